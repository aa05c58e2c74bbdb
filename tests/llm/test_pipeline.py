"""The pipeline against the same stages done by hand."""

import base64
import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from loomframe.llm import mixture, toxicity
from loomframe.llm import queries as Q

from .test_contracts import brute_components


def test_pipeline_matches_brute_force(spark, sf):
    import public_tokenizers as P
    import tiktoken

    docs = Q.documents(spark, sf)
    rows = {r.doc_id: r for r in docs.collect()}
    model = Q.toxicity_model(spark, sf, docs)
    scored = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    kept = [i for i in rows if scored[i] < 0.5]
    best = {}
    for i in kept:
        best[rows[i].text] = max(best.get(rows[i].text, i), i)
    kept = sorted(best.values())
    groups = brute_components([(i, rows[i].text) for i in kept])
    kept = [i for i in kept if groups[i] == i]
    sizes, order = Counter(), sorted({rows[i].source for i in kept})
    for i in kept:
        sizes[rows[i].source] += len(re.findall(r"[^\x20\x09-\x0D]+", rows[i].text))
    weight = {s: (3.0, 1.0, 2.0)[n % 3] for n, s in enumerate(order)}
    target, free, total = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        free -= full
    target |= {s: level * weight[s] for s in free}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in (x.split() for x in Q.vocabulary()[0].splitlines())}, special_tokens={})
    want = Counter()
    for i in kept:
        rate = target[rows[i].source] / sizes[rows[i].source]
        copies = int(rate) + (int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:8], 16) / 2**32 < rate - int(rate))
        ids = library.encode_ordinary(rows[i].text)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(rows[i].text.encode()).hexdigest()] += copies
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == +want


def test_stages_keep_the_columns(spark, sf):
    docs = Q.documents(spark, sf)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema == docs.schema, name


def test_unit_is_even(spark):
    got = [r[0] for r in spark.range(4000).select(mixture.unit(F.col("id"), "s")).collect()]
    assert all(0 <= x < 1 for x in got) and abs(sum(got) / 4000 - 0.5) < 0.02
