"""Odd tables through every operator and every stage of the pipeline; broken and unusual containers; draws and scores by hand."""

import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from loomframe.llm import bpe, exact_dedup, isomedia, jaccard, mixture, pii, sharding, substring, toxicity, warc
from loomframe.llm import queries as Q

#: Names that operators use themselves, or once did.
CLASHING = (
    "key row size digest info rank rate copies nth source_size target component id hub token score __loom_id __loom_key __loom_k __loom_d __loom_gone __loom_digest __loom_row "
    "__loom_source __loom_source_size __loom_target __loom_rate __loom_copies __loom_nth __loom_size __loom_own kept spans n_words c0 media canon label"
).split()


@pytest.fixture(scope="module")
def clashing(spark):
    """Null keys and texts, blanks, a text of 60,000 words, repeated rows, equal texts; columns with names that operators use."""
    rng = random.Random(4)
    long_text = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", "b"), (5, "one", "b"), (5, "one", "b"), (5, "one", "b"), (6, long_text, "b"), (7, long_text + " more", "c"), (None, "one", "b"), (None, None, None), (None, None, None), (8, "mail me@x.org +1 (366) 555-9807", "c")]
    df = spark.createDataFrame([(*r, *(["x"] * len(CLASHING))) for r in rows], f"doc_id long, text string, source string, {', '.join(f'`{c}` string' for c in CLASHING)}")
    return df, rows


def same_columns(out, df):
    assert out.columns == df.columns and all(r.asDict()["__loom_rate"] == "x" for r in out.collect())
    return out


def test_operators_on_clashing_names(spark, clashing):
    df, rows = clashing
    n = len(rows)
    found = jaccard.similar(df).collect()
    assert len(found) == n and {r.component for r in found if r.id in (6, 7)} == {6} and {r.component for r in found if r.id in (4, 5)} == {4}
    assert sorted(r.doc_id or 0 for r in same_columns(jaccard.representatives(df), df).collect()) == [0, 0, 0, 1, 2, 3, 4, 6, 8]
    assert exact_dedup.exact_dedup(df).count() == n
    kept = same_columns(exact_dedup.kept_documents(df), df).collect()
    assert Counter(r.doc_id for r in kept) == Counter([2, 3, 5, 6, 7, 8])
    assert Counter(r.shard for r in sharding.shard(df, [1.0] * 3).collect()).total() == n
    mixed = mixture.mix(df, Q.MIX).collect()
    assert len(mixed) == n and sum(r[-1] for r in mixed) == same_columns(mixture.emit(df, Q.MIX), df).count()
    assert pii.replace(df).filter("n_entities = 2").count() == 1
    media = isomedia.inspect(isomedia.write_media(df), with_payload=True).collect()
    assert len(media) == n and {r["info"].original_bytes for r in media if r.doc_id == 6} == {len(rows[7][1])}
    assert isomedia.inspect(df).columns[-1] == "_info" and all(r[-1] is None for r in isomedia.inspect(df).collect())
    coded = bpe.round_trip(df, *Q.vocabulary()).collect()
    assert Counter(bytes(r.decoded).decode() for r in coded) == Counter(t or "" for _, t, _ in rows)
    assert Counter((r.doc_id, r.n_words) for r in substring.remove_repeats(df).collect()) == Counter((i, len((t or "").split())) for i, t, _ in rows)
    pages = df.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumnRenamed("source", "url")
    assert warc.archive(pages).count() == n


def test_toxicity_of_odd_rows_with_a_small_sample(spark, clashing):
    """A model of sixty rows: blank texts score 0, equal texts equal scores; ties at the threshold are toxic."""
    df, rows = clashing
    rng = random.Random(1)
    train = [(100 + i, " ".join([*(rng.choice("abcdefgh") * 3 for _ in range(20)), "badword" if i % 2 else "fineword"]), i % 2) for i in range(60)]
    known = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    model = toxicity.fit(known, known)
    got = [(r.doc_id, r.text, r.score) for r in toxicity.score(df, model).collect()]
    assert len(got) == len(rows) and all(s == 0 for _, t, s in got if not t.strip()) and all(0 <= s <= 1 for *_, s in got)
    assert len({s for _, t, s in got if t == "one"}) == 1
    same_columns(toxicity.accepted(df, model), df)
    score = toxicity.scores(model, pa.array(["one"]))[0]
    one = spark.createDataFrame([(1, "one")], "doc_id long, text string")
    assert toxicity.accepted(one, model, least=float(score)).count() == 0 and toxicity.accepted(one, model, least=float(np.nextafter(score, 1))).count() == 1


def test_toxicity_scores_by_hand(spark, sf):
    """Scores of whole documents against a plain loop over windows and words."""
    docs = Q.documents(spark, sf)
    m = Q.toxicity_model(spark, sf, docs)
    texts = [r.text for r in docs.orderBy("doc_id").limit(25).collect()] + ["one", "two words"]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def by_hand(text):
        (inverse, distinct, lengths, grams, offsets), = toxicity._table([text])
        at = lambda h, n: (h & np.uint32(n - 1)).astype(int)
        x = []
        for w, h in enumerate(distinct):
            g = grams[offsets[w] : offsets[w + 1]]
            e = m["evidence_grams"][at(g, toxicity.EVIDENCE)]
            fixed = [m["evidence_words"][at(h, toxicity.EVIDENCE)], e.max() if len(e) else 0, e.mean() if len(e) else 0, math.log1p(lengths[w]) / 3]
            x.append(np.concatenate([fixed, m["words"][at(h, toxicity.VECTORS)], m["grams"][at(g, toxicity.VECTORS)].mean(0) if len(g) else np.zeros(toxicity.VECTOR)]))
        best, n, k = -np.inf, len(inverse), toxicity.HIDDEN
        for s in {*range(0, max(1, n - toxicity.WIDTH), toxicity.STRIDE), max(0, n - toxicity.WIDTH)}:
            own = [x[i] for i in inverse[s : s + toxicity.WIDTH]]
            states = []
            for d, seq in (("f", own), ("b", own[::-1])):
                h, out = np.zeros(k), []
                for v in seq:
                    a, g = v @ m[f"W{d}"] + m[f"b{d}"], h @ m[f"U{d}"]
                    r, z = sigmoid(a[:k] + g[:k]), sigmoid(a[k : 2 * k] + g[k : 2 * k])
                    c = np.tanh(a[2 * k :] + r * g[2 * k :])
                    h = h + (1 - z) * (c - h)
                    out.append(h)
                states.append(out if d == "f" else out[::-1])
            both = np.concatenate([np.array(states[0]), np.array(states[1])], 1)
            e = np.tanh(both @ m["A"] + m["a"]) @ m["v"]
            w = np.exp(e - e.max())
            best = max(best, float((w / w.sum()) @ both @ m["o"] + m["c"][0]))
        return sigmoid(best)

    assert np.allclose(toxicity.scores(m, pa.array(texts)), [by_hand(t) for t in texts], atol=1e-4)


def draw(key, shard, weight):
    seed = xxhash.xxh64(struct.pack("<q", key), 42).intdigest() if key is not None else 42
    h = xxhash.xxh64(struct.pack("<i", shard), seed).intdigest()
    return -weight / math.log(((h >> 11) + 0.5) / 2**53)


def test_sharding_by_hand(spark, sf):
    rows = Q.documents(spark, sf).collect()
    got = {r.doc_id: r for r in Q.op3_rendezvous_sharding(spark, sf).collect()}
    for r in rows:
        draws = [draw(r.doc_id, s, 1.0) for s in range(41)]
        best = int(np.argmax(draws[:40]))
        g = got[r.doc_id]
        text = (r.text or "").encode()
        assert (g.shard, g.grown_shard, g.size, g.text_crc32, g.law) == (best, 40 if draws[40] > draws[best] else best, len(text) + 16, zlib.crc32(text), "key")
    for s in range(40):
        mine = sorted(g.slot for g in got.values() if g.shard == s)
        assert mine == list(range(len(mine)))


def test_weighted_sharding_grows_by_weight(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "'x' as text")
    grown = {r.doc_id: r for r in sharding.shard(df, [3.0, 1.0], grown_weight=4.0).collect()}
    again = {r.doc_id: r.shard for r in sharding.shard(df, [3.0, 1.0, 4.0]).collect()}
    assert all(again[i] == r.grown_shard for i, r in grown.items()) and abs(sum(r.grown_shard == 2 for r in grown.values()) / 20000 - 0.5) < 0.02


def test_broken_containers_give_null_rows(spark):
    good = isomedia.encode(b"a" * 3000)
    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    deep = b""
    for _ in range(1500):
        deep = box(b"moov", deep)
    swap = lambda kind, skip, value: good[: (at := good.index(kind) + 4 + skip)] + struct.pack(">I", value) + good[at + 4 :]
    broken = [
        deep, b"", b"\0", good[:50], box(b"moov", b""), good.replace(b"trak", b"free"), swap(b"stsz", 8, 2**32 - 1), swap(b"stts", 4, 2**32 - 1), swap(b"stsc", 4, 2**32 - 1),
        swap(b"stco", 4, 2**32 - 1), swap(b"stco", 8, 2**31), swap(b"stss", 8, 2**31), swap(b"stss", 4, 2**31), swap(b"stsc", 8, 7), struct.pack(">I4sQ", 1, b"moov", 2**63) + bytes(8),
    ]
    rng = random.Random(3)
    noise = [bytes(rng.randrange(256) if rng.random() < 0.03 else b for b in good[:800]) + good[800:] for _ in range(200)]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate([*broken, good, *noise])], "id long, media binary")
    got = {r.id: r.info for r in isomedia.inspect(df, with_payload=True).collect()}
    assert [got[i] for i in range(len(broken))] == [None] * len(broken) and got[len(broken)].samples == 6 and len(got) == df.count()


def test_tracks_and_fragments():
    """An audio track before the video track; 4-bit sample sizes; two fragments, one by defaults and one with a run that tells all."""
    box, full = isomedia._box, isomedia._full

    def track(n, kind, codec, table, duration=0):
        info = box(b"minf", box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(codec, bytes(8))), *table))
        return box(
            b"trak", full(b"tkhd", struct.pack(">IIIII", 0, 0, n, 0, 0)),
            box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, duration, 0, 0)), full(b"hdlr", bytes(4), kind, bytes(12)), info),
        )

    empty = [full(b"stts", struct.pack(">I", 0)), full(b"stsc", struct.pack(">I", 0)), full(b"stsz", struct.pack(">II", 0, 0)), full(b"stco", struct.pack(">I", 0))]
    head = box(b"ftyp", b"isom", bytes(4))
    audio = lambda at: [
        full(b"stts", struct.pack(">IIIII", 2, 2, 10, 1, 5)), full(b"stsc", struct.pack(">IIII", 1, 1, 2, 1)), full(b"stz2", bytes([0, 0, 0, 4]), struct.pack(">I", 3), bytes([0x34, 0x50])),
        full(b"stco", struct.pack(">III", 2, at, at + 100)),
    ]
    movie = lambda at: head + box(b"moov", track(1, b"soun", b"mp4a", audio(at), 99), track(2, b"vide", b"avc1", empty, 7), box(b"mvex", full(b"trex", struct.pack(">5I", 2, 1, 40, 6, 0x10000))))
    data = movie(len(movie(0)) + 8) + box(b"mdat", bytes(200))
    first = len(data)
    run = full(b"trun", struct.pack(">III", 2, first + 0, 0), flags=5)  # data offset, first sample's flags
    size = len(box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 2)), run)))
    run = full(b"trun", struct.pack(">IiI", 2, size + 8, 0), flags=5)
    data += box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 2)), run)) + box(b"mdat", b"v" * 12)
    second = len(data)
    tell = lambda at: box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">IQ", 2, second), flags=1), full(b"trun", struct.pack(">Ii", 2, at), struct.pack(">6I", 15, 3, 0x10000, 25, 4, 0), flags=0x701)))
    data += tell(len(tell(0)) + 8) + box(b"mdat", b"xxxyyyy")
    info = isomedia.inspect_bytes(data)
    sound = info["tracks"][0]
    assert (sound["codec"], sound["duration"], sound["sizes"].tolist()) == ("mp4a", 25, [3, 4, 5]) and [t for *_, t in sound["keyframes"]] == [0, 10, 20]
    at = len(movie(0)) + 8
    assert sound["offsets"].tolist() == [at, at + 3, at + 100]
    assert (info["kind"], info["codec"], info["samples"], info["duration"]) == ("vide", "avc1", 4, 120) and isomedia.payload(data, info) == b"v" * 12 + b"xxxyyyy"
    assert info["keyframes"] == [(first + size + 8, 6, 0), (len(data) - 4, 4, 95)]


def test_media_digests(spark, sf):
    import hashlib

    texts = {r.doc_id: (r.text or "").encode() for r in Q.documents(spark, sf).collect()}
    for r in Q.op6_iso_media(spark, sf).collect():
        padded = texts[r.doc_id] + b"\xff" * (-len(texts[r.doc_id]) % 576 if texts[r.doc_id] else 576)
        media = isomedia.encode(texts[r.doc_id])
        frames, at = len(padded) // 576, len(media) - len(padded)
        ranges = ",".join(f"{at + i * 576}+576" for i in range(0, frames, 24))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media), hashlib.sha256(media).hexdigest(), f"codec=raw duration={frames}/24 keyframes={ranges}")


def test_archives_of_other_writers(spark, tmp_path):
    """Header names in other cases, several gzip members, plain files; an archive that ends within a record is an error."""
    import gzip

    record = lambda kind, n, block: f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-RECORD-ID: <urn:{n}>\r\ncontent-length: {len(block)}\r\nContent-Type: application/http\r\n\r\n".encode() + block + b"\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record("response", 1, b"HTTP/1.1 200 OK\r\n\r\nbody")) + gzip.compress(record("request", 2, b"GET / HTTP/1.1\r\n\r\n")))
    (tmp_path / "b.warc").write_bytes(record("response", 3, b"HTTP/1.1 200 OK\r\n\r\n") * 2)
    got = warc.read(spark, str(tmp_path)).collect()
    assert Counter((r.record_id, r.payload_bytes) for r in got) == Counter([("<urn:1>", 4), ("<urn:2>", None), ("<urn:3>", 0), ("<urn:3>", 0)])
    (tmp_path / "c.warc").write_bytes(record("response", 4, b"HTTP/1.1 200 OK\r\n\r\nbody")[:-8])
    with pytest.raises(Exception, match="a record ends with its file"):
        warc.read(spark, str(tmp_path)).collect()


def test_every_stage_on_odd_and_empty_tables(spark, clashing, sf):
    df, rows = clashing
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, df, sf), stage(spark, df.limit(0), sf)
        assert none.count() == 0 and out.count() <= 2 * len(rows)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == df.columns and none.columns == df.columns
