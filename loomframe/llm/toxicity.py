"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

Inputs. Every word has a word part (a learned vector of its hash, and the
evidence of the hash) and a character part (the mean learned vector of its
n-grams of bytes, and the largest and mean evidence of those). Evidence is the
log odds of toxicity in the sample's documents, drawn back by its own
uncertainty. A document's own count is left out while the network is trained
on it.

Network. Windows of WIDTH words, half overlapping, the last one ending with
the text; two gated recurrent layers, one in each direction; attention over
the places of a window; one logit a window. A text scores as its highest
window: all windows of all texts are scored.

Training, on the driver, reads a bounded sample of labelled rows: by a hash of
their key, at most ``toxic_rows`` and ``clean_rows`` rows and texts of at most
``sample_bytes`` bytes. The model has a fixed size (about 9 MB) and is
broadcast. The logits are shifted so that 0.5 parts the sample best.

Toxic texts without evidence in any window count less in training and in the
choice of the threshold: their windows tell little. Toxicity that shares no
word or n-gram with the sample is therefore found less often.

Defined results: a null or blank text has no words and scores 0. Without rows of both labels every score is 0. Null labels aren't used.
Keys, repeated rows and extra columns, whatever their names, play no part in a
score; texts of any length are scored whole; a score of exactly ``least`` (0.5)
is toxic. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, text_of
from .hashing import _FOLDED, chunks, mix, release, trim, words
from .ship import ship

WIDTH, STRIDE = 32, 16
HIDDEN, VECTOR, INPUT = 8, 4, 12
#: Entries of the tables of evidence and of the learned vectors.
EVIDENCE, VECTORS = 1 << 20, 1 << 12
GRAMS = (4, 5)
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY, SEED = 12, 300, 128, 0.01, 0.05, 7
#: Windows, and bytes of text, that are scored at once.
WINDOWS, CHUNK = 4096, 1 << 19

ship(__name__)


def _gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Of every n bytes, folded in case."""
    v = _FOLDED[data]
    out = np.zeros(max(0, len(v) - n + 1), np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + v[i : i + len(out)]
    return mix(out + np.uint64(n))


def _vocabulary(data: np.ndarray, h: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """The distinct words of a chunk: where each word of the text is among them, their hashes, lengths, and their n-grams with offsets."""
    distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    starts, lengths = starts[first], (ends - starts)[first]
    grams, owner = [], []
    for n in GRAMS:
        g = _gram_hashes(data, n)
        count = np.maximum(0, lengths - n + 1)
        who = np.repeat(np.arange(len(distinct)), count)
        at = np.repeat(starts, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        # The n-gram that begins a word is also one of its own kind.
        grams += [g[at], mix(g[starts[count > 0]] + np.uint64(99))]
        owner += [who, np.flatnonzero(count > 0)]
    grams, owner = np.concatenate(grams), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return inverse, distinct, lengths, grams[order], np.searchsorted(owner[order], np.arange(len(distinct) + 1))


def _pooled(values: np.ndarray, offsets: np.ndarray, how) -> np.ndarray:
    """how.reduceat, with 0 for words without n-grams."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float32)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if len(some):
        out[some] = how.reduceat(values, offsets[some])
    return out


def _index(h: np.ndarray, n: int) -> np.ndarray:
    return (h & np.uint64(n - 1)).astype(np.int64)


def _evidence(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    odds = np.log((toxic + 1) / (n_toxic + 2)) - np.log((clean + 1) / (n_clean + 2))
    unsure = 1.5 * np.sqrt(1 / (toxic + 1) + 1 / (clean + 1))
    return (np.sign(odds) * np.clip(np.abs(odds) - unsure, 0, 4) / 2).astype(np.float32)


def _fixed_inputs(words_evidence: np.ndarray, grams_evidence: np.ndarray, lengths: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = np.maximum(1, np.diff(offsets))
    return np.stack([words_evidence, _pooled(grams_evidence, offsets, np.maximum), _pooled(grams_evidence, offsets, np.add) / n, np.log1p(lengths) / 3], 1).astype(np.float32)


def window_starts(n: int) -> np.ndarray:
    """Of a text of n words: every STRIDE words, and the last WIDTH."""
    if n <= WIDTH:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WIDTH, STRIDE), n - WIDTH)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new_parameters(rng: np.random.Generator) -> dict[str, np.ndarray]:
    h = HIDDEN
    p = {"words": rng.normal(0, 0.01, (VECTORS, VECTOR)), "grams": rng.normal(0, 0.01, (VECTORS, VECTOR))}
    for d in "fb":
        p |= {f"W{d}": rng.normal(0, 0.4, (INPUT, 3 * h)), f"U{d}": rng.normal(0, 0.3, (h, 3 * h)), f"b{d}": np.zeros(3 * h)}
    p |= {"A": rng.normal(0, 0.3, (2 * h, h)), "a": np.zeros(h), "v": rng.normal(0, 0.3, h), "o": rng.normal(0, 0.3, 2 * h), "c": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _scan(a: np.ndarray, mask: np.ndarray, U: np.ndarray, keep: bool):
    """One direction. a: inputs (time, windows, 3 hidden) after their matrix; returns states (time, windows, hidden) and what backward needs."""
    t, n, _ = a.shape
    h, out, saved = np.zeros((n, HIDDEN), a.dtype), np.empty((t, n, HIDDEN), a.dtype), []
    for i in range(t):
        g = h @ U
        rz = _sigmoid(a[i, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
        c = np.tanh(a[i, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        m = mask[i][:, None]
        if keep:
            saved.append((h, g, r, z, c, m))
        h = h + m * (1 - z) * (c - h)
        out[i] = h
    return out, saved


def _unscan(d_out: np.ndarray, saved: list, U: np.ndarray):
    """Gradients of a and U."""
    t, n, _ = d_out.shape
    d_a, d_U, d_h = np.empty((t, n, 3 * HIDDEN), d_out.dtype), np.zeros_like(U), np.zeros((n, HIDDEN), d_out.dtype)
    for i in reversed(range(t)):
        h, g, r, z, c, m = saved[i]
        d_h = d_h + d_out[i]
        d_c = d_h * m * (1 - z) * (1 - c * c)
        d_z = -d_h * m * (c - h) * z * (1 - z)
        d_r = d_c * g[:, 2 * HIDDEN :] * r * (1 - r)
        d_g = np.concatenate([d_r, d_z, d_c * r], 1)
        d_a[i] = np.concatenate([d_r, d_z, d_c], 1)
        d_U += h.T @ d_g
        d_h = d_h * (1 - m * (1 - z)) + d_g @ U.T
    return d_a, d_U


def forward(p: dict, af: np.ndarray, ab: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows. af, ab: (time, windows, 3 hidden) inputs of both directions; mask: (time, windows), 1 where there is a word."""
    f, saved_f = _scan(af, mask, p["Uf"], keep)
    b, saved_b = _scan(ab[::-1], mask[::-1], p["Ub"], keep)
    s = np.concatenate([f, b[::-1]], 2)
    u = np.tanh(s @ p["A"] + p["a"])
    e = u @ p["v"] + (mask - 1) * np.float32(30)
    w = np.exp(e - e.max(0))
    w /= w.sum(0)
    pooled = (w[:, :, None] * s).sum(0)
    return pooled @ p["o"] + p["c"][0], (saved_f, saved_b, s, u, w, pooled)


def gradients(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0):
    """Loss (mean cross entropy), and its gradients by the parameters (but the vectors) and by x (time, windows, inputs)."""
    logit, (saved_f, saved_b, s, u, w, pooled) = forward(p, x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"], mask, True)
    q = _sigmoid(logit)
    loss = -np.mean(weight * (y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7)))
    d = (weight * (q - y) / len(y)).astype(x.dtype)
    g = {"o": pooled.T @ d, "c": np.array([d.sum()])}
    d_pool = d[:, None] * p["o"]
    d_w = (s * d_pool).sum(2)
    d_s = w[:, :, None] * d_pool
    d_e = w * (d_w - (w * d_w).sum(0))
    d_u = d_e[:, :, None] * p["v"] * (1 - u * u)
    g |= {"v": (u * d_e[:, :, None]).sum((0, 1)), "A": np.tensordot(s, d_u, ((0, 1), (0, 1))), "a": d_u.sum((0, 1))}
    d_s = d_s + d_u @ p["A"].T
    d_x = 0
    for k, d_out, saved in (("f", d_s[:, :, :HIDDEN], saved_f), ("b", d_s[::-1, :, HIDDEN:], saved_b)):
        d_a, g[f"U{k}"] = _unscan(d_out, saved, p[f"U{k}"])
        d_a = d_a if k == "f" else d_a[::-1]
        g[f"W{k}"], g[f"b{k}"] = np.tensordot(x, d_a, ((0, 1), (0, 1))), d_a.sum((0, 1))
        d_x = d_x + d_a @ p[f"W{k}"].T
    return loss, g, d_x


def _table(texts: list[str]):
    """What training needs of each text: words among its distinct ones, their hashes, lengths, n-grams, offsets."""
    out = []
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        h, _, starts, ends = words(data, np.array([0, len(data)]), True)
        inverse, distinct, lengths, grams, offsets = _vocabulary(data, h, starts, ends)
        # Tables are indexed by low bits.
        out.append((inverse.astype(np.int32), distinct.astype(np.uint32), lengths.astype(np.int32), grams.astype(np.uint32), offsets.astype(np.int32)))
    return out


def train(texts: list[str], labels: list[int]) -> dict | None:
    """The model, or None without both labels."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    table = _table(texts)
    n_toxic, n_clean = int(y.sum()), int((1 - y).sum())
    counts = np.zeros((2, 2, EVIDENCE), np.float32)  # of words and n-grams; clean and toxic
    for (_, distinct, _, grams, _), label in zip(table, y):
        for kind, hashes in enumerate((distinct, grams)):
            counts[kind, int(label), np.unique(_index(hashes, EVIDENCE))] += 1

    def without(kind: int, hashes: np.ndarray, label: float) -> np.ndarray:
        i = _index(hashes, EVIDENCE)
        return _evidence(counts[kind, 1, i] - label, counts[kind, 0, i] - (1 - label), n_toxic - int(label), n_clean - int(1 - label))

    rng = np.random.default_rng(SEED)
    fixed, chosen = [], []
    for d, ((inverse, distinct, lengths, grams, offsets), label) in enumerate(zip(table, y)):
        x = _fixed_inputs(without(0, distinct, label), without(1, grams, label), lengths, offsets)
        fixed.append(x)
        signal = (np.maximum(x[:, 0], 0) + np.maximum(x[:, 1], 0))[inverse] if len(inverse) else np.zeros(0, np.float32)
        starts = window_starts(len(inverse))
        sums = np.append(0, np.cumsum(signal))
        best = int(starts[np.argmax(sums[np.minimum(starts + WIDTH, len(inverse))] - sums[starts])])
        # A toxic text without evidence in any window tells little of the window that was chosen.
        strongest = float(signal.max()) if len(signal) else 0.0
        chosen.append((d, best, label, min(1.0, 0.05 + strongest) if label else 1.0))
        if not label:
            chosen.append((d, int(rng.choice(starts)), label, 1.0))
    # Of each chosen window: inputs that stay, places of its words' vectors, its n-grams and how many each word has.
    ready = []
    for d, s, _, _ in chosen:
        inverse, distinct, _, grams, offsets = table[d]
        own = inverse[s : s + WIDTH]
        sizes = np.diff(offsets)[own]
        at = np.repeat(offsets[own], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ready.append((fixed[d][own], _index(distinct[own], VECTORS).astype(np.int32), _index(grams[at], VECTORS).astype(np.int32), sizes))
    p = new_parameters(rng)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    target, trust = (np.array([c[i] for c in chosen], np.float32) for i in (2, 3))
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(chosen)))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(chosen))
        for picks in np.split(order, np.arange(BATCH, len(order), BATCH)):
            x = np.zeros((WIDTH, len(picks), INPUT), np.float32)
            mask = np.zeros((WIDTH, len(picks)), np.float32)
            lengths = np.array([len(ready[i][1]) for i in picks])
            t, j = np.concatenate([np.arange(n) for n in lengths]), np.repeat(np.arange(len(picks)), lengths)
            word, gram = np.concatenate([ready[i][1] for i in picks]), np.concatenate([ready[i][2] for i in picks])
            sizes = np.concatenate([ready[i][3] for i in picks])
            mean = 1 / np.maximum(1, sizes).astype(np.float32)[:, None]
            mask[t, j] = 1
            x[t, j, :4] = np.concatenate([ready[i][0] for i in picks])
            x[t, j, 4:8] = p["words"][word]
            x[t, j, 8:] = _pooled(p["grams"][gram], np.append(0, np.cumsum(sizes)), np.add) * mean
            _, g, d_x = gradients(p, x, mask, target[picks], trust[picks])
            g["words"], g["grams"] = np.zeros_like(p["words"]), np.zeros_like(p["grams"])
            np.add.at(g["words"], word, d_x[t, j, 4:8])
            np.add.at(g["grams"], gram, np.repeat(d_x[t, j, 8:] * mean, sizes, axis=0))
            step += 1
            for k, v in g.items():
                m, v2 = moments[k]
                m += 0.1 * (v - m)
                v2 += 0.001 * (v * v - v2)
                rate = RATE * 0.5 ** (3 * epoch / epochs) * (0.1 if k in ("words", "grams") else 1)
                p[k] -= (rate * ((m / (1 - 0.9**step)) / (np.sqrt(v2 / (1 - 0.999**step)) + 1e-6) + DECAY * p[k])).astype(np.float32)
    model = p | {"evidence_words": _evidence(counts[0, 1], counts[0, 0], n_toxic, n_clean), "evidence_grams": _evidence(counts[1, 1], counts[1, 0], n_toxic, n_clean)}
    for k in ("evidence_words", "evidence_grams"):  # what the sample doesn't hold is no evidence
        kind = int(k == "evidence_grams")
        model[k][counts[kind].sum(0) == 0] = 0
    highest = np.array([_highest(p, _inputs(p, fixed[d], *table[d][1:2], *table[d][3:]), table[d][0], np.array([0, len(table[d][0])]))[0] for d in range(len(y))])
    sure = np.ones(len(y))
    for d, _, label, share in chosen:
        if label:
            sure[d] = share
    model["c"] = model["c"] - _threshold(highest, y, sure)
    return model


def _threshold(logit: np.ndarray, y: np.ndarray, sure: np.ndarray) -> float:
    """Where both labels part best: shares missed and false (by how sure the labels are), the middle of the widest gap among the best."""
    order = np.argsort(logit)
    value, toxic = logit[order], y[order] == 1
    missed = np.append(0, np.cumsum(toxic * sure[order])) / max(1e-9, (toxic * sure[order]).sum())
    false = 1 - np.append(0, np.cumsum(~toxic)) / max(1, (~toxic).sum())
    cost = missed + false
    edges = np.concatenate(([value[0] - 1], value, [value[-1] + 1]))
    gap = edges[1:] - edges[:-1]
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    i = best[np.argmax(gap[best])]
    return float((edges[i] + edges[i + 1]) / 2)


def _inputs(p: dict, fixed: np.ndarray, distinct: np.ndarray, grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """All inputs of the distinct words."""
    vectors = _pooled(p["grams"][_index(grams, VECTORS)], offsets, np.add) / np.maximum(1, np.diff(offsets))[:, None]
    return np.concatenate([fixed, p["words"][_index(distinct, VECTORS)], vectors], 1).astype(np.float32)


def _highest(p: dict, x: np.ndarray, inverse: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The highest logit of each text. x: inputs of distinct words; inverse: the words of all texts; firsts: where texts begin, and the end."""
    # Each word's share of the gates is the same in every window.
    af, ab = x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]
    none = np.zeros((1, 3 * HIDDEN), np.float32)
    af, ab = np.concatenate([af, none]), np.concatenate([ab, none])
    sizes = np.diff(firsts)
    starts = [window_starts(int(n)) for n in sizes]
    text = np.repeat(np.arange(len(sizes)), [len(s) for s in starts])
    begin = np.concatenate(starts) + firsts[:-1][text]
    length = np.minimum(WIDTH, sizes[text])
    padded = np.append(inverse, np.full(WIDTH, len(x)))
    logits = np.empty(len(begin), np.float32)
    for at in range(0, len(begin), WINDOWS):
        here = np.arange(WIDTH)[:, None]
        mask = here < length[at : at + WINDOWS]
        index = np.where(mask, padded[np.minimum(begin[at : at + WINDOWS] + here, len(padded) - 1)], len(x))
        logits[at : at + WINDOWS] = forward(p, af[index], ab[index], mask.astype(np.float32))[0]
    return np.maximum.reduceat(logits, np.searchsorted(text, np.arange(len(sizes))))


def scores(model: dict | None, texts: pa.Array) -> np.ndarray:
    """One score a text, from 0 to 1."""
    if model is None:
        return np.zeros(len(texts))
    out = np.zeros(len(texts))
    for at, data, bounds in chunks(texts, CHUNK):
        h, firsts, starts, ends = words(data, bounds, True)
        inverse, distinct, lengths, grams, offsets = _vocabulary(data, h, starts, ends)
        fixed = _fixed_inputs(model["evidence_words"][_index(distinct, EVIDENCE)], model["evidence_grams"][_index(grams, EVIDENCE)], lengths, offsets)
        highest = _highest(model, _inputs(model, fixed, distinct, grams, offsets), inverse, firsts)
        out[at : at + len(highest)] = np.where(np.diff(firsts) > 0, _sigmoid(highest.astype(np.float64)), 0)
    return out


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", toxic_rows: int = 1200, clean_rows: int = 2000, sample_bytes: int = 200_000) -> dict | None:
    """A model of labelled rows that aren't held out, at most toxic_rows and clean_rows of them."""
    rows = labels.select(col(key).alias("key"), col(label).alias("label")).filter(~held_out(F.col("key")) & F.col("key").isNotNull()).distinct()
    order = F.xxhash64("key")
    picked = rows.filter("label = 1").orderBy(order, "key").limit(toxic_rows).union(rows.filter("label = 0").orderBy(order, "key").limit(clean_rows))
    texts = df.select(col(key).alias("key"), text_of(text).alias("text")).filter(F.octet_length("text") <= sample_bytes)
    sample = texts.join(F.broadcast(picked), "key").groupBy("key", "label").agg(F.min("text").alias("text")).orderBy("key", "label").collect()
    given, known = [r.text for r in sample], [int(r.label) for r in sample]
    del sample
    model = train(given, known)
    trim()
    return model


def _score(model):
    def run(batches):
        release()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(model.value, batch.column(batch.num_columns - 1)))], [*batch.schema.names, "score"])
            trim()

    return run


def score(df: DataFrame, model: dict | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, text, score."""
    rows = df.select(col(key).alias("key"), text_of(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_score(shared), f"key {kind}, text string, score double").select(F.col("key").alias(key), F.col("text").alias(text), "score")


def _accept(model, column: int, least: float):
    def run(batches):
        release()
        for batch in batches:
            yield batch.filter(pa.array(scores(model.value, batch.column(column)) < least))
            trim()

    return run


def accepted(df: DataFrame, model: dict | None, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of df that score below ``least``, all their columns kept."""
    plain = [f"c{i}" for i in range(len(df.columns))]
    fields = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(plain, df.schema.fields))
    shared = df.sparkSession.sparkContext.broadcast(model)
    return df.toDF(*plain).mapInArrow(_accept(shared, df.columns.index(text), least), fields).toDF(*df.columns)
