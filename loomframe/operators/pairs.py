"""Measures of every vector of one table with every vector of another, in blocks.

Rows are packed into blocks of vectors of one length, so what is joined is
blocks, and each pair of blocks is a few operations on whole arrays. Sums run
over the places in their order, as in the functions of vectors.py, whose rules
for nulls hold: vectors that are null, have nulls or have other lengths give
null, and so do cosines and correlations of a vector without a norm. Jaccard
similarity alone takes a place that is null or lacking as zero.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block and its bytes at most, rows of a block worked on at once (the sums stay in the processor's cache).
BLOCK, BLOCK_BYTES, TILE = 512, 2 << 20, 64
#: The optimizer's estimate of the bytes of the right table up to which its blocks are broadcast; beyond, both tables' blocks are multiplied part by part.
BROADCAST_BYTES = 64 << 20

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _pack(batches):
    """Blocks of (id, vector of doubles) rows: ids, length of each vector (-1: none), whether none has nulls, doubles one after the other (nulls as 0)."""
    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        width = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        whole, flat = np.ones(len(width), bool), vectors.flatten()
        if flat.null_count:
            whole[pc.list_parent_indices(vectors).to_numpy(zero_copy_only=False)[flat.is_null().to_numpy(zero_copy_only=False)]] = False
        out = []
        for w, full in sorted({*zip(width.tolist(), whole.tolist())}):
            own = np.flatnonzero((width == w) & (whole == full))
            n = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, w))))
            for part in (pa.array(own[i : i + n]) for i in range(0, len(own), n)):
                data = pc.fill_null(vectors.take(part).flatten(), 0.0).to_numpy(zero_copy_only=False).tobytes() if w > 0 else b""
                out.append((ids.take(part), w, full, data))
        if out:
            listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x[0]) for x in out)]), pa.int32()), pa.concat_arrays([x[0] for x in out]))
            yield pa.RecordBatch.from_arrays([listed, *[pa.array([x[k] for x in out], kind) for k, kind in ((1, pa.int32()), (2, pa.bool_()), (3, pa.binary()))]], ["ids", "width", "whole", "data"])


def _dot(a, b):
    """Sums of products of columns of a and b: one row for each place."""
    out, product = np.zeros((a.shape[1], b.shape[1])), np.empty((a.shape[1], b.shape[1]))
    for x, y in zip(a, b):
        np.multiply(x[:, None], y, out=product)
        out += product
    return out


def _square(a):
    out = np.zeros(a.shape[1])
    for x in a:
        out += x * x
    return out


def _over_norms(dots, xx, yy):
    """Within -1 and 1; null without a norm."""
    plain = all(((s > 1e-150) & (s < 1e150)).all() for s in (xx, yy))
    n = np.sqrt(xx[:, None] * yy) if plain else np.sqrt(xx)[:, None] * np.sqrt(yy)
    return np.clip(dots / n, -1.0, 1.0), None if plain else n == 0


def _distance(a, b):
    out, gap = np.zeros((a.shape[1], b.shape[1])), np.empty((a.shape[1], b.shape[1]))
    for x, y in zip(a, b):
        np.subtract(x[:, None], y, out=gap)
        np.multiply(gap, gap, out=gap)
        out += gap
    return np.sqrt(out, out=out)


def _centred(a):
    total = np.zeros(a.shape[1])
    for x in a:
        total += x
    return a - total / max(1, len(a))


def _shared_places(a, b, more=0):
    """Jaccard similarity of the places that aren't zero: whole numbers, exact in any order. more: places that one vector alone has."""
    a, b = (a != 0).astype(np.float64), (b != 0).astype(np.float64)
    both = a.T @ b
    either = a.sum(0)[:, None] + b.sum(0) - both + more
    return both / either, either == 0


def _measured(names, a, b, whole):
    """Each measure of columns of a with columns of b, and where it is null: everywhere, except for Jaccard similarity, if the lengths differ or they aren't whole."""
    fit = whole and len(a) == len(b)
    if fit and {"dot_product", "cosine_similarity", "cosine_distance"} & {*names}:
        dots = _dot(a, b)
        cosines, none = _over_norms(dots, _square(a), _square(b))
    for name in names:
        if name == "jaccard_similarity":
            n = min(len(a), len(b))
            yield _shared_places(a, b) if len(a) == len(b) else _shared_places(a[:n], b[:n], (a[n:] != 0).sum(0)[:, None] + (b[n:] != 0).sum(0))
        elif not fit:
            yield _nulls(a.shape[1], b.shape[1])
        elif name == "dot_product":
            yield dots, None
        elif name == "cosine_similarity":
            yield cosines, none
        elif name == "cosine_distance":
            yield 1 - cosines, none
        elif name == "euclidean_distance":
            yield _distance(a, b), None
        else:
            x, y = _centred(a), _centred(b)
            yield _over_norms(_dot(x, y), _square(x), _square(y))


def _nulls(n, m):
    return np.zeros((n, m)), np.ones((n, m), bool)


MEASURES = ("dot_product", "cosine_similarity", "cosine_distance", "euclidean_distance", "pearson_correlation", "jaccard_similarity")


def _rounded(values, decimals: int):
    """Halves away from zero, as SQL rounds doubles: times a power of ten, to a whole number, and back."""
    power = 10.0**decimals
    scaled = values * power
    whole = np.trunc(scaled)
    whole += np.copysign(np.abs(scaled - whole) >= 0.5, scaled)
    whole /= power
    return whole if np.isfinite(whole).all() else np.where(np.isfinite(whole), whole, values)


def _measure(ids, names, decimals):
    def run(batches):
        with np.errstate(all="ignore"):
            for batch in batches:
                for row in range(batch.num_rows):
                    (a_ids, a_width, a_whole, a_data), (b_ids, b_width, b_whole, b_data) = ([batch.column(k)[row] for k in range(i, i + 4)] for i in (0, 4))
                    a_ids, b_ids, there, whole = a_ids.values, b_ids.values, min(a_width.as_py(), b_width.as_py()) >= 0, a_whole.as_py() and b_whole.as_py()
                    if there:
                        a, b = (np.ascontiguousarray(np.frombuffer(d.as_buffer(), np.float64).reshape(len(i), w.as_py()).T) for i, w, d in ((a_ids, a_width, a_data), (b_ids, b_width, b_data)))
                    for start in range(0, len(a_ids), TILE):
                        n = min(TILE, len(a_ids) - start)
                        columns = [a_ids.take(pa.array(np.repeat(np.arange(start, start + n), len(b_ids)))), b_ids.take(pa.array(np.tile(np.arange(len(b_ids)), n)))]
                        for values, none in _measured(names, a[:, start : start + n], b, whole) if there else [_nulls(n, len(b_ids))] * len(names):
                            values = values if decimals is None else _rounded(values, decimals)
                            columns.append(pa.array(values.ravel(), pa.float64(), mask=none if none is None else none.ravel()))
                        yield pa.RecordBatch.from_arrays(columns, [*ids, *names])

    return run


def _blocks(df: DataFrame, side: str) -> DataFrame:
    kind = df.schema[0].dataType.simpleString()
    return df.mapInArrow(_pack, f"ids array<{kind}>, width int, whole boolean, data binary").toDF(*[f"{side}_{x}" for x in ("ids", "width", "whole", "data")])


def vector_pairs(left: DataFrame, right: DataFrame, measures, decimals: int | None = None) -> DataFrame:
    """left and right: ids and vectors, under four names. A row for every pair: both ids, and a double for each of MEASURES that is asked for."""
    if not measures or not {*measures} <= {*MEASURES}:
        raise ValueError(f"measures are {', '.join(MEASURES)}: {measures}")
    (i, x), (j, y) = left.columns, right.columns
    a, b = (df.select(F.col(f"`{k}`"), F.col(f"`{v}`").cast("array<double>")) for df, k, v in ((left, i, x), (right, j, y)))
    small = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES
    # Dealt out as rows, so that blocks are full and tasks even however the files are cut.
    packed = F.broadcast(_blocks(b.repartition(1), "right")) if small else _blocks(b.hint("rebalance"), "right")
    both = _blocks(a.hint("rebalance"), "left").crossJoin(packed)
    kinds = [df.schema[0].dataType.simpleString() for df in (a, b)]
    fields = ", ".join(f"{name} double" for name in measures)
    return both.mapInArrow(_measure((i, j), tuple(measures), decimals), f"`{i}` {kinds[0]}, `{j}` {kinds[1]}, {fields}")
