"""N-gram Jaccard self-join by adaptive multi-match prefixes.

Texts link when their sets of n-word shingles have a Jaccard similarity of at
least ``percent`` / 100. Exact in shingle hashes of 64 bits.

1. Sets are fingerprinted; texts with equal sets form a class, and only the
   least id of a class goes on (an edge ties the others to it).
2. Document frequencies: shingle hashes are packed, a binary row for each task
   and bucket, and counted by bucket. Shingles that occur once can't be shared
   and only their number is kept; the others go back to their documents.
3. Documents whose repeated shingles are too few for any partner leave. The
   others order theirs by frequency, rarest first. A prefix of
   size - least overlap + l shingles must share l with the prefix of a partner
   (of two documents, the smaller l holds for the shorter prefixes). Each
   document takes the l whose estimated cost is least: postings to scan, and
   postings / l candidates to verify.
4. Candidates, first by stars: for each prefix shingle the document with the
   fewest shingles of its own is the hub, and every document is verified
   against the hub it meets most, of those with which it shares at least l in
   all, sizes and repeated shingles permitting. Components of these links are
   formed.
5. Then all pairs of different components that share at least l: these are
   verified too. Pairs inside one component need no check, so a large group
   of near copies costs about one verification a member, and no link between
   components is lost.

6. Where links are counted, the classes of each component are cut into cells
   by size (only equal or neighbouring sizes can link) and blocks; every two
   blocks meet in one task, which intersects whole sets and gives one sum a
   class. No pair is emitted; the work is the square of a component's
   different texts, so callers that need components alone leave it out.

Verification sends each candidate's text to its hub (a hub with many is
salted) and intersects whole sets. Nothing is capped.

Defined results: null or blank texts have no shingles and link with nothing.
Rows that share an id are one node: a link of either counts for both. Links
are counted by row: how many other rows with an id a row links with, its own
copies and those of its partners included. A null id links with nothing, has
a null component and no links. Extra columns change nothing; an empty table
gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut, fresh
from .components import components
from .hashing import mix, release, shingle_sets, trim
from .ship import ship

#: Shingles in a bucket or cell, about, and in what a task packs at once.
BUCKET = 3_000_000
PACK = 1_000_000
#: Rows up to which a list of ids is broadcast (16 bytes each); beyond, it is joined by shuffling.
BROADCAST_IDS = 500_000
#: Longest extension of a prefix that is tried, and what verifying a candidate costs in scanned postings.
LONGEST, VERIFY = 16, 24
#: Texts that one salt of a hub takes.
HUB_ROWS = 200
#: Of a block in which links are counted: classes and shingles, about; smaller cells are cut into blocks of FINE classes, up to FEW of them.
BLOCK_ROWS, BLOCK_SHINGLES, FINE, FEW = 2048, 1_500_000, 128, 8
#: Rows up to which classes and blocks are broadcast (under 100 bytes each).
BROADCAST_CLASSES = 100_000

ship(__name__)


def _print(s: np.ndarray) -> tuple[int, int, int]:
    """Size and fingerprint of a set."""
    return len(s), int(mix(s).sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64))


def _fingerprints(n: int):
    def run(batches):
        release()
        for batch in batches:
            size, f1, f2 = [], [], []
            for _, s in shingle_sets(batch.column(1), n):
                for values, value in zip((size, f1, f2), _print(s)):
                    values.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64())], ["id", "size", "f1", "f2"]
            )
            trim()

    return run


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(a)))


def _pack(n: int, buckets: int):
    """Rows (bucket, ids, sizes, counts, tokens): the low halves of the shingles of one bucket, by document."""

    def flush(ids, sizes, sets):
        lengths = np.array([len(s) for s in sets])
        h = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets)), lengths)
        bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(bucket.astype(np.uint16) if buckets <= 65536 else bucket, kind="stable")
        bucket, doc, low = bucket[order], doc[order], h[order].astype(np.uint32)
        ids, sizes = np.array(ids, np.int64), np.array(sizes, np.uint32)
        out = []
        for s, k in zip(*_runs(bucket)):
            d, counts = _runs(doc[s : s + k])
            who = doc[s : s + k][d]
            out.append((int(bucket[s]), ids[who].tobytes(), sizes[who].tobytes(), counts.astype(np.uint32).tobytes(), low[s : s + k].tobytes()))
        return _batch(out, [("bucket", pa.int64()), *[(x, pa.binary()) for x in ("ids", "sizes", "counts", "tokens")]])

    def run(batches):
        release()
        ids, sizes, sets, held = [], [], [], 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for row, s in shingle_sets(batch.column(1), n):
                if len(s):
                    ids.append(keys[row])
                    sizes.append(len(s))
                    sets.append(s)
                    held += len(s)
                    if held >= PACK:
                        yield flush(ids, sizes, sets)
                        ids, sizes, sets, held = [], [], [], 0
                        trim()
        if held:
            yield flush(ids, sizes, sets)
        ids = sizes = sets = None
        trim()

    return run


def _batch(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [f for f, _ in fields])


def _joined(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)


def _count(cells: int):
    """Of one bucket, the shingles that occur more than once go back to their documents, a row for each cell of documents."""

    def run(table: pa.Table) -> pa.Table:
        release()
        bucket = table.column("bucket")[0].as_py()
        ids, sizes, counts, low = (_joined(table, x, t) for x, t in (("ids", np.int64), ("sizes", np.uint32), ("counts", np.uint32), ("tokens", np.uint32)))
        order = np.argsort(low, kind="stable")
        starts, lengths = _runs(low[order])
        df = np.empty(len(low), np.uint32)
        df[order] = np.repeat(lengths, lengths)
        keep = df > 1
        at = np.repeat(np.arange(len(ids)), counts)[keep]
        low, level = low[keep], np.minimum(255, np.round(8 * np.log2(df[keep]))).astype(np.uint8)
        cell = ((mix(ids.view(np.uint64)) >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
        order = np.lexsort((at, cell[at]))
        at, low, level = at[order], low[order], level[order]
        of = cell[at]
        out = []
        for s, k in zip(*_runs(of)):
            d, c = _runs(at[s : s + k])
            who = at[s : s + k][d]
            out.append((int(of[s]), bucket, ids[who].tobytes(), sizes[who].tobytes(), c.astype(np.uint32).tobytes(), low[s : s + k].tobytes(), level[s : s + k].tobytes()))
        return pa.Table.from_batches([_batch(out, [("cell", pa.int64()), ("bucket", pa.int64()), *[(x, pa.binary()) for x in ("ids", "sizes", "counts", "tokens", "levels")]])])

    return run


def _prefixes(percent: int):
    """Of one cell of documents, the adaptive prefixes: rows (token, id, size, repeated, need, place)."""

    def run(table: pa.Table) -> pa.Table:
        release()
        ids, sizes, counts, low, level = (
            _joined(table, x, t) for x, t in (("ids", np.int64), ("sizes", np.uint32), ("counts", np.uint32), ("tokens", np.uint32), ("levels", np.uint8))
        )
        per_row = np.array([len(b) // 4 for b in table.column("tokens").to_pylist()])
        token = (np.repeat(np.array(table.column("bucket").to_pylist(), np.int64), per_row) << 32) | low
        doc, size = np.repeat(ids, counts), np.repeat(sizes, counts)
        # Rows that share an id may differ in size: they are different sets.
        order = np.lexsort((token, level, size, doc))
        doc, size, token, level = doc[order], size[order].astype(np.int64), token[order], level[order]
        edge = np.concatenate(([True], (doc[1:] != doc[:-1]) | (size[1:] != size[:-1]))) if len(doc) else np.zeros(0, bool)
        starts = np.flatnonzero(edge)
        repeated = np.diff(np.append(starts, len(doc)))
        weight = np.exp2(level / 8.0)
        out = []
        for s, r in zip(starts, repeated):
            n = int(size[s])
            least = -(-percent * n // 100)
            if r < least:
                continue
            # The cost is that of meeting documents of the same size; smaller partners need the longer prefix that is emitted.
            alike = min(r - 1, max(0, r + percent * -2 * n // (100 + percent)))
            scan = np.cumsum(weight[s : s + r])[alike : alike + min(LONGEST, least)]
            extra = int(np.argmin(scan * (1 + VERIFY / np.arange(1, len(scan) + 1)))) + 1
            out.append((s, r - least + extra, n, r, extra))
        if not out:
            return pa.table({"token": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "size": pa.array([], pa.int64()), "repeated": pa.array([], pa.int64()), "need": pa.array([], pa.int64()), "place": pa.array([], pa.int64())})
        s, p, n, r, extra = (np.array(x, np.int64) for x in zip(*out))
        place = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
        at = np.repeat(s, p) + place
        return pa.table({"token": token[at], "id": doc[at], "size": np.repeat(n, p), "repeated": np.repeat(r, p), "need": np.repeat(extra, p), "place": place})

    return run


def _verify(n: int, percent: int):
    """Rows sorted by (hub, salt, role): each text of role 1 against the hub's texts before it."""

    def run(batches):
        release()
        current, hubs = None, []
        for batch in batches:
            hub, salt, role, who = (batch.column(i).to_pylist() for i in range(4))
            a, b = [], []
            for row, s in shingle_sets(batch.column(4), n):
                if (hub[row], salt[row]) != current:
                    current, hubs = (hub[row], salt[row]), []
                if role[row] == 0:
                    hubs.append(s)
                    continue
                for h in hubs:
                    shared = len(np.intersect1d(h, s, assume_unique=True))
                    if shared and 100 * shared >= percent * (len(h) + len(s) - shared):
                        a.append(who[row])
                        b.append(hub[row])
                        break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            trim()

    return run


def _meet(left: dict, right: dict | None, percent: int) -> list[tuple]:
    """Sides are {class: (rows, set)}. Rows (class, rows of the other side's classes that it links with); without right, of its own side's."""
    other = left if right is None else right
    if not left or not other:
        return []
    rows = np.array([r for r, _ in other.values()], np.int64)
    sizes = np.array([len(s) for _, s in other.values()], np.int64)
    known, at = np.unique(np.concatenate([s for _, s in other.values()]), return_inverse=True)
    starts, marks = np.cumsum(sizes) - sizes, np.zeros(len(known), bool)
    back, out = np.zeros(len(sizes), np.int64), []
    for i, (name, (weight, s)) in enumerate(left.items()):
        place = np.minimum(np.searchsorted(known, s), len(known) - 1)
        place = place[known[place] == s]
        marks[place] = True
        shared = np.add.reduceat(marks[at], starts, dtype=np.int64)
        marks[place] = False
        linked = 100 * shared >= percent * (len(s) + sizes - shared)
        if right is None:
            linked[i] = False
        out.append((name, int(rows[linked].sum())))
        back[linked] += weight
    return out if right is None else out + list(zip(other, back.tolist()))


def _tally(n: int, percent: int):
    """Rows sorted by two blocks and the side: one sum for each class of either block that links with some of the other."""

    def flush(key, sides):
        met = _meet(sides[0], None if key[1:3] == key[3:5] else sides[1], percent)
        columns = zip(*((*name, links) for name, links in met if links))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns] or [pa.array([], pa.int64())] * 4, ["size", "f1", "f2", "links"])

    def run(batches):
        release()
        current, sides = None, ({}, {})
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(5))))
            side, rows = batch.column("side").to_pylist(), batch.column("rows").to_pylist()
            names = list(zip(*(batch.column(c).to_pylist() for c in ("size", "f1", "f2"))))
            for row, s in shingle_sets(batch.column("text"), n):
                if keys[row] != current:
                    if current is not None:
                        yield flush(current, sides)
                    current, sides = keys[row], ({}, {})
                # Another text of the same id isn't this class, and a repeated row is it again.
                if names[row] not in sides[side[row]] and _print(s) == names[row]:
                    sides[side[row]][names[row]] = (rows[row], s)
        if current is not None:
            yield flush(current, sides)
        sides = None
        trim()

    return run


def _short(rows: DataFrame) -> DataFrame:
    """rows, written and to be broadcast while they are few."""
    rows = cut(rows, "classes")
    return F.broadcast(rows) if rows.limit(BROADCAST_CLASSES + 1).count() <= BROADCAST_CLASSES else rows


def _links(texts: DataFrame, classes: DataFrame, found: DataFrame, n: int, percent: int) -> DataFrame:
    """classes: (size, f1, f2, first, rows). Returns (size, f1, f2, links): links of one row of each class that has some."""
    # Two sizes that can link are no further apart than one width; a little more, for rounding.
    width = 1.001 * max(math.log(100 / percent), 0.01)
    reps = classes.join(found.select(F.col("id").alias("first"), "component"), "first").withColumn("band", F.floor(F.log("size") / width))
    reps = cut(reps, "reps")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("total") / BLOCK_SHINGLES), F.least(F.ceil(F.col("n") / FINE), F.lit(FEW)))
    cells = reps.groupBy("component", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).withColumn("blocks", blocks.cast("long"))
    by = Window.partitionBy("component").orderBy("band")  # as many rows as a component has bands
    above = F.when(F.lead("band").over(by) == F.col("band") + 1, F.lead("blocks").over(by))
    below = F.when(F.lag("band").over(by) == F.col("band") - 1, F.lag("blocks").over(by))
    cells = cells.select("component", "band", "n", "blocks", F.coalesce(above, F.lit(0)).alias("above"), F.coalesce(below, F.lit(0)).alias("below"))
    cells = _short(cells.filter("n > 1 or above > 0 or below > 0"))

    def meetings(count, place):
        """For each of count blocks, what place makes of its number."""
        return F.filter(F.transform(F.sequence(F.lit(0).cast("long"), count), lambda o: F.when(o < count, place(o))), lambda m: m.isNotNull())

    def meeting(band, low, band2, high, side):
        return F.struct(band.alias("band"), low.alias("low"), band2.alias("band2"), high.alias("high"), side.cast("long").alias("side"))

    band, block = F.col("band"), F.col("block")
    own = meetings(F.when(F.col("n") > 1, F.col("blocks")).otherwise(0), lambda o: meeting(band, F.least(block, o), band, F.greatest(block, o), o < block))
    up = meetings(F.col("above"), lambda o: meeting(band, block, band + 1, o, F.lit(0)))
    down = meetings(F.col("below"), lambda o: meeting(band - 1, o, band, block, F.lit(1)))
    members = reps.join(cells, ["component", "band"]).withColumn("block", F.pmod(F.xxhash64("size", "f1", "f2"), "blocks"))
    members = members.select("component", "size", "f1", "f2", "rows", F.col("first").alias("id"), F.explode(F.concat(own, up, down)).alias("m"))
    key = ["component", "band", "low", "band2", "high"]
    members = members.select("id", "component", *[f"m.{c}" for c in (*key[1:], "side")], "size", "f1", "f2", "rows")
    rows = texts.filter("id is not null").join(_short(members), "id").select(*key, "side", "size", "f1", "f2", "rows", "text")
    rows = rows.repartition(*key).sortWithinPartitions(*key, "side")
    near = rows.mapInArrow(_tally(n, percent), "size long, f1 long, f2 long, links long")
    near = cut(near.groupBy("size", "f1", "f2").agg(F.sum("links").alias("links")), "near")
    total = F.col("rows") - 1 + F.coalesce("links", F.lit(0))
    return classes.join(near, ["size", "f1", "f2"], "left").select("size", "f1", "f2", total.alias("links")).filter("links > 0")


def _only(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """rows joined with ids on id; ids is broadcast while it is short."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if small else ids, "id", how)


def _verified(texts: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """pairs: (id, hub). Returns those that link, as (a, b)."""
    pairs = cut(pairs, "pairs")
    salts = cut(pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).cast("long").alias("salts")), "salts")
    members = pairs.join(salts, "hub").select("id", "hub", F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"), F.lit(1).alias("role"))
    heads = salts.select(F.col("hub").alias("id"), "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"))
    need = cut(members.unionByName(heads), "need")
    rows = _only(texts, need, "inner").select("hub", "salt", "role", "id", "text")
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")
    return cut(rows.mapInArrow(_verify(n, percent), "a long, b long").distinct(), "links")


def similar(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75, links: bool = False) -> DataFrame:
    """One row per input row: id, size (of its set), component (least id of its group) and, if asked for, links (the number of other rows it links with)."""
    texts = df.select(col(key).cast("long").alias("id"), col(text).cast("string").alias("text"))
    prints = cut(texts.mapInArrow(_fingerprints(n), "id long, size long, f1 long, f2 long"), "prints")

    real = prints.filter("id is not null and size > 0")
    # Written, so that the join deals out both sides itself and can split a large class.
    classes = cut(real.groupBy("size", "f1", "f2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("rows")), "first")
    copies = cut(real.join(classes.drop("rows"), ["size", "f1", "f2"]).select("id", "first").distinct(), "copies")
    total = real.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))
    aside = cut(copies.groupBy("id").agg(F.max(F.col("id") == F.col("first")).alias("is_first")).filter("not is_first").select("id"), "aside")
    alone = _only(texts.filter("id is not null"), aside, "left_anti").select("id", "text")

    packed = alone.mapInArrow(_pack(n, buckets), "bucket long, ids binary, sizes binary, counts binary, tokens binary")
    back = packed.groupBy("bucket").applyInArrow(_count(buckets), "cell long, bucket long, ids binary, sizes binary, counts binary, tokens binary, levels binary")
    posts = cut(back.groupBy("cell").applyInArrow(_prefixes(percent), "token long, id long, size long, repeated long, need long, place long"), "prefixes")

    def fits(a: str, b: str):
        """Sizes permit the similarity, and so do the shingles that are repeated at all."""
        na, nb = F.col(f"{a}size"), F.col(f"{b}size")
        return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * F.least(f"{a}repeated", f"{b}repeated") >= percent * (na + nb))

    def need(a: str, b: str):
        return F.least(f"{a}need", f"{b}need")

    def early(a: str, b: str):
        """Of a pair, only places within the prefixes for its own least overlap count: percent * (na + nb) / (100 + percent), at most that of the emitted ones."""
        left = F.least(F.col(f"{a}repeated") - F.col(f"{a}place"), F.col(f"{b}repeated") - F.col(f"{b}place"))
        return percent * (F.col(f"{a}size") + F.col(f"{b}size")) <= (100 + percent) * (left + need(a, b) - 1)

    def candidates(met: DataFrame, a: str, b: str, id: str, hub: str) -> DataFrame:
        """Pairs (id, hub, n) that share as many prefix shingles as they need."""
        met = met.filter(fits(a, b) & early(a, b)).groupBy(F.col(id).alias("id"), F.col(hub).alias("hub"))
        return met.agg(F.count(F.lit(1)).alias("n"), F.min(need(a, b)).alias("need")).filter("n >= need")

    of_hub = [F.col(c).alias(f"hub_{c}") for c in ("size", "repeated", "need", "place")]
    hub = F.min(F.struct((F.col("size") - F.col("repeated")).alias("own"), F.col("id").alias("hub"), *of_hub))
    # What postings are joined with is written first: a join of two plain tables can split a frequent token.
    hubs = posts.groupBy("token").agg(hub.alias("h"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("token", "h.hub", *[f"h.hub_{c}" for c in ("size", "repeated", "need", "place")])
    hubs = cut(hubs, "hubs")
    met = candidates(posts.join(hubs, "token").filter("id <> hub"), "", "hub_", "id", "hub")
    stars = _verified(alone, met.groupBy("id").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub")), n, percent)

    groups = components(stars).withColumnRenamed("node", "id")
    placed = posts.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("token")
    mixed = cut(mixed, "mixed")
    placed = cut(placed.join(mixed, "token", "left_semi"), "placed")
    x, y = (placed.select(*[F.col(c).alias(f"{p}{c}" if c != "token" else c) for c in placed.columns]) for p in "xy")
    pairs = candidates(x.join(y, "token").filter("xcomponent <> ycomponent and xid < yid"), "x", "y", "yid", "xid").select("id", "hub")
    rest = _verified(alone, pairs, n, percent)

    edges = stars.union(rest).union(copies.filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")))
    found = components(edges).withColumnRenamed("node", "id")
    result = ["id", "size", F.coalesce("component", "id").alias("component")]
    if not links:
        return prints.select("id", "size").join(found, "id", "left").select(*result)
    counted = prints.join(_short(_links(texts, classes, found, n, percent)), ["size", "f1", "f2"], "left").join(found, "id", "left")
    return counted.select(*result, F.when(F.col("id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).alias("links"))


def representatives(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """The rows of df whose id is the least of its group, all columns kept; rows with a null id stay."""
    found = cut(similar(df, key, text, n, percent).filter("id <> component").select("id").distinct(), "dropped")
    small = found.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    own = fresh(df, "__loom_id")
    gone = found.withColumnRenamed("id", own)
    return df.join(F.broadcast(gone) if small else gone, col(key).cast("long") == F.col(own), "left_anti")
