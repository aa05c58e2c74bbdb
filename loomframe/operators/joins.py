"""Joins: naming of columns that clash, strategies, and as-of joins in one shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "anti": "left_anti", "semi": "left_semi", "cross": "cross"}
#: Estimated bytes up to which a side is broadcast where that is asked for.
BROADCAST_BYTES = 256 << 20
#: Keys that are looked at to cut an as-of join without groups into ranges: they decide how even the ranges are and nothing else.
SAMPLED_KEYS = 10_000
_HINT = {"hash": "shuffle_hash", "sort_merge": "merge", "broadcast": "broadcast"}


def _renamed(right: DataFrame, taken: set[str], prefix: str | None, suffix: str | None, spare: set[str]) -> DataFrame:
    """right with its clashing columns renamed, again until none clashes."""
    prefix = "right." if prefix is None and suffix is None else prefix or ""
    for name in right.columns:
        if name in spare:
            continue
        new = name
        while new in taken or (new != name and new in right.columns):
            new = f"{prefix}{new}{suffix or ''}"
        if new != name:
            right = right.withColumnRenamed(name, new)
    return right


def _small(df: DataFrame) -> bool:
    """Whether the optimizer's estimate of its size permits a broadcast; a side of unknown size isn't small."""
    # The gateway gives a number or an object that prints as one.
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= BROADCAST_BYTES


def _bounds(rows: DataFrame, on: str) -> list:
    """Ends of ranges of keys of about as many rows: fewer than the partitions of a shuffle."""
    ranges = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = sorted(r[0] for r in rows.select(on).orderBy(F.xxhash64(on), on).limit(SAMPLED_KEYS).collect())
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def join(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str], how: str, strategy: str | None, prefix: str | None, suffix: str | None, null_safe: bool = False) -> DataFrame:
    """Keys of one name merge into one column; the right side's other clashes are renamed."""
    if how not in _HOW:
        raise ValueError(f"no such join: {how}")
    if how == "cross":
        return left.crossJoin(_renamed(right, set(left.columns), prefix, suffix, set()))
    if strategy == "sort_merge" and how != "inner" or strategy == "broadcast" and how == "outer":
        raise ValueError(f"{strategy} joins can't be {how}")
    if not left_on:
        raise ValueError("a join needs keys")
    shared = [a for a, b in zip(left_on, right_on) if a == b]
    hint = (lambda d: d) if strategy is None or strategy == "broadcast" and not _small(right) else (lambda d: d.hint(_HINT[strategy]))
    if how in ("anti", "semi"):
        r = right.select(*[F.col(f"`{b}`").alias(f"__k{i}") for i, b in enumerate(right_on)])
        on = [left[a].eqNullSafe(r[f"__k{i}"]) if null_safe else left[a] == r[f"__k{i}"] for i, a in enumerate(left_on)]
        return left.join(hint(r), on, _HOW[how])
    right = _renamed(right, set(left.columns), prefix, suffix, set(shared))
    inner = {b: f"__k{i}" for i, b in enumerate(right_on) if b in shared}
    r = right.withColumnsRenamed(inner)
    on = [left[a].eqNullSafe(r[inner.get(b, b)]) if null_safe else left[a] == r[inner.get(b, b)] for a, b in zip(left_on, right_on)]
    out = left.join(hint(r), on, _HOW[how])
    merge = {"inner": lambda a: left[a], "left": lambda a: left[a], "right": lambda a: r[inner[a]], "outer": lambda a: F.coalesce(left[a], r[inner[a]])}[how]
    keys = [merge(a).alias(a) for a in shared]
    return out.select(*keys, *[left[c] for c in left.columns if c not in shared], *[r[f"`{c}`"] for c in r.columns if c not in inner.values()])


def asof(left: DataFrame, right: DataFrame, left_on: str, right_on: str, left_by: list[str], right_by: list[str], strategy: str, prefix: str | None, suffix: str | None) -> DataFrame:
    """For each left row the right row of its group that is last at or before it (backward), first at or after it (forward), or nearest (ties forward).

    Both sides are stacked and sorted once in each group, and the last (or
    first) right row is carried along: one shuffle and one sort, no pairs.
    Without groups the keys are cut into ranges, each a task of its own; the
    last (first) right row of each range, a row a range, is carried over to the
    ranges after (before) it. Rows with a null key or group match nothing.
    """
    if strategy not in ("backward", "forward", "nearest"):
        raise ValueError(f"no such strategy: {strategy}")
    gone = set(right_by) | ({right_on} if left_on == right_on else set())
    kept = right.drop(*gone)
    renamed = _renamed(kept, set(left.columns), prefix, suffix, set())
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept.columns)]) if kept.columns else F.struct(F.lit(1).alias("c0"))
    # Left rows without a key are passed by: they match nothing and would gather in one group.
    whole = F.col(f"`{left_on}`").isNotNull()
    for k in left_by:
        whole = whole & F.col(f"`{k}`").isNotNull()
    nulls = left.filter(~whole)
    a = left.filter(whole).select(
        *[F.col(f"`{k}`").alias(f"__b{i}") for i, k in enumerate(left_by)], F.col(f"`{left_on}`").alias("__on"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(left.columns)]).alias("__left")
    )
    b = right.filter(F.col(f"`{right_on}`").isNotNull()).select(
        *[F.col(f"`{k}`").alias(f"__b{i}") for i, k in enumerate(right_by)], F.col(f"`{right_on}`").alias("__on"), F.struct(F.col(f"`{right_on}`").alias("on"), row.alias("row")).alias("__right")
    )
    rows = a.unionByName(b, allowMissingColumns=True).withColumn("__side", F.col("__left").isNotNull().cast("int"))
    by = [F.col(f"__b{i}") for i in range(len(left_by))]
    found, carried = {}, None
    if not by and (bounds := _bounds(rows, "__on")):
        ends = F.array(*[F.lit(x) for x in bounds]).cast(f"array<{rows.schema['__on'].dataType.simpleString()}>")
        rows = rows.withColumn("__range", F.size(F.filter(ends, lambda x: x <= F.col("__on"))))
        by = [F.col("__range")]
        edges = rows.filter("__side = 0").groupBy("__range").agg(F.max_by("__right", "__on").alias("__last"), F.min_by("__right", "__on").alias("__first"))
        edges = left.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("__range")).join(edges, "__range", "left")
        others = lambda c, order: F.last(c, True).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, -1))
        carried = edges.select("__range", others("__last", F.col("__range")).alias("__before"), others("__first", F.col("__range").desc()).alias("__after"))
    if strategy != "forward":
        w = W.partitionBy(*by).orderBy(F.col("__on").asc(), F.col("__side").asc()).rowsBetween(W.unboundedPreceding, 0)
        found["back"] = F.last("__right", True).over(w)
    if strategy != "backward":
        w = W.partitionBy(*by).orderBy(F.col("__on").desc(), F.col("__side").asc()).rowsBetween(W.unboundedPreceding, 0)
        found["fore"] = F.last("__right", True).over(w)
    rows = rows.withColumns({f"__{k}": x for k, x in found.items()}).filter("__side = 1")
    if carried is not None:
        rows = rows.join(F.broadcast(carried), "__range", "left")
        rows = rows.withColumns({f"__{k}": F.coalesce(f"__{k}", "__before" if k == "back" else "__after") for k in found})
    if strategy == "nearest":
        number = lambda x: F.unix_micros(x.cast("timestamp")) if right.schema[right_on].dataType.typeName().startswith(("timestamp", "date")) else x
        near = F.when(F.col("__fore").isNull(), F.col("__back")).when(F.col("__back").isNull(), F.col("__fore"))
        match = near.when(number(F.col("__fore.on")) - number(F.col("__on")) <= number(F.col("__on")) - number(F.col("__back.on")), F.col("__fore")).otherwise(F.col("__back"))
    else:
        match = F.col("__back" if strategy == "backward" else "__fore")
    rows = rows.withColumn("__match", match)
    right_cols = [F.col(f"__match.row.c{i}").alias(c) for i, c in enumerate(renamed.columns)]
    out = rows.select(*[F.col(f"__left.c{i}").alias(c) for i, c in enumerate(left.columns)], *right_cols)
    empty = [F.lit(None).cast(f.dataType).alias(c) for c, f in zip(renamed.columns, kept.schema.fields)]
    return out.unionAll(nulls.select(*[F.col(f"`{c}`") for c in left.columns], *empty))
