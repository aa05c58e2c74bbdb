"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

1. (row, key, SHA-256 of the text) is written once as a narrow table.
2. A Misra-Gries summary (Spark's approx_top_k, DataSketches' frequent items)
   finds the frequent digests: ``tracked`` counters, so every digest with more
   than about rows / (0.75 * tracked) copies is in it.
3. The winner and size of each candidate are counted exactly (partial
   aggregates; at most ``heavy`` rows) and broadcast: rows with these digests
   are settled map-side and never shuffled.
4. The remaining digests, none of which is frequent, go through one ordinary
   shuffle.

Defined results: null text counts as empty text, and empty texts equal each
other. The largest key of equal texts stays; a null key is the smallest. Of
rows repeated with the same key and text exactly one stays. An empty table
gives an empty table. Other columns, whatever their names, pass through
untouched in ``kept_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut, fresh, text_of

#: Rows up to which the list of those that go is broadcast (about 100 bytes each); beyond, it is joined by shuffling.
BROADCAST_ROWS = 300_000


def _narrow(df: DataFrame, key: str, text: str) -> DataFrame:
    return cut(df.select(F.monotonically_increasing_id().alias("row"), col(key).alias("key"), F.sha2(text_of(text), 256).alias("digest")), "digests")


def _decide(narrow: DataFrame, heavy: int, tracked: int) -> DataFrame:
    items = narrow.agg(F.expr(f"approx_top_k(digest, {heavy}, {tracked})").alias("top")).select(F.explode("top.item").alias("digest"))
    best = F.max(F.struct("key", F.negative("row").alias("row")))
    winners = cut(
        narrow.join(F.broadcast(items), "digest").groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"),
        "winners",
    )
    hot = narrow.join(F.broadcast(winners), "digest")
    rest = narrow.join(F.broadcast(winners), "digest", "left_anti")
    same = Window.partitionBy("digest")
    rest = rest.withColumns({"best": best.over(same), "group_size": F.count(F.lit(1)).over(same)})
    return hot.unionByName(rest).select(
        "row", "key", "digest", F.col("best.key").alias("keep_key"), "group_size", (F.col("row") == -F.col("best.row")).alias("kept")
    )


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", heavy: int = 1024, tracked: int = 8192) -> DataFrame:
    """One row per input row: its key, keep_id, group_size, kept and text_sha256."""
    return _decide(_narrow(df, key, text), heavy, tracked).select(
        F.col("key").alias(key), F.col("keep_key").alias("keep_id"), "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def kept_documents(df: DataFrame, key: str = "doc_id", text: str = "text", heavy: int = 1024, tracked: int = 8192) -> DataFrame:
    """The rows that stay, with all their columns.

    Rows that go are found again by key and digest, so texts aren't shuffled
    while the list of those is short. Of rows that repeat key and text of a
    row that stays, an arbitrary one is kept.
    """
    decided = _decide(_narrow(df, key, text), heavy, tracked).filter("group_size > 1")
    k, g, d, n = (fresh(df, f"__loom_{x}") for x in ("key", "gone", "digest", "row"))
    groups = cut(decided.groupBy(F.col("key").alias(k), F.col("digest").alias(g)).agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")), "decided")
    rows = df.withColumn(d, F.sha2(text_of(text), 256))

    def found(some: DataFrame, how: str) -> DataFrame:
        some = some.select(k, g)
        small = some.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        return rows.join(F.broadcast(some) if small else some, F.col(k).eqNullSafe(col(key)) & (F.col(g) == col(d)), how)

    out = found(groups.filter("not stays"), "left_anti")
    repeated = groups.filter("stays and n > 1")
    if repeated.limit(1).count():
        # Pre-aggregated, so a row that repeats without end is no single task's burden.
        first = found(repeated, "left_semi").groupBy(col(key), col(d)).agg(F.first(F.struct(*[col(c) for c in df.columns])).alias(n))
        # Those that repeat are among the rows that stay, and are taken out of them.
        out = found(groups.filter("not stays or n > 1"), "left_anti")
        out = out.select(*[col(c) for c in df.columns]).unionByName(first.select(*[F.col(n).getField(c).alias(c) for c in df.columns]))
    return out.select(*[col(c) for c in df.columns])
