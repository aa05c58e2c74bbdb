"""Sharding by weighted rendezvous hashing, in DataFrame operations only.

Every shard draws a number from (record key, shard); weights scale it as
-weight / ln(u), and the largest draw wins. The key and the list of shards
alone decide, so one more shard takes rows only into itself.

Slots (ranks within a shard, gapless from 0) are dealt in two levels: a shard
is cut into cells by a hash of the row, cells are counted, and a running sum
over the small table of cells gives each cell its first slot. No task sorts a
whole shard.

Defined results: a null key is a key like any other; null text has size
``overhead`` and the CRC-32 of no bytes (0). Rows that repeat a key share a
shard and have slots of their own; ties in a draw go to the lower shard. Extra
columns play no part. An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, text_of

#: Rows in a cell, about.
CELL_ROWS = 50_000


def _draw(key: Column, shard: Column, weight: Column) -> Column:
    """-weight / ln(u), u in (0, 1) from 53 bits of the hash."""
    u = (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return -weight / F.log(u)


def rendezvous(key: Column, weights: list[float], first: int = 0) -> Column:
    """struct(draw, -shard) of the shard that wins; ties go to the lower number."""
    ws = F.array(*[F.lit(float(w)) for w in weights])
    return F.array_max(
        F.transform(
            F.sequence(F.lit(first), F.lit(first + len(weights) - 1)),
            lambda s: F.struct(_draw(key, s, F.element_at(ws, s - first + 1)).alias("draw"), (-s).alias("negated")),
        )
    )


def shard(df: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text", grown_weight: float = 1.0, overhead: int = 16) -> DataFrame:
    """Per row: key, size, text_crc32, law, shard, slot, grown_shard (with one more shard of ``grown_weight``)."""
    n = len(weights)
    k = F.col("key")
    rows = df.select(
        col(key).alias("key"),
        (F.octet_length(text_of(text)) + overhead).cast("long").alias("size"),
        F.crc32(text_of(text)).alias("text_crc32"),
    )
    rows = rows.withColumn("win", rendezvous(k, weights)).withColumn("more", rendezvous(k, [grown_weight], n))
    cells = max(1, math.ceil(df.count() / (n * CELL_ROWS)))
    rows = rows.select(
        "key", "size", "text_crc32",
        (-F.col("win.negated")).alias("shard"),
        F.when(F.col("more.draw") > F.col("win.draw"), F.lit(n)).otherwise(-F.col("win.negated")).alias("grown_shard"),
        F.pmod(F.xxhash64(k, F.col("text_crc32"), F.lit("cell")), F.lit(cells)).alias("cell"),
    )
    counts = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "cell").orderBy("key", "text_crc32", "size")
    return rows.join(starts, ["shard", "cell"]).select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.row_number().over(order) - 1).cast("long").alias("slot"), "grown_shard",
    )
