"""Mixing sources to target weights, in DataFrame operations only.

Tokens (words) are summed per source; targets follow the weights, capped at
``most`` times a source's tokens, the excess going to the others by weight
(water filling: target = least(cap, level * weight)). The rate of a source is
target / tokens; each document is taken floor(rate) times plus once more if a
hash of its key falls below the fraction.

Defined results: null text has no tokens and is taken by its rate like any
other; a source without tokens has target and rate 0. The null source is a
source, last in the order. Rows that repeat a key are taken alike. Extra
columns, whatever their names, play no part and are kept by ``emit``. The table
of sources is ordered by one task: it takes thousands of sources, not a source
for each record. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, col, cut, fresh, text_of

#: Sources up to which their table, of four numbers and a name a row, is broadcast; beyond, it is joined by shuffling.
BROADCAST_SOURCES = 10_000


def tokens(text: str) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def unit(key: Column, seed: str) -> Column:
    """A number in [0, 1) that key and seed decide: 32 bits of MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """sizes: (source, source_size). Adds target and rate. One row per source, so the windows are small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("nth"), F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("nth", F.row_number().over(order) - 1).withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    everything = Window.partitionBy()
    rows = rows.withColumns(
        {
            "total": F.sum("source_size").over(everything) * F.lit(float(share)),
            "caps_before": F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "weights_from": F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    level = (F.col("total") - F.col("caps_before")) / F.col("weights_from")
    # The level is that of the first source in filling order whose cap isn't reached.
    rows = rows.withColumn("level", F.when(level <= F.col("cap") / F.col("weight"), level))
    rows = rows.withColumn("level", F.first("level", True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap"))
    return rows.select("source", "source_size", target.alias("target"), F.coalesce(F.try_divide(target, F.col("source_size").cast("double")), F.lit(0.0)).alias("rate"))


def _names(df: DataFrame) -> dict[str, str]:
    """Names of the columns that a mix adds: none of df's."""
    return {c: fresh(df, f"__loom_{c}") for c in ("source", "source_size", "target", "rate", "copies", "nth", "size", "own")}


def mix(df: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix", keep_columns: bool = False) -> DataFrame:
    """keep_columns: df's columns (for ``emit``); else key and size. Adds __loom_source_size, __loom_target, __loom_copies, with more underscores in front where df has such columns."""
    names = _names(df)
    size, s = names["size"], names["own"]
    rows = df.withColumn(size, tokens(text)).withColumn(s, col(source))
    sizes = rows.groupBy(col(s).alias("source")).agg(F.sum(col(size)).alias("source_size"))
    table = cut(targets(sizes, weights, share, most), "targets")
    small = table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    mixed = table.select(*[F.col(c).alias(names[c]) for c in ("source", "source_size", "target", "rate")])
    rows = rows.join(F.broadcast(mixed) if small else mixed, col(s).eqNullSafe(F.col(names["source"])))
    rate = F.col(names["rate"])
    whole = F.floor(rate)
    copies = (whole + F.when(unit(col(key), seed) < rate - whole, 1).otherwise(0)).alias(names["copies"])
    mine = [col(c) for c in df.columns] if keep_columns else [col(key), col(size).alias("size")]
    return rows.select(*mine, names["source_size"], names["target"], copies)


def emit(df: DataFrame, weights: list[float], **options) -> DataFrame:
    """df's rows, each as often as the mix takes it."""
    names = _names(df)
    copies = F.col(names["copies"])
    rows = mix(df, weights, keep_columns=True, **options).filter(copies > 0)
    return rows.withColumn(names["nth"], F.explode(F.sequence(F.lit(1), copies.cast("int")))).select(*[col(c) for c in df.columns])
