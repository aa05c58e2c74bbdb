"""Event-time aggregates that run the same on tables and on streams: buckets with a watermark, and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], aggregates: dict, late: str | None = None) -> DataFrame:
    """Buckets of a fixed width from 1970. late: how far behind the latest time rows are still counted, on streams."""
    t = F.col(time).cast("timestamp")
    rows = df.withColumn("__time", t)
    rows = rows.withWatermark("__time", late) if late else rows
    grouped = rows.groupBy(F.window("__time", width).alias("__window"), *keys).agg(*[x.alias(n) for n, x in aggregates.items()])
    return grouped.select(F.col("__window.start").cast("timestamp_ntz").alias("bucket"), *keys, *aggregates)


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], aggregates: dict, late: str | None = None) -> DataFrame:
    """Rows of a key that follow each other within gap."""
    rows = df.withColumn("__time", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("__time", late) if late else rows
    grouped = rows.groupBy(F.session_window("__time", gap).alias("__window"), *keys).agg(*[x.alias(n) for n, x in aggregates.items()])
    return grouped.select(F.col("__window.start").cast("timestamp_ntz").alias("started"), F.col("__window.end").cast("timestamp_ntz").alias("ended"), *keys, *aggregates)


def read_stream(spark, path: str, schema, kind: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
