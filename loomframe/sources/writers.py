"""Sinks. File sinks return the paths they wrote."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

_MODES = {"append": "append", "overwrite": "overwrite", "overwrite-partitions": "overwrite", "error": "error", "ignore": "ignore"}


def _files(df: DataFrame, root: str) -> set[str]:
    """Paths of data files under a folder of any store."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return set()
    found, out = fs.listFiles(path, True), set()
    while found.hasNext():
        p = found.next().getPath()
        if not p.getName().startswith(("_", ".")):
            out.add(p.toString())
    return out


def write(df: DataFrame, root: str, kind: str, mode: str, partition_cols: list[str], options: dict) -> DataFrame:
    """append, overwrite, or overwrite-partitions: only the partitions that df has rows for."""
    if mode not in _MODES:
        raise ValueError(f"no such mode: {mode}")
    before = _files(df, root) if mode == "append" else set()
    writer = df.write.format(kind).mode(_MODES[mode]).options(**options)
    if mode == "overwrite-partitions":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if partition_cols:
        writer = writer.partitionBy(*partition_cols)
    writer.save(root)
    return df.sparkSession.createDataFrame([(p,) for p in sorted(_files(df, root) - before)], "path string")


class Sink:
    """A sink of one's own: start once, write each partition (a list of Arrow batches; tasks that run again write again), finalize with all results."""

    schema = "result string"

    def start(self) -> None:
        pass

    def write(self, batches):
        """Yields one row of ``schema`` for a partition, as a dict."""
        raise NotImplementedError

    def finalize(self, results: list[dict]) -> list[dict]:
        return results


def to_sink(df: DataFrame, sink: Sink) -> DataFrame:
    import pandas as pd
    import pyarrow as pa

    sink.start()

    def run(batches):
        out = pd.DataFrame(list(sink.write(batches)))
        yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    results = [r.asDict() for r in df.mapInArrow(run, sink.schema).collect()]
    return df.sparkSession.createDataFrame([tuple(r.values()) for r in sink.finalize(results)], sink.schema)


def to_sql(df: DataFrame, table: str, conn, mode: str = "append") -> DataFrame:
    """conn: a JDBC address, or a function that opens a DB-API connection (one for each partition; the table must exist)."""
    if isinstance(conn, str):
        df.write.jdbc(conn, table, mode={"append": "append", "overwrite": "overwrite", "fail": "error"}[mode])
    else:
        if mode == "overwrite":
            db = conn()
            db.execute(f"DELETE FROM {table}")
            db.commit()
            db.close()
        marks = ", ".join("?" * len(df.columns))

        def insert(rows):
            db = conn()
            db.cursor().executemany(f"INSERT INTO {table} VALUES ({marks})", [tuple(r) for r in rows])
            db.commit()
            db.close()

        df.foreachPartition(insert)
    return df.sparkSession.createDataFrame([(table,)], "table string")


def to_table_format(df: DataFrame, kind: str, name: str, mode: str) -> DataFrame:
    try:
        writer = df.write.format({"deltalake": "delta"}.get(kind, kind)).mode(mode)
        writer.save(name) if os.sep in name or "://" in name else writer.saveAsTable(name)
    except Exception as error:
        if "DATA_SOURCE_NOT_FOUND" in str(error) or "ClassNotFound" in str(error):
            raise NotImplementedError(f"the {kind} connector is not on Spark's class path") from error
        raise
    return df.sparkSession.createDataFrame([(name,)], "table string")
