"""Sources. Files go through Spark's own readers, so filters and columns are pushed to the scan; formats that need connectors say so."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frame import Frame
from ..session import spark_session


def _spark() -> SparkSession:
    return spark_session()


def _load(kind: str, path, options: dict, schema=None, file_path_column: str | None = None, hive_partitioning: bool = False, ignore_corrupt_files: bool = False) -> Frame:
    reader = _spark().read.format(kind).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if ignore_corrupt_files:
        reader = reader.option("ignoreCorruptFiles", "true")
    paths = [path] if isinstance(path, str) else list(path)
    if not hive_partitioning:
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.load(paths)
    return Frame(df.withColumn(file_path_column, F.col("_metadata.file_path")) if file_path_column else df)


def read_parquet(path, schema=None, file_path_column=None, hive_partitioning=False, ignore_corrupt_files=False) -> Frame:
    return _load("parquet", path, {}, schema, file_path_column, hive_partitioning, ignore_corrupt_files)


def read_csv(path, schema=None, has_headers=True, delimiter=",", quote='"', escape_char=None, comment=None, allow_variable_columns=False, file_path_column=None, hive_partitioning=False, ignore_corrupt_files=False) -> Frame:
    options = {"header": has_headers, "sep": delimiter, "quote": quote, "escape": escape_char or quote, "inferSchema": schema is None, "mode": "PERMISSIVE" if allow_variable_columns else "FAILFAST"}
    return _load("csv", path, options | ({"comment": comment} if comment else {}), schema, file_path_column, hive_partitioning, ignore_corrupt_files)


def read_json(path, schema=None, multi_line=False, file_path_column=None, hive_partitioning=False, ignore_corrupt_files=False) -> Frame:
    """Lines of objects, or with multi_line whole files (objects or arrays)."""
    return _load("json", path, {"multiLine": multi_line}, schema, file_path_column, hive_partitioning, ignore_corrupt_files)


def read_text(path, encoding="utf-8", skip_blank_lines=True, whole_text=False, file_path_column=None, hive_partitioning=False) -> Frame:
    """Column text: a row a line, or a file."""
    frame = _load("text", path, {"wholetext": whole_text, "encoding": encoding}, None, file_path_column, hive_partitioning)
    df = frame.df.withColumnRenamed("value", "text")
    return Frame(df.filter(F.trim("text") != "") if skip_blank_lines and not whole_text else df)


def from_glob_path(path) -> Frame:
    """Path, size and time of files, without their contents."""
    df = _load("binaryFile", path, {}).df
    return Frame(df.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")))


def from_files(path) -> Frame:
    return Frame(_load("binaryFile", path, {}).df.select(F.struct("path").alias("file")))


def read_warc(path, file_path_column=None) -> Frame:
    """One row a record: id, type, date, headers, content. Files are parsed whole, each by one task."""
    from .warc import SCHEMA, parse

    df = _load("binaryFile", path, {}).df.select("path", "content").mapInArrow(parse, f"path string, {SCHEMA}")
    return Frame(df.withColumnRenamed("path", file_path_column) if file_path_column else df.drop("path"))


def read_sql(sql: str, conn, partition_col=None, num_partitions=None, bounds=None, schema=None) -> Frame:
    """conn: a JDBC address (read in parallel by ranges of partition_col), or a function that opens a DB-API connection (read by one task)."""
    if isinstance(conn, str):
        reader = _spark().read.format("jdbc").option("url", conn)
        if partition_col and num_partitions and bounds:
            reader = reader.option("dbtable", f"({sql}) q").option("partitionColumn", partition_col).option("numPartitions", num_partitions)
            reader = reader.option("lowerBound", bounds[0]).option("upperBound", bounds[1])
        else:
            reader = reader.option("query", sql)
        return Frame(reader.load())
    if schema is None:
        raise ValueError("a schema is needed with a connection function")

    def rows(batches):
        import pandas as pd

        for _ in batches:
            db = conn()
            try:
                cursor = db.cursor()
                cursor.execute(sql)
                names = [d[0] for d in cursor.description]
                while found := cursor.fetchmany(10_000):
                    yield pd.DataFrame.from_records(found, columns=names)
            finally:
                db.close()

    return Frame(_spark().range(1, numPartitions=1).mapInPandas(rows, schema))


def read_kafka(bootstrap_servers: str, topics, start="earliest", end="latest", kafka_client_config: dict | None = None) -> Frame:
    """A bounded read; Spark's Kafka connector must be on the class path."""
    topics = topics if isinstance(topics, str) else ",".join(topics)
    options = {"kafka.bootstrap.servers": bootstrap_servers, "subscribe": topics, "startingOffsets": start, "endingOffsets": end}
    return Frame(_connector("kafka", _spark().read.format("kafka").options(**options | {f"kafka.{k}": x for k, x in (kafka_client_config or {}).items()})))


def _connector(kind: str, reader, table: str | None = None) -> DataFrame:
    try:
        return reader.load(table) if table else reader.load()
    except Exception as error:
        if "DATA_SOURCE_NOT_FOUND" in str(error) or "ClassNotFound" in str(error) or "Failed to find" in str(error):
            raise NotImplementedError(f"the {kind} connector is not on Spark's class path") from error
        raise


def _table(kind: str):
    def read(table: str, **options) -> Frame:
        return Frame(_connector(kind, _spark().read.format(kind).options(**options), table))

    read.__name__ = f"read_{kind}"
    read.__doc__ = f"A {kind} table; options (version, snapshot-id, branch, tag, ...) are the connector's."
    return read


read_deltalake, read_iceberg, read_hudi, read_lance, read_paimon = map(_table, ("delta", "iceberg", "hudi", "lance", "paimon"))


def read_huggingface(repo: str) -> Frame:
    """The Parquet files of a dataset, through whichever file system is registered for hf://."""
    return read_parquet(f"hf://datasets/{repo}")


def read_generator(generators, schema: str) -> Frame:
    """generators: functions that yield pandas frames or lists of dicts; each runs as one task."""
    import pandas as pd

    generators = list(generators)

    def rows(batches):
        for batch in batches:
            for i in batch["id"]:
                for part in generators[int(i)]():
                    yield part if isinstance(part, pd.DataFrame) else pd.DataFrame(part)

    return Frame(_spark().range(0, len(generators), numPartitions=max(1, len(generators))).mapInPandas(rows, schema))


def read_source(source, **options) -> Frame:
    """A Python data source class (pyspark.sql.datasource.DataSource)."""
    spark = _spark()
    spark.dataSource.register(source)
    return Frame(spark.read.format(source.name()).options(**options).load())


def from_pydict(data: dict) -> Frame:
    import pyarrow as pa

    return from_arrow(pa.table(data))


def from_pylist(rows: list[dict]) -> Frame:
    import pyarrow as pa

    names = list(dict.fromkeys(k for r in rows for k in r))
    return from_arrow(pa.table({n: [r.get(n) for r in rows] for n in names}))


def from_arrow(table) -> Frame:
    return Frame(_spark().createDataFrame(table))


def from_pandas(frame) -> Frame:
    return Frame(_spark().createDataFrame(frame))


def range(start: int, end: int | None = None, step: int = 1, partitions: int | None = None) -> Frame:
    if end is None:
        start, end = 0, start
    return Frame(_spark().range(start, end, step, partitions))


def concat(frames) -> Frame:
    from functools import reduce

    return reduce(lambda a, b: a.concat(b), frames)


def read_mcap(path, start_time: int | None = None, end_time: int | None = None, topics=None, batch_size: int = 1000) -> Frame:
    """Messages (topic, log_time, publish_time, sequence, data) logged from start_time to before end_time; each file is one task's."""
    from .mcap import SCHEMA, parser

    df = _load("binaryFile", path, {}).df.select("content").mapInArrow(parser(start_time, end_time, batch_size), SCHEMA)
    return Frame(df.filter(F.col("topic").isin(list(topics))) if topics else df)


#: Kinds of crawl archives, as their lists of paths are named.
_CRAWLS = {"raw": "warc", "warc": "warc", "text": "wet", "wet": "wet", "metadata": "wat", "wat": "wat"}


def common_crawl(crawl: str, segment: str | None = None, content: str = "raw", num_files: int | None = None, base: str = "s3a://commoncrawl") -> Frame:
    """Records of a crawl: raw captures, their text or metadata; of one segment, and the first files of the list, if asked. base: the crawls, or a copy, in any store that Spark reads."""
    if content not in _CRAWLS:
        raise ValueError(f"content must be one of {', '.join(_CRAWLS)}")
    paths = _spark().read.text(f"{base}/crawl-data/{crawl}/{_CRAWLS[content]}.paths.gz").withColumn("nth", F.monotonically_increasing_id())
    if segment is not None:
        paths = paths.filter(F.col("value").contains(f"/segments/{segment}/"))
    # The list has one line a file, a hundred thousand at most.
    found = [r.value for r in (paths.orderBy("nth") if num_files is None else paths.orderBy("nth").limit(num_files)).collect()]
    if not found:
        raise ValueError(f"no files of segment {segment} in {crawl}")
    return read_warc([f"{base}/{p}" for p in found])


def read_video_frames(path, **_):
    raise NotImplementedError("read_video_frames needs a video library, which isn't installed here")
