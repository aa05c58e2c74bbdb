"""The frame: a lazy façade over a Spark DataFrame. Every method declares a plan; Catalyst and adaptive execution choose how it runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import aggregates as A
from .expr import Expr, column, named
from .joins import asof, join
from .pairs import vector_pairs
from .window import ordering


def _columns(args, kwargs=None) -> list:
    out = [named(a) for a in args]
    return out + [column(x).alias(n) for n, x in (kwargs or {}).items()]


def _names(args) -> list[str]:
    out = []
    for a in args:
        out += list(a) if isinstance(a, list | tuple) else [a]
    return out


class Grouped:
    """Rows by key; nulls are a group of their own."""

    def __init__(self, frame: Frame, keys: list, rollup: bool = False):
        self.frame, self.keys, self.rollup = frame, keys, rollup

    def _grouped(self):
        df = self.frame.df
        return df.rollup(*map(named, self.keys)) if self.rollup else df.groupBy(*map(named, self.keys))

    def agg(self, *exprs) -> Frame:
        return Frame(self._grouped().agg(*[column(x) for x in _names(exprs)]))

    def _each(self, f, cols) -> Frame:
        keys = {k for k in self.keys if isinstance(k, str)}
        cols = cols or [c for c in self.frame.df.columns if c not in keys]
        return Frame(self._grouped().agg(*[f(F.col(c)).alias(c) for c in cols]))

    def map_groups(self, f, schema: str) -> Frame:
        """f of each group as a pandas frame."""
        return Frame(self._grouped().applyInPandas(f, schema))

    def stddev(self, *cols, ddof: int = 1) -> Frame:
        return self._each(lambda x: A.stddev(x, ddof), cols)

    def var(self, *cols, ddof: int = 1) -> Frame:
        return self._each(lambda x: A.var(x, ddof), cols)

    def string_agg(self, *cols, delimiter: str = "") -> Frame:
        return self._each(lambda x: A.string_agg(x, delimiter), cols)


class _Global(Grouped):
    """All rows as one group."""

    def _grouped(self):
        return self.frame.df.groupBy()


_SHORT = ("sum", "mean", "min", "max", "any_value", "count", "skew", "product", "count_distinct", "list_agg", "list_agg_distinct")
for _name in _SHORT:
    setattr(Grouped, _name, (lambda n: lambda self, *cols: self._each(getattr(A, n), cols))(_name))


class Frame:
    def __init__(self, df: DataFrame):
        self.df = df

    # Looking.
    def schema(self):
        return self.df.schema

    def column_names(self) -> list[str]:
        return self.df.columns

    def columns(self) -> list[Expr]:
        return [Expr(F.col(c)) for c in self.df.columns]

    def explain(self, show_all: bool = False, format: str | None = None) -> None:
        self.df.explain(mode=format or ("extended" if show_all else "formatted"))

    def num_partitions(self) -> int:
        return self.df.rdd.getNumPartitions()

    def describe(self) -> Frame:
        """The schema as rows."""
        rows = [(f.name, f.dataType.simpleString()) for f in self.df.schema.fields]
        return Frame(self.df.sparkSession.createDataFrame(rows, "column_name string, type string"))

    def summarize(self) -> Frame:
        """For each column type, min, max, count, nulls and approximate distinct values, in one pass."""
        fields = self.df.schema.fields
        each = [
            F.struct(
                F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.min(f"`{f.name}`").cast("string").alias("min"), F.max(f"`{f.name}`").cast("string").alias("max"),
                F.count(f"`{f.name}`").alias("count"), F.count_if(F.col(f"`{f.name}`").isNull()).alias("count_nulls"), F.approx_count_distinct(f"`{f.name}`").alias("approx_count_distinct"),
            )
            for f in fields
        ]
        return Frame(self.df.agg(F.array(*each).alias("s")).select(F.inline("s")))

    def metrics(self) -> dict:
        return {"rows": self.df.count(), "partitions": self.num_partitions()}

    def skipped_corrupt_files(self) -> list:
        """Spark keeps no list of them; the executors' logs name them."""
        return []

    # Rows and columns.
    def select(self, *columns, **named_columns) -> Frame:
        return Frame(self.df.select(*_columns(columns, named_columns)))

    def exclude(self, *names) -> Frame:
        return Frame(self.df.drop(*names))

    def with_column(self, name: str, expr) -> Frame:
        return Frame(self.df.withColumn(name, column(expr)))

    def with_columns(self, columns: dict) -> Frame:
        return Frame(self.df.withColumns({n: column(x) for n, x in columns.items()}))

    def with_column_renamed(self, existing: str, new: str) -> Frame:
        return Frame(self.df.withColumnRenamed(existing, new))

    def with_columns_renamed(self, names: dict) -> Frame:
        return Frame(self.df.withColumnsRenamed(names))

    def filter(self, predicate) -> Frame:
        return Frame(self.df.filter(predicate if isinstance(predicate, str) else column(predicate)))

    where = filter

    def drop_null(self, *cols) -> Frame:
        return Frame(self.df.dropna(subset=list(cols) or None))

    def drop_nan(self, *cols) -> Frame:
        """Rows with NaN in a column of floats go; nulls stay."""
        cols = cols or [f.name for f in self.df.schema.fields if f.dataType.typeName() in ("double", "float")]
        return Frame(self.df.filter(~reduce(lambda a, b: a | b, [F.isnan(F.col(c)) for c in cols], F.lit(False))))

    def distinct(self, *on) -> Frame:
        return Frame(self.df.dropDuplicates(list(on)) if on else self.df.distinct())

    unique = drop_duplicates = distinct

    def sample(self, fraction: float | None = None, size: int | None = None, with_replacement: bool = False, seed: int | None = None) -> Frame:
        if size is None:
            return Frame(self.df.sample(with_replacement, fraction, seed))
        n = self.df.count()
        if not with_replacement:
            if size > n:
                raise ValueError(f"a sample of {size} from {n} rows")
            return Frame(self.df.orderBy(F.rand(seed)).limit(size))
        spark = self.df.sparkSession
        # Rows are numbered through the counts of partitions, then drawn by number.
        rows = self.df.withColumn("__row", F.monotonically_increasing_id()).persist()
        parts = rows.groupBy(F.shiftright("__row", 33).alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
        before = parts.withColumn("__start", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        numbered = rows.join(F.broadcast(before), F.shiftright("__row", 33) == F.col("__part")).withColumn("__nth", F.col("__start") + F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)))
        picks = spark.range(size).select(F.floor(F.rand(seed) * n).cast("long").alias("__nth"))
        return Frame(picks.join(numbered, "__nth").select(*[F.col(f"`{c}`") for c in self.df.columns]))

    def sort(self, by, desc=False, nulls_first=None) -> Frame:
        return Frame(self.df.orderBy(*ordering(by, desc, nulls_first)))

    def limit(self, num: int) -> Frame:
        return Frame(self.df.limit(num))

    def offset(self, num: int) -> Frame:
        return Frame(self.df.offset(num))

    def shuffle(self, seed: int | None = None) -> Frame:
        return Frame(self.df.orderBy(F.rand(seed)))

    def repartition(self, num: int | None, *partition_by) -> Frame:
        keys = [named(k) for k in partition_by]
        return Frame(self.df.repartition(*([] if num is None else [num]), *keys))

    def repartition_by_range(self, num: int | None, *by, desc=False) -> Frame:
        """Ranges of the keys, in order from partition to partition; nulls are the greatest."""
        keys = ordering(list(by), desc, None)
        return Frame(self.df.repartitionByRange(*([] if num is None else [num]), *keys))

    def into_partitions(self, num: int) -> Frame:
        return Frame(self.df.coalesce(num) if num <= self.num_partitions() else self.df.repartition(num))

    def shard(self, world_size: int, rank: int) -> Frame:
        """The files of one of world_size readers, by a hash of their paths; for frames that read files."""
        return Frame(self.df.filter(F.pmod(F.xxhash64(F.col("_metadata.file_path")), F.lit(world_size)) == rank))

    def into_batches(self, batch_size: int) -> Frame:
        """Python batches of at most batch_size rows; rows are the same."""
        self.df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_size)
        return self

    def add_monotonically_increasing_id(self, name: str = "id") -> Frame:
        return Frame(self.df.select(F.monotonically_increasing_id().alias(name), "*"))

    def explode(self, *columns: str, index_column: str | None = None, ignore_empty_and_null: bool = False) -> Frame:
        """Lists side by side, one row a place; shorter ones are filled with nulls."""
        zipped = F.arrays_zip(*[F.coalesce(F.col(c), F.array().cast(self.df.schema[c].dataType)) for c in columns]) if len(columns) > 1 else F.transform(F.col(columns[0]), lambda x: F.struct(x.alias(columns[0])))
        f = F.posexplode if ignore_empty_and_null else F.posexplode_outer
        rows = self.df.select(*self.df.columns, f(zipped).alias("__pos", "__item"))
        fields = {c: F.col("__item").getField(c if len(columns) == 1 else str(i)) for i, c in enumerate(columns)}
        keep = [fields[c].alias(c) if c in fields else F.col(c) for c in self.df.columns]
        return Frame(rows.select(*keep, *([F.col("__pos").cast("long").alias(index_column)] if index_column else [])))

    def unpivot(self, ids, values=None, variable_name: str = "variable", value_name: str = "value") -> Frame:
        ids = _names([ids])
        values = _names([values]) if values else [c for c in self.df.columns if c not in ids]
        return Frame(self.df.unpivot(ids, values, variable_name, value_name))

    melt = unpivot

    def pipe(self, function, *args, **kwargs):
        return function(self, *args, **kwargs)

    def transform(self, func, *args, **kwargs) -> Frame:
        out = func(self, *args, **kwargs)
        if not isinstance(out, Frame):
            raise TypeError("the function must return a frame")
        return out

    # Aggregates.
    def groupby(self, *keys) -> Grouped:
        return Grouped(self, _names(keys))

    def rollup(self, *keys) -> Grouped:
        return Grouped(self, _names(keys), True)

    def agg(self, *exprs) -> Frame:
        return _Global(self, []).agg(*exprs)

    def agg_list(self, *cols) -> Frame:
        return _Global(self, []).list_agg(*cols)

    def agg_set(self, *cols) -> Frame:
        return _Global(self, []).list_agg_distinct(*cols)

    def agg_concat(self, *cols, delimiter: str = "") -> Frame:
        return _Global(self, []).string_agg(*cols, delimiter=delimiter)

    def stddev(self, *cols, ddof: int = 1) -> Frame:
        return _Global(self, []).stddev(*cols, ddof=ddof)

    def var(self, *cols, ddof: int = 1) -> Frame:
        return _Global(self, []).var(*cols, ddof=ddof)

    def pivot(self, group_by, pivot_col: str, value_col: str, agg_fn: str, names: list | None = None) -> Frame:
        """names: the values that become columns; without, they are looked up first."""
        p = self.df.groupBy(*_names([group_by])).pivot(pivot_col, names) if names else self.df.groupBy(*_names([group_by])).pivot(pivot_col)
        return Frame(p.agg(getattr(A, agg_fn)(F.col(value_col))))

    def count_rows(self) -> int:
        from ..context import observed

        return observed("count_rows", self.df.count)

    # Two frames.
    def join(self, other: Frame, on=None, left_on=None, right_on=None, how: str = "inner", strategy: str | None = None, prefix: str | None = None, suffix: str | None = None) -> Frame:
        left, right = _names([on if on is not None else left_on or []]), _names([on if on is not None else right_on or []])
        return Frame(join(self.df, other.df, left, right, how, strategy, prefix, suffix))

    def vector_pairs(self, other: Frame, measures, decimals: int | None = None) -> Frame:
        """Every row (id, vector) with every row of other (id, vector): both ids and the measures (dot_product, cosine_similarity and so on), rounded if decimals is given."""
        return Frame(vector_pairs(self.df, other.df, measures, decimals))

    def join_asof(self, other: Frame, on=None, left_on=None, right_on=None, by=None, left_by=None, right_by=None, strategy: str = "backward", prefix=None, suffix=None) -> Frame:
        return Frame(asof(self.df, other.df, on or left_on, on or right_on, _names([by or left_by or []]), _names([by or right_by or []]), strategy, prefix, suffix))

    def concat(self, other: Frame) -> Frame:
        if [(f.name, f.dataType) for f in self.df.schema] != [(f.name, f.dataType) for f in other.df.schema]:
            raise ValueError("the schemas differ")
        return Frame(self.df.unionAll(other.df))

    def union(self, other: Frame) -> Frame:
        return Frame(self.df.unionAll(other.df).distinct())

    def union_all(self, other: Frame) -> Frame:
        return Frame(self.df.unionAll(other.df))

    def union_by_name(self, other: Frame) -> Frame:
        return Frame(self.df.unionByName(other.df, allowMissingColumns=True).distinct())

    def union_all_by_name(self, other: Frame) -> Frame:
        return Frame(self.df.unionByName(other.df, allowMissingColumns=True))

    def intersect(self, other: Frame) -> Frame:
        return Frame(self.df.intersect(other.df))

    def intersect_all(self, other: Frame) -> Frame:
        return Frame(self.df.intersectAll(other.df))

    def except_distinct(self, other: Frame) -> Frame:
        return Frame(self.df.subtract(other.df))

    def except_all(self, other: Frame) -> Frame:
        return Frame(self.df.exceptAll(other.df))

    def skip_existing(self, existing_path: str, key_column, file_format: str = "parquet") -> Frame:
        """Rows whose keys aren't among those already written at a path; null keys are equal."""
        keys = _names([key_column])
        old = self.df.sparkSession.read.format(file_format).load(existing_path).select(*keys).distinct()
        return Frame(join(self.df, old, keys, keys, "anti", None, None, None, null_safe=True))

    # Results.
    def collect(self) -> Frame:
        """Computed and kept."""
        from ..context import observed

        self.df = self.df.persist()
        observed("collect", self.df.count)
        return self

    def show(self, n: int = 8) -> None:
        self.df.show(n)

    def to_pandas(self):
        return self.df.toPandas()

    def to_arrow(self):
        return self.df.toArrow()

    def to_pylist(self) -> list[dict]:
        return [r.asDict(True) for r in self.df.collect()]

    def to_pydict(self) -> dict[str, list]:
        rows = self.to_pylist()
        return {c: [r[c] for r in rows] for c in self.df.columns}

    def iter_rows(self, column_format: str = "python"):
        return (r.asDict(True) for r in self.df.toLocalIterator(prefetchPartitions=True))

    def __iter__(self):
        return self.iter_rows()

    def to_arrow_iter(self):
        """Record batches, a partition at a time."""
        for table in self.iter_partitions():
            yield from table.to_batches()

    def iter_partitions(self):
        """One Arrow table a partition, fetched one after the other."""
        import pyarrow as pa

        def packed(batches):
            batches = list(batches)
            if batches:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batches[0].schema) as out:
                    for b in batches:
                        out.write_batch(b)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["table"])

        for row in self.df.mapInArrow(packed, "table binary").toLocalIterator():
            yield pa.ipc.open_stream(row.table).read_all()

    def _of_rank(self, shard_strategy: str | None, world_size: int | None, rank: int | None) -> Frame:
        """The share of one of world_size readers: by file, for frames that read files."""
        if shard_strategy is None:
            if world_size is not None or rank is not None:
                raise ValueError("world_size and rank need a shard_strategy")
            return self
        if shard_strategy != "file" or world_size is None or rank is None or not 0 <= rank < world_size:
            raise ValueError("shard_strategy must be 'file', with a world_size and a rank below it")
        return self.shard(world_size, rank)

    def to_torch_iter_dataset(self, shard_strategy: str | None = None, world_size: int | None = None, rank: int | None = None):
        frame = self._of_rank(shard_strategy, world_size, rank)
        from torch.utils.data import IterableDataset

        class Rows(IterableDataset):
            def __iter__(self):
                return frame.iter_rows()

        return Rows()

    def to_torch_map_dataset(self, shard_strategy: str | None = None, world_size: int | None = None, rank: int | None = None):
        frame = self._of_rank(shard_strategy, world_size, rank)
        from torch.utils.data import Dataset

        rows = frame.to_pylist()

        class Rows(Dataset):
            def __len__(self):
                return len(rows)

            def __getitem__(self, i):
                return rows[i]

        return Rows()

    def to_torch_dataloader(self, batch_size: int = 1, shard_strategy: str | None = None, world_size: int | None = None, rank: int | None = None, **options):
        from torch.utils.data import DataLoader

        return DataLoader(self.to_torch_map_dataset(shard_strategy, world_size, rank), batch_size=batch_size, **options)

    def to_ray_dataset(self):
        raise NotImplementedError("no Ray here: write Parquet and read it there")

    def to_dask_dataframe(self):
        raise NotImplementedError("no Dask here: write Parquet and read it there")

    # Sinks.
    def _written(self, root_dir: str, kind: str, write_mode: str, partition_cols, options: dict) -> Frame:
        from ..sources.writers import write

        return Frame(write(self.df, root_dir, kind, write_mode, _names([partition_cols or []]), options))

    def write_parquet(self, root_dir: str, compression: str = "snappy", write_mode: str = "append", partition_cols=None) -> Frame:
        return self._written(root_dir, "parquet", write_mode, partition_cols, {"compression": compression})

    def write_csv(self, root_dir: str, write_mode: str = "append", partition_cols=None, delimiter: str = ",", quote: str = '"', escape: str = '"', header: bool = True, date_format=None, timestamp_format=None) -> Frame:
        options = {"sep": delimiter, "quote": quote, "escape": escape, "header": header} | _formats(date_format, timestamp_format)
        return self._written(root_dir, "csv", write_mode, partition_cols, options)

    def write_json(self, root_dir: str, write_mode: str = "append", partition_cols=None, ignore_null_fields: bool = False, date_format=None, timestamp_format=None) -> Frame:
        return self._written(root_dir, "json", write_mode, partition_cols, {"ignoreNullFields": ignore_null_fields} | _formats(date_format, timestamp_format))

    def write_sink(self, sink) -> Frame:
        from ..sources.writers import to_sink

        return Frame(to_sink(self.df, sink))

    def write_sql(self, table_name: str, conn, write_mode: str = "append") -> Frame:
        from ..sources.writers import to_sql

        return Frame(to_sql(self.df, table_name, conn, write_mode))

    def write_table(self, kind: str, name: str, mode: str = "append") -> Frame:
        """Through a table format's connector, which must be on the class path."""
        from ..sources.writers import to_table_format

        return Frame(to_table_format(self.df, kind, name, mode))

    def __getitem__(self, name):
        return Expr(F.col(name)) if isinstance(name, str) else self.select(*name)

    def __getattr__(self, name: str):
        if name.startswith("__") or name == "df":
            raise AttributeError(name)
        if name in self.df.columns:
            return Expr(F.col(name))
        raise AttributeError(name)

    def __len__(self) -> int:
        return self.count_rows()


def _formats(date_format, timestamp_format) -> dict:
    from ..functions.temporal import java_pattern

    return ({"dateFormat": java_pattern(date_format)} if date_format else {}) | ({"timestampFormat": java_pattern(timestamp_format)} if timestamp_format else {})


for _name in ("sum", "mean", "min", "max", "any_value", "count", "skew", "product", "count_distinct"):
    setattr(Frame, _name, (lambda n: lambda self, *cols: getattr(_Global(self, []), n)(*cols))(_name))
for _format in ("iceberg", "deltalake", "paimon", "lance", "clickhouse", "turbopuffer", "huggingface", "bigtable"):
    setattr(Frame, f"write_{_format}", (lambda k: lambda self, table, mode="append", **_: self.write_table(k, table, mode))(_format))
