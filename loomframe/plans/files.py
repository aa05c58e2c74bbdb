"""Sources and sinks: what is written is read back."""

from pyspark.sql import functions as F

from ..operators.expr import Expr, col
from ..operators.frame import Frame
from ..session import spark_session
from ..sources import readers
from .registry import query


def _path(name: str) -> str:
    """A folder of the warehouse, which all machines share."""
    return f"{spark_session().conf.get('spark.sql.warehouse.dir').rstrip('/')}/_round_trips/{name}"


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


def _orders(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query(_ORDERS)
def parquet_round_trip(t):
    _orders(t).write_parquet(_path("parquet"), write_mode="overwrite", partition_cols="o_orderstatus")
    return readers.read_parquet(_path("parquet"), hive_partitioning=True)


@query(_ORDERS)
def csv_round_trip(t):
    _orders(t).write_csv(_path("csv"), write_mode="overwrite")
    return readers.read_csv(_path("csv"), schema="o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")


@query(_ORDERS)
def json_round_trip(t):
    _orders(t).write_json(_path("json"), write_mode="overwrite")
    return readers.read_json(_path("json"), schema="o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 2 = 0 GROUP BY 1")
def overwrite_partitions(t):
    rows, path = _orders(t), _path("partitions")
    rows.write_parquet(path, write_mode="overwrite", partition_cols="o_orderstatus")
    rows.filter("o_orderstatus = 'F' AND o_orderkey % 2 = 0").write_parquet(path, write_mode="overwrite-partitions", partition_cols="o_orderstatus")
    return Frame(readers.read_parquet(path, hive_partitioning=True).df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")))


@query("SELECT r_name AS text FROM region")
def text_lines(t):
    t.region.select(value=col("r_name")).df.write.mode("overwrite").text(_path("text"))
    return readers.read_text(_path("text"))


@query("SELECT count(*) > 0 AS found, bool_and(true) AS sized FROM region")
def glob_paths(t):
    t.region.write_json(_path("glob"), write_mode="overwrite")
    return readers.from_glob_path(f"{_path('glob')}/*.json").agg(Expr((F.count(F.lit(1)) > 0).alias("found")), Expr(F.bool_and(F.col("size") >= 0).alias("sized")))


@query("SELECT range AS id, range * 2 AS twice FROM range(10)")
def generator_source(t):
    def part(a):
        return lambda: iter([[{"id": i, "twice": 2 * i} for i in range(a, a + 5)]])

    return readers.read_generator([part(0), part(5)], "id long, twice long")


@query("SELECT range AS id FROM range(3, 20, 4)")
def range_source(t):
    return readers.range(3, 20, 4)


@query("SELECT * FROM (VALUES (1, 'a'), (2, NULL)) v(x, y)")
def python_rows(t):
    return readers.from_pylist([{"x": 1, "y": "a"}, {"x": 2}])


@query("SELECT r_regionkey, r_name FROM region")
def database_table(t):
    import sqlite3
    from functools import partial

    # A database in memory: each task that reads it makes it first.
    rows = [(r["r_regionkey"], r["r_name"]) for r in t.region.to_pylist()]

    def opened(rows):
        db = sqlite3.connect(":memory:")
        db.execute("CREATE TABLE region (r_regionkey INTEGER, r_name TEXT)")
        db.executemany("INSERT INTO region VALUES (?, ?)", rows)
        return db

    return readers.read_sql("SELECT r_regionkey, r_name FROM region", partial(opened, rows), schema="r_regionkey int, r_name string")


@query("SELECT CAST(sum(n_nationkey) AS BIGINT) AS total FROM nation")
def custom_sink(t):
    from ..sources.writers import Sink

    class Total(Sink):
        schema = "total long"

        def write(self, batches):
            yield {"total": sum(sum(b.column(0).to_pylist()) for b in batches)}

        def finalize(self, results):
            return [{"total": sum(r["total"] for r in results)}]

    return t.nation.select(n=col("n_nationkey").cast("long")).write_sink(Total())
