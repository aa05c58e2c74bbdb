"""Relational operators through the frame: projection, ordering, joins, aggregation, windows, set operations, reshaping."""

from pyspark.sql import functions as F

from ..functions import aggregates as A
from ..operators import udf
from ..operators.expr import Expr, col, lit
from ..operators.frame import Frame
from ..operators.window import CURRENT_ROW, UNBOUNDED_PRECEDING, Window
from .registry import query


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity > 25 AS big FROM lineitem WHERE l_quantity >= 10 AND l_returnflag <> 'N'")
def project_filter(t):
    rows = t.lineitem.filter((col("l_quantity") >= 10) & (col("l_returnflag") != "N"))
    return rows.select("l_orderkey", "l_linenumber", net=col("l_extendedprice") * (lit(1) - col("l_discount")), big=col("l_quantity") > 25)


@query("SELECT o_orderkey AS key, o_custkey, o_totalprice, o_totalprice / 2 AS half FROM orders WHERE o_orderstatus = 'F'")
def with_columns_rename_exclude(t):
    rows = t.orders.where("o_orderstatus = 'F'").with_columns({"half": col("o_totalprice") / 2}).with_column_renamed("o_orderkey", "key")
    return rows.exclude("o_orderstatus", "o_orderdate", "o_orderpriority")


@query("SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY k NULLS LAST, c_custkey DESC LIMIT 40")
def sort_top_n(t):
    return t.customer.select("c_custkey", k=Expr(F.nullif(F.col("c_nationkey"), F.lit(3)))).sort(["k", "c_custkey"], desc=[False, True]).limit(40)


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25 OFFSET 10")
def sort_offset_limit(t):
    return t.part.select("p_partkey", "p_retailprice").sort(["p_retailprice", "p_partkey"], desc=[True, False]).offset(10).limit(25)


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT DISTINCT c_nationkey FROM customer")
def distinct_on(t):
    return t.customer.drop_duplicates("c_nationkey").select("c_nationkey")


@query("SELECT c_custkey FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NOT NULL")
def drop_null(t):
    return t.customer.with_column("s", Expr(F.nullif("c_mktsegment", F.lit("BUILDING")))).drop_null("s").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= 0")
def drop_nan(t):
    return t.customer.with_column("x", Expr(F.when(F.col("c_acctbal") < 0, float("nan")).otherwise(F.col("c_acctbal")))).drop_nan("x").select("c_custkey")


def _join(how, strategy=None):
    def run(t):
        left, right = t.customer.select("c_custkey", "c_nationkey"), t.orders.filter("o_totalprice > 200000").select("o_orderkey", "o_custkey")
        return left.join(right, left_on="c_custkey", right_on="o_custkey", how=how, strategy=strategy)

    return run


for _how, _sql in {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "outer": "FULL JOIN", "semi": "SEMI JOIN", "anti": "ANTI JOIN"}.items():
    _f = _join(_how)
    _f.__name__ = f"join_{_how}"
    _right = "" if _how in ("semi", "anti") else ", o_orderkey, o_custkey"
    query(f"SELECT c_custkey, c_nationkey{_right} FROM customer {_sql} (SELECT * FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey")(_f)
for _strategy in ("hash", "sort_merge", "broadcast"):
    _f = _join("inner", _strategy)
    _f.__name__ = f"join_strategy_{_strategy}"
    query("SELECT c_custkey, c_nationkey, o_orderkey, o_custkey FROM customer JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey")(_f)


@query("SELECT r_regionkey, r_name, n_nationkey FROM region, nation")
def join_cross(t):
    return t.region.join(t.nation.select("n_nationkey"), how="cross")


@query("""SELECT a.k, a.n_name, b.n_name AS "right.n_name" FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT n_regionkey AS k, n_name FROM nation WHERE n_nationkey < 10) b USING (k)""")
def join_clashing_names(t):
    a = t.nation.select("n_name", k=col("n_regionkey"))
    return a.join(t.nation.filter("n_nationkey < 10").select("n_name", k=col("n_regionkey")), on="k")


@query("SELECT a.n_nationkey FROM (SELECT n_nationkey, nullif(n_regionkey, 1) AS k FROM nation) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT nullif(r_regionkey, 1) AS k FROM region WHERE r_regionkey < 3) b WHERE a.k IS NOT DISTINCT FROM b.k)")
def join_null_safe_anti(t):
    from ..operators.joins import join

    a = t.nation.df.select("n_nationkey", F.nullif("n_regionkey", F.lit(1)).alias("k"))
    b = t.region.df.filter("r_regionkey < 3").select(F.nullif("r_regionkey", F.lit(1)).alias("k"))
    return join(a, b, ["k"], ["k"], "anti", None, None, None, null_safe=True).select("n_nationkey")


_EVENTS = "SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'"
_VIEWS = "SELECT user_id, ts AS vts, min(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts"


def _asof(strategy):
    def run(t):
        left = t.events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
        right = t.events.filter("event_type = 'view'").groupby("user_id", "ts").agg(A.min("event_id").alias("view_id")).with_column_renamed("ts", "vts")
        return left.join_asof(right, left_on="ts", right_on="vts", by="user_id", strategy=strategy)

    run.__name__ = f"asof_{strategy}"
    return run


query(f"SELECT p.event_id, p.user_id, p.ts, v.vts, v.view_id FROM ({_EVENTS}) p ASOF LEFT JOIN ({_VIEWS}) v ON p.user_id = v.user_id AND p.ts >= v.vts")(_asof("backward"))
query(f"SELECT p.event_id, p.user_id, p.ts, v.vts, v.view_id FROM ({_EVENTS}) p ASOF LEFT JOIN ({_VIEWS}) v ON p.user_id = v.user_id AND p.ts <= v.vts")(_asof("forward"))
query(
    f"""SELECT event_id, user_id, ts, vts, view_id FROM (
        SELECT p.*, v.vts, v.view_id, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(v.vts) - epoch_us(p.ts)), v.vts DESC) AS n
        FROM ({_EVENTS}) p LEFT JOIN ({_VIEWS}) v ON p.user_id = v.user_id) WHERE n = 1"""
)(_asof("nearest"))


_LATEST = "SELECT ts AS vts, min(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ts"


def _asof_alone(strategy):
    def run(t):
        left = t.events.filter("event_type = 'purchase'").select("event_id", "ts")
        right = t.events.filter("event_type = 'view'").groupby("ts").agg(A.min("event_id").alias("view_id")).with_column_renamed("ts", "vts")
        return left.join_asof(right, left_on="ts", right_on="vts", strategy=strategy)

    run.__name__ = f"asof_alone_{strategy}"
    return run


_PURCHASES = "SELECT event_id, ts FROM events WHERE event_type = 'purchase'"
query(f"SELECT p.event_id, p.ts, v.vts, v.view_id FROM ({_PURCHASES}) p ASOF LEFT JOIN ({_LATEST}) v ON p.ts >= v.vts")(_asof_alone("backward"))
query(f"SELECT p.event_id, p.ts, v.vts, v.view_id FROM ({_PURCHASES}) p ASOF LEFT JOIN ({_LATEST}) v ON p.ts <= v.vts")(_asof_alone("forward"))
query(
    f"""SELECT event_id, ts, CASE WHEN fts IS NULL OR epoch_us(ts) - epoch_us(bts) < epoch_us(fts) - epoch_us(ts) THEN bts ELSE fts END AS vts,
               CASE WHEN fts IS NULL OR epoch_us(ts) - epoch_us(bts) < epoch_us(fts) - epoch_us(ts) THEN bid ELSE fid END AS view_id
        FROM (SELECT p.*, b.vts AS bts, b.view_id AS bid, f.vts AS fts, f.view_id AS fid FROM ({_PURCHASES}) p ASOF LEFT JOIN ({_LATEST}) b ON p.ts >= b.vts ASOF LEFT JOIN ({_LATEST}) f ON p.ts <= f.vts)"""
)(_asof_alone("nearest"))


@query("""SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity), 2) AS total, round(avg(l_tax), 8) AS tax, min(l_shipdate) AS first_ship,
          max(l_extendedprice) AS most, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag""")
def aggregate_basic(t):
    return t.lineitem.groupby("l_returnflag").agg(
        A.count().alias("n"), A.count_distinct("l_suppkey").alias("suppliers"), F.round(A.sum("l_quantity"), 2).alias("total"), F.round(A.mean("l_tax"), 8).alias("tax"),
        A.min("l_shipdate").alias("first_ship"), A.max("l_extendedprice").alias("most"), A.sum("l_linenumber").alias("lines"),
    )


@query("""SELECT o_orderstatus, round(stddev_samp(o_totalprice), 4) AS s1, round(stddev_pop(o_totalprice), 4) AS s0, round(var_samp(o_totalprice), 2) AS v1, round(var_pop(o_totalprice), 2) AS v0,
          round(median(o_totalprice), 4) AS mid, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_orderstatus""")
def aggregate_statistics(t):
    x = "o_totalprice"
    return t.orders.groupby("o_orderstatus").agg(
        F.round(A.stddev(x), 4).alias("s1"), F.round(A.stddev(x, 0), 4).alias("s0"), F.round(A.var(x), 2).alias("v1"), F.round(A.var(x, 0), 2).alias("v0"),
        F.round(A.median(x), 4).alias("mid"), F.round(A.percentile(x, 0.9), 4).alias("p90"),
    )


@query("""SELECT l_returnflag, round((sum(pow(l_quantity - m, 3)) / count(*)) / pow(sum(pow(l_quantity - m, 2)) / count(*), 1.5), 6) AS skewed,
          round(sum(pow(l_quantity - m, 2)) / (count(*) - 2), 4) AS var_two FROM (SELECT l_returnflag, l_quantity, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) GROUP BY l_returnflag""")
def aggregate_skew_ddof(t):
    return t.lineitem.groupby("l_returnflag").agg(F.round(A.skew("l_quantity"), 6).alias("skewed"), F.round(A.var("l_quantity", 2), 4).alias("var_two"))


@query("SELECT n_regionkey, list_sort(list(n_name)) AS names, list_sort(list(DISTINCT n_nationkey % 3)) AS rests, string_agg(n_name, ',' ORDER BY n_name) AS text FROM nation GROUP BY n_regionkey")
def aggregate_lists(t):
    ordered = Frame(t.nation.df.repartition(1).sortWithinPartitions("n_name"))
    return ordered.groupby("n_regionkey").agg(
        F.array_sort(A.list_agg("n_name")).alias("names"), F.array_sort(A.list_agg_distinct(col("n_nationkey") % 3)).alias("rests"),
        F.array_join(F.array_sort(A.list_agg("n_name")), ",").alias("text"),
    )


@query("SELECT o_custkey, bool_and(o_totalprice > 50000) AS every, bool_or(o_orderstatus = 'F') AS some, count_if(o_orderpriority IS NULL) AS missing FROM orders GROUP BY o_custkey")
def aggregate_booleans_modes(t):
    return t.orders.groupby("o_custkey").agg(
        A.bool_and(col("o_totalprice") > 50000).alias("every"), A.bool_or(col("o_orderstatus") == "F").alias("some"), A.count("o_orderpriority", "null").alias("missing")
    )


@query("SELECT c_nationkey, product(1 - 2 * (c_custkey % 2)) AS p FROM customer GROUP BY c_nationkey")
def aggregate_product(t):
    # Factors of 1 and -1: every row counts, and no number of rows overflows.
    return t.customer.groupby("c_nationkey").agg(A.product(lit(1) - lit(2) * (col("c_custkey") % 2)).alias("p"))


@query()
def aggregate_approximate(t):
    return t.lineitem.groupby("l_returnflag").agg(A.approx_count_distinct("l_partkey").alias("parts"), A.approx_percentiles("l_quantity", [0.25, 0.5, 0.75]).alias("quartiles"), A.any_value("l_linestatus").alias("any"))


@query("SELECT l_returnflag, true AS parts_near, true AS quartiles_near, true AS any_there FROM lineitem GROUP BY l_returnflag")
def aggregate_approximate_errors(t):
    """Estimates against exact values: distinct ones within a tenth, quartiles within a fiftieth of the rows by rank."""
    ranks = [F.avg((F.col("l_quantity") < F.col(f"q{i}")).cast("double")) for i in range(3)] + [F.avg((F.col("l_quantity") <= F.col(f"q{i}")).cast("double")) for i in range(3)]
    about = t.lineitem.groupby("l_returnflag").agg(A.approx_count_distinct("l_partkey").alias("parts"), A.approx_percentiles("l_quantity", [0.25, 0.5, 0.75]).alias("q"), A.any_value("l_linestatus").alias("any"))
    about = about.select("l_returnflag", "parts", "any", **{f"q{i}": Expr(F.col("q")[i]) for i in range(3)})
    exact = [F.count_distinct("l_partkey").alias("n"), F.first("parts").alias("parts"), F.max((F.col("l_linestatus") == F.col("any")).cast("int")).alias("found"), *[r.alias(f"r{i}") for i, r in enumerate(ranks)]]
    rows = t.lineitem.join(about, on="l_returnflag").groupby("l_returnflag").agg(*exact)
    near = F.lit(True)
    for i, p in enumerate((0.25, 0.5, 0.75)):
        near = near & (F.col(f"r{i}") <= p + 0.02) & (F.col(f"r{i + 3}") >= p - 0.02)
    return rows.select("l_returnflag", parts_near=Expr(F.abs(F.col("parts") / F.col("n") - 1) < 0.1), quartiles_near=Expr(near), any_there=Expr(F.col("found") == 1))


@query("SELECT round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders")
def aggregate_global(t):
    return t.orders.agg(F.round(A.sum("o_totalprice"), 2).alias("total"), A.count().alias("n"))


@query("SELECT n_regionkey, count(n_name) AS n_name FROM nation GROUP BY n_regionkey")
def grouped_shorthand(t):
    return t.nation.groupby("n_regionkey").count("n_name")


@query("SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def rollup(t):
    return t.nation.rollup("n_regionkey", "n_nationkey").agg(A.count().alias("n"))


@query("""SELECT user_id, round(sum(value) FILTER (event_type = 'click'), 4) AS click, round(sum(value) FILTER (event_type = 'view'), 4) AS view FROM events GROUP BY user_id""")
def pivot(t):
    return t.events.pivot("user_id", "event_type", "value", "sum", ["click", "view"]).select("user_id", click=Expr(F.round("click", 4)), view=Expr(F.round("view", 4)))


@query("SELECT s_suppkey, 'a' AS variable, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'b', CAST(s_nationkey AS DOUBLE) FROM supplier")
def unpivot(t):
    return t.supplier.select("s_suppkey", a=col("s_acctbal"), b=col("s_nationkey").cast("double")).unpivot("s_suppkey", ["a", "b"])


@query("SELECT 'c_acctbal' AS \"column\", 'double' AS type, CAST(count(c_acctbal) AS BIGINT) AS count, CAST(0 AS BIGINT) AS count_nulls FROM customer")
def summarize(t):
    return t.customer.select("c_acctbal").summarize().select("column", "type", "count", "count_nulls")


@query("SELECT * FROM (VALUES ('r_regionkey', 'int'), ('r_name', 'string')) v(column_name, type)")
def describe_schema(t):
    return t.region.describe()


@query("""SELECT o_orderkey, row_number() OVER w AS nth, rank() OVER r AS ranked, dense_rank() OVER r AS dense, lag(o_orderkey, 1, -1) OVER w AS before, lead(o_orderkey) OVER w AS after
          FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey), r AS (PARTITION BY o_custkey ORDER BY o_orderstatus)""")
def window_ranking(t):
    w, r = Window().partition_by("o_custkey").order_by("o_orderkey"), Window().partition_by("o_custkey").order_by("o_orderstatus")
    return t.orders.select("o_orderkey", nth=w.apply(A.row_number()), ranked=r.apply(A.rank()), dense=r.apply(A.dense_rank()), before=w.apply(A.lag("o_orderkey", 1, -1)), after=w.apply(A.lead("o_orderkey")))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS whole, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def window_whole_partition(t):
    w = Window().partition_by("o_custkey").order_by("o_orderkey")
    return t.orders.select("o_orderkey", whole=Expr(F.round(w.apply(A.sum("o_totalprice")), 2)), n=w.apply(A.count()))


@query("""SELECT o_orderkey, CASE WHEN count(*) OVER w >= 3 THEN round(avg(o_totalprice) OVER w, 4) END AS moving, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l
          FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)""")
def window_rows_frame(t):
    w = Window().partition_by("o_custkey").order_by("o_orderkey")
    framed, least = w.rows_between(-2, 1), w.rows_between(-2, 1, min_periods=3)
    return t.orders.select("o_orderkey", moving=Expr(F.round(least.apply(A.mean("o_totalprice")), 4)), f=framed.apply(A.first_value("o_orderkey")), l=framed.apply(A.last_value("o_orderkey")))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS last_hour FROM events")
def window_range_frame(t):
    w = Window().partition_by("user_id").order_by(Expr(F.unix_micros(F.col("ts").cast("timestamp")))).range_between(-3_600_000_000, 0)
    return t.events.select("event_id", last_hour=w.apply(A.count()))


for _name, _op in {"union": "UNION", "union_all": "UNION ALL", "intersect": "INTERSECT", "intersect_all": "INTERSECT ALL", "except_distinct": "EXCEPT", "except_all": "EXCEPT ALL"}.items():
    def _f(t, name=_name):
        return getattr(t.customer.select(k=col("c_nationkey")), name)(t.supplier.select(k=col("s_nationkey")))

    _f.__name__ = f"set_{_name}"
    query(f"SELECT c_nationkey AS k FROM customer {_op} SELECT s_nationkey AS k FROM supplier")(_f)


@query("SELECT n_name, n_regionkey, NULL AS r_name FROM nation UNION ALL BY NAME SELECT r_name, r_regionkey AS n_regionkey FROM region")
def set_union_all_by_name(t):
    return t.nation.select("n_name", "n_regionkey").union_all_by_name(t.region.select("r_name", n_regionkey=col("r_regionkey")))


@query("SELECT DISTINCT n_regionkey, n_name FROM (SELECT n_regionkey, n_name FROM nation UNION ALL SELECT r_regionkey, NULL FROM region)")
def set_union_by_name(t):
    return t.nation.select("n_regionkey", "n_name").union_by_name(t.region.select(n_regionkey=col("r_regionkey")))


@query("SELECT n_nationkey FROM nation UNION ALL SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
def concat(t):
    return t.nation.select("n_nationkey").concat(t.nation.filter("n_regionkey = 2").select("n_nationkey"))


@query("SELECT s_suppkey, unnest(string_split(s_name, '#')) AS word, generate_subscripts(string_split(s_name, '#'), 1) - 1 AS at FROM supplier")
def explode_indexed(t):
    return t.supplier.select("s_suppkey", word=col("s_name").split("#")).explode("word", index_column="at")


@query("SELECT vec_id, unnest(embedding[1:3]) AS a, unnest([1, 2, 3]) AS b FROM embeddings")
def explode_side_by_side(t):
    return t.embeddings.select("vec_id", a=Expr(F.slice("embedding", 1, 3)), b=Expr(F.array(F.lit(1), F.lit(2), F.lit(3)))).explode("a", "b")


@query("SELECT count(*) AS n FROM orders")
def partitioning(t):
    rows = t.orders.repartition(6, "o_custkey").into_partitions(3).shuffle(seed=5).add_monotonically_increasing_id("at")
    return rows.agg(A.count_distinct("at").alias("n"))


@query("SELECT 50 AS n")
def sample_size(t):
    return t.orders.sample(size=50, seed=3).agg(A.count().cast("int").alias("n"))


@query()
def sample_fraction(t):
    return t.orders.sample(fraction=0.1, seed=3)


@query("SELECT true AS share, 0::BIGINT AS strangers, 0::BIGINT AS twice, true AS again FROM region WHERE r_regionkey = 0")
def sample_fraction_properties(t):
    """A sample holds its share of the rows, only rows of the table, none twice, and the same ones for the same seed."""
    drawn = lambda: t.orders.sample(fraction=0.3, seed=3).df.select("o_orderkey")
    counted = drawn().agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("d"), F.sum(F.xxhash64("o_orderkey").cast("decimal(38,0)")).alias("h"))
    again = drawn().agg(F.sum(F.xxhash64("o_orderkey").cast("decimal(38,0)")).alias("h2"))
    strangers = drawn().join(t.orders.df.select("o_orderkey"), "o_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("strangers"))
    total = t.orders.df.agg(F.count(F.lit(1)).alias("all"))
    # Four tables of one row.
    one = lambda df: df.withColumn("one", F.lit(1))
    rows = one(counted).join(one(again), "one").join(one(strangers), "one").join(one(total), "one")
    return rows.select((F.abs(F.col("n") / F.col("all") - 0.3) < 0.05).alias("share"), "strangers", (F.col("n") - F.col("d")).alias("twice"), (F.col("h") == F.col("h2")).alias("again"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 1")
def skip_existing(t):
    from .. import session

    path = f"{session.spark_session().conf.get('spark.sql.warehouse.dir').rstrip('/')}/_existing"
    t.orders.filter("o_orderkey % 2 = 0").select("o_orderkey").write_parquet(path, write_mode="overwrite")
    return t.orders.select("o_orderkey").skip_existing(path, "o_orderkey")


@query("SELECT c_custkey, upper(c_name) || '!' AS loud, CAST(c_custkey * 2 AS BIGINT) AS twice FROM customer")
def udf_row_and_batch(t):
    loud, twice = udf.func("string")(lambda s: s.upper() + "!"), udf.batch("long")(lambda s: s * 2)
    return t.customer.select("c_custkey", loud=loud("c_name"), twice=twice("c_custkey"))


@query("SELECT r_regionkey, unnest(range(r_regionkey + 1)) AS i FROM region")
def udf_generator(t):
    counts = udf.generator("long")(lambda n: range(n + 1))
    return t.region.select("r_regionkey", i=counts("r_regionkey"))


@query("SELECT r_regionkey, r_regionkey + 7 AS more FROM region")
def udf_stateful_async(t):
    class Adder:
        def __init__(self, n):
            self.n = n

        def __call__(self, s):
            return s + self.n

    return t.region.select("r_regionkey", more=udf.stateful("int", n=7)(Adder)("r_regionkey"))


@query("""SELECT c_custkey, c_mktsegment || '-' || c_nationkey AS both, c_custkey + 1 AS next, c_custkey * 10 + c_nationkey + 7 AS summed, true AS short, c_nationkey * 3 AS thrice, length(c_name) + 2 AS longer FROM customer""")
def udf_options(t):
    """Fields of a struct as columns, batches of a few rows, classes with several arguments and named methods, the older decorator."""

    class Adder:
        def __init__(self, n):
            self.n = n

        def both(self, a, b):
            return a * 10 + b + self.n

        def __call__(self, s):
            return s.str.len() + self.n

    pair = udf.func("struct<both: string, next: long>", unnest=True)(lambda k, s, n: {"both": f"{s}-{n}", "next": k + 1})
    small = udf.batch("boolean", batch_size=7)(lambda s: s.map(lambda _: len(s) <= 7))
    rows = t.customer.select("c_custkey", *pair("c_custkey", "c_mktsegment", "c_nationkey"), short=small("c_custkey"))
    more = t.customer.select(
        k=col("c_custkey"), summed=udf.stateful("long", method="both", batch_size=100, n=7)(Adder)("c_custkey", "c_nationkey"), thrice=udf.udf("int")(lambda s: s * 3)("c_nationkey"), longer=udf.udf("long", n=2)(Adder)("c_name")
    )
    return rows.join(more, left_on="c_custkey", right_on="k").exclude("k")


@query("SELECT l_returnflag, round(max(l_quantity) - min(l_quantity), 2) AS spread FROM lineitem GROUP BY l_returnflag")
def udf_aggregate(t):
    class Spread(udf.Aggregate):
        def partial(self, values):
            return [float(values.min()), float(values.max())]

        def combine(self, a, b):
            return [min(a[0], b[0]), max(a[1], b[1])]

        def finalize(self, state):
            return round(state[1] - state[0], 2)

    return udf.aggregate(t.lineitem, Spread(), ["l_returnflag"], "l_quantity", "spread")


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def map_groups(t):
    import pandas as pd

    return t.nation.groupby("n_regionkey").map_groups(lambda g: pd.DataFrame({"n_regionkey": [g["n_regionkey"].iloc[0]], "n": [len(g)]}), "n_regionkey int, n long")


@query("SELECT time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_buckets(t):
    from ..streaming.windows import tumbling

    return tumbling(t.events.df, "ts", "1 day", ["event_type"], {"n": F.count(F.lit(1))})


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
          s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM g)
          SELECT user_id, min(ts) AS started, max(ts) + INTERVAL '6 hours' AS ended, count(*) AS n FROM s GROUP BY user_id, nth""")
def event_sessions(t):
    from ..streaming.windows import sessions

    return sessions(t.events.df, "ts", "6 hours", ["user_id"], {"n": F.count(F.lit(1))})


@query("SELECT s_suppkey AS id, 'balance' AS variable, s_acctbal AS value FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier WHERE s_acctbal > 0")
def frame_aliases(t):
    rows = t.supplier.where(col("s_acctbal") > 0).select("s_suppkey", balance=col("s_acctbal"), nation=col("s_nationkey").cast("double"))
    return rows.with_columns_renamed({"s_suppkey": "id"}).melt("id", ["balance", "nation"]).unique()


@query("""SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names, avg(n_nationkey) AS mean FROM nation GROUP BY n_regionkey""")
def grouped_text(t):
    return t.nation.sort("n_name").groupby("n_regionkey").agg(F.array_join(F.array_sort(F.split(A.string_agg("n_name", "|"), "[|]")), "|").alias("names"), A.avg("n_nationkey").alias("mean"))


@query("""SELECT count(*) AS n, sum(o_totalprice)::DECIMAL(20, 2) AS total, list_sort(list(DISTINCT o_orderstatus)) AS states, max(len(o_orderpriority)) AS longest FROM orders""")
def frame_aggregates(t):
    rows = t.orders.shuffle(seed=2)
    states = rows.select("o_orderstatus").agg_set("o_orderstatus").select(states=Expr(F.array_sort("o_orderstatus")))
    sums = rows.agg(A.count().alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(20,2)").alias("total"), A.max(F.length("o_orderpriority")).alias("longest"))
    return sums.join(states, how="cross")


@query("SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::DECIMAL(20, 2) AS running FROM orders")
def expression_over(t):
    price = Expr(F.col("o_totalprice").cast("decimal(18,2)"))
    w = Window().partition_by("o_custkey").order_by("o_orderkey").rows_between(UNBOUNDED_PRECEDING, CURRENT_ROW)
    return t.orders.select("o_orderkey", running=Expr(price.sum().over(w).column.cast("decimal(20,2)")))


@query("SELECT n_nationkey, upper(n_name) || n_regionkey AS named, CASE WHEN n_regionkey = 0 THEN NULL ELSE 10 // n_regionkey END AS tenth FROM nation")
def udf_async_retries(t):
    calls = {}

    async def named(name, region):
        calls[name] = calls.get(name, 0) + 1
        if calls[name] == 1:
            raise OSError("try again")
        return f"{name.upper()}{region}"

    async def tenth(region):
        return 10 // region

    two, one = udf.func("string", max_retries=1, max_concurrency=4)(named), udf.func("int", on_error="ignore")(tenth)
    return t.nation.select("n_nationkey", named=two("n_name", "n_regionkey"), tenth=one("n_regionkey"))
