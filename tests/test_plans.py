"""Physical plans: what must reach the scan does, and nothing runs where it needn't."""

import re

import pytest

from loomframe import Catalog, Frame, Session, col, lit
from loomframe.plans import QUERIES
from loomframe.sources import readers


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(readers.read_parquet(f"{sf}/lineitem.parquet").filter(col("l_quantity") > 30.0).select("l_orderkey").df)
    assert "GreaterThan(l_quantity,30.0)" in text and re.search(r"ReadSchema: struct<l_orderkey:bigint,l_quantity:double>", text)


def test_partitions_are_pruned(spark, tmp_path):
    root = str(tmp_path / "p")
    readers.range(100).with_column("part", col("id") % lit(4)).write_parquet(root, partition_cols="part")
    text = plan(readers.read_parquet(root, hive_partitioning=True).filter("part = 2").df)
    assert "PartitionFilters: [isnotnull(part" in text


def test_as_of_is_one_shuffle(spark, sf):
    for name in ("asof_backward", "asof_forward"):
        text = plan(QUERIES[name](spark, sf))
        assert "Join" not in re.sub(r"AQE.*", "", text) and text.count("hashpartitioning(__b0") <= 2


@pytest.mark.parametrize("name", ["tpch_q1", "tpch_q6", "tpch_q18", "window_range_frame", "string_search", "list_basic", "temporal_fields", "numeric_basic"])
def test_no_python_on_the_executors(spark, sf, name):
    assert not re.search("ArrowEval|BatchEval|MapIn|CartesianProduct", plan(QUERIES[name](spark, sf)))


def test_shards_cover_all_rows_once(spark, tmp_path):
    root = str(tmp_path / "s")
    readers.range(50, partitions=7).write_parquet(root)
    parts = [readers.read_parquet(root).shard(3, r).count_rows() for r in range(3)]
    assert sum(parts) == 50


def test_catalog_and_table_functions(spark, sf, tmp_path):
    catalog = Catalog.from_pydict({"a": {"x": [1, 2]}, "b": Frame(spark.range(3))})
    assert catalog.list_tables("[ab]")[:2] == ["a", "b"] and catalog.read_table("b").count_rows() == 3
    catalog.write_table("a", readers.from_pydict({"x": [3]}))
    assert catalog.read_table("a").count_rows() == 3
    table = catalog.create_table_if_not_exists("kept", readers.range(4))
    table.append(readers.range(1))
    assert table.read().count_rows() == 5 and catalog.has_table("kept")
    table.overwrite(readers.range(2))
    assert catalog.get_table("kept").select("id").count_rows() == 2
    catalog.drop_table("kept")
    with pytest.raises(KeyError):
        catalog.get_table("kept")
    s = Session(spark)
    assert s.sql(f"SELECT count(*) AS n FROM read_parquet('{sf}/region.parquet')").to_pylist() == [{"n": 5}]
    assert s.sql(f"SELECT count(*) AS n FROM '{sf}/nation.parquet'").to_pylist() == [{"n": 25}]


@pytest.mark.parametrize("name", ["string_normalize", "list_basic", "tokenizer_round_trip"])
def test_whole_queries_keep_every_document(spark, sf, name):
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(QUERIES[name](spark, sf)) == ids(spark.read.parquet(f"{sf}/documents.parquet"))


def test_whole_lists_reach_the_last_word(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(9))
    spark.createDataFrame([(3, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (r,) = QUERIES["list_basic"](spark, str(tmp_path)).collect()
    assert r.list_join == text.replace(" ", "|") and r.list_append == [*text.split(), "end"] and r.list_map == [w[::-1] for w in text.split()]


@pytest.mark.parametrize("name", ["vector_top_k", "vector_distances", "vector_correlations"])
def test_whole_searches_take_every_query(spark, sf, name):
    ids = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    assert {r.j for r in QUERIES[name](spark, sf).select("j").distinct().collect()} == {i for i in ids if i % 50 == 0} > {0}


def test_whole_queries_see_large_keys(spark, tmp_path):
    """Keys beyond 400 and a product of thousands of factors."""
    spark.range(401, 8402).selectExpr("id c_custkey", "cast(id % 2 as int) c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(3).selectExpr("id s_suppkey", "1 s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(19, 24).selectExpr("id p_partkey", "cast(id as int) p_size").write.parquet(f"{tmp_path}/part.parquet")
    run = lambda name: sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert run("aggregate_product") == [(0, 1.0), (1, -1.0)]
    assert run("set_union") == [(0,), (1,)] and run("set_intersect") == [(1,)] and run("set_intersect_all") == [(1,)] * 3 and run("set_except_distinct") == [(0,)]
    assert len(run("set_union_all")) == 8004 and len(run("set_except_all")) == 7998
    assert [r[0] for r in run("images")] == [19, 20, 21, 22, 23]


def test_asof_without_groups_has_no_single_partition_of_rows(spark, sf):
    """Rows are dealt by range; only the table of a row a range is gathered."""
    import re

    df = QUERIES["asof_alone_backward"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__range" in plan
    for m in re.finditer(r"Exchange SinglePartition", plan):
        assert "Range (0" in plan[m.end() :]


def test_asof_without_groups_matches_a_loop(spark):
    import bisect
    import random

    from loomframe.operators.frame import Frame

    rng = random.Random(3)
    for kinds in ("long", "double", "string"):
        make = {"long": lambda: rng.randrange(300), "double": lambda: rng.random(), "string": lambda: f"{rng.randrange(500):04}"}[kinds]
        lefts, rights = [make() if rng.random() > 0.05 else None for _ in range(400)], sorted({make() for _ in range(60)})
        a, b = spark.createDataFrame([(x,) for x in lefts], f"x {kinds}"), spark.createDataFrame([(y, str(y)) for y in rights] + [(None, "none")], f"y {kinds}, said string")
        for strategy in ("backward", "forward"):
            got = sorted(((r.x, r.y, r.said) for r in Frame(a).join_asof(Frame(b), left_on="x", right_on="y", strategy=strategy).df.collect()), key=repr)
            want = []
            for x in lefts:
                i = None if x is None else bisect.bisect_right(rights, x) - 1 if strategy == "backward" else bisect.bisect_left(rights, x)
                y = rights[i] if i is not None and 0 <= i < len(rights) else None
                want.append((x, y, None if y is None else str(y)))
            assert got == sorted(want, key=repr)


def test_torch_shards_are_checked(spark, sf):
    import pytest

    from loomframe.operators.frame import Frame

    orders = Frame(spark.read.parquet(f"{sf}/orders.parquet"))
    for options in ({"world_size": 2, "rank": 0}, {"shard_strategy": "row", "world_size": 2, "rank": 0}, {"shard_strategy": "file", "world_size": 2, "rank": 2}):
        with pytest.raises(ValueError):
            orders._of_rank(options.get("shard_strategy"), options.get("world_size"), options.get("rank"))
    assert sum(orders._of_rank("file", 3, i).count_rows() for i in range(3)) == orders.count_rows() == sum(b.num_rows for b in orders.to_arrow_iter())


def test_fields_of_a_struct_come_from_one_call(spark, sf):
    from loomframe.operators import udf

    pair = udf.func("struct<a: long, b: long>", unnest=True)(lambda k: {"a": k, "b": k + 1})
    text = plan(readers.read_parquet(f"{sf}/customer.parquet").select("c_custkey", *pair("c_custkey")).df)
    assert "pythonUDF0" in text and "pythonUDF1" not in text


def test_aggregate_states_are_sent_on(spark, monkeypatch):
    from loomframe.operators import udf

    class Total(udf.Aggregate):
        def partial(self, values):
            return float(values.sum())

        def combine(self, a, b):
            return a + b

    monkeypatch.setattr(udf, "HELD", 3)
    df = spark.range(0, 1000, 1, 4).selectExpr("id % 17 AS k", "CAST(id AS DOUBLE) AS x")
    got = {r["k"]: r["t"] for r in udf.aggregate(Frame(df), Total(), ["k"], "x", "t").to_pylist()}
    assert got == {k: float(sum(range(k, 1000, 17))) for k in range(17)}


def test_udf_options_are_checked():
    from loomframe.operators import udf

    with pytest.raises(ValueError):
        udf.func("long", unnest=True)(lambda x: x)("a")
    with pytest.raises(ValueError):
        udf.batch("long", batch_size=0)(lambda s: s)
