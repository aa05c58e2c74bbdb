"""The frame on small literal tables: nulls, names, order, errors, partition counts."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomframe import Frame, Session, Window, col, execution_config, lit, sql
from loomframe.functions import aggregates as A
from loomframe.sources import readers


@pytest.fixture(scope="module")
def small(spark):
    return Frame(spark.createDataFrame([(1, "a", 2.0), (2, None, None), (None, "b", 3.0), (4, "a", float("nan"))], "id int, s string, x double"))


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_sort_puts_nulls_last_or_first(small, parts):
    rows = small.repartition(parts)
    assert [r["id"] for r in rows.sort("id").to_pylist()] == [1, 2, 4, None]
    assert [r["id"] for r in rows.sort("id", desc=True).to_pylist()] == [None, 4, 2, 1]
    assert [r["id"] for r in rows.sort("id", nulls_first=True).to_pylist()] == [None, 1, 2, 4]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 5)), st.text(alphabet="abé", max_size=3)), min_size=1, max_size=12), desc=st.booleans())
def test_sort_property(spark, rows, desc):
    frame = Frame(spark.createDataFrame(rows, "a long, b string"))
    got = [(r["a"], r["b"]) for r in frame.sort(["a", "b"], desc=[desc, False]).to_pylist()]
    key = lambda r: ((r[0] is None) != desc, (0 if r[0] is None else -r[0] if desc else r[0]), r[1].encode())
    assert got == sorted(rows, key=key)


def test_join_names(spark):
    a = readers.from_pydict({"k": [1, 2], "v": [1, 1], "w": [0, 0]})
    b = readers.from_pydict({"k": [1, 3], "v": [5, 5]})
    assert a.join(b, on="k").column_names() == ["k", "v", "w", "right.v"]
    assert a.join(b, on="k", suffix="_r").column_names() == ["k", "v", "w", "v_r"]
    assert a.join(b, left_on="v", right_on="v", how="inner", prefix="x_").column_names() == ["v", "k", "w", "x_k"]
    got = {r["k"]: r["right.v"] for r in a.join(b, on="k", how="outer").to_pylist()}
    assert got == {1: 5, 2: None, 3: 5}
    assert {r["k"] for r in a.join(b, on="k", how="right").to_pylist()} == {1, 3}
    for bad in ({"how": "left", "strategy": "sort_merge"}, {"how": "outer", "strategy": "broadcast"}, {"how": "sideways"}):
        with pytest.raises(ValueError):
            a.join(b, on="k", **bad)


def test_asof_ties_and_nulls(spark):
    a = Frame(spark.createDataFrame([(5, "x"), (None, "x"), (7, None), (10, "y")], "t int, g string"))
    b = Frame(spark.createDataFrame([(4, "x", 1), (6, "x", 2), (7, None, 3), (None, "x", 4)], "t int, g string, v int"))
    of = lambda s: {(r["t"], r["g"]): r["v"] for r in a.join_asof(b, on="t", by="g", strategy=s).to_pylist()}
    nothing = {(None, "x"): None, (7, None): None, (10, "y"): None}
    assert of("backward") == {(5, "x"): 1} | nothing
    assert of("forward") == {(5, "x"): 2} | nothing
    assert of("nearest") == {(5, "x"): 2} | nothing


def test_aggregates(small):
    row = small.agg(
        A.count("s").alias("valid"), A.count("s", "all").alias("all"), A.count("s", "null").alias("null"), A.list_agg("s").alias("list"), A.stddev("id", 3).alias("none"), A.product("id").alias("p"), A.concat_agg(F.array("id")).alias("c")
    ).to_pylist()[0]
    assert (row["valid"], row["all"], row["null"], row["none"], row["p"]) == (3, 4, 1, None, 8.0)
    assert sorted(map(str, row["list"])) == ["None", "a", "a", "b"]
    assert small.groupby("s").sum("id").count_rows() == 3


def test_nan_null_distinct_sample(small):
    assert small.drop_null("s").count_rows() == 3 and small.drop_nan().count_rows() == 3 and small.distinct("s").count_rows() == 3
    assert small.sample(size=2, seed=1).count_rows() == 2 and small.sample(size=9, with_replacement=True, seed=1).count_rows() == 9
    with pytest.raises(ValueError):
        small.sample(size=5)


def test_reshaping(small):
    wide = small.filter(col("id").not_null()).select("id", a=lit(1), b=lit(2))
    assert wide.unpivot("id").count_rows() == 6
    assert small.describe().to_pylist()[0] == {"column_name": "id", "type": "int"}
    summary = {r["column"]: r for r in small.summarize().to_pylist()}
    assert summary["id"]["count"] == 3 and summary["id"]["count_nulls"] == 1 and summary["id"]["max"] == "4"
    lists = readers.from_pylist([{"i": 1, "x": [1, 2], "y": ["a"]}, {"i": 2, "x": [], "y": []}])
    assert sorted(lists.explode("x", "y").to_pylist(), key=str) == [{"i": 1, "x": 1, "y": "a"}, {"i": 1, "x": 2, "y": None}, {"i": 2, "x": None, "y": None}]
    assert lists.explode("x", ignore_empty_and_null=True).count_rows() == 2


def test_windows_cover_the_partition_unless_framed(small):
    w = Window().partition_by("s").order_by("id")
    got = {r["id"]: (r["n"], r["few"]) for r in small.select("id", n=w.apply(A.count()), few=w.rows_between(-1, 0, min_periods=2).apply(A.count())).to_pylist()}
    assert got[1] == (2, None) and got[4] == (2, 2)


def test_outputs(small):
    assert small.to_pydict()["id"] == [1, 2, None, 4] and small.to_arrow().num_rows == 4 and len(small.to_pandas()) == 4
    assert sum(t.num_rows for t in small.repartition(3).iter_partitions()) == 4 and len(list(small)) == 4
    assert small.pipe(lambda f, n: f.limit(n), 2).count_rows() == 2
    with pytest.raises(TypeError):
        small.transform(lambda f: 1)
    with pytest.raises(ValueError):
        small.concat(small.select("id"))


def test_sessions(spark, small):
    s = Session(spark)
    s.attach_table(small, "things")
    assert s.sql("SELECT count(*) AS n FROM things").to_pylist() == [{"n": 4}]
    s.attach_function(lambda x: f"<{x}>", "bracket")
    assert sql("SELECT bracket('a') AS x").to_pylist() == [{"x": "<a>"}]
    s.create_namespace_if_not_exists("space")
    s.create_table("space.numbers", readers.range(5))
    assert s.has_table("space.numbers") and s.read_table("space.numbers").count_rows() == 5 and "space" in s.list_namespaces()
    s.write_table("space.numbers", readers.range(2))
    assert s.read_table("space.numbers").count_rows() == 7
    s.drop_namespace("space")
    s.detach_table("things")
    assert not s.has_table("things")
    with execution_config(spark__sql__shuffle__partitions=3):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_files(spark, small, tmp_path):
    root = str(tmp_path / "out")
    written = small.write_parquet(root).to_pylist()
    more = small.write_parquet(root).to_pylist()
    assert written and not {r["path"] for r in written} & {r["path"] for r in more} and readers.read_parquet(root, file_path_column="from").count_rows() == 8
    (tmp_path / "a.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: 9\r\nX-More: 1\r\n\r\nbody\r\n\r\nb\r\n\r\n")
    row = readers.read_warc(str(tmp_path / "a.warc")).to_pylist()[0]
    assert row["WARC_Record_ID"] == "<urn:x>" and bytes(row["warc_content"]) == b"body\r\n\r\nb" and "X-More" in row["warc_headers"]
    with pytest.raises(NotImplementedError, match="connector"):
        readers.read_deltalake(str(tmp_path / "none"))
    (tmp_path / "t.txt").write_text("a\n\nb\n")
    assert [r["text"] for r in readers.read_text(str(tmp_path / "t.txt")).to_pylist()] == ["a", "b"]
    (tmp_path / "j.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.read_json(str(tmp_path / "j.json"), multi_line=True).count_rows() == 2


def test_mcap(tmp_path):
    import struct

    from loomframe.sources.mcap import _MAGIC

    text = lambda s: struct.pack("<I", len(s)) + s.encode()
    record = lambda kind, body: struct.pack("<BQ", kind, len(body)) + body
    inner = record(4, struct.pack("<HH", 7, 0) + text("/cam") + text("json") + struct.pack("<I", 0)) + record(5, struct.pack("<HIQQ", 7, 1, 10, 11) + b"hi")
    chunk = record(6, struct.pack("<QQQI", 0, 0, len(inner), 0) + text("") + struct.pack("<Q", len(inner)) + inner)
    (tmp_path / "a.mcap").write_bytes(_MAGIC + record(1, text("") + text("")) + chunk + _MAGIC)
    assert [(r["topic"], r["log_time"], bytes(r["data"])) for r in readers.read_mcap(str(tmp_path / "a.mcap")).to_pylist()] == [("/cam", 10, b"hi")]


def test_streams_agree_with_tables(spark, sf, tmp_path):
    from loomframe.streaming.windows import read_stream, tumbling

    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    events.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    build = lambda df, late=None: tumbling(df, "ts", "1 day", ["event_type"], {"n": F.count(F.lit(1))}, late)
    q = build(read_stream(spark, str(tmp_path / "in"), events.schema), "400 days").writeStream.outputMode("complete").format("memory").queryName("buckets").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("buckets").collect())) == sorted(map(tuple, build(events).collect()))


def test_udfs(small):
    from loomframe.operators import udf

    async def slow(x):
        return None if x is None else x * 10

    calls = []

    @udf.func("int", max_retries=1, on_error="ignore")
    def fails(x):
        calls.append(x)
        raise ValueError

    rows = small.filter(col("id").not_null()).select("id", t=udf.func("long")(slow)("id"), f=fails("id")).to_pylist()
    assert {r["id"]: (r["t"], r["f"]) for r in rows} == {1: (10, None), 2: (20, None), 4: (40, None)}


def test_subscribers_hear_of_results(small):
    from loomframe import context

    heard = []
    context.attach_subscriber("test", heard.append)
    small.count_rows()
    small.select("id").collect()
    context.detach_subscriber("test")
    small.count_rows()
    assert [h["what"] for h in heard] == ["count_rows", "collect"] and all(h["rows"] == 4 for h in heard)
