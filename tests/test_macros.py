"""Library functions in SQL text."""

import pytest

from loomframe import Session
from loomframe.functions.base import REGISTRY
from loomframe.macros import distinct_on, expand, names


@pytest.mark.parametrize(
    "text, want",
    [
        ("SELECT arccos(x)", "SELECT acos(x)"),
        ("SELECT 'arccos(x)', `arccos(`, \"arccos(\"\"\" -- arccos(\n, arccos (1)", "SELECT 'arccos(x)', `arccos(`, \"arccos(\"\"\" -- arccos(\n, acos(1)"),
        ("SELECT /* arccos(1) */ db.arccos(1), arccosine(1)", "SELECT /* arccos(1) */ db.arccos(1), arccosine(1)"),
        ("SELECT f(arccos(arcsin(a, (b))), 1)", "SELECT f(acos(asin(a, (b))), 1)"),
        ("SELECT find(')', ',')", "SELECT (instr((')'), (',')) - 1)"),
        ("SELECT bitwise_or(a, list_min(b[1, 2]))", "SELECT ((a) | (array_min(b[1, 2])))"),
        ("CREATE TEMPORARY FUNCTION strip(x INT)", "CREATE TEMPORARY FUNCTION strip(x INT)"),
        ("SELECT to_list()", "SELECT array()"),
    ],
)
def test_expand(text, want):
    assert expand(text) == want


def test_own_names_stay():
    assert expand("SELECT strip(x), arccos(x)", own={"strip"}) == "SELECT strip(x), acos(x)"


@pytest.mark.parametrize("text", ["SELECT strip(x", "SELECT find(x)", "SELECT to_datetime(a, b)"])
def test_what_cannot_be_replaced_is_said(text):
    with pytest.raises(ValueError):
        expand(text)


def test_names_are_the_library_s():
    assert names() <= set(REGISTRY)


def test_edges_match_the_library(spark):
    """Nulls, zeros and empty lists, as the frame's functions have them."""
    row = Session(spark).sql("""
        SELECT ln(0) AS a, log10(-1D) AS b, ln(CAST(NULL AS DOUBLE)) AS c, list_sum(to_list(CAST(NULL AS INT))) AS d, list_mean(CAST(array() AS ARRAY<INT>)) AS e, seq(0) AS f, seq(CAST(NULL AS INT)) AS g, chunk(to_list(1), 2) AS h,
               chunk(CAST(NULL AS ARRAY<INT>), 2) AS i, columns_sum(CAST(NULL AS INT), NULL) AS j, is_nan(CAST(NULL AS DOUBLE)) AS k, cosine_similarity(to_list(0), to_list(1)) AS l, jaccard_similarity(to_list(0), to_list(0)) AS m,
               regexp_extract('a', 'b') AS n, jaro_similarity(NULL, 'a') AS o, clip(CAST(NULL AS INT), 1, 2) AS p, list_bool_or(to_list(NULL, true)) AS q, list_count(CAST(NULL AS ARRAY<INT>)) AS r""").to_pylist()[0]
    assert row["a"] == float("-inf") and row["b"] != row["b"] and row["f"] == [] and row["h"] == [] and row["q"] is True
    assert {k: row[k] for k in "cdegijklmnopr"} == dict.fromkeys("cdegijklmnopr")


def test_user_functions_come_first(spark):
    s = Session(spark)
    s.attach_function(lambda x: f"<{x}>", "strip")
    try:
        assert s.sql("SELECT strip('a ') AS x").to_pylist() == [{"x": "<a >"}]
    finally:
        s.detach_function("strip")
    assert s.sql("SELECT strip('a ') AS x").to_pylist() == [{"x": "a"}]


def test_distinct_on(spark):
    s = Session(spark)
    rows = "(VALUES (1, 'a'), (1, 'b'), (2, 'c'), (NULL, 'd')) AS t(k, x)"
    got = s.sql(f"SELECT DISTINCT ON (k) k, x FROM {rows} ORDER BY x DESC").to_pylist()
    assert sorted((r["k"] or 0, r["x"]) for r in got) == [(0, "d"), (1, "b"), (2, "c")]
    assert s.sql(f"SELECT DISTINCT ON (k) k FROM {rows} UNION ALL SELECT 9").count_rows() == 4
    for text in ("SELECT 'select distinct on (a)'", "SELECT DISTINCT a FROM b"):
        assert distinct_on(text) == text
    with pytest.raises(ValueError, match="LIMIT"):
        distinct_on("SELECT DISTINCT ON (a) a FROM b LIMIT 3")
