"""Measures of pairs in blocks: every pair once, with the values of the functions of one pair."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomframe import functions as L
from loomframe.operators import pairs
from loomframe.operators.frame import Frame
from loomframe.plans import QUERIES

from .test_plans import plan


def vectors(spark, seed: int, n: int, name: str):
    rng = random.Random(seed)
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [2.0, 2.0, 2.0], [1.0, math.nan, 2.0], [1.0, 2.0], [1e-170, 0.0, 1e-170], [0.1, -0.2, 0.3], [0.1, -0.2, 0.3], [math.inf, 1.0, 0.0]]
    rows = [(k, v) for k, v in enumerate(odd + [[rng.gauss(0, 1) for _ in range(rng.choice((3, 3, 5)))] for _ in range(n)])]
    return spark.createDataFrame([*rows, (None, [1.0, 2.0, 3.0])], f"{name}_id long, {name} array<double>")


def same(a, b):
    if a is None or b is None:
        return a is b
    return a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) < 1e-9


@pytest.mark.parametrize("way", ["broadcast", "parts"])
def test_pairs_match_the_functions(spark, monkeypatch, way):
    for name, value in {"BLOCK": 7, "TILE": 3, "BROADCAST_BYTES": 0 if way == "parts" else 1 << 99}.items():
        monkeypatch.setattr(pairs, name, value)
    a, b = vectors(spark, 1, 40, "x"), vectors(spark, 2, 20, "y")
    got = Frame(a).vector_pairs(Frame(b), pairs.MEASURES)
    assert ("CartesianProduct" in plan(got.df)) == (way == "parts")
    wanted = a.crossJoin(b).select("x_id", "y_id", *[getattr(L, m)(F.col("x"), F.col("y")).alias(m) for m in pairs.MEASURES])
    order = lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: (str(r[0]), str(r[1])))
    one, other = order(got.df), order(wanted)
    assert len(one) == len(other) == a.count() * b.count()
    assert not [(r, w) for r, w in zip(one, other) if r[:2] != w[:2] or not all(map(same, r[2:], w[2:]))]


def test_pairs_keep_copies_and_other_keys(spark):
    a = spark.createDataFrame([("p", [1.0, 0.0]), ("p", [1.0, 0.0]), ("q", [0.0, 2.0])], "left string, v array<float>")
    got = Frame(a).vector_pairs(Frame(a.filter("left = 'p'").toDF("right", "w")), ["dot_product", "euclidean_distance"], 3)
    assert sorted(map(tuple, got.df.collect())) == [("p", "p", 1.0, 0.0)] * 4 + [("q", "p", 0.0, 2.236)] * 2
    assert Frame(a).vector_pairs(Frame(a.filter("left = 'r'").toDF("right", "w")), ["dot_product"]).count_rows() == 0
    with pytest.raises(ValueError, match="measures are"):
        Frame(a).vector_pairs(Frame(a.toDF("right", "w")), ["manhattan"])


def test_rounding_is_that_of_sql():
    import duckdb
    import numpy as np

    rng = random.Random(4)
    values = [0.0, -0.0, 0.0000005, -0.0000005, 2.5e-6, 0.49999999999999994e-6, 1e305, -math.inf, math.nan, 123456.7890125, *[rng.gauss(0, 1) for _ in range(500)], *[k / 2e6 for k in range(-99, 99)]]
    wanted = [x[0] for x in duckdb.connect().execute("SELECT round(unnest(?::DOUBLE[]), 6)", [values]).fetchall()]
    with np.errstate(all="ignore"):
        assert [*map(repr, pairs._rounded(np.array(values), 6).tolist())] == [*map(repr, wanted)]


@pytest.mark.parametrize("name", ["vector_distances", "vector_correlations"])
def test_searches_join_blocks_and_no_single_pairs(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "lambda" not in text and "left_data" in text
