"""Vectors in arrays of numbers: distances and similarities in higher-order functions; places on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import c, public


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _zip(a, b, f) -> Column:
    return F.zip_with(c(a), c(b), lambda x, y: f(x.cast("double"), y.cast("double")))


def _norm(a) -> Column:
    return F.sqrt(_sum(F.transform(c(a), lambda x: x.cast("double") * x.cast("double"))))


@public
def dot_product(left, right):
    return _sum(_zip(left, right, lambda x, y: x * y))


@public
def cosine_similarity(left, right):
    n = _norm(left) * _norm(right)
    return F.when(n > 0, dot_product(left, right) / n)


@public
def cosine_distance(left, right):
    return 1 - cosine_similarity(left, right)


@public
def euclidean_distance(left, right):
    return F.sqrt(_sum(_zip(left, right, lambda x, y: (x - y) * (x - y))))


@public
def pearson_correlation(left, right):
    mean = lambda a: _sum(F.transform(c(a), lambda x: x.cast("double"))) / F.size(c(a))
    centred = lambda a: F.transform(c(a), lambda x: x.cast("double") - mean(a))
    n = _norm(centred(left)) * _norm(centred(right))
    return F.when(n > 0, dot_product(centred(left), centred(right)) / n)


@public
def jaccard_similarity(left, right):
    """Of the sets of places that aren't zero."""
    both = _sum(_zip(left, right, lambda x, y: F.when((x != 0) & (y != 0), 1.0).otherwise(0.0)))
    any_ = _sum(_zip(left, right, lambda x, y: F.when((x != 0) | (y != 0), 1.0).otherwise(0.0)))
    return F.when(any_ > 0, both / any_)


@public
def hamming_distance(left, right):
    """Different bits of two 64-bit numbers."""
    return F.bit_count(c(left).bitwiseXOR(c(right)))


@public
def great_circle_distance(lat1, lon1, lat2, lon2):
    """Metres on a sphere; null for coordinates that don't exist."""
    a, b, d, g = (c(x) for x in (lat1, lon1, lat2, lon2))
    half = lambda x: F.pow(F.sin(F.radians(x) / 2), 2)
    h = half(d - a) + F.cos(F.radians(a)) * F.cos(F.radians(d)) * half(g - b)
    valid = a.between(-90, 90) & d.between(-90, 90) & b.between(-180, 180) & g.between(-180, 180)
    return F.when(valid, F.lit(2 * 6371008.8) * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))
