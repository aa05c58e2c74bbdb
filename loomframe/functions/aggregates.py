"""Aggregates and window functions. Each gives a Spark column, for grouping, or with ``over`` for windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import c, v


def count(expr="*", mode: str = "valid") -> Column:
    """valid: without nulls; all: rows; null: nulls."""
    if isinstance(expr, str) and expr == "*":
        return F.count(F.lit(1))
    x = c(expr)
    return {"valid": lambda: F.count(x), "all": lambda: F.count(F.lit(1)), "null": lambda: F.count_if(x.isNull())}[mode]()


def count_distinct(expr) -> Column:
    return F.count_distinct(c(expr))


def approx_count_distinct(expr) -> Column:
    return F.approx_count_distinct(c(expr), 0.0081)


def sum(expr) -> Column:
    return F.sum(c(expr))


def mean(expr) -> Column:
    return F.avg(c(expr))


def avg(expr) -> Column:
    return F.avg(c(expr))


def product(expr) -> Column:
    """A double; products of whole numbers are exact up to 2**53, and may be cast."""
    return F.product(c(expr))


def percentile(expr, percentage: float) -> Column:
    """Exact, linearly interpolated."""
    return F.percentile(c(expr), percentage)


def median(expr) -> Column:
    return F.median(c(expr))


def approx_percentiles(expr, percentiles) -> Column:
    out = F.percentile_approx(c(expr).cast("double"), percentiles, 10_000)
    return out


def _rescaled(expr, ddof: int) -> Column:
    x = c(expr)
    if ddof in (0, 1):
        out = F.var_pop(x) if ddof == 0 else F.var_samp(x)
    else:
        out = F.var_pop(x) * F.count(x) / F.nullif(F.count(x) - ddof, F.lit(0))
    return F.when(F.count(x) > ddof, out)


def var(expr, ddof: int = 1) -> Column:
    """Null for ddof values or fewer."""
    return _rescaled(expr, ddof)


def stddev(expr, ddof: int = 1) -> Column:
    return F.sqrt(_rescaled(expr, ddof))


def min(expr) -> Column:
    return F.min(c(expr))


def max(expr) -> Column:
    return F.max(c(expr))


def bool_and(expr) -> Column:
    return F.bool_and(c(expr))


def bool_or(expr) -> Column:
    return F.bool_or(c(expr))


def any_value(expr, ignore_nulls: bool = False) -> Column:
    return F.any_value(c(expr), F.lit(ignore_nulls))


def skew(expr) -> Column:
    """Of the population."""
    return F.skewness(c(expr))


def list_agg(expr) -> Column:
    """Nulls are kept."""
    return F.transform(F.collect_list(F.struct(c(expr).alias("value"))), lambda s: s.getField("value"))


def list_agg_distinct(expr) -> Column:
    return F.collect_set(c(expr))


def string_agg(expr, delimiter: str = "") -> Column:
    """Of strings."""
    return F.listagg(c(expr), delimiter)


def concat_agg(expr) -> Column:
    """Of lists: one after the other."""
    return F.flatten(F.collect_list(c(expr)))


def row_number() -> Column:
    return F.row_number()


def rank() -> Column:
    return F.rank()


def dense_rank() -> Column:
    return F.dense_rank()


def lag(expr, offset: int = 1, default=None) -> Column:
    return F.lag(c(expr), offset, default)


def lead(expr, offset: int = 1, default=None) -> Column:
    return F.lead(c(expr), offset, default)


def first_value(expr, ignore_nulls: bool = False) -> Column:
    return F.first(c(expr), ignore_nulls)


def last_value(expr, ignore_nulls: bool = False) -> Column:
    return F.last(c(expr), ignore_nulls)


def grouped(expr) -> Column:
    """Whether a row of a rollup leaves this column out."""
    return F.grouping(v(expr) if isinstance(expr, Column) else c(expr))


def over(expr, window) -> Column:
    """An aggregate or ranking over a window of this library, or of Spark."""
    return window.apply(c(expr)) if hasattr(window, "apply") else c(expr).over(window)
