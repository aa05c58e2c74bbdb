"""Expressions: a thin shell over Spark columns with this engine's operators and every library function as a method."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import functions as library
from ..functions import aggregates
from ..functions.base import REGISTRY
from ..functions.numeric import divide

_AGGREGATES = (
    "count count_distinct approx_count_distinct sum mean avg product percentile median approx_percentiles var stddev min max bool_and bool_or any_value skew "
    "list_agg list_agg_distinct string_agg lag lead first_value last_value"
).split()


def column(x) -> Column:
    """The Spark column of an expression, a column, or a literal."""
    if isinstance(x, Expr):
        return x.column
    return x if isinstance(x, Column) else F.lit(x)


def named(x) -> Column:
    """As column, but a string is a column's name."""
    return F.col(x) if isinstance(x, str) else column(x)


def _wrap(x):
    return Expr(x) if isinstance(x, Column) else x


class Expr:
    """An expression. Methods are the library's functions, the expression being their first argument."""

    def __init__(self, column: Column, aggregate: bool = False):
        self.column, self.aggregate = column, aggregate

    def __getattr__(self, name: str):
        if name in _AGGREGATES:
            return lambda *a, **k: Expr(getattr(aggregates, name)(self.column, *a, **k), True)
        if name not in REGISTRY:
            raise AttributeError(name)
        return lambda *a, **k: _wrap(REGISTRY[name](self.column, *[column(x) if isinstance(x, Expr) else x for x in a], **k))

    def alias(self, name: str) -> Expr:
        return Expr(self.column.alias(name), self.aggregate)

    def apply(self, f, dtype: str) -> Expr:
        """f of each value, row by row in Python."""
        return Expr(F.udf(f, dtype, useArrow=True)(self.column))

    def over(self, window) -> Expr:
        return Expr(window.apply(self))

    def otherwise(self, value) -> Expr:
        return Expr(self.column.otherwise(column(value)))

    def __getitem__(self, key):
        return Expr(self.column.getField(key) if isinstance(key, str) else library.get(self.column, key))

    def __truediv__(self, o):
        return Expr(divide(self.column, column(o)))

    def __rtruediv__(self, o):
        return Expr(divide(column(o), self.column))

    def __floordiv__(self, o):
        return Expr(F.floor(divide(self.column, column(o))))

    def __mod__(self, o):
        return Expr(self.column % column(o))

    def __add__(self, o):
        return Expr(self.column + column(o)) if not isinstance(o, str) else Expr(F.concat(self.column, F.lit(o)))

    def __radd__(self, o):
        return Expr(column(o) + self.column) if not isinstance(o, str) else Expr(F.concat(F.lit(o), self.column))

    def __lshift__(self, o):
        return Expr(library.shift_left(self.column, column(o)))

    def __rshift__(self, o):
        return Expr(library.shift_right(self.column, column(o)))

    def __neg__(self):
        return Expr(-self.column)

    def __invert__(self):
        return Expr(~self.column)

    def __hash__(self):
        return id(self)

    def __repr__(self):
        return f"Expr({self.column})"


def _binary(name: str):
    def method(self, o):
        return Expr(getattr(self.column, name)(column(o)))

    return method


for _name in ("__sub__", "__rsub__", "__mul__", "__rmul__", "__pow__", "__and__", "__or__", "__eq__", "__ne__", "__lt__", "__le__", "__gt__", "__ge__"):
    setattr(Expr, _name, _binary(_name))
Expr.__xor__ = lambda self, o: Expr(self.column.bitwiseXOR(column(o)))


def col(name: str) -> Expr:
    return Expr(F.col(name))


def lit(value) -> Expr:
    return Expr(F.lit(value))


def sql_expr(text: str) -> Expr:
    return Expr(F.expr(text))
