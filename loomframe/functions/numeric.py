"""Numbers: arithmetic, trigonometry, logarithms, bits, NaN handling, row-wise aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import c, guarded, public, v

_SAME = {
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "sign": F.signum, "negate": F.negate, "sqrt": F.sqrt, "cbrt": F.cbrt, "sin": F.sin, "cos": F.cos,
    "tan": F.tan, "csc": F.csc, "sec": F.sec, "cot": F.cot, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "arcsin": F.asin, "arccos": F.acos,
    "arctan": F.atan, "arctanh": F.atanh, "arccosh": F.acosh, "arcsinh": F.asinh, "radians": F.radians, "degrees": F.degrees, "exp": F.exp, "expm1": F.expm1,
    "bin": F.bin, "log1p": F.log1p,
}


def _one(name, f):
    def function(expr) -> Column:
        return f(c(expr))

    function.__name__ = function.__qualname__ = name
    function.__doc__ = f"{name} of a number; null stays null."
    return public(function)


for _name, _f in _SAME.items():
    globals()[_name] = _one(_name, _f)


def _logarithm(x: Column, out: Column) -> Column:
    """IEEE: minus infinity at zero, NaN below; Spark's own is null there."""
    return F.when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan)).otherwise(out)


@public
def log2(expr):
    return _logarithm(c(expr), F.log2(c(expr)))


@public
def log10(expr):
    return _logarithm(c(expr), F.log10(c(expr)))


@public
def ln(expr):
    return _logarithm(c(expr), F.ln(c(expr)))


@public
def log(expr, base: float = math.e):
    return _logarithm(c(expr), F.ln(c(expr)) / F.lit(math.log(base)))


@public
def e() -> Column:
    return F.e()


@public
def pi() -> Column:
    return F.pi()


@public
def arctan2(y, x):
    return F.atan2(c(y), c(x))


@public
def hypot(a, b):
    return F.hypot(c(a), c(b))


@public
def pow(base, expr):
    return F.pow(c(base), v(expr))


@public
def power(base, expr):
    return F.pow(c(base), v(expr))


@public
def pmod(a, b):
    return F.pmod(c(a), v(b))


@public
def factorial(expr):
    """Null outside 0 to 20."""
    return F.when(c(expr).between(0, 20), F.factorial(c(expr).cast("int")))


@public
def round(expr, decimals: int = 0):
    """Half away from zero."""
    return F.round(c(expr), decimals)


@public
def clip(expr, min=None, max=None):
    """A missing or null bound doesn't bound."""
    x = c(expr)
    out = x if min is None else F.greatest(x, v(min))
    return guarded(x, out if max is None else F.least(out, v(max)))


@public
def between(expr, lower, upper):
    return c(expr).between(v(lower), v(upper))


@public
def conv(expr, from_base: int, to_base: int):
    return F.conv(c(expr).cast("string"), from_base, to_base)


@public
def is_nan(expr):
    return guarded(c(expr), F.isnan(c(expr)))


@public
def is_inf(expr):
    return guarded(c(expr), F.abs(c(expr)) == F.lit(math.inf))


@public
def not_nan(expr):
    return guarded(c(expr), ~F.isnan(c(expr)))


@public
def fill_nan(expr, fill_value):
    return F.nanvl(c(expr).cast("double"), v(fill_value).cast("double"))


@public
def bitwise_and(left, right):
    return c(left).bitwiseAND(v(right))


@public
def bitwise_or(left, right):
    return c(left).bitwiseOR(v(right))


@public
def bitwise_xor(left, right):
    return c(left).bitwiseXOR(v(right))


@public
def shift_left(expr, num_bits):
    return F.call_function("shiftleft", c(expr), v(num_bits))


@public
def shift_right(expr, num_bits):
    return F.call_function("shiftright", c(expr), v(num_bits))


def _present(exprs) -> Column:
    return F.array_compact(F.array(*[c(x).cast("double") for x in exprs]))


@public
def columns_sum(*exprs):
    """Row by row over columns, nulls left out; null if all are."""
    a = _present(exprs)
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x))


@public
def columns_mean(*exprs):
    return columns_sum(*exprs) / F.size(_present(exprs))


@public
def columns_avg(*exprs):
    return columns_mean(*exprs)


@public
def columns_min(*exprs):
    return F.array_min(F.array(*[c(x) for x in exprs]))


@public
def columns_max(*exprs):
    return F.array_max(F.array(*[c(x) for x in exprs]))


def divide(left: Column, right: Column) -> Column:
    """True division of doubles with IEEE results at zero, which Spark raises on or makes null."""
    a, b = left.cast("double"), right.cast("double")
    zero = F.when(a == 0, F.lit(math.nan)).when(F.isnan(a), a).when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))
