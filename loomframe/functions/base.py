"""How functions take their arguments: the first as a column or its name, the others as columns or literal values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every public scalar function by name; expressions find their methods here.
REGISTRY: dict[str, object] = {}


def public(f):
    REGISTRY[f.__name__] = f
    return f


def c(x) -> Column:
    """A column, from itself or its name."""
    if isinstance(x, Column):
        return x
    if hasattr(x, "column"):
        return x.column
    return F.col(x) if isinstance(x, str) else F.lit(x)


def v(x) -> Column:
    """A column, or a literal."""
    if isinstance(x, Column):
        return x
    return x.column if hasattr(x, "column") else F.lit(x)


def guarded(x: Column, out: Column) -> Column:
    """out, null where x is null."""
    return F.when(x.isNotNull(), out)
