"""Windows. Without a frame, aggregates cover the whole partition, ordered or not; nulls sort as the greatest values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F

from .expr import Expr, named

UNBOUNDED_PRECEDING, UNBOUNDED_FOLLOWING, CURRENT_ROW = SparkWindow.unboundedPreceding, SparkWindow.unboundedFollowing, SparkWindow.currentRow
#: Functions that Spark allows no other frame for.
_RANKING = ("row_number(", "rank(", "dense_rank(", "lag(", "lead(")


def ordering(by, desc=False, nulls_first=None) -> list[Column]:
    """Sort columns; nulls are first when descending unless said otherwise."""
    by = list(by) if isinstance(by, list | tuple) else [by]
    each = lambda x: list(x) if isinstance(x, list | tuple) else [x] * len(by)
    out = []
    for key, down, first in zip(by, each(desc), each(nulls_first)):
        c, first = named(key), down if first is None else first
        out.append((c.desc_nulls_first() if first else c.desc_nulls_last()) if down else (c.asc_nulls_first() if first else c.asc_nulls_last()))
    return out


class Window:
    def __init__(self):
        self._partition, self._order, self._frame, self._least = [], [], None, 0

    def _with(self, **changes) -> Window:
        out = Window()
        out.__dict__ = self.__dict__ | changes
        return out

    def partition_by(self, *keys) -> Window:
        return self._with(_partition=[named(k) for k in keys])

    def order_by(self, *keys, desc=False, nulls_first=None) -> Window:
        return self._with(_order=ordering(list(keys), desc, nulls_first))

    def rows_between(self, start=UNBOUNDED_PRECEDING, end=UNBOUNDED_FOLLOWING, min_periods: int = 0) -> Window:
        return self._with(_frame=("rowsBetween", start, end), _least=min_periods)

    def range_between(self, start=UNBOUNDED_PRECEDING, end=UNBOUNDED_FOLLOWING, min_periods: int = 0) -> Window:
        return self._with(_frame=("rangeBetween", start, end), _least=min_periods)

    def spec(self, ranking: bool):
        spec = SparkWindow.partitionBy(*self._partition)
        if self._order:
            spec = spec.orderBy(*self._order)
        if ranking:
            return spec
        kind, start, end = self._frame or ("rowsBetween", UNBOUNDED_PRECEDING, UNBOUNDED_FOLLOWING)
        return getattr(spec, kind)(start, end)

    def apply(self, expr) -> Column:
        c = expr.column if isinstance(expr, Expr) else expr
        text = str(c).removeprefix("Column<'")
        ranking = text.startswith(_RANKING)
        out = c.over(self.spec(ranking))
        return F.when(F.count(F.lit(1)).over(self.spec(False)) >= self._least, out) if self._least and not ranking else out
