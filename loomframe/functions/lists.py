"""Lists: reductions, ordering, slicing, building. Nulls inside lists are left out of reductions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import c, public, v


def _present(x) -> Column:
    return F.filter(c(x), lambda e: e.isNotNull())


@public
def value_counts(list_expr):
    """Map of each value to how often it occurs. Values are sorted once and counted by their runs."""
    a = F.array_sort(_present(list_expr))
    n = F.size(a)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1))

    def counted(pair):
        return F.transform(
            F.filter(pair.getField("places"), lambda i: (i == 0) | (F.get(pair.getField("a"), i) != F.get(pair.getField("a"), i - 1))),
            lambda i: F.struct(F.get(pair.getField("a"), i).alias("value"), i.alias("at")),
        )

    # The sorted list and the places are made once a row, in a list of one.
    runs = F.flatten(F.transform(F.array(F.struct(a.alias("a"), places.alias("places"))), counted))
    ends = lambda r: F.transform(r, lambda x, j: F.struct(x.getField("value"), (F.coalesce(F.get(r, j + 1).getField("at"), n) - x.getField("at")).cast("long")))
    pairs = F.flatten(F.transform(F.array(F.struct(runs.alias("r"))), lambda s: ends(s.getField("r"))))
    return F.when(n > 0, F.map_from_entries(pairs)).otherwise(F.when(c(list_expr).isNotNull(), F.map_from_entries(F.filter(pairs, lambda _: F.lit(False)))))


@public
def chunk(list_expr, size: int):
    """Pieces of equal size; what doesn't fill one is dropped."""
    a = c(list_expr)
    n = F.floor(F.size(a) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(a, i * size + 1, F.lit(size)))).otherwise(
        F.when(a.isNotNull(), F.filter(F.array(a), lambda _: F.lit(False)))
    )


@public
def list_join(list_expr, delimiter: str):
    return F.array_join(c(list_expr), delimiter)


@public
def list_flatten(list_expr):
    return F.flatten(_present(list_expr))


@public
def list_count(list_expr, mode: str = "valid"):
    a = c(list_expr)
    n = {"valid": F.size(_present(a)), "all": F.size(a), "null": F.size(a) - F.size(_present(a))}[mode]
    return F.when(a.isNotNull(), n.cast("long"))


@public
def list_count_distinct(list_expr):
    return F.when(c(list_expr).isNotNull(), F.size(F.array_distinct(_present(list_expr))).cast("long"))


@public
def list_fill(n, elem):
    return F.array_repeat(v(elem), v(n))


@public
def list_sum(list_expr):
    a = _present(list_expr)
    total = F.aggregate(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.get(a, F.lit(0)), lambda s, x: s + x)
    return F.when(F.size(a) > 0, total)


@public
def list_mean(list_expr):
    a = F.transform(_present(list_expr), lambda x: x.cast("double"))
    return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))


@public
def list_min(list_expr):
    return F.array_min(c(list_expr))


@public
def list_max(list_expr):
    return F.array_max(c(list_expr))


@public
def list_bool_and(list_expr):
    a = _present(list_expr)
    return F.when(F.size(a) > 0, F.forall(a, lambda x: x))


@public
def list_bool_or(list_expr):
    a = _present(list_expr)
    return F.when(F.size(a) > 0, F.exists(a, lambda x: x))


@public
def list_sort(list_expr, desc: bool = False, nulls_first: bool = False):
    """Nulls last in both directions, unless asked for first."""
    a = c(list_expr)
    rest = F.sort_array(_present(a), asc=not desc)
    nulls = F.filter(a, lambda e: e.isNull())
    return F.concat(nulls, rest) if nulls_first else F.concat(rest, nulls)


@public
def list_distinct(list_expr):
    return F.array_distinct(_present(list_expr))


@public
def list_map(list_expr, mapper):
    return F.transform(c(list_expr), mapper)


@public
def list_filter(list_expr, predicate):
    return F.filter(c(list_expr), predicate)


@public
def explode(list_expr, ignore_empty_and_null: bool = False):
    """One row an element; empty and null lists give one null row unless ignored."""
    return F.explode(c(list_expr)) if ignore_empty_and_null else F.explode_outer(c(list_expr))


@public
def list_append(list_expr, other):
    return F.array_append(c(list_expr), v(other))


@public
def list_contains(list_expr, item):
    return F.array_contains(c(list_expr), v(item))


@public
def seq(n):
    """0 to n - 1."""
    x = c(n).cast("long")
    return F.when(x > 0, F.sequence(F.lit(0).cast("long"), x - 1)).otherwise(F.when(x.isNotNull(), F.array().cast("array<long>")))


@public
def to_list(*items):
    return F.array(*[c(x) for x in items])


@public
def slice(expr, start, end=None):
    """Half open, from 0, negative from the end, clamped; lists and strings."""
    x, n = c(expr), F.size(c(expr))
    place = lambda i: F.greatest(F.lit(0), F.least(n, F.when(v(i) < 0, v(i) + n).otherwise(v(i))))
    a, b = place(start), n if end is None else place(end)
    return F.when(x.isNotNull(), F.slice(x, a + 1, F.greatest(F.lit(0), b - a)))


@public
def get(expr, key, default=None):
    """Lists from 0, negative from the end, default beyond; struct fields by name."""
    x = c(expr)
    if isinstance(key, str):
        return x.getField(key)
    k = v(key)
    out = F.get(x, F.when(k < 0, k + F.size(x)).otherwise(k))
    return out if default is None else F.when((k < F.size(x)) & (k >= -F.size(x)), out).otherwise(v(default))
