"""Python functions as columns. Batches travel as Arrow; row-by-row functions are the slow path."""

from __future__ import annotations

import asyncio
import logging
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .expr import Expr, named


def _call(u, args):
    return Expr(u(*[named(a) for a in args]))


def _fields(u, args, return_dtype: str) -> list[Expr]:
    """The fields of a struct that a function gives, as columns of their own; equal calls of one select run once."""
    kind = _parse_datatype_string(return_dtype)
    if not isinstance(kind, StructType):
        raise ValueError(f"only structs have fields: {return_dtype}")
    out = u(*[named(a) for a in args])
    return [Expr(out.getField(n).alias(n)) for n in kind.names]


def _sliced(f, batch_size: int | None):
    """f over pieces of at most batch_size rows."""
    if batch_size is None:
        return f
    if batch_size < 1:
        raise ValueError(f"no such batch_size: {batch_size}")

    def run(*columns: pd.Series) -> pd.Series:
        pieces = [pd.Series(f(*[s.iloc[i : i + batch_size].reset_index(drop=True) for s in columns])) for i in range(0, len(columns[0]), batch_size)]
        return pd.concat(pieces, ignore_index=True) if pieces else pd.Series([], dtype="object")

    return run


def func(return_dtype: str, max_retries: int = 0, on_error: str = "raise", max_concurrency: int | None = None, unnest: bool = False):
    """Decorates a function of one row's values; coroutines run together, batch by batch, at most max_concurrency at a time. on_error: raise, log or ignore (null).
    unnest: a list of columns, one for each field of the struct that it gives."""
    if on_error not in ("raise", "log", "ignore"):
        raise ValueError(f"no such on_error: {on_error}")

    def failed(attempt: int, error: Exception) -> None:
        """Raise, or go on: to the next attempt, or after the last to null."""
        if attempt == max_retries:
            if on_error == "raise":
                raise error
            if on_error == "log":
                logging.getLogger(__name__).warning("a function failed: %r", error)

    def decorate(f):
        def guarded(*a):
            for attempt in range(max_retries + 1):
                try:
                    return f(*a)
                except Exception as e:
                    failed(attempt, e)

        if asyncio.iscoroutinefunction(f):

            async def together(rows):
                free = asyncio.Semaphore(max_concurrency or max(1, len(rows)))

                async def one(row):
                    async with free:
                        for attempt in range(max_retries + 1):
                            try:
                                return await f(*row)
                            except Exception as e:
                                failed(attempt, e)

                return await asyncio.gather(*map(one, rows))

            def run(*columns: pd.Series) -> pd.Series:
                return pd.Series(asyncio.run(together(list(zip(*columns)))), dtype="object")

            u = F.pandas_udf(run, return_dtype)
        else:
            u = F.udf(guarded, return_dtype, useArrow=True)
        return lambda *args: _fields(u, args, return_dtype) if unnest else _call(u, args)

    return decorate


def generator(item_dtype: str, ignore_empty: bool = False):
    """Decorates a function that yields any number of values for a row; the column explodes into rows."""

    def decorate(f):
        u = F.udf(lambda *a: list(f(*a)), f"array<{item_dtype}>", useArrow=True)
        explode = F.explode if ignore_empty else F.explode_outer
        return lambda *args: Expr(explode(u(*[named(a) for a in args])))

    return decorate


def batch(return_dtype: str, batch_size: int | None = None):
    """Decorates a function of whole pandas series, of at most batch_size rows."""

    def decorate(f):
        whole = _sliced(f, batch_size)

        def run(*columns: pd.Series) -> pd.Series:
            return whole(*columns)

        u = F.pandas_udf(run, return_dtype)
        return lambda *args: _call(u, args)

    return decorate


def stateful(return_dtype: str, method: str = "__call__", batch_size: int | None = None, **options):
    """Decorates a class that is made once a task; its method is called with whole series of its arguments, of at most batch_size rows."""

    def decorate(cls):
        def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            whole = _sliced(getattr(cls(**options), method), batch_size)
            for columns in batches:
                # One argument comes as itself.
                yield whole(*columns) if isinstance(columns, tuple) else whole(columns)

        u = F.pandas_udf(run, return_dtype)
        return lambda *args: _call(u, args)

    return decorate


def udf(return_dtype: str, batch_size: int | None = None, **options):
    """The older decorator: of a function of whole series, or of a class that is made once a task with the options."""

    def decorate(f):
        return stateful(return_dtype, batch_size=batch_size, **options)(f) if isinstance(f, type) else batch(return_dtype, batch_size)(f)

    return decorate


#: Keys of a task whose states are held at once; beyond, they are sent on and later combined.
HELD = 100_000


class Aggregate:
    """A two-phase aggregate: ``partial`` of a series in every partition, ``combine`` of two states, ``finalize``. States are JSON-serialisable."""

    return_dtype = "double"

    def partial(self, values: pd.Series):
        raise NotImplementedError

    def combine(self, a, b):
        raise NotImplementedError

    def finalize(self, state):
        return state


def aggregate(frame, aggregate: Aggregate, keys: list[str], value: str, name: str):
    """Groups by keys. Partial states are made where the rows are, so only one state for a group and task is shuffled."""
    import json

    from .frame import Frame

    df = frame.df
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def partials(batches):
        states: dict = {}
        for b in batches:
            for key, part in b.groupby(keys, dropna=False):
                s = aggregate.partial(part[value])
                key = key if isinstance(key, tuple) else (key,)
                states[key] = aggregate.combine(states[key], s) if key in states else s
            if len(states) > HELD:
                yield sent(states)
                states = {}
        yield sent(states)

    def sent(states: dict) -> pd.DataFrame:
        return pd.DataFrame([(*k, json.dumps(s)) for k, s in states.items()], columns=[*keys, "__state"])

    def final(part: pd.DataFrame) -> pd.DataFrame:
        states = [json.loads(s) for s in part["__state"]]
        state = states[0]
        for s in states[1:]:
            state = aggregate.combine(state, s)
        return pd.DataFrame([(*part.iloc[0][keys], aggregate.finalize(state))], columns=[*keys, name])

    small = df.select(*keys, value).mapInPandas(partials, f"{fields}, __state string")
    return Frame(small.groupBy(*keys).applyInPandas(final, f"{fields}, `{name}` {aggregate.return_dtype}"))


def as_column(x) -> Column:
    return named(x)
