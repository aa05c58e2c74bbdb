"""Structs, maps, conditions, casts, hashes, ids, similarity hashes."""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import c, public, v


@public
def unnest(expr):
    """All fields of a struct, in a select."""
    return F.col(f"{expr}.*") if isinstance(expr, str) else c(expr)


@public
def to_struct(*fields, **named):
    return F.struct(*[c(f) for f in fields], *[c(f).alias(n) for n, f in named.items()])


@public
def monotonically_increasing_id():
    return F.monotonically_increasing_id()


@public
def uuid(version: int = 4):
    """Random (4), or ordered by time (7): 48 bits of milliseconds, then random bits."""
    if version == 4:
        return F.uuid()
    if version != 7:
        raise ValueError(f"no such version: {version}")
    r = F.regexp_replace(F.uuid(), "-", "")
    ms = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    return F.concat(F.substring(ms, 1, 8), F.lit("-"), F.substring(ms, 9, 4), F.lit("-7"), F.substring(r, 14, 3), F.lit("-"), F.substring(r, 17, 4), F.lit("-"), F.substring(r, 21, 12))


@public
def random_int(low: int, high: int, seed: int | None = None):
    """Both ends included."""
    return (F.floor((F.rand() if seed is None else F.rand(seed)) * (high - low + 1)) + low).cast("long")


@public
def eq_null_safe(left, right):
    return c(left).eqNullSafe(v(right))


@public
def cast(expr, dtype: str):
    return c(expr).cast(dtype)


@public
def try_cast(expr, dtype: str):
    return c(expr).try_cast(dtype)


@public
def is_null(expr):
    return c(expr).isNull()


@public
def not_null(expr):
    return c(expr).isNotNull()


@public
def fill_null(expr, fill_value):
    return F.coalesce(c(expr), v(fill_value))


@public
def is_in(expr, other):
    return c(expr).isin(list(other)) if isinstance(other, list | tuple | set) else F.array_contains(v(other), c(expr))


@public
def coalesce(*args):
    return F.coalesce(*[c(x) for x in args])


@public
def concat(left, right):
    return F.concat(c(left), v(right))


@public
def map_get(expr, key):
    return F.try_element_at(c(expr), v(key))


@public
def map_keys(expr):
    return F.map_keys(c(expr))


@public
def when(condition, then) -> Column:
    return F.when(c(condition), v(then))


@public
def hash(*exprs, seed: int | None = None, hash_function: str = "xxhash64"):
    """A 64-bit number; nulls have a value. sha1 takes the first 8 bytes of the digest."""
    columns = [c(x) for x in exprs]
    if seed is not None:
        columns = [F.lit(seed).cast("long"), *columns]
    if hash_function in ("xxhash64", "xxhash32", "xxhash3_64"):
        return F.xxhash64(*columns)
    if hash_function == "murmurhash3":
        return F.hash(*columns).cast("long")
    if hash_function == "sha1":
        text = F.concat_ws("\u0001", *[F.coalesce(x.cast("string"), F.lit("\u0000")) for x in columns])
        return F.conv(F.substring(F.sha1(text), 1, 15), 16, 10).cast("long")
    raise ValueError(f"no such hash: {hash_function}")


_PRIME = (1 << 61) - 1


def _permutations(n: int, seed: int) -> list[tuple[int, int]]:
    """n pairs from SHA-256 of the seed."""
    draw = lambda i, k: int.from_bytes(hashlib.sha256(f"{seed}:{i}:{k}".encode()).digest()[:7], "big") % (_PRIME - 1)
    return [(draw(i, "a") + 1, draw(i, "b")) for i in range(n)]


#: Hashes of a block of n-grams at a time, so that a text of any length needs the same memory.
_BLOCK = 4096


def _hasher(name: str):
    """A function of bytes that gives 64 bits (32 for the shorter ones)."""
    import xxhash

    from .partitioning import murmur3

    known = {
        "xxhash64": xxhash.xxh64_intdigest, "xxhash32": xxhash.xxh32_intdigest, "xxhash3_64": xxhash.xxh3_64_intdigest, "murmurhash3": murmur3, "sha1": lambda b: int.from_bytes(hashlib.sha1(b).digest()[:8], "little"),
    }
    if name not in known:
        raise ValueError(f"no such hash: {name}; there are {', '.join(known)}")
    return known[name]


def _blocks(items, f, mask: int):
    """Arrays of the hashes of the items, a block at a time."""
    for some in batched(items, _BLOCK):
        yield np.array([f(x.encode()) & mask for x in some], np.uint64)


@public
def minhash(text, num_hashes: int = 64, ngram_size: int = 1, seed: int = 1, hash_function: str = "xxhash64"):
    """The least of each of num_hashes permutations over hashes of word n-grams, as 32-bit numbers."""
    _hasher(hash_function)
    pairs = _permutations(num_hashes, seed)
    a, b = (np.array([p[i] for p in pairs], dtype=object) for i in (0, 1))
    low_a, high_a, b61 = (a % (1 << 32)).astype(np.uint64), (a >> 32).astype(np.uint64), (b % _PRIME).astype(np.uint64)

    def times(h: np.ndarray) -> np.ndarray:
        """(a * h + b) mod 2**61 - 1 for 32-bit h, without overflow."""
        p = np.uint64(_PRIME)
        low = low_a[None, :] * h[:, None]
        high = high_a[None, :] * h[:, None] % p  # times 2**32
        shifted = (high >> np.uint64(29)) + ((high & np.uint64((1 << 29) - 1)) << np.uint64(32))
        return (low % p + shifted % p + b61[None, :]) % p

    @F.pandas_udf("array<long>")
    def udf(s: pd.Series) -> pd.Series:
        f = _hasher(hash_function)

        def one(t):
            w = t.split(" ")
            grams = {" ".join(w[i : i + ngram_size]) for i in range(max(1, len(w) - ngram_size + 1))}
            least = reduce(np.minimum, (times(h).min(0) for h in _blocks(grams, f, 0xFFFFFFFF)))
            return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)

        return s.map(one, na_action="ignore")

    return udf(c(text))


@public
def simhash(text, ngram_size: int = 3, hash_function: str = "xxhash64"):
    """64 bits: each the majority over hashes of character n-grams; 0 for shorter texts."""
    _hasher(hash_function)
    places = np.arange(64, dtype=np.uint64)

    @F.pandas_udf("long")
    def udf(s: pd.Series) -> pd.Series:
        f = _hasher(hash_function)

        def one(t):
            n = len(t) - ngram_size + 1
            if n < 1:
                return 0
            ones = sum(((h[:, None] >> places) & np.uint64(1)).sum(0) for h in _blocks((t[i : i + ngram_size] for i in range(n)), f, (1 << 64) - 1))
            return int(((ones * 2 > n).astype(np.uint64) << places).sum(dtype=np.uint64).astype(np.int64))

        # Not by map: it makes doubles of numbers beside nulls.
        return pd.Series([None if pd.isna(t) else one(t) for t in s], dtype="Int64")

    return udf(c(text))
