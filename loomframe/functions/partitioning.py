"""Partition transforms of table formats, and times in ordered UUIDs."""

from __future__ import annotations

import datetime
import decimal
import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import c, public


@public
def partition_days(expr):
    return F.to_date(c(expr))


@public
def partition_hours(expr):
    return F.floor(F.unix_micros(c(expr).cast("timestamp")) / 3_600_000_000).cast("int")


@public
def partition_months(expr):
    return ((F.year(c(expr)) - 1970) * 12 + F.month(c(expr)) - 1).cast("int")


@public
def partition_years(expr):
    return (F.year(c(expr)) - 1970).cast("int")


def murmur3(data: bytes, seed: int = 0) -> int:
    """32 bits, the x86 variant with its usual tail."""
    mask, h = 0xFFFFFFFF, seed

    def scrambled(k: int) -> int:
        k = k * 0xCC9E2D51 & mask
        return ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask

    whole = len(data) // 4 * 4
    for (k,) in struct.iter_unpack("<I", data[:whole]):
        h ^= scrambled(k)
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    if len(data) > whole:
        h ^= scrambled(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & mask
    return h


@public
def partition_iceberg_bucket(expr, n: int):
    """Integers hash as 8 little-endian bytes, strings as UTF-8, dates as days, timestamps as microseconds, decimals as the least bytes of their unscaled value."""

    def raw(x) -> bytes:
        if isinstance(x, bytes | str):
            return x.encode() if isinstance(x, str) else x
        if isinstance(x, decimal.Decimal):
            unscaled = int(x.scaleb(-x.as_tuple().exponent, decimal.Context(prec=40)))
            return unscaled.to_bytes((unscaled if unscaled >= 0 else ~unscaled).bit_length() // 8 + 1, "big", signed=True)
        if isinstance(x, datetime.datetime):
            x = (x.replace(tzinfo=None) - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
        elif isinstance(x, datetime.date):
            x = (x - datetime.date(1970, 1, 1)).days
        return struct.pack("<q", x)

    # Arrow keeps long integers exact beside nulls, which pandas makes doubles.
    @F.arrow_udf("int")
    def udf(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else (murmur3(raw(x)) & 0x7FFFFFFF) % n for x in a.to_pylist()], pa.int32())

    return udf(c(expr))


@public
def partition_iceberg_truncate(expr, w: int, kind: str = "number"):
    x = c(expr)
    return F.left(x, F.lit(w)) if kind == "string" else x - F.pmod(x, F.lit(w))


def _uuid7_ms(expr) -> Column:
    return F.conv(F.substring(F.regexp_replace(c(expr), "-", ""), 1, 12), 16, 10).cast("long")


@public
def extract_minute_uuid7(expr):
    return F.floor(_uuid7_ms(expr) / 60_000).cast("long")


@public
def extract_hour_uuid7(expr):
    return F.floor(_uuid7_ms(expr) / 3_600_000).cast("long")


@public
def extract_day_uuid7(expr):
    return F.floor(_uuid7_ms(expr) / 86_400_000).cast("long")


@public
def extract_month_uuid7(expr):
    return partition_months(F.timestamp_millis(_uuid7_ms(expr)))
