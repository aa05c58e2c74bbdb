"""Rows of Spark and of DuckDB, made comparable."""

import datetime
import decimal
import math
import os
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal | int | float):
        return "nan" if isinstance(v, float) and math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, bytearray):
        return bytes(v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def duck(sf: str):
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def spark_rows(df) -> tuple[list[str], list]:
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)


def duck_rows(con, sql: str) -> tuple[list[str], list]:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)
