"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.frame import Frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Tables:
    """The tables of a folder as frames: t.orders."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> Frame:
        if name not in TABLES:
            raise AttributeError(name)
        return Frame(self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))


def query(sql: str | None = None):
    """Registers a function of the tables that gives a frame."""

    def decorate(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir))
            return out.df if isinstance(out, Frame) else out

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return decorate


def portable(name: str, sql: str) -> None:
    """A query that Spark and DuckDB both run as it is."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for table in TABLES:
            if table in sql:
                spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        return spark.sql(sql)

    QUERIES[name], ORACLE_SQL[name] = run, sql


def engine_sql(name: str, sql: str, oracle: str) -> None:
    """A query in the engine's SQL, with the library's functions, and the same in DuckDB's."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..session import Session

        tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", sql)}
        return Session(spark).sql(sql, **tables).df

    QUERIES[name], ORACLE_SQL[name] = run, oracle
