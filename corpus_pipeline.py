"""A training corpus in five stages; each reads what its predecessor kept, written as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomframe.llm import exact_dedup, jaccard, mixture, toxicity
from loomframe.llm import queries as production
from loomframe.llm.common import cut, documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network accepts; it is trained on labelled documents of this stage."""
    return toxicity.accepted(docs, production.toxicity_model(spark, sf_dir, docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar shingles, the one with the least id."""
    return jaccard.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate takes it."""
    return mixture.emit(docs, production.MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what remains, a row for each copy."""
    return production.coded(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard_join", drop_near_copies), ("mixture", mix_sources), ("byte_bpe", encode)]

#: The network's scores have no SQL form; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
