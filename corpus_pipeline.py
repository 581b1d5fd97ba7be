"""The corpus pipeline: quality, near-duplicates, contamination, mixture, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metaveil.llm import decontaminate, mixing, quality, simhash, token_planes
from metaveil.llm.common import materialise, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.accept(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages make up a twentieth or more go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight asks for, at least once."""
    return mixing.realise(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in files, and what is read back of each document. The workers keep few words: they hold the other stages too."""
    return token_planes.encode_and_read(docs, cache_words=150_000, special=True)


STAGES = [
    ("quality", quality_filter),
    ("simhash", near_duplicates),
    ("decontaminate", decontamination),
    ("mixing", mixture),
    ("token_planes", token_output),
]

#: Tokenizers and trained models are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
