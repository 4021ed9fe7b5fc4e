"""A training corpus from raw documents: known languages, no toxic texts, no near copies, no benchmark items, packed.

Each stage works on the rows that its predecessor kept and returns them with the columns of `documents`; the last returns the
packed pieces. Empty tables give empty results; nulls and repeated rows are handled as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colsift.llm import decontaminate, language, packing, simhash, toxicity
from colsift.plans.session import discard, materialized

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the corpus; those without a letter or in none of them go."""
    return language.in_known_language(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, learning from the labels of the documents that are left."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language), ("toxicity", drop_toxic), ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated), ("packing", pack)]

ORACLE_SQL = None  # fingerprints, learned scores and packing have no SQL; tests/llm compares with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each stage's rows written before the next reads them; what a stage wrote on its way, and
    the rows of the stage before, are removed once its own rows are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialized(spark, lambda: stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
