"""A training corpus from documents, in five stages, each one operator of tidemark.llm.

Every stage takes what its predecessor kept, as Parquet, and its decisions take effect: documents
without a language go, of each group of near copies one stays, personal data is masked, sources are
repeated or sampled to their target weights, and what is left is packed into sequences. All stages
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tidemark.llm.queries  # noqa: F401  lets the operators travel with their plans
from tidemark.llm import language, minmax, mixing, packing, privacy
from tidemark.llm.common import written


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language, which becomes their lang; null texts and texts without a
    letter go."""
    return language.with_language(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: similarity 0.8 of five-word shingles."""
    return minmax.representatives(docs, words=5)


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and revealing terms generalised; n_chars follows the text."""
    clean = privacy.masked(docs)
    if "n_chars" in clean.columns:
        kind = clean.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.length("text").cast(kind))
    return clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    return mixing.repeated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences."""
    return packing.pack(docs)


STAGES = [
    ("language", identified),
    ("near_dedup", deduplicated),
    ("privacy", sanitised),
    ("mix", mixed),
    ("pack", packed),
]

#: Language models, signatures and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
