"""The registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import tidemark.llm
from tidemark.llm import (
    ann,
    chat,
    embedding_dedup,
    language,
    licenses,
    minmax,
    mixing,
    oracles,
    packing,
    privacy,
    secrets,
    toxicity,
    turns,
    whitening,
)
from tidemark.llm.common import table

# Workers need not find this folder on their path: what they run travels with the plan.
cloudpickle.register_pickle_by_value(tidemark.llm)


def op1_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op2_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(table(spark, sf_dir, "embeddings"))


def op3_minmax_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.link(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_pairs(chat.by_parity(table(spark, sf_dir, "conversations")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op7_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_private_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.find_private(table(spark, sf_dir, "documents"))


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op11_whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_toxic_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turns.repair(conversations, turns.damaged(conversations))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hnsw_neighbours,
        op2_embedding_links,
        op3_minmax_links,
        op4_source_mix,
        op5_preference_chat,
        op6_license_scan,
        op7_cost_packing,
        op8_private_terms,
        op9_secret_ledger,
        op10_language_id,
        op11_whitened,
        op12_toxic_machine,
        op13_turn_repair,
    )
}

ORACLES: dict[str, str] = {
    "op2_embedding_links": oracles.OP2,
    "op3_minmax_links": oracles.OP3,
    "op4_source_mix": oracles.OP4,
    "op5_preference_chat": oracles.OP5,
    "op13_turn_repair": oracles.OP13,
}
