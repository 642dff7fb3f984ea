"""Insight rows: selected deltas and validated extractions with their evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import sanitize_key
from tidemark.operators.delta import capacity_or, delta_priority
from tidemark.operators.joins import join_lookup
from tidemark.operators.ranking import first_per_group, top_per_group
from tidemark.operators.records import extraction
from tidemark.vocabulary import (
    BASELINE,
    OUTPUT_SAMPLE,
    PROJECT_DELTA,
    SOURCE_EXTRACTION,
    TABLE_PARSER_MODEL,
)

METADATA = ("utility_name", "market", "region", "source_kind")
# What is known of the document behind a run, one row per source.
EVIDENCE = (
    "observed_at",
    "source_url",
    "catalog_source_url",
    "raw_s3_bucket",
    "raw_s3_key",
    "output_s3_key",
    "content_md5",
    "remote_fingerprint",
)


def insight_id(source: Column, key: Column) -> Column:
    """Display id; one of over 160 characters ends in a hash of the whole."""
    return sanitize_key(F.concat_ws("-", source, key))


def enrich(deltas: DataFrame, catalog: DataFrame) -> DataFrame:
    """Deltas with utility, market, region and kind of their source."""
    return join_lookup(
        deltas, catalog.select("source_queue_id", *METADATA), ["source_queue_id"]
    )


def delta_insights(
    deltas: DataFrame, catalog: DataFrame, evidence: DataFrame, parsed_at: Column | None = None
) -> DataFrame:
    """One PROJECT_DELTA insight per selected delta. The time of parsing is the evidence's own,
    unless it is given. The evidence has one row per source."""
    names = [c for c in EVIDENCE if c in evidence.columns]
    if parsed_at is None:
        names, parsed_at = [*names, "parsed_at"], F.col("parsed_at")
    rows = join_lookup(
        enrich(deltas, catalog), evidence.select("source_queue_id", *names), ["source_queue_id"]
    )
    missing = {c: F.lit(None).cast("string") for c in EVIDENCE if c not in names}
    return rows.withColumns(missing).select(
        insight_id(F.col("source_queue_id"), F.col("project_key")).alias("queue_id"),
        "observed_at",
        F.lit(PROJECT_DELTA).alias("insight_type"),
        "source_queue_id",
        "project_key",
        "delta_type",
        "changed_fields",
        parsed_at.alias("parsed_at"),
        *EVIDENCE[1:],
        F.lit(TABLE_PARSER_MODEL).alias("model_id"),
        *METADATA,
        "interconnection_queue_id",
        "project_name",
        "capacity_mw",
        "capacity_source_field",
        "substation_or_node",
        "status",
        "developer_name",
        "county",
        "state",
        "zone",
        "fuel_type",
        "extraction_confidence",
        "review_status",
        "review_reasons",
        "record_fingerprint",
        "source_location",
        "source_row_number",
        "source_row",
        extraction().alias("extraction"),
    )


def extraction_insights(extractions: DataFrame, model_id: str, parsed_at: Column) -> DataFrame:
    """One SOURCE_EXTRACTION insight per scored extraction that carries its evidence."""
    missing = {
        c: F.lit(None).cast("string") for c in EVIDENCE if c not in extractions.columns
    }
    return extractions.withColumns(missing).select(
        F.col("source_queue_id").alias("queue_id"),
        "observed_at",
        F.lit(SOURCE_EXTRACTION).alias("insight_type"),
        parsed_at.alias("parsed_at"),
        *[c for c in EVIDENCE[1:] if c != "catalog_source_url"],
        F.lit(model_id).alias("model_id"),
        "interconnection_queue_id",
        "capacity_mw",
        "substation_or_node",
        "status",
        "developer_name",
        "extraction_confidence",
        "review_status",
        "review_reasons",
        extraction().alias("extraction"),
    )


IDENTITY = ["_source", "_project", "observed_at"]


def with_identity(rows: DataFrame) -> DataFrame:
    """Insights with `_source` and `_project`: identity is (source, project, observed_at), and for
    extractions the project is empty."""
    for name in ("source_queue_id", "project_key"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    return rows.withColumns(
        {
            "_source": F.coalesce("source_queue_id", "queue_id"),
            "_project": F.coalesce("project_key", F.lit("")),
        }
    )


def newest_insights(rows: DataFrame, version: Column) -> DataFrame:
    """Of the rows of one identity the newest version's; rows have their identity."""
    # The parse time breaks ties inside one version, so the outcome never depends on row order.
    tie = F.col("parsed_at") if "parsed_at" in rows.columns else F.lit(0)
    best = F.struct(version, tie, "queue_id")
    return first_per_group(rows, IDENTITY, best).drop("_source", "_project")


def upsert_insights(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing and incoming insights; an incoming row replaces one with the same identity."""
    old, new = (
        with_identity(rows).withColumn("_version", F.lit(version))
        for version, rows in enumerate((existing, incoming))
    )
    both = old.unionByName(new, allowMissingColumns=True)
    return newest_insights(both, F.col("_version")).drop("_version")


def run_output(deltas: DataFrame, counters: DataFrame, sample: int = OUTPUT_SAMPLE) -> DataFrame:
    """One row per source: its counters and the first `sample` selected deltas in rank order.

    Deltas without a rank come in the order in which they would be ranked."""
    order = [
        F.col("delta_rank").asc_nulls_last(),
        delta_priority().asc_nulls_first(),
        capacity_or(-1).desc(),
        F.when(F.col("delta_type") == BASELINE, F.col("first_seen")).asc_nulls_first(),
        F.col("project_key"),
    ]
    shown = top_per_group(deltas, ["source_queue_id"], order, sample, "sample_rank")
    fields = [c for c in deltas.columns if c not in ("source_queue_id", "delta_rank")]
    samples = shown.groupBy("source_queue_id").agg(
        F.array_sort(
            F.collect_list(F.struct("sample_rank", *fields)),
            lambda a, b: a["sample_rank"] - b["sample_rank"],
        ).alias("deltas_sample")
    )
    return counters.join(samples, "source_queue_id", "left")
