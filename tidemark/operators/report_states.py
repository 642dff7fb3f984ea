"""Running aggregates of the report: one partial state per hour, source and kind of signal.

States hold counts and newest-of structs, so those of any hours can be merged: a report over a
lookback reads states of whole hours, and signals of the one hour that the lookback cuts. Delta
signals and others are kept apart, as a report shows only the former if there are any: one pass over
the states carries both, and the choice is made at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import report
from tidemark.operators.report import HEALTH_LIMITATION, HEALTHY
from tidemark.vocabulary import NEEDS_REVIEW, PROJECT_DELTA

_KEYS = ["hour", "source_queue_id", "is_delta"]
SUMMARY = (
    "total_signals", "project_delta_signals", "baseline_signals", "new_signals", "updated_signals", "removed_signals",
    "needs_review", "total_capacity_mw", "active_signals", "withdrawn_signals", "completed_signals",
)


def signal_states(signals: DataFrame) -> DataFrame:
    """States of signals; each task sums up its own rows first."""

    def count(column: str, value: str) -> Column:
        return F.count_if(F.col(column) == value)

    named = F.coalesce(F.nullif("source_queue_id", F.lit("")), "queue_id")
    newest = F.struct("observed_at", "queue_id", "market", "utility_name")
    keyed = signals.withColumns(
        {
            "hour": F.date_trunc("hour", "observed_at"),
            "source_queue_id": named,
            "is_delta": F.coalesce(F.col("insight_type") == PROJECT_DELTA, F.lit(False)),
        }
    )
    return keyed.groupBy(*_KEYS).agg(
        F.count("*").alias("total_signals"),
        count("insight_type", PROJECT_DELTA).alias("project_delta_signals"),
        count("delta_type", "BASELINE").alias("baseline_signals"),
        count("delta_type", "NEW").alias("new_signals"),
        count("delta_type", "UPDATED").alias("updated_signals"),
        count("delta_type", "REMOVED").alias("removed_signals"),
        count("review_status", NEEDS_REVIEW).alias("needs_review"),
        F.coalesce(F.sum("capacity_mw"), F.lit(0)).cast("bigint").alias("total_capacity_mw"),
        count("status", "Active").alias("active_signals"),
        count("status", "Withdrawn").alias("withdrawn_signals"),
        count("status", "Completed").alias("completed_signals"),
        F.max(newest).alias("newest"),
    )


def states_since(states: DataFrame, signals: DataFrame, since: Column) -> DataFrame:
    """States of all signals from a time on. `signals` are read only within the hour it falls into."""
    edge = F.date_trunc("hour", since)
    whole = states.filter(F.col("hour") > edge)
    part = signals.filter((F.col("observed_at") >= since) & (F.col("observed_at") < edge + F.expr("interval 1 hour")))
    return whole.unionByName(signal_states(part).select(*states.columns))


def merged_summary(states: DataFrame) -> DataFrame:
    """The report's summary: that of the delta signals if there are any, else of all signals."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in SUMMARY]
    kinds = states.groupBy("is_delta").agg(*sums)
    chosen = kinds.agg(F.max_by(F.struct(*SUMMARY), "is_delta").alias("s"))
    return chosen.select(*[F.coalesce(f"s.{c}", F.lit(0)).cast("bigint").alias(c) for c in SUMMARY])


def merged_health(states: DataFrame) -> DataFrame:
    """One row per source of the report, from its states."""
    kinds = states.groupBy("source_queue_id", "is_delta").agg(
        F.max("newest").alias("newest"),
        F.sum("total_signals").cast("bigint").alias("change_count"),
        F.max(F.col("needs_review") > 0).alias("review"),
    )
    any_delta = states.agg(F.coalesce(F.max("is_delta"), F.lit(False)).alias("any_delta")).scalar()
    return kinds.filter(F.col("is_delta") | ~any_delta).select(
        "source_queue_id",
        F.col("newest.market").alias("market"),
        F.coalesce(F.nullif("newest.utility_name", F.lit("")), "source_queue_id").alias("source_name"),
        F.lit("").alias("format"),
        F.col("newest.observed_at").alias("last_checked_at"),
        F.col("newest.observed_at").alias("last_changed_at"),
        F.when(F.col("review"), NEEDS_REVIEW).otherwise(HEALTHY).alias("parser_status"),
        F.lit("").alias("rows_snapshotted"),
        "change_count",
        F.lit(HEALTH_LIMITATION).alias("limitation"),
    )


def insight_states(insights: DataFrame) -> DataFrame:
    return signal_states(report.signals(insights))
