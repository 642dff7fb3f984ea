"""Snapshot comparison: which projects are new, updated, removed or a first baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.joins import join_lookup
from tidemark.operators.ranking import top_per_group
from tidemark.vocabulary import (
    BASELINE,
    DELTA_PRIORITY,
    NEW,
    REMOVED,
    TRACKED_FIELDS,
    UPDATED,
)

KEYS = ["source_queue_id", "project_key"]
SUMMARY_COLUMNS = ("baseline_records", "baseline_sample", "new", "updated", "removed")


def changed_fields(old: str, new: str) -> Column:
    """Labels of the tracked fields that differ; only the raw row differs when none does."""
    labels = ", ".join(
        f"if({old}.{column} <=> {new}.{column}, null, '{label}')"
        for label, column in TRACKED_FIELDS.items()
    )
    # Labels hold no comma, so joining and splitting drops the nulls.
    return F.expr(f"split(coalesce(nullif(concat_ws(',', {labels}), ''), 'SourceRow'), ',')")


def _packed(records: DataFrame, name: str, keys: list[str]) -> DataFrame:
    rest = [c for c in records.columns if c not in keys]
    return records.select(*keys, F.struct(*rest).alias(name))


def _as_deltas(joined: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Full-outer pairs (cur, prev) to NEW / UPDATED / REMOVED rows; equal pairs drop out."""
    kind = (
        F.when(F.col("prev").isNull(), NEW)
        .when(F.col("cur").isNull(), REMOVED)
        .when(F.col("cur.record_fingerprint") != F.col("prev.record_fingerprint"), UPDATED)
    )
    gone = F.col("delta_type") == REMOVED
    labels = (
        F.when(gone, F.array(F.lit("Status")))
        .when(F.col("delta_type") == UPDATED, changed_fields("prev", "cur"))
        .otherwise(F.array().cast("array<string>"))
    )
    moved = joined.withColumn("delta_type", kind).filter(F.col("delta_type").isNotNull())
    chosen = F.when(gone, F.col("prev")).otherwise(F.col("cur")).alias("chosen")
    rows = moved.select(*keys, "delta_type", labels.alias("changed_fields"), chosen)
    # A project that left the queue counts as withdrawn.
    status = F.when(gone, F.lit("Withdrawn")).otherwise(F.col("chosen.status"))
    return (
        rows.withColumn("chosen", F.col("chosen").withField("status", status))
        .select(*keys, "delta_type", "changed_fields", "chosen.*")
        .select(*keys, "delta_type", "changed_fields", *fields)
    )


def diff_snapshots(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Deltas of every source in one full outer join on (source, key).

    Keys are unique on both sides, so no join key is hot however large a source
    is. `dedupe_records` leaves its output partitioned by the same keys, so the
    current side is not shuffled again.
    """
    fields = [c for c in current.columns if c not in KEYS]
    joined = _packed(current, "cur", KEYS).join(
        _packed(previous.select(*KEYS, *fields), "prev", KEYS), KEYS, "full_outer"
    )
    return _as_deltas(joined, KEYS, fields)


def new_projects(current: DataFrame, previous: DataFrame) -> DataFrame:
    return current.join(previous.select(*KEYS), KEYS, "left_anti")


def removed_projects(current: DataFrame, previous: DataFrame) -> DataFrame:
    gone = previous.join(current.select(*KEYS), KEYS, "left_anti")
    return gone.withColumns(
        {"status": F.lit("Withdrawn"), "changed_fields": F.array(F.lit("Status"))}
    )


def updated_projects(current: DataFrame, previous: DataFrame) -> DataFrame:
    old = previous.select(*KEYS, "record_fingerprint", *TRACKED_FIELDS.values())
    pairs = _packed(current, "cur", KEYS).join(_packed(old, "prev", KEYS), KEYS)
    # Null-safe, as a plain comparison would have both fingerprints worked out once more before the join.
    same = F.col("cur.record_fingerprint").eqNullSafe(F.col("prev.record_fingerprint"))
    return (
        pairs.filter(~same)
        .withColumn("changed_fields", changed_fields("prev", "cur"))
        .select(*KEYS, "changed_fields", "cur.*")
    )


# --- baseline -----------------------------------------------------------------
def split_by_history(current: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records of sources seen before, records of sources seen for the first time).

    `manifest` has one row per source that has a snapshot; whether a source is
    new is a property of the source, not of its rows.
    """
    known = manifest.select("source_queue_id").distinct()
    return (
        join_lookup(current, known, ["source_queue_id"], "left_semi"),
        join_lookup(current, known, ["source_queue_id"], "left_anti"),
    )


def capacity_or(missing: int) -> Column:
    """Capacity for ranking; zero ranks like no capacity at all."""
    return F.coalesce(F.nullif(F.col("capacity_mw"), F.lit(0)), F.lit(missing))


def _unranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("delta_rank", F.lit(None).cast("int"))


def baseline_top(first_time: DataFrame, limit: int | None = None) -> DataFrame:
    """The largest projects of each first-time source; without a limit all of them, unranked."""
    if limit is None:
        return _unranked(first_time)
    order = [capacity_or(-1).desc(), F.col("first_seen"), F.col("project_key")]
    return top_per_group(
        first_time, ["source_queue_id"], order, limit, "delta_rank", measure=-capacity_or(-1)
    )


def baseline_deltas(first_time: DataFrame, limit: int | None = None) -> DataFrame:
    return baseline_top(first_time, limit).withColumns(
        {"delta_type": F.lit(BASELINE), "changed_fields": F.array().cast("array<string>")}
    )


def delta_priority() -> Column:
    """Removed, then new, then updated."""
    priority = F.create_map(*[F.lit(x) for pair in DELTA_PRIORITY.items() for x in pair])
    return F.try_element_at(priority, F.col("delta_type"))


def select_deltas(deltas: DataFrame, limit: int | None = None) -> DataFrame:
    """By kind, capacity and key at most `limit` per source; without a limit all, unranked."""
    if limit is None:
        return _unranked(deltas)
    order = [
        delta_priority(),
        capacity_or(0).desc(),
        F.col("project_key"),
    ]
    # Capacities beyond the spread share a measure, which costs time only.
    spread = 1 << 40
    within = F.greatest(F.least(capacity_or(0), F.lit(spread)), F.lit(-spread))
    measure = delta_priority() * F.lit(2 * spread + 1) - within
    return top_per_group(
        deltas, ["source_queue_id"], order, limit, "delta_rank", measure=measure
    )


def current_sources(previous: DataFrame, present: DataFrame) -> DataFrame:
    """Previous records of the sources in the present batch.

    A source that gave no records this time is left alone, so a failed or empty
    document does not report all its projects as removed.
    """
    names = present.select("source_queue_id").distinct()
    return join_lookup(previous, names, ["source_queue_id"], "left_semi")


def compare(
    current: DataFrame,
    previous: DataFrame,
    manifest: DataFrame,
    baseline_limit: int | None = None,
    truncated: DataFrame | None = None,
    moved: DataFrame | None = None,
) -> DataFrame:
    """All deltas of a run: baselines of first-time sources and diffs of the others.

    `previous` holds the latest snapshot of each source; pass it through
    `current_sources` first when some sources may be absent from `current`. `moved` are its deltas,
    if they have been found already.
    `truncated` names sources that a limit has cut: what they lack is not known to be removed.
    """
    seen, first_time = split_by_history(current, manifest)
    if moved is None:
        moved = diff_snapshots(seen, previous)
    if truncated is not None:
        cut = truncated.select("source_queue_id").distinct().withColumn("_cut", F.lit(True))
        moved = (
            moved.join(cut, "source_queue_id", "left")
            .filter(F.col("_cut").isNull() | (F.col("delta_type") != REMOVED))
            .drop("_cut")
        )
    return baseline_deltas(first_time, baseline_limit).unionByName(
        moved.withColumn("delta_rank", F.lit(None).cast("int"))
    )


def selected(deltas: DataFrame, limit: int | None = None) -> DataFrame:
    """Deltas to persist: all of them, or with a limit ranked and cut, baselines as they are."""
    is_sample = F.col("delta_type") == BASELINE
    if limit is None:
        return deltas.withColumn("delta_rank", F.when(is_sample, F.col("delta_rank")))
    moved = select_deltas(deltas.filter(~is_sample).drop("delta_rank"), limit)
    return deltas.filter(is_sample).unionByName(moved)


def delta_summary(
    deltas: DataFrame, current: DataFrame, manifest: DataFrame
) -> DataFrame:
    """Counts per source, before any cut; one row for every source in the run."""
    known = manifest.select("source_queue_id").distinct().withColumn("seen", F.lit(True))
    sizes = join_lookup(
        current.groupBy("source_queue_id").agg(F.count("*").alias("records")),
        known,
        ["source_queue_id"],
    )

    def times(kind: str) -> Column:
        return F.count_if(F.col("delta_type") == kind)

    moved = deltas.groupBy("source_queue_id").agg(
        times(BASELINE).alias("baseline_sample"),
        times(NEW).alias("new"),
        times(UPDATED).alias("updated"),
        times(REMOVED).alias("removed"),
    )
    counts = sizes.join(moved, "source_queue_id", "full_outer")
    return counts.select(
        "source_queue_id",
        F.when(F.col("seen").isNull(), F.coalesce("records", F.lit(0)))
        .otherwise(F.lit(0))
        .cast("bigint")
        .alias("baseline_records"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in SUMMARY_COLUMNS[1:]],
        F.coalesce("records", F.lit(0)).cast("bigint").alias("record_count"),
    )


def run_counters(summary: DataFrame, persisted: DataFrame) -> DataFrame:
    """Records, deltas before the cut, and deltas persisted, per source."""
    kept = persisted.groupBy("source_queue_id").agg(F.count("*").alias("persisted_count"))
    return summary.join(kept, "source_queue_id", "left").select(
        "source_queue_id",
        "record_count",
        (
            F.col("baseline_sample") + F.col("new") + F.col("updated") + F.col("removed")
        ).alias("delta_count"),
        F.coalesce("persisted_count", F.lit(0)).cast("bigint").alias("persisted_count"),
    )
