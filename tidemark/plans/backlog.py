"""Any number of queued documents of each source in one job, as if they had been run one by one.

Each document is a version of its source. Documents are decoded in one pass, records are built by
version, and the version chain of every source (`operators.chains`) gives all changes in one shuffle
of keys and fingerprints. The tables get the rows that single runs would have written, under each
version's id; the manifest comes last and in one piece, so a failed backlog is repeated as a whole.
Only the run output differs: one folder for the backlog, with the version in each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators import catalog, chains, delta, insights, matrix
from tidemark.operators.joins import join_lookup
from tidemark.operators.records import (
    dedupe_records,
    limit_records,
    records_from_entries,
    with_fingerprints,
)
from tidemark.plans import run
from tidemark.plans.run import Limits
from tidemark.sinks.reports import write_run_output
from tidemark.sinks.store import DeltaStore
from tidemark.sources import decode
from tidemark.vocabulary import BASELINE, REMOVED

PAIR = ["source_queue_id", "snapshot_id"]
#: Between source and version, where functions that work by source work by version.
_BETWEEN = "\x1f"


def by_version(rows: DataFrame) -> DataFrame:
    """Rows whose source stands for (source, version)."""
    return rows.withColumn("source_queue_id", F.concat_ws(_BETWEEN, *PAIR)).drop("snapshot_id")


def by_source(rows: DataFrame) -> DataFrame:
    """The other way round."""
    part = F.split("source_queue_id", _BETWEEN)
    return rows.withColumns({"snapshot_id": part[1], "source_queue_id": part[0]})


def _known_md5(store: DeltaStore, batch: str) -> DataFrame:
    newest = F.max_by("content_md5", "snapshot_id").alias("known_md5")
    return store.manifest_before(batch).groupBy("source_queue_id").agg(newest)


def _changed(rows: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """Rows whose content is not that of the row before, or the newest snapshot's for the first one."""
    by = Window.partitionBy("source_queue_id").orderBy(order)
    placed = rows.withColumns({"_place": F.row_number().over(by), "_before": F.lag("content_md5").over(by)})
    before = F.when(F.col("_place") == 1, F.col("known_md5")).otherwise(F.col("_before"))
    joined = join_lookup(placed, known, ["source_queue_id"])
    return joined.filter(~before.eqNullSafe(F.col("content_md5"))).drop("_before", "known_md5")


def landed_versions(documents: DataFrame, store: DeltaStore, batch: str, observed_at: Column) -> DataFrame:
    """(source, path, observed_at, snapshot_id) of the documents to run, in order of their path, which
    holds their time. Content is read once, for its md5, and not again where it has not changed."""
    facts = documents.select(
        "source_queue_id", "path", observed_at.alias("observed_at"),
        F.length("content").cast("bigint").alias("byte_count"), F.md5("content").alias("content_md5"),
    )
    store.write("landed", facts, batch)
    changed = _changed(store.of_run("landed", batch).drop("snapshot_id"), _known_md5(store, batch), "path")
    number = F.format_string("%s-%06d", F.lit(batch), "_place")
    return changed.withColumn("snapshot_id", number).select(*PAIR, "path", "observed_at")


def _records(store: DeltaStore, wanted: DataFrame, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """Stages the records of all versions; gives document rows and record counts, by version."""
    decoded = by_version(store.of_versions("decoded", wanted))
    rows = decoded.filter("row_seq is not null").drop("error")
    ready = dedupe_records(records_from_entries(matrix.keyed_rows(rows, block_rows=None)))
    cut = ready if limits.records is None else limit_records(ready, limits.records)
    # The source is part of a fingerprint, the version is not.
    store.write_versions("staged", with_fingerprints(by_source(cut)))
    current = by_version(store.of_versions("staged", wanted))
    kept = current.groupBy("source_queue_id").agg(F.count("*").alias("kept"))
    found = kept.withColumn("found", F.col("kept"))
    if limits.records is not None:
        all_ = ready.groupBy("source_queue_id").agg(F.count("*").alias("found"))
        found = kept.join(all_, "source_queue_id")
    return decoded.filter("row_seq is null"), found


def _good_versions(store: DeltaStore, facts: DataFrame, batch: str) -> DataFrame:
    """Versions that gave records, numbered; one that repeats the good one before it is none."""
    good = by_source(facts.filter(F.col("error").isNull()))
    changed = _changed(good, _known_md5(store, batch), "snapshot_id").drop("_place")
    order = Window.partitionBy("source_queue_id").orderBy("snapshot_id")
    store.write_versions("versions", changed.withColumn(chains.SEQ, F.row_number().over(order)))
    return store.read("versions").filter(F.col("snapshot_id").startswith(f"{batch}-"))


def _previous(store: DeltaStore, good: DataFrame, batch: str) -> DataFrame:
    """(source, snapshot_id, previous_snapshot_id) of each version."""
    old = store.manifest_before(batch).groupBy("source_queue_id").agg(F.max("snapshot_id").alias("_old"))
    order = Window.partitionBy("source_queue_id").orderBy("snapshot_id")
    before = F.coalesce(F.lag("snapshot_id").over(order), "_old")
    return join_lookup(good.select(*PAIR), old, ["source_queue_id"]).select(*PAIR, before.alias("previous_snapshot_id"))


def _deltas(store: DeltaStore, good: DataFrame, batch: str, limits: Limits) -> DataFrame:
    """All changes of the backlog, by fingerprint first; records only of those that differ."""
    manifest = store.manifest_before(batch)
    zero = good.join(manifest, "source_queue_id", "left_semi").select("source_queue_id").distinct()
    spans = good.select("source_queue_id", chains.SEQ).unionByName(zero.withColumn(chains.SEQ, F.lit(0).cast("bigint")))
    mine = join_lookup(store.read("records"), good.select(*PAIR, chains.SEQ), PAIR, "inner").drop("snapshot_id", "previous_id")
    earlier = store.latest_before(batch, good).withColumn(chains.SEQ, F.lit(0).cast("bigint"))
    rows = mine.unionByName(earlier)
    store.write("steps", chains.steps(rows, spans, baseline=True), batch)
    moved = chains.with_payload(store.of_run("steps", batch).drop("snapshot_id"), rows)
    told = join_lookup(moved, good.select(*PAIR, chains.SEQ, "truncated"), ["source_queue_id", chains.SEQ], "inner")
    # What a version cut by a limit lacks is not known to be removed.
    told = told.filter((F.col("delta_type") != REMOVED) | ~F.col("truncated")).drop("truncated", chains.SEQ)
    first = by_version(told.filter(F.col("delta_type") == BASELINE))
    others = by_version(told.filter(F.col("delta_type") != BASELINE))
    sampled = delta.baseline_top(first, limits.baseline)
    return sampled.unionByName(others.withColumn("delta_rank", F.lit(None).cast("int")))


def ingest_backlog(
    store: DeltaStore, documents: DataFrame, batch: str, observed_at: Column, limits: Limits = Limits()
) -> DataFrame | None:
    """Process documents of any number per source; gives the manifest rows, None without a change.

    Batch ids sort by time, and before the ids of their versions, `batch-000001` and so on."""
    landed = landed_versions(documents, store, batch, observed_at)
    if landed.isEmpty():
        return None
    chosen = documents.join(landed.select("path", "snapshot_id"), "path")
    store.write_versions("decoded", by_source(decode.decoded(by_version(chosen), limits.document_bytes)))

    documents_, found = _records(store, landed, limits)
    times = by_version(landed.select(*PAIR, "observed_at", F.col("observed_at").alias("parsed_at")))
    facts = run.document_facts(documents_, found, times, limits)
    rejects = by_source(run.rejected(facts))
    store.write_versions("rejects", rejects)
    good = _good_versions(store, facts, batch)
    newest = _previous(store, good, batch)
    linked = newest.withColumnRenamed("previous_snapshot_id", "previous_id")
    staged = store.of_versions("staged", good).drop("previous_id")
    store.write_versions("records", join_lookup(staged, linked, PAIR))
    store.write_versions("deltas", by_source(_deltas(store, good, batch, limits)))

    deltas = by_version(store.of_versions("deltas", good))
    current = by_version(store.of_versions("records", good).drop("previous_id"))
    # A version has history if it is not its source's first one.
    newest = by_version(newest.filter("previous_snapshot_id is not null"))
    sources = good.select(*PAIR)
    metadata = by_version(join_lookup(sources, run.catalog_metadata(store), ["source_queue_id"]))
    pending = by_version(join_lookup(sources, run.pending_fingerprints(store), ["source_queue_id"]))
    told = by_version(good.drop(chains.SEQ)).withColumn("parsed_at", F.col("observed_at"))
    output = f"{store.root}/outputs/{batch}"
    evidence = run.evidence_of(told, metadata, pending, output)

    selected = delta.selected(deltas, limits.deltas)
    found_insights = by_source(insights.delta_insights(selected, metadata.drop("catalog_source_url"), evidence))
    named = found_insights.withColumn(
        "queue_id", insights.insight_id(F.col("source_queue_id"), F.col("project_key"))
    )
    store.write_versions("insights", named)
    summary = delta.delta_summary(deltas, current, newest)
    counters = delta.run_counters(summary, selected)
    outputs = by_source(run.output_rows(selected, counters, summary, told, newest))
    write_run_output(outputs.withColumnRenamed("snapshot_id", "current_snapshot_id"), output)
    store.write_versions("manifest", by_source(evidence.join(counters, "source_queue_id")))
    done = store.read("manifest").join(sources, PAIR, "left_semi")
    _store_state(store, done, by_source(run.summary_text(summary)), store.of_versions("rejects", landed), batch)
    return done


def _store_state(store: DeltaStore, done: DataFrame, texts: DataFrame, rejects: DataFrame, batch: str) -> None:
    """State of each source after its last good version, and after a failure later than that."""
    last = F.max("snapshot_id").alias("snapshot_id")
    newest = done.groupBy("source_queue_id").agg(last)
    good = done.join(newest, PAIR, "left_semi")
    words = texts.join(newest, PAIR, "left_semi").drop("snapshot_id")
    latest_bad = rejects.groupBy("source_queue_id").agg(last)
    bad = rejects.join(latest_bad, PAIR, "left_semi")
    state = run.parsed_state(store, good, words, bad.limit(0))
    later = bad.join(newest.withColumnRenamed("snapshot_id", "_good"), "source_queue_id", "left")
    later = later.filter(F.col("_good").isNull() | (F.col("_good") < F.col("snapshot_id"))).drop("_good")
    old = store.latest_rows("state").join(later, "source_queue_id", "left_semi")
    both = state.unionByName(old.join(state, "source_queue_id", "left_anti"), allowMissingColumns=True)
    store.write("state", catalog.upsert_state(both, run.failure_update(later)), f"{batch}-parsed")
