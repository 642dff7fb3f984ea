"""One ingest run: documents of many sources to snapshot, deltas, insights, manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import catalog, chains, delta, insights, matrix
from tidemark.operators.joins import join_lookup
from tidemark.operators.ranking import first_per_group
from tidemark.operators.records import build_records, limit_records, records_from_entries
from tidemark.sinks.reports import write_run_output
from tidemark.sinks.store import DeltaStore
from tidemark.sources import decode

NO_FORMAT = "No table format for this document"
NO_RECORDS = "No project records found"


@dataclass(frozen=True)
class Limits:
    """No limit unless one is given. A limit that cuts leaves a note and marks the source as
    truncated, and a truncated source reports nothing as removed."""

    records: int | None = None
    deltas: int | None = None
    baseline: int | None = None
    document_bytes: int | None = None


def catalog_metadata(store: DeltaStore) -> DataFrame:
    """Utility, market, region and kind of every source in the catalog."""
    extra = {
        "utility_name": "UtilityName",
        "market": "Market",
        "region": "Region",
        "source_kind": "SourceKind",
    }
    return store.latest_rows("catalog").select(
        "source_queue_id",
        F.col("source_url").alias("catalog_source_url"),
        *[F.try_element_at("extra", F.lit(key)).alias(name) for name, key in extra.items()],
    )


def document_facts(
    documents: DataFrame, counts: DataFrame, observed: DataFrame, limits: Limits = Limits()
) -> DataFrame:
    """One row per document: what became of it.

    `documents` are the document rows of `decode.decoded`, `counts` has found and kept records of
    each source, `observed` the time of each source. `error` says why a document gave no records.
    """
    found, kept = F.coalesce("found", F.lit(0)), F.coalesce("kept", F.lit(0))
    failed = F.col("error").isNotNull()
    why = (
        F.when(failed, F.col("error"))
        .when(F.col("format").isNull(), NO_FORMAT)
        .when(found == 0, NO_RECORDS)
    )
    cut_bytes = (
        F.lit(False) if limits.document_bytes is None else F.col("byte_count") > limits.document_bytes
    )
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    notes = F.array_compact(
        F.array(
            F.when(failed, say(decode.SKIPPED_NOTE, F.col("error"))).otherwise(decode.format_note(F.col("format"))),
            F.when(cut_bytes, say("Document truncated from ", F.col("byte_count").cast("string"), f" to {limits.document_bytes} bytes")),
            F.when(found > kept, say("Project rows truncated from ", found.cast("string"), " to ", kept.cast("string"), " records")),
        )
    )
    return (
        documents.join(counts, "source_queue_id", "left")
        .join(observed, "source_queue_id", "left")
        .select(
            "source_queue_id",
            "doc_id",
            "path",
            "observed_at",
            "content_md5",
            "byte_count",
            "format",
            notes.alias("notes"),
            (cut_bytes | (found > kept)).alias("truncated"),
            F.when(failed, F.substring_index("error", ":", 1))
            .when(why.isNotNull(), "NoRecords")
            .alias("error_type"),
            why.alias("error"),
        )
    )


def rejected(facts: DataFrame) -> DataFrame:
    """Documents that gave no records."""
    return facts.filter(F.col("error").isNotNull())


def ingest(
    store: DeltaStore,
    documents: DataFrame,
    run_id: str,
    observed_at: Column,
    limits: Limits = Limits(),
    parsed_at: Column | None = None,
) -> DataFrame:
    """Process one document per source; gives the run's manifest rows.

    Run ids sort by time. Documents are read and decoded in one pass; every later step works on
    stored tables, so a lost executor never recomputes the decoding, and the manifest is written
    last. Two documents of one source are an error before anything is written. A document that
    cannot be read, or gives no records, goes to the rejects and fails its source; the source
    keeps its snapshot and its fingerprint, so the next scan finds it changed again.
    """
    parsed_at = observed_at if parsed_at is None else parsed_at
    times = documents.select(
        "source_queue_id", observed_at.alias("observed_at"), parsed_at.alias("parsed_at")
    )
    twice = times.groupBy("source_queue_id").count().filter("count > 1").head()
    if twice is not None:
        raise ValueError(f"{twice['count']} documents of {twice['source_queue_id']} in one run")

    store.write("decoded", decode.decoded(documents, limits.document_bytes), run_id)
    decoded = store.of_run("decoded", run_id)
    rows = decoded.filter("row_seq is not null").drop("error", "snapshot_id")
    ready = build_records(records_from_entries(matrix.keyed_rows(rows, block_rows=None)))
    if limits.records is not None:
        # Counted, ranged and cut: read several times, so stored once.
        store.write("staged", ready, run_id)
        ready = store.of_run("staged", run_id).drop("snapshot_id", "previous_id")
    cut = ready if limits.records is None else limit_records(ready, limits.records)
    manifest = store.manifest_before(run_id)
    newest = manifest.groupBy("source_queue_id").agg(F.max("snapshot_id").alias("previous_id"))
    store.write("records", join_lookup(cut, newest, ["source_queue_id"]), run_id)
    current = store.of_run("records", run_id).drop("snapshot_id", "previous_id")
    kept = current.groupBy("source_queue_id").agg(F.count("*").alias("kept"))
    found = kept.withColumn("found", F.col("kept"))
    if limits.records is not None:
        found = kept.join(
            ready.groupBy("source_queue_id").agg(F.count("*").alias("found")), "source_queue_id"
        )
    facts = document_facts(decoded.filter("row_seq is null"), found, times, limits)
    store.write("rejects", rejected(facts), run_id)
    good = facts.filter(F.col("error").isNull()).drop("error", "error_type", "doc_id")

    previous = delta.current_sources(store.latest_before(run_id, good), current)
    # Keys and fingerprints first; whole records only of projects that differ.
    both = chains.as_versions(current, previous)
    known = good.join(manifest.select("source_queue_id"), "source_queue_id", "left_semi")
    store.write("steps", chains.steps(both, chains.two_versions(known)), run_id)
    moved = chains.with_payload(store.of_run("steps", run_id).drop("snapshot_id"), both).drop(chains.SEQ)
    cutting = limits.records is not None or limits.document_bytes is not None
    truncated = good.filter("truncated") if cutting else None
    store.write(
        "deltas", delta.compare(current, previous, manifest, limits.baseline, truncated, moved), run_id
    )
    deltas = store.of_run("deltas", run_id).drop("snapshot_id")

    metadata = catalog_metadata(store)
    evidence = evidence_of(
        good.join(times.select("source_queue_id", "parsed_at"), "source_queue_id"),
        metadata, pending_fingerprints(store), f"{store.root}/outputs/{run_id}",
    )
    chosen = delta.selected(deltas, limits.deltas)
    store.write(
        "insights",
        insights.delta_insights(chosen, metadata.drop("catalog_source_url"), evidence),
        run_id,
    )
    summary = delta.delta_summary(deltas, current, manifest)
    counters = delta.run_counters(summary, chosen)
    before = newest.withColumnRenamed("previous_id", "previous_snapshot_id")
    output = output_rows(chosen, counters, summary, good, before)
    write_run_output(output.withColumn("current_snapshot_id", F.lit(run_id)), f"{store.root}/outputs/{run_id}")
    store.write("manifest", evidence.join(counters, "source_queue_id"), run_id)
    done = store.of_run("manifest", run_id)
    # Sorts after what a scan of the same run has written.
    state = parsed_state(store, done, summary_text(summary), store.of_run("rejects", run_id))
    store.write("state", state, f"{run_id}-parsed")
    return done


def pending_fingerprints(store: DeltaStore) -> DataFrame:
    """The fingerprint that the last scan of each source has met."""
    pending = F.coalesce(F.nullif("pending_fingerprint", F.lit("")), "last_remote_fingerprint")
    return store.latest_rows("state").select("source_queue_id", pending.alias("remote_fingerprint"))


def evidence_of(good: DataFrame, metadata: DataFrame, pending: DataFrame, output: str) -> DataFrame:
    """What is known of the document behind each source of a run."""
    return (
        good.join(metadata.select("source_queue_id", "catalog_source_url"), "source_queue_id", "left")
        .join(pending, "source_queue_id", "left")
        .withColumns(
            {
                "source_url": F.col("catalog_source_url"),
                "raw_s3_bucket": F.nullif(F.regexp_extract("path", "^s3[an]?://([^/]+)/", 1), F.lit("")),
                "raw_s3_key": F.col("path"),
                "output_s3_key": F.lit(output),
            }
        )
    )


def output_rows(
    chosen: DataFrame, counters: DataFrame, summary: DataFrame, good: DataFrame, newest: DataFrame
) -> DataFrame:
    """The run's output of each source. `newest` has its previous_snapshot_id."""
    counts = F.struct(*delta.SUMMARY_COLUMNS)
    return (
        insights.run_output(chosen, counters)
        .join(good.select("source_queue_id", "notes", "truncated"), "source_queue_id", "left")
        .join(summary.select("source_queue_id", counts.alias("delta_summary")), "source_queue_id", "left")
        .join(newest, "source_queue_id", "left")
    )


def summary_text(summary: DataFrame) -> DataFrame:
    counts = F.to_json(F.struct(*delta.SUMMARY_COLUMNS))
    return summary.select("source_queue_id", counts.alias("last_delta_summary"))


def parsed_state(
    store: DeltaStore, done: DataFrame, summaries: DataFrame, rejects: DataFrame
) -> DataFrame:
    """State of the run's sources after parsing: the fingerprint that the scan has met becomes the
    last one only where the parse succeeded."""
    latest = store.latest_rows("state")
    pending = latest.select(
        "source_queue_id", F.nullif("pending_fingerprint", F.lit("")).alias("last_remote_fingerprint")
    )
    updates = (
        done.join(summaries, "source_queue_id", "left")
        .join(pending, "source_queue_id", "left")
        .select(
            "source_queue_id",
            F.lit("SUCCEEDED").alias("parser_status"),
            F.col("observed_at").alias("last_changed_at"),
            F.col("observed_at").alias("last_parsed_at"),
            F.col("content_md5").alias("last_content_md5"),
            F.col("snapshot_id").alias("last_snapshot_id"),
            F.col("record_count").alias("last_record_count"),
            F.col("delta_count").alias("last_delta_count"),
            "last_remote_fingerprint",
            F.lit("").alias("pending_fingerprint"),
            F.col("raw_s3_key").alias("last_raw_key"),
            F.col("format").alias("last_format"),
            F.col("byte_count").alias("last_bytes"),
            "last_delta_summary",
            F.lit("").alias("last_error"),
            F.lit("").alias("last_error_type"),
        )
    )
    updates = updates.unionByName(failure_update(rejects), allowMissingColumns=True)
    old = latest.join(updates.select("source_queue_id"), "source_queue_id", "left_semi")
    return catalog.upsert_state(old, updates)


def failure_update(rejects: DataFrame) -> DataFrame:
    """What a reject sets in the state of its source."""
    return rejects.select(
        "source_queue_id",
        F.lit("FAILED").alias("parser_status"),
        F.col("observed_at").alias("last_parsed_at"),
        F.col("path").alias("last_raw_key"),
        F.col("byte_count").alias("last_bytes"),
        F.col("error").alias("last_error"),
        F.col("error_type").alias("last_error_type"),
    )


def scan(
    store: DeltaStore, landed: DataFrame, run_id: str, checked_at: Column
) -> DataFrame:
    """Compare what a scan met with the stored state; gives the status of each source.

    `landed` has one row per source: remote_fingerprint, content_md5, fetch_error.
    """
    changes = catalog.detect_changes(
        store.latest_rows("catalog"), store.latest_rows("state"), landed
    )
    # What a changed source shows now is stored as pending: only a parse that succeeds settles it.
    changed = catalog.changed_update(changes, checked_at, checked_at)
    updates = (
        changed.withColumnRenamed("last_remote_fingerprint", "pending_fingerprint")
        .unionByName(catalog.unchanged_update(changes, checked_at), allowMissingColumns=True)
        .unionByName(
            catalog.error_update(
                changes, checked_at, F.lit("source could not be read"), F.lit("FetchError")
            ),
            allowMissingColumns=True,
        )
    )
    old = store.latest_rows("state").join(
        updates.select("source_queue_id"), "source_queue_id", "left_semi"
    )
    store.write("state", catalog.upsert_state(old, updates), run_id)
    return changes


def seed(store: DeltaStore, rows: DataFrame, run_id: str, now: Column) -> DataFrame:
    """Add or update catalog rows; gives the rejected ones. Of a source named more than once the
    greatest row counts, by URL, then its other values."""
    normal = catalog.normalize_catalog(rows)
    best = F.struct("source_url", "active", F.to_json(F.sort_array(F.map_entries("extra"))))
    incoming = first_per_group(catalog.accepted(normal), ["source_queue_id"], best)
    merged = catalog.upsert_catalog(store.latest_rows("catalog"), incoming, now)
    store.write("catalog", merged, run_id)
    return catalog.rejected(normal)
