"""The registered queries: name -> function of (spark, sf_dir) giving a DataFrame.

Arrays and maps are flattened to text so that results compare across engines.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from queries import fixtures as fx
from tidemark.functions import text as t
from tidemark.functions.variants import json_object
from tidemark.operators import catalog as cat
from tidemark.operators import chains, delta, insights as ins, matrix as mx, quality, records as rec, report
from tidemark.operators import report_states as states
from tidemark.operators.lookup import ColumnLookup
from tidemark.operators.ranking import top_per_group
from tidemark.plans import retries, texts
from tidemark.plans.ingest import document_records
from tidemark.plans.run import NO_FORMAT, document_facts, rejected
from tidemark.sources import decode
from tidemark.vocabulary import (
    BASELINE_SAMPLE,
    COUNTY,
    DEVELOPER,
    FUEL,
    MAX_DELTAS_PER_SOURCE,
    MAX_SOURCE_BYTES,
    PROBE_BYTES,
    NODE,
    PROJECT_ID,
    PROJECT_NAME,
    STATE,
    STATUS,
    TRACKED_FIELDS,
    WITHDRAWN_DATE,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def kept(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows that a query reads several times: stored once where the session names a folder that all
    machines share (spark.checkpoint.dir), else worked out again. Rows that are compared and joined by
    `keys` are stored in buckets of these, as many as a shuffle has partitions, and not sent again."""
    spark = rows.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return rows
    name = uuid.uuid4().hex
    path = f"{folder.rstrip('/')}/kept-{name}"
    if keys is None:
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.format("parquet").bucketBy(buckets, *keys).option("path", path).saveAsTable(f"kept_{name}")
    return spark.table(f"kept_{name}")


def joined(column: Column | str, separator: str = ",") -> Column:
    return F.array_join(column, separator)


def flat_map(column: str) -> Column:
    """A map as key=value;key=value in key order."""
    pairs = F.transform(
        F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return F.array_join(pairs, ";")


def flat_entries(column: str) -> Column:
    """Entries as header=value;... in their order."""
    return F.array_join(
        F.transform(column, lambda e: F.concat(e["header"], F.lit("="), e["value"])), ";"
    )


RECORD_FIELDS = [
    "source_queue_id",
    "project_key",
    *TRACKED_FIELDS.values(),
    "capacity_source_field",
    "extraction_confidence",
    "review_status",
]


# --- raw rows -------------------------------------------------------------------
@query
def clean_cells(spark, sf):
    rows = fx.raw_rows(spark, sf)
    return rows.select(
        "ord",
        t.clean_cell("Queue Number").alias("queue_number"),
        t.clean_cell("Project Name").alias("project_name"),
        t.clean_cell("POI").alias("poi"),
        t.clean_cell("Date Withdrawn").alias("date_withdrawn"),
        t.clean_cell("NET MW POI").alias("net_mw_poi"),
    )


@query
def header_normalize(spark, sf):
    return fx.raw_rows(spark, sf).select(
        "ord",
        t.normalize_header("Project Name").alias("project_name"),
        t.normalize_header("POI").alias("poi"),
        t.normalize_header("NET MW POI").alias("net_mw_poi"),
    )


@query
def numeric_parse(spark, sf):
    return fx.raw_rows(spark, sf).select(
        "ord",
        t.parse_numeric("NET MW POI").alias("net_mw"),
        t.half_even(t.parse_numeric("NET MW POI")).alias("whole_mw"),
        t.parse_numeric("Project Name").alias("name_number"),
    )


@query
def nullable_strings(spark, sf):
    return fx.raw_rows(spark, sf).select(
        "ord",
        t.nullable("Queue Number").alias("queue_number"),
        t.nullable("NET MW POI").alias("net_mw"),
        t.nullable("Fuel Type").alias("fuel_type"),
        t.nullable("Status").alias("status"),
    )


@query
def status_normalize(spark, sf):
    return fx.raw_rows(spark, sf).select(
        "ord", t.status_word("Status").alias("status"), t.status_word("Status").isNull().alias("bad")
    )


def _looked_up(spark, sf) -> tuple[DataFrame, ColumnLookup]:
    lookup = ColumnLookup(fx.HEADERS)
    return lookup.prepare(fx.raw_rows(spark, sf)), lookup


@query
def status_infer(spark, sf):
    rows, lookup = _looked_up(spark, sf)
    rows = rows.select(
        "ord", lookup.value(STATUS).alias("raw"), lookup.value(WITHDRAWN_DATE).alias("withdrawn")
    )
    raw, withdrawn = F.col("raw"), F.col("withdrawn")
    return rows.select(
        "ord",
        rec.infer_status(raw, withdrawn).alias("status"),
        rec.infer_status(raw, withdrawn, whole_words=True).alias("strict_status"),
    )


@query
def capacity_choice(spark, sf):
    """Three capacity columns with ties, and two that only look like one."""
    key = F.col("ord")
    rows = fx.raw_rows(spark, sf).select(
        "ord",
        "NET MW POI",
        F.when(key % 3 == 0, F.col("NET MW POI"))
        .when(key % 3 == 1, F.concat(F.lit("1,"), fx.text(key % 900 + 100)))
        .alias("Summer Output"),
        F.concat(F.lit("-"), fx.text(key % 7)).alias("Nameplate"),
        F.lit("99999").alias("Storage MWh"),
        F.lit("99999 MW").alias("Updated MW"),
    )
    lookup = ColumnLookup(
        ["NET MW POI", "Summer Output", "Nameplate", "Storage MWh", "Updated MW"]
    )
    chosen = lookup.prepare(rows).select("ord", lookup.capacity().alias("chosen"))
    return chosen.select("ord", "chosen.*")


@query
def alias_resolve(spark, sf):
    rows, lookup = _looked_up(spark, sf)
    fields = {
        "project_id": PROJECT_ID,
        "project_name": PROJECT_NAME,
        "node": NODE,
        "status": STATUS,
        "developer": DEVELOPER,
        "county": COUNTY,
        "state": STATE,
        "fuel": FUEL,
    }
    return rows.select(
        "ord", *[lookup.value(aliases).alias(name) for name, aliases in fields.items()]
    )


@query
def project_keys(spark, sf):
    rows, lookup = _looked_up(spark, sf)
    basis = rec.key_basis(
        lookup.value(PROJECT_ID), lookup.value(PROJECT_NAME), lookup.value(NODE)
    )
    odd = F.when(F.col("ord") % 2 == 0, F.lit("---")).otherwise("unknown")
    keyed = rec.with_project_key(rows.select("ord", basis.alias("basis"), odd.alias("odd")))
    odd_keys = rec.with_project_key(
        keyed.select("ord", "odd", F.col("project_key").alias("usual")), "odd"
    )
    return odd_keys.select(
        "ord", F.col("usual").alias("project_key"), F.col("project_key").alias("odd_key")
    )


@query
def sanitize_keys(spark, sf):
    rows = fx.raw_rows(spark, sf).select(
        "ord",
        F.concat(
            F.lit("-/"), "Project Name", F.lit("%20+"), "POI", F.lit(":%3A%C3%A9%zz 5% "), "County"
        ).alias("raw"),
    )
    return rows.select(
        "ord",
        t.sanitize_key("raw").alias("record_key"),
        t.sanitize_path_part("raw").alias("path_part"),
    )


@query
def source_row_map(spark, sf):
    rows, lookup = _looked_up(spark, sf)
    rows = rows.select("ord", lookup.source_row().alias("source_row"))
    return rows.select("ord", flat_map("source_row").alias("source_row"))


@query
def project_records(spark, sf):
    return fx.raw_records(fx.raw_rows(spark, sf)).select(
        "ord",
        *RECORD_FIELDS,
        joined("review_reasons").alias("review_reasons"),
        flat_map("source_row").alias("source_row"),
    )


@query
def record_score(spark, sf):
    return fx.raw_records(fx.raw_rows(spark, sf)).select(
        "ord", "extraction_confidence", "review_status", joined("review_reasons").alias("reasons")
    )


@query
def completeness(spark, sf):
    return fx.raw_records(fx.raw_rows(spark, sf)).select(
        "ord", rec.completeness().cast("bigint").alias("completeness")
    )


@query
def record_fingerprints(spark, sf):
    return rec.with_fingerprints(fx.raw_records(fx.raw_rows(spark, sf))).select(
        "ord", "record_fingerprint"
    )


@query
def dedupe_records(spark, sf):
    shown = [*RECORD_FIELDS, "ord"]
    return rec.dedupe_records(fx.raw_records(fx.raw_rows(spark, sf)), shown).select(
        *shown, "first_seen"
    )


@query
def record_limit(spark, sf):
    """The record limit at 200 per source, so that it cuts at every scale."""
    ready = rec.dedupe_records(fx.raw_records(fx.raw_rows(spark, sf)), [])
    return rec.limit_records(ready, 200).select("source_queue_id", "project_key", "first_seen")


# --- snapshots ------------------------------------------------------------------
DELTA_FIELDS = [*RECORD_FIELDS, "record_fingerprint"]


def _run(spark, sf, sample: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Current records, all deltas of the run, and the manifest before it. The deltas are not stored."""
    current = kept(fx.current_snapshot(spark, sf))
    manifest = fx.previous_manifest(spark, sf)
    previous = fx.previous_snapshot(spark, sf)
    return current, delta.compare(current, previous, manifest, sample), manifest


#: What cuts and samples of deltas read of them.
RANKED = ["source_queue_id", "project_key", "delta_type", "delta_rank", "capacity_mw", "first_seen"]


@query
def snapshot_diff(spark, sf):
    seen, _ = delta.split_by_history(
        fx.current_snapshot(spark, sf), fx.previous_manifest(spark, sf)
    )
    return delta.diff_snapshots(seen, fx.previous_snapshot(spark, sf)).select(
        "delta_type", joined("changed_fields").alias("changed_fields"), *DELTA_FIELDS
    )


@query
def new_projects(spark, sf):
    seen, _ = delta.split_by_history(
        fx.current_snapshot(spark, sf), fx.previous_manifest(spark, sf)
    )
    return delta.new_projects(seen, fx.previous_snapshot(spark, sf)).select(*DELTA_FIELDS)


@query
def removed_projects(spark, sf):
    return delta.removed_projects(
        fx.current_snapshot(spark, sf, []), fx.previous_snapshot(spark, sf, DELTA_FIELDS)
    ).select(joined("changed_fields").alias("changed_fields"), *DELTA_FIELDS)


@query
def updated_projects(spark, sf):
    return delta.updated_projects(
        fx.current_snapshot(spark, sf), fx.previous_snapshot(spark, sf)
    ).select(joined("changed_fields").alias("changed_fields"), *DELTA_FIELDS)


@query
def changed_fields(spark, sf):
    """How often each tracked field differs."""
    pairs = delta.updated_projects(
        fx.current_snapshot(spark, sf), fx.previous_snapshot(spark, sf)
    )
    return (
        pairs.select("source_queue_id", F.explode("changed_fields").alias("field"))
        .groupBy("source_queue_id", "field")
        .agg(F.count("*").alias("changes"))
    )


@query
def baseline_sources(spark, sf):
    _, first_time = delta.split_by_history(
        fx.current_snapshot(spark, sf), fx.previous_manifest(spark, sf)
    )
    return first_time.select(*DELTA_FIELDS, "first_seen")


@query
def large_cut(spark, sf):
    """The 5 000 dearest lines of each return flag, ranked by ranges: few flags, so each is hot."""
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")]
    lines = fx.table(spark, sf, "lineitem")
    ranked = top_per_group(lines, ["l_returnflag"], order, 5000, "place", measure=-F.col("l_extendedprice"))
    return ranked.select("l_returnflag", "l_orderkey", "l_linenumber", "place")


@query
def baseline_top(spark, sf):
    """All sources taken as first-time, so that every one is ranked."""
    return delta.baseline_top(fx.current_snapshot(spark, sf), BASELINE_SAMPLE).select(
        "source_queue_id",
        "project_key",
        "capacity_mw",
        F.col("delta_rank").cast("bigint").alias("delta_rank"),
    )


@query
def delta_summary(spark, sf):
    current, deltas, manifest = _run(spark, sf)
    return delta.delta_summary(deltas, current, manifest)


@query
def delta_select(spark, sf):
    _, deltas, _ = _run(spark, sf, BASELINE_SAMPLE)
    return delta.selected(kept(deltas.select(*RANKED)), MAX_DELTAS_PER_SOURCE).select(
        "source_queue_id",
        "project_key",
        "delta_type",
        "capacity_mw",
        F.col("delta_rank").cast("bigint").alias("delta_rank"),
    )


@query
def run_counters(spark, sf):
    current, deltas, manifest = _run(spark, sf)
    deltas = kept(deltas.select("source_queue_id", "delta_type", "delta_rank"))
    return delta.run_counters(
        delta.delta_summary(deltas, current, manifest), delta.selected(deltas)
    )


@query
def run_output(spark, sf):
    current, deltas, manifest = _run(spark, sf, BASELINE_SAMPLE)
    deltas = kept(deltas.select(*RANKED))
    chosen = delta.selected(deltas, MAX_DELTAS_PER_SOURCE)
    counters = delta.run_counters(delta.delta_summary(deltas, current, manifest), chosen)
    output = ins.run_output(chosen, counters)
    return output.select(
        "source_queue_id",
        "record_count",
        "delta_count",
        "persisted_count",
        joined(
            F.transform(
                "deltas_sample", lambda d: F.concat(d["delta_type"], F.lit(":"), d["project_key"])
            )
        ).alias("sample"),
    )


@query
def delta_enrich(spark, sf):
    _, deltas, _ = _run(spark, sf)
    enriched = ins.enrich(deltas, fx.source_metadata(spark, sf))
    return enriched.select(
        "source_queue_id",
        "project_key",
        "delta_type",
        "utility_name",
        "market",
        "region",
        "source_kind",
    )


@query
def insight_upsert(spark, sf):
    """Earlier insights of every other current record, then this run's deltas over them."""
    parsed = fx.ntz(fx.AS_OF)
    current, deltas, _ = _run(spark, sf)
    incoming = ins.delta_insights(
        delta.selected(deltas),
        fx.source_metadata(spark, sf),
        fx.run_evidence(spark, sf),
        parsed,
    )
    old = current.filter("ord % 2 = 0").withColumns(
        {"delta_type": F.lit("OLD"), "changed_fields": F.array().cast("array<string>")}
    )
    existing = ins.delta_insights(
        old, fx.source_metadata(spark, sf), fx.run_evidence(spark, sf), fx.ntz(fx.OBSERVED_AT)
    )
    # Only what is shown is carried through the upsert.
    shown = [
        "queue_id",
        "source_queue_id",
        "project_key",
        "observed_at",
        "parsed_at",
        "delta_type",
        "insight_type",
        "model_id",
        "market",
        "utility_name",
        "raw_s3_key",
        "source_url",
        "capacity_mw",
        "status",
        F.col("extraction.status").alias("extracted_status"),
        joined("changed_fields").alias("changed_fields"),
    ]
    return ins.upsert_insights(existing.select(*shown), incoming.select(*shown))


@query
def snapshot_manifest(spark, sf):
    """What a run's manifest says of each source, for sources that were all met before."""
    current = kept(fx.current_snapshot(spark, sf))
    none = delta.compare(current, current, current)
    none = kept(none.select("source_queue_id", "delta_type", "delta_rank"))
    counters = delta.run_counters(delta.delta_summary(none, current, current), none)
    return counters.select("source_queue_id", "record_count", "delta_count", "persisted_count")


@query
def document_rejects(spark, sf):
    """Documents of a run that gave no records, and why: the pages as they are, every third one
    under a wrong name, every fifth of no table format."""
    key = F.col("page_id")
    name = F.when(key % 3 == 0, ".xlsx").when(key % 5 == 0, ".bin").otherwise(".html")
    pages = fx.table(spark, sf, "pages").select(
        fx.text("page_id").alias("source_queue_id"),
        fx.text("page_id").alias("doc_id"),
        F.concat(fx.text("page_id"), name).alias("path"),
        F.lit(None).cast("string").alias("content_type"),
        F.encode("html", "UTF-8").alias("content"),
    )
    documents = decode.decoded(pages).filter("row_seq is null")
    counts = spark.createDataFrame([], "source_queue_id string, found bigint, kept bigint")
    times = pages.select("source_queue_id", fx.ntz(fx.OBSERVED_AT).alias("observed_at"))
    return rejected(document_facts(documents, counts, times)).select(
        "doc_id", "byte_count", "content_md5", "error_type", joined("notes", "; ").alias("notes")
    )


@query
def latest_snapshot(spark, sf):
    from tidemark.sources.snapshots import latest_records

    return latest_records(
        fx.snapshot_history(spark, sf), fx.history_manifest(spark, sf), "snapshot_seq"
    ).select("source_queue_id", "snapshot_seq", "project_key", "capacity_mw", "record_fingerprint")


@query
def snapshot_history_deltas(spark, sf):
    compared = [*TRACKED_FIELDS.values(), "record_fingerprint"]
    return chains.history_deltas(
        fx.snapshot_history(spark, sf, compared), fx.history_manifest(spark, sf)
    ).select(
        "source_queue_id",
        "project_key",
        "snapshot_seq",
        "delta_type",
        joined("changed_fields").alias("changed_fields"),
        "capacity_mw",
        "status",
    )


@query
def diff_by_fingerprint(spark, sf):
    """The diff of stored snapshots: keys and fingerprints first, then the records that differ."""
    current = fx.current_snapshot(spark, sf, DELTA_FIELDS)
    both = chains.as_versions(current, fx.previous_snapshot(spark, sf, DELTA_FIELDS))
    rows = kept(both, delta.KEYS)
    changes = kept(chains.steps(rows, chains.two_versions(fx.previous_manifest(spark, sf))))
    return chains.with_payload(changes, rows).select(
        "delta_type", joined("changed_fields").alias("changed_fields"), *DELTA_FIELDS
    )


@query
def version_steps(spark, sf):
    """Changes of all stored versions by fingerprint alone, baselines too, and who tells of them."""
    rows = fx.snapshot_history(spark, sf, ["record_fingerprint"])
    return chains.steps(rows, fx.history_manifest(spark, sf), baseline=True)


# --- reports --------------------------------------------------------------------
def _signals(spark, sf) -> DataFrame:
    return report.signals(fx.insights(spark, sf))


def _flat_signals(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "review_reasons": joined("review_reasons", "; "),
            "changed_fields": joined("changed_fields", "; "),
        }
    )


@query
def recent_insights(spark, sf):
    recent = report.recent_insights(fx.insights(spark, sf), fx.ntz(fx.AS_OF))
    return report.newest_first(recent.select("queue_id", "observed_at", "delta_type"))


@query
def signals(spark, sf):
    return _flat_signals(_signals(spark, sf))


@query
def prefer_deltas(spark, sf):
    return report.prefer_deltas(_signals(spark, sf)).select("id", "insight_type", "delta_type")


@query
def report_summary(spark, sf):
    return report.report_summary(report.prefer_deltas(_signals(spark, sf)))


@query
def source_health(spark, sf):
    return report.order_health(
        report.source_health(report.prefer_deltas(_signals(spark, sf)))
    )


@query
def summary_of_states(spark, sf):
    """The report's summary from hourly states of all signals."""
    return states.merged_summary(kept(states.signal_states(_signals(spark, sf))))


@query
def health_of_states(spark, sf):
    return states.merged_health(kept(states.signal_states(_signals(spark, sf))))


@query
def recent_summary_of_states(spark, sf):
    """The summary of the last 24 hours and 30 minutes: whole hours from states, the cut hour from
    its signals."""
    signals = kept(_signals(spark, sf))
    since = fx.ntz(fx.AS_OF) - F.expr("interval 1470 minutes")
    return states.merged_summary(states.states_since(kept(states.signal_states(signals)), signals, since))


@query
def attempt_ledger(spark, sf):
    """Entries after a run: customers' documents that failed before (by key, once or twice), some that
    fail now, and every fifth source healed."""
    key = F.col("c_custkey")
    rows = fx.table(spark, sf, "customer").select(
        "c_custkey",
        F.concat(F.lit("src-"), fx.text("c_nationkey")).alias("source_queue_id"),
        F.md5(fx.text("c_custkey").cast("binary")).alias("content_md5"),
        F.concat(F.lit("raw/"), fx.text("c_custkey")).alias("path"),
        F.col("c_nationkey"),
    )
    first = fx.ntz(fx.OBSERVED_AT).cast("timestamp")
    old = rows.filter(key % 3 > 0).select(
        "source_queue_id", "content_md5", "path", (key % 3).cast("bigint").alias("attempts"), F.lit("WAITING").alias("status"),
        F.lit("BadZip").alias("error"), first.alias("first_at"), first.alias("last_at"), first.alias("next_at"),
    )
    failed = rows.filter(key % 4 == 0).withColumn("error", F.lit("NoRecords"))
    healed = rows.filter(F.col("c_nationkey") % 5 == 0)
    now = fx.ntz(fx.AS_OF).cast("timestamp")
    entries = retries.next_entries(old, failed, healed, now)
    return entries.select(
        "source_queue_id", "content_md5", "path", "attempts", "status", "error",
        (F.unix_seconds("next_at") - F.unix_seconds("last_at")).alias("wait_seconds"),
    )


@query
def health_ratio(spark, sf):
    """Of the sources that the report itself shows."""
    return report.health_ratio(report.source_health(report.prefer_deltas(_signals(spark, sf))))


@query
def signal_facets(spark, sf):
    return report.signal_facets(_signals(spark, sf))


@query
def signal_filter(spark, sf):
    return report.filter_signals(
        _signals(spark, sf), market="Market 2", delta_type="UPDATED", min_mw=5, query=" NODE 3 "
    ).select("id", "market", "capacity_mw", "substation_or_node")


@query
def signal_csv(spark, sf):
    return report.signal_csv_rows(report.prefer_deltas(_signals(spark, sf)))


@query
def signal_lines(spark, sf):
    return _signals(spark, sf).select("id", report.signal_line().alias("line"))


@query
def filtered_export(spark, sf):
    chosen = report.filter_signals(_signals(spark, sf), status="Active", min_mw=1)
    return report.csv_line(report.filtered_csv_rows(chosen))


@query
def review_queue(spark, sf):
    return report.review_queue(_signals(spark, sf)).select(
        "id", "source_queue_id", "capacity_mw", joined("review_reasons").alias("reasons")
    )


@query
def report_paths(spark, sf):
    return fx.insights(spark, sf).select(
        "queue_id",
        report.report_path("reports", t.iso_utc("observed_at"), "signals.csv").alias("csv_path"),
        t.iso_utc("observed_at").alias("iso"),
    )


@query
def modeled_value(spark, sf):
    rows = fx.insights(spark, sf)
    days = F.dayofmonth("observed_at")
    value = report.modeled_value(F.col("capacity_mw"), days, F.lit(1000))
    return rows.select("queue_id", F.round(value, 4).alias("modeled_value"))


# --- catalog --------------------------------------------------------------------
@query
def catalog_load(spark, sf):
    """Catalog rows written as CSV lines and as JSON, read back by their parsers."""
    from tidemark.sources.catalog import rows_from_csv_lines, rows_from_json

    source = fx.catalog_rows(spark, sf)
    fields = source.columns
    line = F.to_csv(F.struct(*[F.coalesce(f, F.lit("")).alias(f) for f in fields]))
    document = F.to_json(F.struct(F.array(F.struct(*fields)).alias("queues")))
    from_csv = rows_from_csv_lines(source.select(line.alias("line")), fields)
    from_json = rows_from_json(source.select(document.alias("document")), fields)
    return (
        from_csv.withColumn("origin", F.lit("csv"))
        .unionByName(from_json.withColumn("origin", F.lit("json")))
        .select("origin", *[F.coalesce(t.strip(f), F.lit("")).alias(f) for f in fields])
    )


def _files_folder(spark: SparkSession) -> str:
    """A new folder for files that a query writes and reads; local sessions without a shared one use
    the machine's."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = f"file://{tempfile.gettempdir()}"
    return f"{folder.rstrip('/')}/files-{uuid.uuid4().hex}"


@query
def catalog_files(spark, sf):
    """Catalog rows as CSV files with a header and as JSON documents of up to 1 000 queues each, read
    by the readers of such files, and one row given by hand."""
    from tidemark.sources.catalog import read_catalog_csv, read_catalog_json, with_single

    source, root = fx.catalog_rows(spark, sf), _files_folder(spark)
    source.write.csv(f"{root}/csv", header=True, quote='"', escape='"')
    part = F.floor(F.monotonically_increasing_id() / 1000)
    documents = source.select(part.alias("part"), F.struct(*source.columns).alias("row")).groupBy("part")
    text = F.to_json(F.struct(F.collect_list("row").alias("queues")))
    documents.agg(text.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(f"{root}/json")
    both = (
        read_catalog_csv(spark, f"{root}/csv")
        .withColumn("origin", F.lit("csv"))
        .unionByName(read_catalog_json(spark, f"{root}/json").withColumn("origin", F.lit("json")))
    )
    every = with_single(both, "by-hand", "https://example.com/one.csv", "One Utility")
    named = every.withColumns(
        {
            "origin": F.coalesce("origin", F.lit("given")),
            "queue_id": F.coalesce("queue_id", "QueueID"),
            "url": F.coalesce("url", "SourceURL"),
            "utility": F.coalesce("utility", "UtilityName"),
        }
    )
    return named.select("origin", *[F.coalesce(t.strip(c), F.lit("")).alias(c) for c in source.columns])


@query
def catalog_normalize(spark, sf):
    return cat.normalize_catalog(fx.catalog_rows(spark, sf)).select(
        "source_queue_id", "source_url", "active", flat_map("extra").alias("extra"), "error"
    )


def _catalog(spark, sf) -> DataFrame:
    return cat.accepted(cat.normalize_catalog(fx.catalog_rows(spark, sf)))


@query
def catalog_upsert(spark, sf):
    """Rows of customers with key % 3 = 0 are new; the others existed, key % 3 = 1 unchanged."""
    rows = _catalog(spark, sf).withColumn(
        "n", F.regexp_extract("source_queue_id", r"(\d+)$", 1).cast("bigint")
    )
    existing = rows.filter("n % 3 <> 0").select(
        "source_queue_id",
        F.lit("https://example.com/old").alias("source_url"),
        "active",
        F.create_map(F.lit("Region"), F.lit("East"), F.lit("Market"), F.lit("OLD")).alias("extra"),
        fx.ntz("2024-01-01 00:00:00").alias("created_at"),
        fx.ntz("2024-01-02 00:00:00").alias("updated_at"),
    )
    incoming = rows.filter("n % 3 <> 1").drop("n")
    return cat.upsert_catalog(existing, incoming, fx.ntz(fx.AS_OF)).select(
        "source_queue_id",
        "source_url",
        "active",
        flat_map("extra").alias("extra"),
        "created_at",
        "updated_at",
    )


@query
def active_sources(spark, sf):
    return cat.active_sources(fx.catalog_rows(spark, sf)).select("queue_id", "url", "active")


@query
def queue_metadata(spark, sf):
    return _catalog(spark, sf).select(
        "source_queue_id", cat.queue_metadata("extra").alias("metadata")
    ).select("source_queue_id", flat_map("metadata").alias("metadata"))


@query
def stored_fingerprint(spark, sf):
    return fx.source_state(spark, sf).select(
        "source_queue_id",
        cat.stored_fingerprint(
            "last_remote_fingerprint", "last_hash", "etag", "last_content_md5"
        ).alias("fingerprint"),
    )


@query
def header_fingerprint(spark, sf):
    return fx.landed_manifest(spark, sf).select(
        "source_queue_id", cat.header_fingerprint("headers").alias("fingerprint")
    )


def _changes(spark, sf) -> DataFrame:
    landed = fx.landed_manifest(spark, sf).withColumn(
        "remote_fingerprint", cat.header_fingerprint("headers")
    )
    catalog = cat.normalize_catalog(fx.catalog_rows(spark, sf))
    return cat.detect_changes(catalog, fx.source_state(spark, sf), landed.drop("headers"))


@query
def source_changes(spark, sf):
    return _changes(spark, sf)


@query
def scan_summary(spark, sf):
    return cat.scan_summary(_changes(spark, sf))


@query
def state_upsert(spark, sf):
    now = fx.ntz(fx.AS_OF)
    changes = _changes(spark, sf).filter("source_queue_id IS NOT NULL")
    updates = (
        cat.changed_update(changes, now, now)
        .unionByName(cat.unchanged_update(changes, now), allowMissingColumns=True)
        .unionByName(
            cat.error_update(changes, now, F.lit("request failed"), F.lit("HTTPError")),
            allowMissingColumns=True,
        )
    )
    return cat.upsert_state(fx.source_state(spark, sf), updates).select(
        "source_queue_id",
        "last_remote_fingerprint",
        "last_hash",
        "last_content_md5",
        "parser_status",
        "last_error",
        "last_error_type",
        "last_checked_at",
        "last_changed_at",
    )


@query
def request_headers(spark, sf):
    key = F.col("c_custkey")
    rows = fx.table(spark, sf, "customer").select(
        "c_custkey",
        F.when(key % 5 == 0, "")
        .when(key % 5 == 1, '["a"]')
        .otherwise(
            F.to_json(F.struct(F.col("c_name").alias("Accept"), F.lit("old=1").alias("Cookie")))
        )
        .alias("headers"),
        F.when(key % 3 == 0, F.concat(F.lit("c="), fx.text(key))).alias("cookie"),
    )
    error = cat.request_headers_error("headers")
    return rows.select(
        "c_custkey",
        F.when(error.isNull(), cat.request_headers("headers", "cookie")).alias("merged"),
        error.alias("error"),
    ).select("c_custkey", flat_map("merged").alias("headers"), "error")


@query
def latest_document(spark, sf):
    return cat.latest_document(fx.document_lists(spark, sf)).select(
        "source_queue_id", "doc_id", "publish_date", "source_url", "filename_hint", "error"
    )


@query
def ascii_metadata(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", t.ascii_metadata("text", 512).alias("short"), t.ascii_metadata("source", 64).alias("source")
    )


# --- documents ------------------------------------------------------------------
@query
def document_manifest(spark, sf):
    from tidemark.sources.documents import describe

    pages = fx.table(spark, sf, "pages").select(
        "page_id",
        F.concat(F.lit("raw/"), fx.text("page_id"), F.lit(".html")).alias("path"),
        F.encode("html", "UTF-8").alias("content"),
    )
    return describe(pages, MAX_SOURCE_BYTES).select(
        "page_id", "path", "byte_count", "content_md5", "content_type", "truncated"
    )


@query
def probe_fingerprint(spark, sf):
    """Documents probed at 1 MiB, and at 100 bytes so that the cut shows."""
    documents = fx.table(spark, sf, "documents").select(
        "doc_id", "n_chars", F.encode("text", "UTF-8").alias("content")
    )
    return documents.select(
        "doc_id",
        cat.probe_fingerprint("content").alias("whole"),
        cat.probe_fingerprint("content", probe_bytes=PROBE_BYTES).alias("probe"),
        cat.probe_fingerprint("content", "n_chars", F.lit("bytes 0-99"), 100).alias("short_probe"),
    )


@query
def raw_path(spark, sf):
    pages = fx.table(spark, sf, "pages")
    time = fx.ntz("2026-05-21 09:00:00")
    hint = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("GIS Report "), fx.text("page_id"), F.lit(".xlsx")))
    return pages.select(
        "page_id",
        cat.raw_path(F.concat(F.lit("valley power "), fx.text("page_id")), "url", time, hint).alias("path"),
    )


@query
def content_types(spark, sf):
    key = F.col("page_id")
    return fx.table(spark, sf, "pages").select(
        "page_id",
        t.content_type(
            F.when(key % 4 == 0, " text/html ; charset=utf-8").when(key % 4 == 1, ";x"),
            F.concat(
                F.regexp_extract("url", "^[^?#]*", 0),
                F.when(key % 8 == 2, "/a.csv?x=1").when(key % 8 == 3, "/b.XLSX").otherwise("/c"),
            ),
            F.when(key % 8 == 6, "hint.pdf"),
        ).alias("content_type"),
    )


@query
def format_dispatch(spark, sf):
    key = F.col("o_orderkey")
    endings = F.array(*[F.lit(e) for e in (".xlsx", ".XML", ".htm", ".html", ".csv", ".pdf", "")])
    types = F.array(
        *[
            F.lit(x)
            for x in (
                "text/csv; charset=utf-8",
                "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
                "Application/XHTML+xml",
                "text/xml",
                "",
            )
        ]
    )
    path = F.concat(F.lit("raw/"), fx.text(key), F.get(endings, (key % 7).cast("int")))
    kind = F.get(types, (key % 5).cast("int"))
    return fx.table(spark, sf, "orders").select(
        key.alias("o_orderkey"),
        decode.table_format(path, kind).alias("table_format"),
        decode.text_format(path, kind).alias("text_format"),
    )


@query
def whitespace_lines(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", t.normalize_lines("text").alias("text"))


@query
def decode_text(spark, sf):
    """Documents as UTF-8 with and without mark, and in cp1252 after a quote of its own."""
    key = F.col("doc_id")
    content = (
        F.when(key % 4 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
        .when(key % 4 == 1, F.concat(F.unhex(F.lit("93")), F.encode("text", "ISO-8859-1")))
        .otherwise(F.encode("text", "UTF-8"))
    )
    documents = fx.table(spark, sf, "documents").select("doc_id", content.alias("content"))
    return documents.select("doc_id", t.decode_text("content").alias("text"))


def _pages_as_documents(spark, sf) -> DataFrame:
    return fx.table(spark, sf, "pages").select(
        F.concat(F.lit("site-"), fx.text("page_id")).alias("source_queue_id"),
        fx.text("page_id").alias("doc_id"),
        F.concat(F.lit("raw/"), fx.text("page_id"), F.lit(".html")).alias("path"),
        F.lit("text/html").alias("content_type"),
        F.encode("html", "UTF-8").alias("content"),
    )


@query
def html_visible_text(spark, sf):
    return decode.html_visible_text(_pages_as_documents(spark, sf)).select("doc_id", "text", "error")


def _flat_matrix(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "sheet", "row_number", joined("cells", "|").alias("cells"), "error")


@query
def html_tables(spark, sf):
    return _flat_matrix(decode.html_tables(fx.corpus(spark, sf, ("html",))))


@query
def csv_matrix(spark, sf):
    return _flat_matrix(decode.csv_matrix(fx.corpus(spark, sf, ("csv",))))


@query
def xlsx_matrix(spark, sf):
    return _flat_matrix(decode.xlsx_matrix(fx.corpus(spark, sf, ("xlsx",))))


@query
def xml_records(spark, sf):
    rows = decode.xml_records(fx.corpus(spark, sf, ("xml",)))
    return rows.select(
        "doc_id", "source_location", "source_row_number", flat_entries("entries").alias("entries"), "error"
    )


@query
def xlsx_text(spark, sf):
    return decode.xlsx_text(fx.corpus(spark, sf, ("xlsx",))).select("doc_id", "text", "error")


@query
def pdf_text(spark, sf):
    return decode.pdf_text(fx.corpus(spark, sf, ("pdf",))).select("doc_id", "text", "error")


@query
def document_text(spark, sf):
    documents = fx.spread(kept(fx.corpus(spark, sf, deflate=True)), "doc_id").unionByName(_pages_as_documents(spark, sf))
    return decode.document_text(documents).select(
        "doc_id", "route", "text", joined("notes", "; ").alias("notes"), "error"
    )


@query
def corpus_text(spark, sf):
    """As document_text, with no stream compressed: what stands in deflated bytes is beyond SQL."""
    documents = fx.spread(kept(fx.corpus(spark, sf)), "doc_id").unionByName(_pages_as_documents(spark, sf))
    return decode.document_text(documents).select(
        "doc_id", "route", "text", joined("notes", "; ").alias("notes"), "error"
    )


@query
def text_extractions(spark, sf):
    """The text path over PDFs among documents of five formats, one answer to most of them."""
    documents = fx.spread(kept(fx.corpus(spark, sf, deflate=True)), "doc_id")
    rejects = documents.filter(F.col("path").endswith(".pdf")).select(
        "source_queue_id",
        "doc_id",
        "path",
        fx.ntz(fx.OBSERVED_AT).alias("observed_at"),
        F.md5("content").alias("content_md5"),
        F.octet_length("content").cast("bigint").alias("byte_count"),
        F.array(F.lit(NO_FORMAT)).alias("notes"),
    )
    rejects = kept(rejects)
    key = F.col("response_id")
    document = F.floor(key / fx.ROWS_PER_DOCUMENT).cast("bigint")
    answers = (
        fx.responses(spark, sf)
        .filter(key % fx.ROWS_PER_DOCUMENT == document % fx.ROWS_PER_DOCUMENT)
        .select(F.concat(F.lit("feed-"), fx.text(document)).alias("source_queue_id"), "response")
        .join(rejects.select("source_queue_id", "content_md5"), "source_queue_id")
    )
    return texts.extractions_of(texts.texts_of(documents, rejects), answers).select(
        "source_queue_id",
        "doc_id",
        "interconnection_queue_id",
        "capacity_mw",
        "substation_or_node",
        "status",
        "developer_name",
        "extraction_confidence",
        "review_status",
        joined("review_reasons", "; ").alias("reasons"),
        "error",
        "error_type",
    )


@query
def document_table_records(spark, sf):
    """Documents of four table formats all the way to project records."""
    documents = kept(fx.corpus(spark, sf, ("csv", "html", "xml", "xlsx")))
    rows = document_records(fx.spread(documents, "doc_id"))
    return rows.select(
        *RECORD_FIELDS, "source_location", "source_row_number", "source_header_row_number"
    )


# --- matrices, responses, leads -------------------------------------------------
@query
def header_rows(spark, sf):
    rows = mx.clean_cells(fx.matrix_rows(spark, sf))
    return rows.filter(mx.is_header_row()).select(
        "source_queue_id", "row_seq", joined("cells", "|").alias("cells")
    )


@query
def header_segments(spark, sf):
    rows = mx.fill_down_headers(mx.clean_cells(fx.matrix_rows(spark, sf)))
    return rows.select(
        "source_queue_id",
        "row_seq",
        joined("header", "|").alias("header"),
        "source_header_row_number",
        joined("cells", "|").alias("cells"),
    )


@query
def row_zip(spark, sf):
    return mx.keyed_rows(fx.matrix_rows(spark, sf)).select(
        "source_queue_id", "ord", flat_entries("entries").alias("entries")
    )


@query
def json_objects(spark, sf):
    value = json_object("response")
    return fx.responses(spark, sf).select(
        "response_id",
        value.isNotNull().alias("is_object"),
        F.try_variant_get(value, "$.status", "string").alias("status"),
    )


@query
def extraction_validate(spark, sf):
    return quality.validate_extractions(fx.responses(spark, sf)).select(
        "response_id",
        "interconnection_queue_id",
        "capacity_mw",
        "substation_or_node",
        "status",
        "developer_name",
        "error",
    )


@query
def extraction_score(spark, sf):
    valid = quality.validate_extractions(fx.responses(spark, sf)).filter("error IS NULL")
    return quality.score_extractions(valid).select(
        "response_id",
        "extraction_confidence",
        "review_status",
        joined("review_reasons", "; ").alias("reasons"),
    )


@query
def extraction_insights(spark, sf):
    """Insights of the responses that hold an extraction, with the evidence of their document."""
    valid = quality.validate_extractions(fx.responses(spark, sf)).filter("error IS NULL")
    key = fx.text("response_id")
    evidence = quality.score_extractions(valid).withColumns(
        {
            "source_queue_id": F.concat(F.lit("q-"), key),
            "observed_at": fx.ntz(fx.OBSERVED_AT),
            "source_url": F.concat(F.lit("https://grid.test/"), key),
            "raw_s3_key": F.concat(F.lit("raw/"), key),
        }
    )
    return ins.extraction_insights(evidence, "model-1", fx.ntz(fx.AS_OF)).select(
        "queue_id",
        "observed_at",
        "insight_type",
        "parsed_at",
        "source_url",
        "raw_s3_key",
        "content_md5",
        "model_id",
        "capacity_mw",
        "review_status",
        F.col("extraction.status").alias("status"),
        F.col("extraction.substation_or_node").alias("node"),
    )


@query
def lead_validate(spark, sf):
    return quality.validate_leads(
        fx.lead_bodies(spark, sf), fx.ntz(fx.AS_OF), "web"
    ).select(
        "c_custkey",
        "email",
        "company",
        "role",
        "priority_territories",
        "use_case",
        "status",
        "error",
    )
