"""Runs over a store, in batch and as a stream."""

import datetime as dt
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.plans import run
from tidemark.plans.leads import take_leads
from tidemark.plans.reporting import build_report
from tidemark.sinks.store import DeltaStore, MissingSnapshot
from tidemark.sources.documents import describe, read_documents
from tidemark.streaming import landing

HEADER = "Queue Number,Project Name,POI,Capacity (MW),Status\n"
DOCUMENTS = "source_queue_id string, doc_id string, path string, content_type string, content binary"


def csv_body(rows):
    return HEADER + "".join(f"{n},P{n},Node {n},{mw},{status}\n" for n, mw, status in rows)


MAY = {"east": [(1, 10, "Active"), (2, 20, "Active"), (3, 30, "Active")], "west": [(7, 70, "Active")]}
JUNE = {"east": [(1, 10, "Active"), (2, 25, "Active"), (4, 40, "Active")], "west": [(7, 70, "Active")]}


def batch(spark, month):
    rows = [(s, s, f"raw/{s}.csv", None, bytearray(csv_body(r).encode())) for s, r in month.items()]
    return spark.createDataFrame(rows, DOCUMENTS)


def at(text):
    return F.lit(text).cast("timestamp")


def kinds(deltas):
    return sorted((r.source_queue_id, r.project_key, r.delta_type) for r in deltas.collect())


def test_runs(spark, tmp_path):
    store = DeltaStore(spark, str(tmp_path))
    seeds = spark.createDataFrame(
        [("east", "https://e.com/east.csv", "East Utility", "PJM"), ("", "u", None, None)],
        "QueueID string, SourceURL string, UtilityName string, Market string",
    )
    assert run.seed(store, seeds, "000", at("2026-05-01 00:00:00")).count() == 1

    done = run.ingest(store, batch(spark, MAY), "001", at("2026-05-21 09:00:00"))
    assert sorted((r.source_queue_id, r.record_count, r.delta_count, r.persisted_count) for r in done.collect()) == [("east", 3, 3, 3), ("west", 1, 1, 1)]
    assert {k for _, _, k in kinds(store.of_run("deltas", "001"))} == {"BASELINE"}

    run.ingest(store, batch(spark, JUNE), "002", at("2026-06-21 09:00:00"))
    expected = [("east", "2", "UPDATED"), ("east", "3", "REMOVED"), ("east", "4", "NEW")]
    assert kinds(store.of_run("deltas", "002")) == expected
    # A repeated run gives the same tables.
    run.ingest(store, batch(spark, JUNE), "002", at("2026-06-21 09:00:00"))
    assert kinds(store.of_run("deltas", "002")) == expected
    assert store.read("records").count() == 8

    insight = store.of_run("insights", "002").filter("project_key = '3'").first()
    assert (insight.market, insight.utility_name, insight.status) == ("PJM", "East Utility", "Withdrawn")
    assert insight.extraction.status == "Withdrawn" and insight.queue_id == "east-3"
    built = build_report(store.read("insights"), at("2026-06-21 10:00:00"))
    assert built.summary.first().total_signals == 3

    state = {r.source_queue_id: r for r in store.latest_rows("state").collect()}
    assert (state["east"].parser_status, state["east"].last_snapshot_id) == ("SUCCEEDED", "002")
    landed = spark.createDataFrame(
        [("east", None, state["east"].last_content_md5, None)],
        "source_queue_id string, remote_fingerprint string, content_md5 string, fetch_error string",
    )
    status = run.scan(store, landed, "003", at("2026-06-22 09:00:00")).first()
    assert status.scan_status == "unchanged"
    output = spark.read.json(f"{tmp_path}/outputs/002").filter("source_queue_id = 'east'").first()
    assert [d.project_key for d in output.deltas_sample] == ["3", "4", "2"]


def test_empty_document_leaves_its_source_alone(spark, tmp_path):
    store = DeltaStore(spark, str(tmp_path))
    run.ingest(store, batch(spark, MAY), "001", at("2026-05-21 09:00:00"))
    run.ingest(store, batch(spark, {"east": [], "west": JUNE["west"]}), "002", at("2026-06-21 09:00:00"))
    assert kinds(store.of_run("deltas", "002")) == []
    run.ingest(store, batch(spark, JUNE), "003", at("2026-07-21 09:00:00"))
    assert len(kinds(store.of_run("deltas", "003"))) == 3


def test_missing_snapshot_is_an_error(spark, tmp_path):
    store = DeltaStore(spark, str(tmp_path / "store"))
    run.ingest(store, batch(spark, MAY), "001", at("2026-05-21 09:00:00"))
    shutil.move(str(tmp_path / "store" / "records" / "snapshot_id=001"), str(tmp_path / "elsewhere"))
    with pytest.raises(MissingSnapshot):
        store.latest_before("002")


def land(root, source, name, body, when):
    folder = root / "raw" / source
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / name
    path.write_text(body)
    stamp = dt.datetime.fromisoformat(when).timestamp()
    os.utime(path, (stamp, stamp))


def test_stream_equals_batch(spark, tmp_path):
    store = DeltaStore(spark, str(tmp_path / "stream"))

    def advance():
        query = landing.start(spark, str(tmp_path / "landing"), store, str(tmp_path / "checkpoint"))
        query.awaitTermination()

    for source, rows in MAY.items():
        land(tmp_path / "landing", source, "1.csv", csv_body(rows), "2026-05-21T09:00:00")
    advance()
    # Two documents of one source in one batch are two runs; an unchanged one gives nothing.
    land(tmp_path / "landing", "east", "2.csv", csv_body(MAY["east"]), "2026-06-01T09:00:00")
    land(tmp_path / "landing", "east", "3.csv", csv_body(JUNE["east"]), "2026-06-21T09:00:00")
    advance()
    advance()

    whole = DeltaStore(spark, str(tmp_path / "batch"))
    run.ingest(whole, batch(spark, MAY), "001", at("2026-05-21 09:00:00"))
    run.ingest(whole, batch(spark, JUNE), "002", at("2026-06-21 09:00:00"))
    assert kinds(store.read("deltas")) == kinds(whole.read("deltas"))

    files = read_documents(spark, str(tmp_path / "landing"), "*.csv")
    described = describe(files).orderBy("path").collect()
    assert [r.source_queue_id for r in described] == ["east", "east", "east", "west"]
    assert described[0].content_type == "text/csv" and described[0].byte_count == described[0].length


def run_once(spark, tmp_path, month, run_id="001", limits=run.Limits(), store=None):
    store = store or DeltaStore(spark, str(tmp_path))
    run.ingest(store, batch(spark, month), run_id, at("2026-05-21 09:00:00"), limits)
    return store


def test_no_limit_by_default(spark, tmp_path):
    """More projects than any published limit: all of them are stored, compared and reported."""
    many = {"east": [(i, i % 500, "Active") for i in range(1, 900)]}
    store = run_once(spark, tmp_path, many)
    assert store.of_run("insights", "001").count() == 899
    changed = {"east": [(9000, 5, "Active"), *[(i, i % 500 + 1, "Active") for i in range(1, 900)]]}
    run_once(spark, tmp_path, changed, "002", store=store)
    got = {r.delta_type: r["count"] for r in store.of_run("insights", "002").groupBy("delta_type").count().collect()}
    assert got == {"NEW": 1, "UPDATED": 899}
    row = store.of_run("manifest", "002").first()
    assert (row.record_count, row.truncated, row.persisted_count) == (900, False, 900)


@pytest.mark.parametrize("limits", [run.Limits(records=5), run.Limits(document_bytes=700)])
def test_a_cut_source_reports_no_removals(spark, tmp_path, limits):
    some = {"east": [(i, 10, "Active") for i in range(1, 31)]}
    store = run_once(spark, tmp_path, some, limits=limits)
    run_once(spark, tmp_path, {"east": [(90, 10, "Active"), *some["east"]]}, "002", limits, store)
    assert "REMOVED" not in {k for _, _, k in kinds(store.of_run("deltas", "002"))}
    row = store.of_run("manifest", "002").first()
    assert row.truncated and any("truncated from" in note for note in row.notes)


def test_long_values_and_keys_count_whole(spark, tmp_path):
    def month(end, other):
        text = HEADER + f"{'k' * 150}1,P,Node,5,{'Active ' * 100}{end}\n{'k' * 150}2,P,Node,5,Active{other}\n"
        return spark.createDataFrame([("east", "d", "raw/e.csv", None, bytearray(text.encode()))], DOCUMENTS)

    store = DeltaStore(spark, str(tmp_path))
    run.ingest(store, month("a", ""), "001", at("2026-05-21 09:00:00"))
    assert store.of_run("records", "001").count() == 2
    run.ingest(store, month("b", ""), "002", at("2026-05-22 09:00:00"))
    assert [k for _, _, k in kinds(store.of_run("deltas", "002"))] == ["UPDATED"]


def test_two_documents_of_a_source_are_an_error(spark, tmp_path):
    store = DeltaStore(spark, str(tmp_path))
    twice = batch(spark, {"east": MAY["east"]}).union(batch(spark, {"east": JUNE["east"]}))
    with pytest.raises(ValueError, match="2 documents of east"):
        run.ingest(store, twice, "001", at("2026-05-21 09:00:00"))
    assert not list(tmp_path.iterdir())


def test_a_repeated_run_without_rows_clears_its_partition(spark, tmp_path):
    store = run_once(spark, tmp_path, MAY)
    assert store.of_run("records", "001").count() == 4
    run_once(spark, tmp_path, {"east": []}, store=store)
    for table in ("records", "deltas", "insights", "manifest"):
        assert store.of_run(table, "001").count() == 0, table


def test_failures_are_kept_and_fail_their_source(spark, tmp_path):
    store = DeltaStore(spark, str(tmp_path))
    rows = [
        ("good", "g", "s3://bucket/raw/g.csv", None, bytearray(csv_body(MAY["east"]).encode())),
        ("broken", "b", "raw/b.xlsx", None, bytearray(b"not a zip")),
        ("bare", "e", "raw/e.csv", None, bytearray(b"no,header\n")),
        ("binary", "p", "raw/p.bin", None, bytearray(b"\x00\x01")),
    ]
    run.ingest(store, spark.createDataFrame(rows, DOCUMENTS), "001", at("2026-05-21 09:00:00"))
    got = {r.source_queue_id: (r.error_type, r.error) for r in store.read("rejects").collect()}
    assert got["broken"][0] == "BadZipFile"
    assert got["bare"] == ("NoRecords", run.NO_RECORDS) and got["binary"] == ("NoRecords", run.NO_FORMAT)
    state = {r.source_queue_id: r for r in store.latest_rows("state").collect()}
    assert {s: r.parser_status for s, r in state.items()} == {"good": "SUCCEEDED", "broken": "FAILED", "bare": "FAILED", "binary": "FAILED"}
    assert state["broken"].last_error.startswith("BadZipFile") and state["good"].last_bytes > 50
    insight = store.read("insights").first()
    assert (insight.raw_s3_bucket, insight.raw_s3_key) == ("bucket", "s3://bucket/raw/g.csv")
    assert insight.parsed_at == insight.observed_at


def test_fingerprints_settle_after_the_parse(spark, tmp_path):
    store = DeltaStore(spark, str(tmp_path))
    seeds = spark.createDataFrame([("east", "https://e.com/a"), ("east", "https://e.com/b")], "QueueID string, SourceURL string")
    run.seed(store, seeds, "000", at("2026-05-01 00:00:00"))
    assert [r.source_url for r in store.read("catalog").collect()] == ["https://e.com/b"]
    met = spark.createDataFrame(
        [("east", "etag:1", None, None)],
        "source_queue_id string, remote_fingerprint string, content_md5 string, fetch_error string",
    )

    def status(run_id):
        return run.scan(store, met, run_id, at("2026-05-02 00:00:00")).first().scan_status

    assert status("001") == "changed"
    bad = spark.createDataFrame([("east", "d", "raw/e.xlsx", None, bytearray(b"no zip"))], DOCUMENTS)
    run.ingest(store, bad, "001", at("2026-05-02 00:00:00"))
    assert status("002") == "changed"
    run.ingest(store, batch(spark, {"east": MAY["east"]}), "002", at("2026-05-03 00:00:00"))
    insight = store.read("insights").first()
    assert (insight.source_url, insight.catalog_source_url, insight.remote_fingerprint) == ("https://e.com/b", "https://e.com/b", "etag:1")
    assert status("003") == "unchanged"
    assert store.latest_rows("state").first().last_error_type == ""


def test_content_is_decoded_once(spark, tmp_path):
    """Content is looked at by one job; every other step works on stored tables."""
    looks = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def seen(content):
        looks.add(1)
        return content

    documents = batch(spark, MAY).withColumn("content", seen("content"))
    store = DeltaStore(spark, str(tmp_path))
    run.ingest(store, documents, "001", at("2026-05-21 09:00:00"))
    assert looks.value == 2


def test_leads_are_stored_or_rejected(spark, tmp_path):
    store = DeltaStore(spark, str(tmp_path))
    good = {"email": "A@b.example", "company": "c", "role": "r", "territories": "t", "use_case": "u", "name": "n" * 3000}
    bodies = spark.createDataFrame([(json.dumps(good),), ("[1]",), ("{",), ("{}",)], "body string")
    rejects = take_leads(store, bodies, "001", at("2026-05-21 09:00:00"), "web")
    errors = {r.error for r in rejects.collect()}
    assert len(errors) == 3 and "Request body must be valid JSON" in errors
    lead = store.read("leads").first()
    assert (lead.email, len(lead.name), lead.status) == ("a@b.example", 3000, "NEW")
    # The same run again stores the same rows.
    take_leads(store, bodies, "001", at("2026-05-21 09:00:00"), "web")
    assert store.read("leads").count() == 1
