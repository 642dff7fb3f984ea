"""The text path of a run, from rejected documents to insights, outputs and states."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_pipeline import DOCUMENTS, HEADER, at
from tidemark.plans import retries, run, texts
from tidemark.plans.reporting import build_report
from tidemark.sinks.store import DeltaStore

ANSWER = "source_queue_id string, content_md5 string, response string"


def answer(**changes):
    fields = {"interconnection_queue_id": "Q-9", "capacity_mw": 12.5, "substation_or_node": "Oak", "status": "queued", "developer_name": "Sun"}
    return json.dumps(fields | changes)


@pytest.fixture(scope="module")
def documents(spark):
    rows = [
        ("good", "g", "s3://bucket/raw/g.csv", None, bytearray((HEADER + "1,P,N,10,Active\n").encode())),
        ("prose", "p", "s3://bucket/raw/p.txt", "text/plain", bytearray(b"Queue Q-9 is open for 12.5 MW at Oak." * 3)),
        ("empty", "e", "raw/e.csv", None, bytearray(HEADER.encode())),
        ("page", "h", "raw/h.html", None, bytearray(b"<p>No table, <b>Q-9</b></p>")),
        ("binary", "b", "raw/b.bin", None, bytearray(bytes(range(256)) * 8)),
        ("broken", "x", "raw/x.xlsx", None, bytearray(b"no workbook")),
        ("waits", "w", "raw/w.txt", "text/plain", bytearray(b"Not answered yet.")),
        ("wrong", "r", "raw/r.txt", "text/plain", bytearray(b"Answered by prose.")),
    ]
    return spark.createDataFrame(rows, DOCUMENTS)


def answers(spark, prepared, replies):
    rows = [(r.source_queue_id, r.content_md5, text) for r in prepared.collect() for text in replies.get(r.source_queue_id, [])]
    return spark.createDataFrame(rows, ANSWER)


def test_text_path(spark, tmp_path, documents):
    store = DeltaStore(spark, str(tmp_path))
    seeds = spark.createDataFrame([("prose", "https://p.com", "PJM")], "QueueID string, SourceURL string, Market string")
    run.seed(store, seeds, "000", at("2026-05-01 00:00:00"))
    landed = spark.createDataFrame([("prose", "etag-1", "m", None)], "source_queue_id string, remote_fingerprint string, content_md5 string, fetch_error string")
    run.scan(store, landed, "000s", at("2026-05-02 00:00:00"))
    run.ingest(store, documents, "001", at("2026-05-21 09:00:00"))
    assert {r.source_queue_id for r in store.of_run("manifest", "001").collect()} == {"good"}

    prepared = texts.prepare_texts(store, documents, "001", max_chars=60)
    found = {r.source_queue_id: r for r in store.of_run("texts", "001").collect()}
    assert set(found) == {"prose", "empty", "page", "binary", "broken", "waits", "wrong"}
    assert found["page"].text == "No table, Q-9" and found["page"].route == "html"
    assert len(found["prose"].text) == 60 and found["prose"].notes[-1] == "Document text truncated from 111 to 60 characters"
    assert found["binary"].error.startswith("Unsupported binary") and found["broken"].error.startswith("BadZipFile")
    assert {r.source_queue_id for r in prepared.collect()} == {"prose", "empty", "page", "waits", "wrong"}
    assert found["broken"].notes[0].startswith("Deterministic project extraction skipped: BadZipFile")

    replies = {"prose": ["Here: " + answer()], "page": [answer(developer_name=None), "A" + answer(status="x")], "wrong": ["I do not know"], "empty": [answer(status="maybe")]}
    given = answers(spark, prepared, replies)
    now = at("2026-05-21 10:00:00")
    for _ in range(2):  # a repeated step gives the same tables
        done = {r.source_queue_id: r for r in texts.take_responses(store, given, "001", "model-1", now).collect()}
        assert set(done) == {"prose", "page", "binary", "broken", "wrong", "empty"}
        assert (done["prose"].capacity_mw, done["prose"].status, done["prose"].error) == (12, "Active", None)
        assert done["prose"].review_status == "NEEDS_REVIEW" and float(done["prose"].extraction_confidence) == 0.88
        assert float(done["page"].extraction_confidence) == 0.92 and done["page"].error is None
        assert done["wrong"].error == "Response did not contain a JSON object" and done["wrong"].review_status is None
        assert (done["broken"].error_type, done["wrong"].error_type) == ("BadZipFile", "ValueError")
        assert done["empty"].error.startswith("status must be one of")

        stored = {r.queue_id: r for r in store.insights().filter("insight_type = 'SOURCE_EXTRACTION'").collect()}
        assert set(stored) == {"prose", "page"}
        one = stored["prose"]
        assert (one.source_url, one.raw_s3_bucket, one.remote_fingerprint, one.model_id) == ("https://p.com", "bucket", "etag-1", "model-1")
        assert one.extraction.status == "Active" and one.output_s3_key.endswith("/outputs/001-text")
        assert store.insights().filter("insight_type = 'PROJECT_DELTA'").count() == 1

        state = {r.source_queue_id: r for r in store.latest_rows("state").collect()}
        assert (state["prose"].parser_status, state["prose"].last_remote_fingerprint, state["prose"].pending_fingerprint) == ("SUCCEEDED", "etag-1", "")
        assert state["prose"].last_review_status == "NEEDS_REVIEW" and state["prose"].last_error == ""
        assert (state["wrong"].parser_status, state["wrong"].last_error_type) == ("FAILED", "ValueError")
        assert state["good"].last_snapshot_id == "001" and state["waits"].parser_status == "FAILED"
        output = spark.read.json(f"{tmp_path}/outputs/001-text").filter("queue_id = 'page'").first()
        assert output.extraction.developer_name is None and output.extraction_notes[-1] == "Extracted visible text from HTML"

    dead = retries.record_attempts(store, "001", now, tries=1)
    assert {r.source_queue_id for r in dead.collect()} == {"binary", "broken", "wrong", "waits", "empty"}
    assert build_report(store.insights(), now).summary.first().total_signals == 1


def test_nothing_rejected_and_no_answers(spark, tmp_path, documents):
    store = DeltaStore(spark, str(tmp_path))
    run.ingest(store, documents.filter("source_queue_id = 'good'"), "001", at("2026-05-21 09:00:00"))
    assert texts.prepare_texts(store, documents, "001").isEmpty()
    assert texts.take_responses(store, spark.createDataFrame([], ANSWER), "001", "m", at("2026-05-21 10:00:00")).isEmpty()
    assert store.latest_rows("state").first().parser_status == "SUCCEEDED"


def test_only_rejected_content_is_decoded(spark, documents):
    """Other documents leave before the decoder."""
    rejects = documents.filter("source_queue_id = 'page'").select(
        "source_queue_id", "doc_id", "path", F.current_timestamp().alias("observed_at"), F.md5("content").alias("content_md5"),
        F.length("content").cast("bigint").alias("byte_count"), F.lit(None).cast("array<string>").alias("notes"),
    )
    rows = texts.texts_of(documents, rejects).collect()
    assert [(r.source_queue_id, r.notes) for r in rows] == [("page", ["Extracted visible text from HTML"])]
