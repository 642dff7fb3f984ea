"""Retries, dead letters, and insights merged by identity."""

import datetime as dt

from pyspark.sql import functions as F

from tests.test_pipeline import MAY, at, batch
from tidemark.plans import retries, run
from tidemark.sinks.merged import MergedInsights
from tidemark.sinks.store import DeltaStore

REJECTS = "source_queue_id string, path string, content_md5 string, error string"
SOURCES = "source_queue_id string"


def test_three_failures_and_one_healed(spark, tmp_path):
    store = DeltaStore(spark, str(tmp_path))

    def after(run_id, hour, failed, succeeded=()):
        store.write("rejects", spark.createDataFrame([(s, f"raw/{s}", m, "BadZip: x") for s, m in failed], REJECTS), run_id)
        store.write("manifest", spark.createDataFrame([(s,) for s in succeeded], SOURCES), run_id)
        return sorted(r.source_queue_id for r in retries.record_attempts(store, run_id, at(f"2026-05-01 {hour}:00:00")).collect())

    def due(hour):
        return sorted((r.source_queue_id, r.attempts) for r in retries.due_documents(store, at(f"2026-05-01 {hour}:00:00")).collect())

    assert after("001", "01", [("east", "a"), ("west", "b"), ("north", "c")]) == []
    assert due("01") == [] and due("02") == [("east", 1), ("north", 1), ("west", 1)]
    # West heals; north sends other content, which is a new entry.
    assert after("002", "02", [("east", "a"), ("north", "d")], ["west"]) == []
    assert due("03") == [("north", 1), ("north", 1)] and due("04") == [("east", 2), ("north", 1), ("north", 1)]
    assert after("002", "02", [("east", "a"), ("north", "d")], ["west"]) == []  # repeated: the same
    assert due("04") == [("east", 2), ("north", 1), ("north", 1)]
    assert after("003", "04", [("east", "a")], ["north"]) == ["east"]
    assert due("23") == []
    states = {(r.source_queue_id, r.content_md5): (r.status, r.attempts) for r in retries.ledger(store).collect()}
    assert states == {("east", "a"): ("DEAD", 3), ("west", "b"): ("SETTLED", 1), ("north", "c"): ("SETTLED", 1), ("north", "d"): ("SETTLED", 1)}
    dead = store.read("dead_letters").first()
    assert (dead.path, dead.error, dead.first_at) == ("raw/east", "BadZip: x", dt.datetime(2026, 5, 1, 1))
    assert retries.record_attempts(store, "004", at("2026-05-02 00:00:00")).isEmpty()


def row(source, project, when, status):
    return (f"{source}-{project}", source, project, when, when, status)


def rows_of(spark, rows):
    names = "queue_id string, source_queue_id string, project_key string, observed_at string, parsed_at string, status string"
    frame = spark.createDataFrame(rows, names)
    return frame.withColumns({c: F.col(c).cast("timestamp") for c in ("observed_at", "parsed_at")})


def test_insights_are_merged(spark, tmp_path):
    store = DeltaStore(spark, str(tmp_path))
    merged = MergedInsights(store, buckets=8)
    one, two = "2026-05-01 00:00:00", "2026-06-01 00:00:00"

    def shown():
        return sorted((r.source_queue_id, r.project_key, str(r.observed_at)[:7], r.status) for r in merged.read().collect())

    assert shown() == [] and merged.compact("000") == 0
    store.write("insights", rows_of(spark, [row("a", str(i), one, "first") for i in range(30)]), "001")
    store.write("insights", rows_of(spark, [row("a", "1", one, "again"), row("a", "1", two, "later")]), "002")
    expected = [("a", str(i), "2026-05", "again" if i == 1 else "first") for i in range(30)]
    expected = sorted([*expected, ("a", "1", "2026-06", "later")])
    assert shown() == expected
    assert 1 < merged.compact("002z") <= 8 and shown() == expected
    # Only buckets that a later run touches are written again; a repeated run changes nothing.
    store.write("insights", rows_of(spark, [row("a", "7", one, "third")]), "003")
    expected = sorted([x for x in expected if x[1] != "7"] + [("a", "7", "2026-05", "third")])
    assert shown() == expected and merged.compact("003z") == 1 and shown() == expected
    assert merged.compact("003z1") == 0 and shown() == expected
    merged.delete(rows_of(spark, [row("a", "3", one, None)]).select("source_queue_id", "project_key", "observed_at"), "004")
    expected = [x for x in expected if x[1] != "3"]
    assert shown() == expected and merged.compact("004z") == 1 and shown() == expected
    store.write("insights", rows_of(spark, [row("a", "3", one, "back")]), "005")
    assert shown() == sorted([*expected, ("a", "3", "2026-05", "back")])


def test_insight_of_two_runs_is_one_row(spark, tmp_path):
    store = DeltaStore(spark, str(tmp_path))
    run.ingest(store, batch(spark, MAY), "001", at("2026-05-21 09:00:00"))
    changed = {"east": [(1, 11, "Active"), *MAY["east"][1:]]}
    run.ingest(store, batch(spark, changed), "002", at("2026-05-21 09:00:00"))
    assert store.read("insights").count() == 5
    found = {(r.source_queue_id, r.project_key): r.delta_type for r in store.insights().collect()}
    assert found == {("east", "1"): "UPDATED", ("east", "2"): "BASELINE", ("east", "3"): "BASELINE", ("west", "7"): "BASELINE"}
