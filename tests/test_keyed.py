"""The keyed stream over a store's snapshots."""

import datetime as dt

from tests.test_pipeline import JUNE, MAY, at, batch
from tidemark.plans import run
from tidemark.sinks.store import DeltaStore
from tidemark.streaming import keyed


def advance(store, tmp_path, max_files=10_000):
    query = keyed.start_changes(store, str(tmp_path / "checkpoint"), max_files)
    query.awaitTermination()
    assert query.exception() is None


def moved(store):
    """NEW and UPDATED rows of the diff, and what the stream has found."""
    diff = store.read("deltas").filter("delta_type in ('NEW', 'UPDATED')")
    shown = ["source_queue_id", "project_key", "delta_type", "changed_fields", "capacity_mw", "status"]
    return (
        sorted((r.snapshot_id, *map(str, (r[c] for c in shown))) for r in diff.collect()),
        sorted((r.version, *map(str, (r[c] for c in shown))) for r in store.read("changes").collect()),
    )


def test_stream_equals_diff(spark, tmp_path):
    store = DeltaStore(spark, str(tmp_path / "store"))
    run.ingest(store, batch(spark, MAY), "001", at("2026-05-21 09:00:00"))
    run.ingest(store, batch(spark, JUNE), "002", at("2026-06-21 09:00:00"))
    advance(store, tmp_path, max_files=1)
    expected, got = moved(store)
    assert got == expected and len(got) == 2
    # Project 3 comes back after a snapshot without it; west is not seen; a new source has no news.
    july = {"east": [*JUNE["east"], (3, 30, "Active")], "south": [(1, 5, "Active")]}
    run.ingest(store, batch(spark, july), "003", at("2026-07-21 09:00:00"))
    august = {"east": [(3, 31, "Withdrawn")], "south": [(1, 5, "Active"), (2, 6, "Active")], "west": [(7, 71, "Active")]}
    run.ingest(store, batch(spark, august), "004", at("2026-08-21 09:00:00"))
    advance(store, tmp_path)
    expected, got = moved(store)
    assert got == expected and len(got) == 6
    # A repeated run writes its files again; a restart finds nothing in them.
    run.ingest(store, batch(spark, august), "004", at("2026-08-21 09:00:00"))
    advance(store, tmp_path)
    advance(store, tmp_path)
    assert moved(store)[1] == got


def test_silent_sources(spark, tmp_path):
    store = DeltaStore(spark, str(tmp_path / "store"))
    one = {"east": [(1, 5, "Active")], "west": [(1, 5, "Active")]}

    def observe():
        query = keyed.start_silence(store, str(tmp_path / "silence"), dt.timedelta(days=20))
        query.awaitTermination()
        assert query.exception() is None
        return sorted((r.source_queue_id, str(r.last_observed_at), str(r.silent_at)) for r in store.read("silent").collect())

    run.ingest(store, batch(spark, one), "001", at("2026-05-01 09:00:00"))
    assert observe() == []
    run.ingest(store, batch(spark, {"east": [(1, 6, "Active")]}), "002", at("2026-05-15 09:00:00"))
    assert observe() == []
    run.ingest(store, batch(spark, {"east": [(1, 7, "Active")]}), "003", at("2026-05-30 09:00:00"))
    assert observe() == [("west", "2026-05-01 09:00:00", "2026-05-21 09:00:00")]
