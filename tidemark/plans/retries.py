"""Second and third tries of documents that failed, then the dead-letter table.

The ledger has one row per (source, content): how often it has been tried, why it failed, and when it
is due again. The distance doubles from try to try; after `TRIES` of them the content is dead and goes
to `dead_letters`. A success of the source settles all its entries. The ledger is kept by run, like
every table of the store, and a repeated run replaces its own version of it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.sinks.store import DeltaStore

#: The first try and two more.
TRIES = 3
DISTANCE = dt.timedelta(hours=1)

WAITING, DEAD, SETTLED = "WAITING", "DEAD", "SETTLED"
_KEYS = ["source_queue_id", "content_md5"]


def ledger(store: DeltaStore, before: str | None = None) -> DataFrame:
    """The newest entry of each (source, content), of runs before one if that is given."""
    rows = store.read("attempts")
    if before is not None:
        rows = rows.filter(F.col("snapshot_id") < before)
    fields = [c for c in rows.columns if c not in _KEYS]
    newest = rows.groupBy(*_KEYS).agg(F.max_by(F.struct(*fields), "snapshot_id").alias("_row"))
    return newest.select(*_KEYS, "_row.*")


def next_entries(
    old: DataFrame, rejects: DataFrame, succeeded: DataFrame, at: Column,
    tries: int = TRIES, distance: dt.timedelta = DISTANCE,
) -> DataFrame:
    """Entries that a run changes: one more try for each rejected content, and settled ones for the
    sources that succeeded. A source's success counts for all that failed before it."""
    failed = rejects.groupBy(*_KEYS).agg(F.max_by(F.struct("path", "error"), "path").alias("_new"))
    open_ = old.filter(F.col("status") == WAITING)
    count = F.coalesce("attempts", F.lit(0)) + 1
    seconds = F.lit(distance.total_seconds()) * F.pow(F.lit(2), count - 1)
    due = at + F.make_dt_interval(secs=seconds)
    more = failed.join(old.drop("path", "error"), _KEYS, "left").select(
        *_KEYS, "_new.path", count.cast("bigint").alias("attempts"),
        F.when(count >= tries, DEAD).otherwise(WAITING).alias("status"), "_new.error",
        F.coalesce("first_at", at).alias("first_at"), at.alias("last_at"),
        F.when(count < tries, due).alias("next_at"),
    )
    settled = (
        open_.join(succeeded.select("source_queue_id").distinct(), "source_queue_id", "left_semi")
        .join(failed, _KEYS, "left_anti")
        .withColumns({"status": F.lit(SETTLED), "last_at": at, "next_at": F.lit(None).cast("timestamp")})
    )
    return more.unionByName(settled.select(*more.columns))


def record_attempts(
    store: DeltaStore, run_id: str, at: Column, tries: int = TRIES, distance: dt.timedelta = DISTANCE
) -> DataFrame:
    """Bring the ledger up to date after a run, and again after its texts were answered; gives what is
    dead now. A reject whose text gave an extraction is a success."""
    answered = store.of_run("extractions", run_id).filter("error is null").select(*_KEYS)
    rejects = store.of_run("rejects", run_id).join(answered, _KEYS, "left_anti")
    succeeded = store.of_run("manifest", run_id).select("source_queue_id").union(answered.select("source_queue_id"))
    entries = next_entries(ledger(store, run_id), rejects, succeeded, at, tries, distance)
    store.write("attempts", entries, run_id)
    dead = store.of_run("attempts", run_id).filter(F.col("status") == DEAD)
    store.write("dead_letters", dead, run_id)
    return store.of_run("dead_letters", run_id)


def due_documents(store: DeltaStore, at: Column) -> DataFrame:
    """(source, path, content_md5) to try again by now; dead and settled ones are not."""
    waiting = (F.col("status") == WAITING) & (F.col("next_at") <= at)
    return ledger(store).filter(waiting).select("source_queue_id", "path", "content_md5", "attempts")
