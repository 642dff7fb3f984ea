"""New and updated projects as a stream with state by project, and sources that fall silent.

The snapshots of a store are read as a stream of files. State of each (source, project) is what its
newest row said and in which snapshot; a row is compared with it and replaces it. Each row names the
snapshot of its source before its own, so a project that was away in between is new again, and the
rows are those of the snapshot diff: NEW and UPDATED ones. A removal can't be seen from the rows of
one project; the diff of whole snapshots finds it.

A row that is not newer than the state is skipped, so files that a repeated run has written again, and
a restart from the checkpoint, give nothing twice. Batches of the query are stored under their number.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark import schema
from tidemark.operators.delta import KEYS
from tidemark.sinks.store import DeltaStore
from tidemark.vocabulary import NEW, TRACKED_FIELDS, UPDATED

#: transformWithState keeps its state in this one.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_LABELS = list(TRACKED_FIELDS)
_CHANGES = (
    "source_queue_id string, project_key string, version string, delta_type string, "
    "changed_fields array<string>, capacity_mw bigint, status string"
)
_SILENT = "source_queue_id string, last_observed_at timestamp, silent_at timestamp"


class Project(StatefulProcessor):
    """Newest row of one project."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "version string, fingerprint string, fields string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.last.get()
        before = state
        out = []
        for row in pd.concat(list(rows)).sort_values("version").itertuples(index=False):
            if state is not None and row.version <= state[0]:
                continue
            fields = json.loads(row.fields)
            kind, labels = None, []
            if pd.notna(row.previous_id):
                if state is None or state[0] != row.previous_id:
                    kind = NEW
                elif state[1] != row.record_fingerprint:
                    old = json.loads(state[2])
                    kind = UPDATED
                    labels = [x for x, a, b in zip(_LABELS, old, fields, strict=True) if a != b] or ["SourceRow"]
            if kind:
                out.append((*key, row.version, kind, labels, row.capacity_mw, row.status))
            state = (row.version, row.record_fingerprint, row.fields)
        if state is not before:
            self.last.update(state)
        if out:
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in _CHANGES.split(", ")])
            yield frame.astype({"capacity_mw": "Int64"})

    def close(self) -> None:
        pass


class Source(StatefulProcessor):
    """When a source was last observed; its timer goes off if nothing comes for `silence`."""

    def __init__(self, silence: dt.timedelta):
        self.milliseconds = int(silence.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        newest = max(int(part["at"].max()) for part in rows)
        if self.last.exists():
            old = self.last.get()[0]
            if old >= newest:
                return
            self.handle.deleteTimer(old + self.milliseconds)
        self.last.update((newest,))
        self.handle.registerTimer(newest + self.milliseconds)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = self.last.get()[0]
        times = [pd.Timestamp(x, unit="ms") for x in (at, at + self.milliseconds)]
        yield pd.DataFrame([(*key, *times)], columns=[c.split()[0] for c in _SILENT.split(", ")])

    def close(self) -> None:
        pass


def _table_stream(store: DeltaStore, table: str, ddl: str, max_files: int) -> DataFrame:
    return (
        store.spark.readStream.schema(ddl)
        .option("maxFilesPerTrigger", max_files)
        .option("ignoreMissingFiles", "true")
        .parquet(f"{store.root}/{table}")
    )


def project_changes(records: DataFrame) -> DataFrame:
    """NEW and UPDATED rows of a stream of snapshot rows."""
    fields = F.to_json(F.array(*[F.col(c).cast("string") for c in TRACKED_FIELDS.values()]))
    narrow = records.select(
        *KEYS, F.col("snapshot_id").alias("version"), "previous_id", "record_fingerprint",
        fields.alias("fields"), "capacity_mw", "status",
    )
    return narrow.groupBy(*KEYS).transformWithStateInPandas(Project(), _CHANGES, "Append", "None")


def silent_sources(manifest: DataFrame, silence: dt.timedelta, late: str = "0 seconds") -> DataFrame:
    """Sources whose next snapshot has not come within `silence` of the last one, by event time."""
    seen = manifest.select("source_queue_id", "observed_at", F.unix_millis("observed_at").alias("at"))
    seen = seen.withWatermark("observed_at", late)
    return seen.groupBy("source_queue_id").transformWithStateInPandas(Source(silence), _SILENT, "Append", "EventTime")


def _start(rows: DataFrame, store: DeltaStore, table: str, checkpoint: str) -> StreamingQuery:
    """Each batch replaces its own partition, so one that is repeated is there once."""
    return (
        rows.writeStream.foreachBatch(lambda batch, number: store.write(table, batch, f"{number:012d}"))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _with_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def start_changes(store: DeltaStore, checkpoint: str, max_files: int = 10_000) -> StreamingQuery:
    """Changes of all snapshots that were stored since the last start; the `changes` table."""
    _with_state(store.spark)
    rows = _table_stream(store, "records", schema.SNAPSHOT, max_files)
    return _start(project_changes(rows), store, "changes", checkpoint)


def start_silence(
    store: DeltaStore, checkpoint: str, silence: dt.timedelta, max_files: int = 10_000
) -> StreamingQuery:
    """Sources that have fallen silent since the last start; the `silent` table."""
    _with_state(store.spark)
    rows = _table_stream(store, "manifest", schema.MANIFEST, max_files)
    return _start(silent_sources(rows, silence), store, "silent", checkpoint)
