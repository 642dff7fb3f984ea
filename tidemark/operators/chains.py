"""Version chains: what changes from each version of a source to its next one, for any number of
versions in one job.

Versions of a source are numbered 1, 2, ... (0 for one that was there before). Each project's rows
are put in order of version once, by (source, project), and every row is compared with the row before
it and the one after it:

  - in the source's first version: its baseline, if that is wanted;
  - no row in the version before: new; another fingerprint there: updated;
  - no row in the version after, and there is such a version: removed then.

A version in which a source was not seen at all has no number, so nothing is removed by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.delta import KEYS, changed_fields
from tidemark.operators.joins import join_lookup
from tidemark.vocabulary import BASELINE, NEW, REMOVED, TRACKED_FIELDS, UPDATED

SEQ = "snapshot_seq"
INDEX = [*KEYS, SEQ, "record_fingerprint"]


def _labels(kind: Column, tracked: bool) -> Column:
    none = F.array().cast("array<string>")
    return F.when(kind == UPDATED, changed_fields("_prev", "_cur")).otherwise(none) if tracked else none


def _events(rows: DataFrame, versions: DataFrame, tracked: bool, baseline: bool) -> DataFrame:
    """Rows with `_events`, up to two of (to, kind, labels) each: their own, and their removal."""
    spans = versions.groupBy("source_queue_id").agg(F.min(SEQ).alias("_first"), F.max(SEQ).alias("_last"))
    order = Window.partitionBy(*KEYS).orderBy(SEQ)
    seen = F.struct("record_fingerprint", *(TRACKED_FIELDS.values() if tracked else ()))
    beside = rows.withColumns(
        {
            "_before": F.lag(SEQ).over(order),
            "_after": F.lead(SEQ).over(order),
            "_prev": F.lag(seen).over(order),
            "_cur": seen,
        }
    )
    first = F.lit(BASELINE) if baseline else F.lit(None).cast("string")
    # A version 0 is no news: it is what the chain starts from.
    kind = (
        F.when(F.col(SEQ) == F.col("_first"), F.when(F.col(SEQ) > 0, first))
        .when(~F.col("_before").eqNullSafe(F.col(SEQ) - 1), NEW)
        .when(F.col("_cur.record_fingerprint") != F.col("_prev.record_fingerprint"), UPDATED)
    )
    gone = (F.col(SEQ) < F.col("_last")) & ~F.col("_after").eqNullSafe(F.col(SEQ) + 1)
    own = F.struct(F.col(SEQ).alias("to"), F.col("_kind").alias("kind"), _labels(F.col("_kind"), tracked).alias("labels"))
    removal = F.struct(
        (F.col(SEQ) + 1).alias("to"), F.lit(REMOVED).alias("kind"), F.array(F.lit("Status")).alias("labels")
    )
    return (
        join_lookup(beside, spans, ["source_queue_id"], "inner")
        .withColumn("_kind", kind)
        .withColumn("_events", F.array_compact(F.array(F.when(F.col("_kind").isNotNull(), own), F.when(gone, removal))))
        .filter(F.size("_events") > 0)
        .drop("_before", "_after", "_prev", "_cur", "_first", "_last", "_kind")
    )


def _gone_is_withdrawn(deltas: DataFrame) -> DataFrame:
    gone = F.col("delta_type") == REMOVED
    return deltas.withColumn("status", F.when(gone, F.lit("Withdrawn")).otherwise(F.col("status")))


def history_deltas(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """Deltas between all consecutive snapshots of every source, in one shuffle of the records.

    `records` carries snapshot_seq, numbered 1, 2, ... within each source; `manifest` has one row per
    (source, snapshot_seq). A source's first snapshot gives no deltas here: it is its baseline. For
    records that are stored, `steps` and `with_payload` shuffle only what has changed."""
    fields = [c for c in records.columns if c not in (*KEYS, SEQ)]
    found = _events(records, manifest, tracked=True, baseline=False)
    rows = found.select(*KEYS, *fields, F.inline("_events").alias(SEQ, "delta_type", "changed_fields"))
    return _gone_is_withdrawn(rows).select(*KEYS, SEQ, "delta_type", "changed_fields", *fields)


def steps(index: DataFrame, versions: DataFrame, baseline: bool = False) -> DataFrame:
    """(source, project, snapshot_seq, delta_type, at_seq) of all changes, from keys and fingerprints
    alone; `at_seq` is the version whose row tells about the project."""
    found = _events(index.select(*INDEX), versions, tracked=False, baseline=baseline)
    rows = found.select(*KEYS, F.col(SEQ).alias("at_seq"), F.inline("_events").alias(SEQ, "delta_type", "_labels"))
    return rows.select(*KEYS, SEQ, "delta_type", "at_seq")


def with_payload(changes: DataFrame, records: DataFrame) -> DataFrame:
    """The changes with the fields of their records, changed fields and, for removed ones, status.

    Records meet the changes of their project, so they are sent once, and not at all where Spark
    broadcasts the changes; of a project that has changed, the row before an updated one is the version
    before it. Both should be stored."""
    fields = [c for c in records.columns if c not in (*KEYS, SEQ)]
    marks = changes.groupBy(*KEYS).agg(F.collect_list(F.struct(SEQ, "delta_type", "at_seq")).alias("_marks"))
    met = records.withColumnRenamed(SEQ, "at_seq").join(marks, KEYS)
    needed = F.exists(
        "_marks",
        lambda m: (m["at_seq"] == F.col("at_seq"))
        | ((m["delta_type"] == UPDATED) & (m[SEQ] - 1 == F.col("at_seq"))),
    )
    order = Window.partitionBy(*KEYS).orderBy("at_seq")
    tracked = F.struct(*TRACKED_FIELDS.values())
    told = met.filter(needed).withColumns({"_prev": F.lag(tracked).over(order), "_cur": tracked})
    told = told.withColumn(
        "_mark", F.explode(F.filter("_marks", lambda m: m["at_seq"] == F.col("at_seq")))
    ).withColumns({SEQ: F.col("_mark")[SEQ], "delta_type": F.col("_mark.delta_type")})
    kind = F.col("delta_type")
    labels = (
        F.when(kind == REMOVED, F.array(F.lit("Status")))
        .when(kind == UPDATED, changed_fields("_prev", "_cur"))
        .otherwise(F.array().cast("array<string>"))
    )
    rows = told.withColumn("changed_fields", labels)
    return _gone_is_withdrawn(rows).select(*KEYS, SEQ, kind, "changed_fields", *fields)


def as_versions(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Two snapshots as versions 1 and 0, to be compared as a chain of two."""
    fields = [c for c in current.columns if c in previous.columns]
    number = lambda frame, n: frame.select(*fields, F.lit(n).cast("bigint").alias(SEQ))
    return number(current, 1).unionByName(number(previous, 0))


def two_versions(sources: DataFrame) -> DataFrame:
    """Versions 0 and 1 of each source."""
    return sources.select("source_queue_id").distinct().select(
        "source_queue_id", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")).alias(SEQ)
    )
