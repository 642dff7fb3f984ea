"""Tables of a delta store: parquet folders partitioned by run.

Every run writes one partition, named by its id, and replaces just that one. A
run that is repeated after a failure therefore gives the same tables, and the
manifest, written last, tells which runs are complete.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidemark import schema
from tidemark.operators.catalog import latest_by_source
from tidemark.operators.joins import join_lookup
from tidemark.sources.snapshots import latest_records, latest_versions

SCHEMAS = {
    "records": schema.SNAPSHOT,
    "manifest": schema.MANIFEST,
    "deltas": schema.DELTA,
    "insights": schema.INSIGHT,
    "catalog": schema.CATALOG,
    "state": schema.STATE,
    "decoded": schema.DECODED,
    "rejects": schema.REJECT,
    "steps": schema.STEP,
    "landed": schema.LANDED,
    "versions": schema.VERSION,
    "staged": schema.SNAPSHOT,
    "changes": schema.CHANGE,
    "silent": schema.SILENT,
    "texts": schema.TEXT,
    "extractions": schema.EXTRACTION,
    "attempts": schema.ATTEMPT,
    "dead_letters": schema.ATTEMPT,
    "leads": schema.LEAD,
    "lead_rejects": schema.LEAD,
}


def _as_stored(table: str, rows: DataFrame) -> DataFrame:
    """The columns of a stored table, null where the rows have none."""
    return rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in StructType.fromDDL(SCHEMAS[table])
        ]
    )


class MissingSnapshot(RuntimeError):
    """The manifest names records that are not there."""


class DeltaStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def read(self, table: str) -> DataFrame:
        reader = self.spark.read.schema(SCHEMAS[table])
        try:
            return reader.parquet(f"{self.root}/{table}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMAS[table])

    def write(self, table: str, rows: DataFrame, run_id: str) -> None:
        """Replace the run's partition of a table, also by nothing.

        The rebalance evens out file sizes by source; a source with very many
        rows is split over several files.
        """
        cast = _as_stored(table, rows).drop("snapshot_id")
        # Written to the partition's own folder: a dynamic overwrite leaves it alone without rows.
        folder = f"{self.root}/{table}/snapshot_id={quote(run_id, safe='')}"
        by = [F.col(c) for c in ("source_queue_id",) if c in cast.columns]
        cast.hint("rebalance", *by).write.mode("overwrite").parquet(folder)

    def write_versions(self, table: str, rows: DataFrame) -> None:
        """Replace the partitions that the rows name in snapshot_id, in one job for all of them."""
        by = [F.col(c) for c in ("snapshot_id", "source_queue_id") if c in rows.columns]
        (
            _as_stored(table, rows)
            .hint("rebalance", *by)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("snapshot_id")
            .parquet(f"{self.root}/{table}")
        )

    def of_versions(self, table: str, versions: DataFrame) -> DataFrame:
        """Rows of the (source, snapshot_id) pairs that are named."""
        return join_lookup(self.read(table), versions, ["source_queue_id", "snapshot_id"], "left_semi")

    def of_run(self, table: str, run_id: str) -> DataFrame:
        return self.read(table).filter(F.col("snapshot_id") == run_id)

    def manifest_before(self, run_id: str) -> DataFrame:
        """Complete snapshots older than a run; ids sort by time."""
        return self.read("manifest").filter(F.col("snapshot_id") < run_id)

    def latest_before(self, run_id: str, sources: DataFrame | None = None) -> DataFrame:
        """Records of each source's newest snapshot older than a run, or of some sources only.

        Fails when the manifest promises other records than there are, rather
        than report everything as new or removed.
        """
        manifest = self.manifest_before(run_id)
        if sources is not None:
            manifest = manifest.join(sources.select("source_queue_id").distinct(), "source_queue_id", "left_semi")
        newest = latest_versions(manifest)
        records = latest_records(self.read("records"), manifest)
        promised = manifest.join(newest, ["source_queue_id", "snapshot_id"]).select(
            "source_queue_id", "record_count"
        )
        found = records.groupBy("source_queue_id").agg(F.count("*").alias("found"))
        wrong = promised.join(found, "source_queue_id", "left").filter(
            F.coalesce("found", F.lit(0)) != F.col("record_count")
        )
        first = wrong.head()
        if first is not None:
            raise MissingSnapshot(
                f"{first['source_queue_id']}: {first['record_count']} records in the manifest, "
                f"{first['found'] or 0} found"
            )
        return records.drop("snapshot_id", "previous_id")

    def latest_rows(self, table: str) -> DataFrame:
        """Newest row of each source in a table kept by source (catalog, state)."""
        return latest_by_source(self.read(table), "snapshot_id").drop("snapshot_id")

    def insights(self) -> DataFrame:
        """Insights of all runs, one row for each (source, project, observed_at)."""
        from tidemark.sinks.merged import MergedInsights

        return MergedInsights(self).read()
