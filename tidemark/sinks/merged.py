"""A table whose rows replace each other by identity, merged when it is read.

Runs append: each writes its rows, or tombstones (`deleted`), to its own partition of the log. What
counts is the newest row of an identity, by run, then by time of parsing. A compaction writes that
state, by bucket of a hash of the identity, and only for buckets that the log has touched since their
last compaction; a pointer, written last, names the generation of each bucket and up to which run of
the log it holds. Readers take the bases that the pointer names and the log after them, so a
compaction that fails halfway changes nothing, and one that is repeated replaces itself.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from tidemark.operators.insights import newest_insights, with_identity
from tidemark.operators.joins import join_lookup
from tidemark.sinks.store import SCHEMAS, DeltaStore

BUCKETS = 64
_POINTER = "bucket int, generation string, upto string"


def bucket_of(source: Column, project: Column, buckets: int) -> Column:
    """By project too, so that a hot source is spread."""
    return F.pmod(F.xxhash64(source, project), F.lit(buckets)).cast("int")


class MergedInsights:
    """The insights of a store, one row for each identity."""

    def __init__(self, store: DeltaStore, buckets: int = BUCKETS):
        self.store, self.buckets = store, buckets
        self.root = f"{store.root}/insights_base"

    def _stored(self, name: str, ddl: str) -> DataFrame:
        try:
            return self.store.spark.read.schema(ddl).parquet(f"{self.root}/{name}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.store.spark.createDataFrame([], ddl)

    def _pointer(self) -> DataFrame:
        """The newest generation of each bucket."""
        rows = self._stored("pointer", _POINTER)
        return rows.groupBy("bucket").agg(F.max("generation").alias("generation"), F.max("upto").alias("upto"))

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        tagged = with_identity(rows)
        return tagged.withColumn("bucket", bucket_of(F.col("_source"), F.col("_project"), self.buckets))

    def _live(self) -> tuple[DataFrame, DataFrame]:
        """Bases that count, and the log after them, with their buckets."""
        pointer = self._pointer()
        ddl = f"{SCHEMAS['insights']}, generation string, bucket int"
        base = join_lookup(self._stored("rows", ddl), pointer.drop("upto"), ["bucket", "generation"], "left_semi")
        log = join_lookup(self._bucketed(self.store.read("insights")), pointer.drop("generation"), ["bucket"])
        log = log.filter(F.col("upto").isNull() | (F.col("snapshot_id") > F.col("upto"))).drop("upto")
        return self._bucketed(base.drop("bucket", "generation")), log

    def read(self) -> DataFrame:
        """The newest row of each identity that is not deleted."""
        base, log = self._live()
        newest = newest_insights(base.unionByName(log), F.col("snapshot_id"))
        return newest.filter(~F.coalesce("deleted", F.lit(False))).drop("bucket", "deleted")

    def delete(self, keys: DataFrame, run_id: str) -> None:
        """Tombstones for (source_queue_id, project_key, observed_at) identities."""
        self.store.write("insights", keys.withColumn("deleted", F.lit(True)), run_id)

    def compact(self, generation: str) -> int:
        """Merge the log into the buckets it touches; gives their number. Generations sort by time."""
        base, log = self._live()
        log = log.filter(F.col("snapshot_id") < generation)
        touched = log.groupBy("bucket").agg(F.max("snapshot_id").alias("upto"))
        touched.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/touched/generation={generation}")
        touched = self.store.spark.read.schema("bucket int, upto string").parquet(f"{self.root}/touched/generation={generation}")
        count = touched.count()
        if not count:
            return 0
        rows = join_lookup(base.unionByName(log), touched.select("bucket"), ["bucket"], "left_semi")
        # A deleted identity is gone for good once no base holds it.
        newest = newest_insights(rows, F.col("snapshot_id")).filter(~F.coalesce("deleted", F.lit(False)))
        fields = [F.col(f.name) for f in StructType.fromDDL(SCHEMAS["insights"])]
        by_bucket = newest.select(*fields, "bucket").repartition("bucket")
        by_bucket.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/rows/generation={generation}")
        pointer = touched.select("bucket", F.lit(generation).alias("generation"), "upto")
        # Overwriting its own part makes a repeated compaction point to itself; `generation` is a
        # column of the folder name.
        pointer.drop("generation").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/pointer/generation={generation}")
        return count
