"""Incremental ingest: documents that land in a folder become runs.

The file source hands over each landed file once. A batch may hold any number of documents of a
source: they are versions of it, and one job compares each with the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.backlog import ingest_backlog
from tidemark.plans.run import Limits
from tidemark.schema import BINARY_FILE
from tidemark.sinks.store import DeltaStore

SOURCE_IN_PATH = r"/raw/([^/]+)/"


def landed_documents(files: DataFrame) -> DataFrame:
    return files.select(
        F.regexp_extract("path", SOURCE_IN_PATH, 1).alias("source_queue_id"),
        F.col("path").alias("doc_id"),
        "path",
        F.lit(None).cast("string").alias("content_type"),
        "modificationTime",
        "content",
    ).filter(F.col("source_queue_id") != "")


def process_batch(
    store: DeltaStore, files: DataFrame, batch_id: int, limits: Limits = Limits()
) -> None:
    """One micro-batch. Version ids come from the batch, so a replay repeats the same versions."""
    ingest_backlog(store, landed_documents(files), f"{batch_id:012d}", F.col("modificationTime"), limits)


def start(
    spark: SparkSession,
    landing: str,
    store: DeltaStore,
    checkpoint: str,
    limits: Limits = Limits(),
    max_files: int = 10_000,
) -> StreamingQuery:
    """Process everything that has landed since the last start, then stop."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(landing)
    )
    return (
        files.writeStream.foreachBatch(
            lambda batch, batch_id: process_batch(store, batch, batch_id, limits)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
