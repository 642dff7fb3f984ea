"""What several operators share: the shared folder, cutting lineage, and lists as Arrow columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the text contracts, in Java and SQL syntax.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local session without one uses a folder of its own,
    named after the application; a cluster without one is an error, since a machine's own disk is
    not shared."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = f"file://{tempfile.gettempdir()}/tidemark-{context.applicationId}"
    return folder.rstrip("/")


def written(frame: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read back: lineage ends here,
    lost executors lose nothing, and Spark knows the size when it plans joins."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """Rows dealt out evenly; Spark chooses the number of partitions by their size."""
    return frame.hint("rebalance")


def joined(kinds_and_spans: list[tuple[int, int, str, int]]) -> str:
    """Spans (start, rank of kind, kind, end) as kind:start:end, by start, then kind."""
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(kinds_and_spans))


def crc_bucket(column: str) -> F.Column:
    """crc32 of a value as text; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


#: Rows that a worker takes from a batch at a time.
SLICE = 256


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices. Spark's batches hold up to 64 MB of texts; what a worker makes of them
    as Python objects is several times that, and a reused worker keeps much of it."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def batches_of(rows: Iterator[dict], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Rows gathered into Arrow batches of at most `size` rows."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)
