"""Landed documents as a DataFrame: files, sizes, hashes and types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.text import content_type


def read_documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files under raw/<source>/yyyy/MM/dd/, one row each. Ask only for the columns
    you need: `content` is not read unless it is selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(path)
    return files.select(
        F.regexp_extract("path", r"/raw/([^/]+)/", 1).alias("source_queue_id"),
        F.col("path").alias("doc_id"),
        "path",
        F.lit(None).cast("string").alias("content_type"),
        "modificationTime",
        "length",
        "content",
    )


def describe(documents: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Documents with byte count, md5 and type; content past a given `max_bytes` is not taken."""
    whole = F.col("content")
    taken = whole if max_bytes is None else F.substring(whole, 1, max_bytes)
    return documents.withColumns(
        {
            "byte_count": F.octet_length("content").cast("bigint"),
            "content_md5": F.md5("content"),
            "content_type": content_type(
                F.col("content_type") if "content_type" in documents.columns else F.lit(None).cast("string"),
                "path",
                F.lit(None).cast("string"),
            ),
            "truncated": F.lit(False) if max_bytes is None else F.octet_length("content") > max_bytes,
            "content": taken,
        }
    )
