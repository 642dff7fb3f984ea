"""Catalog files: CSV with a header, or JSON as a list or an object with `queues`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

_BYTE_ORDER_MARK = chr(0xFEFF)


def read_catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return rows.toDF(*[c.lstrip(_BYTE_ORDER_MARK) for c in rows.columns])


def read_catalog_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.json(path, multiLine=True)
    if "queues" in rows.columns:
        rows = rows.select(F.explode("queues").alias("queue")).select("queue.*")
    return rows


def rows_from_csv_lines(lines: DataFrame, fields: Sequence[str], column: str = "line") -> DataFrame:
    """Catalog rows of CSV lines whose header is known."""
    schema = ", ".join(f"`{f}` string" for f in fields)
    return lines.select(F.from_csv(column, schema).alias("row")).select("row.*")


def rows_from_json(
    documents: DataFrame, fields: Sequence[str], column: str = "document"
) -> DataFrame:
    """Catalog rows of JSON documents: a list, or an object with `queues`."""
    row = "struct<" + ", ".join(f"`{f}`: string" for f in fields) + ">"
    text = F.col(column)
    queues = F.coalesce(
        F.from_json(text, f"queues array<{row}>")["queues"], F.from_json(text, f"array<{row}>")
    )
    return documents.select(F.explode(queues).alias("row")).select("row.*")


def with_single(rows: DataFrame, queue_id: str, source_url: str, utility_name: str = "") -> DataFrame:
    """The catalog rows plus one given by hand."""
    spark = rows.sparkSession
    one = spark.range(1).select(
        F.lit(queue_id).alias("QueueID"),
        F.lit(source_url).alias("SourceURL"),
        F.lit(utility_name or None).cast("string").alias("UtilityName"),
    )
    return rows.unionByName(one, allowMissingColumns=True)
