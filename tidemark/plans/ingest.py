"""From documents to project records, for a whole corpus at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import matrix
from tidemark.operators.records import records_from_entries
from tidemark.sources import decode


def keyed_document_rows(documents: DataFrame) -> DataFrame:
    """Keyed rows of all table documents; unreadable documents give none.

    The corpus is read and decoded once. A sheet belongs to one document, which
    one task has decoded whole, so it is filled down in one block.
    """
    rows = decode.table_rows(documents).filter(F.col("error").isNull()).drop("error")
    return matrix.keyed_rows(rows, block_rows=None)


def document_records(documents: DataFrame, whole_words: bool = False) -> DataFrame:
    """Project records of all table documents, before deduplication."""
    return records_from_entries(keyed_document_rows(documents), whole_words)


def extraction_notes(documents: DataFrame) -> DataFrame:
    """What table extraction did with each document: a note, or why it was skipped."""
    kind = decode.table_format("path", "content_type")
    problems = (
        decode.table_rows(documents)
        .filter(F.col("error").isNotNull())
        .select("source_queue_id", "doc_id", "error")
    )
    note = (
        F.when(kind == "xlsx", decode.XLSX_NOTE)
        .when(kind == "xml", decode.XML_NOTE)
        .when(kind == "html", decode.HTML_NOTE)
        .when(kind == "csv", decode.CSV_NOTE)
    )
    skipped = F.concat(F.lit(decode.SKIPPED_NOTE), "error")
    return (
        documents.select("source_queue_id", "doc_id", note.alias("note"))
        .join(problems, ["source_queue_id", "doc_id"], "left")
        .select(
            "source_queue_id",
            "doc_id",
            F.array_compact(F.array(F.coalesce(skipped, "note"))).alias("notes"),
        )
    )
