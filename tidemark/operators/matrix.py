"""Row matrices to keyed rows: find headers, assign rows to them, zip the cells.

A matrix has the columns source_queue_id, doc_id, sheet, row_seq (orders the
rows of a sheet, from 0), row_number (as reported) and cells ARRAY<STRING>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.text import as_column, clean_cell, normalize_header
from tidemark.operators.lookup import ENTRY_TYPE, is_capacity_header
from tidemark.vocabulary import NODE, PROJECT_ID, PROJECT_NAME, STATUS

SHEET = ["source_queue_id", "doc_id", "sheet"]
BLOCK_ROWS = 65_536


def clean_cells(matrix: DataFrame) -> DataFrame:
    return matrix.withColumn("cells", F.transform("cells", lambda c: clean_cell(c)))


def is_header_row(cells: Column | str = "cells") -> Column:
    """A header names a project id, and a node, name or status — or a capacity
    among five or more different headers. Cells are clean."""
    names = F.array_distinct(
        F.transform(
            F.filter(as_column(cells), lambda c: c != ""), lambda c: normalize_header(c)
        )
    )
    has_id = F.arrays_overlap(names, F.array(*[F.lit(a) for a in PROJECT_ID]))
    described = F.arrays_overlap(
        names, F.array(*[F.lit(a) for a in (*NODE, *PROJECT_NAME, *STATUS)])
    )
    measured = F.exists(names, is_capacity_header) & (F.size(names) >= 5)
    return has_id & (described | measured)


def fill_down_headers(matrix: DataFrame, block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """Data rows with the header above them in the same sheet.

    Adds `header` (its cells) and `source_header_row_number`; header rows, empty
    rows and rows before the first header are left out. A sheet is cut into
    blocks of row_seq so that a very long one is not filled down by one task:
    the last header of each block is carried over the blocks (one short row per
    block), then rows are filled inside their block. With `block_rows` None each
    sheet is one block: for sheets known to be small, it reads the matrix once. A row that
    has `own_header` keeps it.
    """
    head = F.struct(F.col("row_number").alias("row_number"), F.col("cells").alias("cells"))
    keyed = "own_header" in matrix.columns
    is_header = is_header_row("cells")
    if keyed:
        is_header = is_header & F.col("own_header").isNull()
    header_here = F.when(F.col("is_header"), head)
    block = F.lit(0) if block_rows is None else F.floor(F.col("row_seq") / block_rows)
    marked = matrix.withColumns({"block": block.cast("bigint"), "is_header": is_header})
    within = (
        Window.partitionBy(*SHEET, "block")
        .orderBy("row_seq")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = marked.withColumn("chosen", F.last(header_here, ignorenulls=True).over(within)).filter(
        ~F.col("is_header") & F.exists("cells", lambda c: c != "")
    )
    if block_rows is not None:
        blocks = marked.groupBy(*SHEET, "block").agg(
            F.max_by(header_here, F.when(F.col("is_header"), F.col("row_seq"))).alias("last_header")
        )
        before = (
            Window.partitionBy(*SHEET)
            .orderBy("block")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carried = blocks.select(
            *SHEET, "block", F.last("last_header", ignorenulls=True).over(before).alias("carried")
        )
        rows = rows.join(carried, [*SHEET, "block"]).withColumn(
            "chosen", F.coalesce("chosen", "carried")
        )
    if keyed:
        own = F.struct(
            F.lit(None).cast("bigint").alias("row_number"), F.col("own_header").alias("cells")
        )
        rows = rows.withColumn(
            "chosen", F.when(F.col("own_header").isNotNull(), own).otherwise(F.col("chosen"))
        )
    return rows.filter(F.col("chosen").isNotNull()).select(
        *[c for c in matrix.columns if c != "own_header"],
        F.col("chosen.cells").alias("header"),
        F.col("chosen.row_number").alias("source_header_row_number"),
    )


def zip_rows(rows: DataFrame) -> DataFrame:
    """Adds `entries`: ARRAY<STRUCT<header, value>> of the cells with a header and a value.

    A header met again in the row gets the suffix " 2", " 3", ...; only cells
    with a value count.
    """
    pairs = F.filter(
        F.transform(
            "header",
            lambda h, i: F.struct(
                h.alias("header"), F.coalesce(F.get("cells", i), F.lit("")).alias("value")
            ),
        ),
        lambda e: (e["header"] != "") & (e["value"] != ""),
    ).cast(ENTRY_TYPE)
    paired = rows.withColumn("_pairs", pairs)
    used = F.col("_pairs.header")
    entries = F.when(
        F.size(F.array_distinct(used)) == F.size(used), F.col("_pairs")
    ).otherwise(F.aggregate("_pairs", F.array().cast(ENTRY_TYPE), _append_renamed))
    return paired.withColumn("entries", entries).drop("_pairs")


def _append_renamed(done: Column, entry: Column) -> Column:
    taken = F.transform(done, lambda e: e["header"])
    numbered = F.transform(
        F.sequence(F.lit(2), F.size(done) + 2),
        lambda n: F.concat(entry["header"], F.lit(" "), n.cast("string")),
    )
    free = F.filter(numbered, lambda name: ~F.array_contains(taken, name))
    name = F.when(F.array_contains(taken, entry["header"]), F.get(free, F.lit(0))).otherwise(
        entry["header"]
    )
    return F.concat(
        done, F.array(F.struct(name.alias("header"), entry["value"].alias("value")))
    ).cast(ENTRY_TYPE)


def keyed_rows(matrix: DataFrame, block_rows: int | None = BLOCK_ROWS) -> DataFrame:
    """Matrix to rows ready for `records_from_entries`."""
    filled = fill_down_headers(clean_cells(matrix), block_rows)
    return zip_rows(filled).select(
        "source_queue_id",
        "doc_id",
        "ord",
        F.col("sheet").alias("source_location"),
        F.col("row_number").alias("source_row_number"),
        "source_header_row_number",
        "entries",
    )
