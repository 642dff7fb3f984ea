"""Header search, fill-down over blocks, zipping; checked against a plain loop."""

import random

from pyspark.sql import functions as F

from tidemark.operators import matrix as mx

MATRIX = (
    "source_queue_id string, doc_id string, sheet string, row_seq bigint, ord bigint, "
    "row_number bigint, cells array<string>"
)


def frame(spark, rows, sheet="s"):
    data = [("q", "d", sheet, i, i, i + 1, cells) for i, cells in enumerate(rows)]
    return spark.createDataFrame(data, MATRIX)


def test_header_rule(spark):
    rows = [
        ["Queue Pos.", "Status"],
        ["Queue Pos.", "Capacity"],
        ["Queue Pos.", "Capacity", "a", "b", "c"],
        ["Queue Pos.", "Capacity", "a", "b", "b"],
        ["Project Name", "Status"],
        ["Queue Pos.", "Updated date MW", "a", "b", "c"],
    ]
    got = frame(spark, rows).orderBy("row_seq").select(mx.is_header_row()).collect()
    assert [r[0] for r in got] == [True, False, True, False, False, False]


def test_duplicate_headers_count_filled_cells_only(spark):
    header = ["MW", "MW 2", "MW", "", "MW", "Name"]
    rows = [(header, ["1", "2", "3", "x", "4"]), (header, ["", "2", "3", "", "4", "n"])]
    data = spark.createDataFrame(rows, "header array<string>, cells array<string>")
    got = [
        [(e["header"], e["value"]) for e in r.entries]
        for r in mx.zip_rows(data).select("entries").collect()
    ]
    assert got[0] == [("MW", "1"), ("MW 2", "2"), ("MW 3", "3"), ("MW 4", "4")]
    assert got[1] == [("MW 2", "2"), ("MW", "3"), ("MW 3", "4"), ("Name", "n")]


def test_blocks_give_the_same_as_a_loop(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        kind = rng.random()
        if kind < 0.06:
            rows.append(["Queue Pos.", "POI", f"h{i}"])
        elif kind < 0.2:
            rows.append(["", " "])
        else:
            rows.append([f"q{i}", "node", "v"][: rng.randint(1, 3)])
    expected, header = [], None
    for i, cells in enumerate(rows):
        if cells[0] == "Queue Pos.":
            header = (cells, i + 1)
        elif header and any(c.strip() for c in cells):
            expected.append((i, header[0], header[1]))
    for block in (None, 1, 7, 64, 100_000):
        filled = mx.fill_down_headers(mx.clean_cells(frame(spark, rows)), block)
        got = [
            (r.row_seq, r.header, r.source_header_row_number)
            for r in filled.orderBy("row_seq").collect()
        ]
        assert got == expected, block


def test_no_header_gives_no_rows(spark):
    assert mx.keyed_rows(frame(spark, [["a", "b"], ["c", "d"]])).isEmpty()


def test_sheets_are_separate(spark):
    both = frame(spark, [["Queue Pos.", "POI"], ["1", "x"]], "a").union(
        frame(spark, [["2", "y"], ["3", "z"]], "b")
    )
    assert [r.ord for r in mx.keyed_rows(both).select("ord").collect()] == [1]
    assert mx.keyed_rows(both).select(F.element_at("entries", 1)["value"]).first()[0] == "1"
