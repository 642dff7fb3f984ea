"""Rows to records: alias rules, capacity, status, keys, dedupe, fingerprints."""

from decimal import Decimal

import pytest

from tidemark.operators import records as rec
from tidemark.plans.ingest import document_records


def from_columns(spark, *rows):
    """Records of dict rows, one column per header."""
    headers = list(dict.fromkeys(h for row in rows for h in row))
    schema = "source_queue_id string, ord bigint, " + ", ".join(f"`{h}` string" for h in headers)
    data = [("src", i, *[row.get(h) for h in headers]) for i, row in enumerate(rows)]
    return rec.records_from_columns(spark.createDataFrame(data, schema), headers)


def from_entries(spark, *rows):
    """Records of dict rows, as run-time headers."""
    data = [
        ("src", i, [(h, " ".join(v.split())) for h, v in row.items() if v and v.strip()])
        for i, row in enumerate(rows)
    ]
    schema = "source_queue_id string, ord bigint, entries array<struct<header:string,value:string>>"
    return rec.records_from_entries(spark.createDataFrame(data, schema))


BOTH = pytest.mark.parametrize("make", [from_columns, from_entries])

QUEUE_ROW = {
    "Queue Number": "2207",
    "Project Name": "Alisa Solar",
    "NET MW POI": "500",
    "POI": "North Gila",
}


@BOTH
def test_plain_row(spark, make):
    row = make(spark, QUEUE_ROW).first()
    assert row.project_key == row.interconnection_queue_id == "2207"
    assert (row.capacity_mw, row.capacity_source_field) == (500, "NET MW POI")
    assert (row.status, row.substation_or_node) == ("Active", "North Gila")
    assert row.extraction_confidence == Decimal("0.99")
    assert row.review_status == "AUTO_REVIEWED"
    assert row.source_row == QUEUE_ROW


@BOTH
def test_dropped_rows(spark, make):
    rows = [
        {"POI": "X", "MW": "5"},  # no project
        {"Queue Number": "Queue Position", "MW": "5"},  # a header again
        {"Queue Number": "1", "MW": "n/a"},  # neither capacity nor node
        {"Queue Number": "2", "MW": "5"},
    ]
    assert [r.project_key for r in make(spark, *rows).collect()] == ["2"]


@BOTH
def test_commercial_name_and_node_fallback(spark, make):
    row = make(
        spark, {"Commercial Name": "Oak", "Name": "Creek Sub", "Project Name": "P", "MW": "7"}
    ).first()
    assert (row.project_name, row.substation_or_node) == ("Oak", "Creek Sub")
    assert row.project_key == "Oak-Creek-Sub"


@BOTH
@pytest.mark.parametrize(
    "cells, expected",
    [
        ({"Summer MW": "10", "Winter MW": "10"}, (10, "Summer MW")),
        ({"Summer MW": "-5", "Winter MW": "0"}, (0, "Winter MW")),
        ({"Summer MW": "-5", "Winter MW": "3.5"}, (4, "Winter MW")),
        ({"Updated MW": "900", "Capacity": "2.5"}, (2, "Capacity")),
        ({"MWh": "900", "Battery duration MW": "3", "Output": "1,200"}, (1200, "Output")),
        ({"MW": "", "M W": "8"}, (8, "M W")),
        ({"MW": "6", "M W": "8"}, (6, "MW")),
    ],
)
def test_capacity(spark, make, cells, expected):
    row = make(spark, {"Queue Number": "1", "POI": "n", **cells}).first()
    assert (row.capacity_mw, row.capacity_source_field) == expected


@BOTH
@pytest.mark.parametrize(
    "cells, expected",
    [
        ({"Status": "Final IA"}, "Withdrawn"),
        ({"Status": "not in service"}, "Completed"),
        ({"Status": "incomplete"}, "Completed"),
        ({"Status": "DONE", "Date Withdrawn": "2024-01-01"}, "Withdrawn"),
        ({"Status": "DONE", "Date Withdrawn": "n/a"}, "Completed"),
        ({"Status": "", "Queue Status": "queued"}, "Active"),
        ({"Study Phase": "Facility"}, "Active"),
    ],
)
def test_status(spark, make, cells, expected):
    assert make(spark, {**QUEUE_ROW, **cells}).first().status == expected


def test_strict_status_words(spark):
    rows = spark.createDataFrame([("s", 1, "1", "n", "Final IA")], "source_queue_id string, ord bigint, `Queue Number` string, POI string, Status string")
    got = rec.records_from_columns(rows, ["Queue Number", "POI", "Status"], whole_words=True)
    assert got.first().status == "Active"


def test_closed_form_scores(spark):
    cases = {
        ("5", "n", "d"): "0.99",
        ("5", "n", ""): "0.99",
        ("5", "", "d"): "0.96",
        ("5", "", ""): "0.92",
        ("", "n", "d"): "0.92",
        ("", "n", ""): "0.88",
    }
    rows = [
        {"Queue Number": str(i), "MW": c, "POI": n, "Customer": d} for i, (c, n, d) in enumerate(cases)
    ]
    got = {r.project_key: str(r.extraction_confidence) for r in from_columns(spark, *rows).collect()}
    assert [got[str(i)] for i in range(len(cases))] == list(cases.values())


def test_unusable_key_is_hashed_and_long_key_ends_in_a_hash(spark):
    rows = [{"Queue Number": "///", "MW": "1"}, {"Queue Number": "q" * 150, "MW": "1"}]
    keys = [r.project_key for r in from_columns(spark, *rows).orderBy("ord").collect()]
    assert keys[0].startswith("project-") and len(keys[0]) == 24
    assert keys[1].startswith("q" * 103 + "-") and len(keys[1]) == 120


def test_dedupe_keeps_most_complete_and_first_place(spark):
    rows = [
        {"Queue Number": "A", "MW": "1"},
        {"Queue Number": "B", "MW": "1", "POI": "first"},
        {"Queue Number": "A", "MW": "2", "POI": "n", "State": "CO"},
        {"Queue Number": "B", "MW": "9", "POI": "second"},
    ]
    got = {r.project_key: r for r in rec.dedupe_records(from_columns(spark, *rows)).collect()}
    assert (got["A"].capacity_mw, got["A"].first_seen, got["A"].ord) == (2, 0, 2)
    assert (got["B"].substation_or_node, got["B"].first_seen) == ("first", 1)


def test_fingerprint_ignores_row_numbers_but_not_cells(spark):
    def mark(row, **kwargs):
        records = from_columns(spark, row)
        return rec.with_fingerprints(records, **kwargs).first().record_fingerprint

    assert mark(QUEUE_ROW) == mark(dict(reversed(QUEUE_ROW.items())))
    assert mark(QUEUE_ROW) != mark({**QUEUE_ROW, "Comment": "x"})
    assert mark(QUEUE_ROW) != mark({**QUEUE_ROW, "NET MW POI": "525"})


def test_source_row_is_whole(spark):
    long = "H" * 85
    row = {"Queue Number": "1", "MW": "5", **{f"c{i}": "v" * 600 for i in range(90)}}
    assert from_columns(spark, row).first().source_row == row
    entries = {"Queue Number": "1", "MW": "5", long + "a": "x", long + "b": "y"}
    for make in (from_columns, from_entries):
        assert make(spark, entries).first().source_row == entries


def test_record_limit_keeps_first_seen(spark):
    rows = [{"Queue Number": f"q{i}", "MW": "1"} for i in range(30)]
    ready = rec.build_records(from_columns(spark, *rows), limit=7)
    assert sorted(r.first_seen for r in ready.collect()) == list(range(7))


def test_csv_document_with_preamble(spark):
    body = (
        "Last Updated On,5/21/2026,\n"
        "Generation Interconnection Number,Nearest Town or County,State,Capacity,Fuel Type\n"
        "GI-TC-2024-31,Elbert County,CO,398,Solar/Storage\n"
    )
    documents = spark.createDataFrame(
        [("spp", "d", "raw/x.csv", None, bytearray(body.encode()))],
        "source_queue_id string, doc_id string, path string, content_type string, content binary",
    )
    row = document_records(documents).first()
    assert (row.interconnection_queue_id, row.capacity_mw) == ("GI-TC-2024-31", 398)
    assert (row.substation_or_node, row.status, row.fuel_type) == ("Elbert County", "Active", "Solar/Storage")
    assert (row.source_row_number, row.source_header_row_number, row.source_location) == (3, 2, "csv")


def test_winners_carry_only_what_is_read(spark):
    """Rows are sorted and sent with all they hold, source rows too unless told otherwise."""
    rows = [{"Queue Number": q, "MW": mw, "POI": "n" * int(mw)} for q, mw in (("A", "1"), ("B", "2"), ("A", "3"))]
    records = from_columns(spark, *rows)
    whole = rec.build_records(records)
    few = rec.build_records(records, columns=["status", "record_fingerprint"])
    assert few.columns == ["source_queue_id", "project_key", "status", "record_fingerprint", "first_seen"]
    assert sorted(few.collect()) == sorted(whole.select(*few.columns).collect())
    assert rec.build_records(records, columns=[]).columns == ["source_queue_id", "project_key", "first_seen"]
    plan = few._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if "partial_max_by" in line]
    assert sorts and not any("source_row" in line or "review_reasons" in line for line in sorts)


def test_a_key_is_known_not_to_be_null(spark):
    """Else joins ask for keys that are not null, which works every key out twice."""
    assert not from_columns(spark, QUEUE_ROW).schema["project_key"].nullable
