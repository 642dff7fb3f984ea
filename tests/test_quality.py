"""Extraction and lead checks."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality

GOOD = {
    "interconnection_queue_id": " QW-123 ",
    "capacity_mw": "50.2 MW",
    "substation_or_node": " Oak Creek 230 ",
    "status": "queued",
    "developer_name": "Example Solar LLC",
}


def checked(spark, *responses):
    rows = spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(responses)], "i int, response string")
    return quality.validate_extractions(rows).orderBy("i").collect()


def test_valid_extraction(spark):
    row = checked(spark, GOOD)[0]
    assert row[2:7] == ("QW-123", 50, "Oak Creek 230", "Active", "Example Solar LLC") and row.error is None


def test_capacity_kinds(spark):
    values = [None, 7, 2.5, "1,200 MW", True, "none", [1], {"a": 1}, -3]
    got = checked(spark, *[{**GOOD, "capacity_mw": v} for v in values])
    assert [r.capacity_mw for r in got] == [None, 7, 2, 1200, None, None, None, None, -3]
    assert [r.error is None for r in got] == [True, True, True, True, False, False, False, False, True]


def test_bad_responses(spark):
    missing = {k: v for k, v in GOOD.items() if k not in ("status", "capacity_mw")}
    got = checked(spark, f"Sure: {json.dumps(GOOD)} bye", "[1]", "none", "} {", missing, {**GOOD, "status": 3}, {**GOOD, "status": "odd"}, {**GOOD, "developer_name": "N/A"})
    assert got[0].error is None and got[7].error is None and got[7].developer_name is None
    assert got[1].error == got[2].error == got[3].error == quality.NOT_AN_OBJECT
    assert got[4].error == "Response missing required keys: capacity_mw, status"
    assert got[5].error == got[6].error == quality.BAD_STATUS_VALUE


def test_scores(spark):
    rows = spark.createDataFrame(
        [
            ("q", 5, "n", "Active", "d", []),
            ("q", 5, "n", "Active", None, []),
            (None, None, None, "Active", None, ["text truncated", "load failed"]),
            ("q", 5, "n", "Odd", "d", ["best-effort"]),
        ],
        "interconnection_queue_id string, capacity_mw bigint, substation_or_node string, status string, developer_name string, notes array<string>",
    )
    got = quality.score_extractions(rows).collect()
    assert [r.extraction_confidence for r in got] == [Decimal("1.00"), Decimal("0.92"), Decimal("0.06"), Decimal("0.68")]
    assert [r.review_status for r in got] == ["AUTO_REVIEWED"] + ["NEEDS_REVIEW"] * 3
    assert got[1].review_reasons == ["Missing developer name"]


def test_leads(spark):
    good = {"email": " Buyer@Example.com ", "company": "Example Energy", "role": "R", "territories": "PJM", "use_case": "u" * 3000}
    bodies = [json.dumps(good), json.dumps({**good, "email": "not-an-email"}), json.dumps({**good, "company": " "}), "[]", "{", "", json.dumps({**good, "use_case": None})]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    leads = quality.validate_leads(rows, F.lit("2026-05-21 09:00:00").cast("timestamp"), "web").orderBy("i").collect()
    assert [r.error for r in leads] == [
        None,
        "A valid work email is required",
        "Company is required",
        "Request body must be a JSON object",
        "Request body must be valid JSON",
        "A valid work email is required",
        "Use case is required",
    ]
    assert (leads[0].email, leads[0].status, len(leads[0].use_case)) == ("buyer@example.com", "NEW", 3000)
    assert len(leads[0].lead_id) == 36 and leads[0].lead_id != leads[1].lead_id


@pytest.mark.parametrize(
    "text, wanted",
    [
        ('{"a": 1, "b": null, "a": "x"}', {"a": "x", "b": None}),
        ('So: {"a": 1, "a": {"z": [1, 2]}, "b": 2, "a": 3} done', {"a": 3, "b": 2}),
        ('{"a": 1, "a": 2} and {"b": 3}', None),
        ('{"a": 1, "a": 2}, {"b": 3}', None),
        ('[{"a": 1, "a": 2}]', None),
        ('{"a": 1, "a": }', None),
        ('{"a": {"q": 1, "q": 2}}', None),
        ("{}", {}),
        ("", None),
        (None, None),
    ],
)
def test_the_last_of_a_repeated_key_counts(one, text, wanted):
    from tidemark.functions.variants import json_object

    got = one(F.to_json(json_object("x")), "x string", text)
    assert (None if got is None else json.loads(got)) == wanted
