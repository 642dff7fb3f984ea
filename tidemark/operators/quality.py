"""Checks of extracted values and of leads: valid rows, scores, reasons, rejects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import half_even, nullable, parse_numeric, status_word, strip
from tidemark.functions.variants import json_object, member_schema, member_text, schema_kind
from tidemark.operators.once import computed_once
from tidemark.operators.records import SCORE_TYPE
from tidemark.vocabulary import (
    ALLOWED_STATUSES,
    AUTO_REVIEWED,
    BAD_STATUS,
    FALLBACK_TEXT,
    MISSING_CAPACITY,
    MISSING_DEVELOPER,
    MISSING_ID,
    MISSING_NODE,
    NEEDS_REVIEW,
    TRUNCATED_SOURCE,
)

# Keys an extraction must have, in the order they are reported (fixed values).
REQUIRED_KEYS = (
    "capacity_mw",
    "developer_name",
    "interconnection_queue_id",
    "status",
    "substation_or_node",
)
NOT_AN_OBJECT = "Response did not contain a JSON object"
BAD_CAPACITY = "capacity_mw must be an integer or null"
BAD_STATUS_VALUE = "status must be one of Active, Withdrawn, Completed"

EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
# Lead rules in order; the first that fails is the error (fixed values).
LEAD_RULES = (
    ("email", "A valid work email is required"),
    ("company", "Company is required"),
    ("territories", "Priority territories are required"),
    ("use_case", "Use case is required"),
)


def validate_extractions(responses: DataFrame, column: str = "response") -> DataFrame:
    """Five typed fields from response text; `error` tells why a response is not valid.

    The fields are null whenever there is an error.
    """
    value = F.col("_value")
    parsed = computed_once(responses, {"_value": json_object(column)})
    kinds = F.transform(
        F.array(*[member_schema(value, key) for key in REQUIRED_KEYS]), lambda k: schema_kind(k)
    )
    parsed = computed_once(
        parsed,
        {
            "_kinds": kinds,
            **{f"_text_{key}": member_text(value, key) for key in REQUIRED_KEYS},
        },
    )

    def kind(key: str) -> Column:
        return F.get("_kinds", F.lit(REQUIRED_KEYS.index(key)))

    def text(key: str) -> Column:
        raw = F.col(f"_text_{key}")
        # Booleans read as words with a capital letter.
        return nullable(F.when(kind(key) == "boolean", F.initcap(raw)).otherwise(raw))

    number = half_even(parse_numeric("_text_capacity_mw"))
    typed = computed_once(
        parsed,
        {
            "_missing": F.array_join(
                F.array_compact(
                    F.array(*[F.when(kind(k) == "absent", F.lit(k)) for k in REQUIRED_KEYS])
                ),
                ", ",
            ),
            "_capacity": F.when(kind("capacity_mw").isin("integer", "number", "string"), number),
            "_status": F.when(kind("status") == "string", status_word("_text_status")),
            "_id": text("interconnection_queue_id"),
            "_node": text("substation_or_node"),
            "_developer": text("developer_name"),
        },
    )
    checked = typed.withColumn(
        "error",
        F.when(value.isNull(), NOT_AN_OBJECT)
        .when(
            F.col("_missing") != "",
            F.concat(F.lit("Response missing required keys: "), "_missing"),
        )
        .when((kind("capacity_mw") != "null") & F.col("_capacity").isNull(), BAD_CAPACITY)
        .when(F.col("_status").isNull(), BAD_STATUS_VALUE),
    )
    fields = {
        "interconnection_queue_id": "_id",
        "capacity_mw": "_capacity",
        "substation_or_node": "_node",
        "status": "_status",
        "developer_name": "_developer",
    }
    return checked.select(
        *responses.columns,
        *[F.when(F.col("error").isNull(), F.col(c)).alias(name) for name, c in fields.items()],
        "error",
    )


def score_extractions(extractions: DataFrame, notes: str = "notes") -> DataFrame:
    """Confidence, review status and reasons of validated extractions.

    Points are whole hundredths, so the score is exact.
    """
    note_text = F.lower(F.array_join(notes, " "))

    def blank(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) == ""

    # condition, points taken, reason (fixed values)
    deductions = [
        (blank("interconnection_queue_id"), 22, MISSING_ID),
        (blank("capacity_mw"), 22, MISSING_CAPACITY),
        (blank("substation_or_node"), 22, MISSING_NODE),
        (~F.coalesce(F.col("status").isin(*ALLOWED_STATUSES), F.lit(False)), 24, BAD_STATUS),
        (blank("developer_name"), 8, MISSING_DEVELOPER),
        (note_text.contains("truncated"), 12, TRUNCATED_SOURCE),
        (note_text.contains("best-effort") | note_text.contains("failed"), 8, FALLBACK_TEXT),
    ]
    taken = reduce(
        lambda a, b: a + b, [F.when(c, F.lit(p)).otherwise(F.lit(0)) for c, p, _ in deductions]
    )
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, _, r in deductions]))
    scored = extractions.withColumns(
        {
            "extraction_confidence": (
                F.greatest(F.lit(0), F.lit(100) - taken) / F.lit(100)
            ).cast(SCORE_TYPE),
            "review_reasons": reasons,
        }
    )
    # Any reason keeps a row in review; without one the score is always 1.00.
    return scored.withColumn(
        "review_status",
        F.when(F.size("review_reasons") == 0, AUTO_REVIEWED).otherwise(NEEDS_REVIEW),
    )


def validate_leads(bodies: DataFrame, created_at: Column, origin: str) -> DataFrame:
    """Lead rows from JSON bodies; `error` holds the first rule that fails.

    The lead id is made from the content and time, so a retried task gives the
    same one.
    """
    body = F.coalesce(F.when(F.col("body") != "", F.col("body")), F.lit("{}"))
    whole = F.try_parse_json(body)
    value = F.when(F.schema_of_variant("_whole").startswith("OBJECT"), F.col("_whole"))

    def field(name: str) -> Column:
        text = F.coalesce(member_text(F.col("_value"), name), F.lit(""))
        return strip(text)

    fields = {name: field(name) for name in ("company", "role", "territories", "use_case", "name")}
    fields["email"] = F.lower(field("email"))
    parsed = computed_once(bodies, {"_whole": whole})
    read = computed_once(computed_once(parsed, {"_value": value}), fields)
    failing = {
        "email": ~F.col("email").rlike(EMAIL),
        **{name: F.col(name) == "" for name, _ in LEAD_RULES[1:]},
    }
    error = F.when(F.col("_whole").isNull(), "Request body must be valid JSON").when(
        F.col("_value").isNull(), "Request body must be a JSON object"
    )
    for name, message in LEAD_RULES:
        error = error.when(failing[name], message)
    digest = F.md5(
        F.concat_ws("\x1f", "email", "company", "role", "territories", "use_case", "name",
                    created_at.cast("string")).cast("binary")
    )
    lead_id = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    keep = [c for c in bodies.columns if c != "body"]
    return read.select(
        *keep,
        lead_id.alias("lead_id"),
        created_at.alias("created_at"),
        "email",
        "name",
        "company",
        "role",
        F.col("territories").alias("priority_territories"),
        "use_case",
        F.lit("NEW").alias("status"),
        F.lit(origin).alias("source"),
        error.alias("error"),
    )
