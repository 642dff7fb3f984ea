"""Keyed rows to project records: normalise, score, key, fingerprint, dedupe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import any_token, normalize_header, sanitize_key, status_word
from tidemark.operators.lookup import ColumnLookup, EntryLookup
from tidemark.operators.once import computed_once
from tidemark.operators.ranking import top_per_group
from tidemark.vocabulary import (
    AUTO_REVIEWED,
    BARE_NAME,
    COMMERCIAL_NAME,
    COMPLETED_TOKENS,
    COMPLETENESS_FIELDS,
    COUNTY,
    DEVELOPER,
    FUEL,
    MISSING_CAPACITY,
    MISSING_NODE,
    NEEDS_REVIEW,
    NODE,
    PROJECT_ID,
    PROJECT_NAME,
    STATE,
    STATUS,
    WITHDRAWN_DATE,
    WITHDRAWN_TOKENS,
    ZONE,
)

SCORE_TYPE = "decimal(3,2)"

RECORD_COLUMNS = (
    "source_queue_id",
    "ord",
    "project_key",
    "interconnection_queue_id",
    "project_name",
    "capacity_mw",
    "capacity_source_field",
    "substation_or_node",
    "status",
    "developer_name",
    "county",
    "state",
    "zone",
    "fuel_type",
    "extraction_confidence",
    "review_status",
    "review_reasons",
    "source_location",
    "source_row_number",
    "source_header_row_number",
    "source_row",
)


# --- field rules --------------------------------------------------------------
def infer_status(raw: Column, withdrawn: Column, whole_words: bool = False) -> Column:
    """Withdrawal date, then status word, then a token in the status, else Active.

    Tokens match anywhere in the text ("Final" holds "ina"). `whole_words` makes
    them match words only.
    """
    lowered = F.lower(raw)
    return F.coalesce(
        F.when(withdrawn.isNotNull(), "Withdrawn"),
        status_word(raw),
        F.when(any_token(lowered, WITHDRAWN_TOKENS, whole_words), "Withdrawn"),
        F.when(any_token(lowered, COMPLETED_TOKENS, whole_words), "Completed"),
        F.lit("Active"),
    )


def key_basis(project_id: Column, project_name: Column, node: Column) -> Column:
    """What a project is known by: its id, else name|node."""
    named = F.concat_ws("|", project_name, node)
    return F.coalesce(project_id, F.nullif(named, F.lit("")), F.lit("unknown"))


def with_project_key(rows: DataFrame, basis: str = "basis") -> DataFrame:
    """Adds project_key: the basis as a safe key of at most 120 characters.

    A longer one ends in a hash of the whole, so different projects stay apart."""
    digest = F.concat(F.lit("project-"), F.substring(F.sha2(F.col(basis), 256), 1, 16))
    # Never null, and known not to be: else every join on the key asks for keys that are not null, and
    # the question is moved below the dedupe, where it works the key out once more.
    return rows.withColumn("_safe", sanitize_key(basis, 120)).withColumn(
        "project_key",
        F.when(F.col("_safe") == "unknown", F.coalesce(digest, F.lit("unknown"))).otherwise(F.col("_safe")),
    ).drop("_safe")


def record_score(capacity: Column, node: Column, developer: Column) -> Column:
    """Confidence of a table record, in exact hundredths.

    Id and status are always present (0.64 + 0.12 + 0.04), so only capacity,
    node and developer move the score; it is held to 0.99.
    """
    points = (
        F.lit(80)
        + F.when(capacity.isNotNull(), 12).otherwise(0)
        + F.when(node.isNotNull(), 8).otherwise(0)
        + F.when(developer.isNotNull(), 4).otherwise(0)
    )
    return (F.least(points, F.lit(99)) / F.lit(100)).cast(SCORE_TYPE)


def review_reasons(capacity: Column, node: Column) -> Column:
    """What a record lacks; it is never without capacity and node both."""
    return (
        F.when(capacity.isNull(), F.array(F.lit(MISSING_CAPACITY)))
        .when(node.isNull(), F.array(F.lit(MISSING_NODE)))
        .otherwise(F.array().cast("array<string>"))
    )


def completeness() -> Column:
    """How many of the eight descriptive fields are filled."""
    filled = [
        f"if(coalesce(cast({field} AS string), '') <> '', 1, 0)" for field in COMPLETENESS_FIELDS
    ]
    return F.expr(" + ".join(filled))


# --- record projection --------------------------------------------------------
def to_records(
    rows: DataFrame, lookup: ColumnLookup | EntryLookup, whole_words: bool = False
) -> DataFrame:
    """One project record per usable row.

    `rows` carries source_queue_id, ord (position within the source) and, where
    known, source_location, source_row_number and source_header_row_number. Rows
    that name no project, repeat a header, or give neither capacity nor node
    are left out.
    """
    place = {
        "source_location": "string",
        "source_row_number": "bigint",
        "source_header_row_number": "bigint",
    }
    rows = rows.withColumns(
        {
            name: (F.col(name) if name in rows.columns else F.lit(None)).cast(kind)
            for name, kind in place.items()
        }
    )

    fields = {
        "project_id": lookup.value(PROJECT_ID),
        "commercial_name": lookup.value(COMMERCIAL_NAME),
        "listed_name": lookup.value(PROJECT_NAME),
        "bare_name": lookup.value(BARE_NAME),
        "capacity": lookup.capacity(),
        "listed_node": lookup.value(NODE),
        "raw_status": lookup.value(STATUS),
        "withdrawn_on": F.coalesce(*[lookup.value([a]) for a in WITHDRAWN_DATE]),
        "developer_name": lookup.value(DEVELOPER),
        "county": lookup.value(COUNTY),
        "state": lookup.value(STATE),
        "zone": lookup.value(ZONE),
        "fuel_type": lookup.value(FUEL),
        "source_row": lookup.source_row(),
    }
    found = computed_once(lookup.prepare(rows), fields)
    repeats_header = normalize_header("project_id").isin(*PROJECT_ID)
    usable = (
        found.filter(F.coalesce("project_id", "commercial_name", "listed_name").isNotNull())
        .filter(F.col("project_id").isNull() | ~repeats_header)
        .filter(F.col("capacity.capacity_mw").isNotNull() | F.col("listed_node").isNotNull())
    )
    named = usable.withColumns(
        {
            "project_name": F.coalesce("commercial_name", "listed_name"),
            "substation_or_node": F.coalesce(
                "listed_node", F.when(F.col("commercial_name").isNotNull(), F.col("bare_name"))
            ),
            "capacity_mw": F.col("capacity.capacity_mw"),
            "capacity_source_field": F.col("capacity.capacity_source_field"),
            "status": infer_status(F.col("raw_status"), F.col("withdrawn_on"), whole_words),
        }
    )
    capacity, node = F.col("capacity_mw"), F.col("substation_or_node")
    keyed = with_project_key(
        named.withColumn("basis", key_basis(F.col("project_id"), F.col("project_name"), node))
    )
    missing = capacity.isNull() | node.isNull()
    return keyed.withColumns(
        {
            "interconnection_queue_id": F.coalesce("project_id", "project_key"),
            "extraction_confidence": record_score(capacity, node, F.col("developer_name")),
            "review_status": F.when(missing, NEEDS_REVIEW).otherwise(AUTO_REVIEWED),
            "review_reasons": review_reasons(capacity, node),
        }
    ).select(*RECORD_COLUMNS)


def records_from_columns(
    rows: DataFrame, headers: list[str], whole_words: bool = False
) -> DataFrame:
    """Records of a DataFrame whose columns are the document's headers."""
    return to_records(rows, ColumnLookup(headers), whole_words)


def records_from_entries(rows: DataFrame, whole_words: bool = False) -> DataFrame:
    """Records of rows that hold their cells as ARRAY<STRUCT<header, value>> `entries`."""
    return to_records(rows, EntryLookup(), whole_words)


def extraction() -> Column:
    """The five extracted fields as one struct."""
    return F.struct(
        "interconnection_queue_id",
        "capacity_mw",
        "substation_or_node",
        "status",
        "developer_name",
    )


# --- fingerprint --------------------------------------------------------------
def record_fingerprint(ignore_location: bool = False) -> Column:
    """sha256 over everything that describes the project.

    Scores, review fields and row numbers do not count. The text is
    unambiguous: a null field is left out, and the separator cannot occur in
    clean cells. `ignore_location` leaves out source_location, which for XML is
    the element index and so moves when an earlier element is added.
    """
    fields = [
        "source_queue_id",
        "project_key",
        "interconnection_queue_id",
        "project_name",
        "capacity_mw",
        "capacity_source_field",
        "substation_or_node",
        "status",
        "developer_name",
        "county",
        "state",
        "zone",
        "fuel_type",
    ]
    if not ignore_location:
        fields.append("source_location")
    parts = ", ".join(f"concat('{field}=', {field})" for field in fields)
    row = "to_json(sort_array(map_entries(source_row)))"
    # The separator cannot occur in clean cells.
    return F.expr(f"sha2(concat_ws('\\u001f', {parts}, {row}), 256)")


def with_fingerprints(records: DataFrame, ignore_location: bool = False) -> DataFrame:
    return records.withColumn("record_fingerprint", record_fingerprint(ignore_location))


# --- dedupe and limit ---------------------------------------------------------
def dedupe_records(records: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One record per (source, key): the most complete, the earliest on a tie.

    A key keeps the position where it first appeared (`first_seen`), whichever
    record wins. This is an aggregate, so each task first reduces its own rows
    to one per key and a key with very many copies never gathers in one place.
    Rows are sorted and sent with all they hold; `columns` names what is read
    of the winner besides its keys and `first_seen`, and leaves the rest behind.
    """
    keys = ["source_queue_id", "project_key"]
    rest = [c for c in records.columns if c not in keys and (columns is None or c in columns)]
    if not rest:
        return records.groupBy(*keys).agg(F.min("ord").alias("first_seen"))
    return (
        records.groupBy(*keys)
        .agg(
            F.max_by(F.struct(*rest), F.struct(completeness(), -F.col("ord"))).alias("winner"),
            F.min("ord").alias("first_seen"),
        )
        .select(*keys, "winner.*", "first_seen")
    )


def limit_records(records: DataFrame, limit: int) -> DataFrame:
    """The first `limit` records of each source by first appearance.

    A source that is cut must not report what is missing as removed: see `delta.compare`."""
    order = [F.col("first_seen"), F.col("project_key")]
    return top_per_group(records, ["source_queue_id"], order, limit, measure=F.col("first_seen"))


def build_records(
    raw_records: DataFrame,
    ignore_location: bool = False,
    limit: int | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Deduplicated and fingerprinted records, ready for a snapshot; limited only if told so.

    With `columns` (see `dedupe_records`) fingerprints are made before the dedupe, so that the source
    rows they cover need not be sorted and sent."""
    if columns is None:
        ready = with_fingerprints(dedupe_records(raw_records), ignore_location)
    else:
        if "record_fingerprint" in columns:
            mark = {"record_fingerprint": record_fingerprint(ignore_location)}
            raw_records = computed_once(raw_records, mark)
        ready = dedupe_records(raw_records, columns)
    return ready if limit is None else limit_records(ready, limit)
