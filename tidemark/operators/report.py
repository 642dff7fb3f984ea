"""Reports over insights: signals, summary, source health, filters and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import first_non_empty, iso_utc, safe_timestamp
from tidemark.vocabulary import (
    FILTERED_CSV_COLUMNS,
    NEEDS_REVIEW,
    PROJECT_DELTA,
    REPORT_LOOKBACK_HOURS,
    SEARCHED_FIELDS,
    SIGNAL_CSV_COLUMNS,
    SOURCE_EXTRACTION,
)

HEALTHY = "HEALTHY"
HEALTH_LIMITATION = "Derived from project-delta insight rows"
SUMMARY_FIELDS = (
    "total_signals",
    "project_delta_signals",
    "baseline_signals",
    "new_signals",
    "updated_signals",
    "removed_signals",
    "needs_review",
    "total_capacity_mw",
    "active_signals",
    "withdrawn_signals",
    "completed_signals",
)


def recent_insights(
    insights: DataFrame, as_of: Column, hours: int = REPORT_LOOKBACK_HOURS
) -> DataFrame:
    """Insights observed at most `hours` before `as_of`; the filter reaches the scan."""
    return insights.filter(F.col("observed_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS"))


def newest_first(rows: DataFrame) -> DataFrame:
    """Order of a report; the id splits ranges in which many rows share a time."""
    return rows.orderBy(F.col("observed_at").desc(), F.col("queue_id"))


def _column(rows: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


def _without_trailing_zeros(number: Column) -> Column:
    return F.when(
        number.contains("."), F.regexp_replace(number, r"\.?0+$", "")
    ).otherwise(number)


def signals(insights: DataFrame) -> DataFrame:
    """Insights as report rows: 23 columns, empty text instead of null, extraction as fallback."""
    has_extraction = "extraction" in insights.columns

    def text(*names: str, extracted: str | None = None, default: str = "") -> Column:
        options = [_column(insights, n).cast("string") for n in names]
        if extracted and has_extraction:
            options.append(F.col(f"extraction.{extracted}").cast("string"))
        return F.coalesce(first_non_empty(*options), F.lit(default))

    def texts(name: str) -> Column:
        empty = F.array().cast("array<string>")
        return F.coalesce(_column(insights, name, "array<string>"), empty)

    capacity = F.nullif(_column(insights, "capacity_mw", "bigint"), F.lit(0))
    if has_extraction:
        # A capacity of zero counts as absent, so the extracted one is taken.
        capacity = F.coalesce(capacity, F.col("extraction.capacity_mw"))
    else:
        capacity = _column(insights, "capacity_mw", "bigint")
    return insights.select(
        text("id", "queue_id").alias("id"),
        text("queue_id").alias("queue_id"),
        text("source_queue_id", "queue_id").alias("source_queue_id"),
        text("insight_type", default=SOURCE_EXTRACTION).alias("insight_type"),
        text("delta_type").alias("delta_type"),
        F.col("observed_at"),
        text("interconnection_queue_id", extracted="interconnection_queue_id").alias(
            "interconnection_queue_id"
        ),
        text("project_name").alias("project_name"),
        capacity.cast("bigint").alias("capacity_mw"),
        text("substation_or_node", extracted="substation_or_node").alias("substation_or_node"),
        text("status", extracted="status").alias("status"),
        text("developer_name", extracted="developer_name").alias("developer_name"),
        text("source_url").alias("source_url"),
        text("raw_s3_key").alias("raw_s3_key"),
        text("output_s3_key").alias("output_s3_key"),
        text("evidence_key", "raw_s3_key", "output_s3_key").alias("evidence_key"),
        _without_trailing_zeros(text("extraction_confidence")).alias("confidence"),
        text("review_status", default=NEEDS_REVIEW).alias("review_status"),
        text("parser_status", "review_status", default=NEEDS_REVIEW).alias("parser_status"),
        texts("review_reasons").alias("review_reasons"),
        texts("changed_fields").alias("changed_fields"),
        text("market").alias("market"),
        text("utility_name").alias("utility_name"),
    )


def prefer_deltas(rows: DataFrame) -> DataFrame:
    """Only the delta rows if there are any, else all rows.

    Whether there are any is one scalar subquery, not a join.
    """
    is_delta = F.col("insight_type") == PROJECT_DELTA
    any_delta = rows.agg(F.coalesce(F.max(is_delta), F.lit(False)).alias("any_delta")).scalar()
    return rows.filter(is_delta | ~any_delta)


def report_summary(rows: DataFrame) -> DataFrame:
    """Eleven counts over the report's signals, in one aggregate."""

    def count(column: str, value: str) -> Column:
        return F.count_if(F.col(column) == value)

    return rows.agg(
        F.count("*").alias("total_signals"),
        count("insight_type", PROJECT_DELTA).alias("project_delta_signals"),
        count("delta_type", "BASELINE").alias("baseline_signals"),
        count("delta_type", "NEW").alias("new_signals"),
        count("delta_type", "UPDATED").alias("updated_signals"),
        count("delta_type", "REMOVED").alias("removed_signals"),
        count("review_status", NEEDS_REVIEW).alias("needs_review"),
        F.coalesce(F.sum("capacity_mw"), F.lit(0)).cast("bigint").alias("total_capacity_mw"),
        count("status", "Active").alias("active_signals"),
        count("status", "Withdrawn").alias("withdrawn_signals"),
        count("status", "Completed").alias("completed_signals"),
    )


def source_health(rows: DataFrame) -> DataFrame:
    """One row per source: changes, last observation, worst review status.

    Market and name are those of the newest signal (the greatest id among signals
    of the same time). Each task sums up its own rows first, so a source with most
    of the signals is no hot spot.
    """
    source = F.coalesce(
        F.when(F.col("source_queue_id") != "", F.col("source_queue_id")), F.col("queue_id")
    )
    named = F.struct("market", "utility_name")
    newest = F.struct("observed_at", "queue_id", "market", "utility_name")
    return (
        rows.groupBy(source.alias("source_queue_id"))
        .agg(
            F.max_by(named, newest).alias("first"),
            F.max("observed_at").alias("last_checked_at"),
            F.count("*").alias("change_count"),
            F.max(F.col("review_status") == NEEDS_REVIEW).alias("needs_review"),
        )
        .select(
            "source_queue_id",
            F.col("first.market").alias("market"),
            F.when(F.col("first.utility_name") != "", F.col("first.utility_name"))
            .otherwise(F.col("source_queue_id"))
            .alias("source_name"),
            F.lit("").alias("format"),
            "last_checked_at",
            F.col("last_checked_at").alias("last_changed_at"),
            F.when(F.col("needs_review"), NEEDS_REVIEW).otherwise(HEALTHY).alias("parser_status"),
            F.lit("").alias("rows_snapshotted"),
            "change_count",
            F.lit(HEALTH_LIMITATION).alias("limitation"),
        )
    )


def order_health(health: DataFrame) -> DataFrame:
    return health.orderBy("parser_status", "market", "source_queue_id")


def health_ratio(health: DataFrame) -> DataFrame:
    return health.agg(
        F.count_if(F.col("parser_status") == HEALTHY).alias("healthy_sources"),
        F.count("*").alias("all_sources"),
    )


def review_queue(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("review_status") == NEEDS_REVIEW)


def signal_facets(rows: DataFrame) -> DataFrame:
    """Distinct non-empty values of the three filter fields."""
    pairs = rows.select("market", "status", "delta_type").unpivot(
        [], ["market", "status", "delta_type"], "facet", "value"
    )
    return pairs.filter(F.col("value") != "").distinct()


def filter_signals(
    rows: DataFrame,
    market: str = "",
    status: str = "",
    delta_type: str = "",
    min_mw: int = 0,
    query: str = "",
) -> DataFrame:
    """Signals matching the chosen facets, capacity and text; '' and 0 match everything."""
    for name, value in (("market", market), ("status", status), ("delta_type", delta_type)):
        if value:
            rows = rows.filter(F.col(name) == value)
    rows = rows.filter(F.coalesce("capacity_mw", F.lit(0)) >= min_mw)
    needle = query.strip().lower()
    if needle:
        searched = F.concat_ws(
            " ", *[F.when(F.col(f) != "", F.col(f)) for f in SEARCHED_FIELDS]
        )
        rows = rows.filter(F.lower(searched).contains(needle))
    return rows


def modeled_value(
    capacity: Column | str, lead_days: Column | str, value_per_mw: Column | str
) -> Column:
    """Value of knowing early: MW * value * days/14, the time factor held to 0.25-1.6."""
    days = F.col(lead_days) if isinstance(lead_days, str) else lead_days
    mw = F.col(capacity) if isinstance(capacity, str) else capacity
    value = F.col(value_per_mw) if isinstance(value_per_mw, str) else value_per_mw
    return mw * value * F.least(F.lit(1.6), F.greatest(F.lit(0.25), days / F.lit(14.0)))


# --- exports ------------------------------------------------------------------
def _printable(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    def shown(name: str) -> Column:
        kind = rows.schema[name].dataType.typeName()
        if kind == "array":
            return F.array_join(name, "; ")
        if kind.startswith("timestamp"):
            return iso_utc(name)
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return rows.select(*[shown(c).alias(c) for c in columns])


def signal_csv_rows(rows: DataFrame) -> DataFrame:
    """The 21 columns of the report CSV, as text."""
    return _printable(rows, SIGNAL_CSV_COLUMNS)


def filtered_csv_rows(rows: DataFrame) -> DataFrame:
    """The 13 columns of the filtered export, as text."""
    return _printable(rows, FILTERED_CSV_COLUMNS)


def csv_line(rows: DataFrame) -> DataFrame:
    """Rows of text columns as one line each, every value quoted."""
    quoted = [
        F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
        for c in rows.columns
    ]
    return rows.select(F.concat_ws(",", *quoted).alias("line"))


def signal_line() -> Column:
    """One signal as a line of the text report."""
    def either(first: str, second: Column) -> Column:
        return F.when(F.col(first) != "", F.col(first)).otherwise(second)

    return F.concat_ws(
        " | ",
        iso_utc("observed_at"),
        either("delta_type", F.lit("SOURCE")),
        either("market", F.col("source_queue_id")),
        either("interconnection_queue_id", F.col("queue_id")),
        "project_name",
        F.coalesce(
            F.concat(F.col("capacity_mw").cast("string"), F.lit(" MW")),
            F.lit("capacity unknown"),
        ),
        "substation_or_node",
        "status",
        "review_status",
    )


def report_path(prefix: str, generated_at: Column, name: str) -> Column:
    """Where a report file goes: prefix/time/name, the time made safe for paths."""
    return F.concat(
        F.lit(prefix if prefix.endswith("/") else prefix + "/"),
        safe_timestamp(generated_at),
        F.lit("/" + name),
    )
