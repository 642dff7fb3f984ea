"""Report rows, summary, health, filters and files."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import report
from tidemark.plans.reporting import build_report, write_report
from tidemark.sinks.reports import write_filtered_csv

SCHEMA = (
    "queue_id string, source_queue_id string, observed_at timestamp, insight_type string, "
    "delta_type string, market string, interconnection_queue_id string, project_name string, "
    "capacity_mw bigint, substation_or_node string, status string, review_status string, "
    "extraction_confidence decimal(3,2)"
)
AT = dt.datetime(2026, 5, 21, 9, 0)
EXTRACTED = ("source-only", None, AT, "SOURCE_EXTRACTION", None, None, "source-only", None, 999, None, "Active", "NEEDS_REVIEW", None)
DELTA = ("pjm-AE2-417", "pjm", AT, "PROJECT_DELTA", "UPDATED", "PJM", "AE2-417", "Oak Creek", 175, "Oak Creek 230 kV", "Active", "AUTO_REVIEWED", None)


def frame(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_one_insight(spark):
    rows = frame(spark, ("smoke", None, AT, None, None, None, "QW-1", None, 50, "Oak", "Active", "AUTO_REVIEWED", None))
    built = build_report(rows, F.lit("2026-05-21 10:00:00").cast("timestamp"))
    summary = built.summary.first()
    assert (summary.total_signals, summary.total_capacity_mw, summary.project_delta_signals) == (1, 50, 0)
    health = built.source_health.first()
    assert (health.source_queue_id, health.source_name, health.parser_status) == ("smoke", "smoke", "HEALTHY")


def test_deltas_are_preferred(spark):
    built = build_report(frame(spark, EXTRACTED, DELTA), F.lit("2026-05-21 10:00:00").cast("timestamp"))
    summary = built.summary.first()
    assert (summary.total_signals, summary.updated_signals, summary.total_capacity_mw) == (1, 1, 175)
    only = build_report(frame(spark, EXTRACTED), F.lit("2026-05-21 10:00:00").cast("timestamp"))
    assert only.summary.first().total_capacity_mw == 999


def test_empty_report(spark):
    built = build_report(frame(spark).limit(0), F.lit("2026-05-21 10:00:00").cast("timestamp"))
    summary = built.summary.first()
    assert (summary.total_signals, summary.total_capacity_mw) == (0, 0)
    assert built.source_health.isEmpty()


def test_health_takes_the_newest_and_the_worst(spark):
    later = AT + dt.timedelta(hours=1)
    rows = [
        ("a-1", "a", AT, "PROJECT_DELTA", "NEW", "Old market", None, None, None, None, None, "NEEDS_REVIEW", None),
        ("a-2", "a", later, "PROJECT_DELTA", "NEW", "New market", None, None, None, None, None, "AUTO_REVIEWED", None),
    ]
    health = report.source_health(report.signals(frame(spark, *rows))).first()
    assert (health.market, health.parser_status, health.change_count) == ("New market", "NEEDS_REVIEW", 2)
    assert health.last_checked_at == later


def test_zero_capacity_falls_back(spark):
    rows = frame(spark, DELTA[:8] + (0,) + DELTA[9:]).withColumn(
        "extraction", F.struct(*[F.lit(v).alias(n) for n, v in (("interconnection_queue_id", "x"), ("substation_or_node", "n"), ("status", "Active"), ("developer_name", "d"))], F.lit(12).cast("bigint").alias("capacity_mw"))
    )
    got = report.signals(rows).first()
    assert (got.capacity_mw, got.developer_name) == (12, "d")


def test_filters(spark):
    rows = report.signals(frame(spark, EXTRACTED, DELTA))
    ids = lambda **k: [r.id for r in report.filter_signals(rows, **k).collect()]
    assert ids() == ["source-only", "pjm-AE2-417"]
    assert ids(query=" oak CREEK 230 ") == ["pjm-AE2-417"]
    assert ids(min_mw=200) == ["source-only"]
    assert ids(market="PJM", status="Active", delta_type="UPDATED") == ["pjm-AE2-417"]
    assert ids(query="source-only oak") == []


def test_lines_and_value(spark, one):
    rows = report.signals(frame(spark, DELTA, EXTRACTED[:8] + (None,) + EXTRACTED[9:]))
    lines = [r[0] for r in rows.select(report.signal_line()).collect()]
    assert lines[0] == "2026-05-21T09:00:00Z | UPDATED | PJM | AE2-417 | Oak Creek | 175 MW | Oak Creek 230 kV | Active | AUTO_REVIEWED"
    assert lines[1].startswith("2026-05-21T09:00:00Z | SOURCE | source-only | source-only |  | capacity unknown")
    for days, factor in ((1, 0.25), (14, 1.0), (60, 1.6)):
        assert one(report.modeled_value(F.lit(10), F.lit(days), F.lit(1000))) == 10_000 * factor


def test_files(spark, tmp_path):
    built = build_report(frame(spark, EXTRACTED, DELTA), F.lit("2026-05-21 10:00:00").cast("timestamp"))
    write_report(built, str(tmp_path / "r"))
    csv = spark.read.csv(str(tmp_path / "r" / "signals.csv"), header=True)
    assert len(csv.columns) == 21 and csv.first().project_name == "Oak Creek"
    assert spark.read.json(str(tmp_path / "r" / "summary.json")).first().total_capacity_mw == 175
    assert spark.read.text(str(tmp_path / "r" / "signals.txt")).count() == 1
    quoted = built.signals.withColumn("project_name", F.lit('The "Oak"'))
    write_filtered_csv(quoted, str(tmp_path / "f"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "f")).collect())
    assert '"The ""Oak"""' in lines[0] and len(lines) == 2
