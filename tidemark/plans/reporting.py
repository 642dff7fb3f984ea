"""The report: recent insights to signals, summary, source health and files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from tidemark.operators import report
from tidemark.sinks import reports
from tidemark.vocabulary import REPORT_LOOKBACK_HOURS


@dataclass(frozen=True)
class Report:
    signals: DataFrame
    summary: DataFrame
    source_health: DataFrame


def build_report(
    insights: DataFrame, as_of: Column, hours: int = REPORT_LOOKBACK_HOURS
) -> Report:
    recent = report.signals(report.recent_insights(insights, as_of, hours))
    shown = report.prefer_deltas(recent)
    return Report(
        signals=report.newest_first(shown),
        summary=report.report_summary(shown),
        source_health=report.order_health(report.source_health(shown)),
    )


def write_report(built: Report, folder: str) -> None:
    reports.write_signal_csv(built.signals, f"{folder}/signals.csv")
    reports.write_signal_json(built.signals, f"{folder}/signals.json")
    reports.write_signal_text(built.signals, f"{folder}/signals.txt")
    reports.write_rows_json(built.summary, f"{folder}/summary.json")
    reports.write_rows_json(built.source_health, f"{folder}/source_health.json")
