"""Report files: CSV, JSON lines and text, each written by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators import report


def write_signal_csv(signals: DataFrame, path: str) -> None:
    report.signal_csv_rows(signals).write.mode("overwrite").csv(path, header=True, escape='"')


def write_filtered_csv(signals: DataFrame, path: str) -> None:
    """Every value quoted, quotes doubled."""
    report.filtered_csv_rows(signals).write.mode("overwrite").csv(
        path, header=True, quoteAll=True, escape='"', emptyValue="", nullValue=""
    )


def write_signal_json(signals: DataFrame, path: str) -> None:
    signals.write.mode("overwrite").json(path)


def write_signal_text(signals: DataFrame, path: str) -> None:
    signals.select(report.signal_line()).write.mode("overwrite").text(path)


def write_rows_json(rows: DataFrame, path: str) -> None:
    """A small result (summary, source health) as JSON lines."""
    rows.write.mode("overwrite").json(path)


def write_run_output(output: DataFrame, path: str) -> None:
    """One JSON object per source and run."""
    output.write.mode("overwrite").json(path)
