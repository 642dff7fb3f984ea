"""Computing columns once per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def computed_once(rows: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Adds columns that later filters and projections only read.

    Catalyst moves a filter below a projection by writing the projected
    expressions into it, so costly ones (parsing JSON, cleaning cells) would run
    again for every mention. Columns that come from a generator stay where they
    are; this one gives exactly one row per row.
    """
    values = F.struct(*[column.alias(name) for name, column in columns.items()])
    return rows.select("*", F.inline(F.array(values)))
