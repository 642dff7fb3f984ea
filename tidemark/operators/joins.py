"""Joins to tables that have one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def join_lookup(facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join many rows to a lookup table that has one row per key.

    How is left to Spark: it broadcasts the lookup when its measured size allows, and otherwise
    splits a key that holds a large share of the facts, which it can as they are the preserved side.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"the facts must be the preserved side, not {how}")
    return facts.join(lookup, list(on), how)
