"""Leads as they come in: checked once, then stored or kept as rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.quality import validate_leads
from tidemark.sinks.store import DeltaStore


def take_leads(
    store: DeltaStore, bodies: DataFrame, run_id: str, created_at: Column, origin: str
) -> DataFrame:
    """Store the leads of JSON bodies (column `body`); gives the rejected ones with their error.

    Ids come from content and time, so a repeated run stores the same rows again.
    """
    checked = validate_leads(bodies, created_at, origin)
    store.write("leads", checked.filter(F.col("error").isNull()), run_id)
    store.write("lead_rejects", checked.filter(F.col("error").isNotNull()), run_id)
    return store.of_run("lead_rejects", run_id)
