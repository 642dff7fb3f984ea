"""Reading snapshots through their manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.joins import join_lookup


def latest_versions(manifest: DataFrame, version: str = "snapshot_id") -> DataFrame:
    """The newest snapshot of each source."""
    return manifest.groupBy("source_queue_id").agg(F.max(version).alias(version))


def latest_records(
    records: DataFrame, manifest: DataFrame, version: str = "snapshot_id"
) -> DataFrame:
    """Records of the newest snapshot of each source.

    The version is a partition column of the stored records, so versions that
    are nobody's newest are not read.
    """
    return join_lookup(
        records, latest_versions(manifest, version), ["source_queue_id", version], "left_semi"
    )
