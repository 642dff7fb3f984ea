"""Vectors that can be compared: finite, not zero; and classes of equal ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def comparable(embedding: str = "embedding") -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part; rows without an id do not."""
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & comparable())
