"""Connected components of an undirected graph, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

_EDGES = "a bigint, b bigint"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each Arrow batch of edges as stars: (node, smallest node of its part of the batch)."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        nodes = np.array(list(parent), np.int64)
        roots = np.array([root(x) for x in list(parent)], np.int64)
        other = nodes != roots
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[other]), pa.array(roots[other])], names=["a", "b"]
        )


def _star_step(edges: DataFrame) -> DataFrame:
    """One large and one small star. Edges (a, b) have a > b before and after. Minima per node are
    partial aggregates; a hub's edges meet its minimum in a join that Spark may split."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    large = large.distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    near = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge (a, b); component is its smallest node."""
    ordered = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    stars = written(ordered.mapInArrow(_forest, _EDGES).distinct(), "stars")
    before = None
    while True:
        state = stars.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state[0] == 0 or tuple(state) == before:
            break
        # Finished stars: every node has one center, and no center has one itself.
        centers = stars.select(F.col("b").alias("a")).distinct()
        loose = stars.groupBy("a").count().where("count > 1").select("a").limit(1)
        if loose.isEmpty() and stars.join(centers, "a", "left_semi").limit(1).isEmpty():
            break
        before = tuple(state)
        stars = written(_star_step(stars), "stars")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        stars.select("b", "b").distinct()
    )
