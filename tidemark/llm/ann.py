"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Equal vectors are one node with its smallest ids (as many as a result can hold; ties go to smaller
ids, so no others can ever be returned). Nodes are dealt over shards of about `SHARD` by a hash;
each shard's graph is built in one task and stored as one row of flat arrays: vectors, the
neighbours of layer 0 (a fixed number per node, -1 for none), those of the upper layers, and
offsets. A search takes blocks of queries to every shard of their dimension, where each query walks
the graph; the best of every shard are merged by exact cosine and id.

Memory of a task is one shard and one block of queries, at any size of the table. The graph table is
written once in the shared folder. Building costs about the same per vector at every size; a search
visits every shard, as every shard may hold a nearest neighbour.

Null vectors, zero vectors, and ones with null or non-finite components take no part; neither do
rows without an id. Vectors of another dimension are searched among themselves. A repeated row
(same id, same vector) is one candidate. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.vectors import usable

SHARD = 4096
QUERIES_IN_BLOCK = 512
#: Links per node in upper layers; layer 0 has twice as many.
LINKS = 16
#: Partitions of the building stage at most; beyond it a task builds several graphs in turn.
MOST_TASKS = 20_000
EF_BUILD = 80
EF_SEARCH = 128


class Graph:
    """A navigable small-world graph over unit vectors, in flat arrays."""

    def __init__(self, unit: np.ndarray):
        n = len(unit)
        self.unit = unit
        draw = np.random.default_rng(20).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / math.log(LINKS)).astype(np.int32), 12)
        self.upper_at = np.concatenate([[0], np.cumsum(self.level)]).astype(np.int32)
        self.base = np.full((n, 2 * LINKS), -1, np.int32)
        self.upper = np.full((int(self.upper_at[-1]), LINKS), -1, np.int32)
        self.entry = -1
        self.seen = np.zeros(n, np.int32)
        self.stamp = 0

    def links(self, node: int, layer: int) -> np.ndarray:
        """The row of neighbours of a node, to be read or written."""
        return self.base[node] if layer == 0 else self.upper[self.upper_at[node] + layer - 1]

    def walk(self, q: np.ndarray, starts: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The `width` nearest nodes found from the starts, as (distance, node), nearest first."""
        self.stamp += 1
        seen, stamp, unit = self.seen, self.stamp, self.unit
        todo = list(starts)
        heapq.heapify(todo)
        best = [(-d, x) for d, x in starts]
        heapq.heapify(best)
        for _, x in starts:
            seen[x] = stamp
        while todo:
            d, node = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            row = self.links(node, layer)
            row = row[row >= 0]
            row = row[seen[row] != stamp]
            if not len(row):
                continue
            seen[row] = stamp
            away = 1.0 - unit[row] @ q
            for a, x in zip(away.tolist(), row.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (-a, x))
                    heapq.heappush(todo, (a, x))
                elif a < -best[0][0]:
                    heapq.heapreplace(best, (-a, x))
                    heapq.heappush(todo, (a, x))
        return sorted((-d, x) for d, x in best)

    def choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours in several directions: one is passed over if it is nearer to one chosen
        before than to the node; what was passed over fills up what is left."""
        if len(found) <= most:
            return [x for _, x in found]
        nodes = [x for _, x in found]
        rows = self.unit[nodes]
        between = 1.0 - rows @ rows.T
        nearest = np.full(len(nodes), np.inf)
        chosen, passed = [], []
        for i, (d, _) in enumerate(found):
            if d < nearest[i]:
                chosen.append(i)
                if len(chosen) == most:
                    break
                np.minimum(nearest, between[i], out=nearest)
            else:
                passed.append(i)
        return [nodes[i] for i in chosen + passed[: most - len(chosen)]]

    def add(self, node: int) -> None:
        level = int(self.level[node])
        if self.entry < 0:
            self.entry = node
            return
        q = self.unit[node]
        top = int(self.level[self.entry])
        at = [(float(1.0 - self.unit[self.entry] @ q), self.entry)]
        for layer in range(top, level, -1):
            at = self.walk(q, at[:1], 1, layer)
        for layer in range(min(top, level), -1, -1):
            at = self.walk(q, at, EF_BUILD, layer)
            most = 2 * LINKS if layer == 0 else LINKS
            mine = self.choose(at, LINKS)
            self.links(node, layer)[: len(mine)] = mine
            for other in mine:
                row = self.links(other, layer)
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = node
                    continue
                everyone = np.append(row, node)
                away = 1.0 - self.unit[everyone] @ self.unit[other]
                order = np.argsort(away, kind="stable")
                kept = self.choose(list(zip(away[order].tolist(), everyone[order].tolist(), strict=True)), most)
                row[:] = -1
                row[: len(kept)] = kept
        if level > top:
            self.entry = node

    def nearest(self, q: np.ndarray, k: int, width: int) -> list[int]:
        at = [(float(1.0 - self.unit[self.entry] @ q), self.entry)]
        for layer in range(int(self.level[self.entry]), 0, -1):
            at = self.walk(q, at[:1], 1, layer)
        return [x for _, x in self.walk(q, at, max(width, k), 0)[:k]]


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


GRAPH = (
    "dim int, shard int, entry int, vectors binary, members binary, member_at binary, "
    "base binary, upper binary, level binary, upper_at binary"
)


def _build(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("first_id", kind="stable")
    vectors = np.stack(group["embedding"].to_numpy()).astype(np.float64)
    members = [np.sort(np.asarray(m, np.int64)) for m in group["members"]]
    graph = Graph(_unit(vectors))
    for node in range(len(vectors)):
        graph.add(node)
    row = {
        "dim": int(group["dim"].iloc[0]),
        "shard": int(group["shard"].iloc[0]),
        "entry": graph.entry,
        "vectors": vectors.tobytes(),
        "members": np.concatenate(members).tobytes(),
        "member_at": np.cumsum([0] + [len(m) for m in members]).astype(np.int32).tobytes(),
        "base": graph.base.tobytes(),
        "upper": graph.upper.tobytes(),
        "level": graph.level.tobytes(),
        "upper_at": graph.upper_at.tobytes(),
    }
    return pd.DataFrame([row])


def build_index(vectors: DataFrame, k: int, shard: int = SHARD) -> DataFrame:
    """One row per shard. Results of up to k neighbours can be drawn from it."""
    rows = usable(vectors)
    same = Window.partitionBy("embedding").orderBy("vec_id")
    # row_number below a limit is cut on each task before rows are sent.
    first = rows.distinct().withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    nodes = written(
        first.groupBy("embedding").agg(F.collect_list("vec_id").alias("members"), F.min("vec_id").alias("first_id")),
        "ann-nodes",
    )
    shards = max(1, -(-nodes.count() // shard))
    dealt = nodes.withColumn("dim", F.size("embedding")).withColumn(
        "shard", F.pmod(F.xxhash64("first_id"), F.lit(shards)).cast("int")
    )
    # A shard is little data and much work, so partitions are counted by shards, not by bytes.
    dealt = dealt.repartition(min(4 * shards, MOST_TASKS), "dim", "shard")
    return written(dealt.groupBy("dim", "shard").applyInPandas(_build, GRAPH), "ann-graphs")


FOUND = "query_id bigint, vec_id bigint, score double"
_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _read_graph(row: dict) -> tuple[Graph, np.ndarray]:
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
    graph = Graph.__new__(Graph)
    graph.unit = _unit(vectors)
    graph.level = np.frombuffer(row["level"], np.int32)
    graph.upper_at = np.frombuffer(row["upper_at"], np.int32)
    graph.base = np.frombuffer(row["base"], np.int32).reshape(len(vectors), -1)
    graph.upper = np.frombuffer(row["upper"], np.int32).reshape(-1, LINKS)
    graph.entry, graph.seen, graph.stamp = row["entry"], np.zeros(len(vectors), np.int32), 0
    return graph, vectors


def _search(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                graph, vectors = _read_graph(row)
                members = np.frombuffer(row["members"], np.int64)
                at = np.frombuffer(row["member_at"], np.int32)
                lengths = np.linalg.norm(vectors, axis=1)
                out: list[tuple[int, int, float]] = []
                for query in row["queries"]:
                    q = np.asarray(query["embedding"], np.float64)
                    length = np.linalg.norm(q)
                    nodes = graph.nearest(q / length, k + 1, width)
                    # The exact measure, on the vectors as they are.
                    scores = (vectors[nodes] @ q) / (lengths[nodes] * length)
                    hits = [
                        (-s, int(m))
                        for x, s in zip(nodes, scores.tolist(), strict=True)
                        for m in members[at[x] : at[x + 1]]
                        if m != query["vec_id"]
                    ]
                    out += [(query["vec_id"], m, -s) for s, m in sorted(hits)[:k]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)] if out else [pa.array([], f.type) for f in _ARROW],
                    schema=_ARROW,
                )

    return run


def search(index: DataFrame, queries: DataFrame, k: int, width: int = EF_SEARCH) -> DataFrame:
    """The k nearest found of every query (vec_id, embedding), its own id left out."""
    asked = usable(queries).distinct().withColumn("dim", F.size("embedding"))
    blocks = max(1, -(-asked.count() // QUERIES_IN_BLOCK))
    block = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(blocks)).alias("block")
    packed = asked.groupBy("dim", block).agg(F.collect_list(F.struct("vec_id", "embedding")).alias("queries"))
    shards = index.groupBy("dim").agg(F.max("shard").alias("last"))
    sent = packed.join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), "last")))
    found = index.join(sent.drop("last"), ["dim", "shard"]).select(*index.columns, "queries")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (
        found.mapInArrow(_search(k, width), FOUND)
        .withColumn("rank", rank)
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, width: int = EF_SEARCH) -> DataFrame:
    """Index all vectors and search the queries."""
    return search(build_index(vectors, k), queries, k, width)
