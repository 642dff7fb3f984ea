"""Near-duplicates among embeddings: int8 tile products with rigorous error bounds.

Equal vectors are one class first. A unit vector x is written as s*q + e, q in int8, and the length
of its error e is computed per vector. For two vectors

    |x.y - s_x s_y q_x.q_y| <= |s_x q_x| |e_y| + |e_x|,

so one product of whole numbers tells which pairs surely lie below the threshold, which surely
reach it, and which few must be recomputed from the original vectors in double precision.

Classes are dealt over cells around centers fitted on a bounded sample. A vector is also a guest in
every lower-numbered cell that a partner of it may live in: y belongs to center p_j rather than to
p_i, so |x - y| is at least the distance of x to the plane between them; beyond the distance that
the threshold allows, no partner can be there. Every pair is met in exactly one cell. A cell of any size is
cut into chunks by a hash; a task multiplies two chunks, and returns for each vector the number of
its links and the smallest class it is joined to there, never the pairs. So a dense group costs
products, but no more rows than vectors and tasks.

Null vectors, zero vectors, and ones with null or non-finite components link with nothing; so do
rows without an id, which are their own component null. Vectors of different dimensions never link.
Repeated rows (same id, same vector) are one vector and come once for each row. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.components import components
from tidemark.llm.vectors import comparable, usable

THRESHOLD = 0.95
CHUNK = 4096
#: The centers are fitted on at most this many vectors; there are at most so many of them.
SAMPLE = 4096
CENTERS = 256
#: What float rounding can add to the bounds.
SLACK = 1e-6
#: Partitions of the tile stage at most; beyond it a task works on several tiles in turn.
MOST_TASKS = 100_000
_STRIP = 512
_EXACT = 65_536


def fit_centers(unit: np.ndarray, count: int) -> np.ndarray:
    """Spherical k-means on the sample; where they lie decides cost only, never results."""
    rng = np.random.default_rng(7)
    centers = unit[rng.choice(len(unit), min(count, len(unit)), replace=False)]
    for _ in range(12):
        own = np.argmax(unit @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(length > 0, sums / np.maximum(length, 1e-12), centers)
    return centers


def cells_of(unit: np.ndarray, centers: np.ndarray, threshold: float) -> list[list[int]]:
    """For each vector its own cell, then the lower-numbered cells it is a guest in."""
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    near = unit @ centers.T
    own = np.argmax(near, axis=1)
    apart = np.linalg.norm(centers[:, None, :] - centers[None, :, :], axis=2)
    best = near[np.arange(len(unit)), own]
    to_plane = (best[:, None] - near) <= reach * apart[own] + SLACK
    to_plane &= np.arange(len(centers))[None, :] < own[:, None]
    return [[int(o), *np.flatnonzero(g).tolist()] for o, g in zip(own, to_plane, strict=True)]


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale, length of the quantised vector and length of the error, per vector."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(unit - back, axis=1)


def linked(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of the two chunks have a cosine of the threshold or more."""
    lengths = [np.linalg.norm(v, axis=1) for v in (left, right)]
    (q1, s1, n1, e1), (q2, s2, _, e2) = (
        quantised(v / length[:, None]) for v, length in zip((left, right), lengths, strict=True)
    )
    # Products of int8 sum up to whole numbers that float32 holds exactly, below 2 ** 24 each.
    wide = left.shape[1] <= 1040
    kind = np.float32 if wide else np.float64
    columns = q2.T.astype(kind)
    out = np.zeros((len(left), len(right)), np.bool_)
    for low in range(0, len(left), _STRIP):
        part = slice(low, low + _STRIP)
        about = (q1[part].astype(kind) @ columns) * s2[None, :] * s1[part, None]
        error = n1[part, None] * e2[None, :] + e1[part, None] + SLACK
        maybe = about + error >= threshold
        if not maybe.any():
            continue
        sure = about - error >= threshold
        out[part] = sure
        rows, cols = np.nonzero(maybe & ~sure)
        rows += low
        for at in range(0, len(rows), _EXACT):
            a, b = rows[at : at + _EXACT], cols[at : at + _EXACT]
            exact = np.einsum("ij,ij->i", left[a], right[b]) / (lengths[0][a] * lengths[1][b])
            out[a, b] = exact >= threshold
    return out


def joined_to(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id that each of both sides is joined to through the links of this mask."""
    left, right = left.copy(), right.copy()
    far = np.iinfo(np.int64).max
    while True:
        a = np.minimum(left, np.where(mask, right[None, :], far).min(axis=1, initial=far))
        b = np.minimum(right, np.where(mask, a[:, None], far).min(axis=0, initial=far))
        if (a == left).all() and (b == right).all():
            return a, b
        left, right = a, b


TILES = "class_id bigint, links bigint, root bigint"


def _tile(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        same = first["l"] == first["r"]
        # Of a chunk with itself, all rows are on both sides.
        sides = [group if same else group[group["chunk"] == first[s]] for s in ("l", "r")]
        if any(side.empty for side in sides):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("class_id", "links", "root")})
        vectors = [np.stack(side["embedding"].to_numpy()).astype(np.float64) for side in sides]
        ids, sizes = ([side[c].to_numpy(np.int64) for side in sides] for c in ("class_id", "copies"))
        mask = linked(vectors[0], vectors[1], threshold)
        if same:
            np.fill_diagonal(mask, False)
        rows, cols = mask.any(axis=1), mask.any(axis=0)
        mask = mask[np.ix_(rows, cols)]
        roots = joined_to(mask, ids[0][rows], ids[1][cols])
        out = [pd.DataFrame({"class_id": ids[0][rows], "links": mask @ sizes[1][cols], "root": roots[0]})]
        if not same:
            out.append(pd.DataFrame({"class_id": ids[1][cols], "links": mask.T @ sizes[0][rows], "root": roots[1]}))
        return pd.concat(out).astype("int64")

    return run


def _dealt(centers: np.ndarray, threshold: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if part.empty:
                continue
            v = np.stack(part["embedding"].to_numpy()).astype(np.float64)
            where = cells_of(v / np.linalg.norm(v, axis=1, keepdims=True), centers, threshold)
            yield part.assign(cells=where)[["class_id", "copies", "embedding", "cells"]]

    return run


def tile_links(classes: DataFrame, threshold: float, chunk: int = CHUNK) -> DataFrame:
    """Links and roots of classes (class_id, copies, embedding) of one dimension, per tile."""
    rows = classes.count()
    count = min(CENTERS, max(1, rows // chunk))
    drawn = classes.where(F.pmod(F.xxhash64("class_id", F.lit(3)), F.lit(1 << 30)) < F.lit((1 << 30) * min(1.0, SAMPLE / max(rows, 1))))
    sample = drawn.select("embedding").limit(SAMPLE).collect()
    if sample:
        unit = np.array([r[0] for r in sample], np.float64)
        centers = fit_centers(unit / np.linalg.norm(unit, axis=1, keepdims=True), count)
    else:
        centers = np.eye(1, len(classes.first()["embedding"])) if rows else np.eye(1)
    # Floats stay floats, which halves what is sent; anything else is compared as the double it is.
    kind = "float" if classes.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    schema = f"class_id bigint, copies bigint, embedding array<{kind}>, cells array<bigint>"
    dealt = written(classes.select("class_id", "copies", F.col("embedding").cast(f"array<{kind}>")).mapInPandas(_dealt(centers, threshold), schema), "tiles-dealt")
    lived = dealt.select("class_id", "copies", "embedding", F.posexplode("cells").alias("place", "cell"))
    lived = lived.withColumn("home", F.col("place") == 0)
    sizes = lived.groupBy("cell").agg(
        F.sum(F.col("home").cast("int")).alias("h"), F.sum((~F.col("home")).cast("int")).alias("g")
    )
    chunks = lambda c: F.ceil(F.col(c) / F.lit(chunk)).cast("int")
    sizes = sizes.select("cell", chunks("h").alias("homes"), chunks("g").alias("guests"))
    mine = F.when(F.col("home"), F.pmod(F.xxhash64("class_id"), F.col("homes"))).otherwise(
        F.col("homes") + F.pmod(F.xxhash64("class_id"), F.col("guests"))
    )
    partners = F.when(F.col("home"), F.col("homes") + F.col("guests")).otherwise(F.col("homes"))
    # sizes has one row per center, of which there are at most CENTERS.
    copies = (
        lived.join(F.broadcast(sizes), "cell")
        .where("homes > 0")
        .withColumn("chunk", mine.cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), partners - 1)))
        .select(
            "cell",
            F.least("chunk", "other").cast("int").alias("l"),
            F.greatest("chunk", "other").cast("int").alias("r"),
            "chunk",
            "class_id",
            "copies",
            "embedding",
        )
    )
    # A tile is little data and much work, so partitions are counted by tiles, not by bytes.
    tiles = sizes.agg(F.sum(F.col("homes") * (F.col("homes") + 1) / 2 + F.col("homes") * F.col("guests"))).first()[0]
    copies = copies.repartition(int(min(2 * (tiles or 1), MOST_TASKS)), "cell", "l", "r")
    return copies.groupBy("cell", "l", "r").applyInPandas(_tile(threshold), TILES)


def link(vectors: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark: SparkSession = vectors.sparkSession
    rows = usable(vectors)
    classes = written(
        rows.distinct().groupBy("embedding").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies")),
        "vector-classes",
    )
    # One dimension after the other; there is one, as a rule.
    dims = [r[0] for r in classes.select(F.size("embedding")).distinct().collect()]
    tiles = spark.createDataFrame([], TILES)
    for dim in sorted(dims):
        tiles = tiles.union(tile_links(classes.where(F.size("embedding") == dim), threshold, chunk))
    tiles = written(tiles, "vector-tiles")
    links = tiles.groupBy("class_id").agg(F.sum("links").alias("links"))
    joined = components(tiles.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    joined = joined.select(F.col("node").alias("class_id"), "component")
    figures = (
        classes.join(links, "class_id", "left")
        .join(joined, "class_id", "left")
        .select(
            "embedding",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "class_id").alias("component_id"),
        )
    )
    known = vectors.select("vec_id", F.when(comparable() & F.col("vec_id").isNotNull(), F.col("embedding")).alias("embedding"))
    return known.join(figures, "embedding", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
