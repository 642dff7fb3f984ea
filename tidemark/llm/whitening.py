"""Whitening of embeddings through a bidiagonal qd solver.

Entries c become integers x = floor(1024 c) + 100000. With n rows of sums S, centred rows are
x - S/n; their covariance (divisor n) is never formed. Instead

  1. every task reduces its centred rows to a triangle by QR, block by block; triangles are reduced
     in the same way, `FAN` at a time, until one R is left: R'R is n times the covariance;
  2. Householder reflections bring R to an upper bidiagonal B;
  3. dqds, on the squares of B's entries, finds all singular values to high relative accuracy;
  4. twisted factorisations of B'B - s give the vectors of the leading ones, which go back through
     the reflections. Blocks that B falls into are solved one by one, and vectors whose values agree
     to `CLOSE` are iterated and kept orthogonal to each other.

What reaches one task or the driver is d x d numbers for vectors of d entries, at any number of rows.
Eigenvalues are s / n; a row's whitened entry is its centred row's projection over the root of one.

Rows whose vector is null, or holds a null, a non-finite entry or one beyond `LARGEST`, take no part,
nor do vectors of another length than the commonest (of lengths equally common, the longest). Rows
without an id take part and keep a null id; repeated rows count as often as they stand. Components
whose eigenvalue is zero within rounding are not returned, so equal rows, or none, give no row.
Components with equal eigenvalues are any orthonormal basis of their space. `deviation` is null where
it does not fit a long. Other columns of the table, of any name, are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

SCALE = 1024
OFFSET = 100_000
#: Larger entries are no embeddings; their sums would leave 64 bits.
LARGEST = float(1 << 35)
COMPONENTS = 8
#: Triangles that are reduced in one task.
FAN = 8
#: Rows in one step of QR.
ROWS = 2048
#: Relative distance of eigenvalues whose vectors are kept orthogonal.
CLOSE = 1e-3

EPS = float(np.finfo(np.float64).eps)


# --- rows -----------------------------------------------------------------------
def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, lengths and starts of the lists that are usable, in the flat values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.asarray(column.offsets, np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    good = np.isfinite(flat) & (np.abs(flat) <= LARGEST)
    bad = np.concatenate([[0], np.cumsum(~good)])
    row = np.flatnonzero(np.asarray(column.is_valid()) & (bad[at[1:]] == bad[at[:-1]]))
    return row, at[row + 1] - at[row], at[row]


def _entries(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors of that length, and their x as integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    row, size, start = _lists(column)
    row, start = row[size == length], start[size == length]
    flat = column.values.to_numpy(zero_copy_only=False)
    c = flat[start[:, None] + np.arange(length)].astype(np.float64)
    return row, np.floor(SCALE * c).astype(np.int64) + OFFSET


_SUMS = pa.schema([("length", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS).column(0)
            rows = []
            for length in np.unique(_lists(part)[1]).tolist():
                x = _entries(part, length)[1]
                rows.append({"length": length, "n": len(x), "sums": x.sum(axis=0).tolist()})
            yield pa.RecordBatch.from_pylist(rows, _SUMS)


class Centre:
    """Number of rows and exact sums of the fit list."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.dims = n, len(sums)
        self.base = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row, exactly."""
        off = x - self.base
        widest = (int(np.abs(off).max(initial=0)) + 1) * self.n
        if widest * widest * self.dims < 1 << 63:
            part = off * self.n - self.rest
            return (part * part).sum(axis=1).tolist()
        part = off.astype(object) * self.n - self.rest.astype(object)
        return [v if (v := int((p * p).sum())) < 1 << 63 else None for p in part]


def centre_of(vectors: DataFrame) -> Centre | None:
    """Sums of the fit list: vectors of the commonest length. Sums of tasks are added by Spark."""
    parts = written(vectors.select("embedding").mapInArrow(_sums, "length bigint, n bigint, sums array<bigint>"), "sums")
    top = parts.where("length > 0").groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    if top is None:
        return None
    flat = parts.where(F.col("length") == top.length).select(F.posexplode("sums").alias("place", "part"))
    sums = flat.groupBy("place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    return Centre(top.n, [int(r.total) for r in sorted(sums.collect())])


# --- blockwise QR ---------------------------------------------------------------
_TRIANGLE = "number bigint, r binary"


def triangle(parts: Iterator[np.ndarray], dims: int) -> np.ndarray:
    """R of all rows, with never more than a block beside the triangle."""
    r = np.zeros((0, dims))
    for part in parts:
        for low in range(0, len(part), ROWS):
            r = np.linalg.qr(np.vstack([r, part[low : low + ROWS]]), mode="r")
    return r


def _reduce_rows(centre: Centre) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (
            centre.centred(_entries(batch.slice(low, ROWS).column(0), centre.dims)[1])
            for batch in batches
            for low in range(0, batch.num_rows, ROWS)
        )
        r = triangle(parts, centre.dims)
        if len(r):
            yield pa.RecordBatch.from_pydict({"number": [TaskContext.get().partitionId()], "r": [r.tobytes()]})

    return run


def _reduce_triangles(dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Triangles come in order of their number; those of one number go into one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, r = None, np.zeros((0, dims))
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if number != last and last is not None:
                    yield pa.RecordBatch.from_pydict({"number": [last], "r": [r.tobytes()]})
                    r = np.zeros((0, dims))
                last = number
                r = np.linalg.qr(np.vstack([r, np.frombuffer(raw.as_py()).reshape(-1, dims)]), mode="r")
        if last is not None:
            yield pa.RecordBatch.from_pydict({"number": [last], "r": [r.tobytes()]})

    return run


def factor(vectors: DataFrame, centre: Centre) -> np.ndarray:
    """R of the centred rows."""
    dims = centre.dims
    level = written(vectors.select("embedding").mapInArrow(_reduce_rows(centre), _TRIANGLE), "triangles")
    while (last := level.agg(F.max("number")).first()[0]) > 0:
        by = level.select(F.floor(F.col("number") / FAN).alias("number"), "r")
        by = by.repartition(last // FAN + 1, "number").sortWithinPartitions("number")
        level = written(by.mapInArrow(_reduce_triangles(dims), _TRIANGLE), "triangles")
    return np.frombuffer(level.first().r).reshape(-1, dims)


# --- bidiagonal form ------------------------------------------------------------
def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and b such that (I - b v v') x is a multiple of the first unit vector."""
    size = float(np.linalg.norm(x))
    if size == 0.0:
        return x, 0.0
    v = x / size
    v[0] += math.copysign(1.0, v[0])
    return v, 2.0 / float(v @ v)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, float]]]:
    """Diagonal and superdiagonal of B with R = U B W', and the reflections that make up W."""
    d = r.shape[1]
    a = np.zeros((d, d))
    a[: min(d, len(r))] = r[:d]
    right = []
    for k in range(d):
        v, b = _reflector(a[k:, k].copy())
        a[k:, k:] -= b * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v, b = _reflector(a[k, k + 1 :].copy())
            a[k:, k + 1 :] -= b * np.outer(a[k:, k + 1 :] @ v, v)
            right.append((v, b))
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def carried_back(z: np.ndarray, right: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """W z."""
    z = z.copy()
    for k in range(len(right) - 1, -1, -1):
        v, b = right[k]
        z[k + 1 :] -= b * (v @ z[k + 1 :]) * v
    return z


# --- singular values by dqds ----------------------------------------------------
def dqds(q: list[float], e: list[float]) -> list[float]:
    """Squared singular values of the bidiagonal with squared entries q (diagonal), e (above it),
    in falling order.

    Each step moves the squares by a shift that is no larger than the smallest value left: the
    reciprocal trace of the inverse, found without a subtraction. Rounding can still turn a pivot
    negative; the step is then repeated with less."""
    found: list[float] = []
    blocks = [(list(q), list(e), 0.0)]
    negligible = (4 * EPS) ** 2
    while blocks:
        q, e, moved = blocks.pop()
        while q:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= negligible * (moved + q[i])), None)
            if len(q) == 1:
                found.append(moved + q[0])
                break
            if cut is not None:
                blocks.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] < q[-1]:  # read backwards it has the same values; the small end goes last
                q.reverse()
                e.reverse()
            shift = _below_smallest(q, e)
            step = _shifted(q, e, shift)
            while step is None:
                shift = shift * 0.9 if shift > moved * EPS else 0.0
                step = _shifted(q, e, shift)
            moved += shift
            q, e = step
    return sorted(found, reverse=True)


def _below_smallest(q: list[float], e: list[float]) -> float:
    if min(q) <= 0.0:
        return 0.0
    row = 1.0 / q[-1]
    trace = row
    for i in range(len(e) - 1, -1, -1):
        row = (1.0 + e[i] * row) / q[i]
        trace += row
    return (1.0 - 8 * len(q) * EPS) / trace if math.isfinite(trace) else 0.0


def _shifted(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    out_q, out_e = [], []
    d = q[0] - shift
    for i in range(len(e)):
        if d < 0.0:
            return None
        top = d + e[i]
        ratio = q[i + 1] / top
        out_q.append(top)
        out_e.append(e[i] * ratio)
        d = d * ratio - shift
    if d < 0.0:
        return None
    out_q.append(d)
    return out_q, out_e


# --- vectors by twisted factorisations ------------------------------------------
def twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """B'B - value = N D N': N's entries below the diagonal before the twist, above it after it, D,
    and the twist, where D's entry is smallest."""
    n = len(a)
    tiny = EPS * EPS * max(float(np.max(a * a)), 1e-300)
    down, up = np.zeros(n), np.zeros(n)  # pivots from the top, from the bottom
    below, above = np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0))
    left, right = np.zeros(n), np.zeros(n)
    s = -value
    for i in range(n):
        left[i] = s
        pivot = a[i] * a[i] + s
        down[i] = pivot if abs(pivot) > tiny else -tiny
        if i < n - 1:
            below[i] = a[i] * b[i] / down[i]
            s = b[i] * b[i] * s / down[i] - value
    p = a[-1] * a[-1] - value
    for i in range(n - 1, -1, -1):
        right[i] = p
        if i:
            pivot = b[i - 1] * b[i - 1] + p
            up[i] = pivot if abs(pivot) > tiny else -tiny
            above[i - 1] = a[i - 1] * b[i - 1] / up[i]
            p = p * a[i - 1] * a[i - 1] / up[i] - value
    gamma = left + right + value
    k = int(np.argmin(np.abs(gamma)))
    pivots = np.concatenate([down[:k], [gamma[k] if abs(gamma[k]) > tiny else tiny], up[k + 1 :]])
    return below, above, pivots, k


def _solved(parts: tuple[np.ndarray, np.ndarray, np.ndarray, int], x: np.ndarray) -> np.ndarray:
    """z with (N D N') z = x."""
    below, above, pivots, k = parts
    y = x.copy()
    for i in range(k):
        y[i + 1] -= below[i] * y[i]
    for i in range(len(y) - 1, k, -1):
        y[i - 1] -= above[i - 1] * y[i]
    y /= pivots
    for i in range(k - 1, -1, -1):
        y[i] -= below[i] * y[i + 1]
    for i in range(k + 1, len(y)):
        y[i] -= above[i - 1] * y[i - 1]
    return y / np.linalg.norm(y)


def _vector(a: np.ndarray, b: np.ndarray, value: float, others: list[np.ndarray], seed: int) -> np.ndarray:
    parts = twisted(a, b, value)
    z = np.zeros(len(a))
    z[parts[3]] = parts[2][parts[3]]
    z = _solved(parts, z)
    if not others:
        return z
    z = np.random.default_rng(seed).standard_normal(len(a))
    for _ in range(3):
        for _ in range(2):
            for other in others:
                z -= (other @ z) * other
        z = _solved(parts, z / np.linalg.norm(z))
    for _ in range(2):
        for other in others:
            z -= (other @ z) * other
    return z / np.linalg.norm(z)


def leading(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of R'R, falling, and their unit vectors as columns; values that are
    zero within rounding are left out."""
    d = r.shape[1]
    a, b, right = bidiagonal(r)
    largest = max(float(np.abs(a).max(initial=0)), float(np.abs(b).max(initial=0)))
    if largest == 0.0:
        return np.zeros(0), np.zeros((d, 0))
    a, b = a / largest, b / largest
    # Entries that do not reach the rounding of the whole part B into blocks.
    cuts = [0, *(np.flatnonzero(np.abs(b) <= EPS) + 1).tolist(), d]
    pairs = []
    for low, high in zip(cuts, cuts[1:], strict=False):
        inner_a, inner_b = a[low:high], b[low : high - 1]
        for value in dqds((inner_a**2).tolist(), (inner_b**2).tolist()):
            pairs.append((value, low, high))
    pairs.sort(reverse=True)
    pairs = [p for p in pairs[:count] if p[0] > (16 * d * EPS) ** 2 * pairs[0][0]]
    columns: list[np.ndarray] = []
    held: list[tuple[float, int, np.ndarray]] = []
    for place, (value, low, high) in enumerate(pairs):
        near = [z for other, start, z in held if start == low and other - value <= CLOSE * other]
        z = _vector(a[low:high], b[low : high - 1], value, near, place)
        held.append((value, low, z))
        whole = np.zeros(d)
        whole[low:high] = z
        columns.append(carried_back(whole, right))
    return np.array([p[0] for p in pairs]) * largest * largest, np.stack(columns, axis=1)


# --- the operator ---------------------------------------------------------------
class Whitening:
    """Centre, directions (one column each, over the root of its eigenvalue) and shares."""

    def __init__(self, centre: Centre, r: np.ndarray, count: int):
        self.centre = centre
        values, vectors = leading(r, count)
        self.values = values / centre.n
        self.directions = vectors / np.sqrt(self.values)
        total = float((r * r).sum()) / centre.n
        self.explained = (self.values / total).tolist() if total else []

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.directions


def fit(vectors: DataFrame, count: int = COMPONENTS) -> Whitening | None:
    """Directions of all usable rows; None if there are none."""
    centre = centre_of(vectors)
    return None if centre is None else Whitening(centre, factor(vectors, centre), count)


_PRODUCTS = "place int, total double"


def _products(model: Whitening) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                w = model.whitened(_entries(batch.slice(low, ROWS).column(0), model.centre.dims)[1])
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], names=["place", "total"])

    return run


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity."""
    k = len(model.values)
    sums = vectors.select("embedding").mapInArrow(_products(model), _PRODUCTS).groupBy("place").agg(F.sum("total").alias("total"))
    flat = np.array([r.total for r in sorted(sums.collect())]).reshape(k, k)
    return float(np.abs(flat / model.centre.n - np.eye(k)).max())


WHITENED = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
)
_ARROW = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64())]
    + [(c, pa.float64()) for c in ("whitened", "explained", "identity_error")]
)


def _apply(model: Whitening, error: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                part = batch.slice(low, ROWS)
                row, x = _entries(part.column(1), model.centre.dims)
                each = pa.array(np.repeat(row, k))
                deviation = pa.array(model.centre.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
                size = len(row) * k
                columns = [
                    part.column(0).take(each), np.tile(np.arange(1, k + 1), len(row)), np.full(size, model.centre.n), deviation,
                    model.whitened(x).ravel(), np.tile(model.explained, len(row)), np.full(size, error),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) if isinstance(c, np.ndarray) else c for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW
                )

    return run


def whiten(vectors: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component."""
    model = fit(vectors, count)
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], WHITENED)
    run = _apply(model, identity_error(vectors, model))
    return vectors.select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(run, WHITENED)
