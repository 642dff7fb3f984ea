import math
import random

import numpy as np
import pytest

from tidemark.llm import whitening

VECTORS = "vec_id long, embedding array<float>"


def vectors(n=400, dims=12, seed=3):
    rng = np.random.default_rng(seed)
    mixed = rng.standard_normal((n, dims)) @ rng.standard_normal((dims, dims))
    return [(i, [float(np.float32(c)) for c in row]) for i, row in enumerate(mixed / 10)]


def brute(rows):
    """x, exact deviations, eigenvalues and vectors of the covariance, by whole numbers and numpy."""
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in x])
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    return centred, deviation, values[::-1], vectors_[:, ::-1]


def compare(out, rows, k):
    centred, deviation, values, directions = brute(rows)
    got = {(r.vec_id, r.component): r for r in out}
    assert len(got) == len(out) == len(rows) * k
    for c in range(k):
        mine = np.array([got[v, c + 1].whitened for v, _ in rows])
        expected = centred @ directions[:, c] / math.sqrt(values[c])
        sign = np.sign(mine @ expected)
        assert np.abs(mine - sign * expected).max() < 1e-9
        assert abs(got[rows[0][0], c + 1].explained / (values[c] / values.sum()) - 1) < 1e-10
    for (v, _), d in zip(rows, deviation, strict=True):
        assert got[v, 1].deviation == d and got[v, 1].n == len(rows)
    w = np.array([[got[v, c + 1].whitened for c in range(k)] for v, _ in rows])
    error = np.abs(np.cov(w.T, bias=True) - np.eye(k)).max()
    assert error < 1e-9 and {r.identity_error for r in out} == {out[0].identity_error} and out[0].identity_error < 1e-9


@pytest.mark.parametrize("dims, parts", [(12, 1), (12, 40), (3, 5), (1, 2)])
def test_against_brute_force(spark, dims, parts):
    rows = vectors(dims=dims)
    frame = spark.createDataFrame(rows, VECTORS).repartition(parts)
    compare(whitening.whiten(frame).collect(), rows, min(8, dims))


def test_what_takes_no_part(spark):
    rows = vectors(60, 10)
    odd = [(1000, None), (1001, [None] + [0.0] * 9), (1002, [float("nan")] * 10), (1003, [math.inf] + [0.0] * 9),
           (1004, [1e30] * 10), (1005, [1.0, 2.0]), (1006, [])]
    clash = [(*r, "x", "y", "z") for r in rows + odd]
    frame = spark.createDataFrame(clash, VECTORS + ", n string, length string, component string")
    compare(whitening.whiten(frame).collect(), rows, 8)
    again = rows + [rows[0], (None, rows[1][1]), (2000, [0.0] * 10)]
    out = whitening.whiten(spark.createDataFrame(again, VECTORS)).collect()
    assert len(out) == 63 * 8 and {r.n for r in out} == {63}
    assert sum(r.vec_id is None for r in out) == 8 and sum(r.vec_id == 0 for r in out) == 16


def test_nothing_to_whiten(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], VECTORS)).collect() == []
    same = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(9)], VECTORS)
    assert whitening.whiten(same).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(9)], VECTORS)
    assert {r.component for r in whitening.whiten(flat).collect()} == {1}


def test_long_vectors_and_doubles(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(300).tolist()) for i in range(340)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    compare(whitening.whiten(frame).collect(), rows, 8)


def test_deviation_beyond_64_bits():
    centre = whitening.Centre(1 << 30, [1 << 50, 3])
    x = np.array([[1 << 20, 5], [(1 << 20) + 90_000, 5]])
    exact = [sum(((1 << 30) * a - s) ** 2 for a, s in zip(v, (1 << 50, 3), strict=True)) for v in x.tolist()]
    assert centre.deviation(x) == [v if v < 1 << 63 else None for v in exact]


def _check(r, count=8):
    values, z = whitening.leading(r, count)
    expected = np.linalg.svd(r, compute_uv=False)[: len(values)] ** 2
    assert np.abs(values / expected - 1).max(initial=0) < 1e-12
    assert np.abs(z.T @ z - np.eye(len(values))).max(initial=0) < 1e-11
    assert np.abs(r.T @ (r @ z) - z * values).max(initial=0) <= 1e-12 * values.max(initial=0)
    return len(values)


def test_solver():
    """Clustered, equal, graded, falling apart and rank-deficient cases."""
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    near = np.diag(np.abs(np.arange(-10, 11)) + 2.0) + np.eye(21, k=1) + np.eye(21, k=-1)
    assert _check(np.linalg.cholesky(near).T) == 8  # pairs of values that agree to many digits
    assert _check(np.diag([5.0] * 10 + [1.0] * 30) @ q) == 8
    assert _check(np.diag([5 + 1e-9 * i for i in range(10)] + [1.0] * 30) @ q) == 8
    assert _check(np.diag(10.0 ** -np.arange(0, 20, 0.5)) @ q) == 8
    assert _check(np.eye(64)) == 8
    assert _check(np.zeros((4, 4))) == 0
    assert _check(np.linalg.qr(rng.standard_normal((90, 3)) @ rng.standard_normal((3, 20)), mode="r")) == 3
    assert _check(rng.standard_normal((3, 20))) == 3
    assert _check(np.linalg.qr(np.repeat(rng.standard_normal((90, 5)), 2, axis=1), mode="r")) == 5


def test_all_singular_values():
    rng = random.Random(4)
    for n in (1, 2, 3, 10, 50):
        a, b = [rng.lognormvariate(0, 3) for _ in range(n)], [rng.lognormvariate(0, 3) for _ in range(n - 1)]
        got = np.sqrt(whitening.dqds([x * x for x in a], [x * x for x in b]))
        assert np.allclose(got, np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False), rtol=1e-11, atol=1e-13 * got[0])
