import numpy as np
import pytest

from tidemark.llm import ann, embedding_dedup

VECTORS = "vec_id long, embedding array<float>, label int"


def table(spark, vectors, first=0):
    rows = [(first + i, [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, VECTORS)


def groups(seed, count, dims=32):
    """Vectors, near copies of some, exact copies of others, and scaled ones."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(count, dims))
    v[10:20] = v[0] + rng.normal(scale=0.12, size=(10, dims))
    v[20:25] = v[1]
    v[25:30] = v[2] * np.arange(2, 7)[:, None]
    chain = v[3].copy()
    for i in range(30, 60):
        chain = chain + rng.normal(scale=0.2, size=dims)
        v[i] = chain
    v[60:120] = v[5] + rng.normal(scale=0.02, size=(60, dims))
    return v.astype(np.float32)


def brute_links(vectors, threshold):
    v = vectors.astype(np.float64)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    mask = v @ v.T >= threshold
    np.fill_diagonal(mask, False)
    label = np.arange(len(v))
    while True:
        new = np.minimum(label, np.where(mask, label[None, :], len(v)).min(axis=1))
        if (new == label).all():
            return mask.sum(axis=1), label
        label = new


@pytest.mark.parametrize("chunk", [40, 4096])
def test_links(spark, chunk):
    vectors = groups(1, 300)
    degree, label = brute_links(vectors, 0.95)
    assert degree.max() > 50
    for r in embedding_dedup.link(table(spark, vectors), chunk=chunk).collect():
        assert (r.n_links, r.component_id) == (degree[r.vec_id], label[r.vec_id])
        assert r.kept == (r.vec_id == r.component_id)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    unit = rng.normal(size=(300, 24))
    unit[::3] *= np.exp(rng.normal(size=(100, 24)))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    q, s, n, e = embedding_dedup.quantised(unit)
    about = (q.astype(int) @ q.T.astype(int)) * s[:, None] * s[None, :]
    assert (np.abs(about - unit @ unit.T) <= n[:, None] * e[None, :] + e[:, None] + 1e-12).all()


def test_guests_reach_every_partner():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    cells = embedding_dedup.cells_of(v, embedding_dedup.fit_centers(v, 12), 0.9)
    for a, b in zip(*np.nonzero(v @ v.T >= 0.9), strict=True):
        lower, upper = sorted((a, b), key=lambda i: cells[i][0])
        assert cells[lower][0] in cells[upper]


ODD = [
    (1, None, 0), (2, [0.0, 0.0], 0), (3, [1.0, None], 0), (4, [float("nan"), 1.0], 0), (5, [float("inf"), 1.0], 0),
    (6, [], 0), (7, [1.0, 2.0], 0), (8, [1.0, 2.0], 0), (8, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (9, [1.0, 2.0, 3.0], 0),
    (10, [2.0, 4.0], 0),
]


def test_odd_vectors(spark):
    frame = spark.createDataFrame(ODD, VECTORS).withColumnRenamed("label", "class_id")
    out = [tuple(r) for r in embedding_dedup.link(frame).collect()]
    assert len(out) == len(ODD)
    assert set(out) == {(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9)} | {
        (None, 0, None, True), (7, 2, 7, True), (8, 2, 7, False), (10, 2, 7, False)
    }
    got = {(r.query_id, r["rank"]): (r.vec_id, round(r.score, 9)) for r in ann.nearest(frame, frame).collect()}
    assert got == {
        (7, 1): (8, 1.0), (7, 2): (10, 1.0), (8, 1): (7, 1.0), (8, 2): (10, 1.0), (10, 1): (7, 1.0), (10, 2): (8, 1.0)
    }
    empty = frame.where("false")
    assert embedding_dedup.link(empty).collect() == []
    assert ann.nearest(empty, empty).collect() == []


def test_recall_over_shards(spark):
    vectors = groups(4, 900)
    frame = table(spark, vectors)
    index = ann.build_index(frame, 5, shard=200)
    assert index.count() == 5
    asked = frame.where("vec_id % 10 = 0")
    found = {}
    for r in ann.search(index, asked, 5).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    v = vectors.astype(np.float64)
    length = np.linalg.norm(v, axis=1)
    hits = 0
    for q in range(0, 900, 10):
        score = v @ v[q] / (length * length[q])
        score[q] = -2
        best = np.lexsort((np.arange(900), -score))[:5]
        mine = sorted(found[q])
        assert [rank for rank, _, _ in mine] == [1, 2, 3, 4, 5]
        assert all(abs(s - score[i]) < 1e-12 for _, i, s in mine)
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        hits += len(set(best) & {i for _, i, _ in mine})
    assert hits / (90 * 5) > 0.95


def test_links_of_doubles_are_not_rounded(spark):
    """Cosines closer to the threshold than floats can tell."""
    rows = []
    for i, cosine in enumerate((0.95 + 3e-9, 0.95 - 3e-9)):
        x = [0.0] * 8
        y = [0.0] * 8
        x[2 * i], y[2 * i], y[2 * i + 1] = 1.0, cosine, (1 - cosine * cosine) ** 0.5
        rows += [(2 * i, x), (2 * i + 1, y)]
    out = embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: r.n_links for r in out} == {0: 1, 1: 1, 2: 0, 3: 0}
