import random
import re

import numpy as np
import pytest

from tests.llm.conftest import odd_rows
from tidemark.llm import components, minmax


def shingle_set(text, words):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(w) < words:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1))


def brute(texts, words):
    sets = {d: shingle_set(t, words) for d, t in texts.items()}
    label = {d: d for d in texts}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def copies(prose):
    """A group of near copies with chains, exact copies, a shared passage, and others."""
    rng = random.Random(9)
    texts, passage = {}, prose("passage", 60)
    base = prose("base", 150).split()
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(10)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    chain = prose("chain", 150).split()
    for i in range(60, 80):
        chain = list(chain)
        for _ in range(5):
            chain[rng.randrange(len(chain))] = f"link{rng.randrange(10**6)}"
        texts[i] = " ".join(chain)
    for i in range(80, 95):
        texts[i] = "Same TEXT\tagain and again x"
    for i in range(95, 140):
        texts[i] = f"{passage} {prose(i, 20)}"
    for i in range(140, 200):
        texts[i] = prose(i, rng.randrange(1, 80))
    texts |= {200: "", 201: "one", 202: "one", 203: None, 204: "\n", 205: "one two", 206: "ONE  two", 207: "É x", 208: "é x"}
    return texts


@pytest.mark.parametrize("words, chunk", [(2, 512), (2, 3), (5, 512)])
def test_against_brute_force(docs, prose, words, chunk):
    texts = copies(prose)
    expected = brute(texts, words)
    rows = [(d, t, "en", "s", 0) for d, t in texts.items()]
    out = minmax.link(docs(rows, clash=True), words=words, chunk=chunk).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_shingles, r.component_id) == expected[r.doc_id], r.doc_id
        assert r.kept == (r.doc_id == r.component_id)


def test_third_round_finds_what_stars_miss(spark):
    """Members of a bucket that are joined to each other, but not to its smallest one."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(100)]

    def text(own, kept):
        return " ".join(base[:kept] + [f"{own}{rng.randrange(10**9)}" for _ in range(100 - kept)])

    texts = {1: " ".join(base)} | {i: text(f"x{i}", 70) for i in range(2, 9)}
    texts[9] = texts[4] + " more"
    texts[10] = texts[6] + " words"
    placed = spark.createDataFrame([(5, d, len(shingle_set(t, 2)), d) for d, t in texts.items()], "key long, rep long, n long, component long")
    held = spark.createDataFrame([(d, t.encode()) for d, t in texts.items()], "rep long, text binary")
    for chunk in (2, 512):
        found = {tuple(sorted(r)) for r in minmax.mixed_links(placed, held, 2, 80, chunk).collect()}
        assert found == {(4, 9), (6, 10)}


def test_bands_catch_the_threshold():
    """Pairs just above the threshold share a band."""
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(400):
        shared, only = rng.integers(0, 1 << 63, 800, dtype=np.uint64), rng.integers(0, 1 << 63, (2, 100), dtype=np.uint64)
        a, b = (minmax.bands(minmax.signature(np.unique(np.concatenate([shared, x])))) for x in only)
        missed += not (a == b).any()
    assert missed == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(6)
    shared, only = rng.integers(0, 1 << 63, 500, dtype=np.uint64), rng.integers(0, 1 << 63, (2, 250), dtype=np.uint64)
    a, b = (minmax.signature(np.concatenate([shared, x])) for x in only)
    assert abs((a == b).mean() - 0.5) < 0.12


def test_odd_rows(docs, prose):
    frame = docs(odd_rows(prose), clash=True)
    out = minmax.link(frame).collect()
    assert len(out) == 9
    assert all(r.kept for r in out)
    assert {r.n_shingles for r in out if r.doc_id in (1, 2, 3)} == {0}
    assert minmax.link(docs([])).collect() == []
    kept = minmax.representatives(frame)
    assert kept.columns == frame.columns and kept.count() == 8  # of the repeated row, one


def test_one_representative_of_each_group(docs, prose):
    """Whatever doc_id says: a shared one does not take other texts away, a missing one keeps no copy."""
    a, b, c, d = (prose(x, 60) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, d), (None, d)]
    out = minmax.representatives(docs([(*r, "en", "s") for r in rows], clash=True)).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted([("1", a), ("2", b), ("3", c), ("None", d)])
    near = [f"{a} {a} more{i}" for i in range(4)]
    rows = [(7, near[0]), (7, near[1]), (None, near[2]), (5, near[3]), (5, b), (6, ""), (6, ""), (8, None)]
    out = minmax.representatives(docs([(*r, "en", "s") for r in rows])).collect()
    assert sorted((r.doc_id, r.text) for r in out if r.text) == sorted([(5, near[3]), (5, b)])
    assert sorted(r.doc_id for r in out if not r.text) == [6, 6, 8]


@pytest.mark.parametrize("chunk", [512, 3])
def test_representatives_against_brute_force(docs, prose, chunk):
    texts = copies(prose)
    label = {d: c for d, (_, c) in brute(texts, 5).items()}
    out = minmax.representatives(docs([(d, t, "en", "s", 0) for d, t in texts.items()]), chunk=chunk).collect()
    assert sorted(r.doc_id for r in out) == sorted({c for d, c in label.items()})


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 300)] + [(7, rng.randrange(1000, 2000)) for _ in range(300)]
    edges += [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(150)] + [(5000, 5000)]
    label = {x: x for e in edges for x in e}
    for _ in range(500):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    out = components.components(frame).collect()
    got = {r.node: r.component for r in out}
    assert len(got) == len(out)
    assert got == {x: label[x] for e in edges for x in e if e[0] != e[1]}


def test_workers_take_batches_in_slices():
    """A batch of Spark's holds up to 64 MB of texts; a worker makes objects of 256 rows at a time."""
    import pyarrow as pa

    n = 1000
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n)), pa.array(range(n)), pa.array([f"some words {i}".encode() for i in range(n)])],
        names=["doc_id", "mark", "text"],
    )
    parts = list(minmax._sign(2)(iter([batch])))
    assert max(p.num_rows for p in parts) <= 256
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(n))
