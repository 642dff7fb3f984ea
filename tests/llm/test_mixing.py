from collections import defaultdict

import pytest

from tests.llm.conftest import odd_rows
from tidemark.llm import mixing


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    """Water-filling as told: clamp, reshare the excess, until nothing is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, clamped = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in clamped)
        open_ = [s for s in order if s not in clamped]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > cap * sizes[s]}
        if not above:
            return share | {s: cap * sizes[s] for s in clamped}
        clamped |= above


def test_targets_and_taken(docs, prose):
    rows = [(i, prose(i, 5 + i % 90), "en", f"s{min(i % 17, 9)}", 0) for i in range(400)]
    rows += [(1000 + i, prose(i, 3), "en", "tiny", 0) for i in range(5)]
    rows += [(2000, "one two", "en", None, 0), (2001, "ä b  c\x0bd", "en", "zz", 0)]
    out = mixing.mix(docs(rows)).collect()
    assert sorted(r.doc_id for r in out) == sorted(r[0] for r in rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    assert {r["size"] for r in out if r.doc_id == 2001} == {3}
    expected = brute_targets(sizes)
    for r in out:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(expected[r.source])
        assert abs(taken[r.source] - r.target) <= 1
    assert sorted(map(tuple, mixing.mix(docs(rows)).collect()), key=str) == sorted(map(tuple, out), key=str)


def test_odd_rows(docs, prose):
    out = mixing.mix(docs(odd_rows(prose), clash=True)).collect()
    assert len(out) == 9
    assert {r.doc_id: r.taken for r in out if r["size"] == 0} == {1: 0, 2: 0, 3: 0}
    tied = [r.taken for r in out if r.doc_id == 6]
    assert tied[0] == tied[1]


def test_empty(docs):
    assert mixing.mix(docs([])).collect() == []
    assert mixing.repeated(docs([])).collect() == []


def test_repeated_keeps_columns(docs, prose):
    frame = docs(odd_rows(prose), clash=True)
    out = mixing.repeated(frame)
    assert out.columns == frame.columns
    counts = defaultdict(int)
    for r in out.collect():
        counts[r.doc_id] += 1
    takes = {r.doc_id: r for r in mixing.mix(frame).collect()}
    for doc_id, n in counts.items():
        copies = 2 if doc_id == 6 else 1
        low = takes[doc_id].epochs * copies
        assert low <= n <= low + copies


def test_ranks_over_ranges(spark):
    names = [(f"s{i:05d}", 1) for i in range(3000)] + [(None, 1)]
    frame = spark.createDataFrame(names, "source string, source_size long")
    got = {r.source: r.weight for r in mixing.weighted(frame).collect()}
    order = sorted(got, key=lambda s: (s is None, s or ""))
    assert [got[s] for s in order] == [i % 3 + 1 for i in range(3001)]
