import itertools
import math
import random
import zlib

import numpy as np

from tests.llm.conftest import odd_rows
from tidemark.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"


def labels(spark, rows):
    return spark.createDataFrame([(d, 1, t) for d, t in rows], LABELS)


def interacting(n=1200):
    """Toxic where an insult stands with a group, or neither stands: no weights alone can say so."""
    rng = random.Random(7)
    rows, truth = [], []
    for i in range(n):
        words = [f"n{chr(97 + rng.randrange(20))}" for _ in range(6)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += rng.sample(["insulta", "insultb"], insult) + rng.sample(["groupa", "groupb"], group)
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en", "s", 0))
        truth.append((i, int(insult == group)))
    return rows, truth


def accuracy(out, truth, held=None):
    truth = dict(truth)
    mine = [r for r in out if held is None or r.held_out == held]
    return sum(r.predicted == truth[r.doc_id] for r in mine) / len(mine)


def test_pairs_are_learned(spark, docs):
    rows, truth = interacting()
    frame, marks = docs(rows, clash=True), labels(spark, truth)
    out = toxicity.score_toxicity(frame, marks).collect()
    assert {r.doc_id: r.held_out for r in out} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in truth}
    assert accuracy(out, truth, held=True) > 0.97
    assert all((r.score >= 0.5) == bool(r.predicted) and 0 <= r.score <= 1 for r in out)
    flat = toxicity.train(frame, marks, factors=0)
    additive = toxicity.score_toxicity(frame, marks, flat).collect()
    assert accuracy(additive, truth, held=True) < 0.7


def test_held_out_labels_and_other_columns_do_not_matter(spark, docs):
    rows, truth = interacting(300)
    held = {i for i, _ in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    one = toxicity.score_toxicity(docs(rows), labels(spark, truth)).collect()
    turned = [(i, 1 - t if i in held else t) for i, t in truth]
    other = toxicity.score_toxicity(docs([(i, t, None, "else", 9) for i, t, *_ in rows]), labels(spark, turned)).collect()
    assert {(r.doc_id, r.score) for r in one} == {(r.doc_id, r.score) for r in other}


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    words = "Idiots and Groups, ähnlich word word x".split()
    known = sorted(toxicity.terms(" ".join(words)))
    w, v = rng.standard_normal(len(known)), rng.standard_normal((len(known), 4))
    machine = toxicity.Machine(known, 0.25, w, v)
    for text in ("Idiots, and groups!", "word WORD", "", None, "nothing known", " ".join(words)):
        at = [known.index(t) for t in sorted(toxicity.terms(text)) if t in known]
        z = 0.25 + sum(w[i] for i in at) + sum(float(v[i] @ v[j]) for i, j in itertools.combinations(at, 2))
        assert abs(machine.score(text) - 1 / (1 + math.exp(-z))) < 1e-12


def test_terms():
    assert toxicity.terms("abc ABC, abc1d") == {zlib.crc32(b"abc"), zlib.crc32(b"d")}
    assert toxicity.terms("Idiotic") == {zlib.crc32(b"idiotic"), zlib.crc32(b"idiot*")}
    assert toxicity.terms(None) == toxicity.terms("12 _ --") == set()


def test_gradient():
    rng = np.random.default_rng(5)
    start, size, factors = np.array([0, 3, 3, 7, 9]), 6, 3
    index = np.array([0, 1, 4, 0, 2, 3, 5, 1, 5])
    y, weight = np.array([1, 0, 0, 1]), np.array([0.2, 0.3, 0.3, 0.2])
    flat = rng.standard_normal(1 + size + size * factors)
    gradient = toxicity.loss_gradient(flat, index, start, y, weight, size, factors)[1]
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        up, down = (toxicity.loss_gradient(flat + s, index, start, y, weight, size, factors)[0] for s in (step, -step))
        assert abs((up - down) / 2e-6 - gradient[i]) < 1e-6


def test_vocabulary_against_brute_force(spark, docs):
    rows, truth = interacting(200)
    kind = dict(truth)
    texts = {i: toxicity.terms(t) for i, t, *_ in rows}
    table = spark.createDataFrame([(i, kind[i], sorted(x)) for i, x in texts.items()], toxicity._TERMED)
    positive = sum(kind.values())

    def g(term):
        total = 0.0
        for label, all_ in ((1, positive), (0, 200 - positive)):
            has = sum(kind[i] == label for i in texts if term in texts[i])
            n = sum(term in x for x in texts.values())
            for seen, expected in ((has, n * all_ / 200), (all_ - has, (200 - n) * all_ / 200)):
                total += seen * math.log(seen / expected) if seen else 0.0
        return total

    often = [t for t in set().union(*texts.values()) if sum(t in x for x in texts.values()) >= 3]
    best = sorted(often, key=lambda t: (-round(g(t), 9), t))[:20]
    assert toxicity.vocabulary(table, positive, 200 - positive, size=20) == best


def test_odd_rows(spark, docs, prose):
    rows, truth = interacting(200)
    frame = docs(odd_rows(prose) + [(r[0] + 1000, *r[1:]) for r in rows], clash=True)
    marks = labels(spark, [(i + 1000, t) for i, t in truth] + [(1, 1), (2, None), (None, 1), (6, 0), (6, 1), (99_999, 1)])
    out = toxicity.score_toxicity(frame, marks).collect()
    assert len(out) == 209
    empty = {r.score for r in out if r.doc_id in (1, 2, 3)}
    assert len(empty) == 1
    assert len({r.score for r in out if r.doc_id == 6}) == 1 and sum(r.doc_id == 6 for r in out) == 2


def test_nothing_to_learn(spark, docs):
    none = labels(spark, [])
    assert toxicity.score_toxicity(docs([]), none).collect() == []
    frame = docs([(1, "a b", "en", "s", 0), (3, None, "en", "s", 0)])
    assert {(r.score, r.predicted) for r in toxicity.score_toxicity(frame, none).collect()} == {(0.0, 0)}
    learnt = [i for i in range(9) if zlib.crc32(str(i).encode()) % 5][:2]
    frame = docs([(i, "a b", "en", "s", 0) for i in learnt])
    assert {r.score for r in toxicity.score_toxicity(frame, labels(spark, [(i, 1) for i in learnt])).collect()} == {1.0}
    both = labels(spark, [(learnt[0], 1), (learnt[1], 0)])
    assert {r.score for r in toxicity.score_toxicity(frame, both).collect()} == {0.5}  # no term is in three texts
