"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms: lower-case words of letters, and the first `PREFIX` letters of longer
ones, each hashed by crc32. The machine scores

    bias + sum of w_i + sum over pairs i < j of <v_i, v_j>

over the terms it knows: a term can count for little alone and for much beside another (an insult
and the name of a group), which weights alone cannot say. Pairs cost no more than terms:
sum over pairs = (|sum of v_i|^2 - sum of |v_i|^2) / 2. The score is the logistic of that.

Learning takes a bounded sample, whatever the size of the corpus: at most `PER_CLASS` different
texts of each label, the first in the order of a hash of their id. Over it Spark counts every term by
label; the `TERMS` terms that tell most about the label (G statistic, at least `LEAST` texts) are known
to the machine, which one task then fits. So what the driver and that task hold is bounded by these
parameters. Scoring reads every text whole.

Labels of one doc_id: toxic if any says so; null labels and labels without a document teach nothing.
Without labels of both kinds the score is the share of toxic ones, 0 without any. Null text is empty,
empty texts get the score of no terms. Rows are scored one by one, so repeated rows agree; doc_id may
be null. Other columns, of any name, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import crc_bucket, written

PREFIX = 5
PER_CLASS = 3000
TERMS = 8192
LEAST = 3
FACTORS = 8
STEPS = 150
RATE = 0.05
RIDGE = 2e-4
#: Places of the hash that draws ids.
DRAWS = 1 << 30
#: Words whose terms a task remembers.
REMEMBERED = 500_000

_WORD = re.compile(r"[^\W\d_]+")


def word_terms(word: str) -> tuple[int, ...]:
    whole = zlib.crc32(word.encode("utf-8", "replace"))
    if len(word) <= PREFIX:
        return (whole,)
    return whole, zlib.crc32(word[:PREFIX].encode("utf-8", "replace") + b"*")


def terms(text: str | None) -> set[int]:
    """Hashes of the terms of a whole text."""
    return {term for word in set(_WORD.findall((text or "").lower())) for term in word_terms(word)}


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(crc_bucket(doc_id), F.lit(5)) == 0


# --- learning -------------------------------------------------------------------
_TERMED = "number bigint, toxic int, terms array<bigint>"
_TERMED_ARROW = pa.schema([("number", pa.int64()), ("toxic", pa.int32()), ("terms", pa.list_(pa.int64()))])


def _termed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 64):
            number, toxic, texts = batch.slice(low, 64).columns
            yield pa.RecordBatch.from_arrays(
                [number, toxic, pa.array([list(terms(t)) for t in texts.to_pylist()], pa.list_(pa.int64()))], schema=_TERMED_ARROW
            )


def training_sample(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(number, toxic, text) of at most `per_class` different texts of each label.

    Ids are drawn first, without texts; a little more than wanted, as some texts are copies."""
    known = documents.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
        .join(known, "doc_id", "left_semi")
        .withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(DRAWS)))
    )
    marked = written(marked, "toxic-marked")
    # A threshold by the number of ids thins out on the scan, so that few are ranked.
    counts = {r.toxic: r.rows for r in marked.groupBy("toxic").agg(F.count("*").alias("rows")).collect()}
    below = F.lit(False)
    for toxic, n in counts.items():
        below |= (F.col("toxic") == toxic) & (F.col("draw") <= int(DRAWS * min(1.0, (2 * per_class + 200) / n)))
    drawn = written(marked.where(below), "toxic-drawn")
    # So few that they go to the texts, rather than all texts to them; the size is checked.
    if drawn.count() <= 8 * per_class + 1000:
        drawn = F.broadcast(drawn)
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = drawn.join(texts, "doc_id").withColumn("mark", F.xxhash64("text"))
    first = rows.groupBy("toxic", "mark").agg(F.min(F.struct("draw", "doc_id", "text")).alias("f"))
    chosen = first.select("toxic", "f.draw", "mark", "f.text").withColumn(
        "place", F.row_number().over(Window.partitionBy("toxic").orderBy("draw", "mark"))
    )
    return chosen.where(F.col("place") <= per_class).select((F.col("place") * 2 + F.col("toxic")).cast("bigint").alias("number"), "toxic", "text")


def vocabulary(rows: DataFrame, positive: int, negative: int, size: int = TERMS, least: int = LEAST) -> list[int]:
    """The terms that tell most about the label, by the G statistic of their counts."""
    counts = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("toxic").cast("double").alias("a"), F.count("*").cast("double").alias("n")
    )
    all_ = float(positive + negative)
    cells = [
        (F.col("a"), F.col("n") * positive / all_),
        (F.col("n") - F.col("a"), F.col("n") * negative / all_),
        (positive - F.col("a"), (all_ - F.col("n")) * positive / all_),
        (negative - F.col("n") + F.col("a"), (all_ - F.col("n")) * negative / all_),
    ]
    g = sum((F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0) for seen, expected in cells), F.lit(0.0))
    top = counts.where(F.col("n") >= least).select("term", F.round(g, 9).alias("g")).orderBy(F.desc("g"), "term").limit(size)
    return [r.term for r in top.collect()]


def margins(w: np.ndarray, v: np.ndarray, bias: float, index: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the logistic, and the sums of factors, of documents whose known terms are
    index[start[d]:start[d + 1]]."""
    owner = np.repeat(np.arange(len(start) - 1), np.diff(start))
    n = len(start) - 1
    sums = np.array([np.bincount(owner, v[index, f], n) for f in range(v.shape[1])]).reshape(v.shape[1], n).T
    squares = np.bincount(owner, (v * v).sum(axis=1)[index], n)
    return bias + np.bincount(owner, w[index], n) + ((sums * sums).sum(axis=1) - squares) / 2, sums


def fit_machine(
    index: np.ndarray, start: np.ndarray, y: np.ndarray, size: int, steps: int = STEPS, factors: int = FACTORS
) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by Adam over all documents; both labels weigh the same."""
    rng = np.random.default_rng(11)
    flat = np.concatenate([[0.0], np.zeros(size), rng.normal(0, 0.05, size * factors)])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1))
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    for t in range(1, steps + 1):
        gradient = loss_gradient(flat, index, start, y, weight, size, factors)[1]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient * gradient
        flat = flat - RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return float(flat[0]), flat[1 : size + 1], flat[size + 1 :].reshape(size, factors)


def loss_gradient(
    flat: np.ndarray, index: np.ndarray, start: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int, factors: int
) -> tuple[float, np.ndarray]:
    """Weighted logistic loss with ridge, and its gradient."""
    bias, w, v = flat[0], flat[1 : size + 1], flat[size + 1 :].reshape(size, factors)
    z, sums = margins(w, v, bias, index, start)
    sign = np.where(y > 0, 1.0, -1.0)
    loss = float((weight * np.logaddexp(0, -sign * z)).sum()) + RIDGE / 2 * float((flat[1:] ** 2).sum())
    slope = -weight * sign / (1 + np.exp(np.clip(sign * z, -500, 500)))
    each = np.repeat(slope, np.diff(start))
    owner = np.repeat(np.arange(len(start) - 1), np.diff(start))
    total = np.bincount(index, each, size)
    pairs = np.array([np.bincount(index, each * sums[owner, f], size) for f in range(factors)]).reshape(factors, size).T
    pairs = pairs - total[:, None] * v
    return loss, np.concatenate([[slope.sum()], total, pairs.ravel()]) + RIDGE * np.concatenate([[0.0], flat[1:]])


class Machine:
    """A trained machine; terms are the hashes it knows."""

    def __init__(self, known: list[int], bias: float, w: np.ndarray, v: np.ndarray):
        self.place = {term: i for i, term in enumerate(known)}
        self.bias, self.w, self.v = bias, w, v
        self.words: dict[str, tuple[int, ...]] = {}

    def places(self, text: str | None) -> list[int]:
        """Places of the known terms of a text, each once."""
        words, place = self.words, self.place
        if len(words) > REMEMBERED:
            words.clear()
        found: set[int] = set()
        for word in set(_WORD.findall((text or "").lower())):
            mine = words.get(word)
            if mine is None:
                mine = words[word] = tuple(place[term] for term in word_terms(word) if term in place)
            found.update(mine)
        return sorted(found)

    def score(self, text: str | None) -> float:
        index = np.array(self.places(text), np.int64)
        z = float(margins(self.w, self.v, self.bias, index, np.array([0, len(index)]))[0][0])
        return float(1 / (1 + np.exp(np.clip(-z, -500, 500))))


def _fit(size: int, factors: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("number")
        index = np.concatenate([np.empty(0, np.int64), *[np.sort(np.asarray(x, np.int64)) for x in group["places"]]])
        start = np.concatenate([[0], np.cumsum([len(x) for x in group["places"]])]).astype(np.int64)
        bias, w, v = fit_machine(index, start, group["toxic"].to_numpy(), size, factors=factors)
        return pd.DataFrame([{"bias": bias, "w": w.tobytes(), "v": v.tobytes()}])

    return run


def _placed(known: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("number", pa.int64()), ("toxic", pa.int32()), ("places", pa.list_(pa.int64()))])
    ordered = np.argsort(np.array(known, np.int64))
    held = np.array(known, np.int64)[ordered]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = []
            for row in batch.column(2):
                mine = np.intersect1d(held, row.values.to_numpy(), return_indices=True)[1]
                places.append(ordered[mine])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.list_(pa.int64()))], schema=schema)

    return run


def train(
    documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, size: int = TERMS, factors: int = FACTORS
) -> Machine | float:
    """The machine, or a fixed score if there are not both labels to learn from."""
    sample = training_sample(documents, labels, per_class)
    rows = written(sample.mapInArrow(_termed, _TERMED), "toxic-terms")
    counts = {r.toxic: r.rows for r in rows.groupBy("toxic").agg(F.count("*").alias("rows")).collect()}
    positive, negative = counts.get(1, 0), counts.get(0, 0)
    if not positive or not negative:
        return 1.0 if positive else 0.0
    known = vocabulary(rows, positive, negative, size)
    if not known:
        return positive / (positive + negative)
    placed = rows.mapInArrow(_placed(known), "number bigint, toxic int, places array<bigint>")
    fitted = placed.groupBy(F.lit("all")).applyInPandas(_fit(len(known), factors), "bias double, w binary, v binary").first()
    return Machine(known, fitted.bias, np.frombuffer(fitted.w), np.frombuffer(fitted.v).reshape(len(known), factors))


# --- scoring --------------------------------------------------------------------
SCORED = "doc_id bigint, held_out boolean, score double, predicted int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def _score(machine: Machine | float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                ids, held, texts = batch.slice(low, 256).columns
                if isinstance(machine, Machine):
                    scores = [machine.score(t) for t in texts.to_pylist()]
                else:
                    scores = [machine] * len(ids)
                predicted = [int(s >= 0.5) for s in scores]
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(scores, pa.float64()), pa.array(predicted, pa.int32())], schema=_ARROW)

    return run


def score_toxicity(documents: DataFrame, labels: DataFrame, machine: Machine | float | None = None) -> DataFrame:
    """Score of every document, from its text alone."""
    machine = train(documents, labels) if machine is None else machine
    narrow = documents.select(F.col("doc_id").cast("bigint"), held_out().alias("held_out"), "text")
    return narrow.mapInArrow(_score(machine), SCORED)
