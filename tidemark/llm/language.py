"""Language identification by hierarchical discrimination.

First the language family is predicted, by one-versus-rest linear support vector machines; then
one-versus-one machines, trained on nothing but the languages of that family, separate its members
(the one with the most votes wins, summed margins break ties). Features are hashed counts of three
consecutive UTF-8 bytes of the whole text, in lower case, as square roots on the unit sphere.

Training takes a bounded sample: `PER_LANGUAGE` labelled documents of each language, the first in the
order of a hash of their id, so the model costs the same over any amount of text. Each machine is one
task over at most `PER_SIDE` documents a side. What reaches the driver is the model: one weight
vector per family and per pair of languages in a family, and the number of labelled rows of each
language.

Text null or without a letter is `und` with score 0. Languages outside the table of families are a
family each. With one language only, everything with a letter is that language, score 1; without
labels everything is `und`. lang null is not learned. Rows are predicted one by one, so repeated
rows agree; doc_id may be null.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import crc_bucket

#: Languages that are closely related, by family (ISO 639-1).
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fo fy lb yi",
    "romance": "fr es pt it ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "finnic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indo-aryan": "hi ur bn pa gu mr ne si",
    "iranian": "fa ps ku tg",
    "semitic": "ar he am mt",
    "dravidian": "ta te kn ml",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
UNKNOWN = "und"

DIMENSIONS = 8192
PER_LANGUAGE = 400
PER_SIDE = 800
STEPS = 120
RIDGE = 1e-4


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.split("-")[0].lower(), lang)


_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Hashed byte trigrams of the whole text, with a space on either side."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    mixed = raw[:-2] * np.uint32(0x9E3779B1)
    mixed += raw[1:-1] * np.uint32(0x85EBCA77)
    mixed ^= mixed >> np.uint32(15)
    mixed += raw[2:] * np.uint32(0xC2B2AE3D)
    counts = np.bincount(mixed >> np.uint32(19), minlength=DIMENSIONS)
    roots = np.sqrt(counts.astype(np.float32))
    return roots / max(float(np.linalg.norm(roots)), 1e-9)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(crc_bucket(doc_id), F.lit(4)) == 2


def labelled(documents: DataFrame) -> DataFrame:
    """What may be learned from: labelled rows outside the held-out quarter."""
    return documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())


def training_sample(
    documents: DataFrame, rows_of: dict[str, int], per_language: int = PER_LANGUAGE
) -> DataFrame:
    """(lang, place, text): a bounded number of labelled documents of each language.

    A threshold on a hash, by the number of rows of the language, thins out on the scan; only about
    twice the wanted number of documents is sent and ranked."""
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30))
    share = {lang: int((1 << 30) * min(1.0, (2 * per_language + 100) / n)) for lang, n in rows_of.items()}
    below = F.lit(False)
    for most in sorted(set(share.values())):
        below |= F.col("lang").isin([x for x, m in share.items() if m == most]) & (draw <= most)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))
    return (
        labelled(documents)
        .where(below)
        .select("lang", "text", draw.alias("draw"))
        .withColumn("place", rank)
        .where(F.col("place") <= per_language)
        .select("lang", "place", "text")
    )


_SAMPLE = "lang string, place bigint, features binary"
_SAMPLE_ARROW = pa.schema([("lang", pa.string()), ("place", pa.int64()), ("features", pa.binary())])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, places, texts = (c.to_pylist() for c in batch.columns)
        rows = [
            {"lang": lang, "place": place, "features": features(text).astype(np.float16).tobytes()}
            for lang, place, text in zip(langs, places, texts, strict=True)
            if has_letter(text)
        ]
        yield pa.RecordBatch.from_pylist(rows, _SAMPLE_ARROW)


def train_svm(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Linear machine with squared hinge loss and intercept, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    # Both sides weigh the same, however many documents they have.
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    step = np.float32(1.0 / (4.0 + RIDGE))
    w = ahead = np.zeros(x.shape[1], np.float32)
    for t in range(STEPS):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        gradient = RIDGE * ahead - 2 * (x.T @ (weight * slack * y))
        new = ahead - step * gradient
        ahead = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w


def _train(group: pd.DataFrame) -> pd.DataFrame:
    first = group.iloc[0]
    x = np.stack([np.frombuffer(f, np.float16) for f in group["features"]]).astype(np.float32)
    y = group["side"].to_numpy(np.float32)
    w = train_svm(x, y)
    return pd.DataFrame([{"problem": first["problem"], "weights": w.astype(np.float32).tobytes()}])


class Model:
    """Weights of the machines; families and languages in order of name."""

    def __init__(self, languages: list[str], weights: dict[str, np.ndarray]):
        self.languages = sorted(languages)
        self.members: dict[str, list[str]] = {}
        for lang in self.languages:
            self.members.setdefault(family_of(lang), []).append(lang)
        self.families = sorted(self.members)
        self.family_names = [f for f in self.families if f"family {f}" in weights]
        self.pairs = [p for p in _pairs(self.languages) if f"pair {p[0]} {p[1]}" in weights]
        rows = [weights[f"family {f}"] for f in self.family_names]
        rows += [weights[f"pair {a} {b}"] for a, b in self.pairs]
        self.matrix = np.stack(rows) if rows else np.zeros((0, DIMENSIONS + 1), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        margins = self.matrix[:, :-1] @ features(text) + self.matrix[:, -1]
        family, score = self.families[0], 1.0
        if self.family_names:
            best = int(np.argmax(margins[: len(self.family_names)]))
            family, score = self.family_names[best], _chance(margins[best])
        votes = {lang: [0, 0.0] for lang in self.members[family]}
        sure = 1.0
        for (a, b), margin in zip(self.pairs, margins[len(self.family_names) :], strict=True):
            if a in votes and b in votes:
                votes[a if margin >= 0 else b][0] += 1
                votes[a][1] += float(margin)
                votes[b][1] -= float(margin)
        lang = max(votes, key=lambda x: (votes[x][0], votes[x][1]))
        for (a, b), margin in zip(self.pairs, margins[len(self.family_names) :], strict=True):
            if lang in (a, b) and a in votes and b in votes:
                sure = min(sure, _chance(margin if a == lang else -margin))
        return lang, min(1.0, max(0.0, score * sure))


def _chance(margin: float) -> float:
    return float(1 / (1 + np.exp(-4 * np.clip(margin, -10, 10))))


def _pairs(languages: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for a, b in itertools.combinations(sorted(languages), 2) if family_of(a) == family_of(b)]


def train(documents: DataFrame, per_language: int = PER_LANGUAGE, per_side: int = PER_SIDE) -> Model:
    """Train every machine as a task of its own, on a bounded sample."""
    spark = documents.sparkSession
    narrow = documents.select("doc_id", "text", "lang")
    counts = labelled(narrow).groupBy("lang").agg(F.count("*")).collect()
    languages = sorted(r[0] for r in counts)
    sample = training_sample(narrow, {r[0]: r[1] for r in counts}, per_language)
    rows = sample.mapInArrow(_featured, _SAMPLE)
    members: dict[str, list[str]] = {}
    for lang in languages:
        members.setdefault(family_of(lang), []).append(lang)
    # Which documents a machine is trained on: (problem, lang, side, how many of that language).
    uses = []
    if len(members) > 1:
        for family, inside in members.items():
            outside = [x for x in languages if x not in inside]
            uses += [(f"family {family}", x, 1, max(1, per_side // len(inside))) for x in inside]
            uses += [(f"family {family}", x, -1, max(1, per_side // len(outside))) for x in outside]
    for a, b in _pairs(languages):
        uses += [(f"pair {a} {b}", a, 1, per_side), (f"pair {a} {b}", b, -1, per_side)]
    weights = {}
    if uses:
        wanted = spark.createDataFrame(uses, "problem string, lang string, side int, most long")
        parts = rows.join(F.broadcast(wanted), "lang").where(F.col("place") <= F.col("most"))
        trained = parts.groupBy("problem").applyInPandas(_train, "problem string, weights binary")
        weights = {r[0]: np.frombuffer(r[1], np.float32) for r in trained.collect()}
    return Model(languages, weights)


PREDICTED = "doc_id bigint, held_out boolean, lang_pred string, score double"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]
)


def _predict(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, texts = batch.columns
            found = [model.predict(t) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [ids, held, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                schema=_ARROW,
            )

    return run


def identify(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """Predicted language and score of every document, from its text alone."""
    model = model or train(documents)
    narrow = documents.select(F.col("doc_id").cast("bigint"), held_out().alias("held_out"), "text")
    return narrow.mapInArrow(_predict(model), PREDICTED)


def with_language(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents whose text has a language, with the predicted one in `lang`, other columns as
    they came: those that are `und` go."""
    model = model or train(documents)

    def tell(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model.predict(t)[0])

    # Not taken into the filter, where it would run a second time.
    predicted = F.pandas_udf(tell, "string").asNondeterministic()
    return documents.withColumn("lang", predicted(F.col("text"))).where(F.col("lang") != UNKNOWN)
