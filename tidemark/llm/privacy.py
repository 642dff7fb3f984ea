"""Personal data, and the terms that give it away.

Base spans (e-mail, IP, card, phone) come from patterns and checks. The method is information-
theoretic: over the different texts of the corpus (copies of a text are one), the terms that stand
in a text together with a protected value are counted, and the pointwise mutual information of a
term and a value, as a share of the value's own information,

    disclosure = log2(P(value | term) / P(value)) / -log2(P(value)),

tells how far the term alone reveals the value: P(value | term) is the share of the texts with the
term that hold the value as well, P(value) the share of all texts that do. Terms that stand with a
value in at least `MIN_CONTEXTS` different texts and have a disclosure of `THRESHOLD` or more are
spans of kind `term` wherever they stand, in texts without the value too; masking generalises them
as it does the value. What lies inside a base span is masked anyway and is no term.

A first pass over the texts writes spans, and values and terms of texts with values. Sums by value
and term leave the candidates; a second pass writes where these stand in all texts, of which both
their full counts and their spans are taken. A bitmap of hashes spares that pass most other terms,
a join removes the rest. Nothing is gathered by value or term beyond sums.

Null text counts as empty; doc_id may be null or repeated; each row of the input gives one row.
Patterns are matched so that long runs of one character class take linear time.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches_of, joined, sliced, written

KINDS = ("email", "ip", "card", "phone", "term")
#: One text says nothing beyond itself: each word that stands in it alone has a disclosure of 1.
MIN_CONTEXTS = 2
THRESHOLD = 0.9
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}

#: The patterns of the contract. Possessive runs that start where a run starts match
#: the same leftmost spans.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bits of the map of candidate terms, by crc32.
TERM_BITS = 1 << 22
_LOCAL_CHARACTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HAS_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, str, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every "@" with the run of local characters before it, not reaching into the last match."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARACTERS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        n = int(d) * (1 + place % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns as (start, rank of kind, kind, end)."""
    found: list[Span] = [(a, 0, "email", b) for a, b in _emails(text)]
    if not _HAS_DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            found.append((m.start(), 1, "ip", m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, "phone", m.end()))
    return found


def terms_outside(text: str, spans: list[Span]) -> Iterator[re.Match]:
    """The terms of a text that no base span overlaps."""
    taken = sorted((a, b) for a, _, _, b in spans)
    at, upto = 0, 0
    for m in _TERM.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            upto = max(upto, taken[at][1])
            at += 1
        if upto <= m.start():
            yield m


def _digest(value: str) -> bytes:
    return hashlib.blake2b(value.encode("utf-8", "replace"), digest_size=16).digest()


_SPAN = "array<struct<start: bigint, rank: int, kind: string, end: bigint>>"
FOUND = (
    "doc_id bigint, text_key bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, "
    f"base_sha256 string, base {_SPAN}, row bigint, values array<binary>, terms array<string>"
)
_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "text_key", "n_email", "n_ip", "n_card", "n_phone")]
    + [
        ("base_sha256", pa.string()),
        ("base", pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64())]))),
        ("row", pa.int64()),
        ("values", pa.list_(pa.binary())),
        ("terms", pa.list_(pa.string())),
    ]
)
PLACES = "doc_id bigint, text_key bigint, term string, starts array<bigint>"
_ARROW_PLACES = pa.schema(
    [("doc_id", pa.int64()), ("text_key", pa.int64()), ("term", pa.string()), ("starts", pa.list_(pa.int64()))]
)
_NOTHING = hashlib.sha256(b"").hexdigest()


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 40
    for batch in sliced(batches):
        rows = []
        for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            spans = sorted(base_spans(text)) if text else []
            row = {"doc_id": doc_id, "text_key": key, "row": number}
            row |= {f"n_{k}": sum(s[2] == k for s in spans) for k in KINDS[:4]}
            row["base_sha256"] = hashlib.sha256(joined(spans).encode()).hexdigest() if spans else _NOTHING
            row["base"] = [{"start": a, "rank": r, "kind": k, "end": b} for a, r, k, b in spans]
            row["values"] = sorted({_digest(text[a:b]) for a, _, _, b in spans})
            row["terms"] = sorted({m[0] for m in terms_outside(text, spans)}) if spans else []
            rows.append(row)
            number += 1
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def _places(bits: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def marked(term: str) -> bool:
        bit = zlib.crc32(term.encode("utf-8", "replace")) % TERM_BITS
        return bool(bits[bit >> 3] >> (bit & 7) & 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in sliced(batches):
            for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                wanted = {term for term in set(_TERM.findall(text or "")) if marked(term)}
                if not wanted:
                    continue
                starts: dict[str, list[int]] = {}
                for m in terms_outside(text, base_spans(text)):
                    if m[0] in wanted:
                        starts.setdefault(m[0], []).append(m.start())
                for term, at in starts.items():
                    yield {"doc_id": doc_id, "text_key": key, "term": term, "starts": at}

    return lambda batches: batches_of(rows(batches), _ARROW_PLACES, 4096)


def text_key() -> Column:
    """Tells rows of one doc_id apart that differ in text."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _narrow(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", text_key().alias("text_key"), "text")


def find_base(documents: DataFrame) -> DataFrame:
    """Base spans of every document, and values and terms of those that have any; no text goes on."""
    return written(_narrow(documents).mapInArrow(_find, FOUND), "privacy-found")


def term_places(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """Where the given terms (term) stand outside base spans, one row per document and term."""
    bit = F.crc32(F.col("term").cast("binary")) % TERM_BITS
    words = (
        terms.select(bit.alias("bit"))
        .groupBy((F.col("bit") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
        .collect()
    )
    bits = np.zeros(TERM_BITS // 64, "<i8")
    for r in words:
        bits[r.word] = r.bits
    places = _narrow(documents if words else documents.limit(0)).mapInArrow(_places(bits.tobytes()), PLACES)
    return written(places.join(terms, "term", "left_semi"), "privacy-places")


def _disclosure(occurrences: str) -> Column:
    prior = F.col("n_value") / F.greatest(F.col("n_texts"), F.col("n_value") + 1)
    share = F.least(F.col("n_joint") / F.col(occurrences), F.lit(1.0))
    return F.log2(share / prior) / -F.log2(prior)


def candidate_pairs(
    found: DataFrame, min_contexts: int = MIN_CONTEXTS, threshold: float = THRESHOLD
) -> DataFrame:
    """(value, term) with their counts that may be above the threshold, by texts with values only."""
    n_texts = found.select("text_key").distinct().count()
    # One row stands for all copies of a text.
    held = (
        found.select("row", "text_key", F.explode("values").alias("value"))
        .groupBy("text_key", "value")
        .agg(F.min("row").alias("row"))
    )
    held = written(held, "privacy-held")
    values = held.groupBy("value").agg(F.count("*").alias("n_value")).where(F.col("n_value") >= min_contexts)
    terms = found.where(F.size("values") > 0).select("row", "terms")
    pairs = (
        terms.join(held.join(values, "value"), "row")
        .select("value", "n_value", F.explode("terms").alias("term"))
        .groupBy("value", "n_value", "term")
        .agg(F.count("*").alias("n_joint"))
        .where(F.col("n_joint") >= min_contexts)
        .withColumn("n_texts", F.lit(n_texts))
    )
    # A term stands in at least as many texts as in texts with values: what falls short by that
    # count does so by the full one, and words used everywhere need not be looked up.
    nearby = (
        terms.join(held.select("row").distinct(), "row", "left_semi")
        .select(F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n_near"))
    )
    return written(pairs.join(nearby, "term").where(_disclosure("n_near") >= threshold), "privacy-pairs")


def _revealed(
    documents: DataFrame, found: DataFrame, min_contexts: int, threshold: float
) -> tuple[DataFrame, DataFrame]:
    """The terms above the threshold, and the places of all candidates."""
    pairs = candidate_pairs(found, min_contexts, threshold)
    places = term_places(documents, pairs.select("term").distinct())
    counts = places.select("term", "text_key").distinct().groupBy("term").agg(F.count("*").alias("n_term"))
    terms = (
        pairs.join(counts, "term")
        .withColumn("disclosure", _disclosure("n_term"))
        .where(F.col("disclosure") >= threshold)
        .select("value", "term", "disclosure")
    )
    return written(terms, "privacy-terms"), places


def revealing_terms(
    documents: DataFrame,
    found: DataFrame,
    min_contexts: int = MIN_CONTEXTS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(value, term, disclosure) of the terms above the threshold."""
    return _revealed(documents, found, min_contexts, threshold)[0]


def all_spans(
    documents: DataFrame, min_contexts: int = MIN_CONTEXTS, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document: base counts and digest, and `all` spans, terms among them."""
    found = find_base(documents)
    terms, places = _revealed(documents, found, min_contexts, threshold)
    end = F.length("term")
    spans = F.transform(
        "starts",
        lambda at: F.struct(at.alias("start"), F.lit(4).alias("rank"), F.lit("term").alias("kind"), (at + end).alias("end")),
    )
    # Repeated rows have the same places.
    more = (
        places.join(terms.select("term").distinct(), "term", "left_semi")
        .groupBy(F.col("doc_id").alias("more_id"), F.col("text_key").alias("more_key"))
        .agg(F.flatten(F.collect_set(spans)).alias("more"))
    )
    same = found.doc_id.eqNullSafe(F.col("more_id")) & (found.text_key == F.col("more_key"))
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPAN))))
    return found.join(more, same, "left").withColumn("all", every)


def _joined(spans: str) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def find_private(
    documents: DataFrame, min_contexts: int = MIN_CONTEXTS, threshold: float = THRESHOLD
) -> DataFrame:
    """Counts, digest of the base spans, and all spans of every document."""
    return all_spans(documents, min_contexts, threshold).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", _joined("all").alias("spans")
    )


def masked(
    documents: DataFrame, min_contexts: int = MIN_CONTEXTS, threshold: float = THRESHOLD
) -> DataFrame:
    """The documents with every span generalised to its kind; overlapping spans become one.
    Texts without spans come as they are, and so do all other columns."""
    spans = (
        all_spans(documents, min_contexts, threshold)
        .where(F.size("all") > 0)
        .select(
            F.col("doc_id").alias("_pii_id"), F.col("text_key").alias("_pii_key"), F.col("all").alias("_pii")
        )
        .dropDuplicates(["_pii_id", "_pii_key"])
    )
    names = F.create_map(*[F.lit(x) for pair in MASKS.items() for x in pair])
    # From left to right: what stands before the span, then its mask; overlapped starts are passed.
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("upto"))
    done = F.aggregate(
        "_pii",
        start,
        lambda acc, s: F.when(s["start"] < acc["upto"], F.struct(acc["out"].alias("out"), F.greatest(acc["upto"], s["end"]).alias("upto"))).otherwise(
            F.struct(
                F.concat(acc["out"], F.substring(F.col("text"), acc["upto"].cast("int") + 1, (s["start"] - acc["upto"]).cast("int")), names[s["kind"]]).alias("out"),
                s["end"].alias("upto"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["upto"].cast("int") + 1, F.length("text"))),
    )
    same = documents.doc_id.eqNullSafe(F.col("_pii_id")) & (text_key() == F.col("_pii_key"))
    return documents.join(spans, same, "left").select(
        *[F.when(F.col("_pii").isNull(), F.col("text")).otherwise(done).alias("text") if c == "text" else c for c in documents.columns]
    )
