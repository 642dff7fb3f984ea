"""MinHash near-dedup with min-max hashing: both the smallest and the largest value under every
permutation are kept, so half the permutations give a signature of the same size, unbiased and
with less variance.

A document is the set of its distinct shingles of `words` words (A-Z lower-cased; a shorter text is
one shingle, a text without words is empty and links with nothing). Documents of equal sets are one
class, with its smallest id as representative; only representatives are compared. Signatures of 80
permutations are cut into 32 bands of 5 values, each band mixing minima and maxima of different
permutations; a pair of similarity 0.8 shares no band with a chance below 1 in 100,000.

A group of near copies may fill a bucket with any number of documents, so pairs in a bucket are
never listed as a whole. Links are confirmed on the full sets in three rounds, each over what the
last one left open:
  1. each representative with the smallest one it shares a bucket with,
  2. with the smallest one of each of its buckets, where the two are not connected yet,
  3. in buckets that still hold several components: every member outside the largest of them with
     every member of another component. Such members and buckets are cut into chunks, and a task
     counts what one chunk of each shares through an inverted index of the first; it returns at
     most one link for each member and component.
After that every pair that shares a bucket has been confirmed or refuted or is connected anyway:
no cap, and no link lost that would join two components. Sizes that differ too much rule a pair
out exactly.

Shingles are compared by 64-bit hashes. Rows without doc_id are linked with nothing, component null,
kept; rows that share a doc_id are one document in what they link. Null text is empty. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sliced, written
from tidemark.llm.components import components

PERMUTATIONS = 80
BANDS = 32
SIMILAR = 80  # percent

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, np.bool_)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_RNG = np.random.default_rng(1999)
_MULTIPLY = (_RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64) | _U64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)
_PLACES = _RNG.integers(0, 1 << 62, 64, dtype=np.uint64) * _U64(2) + _U64(1)


def _stirred(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U64(33))
    x = x * _U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U64(33))
    x = x * _U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U64(33))


class Shingles:
    """Distinct shingle hashes of texts, by array operations over their bytes."""

    def __init__(self, words: int):
        self.words = words
        self.powers = np.ones(1, _U64)
        self.inverses = np.ones(1, _U64)

    def _grow(self, size: int) -> None:
        if size > len(self.powers):
            size = max(size, 2 * len(self.powers))
            for name, base in (("powers", _BASE), ("inverses", _INVERSE)):
                steps = np.full(size, _U64(base))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def of(self, raw: bytes | None) -> np.ndarray:
        """Sorted distinct hashes of a text in UTF-8."""
        data = np.frombuffer((raw or b"").lower(), np.uint8)
        inside = ~_SPACE[data]
        edges = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        if not len(starts):
            return np.empty(0, _U64)
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, _U64)
        np.cumsum((data.astype(_U64) + _U64(1)) * self.powers[: len(data)], out=sums[1:])
        word = (sums[ends] - sums[starts]) * self.inverses[starts]
        word = _stirred(word ^ ((ends - starts).astype(_U64) * _U64(0xD6E8FEB86659FD93)))
        width = min(self.words, len(word))
        mixed = np.zeros(len(word) - width + 1, _U64)
        for place in range(width):
            mixed += word[place : place + len(mixed)] * _PLACES[place]
        # A text shorter than a shingle must not equal a part of one.
        return np.unique(_stirred(mixed + _U64(width)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima, then maxima, under each permutation of the upper halves of the hashes."""
    upper = (shingles >> _U64(32)).astype(np.uint32)
    low = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    for at in range(0, len(upper), 1024):
        values = upper[at : at + 1024, None] * _MULTIPLY[None, :] + _ADD[None, :]
        values ^= values >> np.uint32(16)
        np.minimum(low, values.min(axis=0), out=low)
        np.maximum(high, values.max(axis=0), out=high)
    return np.concatenate([low, high])


def bands(signed: np.ndarray) -> np.ndarray:
    """One key per band; band b takes every 32nd value from the b-th on."""
    rows = signed.reshape(-1, BANDS).astype(_U64)
    keys = (rows * _PLACES[: len(rows), None]).sum(axis=0, dtype=_U64)
    return _stirred(keys + np.arange(BANDS, dtype=_U64) * _PLACES[63]).view(np.int64)


SIGNED = "doc_id bigint, mark bigint, n_shingles bigint, digest binary, bands array<bigint>"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))]
)


def _sign(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingles(words)
        for batch in sliced(batches):
            sizes, digests, keys = [], [], []
            for raw in batch.column(2).to_pylist():
                found = cut.of(raw)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                keys.append(bands(signature(found)) if len(found) else np.empty(0, np.int64))
            at = np.cumsum([0] + [len(k) for k in keys]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.int64), *keys])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
                schema=_ARROW,
            )

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int = SIMILAR) -> bool:
    """Whether two sets reach the similarity; both sorted and distinct."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


_LINKS = "a bigint, b bigint"


def _confirm(words: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingles(words)
        last, hub = None, np.empty(0, _U64)
        for batch in sliced(batches):
            rows = batch.to_pydict()
            out: list[tuple[int, int]] = []
            for a, b, text_a, text_b in zip(rows["a"], rows["b"], rows["text_a"], rows["text_b"], strict=True):
                # Pairs of one hub come together; its set is made once.
                if text_b is not last and text_b != last:
                    last, hub = text_b, cut.of(text_b)
                if similar(cut.of(text_a), hub, percent):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar. Texts are (rep, text)."""
    side = lambda x: texts.select(F.col("rep").alias(x), F.col("text").alias(f"text_{x}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return full.mapInArrow(_confirm(words, percent), _LINKS).distinct()


def _sizes_allow(x: str, y: str, percent: int) -> Column:
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _with_component(members: DataFrame, joined: DataFrame) -> DataFrame:
    mine = joined.select(F.col("node").alias("rep"), "component")
    return members.join(mine, "rep", "left").withColumn("component", F.coalesce("component", "rep"))


#: Rows of a bucket in one chunk.
CHUNK = 512


def _crossing(rows: dict[str, list], cut: Shingles, percent: int) -> list[tuple[int, int]]:
    """Links of one tile between members outside the largest component and members of others."""
    at = {c: np.array(rows[c]) for c in ("rep", "n", "component", "outside", "mine", "among", "l", "r")}
    left = np.flatnonzero(at["outside"] & (at["mine"] == at["l"]))
    right = np.flatnonzero(at["among"] == at["r"])
    n, component = at["n"], at["component"]
    small, large = np.minimum.outer(n[right], n[left]), np.maximum.outer(n[right], n[left])
    asked = (100 * small >= percent * large) & (component[right][:, None] != component[left][None, :])
    left, right, asked = left[asked.any(axis=0)], right[asked.any(axis=1)], asked[asked.any(axis=1)][:, asked.any(axis=0)]
    if not len(left):
        return []
    sets = [cut.of(rows["text"][i]) for i in left]
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(left)), [len(x) for x in sets])
    held = np.concatenate(sets)
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    out: dict[tuple[int, int], int] = {}
    for y, ask in zip(right, asked, strict=True):
        mine = cut.of(rows["text"][y])
        first, last = np.searchsorted(held, mine, "left"), np.searchsorted(held, mine, "right")
        length = last - first
        start = np.repeat(first - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        shared = np.bincount(owner[start + np.arange(len(start))], minlength=len(left))
        good = ask & (100 * shared >= percent * (sizes + len(mine) - shared))
        for x in left[good]:
            out.setdefault((int(at["rep"][x]), int(component[y])), int(at["rep"][y]))
    return [(x, y) for (x, _), y in out.items()]


def _cross(words: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Tiles come as runs of rows; a run may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingles(words)
        held: dict[str, list] = {}
        tile = None
        for batch in batches:
            rows = batch.to_pydict()
            tiles = list(zip(rows["key"], rows["l"], rows["r"], strict=True))
            out: list[tuple[int, int]] = []
            start = 0
            for end in range(1, len(tiles) + 1):
                if end < len(tiles) and tiles[end] == tiles[start]:
                    continue
                if tile != tiles[start]:
                    out += _crossing(held, cut, percent) if held else []
                    held, tile = {c: [] for c in rows}, tiles[start]
                for c, values in rows.items():
                    held[c] += values[start:end]
                start = end
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
        if held:
            out = _crossing(held, cut, percent)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def mixed_links(placed: DataFrame, texts: DataFrame, words: int, percent: int, chunk: int = CHUNK) -> DataFrame:
    """Links across the components of buckets. Rows are (key, rep, n, component).

    Pairs of a bucket of two have been tried as its star. In larger ones, rows whose size no member
    outside the largest component could match are left out first."""
    counted = placed.groupBy("key", "component").agg(
        F.count("*").alias("rows"), F.min("n").alias("low"), F.max("n").alias("high")
    )
    largest = (
        counted.groupBy("key")
        .agg(F.max(F.struct("rows", "component")).alias("m"), F.sum("rows").alias("all"), F.count("*").alias("parts"))
        .where("parts > 1 and all > 2")
        .select("key", F.col("m.component").alias("largest"))
    )
    outside = (
        counted.join(largest, "key")
        .where("component != largest")
        .groupBy("key", "largest")
        .agg(F.sum("rows").alias("out_rows"), F.min("low").alias("low"), F.max("high").alias("high"))
    )
    totals = counted.groupBy("key").agg(F.sum("rows").alias("rows"))
    figures = outside.join(totals, "key").select(
        "key", "largest", "low", "high",
        F.ceil(F.col("out_rows") / chunk).cast("int").alias("lefts"),
        F.ceil(F.col("rows") / chunk).cast("int").alias("rights"),
    )
    fits = (F.col("n") * 100 >= F.col("low") * percent) & (F.col("n") * percent <= F.col("high") * 100)
    mine, among = (F.pmod(F.xxhash64("rep", F.lit(i)), F.col(c)).cast("int") for i, c in ((1, "lefts"), (2, "rights")))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    right = F.transform(upto("lefts"), lambda i: F.struct(i.alias("l"), F.col("among").alias("r")))
    left = F.transform(upto("rights"), lambda j: F.struct(F.col("mine").alias("l"), j.alias("r")))
    tiles = F.when(F.col("outside"), F.array_union(right, left)).otherwise(right)
    rows = (
        placed.join(figures, "key")
        .where(fits)
        .withColumn("outside", F.col("component") != F.col("largest"))
        .withColumn("mine", mine)
        .withColumn("among", among)
        .withColumn("tile", F.explode(tiles))
        .select("key", "tile.*", "rep", "n", "component", "outside", "mine", "among")
    )
    full = rows.join(texts, "rep").repartition("key", "l", "r").sortWithinPartitions("key", "l", "r")
    return full.mapInArrow(_cross(words, percent), _LINKS).distinct()


def _marked(documents: DataFrame) -> DataFrame:
    """(doc_id, mark, text): the mark tells texts of one doc_id apart."""
    return documents.select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))


def _joined(
    reps: DataFrame, texts_of: Callable[[DataFrame], DataFrame], words: int, percent: int, chunk: int
) -> DataFrame:
    """(rep, component) of all representatives with a link. Rows are (rep, n_shingles, bands);
    `texts_of` gives (rep, text) for a table of rep."""
    # Which keys are shared by several representatives, and who shares them.
    keyed = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    hubs = (
        keyed.groupBy("key")
        .agg(F.min(F.struct("rep", "n")).alias("h"), F.max("rep").alias("last"))
        .where("h.rep != last")
        .select("key", F.col("h.rep").alias("hub"), F.col("h.n").alias("hub_n"))
    )
    members = written(keyed.join(hubs, "key"), "minmax-members")
    texts = written(texts_of(members.select("rep").distinct()).distinct(), "minmax-texts")

    star = members.where("rep != hub").where(_sizes_allow("n", "hub_n", percent))
    tried = star.groupBy("rep").agg(F.min("hub").alias("hub")).select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    tried = written(tried, "minmax-tried")
    links = written(confirmed(tried, texts, words, percent), "minmax-links")
    joined = components(links)

    mine = joined.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    open_ = (
        _with_component(star, joined)
        .join(mine, "hub", "left")
        .where(F.col("component") != F.coalesce("hub_component", "hub"))
        .select(F.col("rep").alias("a"), F.col("hub").alias("b"))
        .distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    again = written(open_, "minmax-open")
    more = written(confirmed(again, texts, words, percent), "minmax-more")
    links = links.union(more)
    joined = components(links)

    placed = _with_component(members, joined)
    links = links.union(written(mixed_links(placed, texts, words, percent, chunk), "minmax-last"))
    return components(links).select(F.col("node").alias("rep"), "component")


def link(documents: DataFrame, words: int = 2, percent: int = SIMILAR, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    raw = _marked(documents)
    signed = written(raw.mapInArrow(_sign(words), SIGNED), "minmax-signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    first = classes.select(F.col("digest").alias("class_digest"), "rep")
    reps = (
        full.join(first, (full.digest == F.col("class_digest")) & (full.doc_id == F.col("rep")))
        .dropDuplicates(["rep", "digest"])
        .select("rep", "n_shingles", "bands")
    )

    def texts_of(sharing: DataFrame) -> DataFrame:
        return raw.join(sharing, raw.doc_id == sharing.rep).select("rep", "text")

    joined = _joined(written(reps, "minmax-reps"), texts_of, words, percent, chunk)
    placed = first.join(joined, "rep", "left").select("class_digest", F.coalesce("component", "rep").alias("component"))
    linkable = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest"))
    out = signed.select("doc_id", "n_shingles", linkable.alias("class_digest")).join(placed, "class_digest", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def _same(left: DataFrame, right: DataFrame, mark: str) -> Column:
    """Rows of one doc_id (null like a value) and one text."""
    return left.doc_id.eqNullSafe(right.of_doc) & (left[mark] == right.of_mark)


def representatives(
    documents: DataFrame, words: int = 5, percent: int = SIMILAR, chunk: int = CHUNK
) -> DataFrame:
    """The documents without their near copies, columns as they came.

    Of each group one row stays, of the smallest id (null last; the smallest hash of the text, if an
    id has several texts). Texts are told apart whatever their doc_id: a doc_id with several texts
    loses only those that have a copy, rows without doc_id have copies like others. Of rows with one
    doc_id and one text, one stays; which of their other columns stay is open. Texts without words
    all stay. Columns of any name may be there."""
    raw = _marked(documents)
    signed = written(raw.mapInArrow(_sign(words), SIGNED), "minmax-signed")
    full = signed.where("n_shingles > 0")
    first = full.groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("anonymous"), "doc_id", "mark")).alias("first")
    )
    # Classes are numbered; stored, so that the numbers stay.
    classes = written(
        first.select(
            F.col("digest").alias("class_digest"), "first", F.col("first.doc_id").alias("of_doc"),
            F.col("first.mark").alias("of_mark"), F.monotonically_increasing_id().alias("rep"),
        ),
        "minmax-classes",
    )
    reps = (
        full.join(classes, (full.digest == classes.class_digest) & _same(full, classes, "mark"))
        .dropDuplicates(["rep"])
        .select("rep", "n_shingles", "bands")
    )

    def texts_of(sharing: DataFrame) -> DataFrame:
        wanted = classes.join(sharing, "rep").select("rep", "of_doc", "of_mark")
        return raw.join(wanted, _same(raw, wanted, "mark")).select("rep", "text")

    joined = _joined(written(reps, "minmax-reps"), texts_of, words, percent, chunk)
    groups = classes.join(joined, "rep", "left").groupBy(F.coalesce("component", "rep").alias("component"))
    winners = groups.agg(F.min("first").alias("first")).select(
        F.col("first.doc_id").alias("of_doc"), F.col("first.mark").alias("of_mark"), F.lit(True).alias("wins")
    )
    counts = full.groupBy("doc_id", "mark").agg(F.count("*").alias("rows"))
    decided = counts.join(winners, _same(counts, winners, "mark"), "left").select(
        F.col("doc_id").alias("of_doc"), F.col("mark").alias("of_mark"), "rows", F.coalesce("wins", F.lit(False)).alias("wins")
    )
    decided = written(decided.where("rows > 1 or not wins"), "minmax-decided")

    mark = "mark"
    while mark in documents.columns:
        mark += "_"
    own = documents.withColumn(mark, F.xxhash64("text"))
    single = own.join(decided, _same(own, decided, mark), "left_anti")
    repeated = decided.where("wins")
    several = own.join(repeated, _same(own, repeated, mark), "left_semi").dropDuplicates(["doc_id", mark])
    return single.union(several).drop(mark)
