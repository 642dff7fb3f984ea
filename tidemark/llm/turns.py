"""Repair of conversation structure by Four-Russians block tables.

A conversation is well formed if the initials of its roles give (s?(ua)+)?: perhaps a system turn,
then user and assistant in turn, or nothing at all. The cheapest edits that get there are found by
dynamic programming over four states (nothing yet, after system, after user, after assistant):

    K keep 0, R change the role to user or assistant 3, D delete 4, I insert an empty turn 3;

blank and repeated turns must be deleted, and an undeleted truncated turn costs 3 more. Of equally
cheap edits the least sequence of letters in ASCII order wins.

Costs to go, one for each state, differ by little, so normalised (least one 0) they take few
values: their vectors are numbered. A table gives, for every vector to the right of every block of
`BLOCK` symbols, the vector to its left; long runs of turns take one lookup a block. What a stretch of
turns does to all vectors is one small map, so stretches of a conversation are worked through apart
and joined by their maps. Then each block is expanded backward, from the vector on its right, and the
letters are read off forward: at each state the least letter that is still cheapest, which no tie can
mislead.

Turns of a conversation are ordered by turn (nulls first), role and text; equal rows are counted, not
listed. Segments of at most `SEGMENT` turns and about `BYTES` of text are the unit of all work, so a
conversation of any length is spread over tasks. Only replaying the edits takes a conversation's
segments one after the other, one at a time, since its digest (SHA-256) is a chain; its letters are
one value, so 2^31 of them at most.

Null conv_id is a conversation of its own; null role and text are one space, so such a text is blank
and such a role matches none. Texts are used whole. Other columns, of any name, are not read. An empty
table gives no row; a conversation that damage has emptied gives zeros, no letters and the hash of
nothing. `gaps` is null where it does not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Symbols that a table looks up at once.
BLOCK = 3
SEGMENT = 4096
BYTES = 4 << 20

#: Costs of the edits.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

_BLANKS = " \t\n\x0b\x0c\r"
_EMPTY, _SYSTEM, _USER, _ASSISTANT = range(4)
#: State after a user or an assistant turn is put in, whichever fits.
_THEN = (_USER, _USER, _ASSISTANT, _USER)
_ROLES = ("user", "user", "assistant", "user")
_LEGAL = ("su", "ua", "au")

#: Symbol 0 must be deleted; 1 + 2 * (place in "sua", 3 for others) + 1 if truncated.
SYMBOLS = 9


def symbol(role: str, truncated: bool) -> int:
    place = "sua".find(role[:1]) if role else 3
    return 1 + 2 * (place if place >= 0 else 3) + truncated


def moves(sym: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of a turn, in ASCII order."""
    out = [("D", DELETE, state)]
    if sym == 0:
        return out
    kind, extra = (sym - 1) // 2, TRUNCATED * ((sym - 1) % 2)
    after = {0: _SYSTEM, 1: _USER, 2: _ASSISTANT}.get(kind)
    allowed = {_SYSTEM: (_EMPTY,), _USER: (_EMPTY, _SYSTEM, _ASSISTANT), _ASSISTANT: (_USER,)}
    if after is not None and state in allowed[after]:
        out.append(("K", KEEP + extra, after))
    out.append(("R", REROLE + extra, _THEN[state]))
    return out


def _inserted(costs: list[int]) -> tuple[int, ...]:
    """Costs to go if empty turns may be put in first."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[_THEN[state]]) for state, c in enumerate(costs)]
    return tuple(costs)


class Tables:
    """Numbered vectors of costs to go, and what symbols and blocks do to them."""

    def __init__(self, block: int = BLOCK):
        far = 100
        self.final = 0
        self.vectors = [_inserted([0, far, far, 0])]
        number = {self.vectors[0]: 0}
        step: list[list[int]] = []
        edits: list[list[list[tuple[str, int]]]] = []
        while len(step) < len(self.vectors):
            right = self.vectors[len(step)]
            step.append([])
            edits.append([])
            for sym in range(SYMBOLS):
                taken = [min(cost + right[after] for _, cost, after in moves(sym, s)) for s in range(4)]
                whole = _inserted(taken)
                left = tuple(c - min(whole) for c in whole)
                if left not in number:
                    number[left] = len(self.vectors)
                    self.vectors.append(left)
                step[-1].append(number[left])
                edits[-1].append([self._letters(sym, s, whole, right) for s in range(4)])
        #: step[vector to the right][symbol]: vector to the left.
        self.step = step
        #: edits[vector to the right][symbol][state]: letters up to this turn's, and the state after it.
        self.edits = edits
        self.block = block
        self.size = len(step)
        one = np.array(step, np.int16)
        #: whole[code of a block, vector to the right]: vector to the left.
        whole = np.arange(self.size, dtype=np.int16)[None, :]
        for _ in range(block):
            # A symbol in front of each block known so far.
            whole = np.stack([one[whole, sym] for sym in range(SYMBOLS)]).reshape(-1, self.size)
        self.whole = whole
        self.powers = SYMBOLS ** np.arange(block - 1, -1, -1)

    @staticmethod
    def _letters(sym: int, state: int, whole: tuple[int, ...], right: tuple[int, ...]) -> tuple[str, int]:
        """The least letters among the cheapest, from the true costs on both sides."""
        letters = ""
        while True:
            cheap = {x: after for x, cost, after in moves(sym, state) if cost + right[after] == whole[state]}
            if INSERT + whole[_THEN[state]] == whole[state]:
                cheap["I"] = _THEN[state]
            least = min(cheap)
            letters += least
            state = cheap[least]
            if least != "I":
                return letters, state

    def codes(self, symbols: bytes) -> np.ndarray:
        """Numbers of the full blocks from the start on."""
        full = len(symbols) // self.block * self.block
        return np.frombuffer(symbols, np.uint8)[:full].reshape(-1, self.block).astype(np.int64) @ self.powers

    def through(self, symbols: bytes) -> list[int]:
        """For each vector to the right of the symbols, the one to their left."""
        codes = self.codes(symbols)
        at = np.arange(self.size)
        for sym in reversed(symbols[len(codes) * self.block :]):
            at = np.array([self.step[v][sym] for v in at])
        for code in codes[::-1].tolist():
            at = self.whole[code, at]
        return at.tolist()

    def trace(self, symbols: bytes, right: int, states: tuple[int, ...]) -> tuple[list[int], list[str]]:
        """State after the symbols and letters, for each state before them."""
        codes, block = self.codes(symbols), self.block
        tail = [right]
        for sym in reversed(symbols[len(codes) * block :]):
            tail.append(self.step[tail[-1]][sym])
        bounds = [tail[-1]]  # vectors right of each block, from the last one
        for code in codes[:0:-1].tolist():
            bounds.append(int(self.whole[code, bounds[-1]]))
        ends, audits = list(states), [[] for _ in states]

        def read(part: bytes, vectors: list[int]) -> None:
            for sym, vector in zip(part, reversed(vectors), strict=True):
                edits = self.edits[vector][sym]
                for i, state in enumerate(ends):
                    letters, ends[i] = edits[state]
                    audits[i].append(letters)

        for place in range(len(codes)):
            part = symbols[place * block : (place + 1) * block]
            vectors = [bounds[len(codes) - 1 - place]]
            for sym in part[:0:-1]:  # the block expanded backward
                vectors.append(self.step[vectors[-1]][sym])
            read(part, vectors)
        read(symbols[len(codes) * block :], tail[:-1])
        return ends, ["".join(x) for x in audits]


#: Turns put in at the end, by state.
_LAST = ("", "II", "I", "")


# --- rows -----------------------------------------------------------------------
def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows dropped, emptied, without ends, doubled or given the
    role user, as a checksum of conv_id and turn says."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.pmod(F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))), F.lit(20))
    text = text_of("text")
    return (
        conversations.select("conv_id", "turn", text_of("role").alias("role"), text.alias("text"), code.alias("code"))
        .where("code != 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
            F.when(F.col("code") == 3, 2).otherwise(1).cast("bigint").alias("copies"),
        )
    )


def counted(rows: DataFrame) -> DataFrame:
    """Different rows of each conversation with their number. Rows are (conv_id, turn, role, text) and,
    perhaps, copies; `conv` is conv_id as text, never null."""
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")
    narrow = rows.select(conv, F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), *filled, copies.alias("copies"))
    return narrow.groupBy("conv", "conv_id", "turn", "role", "text").agg(F.sum("copies").cast("bigint").alias("copies"))


def faults(grouped: DataFrame) -> DataFrame:
    """The counted rows with `blank`, `seen` (role and text stand in an earlier turn) and `truncated`."""
    mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    marked = grouped.withColumn("mark", F.unhex(mark))
    several = (
        marked.groupBy("conv", "mark")
        .agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("rows"))
        .where("rows > 1")
        .select("conv", "mark", "first")
    )
    bare = F.rtrim("text", F.lit(_BLANKS))
    seen = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    return (
        marked.join(several, ["conv", "mark"], "left")
        .withColumn("blank", bare == "")
        .withColumn("seen", seen)
        .withColumn("truncated", ~F.substring(bare, -1, 1).isin(".", "!", "?"))
        .select("conv", "conv_id", "turn", "role", "text", "copies", "blank", "seen", "truncated")
    )


# --- segments -------------------------------------------------------------------
SEGMENTS = (
    "conv string, conv_id bigint, segment bigint, symbols binary, roles array<string>, texts array<string>, "
    "through array<int>, head string, tail string, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
)
_SEGMENTS_ARROW = pa.schema(
    [("conv", pa.string()), ("conv_id", pa.int64()), ("segment", pa.int64()), ("symbols", pa.binary())]
    + [("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("through", pa.list_(pa.int32()))]
    + [("head", pa.string()), ("tail", pa.string())]
    + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")]
)


class _Segment:
    def __init__(self, conv: str, conv_id: int | None):
        self.row = {"conv": conv, "conv_id": conv_id, "roles": [], "texts": [], "head": None, "tail": None}
        self.row |= dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.symbols = bytearray()
        self.bytes = 0

    def add(self, sym: int, count: int, initial: str) -> None:
        row = self.row
        if row["head"] is None:
            row["head"] = initial
        elif row["tail"] + initial not in _LEGAL:
            row["illegal"] += 1
        row["illegal"] += count - 1
        row["tail"] = initial
        self.symbols += bytes([sym]) * count

    def full(self, most: int) -> bool:
        return len(self.symbols) >= most or self.bytes >= BYTES


def _cut(most: int, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Segments of rows that come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(block)
        number = TaskContext.get().partitionId() << 32
        done: list[dict] = []
        held = 0
        open_: _Segment | None = None

        def close(segment: _Segment) -> None:
            nonlocal number, held
            symbols = bytes(segment.symbols)
            done.append(segment.row | {"segment": number, "symbols": symbols, "through": tables.through(symbols)})
            number += 1
            held += segment.bytes

        for batch in batches:
            for conv, conv_id, role, text, copies, blank, seen, truncated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if open_ is None or open_.row["conv"] != conv:
                    if open_ is not None:
                        close(open_)
                    open_ = _Segment(conv, conv_id)
                gone = blank or seen
                first = True
                while copies:
                    if open_.full(most):
                        close(open_)
                        open_ = _Segment(conv, conv_id)
                    if first and not gone:
                        open_.add(symbol(role, truncated), 1, role[:1])
                        open_.row["roles"].append(role)
                        open_.row["texts"].append(text)
                        open_.row["truncated"] += truncated
                        open_.bytes += len(role) + len(text)
                        copies -= 1
                    else:
                        count = min(copies, most - len(open_.symbols))
                        open_.add(0, count, role[:1])
                        open_.row["blank" if blank else "duplicate"] += count
                        copies -= count
                    first = False
                if len(done) >= 256 or held >= BYTES:
                    yield pa.RecordBatch.from_pylist(done, _SEGMENTS_ARROW)
                    done.clear()
                    held = 0
        if open_ is not None:
            close(open_)
        if done:
            yield pa.RecordBatch.from_pylist(done, _SEGMENTS_ARROW)

    return run


def _vectors(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The vector right of each segment; those of a conversation come from its last one on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        final = Tables(block).final
        last, at, number = None, final, None
        for batch in batches:
            out: list[tuple[int, int, bool]] = []
            for conv, segment, through in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number is not None:
                    out.append((number, right, conv != last))
                if conv != last:
                    last, at = conv, final
                number, right, at = segment, at, through[at]
            yield _vector_rows(out)
        if number is not None:
            yield _vector_rows([(number, right, True)])

    return run


_VECTORS = "segment bigint, right int, opens boolean"


def _vector_rows(rows: list[tuple[int, int, bool]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["segment", "right", "opens"])


_TRACED = "conv string, segment bigint, ends array<int>, audits array<string>"
_TRACED_ARROW = pa.schema(
    [("conv", pa.string()), ("segment", pa.int64()), ("ends", pa.list_(pa.int32())), ("audits", pa.list_(pa.string()))]
)


def _trace(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Letters of each segment, for each state it may begin in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Tables(block)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                rows = []
                part = batch.slice(low, 256)
                for conv, segment, symbols, right, opens in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    ends, audits = tables.trace(symbols, right, (_EMPTY,) if opens else (0, 1, 2, 3))
                    rows.append({"conv": conv, "segment": segment, "ends": ends, "audits": audits})
                yield pa.RecordBatch.from_pylist(rows, _TRACED_ARROW)

    return run


def _replay(batches: Iterator[pa.RecordBatch], line: Callable[[dict, str, str], None]) -> Iterator[dict | None]:
    """Goes through segments, each after its letters, and calls `line` for every turn that is left;
    gives the totals of each conversation as it ends, and None after each segment."""
    now: dict | None = None
    state, letters_of = _EMPTY, {}

    def put_in(letters: str) -> None:
        nonlocal state
        now["audit"].append(letters)
        for _ in letters:
            line(now, _ROLES[state], "")
            now["cost"] += INSERT
            state = _THEN[state]

    def begin(row: dict) -> dict:
        return {"conv": row["conv"], "conv_id": row["conv_id"], "audit": [], "cost": 0, "tail": None} | dict.fromkeys(
            ("blank", "duplicate", "truncated", "illegal"), 0
        )

    for batch in batches:
        for low in range(0, batch.num_rows, 16):
            for row in batch.slice(low, 16).to_pylist():
                if row["kind"] == 0:
                    letters_of = row
                    continue
                if now is None or now["conv"] != row["conv"]:
                    if now is not None:
                        put_in(_LAST[state])
                        yield now
                    now, state = begin(row), _EMPTY
                elif now["tail"] + row["head"] not in _LEGAL:
                    now["illegal"] += 1
                now["tail"] = row["tail"]
                for c in ("blank", "duplicate", "truncated", "illegal"):
                    now[c] += row[c]
                audit = letters_of["audits"][state if len(letters_of["audits"]) > 1 else 0]
                now["audit"].append(audit)
                symbols, turns = iter(row["symbols"]), zip(row["roles"], row["texts"], strict=True)
                for letter in audit:
                    if letter == "I":
                        line(now, _ROLES[state], "")
                        now["cost"] += INSERT
                        state = _THEN[state]
                        continue
                    sym = next(symbols)
                    role, text = next(turns) if sym else ("", "")
                    cost, after = next((c, a) for x, c, a in moves(sym, state) if x == letter)
                    now["cost"] += cost
                    if letter != "D":
                        line(now, role if letter == "K" else _ROLES[state], text)
                    state = after
                yield None
    if now is not None:
        put_in(_LAST[state])
        yield now


DIGESTS = (
    "conv string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
)
_DIGESTS_ARROW = pa.schema(
    [("conv", pa.string())]
    + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chain, any_ = hashlib.sha256(), False

    def line(_: dict, role: str, text: str) -> None:
        nonlocal any_
        chain.update((("\n" if any_ else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        any_ = True

    done = []
    for total in _replay(batches, line):
        if total is None:
            continue
        done.append(total | {"audit": "".join(total["audit"]), "repaired_sha256": chain.hexdigest()})
        chain, any_ = hashlib.sha256(), False
        if len(done) >= 256:
            yield pa.RecordBatch.from_pylist(done, _DIGESTS_ARROW)
            done = []
    if done:
        yield pa.RecordBatch.from_pylist(done, _DIGESTS_ARROW)


REPAIRED = "conv_id bigint, place bigint, role string, text string"
_REPAIRED_ARROW = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lines: list[tuple[int | None, int, str, str]] = []
    of, place = None, 0

    def line(now: dict, role: str, text: str) -> None:
        nonlocal of, place
        if now is not of:
            of, place = now, 0
        lines.append((now["conv_id"], place, role, text))
        place += 1

    for _ in _replay(batches, line):
        if lines:
            columns = zip(zip(*lines, strict=True), _REPAIRED_ARROW, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in columns], schema=_REPAIRED_ARROW)
            lines.clear()


def edited(rows: DataFrame, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """Segments and their letters, those of a conversation in order in one partition.

    Rows are counted ones with their faults."""
    short = F.length("role") <= 32
    # In the same order, but what is sampled for the ranges stays small.
    ranges = ["conv", "turn", F.substring("role", 1, 32), ~short, F.when(short, F.substring("text", 1, 32))]
    placed = written(rows, "turns").repartitionByRange(*ranges)
    placed = placed.sortWithinPartitions("conv", "turn", "role", "text").drop("turn")
    segments = written(placed.mapInArrow(_cut(segment, block), SEGMENTS), "segments")
    back = segments.select("conv", "segment", "through").repartition("conv").sortWithinPartitions("conv", F.desc("segment"))
    vectors = back.mapInArrow(_vectors(block), _VECTORS)
    known = segments.select("conv", "segment", "symbols").join(vectors, "segment").select("conv", "segment", "symbols", "right", "opens")
    traced = known.mapInArrow(_trace(block), _TRACED).withColumn("kind", F.lit(0))
    both = segments.drop("through").withColumn("kind", F.lit(1)).unionByName(traced, allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", "segment", "kind")


def repaired_turns(rows: DataFrame, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """(conv_id, place, role, text) of the repaired conversations. Rows are (conv_id, turn, role, text)."""
    return edited(faults(counted(rows)), segment, block).mapInArrow(_turns, REPAIRED)


def _or(name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default).alias(name)


def repair(conversations: DataFrame, rows: DataFrame, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """One row per conv_id of `conversations`: the faults of its `rows`, and its edits."""
    grouped = written(counted(rows), "turns-counted")
    digests = edited(faults(grouped), segment, block).mapInArrow(_digest, DIGESTS)
    span = grouped.groupBy("conv").agg(
        F.max("turn").alias("high"), F.min("turn").alias("low"), F.count_distinct("turn").alias("turns")
    )
    wide = "cast(high as decimal(38,0)) - low + 1 - turns"
    gaps = span.select("conv", F.expr(f"case when turns = 0 then 0 else try_cast({wide} as bigint) end").alias("gaps"), F.lit(True).alias("some"))
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")
    every = conversations.select(conv, F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    out = every.join(gaps, "conv", "left").join(digests, "conv", "left")
    return out.select(
        "conv_id",
        F.when(F.col("some"), F.col("gaps")).otherwise(F.lit(0)).alias("gaps"),
        *[_or(c, F.lit(0)) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        _or("audit", F.lit("")),
        _or("repaired_sha256", F.lit(hashlib.sha256().hexdigest())),
    )
