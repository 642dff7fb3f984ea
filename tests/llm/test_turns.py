import hashlib
import heapq
import random
import re
import zlib

import pytest

from tidemark.llm import turns

TURNS = "conv_id long, turn long, role string, text string"
THEN = {"E": ("U", "user"), "S": ("U", "user"), "A": ("U", "user"), "U": ("A", "assistant")}


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 1:
            text = ""
        elif code == 2:
            text = re.sub("[.!?]", "", text)
        elif code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def cheapest(marked):
    """Least cost, then least letters, and lines, by search over all edits. Rows are (role, text, gone, cut)."""
    heap, done = [(0, "", 0, "E", ())], set()
    while heap:
        cost, letters, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(marked) and state in "EA":
            return cost, letters, lines
        nxt, put = THEN[state]
        heapq.heappush(heap, (cost + 3, letters + "I", i, nxt, (*lines, f"{put}:")))
        if i == len(marked):
            continue
        role, text, gone, cut = marked[i]
        heapq.heappush(heap, (cost + 4, letters + "D", i + 1, state, lines))
        if gone:
            continue
        heapq.heappush(heap, (cost + 3 + 3 * cut, letters + "R", i + 1, nxt, (*lines, f"{put}:{text}")))
        kept = {("E", "s"): "S", ("E", "u"): "U", ("S", "u"): "U", ("A", "u"): "U", ("U", "a"): "A"}.get((state, role[:1]))
        if kept:
            heapq.heappush(heap, (cost + 3 * cut, letters + "K", i + 1, kept, (*lines, f"{role}:{text}")))
    raise AssertionError


def brute(rows, after=None):
    """What the query returns, from the rows and those after damage."""
    out = {}
    damaged = brute_damage(rows) if after is None else after
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        numbers = [r[1] for r in mine if r[1] is not None]
        blank = duplicate = truncated = 0
        seen, marked = set(), []
        for _, _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            gone = not bare or (role, text) in seen
            cut = not gone and bare[-1] not in ".!?"
            blank, duplicate, truncated = blank + (not bare), duplicate + (bool(bare) and gone), truncated + cut
            seen.add((role, text))
            marked.append((role, text, gone, cut))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, letters, lines = cheapest(marked)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, letters, digest, lines)
    return out


def made(seed, convs=60, long=0):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        n = long if conv == 1 and long else rng.randrange(0, 9)
        for turn in range(n):
            role = rng.choice("user user assistant assistant system usher tool".split() + ["", None])
            if rng.random() < 0.6:
                role = ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No", f"t{rng.random()}.", f"é {rng.random()}!\n", f"open {rng.random()}", " \t", "", None])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
            if rng.random() < 0.1:
                rows += [rows[-1]] * rng.randrange(1, 4)
    rng.shuffle(rows)
    return rows


def compare(out, expected):
    assert len(out) == len(expected)
    for r in out:
        mine = (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
        assert mine == expected[r.conv_id][:8], r.conv_id


@pytest.mark.parametrize("seed, segment, block", [(1, 4096, 3), (2, 2, 1), (3, 3, 2), (4, 5, 4)])
def test_against_brute_force(spark, seed, segment, block):
    rows = made(seed, long=80)
    frame = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], TURNS + ", conv string, copies long, segment string").repartition(5)
    compare(turns.repair(frame, turns.damaged(frame), segment, block).collect(), brute(rows))


def test_repaired_turns(spark):
    rows = [r for r in made(5, long=50) if r[2] is not None and r[3] is not None]
    frame = spark.createDataFrame(rows, TURNS)
    out = turns.repaired_turns(frame, segment=3).collect()
    got = {}
    for r in sorted(out, key=lambda r: r.place):
        got.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert got == {c: list(x[8]) for c, x in brute(rows, rows).items() if x[8]}
    initials = {c: "".join(line[0] for line in lines) for c, lines in got.items()}
    assert all(re.fullmatch("s?(ua)+", x) for x in initials.values())


def test_repair_of_a_good_conversation_changes_nothing(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Hi!"), (1, 3, "user", "Bye."), (1, 4, "assistant", "Bye!")]
    frame = spark.createDataFrame(rows, TURNS)
    r = turns.repair(frame, frame).first()
    assert (r.gaps, r.illegal, r.cost, r.audit) == (0, 0, 0, "KKKKK")


def test_many_equal_rows_and_long_texts(spark):
    """Equal rows are counted; a conversation of one row a thousand times, and one of long texts."""
    rows = [(7, 3, "user", "Same.")] * 3000 + [(8, t, ("user", "assistant")[t % 2], f"{t} " + "x" * 200_000 + ".") for t in range(30)]
    frame = spark.createDataFrame(rows, TURNS)
    out = {r.conv_id: r for r in turns.repair(frame, frame, segment=64).collect()}
    assert out[7].audit == "D" * 0 + "K" + "D" * 2999 + "I" and out[7].duplicate == 2999 and out[7].illegal == 2999
    assert out[7].cost == 4 * 2999 + 3
    assert out[8].audit == "K" * 30 and out[8].cost == 0
    lines = "\n".join(f"{r}:{t}" for _, _, r, t in rows[3000:])
    assert out[8].repaired_sha256 == hashlib.sha256(lines.encode()).hexdigest()


def test_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert turns.repair(empty, turns.damaged(empty)).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "Hi."), (None, None, None, None)], TURNS)
    compare(turns.repair(frame, turns.damaged(frame)).collect(), brute([(gone, 0, "user", "Hi."), (None, None, None, None)]))
    wide = spark.createDataFrame([(1, -(2**63), "user", "a."), (1, 2**63 - 1, "user", "b.")], TURNS)
    assert turns.repair(wide, wide).first().gaps is None


@pytest.mark.parametrize("block", [1, 2, 3, 4])
def test_tables_against_search(block):
    tables = turns.Tables(block)
    rng = random.Random(block)
    for _ in range(300):
        symbols = bytes(rng.randrange(turns.SYMBOLS) for _ in range(rng.randrange(14)))
        marked = [("suao"[(s - 1) // 2] if s else "u", "", s == 0, bool(s) and (s - 1) % 2 == 1) for s in symbols]
        expected = cheapest(marked)[1]
        ends, letters = tables.trace(symbols, tables.final, (0,))
        assert letters[0] + turns._LAST[ends[0]] == expected
        # In two parts, the second one begun in whatever state the first one ends in.
        cut = rng.randrange(len(symbols) + 1)
        right = tables.through(symbols[cut:])[tables.final]
        first, a = tables.trace(symbols[:cut], right, (0,))
        last, b = tables.trace(symbols[cut:], tables.final, (0, 1, 2, 3))
        assert a[0] + b[first[0]] + turns._LAST[last[first[0]]] == expected
