import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import odd_rows
from tidemark.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_path())


TEXTS = [
    "plain words here", " leading", "trailing ", "two  spaces", "tab\tand\nnew\n\nlines", "it's o'clock, don't", "",
    "é ü ß ñ 日本語 текст", "1234 5 67", "a \n b", "a\n b", "a \nb", "   ", "x" * 300, "end nbsp  em", "a\x1cb \x85c",
    "word " * 500, "### $$$ *** %%%", "<|endoftext|> in a text<|endoftext|>", "\r\n a",
    "a <|endoftext|> b", "a  <|endoftext|>  b", "x<|endoftext|> <|endoftext|>y.", "endoftext|> <|", "ªº ǅ ʰa Ⅷ x² ½b",
]


def test_ids_equal_the_tokenizer(tokenizer, prose):
    texts = TEXTS + [prose(i, 50) for i in range(20)]
    encoder = packing.Encoder(packing.tokenizer_path())
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_round_trip(docs, tokenizer, prose):
    texts = TEXTS + [prose(i, 30 + 40 * i) for i in range(60)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(900, None, "en", "s", 0)]
    out = packing.pack(docs(rows)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == {r[0] for r in rows}
    for doc_id, mine in pieces.items():
        text = texts[doc_id] if doc_id < 900 else ""
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(mine, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024 and at & (at - 1) == 0  # full, or a power of two: no padding


def test_costs_are_balanced():
    """Against packing that looks at room only: first fit, in descending order."""
    lengths = np.random.default_rng(1).integers(1, 400, 2000)
    cost, total = defaultdict(float), defaultdict(int)
    for _, _, length, sequence, _ in packing.assign(lengths):
        cost[sequence] += packing._cost(length)
        total[sequence] += length
    full = [cost[s] for s in cost if total[s] == 1024]
    room, plain = [], []
    for n in sorted(lengths.tolist(), reverse=True):
        place = next((i for i, r in enumerate(room) if r >= n), len(room))
        if place == len(room):
            room.append(1024)
            plain.append(0.0)
        room[place] -= n
        plain[place] += packing._cost(n)
    assert np.std(full) < 0.5 * np.std(plain[:-1])


def test_pieces_of_each_document_are_disjoint():
    lengths = np.array([1023, 1000, 700, 700, 5, 1])
    pieces = packing.assign(lengths)
    for d, n in enumerate(lengths):
        mine = sorted((s, length) for doc, s, length, _, _ in pieces if doc == d)
        assert sum(x for _, x in mine) == n and mine[0][0] == 0


def test_odd_rows(docs, prose):
    out = packing.pack(docs(odd_rows(prose), clash=True)).collect()
    assert {r.doc_id for r in out} == {1, 2, 3, None, 4, 5, 6, 7}
    assert sum(r.length for r in out if r.doc_id == 6) == 2 * next(r.doc_tokens for r in out if r.doc_id == 6)
    assert packing.pack(docs([])).collect() == []
