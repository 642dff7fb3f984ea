"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

Attention over a piece of n tokens costs LINEAR * n + QUADRATIC * n * n. Documents are cut into
full sequences first; what is left of each (always less than a sequence) goes, in descending order
of length, to the cheapest sequence that has room for it; where none has room, it is cut at the
room of the cheapest one with any. A block of documents gets exactly as many places as it has
tokens: full sequences, and for the rest sequences whose lengths are powers of two, so nothing is
padded.

Blocks are consecutive documents of one input partition, up to `BLOCK` of them, so packing takes
one pass and no shuffle; memory holds one block's lengths and the ids of its unfinished rests.
Sequence numbers carry the partition in their upper bits; a repeated task gives the same ones.

Null text counts as empty: the end mark alone. Repeated rows are packed each for itself.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SEQUENCE = 1024
BLOCK = 4096
LINEAR = 1.0
QUADRATIC = 1.0 / 512
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"

#: Words that a task remembers the ids of.
REMEMBERED = 1_000_000
#: Longer words are not worth remembering.
LONGEST = 48
#: Words that are encoded in one call.
TOGETHER = 2000

_SAFE = re.compile(r"(?<=\S) (?=\S)")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies spell printable bytes by themselves, others from U+0100 on in order;
    a line feed is left alone, as it parts words here."""
    odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
    return {b: chr(256 + place) for place, b in enumerate(odd) if b != 10}


class Encoder:
    """Ids of texts by the `tokenizers` library, which sees each distinct word once per task.

    A byte-level vocabulary never merges across a single space between two non-spaces, so a text
    is cut there, and words, with the space before them, are looked up. New words of letters go to
    the vocabulary's model itself, as its pattern would not cut them; other new words are encoded
    together and told apart by the lengths of their ids in bytes. Markers that the vocabulary knows
    as special tokens are recognised in a text, as the library does by itself."""

    def __init__(self, path: str):
        # A task has one core; the library's own threads would only spin beside it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, code in vocabulary.items():
            self.bytes_of[code] = len(token)
        #: Ids as bytes, and each byte as the letter that stands for it in the vocabulary.
        self.code = [code.to_bytes(4, "little") for code in range(len(self.bytes_of))]
        self.letter = _byte_letters()
        #: Ids by word; None for what can't be cut off by spaces: nothing, or spaces at an end.
        self.known: dict[str, bytes | None] = {}
        self.tails: dict[str, bytes] = {}

    def _each(self, pieces: list[str]) -> list[bytes]:
        codes = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(code.ids, "<u4").tobytes() for code in codes]

    def _learn(self, words: set[str]) -> None:
        """Of a word of letters with punctuation after it, both are encoded for themselves: the
        vocabulary's pattern cuts there."""
        cores = {word: word.rstrip(punctuation) for word in words if word[-1] in punctuation}
        cores = {word: core for word, core in cores.items() if core.isalpha()}
        single = (words - cores.keys()) | set(cores.values()).difference(self.known)
        letters = [word for word in single if word.isalpha()]
        if letters:
            self._learn_letters(letters)
        self._learn_whole(sorted(single.difference(letters)))
        for word, core in cores.items():
            tail = word[len(core) :]
            if tail not in self.tails:
                self.tails[tail] = self._each([tail])[0]
            self.known[word] = self.known[core] + self.tails[tail]

    def _learn_letters(self, words: list[str]) -> None:
        code, tokens = self.code, self.model.tokenize
        spelled = "\n".join([" " + word for word in words]).encode("utf-8", "surrogatepass")
        for word, letters in zip(words, spelled.decode("latin-1").translate(self.letter).split("\n"), strict=True):
            self.known[word] = b"".join([code[token.id] for token in tokens(letters)])

    def _learn_whole(self, words: list[str]) -> None:
        for start in range(0, len(words), TOGETHER):
            part = words[start : start + TOGETHER]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            upto = np.cumsum(self.bytes_of[ids])
            ends = np.cumsum([len(word.encode()) + 1 for word in part])
            last = np.searchsorted(upto, ends) + 1
            if last[-1] != len(ids) or (upto[last - 1] != ends).any():
                self.known.update(zip(part, self._each([" " + word for word in part]), strict=True))
                continue
            before = 0
            for word, at in zip(part, last.tolist(), strict=True):
                self.known[word] = ids[before:at].tobytes()
                before = at

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, without end mark."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
            self.tails.clear()
        cut = [text.split(" ") for text in texts]
        firsts = self._each([words[0] for words in cut])
        new = set(chain.from_iterable(cut)).difference(self.known)
        odd = {word for word in new if not word or word.strip() is not word}
        self.known.update(dict.fromkeys(odd))
        self._learn(new - odd)
        for text, words, first in zip(texts, cut, firsts, strict=True):
            try:
                if len(words) > 1 and (not words[0] or words[0][-1].isspace()):
                    raise TypeError
                ids = first + b"".join(map(self.known.__getitem__, words[1:]))
            except TypeError:  # an odd word: cut only where it is safe
                pieces = _SAFE.split(text)
                ids = b"".join(self._each([pieces[0], *[" " + piece for piece in pieces[1:]]]))
            yield np.frombuffer(ids, "<u4")
        for word in new:
            if len(word) > LONGEST:
                del self.known[word]


def room(total: int, sequence: int = SEQUENCE) -> list[int]:
    """Lengths of the sequences that hold `total` tokens without padding."""
    full, rest = divmod(total, sequence)
    return [sequence] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: np.ndarray, sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of rests shorter than a sequence."""
    left = np.array(room(int(lengths.sum()), sequence), np.int64)
    used = np.zeros(len(left), np.int64)
    cost = np.zeros(len(left))
    pieces = []
    queue = [(int(lengths[d]), d, 0) for d in np.argsort(-lengths, kind="stable") if lengths[d]]
    cuts: list[tuple[int, int, int]] = []
    at = 0
    while at < len(queue) or cuts:
        # The rest of a cut document waits among the others by its length.
        if cuts and (at == len(queue) or cuts[-1][0] >= queue[at][0]):
            length, doc, start = cuts.pop()
        else:
            length, doc, start = queue[at]
            at += 1
        fits = left >= length
        open_ = fits if fits.any() else left > 0
        best = int(np.argmin(np.where(open_, cost, np.inf)))
        taken = min(length, int(left[best]))
        pieces.append((doc, start, taken, best, int(used[best])))
        left[best] -= taken
        used[best] += taken
        cost[best] += LINEAR * taken + QUADRATIC * taken * taken
        if taken < length:
            cuts.append((length - taken, doc, start + taken))
            cuts.sort()
    return pieces


PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, cost double"
)
_NAMES = [x.split()[0] for x in PIECES.split(", ")]
_ARROW = pa.schema([(n, pa.float64() if n == "cost" else pa.int64()) for n in _NAMES])


def _cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


def pack_block(block: list[tuple[int | None, int, int, np.ndarray]], first: int, sequence: int) -> tuple[list[tuple], int]:
    """Rows of the rests (doc_id, start, doc_tokens, ids) of a block, and the next sequence number."""
    lengths = np.array([len(x[3]) for x in block], np.int64)
    rows = []
    for d, start, length, seq, offset in assign(lengths, sequence):
        doc_id, before, tokens, ids = block[d]
        crc = zlib.crc32(ids[start : start + length].tobytes())
        rows.append((doc_id, before + start, length, crc, tokens, first + seq, offset, _cost(length)))
    return rows, first + len(room(int(lengths.sum()), sequence))


def _pack(path: str, sequence: int, block_size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        number = TaskContext.get().partitionId() << 40
        block: list[tuple[int | None, int, int, np.ndarray]] = []
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows: list[tuple] = []
                for doc_id, code in zip(ids, encoder.encode([t or "" for t in texts]), strict=True):
                    code = np.append(code, np.uint32(END_ID)).astype("<u4")
                    whole = len(code) // sequence * sequence
                    for start in range(0, whole, sequence):
                        crc = zlib.crc32(code[start : start + sequence].tobytes())
                        rows.append((doc_id, start, sequence, crc, len(code), number, 0, _cost(sequence)))
                        number += 1
                    if whole < len(code):
                        block.append((doc_id, whole, len(code), code[whole:].copy()))
                    if len(block) == block_size:
                        packed, number = pack_block(block, number, sequence)
                        rows += packed
                        block = []
                if rows:
                    yield out(rows)
        if block:
            yield out(pack_block(block, number, sequence)[0])

    return run


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack(documents: DataFrame, path: str | None = None, sequence: int = SEQUENCE, block: int = BLOCK) -> DataFrame:
    """One row per piece: where its document's tokens lie, and a checksum of its ids."""
    run = _pack(path or tokenizer_path(), sequence, block)
    return documents.select("doc_id", "text").mapInArrow(run, PIECES)
