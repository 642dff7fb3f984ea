"""Document decoding as distributed jobs: bytes to matrix rows, keyed rows or text.

Only what needs a format library runs in Python, one document at a time inside
`mapInArrow`; cells leave the worker as read, and all cleaning, header finding
and normalising happens in built-in expressions. A corpus of mixed formats is
read once. Input documents have the
columns source_queue_id, doc_id, path, content_type and content. A document that cannot be read gives one row with
`error` set, so a bad file never stops the job and never gives half its rows.
"""

from __future__ import annotations

import csv
import fnmatch
import html
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import IO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import (
    as_column,
    decode_text,
    looks_like_text,
    media_type,
    normalize_lines,
)
from tidemark.operators.lookup import ENTRY_TYPE
from tidemark.vocabulary import (
    CSV_TYPES,
    HTML_TYPES,
    MAX_DOCUMENT_CHARS,
    SPREADSHEET_TYPE_SUFFIX,
    XML_TYPES,
)

MATRIX_SCHEMA = {
    "source_queue_id": "string",
    "doc_id": "string",
    "sheet": "string",
    "row_seq": "bigint",
    "ord": "bigint",
    "row_number": "bigint",
    "cells": "array<string>",
    "error": "string",
}
# A matrix row, or a keyed record: the latter brings its own header.
TABLE_SCHEMA = {
    "source_queue_id": "string",
    "doc_id": "string",
    "sheet": "string",
    "row_seq": "bigint",
    "ord": "bigint",
    "row_number": "bigint",
    "cells": "array<string>",
    "own_header": "array<string>",
    "error": "string",
}
KEYED_SCHEMA = {
    "source_queue_id": "string",
    "doc_id": "string",
    "ord": "bigint",
    "source_location": "string",
    "source_row_number": "bigint",
    "entries": ENTRY_TYPE,
    "error": "string",
}
# Rows of all documents, each with what is known of its document; a document's last row has no
# row_seq and stands for the document itself.
DECODED_SCHEMA = {
    "source_queue_id": "string",
    "doc_id": "string",
    "path": "string",
    "content_md5": "string",
    "byte_count": "bigint",
    "format": "string",
    "sheet": "string",
    "row_seq": "bigint",
    "ord": "bigint",
    "row_number": "bigint",
    "cells": "array<string>",
    "own_header": "array<string>",
    "error": "string",
}
TEXT_SCHEMA = {
    "source_queue_id": "string",
    "doc_id": "string",
    "text": "string",
    "error": "string",
}
ROUTED_TEXT_SCHEMA = {
    "source_queue_id": "string",
    "doc_id": "string",
    "path": "string",
    "route": "string",
    "text": "string",
    "error": "string",
}
_ARROW_TYPES = {
    "string": pa.string(),
    "bigint": pa.int64(),
    "array<string>": pa.list_(pa.string()),
    ENTRY_TYPE: pa.list_(pa.struct([("header", pa.string()), ("value", pa.string())])),
}

_ROWS_PER_BATCH = 4096
# Sheets of one document are spaced this far apart in `ord`.
SHEET_SPAN = 1 << 32
#: Characters that the dialect of a CSV is guessed from: the guess takes more than linear time.
CSV_SAMPLE_CHARS = 8192
MIN_PDF_CHARS = 50
SHORT_PDF = "Could not extract enough text from PDF with the built-in reader"

XLSX_NOTE = "Extracted project rows from XLSX worksheets"
XML_NOTE = "Extracted project rows from XML elements"
HTML_NOTE = "Extracted project rows from HTML tables"
CSV_NOTE = "Extracted project rows from CSV"
SKIPPED_NOTE = "Deterministic project extraction skipped: "


# --- routing ------------------------------------------------------------------
def table_format(path: Column | str, content_type: Column | str) -> Column:
    """xlsx, xml, html or csv by extension, else by media type; null for others."""
    name, kind = F.lower(as_column(path)), media_type(content_type)
    return (
        F.when(name.endswith(".xlsx") | kind.endswith(SPREADSHEET_TYPE_SUFFIX), "xlsx")
        .when(name.endswith(".xml") | kind.isin(*XML_TYPES), "xml")
        .when(name.endswith(".html") | name.endswith(".htm") | kind.isin(*HTML_TYPES), "html")
        .when(name.endswith(".csv") | kind.isin(*CSV_TYPES), "csv")
    )


def text_format(path: Column | str, content_type: Column | str) -> Column:
    """How a document's text is taken: xlsx, html, pdf or plain."""
    name, kind = F.lower(as_column(path)), media_type(content_type)
    return (
        F.when(name.endswith(".xlsx") | kind.endswith(SPREADSHEET_TYPE_SUFFIX), "xlsx")
        .when(name.endswith(".html") | name.endswith(".htm") | kind.isin(*HTML_TYPES), "html")
        .when(name.endswith(".pdf") | (kind == "application/pdf"), "pdf")
        .otherwise("plain")
    )


# --- workers ------------------------------------------------------------------
def _per_document(
    documents: DataFrame,
    inputs: list[Column],
    read: Callable[..., Iterable[tuple]],
    schema: dict[str, str],
    carried: int = 0,
) -> DataFrame:
    """Run `read(*inputs)` on every document; it gives the columns before error.

    The ids and the first `carried` inputs are repeated on every row, before
    what `read` gives, and kept when it fails.
    """
    types = pa.schema([(name, _ARROW_TYPES[kind]) for name, kind in schema.items()])
    width = len(schema) - 3 - carried

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in zip(*batch.columns):
                values = [v.as_py() for v in row]
                kept, rest = values[: 2 + carried], values[2:]
                try:
                    found = [(*kept, *out, None) for out in read(*rest)]
                except Exception as problem:  # one bad document must not stop the rest
                    found = [(*kept, *(None,) * width, f"{type(problem).__name__}: {problem}")]
                for start in range(0, len(found), _ROWS_PER_BATCH):
                    part = zip(*found[start : start + _ROWS_PER_BATCH])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t.type) for c, t in zip(part, types)], schema=types
                    )

    return documents.select(
        F.col("source_queue_id").cast("string"),
        F.col("doc_id").cast("string"),
        *[column.alias(f"input_{i}") for i, column in enumerate(inputs)],
    ).mapInArrow(batches, ", ".join(f"{name} {kind}" for name, kind in schema.items()))


def _place(sheets: Iterable[tuple[str, Iterable[tuple[int, list[str]]]]]) -> Iterator[tuple]:
    for index, (sheet, rows) in enumerate(sheets):
        for seq, (number, cells) in enumerate(rows):
            yield sheet, seq, index * SHEET_SPAN + seq, number, cells


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column_number(reference: str) -> int:
    """Column of a cell reference such as AB12, from 0: its letters are digits to the base 26."""
    letters = re.match("[A-Za-z]*", reference)[0].upper() or "A"
    return sum((ord(letter) - 64) * 26**power for power, letter in enumerate(reversed(letters))) - 1


def _elements(part: IO[bytes], name: str) -> Iterator[ElementTree.Element]:
    """Finished elements of one name, each forgotten before the next is read."""
    for _, node in ElementTree.iterparse(part):
        if _local(node.tag) == name:
            yield node
            node.clear()


def _words_in(node: ElementTree.Element, name: str) -> list[str]:
    return [part.text or "" for part in node.iter() if _local(part.tag) == name]


def _sheets(data: bytes) -> Iterator[tuple[str, Iterator[tuple[int, dict[int, str]]]]]:
    """Every worksheet of a workbook: its name and its rows, (row number, texts by column).

    Sheets come in name order, so sheet10 precedes sheet2. Rows are read one at a time; what is
    held of a workbook is its table of shared strings.
    """
    book = zipfile.ZipFile(io.BytesIO(data))
    names = set(book.namelist())
    shared: dict[str, str] = {}
    if "xl/sharedStrings.xml" in names:
        with book.open("xl/sharedStrings.xml") as part:
            for place, item in enumerate(_elements(part, "si")):
                shared[str(place)] = "".join(_words_in(item, "t"))

    def shown(cell: ElementTree.Element) -> str:
        kind = cell.get("t")
        text = "".join(_words_in(cell, "t") if kind == "inlineStr" else _words_in(cell, "v")[:1])
        return (shared.get(text.strip(), text) if kind == "s" else text).strip()

    def rows(name: str) -> Iterator[tuple[int, dict[int, str]]]:
        with book.open(name) as part:
            for count, row in enumerate(_elements(part, "row"), 1):
                cells = (node for node in row if _local(node.tag) == "c")
                yield int(row.get("r", count)), {_column_number(c.get("r", "")): shown(c) for c in cells}

    for name in sorted(fnmatch.filter(names, "xl/worksheets/*.xml")):
        yield name, rows(name)


def _xlsx_rows(data: bytes) -> Iterator[tuple]:
    def padded(rows: Iterator[tuple[int, dict[int, str]]]) -> Iterator[tuple[int, list[str]]]:
        for number, texts in rows:
            yield number, [texts.get(column, "") for column in range(max(texts, default=-1) + 1)]

    return _place((name, padded(rows)) for name, rows in _sheets(data))


def _xlsx_text(data: bytes) -> Iterator[tuple]:
    blocks = []
    for name, rows in _sheets(data):
        filled = ("\t".join(filter(None, texts.values())) for _, texts in rows)
        blocks.append("\n".join([f"\n# {name}", *filter(None, filled)]))
    if not blocks:
        raise ValueError("No readable worksheet text found in XLSX")
    yield ("\n".join(blocks),)


def _csv_rows(text: str) -> Iterator[tuple]:
    try:
        dialect = csv.Sniffer().sniff(text[:CSV_SAMPLE_CHARS])
    except csv.Error:
        dialect = csv.excel
    return _place([("csv", enumerate(csv.reader(io.StringIO(text), dialect), 1))])


def _xml_rows(data: bytes) -> Iterator[tuple]:
    for index, record in enumerate(ElementTree.fromstring(data), 1):
        leaves = {}
        for field in record:
            if not len(field) and (field.text or "").strip():
                leaves[_local(field.tag)] = field.text
        entries = [{"header": tag, "value": text} for tag, text in leaves.items()]
        yield index, f"{_local(record.tag)}[{index}]", index, entries


# What is not shown (fixed values), and tags, also one that the end of the text cuts off.
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript)\b.*?(?:</\1\s*>|\Z)", re.DOTALL | re.IGNORECASE)
_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+(?:>|\Z)"""
_TAG = re.compile(rf"<[!?/]?[a-z]{_ATTRIBUTES}|<[!?/]?[a-z][^>]*+(?:>|\Z)", re.IGNORECASE)
_TABLE_TAG = re.compile(rf"<(/?)(table|tr|td|th)\b{_ATTRIBUTES}", re.IGNORECASE)
# Elements whose tags break a line of visible text (fixed values).
_BREAK = re.compile(rf"<(?:/?(?:p|div|tr|li)|br|table)\b{_ATTRIBUTES}", re.IGNORECASE)


def _cell_texts(markup: str) -> Iterator[tuple[int, int, str]]:
    """(row, cell, text) for every cell of every table, rows numbered as they begin.

    Each open table has a row and a cell it is at. A cell ends with its tag, or where the next cell,
    row or the end of its table comes; the same holds for rows. Inner tables have rows of their own,
    and what stands in them belongs to no cell of an outer one."""
    shown = _HIDDEN.sub(" ", markup)
    tables: list[tuple[int, int]] = []  # (row, cell) of each open table; 0 for none, less if it has ended
    rows, at = 0, 0
    for tag in chain(_TABLE_TAG.finditer(shown), [None]):
        if tables and tables[-1][1] > 0:
            between = shown[at : tag.start() if tag else len(shown)]
            words = " ".join(html.unescape(piece) for piece in _TAG.split(between) if piece)
            yield *tables[-1], words
        if tag is None:
            return
        at, name, ends = tag.end(), tag[2].lower(), bool(tag[1])
        if name == "table":
            tables = tables[:-1] if ends else [*tables, (0, 0)]
        elif tables:
            row, cell = tables.pop()
            if name == "tr":
                rows += not ends
                tables.append((0 if ends else rows, 0))
            elif ends or not row:
                tables.append((row, -abs(cell)))
            else:
                tables.append((row, abs(cell) + 1))
                yield row, abs(cell) + 1, ""


def _html_rows(text: str) -> Iterator[tuple]:
    """Rows of all tables with any text, in the order in which they begin."""
    rows: dict[int, dict[int, list[str]]] = {}
    for row, cell, words in _cell_texts(text):
        pieces = rows.setdefault(row, {}).setdefault(cell, [])
        if words:
            pieces.append(words)
    lists = ([" ".join(pieces) for pieces in cells.values()] for _, cells in sorted(rows.items()))
    return _place([("html-table", enumerate((c for c in lists if "".join(c).strip()), 1))])


def _html_text(text: str) -> Iterator[tuple]:
    """What is left without hidden elements and tags; some of them break the line."""
    yield (html.unescape(_TAG.sub(" ", _BREAK.sub("\n", _HIDDEN.sub(" ", text)))),)


# PDF syntax and escapes (fixed values).
_PDF_STREAM = re.compile(rb"stream\r?\n(.*?\r?\n)endstream", re.DOTALL)
_PDF_LITERAL = re.compile(rb"\((?:\\.|[^\\)])*\)")
_PDF_ESCAPE = re.compile(rb"\\([nrtbf()\\])")
_PDF_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"(": b"(", b")": b")", b"\\": b"\\"}
#: A stream that inflates to more is an error of its document.
MAX_INFLATED = 1 << 28


def _pdf_layers(data: bytes) -> Iterator[bytes]:
    """The streams of a document as they stand, each followed by what it inflates to, if it does.

    Packed bytes may end like a line, so only the unpacker tells where they end and that line does."""
    for stream in _PDF_STREAM.finditer(data):
        packed = stream[1].lstrip(b"\r\n")
        yield packed.rstrip(b"\r\n")
        unpacker = zlib.decompressobj()
        try:
            plain = unpacker.decompress(packed, MAX_INFLATED)
        except zlib.error:
            continue
        if unpacker.unconsumed_tail:
            raise ValueError(f"A PDF stream inflates to more than {MAX_INFLATED} bytes")
        if unpacker.eof:
            yield plain


def _said_in(layer: bytes) -> list[str]:
    """The string literals of a layer that are not blank, each escape read where it is met."""
    plain = (_PDF_ESCAPE.sub(lambda e: _PDF_ESCAPED[e[1]], x[0][1:-1]) for x in _PDF_LITERAL.finditer(layer))
    return [words.decode("latin-1") for words in plain if words.strip()]


def _pdf_text(data: bytes) -> Iterator[tuple]:
    words = list(chain.from_iterable(map(_said_in, _pdf_layers(data))))
    yield (" ".join(words or _said_in(data)),)


def _table_rows(kind: str, data: bytes | None, text: str | None) -> Iterator[tuple]:
    """Rows of a document of any table format."""
    if kind == "xml":
        for place, location, number, entries in _xml_rows(data):
            values = [e["value"] for e in entries]
            yield location, 0, place, number, values, [e["header"] for e in entries]
    else:
        sheets = {"xlsx": _xlsx_rows, "csv": _csv_rows, "html": _html_rows}[kind]
        for row in sheets(data if kind == "xlsx" else text):
            yield *row, None


def _routed_text(path: str, route: str, data: bytes | None, text: str | None) -> Iterator[tuple]:
    """Text of a document of any format; plain text is decoded already."""
    if route == "plain":
        yield (text,)
    else:
        readers = {"xlsx": _xlsx_text, "html": _html_text, "pdf": _pdf_text}
        yield from readers[route](text if route == "html" else data)


# --- jobs ---------------------------------------------------------------------
def xlsx_matrix(documents: DataFrame) -> DataFrame:
    return _per_document(documents, [F.col("content")], _xlsx_rows, MATRIX_SCHEMA)


def csv_matrix(documents: DataFrame) -> DataFrame:
    """The dialect is guessed from the start of the text; rows without text are left out."""
    rows = _per_document(documents, [decode_text("content")], _csv_rows, MATRIX_SCHEMA)
    return rows.filter(
        F.col("error").isNotNull() | F.exists("cells", lambda c: c.rlike(r"(?U)[^\s\x1c-\x1f]"))
    )


def html_tables(documents: DataFrame) -> DataFrame:
    """Rows of all tables of a document; inner tables have rows of their own."""
    return _per_document(documents, [decode_text("content")], _html_rows, MATRIX_SCHEMA)


def xml_records(documents: DataFrame) -> DataFrame:
    """Keyed rows: every child of the root is a record, its leaf children are the fields."""
    return _per_document(documents, [F.col("content")], _xml_rows, KEYED_SCHEMA)


def xlsx_text(documents: DataFrame) -> DataFrame:
    return _per_document(documents, [F.col("content")], _xlsx_text, TEXT_SCHEMA)


def html_visible_text(documents: DataFrame) -> DataFrame:
    raw = _per_document(documents, [decode_text("content")], _html_text, TEXT_SCHEMA)
    return raw.withColumn("text", normalize_lines("text"))


def pdf_text(documents: DataFrame, min_chars: int = MIN_PDF_CHARS) -> DataFrame:
    """Best effort: string literals of the plain or inflated streams; fewer than `min_chars`
    characters are an error."""
    raw = _per_document(documents, [F.col("content")], _pdf_text, TEXT_SCHEMA)
    tidy = raw.withColumn("text", normalize_lines("text"))
    short = F.col("error").isNull() & (F.length("text") < min_chars)
    return tidy.withColumns(
        {
            "error": F.when(
                short, F.lit(SHORT_PDF)
            ).otherwise(F.col("error")),
            "text": F.when(~short, F.col("text")),
        }
    )


def _rows_and_end(
    path: str, md5: str, size: int, kind: str | None, data: bytes | None, text: str | None
) -> Iterator[tuple]:
    if kind is not None:
        yield from _table_rows(kind, data, text)
    yield (None,) * 6


def decoded(documents: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """All documents in one pass over their content: their rows, and one row for each document.

    `content_md5` and `byte_count` are those of the whole content, also where `max_bytes` cuts it.
    A document that cannot be read has its one row, with `error`; one of no table format has no
    `format`.
    """
    kind = table_format("path", "content_type")
    whole = F.col("content")
    taken = whole if max_bytes is None else F.substring(whole, 1, max_bytes)
    inputs = [
        F.col("path"),
        F.md5(whole),
        F.octet_length(whole).cast("bigint"),
        kind,
        F.when(kind.isin("xlsx", "xml"), taken),
        F.when(kind.isin("csv", "html"), decode_text(taken)),
    ]
    return _per_document(documents, inputs, _rows_and_end, DECODED_SCHEMA, carried=4)


def format_note(kind: Column) -> Column:
    """What was done with a document of a table format."""
    notes = {"xlsx": XLSX_NOTE, "xml": XML_NOTE, "html": HTML_NOTE, "csv": CSV_NOTE}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in notes.items() for x in pair]), kind)


def table_rows(documents: DataFrame) -> DataFrame:
    """Rows of all table documents, whatever their format, in one pass over the corpus.

    XML records bring their tags in `own_header`; for other rows it is null.
    """
    kind = table_format("path", "content_type")
    routed = documents.withColumn("_format", kind).filter(F.col("_format").isNotNull())
    is_text = F.col("_format").isin("csv", "html")
    inputs = [
        F.col("_format"),
        F.when(~is_text, F.col("content")),
        F.when(is_text, decode_text("content")),
    ]
    return _per_document(routed, inputs, _table_rows, TABLE_SCHEMA)


def document_text(documents: DataFrame) -> DataFrame:
    """Whole text, notes and, for unreadable documents, the error; one row per document.

    All formats go through one pass over the corpus.
    """
    routed = documents.withColumn("_route", text_format("path", "content_type"))
    is_text = F.col("_route").isin("html", "plain")
    inputs = [
        F.col("path"),
        F.col("_route"),
        F.when(~is_text, F.col("content")),
        F.when(is_text, decode_text("content")),
    ]
    raw = _per_document(routed, inputs, _routed_text, ROUTED_TEXT_SCHEMA, carried=2)
    route = F.col("route")
    tidy = raw.withColumn(
        "text",
        F.when(route.isin("html", "pdf"), normalize_lines("text")).otherwise(F.col("text")),
    )
    checked = tidy.withColumn(
        "error",
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when((route == "pdf") & (F.length("text") < MIN_PDF_CHARS), SHORT_PDF)
        .when(
            (route == "plain") & ~looks_like_text(F.col("text")),
            F.concat(
                F.lit("Unsupported binary document type for "),
                "path",
                F.lit("; provide text, CSV, HTML, PDF, or XLSX"),
            ),
        ),
    )
    good = F.col("error").isNull()
    attempted = F.lit("Attempted local best-effort PDF text extraction")
    failed = F.concat(F.lit("Local PDF text extraction failed: "), "error")
    used = F.lit("Used local PDF text extraction")
    notes = (
        F.when(route == "xlsx", F.array(F.lit("Extracted worksheet text from XLSX XML parts")))
        .when(route == "html", F.array(F.lit("Extracted visible text from HTML")))
        .when(route == "pdf", F.array(attempted, F.when(good, used).otherwise(failed)))
        .when(good, F.array(F.lit("Decoded text payload")))
        .otherwise(F.array().cast("array<string>"))
    )
    return checked.select(
        "source_queue_id",
        "doc_id",
        "route",
        F.when(good, F.col("text")).alias("text"),
        notes.alias("notes"),
        "error",
    )


def limit_text(texts: DataFrame, max_chars: int = MAX_DOCUMENT_CHARS) -> DataFrame:
    """Texts as an extraction model may receive them; a cut is recorded in the notes.

    `document_text` itself always gives the whole text.
    """
    size = F.length("text")
    note = F.concat(
        F.lit("Document text truncated from "),
        size.cast("string"),
        F.lit(f" to {max_chars} characters"),
    )
    cut = size > max_chars
    return texts.withColumns(
        {
            "notes": F.when(cut, F.array_append("notes", note)).otherwise(F.col("notes")),
            "text": F.when(cut, F.substring("text", 1, max_chars)).otherwise(F.col("text")),
        }
    )
