"""Decoders on documents written by hand."""

import io
import zipfile
import zlib

from pyspark.util import PythonEvalType

from queries import fixtures
from tidemark.plans.ingest import document_records, extraction_notes, keyed_document_rows
from tidemark.sources import decode

DOCUMENTS = (
    "source_queue_id string, doc_id string, path string, content_type string, content binary"
)
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def documents(spark, *items):
    """(path, content[, content type]) items, one source each."""
    rows = []
    for i, (path, content, *kind) in enumerate(items):
        body = content if isinstance(content, bytes) else content.encode()
        rows.append((f"q{i}", f"d{i}", path, kind[0] if kind else None, bytearray(body)))
    return spark.createDataFrame(rows, DOCUMENTS)


def workbook(**parts):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as book:
        for name, xml in parts.items():
            book.writestr(name.replace("__", "/") + ".xml", xml)
    return data.getvalue()


def cells(frame):
    rows = frame.orderBy("ord").collect()
    return [(r.sheet, r.row_number, r.cells) for r in rows]


def test_xlsx_sheets_padding_and_strings(spark):
    book = workbook(
        xl__worksheets__sheet10=f'<w {NS}><row r="5"><c r="B5" t="inlineStr"><is><t> in</t><t>line </t></is></c></row></w>',
        xl__worksheets__sheet2=f'<w {NS}><row><c r="A1" t="s"><v>1</v></c><c r="AA1"><v>7</v></c></row>'
        '<row><c r="A2" t="s"><v>9</v></c><c r="B2" t="s"><v/></c></row></w>',
        xl__sharedStrings=f"<sst {NS}><si><t>zero</t></si><si><r><t>o</t></r><r><t>ne</t></r></si></sst>",
    )
    got = cells(decode.xlsx_matrix(documents(spark, ("a.xlsx", book))))
    assert got == [
        ("xl/worksheets/sheet10.xml", 5, ["", "inline"]),
        ("xl/worksheets/sheet2.xml", 1, ["one", *[""] * 25, "7"]),
        ("xl/worksheets/sheet2.xml", 2, ["9", ""]),
    ]
    text = decode.xlsx_text(documents(spark, ("a.xlsx", book))).first().text
    assert text == (
        "\n# xl/worksheets/sheet10.xml\ninline\n\n# xl/worksheets/sheet2.xml\none\t7\n9"
    )


def test_csv_dialects_and_blank_rows(spark):
    got = cells(decode.csv_matrix(documents(spark, ("a.csv", 'a;"b;c";d\n\n ; ;\n1;2;3\n'))))
    assert got == [("csv", 1, ["a", "b;c", "d"]), ("csv", 4, ["1", "2", "3"])]


def test_xml_leaves_namespaces_and_repeats(spark):
    xml = (
        '<q:a xmlns:q="u"><!-- c --><q:p><q:Name> x </q:Name><q:Deep><q:Z>1</q:Z></q:Deep>'
        "<q:Name>last</q:Name><q:Blank> </q:Blank></q:p><r><MW>5</MW></r></q:a>"
    )
    rows = decode.xml_records(documents(spark, ("a.xml", xml))).orderBy("ord").collect()
    got = [(r.source_location, [(e.header, e.value) for e in r.entries]) for r in rows]
    assert got == [("p[1]", [("Name", "last")]), ("r[2]", [("MW", "5")])]


def test_html_nested_and_unclosed_tables(spark):
    html = (
        "<td>outside</td><table><tr><th>A<b>b</b></th><td> c </td></tr><tr><td></td></tr>"
        "<tr><td>x<table><tr><td>in</td></tr></table></td></tr><tr><td>lost<tr><td>kept</td></tr>"
        "</table><tr><td>after</td></tr>"
    )
    got = cells(decode.html_tables(documents(spark, ("a.html", html))))
    assert [(n, c) for _, n, c in got] == [
        (1, ["A b", " c "]),
        (2, ["x"]),
        (3, ["in"]),
        (4, ["lost"]),
        (5, ["kept"]),
    ]


def test_html_odd_markup(spark):
    html = (
        "<TABLE class='a>b'><tr><td title=\"x > y\">1 &lt; 2</td><td>3<!-- <td>no</td> --></td><script>'<td>no</td>'</script></tr>"
        "<tr><td>a<table><tr><td>b</td></tr></table>c</td><td>d</td></tr></table> <table><td>no row</td><tr><td>last"
    )
    got = cells(decode.html_tables(documents(spark, ("a.html", html))))
    assert [[x.strip() for x in c] for _, _, c in got] == [["1 < 2", "3"], ["a c", "d"], ["b"], ["last"]]
    text = decode.html_visible_text(documents(spark, ("a.html", "a < b <i>c</i><style>x</style><!-- y --> &eacute;<div unfinished"))).first()
    assert text.text == "a < b c é"


def test_cell_references():
    assert [decode._column_number(x) for x in ("A1", "Z9", "AA1", "ab12", "XFD1", "", "7")] == [0, 25, 26, 27, 16383, 0, 0]


def test_pdf_escapes_and_bombs(spark):
    body = rb"(one \\n two) (\101x\)) (tab\there)" + b" (padding of some more words to be long enough)"
    row = decode.pdf_text(documents(spark, ("a.pdf", b"stream\n" + body + b"\nendstream"))).first()
    assert row.text.startswith("one \\n two \\101x) tab")
    assert list(decode._pdf_layers(b"stream\n" + zlib.compress(b"x" * 10)[:-6] + b"\nendstream"))[1:] == []


def test_visible_text(spark):
    html = "<p>One  <b>two</b></p><script>no()</script><div>three<br/>four</div><noscript>x</noscript>&amp; five "
    row = decode.html_visible_text(documents(spark, ("a.html", html))).first()
    assert row.text == "One two\nthree\nfour\n& five"


def test_packed_bytes_that_end_like_a_line():
    bodies = (b"(project %d)" % i for i in range(20_000))
    packed = {zlib.compress(body)[-1:]: body for body in bodies}
    for end in (b"\n", b"\r"):
        for line in (b"\n", b"\r\n"):
            data = b"stream" + line + zlib.compress(packed[end]) + line + b"endstream"
            assert list(decode._pdf_layers(data))[1:] == [packed[end]]


def test_pdf_plain_deflated_and_short(spark):
    body = b"BT (Queue Q-1 \\(open\\) at Oak Creek) Tj (Capacity 50 MW and more words) Tj ET"
    plain = b"%PDF\nstream\n" + body + b"\nendstream"
    packed = b"%PDF\nstream\r\n" + zlib.compress(body * 1) + b"\r\nendstream"
    loose = b"%PDF " + body
    rows = decode.pdf_text(
        documents(spark, ("a.pdf", plain), ("b.pdf", packed), ("c.pdf", loose), ("d.pdf", b"(x)"))
    ).collect()
    got = {r.doc_id: r for r in rows}
    expected = "Queue Q-1 (open) at Oak Creek Capacity 50 MW and more words"
    assert got["d0"].text == got["d2"].text == expected
    assert got["d1"].text.endswith(expected)
    assert got["d3"].text is None and "enough text" in got["d3"].error


def test_document_text_routes_and_notes(spark):
    rows = decode.document_text(
        documents(
            spark,
            ("raw/sample.txt", "Queue ID: QW-1\nCapacity: 50 MW\n", "text/plain"),
            ("raw/x.bin", bytes(range(256)) * 4 + b"\x00"),
            ("raw/page", "<p>hi</p>", "text/html; charset=utf-8"),
            ("raw/x.pdf", b"(tiny)"),
        )
    ).collect()
    got = {r.doc_id: r for r in rows}
    assert (got["d0"].route, got["d0"].notes) == ("plain", ["Decoded text payload"])
    assert "QW-1" in got["d0"].text
    assert got["d1"].text is None and got["d1"].error.startswith("Unsupported binary document type")
    assert got["d2"].text == "hi"
    assert got["d3"].notes[1].startswith("Local PDF text extraction failed")
    cut = decode.limit_text(decode.document_text(documents(spark, ("a.txt", "word " * 40))), 50).first()
    assert len(cut.text) == 50
    assert cut.notes[-1] == "Document text truncated from 200 to 50 characters"


def test_bad_document_does_not_stop_the_others(spark):
    docs = documents(
        spark,
        ("a.xlsx", b"not a zip"),
        ("b.xml", "<open>"),
        ("c.csv", "Queue Number,POI,MW\n1,n,5\n"),
        ("d.pdf", b"no table"),
    )
    assert [r.source_queue_id for r in document_records(docs).collect()] == ["q2"]
    notes = {r.doc_id: r.notes for r in extraction_notes(docs).collect()}
    assert notes["d0"][0].startswith("Deterministic project extraction skipped")
    assert notes["d2"] == ["Extracted project rows from CSV"] and notes["d3"] == []


def test_xlsx_order_across_sheets(spark):
    def sheet(value):
        head = "".join(
            f'<c r="{c}1" t="inlineStr"><is><t>{h}</t></is></c>'
            for c, h in zip("ABC", ("Queue Number", "POI", "MW"))
        )
        return (
            f'<w {NS}><row r="1">{head}</row><row r="2"><c r="A2"><v>1</v></c>'
            f'<c r="B2" t="inlineStr"><is><t>{value}</t></is></c><c r="C2"><v>5</v></c></row></w>'
        )

    book = workbook(xl__worksheets__sheet2=sheet("two"), xl__worksheets__sheet10=sheet("ten"))
    rows = keyed_document_rows(documents(spark, ("a.xlsx", book))).orderBy("ord").collect()
    assert [r.source_location for r in rows] == [
        "xl/worksheets/sheet10.xml",
        "xl/worksheets/sheet2.xml",
    ]


def test_fixture_documents_are_packed_row_by_row():
    """In Arrow batches a worker held 64 MB of documents, workbooks or not."""
    for packed in (fixtures.zipped_workbook, fixtures.deflated):
        assert packed.evalType == PythonEvalType.SQL_BATCHED_UDF
    assert fixtures.zipped_workbook.func(None, "<sst/>") is None
    assert fixtures.deflated.func(None) is None
