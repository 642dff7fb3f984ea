"""Catalog rows, requests, fingerprints, changes, state."""

import json

from pyspark.sql import functions as F

from tidemark.operators import catalog as cat
from tidemark.sources import catalog as files


def test_synonyms_and_extras(spark):
    rows = spark.createDataFrame(
        [("valley-power", "https://grid.test/list.xlsx", "yes", "Valley Power", "Upper Valley", " No "),
         (None, "u", None, None, None, None)],
        "queue_id string, url string, active string, utility string, Territory string, Flag string",
    )
    good = cat.accepted(cat.normalize_catalog(rows, default_active=False)).first()
    assert (good.source_queue_id, good.source_url, good.active) == ("valley-power", "https://grid.test/list.xlsx", True)
    assert good.extra == {"UtilityName": "Valley Power", "Territory": "Upper Valley", "Flag": "false"}
    bad = cat.rejected(cat.normalize_catalog(rows, default_active=False)).first()
    assert bad.error == "Each record requires QueueID and SourceURL" and bad.active is False


def test_catalog_files(spark, tmp_path):
    header = "QueueID,SourceURL,Active,Notes\n"
    (tmp_path / "c.csv").write_text('﻿' + header + 'a,https://e.com,true,"two, parts"\n', encoding="utf-8")
    row = files.read_catalog_csv(spark, str(tmp_path / "c.csv")).first()
    assert (row.QueueID, row.Notes) == ("a", "two, parts")
    (tmp_path / "o.json").write_text(json.dumps({"queues": [{"QueueID": "a"}, {"QueueID": "b"}]}))
    (tmp_path / "l.json").write_text(json.dumps([{"QueueID": "a"}]))
    assert files.read_catalog_json(spark, str(tmp_path / "o.json")).count() == 2
    both = files.with_single(files.read_catalog_json(spark, str(tmp_path / "l.json")), "z", "https://z")
    assert sorted(r.QueueID for r in both.collect()) == ["a", "z"]
    docs = spark.createDataFrame([('[{"QueueID": "a"}]',), ('{"queues": [{"QueueID": "b"}]}',)], "document string")
    assert sorted(r.QueueID for r in files.rows_from_json(docs, ["QueueID"]).collect()) == ["a", "b"]


def test_active_words(spark):
    rows = spark.createDataFrame([(v,) for v in ("yes", "ACTIVE ", "no", "", None)], "active string")
    assert [r[0] for r in rows.select(cat.is_active("active")).collect()] == [True, True, False, False, True]


def test_header_fingerprints(spark):
    headers = [
        {"ETag": '"abc123"', "Last-Modified": "Wed", "Content-Length": "100"},
        {"last-modified": "Wed, 20 May 2026 12:00:00 GMT", "CONTENT-LENGTH": "100"},
        {"Last-Modified": "Wed"},
        {"Server": "x"},
    ]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(headers)], "i int, h map<string,string>")
    got = [r[0] for r in rows.orderBy("i").select(cat.header_fingerprint("h")).collect()]
    assert got == [
        'etag:"abc123"',
        "metadata:last-modified=Wed, 20 May 2026 12:00:00 GMT;length=100",
        "metadata:last-modified=Wed;length=unknown",
        None,
    ]


def test_raw_paths(spark):
    rows = spark.createDataFrame(
        [
            (0, "north/river 7", "https://grid.test/lists/pending projects.xlsx", None),
            (1, "gis", "https://grid.test/fetch/item?number=77", "Study List 7.xlsx"),
            (2, "x", "https://e.com", None),
            (3, "x", "https://grid.test/a/Open%20Items?x=/y.z", None),
        ],
        "i int, q string, u string, h string",
    )
    time = F.lit("2026-05-21 09:00:00").cast("timestamp_ntz")
    got = [r[0] for r in rows.orderBy("i").select(cat.raw_path("q", "u", time, "h")).collect()]
    assert got == [
        "raw/north-river-7/2026/05/21/20260521T090000Z-pending-projects.xlsx",
        "raw/gis/2026/05/21/20260521T090000Z-Study-List-7.xlsx",
        "raw/x/2026/05/21/20260521T090000Z-queue-document.bin",
        "raw/x/2026/05/21/20260521T090000Z-Open-Items.bin",
    ]


def test_request_headers(spark):
    rows = spark.createDataFrame([(0, '{"Accept": "text/html"}', "a=1"), (1, None, None), (2, "[1]", None), (3, "{bad", None)], "i int, h string, c string")
    got = rows.orderBy("i").select(cat.request_headers("h", "c").alias("m"), cat.request_headers_error("h").alias("e")).collect()
    assert got[0].m == {"Accept": "text/html", "Cookie": "a=1"} and got[0].e is None
    assert got[1].m == {} and got[1].e is None
    assert got[2].e == got[3].e == "RequestHeaders must be a JSON object"


def test_latest_document(spark):
    def document(name, doc_id, date, extension="xlsx"):
        return {"Document": {"FriendlyName": name, "Extension": extension, "DocID": doc_id, "PublishDate": date}}

    payload = {"ListDocsByRptTypeRes": {"DocumentList": [
        document("Other_List", "other", "2027-03-05T01:02:03-05:00"),
        document("GIS_Report_One", "one", "2027-01-09T08:00:00-05:00"),
        document("GIS_Report_Two", "two", "2027-02-11T09:30:00-05:00"),
        document("GIS_Report_Three", "three", "2027-02-11T09:30:00-05:00"),
        document("GIS_Report_Pdf", "pdf", "2027-04-01T09:30:00-05:00", "pdf"),
    ]}}
    rows = spark.createDataFrame([("e", "u", json.dumps(payload)), ("none", "u", "{}")], "source_queue_id string, catalog_url string, payload string")
    got = {r.source_queue_id: r for r in cat.latest_document(rows).collect()}
    assert got["e"].source_url.endswith("doclookupId=two")
    assert got["e"].filename_hint == "GIS_Report_Two.xlsx" and got["e"].error is None
    assert got["none"].error


def test_change_status(spark):
    cases = [
        ("etag:1", "etag:1", "m", "unchanged"),
        ("etag:2", "etag:1", "m", "changed"),
        (None, "md5:m", "m", "unchanged"),
        (None, "m", "m", "unchanged"),
        ("", "md5:m", "m", "unchanged"),
        (None, None, "m", "changed"),
        ("etag:1", "md5:m", "m", "changed"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, r string, s string, m string, e string")
    for row in rows.select("e", cat.change_status("r", "s", "m").alias("got")).collect():
        assert row.got == row.e


def test_state_upsert_sets_only_given_columns(spark):
    state = spark.createDataFrame([("a", "f", "PENDING", "boom"), ("b", "g", "SUCCEEDED", "")], "source_queue_id string, fp string, parser_status string, last_error string")
    updates = spark.createDataFrame([("a", "f2", ""), ("c", "h", "")], "source_queue_id string, fp string, last_error string")
    got = sorted(tuple(r) for r in cat.upsert_state(state, updates).collect())
    assert got == [("a", "f2", "PENDING", ""), ("b", "g", "SUCCEEDED", ""), ("c", "h", None, "")]


def test_catalog_upsert_keeps_created(spark):
    schema = "source_queue_id string, source_url string, active boolean, extra map<string,string>"
    old = spark.createDataFrame([("a", "u0", True, {"Market": "M", "Zone": "Z"}, "c0", "c0"), ("b", "u", True, {}, "c0", "c0")], schema + ", created_at string, updated_at string")
    new = spark.createDataFrame([("a", "u1", False, {"Market": "N"}), ("c", "u", True, None)], schema)
    got = {r.source_queue_id: r for r in cat.upsert_catalog(old, new, F.lit("now")).collect()}
    assert (got["a"].source_url, got["a"].active, got["a"].extra) == ("u1", False, {"Market": "N", "Zone": "Z"})
    assert (got["a"].created_at, got["a"].updated_at, got["b"].updated_at, got["c"].created_at) == ("c0", "now", "c0", "now")


def test_resolver_names(spark):
    rows = spark.createDataFrame([(None,), ("Direct",), ("ftp",)], "r string")
    assert [r[0] for r in rows.select(cat.resolver_error("r")).collect()] == [None, None, "Unsupported source resolver: ftp"]
