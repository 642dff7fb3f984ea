"""Inputs of the registered queries, projected from the given tables.

Each function gives a DataFrame whose size follows the tables; `oracle.py` holds
the same projections as SQL.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidemark.operators.records import build_records, records_from_columns

HEADERS = [
    "Queue Number",
    "Project Name",
    "POI",
    "NET MW POI",
    "Status",
    "Date Withdrawn",
    "Interconnection Customer",
    "State",
    "County",
    "Fuel Type",
]
OBSERVED_AT = "2024-01-30 09:00:00"
AS_OF = "2024-01-31 00:00:00"
ROWS_PER_DOCUMENT = 40
#: Rows that a task makes records of at most.
ROWS_PER_TASK = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows over all cores, and over more tasks where a core would have too many of them at once.

    Spark cuts files by bytes, and these rows grow many times wider when records are made of them. The
    count reads the files' footers only. A table with as many partitions already is left as it is.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-rows.count() // ROWS_PER_TASK))
    return rows.repartition(tasks, key) if rows.rdd.getNumPartitions() < tasks else rows


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def text(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


# --- raw rows -------------------------------------------------------------------
def raw_rows(spark: SparkSession, sf_dir: str, raised: Column | None = None) -> DataFrame:
    """Queue rows, one per order; capacity is 25 MW higher where `raised` holds."""
    joined = (
        spread(table(spark, sf_dir, "orders"), "o_orderkey")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    if raised is not None:
        joined = joined.withColumn("extra_mw", F.when(raised, 25).otherwise(0))
    else:
        joined = joined.withColumn("extra_mw", F.lit(0))
    return joined.selectExpr(
        "concat('src-', n_nationkey) AS source_queue_id",
        "o_orderkey AS ord",
        "if(o_orderkey % 17 = 0, 'N/A', concat(' Q-', o_orderkey, ' ')) AS `Queue Number`",
        "c_name AS `Project Name`",
        "if(o_orderkey % 13 = 0, '', concat('Node  ', o_orderpriority)) AS POI",
        "if(o_orderkey % 19 = 0, 'unknown', "
        "concat(cast(floor(o_totalprice / 1000) AS bigint) + extra_mw, '.5 MW')) AS `NET MW POI`",
        "get(array('Under Study', 'DONE', 'Final IA', 'IN SERVICE', 'withdrawn by customer', '', "
        "'Pending'), cast(o_orderkey % 7 AS int)) AS Status",
        "if(o_orderkey % 23 = 0, '2024-01-05', null) AS `Date Withdrawn`",
        "c_mktsegment AS `Interconnection Customer`",
        "n_name AS State",
        "r_name AS County",
        "CASE o_orderstatus WHEN 'F' THEN 'Solar' WHEN 'O' THEN 'Wind' ELSE 'na' END AS `Fuel Type`",
    )


def raw_records(rows: DataFrame) -> DataFrame:
    return records_from_columns(rows, HEADERS)


# --- snapshots ------------------------------------------------------------------
# `columns` names what a query reads of the records besides their keys and first_seen; None: all.
def current_snapshot(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None
) -> DataFrame:
    rows = raw_rows(spark, sf_dir).filter("ord % 11 <> 0")
    return build_records(raw_records(rows), limit=None, columns=columns)


def previous_snapshot(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None
) -> DataFrame:
    rows = raw_rows(spark, sf_dir, F.col("o_orderkey") % 5 == 0)
    rows = rows.filter("ord % 7 <> 0 AND source_queue_id <> 'src-0'")
    return build_records(raw_records(rows), limit=None, columns=columns)


def previous_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that have a snapshot: all but src-0."""
    return (
        table(spark, sf_dir, "nation")
        .filter("n_nationkey <> 0")
        .select(F.concat(F.lit("src-"), text("n_nationkey")).alias("source_queue_id"))
    )


def snapshot_history(
    spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Up to three snapshots per source; source n has 1 + n % 3 of them."""
    parts = []
    for seq, kept in ((1, "ord % 7 <> 0"), (2, "ord % 11 <> 0"), (3, "ord % 13 <> 0")):
        raised = (F.col("o_orderkey") % 5 == 0) if seq == 2 else None
        number = F.regexp_extract("source_queue_id", r"(\d+)$", 1).cast("int")
        rows = raw_rows(spark, sf_dir, raised).filter(kept).filter(number % 3 + 1 >= seq)
        parts.append(
            build_records(raw_records(rows), limit=None, columns=columns).withColumn(
                "snapshot_seq", F.lit(seq).cast("bigint")
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def history_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("src-"), text("n_nationkey")).alias("source_queue_id"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_nationkey") % 3 + 1)).alias(
            "snapshot_seq"
        ),
    )


def source_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("src-"), text("n_nationkey")).alias("source_queue_id"),
        F.concat(F.lit("Utility "), "n_name").alias("utility_name"),
        F.col("n_name").alias("market"),
        F.col("r_name").alias("region"),
        F.lit("queue_xlsx").alias("source_kind"),
    )


def run_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("src-"), text("n_nationkey")).alias("source_queue_id"),
        ntz(OBSERVED_AT).alias("observed_at"),
        F.concat(F.lit("https://example.com/"), text("n_nationkey")).alias("source_url"),
        F.concat(F.lit("raw/src-"), text("n_nationkey")).alias("raw_s3_key"),
    )


# --- insights -------------------------------------------------------------------
def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    event, user = F.col("event_id"), F.col("user_id")
    delta = (
        F.when(F.col("event_type") == "signup", "NEW")
        .when(F.col("event_type") == "click", "UPDATED")
        .when(F.col("event_type") == "error", "REMOVED")
        .when(F.col("event_type") == "view", "BASELINE")
    )
    status = F.array(*[F.lit(s) for s in ("Active", "Withdrawn", "Completed")])
    source = F.concat(F.lit("src-"), text(user % 25))
    review = F.when(event % 10 == 0, "NEEDS_REVIEW").when(event % 10 != 9, "AUTO_REVIEWED")
    return table(spark, sf_dir, "events").select(
        F.concat(source, F.lit("-"), text(event)).alias("queue_id"),
        F.when(event % 8 != 0, source).alias("source_queue_id"),
        F.col("ts").alias("observed_at"),
        F.when(delta.isNotNull(), "PROJECT_DELTA").alias("insight_type"),
        delta.alias("delta_type"),
        F.when(event % 3 != 0, F.concat(F.lit("Q-"), text(event))).alias(
            "interconnection_queue_id"
        ),
        F.concat(F.lit('Project "'), text(user), F.lit('"')).alias("project_name"),
        F.floor("value").cast("bigint").alias("capacity_mw"),
        F.when(event % 11 != 0, F.concat(F.lit("Node "), text(event % 7))).alias(
            "substation_or_node"
        ),
        F.get(status, (event % 3).cast("int")).alias("status"),
        F.when(event % 5 != 0, F.concat(F.lit("Developer "), text(user % 9))).alias(
            "developer_name"
        ),
        F.when(event % 6 != 0, F.concat(F.lit("https://example.com/"), text(event))).alias(
            "source_url"
        ),
        F.when(event % 4 != 0, F.concat(F.lit("raw/"), text(event))).alias("raw_s3_key"),
        F.concat(F.lit("out/"), text(event)).alias("output_s3_key"),
        (F.lit(88) + event % 12).cast("int").alias("hundredths"),
        review.alias("review_status"),
        F.array_compact(F.array(F.when(event % 10 == 0, F.lit("Missing capacity MW")))).alias(
            "review_reasons"
        ),
        F.when(
            F.col("event_type") == "click", F.array(F.lit("CapacityMW"), F.lit("Status"))
        ).alias("changed_fields"),
        F.when(event % 9 != 0, F.concat(F.lit("Market "), text(user % 5))).alias("market"),
        F.when(user % 6 != 0, F.concat(F.lit("Utility "), text(user % 25))).alias("utility_name"),
        F.struct(
            F.concat(F.lit("X-"), text(event)).alias("interconnection_queue_id"),
            F.when(event % 2 == 0, F.lit(7)).cast("bigint").alias("capacity_mw"),
            F.lit("Spare node").alias("substation_or_node"),
            F.lit("Active").alias("status"),
            F.lit(None).cast("string").alias("developer_name"),
        ).alias("extraction"),
    ).withColumn(
        "extraction_confidence", (F.col("hundredths") / 100).cast("decimal(3,2)")
    ).drop("hundredths")


# --- catalog and state ----------------------------------------------------------
def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows as someone might type them, one per customer."""
    key = F.col("c_custkey")
    spelling = F.array(
        *[F.lit(s) for s in ("yes", " TRUE ", "no", "0", "active", "inactive", "1")]
    )
    return table(spark, sf_dir, "customer").select(
        F.when(key % 50 != 7, F.concat(F.lit(" cust-"), text(key))).alias("queue_id"),
        F.when(
            key % 40 != 9,
            F.concat(F.lit("https://example.com/files/"), text(key), F.lit("/open queue.xlsx?v=1")),
        ).alias("url"),
        F.when(key % 8 != 7, F.get(spelling, (key % 7).cast("int"))).alias("active"),
        F.col("c_name").alias("utility"),
        F.when(key % 3 != 0, F.col("c_mktsegment")).alias("Market"),
        F.when(key % 2 == 0, " Yes ").otherwise(F.concat(F.lit("T"), text(key))).alias("Territory"),
    )


def source_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was stored of the customers' sources at their last visit."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").filter("c_custkey % 9 <> 0").select(
        F.concat(F.lit("cust-"), text(key)).alias("source_queue_id"),
        F.when(key % 4 == 0, F.concat(F.lit('etag:"'), text(key), F.lit('"'))).alias(
            "last_remote_fingerprint"
        ),
        F.when(key % 4 == 1, F.concat(F.lit("hash-"), text(key))).alias("last_hash"),
        F.lit("").alias("etag"),
        F.when(key % 4 == 2, F.md5(F.col("c_name").cast("binary")))
        .when(key % 4 == 3, F.concat(F.lit("md5:"), F.md5(F.col("c_mktsegment").cast("binary"))))
        .alias("last_content_md5"),
        F.lit("SUCCEEDED").alias("parser_status"),
        F.when(key % 5 == 0, "timeout").alias("last_error"),
    )


def landed_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan met: response headers, content hash, or an error."""
    key = F.col("c_custkey")
    etag = F.when(key % 8 == 0, F.concat(F.lit(' "'), text(key), F.lit('" '))).when(
        key % 8 == 4, F.lit('"other"')
    )
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("cust-"), text(key)).alias("source_queue_id"),
        F.map_from_entries(
            F.array_compact(
                F.array(
                    F.when(etag.isNotNull(), F.struct(F.lit("ETag").alias("k"), etag.alias("v"))),
                    F.when(
                        key % 8 == 1,
                        F.struct(
                            F.lit("last-modified").alias("k"),
                            F.lit("Wed, 20 May 2026 12:00:00 GMT").alias("v"),
                        ),
                    ),
                    F.when(
                        key % 16 == 1,
                        F.struct(F.lit("CONTENT-LENGTH").alias("k"), text(key).alias("v")),
                    ),
                )
            )
        ).alias("headers"),
        F.when(key % 31 != 0, F.md5(F.col("c_name").cast("binary"))).alias("content_md5"),
        F.when(key % 29 == 0, "HTTPError").alias("fetch_error"),
    )


def document_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document list per customer: three reports and one that does not match."""
    key = F.col("c_custkey")

    def document(name: Column, extension: str, doc: str, month: Column) -> Column:
        return F.struct(
            F.struct(
                name.alias("FriendlyName"),
                F.lit(extension).alias("Extension"),
                F.concat(F.lit(doc), F.lit(" "), text(key)).alias("DocID"),
                F.concat(
                    F.lit("2026-0"), text(month), F.lit("-05T14:31:25-05:00")
                ).alias("PublishDate"),
            ).alias("Document")
        )

    def report(suffix: str) -> Column:
        return F.concat(
            F.when(key % 10 == 3, F.lit("Other_")).otherwise(F.lit("GIS_Report_")), F.lit(suffix)
        )

    documents = F.array(
        document(F.lit("Battery_Report"), "xlsx", "battery", F.lit(9)),
        document(report("A"), "XLSX", "a", key % 5 + 1),
        document(report("B"), "xlsx", "b", key % 7 + 1),
        document(report("C"), "pdf", "c", F.lit(9)),
    )
    payload = F.to_json(
        F.struct(F.struct(documents.alias("DocumentList")).alias("ListDocsByRptTypeRes"))
    )
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("cust-"), text(key)).alias("source_queue_id"),
        F.concat(F.lit("https://example.com/list/"), text(key)).alias("catalog_url"),
        payload.alias("payload"),
    )


# --- documents ------------------------------------------------------------------
# Row by row: Arrow would hold up to 64 MB of documents a batch in each worker.
@F.udf(T.BinaryType(), useArrow=False)
def zipped_workbook(sheet: str | None, strings: str) -> bytes | None:
    """The workbook of a sheet; null for a document that is none."""
    if sheet is None:
        return None
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as book:
        for name, part in (("xl/worksheets/sheet1.xml", sheet), ("xl/sharedStrings.xml", strings)):
            book.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), part)
    return data.getvalue()


@F.udf(T.BinaryType(), useArrow=False)
def deflated(data: bytes | None) -> bytes | None:
    return None if data is None else zlib.compress(data)


def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The project rows that go into the documents, 40 consecutive orders each."""
    key = F.col("o_orderkey")
    document = F.floor(key / ROWS_PER_DOCUMENT).cast("bigint")
    status = F.array(*[F.lit(s) for s in ("Under Study", "DONE", "Withdrawn", "Pending")])
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").select(
        document.alias("doc"),
        (key % ROWS_PER_DOCUMENT + 1).alias("place"),
        F.concat(F.lit("Q-"), text(key)).alias("number"),
        F.concat(F.lit("Project, "), text("o_custkey")).alias("name"),
        F.concat(F.lit("Node "), "o_orderpriority").alias("node"),
        F.concat(text(F.floor(F.col("o_totalprice") / 1000).cast("bigint")), F.lit(" MW")).alias(
            "capacity"
        ),
        F.get(status, (key % 4).cast("int")).alias("status"),
    )


_EXTENSIONS = ("csv", "html", "xml", "xlsx", "pdf")


def corpus(
    spark: SparkSession,
    sf_dir: str,
    formats: tuple[str, ...] = _EXTENSIONS,
    deflate: bool = False,
) -> DataFrame:
    """Documents in five formats, written from `document_rows`.

    A document has 40 rows by construction, so collecting its lines is bounded.
    With `deflate`, every other PDF holds its text in a compressed stream.
    """
    number, name, node, capacity, status = (
        F.col(c) for c in ("number", "name", "node", "capacity", "status")
    )
    kind = F.get(
        F.array(*[F.lit(e) for e in _EXTENSIONS]), (F.col("doc") % len(_EXTENSIONS)).cast("int")
    )

    def cells(tag: str) -> Column:
        return F.concat(
            *[
                F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
                for c in (number, name, node, capacity, status)
            ]
        )

    place = text(F.col("place") + 1)

    def cell(column: str, value: Column, shared: bool = False) -> Column:
        if shared:
            return F.concat(
                F.lit(f'<c r="{column}'), place, F.lit('" t="s"><v>'), value, F.lit("</v></c>")
            )
        return F.concat(
            F.lit(f'<c r="{column}'),
            place,
            F.lit('" t="inlineStr"><is><t>'),
            value,
            F.lit("</t></is></c>"),
        )

    # The status is shared string 5 + order % 4; the column D is left out, so it is padded.
    status_index = F.array_position(
        F.array(*[F.lit(s) for s in ("Under Study", "DONE", "Withdrawn", "Pending")]), status
    ) + 4
    line = (
        F.when(
            kind == "csv",
            F.concat(
                number, F.lit(',"'), name, F.lit('",'), node, F.lit(","), capacity, F.lit(","), status
            ),
        )
        .when(kind == "html", F.concat(F.lit("<tr>"), cells("td"), F.lit("</tr>")))
        .when(
            kind == "xml",
            F.concat(
                F.lit("<q:project><q:QueueNumber>"),
                number,
                F.lit("</q:QueueNumber><q:ProjectName>"),
                name,
                F.lit("</q:ProjectName><q:POI>"),
                node,
                F.lit("</q:POI><q:CapacityMW> "),
                capacity,
                F.lit(" </q:CapacityMW><q:More><q:Zone>skipped</q:Zone></q:More><q:Status>"),
                status,
                F.lit("</q:Status></q:project>"),
            ),
        )
        .when(
            kind == "xlsx",
            F.concat(
                F.lit('<row r="'),
                place,
                F.lit('">'),
                cell("A", number),
                cell("B", name),
                cell("C", node),
                cell("E", capacity),
                cell("F", text(status_index), shared=True),
                F.lit("</row>"),
            ),
        )
        .otherwise(F.concat(F.lit("("), number, F.lit(" \\(open\\)) Tj ("), node, F.lit(") Tj")))
    )
    documents = (
        document_rows(spark, sf_dir)
        .withColumn("line", line)
        .groupBy("doc")
        .agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"))
        .withColumns({"kind": kind, "body": F.array_join(F.col("lines.line"), "\n")})
        .filter(F.col("kind").isin(*formats))
    )
    body = F.col("body")
    header = "Queue Number,Project Name,POI,Capacity (MW),Status"
    head_cells = "".join(f"<th>{h}</th>" for h in header.split(","))
    whole = (
        F.when(
            kind == "csv",
            F.concat(F.lit(f"Last Updated On,5/21/2026,,,\n\n{header}\n"), body, F.lit("\n")),
        )
        .when(
            kind == "html",
            F.concat(
                F.lit(f"<html><body><p>Open queue</p><table><tr>{head_cells}</tr>"),
                body,
                F.lit("</table><script>var x = '<td>no</td>';</script></body></html>"),
            ),
        )
        .when(
            kind == "xml",
            F.concat(F.lit('<q:queue xmlns:q="urn:queue">'), body, F.lit("</q:queue>")),
        )
        .when(
            kind == "pdf",
            F.concat(F.lit("%PDF-1.4\n1 0 obj\nstream\n"), body, F.lit("\nendstream\nendobj")),
        )
    )
    sheet_head = (
        '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c>'
        '<c r="C1" t="s"><v>2</v></c><c r="E1" t="s"><v>3</v></c><c r="F1" t="s"><v>4</v></c></row>'
    )
    shared = "".join(
        f"<si><t>{s}</t></si>"
        for s in (*header.split(","), "Under Study", "DONE", "Withdrawn", "Pending")
    )
    shared_xml = (
        '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' + shared + "</sst>"
    )
    content = F.when(
        kind == "xlsx",
        zipped_workbook(
            F.when(
                kind == "xlsx",
                F.concat(F.lit(sheet_head), F.coalesce(body, F.lit("")), F.lit("</sheetData></worksheet>")),
            ),
            F.lit(shared_xml),
        ),
    ).otherwise(F.encode(whole, "UTF-8"))
    if deflate:
        packed = (kind == "pdf") & (F.col("doc") % 2 == 0)
        content = F.when(
            packed,
            F.concat(
                F.encode(F.lit("%PDF-1.4\nstream\n"), "UTF-8"),
                deflated(F.when(packed, F.encode(body, "UTF-8"))),
                F.encode(F.lit("\nendstream\n"), "UTF-8"),
            ),
        ).otherwise(content)
    return documents.select(
        F.concat(F.lit("feed-"), text("doc")).alias("source_queue_id"),
        F.concat(F.lit("doc-"), text("doc")).alias("doc_id"),
        F.concat(F.lit("raw/doc-"), text("doc"), F.lit("."), "kind").alias("path"),
        F.lit(None).cast("string").alias("content_type"),
        content.alias("content"),
    )


# --- matrices, responses, leads -------------------------------------------------
HEADER_A = ["Queue Number", "Project Name", "POI", "Capacity (MW)", "Status"]
HEADER_B = ["Status", "Queue Number", "Capacity (MW)", "Capacity (MW)", "Project Name", ""]


def matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sheet per nation: two preamble rows, a header, data, another header, data.

    Nations with key % 10 = 9 lack the first header, so their first data rows belong
    to none. Orders with key % 1000 = 500 stand for the second header.
    """
    nation = table(spark, sf_dir, "nation")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = spread(table(spark, sf_dir, "orders"), "o_orderkey").join(
        customers, F.col("o_custkey") == F.col("c_custkey")
    )
    key = F.col("o_orderkey")

    def strings(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    tops = nation.select(
        "n_nationkey",
        F.posexplode(
            F.array(
                strings(["Last Updated On", "5/21/2026"]),
                strings(["", " "]),
                F.when(F.col("n_nationkey") % 10 == 9, strings(["No header"])).otherwise(
                    strings(HEADER_A)
                ),
            )
        ).alias("row_seq", "cells"),
    )
    number = F.concat(F.lit("Q-"), text(key))
    name = F.concat(F.lit(" Project  "), text("o_custkey"))
    capacity = text(F.floor(F.col("o_totalprice") / 1000).cast("bigint"))
    cells = (
        F.when(key % 1000 == 500, strings(HEADER_B))
        .when(key % 25 == 0, strings(["", " ", ""]))
        .when(
            F.coalesce(key % 1000 > 500, F.lit(False)),
            F.array(F.lit("Pending"), number, capacity, F.when(key % 3 == 0, "").otherwise("12"), name),
        )
        .otherwise(F.array(number, name, F.col("o_orderpriority"), capacity, F.lit("DONE"), F.lit("x")))
    )
    body = orders.select("c_nationkey", (key + 3).alias("row_seq"), cells.alias("cells"))
    both = tops.select("n_nationkey", F.col("row_seq").cast("bigint"), "cells").union(body)
    return both.select(
        F.concat(F.lit("src-"), text("n_nationkey")).alias("source_queue_id"),
        F.concat(F.lit("doc-"), text("n_nationkey")).alias("doc_id"),
        F.lit("sheet").alias("sheet"),
        "row_seq",
        F.col("row_seq").alias("ord"),
        (F.col("row_seq") + 1).alias("row_number"),
        "cells",
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers: clean, wrapped in prose, short of keys, with a bad status, not JSON."""
    key = F.col("o_orderkey")
    body = F.concat(
        F.lit('{"interconnection_queue_id": " QW-'),
        text(key),
        F.lit(' ", "capacity_mw": '),
        F.when(key % 4 == 0, "null")
        .when(key % 4 == 1, F.concat(text(key % 300), F.lit(".5")))
        .when(key % 4 == 2, F.concat(F.lit('"'), text(key % 300), F.lit('.2 MW"')))
        .otherwise(text(key % 300)),
        F.lit(', "substation_or_node": '),
        F.when(key % 6 == 0, '"n/a"').otherwise('"Oak Creek"'),
        F.lit(', "status": "'),
        F.when(key % 5 == 3, "Unclear").otherwise("queued"),
        F.lit('", "developer_name": '),
        F.when(key % 7 == 0, "null").otherwise('"Example Solar"'),
        F.lit("}"),
    )
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").select(
        key.alias("response_id"),
        F.when(key % 5 == 1, F.concat(F.lit("Here it is: "), body, F.lit(" Thank you.")))
        .when(key % 5 == 2, F.lit('{"status": "queued", "capacity_mw": 5}'))
        .when(key % 35 == 4, F.lit("no object here"))
        .otherwise(body)
        .alias("response"),
        F.when(key % 8 == 0, F.array(F.lit("Document text truncated from 9 to 5 characters")))
        .when(key % 9 == 0, F.array(F.lit("Attempted local best-effort PDF text extraction")))
        .otherwise(F.array(F.lit("Decoded text payload")))
        .alias("notes"),
    )


def lead_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    email = F.when(key % 4 == 1, "not-an-email").otherwise(
        F.concat(F.lit(" Buyer"), text(key), F.lit("@Example.com "))
    )
    good = F.to_json(
        F.struct(
            email.alias("email"),
            F.when(key % 4 == 2, " ").otherwise(F.col("c_name")).alias("company"),
            F.lit("Power Strategy").alias("role"),
            F.col("c_mktsegment").alias("territories"),
            F.when(key % 12 == 3, "").otherwise("Monitor withdrawals").alias("use_case"),
        )
    )
    return table(spark, sf_dir, "customer").select(
        key.alias("c_custkey"),
        F.when(key % 20 == 0, "[1, 2]").when(key % 20 == 8, "{broken").otherwise(good).alias("body"),
    )
