"""Source catalog and state: normalise, select, detect changes, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import (
    as_column,
    extra_value,
    first_non_empty,
    non_empty,
    sanitize_path_part,
    strip,
    truthy,
    unquote,
)
from tidemark.operators.ranking import first_per_group
from tidemark.vocabulary import METADATA_KEYS

# Spellings of the catalog columns, in order of preference (fixed values).
ID_SPELLINGS = ("QueueID", "queue_id", "id")
URL_SPELLINGS = ("SourceURL", "source_url", "url", "URL")
ACTIVE_SPELLINGS = ("Active", "active")
SCANNED_URL_SPELLINGS = ("SourceURL", "source_url", "URL", "Url")
# Other column names that are renamed, compared in lower case (fixed values).
CANONICAL_NAMES = {
    "queue_id": "QueueID",
    "id": "QueueID",
    "source_url": "SourceURL",
    "url": "SourceURL",
    "active": "Active",
    "utility": "UtilityName",
    "utility_name": "UtilityName",
}

MISSING_REQUIRED = "Each record requires QueueID and SourceURL"
# Defaults of the document-list resolver (fixed values).
DOCUMENT_PREFIX = "GIS_Report_"
DOCUMENT_EXTENSION = "xlsx"
RESOLVERS = ("", "direct", "ercot_ice_doclist")
DOWNLOAD_BASE = "https://www.ercot.com/misdownload/servlets/mirDownload?doclookupId="
DOCUMENT_LIST_TYPE = (
    "ListDocsByRptTypeRes struct<DocumentList: array<struct<Document: struct<"
    "FriendlyName: string, Extension: string, DocID: string, PublishDate: string, "
    "ConstructedName: string>>>>"
)


# --- catalog rows ---------------------------------------------------------------
def _spelled(rows: DataFrame, spellings: tuple[str, ...]) -> Column:
    found = [F.col(f"`{s}`").cast("string") for s in spellings if s in rows.columns]
    return first_non_empty(*found) if found else F.lit(None).cast("string")


def canonical_name(column: str) -> str:
    name = column.strip()
    return CANONICAL_NAMES.get(name.lower(), name)


def normalize_catalog(rows: DataFrame, default_active: bool = True) -> DataFrame:
    """Catalog rows under canonical names; `error` is set when a required field is missing.

    Columns that are not known keep their values in the map `extra`; yes/no
    words in them become true/false.
    """
    base = {
        "QueueID": strip(_spelled(rows, ID_SPELLINGS)),
        "SourceURL": strip(_spelled(rows, URL_SPELLINGS)),
        "Active": truthy(_spelled(rows, ACTIVE_SPELLINGS), default_active),
    }
    others: dict[str, list[Column]] = {}
    for column in rows.columns:
        name = canonical_name(column)
        if name not in base:
            others.setdefault(name, []).append(F.col(f"`{column}`").cast("string"))
    pairs = []
    for name, columns in others.items():
        # Of several spellings the first with a value wins.
        value = F.coalesce(*[F.when(strip(c) != "", extra_value(c)) for c in columns])
        pairs.append(
            F.when(value.isNotNull(), F.struct(F.lit(name).alias("key"), value.alias("value")))
        )
    extra = (
        F.map_from_entries(F.array_compact(F.array(*pairs)))
        if pairs
        else F.create_map().cast("map<string,string>")
    )
    missing = base["QueueID"].isNull() | base["SourceURL"].isNull()
    return rows.select(
        base["QueueID"].alias("source_queue_id"),
        base["SourceURL"].alias("source_url"),
        base["Active"].alias("active"),
        extra.alias("extra"),
        F.when(missing, F.lit(MISSING_REQUIRED)).alias("error"),
    )


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("error").isNull()).drop("error")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("error").isNotNull())


def is_active(active: Column | str) -> Column:
    """Absent means active; an empty or unknown word does not."""
    text = as_column(active).cast("string")
    return F.coalesce(
        F.lower(strip(text)).isin("1", "true", "yes", "y", "active"), F.lit(True)
    )


def active_sources(catalog: DataFrame) -> DataFrame:
    return catalog.filter(is_active("active"))


def queue_metadata(extra: Column | str = "extra") -> Column:
    """MAP of the seven descriptive keys, blank ones left out."""
    return F.map_filter(
        as_column(extra), lambda k, v: k.isin(*METADATA_KEYS) & (F.coalesce(v, F.lit("")) != "")
    )


def upsert_catalog(existing: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Incoming catalog rows over existing ones.

    created_at is kept, updated_at always set; a field that is not given keeps
    its old value, and rows that are not given stay as they are. Keys are unique
    on both sides: `latest_by_source` first when a batch may name a source twice.
    """
    old, new = existing.alias("old"), incoming.alias("new")
    given = F.col("new.source_queue_id").isNotNull()
    fields = [c for c in incoming.columns if c not in ("source_queue_id", "extra")]
    extra = F.when(
        given,
        F.map_concat(
            F.map_filter(
                F.coalesce(F.col("old.extra"), F.create_map().cast("map<string,string>")),
                lambda k, _: ~F.array_contains(
                    F.coalesce(F.map_keys(F.col("new.extra")), F.array().cast("array<string>")), k
                ),
            ),
            F.coalesce(F.col("new.extra"), F.create_map().cast("map<string,string>")),
        ),
    ).otherwise(F.col("old.extra"))
    return old.join(new, "source_queue_id", "full_outer").select(
        "source_queue_id",
        *[F.coalesce(f"new.{f}", f"old.{f}").alias(f) for f in fields],
        extra.alias("extra"),
        F.coalesce("old.created_at", F.when(given, now)).alias("created_at"),
        F.when(given, now).otherwise(F.col("old.updated_at")).alias("updated_at"),
    )


# --- requests and resolution -------------------------------------------------------
def request_headers(headers: Column | str, cookie: Column | str) -> Column:
    """MAP of request headers from JSON object text, the cookie replacing any Cookie in it."""
    parsed = F.from_json(as_column(headers), "map<string,string>")
    base = F.coalesce(parsed, F.create_map().cast("map<string,string>"))
    given = non_empty(cookie)
    return F.when(
        given.isNotNull(),
        F.map_concat(
            F.map_filter(base, lambda k, _: k != "Cookie"), F.create_map(F.lit("Cookie"), given)
        ),
    ).otherwise(base)


def request_headers_error(headers: Column | str) -> Column:
    text = as_column(headers)
    blank = F.coalesce(strip(text), F.lit("")) == ""
    is_object = F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT")
    return F.when(
        ~blank & ~F.coalesce(is_object, F.lit(False)),
        F.lit("RequestHeaders must be a JSON object"),
    )


def resolver_error(resolver: Column | str) -> Column:
    name = F.lower(strip(F.coalesce(as_column(resolver), F.lit(""))))
    return F.when(~name.isin(*RESOLVERS), F.concat(F.lit("Unsupported source resolver: "), name))


def latest_document(lists: DataFrame) -> DataFrame:
    """Newest matching document of each source's document list.

    `lists` carries source_queue_id, catalog_url, payload (JSON text) and, where
    set, document_name_prefix and document_extension. A source without a match,
    or whose newest match has no id, gets an `error`. The choice is made inside
    each list, so nothing is shuffled.
    """

    def setting(name: str, default: str) -> Column:
        given = F.col(name) if name in lists.columns else F.lit(None).cast("string")
        return strip(F.coalesce(non_empty(given), F.lit(default)))

    entries = F.from_json("payload", DOCUMENT_LIST_TYPE)["ListDocsByRptTypeRes"]["DocumentList"]
    rows = lists.select(
        "source_queue_id",
        "catalog_url",
        setting("document_name_prefix", DOCUMENT_PREFIX).alias("prefix"),
        F.lower(setting("document_extension", DOCUMENT_EXTENSION)).alias("extension"),
        F.coalesce(entries, F.array().cast(_entry_type())).alias("entries"),
    )
    documents = F.transform(
        "entries",
        lambda e, i: F.struct(
            F.coalesce(e["Document"]["PublishDate"], F.lit("")).alias("publish_date"),
            # Of documents published at the same time the first listed wins.
            (-i).alias("earliness"),
            F.coalesce(e["Document"]["FriendlyName"], F.lit("")).alias("friendly_name"),
            F.lower(F.coalesce(e["Document"]["Extension"], F.lit(""))).alias("extension"),
            strip(F.coalesce(e["Document"]["DocID"], F.lit(""))).alias("doc_id"),
            F.coalesce(e["Document"]["ConstructedName"], F.lit("")).alias("constructed_name"),
        ),
    )
    matching = F.filter(
        documents,
        lambda d: d["friendly_name"].startswith(F.col("prefix"))
        & (d["extension"] == F.col("extension")),
    )
    best = rows.withColumn("best", F.array_max(matching))
    no_id = F.col("best.doc_id") == ""
    name = F.coalesce(
        non_empty(F.col("best.friendly_name")), F.concat(F.lit("ercot-"), "best.doc_id")
    )
    return best.select(
        "source_queue_id",
        "catalog_url",
        F.col("best.doc_id").alias("doc_id"),
        name.alias("friendly_name"),
        F.col("best.publish_date").alias("publish_date"),
        F.col("best.constructed_name").alias("constructed_name"),
        F.concat(
            F.lit(DOWNLOAD_BASE),
            F.replace(F.url_encode("best.doc_id"), F.lit("+"), F.lit("%20")),
        ).alias("source_url"),
        F.concat(name, F.lit("."), "extension").alias("filename_hint"),
        F.when(F.col("best").isNull(), "No document matched the prefix and extension")
        .when(no_id, "Latest document did not include DocID")
        .alias("error"),
    )


def _entry_type() -> str:
    return (
        "array<struct<Document: struct<FriendlyName: string, Extension: string, "
        "DocID: string, PublishDate: string, ConstructedName: string>>>"
    )


def raw_path(
    source: Column | str, url: Column | str, observed_at: Column | str, hint: Column | str
) -> Column:
    """raw/source/yyyy/MM/dd/time-filename of a landed document."""
    # Last path segment of the URL; query and fragment are no part of it.
    location = F.regexp_extract(as_column(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    base = F.substring_index(location, "/", -1)
    default = F.lit("queue-document")
    name = first_non_empty(hint, base, default)
    name = sanitize_path_part(F.coalesce(non_empty(strip(unquote(name))), default))
    named = F.when(name.contains("."), name).otherwise(F.concat(name, F.lit(".bin")))
    time = as_column(observed_at)
    return F.concat(
        F.lit("raw/"),
        sanitize_path_part(source),
        F.date_format(time, "'/'yyyy/MM/dd/"),
        F.date_format(time, "yyyyMMdd'T'HHmmss'Z-'"),
        named,
    )


# --- fingerprints -------------------------------------------------------------------
def header_fingerprint(headers: Column | str) -> Column:
    """Fingerprint from a MAP of response headers, null when they do not suffice."""
    lowered = F.transform(
        F.map_entries(as_column(headers)),
        lambda e: F.struct(F.lower(e["key"]).alias("key"), strip(e["value"]).alias("value")),
    )

    def header(name: str) -> Column:
        # The first header of that name counts, also when it is empty.
        return non_empty(F.get(F.filter(lowered, lambda e: e["key"] == name), F.lit(0))["value"])

    length = F.coalesce(header("content-length"), F.lit("unknown"))
    return F.coalesce(
        F.concat(F.lit("etag:"), header("etag")),
        F.concat(
            F.lit("metadata:last-modified="), header("last-modified"), F.lit(";length="), length
        ),
    )


def probe_fingerprint(
    content: Column | str,
    length: Column | str | None = None,
    content_range: Column | str | None = None,
    probe_bytes: int | None = None,
) -> Column:
    """md5 of what was read with its size and the reported length and range.

    `probe_bytes` is for sources of which only the first bytes were fetched (PROBE_BYTES, as a rule):
    a change behind them with an equal length goes unseen then. Landed content is hashed whole."""
    whole = as_column(content)
    head = whole if probe_bytes is None else F.substring(whole, 1, probe_bytes)

    def reported(value: Column | str | None, default: str) -> Column:
        if value is None:
            return F.lit(default)
        return F.coalesce(non_empty(as_column(value).cast("string")), F.lit(default))

    return F.concat(
        F.lit("probe-md5:"),
        F.md5(head),
        F.lit(";bytes="),
        F.octet_length(head).cast("string"),
        F.lit(";length="),
        reported(length, "unknown"),
        F.lit(";range="),
        reported(content_range, "none"),
    )


def stored_fingerprint(
    last_remote: Column | str, last_hash: Column | str, etag: Column | str, last_md5: Column | str
) -> Column:
    """First stored fingerprint; a bare md5 gets its prefix."""
    md5 = strip(non_empty(last_md5))
    return F.coalesce(
        strip(non_empty(last_remote)),
        strip(non_empty(last_hash)),
        strip(non_empty(etag)),
        F.when(md5.startswith("md5:"), md5).otherwise(F.concat(F.lit("md5:"), md5)),
    )


def change_status(remote: Column | str, stored: Column | str, content_md5: Column | str) -> Column:
    """unchanged when the remote fingerprint, or without one the content, is as stored."""
    seen, kept, md5 = non_empty(remote), as_column(stored), as_column(content_md5)
    prefixed = F.concat(F.lit("md5:"), md5)
    same = (seen == kept) | (seen.isNull() & ((kept == prefixed) | (kept == md5)))
    return F.when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")


def detect_changes(catalog: DataFrame, state: DataFrame, manifest: DataFrame) -> DataFrame:
    """Status of every active source: changed, unchanged or error.

    `manifest` describes what was last seen of each source (remote_fingerprint,
    content_md5 and fetch_error, any of them null). Catalog rows without id or
    URL are errors. Sources are unique on all sides, so no join key is hot.
    """
    scanned = active_sources(catalog)
    joined = scanned.join(state, "source_queue_id", "left").join(
        manifest, "source_queue_id", "left"
    )
    malformed = (F.coalesce(strip("source_queue_id"), F.lit("")) == "") | (
        F.coalesce(strip("source_url"), F.lit("")) == ""
    )
    stored = stored_fingerprint(
        "last_remote_fingerprint", "last_hash", "etag", "last_content_md5"
    )
    landed = F.col("remote_fingerprint").isNotNull() | F.col("content_md5").isNotNull()
    return joined.select(
        "source_queue_id",
        "source_url",
        stored.alias("stored_fingerprint"),
        F.coalesce(
            non_empty("remote_fingerprint"), F.concat(F.lit("md5:"), "content_md5")
        ).alias("new_fingerprint"),
        F.when(malformed | F.col("fetch_error").isNotNull() | ~landed, "error")
        .otherwise(change_status("remote_fingerprint", stored, "content_md5"))
        .alias("scan_status"),
    )


def scan_summary(changes: DataFrame) -> DataFrame:
    """Counts of one scan; every changed source is handed to the parser."""

    def times(status: str) -> Column:
        return F.count_if(F.col("scan_status") == status)

    return changes.agg(
        F.count("*").alias("total_targets"),
        times("changed").alias("changed"),
        times("unchanged").alias("unchanged"),
        times("error").alias("errors"),
        times("changed").alias("parser_invocations"),
    )


# --- state -----------------------------------------------------------------------------
def upsert_state(state: DataFrame, updates: DataFrame) -> DataFrame:
    """State with updates applied: an update sets only the columns it carries.

    Null means "not set"; errors are cleared with the empty string.
    """
    old, new = state.alias("old"), updates.alias("new")
    columns = [c for c in state.columns if c != "source_queue_id"]
    added = [c for c in updates.columns if c != "source_queue_id" and c not in columns]
    merged = [
        F.coalesce(f"new.{c}", f"old.{c}").alias(c) if c in updates.columns else F.col(f"old.{c}")
        for c in columns
    ]
    return old.join(new, "source_queue_id", "full_outer").select(
        "source_queue_id", *merged, *[F.col(f"new.{c}") for c in added]
    )


def changed_update(changes: DataFrame, checked_at: Column, observed_at: Column) -> DataFrame:
    """State columns set for changed sources."""
    return changes.filter(F.col("scan_status") == "changed").select(
        "source_queue_id",
        checked_at.alias("last_checked_at"),
        observed_at.alias("last_changed_at"),
        F.col("new_fingerprint").alias("last_remote_fingerprint"),
        F.lit("PENDING").alias("parser_status"),
        F.lit("").alias("last_error"),
        F.lit("").alias("last_error_type"),
    )


def unchanged_update(changes: DataFrame, checked_at: Column) -> DataFrame:
    """State columns set for unchanged sources."""
    return changes.filter(F.col("scan_status") == "unchanged").select(
        "source_queue_id",
        checked_at.alias("last_checked_at"),
        F.col("new_fingerprint").alias("last_remote_fingerprint"),
        F.lit("").alias("last_error"),
        F.lit("").alias("last_error_type"),
    )


def error_update(
    changes: DataFrame, checked_at: Column, message: Column, error_type: Column
) -> DataFrame:
    """State columns set for sources that could not be checked."""
    return changes.filter(F.col("scan_status") == "error").select(
        "source_queue_id",
        checked_at.alias("last_checked_at"),
        message.alias("last_error"),
        error_type.alias("last_error_type"),
    )


def latest_by_source(rows: DataFrame, version: str) -> DataFrame:
    """One row per source: the one with the greatest version."""
    return first_per_group(rows, ["source_queue_id"], F.col(version))
