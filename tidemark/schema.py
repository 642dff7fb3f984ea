"""Schemas of the stored tables, as DDL."""

from __future__ import annotations

_EXTRACTION = (
    "struct<interconnection_queue_id: string, capacity_mw: bigint, "
    "substation_or_node: string, status: string, developer_name: string>"
)

# One row per project and snapshot; `previous_id` is the snapshot of its source before that one.
SNAPSHOT = """
    source_queue_id string, project_key string, ord bigint, interconnection_queue_id string,
    project_name string, capacity_mw bigint, capacity_source_field string,
    substation_or_node string, status string, developer_name string, county string, state string,
    zone string, fuel_type string, extraction_confidence decimal(3,2), review_status string,
    review_reasons array<string>, source_location string, source_row_number bigint,
    source_header_row_number bigint, source_row map<string,string>, first_seen bigint,
    record_fingerprint string, previous_id string, snapshot_id string
"""

# One row per source and snapshot; written last, so a row means the snapshot is complete.
MANIFEST = """
    source_queue_id string, observed_at timestamp, raw_s3_key string, content_md5 string,
    byte_count bigint, format string, notes array<string>, truncated boolean,
    record_count bigint, delta_count bigint, persisted_count bigint, snapshot_id string
"""

# What has changed from each version of a source to its next one, by fingerprint; `at_seq` is the
# version whose row tells about the project. Version 0 of a run is the snapshot before it.
STEP = """
    source_queue_id string, project_key string, snapshot_seq bigint, delta_type string,
    at_seq bigint, snapshot_id string
"""

# Documents as they landed, before any of their content is decoded.
LANDED = """
    source_queue_id string, path string, observed_at timestamp, byte_count bigint,
    content_md5 string, snapshot_id string
"""

# Versions of a backlog that gave records, numbered within their source.
VERSION = """
    source_queue_id string, observed_at timestamp, path string, content_md5 string,
    byte_count bigint, format string, notes array<string>, truncated boolean,
    snapshot_seq bigint, snapshot_id string
"""

# Rows of a run's documents as decoded, and one row for each document (no row_seq).
DECODED = """
    source_queue_id string, doc_id string, path string, content_md5 string, byte_count bigint,
    format string, sheet string, row_seq bigint, ord bigint, row_number bigint,
    cells array<string>, own_header array<string>, error string, snapshot_id string
"""

# Documents that gave no records, and why.
REJECT = """
    source_queue_id string, doc_id string, path string, observed_at timestamp, content_md5 string,
    byte_count bigint, error string, error_type string, notes array<string>, snapshot_id string
"""

# Texts of rejected documents, to be answered.
TEXT = """
    source_queue_id string, doc_id string, path string, observed_at timestamp, content_md5 string,
    byte_count bigint, route string, text string, notes array<string>, error string,
    snapshot_id string
"""

# Answers to texts, checked and scored, or why there is none.
EXTRACTION = """
    source_queue_id string, doc_id string, path string, observed_at timestamp, content_md5 string,
    byte_count bigint, notes array<string>, interconnection_queue_id string, capacity_mw bigint,
    substation_or_node string, status string, developer_name string,
    extraction_confidence decimal(3,2), review_status string, review_reasons array<string>,
    error string, error_type string, snapshot_id string
"""

# All deltas of a run, before any cut.
DELTA = SNAPSHOT.replace(
    "previous_id string, snapshot_id string",
    "delta_type string, changed_fields array<string>, delta_rank int, snapshot_id string",
)

INSIGHT = f"""
    queue_id string, observed_at timestamp, insight_type string, source_queue_id string,
    project_key string, delta_type string, changed_fields array<string>, parsed_at timestamp,
    source_url string, catalog_source_url string, raw_s3_bucket string, raw_s3_key string,
    output_s3_key string, content_md5 string, remote_fingerprint string, model_id string,
    utility_name string, market string, region string, source_kind string,
    interconnection_queue_id string, project_name string, capacity_mw bigint,
    capacity_source_field string, substation_or_node string, status string,
    developer_name string, county string, state string, zone string, fuel_type string,
    extraction_confidence decimal(3,2), review_status string, review_reasons array<string>,
    record_fingerprint string, source_location string, source_row_number bigint,
    source_row map<string,string>, extraction {_EXTRACTION}, deleted boolean, snapshot_id string
"""

# What the keyed stream has found; `version` is the snapshot in which it did.
CHANGE = """
    source_queue_id string, project_key string, version string, delta_type string,
    changed_fields array<string>, capacity_mw bigint, status string, snapshot_id string
"""

# Sources that have sent nothing for longer than agreed.
SILENT = "source_queue_id string, last_observed_at timestamp, silent_at timestamp, snapshot_id string"

# Tries of a document's content that have failed: waiting for the next one, dead, or settled.
ATTEMPT = """
    source_queue_id string, content_md5 string, path string, attempts bigint, status string,
    error string, first_at timestamp, last_at timestamp, next_at timestamp, snapshot_id string
"""

CATALOG = """
    source_queue_id string, source_url string, active boolean, extra map<string,string>,
    created_at timestamp, updated_at timestamp, snapshot_id string
"""

STATE = """
    source_queue_id string, last_checked_at timestamp, last_changed_at timestamp,
    last_remote_fingerprint string, last_hash string, etag string, last_content_md5 string,
    parser_status string, last_error string, last_error_type string, last_snapshot_id string,
    last_record_count bigint, last_delta_count bigint, pending_fingerprint string,
    last_parsed_at timestamp, last_raw_key string, last_format string, last_bytes bigint,
    last_delta_summary string, last_extraction_confidence decimal(3,2),
    last_review_status string, snapshot_id string
"""

# Leads, and what was sent in place of one with the first rule it breaks.
LEAD = """
    lead_id string, created_at timestamp, email string, name string, company string, role string,
    priority_territories string, use_case string, status string, source string, error string,
    snapshot_id string
"""

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
