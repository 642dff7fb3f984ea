"""SQL with the same results as the registered queries, for DuckDB.

Written from the described behaviour of each operator over the same input
projections; nothing here calls the library.
"""

from __future__ import annotations

NULL_WORDS = "('n/a', 'na', 'none', 'null', 'unknown')"
OBSERVED = "TIMESTAMP '2024-01-30 09:00:00'"
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


# --- snippets -------------------------------------------------------------------
def clean(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def nullable(x: str) -> str:
    return f"(CASE WHEN trim({x}) <> '' AND lower(trim({x})) NOT IN {NULL_WORDS} THEN trim({x}) END)"


def header(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"


def number(x: str) -> str:
    return (
        rf"TRY_CAST(nullif(regexp_extract(replace({x}, ',', ''), '-?\d+(?:\.\d+)?'), '') AS DOUBLE)"
    )


def whole(x: str) -> str:
    return f"CAST(round_even({x}, 0) AS BIGINT)"


def sanitize(x: str, allowed: str = "A-Za-z0-9_.=:", limit: int = 160) -> str:
    dashed = f"trim(regexp_replace({x}, '[^{allowed}-]', '-', 'g'), '-')"
    short = f"substr({dashed}, 1, {limit - 17}) || '-' || substr(sha256({dashed}), 1, 16)"
    kept = f"(CASE WHEN length({dashed}) > {limit} THEN {short} ELSE {dashed} END)"
    return f"coalesce(nullif({kept}, ''), 'unknown')"


def status_word(x: str) -> str:
    return f"""(CASE
      WHEN lower(trim({x})) IN ('done', 'in service', 'commercial operation', 'commercial operations',
        'complete', 'completed', 'operational', 'energized') THEN 'Completed'
      WHEN lower(trim({x})) IN ('withdraw', 'withdrawn', 'inactive', 'ina') THEN 'Withdrawn'
      WHEN lower(trim({x})) IN ('active', 'under study', 'planned', 'pln', 'queued', 'pending')
        THEN 'Active' END)"""


def infer_status(status: str, withdrawn: str, strict: bool = False) -> str:
    def has(words: list[str]) -> str:
        if strict:
            return rf"regexp_matches(lower({status}), '\b({'|'.join(words)})\b')"
        return "(" + " OR ".join(f"contains(lower({status}), '{w}')" for w in words) + ")"

    return f"""(CASE WHEN {withdrawn} IS NOT NULL THEN 'Withdrawn'
      WHEN {status_word(status)} IS NOT NULL THEN {status_word(status)}
      WHEN {has(['withdraw', 'inactive', 'ina'])} THEN 'Withdrawn'
      WHEN {has(['done', 'complete', 'service', 'energized', 'commercial operation'])} THEN 'Completed'
      ELSE 'Active' END)"""


def iso(x: str) -> str:
    return f"""(strftime({x}, '%Y-%m-%dT%H:%M:%S') ||
      CASE WHEN strftime({x}, '%f') = '000000' THEN '' ELSE '.' || strftime({x}, '%f') END || 'Z')"""


# --- raw rows and records ---------------------------------------------------------
def raw_rows(raised: str = "false") -> str:
    return f"""
  SELECT 'src-' || n_nationkey AS source_queue_id, o_orderkey AS ord,
    CASE WHEN o_orderkey % 17 = 0 THEN 'N/A' ELSE ' Q-' || o_orderkey || ' ' END AS q_number,
    c_name AS q_name,
    CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'Node  ' || o_orderpriority END AS q_poi,
    CASE WHEN o_orderkey % 19 = 0 THEN 'unknown'
      ELSE (CAST(floor(o_totalprice / 1000) AS BIGINT) + CASE WHEN {raised} THEN 25 ELSE 0 END) || '.5 MW'
      END AS q_mw,
    CASE o_orderkey % 7 WHEN 0 THEN 'Under Study' WHEN 1 THEN 'DONE' WHEN 2 THEN 'Final IA'
      WHEN 3 THEN 'IN SERVICE' WHEN 4 THEN 'withdrawn by customer' WHEN 5 THEN ''
      ELSE 'Pending' END AS q_status,
    CASE WHEN o_orderkey % 23 = 0 THEN '2024-01-05' END AS q_withdrawn,
    c_mktsegment AS q_customer, n_name AS q_state, r_name AS q_county,
    CASE o_orderstatus WHEN 'F' THEN 'Solar' WHEN 'O' THEN 'Wind' ELSE 'na' END AS q_fuel
  FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


HEADERS = {
    "Queue Number": "q_number",
    "Project Name": "q_name",
    "POI": "q_poi",
    "NET MW POI": "q_mw",
    "Status": "q_status",
    "Date Withdrawn": "q_withdrawn",
    "Interconnection Customer": "q_customer",
    "State": "q_state",
    "County": "q_county",
    "Fuel Type": "q_fuel",
}


def row_pairs(between: str) -> str:
    """List of header<between>value of the non-blank cells, sorted."""
    items = ", ".join(
        f"CASE WHEN {clean(c)} <> '' THEN '{h}' || {between} || {clean(c)} END"
        for h, c in HEADERS.items()
    )
    return f"list_sort(list_filter([{items}], lambda x: x IS NOT NULL))"


def row_json() -> str:
    """The non-blank cells as JSON, in header order."""
    items = ", ".join(
        f"CASE WHEN {clean(c)} <> '' THEN {{'key': '{h}', 'value': {clean(c)}}} END"
        for h, c in sorted(HEADERS.items())
    )
    return f"CAST(to_json(list_filter([{items}], lambda x: x IS NOT NULL)) AS VARCHAR)"


def records(rows: str, name: str = "rec") -> str:
    """CTEs that make project records of the raw rows `rows`."""
    basis = "coalesce(project_id, nullif(concat_ws('|', project_name, substation_or_node), ''), 'unknown')"
    return f"""
{name}_0 AS (
  SELECT source_queue_id, ord, {nullable(clean('q_number'))} AS project_id,
    {nullable(clean('q_name'))} AS project_name, {nullable(clean('q_poi'))} AS substation_or_node,
    {whole(number(clean('q_mw')))} AS capacity_mw,
    {infer_status(nullable(clean('q_status')), nullable(clean('q_withdrawn')))} AS status,
    {nullable(clean('q_customer'))} AS developer_name, {nullable(clean('q_county'))} AS county,
    {nullable(clean('q_state'))} AS state, CAST(NULL AS VARCHAR) AS zone,
    {nullable(clean('q_fuel'))} AS fuel_type,
    array_to_string({row_pairs("'='")}, ';') AS source_row,
    {row_json()} AS row_mark
  FROM ({rows})),
{name}_1 AS (
  SELECT *, CASE WHEN {sanitize(basis)} = 'unknown'
      THEN 'project-' || substr(sha256({basis}), 1, 16)
      ELSE {sanitize(basis, limit=120)} END AS project_key,
    CASE WHEN capacity_mw IS NOT NULL THEN 'NET MW POI' END AS capacity_source_field,
    CAST(least(99, 80 + CASE WHEN capacity_mw IS NOT NULL THEN 12 ELSE 0 END
      + CASE WHEN substation_or_node IS NOT NULL THEN 8 ELSE 0 END
      + CASE WHEN developer_name IS NOT NULL THEN 4 ELSE 0 END) / 100.0 AS DECIMAL(3,2))
      AS extraction_confidence,
    CASE WHEN capacity_mw IS NULL OR substation_or_node IS NULL THEN 'NEEDS_REVIEW'
      ELSE 'AUTO_REVIEWED' END AS review_status,
    concat_ws(',', CASE WHEN capacity_mw IS NULL THEN 'Missing capacity MW' END,
      CASE WHEN substation_or_node IS NULL THEN 'Missing substation or node' END) AS review_reasons
  FROM {name}_0
  WHERE (project_id IS NOT NULL OR project_name IS NOT NULL)
    AND (capacity_mw IS NOT NULL OR substation_or_node IS NOT NULL)),
{name} AS (
  SELECT *, coalesce(project_id, project_key) AS interconnection_queue_id,
    1 + CAST(project_name IS NOT NULL AS INT) + CAST(capacity_mw IS NOT NULL AS INT)
      + CAST(substation_or_node IS NOT NULL AS INT) + CAST(developer_name IS NOT NULL AS INT)
      + CAST(county IS NOT NULL AS INT) + CAST(state IS NOT NULL AS INT)
      + CAST(fuel_type IS NOT NULL AS INT) AS completeness,
    sha256(concat_ws(chr(31), 'source_queue_id=' || source_queue_id, 'project_key=' || project_key,
      'interconnection_queue_id=' || coalesce(project_id, project_key),
      'project_name=' || project_name, 'capacity_mw=' || capacity_mw,
      'capacity_source_field=' || capacity_source_field,
      'substation_or_node=' || substation_or_node, 'status=' || status,
      'developer_name=' || developer_name, 'county=' || county, 'state=' || state,
      'fuel_type=' || fuel_type, row_mark)) AS record_fingerprint
  FROM {name}_1)"""


def snapshot(rows: str, name: str) -> str:
    """CTEs that make deduplicated records of the raw rows."""
    return f"""{records(rows, name + '_raw')},
{name} AS (
  SELECT * EXCLUDE (place) FROM (
    SELECT *, min(ord) OVER (PARTITION BY source_queue_id, project_key) AS first_seen,
      row_number() OVER (PARTITION BY source_queue_id, project_key
        ORDER BY completeness DESC, ord) AS place
    FROM {name}_raw) WHERE place = 1)"""


RAW = raw_rows()
CURRENT_ROWS = f"SELECT * FROM ({RAW}) WHERE ord % 11 <> 0"
PREVIOUS_ROWS = (
    f"SELECT * FROM ({raw_rows('o_orderkey % 5 = 0')})"
    " WHERE ord % 7 <> 0 AND source_queue_id <> 'src-0'"
)
FIELDS = [
    "source_queue_id",
    "project_key",
    "interconnection_queue_id",
    "project_name",
    "capacity_mw",
    "substation_or_node",
    "status",
    "developer_name",
    "county",
    "state",
    "zone",
    "fuel_type",
    "capacity_source_field",
    "extraction_confidence",
    "review_status",
]
SHOWN = ", ".join(FIELDS)
TRACKED = {
    "InterconnectionQueueID": "interconnection_queue_id",
    "ProjectName": "project_name",
    "CapacityMW": "capacity_mw",
    "SubstationOrNode": "substation_or_node",
    "Status": "status",
    "DeveloperName": "developer_name",
    "County": "county",
    "State": "state",
    "Zone": "zone",
    "FuelType": "fuel_type",
}
CHANGED = (
    "coalesce(nullif(concat_ws(',', "
    + ", ".join(
        f"CASE WHEN c.{f} IS DISTINCT FROM p.{f} THEN '{label}' END" for label, f in TRACKED.items()
    )
    + "), ''), 'SourceRow')"
)
BOTH = f"{snapshot(CURRENT_ROWS, 'cur')}, {snapshot(PREVIOUS_ROWS, 'prev')}"


def pick(alias: str, fields: list[str]) -> str:
    return ", ".join(f"{alias}.{f}" for f in fields)


def moved(current: str, previous: str, keys: str, extra: list[str] | None = None) -> str:
    """NEW, UPDATED and REMOVED rows between two record sets."""
    fields = [*(extra or []), *FIELDS, "record_fingerprint", "first_seen"]
    removed = ", ".join(
        "'Withdrawn' AS status" if f == "status" else f"p.{f}" for f in fields
    )
    return f"""
  SELECT 'NEW' AS delta_type, '' AS changed_fields, {pick('c', fields)}
  FROM {current} c ANTI JOIN {previous} p USING ({keys})
  UNION ALL
  SELECT 'UPDATED', {CHANGED}, {pick('c', fields)}
  FROM {current} c JOIN {previous} p USING ({keys})
  WHERE c.record_fingerprint <> p.record_fingerprint
  UNION ALL
  SELECT 'REMOVED', 'Status', {removed}
  FROM {previous} p ANTI JOIN {current} c USING ({keys})"""


DIFF = f"""{BOTH},
seen AS (SELECT * FROM cur WHERE source_queue_id <> 'src-0'),
moved AS ({moved('seen', 'prev', 'source_queue_id, project_key')}),
base AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY source_queue_id ORDER BY
      coalesce(nullif(capacity_mw, 0), -1) DESC, first_seen, project_key) AS delta_rank
    FROM cur WHERE source_queue_id = 'src-0') WHERE delta_rank <= 25),
deltas AS (
  SELECT delta_type, changed_fields, {SHOWN}, CAST(NULL AS BIGINT) AS delta_rank FROM moved
  UNION ALL
  SELECT 'BASELINE', '', {SHOWN}, delta_rank FROM base),
chosen AS (
  SELECT * EXCLUDE (delta_rank), delta_rank FROM deltas WHERE delta_type = 'BASELINE'
  UNION ALL
  SELECT * FROM (
    SELECT * EXCLUDE (delta_rank), row_number() OVER (PARTITION BY source_queue_id ORDER BY
      CASE delta_type WHEN 'REMOVED' THEN 0 WHEN 'NEW' THEN 1 ELSE 2 END,
      coalesce(capacity_mw, 0) DESC, project_key) AS delta_rank
    FROM deltas WHERE delta_type <> 'BASELINE') WHERE delta_rank <= 750),
counts AS (
  SELECT coalesce(r.source_queue_id, d.source_queue_id) AS source_queue_id,
    CAST(CASE WHEN r.source_queue_id = 'src-0' THEN r.n ELSE 0 END AS BIGINT) AS baseline_records,
    coalesce(baseline_sample, 0) AS baseline_sample, coalesce(new, 0) AS new,
    coalesce(updated, 0) AS updated, coalesce(removed, 0) AS removed,
    coalesce(r.n, 0) AS record_count
  FROM (SELECT source_queue_id, count(*) AS n FROM cur GROUP BY 1) r
  FULL JOIN (
    SELECT source_queue_id, count(*) FILTER (delta_type = 'BASELINE') AS baseline_sample,
      count(*) FILTER (delta_type = 'NEW') AS new,
      count(*) FILTER (delta_type = 'UPDATED') AS updated,
      count(*) FILTER (delta_type = 'REMOVED') AS removed
    FROM deltas GROUP BY 1) d ON r.source_queue_id = d.source_queue_id),
kept AS (SELECT source_queue_id, count(*) AS persisted_count FROM chosen GROUP BY 1),
counters AS (
  SELECT counts.source_queue_id, record_count,
    baseline_sample + new + updated + removed AS delta_count,
    coalesce(persisted_count, 0) AS persisted_count
  FROM counts LEFT JOIN kept USING (source_queue_id))"""

# The same without limits.
DIFF_ALL = DIFF.replace("WHERE delta_rank <= 25)", ")").replace("WHERE delta_rank <= 750)", ")")

META = """
meta AS (
  SELECT 'src-' || n_nationkey AS source_queue_id, 'Utility ' || n_name AS utility_name,
    n_name AS market, r_name AS region, 'queue_xlsx' AS source_kind,
    'raw/src-' || n_nationkey AS raw_s3_key, 'https://example.com/' || n_nationkey AS source_url
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def history_rows(seq: int, kept: str, raised: str) -> str:
    return f"""SELECT * FROM ({raw_rows(raised)}) WHERE {kept}
      AND CAST(regexp_extract(source_queue_id, '(\\d+)$', 1) AS INT) % 3 + 1 >= {seq}"""


HISTORY = f"""{snapshot(history_rows(1, 'ord % 7 <> 0', 'false'), 'h1')},
{snapshot(history_rows(2, 'ord % 11 <> 0', 'o_orderkey % 5 = 0'), 'h2')},
{snapshot(history_rows(3, 'ord % 13 <> 0', 'false'), 'h3')},
history AS (
  SELECT *, CAST(1 AS BIGINT) AS snapshot_seq FROM h1 UNION ALL
  SELECT *, CAST(2 AS BIGINT) FROM h2 UNION ALL SELECT *, CAST(3 AS BIGINT) FROM h3),
versions AS (
  SELECT 'src-' || n_nationkey AS source_queue_id,
    CAST(unnest(generate_series(1, n_nationkey % 3 + 1)) AS BIGINT) AS snapshot_seq
  FROM nation)"""

# --- insights ---------------------------------------------------------------------
INSIGHTS = """
ins AS (
  SELECT *, CASE event_type WHEN 'signup' THEN 'NEW' WHEN 'click' THEN 'UPDATED'
      WHEN 'error' THEN 'REMOVED' WHEN 'view' THEN 'BASELINE' END AS delta,
    'src-' || (user_id % 25) AS src
  FROM events),
sig AS (
  SELECT src || '-' || event_id AS id, src || '-' || event_id AS queue_id,
    CASE WHEN event_id % 8 <> 0 THEN src ELSE src || '-' || event_id END AS source_queue_id,
    CASE WHEN delta IS NOT NULL THEN 'PROJECT_DELTA' ELSE 'SOURCE_EXTRACTION' END AS insight_type,
    coalesce(delta, '') AS delta_type, ts AS observed_at,
    CASE WHEN event_id % 3 <> 0 THEN 'Q-' ELSE 'X-' END || event_id AS interconnection_queue_id,
    'Project "' || user_id || '"' AS project_name,
    coalesce(nullif(CAST(floor(value) AS BIGINT), 0),
      CASE WHEN event_id % 2 = 0 THEN 7 END) AS capacity_mw,
    CASE WHEN event_id % 11 <> 0 THEN 'Node ' || (event_id % 7) ELSE 'Spare node' END
      AS substation_or_node,
    CASE event_id % 3 WHEN 0 THEN 'Active' WHEN 1 THEN 'Withdrawn' ELSE 'Completed' END AS status,
    CASE WHEN event_id % 5 <> 0 THEN 'Developer ' || (user_id % 9) ELSE '' END AS developer_name,
    CASE WHEN event_id % 6 <> 0 THEN 'https://example.com/' || event_id ELSE '' END AS source_url,
    CASE WHEN event_id % 4 <> 0 THEN 'raw/' || event_id ELSE '' END AS raw_s3_key,
    'out/' || event_id AS output_s3_key,
    CASE WHEN event_id % 4 <> 0 THEN 'raw/' ELSE 'out/' END || event_id AS evidence_key,
    CASE WHEN event_id % 12 = 2 THEN '0.9'
      ELSE '0.' || (88 + event_id % 12) END AS confidence,
    CASE WHEN event_id % 10 IN (0, 9) THEN 'NEEDS_REVIEW' ELSE 'AUTO_REVIEWED' END AS review_status,
    CASE WHEN event_id % 10 IN (0, 9) THEN 'NEEDS_REVIEW' ELSE 'AUTO_REVIEWED' END AS parser_status,
    CASE WHEN event_id % 10 = 0 THEN 'Missing capacity MW' ELSE '' END AS review_reasons,
    CASE WHEN event_type = 'click' THEN 'CapacityMW; Status' ELSE '' END AS changed_fields,
    CASE WHEN event_id % 9 <> 0 THEN 'Market ' || (user_id % 5) ELSE '' END AS market,
    CASE WHEN user_id % 6 <> 0 THEN 'Utility ' || (user_id % 25) ELSE '' END AS utility_name
  FROM ins),
pref AS (
  SELECT * FROM sig WHERE insight_type = 'PROJECT_DELTA'
    OR NOT EXISTS (SELECT 1 FROM sig WHERE insight_type = 'PROJECT_DELTA'))"""


RECENT = INSIGHTS.rsplit("pref AS", 1)[0] + f"""recent AS (
  SELECT * FROM sig WHERE observed_at >= {AS_OF} - INTERVAL 1470 MINUTES),
pref AS (
  SELECT * FROM recent WHERE insight_type = 'PROJECT_DELTA'
    OR NOT EXISTS (SELECT 1 FROM recent WHERE insight_type = 'PROJECT_DELTA'))"""


def health(rows: str) -> str:
    return f"""
health AS (
  SELECT source_queue_id, max(CASE WHEN newest = 1 THEN market END) AS market,
    coalesce(nullif(max(CASE WHEN newest = 1 THEN utility_name END), ''), source_queue_id)
      AS source_name,
    '' AS format, max(observed_at) AS last_checked_at, max(observed_at) AS last_changed_at,
    CASE WHEN count(*) FILTER (review_status = 'NEEDS_REVIEW') > 0 THEN 'NEEDS_REVIEW'
      ELSE 'HEALTHY' END AS parser_status,
    '' AS rows_snapshotted, count(*) AS change_count,
    'Derived from project-delta insight rows' AS limitation
  FROM (SELECT *, row_number() OVER (PARTITION BY source_queue_id
      ORDER BY observed_at DESC, queue_id DESC) AS newest FROM {rows})
  GROUP BY source_queue_id)"""


CSV_21 = [
    "observed_at",
    "queue_id",
    "source_queue_id",
    "insight_type",
    "delta_type",
    "market",
    "utility_name",
    "interconnection_queue_id",
    "project_name",
    "capacity_mw",
    "substation_or_node",
    "status",
    "developer_name",
    "changed_fields",
    "confidence",
    "review_status",
    "parser_status",
    "source_url",
    "raw_s3_key",
    "output_s3_key",
    "evidence_key",
]
CSV_13 = [
    "observed_at",
    "market",
    "delta_type",
    "interconnection_queue_id",
    "project_name",
    "capacity_mw",
    "substation_or_node",
    "status",
    "developer_name",
    "review_status",
    "parser_status",
    "evidence_key",
    "source_url",
]


def printable(field: str) -> str:
    if field == "observed_at":
        return iso(field)
    if field == "capacity_mw":
        return "coalesce(CAST(capacity_mw AS VARCHAR), '')"
    return field


# --- catalog ----------------------------------------------------------------------
CATALOG_ROWS = """
typed AS (
  SELECT c_custkey AS k,
    CASE WHEN c_custkey % 50 <> 7 THEN ' cust-' || c_custkey END AS queue_id,
    CASE WHEN c_custkey % 40 <> 9
      THEN 'https://example.com/files/' || c_custkey || '/open queue.xlsx?v=1' END AS url,
    CASE WHEN c_custkey % 8 <> 7 THEN
      CASE c_custkey % 7 WHEN 0 THEN 'yes' WHEN 1 THEN ' TRUE ' WHEN 2 THEN 'no' WHEN 3 THEN '0'
        WHEN 4 THEN 'active' WHEN 5 THEN 'inactive' ELSE '1' END END AS active,
    c_name AS utility, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS "Market",
    CASE WHEN c_custkey % 2 = 0 THEN ' Yes ' ELSE 'T' || c_custkey END AS "Territory"
  FROM customer),
normal AS (
  SELECT k, trim(queue_id) AS source_queue_id, url AS source_url,
    coalesce(lower(trim(active)) IN ('1', 'true', 'yes', 'y', 'active'), true) AS active,
    "Market" AS market, utility,
    CASE WHEN k % 2 = 0 THEN 'true' ELSE trim("Territory") END AS territory,
    CASE WHEN queue_id IS NULL OR url IS NULL
      THEN 'Each record requires QueueID and SourceURL' END AS error
  FROM typed)"""
STATE = """
state AS (
  SELECT 'cust-' || c_custkey AS source_queue_id,
    CASE WHEN c_custkey % 4 = 0 THEN 'etag:"' || c_custkey || '"' END AS last_remote_fingerprint,
    CASE WHEN c_custkey % 4 = 1 THEN 'hash-' || c_custkey END AS last_hash,
    CASE c_custkey % 4 WHEN 2 THEN md5(c_name) WHEN 3 THEN 'md5:' || md5(c_mktsegment) END
      AS last_content_md5,
    CASE WHEN c_custkey % 5 = 0 THEN 'timeout' END AS last_error,
    CASE c_custkey % 4 WHEN 0 THEN 'etag:"' || c_custkey || '"' WHEN 1 THEN 'hash-' || c_custkey
      WHEN 2 THEN 'md5:' || md5(c_name) ELSE 'md5:' || md5(c_mktsegment) END AS stored
  FROM customer WHERE c_custkey % 9 <> 0)"""
LANDED = """
landed AS (
  SELECT 'cust-' || c_custkey AS source_queue_id,
    CASE WHEN c_custkey % 8 = 0 THEN 'etag:"' || c_custkey || '"'
      WHEN c_custkey % 8 = 4 THEN 'etag:"other"'
      WHEN c_custkey % 8 = 1 THEN 'metadata:last-modified=Wed, 20 May 2026 12:00:00 GMT;length='
        || CASE WHEN c_custkey % 16 = 1 THEN CAST(c_custkey AS VARCHAR) ELSE 'unknown' END
      END AS fingerprint,
    CASE WHEN c_custkey % 31 <> 0 THEN md5(c_name) END AS content_md5,
    CASE WHEN c_custkey % 29 = 0 THEN 'HTTPError' END AS fetch_error
  FROM customer)"""
CHANGES = f"""{CATALOG_ROWS}, {STATE}, {LANDED},
changes AS (
  SELECT n.source_queue_id, n.source_url, s.stored AS stored_fingerprint,
    coalesce(l.fingerprint, 'md5:' || l.content_md5) AS new_fingerprint,
    CASE WHEN n.error IS NOT NULL OR l.fetch_error IS NOT NULL
        OR (l.fingerprint IS NULL AND l.content_md5 IS NULL) THEN 'error'
      WHEN l.fingerprint = s.stored THEN 'unchanged'
      WHEN l.fingerprint IS NULL AND s.stored = 'md5:' || l.content_md5 THEN 'unchanged'
      ELSE 'changed' END AS scan_status
  FROM normal n LEFT JOIN state s USING (source_queue_id)
    LEFT JOIN landed l USING (source_queue_id)
  WHERE n.active)"""

# --- documents --------------------------------------------------------------------
DOC_ROWS = """
docs AS (
  SELECT o_orderkey // 40 AS doc, o_orderkey % 40 + 1 AS place, 'Q-' || o_orderkey AS number,
    'Project, ' || o_custkey AS name, 'Node ' || o_orderpriority AS node,
    CAST(floor(o_totalprice / 1000) AS BIGINT) AS mw,
    CAST(floor(o_totalprice / 1000) AS BIGINT) || ' MW' AS capacity,
    CASE o_orderkey % 4 WHEN 0 THEN 'Under Study' WHEN 1 THEN 'DONE' WHEN 2 THEN 'Withdrawn'
      ELSE 'Pending' END AS status
  FROM orders)"""
PDF_BODY = """string_agg(number || ' (open) ' || node, ' ' ORDER BY place)"""


def matrix_of(kind: int, sheet: str, first: int, preamble: str, line: str, head: str) -> str:
    """Rows of the documents of one format: preamble, header, data from row `first`."""
    return f"""WITH {DOC_ROWS}
SELECT 'doc-' || doc AS doc_id, '{sheet}' AS sheet, row_number, cells, CAST(NULL AS VARCHAR) AS error
FROM (
  {preamble}
  SELECT DISTINCT doc, CAST({first - 1} AS BIGINT) AS row_number, '{head}' AS cells
  FROM docs WHERE doc % 5 = {kind}
  UNION ALL
  SELECT doc, {first - 1} + place, {line} FROM docs WHERE doc % 5 = {kind})"""


SHORT_PDF = "Could not extract enough text from PDF with the built-in reader"
PAGE_TEXT = r"""WITH shown AS (
  SELECT page_id, regexp_replace(regexp_replace(html, '<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', '<s>', 'gs'),
    '<!--.*?-->', '<s>', 'gs') AS x FROM pages),
broken AS (
  SELECT page_id, regexp_replace(regexp_replace(x, '<(br|p|div|tr|li|table)([ /][^>]*)?>|</(p|div|tr|li)>', chr(10), 'g'),
    '<[^>]*>', ' ', 'g') AS x FROM shown),
said AS (
  SELECT page_id, replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&') AS x
  FROM broken)
SELECT CAST(page_id AS VARCHAR) AS doc_id, array_to_string(list_filter(list_transform(string_split(x, chr(10)),
  lambda l: trim(regexp_replace(l, '[ \t]+', ' ', 'g'))), lambda l: l <> ''), chr(10)) AS text, NULL AS error
FROM said"""
LINE = "concat_ws('|', number, name, node, capacity, status)"
SHEET_TEXT = """E'\\n# xl/worksheets/sheet1.xml\\n'
  || 'Queue Number' || chr(9) || 'Project Name' || chr(9) || 'POI' || chr(9) || 'Capacity (MW)'
  || chr(9) || 'Status' || chr(10)
  || string_agg(concat_ws(chr(9), number, name, node, capacity, status), chr(10) ORDER BY place)"""

# --- matrices ---------------------------------------------------------------------
MATRIX = """
grid AS (
  SELECT n_nationkey AS n, CAST(s AS BIGINT) AS row_seq,
    CASE s WHEN 0 THEN ['Last Updated On', '5/21/2026'] WHEN 1 THEN ['', '']
      ELSE CASE WHEN n_nationkey % 10 = 9 THEN ['No header']
        ELSE ['Queue Number', 'Project Name', 'POI', 'Capacity (MW)', 'Status'] END END AS cells
  FROM nation, generate_series(0, 2) t(s)
  UNION ALL
  SELECT c_nationkey, o_orderkey + 3,
    CASE WHEN o_orderkey % 1000 = 500
        THEN ['Status', 'Queue Number', 'Capacity (MW)', 'Capacity (MW)', 'Project Name', '']
      WHEN o_orderkey % 25 = 0 THEN ['', '', '']
      WHEN o_orderkey % 1000 > 500 THEN ['Pending', 'Q-' || o_orderkey,
        CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR),
        CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '12' END, 'Project ' || o_custkey]
      ELSE ['Q-' || o_orderkey, 'Project ' || o_custkey, o_orderpriority,
        CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR), 'DONE', 'x'] END
  FROM orders JOIN customer ON o_custkey = c_custkey),
marked AS (
  SELECT *, list_contains(cells, 'Queue Number') AS is_header FROM grid),
filled AS (
  SELECT *, last_value(CASE WHEN is_header THEN cells END IGNORE NULLS) OVER w AS header,
    last_value(CASE WHEN is_header THEN row_seq + 1 END IGNORE NULLS) OVER w AS header_row
  FROM marked
  WINDOW w AS (PARTITION BY n ORDER BY row_seq ROWS UNBOUNDED PRECEDING)),
segments AS (
  SELECT * FROM filled WHERE NOT is_header AND header IS NOT NULL
    AND array_to_string(cells, '') <> '')"""

# --- responses --------------------------------------------------------------------
RESPONSES = """
answers AS (
  SELECT o_orderkey AS k,
    CASE WHEN o_orderkey % 5 = 2 THEN 'short' WHEN o_orderkey % 35 = 4 THEN 'none' ELSE 'full' END
      AS shape
  FROM orders),
checked AS (
  SELECT k, CASE WHEN shape = 'none' THEN 'Response did not contain a JSON object'
      WHEN shape = 'short' THEN 'Response missing required keys: developer_name, interconnection_queue_id, substation_or_node'
      WHEN k % 5 = 3 THEN 'status must be one of Active, Withdrawn, Completed' END AS error
  FROM answers),
valid AS (
  SELECT k, error, CASE WHEN error IS NULL THEN 'QW-' || k END AS interconnection_queue_id,
    CASE WHEN error IS NULL THEN CASE k % 4 WHEN 0 THEN NULL
      WHEN 1 THEN CAST(round_even((k % 300) + 0.5, 0) AS BIGINT) ELSE k % 300 END END AS capacity_mw,
    CASE WHEN error IS NULL AND k % 6 <> 0 THEN 'Oak Creek' END AS substation_or_node,
    CASE WHEN error IS NULL THEN 'Active' END AS status,
    CASE WHEN error IS NULL AND k % 7 <> 0 THEN 'Example Solar' END AS developer_name
  FROM checked)"""

ORACLES: dict[str, str] = {
    "clean_cells": f"""SELECT ord, {clean('q_number')} AS queue_number, {clean('q_name')} AS project_name,
  {clean('q_poi')} AS poi, {clean('q_withdrawn')} AS date_withdrawn, {clean('q_mw')} AS net_mw_poi
FROM ({RAW})""",
    "header_normalize": f"""SELECT ord, {header('q_name')} AS project_name, {header('q_poi')} AS poi,
  {header('q_mw')} AS net_mw_poi FROM ({RAW})""",
    "numeric_parse": f"""SELECT ord, {number('q_mw')} AS net_mw, {whole(number('q_mw'))} AS whole_mw,
  {number('q_name')} AS name_number FROM ({RAW})""",
    "nullable_strings": f"""SELECT ord, {nullable('q_number')} AS queue_number, {nullable('q_mw')} AS net_mw,
  {nullable('q_fuel')} AS fuel_type, {nullable('q_status')} AS status FROM ({RAW})""",
    "status_normalize": f"""SELECT ord, {status_word('q_status')} AS status,
  {status_word('q_status')} IS NULL AS bad FROM ({RAW})""",
    "status_infer": f"""SELECT ord,
  {infer_status(nullable('q_status'), nullable('q_withdrawn'))} AS status,
  {infer_status(nullable('q_status'), nullable('q_withdrawn'), strict=True)} AS strict_status
FROM ({RAW})""",
    "capacity_choice": f"""
WITH a AS (
  SELECT ord, {number('q_mw')} AS n1,
    CASE ord % 3 WHEN 0 THEN {number('q_mw')} WHEN 1 THEN 1000 + ord % 900 + 100 END AS n2,
    CAST(-(ord % 7) AS DOUBLE) AS n3
  FROM ({RAW})),
b AS (
  SELECT ord, unnest([n1, CASE WHEN ord % 3 = 1 THEN
      CAST('1' || (ord % 900 + 100) AS DOUBLE) ELSE n2 END, n3]) AS number,
    unnest(['NET MW POI', 'Summer Output', 'Nameplate']) AS header, unnest([0, 1, 2]) AS position
  FROM a),
c AS (
  SELECT *, row_number() OVER (PARTITION BY ord ORDER BY number > 0 DESC, number DESC, position) AS place
  FROM b WHERE number IS NOT NULL)
SELECT ord, {whole('number')} AS capacity_mw, header AS capacity_source_field FROM c WHERE place = 1""",
    "alias_resolve": f"""SELECT ord, {nullable(clean('q_number'))} AS project_id,
  {nullable(clean('q_name'))} AS project_name, {nullable(clean('q_poi'))} AS node,
  {nullable(clean('q_status'))} AS status, {nullable(clean('q_customer'))} AS developer,
  {nullable(clean('q_county'))} AS county, {nullable(clean('q_state'))} AS state,
  {nullable(clean('q_fuel'))} AS fuel FROM ({RAW})""",
    "project_keys": f"""
WITH a AS (
  SELECT ord, coalesce({nullable(clean('q_number'))}, concat_ws('|', {nullable(clean('q_name'))},
    {nullable(clean('q_poi'))})) AS basis FROM ({RAW}))
SELECT ord, {sanitize('basis', limit=120)} AS project_key,
  'project-' || substr(sha256(CASE WHEN ord % 2 = 0 THEN '---' ELSE 'unknown' END), 1, 16) AS odd_key
FROM a""",
    "sanitize_keys": f"""
WITH a AS (
  SELECT ord, q_name || ' +' || q_poi || '::é%zz 5% ' || q_county AS decoded,
    '-/' || q_name || '%20+' || q_poi || ':%3A%C3%A9%zz 5% ' || q_county AS raw FROM ({RAW}))
SELECT ord, {sanitize("'-/' || decoded")} AS record_key,
  {sanitize('raw', 'A-Za-z0-9_.=')} AS path_part FROM a""",
    "source_row_map": f"""WITH {records(RAW)}, everything AS (
  SELECT ord, array_to_string({row_pairs("'='")}, ';') AS source_row FROM ({RAW}))
SELECT * FROM everything""",
    "project_records": f"""WITH {records(RAW)}
SELECT ord, {SHOWN}, review_reasons, source_row FROM rec""",
    "record_score": f"""WITH {records(RAW)}
SELECT ord, extraction_confidence, review_status, review_reasons AS reasons FROM rec""",
    "completeness": f"""WITH {records(RAW)}
SELECT ord, CAST(completeness AS BIGINT) AS completeness FROM rec""",
    "record_fingerprints": f"WITH {records(RAW)} SELECT ord, record_fingerprint FROM rec",
    "dedupe_records": f"WITH {snapshot(RAW, 'ready')} SELECT {SHOWN}, ord, first_seen FROM ready",
    "record_limit": f"""WITH {snapshot(RAW, 'ready')}
SELECT source_queue_id, project_key, first_seen FROM (
  SELECT *, row_number() OVER (PARTITION BY source_queue_id ORDER BY first_seen, project_key) AS place
  FROM ready) WHERE place <= 200""",
    "snapshot_diff": f"""WITH {DIFF}
SELECT delta_type, changed_fields, {SHOWN}, record_fingerprint FROM moved""",
    "new_projects": f"""WITH {DIFF}
SELECT {SHOWN}, record_fingerprint FROM moved WHERE delta_type = 'NEW'""",
    "removed_projects": f"""WITH {DIFF}
SELECT changed_fields, {SHOWN}, record_fingerprint FROM moved WHERE delta_type = 'REMOVED'""",
    "updated_projects": f"""WITH {DIFF}
SELECT changed_fields, {SHOWN}, record_fingerprint FROM moved WHERE delta_type = 'UPDATED'""",
    "changed_fields": f"""WITH {DIFF}, fields AS (
  SELECT source_queue_id, unnest(string_split(changed_fields, ',')) AS field
  FROM moved WHERE delta_type = 'UPDATED')
SELECT source_queue_id, field, count(*) AS changes FROM fields GROUP BY ALL""",
    "baseline_sources": f"""WITH {snapshot(CURRENT_ROWS, 'cur')}
SELECT {SHOWN}, record_fingerprint, first_seen FROM cur WHERE source_queue_id = 'src-0'""",
    "baseline_top": f"""WITH {snapshot(CURRENT_ROWS, 'cur')}
SELECT * FROM (
  SELECT source_queue_id, project_key, capacity_mw, row_number() OVER (PARTITION BY source_queue_id
    ORDER BY coalesce(nullif(capacity_mw, 0), -1) DESC, first_seen, project_key) AS delta_rank
  FROM cur) WHERE delta_rank <= 25""",
    "delta_summary": f"WITH {DIFF_ALL} SELECT * FROM counts",
    "delta_select": f"""WITH {DIFF}
SELECT source_queue_id, project_key, delta_type, capacity_mw, delta_rank FROM chosen""",
    "run_counters": f"WITH {DIFF_ALL} SELECT * FROM counters",
    "run_output": f"""WITH {DIFF}, samples AS (
  SELECT source_queue_id, string_agg(delta_type || ':' || project_key, ',' ORDER BY delta_rank) AS sample
  FROM chosen WHERE delta_rank <= 50 GROUP BY 1)
SELECT * FROM counters LEFT JOIN samples USING (source_queue_id)""",
    "delta_enrich": f"""WITH {DIFF_ALL}, {META}
SELECT source_queue_id, project_key, delta_type, utility_name, market, region, source_kind
FROM deltas LEFT JOIN meta USING (source_queue_id)""",
    "insight_upsert": f"""WITH {DIFF_ALL}, {META}, incoming AS (
  SELECT source_queue_id, project_key, delta_type, capacity_mw, status, changed_fields,
    {AS_OF} AS parsed_at FROM chosen),
merged AS (
  SELECT * FROM incoming
  UNION ALL
  SELECT source_queue_id, project_key, 'OLD', capacity_mw, status, '', {OBSERVED}
  FROM cur c ANTI JOIN incoming i USING (source_queue_id, project_key) WHERE c.ord % 2 = 0)
SELECT {sanitize("source_queue_id || '-' || project_key")} AS queue_id, source_queue_id, project_key,
  {OBSERVED} AS observed_at, parsed_at, delta_type, 'PROJECT_DELTA' AS insight_type,
  'deterministic-table-parser-v1' AS model_id, market, utility_name, raw_s3_key, source_url,
  capacity_mw, status, status AS extracted_status, changed_fields
FROM merged LEFT JOIN meta USING (source_queue_id)""",
    "snapshot_manifest": f"""WITH {snapshot(CURRENT_ROWS, 'cur')}
SELECT source_queue_id, count(*) AS record_count, 0::BIGINT AS delta_count, 0::BIGINT AS persisted_count
FROM cur GROUP BY source_queue_id""",
    "document_rejects": """
WITH d AS (
  SELECT page_id, encode(html) AS content, CASE WHEN page_id % 3 = 0 THEN 'xlsx' WHEN page_id % 5 = 0 THEN 'bin'
    ELSE 'html' END AS kind FROM pages)
SELECT CAST(page_id AS VARCHAR) AS doc_id, octet_length(content) AS byte_count, md5(content) AS content_md5,
  CASE kind WHEN 'xlsx' THEN 'BadZipFile' ELSE 'NoRecords' END AS error_type,
  CASE kind WHEN 'xlsx' THEN 'Deterministic project extraction skipped: BadZipFile: File is not a zip file'
    WHEN 'html' THEN 'Extracted project rows from HTML tables' ELSE '' END AS notes
FROM d""",
    "latest_snapshot": f"""WITH {HISTORY}
SELECT source_queue_id, snapshot_seq, project_key, capacity_mw, record_fingerprint FROM history
JOIN (SELECT source_queue_id, max(snapshot_seq) AS snapshot_seq FROM versions GROUP BY 1)
  USING (source_queue_id, snapshot_seq)""",
    "snapshot_history_deltas": f"""WITH {HISTORY},
later AS (SELECT * FROM history WHERE snapshot_seq > 1),
earlier AS (
  SELECT h.* EXCLUDE (snapshot_seq), v.snapshot_seq FROM history h
  JOIN versions v ON h.source_queue_id = v.source_queue_id AND h.snapshot_seq + 1 = v.snapshot_seq),
steps AS ({moved('later', 'earlier', 'source_queue_id, project_key, snapshot_seq', ['snapshot_seq'])})
SELECT source_queue_id, project_key, snapshot_seq, delta_type, changed_fields, capacity_mw, status
FROM steps""",
    "diff_by_fingerprint": f"""WITH {DIFF}
SELECT delta_type, changed_fields, {SHOWN}, record_fingerprint FROM moved""",
    "version_steps": f"""WITH {HISTORY},
spans AS (SELECT source_queue_id, min(snapshot_seq) AS f, max(snapshot_seq) AS l FROM versions GROUP BY 1),
placed AS (
  SELECT h.source_queue_id, h.project_key, h.snapshot_seq, f, l, h.record_fingerprint AS fp, b.record_fingerprint AS before_fp,
    b.project_key IS NOT NULL AS has_before, a.project_key IS NOT NULL AS has_after
  FROM history h JOIN spans s USING (source_queue_id)
  LEFT JOIN history b ON h.source_queue_id = b.source_queue_id AND h.project_key = b.project_key AND b.snapshot_seq = h.snapshot_seq - 1
  LEFT JOIN history a ON h.source_queue_id = a.source_queue_id AND h.project_key = a.project_key AND a.snapshot_seq = h.snapshot_seq + 1)
SELECT source_queue_id, project_key, snapshot_seq, snapshot_seq AS at_seq,
  CASE WHEN snapshot_seq = f THEN 'BASELINE' WHEN has_before THEN 'UPDATED' ELSE 'NEW' END AS delta_type
FROM placed WHERE snapshot_seq = f OR NOT has_before OR fp <> before_fp
UNION ALL
SELECT source_queue_id, project_key, snapshot_seq + 1, snapshot_seq, 'REMOVED' FROM placed
WHERE snapshot_seq < l AND NOT has_after""",
    "recent_insights": f"""WITH {INSIGHTS}
SELECT queue_id, observed_at, nullif(delta_type, '') AS delta_type FROM sig
WHERE observed_at >= {AS_OF} - INTERVAL 24 HOURS""",
    "signals": f"WITH {INSIGHTS} SELECT * FROM sig",
    "prefer_deltas": f"WITH {INSIGHTS} SELECT id, insight_type, delta_type FROM pref",
    "report_summary": f"""WITH {INSIGHTS}
SELECT count(*) AS total_signals,
  count(*) FILTER (insight_type = 'PROJECT_DELTA') AS project_delta_signals,
  count(*) FILTER (delta_type = 'BASELINE') AS baseline_signals,
  count(*) FILTER (delta_type = 'NEW') AS new_signals,
  count(*) FILTER (delta_type = 'UPDATED') AS updated_signals,
  count(*) FILTER (delta_type = 'REMOVED') AS removed_signals,
  count(*) FILTER (review_status = 'NEEDS_REVIEW') AS needs_review,
  CAST(coalesce(sum(capacity_mw), 0) AS BIGINT) AS total_capacity_mw,
  count(*) FILTER (status = 'Active') AS active_signals,
  count(*) FILTER (status = 'Withdrawn') AS withdrawn_signals,
  count(*) FILTER (status = 'Completed') AS completed_signals
FROM pref""",
    "summary_of_states": f"""WITH {INSIGHTS}
SELECT count(*) AS total_signals,
  count(*) FILTER (insight_type = 'PROJECT_DELTA') AS project_delta_signals,
  count(*) FILTER (delta_type = 'BASELINE') AS baseline_signals,
  count(*) FILTER (delta_type = 'NEW') AS new_signals,
  count(*) FILTER (delta_type = 'UPDATED') AS updated_signals,
  count(*) FILTER (delta_type = 'REMOVED') AS removed_signals,
  count(*) FILTER (review_status = 'NEEDS_REVIEW') AS needs_review,
  CAST(coalesce(sum(capacity_mw), 0) AS BIGINT) AS total_capacity_mw,
  count(*) FILTER (status = 'Active') AS active_signals,
  count(*) FILTER (status = 'Withdrawn') AS withdrawn_signals,
  count(*) FILTER (status = 'Completed') AS completed_signals
FROM pref""",
    "recent_summary_of_states": f"""WITH {RECENT}
SELECT count(*) AS total_signals,
  count(*) FILTER (insight_type = 'PROJECT_DELTA') AS project_delta_signals,
  count(*) FILTER (delta_type = 'BASELINE') AS baseline_signals,
  count(*) FILTER (delta_type = 'NEW') AS new_signals,
  count(*) FILTER (delta_type = 'UPDATED') AS updated_signals,
  count(*) FILTER (delta_type = 'REMOVED') AS removed_signals,
  count(*) FILTER (review_status = 'NEEDS_REVIEW') AS needs_review,
  CAST(coalesce(sum(capacity_mw), 0) AS BIGINT) AS total_capacity_mw,
  count(*) FILTER (status = 'Active') AS active_signals,
  count(*) FILTER (status = 'Withdrawn') AS withdrawn_signals,
  count(*) FILTER (status = 'Completed') AS completed_signals
FROM pref""",
    "health_of_states": f"WITH {INSIGHTS}, {health('pref')} SELECT * FROM health",
    "attempt_ledger": """WITH r AS (
  SELECT c_custkey AS k, 'src-' || c_nationkey AS source_queue_id, md5(c_custkey::VARCHAR) AS content_md5,
    'raw/' || c_custkey AS path, c_nationkey % 5 = 0 AS healed, c_custkey % 3 AS tried, c_custkey % 4 = 0 AS fails FROM customer)
SELECT source_queue_id, content_md5, path, (tried + 1)::BIGINT AS attempts, CASE WHEN tried + 1 >= 3 THEN 'DEAD' ELSE 'WAITING' END AS status,
  'NoRecords' AS error, CASE WHEN tried + 1 < 3 THEN 3600 * 2 ** tried END::BIGINT AS wait_seconds
FROM r WHERE fails
UNION ALL
SELECT source_queue_id, content_md5, path, tried::BIGINT, 'SETTLED', 'BadZip', NULL
FROM r WHERE tried > 0 AND NOT fails AND healed""",
    "source_health": f"WITH {INSIGHTS}, {health('pref')} SELECT * FROM health",
    "health_ratio": f"""WITH {INSIGHTS}, {health('pref')}
SELECT count(*) FILTER (parser_status = 'HEALTHY') AS healthy_sources, count(*) AS all_sources
FROM health""",
    "signal_facets": f"""WITH {INSIGHTS}
SELECT DISTINCT * FROM (
  SELECT 'market' AS facet, market AS value FROM sig UNION ALL
  SELECT 'status', status FROM sig UNION ALL SELECT 'delta_type', delta_type FROM sig)
WHERE value <> ''""",
    "signal_filter": f"""WITH {INSIGHTS}
SELECT id, market, capacity_mw, substation_or_node FROM sig
WHERE market = 'Market 2' AND delta_type = 'UPDATED' AND coalesce(capacity_mw, 0) >= 5
  AND contains(lower(concat_ws(' ', nullif(interconnection_queue_id, ''), nullif(project_name, ''),
    nullif(substation_or_node, ''), nullif(developer_name, ''), nullif(market, ''),
    nullif(status, ''), nullif(delta_type, ''))), 'node 3')""",
    "signal_csv": f"""WITH {INSIGHTS}
SELECT {', '.join(f'{printable(f)} AS {f}' for f in CSV_21)} FROM pref""",
    "signal_lines": f"""WITH {INSIGHTS}
SELECT id, concat_ws(' | ', {iso('observed_at')}, coalesce(nullif(delta_type, ''), 'SOURCE'),
  coalesce(nullif(market, ''), source_queue_id), interconnection_queue_id, project_name,
  coalesce(capacity_mw || ' MW', 'capacity unknown'), substation_or_node, status, review_status)
  AS line FROM sig""",
    "filtered_export": f"""WITH {INSIGHTS}
SELECT concat_ws(',', {', '.join(f"chr(34) || replace({printable(f)}, chr(34), chr(34) || chr(34)) || chr(34)" for f in CSV_13)}) AS line
FROM sig WHERE status = 'Active' AND coalesce(capacity_mw, 0) >= 1""",
    "review_queue": f"""WITH {INSIGHTS}
SELECT id, source_queue_id, capacity_mw, review_reasons AS reasons FROM sig
WHERE review_status = 'NEEDS_REVIEW'""",
    "report_paths": f"""WITH {INSIGHTS}
SELECT queue_id, 'reports/' || translate({iso('observed_at')}, ':.', '--') || '/signals.csv' AS csv_path,
  {iso('observed_at')} AS iso FROM sig""",
    "modeled_value": f"""WITH {INSIGHTS}
SELECT src || '-' || event_id AS queue_id, round(CAST(floor(value) AS BIGINT) * 1000
  * least(1.6::DOUBLE, greatest(0.25::DOUBLE, day(ts) / 14.0::DOUBLE)), 4) AS modeled_value
FROM ins""",
    "catalog_load": f"""WITH {CATALOG_ROWS}
SELECT origin, coalesce(trim(queue_id), '') AS queue_id, coalesce(url, '') AS url,
  coalesce(trim(active), '') AS active, utility, coalesce("Market", '') AS "Market",
  trim("Territory") AS "Territory"
FROM typed, (VALUES ('csv'), ('json')) o(origin)""",
    "catalog_files": f"""WITH {CATALOG_ROWS}
SELECT origin, coalesce(trim(queue_id), '') AS queue_id, coalesce(url, '') AS url,
  coalesce(trim(active), '') AS active, utility, coalesce("Market", '') AS "Market",
  trim("Territory") AS "Territory"
FROM typed, (VALUES ('csv'), ('json')) o(origin)
UNION ALL SELECT 'given', 'by-hand', 'https://example.com/one.csv', '', 'One Utility', '', ''""",
    "catalog_normalize": f"""WITH {CATALOG_ROWS}
SELECT source_queue_id, source_url, active, concat_ws(';', 'Market=' || market,
  'Territory=' || territory, 'UtilityName=' || utility) AS extra, error FROM normal""",
    "catalog_upsert": f"""WITH {CATALOG_ROWS}
SELECT source_queue_id, CASE WHEN k % 3 <> 1 THEN source_url ELSE 'https://example.com/old' END
    AS source_url, active,
  CASE k % 3 WHEN 1 THEN 'Market=OLD;Region=East'
    WHEN 2 THEN concat_ws(';', 'Market=' || market, 'Region=East', 'Territory=' || territory,
      'UtilityName=' || utility)
    ELSE concat_ws(';', 'Territory=' || territory, 'UtilityName=' || utility) END AS extra,
  CASE WHEN k % 3 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE {AS_OF} END AS created_at,
  CASE WHEN k % 3 <> 1 THEN {AS_OF} ELSE TIMESTAMP '2024-01-02 00:00:00' END AS updated_at
FROM normal WHERE error IS NULL""",
    "active_sources": f"""WITH {CATALOG_ROWS}
SELECT queue_id, url, active FROM typed
WHERE coalesce(lower(trim(active)) IN ('1', 'true', 'yes', 'y', 'active'), true)""",
    "queue_metadata": f"""WITH {CATALOG_ROWS}
SELECT source_queue_id, concat_ws(';', 'Market=' || market, 'UtilityName=' || utility) AS metadata
FROM normal WHERE error IS NULL""",
    "stored_fingerprint": f"WITH {STATE} SELECT source_queue_id, stored AS fingerprint FROM state",
    "header_fingerprint": f"WITH {LANDED} SELECT source_queue_id, fingerprint FROM landed",
    "source_changes": f"WITH {CHANGES} SELECT * FROM changes",
    "scan_summary": f"""WITH {CHANGES}
SELECT count(*) AS total_targets, count(*) FILTER (scan_status = 'changed') AS changed,
  count(*) FILTER (scan_status = 'unchanged') AS unchanged,
  count(*) FILTER (scan_status = 'error') AS errors,
  count(*) FILTER (scan_status = 'changed') AS parser_invocations FROM changes""",
    "state_upsert": f"""WITH {CHANGES}
SELECT coalesce(s.source_queue_id, c.source_queue_id) AS source_queue_id,
  coalesce(CASE WHEN scan_status <> 'error' THEN new_fingerprint END, last_remote_fingerprint)
    AS last_remote_fingerprint,
  last_hash, last_content_md5,
  coalesce(CASE WHEN scan_status = 'changed' THEN 'PENDING' END,
    CASE WHEN s.source_queue_id IS NOT NULL THEN 'SUCCEEDED' END) AS parser_status,
  coalesce(CASE WHEN scan_status = 'error' THEN 'request failed' WHEN scan_status IS NOT NULL THEN '' END,
    last_error) AS last_error,
  CASE WHEN scan_status = 'error' THEN 'HTTPError' WHEN scan_status IS NOT NULL THEN '' END AS last_error_type,
  CASE WHEN scan_status IS NOT NULL THEN {AS_OF} END AS last_checked_at,
  CASE WHEN scan_status = 'changed' THEN {AS_OF} END AS last_changed_at
FROM state s FULL JOIN (SELECT * FROM changes WHERE source_queue_id IS NOT NULL) c
  ON s.source_queue_id = c.source_queue_id""",
    "request_headers": """SELECT c_custkey,
  CASE WHEN c_custkey % 5 <> 1 THEN concat_ws(';', CASE WHEN c_custkey % 5 > 1 THEN 'Accept=' || c_name END,
    CASE WHEN c_custkey % 3 = 0 THEN 'Cookie=c=' || c_custkey
      WHEN c_custkey % 5 > 1 THEN 'Cookie=old=1' END) END AS headers,
  CASE WHEN c_custkey % 5 = 1 THEN 'RequestHeaders must be a JSON object' END AS error
FROM customer""",
    "latest_document": """
WITH a AS (
  SELECT c_custkey AS k, c_custkey % 5 + 1 >= c_custkey % 7 + 1 AS first FROM customer),
b AS (
  SELECT k, first, k % 10 = 3 AS missing, CASE WHEN first THEN 'a ' ELSE 'b ' END || k AS doc_id,
    'GIS_Report_' || CASE WHEN first THEN 'A' ELSE 'B' END AS name,
    '2026-0' || greatest(k % 5 + 1, k % 7 + 1) || '-05T14:31:25-05:00' AS publish_date FROM a)
SELECT 'cust-' || k AS source_queue_id, CASE WHEN NOT missing THEN doc_id END AS doc_id,
  CASE WHEN NOT missing THEN publish_date END AS publish_date,
  CASE WHEN NOT missing THEN 'https://www.ercot.com/misdownload/servlets/mirDownload?doclookupId='
    || replace(doc_id, ' ', '%20') END AS source_url,
  CASE WHEN NOT missing THEN name || '.xlsx' END AS filename_hint,
  CASE WHEN missing THEN 'No document matched the prefix and extension' END AS error
FROM b""",
    "ascii_metadata": r"""SELECT doc_id, substr(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), 1, 512) AS short,
  substr(regexp_replace(source, '[^\x00-\x7F]', '', 'g'), 1, 64) AS source FROM documents""",
    "document_manifest": """SELECT page_id, 'raw/' || page_id || '.html' AS path,
  CAST(strlen(html) AS BIGINT) AS byte_count, md5(html) AS content_md5, 'text/html' AS content_type,
  strlen(html) > 52428800 AS truncated FROM pages""",
    "probe_fingerprint": r"""
WITH a AS (SELECT doc_id, n_chars, encode(text) AS content FROM documents)
SELECT doc_id, 'probe-md5:' || md5(content) || ';bytes=' || octet_length(content)
    || ';length=unknown;range=none' AS whole,
  'probe-md5:' || md5(content[1:1048576]) || ';bytes='
    || least(octet_length(content), 1048576) || ';length=unknown;range=none' AS probe,
  'probe-md5:' || md5(content[1:100]) || ';bytes=' || least(octet_length(content), 100)
    || ';length=' || n_chars || ';range=bytes 0-99' AS short_probe
FROM a""",
    "raw_path": f"""
WITH a AS (
  SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'GIS Report ' || page_id || '.xlsx'
    ELSE coalesce(nullif(regexp_extract(url_decode(split_part(split_part(url, '?', 1), '#', 1)),
      '^[A-Za-z]+://[^/]*.*/([^/]*)$', 1), ''), 'queue-document') END AS name FROM pages),
b AS (SELECT page_id, {sanitize('name', 'A-Za-z0-9_.=')} AS name FROM a)
SELECT page_id, 'raw/valley-power-' || page_id || '/2026/05/21/20260521T090000Z-' || name
  || CASE WHEN contains(name, '.') THEN '' ELSE '.bin' END AS path FROM b""",
    "content_types": """SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'text/html' WHEN 4 THEN 'text/html'
  WHEN 2 THEN 'text/csv' WHEN 6 THEN 'application/pdf'
  WHEN 3 THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'
  ELSE 'application/octet-stream' END AS content_type FROM pages""",
    "format_dispatch": """
WITH a AS (
  SELECT o_orderkey, o_orderkey % 7 AS e, o_orderkey % 5 AS t FROM orders)
SELECT o_orderkey, CASE WHEN e = 0 OR t = 1 THEN 'xlsx' WHEN e = 1 OR t = 3 THEN 'xml'
    WHEN e IN (2, 3) OR t = 2 THEN 'html' WHEN e = 4 OR t = 0 THEN 'csv' END AS table_format,
  CASE WHEN e = 0 OR t = 1 THEN 'xlsx' WHEN e IN (2, 3) OR t = 2 THEN 'html' WHEN e = 5 THEN 'pdf'
    ELSE 'plain' END AS text_format
FROM a""",
    "html_visible_text": PAGE_TEXT,
    "whitespace_lines": r"""
WITH a AS (
  SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS lines
  FROM documents)
SELECT doc_id, array_to_string(list_filter(list_transform(lines, lambda x:
  regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'),
    '^[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+|[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+$', '', 'g')),
  lambda x: x <> ''), chr(10)) AS text FROM a""",
    "decode_text": r"""SELECT doc_id, CASE WHEN doc_id % 4 = 1
  THEN '“' || text ELSE text END AS text FROM documents""",
    "html_tables": matrix_of(
        1, "html-table", 2, "", LINE, "Queue Number|Project Name|POI|Capacity (MW)|Status"
    ),
    "csv_matrix": matrix_of(
        0,
        "csv",
        4,
        "SELECT DISTINCT doc, CAST(1 AS BIGINT) AS row_number, 'Last Updated On|5/21/2026|||' AS cells"
        " FROM docs WHERE doc % 5 = 0 UNION ALL",
        LINE,
        "Queue Number|Project Name|POI|Capacity (MW)|Status",
    ),
    "xlsx_matrix": matrix_of(
        3,
        "xl/worksheets/sheet1.xml",
        2,
        "",
        "concat_ws('|', number, name, node, '', capacity, status)",
        "Queue Number|Project Name|POI||Capacity (MW)|Status",
    ),
    "xml_records": f"""WITH {DOC_ROWS}
SELECT 'doc-' || doc AS doc_id, 'project[' || place || ']' AS source_location,
  CAST(place AS BIGINT) AS source_row_number, 'QueueNumber=' || number || ';ProjectName=' || name
  || ';POI=' || node || ';CapacityMW= ' || capacity || ' ;Status=' || status AS entries,
  CAST(NULL AS VARCHAR) AS error
FROM docs WHERE doc % 5 = 2""",
    "xlsx_text": f"""WITH {DOC_ROWS}
SELECT 'doc-' || doc AS doc_id, {SHEET_TEXT} AS text, CAST(NULL AS VARCHAR) AS error
FROM docs WHERE doc % 5 = 3 GROUP BY doc""",
    "pdf_text": f"""WITH {DOC_ROWS}
SELECT 'doc-' || doc AS doc_id, {PDF_BODY} AS text, CAST(NULL AS VARCHAR) AS error
FROM docs WHERE doc % 5 = 4 GROUP BY doc""",
    "large_cut": """SELECT l_returnflag, l_orderkey, l_linenumber, place FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INT AS place
  FROM lineitem) WHERE place <= 5000""",
    "corpus_text": f"""WITH {DOC_ROWS},
bodies AS (
  SELECT doc, doc % 5 AS kind, string_agg(number || ',"' || name || '",' || concat_ws(',', node, capacity, status), chr(10) ORDER BY place) AS csv,
    string_agg(concat_ws(' ', number, name, node, capacity, status), chr(10) ORDER BY place) AS html,
    string_agg('<q:project><q:QueueNumber>' || number || '</q:QueueNumber><q:ProjectName>' || name || '</q:ProjectName><q:POI>' || node
      || '</q:POI><q:CapacityMW> ' || capacity || ' </q:CapacityMW><q:More><q:Zone>skipped</q:Zone></q:More><q:Status>' || status
      || '</q:Status></q:project>', chr(10) ORDER BY place) AS xml, {SHEET_TEXT} AS sheet, {PDF_BODY} AS pdf
  FROM docs GROUP BY doc),
pages_text AS (
{PAGE_TEXT}),
texts AS (
  SELECT 'doc-' || doc AS doc_id, CASE kind WHEN 1 THEN 'html' WHEN 3 THEN 'xlsx' WHEN 4 THEN 'pdf' ELSE 'plain' END AS route,
    CASE kind WHEN 0 THEN 'Last Updated On,5/21/2026,,,' || chr(10) || chr(10) || 'Queue Number,Project Name,POI,Capacity (MW),Status' || chr(10) || csv || chr(10)
      WHEN 1 THEN 'Open queue' || chr(10) || 'Queue Number Project Name POI Capacity (MW) Status' || chr(10) || html
      WHEN 2 THEN '<q:queue xmlns:q="urn:queue">' || xml || '</q:queue>' WHEN 3 THEN sheet ELSE pdf END AS text
  FROM bodies
  UNION ALL SELECT doc_id, 'html', text FROM pages_text),
checked AS (SELECT *, route = 'pdf' AND length(text) < 50 AS short FROM texts)
SELECT doc_id, route, CASE WHEN NOT short THEN text END AS text,
  CASE WHEN route = 'plain' THEN 'Decoded text payload' WHEN route = 'html' THEN 'Extracted visible text from HTML'
    WHEN route = 'xlsx' THEN 'Extracted worksheet text from XLSX XML parts'
    WHEN short THEN 'Attempted local best-effort PDF text extraction; Local PDF text extraction failed: {SHORT_PDF}'
    ELSE 'Attempted local best-effort PDF text extraction; Used local PDF text extraction' END AS notes,
  CASE WHEN short THEN '{SHORT_PDF}' END AS error
FROM checked""",
    "text_extractions": f"""WITH {RESPONSES}, {DOC_ROWS},
pdfs AS (SELECT doc, length({PDF_BODY}) < 50 AS short FROM docs WHERE doc % 5 = 4 GROUP BY doc),
met AS (
  SELECT doc, CASE WHEN short THEN '{SHORT_PDF}' ELSE error END AS error, interconnection_queue_id, capacity_mw, substation_or_node,
    status, developer_name
  FROM pdfs LEFT JOIN valid ON k // 40 = doc AND k % 40 = doc % 40 WHERE short OR k IS NOT NULL),
good AS (SELECT *, error IS NULL AS fine FROM met)
SELECT 'feed-' || doc AS source_queue_id, 'doc-' || doc AS doc_id,
  CASE WHEN fine THEN interconnection_queue_id END AS interconnection_queue_id, CASE WHEN fine THEN capacity_mw END AS capacity_mw,
  CASE WHEN fine THEN substation_or_node END AS substation_or_node, CASE WHEN fine THEN status END AS status,
  CASE WHEN fine THEN developer_name END AS developer_name,
  CASE WHEN fine THEN CAST((92 - CASE WHEN capacity_mw IS NULL THEN 22 ELSE 0 END - CASE WHEN substation_or_node IS NULL THEN 22 ELSE 0 END
    - CASE WHEN developer_name IS NULL THEN 8 ELSE 0 END) / 100.0 AS DECIMAL(3,2)) END AS extraction_confidence,
  CASE WHEN fine THEN 'NEEDS_REVIEW' END AS review_status,
  CASE WHEN fine THEN concat_ws('; ', CASE WHEN capacity_mw IS NULL THEN 'Missing capacity MW' END,
    CASE WHEN substation_or_node IS NULL THEN 'Missing substation or node' END, CASE WHEN developer_name IS NULL THEN 'Missing developer name' END,
    'Text extraction required fallback handling') END AS reasons,
  error, CASE WHEN NOT fine THEN 'ValueError' END AS error_type
FROM good""",
    "document_table_records": f"""WITH {DOC_ROWS}
SELECT 'feed-' || doc AS source_queue_id, number AS project_key, number AS interconnection_queue_id,
  name AS project_name, mw AS capacity_mw,
  CASE WHEN doc % 5 = 2 THEN 'CapacityMW' ELSE 'Capacity (MW)' END AS capacity_source_field,
  node AS substation_or_node, CASE status WHEN 'DONE' THEN 'Completed' WHEN 'Withdrawn' THEN 'Withdrawn'
    ELSE 'Active' END AS status,
  CAST(NULL AS VARCHAR) AS developer_name, CAST(NULL AS VARCHAR) AS county,
  CAST(NULL AS VARCHAR) AS state, CAST(NULL AS VARCHAR) AS zone, CAST(NULL AS VARCHAR) AS fuel_type,
  CAST(0.99 AS DECIMAL(3,2)) AS extraction_confidence, 'AUTO_REVIEWED' AS review_status,
  CASE doc % 5 WHEN 0 THEN 'csv' WHEN 1 THEN 'html-table' WHEN 2 THEN 'project[' || place || ']'
    ELSE 'xl/worksheets/sheet1.xml' END AS source_location,
  CAST(place + CASE doc % 5 WHEN 0 THEN 3 WHEN 2 THEN 0 ELSE 1 END AS BIGINT) AS source_row_number,
  CAST(CASE doc % 5 WHEN 0 THEN 3 WHEN 2 THEN NULL ELSE 1 END AS BIGINT) AS source_header_row_number
FROM docs WHERE doc % 5 < 4""",
    "header_rows": f"""WITH {MATRIX}
SELECT 'src-' || n AS source_queue_id, row_seq, array_to_string(cells, '|') AS cells
FROM marked WHERE is_header""",
    "header_segments": f"""WITH {MATRIX}
SELECT 'src-' || n AS source_queue_id, row_seq, array_to_string(header, '|') AS header,
  header_row AS source_header_row_number, array_to_string(cells, '|') AS cells FROM segments""",
    "row_zip": f"""WITH {MATRIX},
pairs AS (
  SELECT n, row_seq, unnest(header) AS h, unnest(cells) AS c, unnest(generate_series(1, 8)) AS i
  FROM segments),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY n, row_seq, h ORDER BY i) AS copy
  FROM pairs WHERE h <> '' AND c <> '')
SELECT 'src-' || n AS source_queue_id, row_seq AS ord,
  string_agg(h || CASE WHEN copy > 1 THEN ' ' || copy ELSE '' END || '=' || c, ';' ORDER BY i) AS entries
FROM numbered GROUP BY n, row_seq""",
    "json_objects": f"""WITH {RESPONSES}
SELECT k AS response_id, shape <> 'none' AS is_object, CASE WHEN shape = 'none' THEN NULL
  WHEN shape = 'full' AND k % 5 = 3 THEN 'Unclear' ELSE 'queued' END AS status FROM answers""",
    "extraction_validate": f"""WITH {RESPONSES}
SELECT k AS response_id, interconnection_queue_id, capacity_mw, substation_or_node, status,
  developer_name, error FROM valid""",
    "extraction_score": f"""WITH {RESPONSES},
a AS (
  SELECT *, k % 8 = 0 AS cut, k % 8 <> 0 AND k % 9 = 0 AS fallback FROM valid WHERE error IS NULL)
SELECT k AS response_id,
  CAST((100 - CASE WHEN capacity_mw IS NULL THEN 22 ELSE 0 END
    - CASE WHEN substation_or_node IS NULL THEN 22 ELSE 0 END
    - CASE WHEN developer_name IS NULL THEN 8 ELSE 0 END
    - CASE WHEN cut THEN 12 ELSE 0 END - CASE WHEN fallback THEN 8 ELSE 0 END) / 100.0
    AS DECIMAL(3,2)) AS extraction_confidence,
  CASE WHEN capacity_mw IS NULL OR substation_or_node IS NULL OR developer_name IS NULL OR cut
    OR fallback THEN 'NEEDS_REVIEW' ELSE 'AUTO_REVIEWED' END AS review_status,
  concat_ws('; ', CASE WHEN capacity_mw IS NULL THEN 'Missing capacity MW' END,
    CASE WHEN substation_or_node IS NULL THEN 'Missing substation or node' END,
    CASE WHEN developer_name IS NULL THEN 'Missing developer name' END,
    CASE WHEN cut THEN 'Source text was truncated before LLM extraction' END,
    CASE WHEN fallback THEN 'Text extraction required fallback handling' END) AS reasons
FROM a""",
    "extraction_insights": f"""WITH {RESPONSES}
SELECT 'q-' || k AS queue_id, {OBSERVED} AS observed_at, 'SOURCE_EXTRACTION' AS insight_type, {AS_OF} AS parsed_at,
  'https://grid.test/' || k AS source_url, 'raw/' || k AS raw_s3_key, CAST(NULL AS VARCHAR) AS content_md5,
  'model-1' AS model_id, capacity_mw,
  CASE WHEN capacity_mw IS NULL OR substation_or_node IS NULL OR developer_name IS NULL OR k % 8 = 0
    OR (k % 8 <> 0 AND k % 9 = 0) THEN 'NEEDS_REVIEW' ELSE 'AUTO_REVIEWED' END AS review_status,
  status, substation_or_node AS node
FROM valid WHERE error IS NULL""",
    "lead_validate": """
WITH a AS (
  SELECT *, c_custkey % 20 IN (0, 8) AS bad FROM customer)
SELECT c_custkey, CASE WHEN bad THEN '' WHEN c_custkey % 4 = 1 THEN 'not-an-email'
    ELSE 'buyer' || c_custkey || '@example.com' END AS email,
  CASE WHEN bad OR c_custkey % 4 = 2 THEN '' ELSE c_name END AS company,
  CASE WHEN bad THEN '' ELSE 'Power Strategy' END AS role,
  CASE WHEN bad THEN '' ELSE c_mktsegment END AS priority_territories,
  CASE WHEN bad OR c_custkey % 12 = 3 THEN '' ELSE 'Monitor withdrawals' END AS use_case,
  'NEW' AS status,
  CASE WHEN c_custkey % 20 = 8 THEN 'Request body must be valid JSON'
    WHEN bad THEN 'Request body must be a JSON object'
    WHEN c_custkey % 4 = 1 THEN 'A valid work email is required'
    WHEN c_custkey % 4 = 2 THEN 'Company is required'
    WHEN c_custkey % 12 = 3 THEN 'Use case is required' END AS error
FROM a""",
}
