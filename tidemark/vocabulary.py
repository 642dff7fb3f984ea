"""Column aliases, status words, limits and labels.

Every value in this module must equal the published behaviour for results to
match, so they are stated plainly. Alias order is priority order.
"""

# --- header aliases (fixed values, normalised form: lower-case a-z0-9) -------
PROJECT_ID = (
    "queuepos",
    "queueposition",
    "queuenumber",
    "generationinterconnectionnumber",
    "projectnumber",
    "projectid",
    "inr",
    "qp",
    "applicationid",
    "ifsqueuenumber",
    "requestid",
    "interconnectionrequestid",
)
PROJECT_NAME = (
    "projectname",
    "commercialname",
    "alternativename",
    "generatingfacility",
    "facilityname",
    "name",
)
DEVELOPER = (
    "developerinterconnectioncustomer",
    "interconnectioncustomer",
    "interconnectioncustomername",
    "interconnectingentity",
    "customer",
    "applicant",
    "owner",
)
NODE = (
    "pointsofinterconnection",
    "pointofinterconnection",
    "poilocation",
    "poiname",
    "poi",
    "substationornode",
    "substation",
    "nearesttownorcounty",
    "bus",
    "node",
)
STATUS = (
    "status",
    "requeststatus",
    "projectstatus",
    "queuestatus",
    "postgiastatus",
    "studyphase",
    "gimstudyphase",
)
WITHDRAWN_DATE = ("withdrawaldate", "datewithdrawn", "wddate")
COUNTY = ("county", "projectcounty", "nearesttownorcounty")
STATE = ("state", "projectstate", "st")
ZONE = ("zone", "z", "cdrreportingzone")
FUEL = ("fuel", "fueltype", "typefuel", "generationfuel1")
COMMERCIAL_NAME = ("commercialname",)
BARE_NAME = ("name",)

# A normalised header is a capacity header when it contains a hint and no exclude.
CAPACITY_HINTS = ("capacity", "mw", "maximumfacilityoutput", "nameplate", "output")
CAPACITY_EXCLUDES = ("mwh", "date", "duration")

# --- status words (fixed values, compared in lower case) ---------------------
STATUS_WORDS = {
    "done": "Completed",
    "in service": "Completed",
    "commercial operation": "Completed",
    "commercial operations": "Completed",
    "complete": "Completed",
    "completed": "Completed",
    "operational": "Completed",
    "energized": "Completed",
    "withdraw": "Withdrawn",
    "withdrawn": "Withdrawn",
    "inactive": "Withdrawn",
    "ina": "Withdrawn",
    "active": "Active",
    "under study": "Active",
    "planned": "Active",
    "pln": "Active",
    "queued": "Active",
    "pending": "Active",
}
ALLOWED_STATUSES = ("Active", "Withdrawn", "Completed")
WITHDRAWN_TOKENS = ("withdraw", "inactive", "ina")
COMPLETED_TOKENS = ("done", "complete", "service", "energized", "commercial operation")

# Cell contents that mean "no value" (fixed values, compared in lower case).
NULL_WORDS = ("n/a", "na", "none", "null", "unknown")
TRUE_WORDS = ("1", "true", "yes", "y", "active")
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n")

# --- labels (fixed values) ---------------------------------------------------
AUTO_REVIEWED = "AUTO_REVIEWED"
NEEDS_REVIEW = "NEEDS_REVIEW"
PROJECT_DELTA = "PROJECT_DELTA"
SOURCE_EXTRACTION = "SOURCE_EXTRACTION"
TABLE_PARSER_MODEL = "deterministic-table-parser-v1"
BASELINE, NEW, UPDATED, REMOVED = "BASELINE", "NEW", "UPDATED", "REMOVED"
# Rank of each delta type when deltas are selected (lowest first).
DELTA_PRIORITY = {REMOVED: 0, NEW: 1, UPDATED: 2, BASELINE: 3}

MISSING_ID = "Missing queue ID"
MISSING_CAPACITY = "Missing capacity MW"
MISSING_NODE = "Missing substation or node"
MISSING_DEVELOPER = "Missing developer name"
BAD_STATUS = "Status is outside allowed values"
TRUNCATED_SOURCE = "Source text was truncated before LLM extraction"
FALLBACK_TEXT = "Text extraction required fallback handling"

# Fields compared between two versions of a record, label -> column.
TRACKED_FIELDS = {
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
# Fields whose presence makes a record more complete.
COMPLETENESS_FIELDS = (
    "interconnection_queue_id",
    "project_name",
    "capacity_mw",
    "substation_or_node",
    "developer_name",
    "county",
    "state",
    "fuel_type",
)

# --- limits (fixed values) ---------------------------------------------------
MAX_SOURCE_BYTES = 50 * 1024 * 1024
PROBE_BYTES = 1024 * 1024
MAX_DOCUMENT_CHARS = 120_000
MAX_PROJECT_RECORDS = 12_000
MAX_DELTAS_PER_SOURCE = 750
BASELINE_SAMPLE = 25
OUTPUT_SAMPLE = 50
REPORT_LOOKBACK_HOURS = 24

# --- media types (fixed values) ----------------------------------------------
HTML_TYPES = ("text/html", "application/xhtml+xml")
XML_TYPES = ("text/xml", "application/xml")
CSV_TYPES = ("text/csv", "application/csv")
SPREADSHEET_TYPE_SUFFIX = "spreadsheetml.sheet"
# Type guessed from a file extension when a server names none.
EXTENSION_TYPES = {
    "csv": "text/csv",
    "htm": "text/html",
    "html": "text/html",
    "json": "application/json",
    "pdf": "application/pdf",
    "txt": "text/plain",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xml": "text/xml",
    "zip": "application/zip",
}
OCTET_STREAM = "application/octet-stream"

# Columns of the two CSV exports (fixed values, in output order).
SIGNAL_CSV_COLUMNS = (
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
)
FILTERED_CSV_COLUMNS = (
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
)
SEARCHED_FIELDS = (
    "interconnection_queue_id",
    "project_name",
    "substation_or_node",
    "developer_name",
    "market",
    "status",
    "delta_type",
)
METADATA_KEYS = (
    "UtilityName",
    "Market",
    "Region",
    "SourceKind",
    "RefreshCadence",
    "OfficialSourcePage",
    "Notes",
)
