"""Row shapes and enumerations shared by every operator."""

LOG_ENTRY = (
    "app string, ts timestamp, severity string, message string, raw_line string, "
    "dedupe_key string, arrival_ts timestamp, arrival_seq bigint"
)

TICKET = (
    "id bigint, app string, fingerprint_hash string, fingerprint_text string, "
    "classification string, severity string, component string, raw_log string, "
    "first_seen timestamp, last_seen timestamp, created_date string, "
    "occurrence_count bigint, status string, message_id string"
)

TICKET_MESSAGE = (
    "ticket_id bigint, app_name string, classification string, severity string, "
    "component string, fingerprint_hash string, fingerprint_text string, "
    "raw_log string, first_seen timestamp"
)

WORKER_EVENT = (
    "ticket_id bigint, app string, action_name string, classification string, "
    "severity string, status string, err_msg string, output string, ts timestamp, seq bigint"
)

RUN = (
    "ticket_id bigint, app string, classification string, severity string, attempt bigint, "
    "pos int, action_name string, failed boolean, output string, err_msg string, ts timestamp"
)

APP_STATUS = (
    "app string, status string, error_msg string, last_poll timestamp, arrival_seq bigint"
)

LOG_RECORD = (
    "level string, time timestamp, message string, "
    "attrs array<struct<key:string,value:string>>, seq bigint"
)

RULE = (
    "rule_no int, keywords array<string>, classification string, severity string, "
    "component string, fingerprint string"
)


def column_names(schema: str) -> list[str]:
    """Top-level column names of one of the schemas above."""
    return [field.split()[0] for field in schema.split(", ")]


# One ticket per key. The hash comes first because it is the most selective column: the
# sort-based aggregation compares only the first bytes of the leading key most of the time.
TICKET_KEY = ["fingerprint_hash", "app", "created_date"]

LABELS = ["classification", "severity", "component", "fingerprint"]

# Ticket, event and poll states.
TICKET_STATUSES = ["open", "in_progress", "done", "failed", "pending"]
CLOSED_STATUSES = ["done", "failed"]
ACTIVE_STATUSES = ["open", "in_progress", "pending", "failed"]
EVENT_STATUSES = ["processing", "done", "failed"]
POLL_STATUSES = ["polling", "idle", "error"]
