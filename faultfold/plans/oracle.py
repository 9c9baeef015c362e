"""The registered queries in DuckDB SQL, written from the rules and not from the Spark code."""

from __future__ import annotations

from faultfold.functions.prompts import (
    DEFAULT_ACTION_PROMPT,
    ENVELOPE_VERSION,
    SYSTEM_PROMPT,
    USER_PROMPT_PARTS,
)
from faultfold.functions.text import WHITE_SPACE
from faultfold.plans.rules import DEFAULT_RULES, FALLBACK
from faultfold.plans.views import LINE_PREFIXES, TEMPLATES


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


def norm(expr: str) -> str:
    low = f"lower(replace({expr}, 'İ', 'i'))"
    alnum = f"regexp_replace({low}, '[^a-z0-9 ]+', ' ', 'g')"
    return f"trim(regexp_replace({alnum}, '\\s+', ' ', 'g'))"


def hashed(app: str, expr: str) -> str:
    return f"sha256({app} || '|' || {norm(expr)})"


def rfc3339(ts: str) -> str:
    return f"coalesce(strftime({ts}, '%Y-%m-%dT%H:%M:%SZ'), '0001-01-01T00:00:00Z')"


def rendered(ts: str, severity: str, message: str) -> str:
    return f"'[' || {rfc3339(ts)} || '] ' || {severity} || ' ' || {message}"


def day(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d')"


def rule_case(low: str) -> str:
    whens = []
    for number, rule in enumerate(DEFAULT_RULES, start=1):
        tests = " OR ".join(f"contains({low}, {text(k)})" for k in rule.keywords)
        whens.append(f"WHEN {tests} THEN {number}")
    return f"CASE {' '.join(whens)} ELSE {len(DEFAULT_RULES) + 1} END"


def label(field: str, number: str) -> str:
    return f"({array(getattr(r, field) for r in [*DEFAULT_RULES, FALLBACK])})[{number}]"


def inferred(message: str) -> str:
    low = f"lower(replace({message}, 'İ', 'i'))"

    def any_of(*words):
        return " OR ".join(f"contains({low}, '{w}')" for w in words)

    return (
        f"CASE WHEN {any_of('critical', 'fatal', 'panic')} THEN 'CRITICAL' "
        f"WHEN {any_of('error', 'exception', 'fail')} THEN 'ERROR' "
        f"WHEN {any_of('warn')} THEN 'WARNING' ELSE 'ERROR' END"
    )


def severity_of(expr: str) -> str:
    return (
        f"CASE WHEN upper({expr}) IN ('CRITICAL', 'FATAL') THEN 'critical' "
        f"WHEN upper({expr}) IN ('HIGH', 'ERROR') THEN 'high' "
        f"WHEN upper({expr}) IN ('MEDIUM', 'WARNING', 'WARN') THEN 'medium' ELSE 'low' END"
    )


KEY = "app, fingerprint_hash, created_date"

VIEWS = {
    "v_logs": f"""
        SELECT 'app' || (user_id % 3) AS app, ts,
          ({array(t[0] for t in TEMPLATES)})[1 + event_id % 15] AS severity,
          ({array(t[1] for t in TEMPLATES)})[1 + event_id % 15] AS message,
          {rendered("ts", "severity", "message")} AS raw_line,
          CASE WHEN event_id % 2 = 0 THEN message ELSE '' END AS dedupe_key,
          ts AS arrival_ts, event_id AS arrival_seq, event_type FROM events""",
    "v_doclogs": """
        SELECT source AS app, TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS ts,
          'ERROR' AS severity, text AS message, text AS raw_line, text AS dedupe_key,
          TIMESTAMP '2024-01-01' + to_seconds(doc_id) AS arrival_ts, doc_id AS arrival_seq
        FROM documents""",
    "v_doclines": f"""
        SELECT doc_id, source AS app,
          ({array(LINE_PREFIXES)})[1 + doc_id % 8] || unnest(string_split(text, chr(10))) AS value
        FROM documents""",
    "v_tickets": f"""
        SELECT o_orderkey AS id, 'app' || (o_custkey % 3) AS app,
          sha256('app' || (o_custkey % 3) || '|' || o_orderkey) AS fingerprint_hash,
          {label("fingerprint", "1 + o_orderkey % 15")} AS fingerprint_text,
          {label("classification", "1 + o_orderkey % 15")} AS classification,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'HIGH'
            WHEN '3-MEDIUM' THEN 'WARN' WHEN '4-NOT SPECIFIED' THEN 'info' ELSE 'low' END
            AS severity,
          {label("component", "1 + o_orderkey % 15")} AS component,
          ({array(t[1] for t in TEMPLATES)})[1 + o_orderkey % 15] AS raw_log,
          o_orderdate AS first_seen,
          o_orderdate + to_seconds((o_custkey % 100) * 3600) AS last_seen,
          {day("o_orderdate")} AS created_date, 1 + o_orderkey % 7 AS occurrence_count,
          CASE WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN o_orderkey % 13 = 0 THEN 'pending'
            WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'open'
            ELSE 'in_progress' END AS status,
          '' AS message_id FROM orders""",
    "v_pos": """
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
          l_suppkey, l_shipdate, l_extendedprice) AS pos FROM lineitem""",
    "v_runs": """
        SELECT l_orderkey % 1000 AS ticket_id, l_orderkey // 1000 AS attempt, pos,
          'app' || (l_orderkey % 3) AS app, 'action' || pos AS action_name,
          l_returnflag = 'R' AS failed,
          CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'part ' || l_partkey END AS output,
          'exit ' || l_linenumber AS err_msg, l_shipdate AS ts FROM v_pos""",
    "v_events": """
        SELECT ticket_id, app, action_name,
          CASE WHEN failed THEN 'failed' WHEN pos % 5 = 0 THEN 'processing' ELSE 'done' END
            AS status, err_msg, output, ts, attempt * 1000 + pos AS seq, attempt, pos
        FROM v_runs""",
    "v_replies": """
        SELECT event_id, CASE event_id % 8
          WHEN 0 THEN good WHEN 1 THEN 'The model says: ' || good
          WHEN 2 THEN good || chr(10) || 'Let me know.' WHEN 3 THEN '{}'
          WHEN 4 THEN '{"classification": "type_' || event_id || '", "severity": ""}'
          WHEN 5 THEN '{"classification": "half", "severity": }'
          WHEN 6 THEN 'plain words only'
          ELSE '{"classification": "nested", "extra": {"a": 1}, "component": "' || event_type
            || '"} and a brace }' END AS reply
        FROM (SELECT event_id, event_type, '{"classification": "type_' || event_id
          || '", "severity": "high", "component": "' || event_type || '", "fingerprint": "print '
          || event_id || '"}' AS good FROM events)""",
    "v_payloads": """
        SELECT ts, upper(event_type) AS severity, event_id AS arrival_seq,
          CASE WHEN event_id % 6 = 0 THEN 'text ' || event_id ELSE '' END AS text_payload,
          CASE event_id % 6 WHEN 1 THEN '{"message": "text ' || event_id || '", "msg": "x"}'
            WHEN 2 THEN '{"log": 5, "msg": "text ' || event_id || '"}'
            WHEN 3 THEN props END AS json_payload,
          CASE WHEN event_id % 6 = 4 THEN 'type.example/audit' END AS proto_type FROM events""",
    "v_records": """
        SELECT (['DEBUG', 'INFO', 'WARN', 'ERROR'])[1 + turn % 4] AS level,
          TIMESTAMP '2024-01-01' + to_seconds(turn * 60) AS time, text AS message, conv_id, role,
          (['worker', 'app', 'source'])[1 + conv_id % 3] AS akey,
          conv_id * 1000 + turn AS seq FROM conversations""",
    "v_bodies": """
        SELECT id, to_json({'ticket_id': id, 'app_name': app, 'classification': classification,
          'severity': severity, 'component': component, 'fingerprint_hash': fingerprint_hash,
          'fingerprint_text': fingerprint_text, 'raw_log': raw_log,
          'first_seen': strftime(first_seen, '%Y-%m-%dT%H:%M:%S.%fZ')})::VARCHAR AS body,
          app, severity, classification FROM v_tickets""",
    "v_actions": """
        SELECT 'app' || (r_regionkey % 3) AS app, r_regionkey + 1 AS pos,
          CASE WHEN r_regionkey % 2 = 0 THEN 'cli_agent' ELSE 'webhook' END AS type,
          CASE WHEN r_regionkey = 4 THEN lower(r_name)
            WHEN r_regionkey % 2 = 0 THEN 'cli_agent:fix-' || lower(r_name)
            ELSE 'webhook:http://hooks.example/' || r_regionkey END AS action_name,
          CASE WHEN r_regionkey = 2
            THEN 'fix {{.Classification}} in {{ .Component }}: {{.RawLog}} ({{.TicketID}})'
            ELSE '' END AS prompt_template FROM region""",
    "v_polls": """
        SELECT 'app' || (user_id % 30) AS app, ts AS poll_ts, event_id AS seq,
          CASE WHEN event_type = 'error' THEN 'timeout ' || props END AS fetch_error
        FROM events""",
    "v_delivery": """
        SELECT l_orderkey AS message_id, CASE WHEN pos = 1 THEN 'published'
          WHEN l_returnflag = 'R' THEN 'failed' WHEN l_quantity < 10 THEN 'mismatched'
          WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'deleted' ELSE 'received' END
          AS kind, l_shipdate + to_seconds(l_partkey % 900) AS ts, pos AS seq FROM v_pos""",
    "v_statuses": """
        SELECT app, 'polling' AS status, '' AS error_msg, CAST(NULL AS TIMESTAMP) AS last_poll,
          seq * 2 AS arrival_seq FROM v_polls
        UNION ALL SELECT app, CASE WHEN fetch_error IS NULL THEN 'idle' ELSE 'error' END,
          coalesce('fetch error: ' || fetch_error, ''), poll_ts, seq * 2 + 1 FROM v_polls""",
    "v_occ": f"""
        SELECT *, {label("classification", "rule_no")} AS classification,
          {label("severity", "rule_no")} AS severity_label,
          {label("component", "rule_no")} AS component,
          {label("fingerprint", "rule_no")} AS fingerprint
        FROM (SELECT *, {hashed("app", "line")} AS fingerprint_hash,
          {day("arrival_ts")} AS created_date,
          {rule_case("lower(replace(line, 'İ', 'i'))")} AS rule_no
          FROM (SELECT *, coalesce(nullif(dedupe_key, ''), raw_line) AS line FROM v_logs))""",
    "v_first_batch": "SELECT * FROM v_occ WHERE arrival_ts < TIMESTAMP '2024-01-15 12:00:00'",
    "v_second_batch": "SELECT * FROM v_occ WHERE arrival_ts >= TIMESTAMP '2024-01-15 12:00:00'",
    "v_known": f"""
        SELECT * REPLACE (CASE WHEN id % 11 = 0 THEN 'done' WHEN id % 13 = 0 THEN 'pending'
          WHEN id % 7 = 0 THEN 'failed' ELSE status END AS status)
        FROM ({{fold:v_first_batch}})""",
    "v_status_log": f"""
        SELECT {KEY}, arrival_seq + 1 AS arrival_seq,
          CASE event_type WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'in_progress'
            ELSE 'failed' END AS status
        FROM v_occ WHERE event_type IN ('purchase', 'signup', 'error')""",
}


def fold(source: str, base: str = "0") -> str:
    """Tickets of a batch on an empty table, with ids after ``base``."""
    return f"""
        SELECT row_number() OVER (ORDER BY first_seq) + {base} AS id, app, fingerprint_hash,
          fingerprint_text, classification, severity, component, raw_log, first_seen,
          CASE WHEN occurrence_count = 1 THEN first_seen ELSE last_arrival END AS last_seen,
          created_date, occurrence_count, 'open' AS status, '' AS message_id
        FROM (SELECT {KEY}, min(arrival_seq) AS first_seq, count(*) AS occurrence_count,
          arg_min(fingerprint, arrival_seq) AS fingerprint_text,
          arg_min(classification, arrival_seq) AS classification,
          arg_min(severity_label, arrival_seq) AS severity,
          arg_min(component, arrival_seq) AS component,
          arg_max(raw_line, arrival_seq) AS raw_log,
          date_trunc('second', arg_min(ts, arrival_seq)) AS first_seen,
          date_trunc('second', arg_max(arrival_ts, arrival_seq)) AS last_arrival
          FROM {source} GROUP BY {KEY})"""


VIEWS["v_known"] = VIEWS["v_known"].replace("{fold:v_first_batch}", fold("v_first_batch"))

NEEDS = {
    "v_runs": ["v_pos"],
    "v_events": ["v_runs"],
    "v_delivery": ["v_pos"],
    "v_statuses": ["v_polls"],
    "v_bodies": ["v_tickets"],
    "v_occ": ["v_logs"],
    "v_first_batch": ["v_occ"],
    "v_second_batch": ["v_occ"],
    "v_known": ["v_first_batch"],
    "v_status_log": ["v_occ"],
}


def query(views: str, body: str) -> str:
    """``body`` after the CTEs of the named views and what they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in NEEDS.get(name, []):
            visit(needed)
        if name not in order:
            order.append(name)

    for name in views.split():
        visit(name)
    ctes = ", ".join(f"{name} AS ({VIEWS[name]})" for name in order)
    return f"WITH {ctes} {body}" if ctes else body


def _matches(text_: str) -> str:
    hay = (
        "lower(message || ' conv=' || conv_id || ' ' || akey || '=' || role || ' app=late')"
    )
    return f"contains({hay}, '{text_}')"


def _prompt() -> str:
    """Substitution by nested replaces; ticket texts contain no placeholders."""
    expr = (
        "CASE WHEN prompt_template = '' THEN "
        + text(DEFAULT_ACTION_PROMPT)
        + " ELSE prompt_template END"
    )
    fields = {
        "{{.AppName}}": "t.app",
        "{{.Component}}": "component",
        "{{ .Component }}": "component",
        "{{.Severity}}": "severity",
        "{{.Classification}}": "classification",
        "{{.FirstSeen}}": "strftime(first_seen, '%Y-%m-%d %H:%M:%S') || ' +0000 UTC'",
        "{{.FingerprintText}}": "fingerprint_text",
        "{{.RawLog}}": "raw_log",
        "{{.TicketID}}": "id::VARCHAR",
    }
    for name, value in fields.items():
        expr = f"replace({expr}, '{name}', {value})"
    return expr


def _upsert(second: str = "v_second_batch") -> str:
    return f"""
        d AS ({fold(second, "(SELECT max(id) FROM v_known)")}),
        f AS (SELECT {KEY}, count(*) AS n,
          date_trunc('second', arg_max(arrival_ts, arrival_seq)) AS seen,
          arg_max(raw_line, arrival_seq) AS line, min(arrival_seq) AS first_seq
          FROM {second} GROUP BY {KEY}),
        hit AS (SELECT k.*, f.n, f.seen, f.line FROM v_known k LEFT JOIN f USING ({KEY})),
        fresh AS (SELECT {KEY}, row_number() OVER (ORDER BY first_seq)
          + (SELECT max(id) FROM v_known) AS id FROM f ANTI JOIN v_known USING ({KEY}))"""


def _upserted() -> str:
    return f"""
        SELECT id, app, fingerprint_hash, fingerprint_text, classification, severity, component,
          CASE WHEN live THEN line ELSE raw_log END AS raw_log, first_seen,
          CASE WHEN live THEN seen ELSE last_seen END AS last_seen, created_date,
          CASE WHEN live THEN occurrence_count + n ELSE occurrence_count END AS occurrence_count,
          status, message_id
        FROM (SELECT *, n IS NOT NULL AND status NOT IN ('done', 'failed') AS live FROM hit)
        UNION ALL
        SELECT fresh.id, d.* EXCLUDE (id) FROM d JOIN fresh USING ({KEY})"""


DETAIL = """
    r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticket_id ORDER BY seq DESC)
      AS rn FROM v_events WHERE ticket_id > 0) WHERE rn <= 20),
    e AS (SELECT ticket_id AS id, string_agg(seq || ':' || status || ':' || action_name, ','
      ORDER BY seq) AS events,
      arg_max(output, seq) FILTER (WHERE status = 'done' AND output <> '') AS last_output
      FROM r GROUP BY ticket_id)"""

PROMPT = (
    f"{text(USER_PROMPT_PARTS[0])} || app || {text(USER_PROMPT_PARTS[1])} || line || "
    f"{text(USER_PROMPT_PARTS[2])}"
)
