"""Every operator as a query over the driver's tables, next to its SQL counterpart."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultfold import schemas
from faultfold.functions import prompts, text
from faultfold.functions.records import record_component
from faultfold.operators import actions as act
from faultfold.operators import classify, delivery, recent, tickets, views, work
from faultfold.plans import oracle
from faultfold.plans import views as given
from faultfold.plans.oracle import query
from faultfold.plans.rules import DEFAULT_RULES
from faultfold.session import materialize, shared_folder
from faultfold.sources import fetch, logs, messages, records, sink
from faultfold.sources import tickets as stored
from faultfold.streaming import pipeline, polls, state

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

COLUMNS = schemas.column_names(schemas.TICKET)
CUT = "2024-01-15 12:00:00"
AS_OF = "2024-01-30 12:00:00"
INTERVAL_S = 43200
DEPTH_AS_OF = "1999-06-15 00:10:00"


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query; results carry times without zone, as the SQL side does."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            df = fn(spark, sf_dir)
            zoned = [c for c, t in df.dtypes if t == "timestamp"]
            return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def moment(value: str) -> Column:
    return F.lit(value).cast("timestamp")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/faultfold/{label}-{uuid.uuid4().hex}"


# ---- sources and sinks ---------------------------------------------------------------------


@register(
    "s1_text_lines",
    query(
        "v_doclines",
        f"""
        SELECT app, severity, message, line AS dedupe_key,
          {oracle.rendered("TIMESTAMP '2024-01-01' + to_seconds(doc_id)", "severity", "message")}
            AS raw_line
        FROM (SELECT *, CASE WHEN p = '' THEN 'ERROR' ELSE upper(p) END AS severity,
          CASE WHEN p = '' THEN line ELSE line[length(p) + 2:] END AS message
          FROM (SELECT doc_id, app, line, regexp_extract(line,
            '(?i)^(CRITICAL|ERROR|WARN|WARNING|INFO|DEBUG) ', 1) AS p
            FROM (SELECT doc_id, app, trim(value, {oracle.text(text.WHITE_SPACE)}) AS line
              FROM v_doclines) WHERE line <> '' AND line NOT LIKE '#%'))""",
    ),
)
def s1_text_lines(spark, sf_dir):
    lines = given.doc_lines(spark, sf_dir)
    ts = given.plus_seconds(moment("2024-01-01"), F.col("doc_id"))
    parsed = logs.parse_text_lines(lines, F.col("app"), ts)
    return parsed.select("app", "severity", "message", "dedupe_key", "raw_line")


@register(
    "s2_event_records",
    query(
        "v_logs",
        f"""
        SELECT arrival_seq, app, ts, severity, message, '' AS dedupe_key,
          {oracle.rendered("ts", "severity", "message")} AS raw_line
        FROM (SELECT *, {oracle.inferred("message")} AS severity FROM (
          SELECT arrival_seq, app,
            CASE WHEN arrival_seq % 10 <> 3 THEN date_trunc('millisecond', ts) END AS ts,
            CASE WHEN arrival_seq % 7 <> 0 THEN message ELSE '' END AS message FROM v_logs))""",
    ),
)
def s2_event_records(spark, sf_dir):
    seq = F.col("arrival_seq")
    exported = given.logs(spark, sf_dir).select(
        F.col("app").alias("source_app"),
        F.when(seq % 10 != 3, F.unix_millis("ts")).alias("timestamp"),
        F.when(seq % 7 != 0, F.col("message")).alias("message"),
        "arrival_ts",
        "arrival_seq",
    )
    return logs.from_event_records(exported, F.col("source_app")).drop("arrival_ts")


@register(
    "s3_structured_entries",
    query(
        "v_payloads",
        f"""
        SELECT arrival_seq, 'gateway' AS app, ts, severity, message,
          {oracle.rendered("ts", "severity", "message")} AS raw_line
        FROM (SELECT *, CASE WHEN text_payload <> '' THEN text_payload
          WHEN json_extract(json_payload, '$.message') IS NOT NULL
            THEN json_extract_string(json_payload, '$.message')
          WHEN json_extract(json_payload, '$.msg') IS NOT NULL
            THEN json_extract_string(json_payload, '$.msg')
          WHEN json_payload IS NOT NULL
            THEN '[JSON payload with ' || len(json_keys(json_payload)) || ' fields]'
          WHEN proto_type IS NOT NULL THEN '[proto payload: ' || proto_type || ']'
          ELSE '[empty log entry]' END AS message FROM v_payloads)""",
    ),
)
def s3_structured_entries(spark, sf_dir):
    entries = logs.from_structured_entries(given.payloads(spark, sf_dir), "gateway")
    return entries.drop("arrival_ts", "dedupe_key")


FETCHED = "SELECT app, arrival_seq, ts FROM v_logs WHERE ts"


@register(
    "s4_fetch_event_records", query("v_logs", f"{FETCHED} >= TIMESTAMP '2024-01-29 12:00:00'")
)
def s4_fetch_event_records(spark, sf_dir):
    fetched = logs.fetch_since(given.logs(spark, sf_dir), moment(AS_OF), INTERVAL_S, "event_records")
    return fetched.select("app", "arrival_seq", "ts")


def event_fetcher(sf_dir: str) -> fetch.Fetch:
    """Fetches the raw events of an app from their file, as a service with an export would."""
    path = f"{sf_dir.rstrip('/')}/events.parquet".removeprefix("file://")

    def events(app: str, since: datetime, until: datetime):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        rows = ds.dataset(path)
        zone = rows.schema.field("ts").type.tz
        low, high = (t if zone else t.replace(tzinfo=None) for t in (since, until))
        unit = rows.schema.field("ts").type
        wanted = (ds.field("ts") >= pa.scalar(low, unit)) & (ds.field("ts") < pa.scalar(high, unit))
        kinds = [pa.int64(), pa.timestamp("us", "UTC"), pa.int64(), pa.string(), pa.float64(), pa.string()]
        names = ["event_id", "ts", "user_id", "event_type", "value", "props"]
        for batch in rows.to_batches(filter=wanted, columns=names):
            user = batch.column("user_id").cast(pa.int64())
            own = pc.equal(pc.subtract(user, pc.multiply(pc.divide(user, 3), 3)), int(app.removeprefix("app")))
            kept = batch.filter(own)
            yield pa.RecordBatch.from_arrays([kept.column(n).cast(k) for n, k in zip(names, kinds)], names)

    return events


APPS = "app0,app1,app2"


@register("x2_fetch_batch", query("v_logs", f"{FETCHED} >= TIMESTAMP '2024-01-29 12:00:00'"))
def x2_fetch_batch(spark, sf_dir):
    """The poll of ``s4_fetch_event_records`` through a data source, with its start pushed into the fetch."""
    fetch.register_source(spark, "faultfold_events", event_fetcher(sf_dir), given.TABLES["events"])
    source = spark.read.format("faultfold_events").option("apps", APPS).option("until", "2030-01-01")
    fetched = logs.fetch_since(given.logs_from(source.load()), moment(AS_OF), INTERVAL_S, "event_records")
    return fetched.select("app", "arrival_seq", "ts")


@register("x2_fetch_stream", query("v_logs", f"{FETCHED} >= TIMESTAMP '2024-01-29 12:00:00'"))
def x2_fetch_stream(spark, sf_dir):
    """The same lines as a stream that is stopped half way and started again."""
    fetch.register_source(spark, "faultfold_events", event_fetcher(sf_dir), given.TABLES["events"])
    root = scratch(spark, "fetched")
    source = spark.readStream.format("faultfold_events").option("apps", APPS)
    source = source.option("since", "2024-01-29T12:00:00")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    for until in ("2024-01-30T06:00:00", "2030-01-01"):
        stream = given.logs_from(source.option("until", until).load())
        query = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(keep)
        query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select("app", "arrival_seq", "ts")


@register("s4_fetch_structured", query("v_logs", f"{FETCHED} > TIMESTAMP '2024-01-29 12:00:00'"))
def s4_fetch_structured(spark, sf_dir):
    fetched = logs.fetch_since(given.logs(spark, sf_dir), moment(AS_OF), INTERVAL_S, "structured")
    return fetched.select("app", "arrival_seq", "ts")


@register(
    "s5_source_filter",
    query(
        "v_logs",
        f"{FETCHED} > TIMESTAMP '2024-01-29 12:00:00' AND (severity = 'WARN' OR app = 'app1')",
    ),
)
def s5_source_filter(spark, sf_dir):
    kept = logs.source_filter(
        given.logs(spark, sf_dir), "severity = 'WARN' or app = 'app1'", moment(AS_OF), INTERVAL_S
    )
    return kept.select("app", "arrival_seq", "ts")


@register(
    "s6_union_sources",
    query(
        "v_logs v_doclogs",
        """
        SELECT app, severity, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts
        FROM (SELECT app, severity, ts FROM v_logs UNION ALL
          SELECT app, severity, ts FROM v_doclogs) GROUP BY app, severity""",
    ),
)
def s6_union_sources(spark, sf_dir):
    both = logs.union_sources(given.logs(spark, sf_dir), given.doc_logs(spark, sf_dir))
    return both.groupBy("app", "severity").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@register("s7_message_bodies", query("v_bodies", "SELECT id AS ticket_id, body FROM v_bodies"))
def s7_message_bodies(spark, sf_dir):
    rows = messages.ticket_messages(given.tickets(spark, sf_dir))
    return messages.message_bodies(rows).select("ticket_id", "body")


@register(
    "s7_written_messages",
    query(
        "v_tickets",
        """
        SELECT id AS ticket_id, app AS app_name, classification, raw_log, first_seen,
          'mock-msg-1704067200000-' || row_number() OVER (ORDER BY id) AS mock_message_id
        FROM v_tickets""",
    ),
)
def s7_written_messages(spark, sf_dir):
    """Write the messages as JSON lines and read the files back."""
    at = moment("2024-01-01")
    rows = messages.message_ids(messages.ticket_messages(given.tickets(spark, sf_dir)), at)
    path = scratch(spark, "messages")
    messages.write_ticket_messages(rows, path)
    ok, _ = messages.read_ticket_messages(spark.read.text(path), "value")
    return ok.select(
        "ticket_id",
        "app_name",
        "classification",
        "raw_log",
        "first_seen",
        F.get_json_object("value", "$.mock_message_id").alias("mock_message_id"),
    )


@register(
    "s7_stream_sink",
    query(
        "v_bodies",
        """
        SELECT id AS ticket_id, app AS app_name, severity, classification,
          id % 3 AS batch FROM v_bodies""",
    ),
)
def s7_stream_sink(spark, sf_dir):
    """The message of every ticket once, through the streaming sink, in three batches."""
    root = scratch(spark, "sink")
    bodies = messages.message_bodies(messages.ticket_messages(given.tickets(spark, sf_dir)), "value")
    spark.dataSource.register(sink.MessageSink)
    for part in range(3):
        bodies.filter(F.col("ticket_id") % 3 == part).select("value").write.parquet(f"{root}/in/{part}")
        stream = spark.readStream.schema("value string").parquet(f"{root}/in/*")
        query = stream.writeStream.format(sink.NAME).option("path", f"{root}/out")
        query = query.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
        query.start().awaitTermination()
    ok, _ = messages.read_ticket_messages(sink.written_messages(spark, f"{root}/out"), "value")
    return ok.select("ticket_id", "app_name", "severity", "classification", "batch")


@register(
    "s8_messages_read",
    query(
        "v_tickets",
        """
        SELECT id AS ticket_id, app AS app_name, classification, severity, component,
          fingerprint_hash, fingerprint_text, raw_log, first_seen
        FROM v_tickets WHERE id % 17 <> 0""",
    ),
)
def s8_messages_read(spark, sf_dir):
    ok, _ = messages.read_ticket_messages(given.messages(spark, sf_dir))
    return ok.select(*schemas.column_names(schemas.TICKET_MESSAGE))


@register(
    "s8_messages_rejected",
    query(
        "v_bodies", "SELECT id, body[1:length(body) - 1] AS body FROM v_bodies WHERE id % 17 = 0"
    ),
)
def s8_messages_rejected(spark, sf_dir):
    _, rejects = messages.read_ticket_messages(given.messages(spark, sf_dir))
    return rejects.select("id", "body")


@register(
    "s9_message_attributes",
    query(
        "v_tickets",
        """
        SELECT id AS ticket_id, app AS attr_app, severity AS attr_severity,
          classification AS attr_classification FROM v_tickets""",
    ),
)
def s9_message_attributes(spark, sf_dir):
    rows = messages.message_attributes(messages.ticket_messages(given.tickets(spark, sf_dir)))
    return rows.select(
        "ticket_id",
        F.col("attributes")["AppName"].alias("attr_app"),
        F.col("attributes")["Severity"].alias("attr_severity"),
        F.col("attributes")["Classification"].alias("attr_classification"),
    )


@register(
    "s10_stored_tickets",
    query(
        "v_occ",
        f"""
        SELECT * REPLACE (CASE WHEN id % 23 <> 0 THEN first_seen END AS first_seen)
        FROM ({oracle.fold("v_occ")})""",
    ),
)
def s10_stored_tickets(spark, sf_dir):
    """Times stored as text, some unreadable, message ids missing; saved by day, read back."""
    rows = tickets.upsert_tickets(given.occurrences(spark, sf_dir))
    as_text = rows.withColumn(
        "first_seen",
        F.when(F.col("id") % 23 == 0, "not a time").otherwise(text.rfc3339_seconds(F.col("first_seen"))),
    ).withColumn("message_id", F.lit(None).cast("string"))
    path = scratch(spark, "tickets")
    stored.save_tickets(as_text, path)
    kept = [c for c in COLUMNS if c != "created_date"]
    types = {**dict(rows.dtypes), "first_seen": "string"}
    schema = ", ".join(f"{c} {types[c]}" for c in [*kept, "created_date"])
    return stored.as_tickets(spark.read.schema(schema).parquet(path))


@register("s11_backfilled_dates", query("v_tickets", "SELECT id, created_date FROM v_tickets"))
def s11_backfilled_dates(spark, sf_dir):
    blank = F.when(F.col("id") % 3 == 0, "").otherwise(F.col("created_date"))
    old = given.tickets(spark, sf_dir).withColumn("created_date", blank)
    return stored.backfill_created_date(old).select("id", "created_date")


@register(
    "s12_log_records",
    query(
        "v_records",
        """
        SELECT seq, level, time, message,
          'conv=' || conv_id || ',' || akey || '=' || role || ',app=late' AS attrs
        FROM v_records""",
    ),
)
def s12_log_records(spark, sf_dir):
    rows = records.log_records(given.records(spark, sf_dir))
    pairs = F.transform("attrs", lambda a: F.concat(a["key"], F.lit("="), a["value"]))
    return rows.withColumn("attrs", F.array_join(pairs, ","))


# ---- projections and scalar functions ------------------------------------------------------


@register("p1_raw_line", query("v_logs", "SELECT arrival_seq, raw_line FROM v_logs"))
def p1_raw_line(spark, sf_dir):
    line = text.raw_line(F.col("ts"), F.col("severity"), F.col("message"))
    return given.logs(spark, sf_dir).select("arrival_seq", line.alias("raw_line"))


@register(
    "p2_infer_severity",
    query(
        "v_doclogs",
        f"SELECT arrival_seq, {oracle.inferred('message')} AS severity FROM v_doclogs",
    ),
)
def p2_infer_severity(spark, sf_dir):
    severity = text.infer_severity(F.col("message"))
    return given.doc_logs(spark, sf_dir).select("arrival_seq", severity.alias("severity"))


@register(
    "p3_split_severity",
    query(
        "v_doclines",
        """
        SELECT severity, count(*) AS n, sum(length(message))::BIGINT AS chars
        FROM (SELECT CASE WHEN p = '' THEN 'ERROR' ELSE upper(p) END AS severity,
          CASE WHEN p = '' THEN value ELSE value[length(p) + 2:] END AS message
          FROM (SELECT value, regexp_extract(value,
            '(?i)^(CRITICAL|ERROR|WARN|WARNING|INFO|DEBUG) ', 1) AS p FROM v_doclines))
        GROUP BY severity""",
    ),
)
def p3_split_severity(spark, sf_dir):
    parts = given.doc_lines(spark, sf_dir).select(text.split_severity(F.col("value")).alias("p"))
    return parts.groupBy(F.col("p.severity").alias("severity")).agg(
        F.count("*").alias("n"), F.sum(F.length("p.message")).alias("chars")
    )


@register(
    "p5_dedupe_text",
    query(
        "v_logs",
        "SELECT arrival_seq, coalesce(nullif(dedupe_key, ''), raw_line) AS line FROM v_logs",
    ),
)
def p5_dedupe_text(spark, sf_dir):
    return given.logs(spark, sf_dir).select("arrival_seq", text.dedupe_text().alias("line"))


@register(
    "p6_normalize_line",
    query(
        "v_doclogs", f"SELECT arrival_seq, {oracle.norm('message')} AS normalized FROM v_doclogs"
    ),
)
def p6_normalize_line(spark, sf_dir):
    line = text.normalize_line(F.col("message"))
    return given.doc_logs(spark, sf_dir).select("arrival_seq", line.alias("normalized"))


@register(
    "p7_fingerprint_hash",
    query(
        "v_doclogs",
        f"""
        SELECT arrival_seq, {oracle.hashed('app', 'message')} AS fingerprint_hash
        FROM v_doclogs""",
    ),
)
def p7_fingerprint_hash(spark, sf_dir):
    hashed = text.with_fingerprint(given.doc_logs(spark, sf_dir))
    return hashed.select("arrival_seq", "fingerprint_hash")


@register(
    "p7_hash_on_message",
    query(
        "v_logs",
        f"""
        SELECT {oracle.hashed('app', 'message')} AS fingerprint_hash, count(*) AS n
        FROM v_logs GROUP BY 1""",
    ),
)
def p7_hash_on_message(spark, sf_dir):
    hashed = text.with_fingerprint(given.logs(spark, sf_dir), "message")
    return hashed.groupBy("fingerprint_hash").agg(F.count("*").alias("n"))


@register(
    "p7_hash_on_fingerprint",
    query(
        "v_occ",
        "SELECT sha256(app || '|' || fingerprint) AS fingerprint_hash, count(*) AS n "
        "FROM v_occ GROUP BY 1",
    ),
)
def p7_hash_on_fingerprint(spark, sf_dir):
    labelled = classify.classify_by_rules(given.logs(spark, sf_dir))
    hashed = text.with_fingerprint(labelled, "fingerprint")
    return hashed.groupBy("fingerprint_hash").agg(F.count("*").alias("n"))


CLASSIFIED_DOCS = query(
    "v_doclogs",
    f"""
    SELECT arrival_seq, {oracle.label("classification", "n")} AS classification,
      {oracle.label("severity", "n")} AS severity, {oracle.label("component", "n")} AS component,
      {oracle.label("fingerprint", "n")} AS fingerprint
    FROM (SELECT arrival_seq, {oracle.rule_case("lower(replace(message, 'İ', 'i'))")} AS n
      FROM v_doclogs)""",
)
LABELLED = ["arrival_seq", *schemas.LABELS]


@register("p8_classify_documents", CLASSIFIED_DOCS)
def p8_classify_documents(spark, sf_dir):
    return classify.classify_by_rules(given.doc_logs(spark, sf_dir)).select(*LABELLED)


@register(
    "p8_classify_logs",
    query(
        "v_occ",
        """
        SELECT arrival_seq, classification, severity_label AS severity, component, fingerprint
        FROM v_occ""",
    ),
)
def p8_classify_logs(spark, sf_dir):
    return classify.classify_by_rules(given.logs(spark, sf_dir)).select(*LABELLED)


def rule_table(spark: SparkSession) -> DataFrame:
    """The default rules as a table."""
    rows = [(n, *rule) for n, rule in enumerate(DEFAULT_RULES, start=1)]
    return spark.createDataFrame(rows, schemas.RULE)


@register("j6_rule_table", CLASSIFIED_DOCS)
def j6_rule_table(spark, sf_dir):
    lines = given.doc_logs(spark, sf_dir)
    return classify.classify_with_rule_table(lines, rule_table(spark)).select(*LABELLED)


@register(
    "j6_large_rule_table",
    """
    WITH hits AS (SELECT o_orderkey, min(p_partkey) AS rule_no FROM orders JOIN part
        ON contains('order of customer ' || o_custkey || ' at ' || o_orderdate,
          'customer ' || p_partkey) GROUP BY o_orderkey)
    SELECT coalesce('part_' || rule_no, 'unknown_error') AS classification, count(*) AS n
    FROM orders LEFT JOIN hits USING (o_orderkey) GROUP BY 1""",
)
def j6_large_rule_table(spark, sf_dir):
    """A keyword for every part, tried on every order."""
    named = F.concat(F.lit("part_"), F.col("p_partkey").cast("string"))
    rules = given.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("rule_no"),
        F.array(F.concat(F.lit("customer "), F.col("p_partkey").cast("string"))).alias("keywords"),
        named.alias("classification"),
        F.lit("low").alias("severity"),
        F.lit("part").alias("component"),
        named.alias("fingerprint"),
    )
    line = F.concat(
        F.lit("order of customer "),
        F.col("o_custkey").cast("string"),
        F.lit(" at "),
        F.col("o_orderdate").cast("string"),
    )
    lines = given.table(spark, sf_dir, "orders").select(line.alias("line"))
    labelled = classify.classify_with_rule_table(lines, rules, F.col("line"))
    return labelled.groupBy("classification").agg(F.count("*").alias("n"))


@register("p9_prompts", query("v_occ", f"SELECT arrival_seq, {oracle.PROMPT} AS prompt FROM v_occ"))
def p9_prompts(spark, sf_dir):
    prompt = prompts.classification_prompt(F.col("app"), text.dedupe_text())
    return given.logs(spark, sf_dir).select("arrival_seq", prompt.alias("prompt"))


@register(
    "p10_model_requests",
    query(
        "v_occ",
        f"""
        SELECT arrival_seq, sha256(to_json({{'messages': [{{'role': 'user', 'content':
          [{{'text': prompt}}]}}], 'system': [{{'text': {oracle.text(prompts.SYSTEM_PROMPT)}}}],
          'inferenceConfig': {{'maxTokens': 512, 'temperature': 0}}}})::VARCHAR) AS blocks_hash,
          sha256(to_json({{'anthropic_version': '{prompts.ENVELOPE_VERSION}', 'max_tokens': 512,
          'temperature': 0, 'system': {oracle.text(prompts.SYSTEM_PROMPT)}, 'messages':
          [{{'role': 'user', 'content': prompt}}]}})::VARCHAR) AS plain_hash
        FROM (SELECT arrival_seq, {oracle.PROMPT} AS prompt FROM v_occ)""",
    ),
)
def p10_model_requests(spark, sf_dir):
    """Both request envelopes of every line, compared by hash."""
    prompt = prompts.classification_prompt(F.col("app"), text.dedupe_text())
    return given.logs(spark, sf_dir).select(
        "arrival_seq",
        F.sha2(prompts.model_request(prompt, "a.nova-b"), 256).alias("blocks_hash"),
        F.sha2(prompts.model_request(prompt, "another"), 256).alias("plain_hash"),
    )


def responses(spark: SparkSession, sf_dir: str, nested: bool) -> DataFrame:
    """Replies in response envelopes: filled, empty, without text, and cut short."""
    case = F.col("event_id") % 5
    item = F.struct(F.col("reply").alias("text"))
    content = F.array(item).alias("content")
    if nested:
        full = F.to_json(F.struct(F.struct(F.struct(content).alias("message")).alias("output")))
        empty, blank = '{"output":{"message":{"content":[]}}}', '{"output":{"message":{"content":[{}]}}}'
    else:
        full = F.to_json(F.struct(content))
        empty, blank = '{"content":[]}', '{"content":[{}]}'
    body = (
        F.when(case == 1, empty)
        .when(case == 2, blank)
        .when(case == 3, F.expr("'{\"cut'"))
        .otherwise(full)
    )
    return given.replies(spark, sf_dir).withColumn("body", body)


RESPONSES = query(
    "v_replies",
    """
    SELECT event_id, CASE event_id % 5 WHEN 1 THEN NULL WHEN 2 THEN '' WHEN 3 THEN NULL
      ELSE reply END AS response,
      CASE event_id % 5 WHEN 1 THEN 'empty response' WHEN 3 THEN 'malformed response' END
      AS reject_reason FROM v_replies""",
)


@register("p11_block_responses", RESPONSES)
def p11_block_responses(spark, sf_dir):
    rows = prompts.response_columns(responses(spark, sf_dir, True), "body", "a.nova-b")
    return rows.select("event_id", "response", "reject_reason")


@register("p11_plain_responses", RESPONSES)
def p11_plain_responses(spark, sf_dir):
    rows = prompts.response_columns(responses(spark, sf_dir, False), "body", "another")
    return rows.select("event_id", "response", "reject_reason")


PARSED = """
    SELECT event_id, obj, json_valid(obj) AS good,
      coalesce(nullif(json_extract_string(CASE WHEN json_valid(obj) THEN obj END,
        '$.classification'), ''), 'unknown_error') AS classification,
      coalesce(nullif(json_extract_string(CASE WHEN json_valid(obj) THEN obj END,
        '$.severity'), ''), 'medium') AS severity,
      coalesce(nullif(json_extract_string(CASE WHEN json_valid(obj) THEN obj END,
        '$.component'), ''), 'unknown') AS component,
      nullif(json_extract_string(CASE WHEN json_valid(obj) THEN obj END,
        '$.fingerprint'), '') AS print
    FROM (SELECT event_id, regexp_extract(reply, '(?s)\\{.*\\}') AS obj FROM v_replies)"""


@register(
    "p12_parsed_replies",
    query(
        "v_replies",
        f"""
        SELECT event_id, classification, severity, component,
          coalesce(print, classification) AS fingerprint FROM ({PARSED}) WHERE good""",
    ),
)
def p12_parsed_replies(spark, sf_dir):
    ok, _ = classify.parse_replies(given.replies(spark, sf_dir))
    return ok.select("event_id", *schemas.LABELS)


@register(
    "p12_rejected_replies",
    query(
        "v_replies",
        f"""
        SELECT event_id, CASE WHEN obj = '' THEN 'no JSON object found' ELSE 'malformed JSON' END
          AS reject_reason FROM ({PARSED}) WHERE NOT good""",
    ),
)
def p12_rejected_replies(spark, sf_dir):
    _, rejects = classify.parse_replies(given.replies(spark, sf_dir))
    return rejects.select("event_id", "reject_reason")


@register(
    "p13_normalize_severity",
    query(
        "v_tickets",
        f"SELECT id, severity, {oracle.severity_of('severity')} AS level FROM v_tickets",
    ),
)
def p13_normalize_severity(spark, sf_dir):
    level = text.normalize_severity(F.col("severity"))
    return given.tickets(spark, sf_dir).select("id", "severity", level.alias("level"))


def record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.log_records(given.records(spark, sf_dir))


@register(
    "p14_record_component",
    query(
        "v_records",
        """
        SELECT seq, CASE akey WHEN 'worker' THEN 'worker:' || role WHEN 'app' THEN role
          ELSE 'src:' || role END AS component FROM v_records""",
    ),
)
def p14_record_component(spark, sf_dir):
    component = record_component(F.col("attrs")).alias("component")
    return record_rows(spark, sf_dir).select("seq", component)


@register(
    "p15_search_records",
    query(
        "v_records",
        f"""
        SELECT seq, level, message FROM v_records
        WHERE level = 'INFO' AND {oracle._matches('source=assist')}""",
    ),
)
def p15_search_records(spark, sf_dir):
    found = views.search_records(record_rows(spark, sf_dir), "INFO", "Source=Assist")
    return found.select("seq", "level", "message")


@register(
    "p16_filter_tickets",
    query(
        "v_tickets",
        f"""
        SELECT id, status, app, severity FROM v_tickets WHERE status = 'open' AND app = 'app1'
          AND {oracle.severity_of('severity')} = 'high'""",
    ),
)
def p16_filter_tickets(spark, sf_dir):
    kept = views.filter_tickets(given.tickets(spark, sf_dir), "open", "app1", "high")
    return kept.select("id", "status", "app", "severity")


@register(
    "p16_pending_tickets", query("v_tickets", "SELECT id FROM v_tickets WHERE status = 'pending'")
)
def p16_pending_tickets(spark, sf_dir):
    return views.pending_tickets(given.tickets(spark, sf_dir)).select("id")


@register(
    "p17_filter_app",
    query(
        "v_logs v_events",
        """
        SELECT 'log' AS kind, arrival_seq AS seq FROM v_logs WHERE app = 'app2'
        UNION ALL SELECT 'event', seq FROM v_events WHERE app = 'app2'""",
    ),
)
def p17_filter_app(spark, sf_dir):
    lines = views.filter_app(given.logs(spark, sf_dir), "app2")
    events = views.filter_app(given.worker_events(spark, sf_dir), "app2")
    return lines.select(F.lit("log").alias("kind"), F.col("arrival_seq").alias("seq")).union(
        events.select(F.lit("event"), "seq")
    )


@register(
    "p18_prompts",
    query(
        "v_tickets v_actions",
        f"""
        SELECT id, pos::INTEGER AS pos, sha256({oracle._prompt()}) AS prompt_hash
        FROM v_tickets t JOIN v_actions a ON t.app = a.app WHERE type = 'cli_agent'""",
    ),
)
def p18_prompts(spark, sf_dir):
    rendered = act.render_prompts(given.tickets(spark, sf_dir), given.actions(spark, sf_dir))
    return rendered.select("id", "pos", F.sha2("prompt", 256).alias("prompt_hash"))


@register(
    "p19_day_key", query("v_logs", f"SELECT arrival_seq, {oracle.day('ts')} AS day FROM v_logs")
)
def p19_day_key(spark, sf_dir):
    return given.logs(spark, sf_dir).select("arrival_seq", text.day_key(F.col("ts")).alias("day"))


# ---- ticket state --------------------------------------------------------------------------

KNOWN = "v_first_batch v_second_batch v_known"


def batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tickets from the first half of January with mixed states, and the later occurrences."""
    occ = given.occurrences(spark, sf_dir)
    first = tickets.upsert_tickets(occ.filter(F.col("arrival_ts") < moment(CUT)))
    status = (
        F.when(F.col("id") % 11 == 0, "done")
        .when(F.col("id") % 13 == 0, "pending")
        .when(F.col("id") % 7 == 0, "failed")
        .otherwise(F.col("status"))
    )
    known = materialize(first.withColumn("status", status), "known")
    return known, occ.filter(F.col("arrival_ts") >= moment(CUT))


A1_SQL = query("v_occ", oracle.fold("v_occ"))


@register("a1_upsert_empty", A1_SQL)
def a1_upsert_empty(spark, sf_dir):
    """All occurrences folded into an empty ticket table."""
    return tickets.upsert_tickets(given.occurrences(spark, sf_dir))


@register(
    "s6_upsert_union",
    query(
        "v_logs v_doclogs",
        f"""
        SELECT app, created_date, count(*) AS tickets, sum(n) AS lines
        FROM (SELECT app, {oracle.hashed('app', 'message')} AS fingerprint_hash,
            {oracle.day('ts')} AS created_date, count(*) AS n
          FROM (SELECT app, ts, message FROM v_logs
            UNION ALL SELECT app, ts, message FROM v_doclogs) GROUP BY ALL)
        GROUP BY app, created_date""",
    ),
)
def s6_upsert_union(spark, sf_dir):
    """Tickets of two sources that are numbered by the library, with ids that are all different."""
    sources = [given.logs(spark, sf_dir), given.doc_logs(spark, sf_dir)]
    entries = logs.union_sources(*[logs.as_entries(s.drop("arrival_seq")) for s in sources])
    rows = tickets.upsert_tickets(classify.occurrences_of(entries, hash_on="message"))
    return rows.groupBy("app", "created_date").agg(
        F.countDistinct("id").alias("tickets"), F.sum("occurrence_count").alias("lines")
    )


@register(
    "a1_upsert_documents",
    query(
        "v_doclogs",
        f"""
        SELECT app, {oracle.hashed('app', 'message')} AS fingerprint_hash,
          {oracle.day('ts')} AS created_date, count(*) AS occurrence_count,
          min(arrival_seq) AS first_seq, arg_max(raw_line, arrival_seq) AS raw_log,
          date_trunc('second', arg_min(ts, arrival_seq)) AS first_seen,
          {oracle.label("classification", "arg_min(n, arrival_seq)")} AS classification
        FROM (SELECT *, {oracle.rule_case("lower(replace(message, 'İ', 'i'))")} AS n
          FROM v_doclogs) GROUP BY 1, 2, 3""",
    ),
)
def a1_upsert_documents(spark, sf_dir):
    """The same fold over whole documents."""
    folded = tickets.fold_occurrences(classify.occurrences_of(given.doc_logs(spark, sf_dir)))
    return folded.select(
        "app",
        "fingerprint_hash",
        "created_date",
        F.col("n").alias("occurrence_count"),
        "first_seq",
        F.col("last.raw_line").alias("raw_log"),
        F.date_trunc("second", "first.seen").alias("first_seen"),
        "first.classification",
    )


UPSERT_SQL = query(KNOWN, "").rstrip() + "," + oracle._upsert() + oracle._upserted()


@register("a1_upsert_known", UPSERT_SQL)
def a1_upsert_known(spark, sf_dir):
    """A second batch on a table with open, pending and closed tickets."""
    known, later = batches(spark, sf_dir)
    return tickets.upsert_tickets(later, known)


@register(
    "j2_skip_closed",
    query(
        KNOWN,
        f"""
        SELECT arrival_seq, fingerprint_hash FROM v_second_batch ANTI JOIN
          (SELECT {oracle.KEY} FROM v_known WHERE status IN ('done', 'failed'))
          USING ({oracle.KEY})""",
    ),
)
def j2_skip_closed(spark, sf_dir):
    known, later = batches(spark, sf_dir)
    return tickets.skip_closed(later, known).select("arrival_seq", "fingerprint_hash")


@register(
    "j2_skipped_counts",
    query(
        KNOWN,
        f"""
        SELECT k.id, count(*) AS skipped FROM v_second_batch JOIN
          (SELECT * FROM v_known WHERE status IN ('done', 'failed')) k USING ({oracle.KEY})
        GROUP BY k.id""",
    ),
)
def j2_skipped_counts(spark, sf_dir):
    known, later = batches(spark, sf_dir)
    return tickets.skipped_counts(later, known)


@register(
    "j3_new_tickets",
    query(
        KNOWN,
        f"""
        SELECT fingerprint_hash, app, created_date, min(arrival_seq) AS arrival_seq,
          arg_min(raw_line, arrival_seq) AS raw_line
        FROM v_second_batch ANTI JOIN v_known USING ({oracle.KEY}) GROUP BY 1, 2, 3""",
    ),
)
def j3_new_tickets(spark, sf_dir):
    known, later = batches(spark, sf_dir)
    return tickets.new_tickets(later, known).select(
        "fingerprint_hash", "app", "created_date", "arrival_seq", "raw_line"
    )


@register(
    "j4_apply_status",
    query(
        "v_tickets v_events",
        """
        SELECT t.id, coalesce(u.status, t.status) AS status FROM v_tickets t LEFT JOIN
          (SELECT ticket_id, arg_max(status, seq) AS status FROM v_events GROUP BY ticket_id) u
          ON t.id = u.ticket_id""",
    ),
)
def j4_apply_status(spark, sf_dir):
    updates = given.worker_events(spark, sf_dir).select("ticket_id", "status", "seq")
    return tickets.apply_status(given.tickets(spark, sf_dir), updates).select("id", "status")


@register(
    "j4_apply_message_ids",
    query(
        "v_tickets v_events",
        """
        SELECT t.id, coalesce(u.action_name, t.message_id) AS message_id FROM v_tickets t
        LEFT JOIN (SELECT ticket_id, arg_max(action_name, seq) AS action_name FROM v_events
          GROUP BY ticket_id) u ON t.id = u.ticket_id""",
    ),
)
def j4_apply_message_ids(spark, sf_dir):
    updates = given.worker_events(spark, sf_dir).select(
        "ticket_id", F.col("action_name").alias("message_id"), "seq"
    )
    changed = tickets.apply_message_ids(given.tickets(spark, sf_dir), updates)
    return changed.select("id", "message_id")


AS_OF_SQL = f"""
    SELECT o.*, s.status AS status_as_of,
      coalesce(s.status NOT IN ('done', 'failed'), true) AS counted
    FROM v_occ o ASOF LEFT JOIN v_status_log s ON o.app = s.app
      AND o.fingerprint_hash = s.fingerprint_hash AND o.created_date = s.created_date
      AND o.arrival_seq >= s.arrival_seq"""


@register(
    "j10_status_as_of",
    query(
        "v_occ v_status_log", f"SELECT arrival_seq, status_as_of, counted FROM ({AS_OF_SQL})"
    ),
)
def j10_status_as_of(spark, sf_dir):
    labelled = tickets.status_as_of(
        given.occurrences(spark, sf_dir), given.status_log(spark, sf_dir)
    )
    return labelled.select("arrival_seq", "status_as_of", "counted")


@register(
    "j10_upsert_with_status",
    query("v_occ v_status_log", "").rstrip()
    + f""",
    v_counted AS (SELECT * FROM ({AS_OF_SQL}) WHERE counted),
    f AS ({oracle.fold("v_counted")}),
    l AS (SELECT {oracle.KEY}, arg_max(status, arrival_seq) AS final FROM v_status_log
      GROUP BY {oracle.KEY})
    SELECT f.* REPLACE (coalesce(l.final, f.status) AS status) FROM f LEFT JOIN l
      USING ({oracle.KEY})""",
)
def j10_upsert_with_status(spark, sf_dir):
    """The fold with tickets closed and reopened between their occurrences."""
    empty = spark.createDataFrame([], schemas.TICKET)
    return tickets.upsert_with_status(
        given.occurrences(spark, sf_dir), empty, given.status_log(spark, sf_dir)
    )


@register(
    "j10_text_sources",
    query(
        "v_logs v_doclogs",
        f"""
        SELECT app, count(*) AS lines, count(*) FILTER (hash[1] NOT BETWEEN '4' AND '7') AS counted
        FROM (SELECT app, {oracle.hashed('app', 'message')} AS hash FROM (SELECT app, message FROM v_logs
          UNION ALL SELECT app, message FROM v_doclogs)) GROUP BY app""",
    ),
)
def j10_text_sources(spark, sf_dir):
    """Status as of arrival for two sources whose lines the library numbers itself."""
    sources = [given.logs(spark, sf_dir), given.doc_logs(spark, sf_dir)]
    entries = logs.union_sources(*[logs.as_entries(s.drop("arrival_seq")) for s in sources])
    occ = classify.occurrences_of(entries, hash_on="message")
    # Texts are hashed once; states and occurrences need no more than the ticket key and the place.
    occ = materialize(occ.select(*schemas.TICKET_KEY, "arrival_seq"), "occurrences")
    head = F.substring("fingerprint_hash", 1, 1)
    keys = occ.select(*schemas.TICKET_KEY).distinct()
    closed = keys.filter(head.between("0", "7")).withColumn("status", F.lit("done"))
    reopened = keys.filter(head.between("0", "3")).withColumn("status", F.lit("open"))
    labelled = tickets.status_as_of(
        occ, reopened.withColumn("arrival_seq", F.lit(0).cast("bigint")), closed
    )
    return labelled.groupBy("app").agg(
        F.count("*").alias("lines"), F.count_if("counted").alias("counted")
    )


@register(
    "a7_publish_outcomes",
    query(
        "v_tickets",
        """
        SELECT id, CASE WHEN status = 'open' AND id % 5 = 0 THEN 'pending' ELSE status END AS status,
          CASE WHEN status = 'open' AND id % 5 <> 0 THEN 'm-' || id ELSE '' END AS message_id
        FROM v_tickets""",
    ),
)
def a7_publish_outcomes(spark, sf_dir):
    rows = given.tickets(spark, sf_dir)
    failed = F.col("id") % 5 == 0
    outcomes = rows.filter("status = 'open'").select(
        F.col("id").alias("ticket_id"),
        F.when(~failed, F.concat(F.lit("m-"), F.col("id").cast("string"))).alias("message_id"),
        F.when(failed, "unavailable").alias("error"),
    )
    return tickets.apply_publish_outcomes(rows, outcomes).select("id", "status", "message_id")


@register(
    "w2_assigned_ids",
    query(
        KNOWN,
        f"""
        SELECT fingerprint_hash, app, created_date, row_number() OVER (ORDER BY min(arrival_seq))
          + (SELECT max(id) FROM v_known) AS id
        FROM v_second_batch ANTI JOIN v_known USING ({oracle.KEY}) GROUP BY 1, 2, 3""",
    ),
)
def w2_assigned_ids(spark, sf_dir):
    known, later = batches(spark, sf_dir)
    new = materialize(tickets.new_tickets(later, known).select(*tickets.KEY, "arrival_seq"), "new")
    return tickets.assign_ids(new, tickets.largest_id(known), "arrival_seq").drop("arrival_seq")


@register(
    "w3_occurrences",
    query(
        KNOWN,
        f"""
        SELECT arrival_seq, skipped, base IS NULL AND rn = 1 AS is_new,
          coalesce(base, 0) + CASE WHEN skipped THEN 0 ELSE rn END AS occurrence_no
        FROM (SELECT o.arrival_seq, k.occurrence_count AS base,
          coalesce(k.status IN ('done', 'failed'), false) AS skipped,
          row_number() OVER (PARTITION BY o.app, o.fingerprint_hash, o.created_date
            ORDER BY o.arrival_seq) AS rn
          FROM v_second_batch o LEFT JOIN v_known k USING ({oracle.KEY}))""",
    ),
)
def w3_occurrences(spark, sf_dir):
    known, later = batches(spark, sf_dir)
    return tickets.occurrences(later, known).select(
        "arrival_seq", "skipped", "is_new", "occurrence_no"
    )


@register(
    "w6_message_ids",
    query(
        "v_tickets",
        """
        SELECT id AS ticket_id, 'mock-msg-' || epoch_ms(last_seen) || '-'
          || row_number() OVER (ORDER BY id) AS mock_message_id FROM v_tickets""",
    ),
)
def w6_message_ids(spark, sf_dir):
    rows = given.tickets(spark, sf_dir).select(F.col("id").alias("ticket_id"), "last_seen")
    numbered = messages.message_ids(rows, F.col("last_seen"))
    return numbered.select("ticket_id", "mock_message_id")


# ---- actions and delivery ------------------------------------------------------------------


@register(
    "j7_route_messages",
    query(
        "v_tickets",
        """
        SELECT id, CASE WHEN id % 19 = 0 THEN 'any' WHEN app IN ('app0', 'app1') THEN 'worker'
          ELSE 'returned' END AS route FROM v_tickets""",
    ),
)
def j7_route_messages(spark, sf_dir):
    workers = given.configured_apps(spark, sf_dir).filter("ord < 2").withColumnRenamed("name", "app")
    return delivery.route_messages(given.messages(spark, sf_dir), workers).select("id", "route")


@register(
    "j7_unrouted_messages",
    query("v_tickets", "SELECT id FROM v_tickets WHERE id % 19 <> 0 AND app = 'app2'"),
)
def j7_unrouted_messages(spark, sf_dir):
    workers = given.configured_apps(spark, sf_dir).filter("ord < 2").withColumnRenamed("name", "app")
    return delivery.unrouted_messages(given.messages(spark, sf_dir), workers).select("id")


@register(
    "j8_planned_actions",
    query(
        "v_tickets v_actions",
        """
        SELECT id, pos::INTEGER AS pos, action_name FROM v_tickets t
        JOIN v_actions a ON t.app = a.app""",
    ),
)
def j8_planned_actions(spark, sf_dir):
    plan = act.plan_actions(given.tickets(spark, sf_dir), given.actions(spark, sf_dir))
    return plan.select("id", "pos", "action_name")


EXECUTED = """
    e AS (SELECT * FROM (SELECT *, coalesce(sum(failed::INTEGER) OVER (PARTITION BY ticket_id,
      attempt ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
      FROM v_runs) WHERE earlier = 0)"""


@register(
    "w4_action_events",
    query("v_runs", "").rstrip()
    + f""",{EXECUTED}
    SELECT ticket_id, attempt, pos::INTEGER AS pos, action_name, 0 AS step,
      'processing' AS status, '' AS err_msg, '' AS output FROM e
    UNION ALL SELECT ticket_id, attempt, pos, action_name, 1,
      CASE WHEN failed THEN 'failed' ELSE 'done' END, CASE WHEN failed THEN err_msg ELSE '' END,
      CASE WHEN failed THEN '' ELSE output END FROM e""",
)
def w4_action_events(spark, sf_dir):
    return act.action_events(given.runs(spark, sf_dir)).drop("app", "ts")


@register(
    "a8_ticket_outcomes",
    query(
        "v_runs",
        """
        SELECT ticket_id, attempt, min(CASE WHEN failed THEN pos END)::INTEGER AS failed_pos,
          CASE WHEN bool_or(failed) THEN 'failed' ELSE 'done' END AS status
        FROM v_runs GROUP BY ticket_id, attempt""",
    ),
)
def a8_ticket_outcomes(spark, sf_dir):
    return act.ticket_outcomes(given.runs(spark, sf_dir))


@register(
    "x3_run_actions",
    query(
        "v_tickets v_actions",
        """
        SELECT id AS ticket_id, pos::INTEGER AS pos, action_name, failed,
          CASE WHEN failed THEN '' ELSE action_name || ' on ' || id END AS output,
          CASE WHEN failed THEN 'exit ' || (id % 10) ELSE '' END AS err_msg
        FROM (SELECT t.id, a.pos, a.action_name, a.pos = 4 AND t.id % 3 = 0 AS failed
          FROM v_tickets t JOIN v_actions a ON t.app = a.app)""",
    ),
)
def x3_run_actions(spark, sf_dir):
    """A user action that fails for some tickets at the fourth position."""

    def sample_action(ticket: dict, action: dict) -> str:
        if action["pos"] == 4 and ticket["id"] % 3 == 0:
            raise RuntimeError(f"exit {ticket['id'] % 10}")
        return f"{action['action_name']} on {ticket['id']}"

    done = act.run_actions(
        given.tickets(spark, sf_dir), given.actions(spark, sf_dir), sample_action
    )
    return done.select("ticket_id", "pos", "action_name", "failed", "output", "err_msg")


@register(
    "z5_worker_step",
    query(
        "v_tickets v_actions v_delivery",
        """
        SELECT t.id AS message_id, 1 + coalesce(d.n, 0) AS attempt,
          CASE WHEN t.app = 'app2' THEN 'mismatched' WHEN bad.app IS NOT NULL AND t.id % 3 = 0
            THEN 'failed' ELSE 'deleted' END AS kind
        FROM v_tickets t
        LEFT JOIN (SELECT message_id, count(*) AS n FROM v_delivery WHERE kind = 'received'
          GROUP BY message_id) d ON t.id = d.message_id
        LEFT JOIN (SELECT DISTINCT app FROM v_actions WHERE pos = 4) bad ON t.app = bad.app""",
    ),
)
def z5_worker_step(spark, sf_dir):
    """A message for every ticket, received by the workers of two of the three apps."""

    def sample_action(ticket: dict, action: dict) -> str:
        if action["pos"] == 4 and ticket["id"] % 3 == 0:
            raise RuntimeError("down")
        return action["action_name"]

    bodies = messages.message_bodies(messages.ticket_messages(given.tickets(spark, sf_dir)))
    received = messages.message_attributes(bodies).select(
        F.col("ticket_id").alias("message_id"), "body", "attributes"
    )
    apps = spark.createDataFrame([("app0",), ("app1",)], "app string")
    log, actions = given.delivery_log(spark, sf_dir), given.actions(spark, sf_dir)
    return work.process_messages(received, log, apps, actions, sample_action).deliveries


def fails_at_four(fails: Callable[[dict], bool]) -> Callable[[dict, dict], str]:
    """A user action that fails at the fourth position for some tickets."""

    def action(ticket: dict, step: dict) -> str:
        if step["pos"] == 4 and fails(ticket):
            raise RuntimeError("down")
        return step["action_name"]

    return action


def queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A message for every ticket, ready to be received."""
    bodies = messages.message_bodies(messages.ticket_messages(given.tickets(spark, sf_dir)))
    return messages.message_attributes(bodies).select(
        F.col("ticket_id").alias("message_id"), "body", "attributes"
    )


@register(
    "z5_worker_messages",
    query(
        "v_tickets v_actions",
        """
        SELECT t.id AS message_id, CASE WHEN t.id % 7 = 0 THEN 0 ELSE t.id % 50 END AS ticket_id,
          CASE WHEN bad.app IS NOT NULL AND t.fingerprint_hash[1] < '5' THEN 'failed'
            ELSE 'done' END AS status
        FROM v_tickets t
        LEFT JOIN (SELECT DISTINCT app FROM v_actions WHERE pos = 4) bad ON t.app = bad.app
        WHERE t.app <> 'app2'""",
    ),
)
def z5_worker_messages(spark, sf_dir):
    """Many messages that name one ticket, or none at all: each is judged by its own run."""
    number = F.when(F.col("message_id") % 7 == 0, F.lit("")).otherwise(
        F.concat(F.lit('"ticket_id":'), (F.col("message_id") % 50).cast("string"), F.lit(","))
    )
    body = F.concat(F.lit("{"), number, F.regexp_replace("body", r'^\{"ticket_id":\d+,', ""))
    received = queued(spark, sf_dir).withColumn("body", body)
    apps = spark.createDataFrame([("app0",), ("app1",)], "app string")
    log = given.delivery_log(spark, sf_dir).limit(0)
    fn = fails_at_four(lambda ticket: ticket["fingerprint_hash"][0] < "5")
    done = work.process_messages(received, log, apps, given.actions(spark, sf_dir), fn)
    return done.outcomes.select("message_id", "ticket_id", "status")


TICKS = [0, 20, 40, 60, 80, 400]


@register(
    "z5_redelivery",
    query(
        "v_tickets v_actions",
        f""",
        m AS (SELECT t.id, t.app, bad.app IS NOT NULL AS bad FROM v_tickets t
          LEFT JOIN (SELECT DISTINCT app FROM v_actions WHERE pos = 4) bad ON t.app = bad.app),
        ticks AS (SELECT n, ({TICKS})[n] AS at FROM range(1, {len(TICKS) + 1}) r(n)),
        w AS (SELECT 0::BIGINT AS n, id, app, bad, 0 AS attempts, 'published' AS kind, -60 AS ts,
            -60 AS visible FROM m
          UNION ALL SELECT t.n, id, app, bad, attempts + due::INT,
            CASE WHEN NOT due THEN kind ELSE outcome END, CASE WHEN due THEN t.at ELSE ts END,
            CASE WHEN NOT due THEN visible WHEN outcome = 'failed' THEN t.at + 30 ELSE t.at END
          FROM (SELECT w.*, t.n AS next, t.at, kind <> 'deleted' AND visible <= t.at AS due,
              CASE WHEN app = 'app2' THEN 'mismatched'
                WHEN bad AND attempts + 1 <= id % 4 THEN 'failed' ELSE 'deleted' END AS outcome
            FROM w JOIN ticks t ON t.n = w.n + 1) w JOIN ticks t ON t.n = w.next)
        SELECT id AS message_id, attempts, kind,
          TIMESTAMP '2024-01-01 00:01:00' + to_seconds(ts) AS ts
        FROM w WHERE n = {len(TICKS)}""",
    ).replace("WITH", "WITH RECURSIVE", 1),
)
def z5_redelivery(spark, sf_dir):
    """The queue worked off over six ticks: failures come back after 30 s, other apps' messages at once."""
    start = datetime(2024, 1, 1, 0, 1, tzinfo=timezone.utc)
    queue = queued(spark, sf_dir)
    log = queue.select(
        "message_id",
        F.lit("published").alias("kind"),
        moment("2024-01-01 00:00:00").alias("ts"),
        F.lit(1).cast("bigint").alias("seq"),
    )
    apps = spark.createDataFrame([("app0",), ("app1",)], "app string")
    fn = fails_at_four(lambda ticket: ticket["attempt"] <= ticket["id"] % 4)
    ticks = [start + timedelta(seconds=s) for s in TICKS]
    log, _ = work.work_queue(queue, log, apps, given.actions(spark, sf_dir), fn, ticks)
    received = F.count_if(F.col("kind") == "received").cast("int").alias("attempts")
    last = log.groupBy("message_id").agg(received, *delivery.latest())
    return last.select("message_id", "attempts", delivery.kind_of().alias("kind"), "ts")


@register(
    "x1_user_classifier",
    query(
        "v_occ",
        """
        SELECT arrival_seq, 'len_' || length(line) AS classification, app AS component
        FROM v_occ WHERE arrival_seq % 10 <> 0""",
    ),
)
def x1_user_classifier(spark, sf_dir):
    """A user classifier that fails for some lines; those become rejects."""

    def classifier(app, line):
        bad = F.col("arrival_seq") % 10 == 0
        return F.struct(
            F.concat(F.lit("len_"), F.length(line).cast("string")).alias("classification"),
            F.lit("low").alias("severity"),
            app.alias("component"),
            F.lit("user").alias("fingerprint"),
            F.when(bad, "unavailable").alias("error"),
        )

    ok, _ = classify.split_rejects(classify.classify_with(given.logs(spark, sf_dir), classifier))
    return ok.select("arrival_seq", "classification", "component")


STATE = """
    SELECT message_id, kind, ts, ts + to_seconds(CASE kind WHEN 'received' THEN 300
      WHEN 'failed' THEN 30 WHEN 'deleted' THEN NULL ELSE 0 END) AS visible_at
    FROM (SELECT message_id, arg_max(kind, seq) AS kind, arg_max(ts, seq) AS ts FROM v_delivery
      {where} GROUP BY message_id)"""


@register("z6_delivery_state", query("v_delivery", STATE.format(where="")))
def z6_delivery_state(spark, sf_dir):
    return delivery.delivery_state(given.delivery_log(spark, sf_dir))


@register(
    "a4_queue_depth",
    query(
        "v_delivery",
        f"""
        SELECT count(*) FILTER (visible_at <= TIMESTAMP '1999-06-15 00:10:00') AS visible,
          count(*) FILTER (visible_at > TIMESTAMP '1999-06-15 00:10:00') AS in_flight
        FROM ({STATE.format(where="WHERE ts <= TIMESTAMP '1999-06-15 00:10:00'")})
        WHERE kind <> 'deleted'""",
    ),
)
def a4_queue_depth(spark, sf_dir):
    return delivery.queue_depth(given.delivery_log(spark, sf_dir), moment(DEPTH_AS_OF))


@register(
    "a4_depth_series",
    query(
        "v_delivery",
        """,
        spans AS (SELECT kind, ts, ts + to_seconds(CASE kind WHEN 'received' THEN 300
            WHEN 'failed' THEN 30 ELSE 0 END) AS shown, min(ts) OVER (PARTITION BY message_id
            ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later
          FROM v_delivery),
        ticks AS (SELECT unnest(generate_series(TIMESTAMP '1995-06-14 23:00:00',
          TIMESTAMP '1995-06-15 01:00:00', INTERVAL 10 SECOND)) AS as_of)
        SELECT as_of, count(*) FILTER (shown <= as_of) AS visible,
          count(*) FILTER (shown > as_of) AS in_flight
        FROM ticks LEFT JOIN spans ON ts <= as_of AND (later IS NULL OR later > as_of)
          AND kind <> 'deleted' GROUP BY as_of""",
    ),
)
def a4_depth_series(spark, sf_dir):
    """The depth every ten seconds."""
    start = datetime(1995, 6, 14, 23, tzinfo=timezone.utc)
    log = given.delivery_log(spark, sf_dir)
    return delivery.depth_series(log, start, start + timedelta(hours=2))


# ---- views ---------------------------------------------------------------------------------

ACTIVE_SQL = """
    SELECT * FROM {source} WHERE status IN ('open', 'in_progress', 'pending', 'failed')
    ORDER BY last_seen DESC, id LIMIT 200"""


@register("t1_active_tickets", query("v_tickets", ACTIVE_SQL.format(source="v_tickets")))
def t1_active_tickets(spark, sf_dir):
    return views.active_tickets(given.tickets(spark, sf_dir))


@register(
    "t1_active_from_logs",
    query("v_occ", ACTIVE_SQL.format(source=f"({oracle.fold('v_occ')})")),
)
def t1_active_from_logs(spark, sf_dir):
    """The flagship: log lines to tickets to the list of active ones."""
    return views.active_tickets(tickets.upsert_tickets(given.occurrences(spark, sf_dir)))


@register(
    "t2_recent_logs",
    query(
        "v_logs",
        "SELECT arrival_seq, app, raw_line FROM v_logs ORDER BY arrival_seq DESC LIMIT 200",
    ),
)
def t2_recent_logs(spark, sf_dir):
    return views.recent_logs(given.logs(spark, sf_dir)).select("arrival_seq", "app", "raw_line")


@register(
    "t3_recent_tickets",
    query("v_tickets", "SELECT * FROM v_tickets WHERE id <> 0 ORDER BY id DESC LIMIT 200"),
)
def t3_recent_tickets(spark, sf_dir):
    return views.recent_tickets(given.tickets(spark, sf_dir))


@register(
    "t3_listed_tickets",
    """
    WITH updates AS (SELECT user_id * 20 + CAST(props->>'k' AS BIGINT) % 20 AS id, event_id AS seq FROM events),
    walked AS (SELECT list_reduce(list([{'id': id, 'seq': seq}] ORDER BY seq), lambda listed, x:
        CASE WHEN list_contains(list_transform(listed, lambda y: y['id']), x[1]['id']) THEN listed
        ELSE (x || listed)[1:200] END) AS listed FROM updates WHERE id <> 0)
    SELECT row['id'] AS ticket_id, row['seq'] AS seq FROM (SELECT unnest(listed) AS row FROM walked)""",
)
def t3_listed_tickets(spark, sf_dir):
    """The list that updates in order of arrival leave, with tickets that come back after they fell out."""
    kind = F.get_json_object("props", "$.k").cast("bigint") % 20
    updates = given.table(spark, sf_dir, "events").select(
        (F.col("user_id") * 20 + kind).alias("ticket_id"), F.col("event_id").alias("seq")
    )
    return recent.listed_tickets(updates)


def ordered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worker events with a sequence over all tickets."""
    overall = F.col("seq") * 1000 + F.col("ticket_id")
    return given.worker_events(spark, sf_dir).withColumn("seq", overall)


@register(
    "t4_recent_events",
    query(
        "v_events",
        """
        SELECT seq * 1000 + ticket_id AS seq, action_name, status FROM v_events
        ORDER BY seq * 1000 + ticket_id DESC LIMIT 200""",
    ),
)
def t4_recent_events(spark, sf_dir):
    recent = views.recent_events(ordered_events(spark, sf_dir))
    return recent.select("seq", "action_name", "status")


@register(
    "t5_recent_records",
    query("v_records", "SELECT seq, level, message FROM v_records ORDER BY seq DESC LIMIT 500"),
)
def t5_recent_records(spark, sf_dir):
    return views.recent_records(record_rows(spark, sf_dir)).select("seq", "level", "message")


STATS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in schemas.TICKET_STATUSES)


@register(
    "a2_ticket_stats", query("v_tickets", f"SELECT {STATS}, count(*) AS total FROM v_tickets")
)
def a2_ticket_stats(spark, sf_dir):
    return views.ticket_stats(given.tickets(spark, sf_dir))


@register(
    "a2_recent_ticket_stats",
    query(
        "v_tickets",
        f"""
        SELECT {STATS}, count(*) AS total
        FROM (SELECT * FROM v_tickets WHERE id <> 0 ORDER BY id DESC LIMIT 200)""",
    ),
)
def a2_recent_ticket_stats(spark, sf_dir):
    """The statistics of the newest tickets only, as a screen shows them."""
    return views.ticket_stats(views.recent_tickets(given.tickets(spark, sf_dir)))


@register(
    "a3_latest_app_status",
    query(
        "v_statuses",
        """
        SELECT app, arg_max(status, arrival_seq) AS status,
          arg_max(error_msg, arrival_seq) AS error_msg FROM v_statuses GROUP BY app""",
    ),
)
def a3_latest_app_status(spark, sf_dir):
    return views.latest_app_status(pipeline.poll_status(given.polls(spark, sf_dir)))


@register(
    "j9_app_overview",
    query(
        "v_statuses",
        """
        SELECT n_nationkey AS ord, 'app' || n_nationkey AS app,
          coalesce(s.status, 'idle') AS status, coalesce(s.error_msg, '') AS error_msg
        FROM nation LEFT JOIN (SELECT app, arg_max(status, arrival_seq) AS status,
          arg_max(error_msg, arrival_seq) AS error_msg FROM v_statuses GROUP BY app) s
          ON s.app = 'app' || n_nationkey""",
    ),
)
def j9_app_overview(spark, sf_dir):
    statuses = pipeline.poll_status(given.polls(spark, sf_dir))
    return views.app_overview(given.configured_apps(spark, sf_dir), statuses)


@register(
    "a5_search_counts",
    query(
        "v_records",
        f"""
        SELECT count(*) FILTER ({oracle._matches('la')} AND level = 'ERROR') AS matches,
          count(*) AS total FROM v_records""",
    ),
)
def a5_search_counts(spark, sf_dir):
    return views.search_counts(record_rows(spark, sf_dir), "ERROR", "la")


@register(
    "a6_last_output",
    query(
        "v_events",
        """
        SELECT ticket_id, arg_max(output, seq) AS last_output FROM v_events
        WHERE status = 'done' AND output <> '' GROUP BY ticket_id""",
    ),
)
def a6_last_output(spark, sf_dir):
    return views.last_output(given.worker_events(spark, sf_dir))


@register(
    "w1_recent_per_ticket",
    query(
        "v_events",
        """
        SELECT ticket_id, seq, status, action_name FROM (SELECT *, row_number() OVER
          (PARTITION BY ticket_id ORDER BY seq DESC) AS rn FROM v_events) WHERE rn <= 20""",
    ),
)
def w1_recent_per_ticket(spark, sf_dir):
    recent = views.recent_events_per_ticket(given.worker_events(spark, sf_dir))
    return recent.select("ticket_id", "seq", "status", "action_name")


@register(
    "j5_ticket_detail",
    query("v_tickets v_events", "").rstrip()
    + f""",{oracle.DETAIL}
    SELECT t.id, t.status, e.events, e.last_output FROM v_tickets t LEFT JOIN e ON t.id = e.id""",
)
def j5_ticket_detail(spark, sf_dir):
    detail = views.ticket_detail(given.tickets(spark, sf_dir), given.worker_events(spark, sf_dir))
    shown = F.transform(
        "events",
        lambda e: F.concat(
            e["seq"].cast("string"), F.lit(":"), e["status"], F.lit(":"), e["action_name"]
        ),
    )
    return detail.select("id", "status", F.array_join(shown, ",").alias("events"), "last_output")


@register(
    "j11_status_from_events",
    query(
        "v_events",
        """
        SELECT ticket_id, CASE arg_max(status, seq) WHEN 'processing' THEN 'in_progress'
          ELSE arg_max(status, seq) END AS status
        FROM v_events WHERE ticket_id > 0 GROUP BY ticket_id""",
    ),
)
def j11_status_from_events(spark, sf_dir):
    return tickets.status_from_events(given.worker_events(spark, sf_dir))


# ---- streaming -----------------------------------------------------------------------------


@register("z2_dedupe_overlap", query("v_logs", "SELECT arrival_seq, app, ts FROM v_logs"))
def z2_dedupe_overlap(spark, sf_dir):
    """Lines that two overlapping polls deliver as a stream, each counted once."""
    root = scratch(spark, "overlap")
    entries = given.logs(spark, sf_dir)
    for poll in ("first", "second"):
        entries.write.parquet(f"{root}/in/{poll}")
    stream = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1000)
    stream = logs.dedupe_overlap(stream.parquet(f"{root}/in/*"), ["app", "arrival_seq"], "1 hour")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    run_stream(spark, stream, keep, "overlap")
    return spark.read.parquet(f"{root}/out").select("arrival_seq", "app", "ts")


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.readStream.schema(given.TABLES[name]).parquet(
        f"{sf_dir.rstrip('/')}/{name}.parque[t]"  # a pattern may name a file, a path may not
    )


def streamed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given.logs_from(streamed(spark, sf_dir, "events"))


def streamed_doc_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given.doc_logs_from(streamed(spark, sf_dir, "documents"))


def run_stream(spark: SparkSession, stream: DataFrame, step, label: str) -> None:
    checkpoint = scratch(spark, f"{label}-checkpoint")
    pipeline.start_ingest(stream, step, checkpoint, available_now=True).awaitTermination()


@register("z3_stream_tickets", A1_SQL)
def z3_stream_tickets(spark, sf_dir):
    """The same tickets from a stream of log entries."""
    table = stored.TicketTable(spark, scratch(spark, "stream-tickets"))
    run_stream(spark, streamed_logs(spark, sf_dir), pipeline.fold_batch(table, "events"), "tickets")
    return table.read()


def landing(spark: SparkSession, rows: DataFrame, path: str, parts: list[Column]) -> DataFrame:
    """Rows in files that arrive one after the other, as a stream of a batch each."""
    for number, part in enumerate(parts):
        rows.filter(part).coalesce(1).write.parquet(f"{path}/{number:03d}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1)
    return stream.parquet(f"{path}/*")


def days_of(spark: SparkSession, sf_dir: str, per_part: int) -> list[Column]:
    """Conditions that cut a month of events into parts of some days."""
    day = F.dayofmonth("ts")
    last = 31 // per_part
    number = F.least(F.floor(day / per_part), F.lit(last))
    return [number == k for k in range(last + 1)]


@register("z3_state_store", A1_SQL)
def z3_state_store(spark, sf_dir):
    """The same tickets from Spark's state store, over several batches and a restart."""
    root = scratch(spark, "states")
    entries = given.logs(spark, sf_dir)
    parts = days_of(spark, sf_dir, 8)
    for run, some in enumerate((parts[:2], parts[2:])):
        landing(spark, entries, f"{root}/in/{run}", some)
        stream = spark.readStream.schema(entries.schema).option("maxFilesPerTrigger", 1)
        state.stream_states(
            stream.parquet(f"{root}/in/*/*"), f"{root}/out", f"{root}/checkpoint", available_now=True
        ).awaitTermination()
    return state.read_states(spark, f"{root}/out")


@register(
    "z3_two_streams",
    f"""
    WITH e AS ({query("v_occ", f"SELECT {oracle.KEY} FROM v_occ")}),
      d AS ({query("v_doclogs", f"""
        SELECT {oracle.hashed('app', 'message')} AS fingerprint_hash, app,
          {oracle.day('ts')} AS created_date FROM v_doclogs""")})
    SELECT app, created_date, count(DISTINCT fingerprint_hash) AS tickets, count(*) AS lines
    FROM (SELECT app, created_date, fingerprint_hash FROM e
      UNION ALL SELECT app, created_date, fingerprint_hash FROM d) GROUP BY ALL""",
)
def z3_two_streams(spark, sf_dir):
    """Two streams with writers of their own, both from batch 0, into one table."""
    table = stored.TicketTable(spark, scratch(spark, "two-streams"))
    run_stream(spark, streamed_logs(spark, sf_dir), pipeline.fold_batch(table, "events"), "events")
    texts = streamed_doc_logs(spark, sf_dir)
    run_stream(spark, texts, pipeline.fold_batch(table, "documents", hash_on="message"), "documents")
    return (
        table.read()
        .groupBy("app", "created_date")
        .agg(F.count("*").alias("tickets"), F.sum("occurrence_count").alias("lines"))
    )


@register(
    "z4_publish_new",
    query(
        "v_occ",
        f"""
        SELECT id, status, 'mock-msg-' || epoch_ms(max(last_seen) OVER ()) || '-' || id
          AS message_id FROM ({oracle.fold("v_occ")})""",
    ),
)
def z4_publish_new(spark, sf_dir):
    """Tickets from a stream, their messages published and the message ids stored."""
    root = scratch(spark, "publish")
    table = stored.TicketTable(spark, f"{root}/tickets")
    step = pipeline.fold_and_publish(table, "events", f"{root}/messages")
    run_stream(spark, streamed_logs(spark, sf_dir), step, "publish")
    return table.read().select("id", "status", "message_id")


@register(
    "z5_stream_status",
    query(
        "v_occ v_events v_actions",
        f"""
        SELECT f.id, CASE WHEN e.id IS NULL THEN f.status WHEN e.failed THEN 'failed'
          WHEN e.done >= coalesce(p.planned, 0) THEN 'done' ELSE 'in_progress' END AS status
        FROM ({oracle.fold("v_occ")}) f
        LEFT JOIN (SELECT ticket_id AS id, bool_or(status = 'failed') AS failed,
            count(DISTINCT pos) FILTER (WHERE status = 'done') AS done
          FROM (SELECT *, max(attempt) OVER (PARTITION BY ticket_id) AS latest FROM v_events)
          WHERE attempt = latest GROUP BY ticket_id) e ON f.id = e.id
        LEFT JOIN (SELECT app, count(DISTINCT pos) AS planned FROM v_actions GROUP BY app) p
          ON f.app = p.app""",
    ),
)
def z5_stream_status(spark, sf_dir):
    """Ticket states after worker events in several batches, cut between a ticket's actions."""
    root = scratch(spark, "status")
    table = stored.TicketTable(spark, f"{root}/tickets")
    table.upsert(given.occurrences(spark, sf_dir), 0, "events")
    events = given.worker_events(spark, sf_dir).select("ticket_id", "attempt", "pos", "status")
    actions = given.actions(spark, sf_dir)
    for part in range(3):
        cut = events.filter(F.col("pos") % 3 == part)
        cut.write.parquet(f"{root}/events/part={part}")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/events/part={part}")
        step = pipeline.status_batch(table, actions, f"worker{part}")
        run_stream(spark, stream, step, f"status{part}")
    return table.read().select("id", "status")


@register(
    "z7_poll_status",
    query("v_statuses", "SELECT app, status, error_msg, last_poll, arrival_seq FROM v_statuses"),
)
def z7_poll_status(spark, sf_dir):
    return pipeline.poll_status(given.polls(spark, sf_dir))


@register(
    "z7_polled_stream",
    query(
        "v_logs",
        """,
        p AS (SELECT arrival_seq % 6 AS poll, arrival_seq % 6 IN (1, 4) AS failed, count(*) AS n
          FROM v_logs GROUP BY ALL)
        SELECT poll, 'polling' AS status, '' AS error_msg, poll * 2 AS arrival_seq, 0 AS lines FROM p
        UNION ALL SELECT poll, CASE WHEN failed THEN 'error' ELSE 'idle' END,
          CASE WHEN failed THEN 'fetch error: no answer to poll ' || poll ELSE '' END,
          poll * 2 + 1, CASE WHEN failed THEN 0 ELSE n END FROM p""",
    ),
)
def z7_polled_stream(spark, sf_dir):
    """Six polls of a source that does not answer two of them: their status, and the lines processed."""
    root = scratch(spark, "polls")
    entries = given.logs(spark, sf_dir)
    clock = landing(spark, entries, f"{root}/in", [F.col("arrival_seq") % 6 == k for k in range(6)])

    def answer(batch: DataFrame) -> DataFrame:
        silent = F.raise_error(F.concat(F.lit("no answer to poll "), (F.col("arrival_seq") % 6).cast("string")))
        number = batch.select(F.col("arrival_seq") % 6).first()[0]
        if number == 1:
            raise RuntimeError("no answer to poll 1")
        return batch.withColumn("app", F.when(F.col("arrival_seq") % 6 == 4, silent).otherwise(F.col("app")))

    def count(batch: DataFrame, batch_id: int) -> None:
        lines = batch.agg(F.count("*").alias("lines"))
        lines.write.mode("overwrite").parquet(f"{root}/lines/poll={batch_id}")

    step = polls.poll_step(spark, polls.Source("app", answer), count, f"{root}/status")
    run_stream(spark, clock, step, "polled")
    told = polls.read_poll_status(spark, f"{root}/status")
    lines = spark.read.schema("lines bigint, poll bigint").parquet(f"{root}/lines")
    text = F.regexp_extract("error_msg", "^fetch error: .*?no answer to poll [0-9]+", 0)
    short = F.regexp_replace(text, "^fetch error: .*no answer", "fetch error: no answer")
    done = F.when(F.col("status") == "idle", F.col("lines")).otherwise(0).cast("bigint")
    return told.join(lines, "poll", "left").select(
        "poll", "status", short.alias("error_msg"), "arrival_seq", F.coalesce(done, F.lit(0)).alias("lines")
    )


@register(
    "z9_late_rows",
    query(
        "v_logs",
        f""",
        parts AS (SELECT *, (arrival_seq * 7) % 5 AS part FROM v_logs),
        marks AS (SELECT part, max(ts) AS newest FROM parts GROUP BY part),
        judged AS (SELECT p.*, coalesce(ts < (SELECT max(newest) FROM marks m WHERE m.part < p.part)
          - INTERVAL 7 DAY, false) AS late FROM parts p)
        SELECT late, part AS batch, {oracle.day("ts")} AS day, count(*) AS n FROM judged GROUP BY ALL""",
    ),
)
def z9_late_rows(spark, sf_dir):
    """Shuffled lines in five batches: those a week behind the newest one are kept apart, by their day."""
    root = scratch(spark, "late")
    entries = given.logs(spark, sf_dir)
    part = (F.col("arrival_seq") * 7) % 5
    stream = landing(spark, entries, f"{root}/in", [part == k for k in range(5)])

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    step = state.late_rows(spark, f"{root}/aside", keep, 7 * 86400)
    run_stream(spark, stream, step, "late")
    kept = spark.read.parquet(f"{root}/out").withColumn("late", F.lit(False))
    late = state.read_late(spark, f"{root}/aside").withColumn("late", F.lit(True))
    by_day = kept.unionByName(late).groupBy(
        "late", F.col("batch").cast("bigint").alias("batch"), text.day_key(F.col("ts")).alias("day")
    )
    return by_day.agg(F.count("*").alias("n"))


@register(
    "z8_day_basis",
    query(
        "v_logs",
        f"""
        SELECT 'arrival' AS basis, {oracle.day("ts + INTERVAL 36 HOUR")} AS day, count(*) AS n
        FROM v_logs GROUP BY 2
        UNION ALL SELECT 'event', {oracle.day("ts")}, count(*) FROM v_logs GROUP BY 2""",
    ),
)
def z8_day_basis(spark, sf_dir):
    """Late lines under the day they arrive, or under their own."""
    late = given.plus_seconds(F.col("ts"), F.lit(36 * 3600))
    entries = given.logs(spark, sf_dir).withColumn("arrival_ts", late)
    counts = [
        classify.occurrences_of(entries, day_basis=basis)
        .groupBy(F.lit(basis).alias("basis"), F.col("created_date").alias("day"))
        .agg(F.count("*").alias("n"))
        for basis in ("arrival", "event")
    ]
    return counts[0].union(counts[1])
