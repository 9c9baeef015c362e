"""Triage inputs derived from the driver's tables, as DataFrames.

The tables hold no logs, so every view is a deterministic projection of one of them; the same
projections are written in SQL in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultfold.functions.text import raw_line
from faultfold.operators.classify import occurrences_of
from faultfold.plans.rules import DEFAULT_RULES
from faultfold.sources.messages import message_attributes, message_bodies, ticket_messages

# Log lines with their severities. Each meets one of the default rules; the last three an earlier
# one than their own.
TEMPLATES = [
    ("ERROR", "mysql replica on node 4 refused the login of the billing job"),
    ("ERROR", "NullPointerException while the cart was summed\n\tat shop.Cart.total(Cart.java:18)"),
    ("ERROR", "cgroup limit hit, the kernel says out of memory for pid 512"),
    ("ERROR", "gateway answered 503 for /basket, giving up"),
    ("ERROR", "panic: assignment to entry in nil map\n\ngoroutine 12 [running]:\nmain.main()"),
    ("ERROR", "redis key inventory:7 is still held by another worker"),
    ("ERROR", "certificate of cache.example ends in 2 days, peer turned it down"),
    ("ERROR", "disk /dev/sda1 is full, the export was not saved"),
    ("ERROR", "kafka partition 11 has had no leader for 40 s"),
    ("ERROR", "authentication of user sam by token was turned down"),
    ("WARN", "slow query on report_daily took 2310 ms"),
    ("ERROR", "circuit breaker for pricing went half way back"),
    ("ERROR", "S3 GetObject for nightly/report.parquet hit its timeout"),
    ("ERROR", "grpc stream to search dropped: connection reset by peer"),
    ("ERROR", "pending jobs reached 1500, the newest are turned away"),
]

# Line prefixes for text input: none, each case of known ones, a comment, an unknown word.
LINE_PREFIXES = ["", "ERROR ", "warn ", "WARNING ", "# ", "FATAL ", "  Info ", "debug"]

TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey bigint",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp"
    ),
    "events": (
        "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, "
        "props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table with a declared schema: no inference, times as UTC instants."""
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(values: list, index: Column) -> Column:
    """Element ``index`` (from 0) of a fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(secs=seconds)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_from(table(spark, sf_dir, "events"))


def logs_from(events: DataFrame, *extra: str) -> DataFrame:
    """Events as log entries; every second one has a dedupe key. ``extra`` columns stay."""
    number = F.col("event_id") % len(TEMPLATES)
    return (
        events.withColumn("app", F.concat(F.lit("app"), (F.col("user_id") % 3).cast("string")))
        .withColumn("severity", pick([t[0] for t in TEMPLATES], number))
        .withColumn("message", pick([t[1] for t in TEMPLATES], number))
        .withColumn("raw_line", raw_line(F.col("ts"), F.col("severity"), F.col("message")))
        .withColumn(
            "dedupe_key", F.when(F.col("event_id") % 2 == 0, F.col("message")).otherwise("")
        )
        .select(
            "app",
            "ts",
            "severity",
            "message",
            "raw_line",
            "dedupe_key",
            F.col("ts").alias("arrival_ts"),
            F.col("event_id").alias("arrival_seq"),
            *extra,
        )
    )


def doc_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as log lines of the app named by their source."""
    return doc_logs_from(table(spark, sf_dir, "documents"))


def doc_logs_from(documents: DataFrame) -> DataFrame:
    ts = plus_seconds(F.lit("2024-01-01").cast("timestamp"), F.col("doc_id"))
    return documents.select(
        F.col("source").alias("app"),
        ts.alias("ts"),
        F.lit("ERROR").alias("severity"),
        F.col("text").alias("message"),
        F.col("text").alias("raw_line"),
        F.col("text").alias("dedupe_key"),
        ts.alias("arrival_ts"),
        F.col("doc_id").alias("arrival_seq"),
    )


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents, with prefixes that vary by document."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda line: F.concat(pick(LINE_PREFIXES, F.col("doc_id") % len(LINE_PREFIXES)), line),
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("app"), F.explode(lines).alias("value")
    )


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tickets, with mixed severity vocabularies."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    status = (
        F.when(key % 11 == 0, "failed")
        .when(key % 13 == 0, "pending")
        .when(F.col("o_orderstatus") == "F", "done")
        .when(F.col("o_orderstatus") == "O", "open")
        .otherwise("in_progress")
    )
    severity = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "critical")
        .when(F.col("o_orderpriority") == "2-HIGH", "HIGH")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "WARN")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "info")
        .otherwise("low")
    )
    number = key % len(DEFAULT_RULES)
    app = F.concat(F.lit("app"), (F.col("o_custkey") % 3).cast("string"))
    last_seen = plus_seconds(F.col("o_orderdate"), (F.col("o_custkey") % 100) * 3600)
    return orders.select(
        key.alias("id"),
        app.alias("app"),
        F.sha2(F.concat(app, F.lit("|"), key.cast("string")), 256).alias("fingerprint_hash"),
        pick([r.fingerprint for r in DEFAULT_RULES], number).alias("fingerprint_text"),
        pick([r.classification for r in DEFAULT_RULES], number).alias("classification"),
        severity.alias("severity"),
        pick([r.component for r in DEFAULT_RULES], number).alias("component"),
        pick([t[1] for t in TEMPLATES], number).alias("raw_log"),
        F.col("o_orderdate").alias("first_seen"),
        last_seen.alias("last_seen"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_date"),
        (key % 7 + 1).alias("occurrence_count"),
        status.alias("status"),
        F.lit("").alias("message_id"),
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines numbered within their order (an order has few lines)."""
    order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"
    )
    return table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(order))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as action runs; an order is one delivery of ticket ``l_orderkey % 1000``."""
    return positions(spark, sf_dir).select(
        (F.col("l_orderkey") % 1000).alias("ticket_id"),
        F.expr("l_orderkey div 1000").alias("attempt"),
        "pos",
        F.concat(F.lit("app"), (F.col("l_orderkey") % 3).cast("string")).alias("app"),
        F.concat(F.lit("action"), F.col("pos").cast("string")).alias("action_name"),
        (F.col("l_returnflag") == "R").alias("failed"),
        F.when(F.col("l_partkey") % 4 == 0, "")
        .otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string")))
        .alias("output"),
        F.concat(F.lit("exit "), F.col("l_linenumber").cast("string")).alias("err_msg"),
        F.col("l_shipdate").alias("ts"),
    )


def worker_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action runs as finished worker events, ordered by delivery and position."""
    rows = runs(spark, sf_dir)
    return rows.select(
        "ticket_id",
        "app",
        "action_name",
        F.when(F.col("failed"), "failed")
        .when(F.col("pos") % 5 == 0, "processing")
        .otherwise("done")
        .alias("status"),
        "err_msg",
        "output",
        "ts",
        (F.col("attempt") * 1000 + F.col("pos")).cast("bigint").alias("seq"),
        "attempt",
        "pos",
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies in eight shapes."""
    eid = F.col("event_id").cast("string")
    full = F.concat(
        F.lit('{"classification": "type_'),
        eid,
        F.lit('", "severity": "high", "component": "'),
        F.col("event_type"),
        F.lit('", "fingerprint": "print '),
        eid,
        F.lit('"}'),
    )
    shapes = F.array(
        full,
        F.concat(F.lit("The model says: "), full),
        F.concat(full, F.lit("\nLet me know.")),
        F.lit("{}"),
        F.concat(F.lit('{"classification": "type_'), eid, F.lit('", "severity": ""}')),
        F.lit('{"classification": "half", "severity": }'),
        F.lit("plain words only"),
        F.concat(
            F.lit('{"classification": "nested", "extra": {"a": 1}, "component": "'),
            F.col("event_type"),
            F.lit('"} and a brace }'),
        ),
    )
    reply = F.element_at(shapes, (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", reply.alias("reply"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured entries in six shapes."""
    eid = F.col("event_id").cast("string")
    case = F.col("event_id") % 6
    json = (
        F.when(case == 1, F.concat(F.lit('{"message": "text '), eid, F.lit('", "msg": "x"}')))
        .when(case == 2, F.concat(F.lit('{"log": 5, "msg": "text '), eid, F.lit('"}')))
        .when(case == 3, F.col("props"))
    )
    return table(spark, sf_dir, "events").select(
        "ts",
        F.upper("event_type").alias("severity"),
        F.when(case == 0, F.concat(F.lit("text "), eid)).otherwise("").alias("text_payload"),
        json.alias("json_payload"),
        F.when(case == 4, F.lit("type.example/audit")).alias("proto_type"),
        F.col("event_id").alias("arrival_seq"),
        F.col("ts").alias("arrival_ts"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as internal log records with ordered attributes."""

    def attr(key: Column, value: Column) -> Column:
        return F.struct(key.alias("key"), value.alias("value"))

    key = pick(["worker", "app", "source"], F.col("conv_id") % 3)
    conv = F.col("conv_id").cast("string")
    return table(spark, sf_dir, "conversations").select(
        pick(["DEBUG", "INFO", "WARN", "ERROR"], F.col("turn") % 4).alias("level"),
        plus_seconds(F.lit("2024-01-01").cast("timestamp"), F.col("turn") * 60).alias("time"),
        F.col("text").alias("message"),
        F.array(attr(F.lit("conv"), conv)).alias("prelude"),
        F.array(attr(key, F.col("role")), attr(F.lit("app"), F.lit("late"))).alias("attrs"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue messages of the tickets; some bodies are cut short, some attributes missing."""
    rows = message_attributes(message_bodies(ticket_messages(tickets(spark, sf_dir))))
    key = F.col("ticket_id")
    body = F.expr("substr(body, 1, length(body) - 1)")
    named = F.map_filter("attributes", lambda k, _: k != "AppName")
    return rows.select(
        F.col("ticket_id").alias("id"),
        F.when(key % 17 == 0, body).otherwise(F.col("body")).alias("body"),
        F.when(key % 19 == 0, named).otherwise(F.col("attributes")).alias("attributes"),
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as configured actions of the three apps."""
    key = F.col("r_regionkey")
    agent = key % 2 == 0
    return table(spark, sf_dir, "region").select(
        F.concat(F.lit("app"), (key % 3).cast("string")).alias("app"),
        (key + 1).cast("int").alias("pos"),
        F.when(agent, "cli_agent").otherwise("webhook").alias("type"),
        F.when(key == 4, F.lower("r_name")).otherwise("").alias("name"),
        F.concat(F.lit("http://hooks.example/"), key.cast("string")).alias("url"),
        F.concat(F.lit("fix-"), F.lower("r_name")).alias("command"),
        F.when(
            key == 2, "fix {{.Classification}} in {{ .Component }}: {{.RawLog}} ({{.TicketID}})"
        )
        .otherwise("")
        .alias("prompt_template"),
    )


def configured_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as configured applications."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("int").alias("ord"),
        F.concat(F.lit("app"), F.col("n_nationkey").cast("string")).alias("name"),
    )


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as polls of thirty applications, some more than are configured."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("app"), (F.col("user_id") % 30).cast("string")).alias("app"),
        F.col("ts").alias("poll_ts"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("timeout "), F.col("props"))).alias(
            "fetch_error"
        ),
    )


def delivery_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as the delivery history of one message per order."""
    kind = (
        F.when(F.col("pos") == 1, "published")
        .when(F.col("l_returnflag") == "R", "failed")
        .when(F.col("l_quantity") < 10, "mismatched")
        .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "deleted")
        .otherwise("received")
    )
    return positions(spark, sf_dir).select(
        F.col("l_orderkey").alias("message_id"),
        kind.alias("kind"),
        plus_seconds(F.col("l_shipdate"), F.col("l_partkey") % 900).alias("ts"),
        F.col("pos").cast("bigint").alias("seq"),
    )


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries with their ticket key; labels follow once they are folded."""
    return occurrences_of(logs(spark, sf_dir))


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status changes of tickets, each right after one of their occurrences."""
    by_type = {"purchase": "done", "signup": "in_progress", "error": "failed"}
    status = F.lit(None).cast("string")
    for kind, value in by_type.items():
        status = F.when(F.col("event_type") == kind, value).otherwise(status)
    events = table(spark, sf_dir, "events").withColumn("status", status)
    return occurrences_of(logs_from(events.filter("status is not null"), "status")).select(
        "fingerprint_hash",
        "app",
        "created_date",
        (F.col("arrival_seq") + 1).alias("arrival_seq"),
        "status",
    )
