"""Triage views over tickets, events, logs and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultfold import schemas
from faultfold.functions.records import record_matches
from faultfold.functions.text import normalize_severity

# How many rows each view keeps.
ACTIVE_LIMIT = 200
LOG_LIMIT = 200
TICKET_LIMIT = 200
EVENT_LIMIT = 200
RECORD_LIMIT = 500
TICKET_EVENT_LIMIT = 20


def active_tickets(tickets: DataFrame, n: int = ACTIVE_LIMIT) -> DataFrame:
    """Tickets that are not done, last seen first. A top-k: each task keeps ``n`` rows."""
    active = tickets.filter(F.col("status").isin(*schemas.ACTIVE_STATUSES))
    return active.orderBy(F.desc("last_seen"), F.asc("id")).limit(n)


def recent_logs(logs: DataFrame, n: int = LOG_LIMIT) -> DataFrame:
    return logs.orderBy(F.desc("arrival_seq")).limit(n)


def recent_tickets(tickets: DataFrame, n: int = TICKET_LIMIT) -> DataFrame:
    """Newest tickets by first appearance; id 0 is no ticket."""
    return tickets.filter("id <> 0").orderBy(F.desc("id")).limit(n)


def recent_events(events: DataFrame, n: int = EVENT_LIMIT) -> DataFrame:
    return events.orderBy(F.desc("seq")).limit(n)


def recent_records(records: DataFrame, n: int = RECORD_LIMIT) -> DataFrame:
    return records.orderBy(F.desc("seq")).limit(n)


def filter_tickets(
    tickets: DataFrame,
    status: str | None = None,
    app: str | None = None,
    severity: str | None = None,
) -> DataFrame:
    """Optional status, app and normalised severity, all of which must hold."""
    if status:
        tickets = tickets.filter(F.col("status") == status)
    if app:
        tickets = tickets.filter(F.col("app") == app)
    if severity:
        tickets = tickets.filter(normalize_severity(F.col("severity")) == severity)
    return tickets


def filter_app(df: DataFrame, app: str | None = None) -> DataFrame:
    return df.filter(F.col("app") == app) if app else df


def pending_tickets(tickets: DataFrame) -> DataFrame:
    """Tickets whose message could not be published."""
    return filter_tickets(tickets, status="pending")


def search_records(
    records: DataFrame, level: str | None = None, text: str | None = None
) -> DataFrame:
    return records.filter(record_matches(level, text))


def search_counts(
    records: DataFrame, level: str | None = None, text: str | None = None
) -> DataFrame:
    return records.agg(
        F.count_if(record_matches(level, text)).alias("matches"), F.count("*").alias("total")
    )


def ticket_stats(tickets: DataFrame) -> DataFrame:
    """Number of tickets per status and in all, in one pass."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in schemas.TICKET_STATUSES]
    return tickets.agg(*counts, F.count("*").alias("total"))


def latest_app_status(statuses: DataFrame) -> DataFrame:
    """Last reported status of each app."""
    latest = F.max_by(F.struct("status", "error_msg"), "arrival_seq").alias("latest")
    return statuses.groupBy("app").agg(latest).select("app", "latest.*")


def app_overview(apps: DataFrame, statuses: DataFrame) -> DataFrame:
    """Every configured app in order with its status, idle if none was reported."""
    latest = latest_app_status(statuses).withColumnRenamed("app", "name")
    return (
        apps.join(latest, "name", "left")
        .select(
            "ord",
            F.col("name").alias("app"),
            F.coalesce("status", F.lit("idle")).alias("status"),
            F.coalesce("error_msg", F.lit("")).alias("error_msg"),
        )
        .orderBy("ord")
    )


def recent_events_per_ticket(events: DataFrame, n: int = TICKET_EVENT_LIMIT) -> DataFrame:
    """The newest ``n`` events of each ticket.

    Spark applies the limit per task before the shuffle, so a ticket with very many events
    ships at most ``n`` rows per task.
    """
    newest = Window.partitionBy("ticket_id").orderBy(F.desc("seq"))
    return events.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")


def last_output(events: DataFrame) -> DataFrame:
    """Output of the newest done event with any, per ticket."""
    done = events.filter((F.col("status") == "done") & (F.col("output") != ""))
    return done.groupBy("ticket_id").agg(F.max_by("output", "seq").alias("last_output"))


def ticket_detail(tickets: DataFrame, events: DataFrame, n: int = TICKET_EVENT_LIMIT) -> DataFrame:
    """Tickets with their last ``n`` events, oldest first, and the last output among those."""
    item = F.struct("seq", "ts", "status", "action_name", "output")
    recent = recent_events_per_ticket(events.filter("ticket_id > 0"), n)
    shown = recent.groupBy(F.col("ticket_id").alias("id")).agg(
        F.sort_array(F.collect_list(item)).alias("events")
    )
    with_output = F.filter(
        F.col("events"), lambda e: (e["status"] == "done") & (e["output"] != "")
    )
    return tickets.join(shown, "id", "left").withColumn(
        "last_output", F.try_element_at(with_output, F.lit(-1))["output"]
    )
