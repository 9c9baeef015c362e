"""Ticket state: folding occurrences into daily tickets, and status changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultfold import schemas
from faultfold.functions.text import dedupe_text
from faultfold.operators.classify import classify_by_rules
from faultfold.operators.scan import (
    block_counts,
    carry_forward,
    join_null_safe,
    rank_in_blocks,
    running_rank,
)
from faultfold.session import materialize

KEY = schemas.TICKET_KEY
COLUMNS = schemas.column_names(schemas.TICKET)

def _seconds(ts: Column) -> Column:
    """Stored times have whole seconds."""
    return F.date_trunc("second", ts)


def _is_closed(status: Column) -> Column:
    return status.isin(*schemas.CLOSED_STATUSES)


def folded_columns(carried: list[Column]) -> list[Column]:
    """What the fold keeps of a ticket: ``n``, ``first_seq``, ``first`` with the ``carried`` columns, and ``last``."""
    first = F.struct(F.coalesce("ts", "arrival_ts").alias("seen"), *carried)
    last = F.struct(F.col("raw_line"), F.col("arrival_ts"))
    return [
        F.count("*").alias("n"),
        F.min("arrival_seq").alias("first_seq"),
        F.min_by(first, F.struct("arrival_seq", "raw_line")).alias("first"),
        F.max_by(last, F.struct("arrival_seq", "raw_line")).alias("last"),
    ]


def fold_occurrences(
    occ: DataFrame, classify: Callable[[DataFrame, Column], DataFrame] = classify_by_rules
) -> DataFrame:
    """One row per ticket key: what the occurrences of a batch add to a ticket.

    Count, first and last are algebraic, so each task reduces its own rows before the
    shuffle and a hot key costs one row per task. Order is arrival order; rows that share a
    sequence number are ordered by their line.

    Only the first occurrence gives a ticket its labels. Occurrences without labels are
    therefore folded first, and ``classify(df, text)`` sees one line per ticket instead of
    every line. A classifier that may fail for a line has to run before the fold.
    """
    labelled = "fingerprint" in occ.columns
    carried = [F.col(c) for c in schemas.LABELS] if labelled else [dedupe_text().alias("line")]
    folded = occ.groupBy(*KEY).agg(*folded_columns(carried))
    if labelled:
        return folded
    named = classify(folded, F.col("first.line"))
    labels = F.struct(F.col("first.seen").alias("seen"), *[F.col(c) for c in schemas.LABELS])
    return named.withColumn("first", labels).drop(*schemas.LABELS)


def ticket_rows(new: DataFrame, max_id: Column) -> DataFrame:
    """Ticket rows of keys seen for the first time, with ids in order of first arrival."""
    seen = _seconds(F.col("first.seen"))
    return assign_ids(new, max_id, "first_seq", KEY).select(
        "id",
        "app",
        "fingerprint_hash",
        F.col("first.fingerprint").alias("fingerprint_text"),
        F.col("first.classification").alias("classification"),
        F.col("first.severity").alias("severity"),
        F.col("first.component").alias("component"),
        F.col("last.raw_line").alias("raw_log"),
        seen.alias("first_seen"),
        F.when(F.col("n") == 1, seen).otherwise(_seconds(F.col("last.arrival_ts"))).alias(
            "last_seen"
        ),
        "created_date",
        F.col("n").alias("occurrence_count"),
        F.lit("open").alias("status"),
        F.lit("").alias("message_id"),
    )


def _repeated_rows(tickets: DataFrame, delta: DataFrame) -> DataFrame:
    """Known tickets with the batch's repeats added; closed and absent keys stay as they are."""
    repeats = delta.select(*KEY, "n", "last")
    joined = join_null_safe(tickets, repeats, KEY, "left")
    hit = F.col("n").isNotNull() & ~_is_closed(F.col("status"))
    updated = {
        "occurrence_count": F.col("occurrence_count") + F.col("n"),
        "last_seen": _seconds(F.col("last.arrival_ts")),
        "raw_log": F.col("last.raw_line"),
    }
    changes = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in updated.items()}
    return joined.withColumns(changes).select(*COLUMNS)


def largest_id(tickets: DataFrame) -> Column:
    return tickets.agg(F.coalesce(F.max("id"), F.lit(0).cast("bigint"))).scalar()


def assign_ids(
    new: DataFrame, max_id: Column, order: str, ties: list[str] | None = None
) -> DataFrame:
    """Ids without gaps in the given order, then by ``ties``, continuing after ``max_id``."""
    ranked = running_rank(new, [], order, "_rank", ties)
    return ranked.withColumn("id", F.col("_rank") + max_id).drop("_rank")


def upsert_tickets(
    occ: DataFrame, tickets: DataFrame | None = None, max_id: Column | None = None
) -> DataFrame:
    """The ticket table after a batch of classified occurrences.

    The occurrences are read once; what remains per key is written to the shared folder and
    feeds the three light branches below. Pass only the tickets of the batch's days, which is
    what ``TicketTable`` does, together with the table's largest id.
    """
    delta = materialize(fold_occurrences(occ), "delta")
    return merge_delta(delta, tickets, max_id)


def merge_delta(
    delta: DataFrame, tickets: DataFrame | None = None, max_id: Column | None = None
) -> DataFrame:
    """``upsert_tickets`` from an already folded and stored batch."""
    if tickets is None:
        return ticket_rows(delta, F.lit(0) if max_id is None else max_id)
    if max_id is None:
        max_id = largest_id(tickets)
    new = join_null_safe(delta, tickets.select(*KEY), KEY, "left_anti")
    return _repeated_rows(tickets, delta).unionByName(ticket_rows(new, max_id))


def upsert_with_status(
    occ: DataFrame, tickets: DataFrame, status_log: DataFrame, max_id: Column | None = None
) -> DataFrame:
    """Upsert where ticket states change during the batch.

    Occurrences that arrive while their ticket is closed are left out first; the ticket ends
    with its last logged state. ``status_log`` has the ticket key, ``status`` and
    ``arrival_seq``, and only changes of tickets that exist by then.
    """
    known = tickets.select(*KEY, "status")
    counted = status_as_of(occ, status_log, known).filter("counted")
    delta = materialize(fold_occurrences(counted), "delta")
    reopened = tickets.withColumn(
        "status", F.when(_is_closed(F.col("status")), "open").otherwise(F.col("status"))
    )
    merged = merge_delta(delta, reopened, max_id)
    final = status_log.groupBy(*KEY).agg(F.max_by("status", "arrival_seq").alias("_final"))
    was = known.withColumnRenamed("status", "_was")
    return (
        merged.transform(join_null_safe, was, KEY, "left")
        .transform(join_null_safe, final, KEY, "left")
        .withColumn("status", F.coalesce("_final", "_was", "status"))
        .select(*COLUMNS)
    )


def occurrences(occ: DataFrame, tickets: DataFrame) -> DataFrame:
    """Each occurrence with ``occurrence_no``, ``is_new`` and ``skipped``.

    The ticket's state is attached to the block summaries, not to the rows, so a hot key stays
    spread over its blocks throughout.
    """
    known = tickets.select(
        *KEY, F.col("occurrence_count").alias("_base"), F.col("status").alias("_status")
    )
    offsets = join_null_safe(block_counts(occ, KEY, "arrival_seq"), known, KEY, "left")
    ranked = rank_in_blocks(occ, offsets, KEY, "arrival_seq", "_rank", ["raw_line"])
    skipped = F.coalesce(_is_closed(F.col("_status")), F.lit(False))
    zero = F.lit(0).cast("bigint")
    return (
        ranked.withColumn("skipped", skipped)
        .withColumn("is_new", F.col("_base").isNull() & (F.col("_rank") == 1))
        .withColumn(
            "occurrence_no",
            F.coalesce("_base", zero) + F.when(F.col("skipped"), zero).otherwise(F.col("_rank")),
        )
        .drop("_base", "_status", "_rank")
    )


def skip_closed(occ: DataFrame, tickets: DataFrame) -> DataFrame:
    """Occurrences whose ticket of that day is not closed."""
    closed = tickets.filter(_is_closed(F.col("status"))).select(*KEY)
    return join_null_safe(occ, closed, KEY, "left_anti")


def skipped_counts(occ: DataFrame, tickets: DataFrame) -> DataFrame:
    """Number of skipped occurrences per closed ticket; reduced before the join."""
    closed = tickets.filter(_is_closed(F.col("status"))).select(*KEY, "id")
    counts = occ.groupBy(*KEY).agg(F.count("*").alias("skipped"))
    return join_null_safe(counts, closed, KEY).drop(*KEY)


def new_tickets(occ: DataFrame, tickets: DataFrame) -> DataFrame:
    """First occurrence, as it is, of every key that has no ticket yet."""
    rest = [c for c in occ.columns if c not in KEY]
    keys = occ.groupBy(*KEY).agg(F.min_by(F.struct(*rest), "arrival_seq").alias("first"))
    new = join_null_safe(keys, tickets.select(*KEY), KEY, "left_anti")
    return new.select(*KEY, "first.*")


def apply_status(tickets: DataFrame, updates: DataFrame) -> DataFrame:
    """Set the status of tickets; the latest update per ``ticket_id`` by ``seq`` wins."""
    latest = updates.groupBy(F.col("ticket_id").alias("id")).agg(
        F.max_by("status", "seq").alias("_status")
    )
    return (
        tickets.join(latest, "id", "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .select(*tickets.columns)
    )


def apply_message_ids(tickets: DataFrame, updates: DataFrame) -> DataFrame:
    """Set the message id of tickets; the latest update per ``ticket_id`` by ``seq`` wins."""
    latest = updates.groupBy(F.col("ticket_id").alias("id")).agg(
        F.max_by("message_id", "seq").alias("_message_id")
    )
    return (
        tickets.join(latest, "id", "left")
        .withColumn("message_id", F.coalesce("_message_id", "message_id"))
        .select(*tickets.columns)
    )


def apply_publish_outcomes(tickets: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Published tickets get their message id, failed ones become pending.

    ``outcomes`` has one row per published ticket: ``ticket_id``, ``message_id``, ``error``.
    """
    done = outcomes.select(
        F.col("ticket_id").alias("id"),
        F.col("message_id").alias("_message_id"),
        F.col("error").isNotNull().alias("_failed"),
    )
    return (
        tickets.join(done, "id", "left")
        .withColumn("status", F.when(F.col("_failed"), "pending").otherwise(F.col("status")))
        .withColumn(
            "message_id",
            F.when(F.col("_failed") == F.lit(False), F.col("_message_id")).otherwise(
                F.col("message_id")
            ),
        )
        .select(*tickets.columns)
    )


def status_as_of(
    occ: DataFrame, status_log: DataFrame, initial: DataFrame | None = None
) -> DataFrame:
    """Each occurrence with the ticket status at its arrival and whether it counts.

    States travel as small integers, so the summaries use hash aggregation. ``initial`` holds
    the states before the batch; ties between a change and an arrival go to the change.
    """
    codes = F.array(*[F.lit(s) for s in schemas.TICKET_STATUSES])

    def code(status: Column) -> Column:
        return F.array_position(codes, status).cast("int")

    seq, change = F.col("arrival_seq"), F.lit(0).alias("_side")
    changes = status_log.select(*KEY, seq.alias("_order"), change, code(F.col("status")).alias("_code"))
    if initial is not None:
        before = F.lit(-1).cast("bigint").alias("_order")
        changes = changes.unionByName(
            initial.select(*KEY, before, change, code(F.col("status")).alias("_code"))
        )
    rows = occ.withColumns({"_order": seq, "_side": F.lit(1), "_row": F.lit(True)})
    both = rows.unionByName(changes, allowMissingColumns=True)
    carried = carry_forward(both, KEY, "_order", "_code", "_at", ["_side"])
    status = F.try_element_at(codes, F.nullif(F.col("_at"), F.lit(0)))
    return (
        carried.filter("_row")
        .withColumn("status_as_of", status)
        .withColumn("counted", ~F.coalesce(_is_closed(F.col("status_as_of")), F.lit(False)))
        .drop("_order", "_side", "_code", "_at", "_row")
    )


def status_from_events(events: DataFrame) -> DataFrame:
    """Displayed ticket status after all events: the latest one per ticket decides."""
    names = F.array(*[F.lit(s) for s in schemas.EVENT_STATUSES])
    shown = F.array(F.lit("in_progress"), F.lit("done"), F.lit("failed"))
    code = F.array_position(names, F.col("status")).cast("int")
    return (
        events.filter("ticket_id > 0")
        .withColumn("_code", code)
        .filter("_code > 0")
        .groupBy("ticket_id")
        .agg(F.max_by("_code", "seq").alias("_code"))
        .select("ticket_id", F.element_at(shown, F.col("_code")).alias("status"))
    )
