"""Structured Streaming: periodic ingest, ticket state per micro-batch, publishing.

State is kept in ``TicketTable``, to which ``foreachBatch`` steps append. Every step is keyed by
its stream's writer name and the batch id, so a batch that is run again after a failure leaves the
same result, and several streams can share a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultfold.operators.classify import occurrences_of
from faultfold.session import materialize
from faultfold.sources.logs import dedupe_overlap, with_sequence
from faultfold.sources.messages import ticket_messages, write_ticket_messages
from faultfold.sources.tickets import TicketTable

# Fixed value: seconds between polls when none are given.
DEFAULT_INTERVAL_S = 30

#: Commits of a ticket table after which they are added up.
COMPACT_EVERY = 16

#: What tells the lines of polled sources apart.
OVERLAP_KEYS = ["app", "arrival_seq"]


def start_ingest(
    stream: DataFrame,
    process: Callable[[DataFrame, int], None],
    checkpoint: str,
    interval_s: int = DEFAULT_INTERVAL_S,
    available_now: bool = False,
) -> StreamingQuery:
    """Call ``process(batch, batch_id)`` at start and then every interval.

    ``available_now`` works off what is there and stops. ``checkpoint`` must be on shared
    storage on a cluster.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(process)
    if available_now:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{interval_s or DEFAULT_INTERVAL_S} seconds")
    return writer.start()


def fold_batch(
    table: TicketTable,
    writer: str,
    classify: Callable[[DataFrame], DataFrame] | None = None,
    hash_on: str = "dedupe_text",
    day_basis: str = "arrival",
) -> Callable[[DataFrame, int], None]:
    """Batch step: classify, fingerprint and fold entries into the ticket table.

    Without ``classify``, the default rules label each ticket once it is folded.

    Days are days of arrival, so late entries join today's tickets and no watermark is
    needed. ``day_basis='event'`` files them under their own day instead.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        entries = with_sequence(batch)
        entries = classify(entries) if classify else entries
        table.upsert(occurrences_of(entries, hash_on, day_basis), batch_id, writer)
        table.compact(at_least=COMPACT_EVERY)

    return process


def stream_tickets(
    stream: DataFrame,
    table: TicketTable,
    checkpoint: str,
    writer: str,
    available_now: bool = False,
    overlap_keys: list[str] | None = None,
    **options,
) -> StreamingQuery:
    """Tickets from a stream of log entries. Each stream on a table has a ``writer`` of its own.

    Polls look back two intervals, so a source that is polled delivers lines again. Each line counts
    once: ``overlap_keys`` tell a source's lines apart, by default its own number for them; lines
    without a number cannot be delivered again, as only files have none. An empty list keeps repeats.
    """
    interval = options.pop("interval_s", DEFAULT_INTERVAL_S)
    keys = OVERLAP_KEYS if overlap_keys is None else overlap_keys
    if keys:
        delay = f"{4 * (interval or DEFAULT_INTERVAL_S)} seconds"
        stream = dedupe_overlap(stream, keys, delay, "arrival_ts")
    step = fold_batch(table, writer, **options)
    return start_ingest(stream, step, checkpoint, interval, available_now)


def publish_new(
    table: TicketTable,
    batch_id: int,
    writer: str,
    path: str,
    send: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Publish the tickets a batch created, once, and return the outcome per ticket.

    Messages go to ``path/<writer>/batch=<id>``; a second run replaces that folder with the same
    content. The time of publishing is the newest ``last_seen`` of the batch, so that it does
    not change on a second run either. The counter of a message id is the ticket's id: it never
    starts again, so ids stay unique over all batches and writers. ``send`` may replace the file
    sink: it takes the messages and returns ``ticket_id``, ``message_id`` and ``error``.
    """
    created = table.created_in(batch_id, writer)
    messages = ticket_messages(created)
    if send is not None:
        return send(messages)
    published_at = created.agg(F.max("last_seen")).scalar()
    numbered = messages.withColumn("published_at", published_at).withColumn(
        "mock_message_id",
        F.concat_ws(
            "-", F.lit("mock-msg"), F.unix_millis("published_at").cast("string"), F.col("ticket_id").cast("string")
        ),
    )
    folder = f"{path}/{writer}/batch={batch_id}"
    write_ticket_messages(numbered, folder, mode="overwrite")
    return table.spark.read.text(folder).select(
        F.get_json_object("value", "$.ticket_id").cast("bigint").alias("ticket_id"),
        F.get_json_object("value", "$.mock_message_id").alias("message_id"),
        F.lit(None).cast("string").alias("error"),
    )


def fold_and_publish(
    table: TicketTable,
    writer: str,
    path: str,
    classify: Callable[[DataFrame], DataFrame] | None = None,
    send: Callable[[DataFrame], DataFrame] | None = None,
    **options,
) -> Callable[[DataFrame, int], None]:
    """Batch step: fold, publish the new tickets, store message ids and failures."""
    fold = fold_batch(table, writer, classify, **options)

    def process(batch: DataFrame, batch_id: int) -> None:
        fold(batch, batch_id)
        outcomes = materialize(publish_new(table, batch_id, writer, path, send), "outcomes")
        table.set_messages(outcomes, batch_id, f"{writer}.publish")

    return process


def status_batch(
    table: TicketTable, actions: DataFrame, writer: str = "status"
) -> Callable[[DataFrame, int], None]:
    """Batch step: store the ticket states that follow from worker events.

    A ticket is in progress until every action of its app is done, whatever batch the events
    come in. A failed ticket that is delivered again goes back to in progress, without a limit
    on attempts. Events have ``ticket_id``, ``attempt``, ``pos`` and ``status``.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        table.add_outcomes(batch, actions, batch_id, writer)

    return process


def stream_status(
    events: DataFrame,
    table: TicketTable,
    actions: DataFrame,
    checkpoint: str,
    available_now: bool = False,
    writer: str = "status",
) -> StreamingQuery:
    """Ticket states from a stream of worker events."""
    step = status_batch(table, actions, writer)
    return start_ingest(events, step, checkpoint, available_now=available_now)


def poll_status(polls: DataFrame) -> DataFrame:
    """Status rows of each poll: polling, then idle or, if fetching failed, error with text.

    ``polls`` has ``app``, ``poll_ts``, ``seq`` and ``fetch_error`` (NULL on success). Works on
    batches and streams alike.
    """
    never = F.lit(None).cast("timestamp")
    begin = F.struct(
        F.lit("polling").alias("status"),
        F.lit("").alias("error_msg"),
        never.alias("last_poll"),
        (F.col("seq") * 2).alias("arrival_seq"),
    )
    failed = F.col("fetch_error").isNotNull()
    end = F.struct(
        F.when(failed, "error").otherwise("idle").alias("status"),
        F.when(failed, F.concat(F.lit("fetch error: "), F.col("fetch_error")))
        .otherwise("")
        .alias("error_msg"),
        F.col("poll_ts").alias("last_poll"),
        (F.col("seq") * 2 + 1).alias("arrival_seq"),
    )
    return polls.select("app", F.explode(F.array(begin, end)).alias("s")).select("app", "s.*")
