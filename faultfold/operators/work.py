"""The worker's step: from received messages to runs, ticket states and delivery rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta, timezone
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultfold.operators.actions import MADE, run_actions, runs_of, status_of, ticket_outcomes, ticket_runs
from faultfold.operators.delivery import (
    HIDDEN_SECONDS,
    first_due,
    latest,
    route_messages,
    tick_number,
    visible_from,
)
from faultfold.schemas import RUN
from faultfold.session import materialize
from faultfold.sources.messages import TEXT_FIELDS, parse_messages

#: What a parsed message says of its ticket; the first ones are those of its runs.
OF_RUN = ["id", "app", "classification", "severity"]
OF_TICKET = [*OF_RUN, *[f for f in TEXT_FIELDS if f not in ("app_name", *OF_RUN)], "first_seen"]

#: Messages a worker takes and can read, of those :func:`parse_taken` gives.
READ = "route <> 'returned' and _has_body and _valid"


class Work(NamedTuple):
    """What a step leaves: runs, states (``message_id``, ``ticket_id``, ``attempt``, ``status``) and delivery
    rows. Each message is judged by its own runs, whatever ticket it names."""

    runs: DataFrame
    outcomes: DataFrame
    deliveries: DataFrame


def attempts(messages: DataFrame, log: DataFrame) -> DataFrame:
    """Messages with ``attempt``: one more than the times the log says they were received."""
    before = log.filter("kind = 'received'").groupBy("message_id").agg(F.count("*").alias("_n"))
    number = F.coalesce("_n", F.lit(0).cast("bigint")) + 1
    return messages.join(before, "message_id", "left").withColumn("attempt", number).drop("_n")


def route_taken(messages: DataFrame, workers: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Messages with their route, those that go back without a body; columns named in ``keep`` stay."""
    taken = F.when(F.col("route") != "returned", F.col("body")).alias("body")
    return route_messages(messages, workers).select("message_id", *keep, "route", "worker_app", taken)


def parse_taken(routed: DataFrame) -> DataFrame:
    """The ticket each routed message is about, in place of its body; ``READ`` tells where there is one."""
    parsed = parse_messages(routed).withColumn("_has_body", F.col("body").isNotNull())
    kept = [c for c in routed.columns if c not in ("body", "worker_app")]
    app = F.coalesce("worker_app", "app_name").alias("app")
    texts = [c for c in OF_TICKET if c not in ("id", "app")]
    return parsed.select(*kept, "_has_body", "_valid", F.col("ticket_id").alias("id"), app, *texts)


def process_messages(
    messages: DataFrame,
    log: DataFrame,
    workers: DataFrame,
    actions: DataFrame,
    fn: Callable[[dict, dict], str],
) -> Work:
    """Route and parse messages, run their tickets' actions, and say what becomes of them.

    ``messages`` has ``message_id``, ``body`` and ``attributes``; ``log`` is the delivery log so
    far. A message for an app without a worker goes back (``mismatched``), an unparseable one is
    deleted, one whose ticket fails comes back later (``failed``), the others are deleted. The
    user's actions run once: their rows are written to the shared folder, and all else is
    derived from them. A body is parsed once, and not at all where its message goes back; messages
    are then written without it. One that a worker takes without a body is ignored.
    """
    received = parse_taken(route_taken(attempts(messages, log), workers, keep=["attempt"]))
    received = materialize(received, "received")
    back = received.filter("route = 'returned'")
    rejects = received.filter("_has_body and not _valid")
    tickets = received.filter("_has_body and _valid").drop("route", "_has_body", "_valid")
    runs = materialize(run_actions(tickets, actions, fn, keep=["message_id"]), "runs")
    by = ["message_id", "ticket_id", "attempt"]
    outcomes = ticket_outcomes(runs, tickets, by=by).select(*by, "status")
    kind = F.when(F.col("status") == "failed", "failed").otherwise("deleted")
    worked = outcomes.select("message_id", "attempt", kind.alias("kind"))
    rest = [
        rows.select("message_id", "attempt", F.lit(what).alias("kind"))
        for rows, what in ((rejects, "deleted"), (back, "mismatched"))
    ]
    return Work(runs, outcomes, worked.unionByName(rest[0]).unionByName(rest[1]))


def work_queue(
    messages: DataFrame,
    log: DataFrame,
    workers: DataFrame,
    actions: DataFrame,
    fn: Callable[[dict, dict], str],
    ticks: Sequence[datetime],
) -> tuple[DataFrame, DataFrame]:
    """Work a queue off over time: the delivery log after the last of ``ticks``, and all runs.

    At each tick the workers receive every message that is visible then, run its ticket, and log
    what became of it, as in :func:`process_messages`; a failed one is visible again 30 seconds
    later, and is tried without a limit. ``log`` holds what happened before, ``published`` rows at
    least. The loop ends early once no message is left.

    Messages meet their log, are routed and are parsed once, before the first tick. From then on
    what becomes of a message at a tick follows from its own row, and says at which tick it is
    received next: a tick reads the rows that wait for it, and writes them to the shared folder
    with their runs. So the log is not read again, nothing is shuffled from tick to tick, and
    lineage does not grow with them. Only messages that share an id are grouped.
    """
    log = materialize(log.select("message_id", "kind", "ts", "seq"), "delivery-log")
    # Files have a known size, so that small ones are broadcast and messages are not shuffled by app.
    workers = materialize(workers.select("app").distinct(), "workers")
    actions = materialize(actions, "actions")
    parts, runs = [log], []
    ticks = sorted(t.astimezone(timezone.utc) for t in ticks)
    waiting: dict[int, list[tuple[DataFrame, bool, bool]]] = {}
    shared = False
    if ticks:
        routed = route_taken(messages, workers).join(_begin(messages, log, ticks).hint("merge"), "message_id")
        received = materialize(parse_taken(routed), "received")
        found = received.groupBy("_due").agg(F.max("_copies").alias("most")).collect()
        for due in (r["_due"] for r in found):
            waiting[due] = [(received.filter(F.col("_due") == due).drop("_due"), True, True)]
        shared = any(r["most"] > 1 for r in found)
    for number, tick in enumerate(ticks):
        if not waiting:
            break
        if number not in waiting:
            continue
        done = materialize(_work(waiting.pop(number), actions, fn), "runs")
        runs.append(runs_of(done, keep=["message_id"]))
        one = done.filter("_copies = 1") if shared else done
        added = [one.select("message_id", F.inline(_entries(F.lit("received"), F.col("kind"))))]
        left = [(one, False)]
        if shared:
            ended, agreed = _agree(done.filter("_copies > 1"))
            added += [ended, agreed.select("message_id", F.inline(_entries(F.lit("received"))))]
            left.append((agreed, True))
        at = F.lit(tick).cast("timestamp").alias("ts")
        parts += [rows.filter("kind is not null").select("message_id", "kind", at, "seq") for rows in added]
        for rows, mixed in left:
            kinds = {r["kind"] for r in rows.select("kind").distinct().collect()}
            for kind in kinds - {"deleted"}:
                shown = tick + timedelta(seconds=HIDDEN_SECONDS[kind or "received"])
                after = [n for n in range(number + 1, len(ticks)) if ticks[n] >= shown]
                if after:
                    again = rows.filter(F.col("kind").eqNullSafe(F.lit(kind)))
                    # Of messages that do not share an id, those that failed were read, and no others.
                    part = (_again(again), mixed or kind == "failed", mixed or kind != "failed")
                    waiting.setdefault(after[0], []).append(part)
    log = reduce(DataFrame.unionByName, parts)
    empty = log.sparkSession.createDataFrame([], RUN)
    return log, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs, empty)


def _begin(messages: DataFrame, log: DataFrame, ticks: Sequence[datetime]) -> DataFrame:
    """Per message: ``_due``, the tick that first finds it visible, its ``_copies``, how often it was
    ``_received``, and the last ``_seq`` of its log.

    The state at the first tick holds for the others, but where the log goes on after it.
    """
    known = log.select("message_id", "kind", "ts", "seq", F.lit(0).alias("_copy"))
    ids = messages.select("message_id", F.lit(1).alias("_copy"))
    going_on = F.col("ts").between(F.lit(ticks[0]) + F.expr("interval 1 microsecond"), F.lit(ticks[-1]))
    state = (
        known.unionByName(ids, allowMissingColumns=True)
        .groupBy("message_id")
        .agg(
            F.sum("_copy").alias("_copies"),
            F.count_if(F.col("kind") == "received").alias("_received"),
            F.max("seq").alias("_seq"),
            *latest(F.when(F.col("ts") <= F.lit(ticks[0]), F.col("seq"))),
        )
        .filter("_copies > 0")
        .withColumn("_due", tick_number(visible_from(), ticks))
        .drop("_code", "ts")
    )
    later = log.filter(going_on)
    if not later.isEmpty():
        later = later.select("message_id").distinct()
        due = first_due(log.join(later, "message_id", "left_semi"), ticks)
        due = later.join(due, "message_id", "left").withColumn("_later", F.lit(True))
        own = F.when(F.col("_later"), F.col("due")).otherwise(F.col("_due"))
        state = state.join(due, "message_id", "left").withColumn("_due", own).drop("due", "_later")
    return state.filter(F.col("_due") < len(ticks))


def _work(
    waiting: Sequence[tuple[DataFrame, bool, bool]], actions: DataFrame, fn: Callable[[dict, dict], str]
) -> DataFrame:
    """Received messages with their ``runs`` and ``kind``, what their delivery ended as, null if it did not end.

    ``waiting`` says of its rows whether there are some that were ``READ``, and some that were not.
    Of a ticket that is done only what its runs carry is kept.
    """
    number = (F.col("_received") + 1).alias("attempt")
    names = waiting[0][0].columns
    own = [c for c in names if c not in OF_TICKET]
    read = [rows.filter(READ).select(*names, number) for rows, some, _ in waiting if some]
    rest = [rows.filter(f"not coalesce({READ}, false)").select(*own, number) for rows, _, some in waiting if some]
    worked = []
    if read:
        ran = ticket_runs(
            reduce(DataFrame.unionByName, read), actions, fn, [*names, "attempt"], [c for c in own if c != "message_id"]
        )
        ended = F.when(status_of(F.col("runs")) == "failed", "failed").otherwise("deleted")
        ran = ran.withColumn("kind", ended)
        kept = (F.col("kind") == "failed") | (F.col("_copies") > 1)
        worked = [ran.withColumns({c: F.when(kept, F.col(c)) for c in OF_TICKET if c not in OF_RUN})]
    ended = F.expr("case when route = 'returned' then 'mismatched' when _has_body then 'deleted' end")
    none = {c: F.lit(None).cast(t) for c, t in waiting[0][0].dtypes if c in OF_TICKET} | {"runs": F.lit(None).cast(MADE)}
    return reduce(DataFrame.unionByName, [*worked, *[r.withColumns({**none, "kind": ended}) for r in rest]])


def _entries(*kinds: Column) -> Column:
    """Log entries of a delivery, in their order."""
    return F.array(
        *[F.struct(k.alias("kind"), (F.col("_seq") + n).alias("seq")) for n, k in enumerate(kinds, 1)]
    )


def _again(rows: DataFrame) -> DataFrame:
    """Rows of one tick as they are received at another."""
    logged = F.when(F.col("kind").isNull(), 1).otherwise(2)
    counts = {"_received": F.col("_received") + F.col("_copies"), "_seq": F.col("_seq") + logged}
    return rows.withColumns(counts).drop("attempt", "runs", "kind")


def _agree(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ends of messages that share an id, and the messages with the ``kind`` that their id ends as.

    Those about one ticket end once, as failed if any of them did. An id whose messages end
    differently comes back as soon as any of them would.
    """
    worked = rows.filter(READ).groupBy("message_id", "_seq", "id").agg(F.max("kind").alias("kind"))
    others = rows.filter(f"kind is not null and not coalesce({READ}, false)")
    ended = worked.select("message_id", "kind", "_seq").unionByName(others.select("message_id", "kind", "_seq"))
    state = ended.groupBy("message_id").agg(F.max("kind").alias("kind"))  # mismatched > failed > deleted
    ended = ended.select("message_id", "kind", (F.col("_seq") + 2).alias("seq"))
    return ended, rows.drop("kind").join(state, "message_id", "left")
