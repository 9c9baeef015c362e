"""Actions on tickets: planning, running, and what the runs mean for ticket state.

A *plan* row is one action of one ticket. A *run* row is a plan row with ``attempt`` (the
delivery it belongs to), ``failed``, ``output``, ``err_msg`` and ``ts``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultfold.functions.prompts import with_prompts, with_template_parts
from faultfold.schemas import RUN

#: What a run adds to its ticket, and its Arrow types.
MADE = "array<struct<pos:int,action_name:string,failed:boolean,output:string,err_msg:string,ts:timestamp>>"
MADE_TYPES = {
    "pos": pa.int32(),
    "action_name": pa.string(),
    "failed": pa.bool_(),
    "output": pa.string(),
    "err_msg": pa.string(),
    "ts": pa.timestamp("us", "UTC"),
}


def action_name() -> Column:
    """Configured name, or the kind followed by its target."""
    default = F.when(
        F.col("type") == "webhook", F.concat(F.lit("webhook:"), F.col("url"))
    ).otherwise(F.concat(F.lit("cli_agent:"), F.col("command")))
    return F.coalesce(F.nullif(F.col("name"), F.lit("")), default)


def plan_actions(tickets: DataFrame, actions: DataFrame) -> DataFrame:
    """Each ticket with each action of its app, in ``pos`` order.

    No broadcast hint: the action table is broadcast when its size is below Spark's
    threshold, otherwise the join is partitioned and skewed apps are split.
    """
    named = actions.withColumn("action_name", action_name()).drop("name")
    return tickets.join(named, "app")


def render_prompts(tickets: DataFrame, actions: DataFrame) -> DataFrame:
    """Prompt of each agent action of each ticket; NULL if its template has an unknown field."""
    agents = with_template_parts(actions.filter(F.col("type") == "cli_agent"))
    return with_prompts(plan_actions(tickets, agents))


def run_actions(
    tickets: DataFrame,
    actions: DataFrame,
    fn: Callable[[dict, dict], str],
    attempt: int = 1,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Run the user's ``fn(ticket, action) -> output`` for each ticket, actions in order.

    The rows of :func:`ticket_runs`, one for each run. A column ``attempt`` of the tickets
    replaces the argument. ``keep`` names further columns of the tickets that their runs carry.
    """
    own = ["id", "app", "classification", "severity", *(["attempt"] if "attempt" in tickets.columns else [])]
    ran = ticket_runs(tickets, actions, fn, carry=[*own, *(c for c in keep if c not in own)])
    return runs_of(ran, attempt, keep)


def ticket_runs(
    tickets: DataFrame,
    actions: DataFrame,
    fn: Callable[[dict, dict], str],
    carry: Sequence[str],
    aside: Sequence[str] = (),
) -> DataFrame:
    """One row for each ticket: its columns named in ``carry``, and ``runs``, what its actions made.

    An exception fails the action and ends its ticket's sequence, so later actions do not
    run. The actions of an app are gathered first (their number is a matter of
    configuration); each ticket is then one row, and tickets run in parallel on all
    executors. A lost task runs its tickets again: delivery is at least once. A ticket whose app
    has no actions has no runs. ``aside`` names columns that ``fn`` is not given.
    """
    named = actions.withColumn("action_name", action_name()).drop("name")
    details = [c for c in named.columns if c not in ("app", "pos")]
    steps = named.groupBy("app").agg(
        F.sort_array(F.collect_list(F.struct("pos", *details))).alias("_steps")
    )
    types = dict(tickets.dtypes)
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in carry], f"runs {MADE}"])
    seen = [c for c in tickets.columns if c not in aside]
    zoned = [c for c in seen if types[c] == "timestamp"]
    zone = tickets.sparkSession.conf.get("spark.sql.session.timeZone")

    def sequence(ticket: dict, actions: list[dict]) -> Iterator[tuple]:
        for action in actions:
            try:
                output, error = fn(ticket, dict(action)), ""
            except Exception as problem:
                output, error = "", str(problem) or type(problem).__name__
            now = datetime.now(timezone.utc)
            yield action["pos"], action["action_name"], error != "", output, error, now
            if error:
                return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.select(seen).to_pandas()
            for c in zoned:
                frame[c] = frame[c].dt.tz_convert(zone).dt.tz_localize(None)
            # An app's actions are the same for all its tickets, so a batch converts them once.
            known: dict[str, list[dict]] = {}
            rows, ends = [], [0]
            # As to_dict("records") gives them, column by column.
            for k, values in enumerate(zip(*[frame[c].tolist() for c in seen])):
                ticket = dict(zip(seen, values))
                app = ticket["app"]
                if app not in known:
                    known[app] = batch.column("_steps")[k].as_py() or []
                rows += sequence(ticket, known[app])
                ends.append(len(rows))
            made = zip(MADE_TYPES.values(), list(zip(*rows)) or [()] * len(MADE_TYPES))
            made = pa.StructArray.from_arrays([pa.array(v, t) for t, v in made], list(MADE_TYPES))
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], made], [*carry, "runs"])

    return tickets.join(steps, "app", "left").mapInArrow(run, schema)


def runs_of(ran: DataFrame, attempt: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """The rows of :func:`ticket_runs`, one for each run."""
    number = F.col("attempt") if "attempt" in ran.columns else F.lit(attempt)
    rows = ran.select(
        F.col("id").alias("ticket_id"),
        *["app", "classification", "severity"],
        number.alias("attempt"),
        *[F.col(c).alias(f"_keep_{c}") for c in keep],
        F.inline("runs"),
    )
    given = [F.col(name).cast(kind).alias(name) for name, kind in (f.split() for f in RUN.split(", "))]
    return rows.select(*given, *[F.col(f"_keep_{c}").alias(c) for c in keep])


def status_of(runs: Column) -> Column:
    """State of one delivery from its ``runs``: done if no action failed, else failed."""
    return F.when(F.exists(runs, lambda r: r["failed"]), "failed").otherwise("done")


def executed_runs(runs: DataFrame) -> DataFrame:
    """Runs up to and including the first failure of their ticket and attempt.

    The first failing position is a minimum, so it needs no ordering of the runs; only
    deliveries with a failure take part in the join.
    """
    failures = (
        runs.filter("failed")
        .groupBy("ticket_id", "attempt")
        .agg(F.min("pos").alias("_failed_pos"))
    )
    return (
        runs.join(failures, ["ticket_id", "attempt"], "left")
        .filter("_failed_pos is null or pos <= _failed_pos")
        .drop("_failed_pos")
    )


def action_events(runs: DataFrame) -> DataFrame:
    """Worker events of the executed runs: processing, then done or failed."""
    start = F.struct(
        F.lit(0).alias("step"),
        F.lit("processing").alias("status"),
        F.lit("").alias("err_msg"),
        F.lit("").alias("output"),
    )
    end = F.struct(
        F.lit(1).alias("step"),
        F.when(F.col("failed"), "failed").otherwise("done").alias("status"),
        F.when(F.col("failed"), F.coalesce("err_msg", F.lit(""))).otherwise("").alias("err_msg"),
        F.when(F.col("failed"), "").otherwise(F.coalesce("output", F.lit(""))).alias("output"),
    )
    kept = [c for c in runs.columns if c not in ("failed", "err_msg", "output")]
    return (
        executed_runs(runs)
        .withColumn("_event", F.explode(F.array(start, end)))
        .select(*kept, "_event.*")
    )


def ticket_outcomes(
    runs: DataFrame,
    tickets: DataFrame | None = None,
    attempt: int = 1,
    by: Sequence[str] = ("ticket_id", "attempt"),
) -> DataFrame:
    """Per delivery, which ``by`` tells apart: done if no action failed, else failed, with the failing position.

    ``tickets`` are those a delivery was for: one whose app has no actions has no runs, and is
    done. Needs no order and no window: the first failure is a minimum, reduced before the
    shuffle.
    """
    if tickets is not None:
        number = F.col("attempt") if "attempt" in tickets.columns else F.lit(attempt)
        given = tickets.withColumns(
            {"ticket_id": F.col("id"), "attempt": number.cast("bigint")}
        ).select(*by)
        runs = given.join(runs.select(*by, "failed", "pos"), list(by), "left")
    return (
        runs.groupBy(*by)
        .agg(F.min(F.when(F.col("failed"), F.col("pos"))).alias("failed_pos"))
        .withColumn("status", F.when(F.col("failed_pos").isNull(), "done").otherwise("failed"))
    )
