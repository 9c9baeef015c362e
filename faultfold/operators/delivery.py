"""Message routing and the delivery lifecycle of the ticket queue.

The delivery log has ``message_id``, ``kind``, ``ts`` and ``seq``. Kinds: ``published``,
``received``, ``failed``, ``mismatched``, ``deleted``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultfold.operators.scan import running

# Seconds a message stays hidden after each kind of log row.
HIDDEN_SECONDS = {"published": 0, "received": 300, "failed": 30, "mismatched": 0}
KINDS = [*HIDDEN_SECONDS, "deleted"]

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def route_messages(
    messages: DataFrame, workers: DataFrame, attributes: str = "attributes"
) -> DataFrame:
    """Where each message goes: ``worker`` (its app), ``any`` worker, or ``returned``.

    A message without an AppName attribute is accepted by any worker. One that names an app
    goes to that app's worker; every other worker puts it back, so an app without a worker
    keeps returning it.
    """
    apps = workers.select(F.col("app").alias("_worker_app")).distinct()
    target = F.try_element_at(F.col(attributes), F.lit("AppName"))
    return (
        messages.withColumn("_target", target)
        .join(apps, F.col("_target") == F.col("_worker_app"), "left")
        .withColumn(
            "route",
            F.when(F.col("_target").isNull(), "any")
            .when(F.col("_worker_app").isNotNull(), "worker")
            .otherwise("returned"),
        )
        .withColumn("worker_app", F.col("_worker_app"))
        .drop("_target", "_worker_app")
    )


def unrouted_messages(
    messages: DataFrame, workers: DataFrame, attributes: str = "attributes"
) -> DataFrame:
    """Messages that name an app without a worker."""
    apps = workers.select(F.col("app").alias("_target"))
    named = messages.withColumn("_target", F.try_element_at(F.col(attributes), F.lit("AppName")))
    return named.filter("_target is not null").join(apps, "_target", "left_anti").drop("_target")


def latest(order: Column | str = "seq") -> list[Column]:
    """Aggregates for the last row of a message: its kind as a number, ``_code``, and its ``ts``.

    Kinds travel as numbers and times as they are, so the aggregation needs no sort.
    """
    code = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    return [F.max_by(code, order).alias("_code"), F.max_by("ts", order).alias("ts")]


def kind_of(code: Column | str = "_code") -> Column:
    """Name of a kind that :func:`latest` gave as a number."""
    return F.try_element_at(F.array(*[F.lit(k) for k in KINDS]), F.nullif(code, F.lit(0)))


def visible_from(code: Column | str = "_code", ts: Column | str = "ts") -> Column:
    """Time from which a message with that last row is visible; null if it is never again."""
    hidden = F.array(*[F.lit(s) for s in [*HIDDEN_SECONDS.values(), None]])
    return F.col(ts) + F.make_dt_interval(secs=F.try_element_at(hidden, F.nullif(code, F.lit(0))))


def delivery_state(log: DataFrame) -> DataFrame:
    """Latest state per message: its kind and the time from which it is visible."""
    state = log.groupBy("message_id").agg(*latest())
    return state.select("message_id", kind_of().alias("kind"), "ts", visible_from().alias("visible_at"))


def tick_number(moment: Column, ticks: Sequence[datetime]) -> Column:
    """Place of the first of ``ticks``, which are in order, at or after ``moment``; their number if there is none."""
    micros = F.array(*[F.lit((t - EPOCH) // timedelta(microseconds=1)).cast("bigint") for t in ticks])
    passed = F.size(F.filter(micros, lambda t: t < F.unix_micros(moment)))
    return F.when(moment.isNotNull(), passed)


def first_due(log: DataFrame, ticks: Sequence[datetime]) -> DataFrame:
    """``message_id, due``: the place of the first tick at which the log lets the message be received.

    A row holds from its time until a row with a higher ``seq`` does, so it counts if the first
    tick at which it shows its message comes before that. As in :func:`depth_series`, a message's
    history need not lie in one task. Only messages that are due at some tick come back.
    """
    rows = log.filter(F.col("seq").isNotNull() & (F.col("ts") <= F.lit(ticks[-1])))
    code = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    rows = rows.select("message_id", (-F.col("seq")).alias("_back"), code.alias("_code"), "ts")
    rows = running(rows, ["message_id"], "_back", "ts", "_next", F.min, strict=True)
    rows = rows.withColumn("due", tick_number(visible_from(), ticks)).filter(F.col("due") < len(ticks))
    until = tick_number(F.col("_next"), ticks)
    return rows.filter(until.isNull() | (F.col("due") < until)).groupBy("message_id").agg(F.min("due").alias("due"))


def queue_depth(log: DataFrame, as_of: Column) -> DataFrame:
    """Visible and hidden messages at ``as_of``."""
    state = delivery_state(log.filter(F.col("ts") <= as_of)).filter("kind <> 'deleted'")
    return state.agg(
        F.count_if(F.col("visible_at") <= as_of).alias("visible"),
        F.count_if(F.col("visible_at") > as_of).alias("in_flight"),
    )


def depth_series(log: DataFrame, start: datetime, end: datetime, every_s: int = 10) -> DataFrame:
    """``as_of, visible, in_flight`` at ``start`` and every ``every_s`` seconds to ``end``.

    A sweep line: a log row holds from its time until a later row of its message does, and within
    that span the message is hidden first and visible then. Each span adds one at the first
    tick in it and takes one off at the first tick after it; the depth is a running sum over the
    ticks, whose changes are added up per tick first. So a row costs three narrow rows, whatever
    the number of ticks, and neither a message's nor the queue's history lies in one task.
    Times without a zone are UTC.
    """
    first, last = (int((t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp()) for t in (start, end))
    ticks = (last - first) // every_s + 1

    def tick(moment: Column) -> Column:
        """Number of the first tick at or after a moment; before the first it is 0, after the last ``ticks``."""
        after = F.unix_micros(moment) - F.lit(first * 1_000_000)
        number = F.floor((after + F.lit(every_s * 1_000_000 - 1)) / F.lit(every_s * 1_000_000))
        return F.least(F.greatest(number, F.lit(0).cast("bigint")), F.lit(ticks).cast("bigint"))

    kinds = [*HIDDEN_SECONDS, "deleted"]
    code = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")).cast("int")
    # The latest row comes first, so the earliest time of all later rows is a running minimum.
    rows = log.select("message_id", (-F.col("seq")).alias("_back"), code.alias("_code"), "ts")
    rows = running(rows, ["message_id"], "_back", "ts", "_next", F.min, strict=True)
    rows = rows.filter("(_next is null or _next > ts) and _code between 1 and 4")
    hidden = F.element_at(F.array(*[F.lit(s) for s in HIDDEN_SECONDS.values()]), F.col("_code"))
    shown = F.col("ts") + F.make_dt_interval(secs=hidden)
    # greatest() passes over nulls, so a row without a later one is told apart first.
    end_tick = F.when(F.col("_next").isNull(), F.lit(ticks).cast("bigint")).otherwise(tick(F.col("_next")))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def change(at: Column, visible: Column, in_flight: Column) -> Column:
        return F.struct(at.alias("_tick"), visible.alias("_visible"), in_flight.alias("_in_flight"))

    changes = F.array(
        change(tick(F.col("ts")), none, one),
        change(F.least(tick(shown), end_tick), one, -one),
        change(end_tick, -one, none),
    )
    summed = (
        rows.select(F.explode(changes).alias("c"))
        .select("c.*")
        .groupBy("_tick")
        .agg(F.sum("_visible").alias("_visible"), F.sum("_in_flight").alias("_in_flight"))
    )
    series = log.sparkSession.range(ticks).withColumnRenamed("id", "_tick").join(summed, "_tick", "left")
    for name in ("visible", "in_flight"):
        series = running(series, [], "_tick", f"_{name}", name, F.sum)
    at = F.timestamp_seconds(F.lit(first) + F.col("_tick") * every_s).alias("as_of")
    return series.select(at, *[F.coalesce(n, none).alias(n) for n in ("visible", "in_flight")])
