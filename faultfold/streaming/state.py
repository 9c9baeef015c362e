"""Daily tickets kept in Spark's own state store.

Count, first and last of a ticket are algebraic, so the fold is an ordinary streaming aggregation per day, app and
hash: the state store holds one row per ticket of the days that are still open, looks a batch's tickets up by
their key, and drops a day once the watermark has passed it. No history is read. In update mode
a batch sends the whole state of the tickets it touched; these rows are appended under the batch's id, where a
batch that is run again replaces itself, and the latest row of a ticket is its state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultfold.functions.text import dedupe_text
from faultfold.operators.classify import classify_by_rules, occurrences_of
from faultfold.operators.tickets import folded_columns, ticket_rows
from faultfold.schemas import LABELS, TICKET_KEY

#: Time behind the newest line after which a day takes no more lines and leaves the state store.
KEPT = "2 days"


def ticket_states(entries: DataFrame, hash_on: str = "dedupe_text", day_basis: str = "arrival", kept: str = KEPT) -> DataFrame:
    """The fold of a stream of log entries: ticket key, ``n``, ``first_seq``, ``first`` and ``last``.

    With ``day_basis='event'`` a line belongs to its own day, and one that comes later than ``kept`` is left out;
    ``late_rows`` keeps those. Entries need a sequence number of their own, as a stream cannot number them.
    """
    basis = {"arrival": "arrival_ts", "event": "ts"}[day_basis]
    occ = occurrences_of(entries, hash_on, day_basis).drop("created_date")
    at = occ.withColumn("_at", F.coalesce(F.col(basis), F.col("arrival_ts"))).withWatermark("_at", kept)
    folded = at.groupBy("fingerprint_hash", "app", F.window("_at", "1 day").alias("_day")).agg(
        *folded_columns([dedupe_text().alias("line")])
    )
    return folded.withColumn("created_date", F.date_format("_day.start", "yyyy-MM-dd")).drop("_day")


def keep_states(path: str) -> Callable[[DataFrame, int], None]:
    """Batch step: write the states a batch sends, by day."""

    def process(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("created_date").parquet(f"{path}/batch={batch_id}")

    return process


def stream_states(
    entries: DataFrame, path: str, checkpoint: str, interval_s: int = 30, available_now: bool = False, **options
) -> StreamingQuery:
    """Keep the tickets of a stream under ``path``."""
    states = ticket_states(entries, **options)
    writer = states.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(keep_states(path))
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{interval_s} seconds"}
    return writer.trigger(**trigger).start()


def read_states(
    spark: SparkSession,
    path: str,
    days: list[str] | None = None,
    classify: Callable[[DataFrame, Column], DataFrame] = classify_by_rules,
) -> DataFrame:
    """Current tickets, of all days or of the given ones, whose folders alone are read then.

    Ids follow the first arrival; lines are classified here, once per ticket.
    """
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    rows = rows.withColumn("created_date", F.col("created_date").cast("string"))
    if days is not None:
        rows = rows.filter(F.col("created_date").isin(days))
    latest = rows.groupBy(*TICKET_KEY).agg(F.max_by(F.struct("n", "first_seq", "first", "last"), "batch").alias("s"))
    named = classify(latest.select(*TICKET_KEY, "s.*"), F.col("first.line"))
    labels = F.struct(F.col("first.seen").alias("seen"), *[F.col(c) for c in LABELS])
    return ticket_rows(named.withColumn("first", labels).drop(*LABELS), F.lit(0).cast("bigint"))


def late_rows(
    spark: SparkSession, path: str, process: Callable[[DataFrame, int], None], delay_s: int, at: str = "ts"
) -> Callable[[DataFrame, int], None]:
    """Batch step: rows more than ``delay_s`` behind the newest of all batches before go to ``path/late``, the others to ``process``.

    That is the rule of a watermark, which would drop such rows without a trace. The newest time of
    each batch is a row under ``path/marks``; only batches before one's own count, so a batch that is run
    again decides as it did first.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            newest = _marks(spark, path).filter(F.col("batch") < batch_id).agg(F.max("newest")).scalar()
            limit = newest - F.make_dt_interval(secs=F.lit(delay_s))
            is_late = F.coalesce(F.col(at) < limit, F.lit(False))
            batch.filter(is_late).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
            process(batch.filter(~is_late), batch_id)
            newest = batch.agg(F.max(at).alias("newest"))
            newest.coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/batch={batch_id}")
        finally:
            batch.unpersist()

    return step


def _marks(spark: SparkSession, path: str) -> DataFrame:
    """``batch, newest`` of the batches so far: one row each."""
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/marks")
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return spark.createDataFrame([], "batch bigint, newest timestamp")
    return spark.read.schema("newest timestamp, batch bigint").parquet(f"{path}/marks")


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """The late rows of all batches, with their ``batch``."""
    return spark.read.parquet(f"{path}/late")
