"""Polls of configured sources: fetched, processed, and told about as they happen.

A poll writes that it is polling before it fetches; an error of the fetch is caught, ends the poll without
classification, and is told with its text. The next poll looks back two intervals, so lines of a failed one come with it.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from faultfold.schemas import APP_STATUS
from faultfold.session import materialize
from faultfold.streaming.pipeline import DEFAULT_INTERVAL_S, poll_status


class Source(NamedTuple):
    """An app's source: ``fetch(batch)`` returns log entries, every ``interval_s`` seconds."""

    app: str
    fetch: Callable[[DataFrame], DataFrame]
    interval_s: int = DEFAULT_INTERVAL_S


def _told(spark: SparkSession, path: str, app: str, batch_id: int, error: str | None, ended: datetime | None) -> None:
    """Write a poll's status rows: the first one before it runs, and the other beside it, so that a poll that is
    stopped meanwhile keeps the first. A poll that runs again replaces both."""
    row = spark.createDataFrame([(app, ended, batch_id, error)], "app string, poll_ts timestamp, seq bigint, fetch_error string")
    wanted, mode = ("status = 'polling'", "overwrite") if ended is None else ("status <> 'polling'", "append")
    rows = poll_status(row).filter(wanted)
    rows.drop("app").coalesce(1).write.mode(mode).parquet(f"{path}/poll={batch_id}/app={app}")


def poll_step(
    spark: SparkSession, source: Source, process: Callable[[DataFrame, int], None], path: str
) -> Callable[[DataFrame, int], None]:
    """Batch step: one poll of a source. Only errors of the fetch are caught; those of ``process`` end the query,
    which runs the batch again when it is started anew."""

    def step(batch: DataFrame, batch_id: int) -> None:
        _told(spark, path, source.app, batch_id, None, None)
        error, entries = None, None
        try:
            # The fetch is lazy, so it has to be read to its end to be known to have worked.
            entries = materialize(source.fetch(batch), "fetched")
        except Exception as problem:
            error = str(problem) or type(problem).__name__
        if entries is not None:
            process(entries, batch_id)
        _told(spark, path, source.app, batch_id, error, datetime.now(timezone.utc))

    return step


def start_polls(
    spark: SparkSession,
    sources: list[Source],
    process: Callable[[str], Callable[[DataFrame, int], None]],
    path: str,
    checkpoint: str,
) -> list[StreamingQuery]:
    """Poll every configured source at its own interval; ``process(app)`` is the app's batch step."""
    queries = []
    for source in sources:
        clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        step = poll_step(spark, source, process(source.app), path)
        writer = clock.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/{source.app}")
        interval = source.interval_s or DEFAULT_INTERVAL_S
        queries.append(writer.trigger(processingTime=f"{interval} seconds").queryName(f"poll {source.app}").start())
    return queries


def read_poll_status(spark: SparkSession, path: str) -> DataFrame:
    """Status rows of all polls so far, with their ``poll``."""
    return spark.read.schema(f"{APP_STATUS}, poll bigint").parquet(path).withColumn("app", F.col("app").cast("string"))
