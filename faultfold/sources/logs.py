"""Log sources: each function returns rows in the log entry schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultfold import schemas
from faultfold.functions.payload import with_payload_message
from faultfold.functions.text import infer_severity, raw_line, split_severity, trim_line


# Sequence numbers from here on were generated; the sequence of a source must stay below.
GENERATED = 1 << 62


def as_entries(df: DataFrame) -> DataFrame:
    """Log entry columns in order; arrival time and sequence are filled in if absent.

    A stream gets its sequence per micro-batch, see ``with_sequence``.
    """
    if "dedupe_key" not in df.columns:
        df = df.withColumn("dedupe_key", F.lit(""))
    if "arrival_ts" not in df.columns:
        df = df.withColumn("arrival_ts", F.current_timestamp())
    if "arrival_seq" not in df.columns:
        df = df.withColumn("arrival_seq", F.lit(None).cast("bigint"))
        df = df if df.isStreaming else with_sequence(df)
    return df.select(*schemas.column_names(schemas.LOG_ENTRY))


def with_sequence(df: DataFrame) -> DataFrame:
    """Number rows that have no ``arrival_seq``: unique, in input order inside a file split.

    Generated numbers start at ``GENERATED``, so they come after given ones and never meet them. Numbers
    generated earlier are given anew, which keeps them unique where rows of several sources meet.
    """
    given = F.when(F.col("arrival_seq") < GENERATED, F.col("arrival_seq"))
    return df.withColumn("arrival_seq", F.coalesce(given, F.monotonically_increasing_id() + GENERATED))


def parse_text_lines(lines: DataFrame, app: str | Column, ts: Column, line: str = "value") -> DataFrame:
    """Entries from text lines: trimmed, without blank and ``#`` lines, severity split off."""
    app = F.lit(app) if isinstance(app, str) else app
    trimmed = lines.withColumn("_line", trim_line(F.col(line)))
    kept = trimmed.filter((F.col("_line") != "") & ~F.col("_line").startswith("#"))
    parts = kept.withColumn("_parts", split_severity(F.col("_line"))).withColumn("ts", ts)
    return as_entries(
        parts.withColumn("app", app)
        .withColumn("severity", F.col("_parts.severity"))
        .withColumn("message", F.col("_parts.message"))
        .withColumn("raw_line", raw_line(F.col("ts"), F.col("severity"), F.col("message")))
        .withColumn("dedupe_key", F.col("_line"))
    )


def read_text_logs(
    spark: SparkSession, path: str, app: str, ts: Column, require_lines: bool = True
) -> DataFrame:
    """Batch text source. Files are split among tasks; an input without any entry is an error."""
    entries = parse_text_lines(spark.read.option("lineSep", "\n").text(path), app, ts)
    if require_lines and entries.isEmpty():
        raise ValueError(f"error log {path!r} has no entries")
    return entries


def stream_text_logs(
    spark: SparkSession, path: str, app: str, ts: Column, max_files_per_trigger: int = 1000
) -> DataFrame:
    """Streaming text source over a folder; entries of all files dropped into it."""
    lines = (
        spark.readStream.option("lineSep", "\n")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .text(path)
    )
    return parse_text_lines(lines, app, ts)


def from_event_records(df: DataFrame, app: str | Column) -> DataFrame:
    """Entries from exported ``timestamp`` (ms) and ``message`` records, severity inferred."""
    app = F.lit(app) if isinstance(app, str) else app
    return as_entries(
        df.withColumn("app", app)
        .withColumn("ts", F.timestamp_millis("timestamp"))
        .withColumn("message", F.coalesce("message", F.lit("")))
        .withColumn("severity", infer_severity(F.col("message")))
        .withColumn("raw_line", raw_line(F.col("ts"), F.col("severity"), F.col("message")))
        .withColumn("dedupe_key", F.lit(""))
    )


def from_structured_entries(df: DataFrame, app: str | Column) -> DataFrame:
    """Entries from ``ts``, ``severity`` and a text, JSON or typed payload."""
    app = F.lit(app) if isinstance(app, str) else app
    named = with_payload_message(df, "text_payload", "json_payload", "proto_type")
    return as_entries(
        named.withColumn("app", app)
        .withColumn("raw_line", raw_line(F.col("ts"), F.col("severity"), F.col("message")))
        .withColumn("dedupe_key", F.lit(""))
    )


def since(as_of: Column, interval_s: int) -> Column:
    """Start of a poll's look-back: two intervals, or a minute if there is no interval."""
    back = 2 * interval_s if interval_s > 0 else 60
    return as_of - F.make_dt_interval(secs=F.lit(back))


def fetch_since(df: DataFrame, as_of: Column, interval_s: int, mode: str) -> DataFrame:
    """Rows a poll at ``as_of`` would fetch.

    ``event_records`` is inclusive at the millisecond, ``structured`` strict at the whole
    second. The comparison is on the bare column, so it reaches the parquet scan.
    """
    start = since(as_of, interval_s)
    if mode == "event_records":
        return df.filter(F.col("ts") >= F.date_trunc("millisecond", start))
    if mode == "structured":
        return df.filter(F.col("ts") > F.date_trunc("second", start))
    raise ValueError(f"unknown mode: {mode!r}")


def source_filter(
    df: DataFrame,
    predicate: str | None,
    as_of: Column,
    interval_s: int,
    mode: str = "structured",
    ordered: bool = True,
) -> DataFrame:
    """Poll filter and an optional predicate in Spark SQL, oldest first.

    The order is a distributed range sort; leave it out where the consumer ignores order.
    """
    fetched = fetch_since(df, as_of, interval_s, mode)
    if predicate:
        fetched = fetched.filter(F.expr(predicate))
    return fetched.orderBy("ts", "arrival_seq") if ordered else fetched


def union_sources(*sources: DataFrame) -> DataFrame:
    """All entries of all sources; nothing is removed across sources.

    Rows without a sequence of their own are numbered together, after the union.
    """
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
    return union if union.isStreaming or "arrival_seq" not in union.columns else with_sequence(union)


def dedupe_overlap(
    df: DataFrame, keys: list[str], delay: str | None = None, at: str = "ts"
) -> DataFrame:
    """Undo the overlap: one row per ``keys``. Rows with a null key cannot be told apart and all stay.

    A stream needs ``delay``, the time by ``at`` after which a repeat can no longer arrive.
    """
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    own = F.when(whole, F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys])).otherwise(F.uuid())
    marked = df.withColumn("_own", own)
    if df.isStreaming:
        if delay is None:
            raise ValueError("a stream needs a delay")
        return marked.withWatermark(at, delay).dropDuplicatesWithinWatermark(["_own"]).drop("_own")
    return marked.dropDuplicates(["_own"]).drop("_own")
