"""Ticket rows at rest: plain reads and writes, and a table of appended batches."""

from __future__ import annotations

import re
import threading
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultfold import schemas
from faultfold.operators.scan import join_null_safe
from faultfold.operators.tickets import assign_ids, fold_occurrences
from faultfold.session import materialize

COLUMNS = schemas.column_names(schemas.TICKET)
KEY = schemas.TICKET_KEY
CHANGE = (
    "fingerprint_hash string, app string, created_date string, id bigint, n bigint, "
    "first_seq bigint, first struct<seen:timestamp,classification:string,severity:string,"
    "component:string,fingerprint:string>, last struct<raw_line:string,arrival_ts:timestamp>, "
    "status string, message_id string, attempt bigint, done array<int>, failed boolean, "
    "commit bigint"
)
CHANGE_TYPES = {n: t for n, t in re.findall(r"(\w+) ((?:struct<[^>]*>|array<int>|\w+))(?:, |$)", CHANGE)}
BASE = "base"


class Commit(NamedTuple):
    """One appended batch. A compaction is written under the number of the last commit it covers."""

    number: int
    writer: str
    batch: int


def backfill_created_date(df: DataFrame) -> DataFrame:
    """Fill a missing or empty ``created_date`` from the day of ``first_seen``."""
    day = F.date_format("first_seen", "yyyy-MM-dd")
    if "created_date" not in df.columns:
        return df.withColumn("created_date", day)
    stored = F.nullif(F.col("created_date").cast("string"), F.lit(""))
    return df.withColumn("created_date", F.coalesce(stored, day))


def as_tickets(df: DataFrame) -> DataFrame:
    """Ticket columns from stored rows: text times parsed, missing message id as empty."""
    for name in ("first_seen", "last_seen"):
        if dict(df.dtypes)[name] == "string":
            df = df.withColumn(name, F.try_to_timestamp(F.col(name)))
    df = df.withColumn("message_id", F.coalesce("message_id", F.lit("")))
    return backfill_created_date(df).select(*COLUMNS)


def load_tickets(spark: SparkSession, path: str) -> DataFrame:
    return as_tickets(spark.read.parquet(path))


def by_day(tickets: DataFrame) -> DataFrame:
    """Gather days before a write by day: few files, while large days are split at run time."""
    return tickets.hint("rebalance", "created_date")


def save_tickets(tickets: DataFrame, path: str) -> None:
    """Write tickets by day, replacing the days they cover and no others."""
    (
        by_day(tickets)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("created_date")
        .parquet(path)
    )


class TicketTable:
    """Tickets as appended changes; a day is never rewritten.

    A fold appends one row per ticket key of its batch, with an id for keys it creates; messages
    and states append the rows they change. Reading adds the changes up per key: counts are
    summed, the first and last line and the latest state win by commit. ``compact`` does that for
    older commits once and for all.

    Every stream has a ``writer`` name of its own. A batch that is run again replaces its own
    commit, or changes nothing once that is compacted; a batch id below the writer's last is an
    error, never skipped. One driver owns a table and hands out commits one at a time; a commit
    counts once it is complete.

    What is compacted lies in the order of days, and of keys within a day, so the files and row
    groups of other days and ids are passed over by their statistics: a batch reads its own days,
    however long the history is.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._lock = threading.RLock()
        self._tops: dict[Commit, int] = {}

    # -- commits ---------------------------------------------------------------------------

    def _commits(self) -> list[Commit]:
        """Complete commits in order: one short name for each since the last compaction."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        files = root.getFileSystem(conf)
        if not files.exists(root):
            return []
        found = []
        for status in files.listStatus(root):
            name = status.getPath().getName()
            if files.exists(jvm.org.apache.hadoop.fs.Path(root, f"{name}/_SUCCESS")):
                number, writer, batch = name.split(",")
                found.append(Commit(int(number), writer, int(batch)))
        return sorted(found)

    def _number(self, writer: str, batch: int) -> tuple[int, list[Commit]]:
        """The commit number of a batch, and the commits before it."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", writer) or writer == BASE:
            raise ValueError(f"writer name {writer!r}")
        commits = self._commits()
        own = [c for c in commits if c.writer == writer]
        if own and own[-1].batch > batch:
            raise ValueError(f"writer {writer!r} is at batch {own[-1].batch}, not at {batch}")
        if own and own[-1].batch == batch:
            return own[-1].number, [c for c in commits if c.number < own[-1].number]
        return (commits[-1].number + 1 if commits else 1), commits

    def _begin(self, writer: str, batch: int) -> tuple[int, list[Commit]] | None:
        """As ``_number``; None if the batch is compacted already, so that it need not run again."""
        number, before = self._number(writer, batch)
        bases = [c for c in self._commits() if c.writer == BASE]
        return None if bases and number <= bases[-1].number else (number, before)

    def _largest_id(self, commits: list[Commit]) -> int:
        """The largest id so far. Each commit is asked for its own once, and a batch's commit is small."""
        for c in commits:
            if c not in self._tops:
                rows = self.spark.read.schema(CHANGE).parquet(self._folder(c.number, c.writer, c.batch))
                self._tops[c] = rows.agg(F.max("id")).first()[0] or 0
        self._tops = {c: top for c, top in self._tops.items() if c in commits}
        return max(self._tops.values(), default=0)

    def _write(self, rows: DataFrame, number: int, writer: str, batch: int) -> None:
        self._tops = {c: top for c, top in self._tops.items() if c.number != number}
        wide = rows.withColumns(
            {n: F.lit(None).cast(t) for n, t in CHANGE_TYPES.items() if n not in rows.columns}
        )
        wide = wide.withColumn("commit", F.lit(number).cast("bigint")).select(*CHANGE_TYPES)
        wide.write.mode("overwrite").parquet(self._folder(number, writer, batch))

    def _live(self, commits: list[Commit]) -> list[Commit]:
        """The latest compaction and the commits after it."""
        bases = [c for c in commits if c.writer == BASE]
        return [*bases[-1:], *[c for c in commits if c.writer != BASE and (not bases or c.number > bases[-1].number)]]

    def _changes(self, commits: list[Commit]) -> DataFrame:
        live = self._live(commits)
        if not live:
            return self.spark.createDataFrame([], CHANGE)
        return self.spark.read.schema(CHANGE).parquet(*[self._folder(c.number, c.writer, c.batch) for c in live])

    def compact(self, at_least: int = 2) -> None:
        """Add up all commits so far, if ``at_least`` so many came since the last time.

        A writer's last commit stays in its place, so that its batch is known if it is run again.
        What the compaction before this one covered is deleted; readers of it have long ended.
        """
        with self._lock:
            commits = self._commits()
            fresh = [c for c in self._live(commits) if c.writer != BASE]
            if len(fresh) < max(2, at_least):
                return
            number = fresh[-1].number
            changes = self._changes(commits)
            events = changes.filter("attempt is not null").groupBy(*KEY, "attempt").agg(*_merged())
            state = _summed(changes).unionByName(events, allowMissingColumns=True)
            # Days follow each other in the files, and keys within a day.
            order = [F.col(c) for c in ("created_date", "fingerprint_hash", "app")]
            laid = state.repartitionByRange(*order).sortWithinPartitions(*order)
            self._write(laid, number, BASE, number)
            last = {c.writer: c.number for c in commits if c.writer != BASE}
            before = [c.number for c in commits if c.writer == BASE]
            if before:
                self._delete([c for c in commits if c.number <= before[-1] and last.get(c.writer) != c.number])

    def _delete(self, commits: list[Commit]) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for c in commits:
            path = jvm.org.apache.hadoop.fs.Path(self._folder(c.number, c.writer, c.batch))
            path.getFileSystem(conf).delete(path, True)

    def _folder(self, number: int, writer: str, batch: int) -> str:
        return f"{self.path}/log/{number:012d},{writer},{batch}"

    # -- reading ---------------------------------------------------------------------------

    def read(self, days: list[str] | None = None) -> DataFrame:
        """Current tickets, of all days or of the given ones."""
        return _as_rows(_summed(_of_days(self._changes(self._commits()), days)))

    def created_in(self, batch_id: int, writer: str) -> DataFrame:
        """Tickets as the given batch created them."""
        own = [c for c in self._commits() if (c.writer, c.batch) == (writer, batch_id)]
        return _as_rows(_summed(self._changes(own).filter("id is not null")))

    # -- writing ---------------------------------------------------------------------------

    def upsert(self, occ: DataFrame, batch_id: int, writer: str) -> None:
        """Append what a batch of classified occurrences adds. The occurrences are read once.

        Keys whose ticket is closed are left out; keys without a ticket get the next ids.
        """
        with self._lock:
            begun = self._begin(writer, batch_id)
            if begun is None:
                return
            number, before = begun
            delta = materialize(fold_occurrences(occ), "delta")
            known = self._changes(before)
            first, last = delta.agg(F.min("created_date"), F.max("created_date")).first()
            near = known.filter(F.col("created_date").between(first, last) | F.col("created_date").isNull())
            near = join_null_safe(near, delta.select(*KEY), KEY, "left_semi")
            state = _summed(near).select(*KEY, "id", "status")
            state = state.withColumnsRenamed({"id": "_id", "status": "_status"})
            joined = join_null_safe(delta, state, KEY, "left")
            new = joined.filter("_id is null").drop("_id", "_status")
            closed = F.coalesce(F.col("_status").isin(*schemas.CLOSED_STATUSES), F.lit(False))
            old = joined.filter(F.col("_id").isNotNull() & ~closed).drop("_id", "_status")
            top = F.lit(self._largest_id(self._live(before))).cast("bigint")
            rows = assign_ids(new, top, "first_seq", KEY).unionByName(old, allowMissingColumns=True)
            self._write(rows, number, writer, batch_id)

    def set_messages(self, outcomes: DataFrame, batch_id: int, writer: str) -> None:
        """Append message ids, and pending for tickets whose publishing failed."""
        failed = F.col("error").isNotNull()
        rows = outcomes.select(
            F.col("ticket_id").alias("_id"),
            F.when(~failed, F.col("message_id")).alias("message_id"),
            F.when(failed, "pending").alias("status"),
        )
        self._append_by_id(rows, batch_id, writer)

    def set_status(self, updates: DataFrame, batch_id: int, writer: str) -> None:
        """Append states: ``ticket_id``, ``status``, one row per ticket. Unknown ids are ignored."""
        self._append_by_id(updates.select(F.col("ticket_id").alias("_id"), "status"), batch_id, writer)

    def add_outcomes(self, events: DataFrame, actions: DataFrame, batch_id: int, writer: str) -> None:
        """Append worker events and the states that follow from all events so far.

        ``events`` has ``ticket_id``, ``attempt``, ``pos`` and ``status``. Per ticket the latest
        attempt decides: failed if an action failed, done once every action of the ticket's app
        is done, else in progress. ``actions`` has a row for each ``app`` and ``pos``.
        """
        with self._lock:
            begun = self._begin(writer, batch_id)
            if begun is None:
                return
            number, before = begun
            known = self._changes(before)
            done = F.when(F.col("status") == "done", F.col("pos"))
            fresh = (
                events.filter("ticket_id > 0")
                .groupBy(F.col("ticket_id").alias("_id"), "attempt")
                .agg(F.collect_set(done).alias("done"), F.max(F.col("status") == "failed").alias("failed"))
            )
            fresh = materialize(fresh.join(_keys_of(known, fresh), "_id"), "events")
            past = known.filter("attempt is not null")
            past = join_null_safe(past, fresh.select(*KEY).distinct(), KEY, "left_semi")
            both = fresh.drop("_id").unionByName(past.select(*KEY, "attempt", "done", "failed"))
            merged = both.groupBy(*KEY, "attempt").agg(*_merged())
            planned = actions.groupBy("app").agg(F.countDistinct("pos").alias("_planned"))
            complete = F.size("done") >= F.coalesce("_planned", F.lit(0))
            state = F.when(F.col("failed"), "failed").when(complete, "done").otherwise("in_progress")
            states = merged.join(planned, "app", "left").groupBy(*KEY).agg(
                F.max_by(state, "attempt").alias("status")
            )
            rows = join_null_safe(fresh.drop("_id"), states, KEY)
            self._write(rows, number, writer, batch_id)

    def _append_by_id(self, rows: DataFrame, batch_id: int, writer: str) -> None:
        with self._lock:
            begun = self._begin(writer, batch_id)
            if begun is None:
                return
            number, before = begun
            keys = _keys_of(self._changes(before), rows)
            self._write(rows.join(keys, "_id").drop("_id"), number, writer, batch_id)


def _keys_of(known: DataFrame, rows: DataFrame) -> DataFrame:
    """``_id`` and the key of the tickets that ``rows`` may name. Ids grow with the days, so the range of the
    rows' ids leaves the row groups of other days unread."""
    low, high = rows.agg(F.min("_id"), F.max("_id")).first()
    near = known.filter(F.col("id").between(low, high))
    return near.select(F.col("id").alias("_id"), *KEY)


def _merged() -> list[Column]:
    """Events of a ticket's attempt added up: the positions done, and whether one failed."""
    return [
        F.array_distinct(F.flatten(F.collect_list("done"))).alias("done"),
        F.max("failed").alias("failed"),
    ]


def _of_days(changes: DataFrame, days: list[str] | None) -> DataFrame:
    if days is None:
        return changes
    day = F.col("created_date")
    return changes.filter(day.isin([d for d in days if d is not None]) | (day.isNull() & F.lit(None in days)))


def _summed(changes: DataFrame) -> DataFrame:
    """Changes added up to one row per ticket key."""
    at, folded = F.col("commit"), F.col("n").isNotNull()
    return changes.groupBy(*KEY).agg(
        F.min("id").alias("id"),
        F.sum("n").alias("n"),
        F.min_by("first", F.when(folded, at)).alias("first"),
        F.max_by("last", F.when(folded, at)).alias("last"),
        F.max_by("status", F.when(F.col("status").isNotNull(), at)).alias("status"),
        F.max_by("message_id", F.when(F.col("message_id").isNotNull(), at)).alias("message_id"),
    )


def _as_rows(summed: DataFrame) -> DataFrame:
    """Ticket rows of summed changes."""
    seen = F.date_trunc("second", F.col("first.seen"))
    later = F.date_trunc("second", F.col("last.arrival_ts"))
    return summed.select(
        "id",
        "app",
        "fingerprint_hash",
        F.col("first.fingerprint").alias("fingerprint_text"),
        F.col("first.classification").alias("classification"),
        F.col("first.severity").alias("severity"),
        F.col("first.component").alias("component"),
        F.col("last.raw_line").alias("raw_log"),
        seen.alias("first_seen"),
        F.when(F.col("n") == 1, seen).otherwise(later).alias("last_seen"),
        "created_date",
        F.col("n").alias("occurrence_count"),
        F.coalesce("status", F.lit("open")).alias("status"),
        F.coalesce("message_id", F.lit("")).alias("message_id"),
    )
