"""Log sources that are fetched since a time, as a Python data source for batches and streams.

A fetcher is ``fetch(app, since, until)``: it yields Arrow record batches of log lines with a time from
``since`` on and before ``until``. ``register_source`` makes a data source of it::

    register_source(spark, "gateway", fetch)
    spark.read.format("gateway").option("apps", "shop,auth").load().filter("ts >= '2024-01-29'")
    spark.readStream.format("gateway").option("apps", "shop").option("since", "2024-01-29").load()

A batch pushes comparisons with ``ts`` and ``app`` into the fetch; Spark tests them again. A span is cut into
slices that tasks fetch side by side. A stream's offsets are fetch times: a batch covers the time from
the last offset to the next, so a batch that is run again asks for the same lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

#: Rows a fetcher yields; the columns of a log entry without those the library fills in.
FETCHED = (
    "app string, ts timestamp, severity string, message string, raw_line string, "
    "dedupe_key string, arrival_ts timestamp, arrival_seq bigint"
)
Fetch = Callable[[str, datetime, datetime], Iterator[pa.RecordBatch]]

_TICK = timedelta(microseconds=1)


def _moment(text: str) -> datetime:
    moment = datetime.fromisoformat(text)
    return moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)


def _utc(value: datetime) -> datetime:
    """Times of pushed filters come without a zone, in the session's, which is UTC."""
    return value if value.tzinfo else value.replace(tzinfo=timezone.utc)


class Span(InputPartition):
    """What one task fetches: an app's lines from ``since`` on and before ``until``."""

    def __init__(self, app: str, since: datetime, until: datetime):
        super().__init__((app, since, until))
        self.app, self.since, self.until = app, since, until


def spans(apps: list[str], since: datetime, until: datetime, slices: int) -> list[Span]:
    """Each app's time cut into at most ``slices`` spans that neither overlap nor leave a gap."""
    if since >= until:
        return []
    micros = (until - since) // _TICK
    step = -(-micros // max(1, slices))
    borders = [*(since + k * _TICK for k in range(0, micros, step)), until]
    return [Span(app, a, b) for app in apps for a, b in zip(borders, borders[1:])]


class _Options:
    """``apps`` by commas, ``since`` and ``until`` as ISO times, ``slices`` of a span."""

    def __init__(self, options):
        self.apps = [a for a in options.get("apps", "").split(",") if a]
        self.since = _moment(options.get("since", "1970-01-01T00:00:00"))
        self.until = _moment(options["until"]) if options.get("until") else None
        self.slices = int(options.get("slices", "8"))

    def now(self) -> datetime:
        now = datetime.now(timezone.utc)
        return min(self.until, now) if self.until else now


class FetchReader(DataSourceReader):
    def __init__(self, fetch: Fetch, options: _Options):
        self.fetch, self.apps = fetch, options.apps
        self.since, self.until, self.slices = options.since, options.now(), options.slices

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrow the span and the apps; all filters are returned, so Spark tests rows as well."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("ts",):
                after = _utc(f.value) + (_TICK if isinstance(f, GreaterThan) else 0 * _TICK)
                self.since = max(self.since, after)
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("ts",):
                before = _utc(f.value) + (_TICK if isinstance(f, LessThanOrEqual) else 0 * _TICK)
                self.until = min(self.until, before)
            elif isinstance(f, EqualTo) and f.attribute == ("app",):
                self.apps = [a for a in self.apps if a == f.value]
            yield f

    def partitions(self) -> list[Span]:
        return spans(self.apps, self.since, self.until, self.slices) or [Span("", self.since, self.since)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if partition.since < partition.until:
            yield from self.fetch(partition.app, partition.since, partition.until)


class FetchStream(DataSourceStreamReader):
    def __init__(self, fetch: Fetch, options: _Options):
        self.fetch, self.options = fetch, options

    def initialOffset(self) -> dict:
        return {"until": self.options.since.isoformat()}

    def latestOffset(self) -> dict:
        """The present, or ``until``; never before ``since``."""
        return {"until": max(self.options.since, self.options.now()).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return spans(self.options.apps, _moment(start["until"]), _moment(end["until"]), self.options.slices)

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        yield from self.fetch(partition.app, partition.since, partition.until)


def fetch_source(format_name: str, fetch: Fetch, schema: str = FETCHED) -> type[DataSource]:
    """A data source that Spark can register under ``format_name``.

    The fetcher is called in tasks, so it must be picklable and reach its service from executors.
    """

    class FetchSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> FetchReader:
            return FetchReader(fetch, _Options(self.options))

        def streamReader(self, schema) -> FetchStream:
            return FetchStream(fetch, _Options(self.options))

    return FetchSource


def register_source(spark: SparkSession, format_name: str, fetch: Fetch, schema: str = FETCHED) -> None:
    """Make ``spark.read.format(format_name)`` and ``readStream`` fetch lines, with comparisons pushed into the fetch."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(fetch_source(format_name, fetch, schema))
