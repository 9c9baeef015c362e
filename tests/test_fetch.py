"""The pluggable source: spans, filters that reach the fetch, and restarts."""

from datetime import datetime, timedelta, timezone

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, IsNotNull, LessThan, LessThanOrEqual

from faultfold.sources import fetch

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(minutes):
    return START + timedelta(minutes=minutes)


@given(st.integers(1, 10**12), st.integers(0, 40))
def test_spans_cover_the_time_once(micros, slices):
    made = fetch.spans(["a", "b"], START, START + timedelta(microseconds=micros), slices)
    for app in "ab":
        mine = [s for s in made if s.app == app]
        assert mine[0].since == START and mine[-1].until == START + timedelta(microseconds=micros)
        assert all(x.until == y.since for x, y in zip(mine, mine[1:])) and len(mine) <= max(1, slices)
        assert all(s.since < s.until for s in mine)
    assert fetch.spans(["a"], START, START, slices) == []


def test_filters_narrow_the_fetch():
    reader = fetch.FetchReader(None, fetch._Options({"apps": "a,b,c", "until": "2024-01-02"}))
    naive = lambda m: at(m).replace(tzinfo=None)
    filters = [
        GreaterThanOrEqual(("ts",), naive(5)), GreaterThan(("ts",), at(7)), LessThan(("ts",), at(50)),
        LessThanOrEqual(("ts",), at(40)), EqualTo(("app",), "b"), IsNotNull(("ts",)), GreaterThan(("n",), 3),
    ]
    assert list(reader.pushFilters(filters)) == filters  # Spark tests all of them again
    tick = timedelta(microseconds=1)
    assert (reader.apps, reader.since, reader.until) == (["b"], at(7) + tick, at(40) + tick)
    assert {s.app for s in reader.partitions()} == {"b"}


def minutes_of(log):
    """A service that has a line a minute for each app, and a log of what it was asked for."""

    minutes = [at(m) for m in range(60)]

    def lines(app, since, until):
        with open(log, "a") as out:
            out.write(f"{app},{since.isoformat()},{until.isoformat()}\n")
        times = [t for t in minutes if since <= t < until]
        if times:
            yield pa.RecordBatch.from_arrays(
                [pa.array([app] * len(times)), pa.array(times, pa.timestamp("us", "UTC"))], ["app", "ts"]
            )

    return lines


def test_a_batch_asks_for_what_it_needs(spark, tmp_path):
    log = tmp_path / "asked"
    fetch.register_source(spark, "minutes", minutes_of(str(log)), "app string, ts timestamp")
    source = spark.read.format("minutes").option("apps", "x,y").option("until", "2025-01-01").option("slices", 3)
    rows = source.load().filter((F.col("ts") >= F.lit(at(50))) & (F.col("app") == "y"))
    assert rows.count() == 10
    asked = [line.split(",") for line in log.read_text().split()]
    assert {a for a, *_ in asked} == {"y"} and min(s for _, s, _ in asked) == at(50).isoformat() and len(asked) == 3
    assert source.option("until", "2020-01-01").load().count() == 0


def test_a_stream_goes_on_where_it_was(spark, tmp_path):
    fetch.register_source(spark, "minutes", minutes_of(str(tmp_path / "asked")), "app string, ts timestamp")
    for until in (20, 20, 45, 100):
        source = spark.readStream.format("minutes").option("apps", "x,y").option("since", at(5).isoformat())
        stream = source.option("until", at(until).isoformat()).load().writeStream.format("parquet")
        stream = stream.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint"))
        stream.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.distinct().count() == 2 * 55


def test_a_failing_fetch_is_an_error(spark):
    def broken(app, since, until):
        raise ConnectionError("service is away")

    fetch.register_source(spark, "broken", broken, "app string, ts timestamp")
    with pytest.raises(Exception, match="service is away"):
        spark.read.format("broken").option("apps", "x").load().count()
