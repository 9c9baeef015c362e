from datetime import datetime

import pytest
from pyspark.sql import functions as F

from faultfold.functions import text
from faultfold.sources import logs


def values(spark, column, rows):
    df = spark.createDataFrame([(r,) for r in rows], "c string")
    return [r[0] for r in df.select(column(F.col("c"))).collect()]


def test_normalize_line(spark):
    rows = ["  DB-Timeout: 30s!! ", "a\tb\n\nc", "Größe 5", "İstanbul", "***", ""]
    assert values(spark, text.normalize_line, rows) == [
        "db timeout 30s",
        "a b c",
        "gr e 5",
        "istanbul",
        "",
        "",
    ]


def test_fingerprint_hash_of_known_text(spark):
    import hashlib

    df = spark.createDataFrame([("app", "ERROR: db  timeout")], "a string, c string")
    got = df.select(text.fingerprint_hash(F.col("a"), F.col("c"))).first()[0]
    assert got == hashlib.sha256(b"app|error db timeout").hexdigest()


def test_infer_severity_first_hit_wins(spark):
    rows = ["Fatal error", "PANIC", "an Exception", "failed", "Warning: x", "all fine", ""]
    assert values(spark, text.infer_severity, rows) == [
        "CRITICAL",
        "CRITICAL",
        "ERROR",
        "ERROR",
        "WARNING",
        "ERROR",
        "ERROR",
    ]


def test_split_severity(spark):
    rows = ["ERROR  two spaces", "warning x", "WARN x", "FATAL x", "ERROR", "critical: x", "Debug "]
    got = values(spark, text.split_severity, rows)
    assert [tuple(g) for g in got] == [
        ("ERROR", " two spaces"),
        ("WARNING", "x"),
        ("WARN", "x"),
        ("ERROR", "FATAL x"),
        ("ERROR", "ERROR"),
        ("ERROR", "critical: x"),
        ("DEBUG", ""),
    ]


def test_normalize_severity(spark):
    rows = ["critical", "Fatal", "HIGH", "error", "warn", "WARNING", "medium", "low", "ALERT", ""]
    expected = ["critical"] * 2 + ["high"] * 2 + ["medium"] * 3 + ["low"] * 3
    assert values(spark, text.normalize_severity, rows) == expected


def test_raw_line_of_missing_time(spark):
    df = spark.createDataFrame([(None, "ERROR", "m")], "ts timestamp, s string, m string")
    line = df.select(text.raw_line(F.col("ts"), F.col("s"), F.col("m"))).first()[0]
    assert line == "[0001-01-01T00:00:00Z] ERROR m"


def test_hash_modes(spark):
    df = spark.createDataFrame(
        [("a", "m", "[t] ERROR m", "", "fp")],
        "app string, message string, raw_line string, dedupe_key string, fingerprint string",
    )
    modes = ["dedupe_text", "message", "fingerprint"]
    got = {text.with_fingerprint(df, m).first()["fingerprint_hash"] for m in modes}
    assert len(got) == 3
    with pytest.raises(ValueError):
        text.with_fingerprint(df, "other")


def test_read_text_logs(spark, tmp_path):
    file = tmp_path / "app.log"
    file.write_text("\n# note\n  ERROR db down \nplain\r\n warn slow \n\n")
    rows = logs.read_text_logs(spark, str(file), "web", F.lit("2024-01-01").cast("timestamp"))
    got = rows.orderBy("arrival_seq").collect()
    assert [(r.severity, r.message, r.dedupe_key) for r in got] == [
        ("ERROR", "db down", "ERROR db down"),
        ("ERROR", "plain", "plain"),
        ("WARN", "slow", "warn slow"),
    ]
    assert got[0].raw_line == "[2024-01-01T00:00:00Z] ERROR db down"
    assert {r.app for r in got} == {"web"}


def test_text_log_without_entries_is_an_error(spark, tmp_path):
    file = tmp_path / "empty.log"
    file.write_text("# only a note\n\n")
    with pytest.raises(ValueError):
        logs.read_text_logs(spark, str(file), "web", F.current_timestamp())


def test_fetch_filter_reaches_the_scan(spark, data):
    from faultfold.plans import views as given

    fetched = logs.fetch_since(
        given.logs(spark, data), F.lit("2024-01-20").cast("timestamp"), 3600, "event_records"
    )
    plan = fetched._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan


def test_fetch_bounds(spark):
    rows = [(i, datetime(2024, 1, 1, 0, 0, s, us)) for i, (s, us) in enumerate(
        [(10, 0), (10, 500), (9, 999999), (11, 0)])]
    df = spark.createDataFrame(rows, "id int, ts timestamp")
    as_of = F.lit("2024-01-01 00:00:30.0007").cast("timestamp")

    def ids(mode, interval):
        return {r.id for r in logs.fetch_since(df, as_of, interval, mode).collect()}

    assert ids("event_records", 10) == {0, 1, 3}
    assert ids("structured", 10) == {1, 3}
    assert ids("structured", 0) == {0, 1, 2, 3}


def test_union_keeps_duplicates(spark):
    a = spark.createDataFrame([("x", 1)], "app string, arrival_seq bigint")
    b = spark.createDataFrame([("x",)], "app string")
    assert logs.union_sources(a, a, b).count() == 3
