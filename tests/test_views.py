import random

import pytest

from faultfold.operators import views
from faultfold.operators.recent import listed_tickets
from faultfold.plans import views as given
from faultfold.sources.records import log_records
from faultfold.sources.tickets import as_tickets, backfill_created_date, load_tickets, save_tickets


def records(spark):
    attrs = "attrs array<struct<key:string,value:string>>"
    rows = [
        ("INFO", None, "Polled", [("app", "shop")], [("n", "5")], 1),
        ("ERROR", None, "Fetch FAILED", [("source", "aws")], [("app", "shop"), ("worker", "w")], 2),
        ("INFO", None, "idle", None, None, 3),
    ]
    df = spark.createDataFrame(
        rows,
        "level string, time timestamp, message string, "
        f"{attrs.replace('attrs', 'prelude')}, {attrs}, seq bigint",
    )
    return log_records(df)


def test_record_search(spark):
    df = records(spark)

    def found(level=None, text=None):
        return {r.seq for r in views.search_records(df, level, text).collect()}

    assert found() == {1, 2, 3}
    assert found("INFO") == {1, 3}
    assert found(None, "failed source=AWS") == {2}
    assert found("INFO", "app=shop n=5") == {1}
    assert found("ERROR", "app=shop n=5") == set()
    counts = views.search_counts(df, None, "shop").first()
    assert (counts.matches, counts.total) == (2, 3)


def test_record_component(spark):
    from pyspark.sql import functions as F

    from faultfold.functions.records import record_component

    got = records(spark).select("seq", record_component(F.col("attrs")).alias("c")).collect()
    assert {r.seq: r.c for r in got} == {1: "shop", 2: "src:aws", 3: ""}


def test_active_tickets_is_a_top_k(spark, data):
    active = views.active_tickets(given.tickets(spark, data), 10)
    assert "TakeOrderedAndProject" in active._jdf.queryExecution().executedPlan().toString()
    rows = active.collect()
    assert [(-r.last_seen.timestamp(), r.id) for r in rows] == sorted(
        (-r.last_seen.timestamp(), r.id) for r in rows
    )
    assert "done" not in {r.status for r in rows}


def test_recent_per_ticket_limits_before_the_shuffle(spark, data):
    recent = views.recent_events_per_ticket(given.worker_events(spark, data), 3)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_ticket_detail_keeps_the_newest(spark):
    from datetime import datetime

    events = spark.createDataFrame(
        [(1, s, datetime(2024, 1, 1), "done" if s < 30 else "failed", f"a{s}", f"out{s}" if s < 8 else "")
         for s in range(40)] + [(0, 1, datetime(2024, 1, 1), "done", "x", "y")],
        "ticket_id bigint, seq bigint, ts timestamp, status string, action_name string, output string",
    )
    tickets = spark.createDataFrame([(1,), (2,), (0,)], "id bigint")
    detail = {r.id: r for r in views.ticket_detail(tickets, events).collect()}
    assert [e.seq for e in detail[1].events] == list(range(20, 40))
    assert detail[1].last_output is None
    assert detail[2].events is None and detail[0].events is None
    wide = {r.id: r for r in views.ticket_detail(tickets, events, 40).collect()}
    assert wide[1].last_output == "out7"
    assert {r.ticket_id: r.last_output for r in views.last_output(events).collect()} == {
        1: "out7", 0: "y",
    }


def test_overview_lists_configured_apps(spark):
    apps = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "ord int, name string")
    statuses = spark.createDataFrame(
        [("a", "polling", "", 1), ("a", "error", "fetch error: x", 2), ("z", "idle", "", 3),
         ("b", "error", "y", 1), ("b", "idle", "", 4)],
        "app string, status string, error_msg string, arrival_seq bigint",
    )
    got = views.app_overview(apps, statuses).collect()
    assert [tuple(r) for r in got] == [
        (1, "a", "error", "fetch error: x"), (2, "b", "idle", ""), (3, "c", "idle", ""),
    ]


def test_stored_tickets(spark, data, tmp_path):
    rows = given.tickets(spark, data).filter("created_date < '1995-04-01'")
    path = str(tmp_path / "tickets")
    save_tickets(rows, path)
    back = load_tickets(spark, path)
    assert back.count() == rows.count() and back.exceptAll(rows).count() == 0
    day = rows.first().created_date
    save_tickets(rows.filter(rows.created_date == day).limit(1), path)
    left = load_tickets(spark, path)
    assert left.filter(left.created_date == day).count() == 1
    assert left.filter(left.created_date != day).count() == rows.filter(
        rows.created_date != day
    ).count()


def test_backfill(spark):
    df = spark.sql("select timestamp'2024-03-01 23:00:00' first_seen, '' created_date")
    assert backfill_created_date(df).first().created_date == "2024-03-01"
    assert backfill_created_date(df.drop("created_date")).first().created_date == "2024-03-01"
    kept = spark.sql("select timestamp'2024-03-01 23:00:00' first_seen, '2020-01-01' created_date")
    assert backfill_created_date(kept).first().created_date == "2020-01-01"


def test_unreadable_times_become_null(spark, data):
    from pyspark.sql import functions as F

    odd = given.tickets(spark, data).limit(3).withColumn("first_seen", F.lit("x")).withColumn(
        "message_id", F.lit(None).cast("string")
    )
    row = as_tickets(odd).first()
    assert row.first_seen is None and row.message_id == "" and row.last_seen is not None


@pytest.mark.parametrize("tickets, n", [(9, 8), (30, 5)])
def test_listed_tickets_return_after_they_fell_out(spark, tickets, n):
    """Against a list kept row by row; going round n + 1 tickets is the case where every row depends on the last one."""
    draw = random.Random(tickets)
    updates = [i % tickets if i < 60 else draw.choice([0, 1, 1, draw.randrange(tickets)]) for i in range(150)]
    listed = []
    for seq, ticket in enumerate(updates):
        if ticket != 0 and ticket not in [t for t, _ in listed]:
            listed = [(ticket, seq), *listed][:n]
    rows = [(t, 7 * s) for s, t in enumerate(updates)] + [(None, 2000)]
    df = spark.createDataFrame(rows, "ticket_id bigint, seq bigint")
    got = listed_tickets(df, n, block_bits=5).collect()
    assert [(r.ticket_id, r.seq // 7) for r in got] == listed
    assert listed_tickets(df.limit(0), n).collect() == []
