"""The queue over time: depth at every tick, redelivery, and the exactly-once sink."""

import json
from collections import Counter
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from faultfold.operators import delivery, work
from faultfold.plans import catalog
from faultfold.plans import views as given
from faultfold.sources import sink


def test_series_equals_depth_at_each_tick(spark):
    rows, start = [], datetime(2024, 1, 1, tzinfo=timezone.utc)
    kinds = ["published", "received", "failed", "mismatched", "received", "deleted", "odd"]
    for message in range(40):
        for seq in range(1, 2 + message % 7):
            late = (message * 37 + seq * (53 if message % 3 else -29)) % 900  # times need not follow the sequence
            rows.append((message, kinds[(message + seq) % 7], start + timedelta(seconds=late), seq))
    rows.append((None, "published", start + timedelta(seconds=100), 1))
    log = spark.createDataFrame(rows, "message_id long, kind string, ts timestamp, seq long")
    clean = log.filter("kind <> 'odd'")
    series = delivery.depth_series(clean, start, start + timedelta(seconds=1000), 100).collect()
    assert sorted(r.as_of for r in series) == [datetime(2024, 1, 1) + timedelta(seconds=100 * k) for k in range(11)]
    for r in series:
        one = delivery.queue_depth(clean, F.lit(r.as_of).cast("timestamp")).first()
        assert (r.visible, r.in_flight) == tuple(one)
    assert delivery.depth_series(clean.limit(0), start, start, 10).collect()[0][1:] == (0, 0)


def test_a_queue_is_tried_without_limit_until_it_is_empty(spark, data):
    queue = catalog.queued(spark, data).filter("message_id in (3, 5, 6)")
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    log = queue.select("message_id", F.lit("published").alias("kind"), F.lit(start).alias("ts"), F.lit(1).cast("long").alias("seq"))
    apps = given.actions(spark, data).select("app").distinct()
    fn = lambda ticket, action: 1 / (ticket["attempt"] > ticket["id"])  # noqa: E731 - fails as often as the id says
    ticks = [start + timedelta(seconds=31 * k) for k in range(9)]
    log, runs = work.work_queue(queue, log, apps, given.actions(spark, data), lambda t, a: str(fn(t, a)), ticks)
    tries = {r.message_id: r.n for r in log.filter("kind = 'received'").groupBy("message_id").agg(F.count("*").alias("n")).collect()}
    assert tries == {3: 4, 5: 6, 6: 7}
    assert delivery.delivery_state(log).filter("kind <> 'deleted'").isEmpty()
    assert runs.filter("failed").groupBy("message_id").count().count() == 3


START = datetime(2024, 1, 1, tzinfo=timezone.utc)
TICKS = [START + timedelta(seconds=n) for n in (0, 20, 40, 40, 75, 400, 800)]


def odd_queue():
    """Messages and a log: shared ids, no id, no body, no log, entries between and after the ticks."""

    def body(ticket, app="a"):
        return json.dumps({"ticket_id": ticket, "app_name": app, "first_seen": "2024-01-01T00:00:00Z"})

    a, z, b = {"AppName": "a"}, {"AppName": "z"}, {"AppName": "b"}
    queue = [(k, body(k), [a, z, b, None][k % 4]) for k in range(1, 25)]
    queue += [(30, body(3), a), (30, body(3), a), (31, body(2), a), (31, body(5), a), (32, body(1), z), (32, body(1), z)]
    queue += [(33, "{", a), (33, body(8), a), (34, "{", z), (35, "{", a), (36, None, a), (37, None, z), (38, "{}", None)]
    queue += [(39, None, None), (39, body(2), a), (40, "null", a), (None, body(2), a), (41, body(2), a), (42, body(11), a)]
    queue += [(50, body(2), a), (51, body(2), a), (52, body(2), a), (53, body(2), z), (54, body(2), a), (55, body(2), a)]

    def at(n):
        return START + timedelta(seconds=n)

    log = [(m, "published", at(-60), 1) for m in [*range(1, 25), *range(30, 41), None, 99]]
    log += [(42, "received", at(-90 * k), 9 - k) for k in range(5)] + [(42, "failed", at(5), 10)]
    log += [(50, "published", at(50), 1), (51, "published", at(-9), 1), (51, "deleted", at(60), 2), (51, "failed", at(70), 3)]
    log += [(52, "published", at(30), 4), (52, "received", at(35), 3), (53, "odd", at(-5), 2), (53, "published", at(41), 3)]
    log += [(54, "received", at(-9), 1), (55, "published", None, 1), (55, "published", at(-9), None), (55, "mismatched", at(900), 3)]
    return queue, log


def worked_off(queue, log, ticks):
    """The log and the runs, message by message; an action fails while the attempt is at most ``ticket % 4``."""
    log, runs = list(log), []
    for tick in sorted(ticks):
        states, received, last = {}, Counter(), {}
        for m, kind, ts, seq in log:
            received[m] += kind == "received"
            last[m] = max(last.get(m, 0), seq or 0)
            if ts is not None and ts <= tick and seq is not None:
                states[m] = max(states.get(m, (0, "", ts)), (seq, kind, ts))
        hidden = delivery.HIDDEN_SECONDS
        due = {m for m, (_, k, ts) in states.items() if k in hidden and ts + timedelta(seconds=hidden[k]) <= tick}
        ended = {}
        for m, body, attributes in [q for q in queue if q[0] in due and q[0] is not None]:
            log.append((m, "received", tick, last[m] + 1))
            if attributes and attributes["AppName"] == "z":
                log.append((m, "mismatched", tick, last[m] + 2))
            elif body == "{":
                log.append((m, "deleted", tick, last[m] + 2))
            elif body is not None:
                fields = json.loads(body) or {}
                ticket, app = fields.get("ticket_id", 0), (attributes or {}).get("AppName", fields.get("app_name", ""))
                ok = received[m] + 1 > ticket % 4 or app != "a"
                runs += [(m, ticket, received[m] + 1, 1, False)] * (app == "a")
                runs += [(m, ticket, received[m] + 1, 2, not ok)] * (app == "a")
                ended[m, ticket] = ended.get((m, ticket), True) and ok
        log += [(m, "deleted" if ok else "failed", tick, last[m] + 2) for (m, _), ok in ended.items()]
    return log, runs


def test_an_odd_queue_is_worked_off_as_message_by_message(spark):
    queue, log = odd_queue()
    columns = "message_id bigint, body string, attributes map<string,string>"
    given_log = spark.createDataFrame(log, "message_id bigint, kind string, ts timestamp, seq bigint")
    steps = spark.createDataFrame(
        [("a", 1, "webhook", "one", "u", "c"), ("a", 2, "webhook", "two", "u", "c"), ("z", 1, "webhook", "", "u", "c")],
        "app string, pos int, type string, name string, url string, command string",
    )

    def fn(ticket, action):
        # Not one key more, and every field of the ticket however often it comes back.
        assert set(ticket) == {"message_id", "attempt", *work.OF_TICKET}
        assert str(ticket["first_seen"])[:4] == ("2024" if ticket["id"] else "NaT")
        return str(1 // (action["pos"] == 1 or ticket["attempt"] > ticket["id"] % 4))

    apps = spark.createDataFrame([("a",), ("b",), ("a",)], "app string")
    got, runs = work.work_queue(spark.createDataFrame(queue, columns), given_log, apps, steps, fn, TICKS)
    expected, expected_runs = worked_off(queue, log, TICKS)

    def plain(rows):
        return Counter((m, k, ts and ts.replace(tzinfo=None), seq) for m, k, ts, seq in rows)

    assert plain(got.select("message_id", "kind", "ts", "seq").collect()) == plain(expected)
    names = ["message_id", "ticket_id", "attempt", "pos", "failed"]
    assert Counter(tuple(r) for r in runs.select(names).collect()) == Counter(expected_runs)
    assert {r.err_msg for r in runs.filter("failed").collect()} == {"integer division or modulo by zero"}
    none, _ = work.work_queue(spark.createDataFrame(queue, columns), given_log, apps, steps, fn, [])
    assert plain(none.collect()) == plain(log)


def test_a_repeated_task_and_batch_leave_each_message_once(spark, tmp_path):
    writer = sink.MessageWriter(str(tmp_path), 0)
    rows = [(f"m{k}",) for k in range(6)]
    lost = writer.write(iter(rows[:3]))  # its task was counted as failed
    good = [writer.write(iter(rows[:3])), writer.write(iter(rows[3:])), writer.write(iter([]))]
    writer.commit(good, 0)
    assert sorted(r.value for r in sink.written_messages(spark, str(tmp_path)).collect()) == [r[0] for r in rows]
    writer.commit([writer.write(iter(rows)), None], 0)  # the batch again
    writer.commit([writer.write(iter([("n",)]))], 1)
    aborted = writer.write(iter([("x",)]))
    writer.abort([aborted, None], 2)
    got = sorted((r.batch, r.value) for r in sink.written_messages(spark, str(tmp_path)).collect())
    assert got == [(0, r[0]) for r in rows] + [(1, "n")]
    assert lost.file and not (tmp_path / "messages" / aborted.file).exists()
