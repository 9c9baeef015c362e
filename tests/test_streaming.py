import time

import pytest
from pyspark.sql import functions as F

from faultfold.operators import tickets
from faultfold.operators.classify import occurrences_of
from faultfold.plans import views as given
from faultfold.sources.logs import dedupe_overlap
from faultfold.sources.messages import read_ticket_messages
from faultfold.sources.tickets import TicketTable
from faultfold.streaming import pipeline


def poll_batches(df, interval_s):
    """Each row once per overlapping poll that would fetch it, with the poll's time."""
    polls = F.window("ts", f"{2 * interval_s} seconds", f"{interval_s} seconds")
    return df.withColumn("_poll", polls).withColumn("poll_ts", F.col("_poll.end")).drop("_poll")


def landed(spark, data, path, parts=4):
    """Log entries as files that arrive one after the other."""
    entries = given.logs(spark, data)
    edges = entries.approxQuantile("arrival_seq", [i / parts for i in range(1, parts)], 0.0)
    bounds = [-1.0, *edges, float("inf")]
    for low, high in zip(bounds, bounds[1:]):
        part = entries.filter((F.col("arrival_seq") > low) & (F.col("arrival_seq") <= high))
        part.coalesce(1).write.mode("append").parquet(path)
    return entries


def stream_of(spark, entries, path):
    return (
        spark.readStream.schema(entries.schema)
        .option("maxFilesPerTrigger", 1)
        .option("latestFirst", "false")
        .parquet(path)
    )


def same(left, right):
    return left.count() == right.count() and left.exceptAll(right).count() == 0


def test_stream_equals_batch_over_several_batches(spark, data, tmp_path):
    entries = landed(spark, data, str(tmp_path / "in"))
    table = TicketTable(spark, str(tmp_path / "tickets"))
    stream = stream_of(spark, entries, str(tmp_path / "in"))
    query = pipeline.stream_tickets(
        stream, table, str(tmp_path / "cp"), "logs", available_now=True
    )
    query.awaitTermination()
    assert len(query.recentProgress) >= 4
    batch = tickets.upsert_tickets(occurrences_of(entries))
    assert same(table.read(), batch.select(*tickets.COLUMNS))
    day = batch.first().created_date
    assert same(table.read([day]), batch.filter(F.col("created_date") == day))


def test_publish_once_and_mark_failures(spark, data, tmp_path):
    entries = landed(spark, data, str(tmp_path / "in"), 2)
    table = TicketTable(spark, str(tmp_path / "tickets"))
    queue = str(tmp_path / "queue")
    stream = stream_of(spark, entries, str(tmp_path / "in"))
    step = pipeline.fold_and_publish(table, "logs", queue)
    pipeline.start_ingest(stream, step, str(tmp_path / "cp"), available_now=True).awaitTermination()
    ok, rejects = read_ticket_messages(
        spark.read.option("recursiveFileLookup", "true").text(queue), "value"
    )
    assert rejects.count() == 0
    assert ok.count() == ok.select("ticket_id").distinct().count() == table.read().count()
    assert table.read().filter("message_id = ''").count() == 0

    before = table.read().collect()
    query_batches = len(list((tmp_path / "queue/logs").glob("batch=*")))
    assert query_batches == 2 and sorted(table.read().collect()) == sorted(before)


def test_failed_publish_leaves_tickets_pending(spark, data, tmp_path):
    table = TicketTable(spark, str(tmp_path / "tickets"))

    def send(messages):
        failed = F.col("ticket_id") % 2 == 0
        return messages.select(
            "ticket_id",
            F.when(~failed, F.concat(F.lit("m"), F.col("ticket_id").cast("string"))).alias(
                "message_id"
            ),
            F.when(failed, "down").alias("error"),
        )

    step = pipeline.fold_and_publish(table, "logs", str(tmp_path / "q"), send=send)
    step(given.logs(spark, data), 0)
    rows = table.read().collect()
    assert {(r.id % 2, r.status) for r in rows} == {(0, "pending"), (1, "open")}
    assert all(r.message_id == (f"m{r.id}" if r.id % 2 else "") for r in rows)


def test_repeated_batch_changes_nothing(spark, data, tmp_path):
    table = TicketTable(spark, str(tmp_path / "tickets"))
    occ = occurrences_of(given.logs(spark, data))
    table.upsert(occ, 0, "a")
    first = sorted(table.read().collect())
    table.upsert(occ, 0, "a")
    assert sorted(table.read().collect()) == first
    restarted = TicketTable(spark, str(tmp_path / "tickets"))
    restarted.upsert(occ, 0, "a")
    assert sorted(restarted.read().collect()) == first
    restarted.upsert(occ, 1, "a")
    assert sum(r.occurrence_count for r in restarted.read().collect()) == 2 * occ.count()
    assert restarted.created_in(1, "a").count() == 0
    assert restarted.created_in(0, "a").count() == len(first)
    with pytest.raises(ValueError, match="is at batch 1"):
        restarted.upsert(occ, 0, "a")


def test_two_writers_share_a_table(spark, data, tmp_path):
    """Batches with equal ids of two streams, a state and a compaction between them: nothing is lost."""
    table = TicketTable(spark, str(tmp_path / "tickets"))
    occ = occurrences_of(given.logs(spark, data))
    parts = [occ.filter(F.col("arrival_seq") % 4 == k) for k in range(4)]
    table.upsert(parts[0], 0, "a")
    table.upsert(parts[1], 0, "b")
    table.set_status(spark.createDataFrame([(1, "in_progress")], "ticket_id bigint, status string"), 0, "s")
    table.upsert(parts[2], 1, "a")
    before = sorted(table.read().collect())
    table.compact()
    assert sorted(table.read().collect()) == before
    table.upsert(parts[3], 1, "b")
    table.upsert(parts[3].limit(0), 1, "s2")
    table.compact()
    rows = table.read().collect()
    assert sum(r.occurrence_count for r in rows) == occ.count()
    assert sorted(r.id for r in rows) == list(range(1, len(rows) + 1))
    assert {r.id for r in rows if r.status != "open"} == {1}


def test_interrupted_batch_is_redone(spark, data, tmp_path, monkeypatch):
    """A batch that fails before it is complete leaves the table as it was."""
    table = TicketTable(spark, str(tmp_path / "tickets"))
    occ = occurrences_of(given.logs(spark, data))
    table.upsert(occ.filter("arrival_seq < 400"), 0, "a")
    before = sorted(table.read().collect())
    late = occ.filter("arrival_seq >= 400")

    def fail(*args, **kwargs):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(TicketTable, "_write", fail)
        with pytest.raises(RuntimeError):
            table.upsert(late, 1, "a")
    (tmp_path / "tickets/log/000000000002,a,1").mkdir()
    assert sorted(table.read().collect()) == before
    table.upsert(late, 1, "a")
    assert same(table.read(), tickets.upsert_tickets(occ))


def test_status_stream(spark, data, tmp_path):
    """Done only once every action is done, over batches; failed and delivered again in progress."""
    table = TicketTable(spark, str(tmp_path / "tickets"))
    table.upsert(occurrences_of(given.logs(spark, data)), 0, "a")
    apps = {r.id: r.app for r in table.read().collect()}
    actions = spark.createDataFrame(
        [(apps[1], 1), (apps[1], 2), (apps[2], 1), (apps[2], 2)], "app string, pos int"
    ).distinct()
    schema = "ticket_id bigint, attempt bigint, pos int, status string"
    events = str(tmp_path / "events")
    rounds = [
        [(1, 1, 1, "processing"), (2, 1, 1, "processing"), (1, 1, 1, "done")],
        [(2, 1, 1, "failed"), (0, 1, 1, "done")],
        [(1, 1, 2, "processing"), (1, 1, 2, "done"), (2, 2, 1, "processing"), (99999999, 1, 1, "done")],
    ]
    seen = []
    for rows in rounds:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(events)
        stream = spark.readStream.schema(schema).parquet(events)
        pipeline.stream_status(stream, table, actions, str(tmp_path / "cp"), True).awaitTermination()
        by_id = {r.id: r.status for r in table.read().collect()}
        seen.append((by_id[1], by_id[2], by_id[3]))
    assert seen == [
        ("in_progress", "in_progress", "open"),
        ("in_progress", "failed", "open"),
        ("done", "in_progress", "open"),
    ]


def test_closed_tickets_stay_closed_across_batches(spark, data, tmp_path):
    table = TicketTable(spark, str(tmp_path / "tickets"))
    occ = occurrences_of(given.logs(spark, data))
    table.upsert(occ, 0, "a")
    table.set_status(table.read().select(F.col("id").alias("ticket_id"), F.lit("done").alias("status")), 0, "s")
    table.upsert(occ, 1, "a")
    rows = table.read().collect()
    assert {r.status for r in rows} == {"done"}
    assert sum(r.occurrence_count for r in rows) == occ.count()


def test_message_ids_are_unique_over_batches(spark, data, tmp_path):
    table = TicketTable(spark, str(tmp_path / "tickets"))
    step = pipeline.fold_and_publish(table, "logs", str(tmp_path / "q"))
    entries = given.logs(spark, data)
    step(entries.filter("arrival_seq < 400"), 0)
    step(entries.filter("arrival_seq >= 400"), 1)
    ids = [r.message_id for r in table.read().collect()]
    assert len(set(ids)) == len(ids) and "" not in ids


def test_overlap(spark, data, tmp_path):
    entries = given.logs(spark, data)
    polled = poll_batches(entries, 3600)
    assert polled.count() == 2 * entries.count()
    assert dedupe_overlap(polled, ["app", "arrival_seq"]).count() == entries.count()

    path = str(tmp_path / "in")
    polled.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(polled.schema).parquet(path)
    seen = []
    query = pipeline.start_ingest(
        dedupe_overlap(stream, ["app", "arrival_seq"], "3 hours"),
        lambda batch, _: seen.append(batch.count()),
        str(tmp_path / "cp"),
        available_now=True,
    )
    query.awaitTermination()
    assert sum(seen) == entries.count()


def test_late_lines_join_the_day_of_arrival(spark, tmp_path):
    rows = spark.sql(
        "select 'a' app, timestamp'2024-01-01 10:00:00' ts, 'E' severity, 'm' message, "
        "'l' raw_line, 'k' dedupe_key, timestamp'2024-01-03 10:00:00' arrival_ts, 1L arrival_seq"
    )
    table = TicketTable(spark, str(tmp_path / "arrival"))
    pipeline.fold_batch(table, "logs")(rows, 0)
    row = table.read().first()
    assert row.created_date == "2024-01-03" and row.first_seen.day == 1
    own = TicketTable(spark, str(tmp_path / "event"))
    pipeline.fold_batch(own, "logs", day_basis="event")(rows, 0)
    assert own.read().first().created_date == "2024-01-01"


def test_poll_status(spark):
    polls = spark.createDataFrame(
        [("a", None, 1, None), ("a", None, 2, "network")],
        "app string, poll_ts timestamp, seq bigint, fetch_error string",
    )
    got = pipeline.poll_status(polls).orderBy("arrival_seq").collect()
    assert [(r.status, r.error_msg) for r in got] == [
        ("polling", ""), ("idle", ""), ("polling", ""), ("error", "fetch error: network"),
    ]


def test_stream_text_logs(spark, tmp_path):
    from faultfold.sources.logs import stream_text_logs

    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("ERROR db down\n# x\nplain\n")
    table = TicketTable(spark, str(tmp_path / "t"))
    stream = stream_text_logs(spark, str(folder), "web", F.current_timestamp())
    pipeline.stream_tickets(
        stream, table, str(tmp_path / "cp"), "logs", available_now=True
    ).awaitTermination()
    got = {r.raw_log.split("] ")[1]: r.classification for r in table.read().collect()}
    assert got == {"ERROR db down": "database_connection_timeout", "ERROR plain": "unknown_error"}


def commits(table):
    return [(c.number, c.writer, c.batch) for c in table._commits()]


def test_an_idle_writer_does_not_stop_compaction(spark, data, tmp_path):
    """Commits are added up whoever wrote them; a batch that is run again afterwards changes nothing."""
    entries = occurrences_of(given.logs(spark, data))
    parts = [entries.filter(F.col("arrival_seq") % 6 == k) for k in range(6)]
    table = TicketTable(spark, str(tmp_path / "t"))
    table.upsert(parts[0], 0, "old")
    for k in range(1, 5):
        table.upsert(parts[k], k, "live")
    before = table.read()
    rows = sorted(before.collect())
    table.compact()
    assert sorted(table.read().collect()) == rows
    table.upsert(parts[0], 0, "old")  # both writers' last batches once more
    table.upsert(parts[4], 4, "live")
    assert sorted(table.read().collect()) == rows
    table.upsert(parts[5], 5, "live")
    table.set_status(table.read().select(F.col("id").alias("ticket_id"), F.lit("done").alias("status")).limit(3), 0, "old.status")
    table.compact()
    assert table._live(table._commits())[0].writer == "base" and len(table._live(table._commits())) == 1
    left = commits(table)
    assert (1, "old", 0) in left and not [c for c in left if c[1] == "live" and c[2] < 5 and c[0] <= 4]
    assert table.read().agg(F.sum("occurrence_count")).first()[0] == entries.count()
    assert table.read().filter("status = 'done'").count() == 3
    ids = [r.id for r in table.read().collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))


def test_a_batch_reads_its_own_days_of_a_compacted_table(spark, tmp_path):
    """Row groups of other days and ids are passed over by their statistics."""
    import glob

    import pyarrow.parquet as pq

    table = TicketTable(spark, str(tmp_path / "t"))
    keys = spark.range(6000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("fingerprint_hash"),
        F.lit("app").alias("app"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 200).cast("int")), "yyyy-MM-dd").alias("created_date"),
        F.lit("line").alias("raw_line"), F.lit("").alias("dedupe_key"),
        F.current_timestamp().alias("ts"), F.current_timestamp().alias("arrival_ts"),
        F.col("id").alias("arrival_seq"),
    )
    for batch in range(2):
        table.upsert(keys.filter(F.col("arrival_seq") % 2 == batch), batch, "w")
    table.compact()
    base = table._live(table._commits())[0]
    files = glob.glob(f"{table._folder(base.number, base.writer, base.batch)}/*.parquet")
    days = sorted(pq.read_table(f, columns=["created_date"]).column(0).to_pylist() for f in files)
    days = [part for part in days if part]
    assert all(part == sorted(part) for part in days)
    assert all(x[-1] <= y[0] for x, y in zip(days, days[1:])) and sum(map(len, days)) == 6000
    near = table._changes(table._commits()).filter(F.col("created_date").between("2024-01-03", "2024-01-03"))
    assert "PushedFilters: [IsNotNull(created_date), GreaterThanOrEqual(created_date" in near._sc._jvm.PythonSQLUtils.explainString(
        near._jdf.queryExecution(), "formatted"
    )


def test_polled_lines_count_once_by_default(spark, data, tmp_path):
    entries = landed(spark, data, str(tmp_path / "in"), 2)
    entries.limit(30).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # the next poll delivers them again
    options = {"available_now": True, "interval_s": 10**6}
    for keys, name, extra in ((None, "once", 0), ([], "all", 30)):
        table = TicketTable(spark, str(tmp_path / name))
        stream = stream_of(spark, entries, str(tmp_path / "in"))
        pipeline.stream_tickets(
            stream, table, str(tmp_path / f"{name}-cp"), "w", overlap_keys=keys, **options
        ).awaitTermination()
        assert table.read().agg(F.sum("occurrence_count")).first()[0] == entries.count() + extra


def test_states_survive_a_restart_and_read_their_days_only(spark, data, tmp_path):
    from faultfold.streaming import state

    entries = landed(spark, data, str(tmp_path / "in"), 3)
    for _ in range(2):  # the second run finds nothing new
        state.stream_states(
            stream_of(spark, entries, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True
        ).awaitTermination()
    batch = tickets.upsert_tickets(occurrences_of(entries))
    assert same(state.read_states(spark, str(tmp_path / "out")).select(*tickets.COLUMNS), batch.select(*tickets.COLUMNS))
    day = batch.first().created_date
    one = state.read_states(spark, str(tmp_path / "out"), [day])
    assert one.count() == batch.filter(F.col("created_date") == day).count()
    plan = one._sc._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")
    assert "PartitionFilters" in plan


def test_a_source_is_polled_and_its_errors_are_told(spark, data, tmp_path):
    """polling, error, polling, idle: the poll that fails is not processed, the next one is."""
    from faultfold.streaming import polls

    entries, seen = given.logs(spark, data).limit(5), []

    def answer(batch):
        if not seen:
            seen.append("failed")
            raise TimeoutError("no answer")
        return entries

    step = polls.poll_step(spark, polls.Source("shop", answer), lambda b, k: seen.append((k, b.count())), str(tmp_path / "s"))
    for batch_id in range(2):
        step(entries, batch_id)
    told = polls.read_poll_status(spark, str(tmp_path / "s")).orderBy("arrival_seq").collect()
    assert [(r.app, r.status, r.error_msg) for r in told] == [
        ("shop", "polling", ""), ("shop", "error", "fetch error: no answer"), ("shop", "polling", ""), ("shop", "idle", ""),
    ]
    assert seen == ["failed", (1, 5)] and told[1].last_poll is not None and told[0].last_poll is None


def test_configured_sources_are_polled_at_their_own_interval(spark, data, tmp_path):
    from faultfold.streaming import polls

    entries, seen = given.logs(spark, data).limit(3), []
    sources = [polls.Source("a", lambda batch: entries, 1), polls.Source("b", lambda batch: entries, 1)]
    queries = polls.start_polls(
        spark, sources, lambda app: lambda batch, k: seen.append(app), str(tmp_path / "s"), str(tmp_path / "cp")
    )
    try:
        for _ in range(300):  # the clock never ends, so the queries are watched
            if set(seen) == {"a", "b"}:
                break
            time.sleep(0.5)
    finally:
        for query in queries:
            query.stop()
    assert set(seen) == {"a", "b"}
    assert polls.read_poll_status(spark, str(tmp_path / "s")).select("app").distinct().count() == 2


def test_late_rows_are_kept_apart_and_again_on_a_second_run(spark, tmp_path):
    from datetime import datetime, timedelta

    from faultfold.streaming import state

    start, kept = datetime(2024, 1, 10), {}
    make = lambda hours: spark.createDataFrame([(start + timedelta(hours=h),) for h in hours] + [(None,)], "ts timestamp")
    step = state.late_rows(spark, str(tmp_path / "l"), lambda b, k: kept.update({k: b.count()}), 3600)
    for batch_id, hours in ((0, [5, 1]), (1, [9, 4.5, 3]), (2, [7, 8.5]), (1, [9, 4.5, 3])):
        step(make(hours), batch_id)
    late = {(r.batch, (r.ts - start).total_seconds() / 3600) for r in state.read_late(spark, str(tmp_path / "l")).collect()}
    assert late == {(1, 3.0), (2, 7.0)} and kept == {0: 3, 1: 3, 2: 2}
