import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultfold import schemas
from faultfold.operators import scan, tickets

OCC = (
    "app string, fingerprint_hash string, created_date string, ts timestamp, raw_line string, "
    "arrival_ts timestamp, arrival_seq bigint, classification string, severity string, "
    "component string, fingerprint string"
)
LOG = (
    "app string, fingerprint_hash string, created_date string, arrival_seq bigint, status string"
)
CLOSED = ("done", "failed")
START = datetime(2024, 1, 1)


def stream(seed, n, first=0):
    """Random occurrences; one key holds about half of them."""
    rng = random.Random(seed)
    rows = []
    for seq in sorted(rng.sample(range(first, first + 3 * n), n)):
        arrival = START + timedelta(minutes=37 * seq, microseconds=seq)
        name = rng.choice(["hot"] * 5 + ["b", "c", "d", "e"])
        ts = None if rng.random() < 0.1 else arrival - timedelta(seconds=rng.randrange(100000))
        rows.append(
            ("app0" if name == "hot" else rng.choice(["app0", "app1"]), name,
             arrival.strftime("%Y-%m-%d"), ts, f"line {seq}", arrival, seq,
             f"class{seq}", "high", f"part{seq}", f"print{seq}")
        )
    return rows


def seconds(value):
    return value.replace(microsecond=0)


def sequential(rows, table, changes=()):
    """The fold one row at a time, with status changes in between."""
    table = {k: dict(v) for k, v in table.items()}
    next_id = max([t["id"] for t in table.values()], default=0) + 1
    events = [(2 * c[3], "status", c) for c in changes] + [(2 * r[6] + 1, "row", r) for r in rows]
    outcomes = {}
    for _, kind, item in sorted(events, key=lambda e: e[0]):
        key = item[:3]
        if kind == "status":
            if key in table:
                table[key]["status"] = item[4]
            continue
        app, hashed, day, ts, raw, arrival, seq, *labels = item
        ticket = table.get(key)
        if ticket is None:
            seen = seconds(ts or arrival)
            table[key] = dict(
                id=next_id, app=app, fingerprint_hash=hashed, created_date=day,
                classification=labels[0], severity=labels[1], component=labels[2],
                fingerprint_text=labels[3], raw_log=raw, first_seen=seen, last_seen=seen,
                occurrence_count=1, status="open", message_id="",
            )
            next_id += 1
            outcomes[seq] = (True, False, 1)
        elif ticket["status"] in CLOSED:
            outcomes[seq] = (False, True, ticket["occurrence_count"])
        else:
            ticket["occurrence_count"] += 1
            ticket["last_seen"] = seconds(arrival)
            ticket["raw_log"] = raw
            outcomes[seq] = (False, False, ticket["occurrence_count"])
    return table, outcomes


def by_key(df):
    return {(r.app, r.fingerprint_hash, r.created_date): r.asDict() for r in df.collect()}


def rows_of(table):
    return [tuple(t[c] for c in tickets.COLUMNS) for t in table.values()]


def known_table(seed):
    """A sequentially built table with mixed states."""
    table, _ = sequential(stream(seed, 120), {})
    rng = random.Random(seed)
    for ticket in table.values():
        ticket["status"] = rng.choice(schemas.TICKET_STATUSES)
        ticket["message_id"] = rng.choice(["", "m1"])
    return table


@pytest.fixture(params=[18, 3])
def blocks(request, monkeypatch):
    """The block scan with large and tiny blocks."""
    monkeypatch.setattr(scan, "BLOCK_BITS", request.param)
    monkeypatch.setattr(scan, "SUPER_BITS", 4)


def test_upsert_on_empty_table(spark, blocks):
    rows = stream(1, 200)
    expected, _ = sequential(rows, {})
    assert by_key(tickets.upsert_tickets(spark.createDataFrame(rows, OCC))) == expected


def test_upsert_on_known_tickets(spark, blocks):
    table = known_table(2)
    rows = stream(3, 200, first=300)
    expected, _ = sequential(rows, table)
    known = spark.createDataFrame(rows_of(table), schemas.TICKET)
    assert by_key(tickets.upsert_tickets(spark.createDataFrame(rows, OCC), known)) == expected


def test_occurrence_stream(spark, blocks):
    table = known_table(4)
    rows = stream(5, 200, first=300)
    _, expected = sequential(rows, table)
    known = spark.createDataFrame(rows_of(table), schemas.TICKET)
    got = tickets.occurrences(spark.createDataFrame(rows, OCC), known).collect()
    assert {r.arrival_seq: (r.is_new, r.skipped, r.occurrence_no) for r in got} == expected


def status_changes(seed, table, rows):
    """Random changes of tickets that exist by then."""
    rng = random.Random(seed)
    first = {}
    for row in rows:
        first.setdefault(row[:3], row[6])
    keys = sorted({*table, *first})
    used = set()
    changes = []
    for _ in range(150):
        key = rng.choice(keys)
        start = 300 if key in table else first[key] + 1
        seq = rng.randrange(start, start + 700)
        if (key, seq) not in used:
            used.add((key, seq))
            changes.append((*key, seq, rng.choice(["in_progress", "done", "failed", "pending"])))
    return changes


def test_upsert_with_changing_states(spark, blocks):
    table = known_table(6)
    rows = stream(7, 250, first=300)
    changes = status_changes(8, table, rows)
    expected, outcomes = sequential(rows, table, changes)
    occ = spark.createDataFrame(rows, OCC)
    known = spark.createDataFrame(rows_of(table), schemas.TICKET)
    log = spark.createDataFrame(changes, LOG)

    labelled = tickets.status_as_of(occ, log, known.select(*tickets.KEY, "status"))
    counted = {r.arrival_seq: r.counted for r in labelled.collect()}
    assert counted == {seq: not skipped for seq, (_, skipped, _) in outcomes.items()}
    assert by_key(tickets.upsert_with_status(occ, known, log)) == expected


def test_skip_and_new(spark):
    table = known_table(9)
    rows = stream(10, 150, first=300)
    _, outcomes = sequential(rows, table)
    occ = spark.createDataFrame(rows, OCC)
    known = spark.createDataFrame(rows_of(table), schemas.TICKET)
    kept = {r.arrival_seq for r in tickets.skip_closed(occ, known).collect()}
    assert kept == {seq for seq, (_, skipped, _) in outcomes.items() if not skipped}
    skips = sum(r.skipped for r in tickets.skipped_counts(occ, known).collect())
    assert skips == len(rows) - len(kept)
    new = {r.arrival_seq for r in tickets.new_tickets(occ, known).collect()}
    assert new == {seq for seq, (is_new, _, _) in outcomes.items() if is_new}


def test_late_and_early_labels_agree(spark, data):
    from faultfold.operators.classify import classify_by_rules, occurrences_of
    from faultfold.plans import views as given

    entries = given.logs(spark, data)
    late = tickets.fold_occurrences(occurrences_of(entries))
    early = tickets.fold_occurrences(occurrences_of(classify_by_rules(entries)))
    columns = [*tickets.KEY, "n", "first_seq", "first", "last"]
    assert late.select(*columns).exceptAll(early.select(*columns)).count() == 0
    assert late.count() == early.count()


def test_fold_reduces_before_the_shuffle(spark):
    occ = spark.createDataFrame(stream(1, 5), OCC)
    plan = tickets.fold_occurrences(occ)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count") > plan.index("Exchange hashpartitioning")
    assert plan.count("Exchange") == 1


def test_hot_rows_are_split_in_the_skip_join(spark):
    """With a hot key the join that drops occurrences of closed tickets is split at run time."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.shuffle.partitions": "8",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        occ = spark.range(0, 40000, 1, 8).selectExpr(
            "if(id % 3 = 0, 'hot', concat('k', id)) fingerprint_hash", "'a' app",
            "'2024-01-01' created_date", "id arrival_seq", "uuid() raw_line",
        )
        closed = spark.range(1000).selectExpr(
            "concat('k', id) fingerprint_hash", "'a' app", "'2024-01-01' created_date",
            "'done' status",
        )
        kept = tickets.skip_closed(occ, closed)
        assert kept.count() == 40000 - 666
        kept.write.format("noop").mode("overwrite").save()
        rows = kept.toPandas()
        assert len(rows) == 40000 - 666
        assert "isFinalPlan=true" in kept._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_status_and_message_updates(spark):
    table = known_table(11)
    known = spark.createDataFrame(rows_of(table), schemas.TICKET)
    updates = spark.createDataFrame(
        [(1, "done", "x", 2), (1, "open", "y", 1), (2, "failed", "z", 1), (999, "done", "q", 1)],
        "ticket_id bigint, status string, message_id string, seq bigint",
    )
    by_id = {r.id: r for r in tickets.apply_status(known, updates).collect()}
    assert (by_id[1].status, by_id[2].status, len(by_id)) == ("done", "failed", len(table))
    by_id = {r.id: r for r in tickets.apply_message_ids(known, updates).collect()}
    assert (by_id[1].message_id, by_id[2].message_id, len(by_id)) == ("x", "z", len(table))


def test_status_from_events(spark):
    rows = [(1, "processing", 1), (1, "done", 2), (2, "failed", 1), (2, "processing", 5),
            (0, "done", 1), (3, "other", 9), (3, "failed", 1)]
    events = spark.createDataFrame(rows, "ticket_id bigint, status string, seq bigint")
    got = {r.ticket_id: r.status for r in tickets.status_from_events(events).collect()}
    assert got == {1: "done", 2: "in_progress", 3: "failed"}


def test_publish_outcomes(spark):
    table = known_table(12)
    known = spark.createDataFrame(rows_of(table), schemas.TICKET).withColumn("status", F.lit("open"))
    outcomes = spark.createDataFrame(
        [(1, "m", None), (2, None, "down")], "ticket_id bigint, message_id string, error string"
    )
    by_id = {r.id: r for r in tickets.apply_publish_outcomes(known, outcomes).collect()}
    assert (by_id[1].status, by_id[1].message_id) == ("open", "m")
    assert by_id[2].status == "pending"
    assert by_id[3].status == "open"


def test_two_text_sources_have_one_sequence(spark, tmp_path):
    """Lines of two files, numbered by the library: a ticket each, with ids that are all different."""
    from pyspark.sql import functions as F

    from faultfold.operators.classify import occurrences_of
    from faultfold.sources.logs import read_text_logs, union_sources

    for app in ("shop", "auth"):
        (tmp_path / app).write_text(f"ERROR {app} one\nERROR {app} two\n")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    both = union_sources(*[read_text_logs(spark, str(tmp_path / a), a, at) for a in ("shop", "auth")])
    assert both.select("arrival_seq").distinct().count() == 4
    rows = tickets.upsert_tickets(occurrences_of(both)).collect()
    assert sorted(r.id for r in rows) == [1, 2, 3, 4]
    assert {(r.app, r.occurrence_count) for r in rows} == {("shop", 1), ("auth", 1)}


def test_tied_sequence_numbers(spark):
    rows = stream(6, 60)
    tied = [{**r, "arrival_seq": 7} if isinstance(r, dict) else r for r in rows]
    occ = spark.createDataFrame(tied, OCC)
    got = tickets.upsert_tickets(occ).collect()
    assert len(got) == occ.select(*tickets.KEY).distinct().count()
    assert sorted(r.id for r in got) == list(range(1, len(got) + 1))


def test_null_keys_are_kept(spark):
    from pyspark.sql import functions as F

    rows = stream(8, 40)
    occ = spark.createDataFrame(rows, OCC).withColumn(
        "app", F.when(F.col("arrival_seq") % 2 == 0, F.col("app"))
    ).withColumn("created_date", F.when(F.col("arrival_seq") % 3 == 0, F.col("created_date")))
    none = spark.createDataFrame([], schemas.TICKET)
    assert tickets.occurrences(occ, none).count() == len(rows)
    log = occ.select(*tickets.KEY, F.lit("done").alias("status"), "arrival_seq").limit(0)
    assert tickets.status_as_of(occ, log).count() == len(rows)
    once = tickets.upsert_tickets(occ)
    again = tickets.upsert_tickets(occ, once)
    assert again.count() == once.count()
    assert again.agg(F.sum("occurrence_count")).first()[0] == 2 * len(rows)
