from datetime import datetime, timedelta

from pyspark.sql import functions as F

from faultfold import schemas
from faultfold.functions import prompts
from faultfold.operators import actions, delivery

ACTIONS = (
    "app string, pos int, type string, name string, url string, command string, "
    "prompt_template string"
)
TICKET = (
    1, "shop", "abc123", "postgres {{.AppName}}", "database_connection_timeout", "critical",
    "payments", "ERROR: refused", datetime(2024, 1, 1, 10, 0, 0, 250000),
    datetime(2024, 1, 1), "2024-01-01", 1, "open", "",
)


def ticket(spark, *apps):
    rows = [(i, app, *TICKET[2:]) for i, app in enumerate(apps, start=1)]
    return spark.createDataFrame(rows, schemas.TICKET)


def test_prompt_substitution(spark):
    rows = [
        ("shop", 1, "cli_agent", "", "", "fix", "fix {{.Classification}} in {{ .Component }}"),
        ("shop", 2, "cli_agent", "", "", "fix", "{{.FingerprintText}}|{{.TicketID}}|{{.FirstSeen}}"),
        ("shop", 3, "cli_agent", "", "", "fix", ""),
        ("shop", 4, "cli_agent", "", "", "fix", "{{.Nothing}}"),
        ("shop", 5, "cli_agent", "", "", "fix", "no field"),
        ("shop", 6, "webhook", "", "u", "", ""),
    ]
    made = actions.render_prompts(ticket(spark, "shop"), spark.createDataFrame(rows, ACTIONS))
    got = {r.pos: r.prompt for r in made.collect()}
    assert got[1] == "fix database_connection_timeout in payments"
    assert got[2] == "postgres {{.AppName}}|1|2024-01-01 10:00:00.25 +0000 UTC"
    assert "Application: shop\nComponent:   payments\n" in got[3]
    assert got[3].count("{{") == 1
    assert got[4] is None
    assert got[5] == "no field"
    assert 6 not in got
    assert len(prompts.ticket_fields()) == 9


def test_action_names(spark):
    rows = [
        ("shop", 1, "webhook", "", "http://h", "", ""),
        ("shop", 2, "cli_agent", None, "", "fix", ""),
        ("shop", 3, "cli_agent", "named", "", "fix", ""),
        ("other", 1, "webhook", "", "x", "", ""),
    ]
    plan = actions.plan_actions(ticket(spark, "shop"), spark.createDataFrame(rows, ACTIONS))
    assert [r.action_name for r in plan.orderBy("pos").collect()] == [
        "webhook:http://h",
        "cli_agent:fix",
        "named",
    ]


def test_run_stops_at_the_first_failure(spark):
    rows = [(app, pos, "cli_agent", f"s{pos}", "", "c", "") for app in "ab" for pos in (2, 1, 3)]

    def fn(ticket, action):
        if ticket["app"] == "a" and action["pos"] == 2:
            raise RuntimeError("boom")
        return f"{ticket['id']}-{action['action_name']}"

    runs = actions.run_actions(ticket(spark, "a", "b"), spark.createDataFrame(rows, ACTIONS), fn, 4)
    got = runs.orderBy("ticket_id", "pos").collect()
    assert [(r.ticket_id, r.pos, r.failed, r.output, r.err_msg) for r in got] == [
        (1, 1, False, "1-s1", ""),
        (1, 2, True, "", "boom"),
        (2, 1, False, "2-s1", ""),
        (2, 2, False, "2-s2", ""),
        (2, 3, False, "2-s3", ""),
    ]
    assert {r.attempt for r in got} == {4}
    outcome = {r.ticket_id: r.status for r in actions.ticket_outcomes(runs).collect()}
    assert outcome == {1: "failed", 2: "done"}


def test_events_of_runs(spark):
    rows = [(1, 1, 1, False, "o1", None), (1, 1, 2, True, "o2", "bad"), (1, 1, 3, False, "o3", None),
            (1, 2, 1, False, "again", None)]
    runs = spark.createDataFrame(
        rows,
        "ticket_id bigint, attempt bigint, pos int, failed boolean, output string, err_msg string",
    )
    got = actions.action_events(runs).orderBy("attempt", "pos", "step").collect()
    assert [(r.attempt, r.pos, r.status, r.output, r.err_msg) for r in got] == [
        (1, 1, "processing", "", ""),
        (1, 1, "done", "o1", ""),
        (1, 2, "processing", "", ""),
        (1, 2, "failed", "", "bad"),
        (2, 1, "processing", "", ""),
        (2, 1, "done", "again", ""),
    ]
    outcomes = {r.attempt: (r.status, r.failed_pos) for r in actions.ticket_outcomes(runs).collect()}
    assert outcomes == {1: ("failed", 2), 2: ("done", None)}


def test_routing(spark):
    rows = [(1, {"AppName": "a"}), (2, {"AppName": "z"}), (3, {"Severity": "x"}), (4, None),
            (5, {"AppName": None})]
    messages = spark.createDataFrame(rows, "id int, attributes map<string,string>")
    workers = spark.createDataFrame([("a",), ("b",), ("a",)], "app string")
    got = {r.id: (r.route, r.worker_app) for r in delivery.route_messages(messages, workers).collect()}
    assert got == {
        1: ("worker", "a"), 2: ("returned", None), 3: ("any", None), 4: ("any", None),
        5: ("any", None),
    }
    assert [r.id for r in delivery.unrouted_messages(messages, workers).collect()] == [2]


def test_delivery_lifecycle(spark):
    start = datetime(2024, 1, 1)
    history = {
        "fresh": ["published"],
        "held": ["published", "received"],
        "backoff": ["published", "received", "failed"],
        "handed_on": ["published", "received", "mismatched"],
        "gone": ["published", "received", "deleted"],
    }
    rows = [
        (name, kind, start + timedelta(seconds=i), i)
        for name, kinds in history.items()
        for i, kind in enumerate(kinds)
    ]
    log = spark.createDataFrame(rows, "message_id string, kind string, ts timestamp, seq bigint")
    state = {r.message_id: r for r in delivery.delivery_state(log).collect()}
    seconds = {
        name: (r.visible_at - start).total_seconds() if r.visible_at else None
        for name, r in state.items()
    }
    assert seconds == {"fresh": 0, "held": 301, "backoff": 32, "handed_on": 2, "gone": None}

    def depth(second):
        as_of = F.lit(start.isoformat()).cast("timestamp") + F.make_dt_interval(secs=F.lit(second))
        row = delivery.queue_depth(log, as_of).first()
        return row.visible, row.in_flight

    assert depth(0) == (5, 0)
    assert depth(2) == (2, 2)
    assert depth(40) == (3, 1)
    assert depth(301) == (4, 0)


def test_tickets_without_actions_are_done(spark):
    from faultfold.operators.actions import run_actions, ticket_outcomes

    tickets = spark.createDataFrame(
        [(1, "a", "c", "low"), (2, "b", "c", "low")],
        "id bigint, app string, classification string, severity string",
    )
    actions = spark.createDataFrame(
        [("a", 1, "webhook", "", "u", "c")],
        "app string, pos int, type string, name string, url string, command string",
    )

    def fn(ticket, action):
        raise ValueError("down")

    got = ticket_outcomes(run_actions(tickets, actions, fn), tickets).collect()
    assert {(r.ticket_id, r.status) for r in got} == {(1, "failed"), (2, "done")}
