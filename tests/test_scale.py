"""What queries write, read and carry where tables are large."""

from datetime import datetime, timedelta, timezone

import pytest

from faultfold import schemas
from faultfold.operators import classify, work
from faultfold.plans import catalog


@pytest.fixture
def kept(monkeypatch):
    """Columns of what is written to the shared folder, by label."""
    columns = {}
    for module in (catalog, classify, work):
        real = module.materialize

        def write(df, label, real=real):
            columns[label] = df.columns
            return real(df, label)

        monkeypatch.setattr(module, "materialize", write)
    return columns


def test_texts_of_sources_are_hashed_once(spark, data, kept):
    catalog.QUERIES["j10_text_sources"](spark, data)
    assert kept["occurrences"] == [*schemas.TICKET_KEY, "arrival_seq"]


def test_documents_are_streamed_from_their_table(spark, data, monkeypatch):
    def copied(*_):
        raise AssertionError("documents are copied")

    monkeypatch.setattr(catalog.given, "doc_logs", copied)
    rows = catalog.QUERIES["z3_two_streams"](spark, data).collect()
    tables = [catalog.given.table(spark, data, t).count() for t in ("events", "documents")]
    assert sum(r["lines"] for r in rows) == sum(tables)


def test_labels_of_keywords_are_not_carried_with_lines(spark, kept):
    rows = [(7, ["ab", "b"], "seven", "low", "c", "f"), (3, ["xb", "b"], None, "high", "d", "g"), (3, ["a"], "three", "low", "e", "h")]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["ab", "xb", "q", None, "b", "ab"])], "k int, line string")
    got = classify.classify_with_rule_table(df, spark.createDataFrame(rows, schemas.RULE), df.line)
    assert {r.k: (r.classification, r.severity) for r in got.collect()} == {
        0: ("three", "low"), 1: ("unknown_error", "high"), 2: ("unknown_error", "medium"),
        3: ("unknown_error", "medium"), 4: ("unknown_error", "high"), 5: ("three", "low"),
    }
    assert got.columns == ["k", "line", *schemas.LABELS]
    assert kept["hits"] == ["_line", "_rank"]


def test_bodies_are_parsed_once(spark, kept):
    body = '{"ticket_id":%d,"app_name":"a","classification":"c","severity":"low"}'
    rows = [(1, body % 1, {"AppName": "a"}), (2, body % 2, {"AppName": "z"}), (3, "{", {"AppName": "a"}),
            (4, None, {"AppName": "a"}), (5, None, {"AppName": "z"}), (6, "null", None)]
    messages = spark.createDataFrame(rows, "message_id bigint, body string, attributes map<string,string>")
    log = spark.createDataFrame([(1, "received")], "message_id bigint, kind string")
    apps = spark.createDataFrame([("a",)], "app string")
    actions = spark.createDataFrame(
        [("a", 1, "webhook", "", "u", "c"), ("a", 2, "webhook", "n", "u", "c")],
        "app string, pos int, type string, name string, url string, command string",
    )
    done = work.process_messages(messages, log, apps, actions, lambda t, a: f"{t['id']} {a['action_name']}")
    assert {tuple(r) for r in done.deliveries.collect()} == {
        (1, 2, "deleted"), (2, 1, "mismatched"), (3, 1, "deleted"), (5, 1, "mismatched"), (6, 1, "deleted"),
    }
    assert [(r.message_id, r.pos, r.output, r.attempt) for r in done.runs.orderBy("pos").collect()] == [
        (1, 1, "1 webhook:u", 2), (1, 2, "1 n", 2),
    ]
    assert "body" not in kept["received"] and "routed" not in kept


def test_a_message_is_parsed_once_however_often_it_is_received(spark, kept, monkeypatch):
    parsed, real = [], work.parse_messages
    monkeypatch.setattr(work, "parse_messages", lambda *a: parsed.append(a) or real(*a))
    body = '{"ticket_id":%d,"app_name":"a","raw_log":"x"}'
    rows = [(k, body % k, {"AppName": "z" if k == 3 else "a"}) for k in range(4)]
    messages = spark.createDataFrame(rows, "message_id bigint, body string, attributes map<string,string>")
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    log = spark.createDataFrame([(k, "published", start, 1) for k in range(4)], "message_id bigint, kind string, ts timestamp, seq bigint")
    apps = spark.createDataFrame([("a",)], "app string")
    actions = spark.createDataFrame(
        [("a", 1, "webhook", "", "u", "c")], "app string, pos int, type string, name string, url string, command string"
    )

    def fn(ticket, action):
        return str(1 // (ticket["attempt"] > ticket["id"]))

    ticks = [start + timedelta(seconds=30 * n) for n in range(4)]
    log, runs = work.work_queue(messages, log, apps, actions, fn, ticks)
    tries = log.filter("kind = 'received'").groupBy("message_id").count().collect()
    assert {tuple(r) for r in tries} == {(0, 1), (1, 2), (2, 3), (3, 4)}
    assert runs.count() == 6 and log.count() == 4 + 20
    assert len(parsed) == 1 and not any("body" in columns for columns in kept.values())
