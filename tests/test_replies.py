import json

import pytest
from pyspark.sql import functions as F

from faultfold.functions import prompts
from faultfold.functions.payload import with_payload_message
from faultfold.operators.classify import parse_replies
from faultfold.sources.messages import (
    message_bodies,
    message_ids,
    read_ticket_messages,
    ticket_messages,
    write_ticket_messages,
)

FULL = '{"classification":"c","severity":"high","component":"db","fingerprint":"f"}'

ACCEPTED = {
    FULL: ("c", "high", "db", "f"),
    f"The model says: {FULL} bye": ("c", "high", "db", "f"),
    "{}": ("unknown_error", "medium", "unknown", "unknown_error"),
    '{"classification":"x","component":""}': ("x", "medium", "unknown", "x"),
    '{"Classification":"x","SEVERITY":"low"}': ("x", "low", "unknown", "x"),
    '{"classification":"a","classification":"b"}': ("b", "medium", "unknown", "b"),
    '{"classification":"a","classification":null}': ("a", "medium", "unknown", "a"),
    '{"classification":"a","other":{"b":[1,2]}}': ("a", "medium", "unknown", "a"),
    '{"ſeverity":"low"}': ("unknown_error", "low", "unknown", "unknown_error"),
}
REJECTED = [
    "plain words only",
    '{"classification": "half", "severity": }',
    '{"classification": 5}',
    '{"classification": 5, "classification": "a"}',
    "{'classification': 'a'}",
    f"{FULL} and {FULL}",
    '{"a": NaN}',
    "} {",
    "",
]


def test_replies(spark):
    rows = [(t,) for t in [*ACCEPTED, *REJECTED]]
    ok, rejects = parse_replies(spark.createDataFrame(rows, "reply string"))
    got = {
        r.reply: (r.classification, r.severity, r.component, r.fingerprint) for r in ok.collect()
    }
    assert got == ACCEPTED
    assert {r.reply for r in rejects.collect()} == set(REJECTED)


def test_payload_messages(spark):
    rows = [
        ("text", '{"message":"m"}', None),
        ("", '{"message":"m","msg":"n"}', None),
        ("", '{"msg":5,"log":"l"}', None),
        (None, '{"error":null}', None),
        (None, '{"k":1,"j":2}', "t"),
        (None, "{}", None),
        (None, None, "type/x"),
        (None, "not json", None),
        (None, None, None),
    ]
    df = spark.createDataFrame(rows, "t string, j string, p string")
    got = [r.message for r in with_payload_message(df, "t", "j", "p").collect()]
    assert got == [
        "text",
        "m",
        "",
        "",
        "[JSON payload with 2 fields]",
        "[JSON payload with 0 fields]",
        "[proto payload: type/x]",
        "[empty log entry]",
        "[empty log entry]",
    ]


@pytest.mark.parametrize(
    "model, blocks",
    [("amazon.nova-micro", True), ("x.nova-pro", True), ("nova", True), ("other-1", False)],
)
def test_model_family(model, blocks):
    assert prompts.uses_content_blocks(model) is blocks


def test_model_request_shapes(spark):
    df = spark.createDataFrame([("shop", 'a "quoted" line')], "app string, line string")
    prompt = prompts.classification_prompt(F.col("app"), F.col("line"))
    row = df.select(
        prompt.alias("p"),
        prompts.model_request(prompt, "nova").alias("n"),
        prompts.model_request(prompt, "other").alias("o"),
    ).first()
    assert "application 'shop'" in row.p and 'a "quoted" line' in row.p
    blocks, plain = json.loads(row.n), json.loads(row.o)
    assert blocks["messages"][0]["content"][0]["text"] == row.p
    assert blocks["inferenceConfig"] == {"maxTokens": 512, "temperature": 0}
    assert plain["messages"] == [{"role": "user", "content": row.p}]
    assert plain["system"] == blocks["system"][0]["text"] == prompts.SYSTEM_PROMPT


def test_response_text(spark):
    nested = '{"output":{"message":{"content":[{"text":"a"},{"text":"b"}]}}}'
    cases = {
        nested: "a",
        '{"output":{"message":{"content":[]}}}': None,
        "{}": None,
        "oops": None,
        '{"output":{"message":{"content":[{"text":3}]}}}': None,
        '{"output":{"message":{"content":[{}]}}}': "",
    }
    df = spark.createDataFrame([(c,) for c in cases], "body string")
    rows = prompts.response_columns(df, "body", "nova").collect()
    assert {r.body: r.response for r in rows} == cases
    assert all((r.response is None) == (r.reject_reason is not None) for r in rows)


def test_message_parsing(spark):
    good = {"ticket_id": 7, "app_name": "a", "first_seen": "2026-04-19T21:11:18.620478+01:00"}
    cases = {
        json.dumps(good): True,
        "{}": True,
        "null": True,
        '{"APP_NAME":"b"}': True,
        '{"ticket_id":null}': True,
        "not json at all": False,
        "{bad json": False,
        '{"ticket_id":"7"}': False,
        '{"ticket_id":7.5}': False,
        '{"app_name":1}': False,
        '{"first_seen":"yesterday"}': False,
        '{"first_seen":"2026-04-19 21:11:18"}': False,
        "[]": False,
        "": False,
    }
    df = spark.createDataFrame([(c,) for c in [*cases, None]], "body string")
    ok, rejects = read_ticket_messages(df)
    parsed = {r.body: r for r in ok.collect()}
    assert set(parsed) == {c for c, valid in cases.items() if valid}
    assert {r.body for r in rejects.collect()} == {c for c, v in cases.items() if not v}
    assert parsed[json.dumps(good)].first_seen.isoformat() == "2026-04-19T20:11:18.620478"
    assert parsed["{}"].ticket_id == 0 and parsed["{}"].app_name == ""
    assert parsed['{"APP_NAME":"b"}'].app_name == "b"


def test_messages_round_trip(spark, data, tmp_path):
    from faultfold.plans import views as given

    sent = ticket_messages(given.tickets(spark, data))
    numbered = message_ids(sent, F.lit("2024-01-01").cast("timestamp"))
    write_ticket_messages(numbered, str(tmp_path / "queue"))
    write_ticket_messages(numbered, str(tmp_path / "queue"))
    ok, rejects = read_ticket_messages(spark.read.text(str(tmp_path / "queue")), "value")
    back = ok.select(*sent.columns)
    assert rejects.count() == 0
    assert back.count() == 2 * sent.count()
    assert back.exceptAll(sent.union(sent)).count() == 0


def test_bodies_are_json(spark, data):
    from faultfold.plans import views as given

    row = message_bodies(ticket_messages(given.tickets(spark, data))).first()
    assert json.loads(row.body)["ticket_id"] == row.ticket_id
