from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from faultfold import schemas
from faultfold.operators.classify import (
    classify_by_rules,
    classify_with,
    classify_with_rule_table,
    occurrences_of,
    split_rejects,
)
from faultfold.plans.catalog import rule_table
from faultfold.plans.rules import DEFAULT_RULES, FALLBACK, Rule, effective_keywords
from faultfold.plans.views import TEMPLATES

EXPECTED_RULES = [1, 2, 3, 5, 4, 6, 7, 8, 9, 10, 11, 12, 1, 1, 5]


def first_rule(line, rules=DEFAULT_RULES):
    low = line.replace("İ", "i").lower()
    for rule in rules:
        if any(word in low for word in rule.keywords):
            return rule
    return FALLBACK


def lines(spark, texts):
    rows = [("a", t, "", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "app string, raw_line string, dedupe_key string, arrival_seq bigint"
    )


def test_templates_hit_the_expected_rules(spark):
    got = classify_by_rules(lines(spark, [t[1] for t in TEMPLATES])).orderBy("arrival_seq")
    expected = [DEFAULT_RULES[n - 1].classification for n in EXPECTED_RULES]
    assert [r.classification for r in got.collect()] == expected


WORDS = sorted({w for r in DEFAULT_RULES for w in r.keywords})
TEXTS = st.lists(
    st.one_of(st.sampled_from(WORDS), st.sampled_from(["", "x", "İ", "DİSK", " lo", "ck", "S3"])),
    max_size=4,
).map("".join)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TEXTS, min_size=50, max_size=200))
def test_rule_list_and_tables_agree_with_plain_python(spark, texts):
    df = lines(spark, texts)
    table = rule_table(spark)
    ways = [
        classify_by_rules(df),
        classify_with_rule_table(df, table),
        classify_with_rule_table(df, table),
    ]
    expected = [tuple(first_rule(t)[1:]) for t in texts]
    for way in ways:
        rows = way.orderBy("arrival_seq").select(*schemas.LABELS).collect()
        assert [tuple(r) for r in rows] == expected


def test_large_table_with_short_and_empty_keywords(spark):
    rules = [
        Rule(["zz"], "two", "low", "c", "f"),
        Rule(["q"], "one", "low", "c", "f"),
        Rule(["straße 9"], "long", "low", "c", "f"),
        Rule([""], "any", "low", "c", "f"),
    ]
    rows = [(n, *r) for n, r in enumerate(rules, start=1)]
    table = spark.createDataFrame(rows, schemas.RULE)
    df = lines(spark, ["a zz q", "q", "Straße 9", "straße 8", "", "z"])
    got = classify_with_rule_table(df, table).orderBy("arrival_seq")
    assert [r.classification for r in got.collect()] == [
        "two",
        "one",
        "long",
        "any",
        "any",
        "any",
    ]


def test_dropped_keywords_are_implied():
    kept = effective_keywords(DEFAULT_RULES)
    for rule, words in zip(DEFAULT_RULES, kept):
        for word in set(rule.keywords) - set(words):
            assert any(k in word for known in kept for k in known)


def test_user_classifier_errors_skip_only_their_line(spark):
    def fn(app, line):
        return F.struct(
            F.lit("c").alias("classification"),
            F.lit("low").alias("severity"),
            app.alias("component"),
            line.alias("fingerprint"),
            F.when(line == "bad", "unavailable").alias("error"),
        )

    ok, rejects = split_rejects(classify_with(lines(spark, ["good", "bad", "fine"]), fn))
    assert {r.fingerprint for r in ok.collect()} == {"good", "fine"}
    assert [r.classify_error for r in rejects.collect()] == ["unavailable"]


def test_user_classifier_as_pandas_udf(spark):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    shape = (
        "classification string, severity string, component string, fingerprint string, error string"
    )

    @pandas_udf(shape)
    def fn(app: pd.Series, line: pd.Series) -> pd.DataFrame:
        bad = line.str.contains("bad")
        return pd.DataFrame(
            {
                "classification": "n" + line.str.len().astype(str),
                "severity": "low",
                "component": app,
                "fingerprint": line,
                "error": bad.map({True: "no", False: None}),
            }
        )

    ok, rejects = split_rejects(classify_with(lines(spark, ["good", "bad"]), fn))
    assert [r.classification for r in ok.collect()] == ["n4"]
    assert rejects.count() == 1


def test_day_basis(spark):
    df = spark.sql(
        "select 'a' app, 'l' raw_line, '' dedupe_key, timestamp'2024-01-01 23:59:59' ts, "
        "timestamp'2024-01-02 00:00:01' arrival_ts"
    )
    assert occurrences_of(df).first().created_date == "2024-01-02"
    assert occurrences_of(df, day_basis="event").first().created_date == "2024-01-01"
