"""Classification of log lines: rule list, rule table, model replies, user classifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultfold import schemas
from faultfold.functions.payload import reply_columns
from faultfold.functions.runs import finder, possible_words
from faultfold.functions.text import contains_any, dedupe_text, fold_case, with_fingerprint
from faultfold.plans.rules import DEFAULT_RULES, FALLBACK, Rule, effective_keywords
from faultfold.session import materialize


def _labels(rule: Rule) -> Column:
    return F.struct(
        F.lit(rule.classification).alias("classification"),
        F.lit(rule.severity).alias("severity"),
        F.lit(rule.component).alias("component"),
        F.lit(rule.fingerprint).alias("fingerprint"),
    )


def rule_number(lowered: Column, rules: list[Rule]) -> Column:
    """1-based number of the first rule with a keyword in the text; one past the end if none."""
    number = None
    for position, words in enumerate(effective_keywords(rules), start=1):
        if words:
            test = contains_any(lowered, words)
            number = F.when(test, position) if number is None else number.when(test, position)
    last = F.lit(len(rules) + 1)
    return last if number is None else number.otherwise(last)


def classify_by_rules(
    df: DataFrame, text: Column | None = None, rules: list[Rule] | None = None
) -> DataFrame:
    """Add the four labels of the first matching rule. Map side only, no shuffle."""
    rules = DEFAULT_RULES if rules is None else rules
    text = dedupe_text() if text is None else text
    table = F.array(*[_labels(rule) for rule in [*rules, FALLBACK]])
    numbered = df.withColumn("_low", fold_case(text)).withColumn(
        "_rule", F.element_at(table, rule_number(F.col("_low"), rules))
    )
    for label in schemas.LABELS:
        numbered = numbered.withColumn(label, F.col("_rule")[label])
    return numbered.drop("_low", "_rule")


def classify_with_rule_table(
    df: DataFrame, rules: DataFrame, text: Column | None = None
) -> DataFrame:
    """Same labels, with the rules in a table of any size.

    Lines are read once and written with the few runs of characters that may be a keyword, which
    tables of fixed size tell (see ``functions.runs``). Runs and keywords then meet by an
    equality join of narrow rows, and a line meets the lowest rule found for it. Keywords are numbered
    in the order in which they decide, so that lines, hits and keywords meet by numbers; the labels
    come last, for the keywords that decided some line. The keyword of
    the lowest rule decides, and of equal rule numbers the smaller keyword. Null keywords match
    nothing, a null label is replaced by the fallback's. Lines that repeat cost a row each, and
    a keyword that a third of all lines hold is one key, which adaptive execution splits where
    keywords are too many to broadcast.
    """
    text = dedupe_text() if text is None else text
    words = rules.select(F.explode("keywords").alias("word"), "rule_no", *schemas.LABELS)
    rule = F.struct("rule_no", "word", *schemas.LABELS)
    best = words.filter("word is not null").groupBy("word").agg(F.min(rule).alias("_rule"))
    best = best.orderBy("_rule.rule_no", "word").withColumn("_rank", F.monotonically_increasing_id())
    best = materialize(best, "keywords")
    runs = possible_words(fold_case(text), finder(best.select("word")))
    lines = df.withColumns({"_line": F.monotonically_increasing_id(), "_runs": runs})
    lines = materialize(lines, "lines")
    found = lines.select("_line", F.explode("_runs").alias("word")).join(best.select("word", "_rank"), "word")
    hits = materialize(found.groupBy("_line").agg(F.min("_rank").alias("_rank")), "hits")
    used = best.select("_rank", "_rule").join(hits.select("_rank").distinct(), "_rank", "left_semi")
    used = materialize(used, "deciding-keywords")
    labelled = lines.drop("_runs").join(hits, "_line", "left").join(used, "_rank", "left")
    fallback = _labels(FALLBACK)
    for label in schemas.LABELS:
        labelled = labelled.withColumn(label, F.coalesce(F.col("_rule")[label], fallback[label]))
    return labelled.drop("_line", "_rank", "_rule")


def parse_replies(df: DataFrame, reply: str = "reply") -> tuple[DataFrame, DataFrame]:
    """Labels from model replies, and the replies that cannot be used with the reason."""
    parsed = reply_columns(df, reply)
    ok = parsed.filter("reject_reason is null").drop("reject_reason")
    rejects = parsed.filter("reject_reason is not null").select(*df.columns, "reject_reason")
    return ok, rejects


def classify_with(
    df: DataFrame, fn: Callable[[Column, Column], Column], text: Column | None = None
) -> DataFrame:
    """Labels from a user classifier.

    ``fn(app, line)`` is a column function or an Arrow ``pandas_udf`` that returns
    ``struct<classification, severity, component, fingerprint, error>``. A row with an error
    keeps it in ``classify_error``; see ``split_rejects``.
    """
    text = dedupe_text() if text is None else text
    called = df.withColumn("_result", fn(F.col("app"), text))
    for label in schemas.LABELS:
        called = called.withColumn(label, F.col("_result")[label])
    return called.withColumn("classify_error", F.col("_result")["error"]).drop("_result")


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classified rows, and the rows whose classification failed."""
    ok = df.filter("classify_error is null").drop("classify_error")
    return ok, df.filter("classify_error is not null")


def occurrences_of(
    classified: DataFrame, hash_on: str = "dedupe_text", day_basis: str = "arrival"
) -> DataFrame:
    """Add the ticket key: fingerprint hash and the day of arrival (or of the event, if it has a time)."""
    basis = {"arrival": "arrival_ts", "event": "ts"}[day_basis]
    keyed = with_fingerprint(classified, hash_on)
    at = F.coalesce(F.col(basis), F.col("arrival_ts"))
    return keyed.withColumn("created_date", F.date_format(at, "yyyy-MM-dd"))
