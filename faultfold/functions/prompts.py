"""Prompt and request text for classification and for ticket actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultfold.functions.payload import STRICT

# Instruction texts, request settings and the envelope version.
SYSTEM_PROMPT = (
    "You are a log analysis expert. Analyze the following error log and return ONLY valid JSON."
)
USER_PROMPT_PARTS = [
    "Analyze this error log from application '",
    "':\n\n",
    "\n\nReturn JSON with exactly these fields:\n"
    "- classification: short snake_case error type (e.g. 'database_connection_timeout', "
    "'null_pointer_exception')\n"
    "- severity: one of 'low', 'medium', 'high', 'critical'\n"
    "- component: affected service/component name\n"
    "- fingerprint: a normalized canonical description of this error, stripping variable parts "
    "like IDs, timestamps, IP addresses, request IDs — this will be used for deduplication",
]
MAX_TOKENS = 512
TEMPERATURE = 0
ENVELOPE_VERSION = "bedrock-2023-05-31"
DEFAULT_ACTION_PROMPT = """You are a software engineer investigating a production error.

Application: {{.AppName}}
Component:   {{.Component}}
Severity:    {{.Severity}}
Error type:  {{.Classification}}
First seen:  {{.FirstSeen}}

Error fingerprint:
{{.FingerprintText}}

Raw log line:
{{.RawLog}}

Investigate the root cause of this error, propose a fix, and if you have access to the \
codebase, attempt to implement and test it."""

PLACEHOLDER = r"\{\{\s*\.\w+\s*\}\}"
PLACEHOLDER_NAME = r"\{\{\s*\.(\w+)\s*\}\}"


def classification_prompt(app: Column, line: Column) -> Column:
    head, middle, tail = (F.lit(part) for part in USER_PROMPT_PARTS)
    return F.concat(head, app, middle, line, tail)


def uses_content_blocks(model: str) -> bool:
    """Two request envelopes exist; the model id decides which one applies."""
    return "nova" in model


def model_request(prompt: Column, model: str) -> Column:
    """Request body for one prompt, as JSON text."""
    if uses_content_blocks(model):
        content = F.array(F.struct(prompt.alias("text")))
        body = F.struct(
            F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias(
                "messages"
            ),
            F.array(F.struct(F.lit(SYSTEM_PROMPT).alias("text"))).alias("system"),
            F.struct(
                F.lit(MAX_TOKENS).alias("maxTokens"), F.lit(TEMPERATURE).alias("temperature")
            ).alias("inferenceConfig"),
        )
    else:
        body = F.struct(
            F.lit(ENVELOPE_VERSION).alias("anthropic_version"),
            F.lit(MAX_TOKENS).alias("max_tokens"),
            F.lit(TEMPERATURE).alias("temperature"),
            F.lit(SYSTEM_PROMPT).alias("system"),
            F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias(
                "messages"
            ),
        )
    return F.to_json(body)


def response_columns(df: DataFrame, body: str, model: str, out: str = "response") -> DataFrame:
    """First content text of a model response; ``reject_reason`` says why there is none."""
    content = "content:array<struct<text:variant>>"
    shape = f"output:struct<message:struct<{content}>>" if uses_content_blocks(model) else content
    parsed = F.from_json(
        F.concat(F.lit("["), F.col(body), F.lit("]")), f"array<struct<{shape}>>", STRICT
    )
    one = F.when(F.size(parsed) == 1, F.try_element_at(parsed, F.lit(1)))
    items = one["output"]["message"]["content"] if uses_content_blocks(model) else one["content"]
    text = F.col("_text")
    kind = F.schema_of_variant(text)
    reason = (
        F.when(F.col("_one").isNull(), "malformed response")
        .when(F.coalesce(F.size("_items"), F.lit(0)) < 1, "empty response")
        .when(text.isNotNull() & ~kind.isin("STRING", "VOID"), "malformed response")
    )
    return (
        df.withColumn("_one", one)
        .withColumn("_items", items)
        .withColumn("_text", F.try_element_at(F.col("_items"), F.lit(1))["text"])
        .withColumn("reject_reason", reason)
        .withColumn(
            out,
            F.when(
                F.col("reject_reason").isNull(),
                F.coalesce(F.try_variant_get(text, "$", "string"), F.lit("")),
            ),
        )
        .drop("_one", "_items", "_text")
    )


def ticket_fields() -> dict[str, Column]:
    """Template field name to text, for a ticket row."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    first_seen = F.coalesce(F.col("first_seen").cast("string"), F.lit("0001-01-01 00:00:00"))
    return {
        "TicketID": text("id"),
        "AppName": text("app"),
        "Classification": text("classification"),
        "Severity": text("severity"),
        "Component": text("component"),
        "FingerprintHash": text("fingerprint_hash"),
        "FingerprintText": text("fingerprint_text"),
        "RawLog": text("raw_log"),
        "FirstSeen": F.concat(first_seen, F.lit(" +0000 UTC")),
    }


def with_template_parts(actions: DataFrame) -> DataFrame:
    """Cut each action's template, or the default one, at its placeholders.

    Done once per action, before the actions meet the tickets. ``_places`` holds the position
    of each placeholder's field, and is NULL if a field is unknown.
    """
    template = F.coalesce(
        F.nullif(F.col("prompt_template"), F.lit("")), F.lit(DEFAULT_ACTION_PROMPT)
    )
    known = F.array(*[F.lit(name) for name in ticket_fields()])
    names = F.regexp_extract_all(template, F.lit(PLACEHOLDER_NAME), F.lit(1))
    places = F.transform(names, lambda n: F.array_position(known, n).cast("int"))
    return actions.withColumn("_literals", F.split(template, PLACEHOLDER, -1)).withColumn(
        "_places", F.when(~F.array_contains(places, 0), places)
    )


def with_prompts(plan: DataFrame) -> DataFrame:
    """Add ``prompt`` to tickets joined with prepared actions.

    Everything is put together in one pass, so inserted text is never looked at again.
    """
    values = F.array(*ticket_fields().values(), F.lit(""))
    places = F.concat("_places", F.array(F.lit(len(ticket_fields()) + 1)))
    pieces = F.zip_with(
        "_literals", places, lambda text, place: F.concat(text, F.element_at("_values", place))
    )
    return (
        plan.withColumn("_values", values)
        .withColumn("prompt", F.array_join(pieces, ""))
        .drop("_values", "_literals", "_places")
    )
