"""Ticket queue messages as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultfold.functions.payload import (
    kinds_fit,
    last_value,
    settled,
    with_entries,
)
from faultfold.operators.scan import running_rank

# The times a message may carry, and the empty message.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|[+-]\d{2}:\d{2})$"
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
TEXT_FIELDS = [
    "app_name",
    "classification",
    "severity",
    "component",
    "fingerprint_hash",
    "fingerprint_text",
    "raw_log",
]


def ticket_messages(tickets: DataFrame) -> DataFrame:
    """Message columns of ticket rows."""
    return tickets.select(
        F.col("id").alias("ticket_id"),
        F.col("app").alias("app_name"),
        "classification",
        "severity",
        "component",
        "fingerprint_hash",
        "fingerprint_text",
        "raw_log",
        "first_seen",
    )


def message_bodies(messages: DataFrame, out: str = "body") -> DataFrame:
    """Add the JSON body of each message."""
    fields = [c for c in messages.columns]
    return messages.withColumn(
        out, F.to_json(F.struct(*fields), {"timestampFormat": TIME_FORMAT})
    )


def message_attributes(df: DataFrame, out: str = "attributes") -> DataFrame:
    """Add the routing attributes of each message."""
    return df.withColumn(
        out,
        F.create_map(
            F.lit("AppName"),
            F.col("app_name"),
            F.lit("Severity"),
            F.col("severity"),
            F.lit("Classification"),
            F.col("classification"),
        ),
    )


def message_ids(df: DataFrame, published_at: Column, order: str = "ticket_id") -> DataFrame:
    """Number messages in publish order: ``mock-msg-<ms>-<counter>``."""
    counted = running_rank(df, [], order, "_counter")
    return (
        counted.withColumn("published_at", published_at)
        .withColumn(
            "mock_message_id",
            F.concat(
                F.lit("mock-msg-"),
                F.unix_millis("published_at").cast("string"),
                F.lit("-"),
                F.col("_counter").cast("string"),
            ),
        )
        .drop("_counter")
    )


def write_ticket_messages(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append one JSON record per message to ``path``, in parallel."""
    ordered = ["mock_message_id", "published_at"]
    head = [c for c in ordered if c in df.columns]
    rest = [c for c in df.columns if c not in ordered]
    lines = message_bodies(df.select(*head, *rest), "value").select("value")
    lines.write.mode(mode).text(path)


def read_ticket_messages(df: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Parsed messages and the unparseable ones; rows without a body are ignored.

    Missing fields are zero values, so ``{}`` and ``null`` are valid messages.
    """
    parsed = parse_messages(df.filter(F.col(body).isNotNull()), body)
    ok = parsed.filter("_valid").drop("_valid")
    rejects = parsed.filter("not _valid").select(*df.columns)
    return ok, rejects


def parse_messages(df: DataFrame, body: str = "body") -> DataFrame:
    """All rows with the fields of their message, and ``_valid``: false where there is none or it is unparseable."""
    fields = F.col("_fields")
    kinds = {"ticket_id": "BIGINT", **dict.fromkeys([*TEXT_FIELDS, "first_seen"], "STRING")}

    def is_time(e: Column) -> Column:
        value = F.try_variant_get(e["value"], "$", "string")
        parsed = F.try_to_timestamp(value).isNotNull()
        return (e["key"] != "first_seen") | (F.regexp_like(value, F.lit(RFC3339)) & parsed)

    null_body = F.regexp_like(F.col(body), F.lit(r"^\s*null\s*$"))
    valid = fields.isNotNull() & kinds_fit(fields, kinds, is_time)
    read = with_entries(df, F.col(body), "_fields", decoded=True)
    zero = F.lit(0).cast("bigint")
    texts = [F.coalesce(last_value(fields, n, "string"), F.lit("")).alias(n) for n in TEXT_FIELDS]
    parsed = read.select(
        "*",
        F.coalesce(null_body | valid, F.lit(False)).alias("_valid"),
        F.coalesce(last_value(fields, "ticket_id", "bigint"), zero).alias("ticket_id"),
        *texts,
        F.try_to_timestamp(last_value(fields, "first_seen", "string")).alias("first_seen"),
    )
    return settled(parsed.drop("_fields"), "_valid")
