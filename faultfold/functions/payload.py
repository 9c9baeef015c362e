"""Strict JSON on top of the variant type.

Spark's JSON reader is forgiving: trailing text is ignored and numbers turn into strings.
Wrapping the text in brackets and asking for exactly one element rejects trailing text, and
reading values as variants keeps their types visible.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}

# Payload keys looked up for the message, in order.
MESSAGE_KEYS = ["message", "msg", "log", "error", "err"]


def with_entries(df: DataFrame, text: Column, out: str, decoded: bool = False) -> DataFrame:
    """Fields of a JSON object as ``struct<key, kind, value>`` in document order.

    Duplicates are kept, ``kind`` is the type of the value. NULL if the text is not exactly
    one object. ``decoded`` is the form for looking up what decoding into a record would set:
    keys in lower case, none for null values, last field first.
    """
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    objects = F.from_json(wrapped, "array<map<string,variant>>", STRICT)

    def field(e: Column) -> Column:
        kind = F.schema_of_variant(e["value"])
        key = e["key"]
        if decoded:
            folded = F.lower(F.replace(key, F.lit("\u017f"), F.lit("s")))
            key = F.when(kind != "VOID", folded)
        return F.struct(key.alias("key"), kind.alias("kind"), e["value"].alias("value"))

    entries = F.transform(F.map_entries(F.try_element_at(F.col("_objects"), F.lit(1))), field)
    if decoded:
        entries = F.reverse(entries)
    return (
        df.withColumn("_objects", objects)
        .withColumn(out, F.when(F.size("_objects") == 1, entries))
        .drop("_objects")
    )


def kinds_fit(fields: Column, kinds: dict[str, str], also: Callable | None = None) -> Column:
    """True if every known field has the expected type and passes ``also``.

    Other fields may be anything.
    """

    def fits(e: Column) -> Column:
        test = F.lit(True)
        for kind in dict.fromkeys(kinds.values()):
            names = [name for name, k in kinds.items() if k == kind]
            right = e["kind"] == kind if also is None else (e["kind"] == kind) & also(e)
            test = F.when(e["key"].isin(*names), right).otherwise(test)
        return test

    return F.forall(fields, fits)


def last_value(fields: Column, name: str, kind: str) -> Column:
    """Value of the last field of that name, from decoded entries; NULL if there is none."""
    place = F.nullif(F.array_position(fields["key"], F.lit(name)), F.lit(0))
    return F.try_variant_get(F.try_element_at(fields, place.cast("int"))["value"], "$", kind)


def settled(df: DataFrame, flag: str) -> DataFrame:
    """Let rows be filtered by ``flag`` without computing it again.

    A filter on a projected column is pushed below the projection together with a copy of its
    expression, which would parse the text once more for every use. It is not pushed through
    the generator of a one-element array.
    """
    return df.withColumn(flag, F.explode(F.array(flag)))


def with_payload_message(
    df: DataFrame, text: str, json: str, proto_type: str, out: str = "message"
) -> DataFrame:
    """Message of a structured entry: text, else a known JSON key, else a placeholder.

    The first key that is present decides, even if its value is not a string.
    """
    entries = F.col("_entries")
    hit = F.col("_hit")

    def under(key: str) -> Column:
        return F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(-1))

    found = F.coalesce(*[under(key) for key in MESSAGE_KEYS])
    text_of = F.when(hit["kind"] == "STRING", F.try_variant_get(hit["value"], "$", "string"))
    message = (
        F.when(F.coalesce(F.col(text), F.lit("")) != "", F.col(text))
        .when(hit.isNotNull(), F.coalesce(text_of, F.lit("")))
        .when(
            entries.isNotNull(),
            F.concat(
                F.lit("[JSON payload with "),
                F.size(entries).cast("string"),
                F.lit(" fields]"),
            ),
        )
        .when(
            F.col(proto_type).isNotNull(),
            F.concat(F.lit("[proto payload: "), F.col(proto_type), F.lit("]")),
        )
        .otherwise("[empty log entry]")
    )
    return (
        with_entries(df, F.col(json), "_entries")
        .withColumn("_hit", found)
        .withColumn(out, message)
        .drop("_entries", "_hit")
    )


def reply_columns(df: DataFrame, text: str) -> DataFrame:
    """Parse a classification reply; ``reject_reason`` is NULL for the usable ones."""
    # Reply fields and what stands in for an empty one.
    defaults = {"classification": "unknown_error", "severity": "medium", "component": "unknown"}
    names = [*defaults, "fingerprint"]
    fields = F.col("_fields")

    found = df.withColumn("_object", F.regexp_extract(F.col(text), r"(?s)\{.*\}", 0))
    found = with_entries(found, F.nullif("_object", F.lit("")), "_fields", decoded=True)
    reason = (
        F.when(F.coalesce(F.col("_object"), F.lit("")) == "", "no JSON object found")
        .when(fields.isNull(), "malformed JSON")
        .when(~kinds_fit(fields, dict.fromkeys(names, "STRING")), "field is not a string")
    )
    values = [F.nullif(last_value(fields, n, "string"), F.lit("")).alias(n) for n in names]
    parsed = found.select("*", reason.alias("reject_reason"), *values)
    parsed = settled(parsed.drop("_object", "_fields"), "reject_reason")
    for name, default in defaults.items():
        parsed = parsed.withColumn(name, F.coalesce(name, F.lit(default)))
    return parsed.withColumn("fingerprint", F.coalesce("fingerprint", "classification"))
