"""Column functions over log text. All stay in built-in, code-generated expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rendering of a missing time, and the white space trimmed from lines.
ZERO_TIME = "0001-01-01T00:00:00Z"
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# Recognised severity prefixes, in the order they are tried.
SEVERITY_PREFIXES = ["CRITICAL", "ERROR", "WARN", "WARNING", "INFO", "DEBUG"]


def fold_case(c: Column) -> Column:
    """Lower-case one code point at a time: dotted capital I becomes a plain i."""
    return F.lower(F.replace(c, F.lit("\u0130"), F.lit("i")))


def contains_any(lowered: Column, words: list[str]) -> Column:
    """True if any of ``words`` occurs in the already lower-cased text."""
    test = lowered.contains(words[0])
    for word in words[1:]:
        test = test | lowered.contains(word)
    return test


def trim_line(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def rfc3339_seconds(ts: Column) -> Column:
    rendered = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")
    return F.coalesce(rendered, F.lit(ZERO_TIME))


def raw_line(ts: Column, severity: Column, message: Column) -> Column:
    """``[time] SEVERITY message``; missing parts render as empty."""
    blank = F.lit("")
    return F.concat(
        F.lit("["),
        rfc3339_seconds(ts),
        F.lit("] "),
        F.coalesce(severity, blank),
        F.lit(" "),
        F.coalesce(message, blank),
    )


def infer_severity(message: Column) -> Column:
    """Severity from the words of the message; ERROR when nothing is recognised."""
    low = fold_case(message)
    return (
        F.when(contains_any(low, ["critical", "fatal", "panic"]), "CRITICAL")
        .when(contains_any(low, ["error", "exception", "fail"]), "ERROR")
        .when(low.contains("warn"), "WARNING")
        .otherwise("ERROR")
    )


def split_severity(line: Column) -> Column:
    """``struct<severity, message>`` of a line with an optional severity prefix.

    The prefix needs a following space, and the rest is left untrimmed.
    """
    pattern = "(?i)^(" + "|".join(SEVERITY_PREFIXES) + ") "
    prefix = F.regexp_extract(line, pattern, 1)
    found = prefix != ""
    return F.struct(
        F.when(found, F.upper(prefix)).otherwise("ERROR").alias("severity"),
        F.when(found, F.substr(line, F.length(prefix) + 2)).otherwise(line).alias("message"),
    )


def dedupe_text() -> Column:
    """The text that is classified and hashed: the dedupe key, or else the raw line."""
    return F.coalesce(F.nullif(F.col("dedupe_key"), F.lit("")), F.col("raw_line"))


def normalize_line(c: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 as one space, trimmed."""
    return F.trim(F.regexp_replace(fold_case(c), "[^a-z0-9]+", " "))


def fingerprint_hash(app: Column, text: Column) -> Column:
    return F.sha2(F.concat(app, F.lit("|"), normalize_line(text)), 256)


def with_fingerprint(df: DataFrame, hash_on: str = "dedupe_text") -> DataFrame:
    """Add ``fingerprint_hash``.

    ``dedupe_text`` hashes the dedupe text, ``message`` the bare message (so that the time in
    a rendered line does not split tickets), ``fingerprint`` the classifier's wording as it is.
    """
    if hash_on == "dedupe_text":
        value = fingerprint_hash(F.col("app"), dedupe_text())
    elif hash_on == "message":
        value = fingerprint_hash(F.col("app"), F.col("message"))
    elif hash_on == "fingerprint":
        value = F.sha2(F.concat("app", F.lit("|"), "fingerprint"), 256)
    else:
        raise ValueError(f"unknown hash_on: {hash_on!r}")
    return df.withColumn("fingerprint_hash", value)


def normalize_severity(c: Column) -> Column:
    """Bridge the source and ticket vocabularies to critical, high, medium and low."""
    up = F.upper(c)
    return (
        F.when(up.isin("CRITICAL", "FATAL"), "critical")
        .when(up.isin("HIGH", "ERROR"), "high")
        .when(up.isin("MEDIUM", "WARNING", "WARN"), "medium")
        .otherwise("low")
    )


def day_key(ts: Column) -> Column:
    """Calendar day in the session zone, which is UTC."""
    return F.date_format(ts, "yyyy-MM-dd")
