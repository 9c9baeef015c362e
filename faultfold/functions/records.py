"""Column functions over internal log records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultfold.functions.text import fold_case

# Attributes that name a component, with the prefix each is shown with.
COMPONENT_KEYS = {"worker": "worker:", "app": "", "source": "src:"}


def record_component(attrs: Column) -> Column:
    """Component named by the first attribute, in record order, that can name one."""
    first = F.try_element_at(
        F.filter(attrs, lambda a: a["key"].isin(*COMPONENT_KEYS)), F.lit(1)
    )
    shown = F.lit("")
    for key, prefix in COMPONENT_KEYS.items():
        shown = F.when(first["key"] == key, F.concat(F.lit(prefix), first["value"])).otherwise(shown)
    return F.coalesce(shown, F.lit(""))


def record_text(message: Column, attrs: Column) -> Column:
    """Searchable text: the message followed by `` key=value`` of each attribute."""
    pairs = F.transform(
        attrs,
        lambda a: F.concat(
            F.coalesce(a["key"], F.lit("")), F.lit("="), F.coalesce(a["value"], F.lit(""))
        ),
    )
    return F.concat_ws(" ", F.coalesce(message, F.lit("")), pairs)


def record_matches(level: str | None, text: str | None) -> Column:
    """Predicate: exact level and case-blind text; both optional."""
    test = F.lit(True)
    if level:
        test = test & (F.col("level") == level)
    if text:
        haystack = fold_case(record_text(F.col("message"), F.col("attrs")))
        test = test & haystack.contains(fold_case(F.lit(text)))
    return test
