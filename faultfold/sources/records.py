"""Internal log records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultfold import schemas


def log_records(df: DataFrame, prelude: str = "prelude") -> DataFrame:
    """Records with the logger's own attributes placed before those of the record."""
    attrs = F.coalesce(F.col("attrs"), F.array().cast("array<struct<key:string,value:string>>"))
    if prelude in df.columns:
        attrs = F.concat(F.coalesce(F.col(prelude), F.array().cast(
            "array<struct<key:string,value:string>>")), attrs)
    return df.withColumn("attrs", attrs).select(*schemas.column_names(schemas.LOG_RECORD))
