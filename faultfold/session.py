"""Session defaults and materialisation in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(app_name: str = "faultfold", master: str | None = None, **conf) -> SparkSession:
    """Session with UTC days and adaptive execution; ``conf`` overrides win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_own: dict[str, str] = {}


def use_shared_folder(spark: SparkSession, folder: str | None = None) -> None:
    """Name the folder for intermediate files where the session has no ``spark.checkpoint.dir``.

    Without ``folder`` it is one in the warehouse, which all executors share as well.
    """
    folder = folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
    _own[spark.sparkContext.applicationId] = folder


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: ``spark.checkpoint.dir``, or the one that was named."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    folder = folder or _own.get(spark.sparkContext.applicationId)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Used where a result feeds several branches: the expensive input is then evaluated a single
    time, the lineage is cut, and a lost executor re-reads files instead of recomputing.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/faultfold/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
