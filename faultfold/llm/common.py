"""Tables, shared intermediate files and Arrow batches of bounded size."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts can be long, so batches hold fewer rows than Spark's default.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the rows of an Arrow batch for this session, so that batches of long texts stay small."""
    _importable(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def _importable(spark: SparkSession) -> None:
    """Python workers on this machine find the package where the driver found it; clusters get it by --py-files."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, as in tests, a folder of the warehouse, which is shared too."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: evaluated a single time, lineage cut,
    and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{label}-{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """Shuffle files of queries run meanwhile go when these end: their result is written, nothing reads them again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/llm/" in file:
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sampled(rows: DataFrame, key: str, n: int) -> DataFrame:
    """At most about ``n`` of ``rows``, to fit a model on: those whose ``key`` has the smallest hashes.

    Only keys are sorted, and only about four times ``n`` of them; rows with a null key are left out.
    """
    rows = rows.where(F.col(key).isNotNull())
    share = min(1.0, 4 * n / max(1, rows.count()))
    hashed = F.xxhash64(key)
    near = rows.where(F.pmod(hashed, F.lit(1 << 20)) <= F.lit(int(share * (1 << 20))))
    keys = near.select(key).distinct().orderBy(hashed, key).limit(n)
    return rows.join(F.broadcast(keys), key, "left_semi")


#: Slots of hashed ids that are broadcast to find the rows of a table that some ids may concern.
SLOTS = 1 << 19


def without_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` but those whose ``key`` is among ``ids``; null keys stay.

    There are :data:`SLOTS` slots of hashed ids at most, whatever the input. Rows in a slot that no id uses are
    kept where they lie; only the others are shuffled to be compared.
    """
    slots = ids.select(F.pmod(F.xxhash64(key), F.lit(SLOTS)).alias("_used")).distinct()
    slot = F.pmod(F.xxhash64(rows[key]), F.lit(SLOTS))
    clear = rows.join(F.broadcast(slots), slot == slots["_used"], "left_anti")
    near = rows.join(F.broadcast(slots), slot == slots["_used"], "left_semi")
    return clear.union(near.join(ids, key, "left_anti").select(rows.columns))
