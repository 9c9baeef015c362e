"""Stages that turn ``documents`` into packed training sequences.

Each stage works on all rows the one before has kept. Columns that ``documents`` has beyond its own are
carried along; rows are kept or dropped one by one, so repeated rows and null ids need no care.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultfold.llm import packing, pii, quality_classifier, quality_rules
from faultfold.llm.common import table, without_ids, written
from faultfold.llm.near_dedup import near_duplicates
from faultfold.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below its threshold go."""
    return quality_classifier.accepted(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the current policy go."""
    return quality_rules.passing(docs, quality_rules.CURRENT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; those without an id stay."""
    copies = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return without_ids(docs, written(copies, "copies"), "doc_id")


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind, and ``n_chars`` follows the text."""
    clean = pii.find(docs, pii.fit(docs), replace=True)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences with the sources in their proportions."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("quality_rules", rules),
    ("near_dedup", near_dedup),
    ("pii", private_data),
    ("packing", packed),
]

#: Learned models and token counts are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
