"""A corpus from raw documents to packed sequences, in five stages.

Every stage takes all rows that the stage before it kept. A stage's result is written as Parquet
in the shared scratch folder and read again, so a lost executor costs one stage at most.

Defined results: a missing text counts as empty; empty texts equal each other, so of those that
the classifier keeps one stays; rows without an id pass the stages that name documents by it and are
packed; of rows that repeat id and text all stay; columns besides those of documents pass all stages
but the last, whatever their names; very long texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluicegate.llm.decontaminate import drop_contaminated
from sluicegate.llm.exact_dedup import drop_duplicates
from sluicegate.llm.near_dedup import Shingling, drop_near_duplicates
from sluicegate.llm.packing import pack
from sluicegate.llm.quality import keep_good, train_quality
from sluicegate.llm.tokens import public_file
from sluicegate.plans.scratch import Scratch

# A stage on word shingles takes five words.
NEAR = Shingling(words=5, percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects; it learns from the labelled ones."""
    return keep_good(docs, train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of each group of equal texts."""
    return drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of each group of near-duplicates."""
    return drop_near_duplicates(docs, NEAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a test item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of what is left; one row per piece."""
    return pack(docs, public_file("byte_bpe_50k.json"), end_id=1)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near),
          ("decontaminate", decontaminate), ("packing", packing)]

# The classifier and the tokeniser cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(name, stage(spark, docs, sf_dir))
        scratch.free_shuffles()
    return docs
