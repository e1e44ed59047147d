"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the columns of
documents. The decisions of a stage take effect in its result.

Defined results of all stages: no rows give no rows; repeated rows are judged alike; nulls in columns that a stage doesn't read are
carried. Of single stages: rows without text, or with too few words, go in quality_rules and stay elsewhere; rows without an id are
never near duplicates and stay; rows that repeat one id and text stay together with it, as near-duplicate groups keep ids; ties
between copies go to the smallest id; long texts are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lineara.llm import decontaminate, mixing, neardup, quality, sharding
from lineara.session import shared_dir, table

#: Least similarity of near duplicates, in percent.
SIMILARITY = 80
#: Token shares of the mixture; the size is set by the clean domain, whose documents are all taken once.
WEIGHTS = {"clean": 0.99, "junk": 0.01, "toxic": 0.0}
SHARDS = 16


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood-ratio threshold."""
    return quality.judge(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest id."""
    kept = neardup.groups(docs, SIMILARITY).where("kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the rates that meet WEIGHTS; rates are at most 1, so nothing is repeated."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"), WEIGHTS, max_rate=1.0, anchor="clean")


def sharding_by_size(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard, slot and size."""
    return sharding.assign_shards(docs, SHARDS).select(*docs.columns, "size", F.col("shard").cast("int").alias("shard"), "slot")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_to_targets),
    ("sharding", sharding_by_size),
]

#: Hashed models, MinHash and projected gradients can't be stated in SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again."""
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
