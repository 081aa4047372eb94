"""The corpus pipeline: from raw documents to mixed, sharded training data.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame, which is
written as Parquet in the shared folder and read back as the next stage's ``docs``.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklight.llm import decontaminate, mixing, neardup, quality, sharding
from tracklight.llm.common import fresh, read, spool


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.drop_low_quality(docs, read(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return neardup.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark contamination by the rule of op1."""
    name = fresh(docs, "contamination")
    found = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), name=name)
    return found.where(~decontaminate.contaminated(name)).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times."""
    return mixing.mixed_copies(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with its shard and its slot in it."""
    placed = sharding.shard(docs)
    name = placed.columns[-1]
    shard, slot = fresh(docs, "shard"), fresh(docs, "slot")
    return placed.select(*docs.columns, F.col(f"{name}.shard").alias(shard), F.col(f"{name}.slot").alias(slot))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The classifier and the tilted rates have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = spool(docs, name)
    return docs
