"""The corpus pipeline: documents in, shards of a cleaned, deduplicated and mixed corpus out.

Every stage takes what the one before kept, with all columns of documents, and hands on the same
columns; the last one returns each row's shard and place in it.  Null ids, null and empty texts,
repeated rows and further columns pass through as the stages' operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, mixing, quality, sharding, simhash
from plumbline.llm.common import stored, table
from plumbline.llm.queries import (
    MIX_MOST, MIX_WEIGHTS, NEAR_BITS, QUALITY_FOLDS, QUALITY_HELD_OUT, SHARDS, SHINGLE, WINDOW)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality field accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), QUALITY_HELD_OUT, QUALITY_FOLDS)
    return quality.keep(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id."""
    return simhash.deduplicate(docs, SHINGLE, NEAR_BITS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), WINDOW)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target asks for."""
    return mixing.apply(docs, MIX_WEIGHTS, MIX_MOST)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's shard and place in it."""
    return sharding.assign(docs, SHARDS)


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", decontaminated),
          ("mixing", mixed), ("sharding", sharded)]
#: Trained weights and fingerprints are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what the one before kept; each result is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
