"""Corpus pipeline: quality filter, near-duplicate removal, decontamination, source mix, shards.

Each stage takes (spark, docs, sf_dir) with docs as written by the stage before and
returns the columns of `documents`; the last one adds where each document is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recolumn.llm import cluster, decontaminate, mixing, near_dedup, quality, sharding


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id; so does one of rows that repeat a text without an id."""
    return near_dedup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as read back from the committed shards, with shard and shard_bytes (an underscore in front if the name is taken)."""
    return sharding.sharded(docs)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the committed shards; tables that a stage kept go when its result is written, and that result once the next stage has read it."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with cluster.scope() as own:
            docs = stage(spark, docs, sf_dir)
            if name != STAGES[-1][0]:
                docs = own.keep(cluster.durable(docs))
        cluster.release(written)
        written = docs if name != STAGES[-1][0] else None
    return docs
