"""The corpus pipeline: documents through the stages below, each on all rows that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tiffin.llm import decontam, jaccard, language, mixing, sharding
from tiffin.llm.common import new_folder, table


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language stay; those without letters, or mostly of words that no language knows, go."""
    return language.accepted(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id: five words, similarity 0.8."""
    return jaccard.one_per_group(docs, 5, 80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeated(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    return sharding.minimax_shards(docs, 16)


STAGES = [
    ("language", with_language),
    ("near_copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Learned and similarity stages have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for n, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}-{name}")
        docs = spark.read.parquet(f"{folder}/{n}-{name}")
    return docs
