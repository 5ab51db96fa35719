"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread.

Every stage takes (spark, docs, sf_dir) and works on all that the one before has kept; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from windlass.llm import decontaminate, knn_quality, mixing, sharding, simhash
from windlass.llm.common import checkpoint_folder, delete_folder

#: Tokens that the mixing stage draws, as a share of those it gets.
MIX_BUDGET = 0.8


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour vote takes for label 1."""
    return knn_quality.drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near copies: texts whose 5-word shingles
    are similar to 0.8 or more, directly or through others."""
    return simhash.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the probabilities of raked source, language and topic weights."""
    return mixing.draw(docs, budget=MIX_BUDGET)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the slot and shard they are placed in."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; what one returns is written to the shared folder and read again, and
    deleted when the last stage has been written."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    STAGES[-1][1](spark, docs, sf_dir).write.parquet(f"{folder}/{len(STAGES) - 1}")
    for k in range(len(STAGES) - 1):
        delete_folder(spark, f"{folder}/{k}")
    return spark.read.parquet(f"{folder}/{len(STAGES) - 1}")


#: Trained and latent-space stages have no SQL; the tests compare with brute-force versions.
ORACLE_SQL = None
