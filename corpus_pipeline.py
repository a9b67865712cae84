"""From raw documents to balanced shards: five stages, each written as Parquet and read again as the next one's input.

A stage takes (spark, docs, sf_dir) and returns the rows it keeps with all columns of ``docs``; the last returns shards.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.llm import decontaminate, mixing, sharding, simhash, toxicity
from marginalia.llm.queries import SHARD_BYTES, table
from marginalia.llm.shared import without
from marginalia.session import checkpoint_root, ship_package


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go. The index is learned from ``docs`` and the label table."""
    ship_package(spark)
    index = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.accepted(toxicity.scorer(docs, index)(F.col("text"))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose SimHash fingerprints link, as in op6, the one with the smallest id stays.

    Documents without a word share a fingerprint and so leave one. Rows with a null id stay; rows that repeat
    an id stay or go together.
    """
    ship_package(spark)
    found = simhash.near_duplicates(docs)
    return without(docs, found.filter("doc_id <> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a test item go."""
    return without(docs, decontaminate.overlaps(docs, table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in target proportions: documents beyond a source's target go, those taken twice appear twice."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, bytes and shard of every row."""
    ship_package(spark)
    return sharding.assign(docs, SHARD_BYTES)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("sharding", shard),
]

# Nearest neighbours, components and repeated splits have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result lies in the shared checkpoint folder."""
    place = f"{checkpoint_root(spark)}/marginalia/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{place}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
