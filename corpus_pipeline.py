"""A training corpus from raw documents: quality, near-duplicates, decontamination, mixing and sharding, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of
the next one. All but the last return the columns of docs; the last adds the column `shard`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontam, mixing, quality, sharding, simhash
from quire.llm.common import stored

SHARDS = 8


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from labels, rejects go.

    Null and empty texts are judged as texts without words, rows that repeat alike; an empty table stays empty. Without
    labels of both classes all documents have one score: all stay or all go.
    """
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the least doc_id, null last.

    Null and empty texts are one group; a row that repeats stays once; an empty table stays empty.
    """
    return simhash.first_of_groups(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go, with all rows of their doc_id.

    Null and empty texts hold nothing, items without words are held by nothing; empty tables change nothing.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their weights: a document's row comes as often as the mix takes it, twice at most.

    Null is a source, last in order. Documents without words come like others of their hash, but not beyond their
    source's cap; rows that repeat come alike; an empty table stays empty.
    """
    return mixing.apply_mix(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard by jump hashing of its doc_id, a null one too; nothing else decides, and no row goes."""
    return sharding.assign(docs, SHARDS)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: A trained classifier and XXH64 fingerprints have no SQL form; the tests hold run() against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. What each but the last returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
