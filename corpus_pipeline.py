"""A corpus from raw documents to packed sequences: five stages, each written and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact, packing, passages, quality, queries, simhash
from tessera.storage import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The most bytes that Spark hands to a Python worker at once (one row at least): batches are held by the JVM and by the worker, some of them twice.
BATCH_BYTES = "4m"


def in_small_batches(stage: Stage) -> Stage:
    """stage, with the session's Arrow batches bounded by BATCH_BYTES from then on, since its result runs later. Rows are the same."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney classifier doesn't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@in_small_batches
def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the smallest doc_id."""
    return exact.exact_dedup(docs)


@in_small_batches
def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, by fingerprints of five-word shingles, the one with the smallest doc_id."""
    return simhash.simhash_dedup(docs)


@in_small_batches
def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has."""
    return passages.remove_passages(docs)


@in_small_batches
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 token ids, with the ids."""
    return packing.pack(docs, queries.BYTE_BPE, crc=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", simhash_stage),
    ("substring dedup", passages_stage),
    ("packing", packing_stage),
]

#: The classifier, chaining and tokenizing stages can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
