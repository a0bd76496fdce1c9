"""The corpus pipeline: quality rules, near-dedup, suffix dedup, decontamination and encoding, in this order.

Null and empty texts fail the quality rules. Repeated rows leave one. Null and repeated ids name nothing: rows are told apart by
id and text. Very long texts are read whole. Columns beyond those of ``documents`` pass through whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from attesta.llm import bpe
from attesta.llm import decontaminate as dc
from attesta.llm import near as nd
from attesta.llm import quality as ql
from attesta.llm import suffix_dedup as sd
from attesta.plans.lineage import cut


def _small_batches(spark: SparkSession) -> None:
    """Texts pass to Python a thousand at a time: batches of the default size take hundreds of MB of an executor."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return ql.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id: SimHash finds candidates, 0.8 similarity in five-word shingles links."""
    _small_batches(spark)
    return nd.deduplicate(docs, shingle=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that occur earlier go from the texts."""
    _small_batches(spark)
    return sd.deduplicate(docs, length=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go from the texts; a text that is mostly benchmark goes altogether."""
    _small_batches(spark)
    return dc.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_run=10, max_coverage=0.5)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``token_ids``."""
    _small_batches(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: Four of the five stages can't be said in SQL; tests/llm holds the whole against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
