"""From raw documents to training shards: language, near-duplicates, benchmark leaks, mixture, shards.

Each stage is one operator of ``hydroseries.llm``, works on all rows its predecessor kept, and returns rows with the
columns of ``documents``; the last adds each row's shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hydroseries.llm.common import documents
from hydroseries.llm.dartmin import without_near_copies
from hydroseries.llm.hyperdim import keep_known_languages
from hydroseries.llm.latent import without_leaks
from hydroseries.llm.mixing import mixed_documents
from hydroseries.llm.sharding import sharded_documents
from hydroseries.session import cut_lineage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in some language."""
    return keep_known_languages(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest id."""
    return without_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mixture takes them: a row per copy."""
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with size, text_crc32, law, shard, slot and grown_shard."""
    return sharded_documents(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: Three stages are not expressible in SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
