"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows are shuffled within their source by a seeded hash and ranked; row r of n lies at the fraction
(r + 1/2) / n. Sorted by fraction, every stretch of the order holds the sources in the proportions of
the whole, so equal cuts give shards that all match the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hydroseries.llm.common import packed
from hydroseries.llm.ordering import SLICES, digest_order, digest_slice, running
from hydroseries.session import cut_lineage


ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard_rows(
    docs: DataFrame, shards: int = 24, seed: int = 11, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row of ``docs``.

    The law is ``rows``: shards hold counts at most one apart; slots run from 0 without gaps in the interleaved
    order; ``grown_shard`` is null (it belongs to the law ``key``). Any two shards differ by two rows of a source at most.

    Null text: size 8, checksum 0. A null source is a source of its own. Null or repeated ids are rows like others:
    equal rows may change places with each other, which changes no result. Fewer rows than shards: some stay empty.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    # A few dozen bytes a row are written once; texts are read once.
    rows = cut_lineage(rows.withColumn("_h", digest_order(seed)).withColumn("_slice", digest_slice("_h")))
    tie = ["_h", "doc_id", "text_crc32", "size"]
    rows = running(rows, ["source"], "_slice", tie, F.lit(1), "_rank", "_n").drop("_slice")
    rows = rows.withColumn("_at", (F.col("_rank") * 2 + 1) / (F.col("_n") * 2))
    rows = rows.withColumn("_slice", F.least(F.lit(SLICES - 1), F.floor(F.col("_at") * SLICES).cast("int")))
    # Each slice of fractions holds an equal part of each source, so slices are equally large.
    order = [F.col("_at"), F.col("source").asc_nulls_last(), *map(F.col, tie)]
    rows = running(rows, [], "_slice", order, F.lit(1), "_place", "_all")
    rows = rows.withColumn("shard", F.expr(f"int(_place * {shards} div _all)"))
    slot = F.expr(f"_place - (shard * _all + {shards - 1}) div {shards}").cast("long")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def sharded_documents(docs: DataFrame, **options) -> DataFrame:
    """The columns of ``docs`` with size, text_crc32, law, shard, slot and grown_shard, which replace columns of their names.

    Repeated rows are numbered on both sides, so that each gets one of their places.
    """
    ids, text = options.get("id_col", "doc_id"), options.get("text_col", "text")
    made = shard_rows(docs, **options)
    crc = F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))
    left = packed(docs, _id=F.coalesce(F.col(f"`{ids}`").cast("string"), F.lit("null")), _crc=crc, _size=F.octet_length(f"`{text}`"))
    left = left.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_crc").orderBy("_size")))
    right = made.withColumns({"_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "_crc": F.col("text_crc32")})
    right = right.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_crc").orderBy("size", "shard", "slot")))
    joined = left.join(right.drop("doc_id"), ["_id", "_crc", "_nth"])
    old = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ADDED]
    return joined.select(*old, *ADDED)
