"""Mixing sources to target weights.

Every row gets a hash-random key, rows are range-sorted by it within their source, distributed
prefix sums of token counts tell where each row lies, and the mix is cut at the source's exact
budget. A budget above the source's size repeats the source: whole epochs, then a part of one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hydroseries.llm.common import packed
from hydroseries.llm.ordering import digest_order, digest_slice, range_slices, running
from hydroseries.session import cut_lineage

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most_epochs: int = 2
) -> DataFrame:
    """source, source_size -> the same and target (double): each source's part of ``share`` times all sizes.

    Sources in code point order, null last, take the weights in turn. A target stops at ``most_epochs`` times
    its source's size; the excess is dealt out again by weight until none is above. With sources in order of
    (cap / weight) that is one level: the capped ones come first, all others get level times weight.
    """
    keyed = sizes.withColumn("_null", F.col("source").isNull())
    ranked = running(
        range_slices(keyed, F.col("_null"), F.col("source")), [], "_slice", ["_null", "source"], F.lit(1), "_rank"
    ).drop("_slice", "_null")
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % n + 1).cast("int"))
    cap = (F.col("source_size") * most_epochs).cast("double")
    ranked = ranked.withColumns({"_weight": weight, "_cap": cap})
    ranked = range_slices(ranked.withColumn("_ratio", F.col("_cap") / F.col("_weight")), F.col("_ratio"), F.col("_rank"))
    order = ["_ratio", "_rank"]
    level = running(ranked, [], "_slice", order, F.col("_cap"), "_capped", "_all")
    level = running(level, [], "_slice", order, F.col("_weight"), "_used", "_weights")
    budget = F.col("_all") / most_epochs * share
    at = (budget - F.col("_capped")) / (F.col("_weights") - F.col("_used"))
    free = F.when(at <= F.col("_ratio"), at)
    # The first source that is not capped gives the level; none is free only if the caps hold no more than the budget.
    found = level.select(F.min_by(free, F.when(free.isNotNull(), F.struct(*order)))).first()[0]
    target = F.col("_cap") if found is None else F.least(F.col("_cap"), F.lit(found) * F.col("_weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most_epochs: int = 2, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", whole: bool = False,
) -> DataFrame:
    """doc_id, text_hash, size, source_size, target, taken: one row per row of ``docs``.

    ``taken`` counts the words the mix takes from the row, repeats counted; per source they add up to the target
    rounded to a whole word. ``whole=True`` takes the row at the border entirely if half of it or more fits, and
    else not, so that no document is torn. The order depends on seed and id only, so reruns agree.

    Null text: size 0, taken 0. A null source is a source of its own, the last one. Null or repeated ids are rows
    like others; equal ids lie next to each other, in order of size and hash. No rows: no rows.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"),
    )
    # Written once: a few dozen bytes a row, so that texts are read once and not by each of the steps below.
    rows = cut_lineage(rows.withColumn("_h", digest_order(seed)).withColumn("_slice", digest_slice("_h")))
    targets = source_targets(
        rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most_epochs
    )
    rows = running(rows, ["source"], "_slice", ["_h", "doc_id", "size", "text_hash"], F.col("size"), "_start")
    rows = rows.alias("r").join(targets.alias("t"), F.expr("r.source <=> t.source")).select("r.*", "source_size", "target")
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("_budget div source_size")).otherwise(F.lit(0))
    rows = rows.withColumn("_budget", budget).withColumn("_epochs", epochs)
    left = F.col("_budget") - F.col("_epochs") * F.col("source_size") - F.col("_start")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left))
    if whole:
        part = F.when(part * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    taken = (F.col("_epochs") * F.col("size") + part).cast("long")
    return rows.select("doc_id", "text_hash", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, whole documents only.

    Documents of no words weigh nothing in any mix and are left out.
    """
    taken = mix_sources(docs, whole=True, **options).where(F.col("taken") > 0)
    # Equal rows (same id, same text) carry equal copies in any order, so they are folded before the join.
    copies = taken.groupBy("doc_id", "text_hash").agg(
        F.sum(F.expr("taken div size")).alias("_copies"), F.count("*").alias("_rows")
    )
    ids, text = options.get("id_col", "doc_id"), options.get("text_col", "text")
    keyed = packed(docs, _key=F.col(f"`{ids}`").cast("long"), _hash=F.xxhash64(F.col(f"`{text}`")))
    joined = keyed.join(copies, F.col("_key").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")))
    # A repeated row takes its share of the copies; the remainder goes to the first ones.
    nth = F.row_number().over(Window.partitionBy("_key", "_hash").orderBy("_hash"))
    joined = joined.withColumn("_nth", F.when(F.col("_rows") > 1, nth).otherwise(1))
    times = F.expr("int(_copies div _rows) + int(_nth <= _copies % _rows)")
    return joined.withColumn("_n", F.explode(F.array_repeat(F.lit(1), times))).select("_row.*")
