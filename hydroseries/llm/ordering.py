"""Ranks and running sums over orders too long for one task, with built-in functions only.

A row's place in its group is the sum over all earlier slices of the order plus its place in
its own slice. Slices are equal ranges of a hash (or of a rank fraction), so they have nearly
equal sizes whatever the group sizes are; only one row per (group, slice) is windowed per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hydroseries.session import cut_lineage

#: Slices of one group. A group of 10^11 rows has slices of 24 million rows, which sort within a task.
SLICES = 4096


def digest_order(seed: int, id_col: str = "doc_id") -> Column:
    """A seeded random order that any engine can repeat: hexadecimal digits of an MD5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def digest_slice(h: str) -> Column:
    """The first three digits (4096 values); slices follow the order of the digest."""
    return F.conv(F.substring(h, 1, 3), 16, 10).cast("int")


def range_slices(df: DataFrame, *order: Column) -> DataFrame:
    """Add ``_slice``, non-decreasing along ``order``: the partition after a range sort.

    Sampled borders may change when a partition is computed again, so the result is written once.
    """
    return cut_lineage(df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()))


def running(
    df: DataFrame, group: Sequence[str], slice_col: str, order: Sequence[Column | str], value: Column, out: str,
    total: str | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows of the group before this one; ``total``: its sum over the group.

    ``slice_col`` must be non-decreasing along ``order``. Nulls of a group column compare as equal. The sums per
    slice are folded before they are shuffled; slices are dealt out by (group, slice), never by group.
    """
    names = [f"_g{i}" for i in range(len(group))]
    # A null key gets a text no other key has: every other one starts with "=".
    keys = {n: F.coalesce(F.concat(F.lit("="), F.col(g).cast("string")), F.lit("")) for g, n in zip(group, names)}
    df = df.withColumns({**keys, "_v": value})
    sums = df.groupBy(*names, slice_col).agg(F.sum("_v").alias("_sum"))
    whole = Window.partitionBy(*names)
    ahead = whole.orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        *names, slice_col, F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"),
        F.sum("_sum").over(whole).alias("_total"),
    )
    inner = Window.partitionBy(*names, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("_v").over(inner), F.lit(0))
    df = df.join(before, [*names, slice_col]).withColumn(out, F.col("_before") + within)
    df = df.withColumn(total, F.col("_total")) if total else df
    return df.drop(*names, "_v", "_before", "_total")
