"""Exact linear-interpolated quantiles per group, safe for groups of any size.

``percentile`` keeps all distinct values of a group in the memory of one task. Here ranks are found by radix selection: a
double becomes a whole number of 64 bits in the same order, rows are counted by the leading bits of it, and only rows whose
leading bits lead to a wanted rank are looked at further. Counts are folded before they are shuffled, so what moves is a
few thousand counts per group and the values of the wanted cells; these are dealt out by value, so a cell that
holds all rows of a group is spread over tasks too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bits below the first and the second prefix: a prefix holds sign, exponent and 8 bits, the next one 22 bits more. No step
#: orders more than 2^22 counts in one task, however many rows they stand for.
BELOW_FIRST, BELOW_SECOND = 44, 22
_INFINITE = 2047 << 52


def order_key(v: Column) -> Column:
    """A long in the order of the double: the bits of its size, negative below zero. NaN comes last, both zeros are equal."""
    a = F.abs(v)
    two = F.lit(2.0)
    # The logarithm may be off by rounding next to a power of two.
    e = F.floor(F.log2(a)).cast("int")
    e = F.when(F.pow(two, e) > a, e - 1).when(F.pow(two, e + 1) <= a, e + 1).otherwise(e)
    normal = (e + 1023).cast("long") * (1 << 52) + ((a / F.pow(two, e) - 1) * float(1 << 52)).cast("long")
    bits = (
        F.when(a == float("inf"), F.lit(_INFINITE))
        .when(a < 2.0**-1022, (a * 2.0**537 * 2.0**537).cast("long"))
        .otherwise(normal)
    )
    return F.when(F.isnan(v), F.lit(_INFINITE + 1)).when(v < 0, -bits).otherwise(bits)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probs: Mapping[str, float],
    count: str = "n",
    total: str | None = None,
    keep_empty: bool = False,
) -> DataFrame:
    """One row per group: keys (non-null), number of values, one column per quantile.

    ``total`` also asks for the number of rows with missing values included. Groups that hold no value
    at all are left out, or stay with NULLs if ``keep_empty``.
    """
    keys = list(keys)
    if not keys:
        return exact_quantiles(df.withColumn("_g", F.lit(0)), ["_g"], value, probs, count, total, keep_empty).drop("_g")
    rows = df.select(*keys, value.cast("double").alias("_v"))
    if total is None and not keep_empty:
        rows = rows.where(F.col("_v").isNotNull())
    rows = rows.withColumn("_key", order_key(F.col("_v")))
    first = F.shiftright("_key", BELOW_FIRST)
    cells = rows.groupBy(*keys, first.alias("_p1")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    known = F.when(F.col("_p1").isNotNull(), F.col("_c"))
    cells = cells.withColumns(
        {
            "_all": F.sum("_c").over(w),
            "_n": F.coalesce(F.sum(known).over(w), F.lit(0)),
            "_before": F.sum("_c").over(w.orderBy(F.col("_p1").asc_nulls_last())) - F.col("_c"),
        }
    )
    wanted = []
    for name, p in probs.items():
        exact = F.lit(float(p)) * (F.col("_n") - 1)
        low = F.floor(exact).cast("long")
        # Where both ranks are the same the weights are 1 and 0.
        wanted.append(F.struct(F.lit(name).alias("q"), low.alias("r"), (1 - (exact - low)).alias("wt")))
        wanted.append(F.struct(F.lit(name).alias("q"), F.ceil(exact).cast("long").alias("r"), (exact - low).alias("wt")))

    def here(ranks, before: Column, c: str) -> Column:
        return F.filter(ranks, lambda s: (s["r"] >= before) & (s["r"] < before + F.col(c)))

    hits = cells.select(*keys, "_p1", "_n", "_before", here(F.array(*wanted), F.col("_before"), "_c").alias("_want"))
    hits = hits.where((F.size("_want") > 0) & F.col("_p1").isNotNull())
    # Only rows of these cells go on, one per value.
    inside = rows.where(F.col("_key").isNotNull()).withColumn("_p1", first).join(hits.select(*keys, "_p1"), [*keys, "_p1"])
    values = inside.groupBy(*keys, "_p1", "_key").agg(F.count("*").alias("_c"), F.min("_v").alias("_v"))
    second = F.shiftright("_key", BELOW_SECOND)
    parts = values.groupBy(*keys, "_p1", second.alias("_p2")).agg(F.sum("_c").alias("_c")).join(hits, [*keys, "_p1"])
    upto = Window.partitionBy(*keys, "_p1").orderBy("_p2")
    parts = parts.withColumn("_before", F.col("_before") + F.sum("_c").over(upto) - F.col("_c"))
    parts = parts.select(*keys, "_p1", "_p2", "_n", "_before", here(F.col("_want"), F.col("_before"), "_c").alias("_want"))
    last = values.withColumn("_p2", second).join(parts.where(F.size("_want") > 0), [*keys, "_p1", "_p2"])
    last = last.withColumn("_end", F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_p1", "_p2").orderBy("_key")))
    mine = F.filter("_want", lambda s: (s["r"] >= F.col("_end") - F.col("_c")) & (s["r"] < F.col("_end")))
    picked = last.select(*keys, "_n", "_v", F.inline(mine))

    def blend(name: str) -> Column:
        part = F.col("q") == name
        low = F.min(F.when(part, F.col("_v")))
        high = F.max(F.when(part, F.col("_v")))
        frac = F.max_by(F.when(part, F.col("wt")), F.when(part, F.struct("r", "_v")))
        return F.when(low == high, low).otherwise(low + (high - low) * frac)

    out = picked.groupBy(*keys).agg(F.max("_n").alias(count), *[blend(name).alias(name) for name in probs])
    if total is None and not keep_empty:
        return out
    groups = cells.groupBy(*keys).agg(F.max("_n").alias(count), F.max("_all").alias("_all"))
    out = groups.join(out.drop(count), keys, "left" if keep_empty else "inner")
    return out.select(*keys, count, *([F.col("_all").alias(total)] if total else []), *probs)


def medians(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Median of several columns per group, NULLs skipped; groups without any value stay, as NULL."""
    keys, values = list(keys), list(values)
    pairs = F.array(*[F.struct(F.lit(v).alias("_name"), F.col(v).cast("double").alias("_x")) for v in values])
    long = df.select(*keys, F.inline(pairs))
    mid = exact_quantiles(long, [*keys, "_name"], F.col("_x"), {"_m": 0.5}, keep_empty=True)
    return mid.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == v, F.col("_m"))).alias(v) for v in values])
