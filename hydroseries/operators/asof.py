"""As-of joins of a stepwise driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries.functions import timeparts as tp
from hydroseries.operators.frames import scan_series


def asof_fill(
    left: DataFrame,
    steps: DataFrame,
    ts: str,
    step_ts: str,
    columns: Sequence[str],
    keys: Sequence[str] = (),
    tolerance_hours: float | None = None,
    chunk_days: int = 7,
) -> DataFrame:
    """Add the columns of the latest step at or before ``ts``; NULL before the first step.

    Without a tolerance the last step holds for ever; with one, a step holds while its age
    is less than the tolerance. ``steps`` has at most one row per key and time. With
    ``keys`` both sides are cut into time chunks per key; without, the distinct times of
    ``left`` form one timeline that is filled once and joined back by equality, however
    many series share it.
    """
    keys = list(keys)
    if not keys:
        times = left.select(F.col(ts).alias("_at")).where(F.col("_at").isNotNull()).distinct()
        line = _union_fill(times, steps, "_at", step_ts, columns, [], tolerance_hours, chunk_days)
        return left.join(line, left[ts] == line["_at"], "left").select(*[left[c] for c in left.columns], *columns)
    return _union_fill(left, steps, ts, step_ts, columns, keys, tolerance_hours, chunk_days)


def _union_fill(left, steps, ts, step_ts, columns, keys, tolerance_hours, chunk_days) -> DataFrame:
    step = F.struct(F.col(step_ts).cast("timestamp_ntz").alias("_step_ts"), *[F.col(c) for c in columns])
    row = F.struct(*[F.col(c) for c in left.columns])
    mark = steps.select(*keys, F.col(step_ts).cast("timestamp_ntz").alias("_t"), F.lit(0).alias("_side"), step.alias("_step"))
    ask = left.select(*keys, F.col(ts).cast("timestamp_ntz").alias("_t"), F.lit(1).alias("_side"), row.alias("_row"))
    both = mark.unionByName(ask, allowMissingColumns=True).withColumn(
        "_chunk", F.floor(tp.day_number(F.col("_t")) / chunk_days)
    )
    if not keys:
        both = both.withColumn("_all", F.lit(0))
    both = scan_series(both, keys or ["_all"], "_chunk", ["_t", "_side"], ffill={"_hit": F.col("_step")})
    fresh = F.lit(True)
    if tolerance_hours is not None:
        fresh = tp.hours_between(F.col("_t"), F.col("_hit._step_ts")) < tolerance_hours
    value = lambda c: F.when(fresh, F.col("_hit")[c]).alias(c)
    return both.where(F.col("_side") == 1).select("_row.*", *[value(c) for c in columns])


def day_fill(left: DataFrame, daily: DataFrame, at: Column, day: str, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """As-of on a gap-free daily grid with a tolerance of one day: an equality join on the day of ``at``."""
    right = daily.select(*keys, F.col(day).cast("date").alias("_day"), *columns)
    return left.withColumn("_day", at.cast("date")).join(right, [*keys, "_day"], "left").select(*left.columns, *columns)
