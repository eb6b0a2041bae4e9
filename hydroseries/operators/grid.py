"""Complete time grids and hourly aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries.functions import timeparts as tp


#: Steps that one row is expanded into; about a year of hours.
STRETCH = 8192

#: Tasks that the hours of all keys are dealt over; by their size on disk, a few bytes an hour, adaptive execution would make far fewer.
GRID_TASKS = 128


def complete_grid(df: DataFrame, keys: Sequence[str], ts: str, step: str = "interval 1 hour") -> DataFrame:
    """Every step between first and last time of each key; absent steps are rows of NULLs.

    Steps are made in two levels: first the starts of stretches of ``STRETCH`` steps, which are dealt out, then the steps of each
    stretch. So a key with any number of steps is the work of many tasks, and no row holds more than a stretch of them. The starts of
    all keys are a few bytes each: dealt out by size, one task would make every step.
    The grid is estimated by the few starts it is made of; a caller that turns the join into an inner one (by asking for values) would
    have all of it broadcast, so both sides are sorted and merged.
    """
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    one, many = F.expr(step), F.expr(f"{step} * {STRETCH}")
    starts = span.select(*keys, "_hi", F.explode(F.sequence("_lo", "_hi", many)).alias("_at")).repartition(GRID_TASKS, *keys, "_at")
    last = F.least(F.col("_hi"), F.col("_at") + F.expr(f"{step} * {STRETCH - 1}"))
    grid = starts.select(*keys, F.explode(F.sequence(F.col("_at"), last, one)).alias(ts))
    return grid.repartition(GRID_TASKS, *keys, ts).hint("merge").join(df, [*keys, ts], "left").select(*df.columns)


def resample_hourly(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    flag: str = "qc_flag",
    by_year: bool = True,
    min_obs: int = 2,
    degraded_from: float = 0.5,
) -> DataFrame:
    """Hourly mean, maximum, count and share of flagged points on a complete hourly grid.

    Flags: 0 ok, 8 degraded (half of the points or more carry a flag), 9 gap (fewer than
    ``min_obs`` values). Flagged points stay in mean and maximum. The grid runs from the
    first to the last hour of the key and year (``by_year``) or of the key.
    """
    keys = list(keys)
    v = F.col(value)
    work = df.withColumn("_hour", tp.hour_of(F.col(ts)))
    part = [*keys, "_year"] if by_year else keys
    if by_year:
        work = work.withColumn("_year", F.year(ts))
    hourly = work.groupBy(*part, "_hour").agg(
        F.avg(v).alias("mean"),
        F.max(v).alias("max"),
        F.count(v).alias("n_obs"),
        F.avg((F.col(flag) != 0).cast("double")).alias("_share"),
    )
    full = complete_grid(hourly, part, "_hour")
    n = F.coalesce(F.col("n_obs"), F.lit(0))
    share = F.bround(F.coalesce(F.col("_share"), F.lit(0.0)), 4)
    return full.select(
        *keys,
        F.col("_hour").alias(ts),
        "mean",
        "max",
        n.alias("n_obs"),
        share.alias("pct_flagged"),
        F.when(n < min_obs, 9).when(share >= degraded_from, 8).otherwise(0).cast("int").alias(flag),
    )
