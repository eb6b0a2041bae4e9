"""Lag correlation and the response of levels to events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries.functions import timeparts as tp
from hydroseries.operators.frames import in_blocks, join_per_key
from hydroseries.operators.quantiles import medians
from hydroseries.operators.scores import in_windows
from hydroseries.operators.windows import positioned, shifted


def lag_correlation(
    df: DataFrame, keys: Sequence[str], ts: str, target: str, drivers: Mapping[str, str],
    max_lag: int = 72, min_pairs: int = 30, strict_time: bool = False,
) -> DataFrame:
    """corr(target(t), driver(t - lag)) for lag 0..max_lag; NULL below ``min_pairs`` pairs.

    Lags are taken inside bounded blocks; the exploded pairs are folded to moments before
    any shuffle. A lag counts rows, with ``strict_time`` hours (an absent hour gives no pair).
    """

    def lags(c):
        return lambda w: F.array(*[shifted(c, -k, strict_time)(w) for k in range(max_lag + 1)])

    out = in_blocks(
        positioned(df, keys, ts, strict_time), keys, "pos", {f"_{n}": lags(c) for n, c in drivers.items()}, before=max_lag
    )
    out = out.where(F.col(target).isNotNull())
    both = F.arrays_zip(*[F.col(f"_{n}").alias(n) for n in drivers])
    long = out.select(*keys, F.col(target).alias("_y"), F.posexplode(both).alias("lag_h", "_d"))
    aggs = []
    for n in drivers:
        x = F.col(f"_d.{n}")
        y = F.when(x.isNotNull(), F.col("_y"))
        aggs.append(
            F.struct(F.lit(n).alias("var"), F.when(F.count(x) >= min_pairs, F.corr(y, x)).alias("corr")).alias(f"_{n}")
        )
    wide = long.groupBy(*keys, "lag_h").agg(*aggs)
    return wide.select(*keys, "lag_h", F.inline(F.array(*[F.col(f"_{n}") for n in drivers])))


def best_lag(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lag of the greatest absolute correlation, the smallest lag on ties."""
    order = F.when(F.col("corr").isNotNull(), F.struct(-F.abs("corr"), F.col("lag_h")))
    best = curve.groupBy(*keys, "var").agg(F.min_by(F.struct("lag_h", "corr"), order).alias("_b"))
    return best.select(*keys, "var", "_b.lag_h", "_b.corr")


def classify(rain: Column, tide_lag: Column, rain_mm: float = 5.0, lag_hours: float = 6.0) -> Column:
    """Both signals or none is compound, rain alone pluvial, a close tide peak alone tidal."""
    wet = F.coalesce(rain >= rain_mm, F.lit(False))
    tidal = F.coalesce(F.abs(tide_lag) <= lag_hours, F.lit(False))
    return F.when(wet == tidal, "compound").when(wet, "pluvial").otherwise("tidal")


def event_response(
    df: DataFrame, events: DataFrame, keys: Sequence[str], ts: str, level: str, tide: str, rain: str,
    pad_days: int = 3, rain_hours: int = 72, repeat_factor: float = 24.0,
) -> DataFrame:
    """Peak, tide at the peak, antecedent rain and lags per event and series, and the class of the event.

    Antecedent rain only reaches back to the start of the padded window and is divided by
    ``repeat_factor``, as daily values repeat hourly. ``events`` has event, start, end, type.
    """
    keys = list(keys)
    part = ["event", *keys]
    rows = in_windows(df.select(*keys, ts, level, tide, rain), ts, events.select("event", "start", "end"), pad_days)
    at = F.col(ts)
    top = lambda c: F.when(F.col(c).isNotNull(), F.struct(-F.col(c), at))
    peaks = rows.groupBy(*part).agg(
        F.max(level).alias("peak_level"),
        F.min_by(F.struct(at.alias("ts"), F.col(tide).alias("tide")), top(level)).alias("_pk"),
        F.min_by(at, top(tide)).alias("_tide_max_ts"),
        F.min(F.when(F.col(rain) > 0, at)).alias("_onset"),
    )
    peaks = peaks.where(F.col("_pk").isNotNull()).withColumn("peak_ts", F.col("_pk.ts"))
    before = join_per_key(rows, peaks.select(*part, "peak_ts"), part, ts, "inner")
    recent = at.between(tp.shift_hours(F.col("peak_ts"), -rain_hours), F.col("peak_ts"))
    wet = before.where(recent).groupBy(*part).agg((F.sum(rain) / repeat_factor).alias("rain_before"))
    stats = peaks.join(wet, part, "left").select(
        *part,
        F.round("peak_level", 1).alias("peak_level"),
        "peak_ts",
        F.round("_pk.tide", 3).alias("tide_at_peak"),
        "rain_before",
        tp.hours_between(F.col("peak_ts"), F.col("_tide_max_ts")).alias("lag_tide_h"),
        tp.hours_between(F.col("peak_ts"), F.col("_onset")).alias("lag_rain_h"),
    )
    mid = medians(stats, ["event"], ["rain_before", "lag_tide_h"])
    kinds = mid.select("event", classify(F.col("rain_before"), F.col("lag_tide_h")).alias("type_computed"))
    given = events.select("event", F.col("type").alias("type_given"))
    return stats.join(kinds, "event").join(given, "event")


def class_agreement(response: DataFrame) -> DataFrame:
    """Number of events, number whose given type names the computed one, and the events that disagree."""
    per_event = response.select("event", "type_given", "type_computed").distinct()
    same = F.instr(F.lower("type_given"), F.col("type_computed")) > 0
    return per_event.agg(
        F.count("*").alias("n_events"),
        F.count_if(same).alias("n_agree"),
        F.avg(same.cast("double")).alias("agreement"),
        F.array_join(F.array_sort(F.collect_list(F.when(~same, F.col("event")))), ",").alias("disagree"),
    )


def mean_removed(df: DataFrame, part: Sequence[str], value: str, spread: str, out: str = "anomaly") -> DataFrame:
    """Value minus the mean of its group; an aggregate joined back, so large groups stay spread."""
    mean = df.groupBy(*part).agg(F.avg(value).alias("_mean"))
    return join_per_key(df, mean, part, spread).withColumn(out, F.col(value) - F.col("_mean")).drop("_mean")
