"""One table of level, rain and tide on an hourly axis, and its repair rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hydroseries.functions import cleaning as cl
from hydroseries.functions import timeparts as tp
from hydroseries.operators.asof import asof_fill
from hydroseries.operators.frames import BLOCK_ROWS, first_per_key, halo, in_blocks, scan_series, with_position
from hydroseries.operators.grid import complete_grid
from hydroseries.operators.sliding import median_of_groups


def harmonize_series(
    target: DataFrame,
    rain_daily: DataFrame,
    tide: DataFrame,
    keys: Sequence[str],
    ts: str,
    zone: str = "UTC",
    rain: str = "rain_mm",
    rain_day: str = "day",
    level: str = "tide_m",
    tolerance_hours: float | None = None,
) -> DataFrame:
    """Complete the hours of the target, put the rain of the UTC day and the tide of the hour on them.

    ``ts`` is local time of ``zone``; ``rain_day`` is the start of a UTC day. Both drivers
    are shared by all series. Missing drivers get flag 0, as only values are judged.
    """
    full = complete_grid(target, keys, ts).withColumn("_utc", tp.local_to_utc(F.col(ts), zone))
    full = asof_fill(full, rain_daily, "_utc", rain_day, [rain], tolerance_hours=tolerance_hours).drop("_utc")
    full = full.join(tide.select(F.col(ts), F.col(level)), [ts], "left")
    return full.select(
        *target.columns,
        rain,
        F.lit("daily").alias("rain_resolution"),
        cl.rain_flag(F.col(rain)).alias("rain_flag"),
        level,
        cl.tide_flag(F.col(level)).alias("tide_flag"),
    )


def harmonize_many(
    target: DataFrame, forcing: DataFrame, keys: Sequence[str], ts: str, per_series: bool
) -> DataFrame:
    """Inner join of hourly series with drivers, shared by all series or one set per series.

    Repeated driver rows are reduced to the first one; drivers per series are hourly.
    """
    on = [*keys, ts] if per_series else [ts]
    others = [F.col(c) for c in forcing.columns if c not in on]
    # Repartitioned so that a time shared by very many rows can be split by adaptive execution.
    out = target.join(first_per_key(forcing, on, others).repartition(*on), on)
    return out.withColumn("rain_resolution", F.lit("hourly")) if per_series else out


def array_median(a: Column, min_obs: int = 1) -> Column:
    """Median of the non-null elements, NULL when there are fewer than ``min_obs``."""
    s = F.array_sort(F.array_compact(a))
    n = F.size(s)
    lo = F.try_element_at(s, F.floor((n + 1) / 2).cast("int"))
    hi = F.try_element_at(s, F.ceil((n + 1) / 2).cast("int"))
    return F.when(n >= max(min_obs, 1), lo + (hi - lo) / 2)


def centred_median(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, rows: int = 12, min_obs: int = 5,
    out: str = "around", pos: str | None = None,
) -> DataFrame:
    """Median over ``rows`` before to ``rows`` after. ``pos`` is the row number in the series if known."""
    work, p = df, pos
    if p is None:
        p = "_pos"
        work = with_position(df.withColumn("_chunk", tp.day_number(F.col(ts))), keys, "_chunk", [ts], p)

    def frame(w):
        v = F.col(value)
        near = [F.lag(v, k).over(w) for k in range(rows, 0, -1)] + [v] + [F.lead(v, k).over(w) for k in range(1, rows + 1)]
        return F.array(*near)

    done = in_blocks(work, keys, p, {"_near": frame}, before=rows, after=rows)
    return done.select(*df.columns, array_median(F.col("_near"), min_obs).alias(out))


def trailing_median(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, hours: int = 24, min_obs: int = 12, out: str = "base"
) -> DataFrame:
    """Median of the values in (t - hours, t], missing ones skipped; NULL below ``min_obs`` values. Works on irregular times.

    Blocks of fourteen times the reach, each with the rows of the reach before it, are dealt out; a row costs
    the logarithm of the number of rows within the reach (``sliding``), however densely the series is sampled.
    """
    reach = int(hours) * 3_600_000_000
    wide = halo(df.withColumn("_us", tp.micros(F.col(ts))), keys, "_us", before=reach, rows=14 * reach)
    done = median_of_groups(wide, [*keys, "_block"], "_us", value, reach, min_obs, out)
    return done.where("_home").select(*df.columns, out)


def hourly_spike_filter(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, flag: str,
    rows: int = 12, min_obs: int = 5, limit: float = 150.0,
    lo: float = cl.LEVEL_RANGE_CM[0], hi: float = cl.LEVEL_RANGE_CM[1],
    keep_gap_flag: bool = False, pos: str | None = None,
) -> DataFrame:
    """Hours far from the median of the surrounding rows or outside the plausible range: flag 7, value NULL.

    A missing value counts as outside and gets 7 as well, unless ``keep_gap_flag``. The distance is compared with ``limit`` to six
    decimals, so that the last bits of a median of two values do not decide.
    """
    near = centred_median(df, keys, ts, value, rows, min_obs, "_mid", pos)
    v = F.col(value)
    spike = cl.holds(F.round(F.abs(v - F.col("_mid")), 6) > limit) | cl.outside_range(v, lo, hi)
    if keep_gap_flag:
        spike = spike & v.isNotNull()
    new = {value: F.when(~spike, v), flag: F.when(spike, 7).otherwise(F.col(flag)).cast("int")}
    return near.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns])


#: Tasks that the hours of all series are dealt over.
SCAN_TASKS = 256


def interpolate_linear(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, limit: int = 6, out: str | None = None, pos: str | None = None
) -> DataFrame:
    """Fill up to ``limit`` missing rows after a value, on the line to the next value.

    Where no later value exists the last one is repeated; before the first value nothing
    is filled. Distance is counted in rows, or in the units of ``pos`` if given.
    """
    out = out or value
    work, p = df, pos
    if p is None:
        p = "_pos"
        work = with_position(df.withColumn("_chunk", tp.day_number(F.col(ts))), keys, "_chunk", [ts], p, tasks=SCAN_TASKS)
    work = work.withColumn("_part", F.floor(F.col(p) / BLOCK_ROWS).cast("long"))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(p).alias("at"), F.col(value).alias("v")))
    work = scan_series(work, keys, "_part", [p], ffill={"_a": known}, bfill={"_b": known}, tasks=SCAN_TASKS)
    a, b, i = F.col("_a"), F.col("_b"), F.col(p)
    line = a["v"] + (b["v"] - a["v"]) * (i - a["at"]) / F.nullif(b["at"] - a["at"], F.lit(0))
    filled = (
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(a.isNull() | (i - a["at"] > limit), None)
        .when(b.isNull(), a["v"])
        .otherwise(line)
    )
    rest = [c for c in df.columns if c != out]
    return work.select(*rest, filled.alias(out))
