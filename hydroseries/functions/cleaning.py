"""Missing values, range rules and text coercion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Plausible ranges and sentinels of the sensor network.
SENTINELS = (-999.0,)
RAIN_MAX_MM_DAY = 300.0
TIDE_MAX_M = 2.0
LEVEL_RANGE_CM = (-300.0, 1000.0)


def nan_to_null(c: Column) -> Column:
    """Missing is NULL: NaN compares greater than everything in Spark."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def null_normalise(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column, to be called right after a scan."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType)).alias(f.name)
        out.append(c)
    return df.select(*out)


def holds(cond: Column) -> Column:
    """Three-valued logic closed to two values: unknown counts as false."""
    return F.coalesce(cond, F.lit(False))


def rain_flag(mm: Column) -> Column:
    return holds((mm < 0) | (mm > RAIN_MAX_MM_DAY)).cast("int")


def tide_flag(level_m: Column) -> Column:
    return holds(F.abs(level_m) > TIDE_MAX_M).cast("int")


def outside_range(c: Column, lo: float = LEVEL_RANGE_CM[0], hi: float = LEVEL_RANGE_CM[1]) -> Column:
    """True outside the closed range, and also where the value is missing."""
    return ~holds(c.between(lo, hi))


def is_sentinel(c: Column, sentinels=SENTINELS) -> Column:
    return holds(c.isin(*[float(s) for s in sentinels]))


def to_number(c: Column, kind: str = "double") -> Column:
    """Text to number; what does not parse becomes NULL."""
    return c.try_cast(kind)


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """``box`` is (lat_min, lat_max, lon_min, lon_max), borders included."""
    return holds(lat.between(box[0], box[1]) & lon.between(box[2], box[3]))


def same_text(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def exact_mean(c: Column, digits: int = 6) -> Column:
    """Aggregate: the mean of values, taken to ``digits`` decimals each, rounded to as many, halves away from zero.

    Sum and rounding are in whole numbers, so neither the order of the rows nor the nearest double decides a half.
    """
    unit = 10**digits
    total, n = F.sum(F.round(c * unit).cast("long")), F.count(c)
    size = F.call_function("div", 2 * F.abs(total) + n, F.nullif(2 * n, F.lit(0)))
    return F.when(total < 0, -size).otherwise(size) / unit
