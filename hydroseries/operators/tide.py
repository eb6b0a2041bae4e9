"""Plain harmonic tide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries.functions import timeparts as tp
from hydroseries.operators.frames import join_per_key


def tide_synthesis(hours: DataFrame, constituents: DataFrame, key: str, ts: str, out: str = "tide_m") -> DataFrame:
    """Sum of amplitude * cos(speed * t - phase) per hour, t in hours since 1992-01-01.

    ``constituents``: key, name, amplitude (m), speed (degrees per hour), phase (degrees).
    A point has a few dozen constituents at most; they travel as one array per point.
    """
    waves = constituents.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("name", "amplitude", "speed", "phase"))).alias("_waves")
    )
    t = tp.hours_between(F.col(ts), F.lit("1992-01-01").cast("timestamp_ntz"))
    height = F.aggregate(
        "_waves", F.lit(0.0), lambda s, w: s + w["amplitude"] * F.cos(F.radians(w["speed"] * t - w["phase"]))
    )
    return join_per_key(hours, waves, [key], spread=ts, how="inner").select(*hours.columns, height.alias(out))
