"""Gridded rain as a long table of cells."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The hourly global grid, north-up, 0.1 degree.
N_LAT, N_LON = 1200, 3600
TOP, LEFT, STEP = 59.95, 0.05, 0.1
CELLS = "ts timestamp, lat double, lon double, mm double"


def read_hourly_grids(spark: SparkSession, path: str, box: tuple[float, float, float, float], **how) -> DataFrame:
    """Landed grid files of a folder or glob as cells, see ``decode_hourly_grids``."""
    return decode_hourly_grids(spark.read.format("binaryFile").load(path).select("path", "content"), box, **how)


def decode_hourly_grids(
    files: DataFrame, box: tuple[float, float, float, float],
    name_pattern: str = r"(\d{8})[._]?(\d{4})", shape: tuple[int, int] = (N_LAT, N_LON),
) -> DataFrame:
    """Gzipped little-endian float32 grids, one hour per file, cut to ``box`` (lat_min, lat_max, lon_min, lon_max).

    The box is cut while decoding, so only its cells leave the task. Negative values are
    missing; a file that does not decode gives no cells (see ``expected_hours``).
    ``files`` has path (the hour is in the name) and content.
    """
    n_lat, n_lon = shape
    lat_min, lat_max, lon_min, lon_max = box
    row0, row1 = round((TOP - lat_max) / STEP), round((TOP - lat_min) / STEP)
    col0, col1 = round((lon_min - LEFT) / STEP), round((lon_max - LEFT) / STEP)
    lats = TOP - np.arange(row0, row1 + 1) * STEP
    lons = LEFT + np.arange(col0, col1 + 1) * STEP

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for when, content in zip(batch["ts"], batch["content"]):
                try:
                    grid = np.frombuffer(gzip.decompress(content), dtype="<f4").reshape(n_lat, n_lon)
                except (OSError, EOFError, ValueError, zlib.error):  # a damaged file is a missing hour
                    continue
                part = grid[row0 : row1 + 1, col0 : col1 + 1].astype("float64")
                mm = pd.Series(part.ravel()).where(part.ravel() >= 0)
                yield pd.DataFrame(
                    {"ts": when, "lat": np.repeat(lats, len(lons)), "lon": np.tile(lons, len(lats)), "mm": mm}
                )

    name = F.regexp_extract(F.col("path"), r"([^/]+)$", 1)
    stamp = F.concat(F.regexp_extract(name, name_pattern, 1), F.regexp_extract(name, name_pattern, 2))
    files = files.select(
        F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmm")).alias("ts"), "content"
    )
    cells = files.mapInPandas(decode, CELLS)
    return cells.select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("lat", 6).alias("lat"),
                        F.round("lon", 6).alias("lon"), F.nanvl("mm", F.lit(None).cast("double")).alias("mm"))


def expected_hours(cells: DataFrame, days: DataFrame, day: str = "day", ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """All 24 hours of each day with their cells (absent hours: NULLs), and the list of absent hours."""
    start = F.col(day).cast("timestamp_ntz")
    hours = days.select(F.explode(F.sequence(start, start + F.expr("interval 23 hours"), F.expr("interval 1 hour"))).alias(ts))
    missing = hours.join(cells.select(ts).distinct(), ts, "left_anti")
    return hours.join(cells, ts, "left"), missing


def rain_subset(cells: DataFrame, box: tuple[float, float, float, float], start: str, end: str, ts: str = "ts") -> DataFrame:
    """Box and closed time range; both reach the scan of a table stored by year."""
    return cells.where(
        F.col("lat").between(box[0], box[1])
        & F.col("lon").between(box[2], box[3])
        & F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    )
