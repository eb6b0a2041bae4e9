"""Incremental load of raw gauge text into the point and hourly tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from hydroseries.operators.frames import first_per_key, join_per_key
from hydroseries.operators.grid import resample_hourly
from hydroseries.operators.qc import point_qc
from hydroseries.session import cut_lineage, shared_until_done
from hydroseries.sources.files import write_series
from hydroseries.sources.gauge_text import Gauge, first_limits, parse_gauge_text, read_gauge_files


def stored(spark: SparkSession, path: str, key: str = "series_id") -> DataFrame | None:
    """A stored table, None where nothing is stored. ``key`` stays text: ``0140`` and ``140`` are two series."""
    try:
        found = spark.read.parquet(path).schema
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None
    # Values of folders are typed by guess unless a schema is given.
    declared = StructType([StructField(f.name, StringType()) if f.name == key else f for f in found])
    return spark.read.schema(declared).parquet(path)


def last_times(points: DataFrame, key: str, ts: str) -> DataFrame:
    """Resume point per series."""
    return points.groupBy(key).agg(F.max(ts).alias("last_ts"))


def since_last(new: DataFrame, last: DataFrame, key: str, ts: str) -> DataFrame:
    """New rows from the start of the last stored day on; series never seen come whole."""
    out = join_per_key(new, last, [key], spread=ts)
    fresh = F.col("last_ts").isNull() | (F.col(ts) >= F.date_trunc("day", "last_ts").cast("timestamp_ntz"))
    return out.where(fresh).select(*new.columns)


def upsert(old: DataFrame | None, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union by key; a stored row wins over a new one, then the smaller ``order``."""
    fresh = new.withColumn("_new", F.lit(1))
    both = fresh if old is None else old.withColumn("_new", F.lit(0)).unionByName(fresh, allowMissingColumns=True)
    return first_per_key(both, keys, [F.col("_new"), F.col(order)]).drop("_new")


def touched(old: DataFrame | None, new: DataFrame, key: str, ts: str) -> DataFrame | None:
    """Stored rows of the series-years that new rows fall into.

    The years, as many as the calendar has, prune folders when the scan is planned; the join on both
    folder columns lets Spark prune the series when it runs.
    """
    if old is None:
        return None
    years = sorted(r[0] for r in new.select(F.year(ts)).distinct().collect() if r[0] is not None)
    parts = new.select(key, F.year(ts).alias("year")).where(F.col("year").isin(years)).distinct()
    return old.where(F.col("year").isin(years)).join(parts, [key, "year"], "left_semi")


def ingest(
    spark: SparkSession, new: DataFrame, points_path: str, hourly_path: str, key: str = "series_id", order: str = "value"
) -> None:
    """Merge new points (key, ts, value) and rebuild flags and hours of the touched series-years.

    Only partitions that got new rows are read, recomputed and replaced. The merged rows
    are cut from their source before the files they came from are overwritten. Of several new values of one time the
    first by ``order`` stays; points without key or time have no place in the tables and are left out.
    """
    new = new.where(F.col(key).isNotNull() & F.col("ts").isNotNull())
    new = new.select(F.col(key).cast("string").alias(key), "ts", "value", F.col(order).alias("_order"))
    old = touched(stored(spark, points_path, key), new, key, "ts")
    if old is not None:
        old = old.select(key, "ts", "value")
    with shared_until_done():
        merged = upsert(old, new, [key, "ts"], "_order").drop("_order")
        flagged = cut_lineage(point_qc(merged, [key], "ts", "value", tie="value"))
        write_series(flagged, points_path, [key], "ts")
        write_series(resample_hourly(flagged, [key], "ts", "value"), hourly_path, [key], "ts")


def ingest_incremental(spark: SparkSession, raw_path: str, points_path: str, hourly_path: str) -> Gauge:
    """From a folder of raw gauge files to the point and hourly tables; series_id is the name of a file's folder.

    Points before the last stored day of their series are skipped, of several values of one time the first in
    the files' order stays. Returns the points loaded, the first limits per series and the rejected pieces.
    """
    key = "series_id"
    parsed = parse_gauge_text(read_gauge_files(spark, raw_path), [key, "chunk_start"], place="place")
    new = cut_lineage(parsed.points.withColumn("_from", F.struct("chunk_start", "place")).drop("chunk_start", "place"))
    before = stored(spark, points_path, key)
    if before is not None:
        new = cut_lineage(since_last(new, last_times(before, key, "ts"), key, "ts"))
    ingest(spark, new, points_path, hourly_path, key, order="_from")
    return Gauge(new.drop("_from"), first_limits(parsed.limits, key, "chunk_start"), parsed.rejects)
