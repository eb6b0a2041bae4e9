"""Raw gauge text: ``time,value;time,value;...|limit;limit;limit|ignored tail``."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroseries.functions import timeparts as tp
from hydroseries.functions.cleaning import nan_to_null, to_number


class Gauge(NamedTuple):
    points: DataFrame  # keys, ts, value
    limits: DataFrame  # keys, limit1..limit3
    rejects: DataFrame  # keys, piece, reason


def read_gauge_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: series_id (name of the folder), chunk_start (from the file name) and raw text."""
    name = F.col("_metadata.file_path")
    return spark.read.text(path, wholetext=True).select(
        F.regexp_extract(name, r"([^/]+)/[^/]+$", 1).alias("series_id"),
        F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})_[^/]*$", 1).try_cast("date").alias("chunk_start"),
        F.col("value").alias("raw"),
    )


def parse_gauge_text(df: DataFrame, keys: list[str], raw: str = "raw", mode: str = "rejects", place: str | None = None) -> Gauge:
    """Points, limits and rejected pieces of raw texts.

    ``mode="strict"`` fails the job on a text without a bar or on a point that does not
    parse; otherwise these go to ``rejects``. An empty data part gives no points. ``place`` names a further
    column of the points: their place in the text, which tells the first of several values of one time.
    """
    more = [place] if place else []
    text = F.col(raw)
    has_bar = F.coalesce(F.instr(text, "|") > 0, F.lit(False))
    parts = F.split(text, r"\|", 3)
    good = df.where(has_bar)
    cut = F.transform(F.split(parts[0], ";"), lambda p: F.trim(p))
    pieces = good.select(*keys, F.posexplode(F.filter(cut, lambda p: p != "")).alias(place or "_place", "piece"))
    pair = F.split("piece", ",", 2)
    pieces = pieces.withColumns(
        {
            "ts": tp.parse_gauge_time(pair[0]),
            "_num": to_number(F.trim(F.get(pair, F.lit(1)))),
        }
    )
    ok = F.col("ts").isNotNull() & F.col("_num").isNotNull()
    bad = pieces.where(~ok).select(*keys, "piece", F.lit("bad point").alias("reason"))
    whole = df.where(~has_bar).select(*keys, text.alias("piece"), F.lit("no bar").alias("reason"))
    if mode == "strict":
        fail = F.raise_error(F.concat(F.lit("bad data point: "), "piece")).cast("boolean")
        pieces = pieces.where(F.when(~ok, fail).otherwise(True))
        no_bar = F.raise_error(F.concat(F.lit("unexpected text: "), text)).cast("boolean")
        shape = df.where(F.when(~has_bar, no_bar).otherwise(False)).select(
            *keys, *[F.lit(None).cast("int").alias(c) for c in more],
            F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("double").alias("_num"),
        )
        pieces = pieces.select(*keys, *more, "ts", "_num").unionByName(shape)
        ok = F.lit(True)
    points = pieces.where(ok).select(*keys, "ts", nan_to_null(F.col("_num")).alias("value"), *more)

    given = F.filter(F.split(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), ";"), lambda p: F.trim(p) != "")
    nums = F.transform(given, lambda p: to_number(F.trim(p)) / 10)
    usable = (F.size(given) == 3) & ~F.exists(nums, lambda n: n.isNull())
    limits = good.select(*keys, nums.alias("_n"), usable.alias("_ok")).select(
        *keys, *[F.when(F.col("_ok"), F.get("_n", F.lit(i))).alias(f"limit{i + 1}") for i in range(3)]
    )
    return Gauge(points, limits, whole.unionByName(bad))


def first_limits(limits: DataFrame, key: str, chunk_start: str) -> DataFrame:
    """Limits of the earliest chunk that carries any."""
    names = ["limit1", "limit2", "limit3"]
    row = F.struct(*names)
    known = F.coalesce(*names).isNotNull()
    best = limits.groupBy(key).agg(F.min_by(row, F.when(known, F.col(chunk_start))).alias("_r"))
    return best.select(key, *[F.col("_r")[n].alias(n) for n in names])


def fill_limits(stations: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """Take the limits over for stations that lack any of theirs."""
    names = ["limit1", "limit2", "limit3"]
    new = limits.select(key, *[F.col(n).alias(f"_{n}") for n in names])
    incomplete = F.col(names[0]).isNull() | F.col(names[1]).isNull() | F.col(names[2]).isNull()
    found = F.coalesce(*[f"_{n}" for n in names]).isNotNull()
    out = stations.join(new, key, "left")
    swap = {n: F.when(incomplete & found, F.col(f"_{n}")).otherwise(F.col(n)) for n in names}
    return out.select(*[swap.get(c, F.col(c)).alias(c) for c in stations.columns])
