"""Events against ground truth: exceedance, official counts, reports nearby."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries.functions import timeparts as tp
from hydroseries.functions.cleaning import holds, to_number
from hydroseries.operators.frames import join_per_key
from hydroseries.operators.quantiles import medians
from hydroseries.operators.scores import in_windows
from hydroseries.operators.spatial import points_in_polygons, within_km


def official_counts(wanted: DataFrame, counts: DataFrame, place: str = "place") -> DataFrame:
    """Sum of text counts for place, quarter and month; ``published`` tells if the quarter exists at all.

    NULL while the quarter is not published, 0 when it is published without such rows.
    """
    periods = counts.select(F.col("period").alias("_p")).distinct()
    sums = counts.groupBy(F.lower(place).alias("_pl"), F.col("period").alias("_p"), F.col("month").alias("_m")).agg(
        F.sum(to_number(F.col("n_text"), "int")).alias("_n")
    )
    w = wanted.withColumns(
        {"_p": F.col("period"), "_m": F.col("month"), "_pl": F.lower(place)}
    )
    out = join_per_key(w, periods.withColumn("_known", F.lit(True)), ["_p"])
    out = join_per_key(out, sums, ["_pl", "_p", "_m"])
    known = holds(F.col("_known"))
    return out.select(
        *wanted.columns, known.alias("published"), F.when(known, F.coalesce("_n", F.lit(0))).alias("official_n")
    )


def reports_near(stations: DataFrame, reports: DataFrame, events: DataFrame, key: str, ts: str, depth: str,
                 km: float = 3.0, pad_days: int = 1) -> DataFrame:
    """Reports inside an event window within ``km`` of a station: count and median depth per event and station."""
    r = reports.select(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), ts, depth)
    seen = in_windows(r, ts, events.select("event", "start", "end"), pad_days)
    pairs = within_km(stations.select(key, "lat", "lon").dropna(), seen, km)
    n = pairs.groupBy("event", key).agg(F.count("*").alias("n_reports"))
    return n.join(medians(pairs, ["event", key], [depth]).withColumnRenamed(depth, "median_depth"), ["event", key], "left")


def event_crosstab(
    pred: DataFrame, events: DataFrame, stations: DataFrame, districts: DataFrame, counts: DataFrame,
    reports: DataFrame, key: str, ts: str = "ts", pad_days: int = 1, model_horizon: int = 6,
) -> DataFrame:
    """One row per event and station: observed, forecast, official and reported flooding.

    ``stations`` has key, lat, lon, threshold; ``districts`` name and ring; ``counts``
    period, month, place, n_text; ``reports`` ts, lat, lon, depth. Stations without
    coordinates have no place, and unknown counts of reports.
    """
    # Every combination is a row of the result; events are a short hand-kept list, so each station is repeated per event.
    listed = events.agg(F.collect_list(F.struct("event", "start"))).scalar()
    frame = stations.withColumn("_ev", listed).select(key, "lat", "lon", "threshold", F.inline("_ev"))
    rows = in_windows(join_per_key(pred, stations.select(key, "threshold"), [key], ts, "inner"), ts, events.select("event", "start", "end"), pad_days)
    over: Column = F.col("y") >= F.col("threshold")
    told: Column = F.col("yhat") >= F.col("threshold")
    seen = rows.groupBy("event", key).agg(
        F.bool_or(holds(over & (F.col("horizon") == 1))).alias("obs_exceed"),
        F.bool_or(holds(told & (F.col("horizon") == model_horizon))).alias("pred_exceed"),
    )
    placed = points_in_polygons(stations.select(key, "lat", "lon").dropna(), districts, "place").select(key, "place")
    out = frame.join(seen, ["event", key], "left").join(placed, key, "left")
    out = out.withColumns(
        {"period": tp.quarter_code(F.col("start")), "month": F.month("start").cast("string")}
    )
    out = official_counts(out, counts)
    near = reports_near(stations, reports, events, key, ts, "depth", pad_days=pad_days)
    out = out.join(near, ["event", key], "left")
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return out.select(
        "event", key, "place",
        holds(F.col("obs_exceed")).alias("obs_exceed"),
        holds(F.col("pred_exceed")).alias("pred_exceed"),
        F.when(F.col("place").isNotNull(), F.col("published")).alias("published"),
        F.when(F.col("place").isNotNull(), F.col("official_n")).alias("official_n"),
        F.when(located, F.coalesce("n_reports", F.lit(0))).alias("n_reports"),
        F.when(located, F.col("median_depth")).alias("median_depth"),
    )


def event_summary(crosstab: DataFrame, key: str) -> DataFrame:
    """Per event: stations that saw it, reports (unknown as none), official counts of published months."""
    return crosstab.groupBy("event").agg(
        F.array_join(
            F.array_sort(F.collect_list(F.when(F.col("obs_exceed"), F.col(key).cast("string")))), ","
        ).alias("seen_at"),
        F.sum(F.coalesce("n_reports", F.lit(0))).alias("n_reports"),
        F.sum(F.when(F.col("published"), F.col("official_n"))).alias("official_n"),
    )


