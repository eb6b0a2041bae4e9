"""Point flags, hourly series, grids, as-of fill, repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydroseries.functions import timeparts as tp
from hydroseries.operators import asof, grid, qc
from hydroseries.operators import harmonize as hz
from hydroseries.plans.registry import (
    DRIVERS_SQL, SQL, grid_events, hourly_events, hourly_sql, query, rain_daily, rounded, table, tide_hourly,
)

POINTS_SQL = """
pts AS (SELECT event_id, event_type AS k, date_trunc('hour', ts) AS ts,
               CASE WHEN value < 1 THEN -999.0::DOUBLE ELSE floor(value / 50) * 50 END AS v FROM events)"""


def gauge_points(spark, sf_dir, key="event_type"):
    """Coarse readings with sentinels and repeated times, out of the whole ``events`` table."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col(key).alias("k"),
        F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"),
        F.when(F.col("value") < 1, -999.0).otherwise((F.floor(F.col("value") / 50) * 50).cast("double")).alias("v"),
    )


POINT_QC_SQL = """
a AS (SELECT *, lag(v) OVER w AS pv, lag(ts) OVER w AS pt,
             row_number() OVER (PARTITION BY k, year(ts), ts ORDER BY event_id) AS rn
      FROM pts WINDOW w AS (PARTITION BY k, year(ts) ORDER BY ts, event_id)),
b AS (SELECT *, abs(v - pv) / nullif(date_diff('microsecond', pt, ts) / 60e6, 0) * 10 AS rate,
             sum(CASE WHEN coalesce(v = pv, false) THEN 0 ELSE 1 END)
                 OVER (PARTITION BY k, year(ts) ORDER BY ts, event_id) AS run FROM a),
c AS (SELECT k, year(ts) AS y, count(*) AS n, quantile_cont(v, 0.001) AS lo, quantile_cont(v, 0.999) AS hi,
             count(rate) AS nr, quantile_cont(rate, 0.999) AS rmax FROM b GROUP BY 1, 2),
d AS (SELECT b.*, max(ts) OVER r - min(ts) OVER r AS span FROM b WINDOW r AS (PARTITION BY k, year(ts), run)),
flagged AS (SELECT d.event_id, d.k, d.ts, d.v,
       CASE WHEN d.v = -999 OR (c.n >= 100 AND (d.v < c.lo OR d.v > c.hi)) THEN 1
            WHEN d.rn > 1 THEN 4
            WHEN d.span > INTERVAL 60 MINUTE THEN 2
            WHEN c.nr >= 100 AND d.rate > c.rmax THEN 3 ELSE 0 END::INTEGER AS qc_flag
  FROM d JOIN c ON c.k = d.k AND c.y = year(d.ts))"""


def flagged_points(spark, sf_dir):
    return qc.point_qc(gauge_points(spark, sf_dir), ["k"], "ts", "v", "event_id")


@query("q01_point_qc", f"WITH {POINTS_SQL},{POINT_QC_SQL} SELECT event_id, k, ts, v, qc_flag FROM flagged")
def q01_point_qc(spark, sf_dir):
    return flagged_points(spark, sf_dir).withColumn("qc_flag", F.col("qc_flag").cast("int"))


@query("q01_point_qc_lost", f"""WITH {POINTS_SQL.replace('FROM events)', 'FROM events WHERE event_id % 50 NOT IN (7, 11))')},{POINT_QC_SQL}
    SELECT event_id, qc_flag FROM flagged UNION ALL SELECT event_id, 1::INTEGER FROM events WHERE event_id % 50 IN (7, 11)""")
def q01_point_qc_lost(spark, sf_dir):
    """Some points have no key, some no time: they keep their row and get flag 1."""
    n = F.col("event_id") % 50
    p = gauge_points(spark, sf_dir).withColumns({"k": F.when(n != 7, F.col("k")), "ts": F.when(n != 11, F.col("ts"))})
    flags = qc.point_qc(p, ["k"], "ts", "v", "event_id")
    return flags.select("event_id", F.col("qc_flag").cast("int").alias("qc_flag"))


@query(
    "q02_resample_hourly",
    f"""WITH {POINTS_SQL},{POINT_QC_SQL},
    h AS (SELECT k, year(ts) AS y, ts, avg(v) AS mean, max(v) AS max, count(v) AS n_obs,
                 avg((qc_flag <> 0)::INTEGER) AS share FROM flagged GROUP BY 1, 2, 3),
    s AS (SELECT k, y, min(ts) AS lo, max(ts) AS hi FROM h GROUP BY 1, 2),
    g AS (SELECT k, y, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM s),
    f AS (SELECT g.k, g.ts, h.mean, h.max, coalesce(h.n_obs, 0) AS n_obs,
                 round_even(coalesce(h.share, 0), 4) AS pct FROM g LEFT JOIN h USING (k, y, ts))
    SELECT k, ts, round(mean, 6) AS mean, max, n_obs, pct AS pct_flagged,
           CASE WHEN n_obs < 2 THEN 9 WHEN pct >= 0.5 THEN 8 ELSE 0 END::INTEGER AS qc_flag FROM f""",
)
def q02_resample_hourly(spark, sf_dir):
    return grid.resample_hourly(flagged_points(spark, sf_dir), ["k"], "ts", "v").withColumn(
        "mean", F.round("mean", 6)
    )


@query(
    "q01_point_qc_whole_series",
    f"WITH {POINTS_SQL},{POINT_QC_SQL} SELECT event_id, qc_flag FROM flagged".replace("year(ts)", "1").replace(
        "year(d.ts)", "1"
    ).replace("event_type AS k", "user_id AS k"),
)
def q01_point_qc_whole_series(spark, sf_dir):
    flags = qc.point_qc(gauge_points(spark, sf_dir, "user_id"), ["k"], "ts", "v", "event_id", calibration="series")
    return flags.select("event_id", F.col("qc_flag").cast("int").alias("qc_flag"))


@query("q03_complete_grid", f"WITH {hourly_sql('user_id', True)} SELECT k, ts, round(v, 6) AS v, n FROM g")
def q03_complete_grid(spark, sf_dir):
    return grid_events(spark, sf_dir, "user_id").select("k", "ts", F.round("v", 6).alias("v"), "n")


ASOF = """WITH {h},{d} SELECT h.k, h.ts, round(CASE WHEN {fresh} THEN r.rain_mm END, 6) AS rain_mm
    FROM h ASOF LEFT JOIN rain r ON h.ts - INTERVAL 7 HOUR >= r.day"""


def _asof(spark, sf_dir, tolerance):
    h = hourly_events(spark, sf_dir, "user_id").withColumn("utc", tp.local_to_utc(F.col("ts"), "Asia/Jakarta"))
    out = asof.asof_fill(h, rain_daily(spark, sf_dir), "utc", "day", ["rain_mm"], tolerance_hours=tolerance)
    return out.select("k", "ts", F.round("rain_mm", 6).alias("rain_mm"))


@query("q04_asof_fill", ASOF.format(h=hourly_sql("user_id"), d=DRIVERS_SQL, fresh="true"))
def q04_asof_fill(spark, sf_dir):
    return _asof(spark, sf_dir, None)


@query(
    "q04_asof_fill_24h",
    ASOF.format(h=hourly_sql("user_id"), d=DRIVERS_SQL, fresh="date_diff('hour', r.day, h.ts - INTERVAL 7 HOUR) < 24"),
)
def q04_asof_fill_24h(spark, sf_dir):
    return _asof(spark, sf_dir, 24.0)


@query(
    "j04_asof_per_series",
    """WITH c AS (SELECT user_id AS k, ts, value AS v FROM events WHERE event_type = 'click'),
    s AS (SELECT user_id AS k, ts AS at, max(value) AS step FROM events WHERE event_type = 'signup' GROUP BY 1, 2)
    SELECT c.k, c.ts, c.v, s.at, s.step FROM c ASOF LEFT JOIN s ON c.k = s.k AND c.ts >= s.at""",
)
def j04_asof_per_series(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "ts", F.col("value").alias("v"), "event_type")
    clicks = e.where(F.col("event_type") == "click").drop("event_type")
    steps = e.where(F.col("event_type") == "signup").groupBy("k", F.col("ts").alias("at")).agg(F.max("v").alias("step"))
    return asof.asof_fill(clicks, steps, "ts", "at", ["at", "step"], keys=["k"])


@query(
    "j04_day_fill",
    f"""WITH {hourly_sql()},{DRIVERS_SQL} SELECT h.k, h.ts, round(r.rain_mm, 6) AS rain_mm FROM h
    LEFT JOIN rain r ON r.day = date_trunc('day', h.ts - INTERVAL 7 HOUR)""",
)
def j04_day_fill(spark, sf_dir):
    h = hourly_events(spark, sf_dir)
    out = asof.day_fill(h, rain_daily(spark, sf_dir), tp.local_to_utc(F.col("ts"), "Asia/Jakarta"), "day", ["rain_mm"])
    return out.select("k", "ts", F.round("rain_mm", 6).alias("rain_mm"))


@query(
    "q05_harmonize",
    f"""WITH {hourly_sql('user_id', True)},{DRIVERS_SQL},
    f AS (SELECT g.k, g.ts, g.v, r.rain_mm FROM g ASOF LEFT JOIN rain r ON g.ts - INTERVAL 7 HOUR >= r.day)
    SELECT f.k, f.ts, round(f.v, 6) AS v, round(rain_mm, 6) AS rain_mm, 'daily' AS rain_resolution,
           coalesce(rain_mm < 0 OR rain_mm > 300, false)::INTEGER AS rain_flag,
           round(tide_m, 6) AS tide_m, coalesce(abs(tide_m) > 2, false)::INTEGER AS tide_flag
    FROM f LEFT JOIN tide t ON t.ts = f.ts""",
)
def q05_harmonize(spark, sf_dir):
    h = hourly_events(spark, sf_dir, "user_id").select("k", "ts", "v")
    out = hz.harmonize_series(h, rain_daily(spark, sf_dir), tide_hourly(spark, sf_dir), ["k"], "ts", zone="Asia/Jakarta")
    return rounded(out, "v", "rain_mm", "tide_m")


@query(
    "q05_harmonize_many_shared",
    f"WITH {hourly_sql('user_id')},{DRIVERS_SQL} SELECT k, ts, round(v, 6) AS v, round(tide_m, 6) AS tide_m FROM h JOIN tide USING (ts)",
)
def q05_harmonize_many_shared(spark, sf_dir):
    h = hourly_events(spark, sf_dir, "user_id").select("k", "ts", "v")
    return rounded(hz.harmonize_many(h, tide_hourly(spark, sf_dir), ["k"], "ts", per_series=False), "v", "tide_m")


@query(
    "q05_harmonize_many_per_series",
    f"""WITH {hourly_sql()}, d AS (SELECT event_type AS k, date_trunc('hour', ts) + INTERVAL 1 HOUR AS ts, min(value) AS rain_mm
      FROM events GROUP BY 1, 2) SELECT k, ts, round(v, 6) AS v, rain_mm, 'hourly' AS rain_resolution FROM h JOIN d USING (k, ts)""",
)
def q05_harmonize_many_per_series(spark, sf_dir):
    h = hourly_events(spark, sf_dir).select("k", "ts", "v")
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("k"), tp.shift_hours(F.date_trunc("hour", "ts"), 1).alias("ts"), F.col("value").alias("rain_mm")
    )
    return rounded(hz.harmonize_many(h, e, ["k"], "ts", per_series=True), "v")


SPIKE = """WITH {h}, m AS (SELECT k, ts, v, n, median(v) OVER w AS mid, count(v) OVER w AS c FROM g
      WINDOW w AS (PARTITION BY k ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
    s AS (SELECT *, coalesce(c >= 5 AND round(abs(v - mid), 6) > 20, false) OR NOT coalesce(v BETWEEN 5 AND 150, false) AS spike FROM m)
    SELECT k, ts, round(CASE WHEN NOT spike THEN v END, 6) AS v,
           (CASE WHEN {rule} THEN 7 WHEN n IS NULL THEN 9 ELSE 0 END)::INTEGER AS flag FROM s"""


def _spikes(spark, sf_dir, keep):
    g = grid_events(spark, sf_dir, "user_id").withColumn("flag", F.when(F.col("n").isNull(), 9).otherwise(0))
    out = hz.hourly_spike_filter(
        g.select("k", "ts", "v", "flag"), ["k"], "ts", "v", "flag", limit=20.0, lo=5.0, hi=150.0, keep_gap_flag=keep
    )
    return rounded(out, "v")


@query("q06_hourly_spike_filter", SPIKE.format(h=hourly_sql("user_id", True), rule="spike"))
def q06_hourly_spike_filter(spark, sf_dir):
    return _spikes(spark, sf_dir, False)


@query("q06_spike_filter_keep_gaps", SPIKE.format(h=hourly_sql("user_id", True), rule="spike AND v IS NOT NULL"))
def q06_spike_filter_keep_gaps(spark, sf_dir):
    return _spikes(spark, sf_dir, True)


@query(
    "q07_interpolate_linear",
    f"""WITH {hourly_sql('user_id', True).replace('round(avg(value), 9)', 'round(avg(value), 12)')},
    p AS (SELECT k, ts, v, row_number() OVER (PARTITION BY k ORDER BY ts) - 1 AS i FROM g),
    q AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY k ORDER BY i) AS a,
                 min(CASE WHEN v IS NOT NULL THEN i END) OVER
                   (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM p)
    SELECT q.k, q.ts, round(CASE WHEN q.v IS NOT NULL THEN q.v WHEN q.a IS NULL OR q.i - q.a > 6 THEN NULL
        WHEN q.b IS NULL THEN x.v ELSE x.v + (y.v - x.v) * (q.i - q.a) / (q.b - q.a)::DOUBLE END, 8) AS v
    FROM q LEFT JOIN p x ON x.k = q.k AND x.i = q.a LEFT JOIN p y ON y.k = q.k AND y.i = q.b""",
)
def q07_interpolate_linear(spark, sf_dir):
    g = grid_events(spark, sf_dir, "user_id", digits=12).select("k", "ts", "v")
    return rounded(hz.interpolate_linear(g, ["k"], "ts", "v"), "v", digits=8)


@query(
    "w07_trailing_median",
    f"""WITH {hourly_sql('user_id')} SELECT k, ts, round(CASE WHEN count(v) OVER w >= 3 THEN median(v) OVER w END, 6) AS base
    FROM h WINDOW w AS (PARTITION BY k ORDER BY ts RANGE BETWEEN INTERVAL '23:59:59.999999' PRECEDING AND CURRENT ROW)""",
)
def w07_trailing_median(spark, sf_dir):
    h = hourly_events(spark, sf_dir, "user_id")
    return rounded(hz.trailing_median(h, ["k"], "ts", "v", min_obs=3).select("k", "ts", "base"), "base")
