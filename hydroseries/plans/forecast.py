"""Windows, baselines, scores, events and comparisons of forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F


from hydroseries.functions.cleaning import holds
from hydroseries.operators import response, scores, windows
from hydroseries.operators.quantiles import exact_quantiles
from hydroseries.plans.registry import (
    DRIVERS_SQL, EVENTS_SQL, HORIZONS, PRED_SQL, event_windows, forecasts, grid_events, hourly_events, hourly_sql, query,
    rain_daily, rates_sql, rounded, tide_hourly,
)

METHODS = {"model": "yhat", "persistence": "y_persist"}

FORCED_SQL = f"""{hourly_sql('event_type', True)},{DRIVERS_SQL},
f AS (SELECT g.k, g.ts, g.v, t.tide_m AS tide, r.rain_mm AS rain, (CASE WHEN g.n IS NULL OR g.n < 2 THEN 9 ELSE 0 END)::INTEGER AS flag
      FROM g LEFT JOIN tide t ON t.ts = g.ts LEFT JOIN rain r ON r.day = date_trunc('day', g.ts))"""


def forced(spark, sf_dir):
    """k, ts, v, tide, rain, flag on the complete hourly grid of every event type."""
    g = grid_events(spark, sf_dir)
    rain = rain_daily(spark, sf_dir).select(F.col("day").alias("_d"), F.col("rain_mm").alias("rain"))
    tide = tide_hourly(spark, sf_dir).withColumnRenamed("tide_m", "tide")
    flag = F.when(F.coalesce(F.col("n"), F.lit(0)) < 2, 9).otherwise(0)
    out = g.join(tide, "ts", "left").withColumn("_d", F.date_trunc("day", "ts").cast("timestamp_ntz")).join(rain, "_d", "left")
    return out.select("k", "ts", "v", "tide", "rain", flag.alias("flag"))


def _window_sql(lookback: int, h: int, extra: bool) -> str:
    more = f", round(lag(v, {24 - h}) OVER w, 6) AS y_day_before, round(lead(tide, {h}) OVER w - tide, 9) AS known_change" if extra else ""
    keep = " AND y_day_before IS NOT NULL AND known_change IS NOT NULL" if extra else ""
    tail = ", y_day_before, known_change" if extra else ""
    return f"""WITH {FORCED_SQL},
    s AS (SELECT k, ts, lead(ts, {h}) OVER w AS target_ts, round(lead(v, {h}) OVER w, 6) AS y, round(v, 6) AS y_last,
      round(lead(tide, {h}) OVER w, 6) AS known_future, lead(flag, {h}) OVER w AS qc_target,
      least(count(v) OVER b, count(tide) OVER b, count(rain) OVER b) AS n, greatest(max(flag) OVER b, lead(flag, {h}) OVER w) AS qc_any,
      round(sum(v) OVER b, 6) AS sum_v, round(sum(tide) OVER b, 9) AS sum_tide, round(sum(rain) OVER b, 6) AS sum_rain {more}
      FROM f WINDOW w AS (PARTITION BY k ORDER BY ts), b AS (PARTITION BY k ORDER BY ts ROWS BETWEEN {lookback - 1} PRECEDING AND CURRENT ROW))
    SELECT k, ts, target_ts, y, y_last, known_future, qc_target, qc_any, sum_v, sum_tide, sum_rain{tail} FROM s
    WHERE n = {lookback} AND y IS NOT NULL AND known_future IS NOT NULL{keep}"""


def _windows(spark, sf_dir, lookback, h, extra, strict, pick=lambda df: df):
    w = windows.make_windows(pick(forced(spark, sf_dir)), ["k"], "ts", "v", "tide", "rain", "flag", lookback, h, extra, strict)

    def total(c, digits=6):
        return F.round(F.aggregate("history", F.lit(0.0), lambda a, s: a + s[c]), digits)

    w = w.withColumns({"sum_v": total("v"), "sum_tide": total("tide", 9), "sum_rain": total("rain")}).drop("history")
    if extra:
        w = rounded(rounded(w, "y_day_before"), "known_change", digits=9)
    return rounded(w, "y", "y_last", "known_future")


@query("q09_make_windows", _window_sql(6, 1, False))
def q09_make_windows(spark, sf_dir):
    return _windows(spark, sf_dir, 6, 1, False, False)


@query("q09_make_windows_extra", _window_sql(4, 6, True))
def q09_make_windows_extra(spark, sf_dir):
    return _windows(spark, sf_dir, 4, 6, True, True)


#: Hours taken out of the series, so that steps of rows and of hours differ.
GAPS = (4, 15)


def gappy(df):
    return df.where(~F.hour("ts").isin(*GAPS))


# An absent hour counts like one without values.
@query("q09_make_windows_gaps", _window_sql(6, 1, False).replace(
    "FROM f WINDOW", f"FROM (SELECT * REPLACE (CASE WHEN hour(ts) IN {GAPS} THEN NULL ELSE v END AS v) FROM f) WINDOW"))
def q09_make_windows_gaps(spark, sf_dir):
    return _windows(spark, sf_dir, 6, 1, False, True, gappy)


@query("q18_baseline_forecast_gaps", f"""WITH {hourly_sql('user_id')}, r AS (SELECT k, ts, round(v, 6) AS v FROM h)
    SELECT r.k, r.ts, b.ts AS target_ts, 6::INTEGER AS horizon, b.v AS y, r.v AS persistence, c.v AS day_before, round(b.v - c.v, 6) AS residual
    FROM r JOIN r b ON b.k = r.k AND b.ts = r.ts + INTERVAL 6 HOUR LEFT JOIN r c ON c.k = r.k AND c.ts = r.ts - INTERVAL 18 HOUR""")
def q18_baseline_forecast_gaps(spark, sf_dir):
    h = hourly_events(spark, sf_dir, "user_id").select("k", "ts", F.round("v", 6).alias("v"))
    return rounded(windows.baseline_forecast(h, ["k"], "ts", "v", 6), "residual")


@query("q18_baseline_forecast", f"""WITH {hourly_sql('event_type', True)}
    SELECT k, ts, target_ts, 6::INTEGER AS horizon, y, persistence, day_before, round(y - day_before, 6) AS residual FROM (
      SELECT k, ts, lead(ts, 6) OVER w AS target_ts, round(lead(v, 6) OVER w, 6) AS y, round(v, 6) AS persistence,
             round(lag(v, 18) OVER w, 6) AS day_before FROM g WINDOW w AS (PARTITION BY k ORDER BY ts)) WHERE target_ts IS NOT NULL""")
def q18_baseline_forecast(spark, sf_dir):
    g = grid_events(spark, sf_dir).withColumn("v", F.round("v", 6))
    out = windows.baseline_forecast(g, ["k"], "ts", "v", 6)
    return rounded(out, "residual")


@query("j05_lookup_back", f"""WITH {hourly_sql('user_id')} SELECT h.k, h.ts, round(a.v, 6) AS v6 FROM h
    LEFT JOIN h a ON a.k = h.k AND a.ts = h.ts - INTERVAL 6 HOUR""")
def j05_lookup_back(spark, sf_dir):
    h = hourly_events(spark, sf_dir, "user_id")
    return rounded(scores.lookup_back(h.select("k", "ts"), h, ["k"], "ts", "v", 6, "v6"), "v6")


def _reg(y: str, f: str, name: str, where: str = "true", suffix: str = "") -> str:
    ok = f"FILTER (WHERE {y} IS NOT NULL AND {f} IS NOT NULL AND {where})"
    return f"""round(1 - sum(({y} - {f}) ^ 2) {ok} / nullif(var_pop({y}) {ok} * count(*) {ok}, 0), 6) AS {name}nse{suffix},
    round(sqrt(avg(({y} - {f}) ^ 2) {ok}), 6) AS {name}rmse{suffix}, round(avg(abs({y} - {f})) {ok}, 6) AS {name}mae{suffix},
    count(*) {ok} AS {name}n{suffix}"""


SCORES_SQL = "SELECT k, horizon, " + ", ".join(
    _reg("y", c, f"{m}_") + ", " + _reg("y", c, f"{m}_", "qc_flag = 0", "_flag0") for m, c in METHODS.items()
) + " FROM pred GROUP BY 1, 2"


def _forecast_scores(spark, sf_dir):
    return scores.forecast_scores(forecasts(spark, sf_dir), ["k", "horizon"], "y", METHODS, "qc_flag")


@query("q10_forecast_scores", f"WITH {hourly_sql()},{PRED_SQL} {SCORES_SQL}")
def q10_forecast_scores(spark, sf_dir):
    out = _forecast_scores(spark, sf_dir)
    return rounded(out, *[c for c in out.columns if c not in ("k", "horizon") and not c.split("_")[1] == "n"])


def thresholds(spark, sf_dir):
    """k, level, threshold: two levels of every series."""
    q = exact_quantiles(hourly_events(spark, sf_dir), ["k"], F.col("v"), {"level2": 0.5, "level3": 0.75})
    return q.select(
        "k", F.inline(F.array(*[F.struct(F.lit(n).alias("level"), F.col(n).alias("threshold")) for n in ("level2", "level3")]))
    )


THR_SQL = """
thr AS (SELECT k, 'level2' AS level, quantile_cont(v, 0.5) AS threshold FROM h GROUP BY k
        UNION ALL SELECT k, 'level3', quantile_cont(v, 0.75) FROM h GROUP BY k)"""


def _conf(by: str, src: str, obs: str, pred: str) -> str:
    return f"""SELECT {by}, method, tp, fp, fn, n_obs_hours, {rates_sql()} FROM (
      SELECT {by}, method, count(*) FILTER ({obs} AND {pred}) AS tp, count(*) FILTER (NOT {obs} AND {pred}) AS fp,
             count(*) FILTER ({obs} AND NOT {pred}) AS fn, count(*) FILTER ({obs}) AS n_obs_hours
      FROM {src} GROUP BY ALL)"""


LONG_SQL = """
long AS (SELECT k, ts, horizon, y, 'model' AS method, yhat AS f FROM pred
         UNION ALL SELECT k, ts, horizon, y, 'persistence', y_persist FROM pred)"""
RATES = ("f1", "csi", "pod", "far")


@query("q11_exceedance_scores", f"WITH {hourly_sql()},{PRED_SQL},{THR_SQL},{LONG_SQL} "
       + _conf("k, horizon, level", "long JOIN thr USING (k)", "(y >= threshold)", "(f >= threshold)"))
def q11_exceedance_scores(spark, sf_dir):
    out = scores.exceedance_scores(forecasts(spark, sf_dir), thresholds(spark, sf_dir), ["k"], ["horizon"], "y", METHODS)
    return rounded(out, *RATES)


ANOM_SQL = f"""{hourly_sql()},{PRED_SQL},{LONG_SQL},
base AS (SELECT k, ts, CASE WHEN count(v) OVER w >= 12 THEN median(v) OVER w END AS b FROM h
         WINDOW w AS (PARTITION BY k ORDER BY ts RANGE BETWEEN INTERVAL '23:59:59.999999' PRECEDING AND CURRENT ROW)),
ahead AS (SELECT k, ts + to_hours(horizon) AS ts, horizon, b FROM base CROSS JOIN hz),
lv AS (SELECT k, quantile_cont(v, 0.95) AS p95 FROM h WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1),
rs AS (SELECT h.k, a.horizon, quantile_cont(h.v - a.b, 0.95) AS rise FROM h JOIN ahead a ON a.k = h.k AND a.ts = h.ts
       WHERE h.ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2),
fx AS (SELECT k, quantile_cont(v, 0.75) AS thr FROM h GROUP BY 1),
al AS (SELECT l.k, l.horizon, l.method, d.definition,
    coalesce(CASE d.definition WHEN 'p95' THEN y >= p95 WHEN 'rise' THEN y - b >= rise ELSE y >= thr END, false) AS o,
    coalesce(CASE d.definition WHEN 'p95' THEN f >= p95 WHEN 'rise' THEN f - b >= rise ELSE f >= thr END, false) AS p
  FROM long l CROSS JOIN (VALUES ('p95'), ('rise'), ('fixed')) d(definition)
  LEFT JOIN ahead a ON a.k = l.k AND a.ts = l.ts AND a.horizon = l.horizon
  LEFT JOIN lv ON lv.k = l.k LEFT JOIN rs ON rs.k = l.k AND rs.horizon = l.horizon LEFT JOIN fx ON fx.k = l.k)"""


def _anomaly(spark, sf_dir):
    h = hourly_events(spark, sf_dir)
    fixed = exact_quantiles(h, ["k"], F.col("v"), {"threshold": 0.75})
    train = F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")
    return scores.anomaly_scores(forecasts(spark, sf_dir), h, ["k"], "ts", "v", train, METHODS, HORIZONS, fixed)


@query("q12_anomaly_scores", f"WITH {ANOM_SQL} " + _conf("k, horizon, definition", "al", "o", "p"))
def q12_anomaly_scores(spark, sf_dir):
    return rounded(_anomaly(spark, sf_dir), *RATES)


@query("q12_p95_flag0_scores", f"WITH {hourly_sql()},{PRED_SQL},{LONG_SQL}, lv AS (SELECT k, horizon, quantile_cont(y, 0.95) AS threshold FROM pred WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2) "
       + _conf("k, horizon", "(SELECT l.*, threshold FROM long l JOIN lv USING (k, horizon) JOIN pred p USING (k, horizon, ts) WHERE p.qc_flag = 0 AND l.ts >= TIMESTAMP '2024-01-20')", "(y >= threshold)", "(f >= threshold)"))
def q12_p95_flag0_scores(spark, sf_dir):
    """Threshold from the training targets of each horizon, scored on unflagged later rows."""
    p = forecasts(spark, sf_dir)
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    level = exact_quantiles(p.where(F.col("ts") < cut), ["k", "horizon"], F.col("y"), {"threshold": 0.95})
    test = p.where((F.col("ts") >= cut) & (F.col("qc_flag") == 0)).join(level, ["k", "horizon"])
    t = F.col("threshold")
    out = scores.confusion_scores(test, ["k", "horizon"], F.col("y") >= t, {m: F.col(c) >= t for m, c in METHODS.items()})
    return rounded(out, *RATES)


EVENT_SQL = f"""{hourly_sql()},{PRED_SQL},{EVENTS_SQL},
t AS (SELECT k, quantile_cont(v, 0.75) AS threshold FROM h GROUP BY 1),
inw AS (SELECT event, p.*, threshold FROM pred p JOIN t USING (k)
        JOIN ev ON p.ts BETWEEN ev.s - INTERVAL 1 DAY AND ev.e + INTERVAL 1 DAY),
ft AS (SELECT event, k, min(ts) FILTER (y >= threshold) AS t_first FROM inw WHERE horizon = 1 GROUP BY 1, 2),
ld AS (SELECT ft.event, ft.k, max(p.horizon) AS lead FROM ft JOIN t USING (k) JOIN pred p ON p.k = ft.k AND p.ts = ft.t_first
       WHERE p.yhat >= t.threshold GROUP BY 1, 2),
el AS (SELECT event, k, horizon, 'model' AS method, y >= threshold AS o, yhat >= threshold AS p FROM inw
       UNION ALL SELECT event, k, horizon, 'persistence', y >= threshold, y_persist >= threshold FROM inw)"""


def level3(spark, sf_dir):
    return exact_quantiles(hourly_events(spark, sf_dir), ["k"], F.col("v"), {"threshold": 0.75}).drop("n")


@query("q13_event_scores", f"""WITH {EVENT_SQL} SELECT c.*, t_first, (CASE WHEN t_first IS NOT NULL THEN coalesce(lead, 0) END)::INTEGER AS max_lead_hours
    FROM ({_conf('event, k, horizon', 'el', 'o', 'p')}) c LEFT JOIN ft USING (event, k) LEFT JOIN ld USING (event, k)""")
def q13_event_scores(spark, sf_dir):
    out = scores.event_scores(
        forecasts(spark, sf_dir), event_windows(spark), level3(spark, sf_dir), ["k"], "ts", METHODS, "yhat"
    )
    return rounded(out, *RATES)


@query("j06_in_event_windows", f"""WITH {EVENTS_SQL} SELECT event, event_id, type FROM events JOIN ev
    ON ts BETWEEN s - INTERVAL 1 DAY AND e + INTERVAL 1 DAY""")
def j06_in_event_windows(spark, sf_dir):
    from hydroseries.plans.registry import table

    e = table(spark, sf_dir, "events").select("event_id", "ts")
    return scores.in_windows(e, "ts", event_windows(spark), 1).select("event", "event_id", "type")


@query("a32_pinball_and_peak_error", f"""WITH {hourly_sql()},{PRED_SQL}, pk AS (SELECT k, horizon, quantile_cont(y, 0.9) AS p FROM pred GROUP BY 1, 2)
    SELECT k, horizon, round(avg(greatest(0.9::DOUBLE * (y - yhat), (0.9::DOUBLE - 1) * (y - yhat))), 6) AS pinball,
           round(avg(CASE WHEN y > p THEN 5.0::DOUBLE ELSE 1 END * (y - yhat) ^ 2), 6) AS peak_error
    FROM pred JOIN pk USING (k, horizon) GROUP BY 1, 2""")
def a32_pinball_and_peak_error(spark, sf_dir):
    p = forecasts(spark, sf_dir)
    pk = exact_quantiles(p, ["k", "horizon"], F.col("y"), {"p": 0.9})
    out = p.join(pk, ["k", "horizon"]).groupBy("k", "horizon").agg(
        scores.pinball(F.col("y"), F.col("yhat")).alias("pinball"),
        scores.peak_weighted_error(F.col("y"), F.col("yhat"), F.col("p")).alias("peak_error"),
    )
    return rounded(out, "pinball", "peak_error")


@query("f21_standardise", """WITH s AS (SELECT avg(value) FILTER (ts < TIMESTAMP '2024-01-20') AS m,
    stddev_pop(value) FILTER (ts < TIMESTAMP '2024-01-20') AS d FROM events)
    SELECT event_id, round((value - m) / (d + 1e-8), 6) AS value_scaled FROM events CROSS JOIN s""")
def f21_standardise(spark, sf_dir):
    from hydroseries.plans.registry import table

    e = table(spark, sf_dir, "events").withColumn("tr", F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return rounded(windows.standardise(e, ["value"], "tr").select("event_id", "value_scaled"), "value_scaled")


SPLITS = {"train": ("2024-01-01", "2024-01-15"), "val": ("2024-01-16", "2024-01-20"), "test": ("2024-01-21", "2024-01-31")}
SPLIT_SQL = "CASE " + " ".join(f"WHEN ts BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}' THEN '{n}'" for n, (a, b) in SPLITS.items()) + " END"


@query("f25_split_label", f"SELECT event_id, {SPLIT_SQL} AS part FROM events")
def f25_split_label(spark, sf_dir):
    from hydroseries.plans.registry import table

    return table(spark, sf_dir, "events").select("event_id", scores.split_label(F.col("ts"), SPLITS).alias("part"))


@query("f25_training_rows", """SELECT event_id, CASE WHEN event_type = 'view' THEN ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-10'
    ELSE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-20' END AS is_train FROM events""")
def f25_training_rows(spark, sf_dir):
    from hydroseries.plans.registry import table

    own = spark.createDataFrame([("view", "2024-01-03", "2024-01-10")], "event_type string, start string, `end` string")
    own = own.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})
    out = scores.training_rows(table(spark, sf_dir, "events"), own, ["event_type"], "ts", "2024-01-01", "2024-01-20")
    return out.select("event_id", "is_train")


@query("f26_sample_gate", f"""WITH s AS (SELECT user_id, {SPLIT_SQL} AS part FROM events),
    c AS (SELECT user_id, count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'val') AS n_val,
                 count(*) FILTER (part = 'test') AS n_test FROM s GROUP BY 1)
    SELECT *, CASE WHEN n_train < 30 OR n_val < 5 OR n_test < 10 THEN 'too few windows' END AS note FROM c""")
def f26_sample_gate(spark, sf_dir):
    from hydroseries.plans.registry import table

    e = table(spark, sf_dir, "events").select("user_id", scores.split_label(F.col("ts"), SPLITS).alias("part"))
    n = e.groupBy("user_id").agg(*[F.count_if(holds(F.col("part") == p)).alias(f"n_{p}") for p in SPLITS])
    return scores.sample_gate(n, {"n_train": 30, "n_val": 5, "n_test": 10})


def _nse(y: str, f: str) -> str:
    return f"round(1 - sum(({y} - {f}) ^ 2) / nullif(var_pop({y}) * count(*), 0), 6) AS nse"


RUNS_SQL = f"""{hourly_sql()},{PRED_SQL},
runs AS (SELECT k, horizon, 'model' AS config, {_nse('y', 'yhat')}, round(avg(abs(y - yhat)), 6) AS mae FROM pred GROUP BY 1, 2
  UNION ALL SELECT k, horizon, 'persistence', {_nse('y', 'y_persist')}, NULL FROM pred WHERE y_persist IS NOT NULL GROUP BY 1, 2)"""


def runs(spark, sf_dir):
    p = forecasts(spark, sf_dir)
    a = p.groupBy("k", "horizon").agg(*scores.regression_aggs(F.col("y"), F.col("yhat"))).drop("rmse", "n")
    b = p.groupBy("k", "horizon").agg(scores.regression_aggs(F.col("y"), F.col("y_persist"))[0])
    out, missing = scores.compare_runs(
        {"model": a, "persistence": b, "absent": None}, ["k", "horizon", "nse", "mae"]
    )
    assert missing == ["absent"]
    return rounded(out, "nse", "mae")


@query("q17_compare_runs", f"WITH {RUNS_SQL} SELECT * FROM runs")
def q17_u02_compare_runs(spark, sf_dir):
    return runs(spark, sf_dir)


@query("q17_pivot_runs", f"""WITH {RUNS_SQL} SELECT k, horizon, avg(nse) FILTER (config = 'model') AS model,
    avg(nse) FILTER (config = 'persistence') AS persistence FROM runs GROUP BY 1, 2""")
def q17_pivot_runs(spark, sf_dir):
    return scores.pivot_runs(runs(spark, sf_dir), ["k", "horizon"], "nse", ["model", "persistence"])


@query("q17_median_scores", f"WITH {RUNS_SQL} SELECT horizon, config, round(median(nse), 6) AS nse FROM runs GROUP BY 1, 2")
def q17_median_scores(spark, sf_dir):
    return rounded(scores.median_scores(runs(spark, sf_dir), ["horizon", "config"], ["nse"]), "nse")


@query("q17_best_run", f"WITH {RUNS_SQL} SELECT k, horizon, arg_min(config, ROW(-nse, config)) AS best_config, max(nse) AS nse FROM runs GROUP BY 1, 2")
def q17_best_run(spark, sf_dir):
    return scores.best_run(runs(spark, sf_dir), ["k", "horizon"], "nse")


@query("j15_lift_over_base", f"""WITH {RUNS_SQL} SELECT m.k, m.horizon, m.config, round(m.nse - b.nse, 6) AS gain, round(b.nse - m.nse, 6) AS "drop",
    coalesce(m.nse - b.nse >= 0.02 AND b.nse - m.nse <= 0.05, false) AS lift
    FROM runs m JOIN runs b USING (k, horizon) WHERE b.config = 'persistence' AND m.config <> 'persistence'""")
def j15_lift_over_base(spark, sf_dir):
    return rounded(scores.lift_over(runs(spark, sf_dir), ["k", "horizon"], "persistence", "nse", "nse"), "gain", "drop")


@query("j17_replace_series", """SELECT event_id, event_type, CASE WHEN event_type = 'view' THEN value * 2 ELSE value END AS value FROM events""")
def j17_replace_series(spark, sf_dir):
    from hydroseries.plans.registry import table

    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    fresh = e.where(F.col("event_type") == "view").withColumn("value", F.col("value") * 2)
    return scores.replace_series(e, fresh, ["event_type"])


LAG_SQL = f"""{FORCED_SQL}, lg AS (SELECT unnest(range(0, 25))::INTEGER AS lag_h),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ts) AS i FROM f),
cv AS (SELECT a.k, lag_h, 'tide' AS var, CASE WHEN count(*) FILTER (a.v IS NOT NULL AND b.tide IS NOT NULL) >= 30 THEN corr(a.v, b.tide) END AS corr
       FROM n a CROSS JOIN lg JOIN n b ON b.k = a.k AND b.i = a.i - lag_h GROUP BY 1, 2
       UNION ALL SELECT a.k, lag_h, 'rain', CASE WHEN count(*) FILTER (a.v IS NOT NULL AND b.rain IS NOT NULL) >= 30 THEN corr(a.v, b.rain) END
       FROM n a CROSS JOIN lg JOIN n b ON b.k = a.k AND b.i = a.i - lag_h GROUP BY 1, 2)"""


def _curve(spark, sf_dir):
    f = forced(spark, sf_dir)
    return response.lag_correlation(f, ["k"], "ts", "v", {"tide": "tide", "rain": "rain"}, max_lag=24)


@query("q15_lag_correlation", f"WITH {LAG_SQL} SELECT k, lag_h, var, round(corr, 6) AS corr FROM cv")
def q15_lag_correlation(spark, sf_dir):
    return rounded(_curve(spark, sf_dir), "corr")


@query("q15_lag_correlation_gaps", f"WITH {LAG_SQL} SELECT k, lag_h, var, round(corr, 6) AS corr FROM cv".replace(
    "FROM f),", f"FROM f WHERE hour(ts) NOT IN {GAPS}),").replace("b.i = a.i - lag_h", "b.ts = a.ts - lag_h * INTERVAL 1 HOUR"))
def q15_lag_correlation_gaps(spark, sf_dir):
    f = gappy(forced(spark, sf_dir))
    out = response.lag_correlation(f, ["k"], "ts", "v", {"tide": "tide", "rain": "rain"}, max_lag=24, strict_time=True)
    return rounded(out, "corr")


@query("q15_best_lag", f"""WITH {LAG_SQL} SELECT k, var, arg_min(lag_h, ROW(-abs(round(corr, 9)), lag_h)) AS lag_h,
    arg_min(round(corr, 6), ROW(-abs(round(corr, 9)), lag_h)) AS corr FROM cv WHERE corr IS NOT NULL GROUP BY 1, 2""")
def q15_o03_best_lag(spark, sf_dir):
    return rounded(response.best_lag(rounded(_curve(spark, sf_dir), "corr", digits=9), ["k"]), "corr")


RESP_SQL = f"""{FORCED_SQL},{EVENTS_SQL},
w AS (SELECT event, f.* FROM f JOIN ev ON ts BETWEEN s - INTERVAL 3 DAY AND e + INTERVAL 3 DAY),
pk AS (SELECT event, k, max(v) AS pv, arg_min(ts, ROW(-v, ts)) FILTER (v IS NOT NULL) AS pt,
              arg_min(ts, ROW(-tide, ts)) FILTER (tide IS NOT NULL) AS tt, min(ts) FILTER (rain > 0) AS onset FROM w GROUP BY 1, 2),
st AS (SELECT pk.event, pk.k, pv, pt, tt, onset, (SELECT w.tide FROM w WHERE w.event = pk.event AND w.k = pk.k AND w.ts = pt) AS tp,
              (SELECT sum(rain) / 24 FROM w WHERE w.event = pk.event AND w.k = pk.k AND w.ts BETWEEN pt - INTERVAL 72 HOUR AND pt) AS rb FROM pk WHERE pt IS NOT NULL),
md AS (SELECT event, median(rb) AS rm, median(date_diff('hour', tt, pt)::DOUBLE) AS tm FROM st GROUP BY 1),
cl AS (SELECT event, CASE WHEN coalesce(rm >= 5, false) = coalesce(abs(tm) <= 6, false) THEN 'compound'
                          WHEN coalesce(rm >= 5, false) THEN 'pluvial' ELSE 'tidal' END AS type_computed FROM md),
rsp AS (SELECT st.event, st.k, round(pv, 1) AS peak_level, pt AS peak_ts, round(tp, 3) AS tide_at_peak, round(rb, 6) AS rain_before,
    date_diff('hour', tt, pt)::DOUBLE AS lag_tide_h, date_diff('hour', onset, pt)::DOUBLE AS lag_rain_h, type_computed, ev.type AS type_given
    FROM st JOIN cl USING (event) JOIN ev USING (event))"""


def _response(spark, sf_dir):
    f = forced(spark, sf_dir)
    return rounded(response.event_response(f, event_windows(spark), ["k"], "ts", "v", "tide", "rain"), "rain_before")


@query("q16_event_response", f"WITH {RESP_SQL} SELECT * FROM rsp")
def q16_event_response(spark, sf_dir):
    return _response(spark, sf_dir)


@query("a31_class_agreement", f"""WITH {RESP_SQL}, d AS (SELECT DISTINCT event, type_given, type_computed FROM rsp)
    SELECT count(*) AS n_events, count(*) FILTER (contains(lower(type_given), type_computed)) AS n_agree,
    round(avg(contains(lower(type_given), type_computed)::INTEGER), 6) AS agreement,
    coalesce(string_agg(event, ',' ORDER BY event) FILTER (NOT contains(lower(type_given), type_computed)), '') AS disagree FROM d""")
def a31_class_agreement(spark, sf_dir):
    return rounded(response.class_agreement(_response(spark, sf_dir)), "agreement")


@query("q19_train_linear")
def q19_train_linear(spark, sf_dir):
    """Learned linear baseline: scores on the later part of the whole series."""
    w = windows.make_windows(forced(spark, sf_dir), ["k"], "ts", "v", "tide", "rain", "flag", 12, 6)
    w = w.withColumn("is_train", F.col("target_ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    _, fitted = windows.train_linear(w, "is_train")
    out = fitted.where(~F.col("is_train")).groupBy("k").agg(*scores.regression_aggs(F.col("y"), F.col("yhat")))
    return rounded(out, "nse", "rmse", "mae")


