"""As-of fill, harmonisation, repairs, windows and scores."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydroseries.functions.cleaning import null_normalise
from hydroseries.operators import asof, harmonize, response, scores, windows

T0 = datetime(2024, 1, 1)


def hours(spark, values, key="a", start=T0, extra=""):
    rows = [(key, start + timedelta(hours=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")


def column(df, name, order="ts"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_nan_becomes_null(spark):
    df = null_normalise(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "v double, n int"))
    assert column(df, "v", "n") == [None, 2.0]


def test_last_rain_holds_unless_it_is_too_old(spark):
    rain = spark.createDataFrame([(T0, 5.0), (T0 + timedelta(days=1), 7.0)], "day timestamp_ntz, mm double")
    left = hours(spark, range(60), start=T0 - timedelta(hours=3))
    for keys in ((), ("k",)):
        steps = rain if not keys else rain.withColumn("k", F.lit("a"))
        kept = column(asof.asof_fill(left, steps, "ts", "day", ["mm"], keys=keys), "mm")
        assert kept == [None] * 3 + [5.0] * 24 + [7.0] * 33
        aged = column(asof.asof_fill(left, steps, "ts", "day", ["mm"], keys=keys, tolerance_hours=24), "mm")
        assert aged == [None] * 3 + [5.0] * 24 + [7.0] * 24 + [None] * 9


def test_asof_equals_pandas_on_random_times(spark):
    rng = np.random.default_rng(3)
    at = pd.DataFrame({"k": rng.choice(["a", "b"], 400), "us": rng.integers(0, 10**12, 400)})
    st = pd.DataFrame({"k": rng.choice(["a", "b"], 50), "us": rng.integers(0, 10**12, 50), "s": np.arange(50.0)})
    for d in (at, st):
        d["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(d["us"], unit="us")
    want = pd.merge_asof(at.sort_values("ts"), st[["k", "ts", "s"]].sort_values("ts"), on="ts", by="k").sort_values(["k", "ts"])
    to = lambda d, c: spark.createDataFrame(
        [(r.k, r.ts.to_pydatetime(), *[getattr(r, x) for x in c]) for r in d.itertuples()], "k string, ts timestamp_ntz" + "".join(f", {x} double" for x in c))
    out = asof.asof_fill(to(at, []), to(st, ["s"]).withColumnRenamed("ts", "at"), "ts", "at", ["s"], keys=["k"], chunk_days=1)
    got = out.toPandas().sort_values(["k", "ts"])
    np.testing.assert_array_equal(got["s"].to_numpy(dtype=float), want["s"].to_numpy())


def test_interpolation_limit(spark):
    values = [None, 1] + [None] * 8 + [10] + [None] * 8
    want = [None, 1, 2, 3, 4, 5, 6, 7, None, None, 10, 10, 10, 10, 10, 10, 10, None, None]
    assert column(harmonize.interpolate_linear(hours(spark, values), ["k"], "ts", "v"), "v") == want


def test_interpolation_equals_pandas(spark):
    rng = np.random.default_rng(4)
    v = pd.Series(np.where(rng.random(600) < 0.7, np.nan, np.round(rng.normal(0, 50, 600), 1)))
    df = hours(spark, [None if np.isnan(x) else x for x in v])
    got = np.array(column(harmonize.interpolate_linear(df, ["k"], "ts", "v"), "v"), dtype=float)
    np.testing.assert_allclose(got, v.interpolate(method="linear", limit=6).to_numpy(), rtol=1e-12)


def test_missing_hour_gets_seven_or_keeps_its_gap_flag(spark):
    df = hours(spark, [10] * 6 + [None] + [10] * 6 + [900] + [10] * 6).withColumn("f", F.when(F.col("v").isNull(), 9).otherwise(0))
    out = harmonize.hourly_spike_filter(df, ["k"], "ts", "v", "f")
    assert column(out, "f") == [0] * 6 + [7] + [0] * 6 + [7] + [0] * 6
    assert column(out, "v")[13] is None
    kept = harmonize.hourly_spike_filter(df, ["k"], "ts", "v", "f", keep_gap_flag=True)
    assert column(kept, "f")[6] == 9


def test_centred_and_trailing_median_equal_pandas(spark):
    rng = np.random.default_rng(6)
    v = pd.Series(np.where(rng.random(300) < 0.4, np.nan, rng.normal(0, 9, 300)), index=pd.date_range("2024-01-01", periods=300, freq="h"))
    df = hours(spark, [None if np.isnan(x) else x for x in v])
    near = harmonize.centred_median(df, ["k"], "ts", "v")
    np.testing.assert_allclose(np.array(column(near, "around"), dtype=float), v.rolling(25, center=True, min_periods=5).median())
    base = harmonize.trailing_median(df, ["k"], "ts", "v")
    np.testing.assert_allclose(np.array(column(base, "base"), dtype=float), v.rolling("24h", min_periods=12).median())


def test_windows(spark):
    df = hours(spark, range(10)).withColumns({"tide": F.col("v") * 2, "rain": F.col("v") * 3, "flag": F.lit(0)})
    out = windows.make_windows(df, ["k"], "ts", "v", "tide", "rain", "flag", lookback=3, horizon=1)
    rows = out.orderBy("ts").collect()
    assert len(rows) == 7 and all(len(r.history) == 3 for r in rows)
    assert rows[0].y == 3.0 and rows[0].y_last == 2.0 and rows[0].known_future == 6.0


def test_windows_with_a_missing_value_are_dropped(spark):
    df = hours(spark, [0, 1, 2, None, 4, 5, 6, 7, 8, 9]).withColumns({"tide": F.lit(1.0), "rain": F.lit(0.0), "flag": F.lit(0)})
    out = windows.make_windows(df, ["k"], "ts", "v", "tide", "rain", "flag", lookback=3, horizon=1)
    assert column(out, "y") == [7.0, 8.0, 9.0]


def test_residual_of_a_daily_cycle_is_zero(spark):
    df = hours(spark, [np.sin(2 * np.pi * (i % 24) / 24) for i in range(200)])
    out = windows.baseline_forecast(df, ["k"], "ts", "v", 24).where("residual is not null")
    assert out.count() == 176 and out.agg(F.max(F.abs("residual"))).first()[0] < 1e-12


@pytest.mark.parametrize("obs,pred,f1", [([1, 0, 1], [1, 0, 1], 1.0), ([1, 0, 1], [0, 1, 0], 0.0), ([0, 0, 0], [0, 0, 0], None)])
def test_confusion(spark, obs, pred, f1):
    df = spark.createDataFrame([("a", bool(o), bool(p)) for o, p in zip(obs, pred)], "k string, o boolean, p boolean")
    assert scores.confusion_scores(df, ["k"], F.col("o"), {"m": F.col("p")}).first().f1 == f1


def test_nse(spark):
    df = spark.createDataFrame([("a", float(i), float(i), 4.5, 1.0) for i in range(10)], "k string, y double, p double, mean double, one double")
    row = scores.forecast_scores(df, ["k"], "y", {"p": "p", "m": "mean"}).first()
    assert row.p_nse == 1.0 and row.m_nse == pytest.approx(0.0) and row.p_n == 10
    assert scores.forecast_scores(df, ["k"], "one", {"p": "p"}).first().p_nse is None


def test_one_spike_is_one_rise(spark):
    values = [10.0] * 200
    values[150] = 200.0
    df = hours(spark, values)
    base = harmonize.trailing_median(df, ["k"], "ts", "v")
    ahead = base.select("k", (F.col("ts") + F.expr("interval 1 hour")).alias("ts"), "base")
    assert df.join(ahead, ["k", "ts"]).where(F.col("v") - F.col("base") >= 50).count() == 1


def test_lag_of_a_shifted_driver_is_found(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, 400)
    df = hours(spark, np.r_[np.zeros(5), x[:-5]]).join(hours(spark, x).withColumnRenamed("v", "d"), ["k", "ts"])
    best = response.best_lag(response.lag_correlation(df, ["k"], "ts", "v", {"d": "d"}, max_lag=12), ["k"]).first()
    assert best.lag_h == 5 and best["corr"] > 0.99


@pytest.mark.parametrize("rain,lag,kind", [(9.0, 2.0, "compound"), (9.0, 30.0, "pluvial"), (0.0, -3.0, "tidal"), (None, None, "compound"), (5.0, None, "pluvial")])
def test_classes(spark, rain, lag, kind):
    df = spark.createDataFrame([(rain, lag)], "r double, l double")
    assert df.select(response.classify(F.col("r"), F.col("l"))).first()[0] == kind


def test_lead_is_zero_when_nothing_was_forecast_and_null_when_nothing_happened(spark):
    ev = spark.createDataFrame([("E", T0, T0 + timedelta(days=1))], "event string, start timestamp_ntz, `end` timestamp_ntz")
    rows = []
    for key, y, f in (("a", 9.0, 0.0), ("b", 0.0, 0.0), ("c", 9.0, 9.0)):
        rows += [(key, T0 + timedelta(hours=5), h, y, f if h != 24 else 0.0) for h in (1, 6, 24)]
    pred = spark.createDataFrame(rows, "k string, ts timestamp_ntz, horizon int, y double, yhat double")
    thr = spark.createDataFrame([(k, 5.0) for k in "abc"], "k string, threshold double")
    out = scores.event_scores(pred, ev, thr, ["k"], "ts", {"m": "yhat"}, "yhat")
    assert {r.k: r.max_lead_hours for r in out.collect()} == {"a": 0, "b": None, "c": 6}


def test_linear_baseline_learns_a_line(spark):
    df = hours(spark, [float(i % 37) for i in range(300)]).withColumns({"tide": F.col("v") * 0.5, "rain": F.lit(0.0), "flag": F.lit(0)})
    w = windows.make_windows(df, ["k"], "ts", "v", "tide", "rain", "flag", lookback=4, horizon=1)
    w = w.withColumn("is_train", F.col("target_ts") < F.lit("2024-01-10").cast("timestamp_ntz"))
    _, out = windows.train_linear(w, "is_train")
    nse = out.agg(*scores.regression_aggs(F.col("y"), F.col("yhat"))).first().nse
    assert nse > 0.9


def test_strict_time_counts_hours_whatever_the_blocks(spark, monkeypatch):
    from functools import partial

    from hydroseries.operators.frames import in_blocks

    df = hours(spark, range(300)).withColumns({"tide": F.col("v") * 2, "rain": F.lit(0.0), "flag": F.lit(0)})
    df = df.where("v not between 110 and 119 and v <> 200")
    seen = []
    for rows in (64, 4096):
        for module in (windows, response):
            monkeypatch.setattr(module, "in_blocks", partial(in_blocks, rows=rows))
        base = windows.baseline_forecast(df, ["k"], "ts", "v", 6).orderBy("ts").collect()
        assert all(r.y == r.persistence + 6 and r.day_before in (None, r.persistence - 18) for r in base)
        assert [r.day_before for r in base if r.persistence == 130.0] == [None]
        made = windows.make_windows(df, ["k"], "ts", "v", "tide", "rain", "flag", 5, 2, strict_time=True).orderBy("ts").collect()
        assert all(r.y == r.y_last + 2 and [h.v for h in r.history] == [r.y_last - 4 + i for i in range(5)] for r in made)
        curve = response.lag_correlation(df, ["k"], "ts", "v", {"tide": "tide"}, 18, strict_time=True).orderBy("lag_h").collect()
        assert all(abs(r["corr"] - 1) < 1e-9 for r in curve)
        seen.append((base, made, [r.lag_h for r in curve]))
    assert seen[0] == seen[1]


def test_a_distance_of_just_the_limit_is_no_spike(spark):
    # The median of 26.06 and 61.92 is 43.99; in doubles the distance to 63.99 comes out above 20.
    df = hours(spark, [26.06, 26.06, 26.06, 61.92, 61.92, 63.99]).withColumn("f", F.lit(0))
    out = harmonize.hourly_spike_filter(df, ["k"], "ts", "v", "f", limit=20.0)
    assert column(out, "f") == [0] * 6
    above = harmonize.hourly_spike_filter(df, ["k"], "ts", "v", "f", limit=19.99999)
    assert column(above, "f")[5] == 7


def test_interpolation_keeps_its_tasks_apart(spark):
    df = spark.range(64).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("h")).select(
        "k", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h)").alias("ts"), F.when(F.col("h") % 4 == 0, F.col("h").cast("double")).alias("v"))
    out = harmonize.interpolate_linear(df, ["k"], "ts", "v").withColumn("_p", F.spark_partition_id()).collect()
    assert {(r.k, r.ts.hour): r.v for r in out} == {(k, h): float(min(h, 8)) for k in range(64) for h in range(10)}
    assert len({r._p for r in out}) > 32


def test_a_distance_of_just_the_limit_is_no_spike_where_gaps_keep_their_flag(spark):
    df = hours(spark, [26.06, 26.06, None, 26.06, 61.92, 61.92, 63.99]).withColumn("f", F.when(F.col("v").isNull(), 9).otherwise(0))
    out = harmonize.hourly_spike_filter(df, ["k"], "ts", "v", "f", limit=20.0, keep_gap_flag=True)
    assert column(out, "f") == [0, 0, 9, 0, 0, 0, 0] and column(out, "v")[6] == 63.99
