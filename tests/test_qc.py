"""Point flags and hourly series on small literal series and against pandas on random ones."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydroseries.operators.grid import complete_grid, resample_hourly
from hydroseries.operators.qc import drop_repeated_times, flag_repeated_times, point_qc

T0 = datetime(2026, 1, 1)


def series(spark, values, step=10, times=None, key="1"):
    times = times or [T0 + timedelta(minutes=step * i) for i in range(len(values))]
    rows = [(key, t, float(v) if v is not None else None, i) for i, (t, v) in enumerate(zip(times, values))]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double, n long")


def flags(df, **kw):
    out = point_qc(df, ["k"], "ts", "v", "n", **kw)
    return [r.qc_flag for r in out.orderBy("k", "n").collect()]


def test_sentinel_is_flagged_but_negative_is_not(spark):
    assert flags(series(spark, [100, -999, 105, -5, 102]))[:4] == [0, 1, 0, 0]


def test_equal_values_for_more_than_an_hour_are_stuck(spark):
    assert flags(series(spark, [100.0] * 8 + [101.0, 102.0])) == [2] * 8 + [0, 0]


def test_exactly_one_hour_is_not_stuck(spark):
    assert flags(series(spark, [100.0] * 7 + [101.0])) == [0] * 8


def test_missing_values_never_form_a_run(spark):
    assert flags(series(spark, [None] * 9 + [1.0])) == [0] * 10


def test_repeated_time(spark):
    times = [T0, T0, T0 + timedelta(minutes=10)]
    assert flags(series(spark, [100.0, 101.0, 102.0], times=times)) == [0, 4, 0]


def test_run_over_chunk_borders(spark):
    """A run over several days, seen from rows of every chunk it touches."""
    values = [1.0] + [7.0] * 60 + [2.0]
    assert flags(series(spark, values, step=60)) == [0] + [2] * 60 + [0]


def test_nan_counts_as_missing(spark):
    df = series(spark, [float("nan")] * 9)
    assert flags(df) == [0] * 9


def brute(pdf):
    """The rules row by row on one calibrated group, sorted by time and tie."""
    v, t = pdf["v"].to_numpy(), pdf["ts"].to_numpy()
    n = len(pdf)
    lo, hi = (pdf["v"].quantile(q) for q in (0.001, 0.999)) if n >= 100 else (-np.inf, np.inf)
    minutes = np.r_[np.nan, np.diff(t) / np.timedelta64(1, "s") / 60]
    rate = np.r_[np.nan, np.abs(np.diff(v))] / np.where(minutes == 0, np.nan, minutes) * 10
    known = rate[~np.isnan(rate)]
    top = np.quantile(known, 0.999) if len(known) >= 100 else np.inf
    out, start = [], 0
    spans = np.zeros(n)
    for i in range(1, n + 1):
        if i == n or v[i] != v[i - 1]:
            spans[start:i] = (t[i - 1] - t[start]) / np.timedelta64(1, "m")
            start = i
    for i in range(n):
        if v[i] == -999 or v[i] < lo or v[i] > hi:
            out.append(1)
        elif i and t[i] == t[i - 1]:
            out.append(4)
        elif spans[i] > 60:
            out.append(2)
        elif rate[i] > top:
            out.append(3)
        else:
            out.append(0)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_series_with_one_dominant_key_and_many_copies(spark, seed):
    """Against the plain rules: gaps, copies, sentinels, runs, NULLs, two years, a dominant series."""
    rng = np.random.default_rng(seed)
    frames = []
    for key, n in (("big", 1500), ("mid", 300), ("tiny", 40)):
        step = rng.choice([0, 0, 5, 10, 10, 60, 400], n)
        ts = pd.Timestamp("2025-12-28") + pd.to_timedelta(np.cumsum(step), unit="min")
        v = np.where(rng.random(n) < 0.5, 50.0, np.round(rng.normal(50, 3, n)))
        v[rng.random(n) < 0.01] = -999
        v[rng.random(n) < 0.05] = np.nan
        frames.append(pd.DataFrame({"k": key, "ts": ts, "v": v, "n": np.arange(n)}))
    pdf = pd.concat(frames)
    want = []
    for _, g in pdf.groupby(["k", pdf["ts"].dt.year]):
        g = g.sort_values(["ts", "n"])
        want.append(g.assign(f=brute(g))[["k", "n", "f"]])
    want = pd.concat(want).sort_values(["k", "n"])["f"].tolist()
    rows = [(r.k, r.ts.to_pydatetime(), None if np.isnan(r.v) else float(r.v), int(r.n)) for r in pdf.itertuples()]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double, n long").repartition(5, "v")
    assert flags(df) == want


def test_copies_are_dropped_or_marked(spark):
    df = series(spark, [1, 2, 3], times=[T0, T0, T0])
    assert [r.v for r in drop_repeated_times(df, ["k"], "ts", "n").collect()] == [1.0]
    marked = flag_repeated_times(df, ["k"], "ts", "n").orderBy("n").collect()
    assert [r.is_copy for r in marked] == [False, True, True]


def flagged(spark, values, flags_, step=10):
    df = series(spark, values, step)
    table = F.array(*[F.lit(f) for f in flags_])
    return df.withColumn("qc_flag", F.get(table, F.col("n").cast("int")))


def test_gap_hour(spark):
    out = resample_hourly(flagged(spark, [1, 2], [0, 0], step=70), ["k"], "ts", "v").collect()
    assert 9 in {r.qc_flag for r in out}


def test_degraded_hour(spark):
    out = resample_hourly(flagged(spark, [5] * 10, [2] * 8 + [0, 0], step=5), ["k"], "ts", "v").collect()
    assert [(r.n_obs, r.pct_flagged, r.qc_flag) for r in out] == [(10, 0.8, 8)]


def test_clean_hour(spark):
    out = resample_hourly(flagged(spark, [1, 2, 3, 4, 5], [0] * 5), ["k"], "ts", "v").collect()
    assert [(r.n_obs, r.pct_flagged, r.qc_flag, r.mean, r.max) for r in out] == [(5, 0.0, 0, 3.0, 5.0)]


def test_grid_has_every_hour_between_first_and_last(spark):
    df = series(spark, [1, 2], times=[T0, T0 + timedelta(hours=5)])
    out = complete_grid(df.select("k", "ts", "v"), ["k"], "ts").orderBy("ts").collect()
    assert [r.v for r in out] == [1.0, None, None, None, None, 2.0]


def test_rows_without_key_or_time_keep_their_place(spark):
    from datetime import datetime

    t = datetime(2024, 1, 1)
    rows = [(1, "a", t, 5.0), (2, "a", None, 5.0), (3, None, t, 5.0), (4, "a", t, 6.0), (5, None, t, 7.0), (6, "a", None, 1.0)]
    df = spark.createDataFrame(rows, "n long, k string, ts timestamp_ntz, v double")
    for calibration in ("series", "series_year"):
        flags = {r.n: r.qc_flag for r in point_qc(df, ["k"], "ts", "v", "n", calibration=calibration).collect()}
        assert flags == {1: 0, 2: 1, 3: 1, 4: 4, 5: 1, 6: 1}
    copies = {r.n: r.is_copy for r in flag_repeated_times(df, ["k"], "ts", "n").collect()}
    assert copies == {1: False, 2: False, 3: False, 4: True, 5: True, 6: True}


def test_exact_mean_does_not_leave_halves_to_the_order_of_rows(spark):
    from hydroseries.functions.cleaning import exact_mean

    values = [29.27] * 31 + [9.04] + [None]
    rows = [(k, sign * x if x is not None else None, i) for k, sign in (("up", 1), ("down", -1)) for i, x in enumerate(values)] + [("none", None, 0)]
    df = spark.createDataFrame(rows, "k string, v double, i int")
    want = {"up": 28.637813, "down": -28.637813, "none": None}  # 916.41 / 32 = 28.6378125
    for order in ("i", "v"):
        assert {r.k: r.m for r in df.orderBy(order).groupBy("k").agg(exact_mean(F.col("v")).alias("m")).collect()} == want
