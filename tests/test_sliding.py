"""Sliding medians against pandas and brute force, on irregular times, ties and missing values."""

import math
import random
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hydroseries.operators.harmonize import trailing_median
from hydroseries.operators.sliding import SlidingMedian, trailing_medians


def test_sliding_median_equals_numpy():
    rng = random.Random(1)
    window, held = SlidingMedian(), {}
    for entry in range(3000):
        v = rng.choice([rng.gauss(0, 1), float(rng.randint(0, 3))])
        window.add(v, entry)
        held[entry] = v
        while len(held) > 40 or (held and rng.random() < 0.45):
            gone = rng.choice(list(held))
            window.remove(gone)
            del held[gone]
        assert len(window) == len(held)
        if held:
            assert math.isclose(window.median(), float(np.median(list(held.values()))), rel_tol=1e-15, abs_tol=1e-15)


def test_trailing_medians_equal_pandas_on_irregular_times():
    rng = np.random.default_rng(2)
    at = np.cumsum(rng.integers(1, 5000, 4000))
    v = rng.normal(0, 1, 4000)
    v[rng.random(4000) < 0.2] = np.nan
    want = pd.Series(v, index=pd.to_datetime(at, unit="s")).rolling("24h", min_periods=12).median()
    got = trailing_medians(at.tolist(), v.tolist(), 86_400, 12)
    np.testing.assert_allclose(np.array(got, dtype=float), want.to_numpy())
    assert trailing_medians([5, 5, 5], [1.0, 2.0, 9.0], 1, 1) == [2.0, 2.0, 2.0]
    assert trailing_medians([], [], 10, 1) == []


def test_cost_per_row_hardly_grows_with_the_window():
    v = np.random.default_rng(3).normal(0, 1, 60_000).tolist()
    at = list(range(len(v)))

    def took(reach):
        start = time.process_time()
        trailing_medians(at, v, reach, 1)
        return time.process_time() - start

    # A window of 30,000 rows instead of 30: a sort of each would cost a thousand times as much.
    assert took(30_000) < 8 * took(30)


def test_trailing_median_over_blocks(spark):
    rng = np.random.default_rng(4)
    at = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(rng.integers(60, 4 * 3600, 900)), unit="s")
    v = rng.normal(0, 1, 900)
    frame = pd.DataFrame({"k": np.where(np.arange(900) % 3 == 0, "a", "b"), "ts": at, "v": v, "more": [None if i % 5 else "x" for i in range(900)]})
    df = spark.createDataFrame(frame).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = trailing_median(df, ["k"], "ts", "v", 24, 5).toPandas().sort_values("ts")
    assert list(got.columns) == ["k", "ts", "v", "more", "base"] and len(got) == 900
    for k, part in frame.groupby("k"):
        want = part.set_index("ts")["v"].rolling("24h", min_periods=5).median().to_numpy()
        np.testing.assert_allclose(got[got.k == k]["base"].to_numpy(dtype=float), want)
