"""Radix selection of quantiles against numpy, on awkward numbers and crowded cells."""

import math
import struct

import numpy as np
from pyspark.sql import functions as F

from hydroseries.operators.quantiles import exact_quantiles, order_key

ODD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, math.nextafter(1.0, 0), math.nextafter(1.0, 2),
       2.0**52, 2.0**1023, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 1e-300, 3.5, -3.5, 1e15, 0.1, 8.0, math.nextafter(8.0, 0)]


def bits(v):
    b = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
    return -b if v < 0 else b


def test_order_key_is_the_bits_of_the_double(spark):
    rng = np.random.default_rng(3)
    wild = rng.integers(0, 2**63 - 1, 3000, dtype=np.int64).view(np.float64)
    values = ODD + [float(v) for v in wild if math.isfinite(v)] + [2.0**k for k in range(-1074, 1024)]
    df = spark.createDataFrame([(v,) for v in values + [float("nan")]], "v double")
    got = df.select("v", order_key(F.col("v")).alias("k")).collect()
    for r in got:
        assert r.k == (2047 << 52) + 1 if math.isnan(r.v) else r.k == bits(r.v), r
    assert df.select(order_key(F.lit(None).cast("double")).alias("k")).first().k is None


def test_quantiles_of_crowded_cells(spark):
    """All values of a group in one first cell, all equal, two values far apart, and groups without values."""
    rng = np.random.default_rng(4)
    groups = {"cell": 1 + rng.random(5000) * 2.0**-10, "dense": 1 + rng.integers(0, 50, 5000) * 2.0**-52, "same": np.full(3000, -7.25),
              "two": np.array([-1e300, 1e300]), "one": np.array([4.0]), "signs": rng.normal(0, 1, 2000), "inf": np.array([1.0, 2.0, np.inf])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("none", None), ("one", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(8)
    probs = {"a": 0.0, "b": 0.001, "c": 0.5, "d": 0.75, "e": 1.0}
    got = {r.k: r for r in exact_quantiles(df, ["k"], F.col("v"), probs, total="rows", keep_empty=True).collect()}
    assert set(got) == {*groups, "none"}
    assert (got["none"].n, got["none"].rows, got["none"].c) == (0, 1, None) and got["one"].rows == 2
    for k, x in groups.items():
        assert got[k].n == len(x)
        for name, p in probs.items():
            want = float(np.quantile(x, p)) if k != "inf" else None
            if want is not None:
                assert math.isclose(got[k][name], want, rel_tol=1e-12, abs_tol=1e-12), (k, name)
    assert got["inf"].c == 2.0 and got["inf"].e == math.inf
    assert {r.k for r in exact_quantiles(df, ["k"], F.col("v"), {"c": 0.5}).collect()} == set(groups)


def test_one_cell_is_dealt_over_tasks(spark):
    """Values of one leading cell are shuffled by value, not by group or cell."""
    df = spark.range(200_000).select(F.lit("k").alias("k"), (1 + F.col("id") / (1 << 40)).alias("v"))
    out = exact_quantiles(df, ["k"], F.col("v"), {"m": 0.5})
    plan = out._jdf.queryExecution().toString()
    assert "hashpartitioning(k" in plan and "_key" in plan.split("hashpartitioning(k", 1)[1]
    assert math.isclose(out.first().m, 1 + 99_999.5 / (1 << 40), rel_tol=1e-15)
