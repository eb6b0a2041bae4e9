"""Chunked scans, halos and quantiles equal the plain computation, however the series is cut."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hydroseries.operators.frames import in_blocks, join_per_key, scan_series, top_per_key, with_position
from hydroseries.operators.quantiles import exact_quantiles, medians


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(5)
    n = 3000
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n))
    v = np.where(rng.random(n) < 0.6, np.nan, rng.normal(0, 100, n))
    pdf = pd.DataFrame({"k": key, "t": np.cumsum(rng.integers(1, 9, n)), "v": v})
    rows = [(r.k, int(r.t), None if np.isnan(r.v) else float(r.v)) for r in pdf.itertuples()]
    return spark.createDataFrame(rows, "k string, t long, v double").repartition(7).cache(), pdf


@pytest.mark.parametrize("length", [10, 500, 100000])
def test_scan_equals_pandas(walk, length):
    df, pdf = walk
    out = scan_series(
        df.withColumn("c", F.floor(F.col("t") / length)), ["k"], "c", ["t"],
        prev={"p": F.col("v")}, next={"x": F.col("v")}, ffill={"f": F.col("v")}, bfill={"b": F.col("v")},
    )
    got = out.toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    pdf = pdf.sort_values(["k", "t"]).reset_index(drop=True)
    g = pdf.groupby("k")["v"]
    for name, want in (("p", g.shift()), ("x", g.shift(-1)), ("f", g.ffill()), ("b", g.bfill())):
        np.testing.assert_array_equal(got[name].to_numpy(dtype=float), want.to_numpy(), err_msg=name)


@pytest.mark.parametrize("rows", [4, 7, 4096])
def test_blocks_equal_plain_window(walk, rows):
    df, pdf = walk
    pos = with_position(df.withColumn("c", F.floor(F.col("t") / 100)), ["k"], "c", ["t"])
    out = in_blocks(pos, ["k"], "pos", {
        "a": lambda w: F.lag("v", 3).over(w), "b": lambda w: F.lead("v", 4).over(w), "s": lambda w: F.sum("v").over(w.rowsBetween(-3, 2)),
    }, before=3, after=4, rows=rows)
    w = Window.partitionBy("k").orderBy("t")
    want = df.select("*", (F.row_number().over(w) - 1).alias("pos"), F.lag("v", 3).over(w).alias("a"), F.lead("v", 4).over(w).alias("b"),
                     F.sum("v").over(w.rowsBetween(-3, 2)).alias("s"))
    cols = ["k", "t", "pos", "a", "b", "s"]
    a, b = (x.select(*cols).toPandas().sort_values(["k", "t"]).reset_index(drop=True) for x in (out, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_no_task_gets_a_whole_series(spark):
    """Rows left partitioned by series alone are cut again before an ordered step."""
    by_key = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), (F.col("id") / 50).cast("long").alias("c"))
    by_key = by_key.repartition(8, "k")
    limits = spark.createDataFrame([("hot", 1.0)], "k string, limit double")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        for out in (
            in_blocks(by_key, ["k"], "t", {"p": lambda w: F.lag("t").over(w)}, before=1, rows=50),
            scan_series(by_key, ["k"], "c", ["t"], prev={"p": F.col("t")}),
            with_position(by_key, ["k"], "c", ["t"]),
            join_per_key(by_key, limits, ["k"], "t"),
        ):
            sizes = [r["count"] for r in out.withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()]
            assert sum(sizes) == 1000 and max(sizes) < 500, sizes
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 2.0], [5.0] * 50, [-999.0] + list(range(200)), list(np.random.default_rng(1).normal(0, 1e-8, 301)),
    [1e300, -1e300, 0.0, -0.0, 1.0], list(np.random.default_rng(2).integers(0, 5, 500)),
])
def test_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("a", None), ("b", None)], "k string, v double").repartition(4)
    got = exact_quantiles(df, ["k"], F.col("v"), {"lo": 0.001, "mid": 0.5, "hi": 0.95, "top": 1.0}).collect()
    assert len(got) == 1 and got[0].n == len(values)
    for name, q in (("lo", 0.001), ("mid", 0.5), ("hi", 0.95), ("top", 1.0)):
        assert got[0][name] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-300), name


def test_quantile_total_counts_missing_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0)], "k string, v double")
    row = exact_quantiles(df, ["k"], F.col("v"), {"m": 0.5}, "n", "rows").first()
    assert (row.n, row.rows, row.m) == (2, 3, 2.0)


def test_medians_keep_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 4.0, None), ("b", None, 2.0)], "k string, x double, y double")
    got = {r.k: (r.x, r.y) for r in medians(df, ["k"], ["x", "y"]).collect()}
    assert got == {"a": (2.5, None), "b": (None, 2.0)}


def test_salted_join_keeps_every_row_once(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), F.col("id").alias("t"))
    per = spark.createDataFrame([(0, 1.5)], "k long, limit double")
    got = join_per_key(df, per, ["k"], "t").groupBy("limit").count().collect()
    assert {(r.limit, r["count"]) for r in got} == {(1.5, 250), (None, 250)}


def test_top_per_key_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    out = top_per_key(df, ["k"], [F.col("id").desc()], 2)
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 6
