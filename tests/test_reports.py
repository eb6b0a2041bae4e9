"""Quality report and complete grids against plain loops, over many chunks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from hydroseries.operators.grid import GRID_TASKS, complete_grid
from hydroseries.operators.report import longest_missing, quality_report

START = dt.datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp_ntz, v double, flag int, more string"


def plain(rows):
    """Counts, number of gaps and the longest (first on ties) of one series."""
    rows = sorted(rows, key=lambda r: r[1])
    gaps, run = [], []
    for r in rows:
        if r[2] is None or r[2] != r[2]:
            run.append(r[1])
        elif run:
            gaps.append(run)
            run = []
    if run:
        gaps.append(run)
    best = max(gaps, key=len, default=[])
    missing = sum(map(len, gaps))
    return (rows[0][1], rows[-1][1], len(rows), missing, missing / len(rows), len(gaps), best[0] if best else None, best[-1] if best else None,
            len(best), *[sum(r[3] == f for r in rows) for f in (0, 7)])


@pytest.mark.parametrize("seed", range(3))
def test_quality_report(spark, seed):
    """Gaps over one and several chunk borders, at both ends, whole series missing, ties and one row."""
    rng = random.Random(seed)
    data = {}
    for k, hours in (("long", 3000), ("short", 30), ("one", 1), ("none", 900), ("full", 900)):
        rows, missing = [], False
        for h in range(hours):
            if rng.random() < (0.004 if missing else 0.01):
                missing = not missing
            gone = {"none": True, "full": False}.get(k, missing)
            rows.append((k, START + dt.timedelta(hours=h + rng.random() / 2), rng.choice([None, float("nan")]) if gone else rng.random(), rng.choice([0, 7, 9, None]), "x"))
        data[k] = rows
    df = spark.createDataFrame([r for rows in data.values() for r in rows] + [("long", None, None, 0, "x")], SCHEMA).repartition(7)
    got = {r.k: tuple(r)[1:] for r in quality_report(df, ["k"], "ts", "v", "flag", (0, 7)).collect()}
    assert got == {k: plain(rows) for k, rows in data.items()}
    first = {r.k: (r.gap_from, r.gap_to, r.n_rows) for r in longest_missing(df.where("ts is not null").withColumn("v", F.nanvl("v", F.lit(None).cast("double"))), ["k"], "ts", "v", 1).collect()}
    assert first == {k: g[6:9] for k, g in got.items() if g[8]}
    assert quality_report(df.where("false"), ["k"], "ts", "v", "flag").count() == 0


def test_grid_of_a_long_key_is_dealt_over_tasks(spark):
    ends = [("a", START), ("a", START + dt.timedelta(seconds=1_999_999)), ("b", START), ("b", START + dt.timedelta(seconds=5)), ("c", START)]
    df = spark.createDataFrame([(k, t, 1) for k, t in ends], "k string, ts timestamp_ntz, v int")
    out = complete_grid(df, ["k"], "ts", "interval 1 second")
    counts = {r.k: (r.n, r.v, r.d) for r in out.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.countDistinct("ts").alias("d")).collect()}
    assert counts == {"a": (2_000_000, 2, 2_000_000), "b": (6, 2, 6), "c": (1, 1, 1)}
    assert "hashpartitioning(k" in out._jdf.queryExecution().toString() and "_at" in out._jdf.queryExecution().toString().split("hashpartitioning(k", 1)[1]


def test_grid_asked_for_values_only_is_not_broadcast(spark):
    df = spark.createDataFrame([(k, START + dt.timedelta(hours=h), 1.0 * h) for k in "ab" for h in (0, 3, 9)], "k string, ts timestamp_ntz, v double")
    out = complete_grid(df, ["k"], "ts").where(F.col("v").isNotNull())
    assert sorted((r.k, r.ts, r.v) for r in out.collect()) == sorted((r.k, r.ts, r.v) for r in df.collect())
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_query_for_present_hours_never_broadcasts_the_grid(spark, tmp_path):
    from hydroseries.plans import load_all
    from hydroseries.plans.registry import QUERIES

    load_all()
    rows = [(i, START + dt.timedelta(hours=h, minutes=i), u, "view", float(i)) for i, (u, h) in enumerate([(1, 0), (1, 0), (1, 5), (2, 3), (2, 90), (2, 90)])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES["p10_drop_missing"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect())) == [(1, START, 0.5), (2, START + dt.timedelta(hours=90), 4.5)]
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_grids_of_many_short_keys_are_made_by_many_tasks(spark):
    """A key here is one start of a few bytes, of which adaptive execution would give all to one task."""
    df = spark.range(2_000).select(F.col("id").alias("k"), F.explode(F.array(F.lit(0), F.lit(50))).alias("h"))
    df = df.select("k", (F.lit(START).cast("timestamp_ntz") + F.make_interval(hours="h")).cast("timestamp_ntz").alias("ts"), F.lit(1).alias("v"))
    sc = spark.sparkContext
    sc.setJobGroup("short keys", "")
    try:
        rows = complete_grid(df, ["k"], "ts").collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(rows) == 2_000 * 51 and len({(r.k, r.ts) for r in rows}) == len(rows) and sum(r.v or 0 for r in rows) == 4_000
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("short keys") for s in tracker.getJobInfo(j).stageIds}
    done = [tracker.getStageInfo(s).numCompletedTasks for s in stages if tracker.getStageInfo(s)]
    assert sum(n >= GRID_TASKS for n in done) >= 2  # the steps, and their join
