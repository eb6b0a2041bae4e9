"""Coverage, missing rates, gaps, correlations and other plain aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydroseries.functions import cleaning as cl
from hydroseries.functions import timeparts as tp
from hydroseries.operators import report
from hydroseries.operators.frames import first_per_key, join_per_key
from hydroseries.operators.quantiles import exact_quantiles, medians
from hydroseries.operators.response import mean_removed
from hydroseries.plans.registry import (
    grid_events, hourly_events, hourly_sql, ntz, query, rounded, table,
)
from hydroseries.plans.series import POINT_QC_SQL, POINTS_SQL, SQL, flagged_points, q02_resample_hourly

HOURLY_FLAGS = SQL["q02_resample_hourly"]


@query("a03_coverage", f"""SELECT k, min(ts) AS start, max(ts) AS "end", count(*) AS n,
    round(avg(pct_flagged), 4) AS mean_share FROM ({HOURLY_FLAGS}) GROUP BY k""")
def a03_coverage(spark, sf_dir):
    return report.coverage(q02_resample_hourly(spark, sf_dir), ["k"], "ts", "pct_flagged")


@query("q08_quality_report", f"""WITH h AS ({HOURLY_FLAGS}),
    a AS (SELECT k, ts, mean, count(mean) OVER (PARTITION BY k ORDER BY ts) AS isle FROM h),
    b AS (SELECT k, min(ts) AS gap_from, max(ts) AS gap_to, count(*) AS gap_rows FROM a WHERE mean IS NULL GROUP BY k, isle),
    c AS (SELECT k, arg_max(gap_from, ROW(gap_rows, -epoch_us(gap_from))) AS gap_from, arg_max(gap_to, ROW(gap_rows, -epoch_us(gap_from))) AS gap_to,
                 max(gap_rows) AS gap_rows, count(*) AS n_gaps FROM b GROUP BY k),
    d AS (SELECT k, min(ts) AS start, max(ts) AS "end", count(*) AS n_rows, count(*) - count(mean) AS n_missing, count(*) FILTER (qc_flag = 0) AS n_flag_0,
                 count(*) FILTER (qc_flag = 8) AS n_flag_8, count(*) FILTER (qc_flag = 9) AS n_flag_9 FROM h GROUP BY k)
    SELECT d.*, round(n_missing / n_rows, 6) AS missing_rate, coalesce(n_gaps, 0) AS n_gaps, gap_from, gap_to, coalesce(gap_rows, 0) AS gap_rows FROM d LEFT JOIN c USING (k)""")
def q08_quality_report(spark, sf_dir):
    return rounded(report.quality_report(q02_resample_hourly(spark, sf_dir), ["k"], "ts", "mean", "qc_flag", (0, 8, 9)), "missing_rate")


@query("a01_hourly_aggregate", "SELECT user_id, date_trunc('hour', ts) AS ts, round(avg(value), 6) AS mean, max(value) AS max,"
       " count(value) AS n FROM events GROUP BY 1, 2")
def a01_hourly_aggregate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", tp.hour_of(F.col("ts")).alias("ts")).agg(
        F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("max"), F.count("value").alias("n")
    )


@query("a02_flagged_share", f"WITH {POINTS_SQL},{POINT_QC_SQL} SELECT k, ts, round(avg((qc_flag <> 0)::INTEGER), 6) AS share"
       " FROM flagged GROUP BY 1, 2")
def a02_flagged_share(spark, sf_dir):
    f = flagged_points(spark, sf_dir)
    return f.groupBy("k", "ts").agg(F.round(F.avg((F.col("qc_flag") != 0).cast("double")), 6).alias("share"))


@query("a04_monthly_missing", """SELECT l_returnflag AS k, date_trunc('month', l_shipdate)::TIMESTAMP AS month, count(*) AS n_obs,
    day(last_day(l_shipdate::DATE)) * 144 AS expected,
    round(greatest(0.0::DOUBLE, 1 - count(*) / (day(last_day(l_shipdate::DATE)) * 144)::DOUBLE), 6) AS missing_rate
    FROM lineitem GROUP BY 1, 2, 4""")
def a04_monthly_missing(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_shipdate").alias("ts"))
    return rounded(report.monthly_missing(df, ["k"], "ts"), "missing_rate")


@query("a05_monthly_null_rates", f"""WITH {hourly_sql('user_id', True)} SELECT k, date_trunc('month', ts)::TIMESTAMP AS month,
    round(avg((v IS NULL)::INTEGER), 6) AS v, round(avg((n IS NULL)::INTEGER), 6) AS n FROM g GROUP BY 1, 2""")
def a05_monthly_null_rates(spark, sf_dir):
    return rounded(report.monthly_null_rates(grid_events(spark, sf_dir, "user_id"), ["k"], "ts", ["v", "n"]), "v", "n")


@query("a06_flag_histogram", f"WITH {POINTS_SQL},{POINT_QC_SQL} SELECT k, qc_flag, count(*) AS n FROM flagged GROUP BY 1, 2")
def a06_flag_histogram(spark, sf_dir):
    f = flagged_points(spark, sf_dir).withColumn("qc_flag", F.col("qc_flag").cast("int"))
    return report.flag_histogram(f, ["k"], "qc_flag")


@query("a07_exact_quantiles", """SELECT l_returnflag AS k, count(*) AS n, round(quantile_cont(l_extendedprice, 0.001), 6) AS lo,
    round(quantile_cont(l_extendedprice, 0.999), 6) AS hi FROM lineitem GROUP BY 1""")
def a07_exact_quantiles(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_returnflag"))
    return rounded(exact_quantiles(df, ["k"], F.col("l_extendedprice"), {"lo": 0.001, "hi": 0.999}), "lo", "hi")


@query("a08_train_percentile", f"""WITH {hourly_sql('user_id', True)} SELECT k, count(v) AS n, round(quantile_cont(v, 0.95), 6) AS p95
    FROM g WHERE ts < TIMESTAMP '2024-01-20' AND v IS NOT NULL GROUP BY k""")
def a08_train_percentile(spark, sf_dir):
    g = grid_events(spark, sf_dir, "user_id").where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return rounded(exact_quantiles(g, ["k"], F.col("v"), {"p95": 0.95}), "p95")


@query("a12_medians", """SELECT o_orderpriority AS k, round(median(o_totalprice), 6) AS o_totalprice,
    round(median(o_custkey)::DOUBLE, 6) AS o_custkey FROM orders GROUP BY 1""")
def a12_medians(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderpriority"))
    return rounded(medians(o, ["k"], ["o_totalprice", "o_custkey"]), "o_totalprice", "o_custkey")


@query("a13_pivot_mean", """SELECT event_type AS k, day(ts) AS d,
    round(avg(value) FILTER (hour(ts) < 12), 6) AS am, round(avg(value) FILTER (hour(ts) >= 12), 6) AS pm
    FROM events GROUP BY 1, 2""")
def a13_pivot_mean(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("half", F.when(F.hour("ts") < 12, "am").otherwise("pm"))
    out = e.groupBy(F.col("event_type").alias("k"), F.dayofmonth("ts").cast("long").alias("d")).pivot("half", ["am", "pm"])
    return rounded(out.agg(F.avg("value")), "am", "pm")


@query("a14_sum_all_null", f"""WITH {hourly_sql('user_id', True)} SELECT k, date_trunc('day', ts)::TIMESTAMP AS day,
    round(sum(v), 6) AS total FROM g GROUP BY 1, 2""")
def a14_sum_all_null(spark, sf_dir):
    g = grid_events(spark, sf_dir, "user_id")
    return g.groupBy("k", ntz(F.date_trunc("day", "ts")).alias("day")).agg(F.round(F.sum("v"), 6).alias("total"))


@query("a15_text_counts", """SELECT upper(event_type) AS kind,
    sum(try_cast(CASE WHEN value < 20 THEN 'n/a' ELSE json_extract_string(props, '$.k') END AS INTEGER))::BIGINT AS n
    FROM events GROUP BY 1""")
def a15_text_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("value") < 20, "n/a").otherwise(F.get_json_object("props", "$.k"))
    return e.groupBy(F.upper("event_type").alias("kind")).agg(F.sum(cl.to_number(text, "int")).alias("n"))


@query("a16_argmax_first", """SELECT user_id, arg_min(ts, ROW(-value, ts)) AS at, max(value) AS peak,
    arg_min(ts, ROW(value, ts)) AS low_at FROM events GROUP BY 1""")
def a16_argmax_first(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("value").isNotNull())
    return e.groupBy("user_id").agg(
        F.min_by("ts", F.struct(-F.col("value"), F.col("ts"))).alias("at"),
        F.max("value").alias("peak"),
        F.min_by("ts", F.struct(F.col("value"), F.col("ts"))).alias("low_at"),
    )


@query("a17_first_exceedance", """SELECT user_id, min(ts) FILTER (value >= 100) AS first_ts,
    coalesce(bool_or(value >= 100), false) AS any_over FROM events GROUP BY 1""")
def a17_a18_first_and_any(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(
        F.min(F.when(F.col("value") >= 100, F.col("ts"))).alias("first_ts"),
        F.coalesce(F.bool_or(F.col("value") >= 100), F.lit(False)).alias("any_over"),
    )


@query("a20_correlations", """WITH c AS (SELECT l_returnflag AS k, corr(l_quantity, l_extendedprice) AS qp, corr(l_quantity, l_discount) AS qd,
    corr(l_extendedprice, l_discount) AS pd FROM lineitem GROUP BY 1)
    SELECT k, x.a, x.b, round(x.c, 6) AS corr FROM (SELECT k, unnest([
      {'a': 'l_quantity', 'b': 'l_quantity', 'c': 1.0::DOUBLE}, {'a': 'l_extendedprice', 'b': 'l_extendedprice', 'c': 1.0},
      {'a': 'l_discount', 'b': 'l_discount', 'c': 1.0}, {'a': 'l_quantity', 'b': 'l_extendedprice', 'c': qp},
      {'a': 'l_extendedprice', 'b': 'l_quantity', 'c': qp}, {'a': 'l_quantity', 'b': 'l_discount', 'c': qd},
      {'a': 'l_discount', 'b': 'l_quantity', 'c': qd}, {'a': 'l_extendedprice', 'b': 'l_discount', 'c': pd},
      {'a': 'l_discount', 'b': 'l_extendedprice', 'c': pd}]) AS x FROM c)""")
def a20_correlations(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("k", F.col("l_returnflag"))
    return rounded(report.correlations(df, ["k"], ["l_quantity", "l_extendedprice", "l_discount"]), "corr")


@query("a21_mean_over_cells", "SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS day, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def a21_mean_over_cells(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.groupBy(ntz(F.date_trunc("day", "l_shipdate")).alias("day")).agg(F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("a22_month_climatology", "SELECT month(l_shipdate)::INTEGER AS month, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def a22_month_climatology(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.month("l_shipdate").alias("month")).agg(
        F.round(F.avg("l_quantity"), 6).alias("mean")
    )


@query("a23_flag_share_by_month", """SELECT o_orderpriority AS k, date_trunc('month', o_orderdate)::TIMESTAMP AS month,
    round(avg((o_orderstatus = 'F')::INTEGER) * 100, 6) AS share_pct FROM orders GROUP BY 1, 2""")
def a23_flag_share_by_month(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("k"), F.col("o_orderdate").alias("ts"), (F.col("o_orderstatus") == "F").cast("int").alias("f")
    )
    return rounded(report.flag_share_by_month(o, ["k"], "ts", "f", 1), "share_pct")


@query("a27_distinct_and_lists", """SELECT o_orderstatus AS k, count(DISTINCT o_custkey) AS n_customers,
    array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS priorities FROM orders GROUP BY 1""")
def a27_distinct_and_lists(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    # Distinct first: the list is built from one row per value.
    names = o.select(F.col("o_orderstatus").alias("k"), "o_orderpriority").distinct()
    lists = names.groupBy("k").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("priorities"))
    n = o.groupBy(F.col("o_orderstatus").alias("k")).agg(F.count_distinct("o_custkey").alias("n_customers"))
    return n.join(lists, "k")


@query("w01_repeated_times", """SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY event_id) > 1 AS is_copy FROM events""")
def w01_repeated_times(spark, sf_dir):
    from hydroseries.operators.qc import flag_repeated_times

    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.date_trunc("day", "ts").alias("day"))
    return flag_repeated_times(e, ["user_id"], "day", "event_id").select("event_id", "is_copy")


@query("w01_repeated_times_lost", """WITH e AS (SELECT event_id, CASE WHEN event_id % 9 <> 4 THEN user_id END AS u,
      CASE WHEN event_id % 7 <> 2 THEN date_trunc('day', ts) END AS day FROM events)
    SELECT event_id, row_number() OVER (PARTITION BY u, day ORDER BY event_id) > 1 AS is_copy FROM e""")
def w01_repeated_times_lost(spark, sf_dir):
    """Missing users and times count as equal."""
    from hydroseries.operators.qc import flag_repeated_times

    n = F.col("event_id")
    e = table(spark, sf_dir, "events").select(
        "event_id", F.when(n % 9 != 4, F.col("user_id")).alias("u"), F.when(n % 7 != 2, F.date_trunc("day", "ts")).alias("day")
    )
    return flag_repeated_times(e, ["u"], "day", "event_id").select("event_id", "is_copy")


@query("w02_runs", """WITH a AS (SELECT user_id AS k, event_id, ts, floor(value / 50) AS v FROM events),
    b AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS c FROM a WINDOW w AS (PARTITION BY k ORDER BY ts)),
    d AS (SELECT *, sum(c) OVER (PARTITION BY k ORDER BY ts) AS run FROM b)
    SELECT k, event_id, min(ts) OVER r AS run_from, max(ts) OVER r AS run_to FROM d WINDOW r AS (PARTITION BY k, run)""")
def w02_w03_runs(spark, sf_dir):
    """Islands of equal value and their span, brought back to the rows."""
    from hydroseries.operators.frames import scan_series

    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("k"), "event_id", "ts", F.floor(F.col("value") / 50).alias("v"), tp.day_number(F.col("ts")).alias("c")
    )
    e = scan_series(e, ["k"], "c", ["ts"], prev={"pv": F.col("v")}, next={"nv": F.col("v")})
    starts = F.when(~cl.holds(F.col("v") == F.col("pv")), F.col("ts"))
    ends = F.when(~cl.holds(F.col("v") == F.col("nv")), F.col("ts"))
    out = scan_series(e, ["k"], "c", ["ts"], ffill={"run_from": starts}, bfill={"run_to": ends})
    return out.select("k", "event_id", "run_from", "run_to")


@query("w04_rate_of_change", """SELECT event_id, round(abs(value - lag(value) OVER w) / nullif(date_diff('microsecond', lag(ts) OVER w, ts) / 60e6, 0) * 10, 6) AS rate
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def w04_rate_of_change(spark, sf_dir):
    from hydroseries.operators.frames import scan_series

    e = table(spark, sf_dir, "events").withColumn("c", tp.day_number(F.col("ts")))
    e = scan_series(e, ["user_id"], "c", ["ts", "event_id"], prev={"pt": F.col("ts"), "pv": F.col("value")})
    gap = F.nullif(tp.minutes_between(F.col("ts"), F.col("pt")), F.lit(0.0))
    return e.select("event_id", F.round(F.abs(F.col("value") - F.col("pv")) / gap * 10, 6).alias("rate"))


@query("w05_outside_quantiles", """WITH q AS (SELECT event_type, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY 1)
    SELECT event_id, value < lo OR value > hi AS outside FROM events JOIN q USING (event_type)""")
def w05_outside_quantiles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    q = exact_quantiles(e, ["event_type"], F.col("value"), {"lo": 0.01, "hi": 0.99})
    return join_per_key(e, q, ["event_type"], "ts").select("event_id", ((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))).alias("outside"))


@query("w06_centred_median", f"""WITH {hourly_sql('user_id')} SELECT k, ts, round(CASE WHEN count(v) OVER w >= 5 THEN median(v) OVER w END, 6) AS around
    FROM h WINDOW w AS (PARTITION BY k ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)""")
def w06_centred_median(spark, sf_dir):
    from hydroseries.operators.harmonize import centred_median

    h = hourly_events(spark, sf_dir, "user_id").select("k", "ts", "v")
    return rounded(centred_median(h, ["k"], "ts", "v").select("k", "ts", "around"), "around")


@query("w08_longest_missing", f"""WITH {hourly_sql('user_id', True)},
    a AS (SELECT k, ts, v, count(v) OVER (PARTITION BY k ORDER BY ts) AS isle FROM g),
    b AS (SELECT k, min(ts) AS gap_from, max(ts) AS gap_to, count(*) AS n_rows FROM a WHERE v IS NULL GROUP BY k, isle),
    c AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n_rows DESC, gap_from)::INTEGER AS rank FROM b)
    SELECT k, gap_from, gap_to, n_rows, rank FROM c WHERE rank <= 5""")
def w08_longest_missing(spark, sf_dir):
    return report.longest_missing(grid_events(spark, sf_dir, "user_id"), ["k"], "ts", "v")


@query("w15_longest_gaps", """WITH a AS (SELECT user_id, ts AS gap_to, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_from FROM events),
    b AS (SELECT *, date_diff('microsecond', gap_from, gap_to) / 60e6 AS m FROM a WHERE gap_from IS NOT NULL),
    c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m DESC, gap_from)::INTEGER AS rank FROM b)
    SELECT user_id, gap_from, gap_to, round(m * 60e6)::BIGINT AS micros, rank FROM c WHERE rank <= 5""")
def w15_o02_longest_gaps(spark, sf_dir):
    out = report.longest_gaps(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id")
    return out.withColumn("micros", F.round(F.col("minutes") * 60e6).cast("long")).drop("minutes")


@query("w17_first_per_key", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER
    (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def w17_first_per_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return first_per_key(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query("w18_mean_removed", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY event_type), 6) AS anomaly FROM events")
def w18_mean_removed(spark, sf_dir):
    out = mean_removed(table(spark, sf_dir, "events"), ["event_type"], "value", spread="ts")
    return rounded(out.select("event_id", "anomaly"), "anomaly")
