"""Projections, filters, joins, set operations and scalar functions on their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydroseries.functions import cleaning as cl
from hydroseries.functions import geo, text
from hydroseries.functions import timeparts as tp
from hydroseries.plans.registry import DRIVERS_SQL, hourly_events, hourly_sql, query, rounded, table, tide_hourly


def at(s: str):
    return F.lit(s).cast("timestamp_ntz")


@query("p01_select_rename", "SELECT event_id AS id, ts AS waktu, value AS tma_cm, 'hourly' AS resolution FROM events")
def p01_p02_select_rename(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return e.withColumnsRenamed({"event_id": "id", "ts": "waktu", "value": "tma_cm"}).withColumn("resolution", F.lit("hourly"))


@query("p03_drop_if_present", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def p03_drop_if_present(spark, sf_dir):
    return table(spark, sf_dir, "supplier").drop("s_acctbal", "qc_flag")


@query("p04_id_list", "SELECT event_id, user_id FROM events WHERE event_type IN ('view', 'error')")
def p04_id_list(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "error")).select("event_id", "user_id")


@query("p05_closed_time_range", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09'")
def p05_closed_time_range(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("ts").between(at("2024-01-05"), at("2024-01-09"))).select("event_id")


@query("p06_calendar_range", "SELECT event_id FROM events WHERE ts::DATE >= DATE '2024-01-20' AND ts::DATE <= DATE '2024-01-25'")
def p06_calendar_range(spark, sf_dir):
    day = F.to_date("ts")
    return table(spark, sf_dir, "events").where(day.between("2024-01-20", "2024-01-25")).select("event_id")


@query("p07_outside_range", f"WITH {hourly_sql('user_id', True)} SELECT k, ts, NOT coalesce(v BETWEEN 5 AND 150, false) AS outside FROM g")
def p07_outside_range(spark, sf_dir):
    from hydroseries.plans.registry import grid_events

    return grid_events(spark, sf_dir, "user_id").select("k", "ts", cl.outside_range(F.col("v"), 5, 150).alias("outside"))


@query("p08_flag_priority", """SELECT event_id, (CASE WHEN value < 1 THEN 1 WHEN value > 100 THEN 4 WHEN user_id % 5 = 0 THEN 2 ELSE 0 END)::INTEGER AS flag,
    CASE WHEN value >= 1 THEN value END AS value FROM events""")
def p08_p14_flag_priority(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("value") < 1, -999.0).otherwise(F.col("value")))
    gone = cl.is_sentinel(F.col("value"))
    flag = F.when(gone, 1).when(F.col("value") > 100, 4).when(F.col("user_id") % 5 == 0, 2).otherwise(0)
    return e.select("event_id", flag.alias("flag"), F.when(~gone, F.col("value")).alias("value"))


@query("p09_bounding_box", "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 100 AND 5000 AND c_nationkey BETWEEN 3 AND 12")
def p09_bounding_box(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.where(cl.in_box(F.col("c_acctbal"), F.col("c_nationkey"), (100, 5000, 3, 12))).select("c_custkey")


@query("p10_drop_missing", f"WITH {hourly_sql('user_id', True)} SELECT k, ts, round(v, 6) AS v FROM g WHERE v IS NOT NULL AND n > 1")
def p10_drop_missing(spark, sf_dir):
    from hydroseries.plans.registry import grid_events

    g = grid_events(spark, sf_dir, "user_id").dropna(subset=["v"]).where(F.col("n") > 1)
    return rounded(g.select("k", "ts", "v"), "v")


@query("p11_text_equality", "SELECT o_orderkey FROM orders WHERE o_orderpriority ILIKE '1-urgent' OR upper(o_orderpriority) LIKE '%SPEC%'")
def p11_text_equality(spark, sf_dir):
    p = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").where(cl.same_text(p, F.lit("1-urgent")) | F.upper(p).like("%SPEC%")).select("o_orderkey")


@query("p12_category", "SELECT doc_id, source FROM documents WHERE lang = 'en'")
def p12_category(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("lang") == "en").select("doc_id", "source")


@query("p13_class_by_sets", """SELECT c_custkey, CASE WHEN c_nationkey IN (1, 2) THEN 'outlet' WHEN c_nationkey = 3 THEN 'isolated' WHEN c_nationkey IN (4, 5, 6) THEN 'bubble pump' ELSE 'canal' END AS cls FROM customer""")
def p13_class_by_sets(spark, sf_dir):
    n = F.col("c_nationkey")
    cls = F.when(n.isin(1, 2), "outlet").when(n == 3, "isolated").when(n.isin(4, 5, 6), "bubble pump").otherwise("canal")
    return table(spark, sf_dir, "customer").select("c_custkey", cls.alias("cls"))


@query("j01_shared_driver", f"WITH {DRIVERS_SQL} SELECT event_id, round(tide_m, 6) AS tide_m FROM events JOIN tide ON tide.ts = date_trunc('hour', events.ts)")
def j01_shared_driver(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", tp.hour_of(F.col("ts")).alias("ts"))
    return rounded(e.join(tide_hourly(spark, sf_dir), "ts").select("event_id", "tide_m"), "tide_m")


@query("j02_time_and_series", f"WITH {hourly_sql('user_id')} SELECT e.event_id, round(h.v, 6) AS v FROM events e JOIN h ON h.k = e.user_id AND h.ts = date_trunc('hour', e.ts)")
def j02_time_and_series(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"), tp.hour_of(F.col("ts")).alias("ts"))
    return rounded(e.join(hourly_events(spark, sf_dir, "user_id"), ["k", "ts"]).select("event_id", "v"), "v")


@query("j03_left_on_grid", f"""WITH {hourly_sql('event_type', True)},{DRIVERS_SQL} SELECT g.k, g.ts, round(g.v, 6) AS v, round(tide_m, 6) AS tide_m FROM g LEFT JOIN tide USING (ts)""")
def j03_left_on_grid(spark, sf_dir):
    from hydroseries.plans.registry import grid_events

    g = grid_events(spark, sf_dir).select("k", "ts", "v").join(tide_hourly(spark, sf_dir), "ts", "left")
    return rounded(g, "v", "tide_m")


@query("j20_at_first_exceedance", """WITH f AS (SELECT user_id, min(ts) AS t FROM events WHERE value >= 100 GROUP BY 1)
    SELECT e.event_id, e.user_id FROM events e JOIN f ON f.user_id = e.user_id AND f.t = e.ts""")
def j20_at_first_exceedance(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = e.where(F.col("value") >= 100).groupBy("user_id").agg(F.min("ts").alias("ts"))
    return e.join(first, ["user_id", "ts"]).select("event_id", "user_id")


@query("o01_sorted", "SELECT user_id, ts, event_id FROM events ORDER BY user_id, ts")
def o01_o05_sorted(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id").orderBy("user_id", "ts")


@query("u01_union_by_name", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def u01_union_by_name(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")))


@query("u04_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def u04_distinct(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_type").distinct()


@query("f01_parse_times", """SELECT o_orderkey, o_orderdate + to_hours(o_orderkey % 24) AS ts, o_orderdate::DATE AS day, NULL::TIMESTAMP AS bad FROM orders""")
def f01_parse_times(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd "), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(".00.00"))
    return o.select(
        "o_orderkey", tp.parse_gauge_time(stamp).alias("ts"), tp.parse_day(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("day"),
        tp.parse_gauge_time(F.lit("2024-13-01 00.00.00")).alias("bad"),
    )


@query("f02_zones", "SELECT event_id, ts - INTERVAL 7 HOUR AS utc, ts + INTERVAL 7 HOUR AS local FROM events")
def f02_zones(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", tp.local_to_utc(ts, "Asia/Jakarta").alias("utc"), tp.utc_to_local(ts, "Asia/Jakarta").alias("local")
    )


@query("f03_calendar_parts", """SELECT l_orderkey, l_linenumber, year(l_shipdate)::INTEGER AS y, date_trunc('month', l_shipdate)::TIMESTAMP AS month,
    day(last_day(l_shipdate::DATE))::INTEGER AS days, concat(year(l_shipdate), lpad((quarter(l_shipdate) * 3)::VARCHAR, 2, '0')) AS quarter FROM lineitem""")
def f03_calendar_parts(spark, sf_dir):
    d = F.col("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.year(d).alias("y"), tp.month_of(d).alias("month"), tp.days_in_month(d).alias("days"), tp.quarter_code(d).alias("quarter")
    )


@query("f04_date_chunks", """WITH s AS (SELECT o_custkey, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders GROUP BY 1),
    c AS (SELECT o_custkey, b, unnest(generate_series(a, b, INTERVAL 90 DAY))::DATE AS start FROM s) SELECT o_custkey, start, least(start + 89, b)::DATE AS "end" FROM c""")
def f04_date_chunks(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    return s.select("o_custkey", F.inline(tp.date_chunks(F.col("a"), F.col("b"), 90)))


@query("f05_time_arithmetic", """SELECT l_orderkey, l_linenumber, round(date_diff('hour', o_orderdate, l_shipdate)::DOUBLE, 6) AS hours, o_orderdate + (l_shipdate - o_orderdate) / 2 AS mid
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def f05_time_arithmetic(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    a, b = F.col("o_orderdate"), F.col("l_shipdate")
    return l.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "l_orderkey", "l_linenumber", F.round(tp.hours_between(b, a), 6).alias("hours"), tp.midpoint(a, b).alias("mid")
    )


@query("f06_same_day_in_year", """SELECT o_orderkey, make_date(2023, month(o_orderdate), CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN 28 ELSE day(o_orderdate) END) AS day FROM orders""")
def f06_same_day_in_year(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", tp.same_day_in_year(F.col("o_orderdate"), F.lit(2023)).alias("day"))


@query("f10_lengths", "SELECT event_id, round(sqrt(value * value + user_id * user_id), 6) AS len FROM events")
def f10_lengths(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(geo.length(F.col("value"), F.col("user_id")), 6).alias("len"))


@query("f13_numeric", """SELECT c_custkey, abs(c_acctbal) AS a, greatest(c_acctbal, 0)::DOUBLE AS clipped, round(c_acctbal / 3, 4) AS r, floor(c_acctbal)::BIGINT AS f FROM customer""")
def f13_numeric(spark, sf_dir):
    c = F.col("c_acctbal")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.abs(c).alias("a"), F.greatest(c, F.lit(0.0)).alias("clipped"), F.round(c / 3, 4).alias("r"), F.floor(c).alias("f")
    )


@query("f14_range_flags", f"WITH {hourly_sql('user_id', True)} SELECT k, ts, coalesce(v - 10 < 0 OR v - 10 > 300, false)::INTEGER AS rain_flag, coalesce(abs(v / 30) > 2, false)::INTEGER AS tide_flag FROM g")
def f14_range_flags(spark, sf_dir):
    from hydroseries.plans.registry import grid_events

    v = F.col("v")
    return grid_events(spark, sf_dir, "user_id").select("k", "ts", cl.rain_flag(v - 10).alias("rain_flag"), cl.tide_flag(v / 30).alias("tide_flag"))


NAME_SQL = "lower('Rumah Pompa ' || p_name || ' ' || p_size || ' (Laut)')"
for _w in text.NAME_REMARKS + text.NAME_WORDS:
    NAME_SQL = f"replace({NAME_SQL}, '{_w}', '')"
NAME_SQL = f"regexp_replace(regexp_replace({NAME_SQL}, '[0-9]+', '', 'g'), '[^a-z\\s]', ' ', 'g')"


@query("f15_clean_name", f"SELECT p_partkey, trim(regexp_replace({NAME_SQL}, '\\s+', ' ', 'g')) AS name FROM part")
def f15_clean_name(spark, sf_dir):
    full = F.concat(F.lit("Rumah Pompa "), "p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" (Laut)"))
    return table(spark, sf_dir, "part").select("p_partkey", text.clean_name(full).alias("name"))


@query("f16_edit_similarity", "SELECT p_partkey, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))::DOUBLE, 6) AS score FROM part")
def f16_edit_similarity(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.edit_similarity(F.col("p_name"), F.col("p_type")), 6).alias("score"))


@query("f16_sequence_ratio")
def f16_sequence_ratio(spark, sf_dir):
    """Standard-library ratio on Arrow batches; it has no SQL counterpart."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(text.sequence_ratio(F.col("p_name"), F.col("p_type")), 6).alias("score"))


@query("f17_split_and_join", """SELECT p_partkey, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS second, concat_ws('/', p_brand, p_type) AS joined, contains(lower(p_type), 'eco') AS eco FROM part""")
def f17_split_and_join(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.split_part(n, F.lit(" "), F.lit(1)).alias("first"), F.split_part(n, F.lit(" "), F.lit(2)).alias("second"),
        F.concat_ws("/", "p_brand", "p_type").alias("joined"), (F.instr(F.lower("p_type"), "eco") > 0).alias("eco"),
    )


@query("f19_nested_get", "SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, NULL::VARCHAR AS absent FROM events")
def f19_nested_get(spark, sf_dir):
    p = F.from_json("props", "k int, tags struct<city:string>")
    return table(spark, sf_dir, "events").select("event_id", p["k"].alias("k"), p["tags"]["city"].alias("absent"))


@query("f20_arrays", """SELECT vec_id, list_slice(embedding, 1, 3)[2]::DOUBLE AS second, len(embedding) <> list_count(embedding) AS any_null,
    round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""")
def f20_arrays(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.slice(e, 1, 3)[1].cast("double").alias("second"), F.exists(e, lambda x: x.isNull()).alias("any_null"),
        F.round(F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"),
    )


@query("f22_coercion", "SELECT event_id, try_cast(CASE WHEN value < 20 THEN 'n/a' ELSE value::VARCHAR END AS DOUBLE) AS v FROM events")
def f22_coercion(spark, sf_dir):
    v = F.when(F.col("value") < 20, "n/a").otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", cl.to_number(v).alias("v"))


@query("f23_classify", """SELECT event_id, CASE WHEN (value >= 40) = (abs(user_id - 30) <= 6) THEN 'compound' WHEN value >= 40 THEN 'pluvial' ELSE 'tidal' END AS kind FROM events""")
def f23_classify(spark, sf_dir):
    from hydroseries.operators.response import classify

    kind = classify(F.col("value"), F.col("user_id") - 30, rain_mm=40.0)
    return table(spark, sf_dir, "events").select("event_id", kind.alias("kind"))


@query("f24_distance_verdict", "SELECT event_id, CASE WHEN abs(value - 18) < 5 THEN 'near' ELSE 'far' END AS verdict FROM events")
def f24_distance_verdict(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.when(F.abs(F.col("value") - 18) < 5, "near").otherwise("far").alias("verdict"))


