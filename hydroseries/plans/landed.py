"""Landed files: the tables are written in the raw formats to the shared folder and read back."""

from __future__ import annotations

import gzip
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hydroseries.functions import timeparts as tp
from hydroseries.plans import series  # noqa: F401  (its SQL is used below)
from hydroseries.plans.registry import SQL, ntz, query, rounded, table
from hydroseries.session import shared_folder
from hydroseries.sources import documents, files, gauge_text, ingest, rain_grid


def folder(spark) -> str:
    """A new folder next to the checkpoints."""
    return f"{shared_folder(spark).rstrip('/')}/landed-{uuid.uuid4().hex}"


# Raw texts of at most 500 consecutive events each, so that no text grows with the table.
RAW_SQL = """
pt AS (SELECT event_type AS k, event_id // 500 AS chunk, date_trunc('second', ts) AS ts, value, event_id FROM events)"""


def raw_texts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    point = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd HH.mm.ss"), F.col("value").cast("string"))
    e = e.select(F.col("event_type").alias("k"), F.expr("event_id div 500").alias("chunk"), F.struct("event_id", point.alias("p")).alias("x"))
    g = e.groupBy("k", "chunk").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    limits = (
        F.when(F.col("chunk") % 4 == 0, F.concat_ws(";", F.col("chunk") * 10 + 950, F.lit("850"), F.lit("750.5")))
        .when(F.col("chunk") % 4 == 1, "900;800")
        .when(F.col("chunk") % 4 == 2, "900;x;700")
        .otherwise("")
    )
    body = F.concat(F.array_join(F.transform("xs", lambda x: x["p"]), ";"), F.lit(";"))
    return g.select("k", "chunk", F.concat(body, F.lit("|"), limits, F.lit("|\n\n<html></html>")).alias("raw"))


@query("s01_gauge_text_points", f"WITH {RAW_SQL} SELECT k, ts, value FROM pt")
def s01_gauge_text_points(spark, sf_dir):
    return gauge_text.parse_gauge_text(raw_texts(spark, sf_dir), ["k"]).points


LIMITS = {1: "CASE WHEN chunk % 4 = 0 THEN (chunk * 10 + 950) / 10.0::DOUBLE END", 2: "CASE WHEN chunk % 4 = 0 THEN 85.0::DOUBLE END",
          3: "CASE WHEN chunk % 4 = 0 THEN 75.05::DOUBLE END"}
LIMIT_SQL = ", ".join(f"{x} AS limit{i}" for i, x in LIMITS.items())


@query("s02_gauge_text_limits", f"WITH {RAW_SQL}, c AS (SELECT DISTINCT k, chunk FROM pt) SELECT k, chunk, {LIMIT_SQL} FROM c")
def s02_gauge_text_limits(spark, sf_dir):
    return gauge_text.parse_gauge_text(raw_texts(spark, sf_dir), ["k", "chunk"]).limits


@query("s01_gauge_text_rejects", """SELECT user_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H.%M.%S') || ',x' AS piece, 'bad point' AS reason FROM events WHERE value > 100
    UNION ALL SELECT user_id, 'gone ' || event_id, 'no bar' FROM events WHERE value <= 1""")
def s01_gauge_text_rejects(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    point = F.concat(F.date_format("ts", "yyyy-MM-dd HH.mm.ss"), F.lit(","), F.when(F.col("value") > 100, "x").otherwise(F.col("value").cast("string")))
    raw = F.when(F.col("value") <= 1, F.concat(F.lit("gone "), F.col("event_id").cast("string"))).otherwise(F.concat(point, F.lit(";|1;2;3|tail")))
    return gauge_text.parse_gauge_text(e.select("user_id", raw.alias("raw")), ["user_id"]).rejects


@query("a28_first_limits", f"""WITH {RAW_SQL}, c AS (SELECT DISTINCT k, chunk FROM pt), m AS (SELECT k, min(chunk) AS chunk FROM c WHERE chunk % 4 = 0 GROUP BY 1),
    f AS (SELECT m.k, {LIMIT_SQL} FROM m), st AS (SELECT DISTINCT k, CASE WHEN k IN ('view', 'click') THEN 1.0::DOUBLE END AS limit1, 2.0::DOUBLE AS limit2,
      CASE WHEN k <> 'click' THEN NULL ELSE 3.0::DOUBLE END AS limit3 FROM pt)
    SELECT st.k, CASE WHEN st.k = 'click' THEN st.limit1 ELSE f.limit1 END AS limit1, CASE WHEN st.k = 'click' THEN st.limit2 ELSE f.limit2 END AS limit2,
           CASE WHEN st.k = 'click' THEN st.limit3 ELSE f.limit3 END AS limit3 FROM st JOIN f USING (k)""")
def a28_first_limits(spark, sf_dir):
    limits = gauge_text.parse_gauge_text(raw_texts(spark, sf_dir), ["k", "chunk"]).limits
    k = F.col("k")
    st = table(spark, sf_dir, "events").select(F.col("event_type").alias("k")).distinct().select(
        k, F.when(k.isin("view", "click"), 1.0).alias("limit1"), F.lit(2.0).alias("limit2"), F.when(k == "click", 3.0).alias("limit3")
    )
    return gauge_text.fill_limits(st, gauge_text.first_limits(limits, "k", "chunk"), "k")


@query("s03_read_by_file_key", """SELECT o_orderkey, o_totalprice, CASE o_orderstatus WHEN 'F' THEN 140 WHEN 'O' THEN 162 END::INTEGER AS series_id FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def s03_f18_read_by_file_key(spark, sf_dir):
    """One folder of files named by station number, of which two stations are wanted."""
    out = folder(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    for status, number in (("F", 140), ("O", 162), ("P", 150)):
        o.where(F.col("o_orderstatus") == status).drop("o_orderstatus").write.parquet(f"{out}/{number}_2024_hourly")
    found = F.regexp_extract(F.col("_metadata.file_path"), r"/(\d+)_2024_hourly/", 1).try_cast("int")
    df = files.read_series(spark, f"{out}/*_hourly")
    return df.withColumn("series_id", found).where(F.col("series_id").isin(140, 162))


@query("s04_pruned_columns", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 49")
def s04_p05_pruned_columns(spark, sf_dir):
    return files.read_series(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"]).where(F.col("l_quantity") >= 49)


VIEWS = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark",
    "labels", "conversations",
)


@query("q22_register_views", " UNION ALL ".join(f"SELECT '{v}' AS name, count(*) AS n FROM {v}" for v in VIEWS))
def q22_s05_s17_register_views(spark, sf_dir):
    skipped = files.register_views(spark, {**{f"v_{v}": f"{sf_dir}/{v}.parquet" for v in VIEWS}, "v_absent": f"{sf_dir}/absent-*.parquet"})
    assert skipped == ["v_absent"], skipped
    return files.view_sizes(spark, [f"v_{v}" for v in VIEWS]).withColumn("name", F.substring("name", 3, 100))


@query("s06_csv_scan", "SELECT o_orderkey, o_orderdate::DATE AS day, o_totalprice, o_orderpriority FROM orders")
def s06_csv_scan(spark, sf_dir):
    out = folder(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_totalprice", "o_orderpriority")
    files.write_metrics(o, out, "csv")
    return spark.read.schema("o_orderkey bigint, day date, o_totalprice double, o_orderpriority string").option("header", True).csv(out)


@query("s07_flatten_stations", """SELECT s_suppkey::INTEGER AS station_id, s_name AS name, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS lat,
    CASE WHEN s_acctbal > 0 THEN s_nationkey::DOUBLE END AS lon, CASE WHEN s_acctbal > 0 THEN 'survey' END AS coordinate_source,
    s_nationkey * 10.0::DOUBLE AS limit1, CASE WHEN s_nationkey > 3 THEN 7.5::DOUBLE END AS limit2, NULL::DOUBLE AS limit3 FROM supplier""")
def s07_f19_flatten_stations(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    n = F.col("s_nationkey")
    nested = s.select(
        F.col("s_suppkey").cast("int").alias("id"), F.col("s_name").alias("nama"),
        F.when(F.col("s_acctbal") > 0, F.struct(F.col("s_acctbal").alias("lat"), n.cast("double").alias("lon"), F.lit("survey").alias("sumber"))).alias("koordinat"),
        F.struct((n * 10.0).alias("siaga1"), F.when(n > 3, 7.5).alias("siaga2"), F.lit(None).cast("double").alias("siaga3")).alias("ambang_siaga_cm"),
    )
    return documents.flatten_stations(nested)


@query("s08_json_pages", "SELECT o_orderkey::VARCHAR AS id, o_orderstatus AS status, CASE WHEN o_orderstatus = 'F' THEN o_custkey::VARCHAR END AS extra FROM orders")
def s08_p03_json_pages(spark, sf_dir):
    """Pages of 100 records, some with a column the others lack, and a helper column to drop."""
    out = folder(spark)
    o = table(spark, sf_dir, "orders")
    rec = F.struct(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.monotonically_increasing_id().alias("rn"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("extra"),
    )
    pages = o.select(F.expr("o_orderkey div 100").alias("page"), rec.alias("r")).groupBy("page").agg(F.collect_list("r").alias("rows"))
    pages.select(F.struct(F.lit("t").alias("title")).alias("meta"), "rows").write.json(out)
    # One document per line here; a landed file holds one document.
    return documents.read_pages(spark, out, multi_line=False)


@query("s09_crowd_reports", """SELECT event_id::VARCHAR AS pkey, date_trunc('second', ts) AS created_at, event_type AS disaster_type, 'confirmed' AS status, 'app' AS source,
    CASE WHEN value > 50 THEN value END AS flood_depth_cm, props AS text, CASE WHEN user_id % 2 = 0 THEN 'north' END AS city,
    CASE WHEN user_id % 2 = 0 THEN user_id::VARCHAR END AS local_area_id, 106 + user_id / 1000.0::DOUBLE AS lon, -6 - user_id / 1000.0::DOUBLE AS lat FROM events""")
def s09_crowd_reports(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    u = F.col("user_id")
    props = F.struct(
        F.col("event_id").cast("string").alias("pkey"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.col("event_type").alias("disaster_type"), F.lit("confirmed").alias("status"), F.lit("app").alias("source"), F.col("props").alias("text"),
        F.when(F.col("value") > 50, F.struct(F.col("value").alias("flood_depth"))).alias("report_data"),
        F.when(u % 2 == 0, F.struct(F.lit("north").alias("city"), u.cast("string").alias("local_area_id"))).alias("tags"),
    )
    return documents.flatten_reports(e.select(props.alias("properties"), F.array(F.lit(106.0) + u / 1000.0, F.lit(-6.0) - u / 1000.0).alias("coordinates")))


@query("s10_waterway_extract", """WITH w AS (SELECT event_id // 20 AS way, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1)
    SELECT way AS way_id, n, CASE WHEN way % 3 = 0 THEN '' ELSE 'river' END AS waterway FROM w""")
def s10_waterway_extract(spark, sf_dir):
    """Documents of 200 ways each, one per line, written and read as nested JSON."""
    out = folder(spark)
    e = table(spark, sf_dir, "events").select(F.expr("event_id div 20").alias("way"), "event_id", "user_id")
    w = e.groupBy("way").agg(F.array_sort(F.collect_list(F.struct("event_id", "user_id"))).alias("ns"))
    tags = F.when(F.col("way") % 3 != 0, F.create_map(F.lit("waterway"), F.lit("river")))
    e = F.struct(
        F.lit("way").alias("type"), F.col("way").alias("id"), F.transform("ns", lambda x: x["user_id"]).alias("nodes"),
        F.transform("ns", lambda x: F.struct((x["user_id"] / 1e4).alias("lat"), (x["user_id"] / 1e3).alias("lon"))).alias("geometry"), tags.alias("tags"),
    )
    docs = w.select(F.expr("way div 200").alias("d"), e.alias("e")).groupBy("d").agg(F.collect_list("e").alias("elements"))
    docs.select("elements").write.json(out)
    ways = documents.read_ways(spark, out, multi_line=False)
    return ways.select("way_id", F.size("path").cast("long").alias("n"), "waterway")


GRIDS_SQL = """
gp AS (SELECT p_partkey // 200 AS h, p_partkey % 200 // 20 AS r, p_partkey % 20 AS c, p_size - 5 AS v FROM part),
ct AS (SELECT TIMESTAMP '2024-01-01' + to_hours(h::BIGINT) AS ts, round(59.95 - r * 0.1, 6)::DOUBLE AS lat, round(0.05 + c * 0.1, 6)::DOUBLE AS lon,
       CASE WHEN v >= 0 THEN v::DOUBLE END AS mm FROM gp WHERE r BETWEEN 2 AND 6 AND c BETWEEN 3 AND 15)"""
BOX = (59.35, 59.75, 0.35, 1.55)


def _grids(spark, sf_dir):
    """Hourly grids of 10 x 20 cells out of the parts, encoded like the landed files and decoded again."""
    p = table(spark, sf_dir, "part").select(
        F.expr("p_partkey div 200").alias("h"), (F.col("p_partkey") % 200).alias("i"), (F.col("p_size") - 5).cast("double").alias("v")
    )

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros(200, dtype="<f4")
        grid[pdf["i"].to_numpy()] = pdf["v"].to_numpy()
        stamp = pd.Timestamp("2024-01-01") + pd.Timedelta(hours=int(pdf["h"].iloc[0]))
        return pd.DataFrame({"path": [f"rain.{stamp:%Y%m%d.%H%M}.dat.gz"], "content": [gzip.compress(grid.tobytes())]})

    landed = p.groupBy("h").applyInPandas(encode, "path string, content binary")
    return rain_grid.decode_hourly_grids(landed, BOX, shape=(10, 20))


@query("s11_hourly_grids", f"WITH {GRIDS_SQL} SELECT * FROM ct")
def s11_hourly_grids(spark, sf_dir):
    return _grids(spark, sf_dir)


@query("s12_missing_hours", f"""WITH {GRIDS_SQL}, d AS (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS day FROM ct), a AS (SELECT day + to_hours(unnest(range(24))) AS ts FROM d)
    SELECT a.ts FROM a WHERE NOT EXISTS (SELECT 1 FROM ct WHERE ct.ts = a.ts)""")
def s12_missing_hours(spark, sf_dir):
    cells = _grids(spark, sf_dir)
    days = cells.select(ntz(F.date_trunc("day", "ts")).alias("day")).distinct()
    return rain_grid.expected_hours(cells, days)[1]


@query("s16_rain_subset", f"WITH {GRIDS_SQL} SELECT * FROM ct WHERE lat BETWEEN 59.45 AND 59.65 AND lon BETWEEN 0.5 AND 1.0 AND ts BETWEEN TIMESTAMP '2024-01-01 02:00:00' AND TIMESTAMP '2024-01-01 06:00:00'")
def s16_rain_subset(spark, sf_dir):
    return rain_grid.rain_subset(_grids(spark, sf_dir), (59.45, 59.65, 0.5, 1.0), "2024-01-01 02:00:00", "2024-01-01 06:00:00")


@query("s13_write_series", "SELECT user_id::VARCHAR AS series_id, year(ts)::INTEGER AS year, count(*) AS n, round(sum(CASE WHEN user_id % 2 = 0 THEN value * 2 ELSE value END), 4) AS total FROM events GROUP BY 1, 2")
def s13_write_series(spark, sf_dir):
    """Write all series, then replace the partitions of some of them only."""
    out = folder(spark)
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("series_id"), "ts", "value")
    files.write_series(e, out, ["series_id"], "ts", shelves=64)
    files.write_series(e.where(F.col("series_id").cast("long") % 2 == 0).withColumn("value", F.col("value") * 2), out, ["series_id"], "ts", shelves=64)
    back = spark.read.parquet(out)
    return back.groupBy(F.col("series_id").cast("string").alias("series_id"), "year").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("s14_json_sink", "SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1")
def s14_json_sink(spark, sf_dir):
    out = folder(spark)
    files.write_metrics(table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("n")), out, "json")
    return spark.read.schema("k string, n bigint").json(out)


@query("s15_registry", """SELECT x.name, x.layer_kind, count(*) AS n FROM events e JOIN (VALUES ('view', 'raster'), ('click', 'vector'), ('error', 'tabular')) x(name, layer_kind)
    ON x.name = e.event_type WHERE x.layer_kind IN ('raster', 'vector') GROUP BY 1, 2""")
def s15_registry(spark, sf_dir):
    rows = [(n, f"events/{n}", "parquet", k, True, "tables", "") for n, k in (("view", "raster"), ("click", "vector"), ("error", "tabular"))]
    reg = files.registry(spark, rows).where(F.col("layer_kind").isin("raster", "vector"))
    e = table(spark, sf_dir, "events")
    return e.join(reg, e["event_type"] == reg["name"]).groupBy("name", "layer_kind").agg(F.count("*").alias("n"))


@query("u03_upsert", """WITH o AS (SELECT user_id, date_trunc('hour', ts) AS ts, value, 0 AS p, event_id FROM events WHERE event_type IN ('view', 'click')),
    n AS (SELECT user_id, date_trunc('hour', ts) AS ts, value, 1 AS p, event_id FROM events WHERE event_type IN ('click', 'error'))
    SELECT user_id, ts, arg_min(value, ROW(p, event_id)) AS value FROM (SELECT * FROM o UNION ALL SELECT * FROM n) GROUP BY 1, 2""")
def u03_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", tp.hour_of(F.col("ts")).alias("ts"), "value", "event_id", "event_type")
    old = e.where(F.col("event_type").isin("view", "click")).drop("event_type")
    new = e.where(F.col("event_type").isin("click", "error")).drop("event_type")
    return ingest.upsert(old, new, ["user_id", "ts"], "event_id").drop("event_id")


@query("st02_since_last", """WITH l AS (SELECT user_id, max(ts) AS m FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT event_id FROM events LEFT JOIN l USING (user_id) WHERE event_type = 'click' AND (m IS NULL OR ts >= date_trunc('day', m))""")
def st02_since_last(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = ingest.last_times(e.where(F.col("event_type") == "view"), "user_id", "ts")
    return ingest.since_last(e.where(F.col("event_type") == "click"), last, "user_id", "ts").select("event_id")


INGEST_SQL = "WITH \npts AS (SELECT 0 AS event_id, event_type AS k, date_trunc('minute', ts) AS ts, min(floor(value / 10) * 10) AS v FROM events GROUP BY 2, 3)" + SQL[
    "q02_resample_hourly"
].split("FROM events)", 1)[1].replace("AS y, ts, avg(v)", "AS y, date_trunc('hour', ts) AS ts, avg(v)")


@query("q24_ingest", INGEST_SQL.replace("SELECT k, ts, round(mean, 6)", "SELECT k AS series_id, ts, round(mean, 6)"))
def q24_ingest(spark, sf_dir):
    """Two loads, the second overlapping the first; the hourly table after both."""
    out = folder(spark)
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series_id"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"), (F.floor(F.col("value") / 10) * 10).cast("double").alias("value")
    )
    early = e.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    late = e.where(F.col("ts") >= F.lit("2024-01-18").cast("timestamp_ntz"))
    for part in (early, late):
        ingest.ingest(spark, part, f"{out}/points", f"{out}/hourly")
    back = spark.read.parquet(f"{out}/hourly")
    return rounded(back.select(F.col("series_id").cast("string").alias("series_id"), "ts", "mean", "max", "n_obs", "pct_flagged", "qc_flag"), "mean")

