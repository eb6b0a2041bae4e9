"""Cell tables: terrain, flood masks, scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydroseries.functions import geo
from hydroseries.functions import timeparts as tp
from hydroseries.operators import cells as cs
from hydroseries.operators import scenes as sc
from hydroseries.operators.spatial import points_in_polygons
from hydroseries.operators.tide import tide_synthesis
from hydroseries.plans.registry import EVENTS_SQL, event_windows, query, rounded, table
from hydroseries.plans.space import SHAPES

# The parts are a raster of 40 columns: a slope to the east and south with rough ground.
GRID = """
z AS (SELECT (p_partkey // 40)::INTEGER AS row, (p_partkey % 40)::INTEGER AS col,
             (p_partkey // 40 % 25) * 0.5::DOUBLE + p_partkey % 40 * 0.25::DOUBLE + p_size * 0.125::DOUBLE AS value FROM part)"""
RADAR = """
db AS (SELECT (p_partkey // 40)::INTEGER AS row, (p_partkey % 40)::INTEGER AS col,
              CASE WHEN p_size = 50 THEN NULL ELSE -25.0::DOUBLE + p_size * 0.25::DOUBLE + CASE WHEN p_partkey % 40 < 15 THEN 0 ELSE 8 END END AS value FROM part),
ref AS (SELECT (p_partkey // 40)::INTEGER AS row, (p_partkey % 40)::INTEGER AS col, -20.0::DOUBLE + p_size * 0.125::DOUBLE AS value FROM part)"""


def _rc():
    return [F.expr("cast(p_partkey div 40 as int)").alias("row"), (F.col("p_partkey") % 40).cast("int").alias("col")]


def terrain(spark, sf_dir):
    v = F.expr("p_partkey div 40 % 25") * 0.5 + F.col("p_partkey") % 40 * 0.25 + F.col("p_size") * 0.125
    return table(spark, sf_dir, "part").select(*_rc(), v.alias("value"))


def radar(spark, sf_dir):
    west = F.when(F.col("p_partkey") % 40 < 15, 0).otherwise(8)
    v = F.when(F.col("p_size") != 50, F.lit(-25.0) + F.col("p_size") * 0.25 + west)
    return table(spark, sf_dir, "part").select(*_rc(), v.alias("value"))


def reference(spark, sf_dir):
    return table(spark, sf_dir, "part").select(*_rc(), (F.lit(-20.0) + F.col("p_size") * 0.125).alias("value"))


@query("r01_coarsen", f"WITH {GRID} SELECT (row // 3)::INTEGER AS row, (col // 3)::INTEGER AS col, round(avg(value), 6) AS value FROM z GROUP BY 1, 2")
def r01_coarsen(spark, sf_dir):
    return rounded(cs.coarsen(terrain(spark, sf_dir), 3), "value")


SLOPE = f"""{GRID}, m AS (SELECT max(row) AS rm, max(col) AS cm FROM z),
    o AS (SELECT unnest([-1, 0, 1]) AS dr), o2 AS (SELECT unnest([-1, 0, 1]) AS dc),
    t AS (SELECT z.row, z.col, z.value, dr, dc, rm, cm, z.row + dr AS r2, z.col + dc AS c2 FROM z, o, o2, m),
    w AS (SELECT t.row, t.col, t.value, dr, dc,
        CASE WHEN r2 < 0 OR r2 > rm THEN 2 * a.value - b.value
             WHEN (c2 < 0 OR c2 > cm) AND t.row IN (0, rm) THEN a.value
             WHEN c2 < 0 OR c2 > cm THEN 2 * d.value - e.value ELSE a.value END AS v
      FROM t LEFT JOIN z a ON a.row = CASE WHEN r2 < 0 OR r2 > rm THEN t.row ELSE r2 END AND a.col = CASE WHEN c2 < 0 OR c2 > cm THEN t.col ELSE c2 END
             LEFT JOIN z b ON b.row = t.row - dr AND b.col = CASE WHEN c2 < 0 OR c2 > cm THEN t.col ELSE c2 END
             LEFT JOIN z d ON d.row = r2 AND d.col = t.col LEFT JOIN z e ON e.row = r2 AND e.col = t.col - dc),
    g AS (SELECT row, col, sum(dc * CASE WHEN dr = 0 THEN 2 ELSE 1 END * v) AS dx, sum(dr * CASE WHEN dc = 0 THEN 2 ELSE 1 END * v) AS dy FROM w GROUP BY 1, 2),
    h AS (SELECT *, degrees(atan2(dy, -dx)) AS a FROM g),
    k AS (SELECT *, CASE WHEN a > 90 THEN 450 - a ELSE 90 - a END AS az FROM h),
    sl AS (SELECT row, col, round(degrees(atan(sqrt(dx * dx + dy * dy) / 80)), 6) AS slope_deg,
           round(CASE WHEN dx = 0 AND dy = 0 THEN NULL WHEN az >= 360 THEN az - 360 ELSE az END, 6) AS aspect FROM k)"""


@query("r02_slope_aspect", f"WITH {SLOPE} SELECT * FROM sl")
def r02_slope_aspect(spark, sf_dir):
    return rounded(cs.slope_aspect(terrain(spark, sf_dir), 10.0, tile=16), "slope_deg", "aspect")


FLOW = f"""{GRID}, nb(dr, dc, code, ord) AS (VALUES (-1, 0, 64, 0), (-1, 1, 128, 1), (0, 1, 1, 2), (1, 1, 2, 3), (1, 0, 4, 4), (1, -1, 8, 5), (0, -1, 16, 6), (-1, -1, 32, 7)),
    d AS (SELECT a.row, a.col, code, ord, (a.value - b.value) / (10 * sqrt(dr * dr + dc * dc)) AS drop_ FROM z a CROSS JOIN nb JOIN z b ON b.row = a.row + dr AND b.col = a.col + dc),
    f AS (SELECT row, col, arg_min(code, ROW(-round(drop_, 9), ord)) AS direction FROM d WHERE drop_ > 0 GROUP BY 1, 2),
    fl AS (SELECT z.row, z.col, coalesce(direction, 0)::INTEGER AS direction, (z.row + dr)::INTEGER AS to_row, (z.col + dc)::INTEGER AS to_col
           FROM z LEFT JOIN f ON f.row = z.row AND f.col = z.col LEFT JOIN nb ON nb.code = f.direction)"""


@query("r03_flow_direction", f"WITH {FLOW} SELECT * FROM fl")
def r03_flow_direction(spark, sf_dir):
    return cs.flow_direction(terrain(spark, sf_dir), 10.0, tile=16)


@query("r04_flow_accumulation", f"""WITH RECURSIVE {FLOW}, up AS (SELECT row AS r0, col AS c0, row, col FROM fl
      UNION ALL SELECT up.r0, up.c0, fl.to_row, fl.to_col FROM up JOIN fl ON fl.row = up.row AND fl.col = up.col WHERE fl.direction <> 0)
    SELECT row, col, count(*) AS accumulation FROM up GROUP BY 1, 2""")
def r04_flow_accumulation(spark, sf_dir):
    return cs.flow_accumulation(cs.flow_direction(terrain(spark, sf_dir), 10.0, tile=16))


# Every level at which water can reach the border from a cell; the lowest is the fill.
FILL = """mx AS (SELECT max(row) AS rm, max(col) AS cm FROM z), st AS (SELECT unnest([-1, 0, 1]) AS d),
    lv AS (SELECT row, col, value AS lvl FROM z, mx WHERE row IN (0, rm) OR col IN (0, cm)
      OR EXISTS (SELECT 1 FROM st a, st b WHERE NOT EXISTS (SELECT 1 FROM z q WHERE q.row = z.row + a.d AND q.col = z.col + b.d))
      UNION SELECT z.row, z.col, greatest(lv.lvl, z.value) FROM lv CROSS JOIN st a CROSS JOIN st b JOIN z ON z.row = lv.row + a.d AND z.col = lv.col + b.d),
    fi AS (SELECT row, col, min(lvl) AS filled FROM lv GROUP BY 1, 2)"""


@query("r05_fill_depressions", f"""WITH RECURSIVE {GRID}, {FILL} SELECT row, col, value, filled, greatest(filled - value, 0)::DOUBLE AS sink_depth
    FROM z JOIN fi USING (row, col)""")
def r05_fill_depressions(spark, sf_dir):
    return cs.fill_depressions(terrain(spark, sf_dir), tile=16)


@query("a25_terrain_stats", f"""WITH RECURSIVE {SLOPE}, {FILL}, a AS (SELECT count(value) AS n_cells, round(quantile_cont(value, 0.01), 6) AS p1,
      round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM z),
    b AS (SELECT round(avg((slope_deg < 0.5)::INTEGER) * 100, 6) AS flat_pct FROM sl),
    c AS (SELECT round(sum(greatest(filled - value, 0)) * 100, 6)::DOUBLE AS sink_volume FROM z JOIN fi USING (row, col)) SELECT * FROM a, b, c""")
def a25_terrain_stats(spark, sf_dir):
    z = terrain(spark, sf_dir)
    out = cs.terrain_stats(z, cs.slope_aspect(z, 10.0, tile=16), cs.fill_depressions(z, tile=16), 10.0)
    return rounded(out, "p1", "p50", "p99", "flat_pct", "sink_volume")


@query("a24_histogram", """WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
    SELECT least(floor((l_extendedprice - lo) / (hi - lo) * 100), 99)::INTEGER AS bin, count(*) AS n,
           round(min(lo), 6) AS low, round(min((hi - lo) / 100), 6) AS width FROM lineitem, e GROUP BY 1""")
def a24_histogram(spark, sf_dir):
    return rounded(cs.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 100), "low", "width")


def _otsu(src: str) -> str:
    return f"""e_{src} AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 256 AS wd FROM {src}),
    h_{src} AS (SELECT least(floor((value - lo) / (hi - lo) * 256), 255)::INTEGER AS bin, count(*) AS n, min(lo) AS lo, min(wd) AS wd
        FROM {src}, e_{src} WHERE value IS NOT NULL GROUP BY 1),
    c_{src} AS (SELECT bin, n, lo + (bin + 0.5) * wd AS ctr FROM h_{src}),
    k_{src} AS (SELECT bin, ctr, sum(n) OVER (ORDER BY bin) AS w0, sum(n * ctr) OVER (ORDER BY bin) AS m0, sum(n) OVER () AS w, sum(n * ctr) OVER () AS m FROM c_{src}),
    b_{src} AS (SELECT bin, ctr, coalesce(w0 * (w - w0) * (m0 / w0 - (m - m0) / nullif(w - w0, 0)) ^ 2, 0) AS q FROM k_{src}),
    o_{src} AS (SELECT arg_min(ctr, ROW(-round(q, 3), bin)) AS otsu FROM b_{src}),
    t_{src} AS (SELECT otsu, CASE WHEN otsu BETWEEN -22 AND -13 THEN otsu ELSE -16 END AS thr, NOT otsu BETWEEN -22 AND -13 AS fb FROM o_{src})"""


def _threshold(df):
    return cs.water_threshold(cs.otsu_threshold(df.withColumn("scene", F.lit("a")), "value", ["scene"]))


@query("r06_otsu_threshold", f"WITH {RADAR}, {_otsu('db')}, {_otsu('ref')} SELECT 'db' AS scene, round(otsu, 6) AS otsu_db, round(thr, 6)::DOUBLE AS threshold_db, fb AS fallback FROM t_db"
       " UNION ALL SELECT 'ref', round(otsu, 6), round(thr, 6)::DOUBLE, fb FROM t_ref")
def r06_r07_otsu_threshold(spark, sf_dir):
    both = radar(spark, sf_dir).withColumn("scene", F.lit("db")).unionByName(reference(spark, sf_dir).withColumn("scene", F.lit("ref")))
    return rounded(cs.water_threshold(cs.otsu_threshold(both, "value", ["scene"])), "otsu_db", "threshold_db")


# Cells without a row count as the median of the raster, as cells without a value do.
SMOOTH = """m AS (SELECT max(row) AS rm, max(col) AS cm FROM db), md AS (SELECT median(value) AS mid FROM db),
    dd AS (SELECT unnest([-2, -1, 0, 1, 2]) AS d),
    nn AS (SELECT db.row, db.col, db.value, CASE WHEN db.row + a.d < 0 THEN -(db.row + a.d) - 1 WHEN db.row + a.d > rm THEN 2 * rm + 1 - (db.row + a.d) ELSE db.row + a.d END AS r2,
        CASE WHEN db.col + b.d < 0 THEN -(db.col + b.d) - 1 WHEN db.col + b.d > cm THEN 2 * cm + 1 - (db.col + b.d) ELSE db.col + b.d END AS c2
        FROM db, dd a, dd b, m),
    sm AS (SELECT nn.row, nn.col, CASE WHEN min(nn.value) IS NOT NULL THEN median(coalesce(o.value, mid)) END AS value
        FROM nn LEFT JOIN db o ON o.row = nn.r2 AND o.col = nn.c2, md GROUP BY 1, 2)"""


@query("r08_despeckle", f"WITH {RADAR}, {SMOOTH} SELECT row, col, round(value, 6) AS value FROM sm")
def r08_despeckle(spark, sf_dir):
    return rounded(cs.despeckle(radar(spark, sf_dir), tile=16), "value")


@query("r08_despeckle_absent", f"""WITH {RADAR.replace('db AS', 'whole AS', 1)}, db AS (SELECT * FROM whole WHERE (row * 7 + col * 3) % 11 > 1), {SMOOTH}
    SELECT row, col, round(value, 6) AS value FROM sm""")
def r08_despeckle_absent(spark, sf_dir):
    """A raster with many absent cells, in patches that cross tile borders."""
    cells = radar(spark, sf_dir).where((F.col("row") * 7 + F.col("col") * 3) % 11 > 1)
    return rounded(cs.despeckle(cells, tile=16), "value")


@query("f12_power_to_db", "SELECT o_orderkey, round(CASE WHEN o_totalprice > 100000 THEN 10 * log10(o_totalprice / 1e6) END, 6) AS db FROM orders")
def f12_power_to_db(spark, sf_dir):
    p = F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice") / 1e6).otherwise(-1.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(geo.power_to_db(p), 6).alias("db"))


# Cell centres in degrees; land is what lies in one of the districts.
LAND_SQL = "land AS (SELECT row, col, place FROM (SELECT row, col, 106.60 + col * 0.012::DOUBLE AS lon, -6.36 + row * 0.0072::DOUBLE AS lat FROM db) JOIN d0 ON lon > x0 AND lon < x1 AND lat > y0 AND lat < y1)"
D0 = "d0(place, x0, y0, x1, y1) AS (VALUES " + ", ".join(f"('{n}', {a}, {b}, {c}, {d})" for n, a, b, c, d in SHAPES) + ")"
FLOOD_SQL = f"""{RADAR}, {GRID}, {D0}, {LAND_SQL}, dl AS (SELECT db.* FROM db JOIN land USING (row, col)), {_otsu('dl')},
    fm AS (SELECT l.row, l.col, l.place FROM land l JOIN db USING (row, col) JOIN ref r USING (row, col) JOIN z USING (row, col), t_dl
           WHERE db.value < t_dl.thr AND NOT coalesce(r.value < -19, false) AND NOT coalesce(z.value <= 0.3, false))"""


def _flood(spark, sf_dir):
    db = radar(spark, sf_dir)
    polygons = spark.createDataFrame(
        [(n, [(a, b), (c, b), (c, d), (a, d)]) for n, a, b, c, d in SHAPES], "place string, ring array<struct<x:double,y:double>>"
    )
    centre = db.select("row", "col", (F.lit(106.60) + F.col("col") * 0.012).alias("lon"), (F.lit(-6.36) + F.col("row") * 0.0072).alias("lat"))
    land = points_in_polygons(centre, polygons, "place").where(F.col("place").isNotNull()).select("row", "col", "place")
    thr = _threshold(db.join(land, ["row", "col"])).select("threshold_db").scalar()
    event = db.withColumn("value", F.col("value") - thr)
    mask = cs.flood_mask(event, reference(spark, sf_dir), land, terrain(spark, sf_dir), F.lit(0.0), F.lit(-19.0))
    return mask, land, polygons


@query("r09_land_mask", f"WITH {RADAR}, {D0}, {LAND_SQL} SELECT row, col, place FROM land")
def r09_land_mask(spark, sf_dir):
    return _flood(spark, sf_dir)[1]


@query("r10_flood_mask", f"WITH {FLOOD_SQL} SELECT row, col FROM fm")
def r10_u05_flood_mask(spark, sf_dir):
    return _flood(spark, sf_dir)[0]


@query("r10_flood_summary", f"""WITH {FLOOD_SQL}, n AS (SELECT count(*) AS f FROM fm), l AS (SELECT count(*) AS l FROM land)
    SELECT round(f * 0.0001::DOUBLE, 6) AS flood_km2, round(f * 100.0::DOUBLE / l, 6) AS flood_pct,
           coalesce(f * 100.0::DOUBLE / l > 30 OR f * 0.0001::DOUBLE < 0.05, false) AS implausible FROM n, l""")
def r10_flood_summary(spark, sf_dir):
    mask, land, _ = _flood(spark, sf_dir)
    return rounded(cs.flood_summary(mask, land, 0.0001), "flood_km2", "flood_pct")


@query("r11_drop_small_blobs", f"""WITH RECURSIVE {FLOOD_SQL}, nx(dr, dc) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)),
    rc AS (SELECT row, col, row::BIGINT * 4294967296 + col AS lab FROM fm
           UNION SELECT fm.row, fm.col, rc.lab FROM rc CROSS JOIN nx JOIN fm ON fm.row = rc.row + dr AND fm.col = rc.col + dc),
    bl AS (SELECT row, col, min(lab) AS blob FROM rc GROUP BY 1, 2), n AS (SELECT blob FROM bl GROUP BY 1 HAVING count(*) >= 4)
    SELECT row, col, blob FROM bl JOIN n USING (blob)""")
def r11_drop_small_blobs(spark, sf_dir):
    return cs.drop_small_blobs(_flood(spark, sf_dir)[0], min_cells=4)


@query("r12_district_floods", f"""WITH {FLOOD_SQL}, a AS (SELECT place, count(*) * 0.01::DOUBLE AS ha FROM fm GROUP BY 1),
    o AS (SELECT upper(CASE o_orderstatus WHEN 'F' THEN 'north' ELSE 'east' END) AS up, sum(try_cast(CASE WHEN o_custkey % 10 = 0 THEN '-' ELSE (o_custkey % 10)::VARCHAR END AS INTEGER))::BIGINT AS n FROM orders GROUP BY 1)
    SELECT d0.place, round(coalesce(ha, 0), 3)::DOUBLE AS flood_ha, n AS official_n FROM d0 LEFT JOIN a USING (place) LEFT JOIN o ON up = upper(d0.place)""")
def r12_district_floods(spark, sf_dir):
    mask, land, polygons = _flood(spark, sf_dir)
    k = F.col("o_custkey") % 10
    place = F.upper(F.when(F.col("o_orderstatus") == "F", "north").otherwise("east"))
    text = F.when(k == 0, "-").otherwise(k.cast("string"))
    o = table(spark, sf_dir, "orders").groupBy(place.alias("place")).agg(F.sum(text.try_cast("int")).alias("n"))
    return cs.district_floods(mask.join(land, ["row", "col"]), polygons, o, 0.01)


@query("r15_datum_check", f"""WITH {GRID}, y AS (SELECT row, col, value * 0.5 - 15 AS value FROM z)
    SELECT round(median(z.value - y.value), 6) AS median_diff, CASE WHEN abs(median(z.value - y.value) - 18) < 5 THEN 'ellipsoidal' ELSE 'orthometric' END AS verdict FROM z JOIN y USING (row, col)""")
def r15_j19_datum_check(spark, sf_dir):
    z = terrain(spark, sf_dir)
    return rounded(cs.datum_check(z, z.withColumn("value", F.col("value") * 0.5 - 15)), "median_diff")


@query("a26_reference_stack", """SELECT (l_partkey // 40)::INTEGER AS row, (l_partkey % 40)::INTEGER AS col, round(median(CASE WHEN l_discount > 0.01 THEN l_quantity END), 6) AS value FROM lineitem GROUP BY 1, 2""")
def a26_reference_stack(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(
        F.expr("cast(l_partkey div 40 as int)").alias("row"), (F.col("l_partkey") % 40).cast("int").alias("col"),
        F.when(F.col("l_discount") > 0.01, F.col("l_quantity")).alias("value"),
    )
    return rounded(cs.reference_stack(l), "value")


PEAK_SQL = f"{EVENTS_SQL}, pk AS (SELECT event, s + (e + INTERVAL 23 HOUR - s) / 2 AS peak FROM ev)"


def peaks(spark):
    end = tp.shift_hours(F.col("end"), 23)
    return event_windows(spark).select("event", tp.midpoint(F.col("start"), end).alias("peak"))


# Scenes: the purchases of the event table.
def scene_table(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("scene_id"), F.col("ts").alias("acquired"), F.when(F.col("value") > 30, "asc").otherwise("desc").alias("orbit")
    )


SCENES_SQL = f"""WITH {PEAK_SQL}, h AS (SELECT event, event_id AS scene_id, ts AS acquired, CASE WHEN value > 30 THEN 'asc' ELSE 'desc' END AS orbit,
      abs(date_diff('microsecond', peak, ts)) / 3600e6 AS gap, NOT ts::DATE BETWEEN (peak - INTERVAL 4 DAY)::DATE AND (peak + INTERVAL 5 DAY)::DATE AS wide
      FROM events JOIN pk ON ts::DATE BETWEEN (peak - INTERVAL 6 DAY)::DATE AND (peak + INTERVAL 7 DAY)::DATE WHERE event_type = 'purchase'),
    b AS (SELECT *, min(wide::INTEGER) OVER (PARTITION BY event) AS w FROM h)
    SELECT event, scene_id, acquired, orbit, wide, round(gap, 6) AS gap_hours, row_number() OVER (PARTITION BY event ORDER BY gap, scene_id)::INTEGER AS rank FROM b WHERE wide::INTEGER = w"""


@query("r13_event_scenes", SCENES_SQL)
def r13_w13_event_scenes(spark, sf_dir):
    return rounded(sc.event_scenes(scene_table(spark, sf_dir), peaks(spark)), "gap_hours")


@query("r13_closest_scenes", f"SELECT * FROM ({SCENES_SQL}) WHERE rank <= 3")
def r13_closest_scenes(spark, sf_dir):
    """The chosen scene of each event and two alternatives."""
    return rounded(sc.event_scenes(scene_table(spark, sf_dir), peaks(spark), keep=3), "gap_hours")


RAIN_H = "rn AS (SELECT date_trunc('hour', ts) AS ts, round(avg(value), 9) AS rain_mm FROM events WHERE event_type = 'view' GROUP BY 1)"


def _rain(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "view")
    return e.groupBy(tp.hour_of(F.col("ts")).alias("ts")).agg(F.round(F.avg("value"), 9).alias("rain_mm"))


@query("r14_prior_rain", f"""WITH {RAIN_H} SELECT event_id AS scene_id, round(sum(rain_mm), 6) AS prior_mm FROM events e JOIN rn ON rn.ts BETWEEN e.ts - INTERVAL 72 HOUR AND e.ts
    WHERE event_type = 'purchase' GROUP BY 1""")
def r14_prior_rain(spark, sf_dir):
    return rounded(sc.prior_rain(scene_table(spark, sf_dir), _rain(spark, sf_dir)), "prior_mm")


@query("r14_reference_scenes", f"""WITH {PEAK_SQL}, {RAIN_H}, pr AS (SELECT event_id, e.ts, sum(rain_mm) AS mm FROM events e JOIN rn ON rn.ts BETWEEN e.ts - INTERVAL 72 HOUR AND e.ts
      WHERE event_type = 'purchase' GROUP BY 1, 2),
    c AS (SELECT event, event_id AS scene_id, ts AS acquired, mm FROM pr JOIN pk ON abs(date_diff('microsecond', peak, ts)) > 3 * 86400e6
          AND ts::DATE BETWEEN peak::DATE - 20 AND peak::DATE + 21),
    r AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY mm, acquired DESC, scene_id)::INTEGER AS rank, count(*) FILTER (mm < 1) OVER (PARTITION BY event) >= 3 AS strict FROM c)
    SELECT event, scene_id, acquired, round(mm, 6) AS prior_mm, rank, strict FROM r WHERE rank <= 5 AND (NOT strict OR mm < 1)""")
def r14_o04_reference_scenes(spark, sf_dir):
    out = sc.reference_scenes(scene_table(spark, sf_dir), peaks(spark), _rain(spark, sf_dir))
    return rounded(out, "prior_mm")


WAVES_SQL = "wv AS (SELECT s_suppkey, n_nationkey AS nm, 0.1::DOUBLE + n_nationkey * 0.01::DOUBLE AS amp, 13.0::DOUBLE + n_nationkey * 0.75::DOUBLE AS spd, (s_suppkey * 7 + n_nationkey * 11) % 360 AS ph FROM supplier JOIN nation ON s_nationkey % 5 = n_regionkey)"


@query("q20_tide_synthesis", f"""WITH {WAVES_SQL}, hr AS (SELECT DISTINCT user_id % (SELECT count(*) FROM supplier) AS s_suppkey, date_trunc('hour', ts) AS ts FROM events)
    SELECT hr.s_suppkey, hr.ts, round(sum(amp * cos(radians(spd * date_diff('hour', TIMESTAMP '1992-01-01', hr.ts) - ph))), 6) AS tide_m
    FROM hr JOIN wv USING (s_suppkey) GROUP BY 1, 2""")
def q20_tide_synthesis(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    waves = s.join(n, F.col("s_nationkey") % 5 == F.col("n_regionkey")).select(
        "s_suppkey", k.cast("string").alias("name"), (F.lit(0.1) + k * 0.01).alias("amplitude"), (F.lit(13.0) + k * 0.75).alias("speed"),
        ((F.col("s_suppkey") * 7 + k * 11) % 360).cast("double").alias("phase"),
    )
    e = table(spark, sf_dir, "events").select("user_id", tp.hour_of(F.col("ts")).alias("ts"))
    e = e.withColumn("_n", s.agg(F.count("*")).scalar())
    hours = e.select((F.col("user_id") % F.col("_n")).alias("s_suppkey"), "ts").distinct()
    return rounded(tide_synthesis(hours, waves, "s_suppkey", "ts"), "tide_m")


