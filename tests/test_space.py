"""Spatial joins, matching, graphs and cells against brute force."""

import difflib
import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydroseries.functions import geo, text
from hydroseries.operators import cells as cs
from hydroseries.operators import graph, match, scenes, spatial


def test_utm_matches_published_values(spark):
    """On the central meridian the easting is exactly 500 km; northing from the meridian arc."""
    x, y = geo.utm_south(F.lit(105.0), F.lit(-6.0))
    row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert row.x == pytest.approx(500000.0, abs=1e-6) and row.y == pytest.approx(10000000 - 0.9996 * 663510.9, abs=50)


def test_nearest_with_cutoff_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    p, n = rng.uniform(0, 5000, (60, 2)), rng.uniform(0, 5000, (150, 2))
    pts = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "id int, x double, y double")
    nodes = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(n)], "node int, x double, y double")
    got = {r.id: r.node for r in spatial.nearest_within(pts, nodes, "id", "node", 300.0).collect()}
    d = np.hypot(p[:, None, 0] - n[None, :, 0], p[:, None, 1] - n[None, :, 1])
    assert got == {i: int(d[i].argmin()) if d[i].min() <= 300 else None for i in range(60)}


def test_point_in_concave_polygon(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    poly = spark.createDataFrame([("u", ring)], "place string, ring array<struct<x:double,y:double>>")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 2.0), (3, 3.5, 2.5), (4, 9.0, 9.0)], "id int, lon double, lat double")
    got = {r.id: r.place for r in spatial.points_in_polygons(pts, poly, "place", cell=0.7).collect()}
    assert got == {1: "u", 2: None, 3: "u", 4: None}


def test_no_known_cell_is_an_error_on_request(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0)], "id int, lon double, lat double")
    cells = spark.createDataFrame([(9.0, 9.0, 1.0), (0.1, 0.1, None)], "lon double, lat double, a double")
    assert spatial.nearest_known_cell(pts, cells, "id", "a", 1.0).first().cell_x is None
    with pytest.raises(Exception, match="no cell with a value"):
        spatial.nearest_known_cell(pts, cells, "id", "a", 1.0, required=True).collect()


def test_names_are_cleaned(spark):
    names = ["P.A. Marina Ancol (Laut)", "Rumah Pompa Pluit 2", "Bendung. Katulampa - 1", "Waduk   Sunter"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(text.clean_name(F.col("n"))).collect()] == ["marina ancol", "rumah pluit", "katulampa", "sunter"]


def test_best_match_equals_the_standard_library(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdeklmnorstu "), rng.integers(2, 14))).strip() or "x"
    a, b = sorted({word() for _ in range(80)}), sorted({word() for _ in range(120)})
    b += [x[:-1] + "z" for x in a[:20] if len(x) > 2] + a[20:25]
    b = sorted(set(b))
    out = match.sequence_matches(spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string"))
    got = {r.a: (r.b, round(r.score, 9)) for r in out.collect()}
    want = {}
    for x in a:
        hit = difflib.get_close_matches(x, b, n=1, cutoff=0.6)
        if hit:
            want[x] = (hit[0], round(difflib.SequenceMatcher(None, x, hit[0]).ratio(), 9))
    assert got == want


def test_station_match_takes_the_best_source_and_shares_aliases(spark):
    st = spark.createDataFrame([(1, "P.A. Kali Asin"), (2, "Kali Asin laut"), (3, "zzz"), (4, "Far Away")], "station_id int, name string")
    cand = spark.createDataFrame(
        [("gates", 1, "Kali Mati", "-6.1", "106.8"), ("pumps", 1, "Kali Asin", "-6.2", "106.9"), ("pumps", 2, "Kali Asin 2", "-6.3", "106.9"),
         ("pumps", 3, "Far Away", "9", "9"), ("gates", 4, "zzz", "n/a", "1")],
        "source string, pos int, name string, lat string, lon string")
    out = match.station_match(st, cand, (-6.35, -5.95, 106.6, 107.05), ["gates", "pumps"], alias={2: 1})
    got = {r.station_id: (r.match, r.lat) for r in out.collect()}
    assert got == {1: ("Kali Asin", -6.2), 2: ("Kali Asin", -6.2), 3: (None, None), 4: (None, None)}


def random_graph(rng, n, m):
    e = {tuple(sorted(map(int, rng.integers(0, n, 2)))) for _ in range(m)}
    return [(a, b, float(rng.integers(1, 100))) for a, b in e if a != b]


def dijkstra(edges, s):
    adj = {}
    for a, b, w in edges:
        adj.setdefault(a, []).append((b, w))
        adj.setdefault(b, []).append((a, w))
    dist, todo = {s: 0.0}, [(0.0, s)]
    while todo:
        d, u = heapq.heappop(todo)
        if d > dist[u]:
            continue
        for v, w in adj.get(u, []):
            if d + w < dist.get(v, 1e18):
                dist[v] = d + w
                heapq.heappush(todo, (d + w, v))
    return dist


def test_components_and_paths_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    # sparse random part, a long chain, a hub
    edges = random_graph(rng, 40, 38) + [(100 + i, 101 + i, 2.0) for i in range(30)] + [(200, 201 + i, 1.0) for i in range(25)]
    df = spark.createDataFrame(edges, "u long, v long, length_m double")
    got = {r.node: r.component for r in graph.connected_components(df).collect()}
    nodes = {x for a, b, _ in edges for x in (a, b)}
    reach = {x: dijkstra(edges, x) for x in nodes}
    assert got == {x: min(reach[x]) for x in nodes}
    stops = sorted(list(nodes))[::9] + [100, 115, 130]
    out = graph.path_lengths(df, spark.createDataFrame([(s,) for s in set(stops)], "node long"))
    have = {(r.node_a, r.node_b): r.length_m for r in out.collect()}
    assert have == {(a, b): reach[a][b] for a in stops for b in stops if a < b and b in reach[a]}


def as_cells(spark, z):
    return spark.createDataFrame(
        [(i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(z)], "row int, col int, value double")


def as_array(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.row, r.col] = np.nan if r[name] is None else r[name]
    return out


def priority_flood(z):
    n, m = z.shape
    w = np.full(z.shape, np.nan)
    todo, seen = [], set()
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    for (i, j), v in np.ndenumerate(z):
        if not np.isnan(v) and any(not (0 <= i + a < n and 0 <= j + b < m) or np.isnan(z[i + a, j + b]) for a, b in steps):
            heapq.heappush(todo, (v, i, j))
            seen.add((i, j))
    while todo:
        v, i, j = heapq.heappop(todo)
        w[i, j] = v
        for a, b in steps:
            x, y = i + a, j + b
            if 0 <= x < n and 0 <= y < m and not np.isnan(z[x, y]) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(todo, (max(v, z[x, y]), x, y))
    return w


def test_fill_equals_priority_flood_over_tiles(spark):
    rng = np.random.default_rng(4)
    z = np.round(rng.uniform(0, 10, (21, 17)), 1)
    z[8:11, 3] = np.nan
    got = as_array(cs.fill_depressions(as_cells(spark, z), tile=6), "filled", z.shape)
    np.testing.assert_array_equal(got, priority_flood(z))


def test_despeckle_equals_mirrored_median(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(0, 1, (14, 11))
    z[4, 4] = np.nan
    full = np.pad(np.where(np.isnan(z), np.nanmedian(z), z), 2, mode="symmetric")
    want = np.median(np.lib.stride_tricks.sliding_window_view(full, (5, 5)), axis=(2, 3))
    want[np.isnan(z)] = np.nan
    got = as_array(cs.despeckle(as_cells(spark, z), tile=5), "value", z.shape)
    np.testing.assert_allclose(got, want)


@pytest.mark.parametrize("seed", range(3))
def test_fill_of_rough_ground_with_holes_and_absent_cells(spark, seed):
    """Water that has to cross many tiles, plateaus, missing and absent cells."""
    rng = np.random.default_rng(seed)
    z = rng.integers(0, 6, (26, 31)).astype(float)
    z[rng.random(z.shape) < 0.02] = np.nan
    z[3:20, 4] = z[3:20, 27] = z[3, 4:28] = z[20, 4:28] = 9.0
    z[20, 11] = 7.0
    cells = as_cells(spark, z).where(~((F.col("row") == 12) & (F.col("col") == 13)))
    z[12, 13] = np.nan
    np.testing.assert_array_equal(as_array(cs.fill_depressions(cells, tile=5), "filled", z.shape), priority_flood(z))


def test_despeckle_with_absent_cells(spark):
    """A cell without a row counts as the median of the raster, as one without a value does."""
    rng = np.random.default_rng(6)
    z = rng.normal(0, 1, (17, 23))
    z[rng.random(z.shape) < 0.05] = np.nan
    gone = np.isnan(z) & (rng.random(z.shape) < 0.6)
    gone[5:12, 5:9] = True
    z[gone] = np.nan
    full = np.pad(np.where(np.isnan(z), np.nanmedian(z), z), 2, mode="symmetric")
    want = np.median(np.lib.stride_tricks.sliding_window_view(full, (5, 5)), axis=(2, 3))
    want[np.isnan(z)] = np.nan
    rows = [(i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(z) if not gone[i, j]]
    cells = spark.createDataFrame(rows, "row int, col int, value double")
    for tile in (4, 6, 64):
        np.testing.assert_allclose(as_array(cs.despeckle(cells, tile=tile), "value", z.shape), want)


def test_plane_has_constant_slope_up_to_the_border(spark):
    z = np.add.outer(np.arange(9.0) * 3, np.arange(7.0) * 4)
    out = cs.slope_aspect(as_cells(spark, z), 1.0, tile=4)
    want = np.full(z.shape, np.degrees(np.arctan(5.0)))
    # At the corners the column beyond the side repeats the corner, which halves that gradient.
    want[np.ix_([0, -1], [0, -1])] = np.degrees(np.arctan(np.hypot(3.0, 2.0)))
    np.testing.assert_allclose(as_array(out, "slope_deg", z.shape), want)
    flat = cs.slope_aspect(as_cells(spark, np.ones((3, 3))), 1.0, tile=2)
    assert flat.where("aspect is not null").count() == 0


def test_accumulation_counts_a_line(spark):
    flow = cs.flow_direction(as_cells(spark, np.array([[9.0, 8, 7, 6, 5, 4, 3]])), tile=3)
    acc = cs.flow_accumulation(flow).orderBy("col").collect()
    assert [r.accumulation for r in acc] == [1, 2, 3, 4, 5, 6, 7]


def test_otsu_lies_between_the_modes(spark):
    rng = np.random.default_rng(6)
    v = np.r_[rng.normal(-20, 1, 800), rng.normal(-10, 1, 800)]
    df = spark.createDataFrame([("s", float(x)) for x in v], "s string, value double")
    row = cs.water_threshold(cs.otsu_threshold(df, "value", ["s"])).first()
    assert -18 < row.otsu_db < -12 and not row.fallback or row.threshold_db == -16.0
    hist, edges = np.histogram(v, bins=256)
    mid, w0 = (edges[:-1] + edges[1:]) / 2, np.cumsum(hist).astype(float)
    w1, m = w0[-1] - w0, np.cumsum(hist * mid)
    with np.errstate(all="ignore"):
        b = np.nan_to_num(w0 * w1 * (m / w0 - (m[-1] - m) / w1) ** 2)
    assert row.otsu_db == pytest.approx(mid[b.argmax()])


def test_only_ground_above_the_sea_is_flooded(spark):
    z = np.zeros((4, 6))
    z[:, 3:] = 2.0
    e = as_cells(spark, np.full((4, 6), -20.0))
    mask = cs.flood_mask(e, as_cells(spark, np.full((4, 6), -5.0)), e, as_cells(spark, z), F.lit(-16.0), F.lit(-16.0))
    assert {r.col for r in mask.collect()} == {3, 4, 5}
    assert cs.drop_small_blobs(mask, min_cells=12).count() == 12 and cs.drop_small_blobs(mask, min_cells=13).count() == 0
    assert cs.drop_small_blobs(mask, 1, cell_m2=100.0).count() == 0


def test_scene_choice_falls_back_to_the_wide_window(spark):
    from datetime import datetime

    peaks = spark.createDataFrame([("E", datetime(2024, 5, 10, 12)), ("F", datetime(2024, 7, 1))], "event string, peak timestamp_ntz")
    sc = spark.createDataFrame(
        [(1, datetime(2024, 5, 4, 6), "asc"), (2, datetime(2024, 5, 16, 6), "asc"), (3, datetime(2024, 7, 3), "asc"), (4, datetime(2024, 6, 25), "asc")],
        "scene_id int, acquired timestamp_ntz, orbit string")
    got = [(r.event, r.scene_id, r.wide) for r in scenes.event_scenes(sc, peaks).orderBy("event", "rank").collect()]
    assert got == [("E", 2, True), ("E", 1, True), ("F", 3, False)]


def test_pairs_near_poles_and_over_the_antimeridian_equal_brute_force(spark):
    import math

    rng = np.random.default_rng(3)
    a = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-90, 90, 150), rng.uniform(-180, 180, 150)))]
    a += [(900, 89.99, 10.0), (901, -90.0, 0.0), (902, 0.0, 179.999), (903, 75.0, -180.0)]
    b = [(i, x + float(rng.normal(0, 0.02)), y + float(rng.normal(0, 0.05))) for i, x, y in a] + [(950, 89.99, -170.0), (951, 0.0, -179.999), (952, 75.0, 180.0)]
    b = [(i, max(-90.0, min(90.0, x)), y) for i, x, y in b]

    def km(p, q):
        u, v = math.radians(p[1]), math.radians(q[1])
        h = math.sin((v - u) / 2) ** 2 + math.cos(u) * math.cos(v) * math.sin(math.radians(q[2] - p[2]) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1, h)))

    l, r = spark.createDataFrame(a, "i int, lat double, lon double"), spark.createDataFrame(b, "j int, r_lat double, r_lon double")
    for reach in (3.0, 800.0):
        found = sorted((x.i, x.j) for x in spatial.within_km(l, r, reach).select("i", "j").collect())
        assert found == sorted((p[0], q[0]) for p in a for q in b if km(p, q) <= reach)


def test_nearest_axis_value_over_a_hole(spark):
    axis = spark.createDataFrame([(x / 10,) for x in (0, 1, 2, 30, 31)], "v double")
    at = {1: -5.0, 2: 0.14, 3: 1.0, 4: 1.7, 5: 9.0, 6: None, 7: 2.9}
    points = spark.createDataFrame(list(at.items()), "k int, x double")
    out = {r.k: r.near for r in spatial.nearest_axis_value(points, axis, "k", "x", "v", 0.1, "near").collect()}
    assert out == {1: 0.0, 2: 0.1, 3: 0.2, 4: 3.0, 5: 3.1, 6: None, 7: 3.0}


def test_series_of_a_cell_with_many_points_is_dealt_over_tasks(spark):
    cells = spark.range(4).crossJoin(spark.range(300).select(F.col("id").alias("h"))).select(
        (F.col("id") % 2 * 0.5).alias("lat"), (F.floor(F.col("id") / 2) * 0.5).alias("lon"), F.col("h").alias("ts"), (F.col("id") * 1000 + F.col("h") + 0.25).alias("mm"))
    points = spark.range(40).select(F.col("id").alias("k"), F.when(F.col("id") != 7, F.lit(0.6)).alias("lat"), F.when(F.col("id") != 7, F.lit(0.0)).alias("lon"))
    out = spatial.gridded_to_points(cells, points, "k", "ts", "mm", 0.5, fallback=0, digits=1)
    got = out.withColumn("_p", F.spark_partition_id()).collect()
    assert {(r.k, r.ts): (r.mm, r.grid_mean) for r in got} == {(k, h): (round(1000 + h + 0.3, 1), round(1500 + h + 0.3, 1)) for k in range(40) for h in range(300)}
    held = {}
    for r in got:
        held[r._p] = held.get(r._p, 0) + 1
    assert len(got) == 12_000 and max(held.values()) < 2_000


def test_links_of_places_and_membership_give_all_pairs(spark):
    left = spark.range(60).select(F.col("id").alias("i"), (F.col("id") % 6 * 0.02).alias("lat"), (F.col("id") % 4 * 0.02).alias("lon"))
    right = spark.range(90).select(F.col("id").alias("j"), F.when(F.col("id") > 2, F.col("id") % 5 * 0.02).alias("r_lat"), (F.col("id") % 3 * 0.02).alias("r_lon"))
    rows = spatial.places_within_km(left, right, 3.0, "i", "j").collect()
    side = {k: {r.key: r.place for r in rows if r.kind == k} for k in ("left", "right")}
    links = {(r.key, r.place): r.dist_km for r in rows if r.kind == "link"}
    assert len(links) == sum(r.kind == "link" for r in rows) < 12 * 15 and set(side["left"]) == set(range(60)) and set(side["right"]) == set(range(3, 90))
    pairs = {(r.i, r.j): r.dist_km for r in spatial.within_km(left, right, 3.0).collect()}
    assert pairs == {(i, j): links[p, q] for i, p in side["left"].items() for j, q in side["right"].items() if (p, q) in links}


def test_points_of_a_cell_with_few_times_are_dealt_over_tasks(spark):
    cells = spark.createDataFrame([(0.0, 0.0, h, 1.25 + h) for h in range(2)] + [(0.5, 0.0, 0, None)], "lat double, lon double, ts long, mm double")
    points = spark.range(100_000).select(F.col("id").alias("k"), F.lit(0.1).alias("lat"), F.lit(0.0).alias("lon"))
    out = spatial.gridded_to_points(cells, points, "k", "ts", "mm", 0.5)
    held = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.sum("n"), F.max("n")).first()
    assert held[0] == 200_000 and held[1] < 20_000
    seen = out.groupBy("ts", "mm", "grid_mean").agg(F.countDistinct("k").alias("k"), F.count("*").alias("n")).collect()
    assert sorted(map(tuple, seen)) == [(h, 1.25 + h, 1.25 + h, 100_000, 100_000) for h in range(2)]


def test_world_links_grow_with_places_not_with_rows(spark, tmp_path):
    """Keys repeat their coordinates: every 9,797 suppliers, every 1,009,000 customers. Supplier 0 is at the south pole."""
    from hydroseries.plans import load_all
    from hydroseries.plans.registry import QUERIES

    load_all()
    copies = 40
    s, c = spark.range(copies), spark.range(copies)
    s.select((F.col("id") * 9_797).alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    c.select((F.col("id") * 1_009_000).alias("c_custkey"), F.lit(1.0).alias("c_acctbal")).write.parquet(f"{tmp_path}/customer.parquet")
    rows = QUERIES["j07_within_km_world"](spark, str(tmp_path)).collect()
    assert [(r.key, r.place, r.dist_km) for r in rows if r.kind == "link"] == [(0, 0, 0.0)]
    assert sorted((r.key, r.place) for r in rows if r.kind == "left") == [(i * 9_797, 0) for i in range(copies)]
    assert sorted((r.key, r.place) for r in rows if r.kind == "right") == [(i * 1_009_000, 0) for i in range(copies)]
    assert len(rows) == 1 + 2 * copies


def test_links_of_a_cell_at_the_pole_are_dealt_over_tasks(spark):
    """All points are in one cell, which reaches around the pole; by their few bytes they would be one task."""
    left = spark.range(100).select(F.col("id").alias("i"), F.lit(-89.5).alias("lat"), (F.col("id") * 3.6 - 180).alias("lon"))
    right = spark.range(9_000).select(F.col("id").alias("j"), (F.lit(-89.9) + F.col("id") % 2 * 0.1).alias("r_lat"), (F.col("id") * 0.04 - 180).alias("r_lon"))
    out = spatial.places_within_km(left, right, 300.0, "i", "j").where("kind = 'link'").withColumn("_p", F.spark_partition_id())
    held = [r["count"] for r in out.groupBy("_p").count().collect()]
    assert sum(held) == 100 * 9_000 and max(held) <= 4 * 100 * spatial.CELL_ROWS
    assert out.select("key", "place").distinct().count() == 100 * 9_000


def pairs_of_copies(spark, folder, name, copies=40):
    """The query's rows on suppliers and customers that all have the coordinates of key 0."""
    from hydroseries.plans import load_all
    from hydroseries.plans.registry import QUERIES

    load_all()
    ids = spark.range(copies)
    ids.select((F.col("id") * 9_797).alias("s_suppkey")).write.parquet(f"{folder}/supplier.parquet")
    ids.select((F.col("id") * 1_009_000).alias("c_custkey"), F.lit(1.0).alias("c_acctbal")).write.parquet(f"{folder}/customer.parquet")
    out = QUERIES[name](spark, str(folder))
    assert out.columns == ["s_suppkey", "c_custkey", "dist_km"]
    return sorted(map(tuple, out.collect()))


def test_every_pair_of_copies_is_a_row(spark, tmp_path):
    found = pairs_of_copies(spark, tmp_path, "j07_within_km")
    assert found == [(i * 9_797, j * 1_009_000, 0.0) for i in range(40) for j in range(40)]


def test_every_pair_of_copies_at_the_pole_is_a_row(spark, tmp_path):
    found = pairs_of_copies(spark, tmp_path, "j07_within_km_world")
    assert found == [(i * 9_797, j * 1_009_000, 0.0) for i in range(40) for j in range(40)]


def test_pairs_by_packs_equal_pairs_of_rows(spark, monkeypatch):
    """Copies, more than a pack holds too, rows without coordinates, poles and the antimeridian; cells of several shares."""
    monkeypatch.setattr(spatial, "PLACE_PACK", 4)
    monkeypatch.setattr(spatial, "SHARE_ROWS", 8)
    rng = np.random.default_rng(5)
    at = [(float(x), float(y)) for x, y in zip(rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60))]
    at += [(89.99, 10.0), (-90.0, 0.0), (0.0, 179.999), (75.0, -180.0), (None, 1.0), (1.0, None)]
    off = [(None if x is None else max(-90.0, min(90.0, x + float(rng.normal(0, 0.02)))), y) for x, y in at] + [(89.99, -170.0), (0.0, -179.999), (75.0, 180.0)]
    a = [(i, *p) for i, p in enumerate(at * 2 + [at[0]] * 9 + [at[60]] * 7)]
    b = [(i, *p) for i, p in enumerate(off * 3 + [off[0]] * 11 + [(89.99, -170.0)] * 6)]
    l, r = spark.createDataFrame(a, "i int, lat double, lon double"), spark.createDataFrame(b, "j long, r_lat double, r_lon double")
    for reach in (3.0, 800.0):
        want = sorted(map(tuple, spatial.within_km(l, r, reach).select("i", "j", "dist_km").collect()))
        out = spatial.pairs_within_km(l, r, reach, "i", "j")
        assert out.dtypes == [("i", "int"), ("j", "bigint"), ("dist_km", "double")] and len(want) > 300
        assert sorted(map(tuple, out.collect())) == want
    assert spatial.pairs_within_km(l, r.where("r_lat is null"), 3.0, "i", "j").count() == 0


def test_pairs_of_one_place_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PLACE_PACK", 64)
    monkeypatch.setattr(spatial, "SHARE_ROWS", 256)
    left = spark.range(1_500).select(F.col("id").alias("i"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    right = spark.range(1_500).select(F.col("id").alias("j"), F.lit(1.0).alias("r_lat"), F.lit(2.0).alias("r_lon"))
    out = spatial.pairs_within_km(left, right, 3.0, "i", "j")
    held = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 1_500 * 1_500 and max(held) < sum(held) / 4
    assert out.select("i", "j").distinct().count() == 1_500 * 1_500
