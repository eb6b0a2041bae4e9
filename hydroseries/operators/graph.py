"""Drainage network as node and edge tables: edges, components, path lengths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries.functions.geo import utm_south
from hydroseries.operators.frames import first_per_key
from hydroseries.session import cut_lineage

# Waterway classes that carry water between stations.
WATERWAYS = ("canal", "drain", "river", "stream", "ditch")


def edges_from_ways(ways: DataFrame, classes: Sequence[str] = WATERWAYS, zone: int = 48) -> DataFrame:
    """One undirected edge per pair of consecutive nodes: u < v, length in metres, ends in UTM.

    Self-loops are left out; of repeated pairs the first by way order and position stays.
    """
    n = F.size("path")
    pairs = F.zip_with(
        F.slice("path", F.lit(1), n - 1), F.slice("path", F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )
    rows = ways.where(F.col("waterway").isin(*classes) & (n > 1)).select(
        "way_order", "waterway", "name", F.posexplode(pairs).alias("pos", "p")
    )
    rows = rows.where(F.col("p.a.node") != F.col("p.b.node"))
    turn = F.col("p.a.node") > F.col("p.b.node")
    rows = rows.select(
        "way_order", "pos", "waterway", "name",
        F.when(turn, F.col("p.b")).otherwise(F.col("p.a")).alias("a"),
        F.when(turn, F.col("p.a")).otherwise(F.col("p.b")).alias("b"),
    )
    x1, y1 = utm_south(F.col("a.lon"), F.col("a.lat"), zone)
    x2, y2 = utm_south(F.col("b.lon"), F.col("b.lat"), zone)
    rows = rows.select(
        "way_order", "pos", F.col("a.node").alias("u"), F.col("b.node").alias("v"), "waterway", "name",
        x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"),
    ).withColumn("length_m", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    return first_per_key(rows, ["u", "v"], [F.col("way_order"), F.col("pos")]).drop("way_order", "pos")


def nodes_of(edges: DataFrame) -> DataFrame:
    """Node, x, y of all edge ends."""
    a = edges.select(F.col("u").alias("node"), F.col("x1").alias("x"), F.col("y1").alias("y"))
    b = edges.select(F.col("v").alias("node"), F.col("x2").alias("x"), F.col("y2").alias("y"))
    return first_per_key(a.unionByName(b), ["node"], [F.col("x"), F.col("y")])


def edge_heights(edges: DataFrame, cells: DataFrame, left: float, top: float, size: float) -> DataFrame:
    """Mean cell value at both ends and the middle of each edge, missing samples skipped."""
    at = F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)))
    s = edges.select("u", "v", "x1", "y1", "x2", "y2", at.alias("f"))
    x = F.col("x1") + (F.col("x2") - F.col("x1")) * F.col("f")
    y = F.col("y1") + (F.col("y2") - F.col("y1")) * F.col("f")
    s = s.select("u", "v", ((F.lit(top) - y) / size).cast("int").alias("row"), ((x - left) / size).cast("int").alias("col"))
    z = s.join(cells.select("row", "col", "value"), ["row", "col"], "left").groupBy("u", "v").agg(F.avg("value").alias("z_mean"))
    return edges.join(z, ["u", "v"], "left")


def _signature(df: DataFrame, *columns: str) -> tuple:
    h = F.xxhash64(*columns)
    row = df.agg(F.count("*"), F.bit_xor(h), F.sum((h % 1_000_003).cast("long"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", nodes: DataFrame | None = None) -> DataFrame:
    """(node, component), the component being its smallest node id.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step links
    nodes to the smallest id around them, so rounds grow with the logarithm of the size
    and not with the diameter. The steps use minimum aggregates and joins only, no
    neighbour list is ever collected; each round ends in a checkpoint.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col("u") != F.col("v"))
    e = cut_lineage(e.distinct())
    seen = _signature(e, "u", "v")
    while True:
        both = e.union(e.select("v", "u"))
        # Repartitioned: only joins of two plain exchanges are split when a node has very many edges.
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).repartition("u")
        star = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = star.where(F.col("u") != F.col("v")).distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m")).repartition("u")
        rest = star.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        e = rest.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).union(low).distinct()
        e = cut_lineage(e)
        now = _signature(e, "u", "v")
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node")).distinct()
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
    if nodes is not None:
        out = nodes.select("node").join(out, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return out


def _shortest_edges(edges: DataFrame) -> DataFrame:
    return (
        edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("length_m").alias("d"))
        .where(F.col("u") != F.col("v"))
        .groupBy("u", "v")
        .agg(F.min("d").alias("d"))
    )


def contract(edges: DataFrame, terminals: DataFrame) -> DataFrame:
    """The same distances between terminals on a smaller graph (u, v, d).

    Dead ends go, and nodes with two neighbours are replaced by one edge. In each round a
    random set of such nodes without neighbours in the set is taken, so that long chains
    shrink by a constant factor per round.
    """
    e = cut_lineage(_shortest_edges(edges))
    keep = cut_lineage(terminals.select(F.col("node").alias("n")).distinct())
    turn = 0
    while True:
        turn += 1
        both = e.select(F.col("u").alias("n"), F.col("v").alias("o"), "d").union(e.select("v", "u", "d"))
        around = both.groupBy("n").agg(
            F.count("*").alias("deg"), F.min("o").alias("o1"), F.max("o").alias("o2"),
            F.min_by("d", "o").alias("d1"), F.max_by("d", "o").alias("d2"),
        )
        free = around.where(F.col("deg") <= 2).join(keep, "n", "left_anti")
        free = cut_lineage(free.withColumn("h", F.xxhash64("n", F.lit(turn))))
        mids = free.where(F.col("deg") == 2)
        rank = free.select(F.col("n").alias("o"), "h")
        # A node yields to a neighbour of smaller hash that could be taken in the same round.
        beaten = (
            mids.select("n", F.col("h").alias("mine"), F.explode(F.array("o1", "o2")).alias("o"))
            .join(rank, "o")
            .where(F.struct("h", "o") < F.struct("mine", "n"))
            .select("n")
        )
        taken = cut_lineage(mids.join(beaten, "n", "left_anti"))
        gone = taken.select("n").union(free.where(F.col("deg") == 1).select("n"))
        if gone.isEmpty():
            return e
        left = e.join(gone.select(F.col("n").alias("u")), "u", "left_anti").join(
            gone.select(F.col("n").alias("v")), "v", "left_anti"
        )
        bridge = taken.select(F.col("o1").alias("u"), F.col("o2").alias("v"), (F.col("d1") + F.col("d2")).alias("d"))
        e = left.select("u", "v", "d").union(bridge).groupBy("u", "v").agg(F.min("d").alias("d"))
        e = cut_lineage(e)


def hierarchy(edges: DataFrame) -> DataFrame:
    """n, o, d: for every node the links to nodes taken out after it, with shortcuts over all taken out before.

    In each round all nodes that have fewer links than their neighbours (a hash decides ties) are taken out at once and their
    neighbours linked past them. Every shortest path then has a highest node which both its ends reach by such links alone.
    ``edges``: u, v, d, one row per pair.
    """
    e, turn, taken_links = cut_lineage(edges.select("u", "v", "d")), 0, None
    while True:
        turn += 1
        both = e.select(F.col("u").alias("n"), F.col("v").alias("o"), "d").union(e.select("v", "u", "d"))
        rank = both.groupBy("n").agg(F.count("*").alias("deg")).withColumn("r", F.struct("deg", F.xxhash64("n", F.lit(turn)), "n"))
        beside = both.select("n", "o").join(rank.select(F.col("n").alias("o"), F.col("r").alias("other")), "o")
        lowest = beside.groupBy("n").agg(F.min("other").alias("other"))
        taken = cut_lineage(rank.join(lowest, "n").where(F.col("r") < F.col("other")).select("n"))
        if taken.isEmpty():
            return both if taken_links is None else taken_links
        up = cut_lineage(both.join(taken, "n").select("n", "o", "d"))
        taken_links = up if taken_links is None else cut_lineage(taken_links.union(up)) if turn % 8 == 0 else taken_links.union(up)
        rest = e.join(taken.select(F.col("n").alias("u")), "u", "left_anti").join(taken.select(F.col("n").alias("v")), "v", "left_anti")
        # A node with fewer links than its neighbours has few: the pairs past it are few as well.
        past = up.select("n", F.col("o").alias("u"), F.col("d").alias("d1")).join(up.select("n", F.col("o").alias("v"), F.col("d").alias("d2")), "n")
        past = past.where(F.col("u") < F.col("v")).select("u", "v", (F.col("d1") + F.col("d2")).alias("d"))
        e = cut_lineage(rest.select("u", "v", "d").union(past).groupBy("u", "v").agg(F.min("d").alias("d")))


def hub_labels(links: DataFrame, terminals: DataFrame, limit: float | None = None) -> DataFrame:
    """source, hub, d: what each terminal reaches by links to nodes taken out later (``hierarchy``), itself included."""
    links = cut_lineage(links)
    known = cut_lineage(terminals.select(F.col("node").alias("source"), F.col("node").alias("hub")).distinct().withColumn("d", F.lit(0.0).cast("double")))
    front = known
    while True:
        reach = front.join(links, F.col("hub") == F.col("n")).groupBy("source", F.col("o").alias("hub")).agg(F.min(front["d"] + links["d"]).alias("d"))
        if limit is not None:
            reach = reach.where(F.col("d") <= limit)
        old = known.withColumnRenamed("d", "_old")
        front = reach.join(old, ["source", "hub"], "left").where(F.col("_old").isNull() | (F.col("d") < F.col("_old")))
        front = cut_lineage(front.select("source", "hub", "d"))
        if front.isEmpty():
            return known
        known = cut_lineage(known.union(front).groupBy("source", "hub").agg(F.min("d").alias("d")))


def path_lengths(
    edges: DataFrame, terminals: DataFrame, shrink: bool = True, pairs: DataFrame | None = None, limit: float | None = None
) -> DataFrame:
    """Shortest path length between connected terminals: node_a < node_b, length_m.

    Distances are a join of two sets of labels: a terminal's labels are the nodes above it in a hierarchy of the graph, and every shortest
    path has its highest node in the labels of both ends. No terminal keeps a distance to all other nodes.
    ``pairs`` (node_a, node_b) asks for some pairs of terminals only, ``limit`` for lengths up to it.
    """
    short = contract(edges, terminals) if shrink else cut_lineage(_shortest_edges(edges))
    labels = hub_labels(hierarchy(short), terminals, limit)
    a = labels.select(F.col("source").alias("node_a"), "hub", F.col("d").alias("_a"))
    b = labels.select(F.col("source").alias("node_b"), "hub", F.col("d").alias("_b"))
    if pairs is not None:
        low, high = F.least("node_a", "node_b").alias("node_a"), F.greatest("node_a", "node_b").alias("node_b")
        met = pairs.select(low, high).distinct().join(a, "node_a").join(b, ["node_b", "hub"])
    else:
        met = a.join(b, "hub")
    out = met.where(F.col("node_a") < F.col("node_b")).groupBy("node_a", "node_b").agg(F.min(F.col("_a") + F.col("_b")).alias("length_m"))
    return out if limit is None else out.where(F.col("length_m") <= limit)


def station_distances(snapped: DataFrame, edges: DataFrame, key: str = "station_id") -> DataFrame:
    """Distance in km (three decimals) between every two stations whose nodes are connected.

    Stations snapped to the same node are 0 km apart.
    """
    at = snapped.where(F.col("node").isNotNull()).select(key, "node")
    far = path_lengths(edges, at)
    a = at.select(F.col(key).alias("_a"), F.col("node").alias("node_a"))
    b = at.select(F.col(key).alias("_b"), F.col("node").alias("node_b"))
    pairs = far.join(a, "node_a").join(b, "node_b").select("_a", "_b", "length_m")
    same = a.join(b, a["node_a"] == b["node_b"]).where(F.col("_a") < F.col("_b")).select("_a", "_b", F.lit(0.0).alias("length_m"))
    return pairs.union(same).select(
        F.least("_a", "_b").alias("station_a"), F.greatest("_a", "_b").alias("station_b"),
        F.round(F.col("length_m") / 1000, 3).alias("distance_km"),
    )


def component_summary(snapped: DataFrame, components: DataFrame, outlets: Sequence, key: str = "station_id") -> DataFrame:
    """Stations with their component, its number of stations, and whether an outlet station shares it."""
    rows = snapped.where(F.col("node").isNotNull()).join(components, "node")
    is_outlet: Column = F.col(key).isin(*outlets)
    per = rows.groupBy("component").agg(F.count("*").alias("n_stations"), F.max(is_outlet).alias("reaches_sea"))
    return rows.join(per, "component").select(key, "node", "component", "n_stations", "reaches_sea")


def below_zero(edges: DataFrame) -> DataFrame:
    """Number of edges, and of those with a negative mean height; unknown heights are not below."""
    return edges.agg(F.count("*").alias("n_edges"), F.count_if(F.coalesce(F.col("z_mean") < 0, F.lit(False))).alias("n_below"))


def clip_to(edges: DataFrame, points: DataFrame, margin: float = 2000.0) -> DataFrame:
    """Edges that touch the bounding box of the points, grown by ``margin`` metres."""
    ends = [f(c).alias(f"{n}{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))]
    out = edges.withColumn("_box", points.agg(F.struct(*ends)).scalar())
    box = F.col("_box")
    hit = F.lit(True)
    for c in ("x", "y"):
        lo, hi = F.least(f"{c}1", f"{c}2"), F.greatest(f"{c}1", f"{c}2")
        hit = hit & (hi >= box[f"lo{c}"] - margin) & (lo <= box[f"hi{c}"] + margin)
    return out.where(hit).select(*edges.columns)
