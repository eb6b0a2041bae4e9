"""Rasters as tables of cells (row, col, value) cut into square tiles."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hydroseries.functions.cleaning import holds
from hydroseries.operators.frames import join_per_key
from hydroseries.operators.graph import connected_components
from hydroseries.operators.quantiles import exact_quantiles
from hydroseries.session import cut_lineage

TILE = 256
# Flow codes of the eight neighbours (row step, column step, code), north first, clockwise.
D8 = ((-1, 0, 64), (-1, 1, 128), (0, 1, 1), (1, 1, 2), (1, 0, 4), (1, -1, 8), (0, -1, 16), (-1, -1, 32))
OTSU_BAND = (-22.0, -13.0)
FALLBACK_DB = -16.0
SEA_LEVEL_M = 0.3
MIN_BLOB = 10
MIN_AREA_M2 = 2500.0


def _tiles(df: DataFrame, keys: Sequence[str], reach: int, tile: int) -> DataFrame:
    """Assign cells to tiles; cells within ``reach`` of a border also go to the tile next door."""

    def near(c: Column) -> Column:
        home, off = F.floor(c / tile).cast("int"), F.pmod(c, F.lit(tile))
        return F.explode(F.array_compact(F.array(home, F.when(off < reach, home - 1), F.when(off >= tile - reach, home + 1))))

    return df.withColumn("_tr", near(F.col("row"))).withColumn("_tc", near(F.col("col")))


def stencil(
    cells: DataFrame, columns: Sequence[str], outputs: dict[str, str],
    compute: Callable[..., dict[str, np.ndarray]], reach: int = 1, tile: int = TILE, keys: Sequence[str] = (),
) -> DataFrame:
    """Apply a neighbourhood function to every cell, one tile with its rim at a time.

    ``compute`` gets one 2-D array per column (NaN where missing) and the mask of cells
    that exist, and returns the output arrays of the same shape. One shuffle moves the
    cells plus the rims; a task holds one tile, whatever the size of the raster.
    """
    keys, columns = list(keys), list(columns)
    wide = _tiles(cells.select(*keys, "row", "col", *columns), keys, reach, tile)
    fields = [cells.schema[k] for k in keys]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["row int", "col int"]
                       + [f"`{n}` {t}" for n, t in outputs.items()])
    size = tile + 2 * reach

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(key[-2]), int(key[-1])
        r = pdf["row"].to_numpy() - (tr * tile - reach)
        c = pdf["col"].to_numpy() - (tc * tile - reach)
        exists = np.zeros((size, size), dtype=bool)
        exists[r, c] = True
        arrays = []
        for name in columns:
            a = np.full((size, size), np.nan)
            a[r, c] = pdf[name].to_numpy(dtype=float)
            arrays.append(a)
        made = compute(*arrays, exists)
        core = (r >= reach) & (r < size - reach) & (c >= reach) & (c < size - reach)
        out = pdf.loc[core, [*keys, "row", "col"]].reset_index(drop=True)
        for name, kind in outputs.items():
            v = made[name][r[core], c[core]]
            out[name] = pd.Series(v).astype("int64") if kind in ("int", "bigint") else v
        return out

    done = wide.groupBy(*keys, "_tr", "_tc").applyInPandas(run, schema)
    doubles = [n for n, t in outputs.items() if t == "double"]
    return done.withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n in doubles}) if doubles else done


def coarsen(cells: DataFrame, factor: int, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over blocks of factor x factor cells, missing cells skipped."""
    step = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return cells.groupBy(*keys, step("row"), step("col")).agg(F.avg("value").alias("value"))


def _shift(a: np.ndarray, dr: int, dc: int, fill=np.nan) -> np.ndarray:
    """Array whose element (r, c) is a[r + dr, c + dc]."""
    out = np.full(a.shape, fill, dtype=a.dtype)
    n, m = a.shape
    out[max(0, -dr) : n - max(0, dr), max(0, -dc) : m - max(0, dc)] = a[
        max(0, dr) : n - max(0, -dr), max(0, dc) : m - max(0, -dc)
    ]
    return out


def _window(z: np.ndarray, exists: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """The 3x3 values around each cell, continued over the border of the raster.

    Beyond the first and last row values go on linearly from the two rows inside (columns
    beyond the side are taken from the cell's own column); in other rows values go on
    linearly sideways. A missing neighbour inside the raster takes the value of the cell.
    """
    side = {d: _shift(exists, 0, d, False) for d in (-1, 1)}
    upright = {d: _shift(exists, d, 0, False) for d in (-1, 1)}
    edge_row = ~(upright[-1] & upright[1])
    win = {}
    for dr in (-1, 0, 1):
        for dc in (-1, 0, 1):
            v = _shift(z, dr, dc)
            if dc:
                # on first and last rows clamp to the own column
                clamp = edge_row & ~side[dc]
                v = np.where(clamp, _shift(z, dr, 0), v)
                beyond = ~edge_row & ~side[dc]
                v = np.where(beyond, 2 * _shift(z, dr, 0) - _shift(z, dr, -dc), v)
            if dr:
                out = ~upright[dr]
                own, other = z, _shift(z, -dr, 0)
                if dc:
                    own = np.where(side[dc], _shift(z, 0, dc), z)
                    other = np.where(side[dc], _shift(z, -dr, dc), _shift(z, -dr, 0))
                v = np.where(out, 2 * own - other, v)
            win[dr, dc] = np.where(np.isnan(v), z, v)
    return win


def slope_aspect(cells: DataFrame, size: float, tile: int = TILE, keys: Sequence[str] = ()) -> DataFrame:
    """Slope and aspect in degrees by Horn's formula, border cells included; flat cells have no aspect."""

    def compute(z, exists):
        w = _window(z, exists)
        east = w[-1, 1] + 2 * w[0, 1] + w[1, 1]
        west = w[-1, -1] + 2 * w[0, -1] + w[1, -1]
        south = w[1, -1] + 2 * w[1, 0] + w[1, 1]
        north = w[-1, -1] + 2 * w[-1, 0] + w[-1, 1]
        dx, dy = east - west, south - north
        slope = np.degrees(np.arctan(np.hypot(dx, dy) / (8 * size)))
        angle = np.degrees(np.arctan2(dy, -dx))
        aspect = np.where(angle > 90, 450 - angle, 90 - angle)
        aspect = np.where(aspect >= 360, aspect - 360, aspect)
        return {"slope_deg": slope, "aspect": np.where((dx == 0) & (dy == 0), np.nan, aspect)}

    return stencil(cells, ["value"], {"slope_deg": "double", "aspect": "double"}, compute, 1, tile, keys)


def flow_direction(cells: DataFrame, size: float = 1.0, tile: int = TILE, keys: Sequence[str] = ()) -> DataFrame:
    """Code of the steepest descent among eight neighbours (0: none lower) and the cell it leads to."""

    def compute(z, exists):
        best, code = np.zeros(z.shape), np.zeros(z.shape)
        for dr, dc, k in D8:
            drop = (z - _shift(z, dr, dc)) / (size * np.hypot(dr, dc))
            better = np.nan_to_num(drop, nan=-1.0) > best
            best, code = np.where(better, drop, best), np.where(better, k, code)
        return {"direction": code}

    out = stencil(cells, ["value"], {"direction": "int"}, compute, 1, tile, keys)
    step_r = F.lit(None).cast("int")
    step_c = F.lit(None).cast("int")
    for dr, dc, k in D8:
        step_r = F.when(F.col("direction") == k, dr).otherwise(step_r)
        step_c = F.when(F.col("direction") == k, dc).otherwise(step_c)
    return out.withColumns(
        {"to_row": (F.col("row") + step_r).cast("int"), "to_col": (F.col("col") + step_c).cast("int")}
    )


def cell_id(row: Column, col: Column) -> Column:
    return F.shiftleft(row.cast("long"), 32) + col.cast("long")


def flow_accumulation(flow: DataFrame) -> DataFrame:
    """Number of cells that drain through each cell, itself included.

    Pointer doubling: after k rounds each cell knows how many cells lie less than 2^k steps
    upstream, and its 2^k-th cell downstream. Rounds grow with the logarithm of the longest
    flow path.
    """
    f = flow.select(
        "row", "col", cell_id(F.col("row"), F.col("col")).alias("id"),
        F.when(F.col("direction") != 0, cell_id(F.col("to_row"), F.col("to_col"))).alias("next"),
    )
    # A step that leaves the raster ends there.
    real = f.select(F.col("id").alias("next"))
    inside = f.join(real, "next", "left_semi").select("id", "next")
    f = cut_lineage(f.drop("next").join(inside, "id", "left").withColumn("acc", F.lit(1).cast("long")))
    while True:
        moving = f.where(F.col("next").isNotNull())
        if moving.isEmpty():
            return f.select("row", "col", F.col("acc").alias("accumulation"))
        inflow = moving.groupBy(F.col("next").alias("id")).agg(F.sum("acc").alias("_in"))
        ahead = f.select(F.col("id").alias("next"), F.col("next").alias("_after"))
        hop = moving.select("id", "next").join(ahead, "next").select("id", "_after")
        f = f.join(inflow, "id", "left").join(hop, "id", "left").select(
            "row", "col", "id", F.col("_after").alias("next"), (F.col("acc") + F.coalesce("_in", F.lit(0))).alias("acc")
        )
        f = cut_lineage(f)


_OCEAN = -1


def _flood(z: np.ndarray, exists: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, float]]]:
    """Priority flood of one tile (array with a rim of one cell) from its outlets and its outer cells.

    Returns per cell of the array the level at which water reaches an outlet or an outer cell inside the tile, the place
    (flat index) of that outer cell or ``_OCEAN``, and the lowest passes between the basins, without those that a chain of
    lower ones makes needless.
    """
    n, m = z.shape
    known = exists & ~np.isnan(z)
    core = np.zeros(z.shape, dtype=bool)
    core[1:-1, 1:-1] = True
    around = np.ones(z.shape, dtype=bool)
    for dr, dc, _ in D8:
        around &= _shift(known, dr, dc, False)
    core &= known
    outlet = core & ~around
    outer = np.zeros(z.shape, dtype=bool)
    outer[1, :] = outer[-2, :] = outer[:, 1] = outer[:, -2] = True
    flat = np.arange(n * m).reshape(n, m)
    basin = np.where(outlet, _OCEAN, np.where(outer & core, flat, -2))
    level = np.where(core, z, np.inf)
    height, label, reached, open_ = level.ravel().tolist(), basin.ravel().tolist(), level.ravel().tolist(), core.ravel().tolist()
    heap = [(height[k], k) for k in np.flatnonzero((basin.ravel() > -2)).tolist()]
    heapq.heapify(heap)
    steps = [dr * m + dc for dr, dc, _ in D8]
    while heap:
        at, k = heapq.heappop(heap)
        mine = label[k]
        for step in steps:
            o = k + step
            if open_[o] and label[o] == -2:
                label[o] = mine
                reached[o] = max(at, height[o])
                heapq.heappush(heap, (reached[o], o))
    basin, level = np.array(label).reshape(n, m), np.array(reached).reshape(n, m)
    passes = []
    for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)):
        other, height_ = _shift(basin, dr, dc, -2), _shift(level, dr, dc, np.inf)
        meet = (basin > -2) & (other > -2) & (basin != other)
        a, b = basin[meet], other[meet]
        passes.append(np.column_stack([np.maximum(level[meet], height_[meet]), np.minimum(a, b), np.maximum(a, b)]))
    table = np.concatenate(passes)
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    kept = []
    for w, a, b in table[np.lexsort(table.T[::-1])].tolist():
        ra, rb = find(int(a)), find(int(b))
        if ra != rb:
            root[ra] = rb
            kept.append((int(a), int(b), w))
    return level, basin, kept


def _basins(cells: DataFrame, tile: int) -> DataFrame:
    """One priority flood per tile. kind 0: cells with level and basin; kind 1: passes (basin, other, level) of the tile."""
    size = tile + 2
    wide = _tiles(cells.select("row", "col", "value"), [], 1, tile)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(key[0]) * tile - 1, int(key[1]) * tile - 1
        r, c = pdf["row"].to_numpy() - top, pdf["col"].to_numpy() - left
        exists, z = np.zeros((size, size), dtype=bool), np.full((size, size), np.nan)
        exists[r, c] = True
        z[r, c] = pdf["value"].to_numpy(dtype=float)
        level, basin, passes = _flood(z, exists)

        def name(flat):
            flat = np.asarray(flat, dtype=np.int64)
            return np.where(flat < 0, _OCEAN, ((flat // size + top) << 32) + flat % size + left)

        core = (r >= 1) & (r < size - 1) & (c >= 1) & (c < size - 1)
        r, c, v = r[core], c[core], pdf["value"].to_numpy(dtype=float)[core]
        out = pd.DataFrame({"kind": 0, "tr": int(key[0]), "tc": int(key[1]), "row": r + top, "col": c + left, "value": v,
                            "level": np.where(np.isnan(v), np.nan, level[r, c]), "basin": name(basin[r, c]), "other": _OCEAN})
        if passes:
            a, b, w = zip(*passes)
            out = pd.concat([out, pd.DataFrame({"kind": 1, "tr": int(key[0]), "tc": int(key[1]), "row": 0, "col": 0, "value": np.nan,
                                                "level": w, "basin": name(a), "other": name(b)})])
        return out

    schema = "kind int, tr int, tc int, row int, col int, value double, level double, basin long, other long"
    return cut_lineage(wide.groupBy("_tr", "_tc").applyInPandas(run, schema))


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """Lowest way out of every outer cell of one tile: over the passes of the tile, from levels known so far (kind 2)."""
    known = pdf[pdf["kind"] == 2]
    best = dict(zip(known["basin"].tolist(), known["level"].tolist()))
    best[_OCEAN] = -np.inf
    links: dict[int, list[tuple[int, float]]] = {}
    p = pdf[pdf["kind"] == 1]
    for a, b, w in zip(p["basin"].tolist(), p["other"].tolist(), p["level"].tolist()):
        links.setdefault(a, []).append((b, w))
        links.setdefault(b, []).append((a, w))
    heap = [(v, k) for k, v in best.items() if v < np.inf]
    heapq.heapify(heap)
    while heap:
        v, k = heapq.heappop(heap)
        if v > best[k]:
            continue
        for o, w in links.get(k, ()):
            new = max(v, w)
            if new < best.get(o, np.inf):
                best[o] = new
                heapq.heappush(heap, (new, o))
    best.pop(_OCEAN)
    return pd.DataFrame({"tr": pdf["tr"].iloc[0], "tc": pdf["tc"].iloc[0], "basin": list(best), "level": list(best.values())})


def fill_depressions(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """Lowest level at which water can leave each cell (row, col, value, filled, sink_depth).

    Water leaves at the border of the raster and at missing cells. Two passes over the cells, after Barnes (2016): each tile
    is flooded once from its outlets and outer cells, which leaves basins with the passes between them; levels are settled on
    the outer cells of all tiles alone (about 4 in ``tile`` of the cells), tile by tile and then over the seams until nothing
    changes; a cell's level is the higher of its level in the tile and that of its basin.
    """
    made = _basins(cells, tile)
    outer = made.where((F.col("kind") == 0) & (F.col("basin") == cell_id(F.col("row"), F.col("col"))))
    outer = cut_lineage(outer.select("tr", "tc", "row", "col", "value", F.col("basin")))
    # Seams: neighbours in different tiles, both outer cells. An outlet beyond the seam is a way out at its own height.
    rim = made.where((F.col("kind") == 0) & F.col("value").isNotNull()).where(
        F.pmod("row", F.lit(tile)).isin(0, tile - 1) | F.pmod("col", F.lit(tile)).isin(0, tile - 1)
    ).select("tr", "tc", "row", "col", "value", "basin")
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc, _ in D8])
    near = outer.select(F.col("tr").alias("_tr"), F.col("tc").alias("_tc"), F.col("basin").alias("to"), F.col("value").alias("_z"),
                        "row", "col", F.explode(steps).alias("_s"))
    near = near.select("_tr", "_tc", "to", "_z", (F.col("row") + F.col("_s.dr")).alias("row"), (F.col("col") + F.col("_s.dc")).alias("col"))
    seams = near.join(rim, ["row", "col"]).where((F.col("tr") != F.col("_tr")) | (F.col("tc") != F.col("_tc")))
    seams = cut_lineage(seams.select("_tr", "_tc", "to", F.col("basin").alias("from"), F.greatest("_z", "value").alias("over")))
    passes = made.where("kind = 1").select("kind", "tr", "tc", "basin", "other", "level")
    known = outer.select("tr", "tc", "basin", F.lit(float("inf")).alias("level"))
    start = seams.where(F.col("from") == _OCEAN).groupBy(F.col("to").alias("basin")).agg(F.min("over").alias("_in"))
    known = known.join(start, "basin", "left").select("tr", "tc", "basin", F.coalesce("_in", "level").alias("level"))
    active, first = known.select("tr", "tc").distinct(), True
    while True:
        part = known if first else known.join(active, ["tr", "tc"], "left_semi")
        frame = part.select(F.lit(2).alias("kind"), "tr", "tc", "basin", F.lit(None).cast("long").alias("other"), "level").unionByName(
            (passes if first else passes.join(active, ["tr", "tc"], "left_semi")))
        new = frame.groupBy("tr", "tc").applyInPandas(_settle, "tr int, tc int, basin long, level double")
        rest = known.limit(0) if first else known.join(active, ["tr", "tc"], "left_anti")
        known = cut_lineage(rest.unionByName(new.select(*known.columns)))
        first = False
        arrive = seams.join(known.select(F.col("basin").alias("from"), F.col("level").alias("_l")), "from")
        arrive = arrive.groupBy(F.col("to").alias("basin")).agg(F.min(F.greatest("over", "_l")).alias("_in"))
        lower = cut_lineage(known.join(arrive, "basin").where(F.col("_in") < F.col("level")).select("tr", "tc", "basin", "_in"))
        if lower.isEmpty():
            break
        active = lower.select("tr", "tc").distinct()
        known = known.join(lower.select("basin", "_in"), "basin", "left").select(
            "tr", "tc", "basin", F.coalesce("_in", "level").alias("level"))
    out = made.where("kind = 0").select("row", "col", "value", F.col("level").alias("_own"), "basin")
    out = out.join(known.select("basin", F.col("level").alias("_way")), "basin", "left")
    filled = F.when(F.isnan("value") | F.col("value").isNull(), F.lit(None).cast("double")).otherwise(F.greatest("_own", F.coalesce("_way", "_own")))
    out = out.select("row", "col", F.nanvl("value", F.lit(None).cast("double")).alias("value"), filled.alias("filled"))
    return out.withColumn("sink_depth", F.greatest(F.col("filled") - F.col("value"), F.lit(0.0)))


def terrain_stats(cells: DataFrame, slope: DataFrame, sinks: DataFrame, size: float, flat_below: float = 0.5) -> DataFrame:
    """Percentiles of height, share of flat cells, and total sink volume, in one row."""
    z = exact_quantiles(cells.withColumn("_g", F.lit(0)), ["_g"], F.col("value"), {"p1": 0.01, "p50": 0.5, "p99": 0.99}, "n_cells")
    flat = slope.agg((F.avg((F.col("slope_deg") < flat_below).cast("double")) * 100).alias("flat_pct"))
    volume = sinks.agg((F.sum(F.greatest("sink_depth", F.lit(0.0))) * size * size).alias("sink_volume"))
    both = flat.withColumn("_g", F.lit(0)).join(volume.withColumn("_g", F.lit(0)), "_g")
    return z.join(both, "_g").drop("_g")


def raster_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cell by cell a - b where both have the cell."""
    return a.select("row", "col", F.col("value").alias("_a")).join(
        b.select("row", "col", F.col("value").alias("_b")), ["row", "col"]
    ).select("row", "col", (F.col("_a") - F.col("_b")).alias("value"))


def datum_check(a: DataFrame, b: DataFrame, expected: float = 18.0, within: float = 5.0) -> DataFrame:
    """Median difference of two rasters and whether it is the known offset between their datums."""
    d = raster_difference(a, b).withColumn("_g", F.lit(0))
    m = exact_quantiles(d, ["_g"], F.col("value"), {"median_diff": 0.5}).select("median_diff")
    near = F.abs(F.col("median_diff") - expected) < within
    return m.withColumn("verdict", F.when(near, "ellipsoidal").otherwise("orthometric"))


def histogram(df: DataFrame, value: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Counts of ``bins`` equal bins between minimum and maximum, the last one closed: bin, n, low, width."""
    keys = list(keys)
    key = keys or ["_g"]
    src = (df if keys else df.withColumn("_g", F.lit(0))).where(F.col(value).isNotNull())
    ends = src.groupBy(*key).agg(F.min(value).alias("low"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("low")) / bins
    at = F.floor((F.col(value) - F.col("low")) / F.nullif(F.col("_hi") - F.col("low"), F.lit(0.0)) * bins)
    rows = join_per_key(src, ends, key, how="inner").select(
        *key, "low", width.alias("width"), F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")
    )
    out = rows.groupBy(*key, "bin").agg(F.count("*").alias("n"), F.first("low").alias("low"), F.first("width").alias("width"))
    return out if keys else out.drop("_g")


def otsu_threshold(df: DataFrame, value: str, keys: Sequence[str], bins: int = 256) -> DataFrame:
    """Centre of the bin that best splits the histogram in two classes; the lowest bin on ties."""
    keys = list(keys)
    centre = F.col("low") + (F.col("bin") + 0.5) * F.col("width")
    h = histogram(df, value, bins, keys).select(*keys, "bin", "n", centre.alias("centre"))
    w = Window.partitionBy(*keys)  # at most ``bins`` rows per key
    up = w.orderBy("bin")
    h = h.withColumns(
        {
            "_w0": F.sum("n").over(up), "_m0": F.sum(F.col("n") * F.col("centre")).over(up),
            "_w": F.sum("n").over(w), "_m": F.sum(F.col("n") * F.col("centre")).over(w),
        }
    )
    w1 = F.col("_w") - F.col("_w0")
    mu0, mu1 = F.col("_m0") / F.col("_w0"), (F.col("_m") - F.col("_m0")) / F.nullif(w1, F.lit(0))
    between = F.coalesce(F.col("_w0") * w1 * (mu0 - mu1) * (mu0 - mu1), F.lit(0.0))
    return h.groupBy(*keys).agg(F.min_by("centre", F.struct(-between, F.col("bin"))).alias("otsu_db"))


def water_threshold(otsu: DataFrame) -> DataFrame:
    """The split value if it is plausible for open water, else the fallback."""
    ok = holds(F.col("otsu_db").between(*OTSU_BAND))
    return otsu.withColumns(
        {"threshold_db": F.when(ok, F.col("otsu_db")).otherwise(F.lit(FALLBACK_DB)), "fallback": ~ok}
    )


def despeckle(cells: DataFrame, size: int = 5, tile: int = TILE, keys: Sequence[str] = ()) -> DataFrame:
    """Median of the size x size neighbourhood, mirrored at the border of the raster.

    Missing cells, with a row or without one, count as the median of the whole raster and are missing again
    afterwards. The raster is the smallest rectangle that holds all cells.
    """
    keys = list(keys)
    reach = size // 2
    key = keys or ["_g"]
    src = cells if keys else cells.withColumn("_g", F.lit(0))
    box = src.groupBy(*key).agg(*[f(c).alias(n) for n, f, c in (("_r0", F.min, "row"), ("_r1", F.max, "row"), ("_c0", F.min, "col"), ("_c1", F.max, "col"))])
    mid = exact_quantiles(src, key, F.col("value"), {"_mid": 0.5}).select(*key, "_mid")
    src = join_per_key(src, box.join(mid, key, "left"), key)
    # Where a tile lies in its raster is the same for all its cells: the distance of a cell from each side.
    side = {"_up": F.col("row") - F.col("_r0"), "_down": F.col("_r1") - F.col("row"), "_left": F.col("col") - F.col("_c0"), "_right": F.col("_c1") - F.col("col")}
    src = src.select(*key, "row", "col", "value", "_mid", *[c.alias(n) for n, c in side.items()])

    def compute(v, mid, up, down, left, right, exists):
        n, m = v.shape
        r, c = (int(x[0]) for x in np.nonzero(exists))
        # First and last row and column of the raster inside this array.
        r0, r1 = max(0, r - int(up[r, c])), min(n, r + int(down[r, c]) + 1)
        c0, c1 = max(0, c - int(left[r, c])), min(m, c + int(right[r, c]) + 1)
        full = np.where(np.isnan(v), mid[r, c], v)[r0:r1, c0:c1]
        block = np.pad(full, reach, mode="symmetric")
        out = np.full(v.shape, np.nan)
        out[r0:r1, c0:c1] = np.median(np.lib.stride_tricks.sliding_window_view(block, (size, size)), axis=(2, 3))
        return {"smooth": np.where(np.isnan(v), np.nan, out)}

    done = stencil(src, ["value", "_mid", *side], {"smooth": "double"}, compute, reach, tile, key)
    done = done.withColumnRenamed("smooth", "value")
    return done if keys else done.drop("_g")


def reference_stack(scenes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Median over scenes per cell, missing skipped; a cell has as many values as there are scenes."""
    return scenes.groupBy(*keys, "row", "col").agg(F.median("value").alias("value"))


def flood_mask(event: DataFrame, reference: DataFrame, land: DataFrame, terrain: DataFrame,
               event_db: Column, reference_db: Column) -> DataFrame:
    """Land cells that are water in the event but not in the reference, above the sea level of the terrain.

    ``event_db`` and ``reference_db`` are thresholds (literals or columns). ``land`` lists land cells.
    """
    e = event.select("row", "col", F.col("value").alias("_e"))
    r = reference.select("row", "col", F.col("value").alias("_r"))
    t = terrain.select("row", "col", F.col("value").alias("_z"))
    rows = land.select("row", "col").join(e, ["row", "col"]).join(r, ["row", "col"], "left").join(t, ["row", "col"], "left")
    flood = holds(F.col("_e") < event_db) & ~holds(F.col("_r") < reference_db) & ~holds(F.col("_z") <= SEA_LEVEL_M)
    return rows.where(flood).select("row", "col")


def blobs(mask: DataFrame) -> DataFrame:
    """Cells with the id of their four-connected blob (its smallest cell id)."""
    m = mask.select("row", "col", cell_id(F.col("row"), F.col("col")).alias("node"))
    links = m.select("node", F.explode(F.array(
        F.struct((F.col("row") + 1).alias("r"), F.col("col").alias("c")),
        F.struct(F.col("row").alias("r"), (F.col("col") + 1).alias("c")),
    )).alias("_to")).select(F.col("node").alias("u"), cell_id(F.col("_to.r"), F.col("_to.c")).alias("v"))
    links = links.join(m.select(F.col("node").alias("v")), "v", "left_semi")
    return m.join(connected_components(links, "u", "v", m), "node").select("row", "col", F.col("component").alias("blob"))


def drop_small_blobs(mask: DataFrame, min_cells: int = MIN_BLOB, cell_m2: float | None = None, min_m2: float = MIN_AREA_M2) -> DataFrame:
    """Mask without blobs of fewer than ``min_cells`` cells, or below ``min_m2`` when the cell area is given."""
    b = blobs(mask)
    n = b.groupBy("blob").agg(F.count("*").alias("_n"))
    ok = F.col("_n") >= min_cells
    if cell_m2 is not None:
        ok = ok & (F.col("_n") * cell_m2 >= min_m2)
    return join_per_key(b, n.where(ok), ["blob"], how="inner").select("row", "col", "blob")


def flood_summary(mask: DataFrame, land: DataFrame, cell_km2: float, max_pct: float = 30.0, min_km2: float = 0.05) -> DataFrame:
    """Flood area, share of the land, and whether the result looks implausible."""
    f = mask.agg(F.count("*").alias("_f")).withColumn("_g", F.lit(0))
    l = land.agg(F.count("*").alias("_l")).withColumn("_g", F.lit(0))
    km2, pct = F.col("_f") * cell_km2, F.try_divide(F.col("_f") * 100, F.col("_l"))
    return f.join(l, "_g").select(
        km2.alias("flood_km2"), pct.alias("flood_pct"), holds((pct > max_pct) | (km2 < min_km2)).alias("implausible")
    )


def district_floods(placed: DataFrame, districts: DataFrame, official: DataFrame, cell_ha: float, name: str = "place") -> DataFrame:
    """Per district: flooded hectares (0 if none) and official count (NULL if none).

    ``placed`` are flood cells with their district, ``official`` has the upper-case name and n.
    """
    ha = placed.where(F.col(name).isNotNull()).groupBy(name).agg((F.count("*") * cell_ha).alias("_ha"))
    out = districts.select(name).distinct().join(ha, name, "left")
    o = official.select(F.col(name).alias("_up"), "n")
    return out.join(o, F.upper(name) == F.col("_up"), "left").select(
        name, F.round(F.coalesce("_ha", F.lit(0.0)), 3).alias("flood_ha"), F.col("n").alias("official_n")
    )
