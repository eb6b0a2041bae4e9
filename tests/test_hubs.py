"""Hub labels: distances of asked pairs up to a limit."""

import heapq
import random

from hydroseries.operators import graph


def dijkstra(links, start):
    best, todo = {start: 0}, [(0, start)]
    while todo:
        d, n = heapq.heappop(todo)
        for o, w in links.get(n, ()):
            if d == best[n] and d + w < best.get(o, 1 << 60):
                best[o] = d + w
                heapq.heappush(todo, (d + w, o))
    return best


def test_labels_of_a_grid_with_holes(spark):
    """Whole lengths, so sums are exact; repeated links, loops and terminals without links."""
    rng = random.Random(3)
    side = 5
    rows = []
    for i in range(side):
        for j in range(side):
            for o in ((i + 1, j), (i, j + 1)):
                if o[0] < side and o[1] < side and rng.random() < 0.85:
                    rows.append((i * side + j, o[0] * side + o[1], float(rng.randint(1, 9))))
    rows += [(0, 1, 99.0), (5, 5, 1.0), (500, 501, 2.0)]
    links = {}
    for a, b, w in rows:
        links.setdefault(a, []).append((b, w))
        links.setdefault(b, []).append((a, w))
    terminals = [*range(0, side * side, 4), 500, 501, 900]
    want = {}
    for a in terminals:
        for b, d in dijkstra(links, a).items():
            if a < b and b in terminals:
                want[a, b] = d
    df = spark.createDataFrame(rows, "u long, v long, length_m double")
    t = spark.createDataFrame([(x,) for x in terminals], "node long")
    asked = [(b, a) for a in terminals for b in terminals]
    pairs = spark.createDataFrame(asked, "node_a long, node_b long")
    found = {(r.node_a, r.node_b): r.length_m for r in graph.path_lengths(df, t, shrink=False, pairs=pairs, limit=25.0).collect()}
    assert found == {k: d for k, d in want.items() if d <= 25} and len(found) < len(want)
