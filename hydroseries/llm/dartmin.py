"""Near-duplicates by DartMinHash.

A text is a weighted set: its distinct shingles of five words, each with its number of occurrences. Every element's
region (weight axis times rank axis) has darts thrown at it by hashing, the same darts wherever the element occurs. A
dart that lies below the element's weight counts; the earliest dart per coordinate makes the signature, and two
signatures agree in a coordinate with the probability of the weighted Jaccard similarity. Only the ranks a text needs
are thrown, so the work is about the number of elements plus k ln k, not their product.

Texts that share a band of the signature are compared by signature within their bucket; what may be similar forms
clusters. Within a cluster the whole shingle sets are compared exactly; texts that links connect form a class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries.llm.common import Buffer, WordIds, gram_hashes, hash64, map_batches, mix, packed, rows_of, signed, texts
from hydroseries.operators.graph import connected_components
from hydroseries.session import cut_lineage

SHINGLE = 5
THRESHOLD = 0.8
K = 144
BANDS, ROWS = 24, 6  # at a similarity of 0.8 a pair shares no band with a probability below 0.001
FIRST = -14  # the lowest stretch of ranks is [0, 2^FIRST); each further one doubles what is thrown
#: Texts meet in a cluster from this share of equal coordinates on: 3.5 standard deviations below the threshold.
LIKELY = THRESHOLD - 3.5 * (THRESHOLD * (1 - THRESHOLD) / K) ** 0.5
#: Texts, and shingles of texts, in one block of a group.
BLOCK, UNITS = 2000, 2_000_000


def _stretch(level: int) -> tuple[float, float]:
    return (0.0 if level == 0 else 2.0 ** (FIRST + level - 1)), 2.0 ** (FIRST + level)


class Darts:
    """Signatures of weighted sets; tables of the dart counts are made as levels are needed."""

    def __init__(self, k: int = K):
        self.k, self.tables = k, {}

    def _table(self, level: int) -> np.ndarray:
        """Distribution function of the number of darts per unit of weight: Poisson."""
        if level not in self.tables:
            low, high = _stretch(level)
            mean = self.k * (high - low)
            n = np.arange(int(mean + 12 * mean ** 0.5 + 20))
            logs = -mean + n * np.log(mean) - np.concatenate([[0], np.cumsum(np.log(n[1:]))])
            self.tables[level] = np.cumsum(np.exp(logs))
        return self.tables[level]

    def throw(self, units: np.ndarray, fill: np.ndarray | None, level: int):
        """Coordinate, rank and identity of the darts of one stretch that hit. ``units``: keys of unit slabs of weight;
        ``fill``: how much of each slab the weight covers, None for all of it."""
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        chance = (mix(units + salt) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        counts = np.searchsorted(self._table(level), chance, side="right")
        some = np.flatnonzero(counts)
        counts = counts[some]
        source = np.repeat(some, counts)
        nth = np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts)
        dart = mix(units[source] ^ mix(salt + nth.astype(np.uint64)))
        if fill is not None:
            height = (mix(dart + np.uint64(7)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            hit = height < fill[source]
            dart = dart[hit]
        low, high = _stretch(level)
        rank = low + (high - low) * ((dart >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        place = (mix(dart + np.uint64(3)) % np.uint64(self.k)).astype(np.int64)
        return place, rank, dart

    def signature(self, elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """k dart identities; ``elements`` distinct 64-bit keys, ``weights`` above 0."""
        slabs = np.ceil(weights).astype(np.int64)
        source = np.repeat(np.arange(len(elements)), slabs)
        nth = np.arange(len(source)) - np.repeat(np.cumsum(slabs) - slabs, slabs)
        units = unit_keys(elements[source], nth)
        fill = np.minimum(1.0, weights[source] - nth)
        fill = None if (fill == 1).all() else fill
        need = (np.log(self.k) + 2) / max(float(weights.sum()), 1e-6)
        top = max(0, int(np.ceil(np.log2(need))) - FIRST)
        parts = [self.throw(units, fill, level) for level in range(top + 1)]
        while True:
            place, rank, dart = (np.concatenate(x) for x in zip(*parts))
            if len(np.unique(place)) == self.k:
                break
            top += 1
            parts.append(self.throw(units, fill, top))
        out = np.empty(self.k, dtype=np.uint64)
        order = np.argsort(-rank, kind="stable")
        out[place[order]] = dart[order]  # the last one written has the lowest rank
        return out


def unit_keys(elements: np.ndarray, nth: np.ndarray) -> np.ndarray:
    return mix(elements + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_counts(words: list[bytes], ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their counts. A text of fewer than five words is one shingle; without words there is none."""
    if not words:
        return np.empty(0, dtype=np.uint64), np.empty(0)
    x = np.array([ids[w] for w in words], dtype=np.uint64)
    return np.unique(gram_hashes(x, min(SHINGLE, len(x))), return_counts=True)


def unit_set(words: list[bytes], ids: WordIds) -> np.ndarray:
    """The weighted set as a plain one: (shingle, n-th occurrence). Its Jaccard similarity is the weighted one."""
    grams, counts = shingle_counts(words, ids)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return unit_keys(np.repeat(grams, counts), nth)


def _node(words: list[bytes]) -> int:
    """Texts of equal words are one node: 64 bits of their SHA-256."""
    return int.from_bytes(hashlib.sha256(b" ".join(words)).digest()[:8], "big", signed=True)


def signatures(rows: DataFrame) -> DataFrame:
    """doc_id, node, n (weight in all), bands, sig (one byte per coordinate); without words: node, bands and sig null."""

    def run(batches):
        darts, ids = Darts(), WordIds(hash64)
        out = Buffer("doc_id", "node", "n", "bands", "sig")
        done: dict[int, tuple] = {}  # copies met again in the task are not computed again
        for who, text in rows_of(batches, "doc_id", "text"):
            words = (text or b"").split()
            if not words:
                out.add(who, None, 0, None, None)
                continue
            node = _node(words)
            made = done.get(node)
            if made is None:
                grams, counts = shingle_counts(words, ids)
                s = darts.signature(grams, counts.astype(float))
                b = s[: BANDS * ROWS].reshape(BANDS, ROWS)
                key = np.arange(BANDS, dtype=np.uint64)
                for r in range(ROWS):
                    key = mix(key * np.uint64(31) + b[:, r])
                made = (int(counts.sum()), signed(key), (s >> np.uint64(40)).astype(np.uint8).tobytes())
                if len(done) > 20_000:
                    done.clear()
                done[node] = made
            out.add(who, node, *made, size=500)
            if out.full():
                yield out.take()
        yield out.take()

    return map_batches(rows, run, "doc_id long, node long, n long, bands array<long>, sig binary")


def connect(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the graph whose neighbours ``near(place, others)`` tells (a truth value each).

    One place after the other is compared with all that are not yet connected to it, first of all those outside the
    largest component. At the end every place outside it was compared with all others, so no connection is missing,
    while a group of copies of one original takes few comparisons.
    """
    label, done = np.arange(n), np.zeros(n, dtype=bool)
    while True:
        size = np.bincount(label, minlength=n)
        open_ = np.flatnonzero(~done & (label != size.argmax()))
        if not done.any():
            open_ = np.arange(n)
        if not len(open_):
            return
        hub = int(open_[0])
        done[hub] = True
        others = np.flatnonzero(label != label[hub])
        if not len(others):
            return
        hits = others[near(hub, others)]
        if not len(hits):
            continue
        labels, first = np.unique(label[hits], return_index=True)
        yield from ((hub, int(x)) for x in hits[first])
        label[np.isin(label, labels)] = label[hub]


def _streamed(groups: DataFrame, key: list[str], columns: list[str], edges) -> DataFrame:
    """u, v: what ``edges`` yields for the rows of each group; rows of a group follow each other in a sorted partition."""

    def run(batches):
        out, held, now = Buffer("u", "v"), [], None

        def flush():
            if len(held) > 1:
                for u, v in edges(held):
                    out.add(u, v)

        for row in rows_of(batches, *key, *columns):
            if row[: len(key)] != now:
                flush()
                held, now = [], row[: len(key)]
                if out.full():
                    yield out.take()
            held.append(row[len(key) :])
        flush()
        yield out.take()

    dealt = groups.select(*key, *columns).repartition(*key).sortWithinPartitions(*key)
    return map_batches(dealt, run, "u long, v long")


def _blocks(members: DataFrame, count: Column, size: Column | None = None) -> DataFrame:
    """Add i, j: a group of more than ``BLOCK`` texts (or ``UNITS`` shingles) is compared in pairs of blocks."""
    n = F.ceil(count / BLOCK)
    n = F.greatest(F.lit(1), n if size is None else F.greatest(n, F.ceil(size / UNITS))).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("_n")).cast("int")
    others = F.when(F.col("_n") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda x: x != F.col("_own"))
    )
    dealt = members.withColumn("_n", n).withColumn("_own", own).withColumn("_other", F.explode(others))
    return dealt.withColumns({"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other")}).drop("_n", "_own", "_other")


def _similar_size(sizes: np.ndarray, hub: int, others: np.ndarray) -> np.ndarray:
    return np.minimum(sizes[others], sizes[hub]) >= THRESHOLD * np.maximum(sizes[others], sizes[hub])


def _likely_edges(held: list[tuple]) -> Iterator[tuple[int, int]]:
    """node, n, sig of a bucket -> a forest over pairs whose signatures may belong to similar sets."""
    held = sorted(held)
    sizes = np.array([r[1] for r in held])
    sig = np.frombuffer(b"".join(r[2] for r in held), dtype=np.uint8).reshape(len(held), -1)

    def near(hub, others):
        same = (sig[others] == sig[hub]).mean(axis=1)
        same = (same - 1 / 256) / (1 - 1 / 256)  # bytes agree by chance
        return (same >= LIKELY) & _similar_size(sizes, hub, others)

    for x, y in connect(len(held), near):
        yield held[x][0], held[y][0]


def _exact_edges(held: list[tuple]) -> Iterator[tuple[int, int]]:
    """node, units of a cluster -> a forest over pairs whose whole sets reach the threshold."""
    held = sorted(held)
    sizes = np.array([len(r[1]) for r in held])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    distinct, flat = np.unique(np.concatenate([np.asarray(r[1]) for r in held]), return_inverse=True)
    flat = flat.astype(np.int32)
    mark = np.zeros(len(distinct), dtype=bool)

    def near(hub, others):
        out = np.zeros(len(others), dtype=bool)
        fit = np.flatnonzero(_similar_size(sizes, hub, others))
        if not len(fit):
            return out
        own = flat[starts[hub] : starts[hub + 1]]
        mark[own] = True
        if len(fit) * 2 > len(held):
            common = np.add.reduceat(mark[flat].astype(np.int64), starts[:-1])[others[fit]]
        else:
            common = np.array([np.count_nonzero(mark[flat[starts[o] : starts[o + 1]]]) for o in others[fit]])
        mark[own] = False
        out[fit] = common * 10 >= (sizes[others[fit]] + sizes[hub] - common) * int(THRESHOLD * 10)
        return out

    for x, y in connect(len(held), near):
        yield held[x][0], held[y][0]


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, node, n, _class (the same for the rows of a class; null for a text without words): one row per row of ``docs``."""
    rows = texts(docs, id_col, text_col)
    made = cut_lineage(signatures(rows))
    # Copies are folded before bands are dealt, so a group of copies is one row of each of its buckets.
    nodes = made.where(F.col("node").isNotNull()).groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "bands", "sig")])
    nodes = cut_lineage(nodes)
    exploded = nodes.select("node", F.explode("bands").alias("h"))
    shared = exploded.groupBy("h").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi"), F.count("*").alias("texts"))
    shared = shared.where(F.col("_lo") != F.col("_hi")).select("h", "texts")
    members = exploded.join(shared, "h")
    nodes = nodes.select("node", "n", "sig")
    buckets = _blocks(members.join(nodes, "node"), F.col("texts"))
    likely = _streamed(buckets, ["h", "i", "j"], ["node", "n", "sig"], _likely_edges)
    clusters = cut_lineage(connected_components(likely))

    ids = made.join(clusters, "node", "left_semi").select(F.col("doc_id").alias("_id")).distinct()
    whole = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def run(batches):
        ids_, out, seen = WordIds(hash64), Buffer("node", "units"), set()
        for (text,) in rows_of(batches, "text"):
            words = (text or b"").split()
            node = _node(words)
            if node in seen or not words:
                continue
            seen.add(node)
            units = signed(unit_set(words, ids_))
            out.add(node, units, size=8 * len(units))
            if out.full():
                yield out.take()
        yield out.take()

    sizes = clusters.join(nodes, "node").groupBy("component").agg(F.count("*").alias("_count"), F.sum("n").alias("_units"))
    placed = _blocks(clusters.join(sizes, "component"), F.col("_count"), F.col("_units"))
    sets = map_batches(whole, run, "node long, units array<long>").dropDuplicates(["node"])
    exact = _streamed(sets.join(placed, "node"), ["component", "i", "j"], ["node", "units"], _exact_edges)
    joined = connected_components(exact)
    return made.join(joined, "node", "left").select("doc_id", "node", "n", F.coalesce("component", "node").alias("_class"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node, class_id, class_size, n_shingles: one row per row of ``docs``.

    Two texts are linked if the weighted Jaccard similarity of their five-word shingles is 0.8 or more; classes are what links
    connect, ``class_id`` the smallest doc_id in it. Texts of equal words are one node, whatever their number, so copies are never
    paired. A text of fewer than five words is one shingle and equals only its copies. A text without words (null, empty)
    is a class of its own: node null, class_id its id, size 1. Repeated rows are copies. A class of null ids has a null class_id.
    """
    labelled = _labelled(docs, id_col, text_col)
    sizes = labelled.where(F.col("_class").isNotNull()).groupBy("_class").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")
    )
    out = labelled.join(sizes, "_class", "left")
    return out.select(
        "doc_id", "node", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.col("n").alias("n_shingles"),
    )


def _nodes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        words = [(t or b"").split() for t in part]
        yield pd.Series([_node(w) if w else None for w in words], dtype="Int64")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which exactly one per class stays, that of the smallest id, a null id last; texts without words all stay.

    A row goes by its id and its words together, so another text of the same id stays. Where that id has several texts in the
    class, one of them stays; of repeated rows the smallest by all columns written as JSON (further columns may be maps).
    """
    labelled = _labelled(docs, id_col, text_col).where(F.col("node").isNotNull())
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("node").alias("node"))
    first = labelled.groupBy("_class").agg(F.min(rank).alias("_first"), F.count("*").alias("_size")).where("_size > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("_first.id")) & (F.col("node") == F.col("_first.node"))
    marks = labelled.join(first, "_class").groupBy(F.col("doc_id").alias("_id"), F.col("node").alias("_node"))
    marks = cut_lineage(marks.agg(F.first(stays).alias("_stays"), F.count("*").alias("_rows")).where("not _stays or _rows > 1"))
    node = F.pandas_udf(_nodes, "long")(F.col(f"`{text_col}`").cast("binary"))
    keyed = packed(docs, doc_id=F.col(f"`{id_col}`").cast("long"), node=node)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("node") == F.col("_node"))
    again = marks.where("_stays")
    if again.isEmpty():
        return keyed.join(marks, same, "left_anti").select("_row.*")
    once = keyed.join(again, same, "left_semi").groupBy("doc_id", "node").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return keyed.join(marks, same, "left_anti").select("_row.*").unionByName(once.select("_row.*"))
