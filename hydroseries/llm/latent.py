"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages and weighted by TF-IDF (document frequencies over all documents). A randomised SVD of all
passages gives one latent space: Spark adds up the products of the passages' matrix with random directions, once to find the
space and once to turn it, and what comes to the driver is terms x rank numbers. Windows of every document are
folded into the space; those near an item by cosine are candidates. The rank is fixed, so an item keeps a share of its length
only; the cosine is taken against that share, and a copy scores alike however many items share the space.
The longest common subsequence of the words decides on candidates, together with a check that the item's ending, which holds
the answer, is there as well. So light paraphrases are found too: changed, missing or added words lower the measure and do not break it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hydroseries.llm.common import Buffer, WordIds, map_batches, rows_of, texts
from hydroseries.session import cut_lineage

BITS = 15
TERMS = 1 << BITS
BLOCK = 16
WIDTHS = (1, 2, 4)
_MARKS = bytes.maketrans(b".,;:!?()[]{}\"'|#$%&*", b" " * 20)


def words_of(text: bytes | None) -> list[bytes]:
    """Words lower-cased in A-Z, common marks as spaces."""
    return (text or b"").lower().translate(_MARKS).split()


def term(word: bytes) -> int:
    return zlib.crc32(word) & (TERMS - 1)


def common_length(masks: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence of ``words`` and an item of n words, whose places ``masks`` holds as bits."""
    row = (1 << n) - 1
    full = row
    for w in words:
        m = masks.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def place_masks(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def inverse_frequencies(rows: DataFrame) -> np.ndarray:
    """idf of every hashed term over all of ``rows`` (as from ``common.texts``); as many numbers come back as there are terms."""

    def run(batches):
        ids, sums = WordIds(term), np.zeros(TERMS + 1, dtype=np.int64)
        for (text,) in rows_of(batches, "text"):
            found = {ids[w] for w in set(words_of(text))}
            if found:
                sums[list(found)] += 1
            sums[TERMS] += 1
        at = np.flatnonzero(sums)
        yield {"at": at.astype(np.int32), "n": sums[at]}

    got = map_batches(rows, run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(TERMS + 1)
    n[got["at"].to_numpy()] = got["n"].to_numpy()
    return np.log((n[TERMS] + 1) / (n[:TERMS] + 1)) + 0.05


def item_passages(benchmark: DataFrame, idf: np.ndarray, id_col: str, text_col: str, most: int = 64, least: int = 4) -> DataFrame:
    """item_id, words, at, v: passages of up to ``most`` words and their unit TF-IDF vectors; shorter ones than ``least`` give none."""
    shared = benchmark.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        out = Buffer("item_id", "words", "at", "v")
        for item, text in rows_of(batches, "doc_id", "text"):
            words = words_of(text)
            pieces = max(1, -(-len(words) // most))
            for k in range(pieces):
                part = words[k * len(words) // pieces : (k + 1) * len(words) // pieces]
                if len(part) < least:
                    continue
                at, n = np.unique(np.array([term(w) for w in part]), return_counts=True)
                v = n * shared.value[at]
                out.add(item, part, at.astype(np.int32), v / np.linalg.norm(v))
            if out.full():
                yield out.take()
        yield out.take()

    schema = "item_id long, words array<binary>, at array<int>, v array<double>"
    return cut_lineage(map_batches(texts(benchmark, id_col, text_col), run, schema))


def _directions(rank: int) -> np.ndarray:
    """Random directions over all terms, the same in every task."""
    return np.random.default_rng(5).standard_normal((TERMS, rank)).astype(np.float32)


def _products(passages: DataFrame, space: np.ndarray | None, rank: int) -> np.ndarray:
    """The passages' matrix, turned over, times itself times ``space`` (random directions if None): terms x rank.

    A task adds up its passages and sends a row per term in use; rows of a term are added up by Spark's shuffle.
    """
    given = None if space is None else passages.sparkSession.sparkContext.broadcast(space)

    def local(batches):
        known = _directions(rank) if given is None else given.value
        sums: dict[int, np.ndarray] = {}
        for at, v in rows_of(batches, "at", "v"):
            v = np.array(v)
            along = v @ known[at]
            for t, x in zip(at, v):
                if t in sums:
                    sums[t] += x * along
                else:
                    sums[t] = x * along
        yield {"at": list(sums), "z": [x.tobytes() for x in sums.values()]}

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for at, z in rows_of(batches, "at", "z"):
            x = np.frombuffer(z)
            sums[at] = sums[at] + x if at in sums else x
        yield {"at": list(sums), "z": [x.tobytes() for x in sums.values()]}

    schema = "at int, z binary"
    met = map_batches(map_batches(passages.select("at", "v"), local, schema).repartition("at"), total, schema)
    out = np.zeros((TERMS, rank))
    for r in met.collect():
        out[r["at"]] = np.frombuffer(r["z"])
    return out


def latent_space(passages: DataFrame, rank: int, spare: int = 8) -> np.ndarray:
    """The ``rank`` leading right singular vectors of the passages (terms x rank), by a randomised SVD with one power step."""
    wide = rank + spare
    basis, _ = np.linalg.qr(_products(passages, None, wide))
    product = _products(passages, basis.astype(np.float32), wide)
    values, turn = np.linalg.eigh(basis.T @ product)
    best = np.argsort(-values)[:rank]
    best = best[values[best] > 1e-6 * max(values.max(initial=0), 1e-12)]
    return basis @ turn[:, best]


def better(hit: tuple[float, float, float, int], was: tuple[float, float, float, int]) -> bool:
    """More of the item, then nearer, then earlier."""
    return (hit[1], hit[0], -hit[3]) > (was[1], was[0], -was[3])


class Searcher:
    """Finds the benchmark passages of one part in texts. Holds the items' words and latent vectors."""

    def __init__(self, items: list[tuple[int, list[bytes], np.ndarray, np.ndarray]], idf: np.ndarray, space: np.ndarray, cosine: float,
                 sure: float, likely: float, answer: float):
        self.limit, self.sure, self.likely, self.answer = cosine, sure, likely, answer
        self.items = [(i, w) for i, w, _, _ in items]
        # A vector is of length 1; what the space keeps of it is ``share``. Divided by its square, a copy of the item has the
        # same product with it as with the whole vector.
        kept = np.array([v @ space[at] for _, _, at, v in items]).reshape(len(items), space.shape[1])
        share = np.linalg.norm(kept, axis=1, keepdims=True)
        self.queries = (kept / np.maximum(share, 1e-3) ** 2).astype(np.float32)
        self.longest = float(np.linalg.norm(self.queries, axis=1).max(initial=1e-9))
        self.idf, self.space = idf, space.astype(np.float32)

    def prepare(self) -> None:
        """What is cheaper to make in a task than to send there."""
        self.ids = WordIds(term)
        self.squares = np.concatenate([self.idf ** 2, [0]]).astype(np.float32)
        used = np.flatnonzero(np.abs(self.space).max(axis=1, initial=0) > 1e-9)
        self.fold = self.space[used] * self.idf[used, None].astype(np.float32)
        self.slot = np.full(TERMS + 1, -1, dtype=np.int32)  # the last one pads; other terms are in no passage
        self.slot[used] = np.arange(len(used))
        self.masks = [place_masks(w) for _, w in self.items]
        self.bags = [Counter(w) for _, w in self.items]
        self.sets = [frozenset(w) for _, w in self.items]
        self.tails = [w[-max(1, len(w) // 3) :] for _, w in self.items]
        self.tail_masks = [place_masks(t) for t in self.tails]

    def windows(self, batch: list[list[bytes]]) -> Iterator[tuple[np.ndarray, ...]]:
        """text, first block, blocks, item place and cosine of every window near an item, many at a time."""
        ids, flat, ends, owner = self.ids, [], [], []
        for k, words in enumerate(batch):
            blocks = -(-len(words) // BLOCK)
            flat.extend([ids[w] for w in words])
            flat.extend([TERMS] * (blocks * BLOCK - len(words)))
            owner.append(np.full(blocks, k))
            ends.append(np.full(blocks, blocks))
        if not flat or not len(self.items):
            return
        flat = np.array(flat)
        owner = np.concatenate(owner)
        sizes = np.concatenate(ends)
        first = np.searchsorted(owner, owner)
        n = len(owner)
        place = np.arange(n)
        stop = first + sizes
        norms = np.zeros(n + 1)
        np.cumsum(self.squares[flat].reshape(n, BLOCK).sum(axis=1), out=norms[1:])
        slots = self.slot[flat]
        used = np.flatnonzero(slots >= 0)
        if not len(used):
            return
        latent = np.zeros((n + 1, self.fold.shape[1]), dtype=np.float32)
        block = used // BLOCK
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        latent[block[starts] + 1] = np.add.reduceat(self.fold[slots[used]], starts, axis=0)
        np.cumsum(latent, axis=0, out=latent)
        for width in WIDTHS:
            over = np.minimum(place + width, stop)
            size = np.sqrt(norms[over] - norms[place])
            v = latent[over] - latent[place]
            # No product with an item can be larger than that of the lengths.
            near = np.flatnonzero((np.sqrt(np.einsum("ij,ij->i", v, v)) * self.longest >= self.limit * size) & (size > 0))
            for some in np.array_split(near, max(1, len(near) * len(self.items) // 4_000_000)):
                cosines = (v[some] / size[some, None]).astype(np.float32) @ self.queries.T
                a, q = np.nonzero(cosines >= self.limit)
                i = some[a]
                yield owner[i], place[i] - first[i], over[i] - place[i], q, np.minimum(cosines[a, q], 1.0)

    def stretches(self, batch: list[list[bytes]]) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
        """(text, item place, [(first block, blocks, cosine)]): windows of one item that touch each other, together."""
        found = list(self.windows(batch))
        if not found:
            return
        text, start, size, q, cosine = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((start, q, text))
        key, stop, held = None, 0, []
        for t, x, n, i, c in zip(*(v[order].tolist() for v in (text, start, size, q, cosine))):
            if key != (t, i) or x > stop:
                if held:
                    yield *key, held
                key, stop, held = (t, i), 0, []
            held.append((x, n, c))
            stop = max(stop, x + n)
        if held:
            yield *key, held

    def hits(self, batch: list[list[bytes]]) -> list[dict[int, tuple[float, float, float, int]]]:
        """Per text: item id -> (cosine, part of the item's words in order, part of its ending, first word)."""
        out: list[dict] = [{} for _ in batch]
        for k, q, near in self.stretches(batch):
            item, words = self.items[q]
            n, bag, own, text = len(words), self.bags[q], self.sets[q], batch[k]

            def region(at, blocks):
                return text[max(0, at * BLOCK - n // 2 - BLOCK // 2) : (at + blocks) * BLOCK + n // 2 + BLOCK // 2]

            def enough(part):
                """No subsequence can be longer than the item's words that are there at all."""
                return sum([bag[w] for w in own.intersection(part)]) >= self.likely * n

            if not enough(region(near[0][0], max(x + b for x, b, _ in near) - near[0][0])):
                continue
            for at, blocks, cosine in near:
                part_of = region(at, blocks)
                if not enough(part_of):
                    continue
                part = common_length(self.masks[q], n, part_of) / n
                if part < self.likely:
                    continue
                tail = common_length(self.tail_masks[q], len(self.tails[q]), part_of) / len(self.tails[q])
                if part >= self.sure or tail >= self.answer:
                    hit = (cosine, part, tail, at * BLOCK)
                    if item not in out[k] or better(hit, out[k][item]):
                        out[k][item] = hit
        return out


class Parts:
    """The benchmark as searchers of bounded size, each broadcast by itself; a task holds one at a time.

    The driver collects a part's passages only, and documents never.
    """

    def __init__(self, rows: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text", rank: int = 96,
                 cosine: float = 0.35, sure: float = 0.75, likely: float = 0.6, answer: float = 0.75, most: int = 4096):
        """``rows`` as from ``common.texts``; a part has about ``most`` passages (64 words each), ``rank`` is that of the space of all."""
        idf = inverse_frequencies(rows)
        passages = item_passages(benchmark, idf, item_col, item_text)
        parts = -(-passages.count() // most)
        space = latent_space(passages, rank) if parts else np.zeros((TERMS, 0))
        # Equal passages of an item are found alike, so one will do: what is left is dealt evenly.
        placed = passages.dropDuplicates(["item_id", "words"]).withColumn("_part", F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)))
        if parts > 1:
            placed = cut_lineage(placed)
        self.held = None
        self.shared = []
        for k in range(parts):
            found = sorted(
                ((r["item_id"], [bytes(w) for w in r["words"]], np.array(r["at"]), np.array(r["v"])) for r in placed.where(F.col("_part") == k).collect()),
                key=lambda r: (r[0] is None, r[0] or 0, r[1]),
            )
            if found:
                searcher = Searcher(found, idf, space, cosine, sure, likely, answer)
                self.shared.append(benchmark.sparkSession.sparkContext.broadcast(searcher))

    def searchers(self) -> Iterator[Searcher]:
        """In a task: every part, made ready; the one before is let go of."""
        for k, part in enumerate(self.shared):
            if self.held is None or self.held[0] != k:
                self.held = None
                searcher = part.value
                part.__dict__.pop("_value", None)  # or the worker would keep them all
                searcher.prepare()
                self.held = k, searcher
            yield self.held[1]

    def hits(self, texts: list[bytes | None]) -> Iterator[dict[int, tuple[float, float, float, int]]]:
        """Per text: what ``Searcher.hits`` finds in all parts together."""
        words = [words_of(t) for t in texts]
        out: list[dict] = [{} for _ in words]
        for s in self.searchers():
            for was, hits in zip(out, (h for part in _groups(words) for h in s.hits(part))):
                for item, hit in hits.items():
                    if item not in was or better(hit, was[item]):
                        was[item] = hit
        return iter(out)


def _groups(words: list[list[bytes]], most: int = 24_000) -> Iterator[list[list[bytes]]]:
    part, held = [], 0
    for w in words:
        if part and held + len(w) > most:
            yield part
            part, held = [], 0
        part.append(w)
        held += len(w)
    if part:
        yield part


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", **options,
) -> DataFrame:
    """doc_id, item_id, cosine, coverage, answer_coverage, first_word: a row per document and item found in it.

    A passage of an item counts as found if ``sure`` of its words are there in order, or ``likely`` of them and ``answer`` of
    its last third. Texts of no words, and items of fewer than four, match nothing. Null text counts as empty; null or repeated
    ids are rows like others. Without documents or items: no rows. A benchmark of any size is searched whole, part by part.
    """
    rows = texts(docs, id_col, text_col)
    parts = Parts(rows, benchmark, item_col, item_text, **options)

    def run(batches):
        out = Buffer("doc_id", "item_id", "cosine", "coverage", "answer_coverage", "first_word")
        for b in batches:
            who = b.column(b.schema.get_field_index("doc_id")).to_pylist()
            for doc, hits in zip(who, parts.hits(b.column(b.schema.get_field_index("text")).to_pylist())):
                for item, (cosine, share, tail, at) in hits.items():
                    out.add(doc, item, round(cosine, 4), round(share, 6), round(tail, 6), at)
            yield out.take()

    schema = "doc_id long, item_id long, cosine double, coverage double, answer_coverage double, first_word int"
    return map_batches(rows, run, schema)


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", **options,
) -> DataFrame:
    """The rows of ``docs`` in which no item is found; they pass through, so nothing is shuffled."""
    parts = Parts(texts(docs, id_col, text_col), benchmark, item_col, item_text, **options)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = [not hits for hits in parts.hits(b.column(place).cast(pa.binary()).to_pylist())]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)))
