"""Cross-tokenizer alignment with external spill counting.

1. Encode. Texts fall into segments at single spaces between other characters. No token of either vocabulary lies across
   such a place (``Pair`` refuses a vocabulary where one could), so a segment is encoded once and looked up afterwards, with its
   groups and links. Texts of one task make chunks; the links of a chunk, as records (pair, document, times) in order of B id, A id
   and document, are cut by B id into radix parts, each a run under zstd.
2. Count. A task gets runs of one radix part up to a bounded size - a part with more is given to several tasks - and merges them
   over a heap: B id by B id it takes the slices of all runs that hold the id. Partial counts of a part meet in one task, where the
   order by B gives each id's highest count.
3. Give back. The same runs are merged again beside the counts of their part, and what each document gets goes
   back to its chunk, where all parts are added up.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries.llm.common import Buffer, map_batches, rows_of, texts
from hydroseries.session import cut_lineage

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Parts by B id; links of one chunk; bytes of runs that one task merges.
PARTS, CHUNK_LINKS, MERGE_BYTES = 64, 4_000_000, 24 << 20
#: Segments that a worker remembers; longer ones are encoded each time. Bytes of texts that are encoded together.
_SEGMENTS, _LONG_SEGMENT, _BATCH_BYTES = 500_000, 256, 1 << 20
_CUT = re.compile(r" (?<=\S )(?=\S)")
_A_BITS = 17
#: Fixed value: how the byte-level vocabulary cuts a text before its merges.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_level() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest for 256 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


_NO_LINKS = np.empty(0, dtype=np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class Pair:
    """Both tokenizers; segment -> its tokens, groups and links."""

    def __init__(self, folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE):
        import sentencepiece
        import tiktoken

        with open(f"{folder}/{a_file}") as f:
            a = json.load(f)
        stand_in = _byte_level()
        ranks = {bytes(stand_in[c] for c in t): i for t, i in a["model"]["vocab"].items() if all(c in stand_in for c in t)}
        special = {t["content"].encode() for t in a["added_tokens"]}
        ranks = {t: i for t, i in ranks.items() if t not in special}
        # Ids follow the order of the merges, so they serve as ranks; special tokens are left out, so their strings are plain text.
        self.a = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{b_file}")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces) or any(re.search(r"\S \S", t.decode(errors="replace")) for t in ranks):
            raise ValueError("a token of this vocabulary may lie across a space, so texts cannot be encoded by segments")
        self.a_size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.a_size[list(ranks.values())] = [len(t) for t in ranks]
        self.b_size = np.array([len(t) for t in self.b_bytes])
        #: Ids as text with what follows them inside and at the end of their part of a group.
        self.a_text = [np.array([f"{i}{end}" for i in range(len(self.a_size))], dtype=object) for end in ",|"]
        self.b_text = [np.array([f"{i}{end}" for i in range(len(pieces))], dtype=object) for end in ",;"]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        #: Per segment: its groups as text; whether its bytes are kept, numbers of A and B tokens, place and number of its links, uses.
        self.groups: list[str] = []
        self.facts = np.zeros((6, 0), dtype=np.int64)
        self.links = np.empty(0, dtype=np.int64)

    def _forget(self) -> None:
        """Keeps the segments that were met again, half of what fits at most."""
        uses = self.facts[5]
        keep = np.flatnonzero(uses > 1)
        if len(keep) > _SEGMENTS // 2:
            keep = keep[np.argsort(-uses[keep], kind="stable")[: _SEGMENTS // 2]]
        self.links = self.links[_ranges(self.facts[3, keep], self.facts[4, keep])]
        self.facts = self.facts[:, keep]
        self.facts[3] = np.cumsum(self.facts[4]) - self.facts[4]
        names, groups = list(self.number), self.groups
        self.number = {names[k]: n for n, k in enumerate(keep.tolist())}
        self.groups = [groups[k] for k in keep.tolist()]

    def _align(self, a: list[list[int]], b: list[list[int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Groups, links and numbers of links of segments, all at once: both sides cover the same bytes, and a segment's end is an end on both."""
        n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        flat_a = np.fromiter(chain.from_iterable(a), dtype=np.int64, count=n_a.sum())
        flat_b = np.fromiter(chain.from_iterable(b), dtype=np.int64, count=n_b.sum())
        end_a, end_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        # Where the ends of the other side meet this one's: both are sorted and free of ties.
        last_a = end_b[np.minimum(np.searchsorted(end_b, end_a), len(end_b) - 1)] == end_a
        last_b = end_a[np.minimum(np.searchsorted(end_a, end_b), len(end_a) - 1)] == end_b
        links = flat_b[last_b] << _A_BITS | flat_a[last_a]
        up_to_a, up_to_b = np.cumsum(n_a), np.cumsum(n_b)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        n_links = np.diff(np.cumsum(last_a)[up_to_a - 1], prepend=0)
        words = np.concatenate([np.where(last_a, self.a_text[1][flat_a], self.a_text[0][flat_a]),
                                np.where(last_b, self.b_text[1][flat_b], self.b_text[0][flat_b])])
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        words = words[order].tolist()
        edges = [0, *(up_to_a + up_to_b).tolist()]
        return ["".join(words[s:e]) for s, e in zip(edges, edges[1:])], links, n_links

    def _add(self, segments: list[str]) -> None:
        """Encodes segments, each of which starts with the space that belongs to it."""
        encode, size, pieces = self.a.encode_ordinary, self.a_size, self.b_bytes
        a = [encode(s) for s in segments]
        b = self.b.encode([s[1:] for s in segments], num_threads=1)
        ok = [b"".join([pieces[i] for i in y]) == s.encode() for s, y in zip(segments, b)]
        facts = np.zeros((6, len(segments)), dtype=np.int64)
        facts[0], facts[1], facts[2] = ok, [len(x) for x in a], [len(y) for y in b]
        good = np.flatnonzero(facts[0])
        groups = [""] * len(segments)
        if len(good):
            texts_, links, n_links = self._align([a[k] for k in good.tolist()], [b[k] for k in good.tolist()])
            for k, g in zip(good.tolist(), texts_):
                groups[k] = g
            facts[4, good] = n_links
            self.links = np.concatenate([self.links, links])
        facts[3] = np.cumsum(facts[4]) - facts[4] + len(self.links) - facts[4].sum()
        self.number.update(zip([s[1:] for s in segments], range(len(self.groups), len(self.groups) + len(segments))))
        self.groups += groups
        self.facts = np.concatenate([self.facts, facts], axis=1)

    def encode(self, texts: list[str]) -> list[tuple[int, int, str, np.ndarray]]:
        """Per text: numbers of A and B tokens, groups as text, links; nothing of a text whose bytes are not kept."""
        if len(self.groups) > _SEGMENTS or len(self.links) > 8 * _SEGMENTS:
            self._forget()
        per_text = [_CUT.split(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(per_text))
        found = list(map(self.number.get, flat))
        if None in found:
            self._add([f" {s}" for s in dict.fromkeys([s for s, f in zip(flat, found) if f is None])])
            found = list(map(self.number.__getitem__, flat))
        ids = np.array(found, dtype=np.int64)
        np.add.at(self.facts[5], ids, 1)
        facts = self.facts[:, ids]
        links = self.links[_ranges(facts[3], facts[4])]
        groups = self.groups
        words = [groups[i] for i in found]
        edges = np.cumsum([0, *map(len, per_text)])
        sums = np.concatenate([np.zeros((6, 1), dtype=np.int64), np.cumsum(facts, axis=1)], axis=1)[:, edges]
        n_ok, n_a, n_b, _, n_links, _ = np.diff(sums, axis=1)
        out = []
        for k, whole in enumerate((n_ok == np.diff(edges)).tolist()):
            if not whole or not per_text[k]:
                out.append((0, 0, "", _NO_LINKS))
                continue
            text = "".join(words[edges[k] : edges[k + 1]])[:-1]
            out.append((int(n_a[k]), int(n_b[k]), text, links[sums[4, k] : sums[4, k + 1]]))
        for s in [s for s in set(flat) if len(s) > _LONG_SEGMENT]:  # these stay for this call only
            k = self.number[s]
            self.facts[5, k] = 0
            self.groups[k] = ""
            self.number[f"\n{k}"] = self.number.pop(s)
        return out


_pairs: dict[tuple[str, str, str], Pair] = {}


def _pair(*files: str) -> Pair:
    """One for each worker process: what it remembers serves the worker's next tasks too."""
    if files not in _pairs:
        _pairs[files] = Pair(*files)
    return _pairs[files]


# --- runs ----------------------------------------------------------------------------------------------------------


def _pack(*columns: np.ndarray, coder=[]) -> bytes:
    """Columns of 32-bit numbers as one zstd frame; sorted ones are better given as differences."""
    if not coder:
        import zstandard

        coder.append(zstandard.ZstdCompressor(level=3))
    return coder[0].compress(b"".join(np.ascontiguousarray(c, dtype="<u4").tobytes() for c in columns))


def _unpack(blob: bytes, n: int, coder=[]) -> list[np.ndarray]:
    if not coder:
        import zstandard

        coder.append(zstandard.ZstdDecompressor())
    flat = np.frombuffer(coder[0].decompress(blob), dtype="<u4")
    return [flat[k * n : (k + 1) * n] for k in range(len(flat) // n)] if n else []


def _part_of(pair: np.ndarray) -> np.ndarray:
    """The radix part of a pair: low bits of its B id, mixed, so that neighbours in the vocabulary part."""
    b = pair.astype(np.uint64) >> np.uint64(_A_BITS)
    return ((b * np.uint64(2654435761)) % np.uint64(1 << 32) >> np.uint64(16)) % np.uint64(PARTS)


def _runs(links: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """part, number of records, run: the links of a chunk's documents, folded to (pair, document, times)."""
    sizes = [len(x) for x in links]
    if not sum(sizes):
        return
    doc = np.repeat(np.arange(len(links), dtype=np.int64), sizes)
    key = np.concatenate(links) << 24 | doc
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.append(first, len(key)))
    key = key[first]
    pair, doc = key >> 24, key & ((1 << 24) - 1)
    part = _part_of(pair)
    order = np.argsort(part.astype(np.uint8), kind="stable")
    pair, doc, times = pair[order], doc[order], times[order]
    edges = np.searchsorted(part[order], np.arange(PARTS + 1, dtype=np.uint64))
    for p in range(PARTS):
        a, b = int(edges[p]), int(edges[p + 1])
        if b > a:
            yield p, b - a, _pack(np.diff(pair[a:b], prepend=0), doc[a:b], times[a:b])


def _some(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows of id and text, some at a time."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1] or b"") + 64
        if size >= _BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _encoded(docs: DataFrame, folder: str, a_file: str, b_file: str) -> DataFrame:
    """kind 0: a document's numbers; kind 1: a run of a chunk's links. Written once, so texts are encoded once."""
    names = ("kind", "chunk", "place", "doc_id", "n_a", "n_b", "n_groups", "sha", "part", "n", "run")

    def run(batches):
        from pyspark import TaskContext

        pair, out = _pair(folder, a_file, b_file), Buffer(*names)
        chunk, links, held = TaskContext.get().partitionId() << 32, [], 0
        for rows in _some(rows_of(batches, "doc_id", "text")):
            for (doc_id, _), (n_a, n_b, groups, mine) in zip(rows, pair.encode([(t or b"").decode() for _, t in rows])):
                sha = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
                out.add(0, chunk, len(links), doc_id, n_a, n_b, len(mine), sha, None, None, None)
                links.append(mine)
                held += len(mine)
                if held >= CHUNK_LINKS or len(links) >= 1 << 20:
                    for part, n, blob in _runs(links):
                        out.add(1, chunk, None, None, None, None, None, None, part, n, blob, size=len(blob))
                    chunk, links, held = chunk + 1, [], 0
            if out.full():
                yield out.take()
        for part, n, blob in _runs(links):
            out.add(1, chunk, None, None, None, None, None, None, part, n, blob, size=len(blob))
        yield out.take()

    return cut_lineage(map_batches(
        docs, run, "kind int, chunk long, place int, doc_id long, n_a long, n_b long, n_groups long, sha string, part int, n int, run binary"
    ))


class _Run:
    """A sorted run, B id by B id."""

    def __init__(self, chunk: int, n: int, blob: bytes):
        self.chunk, self.n, self.blob = chunk, n, blob
        pair, self.doc, self.times = _unpack(blob, n)
        self.pair = np.cumsum(pair, dtype=np.int64)
        b = self.pair >> _A_BITS
        self.starts = np.append(np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])), n)
        self.ids = b[self.starts[:-1]].tolist()
        self.at = 0

    def slice(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = int(self.starts[self.at]), int(self.starts[self.at + 1])
        self.at += 1
        return self.pair[a:b], self.doc[a:b], self.times[a:b]


def _merge(runs: list[_Run]) -> Iterator[tuple[int, list[tuple[_Run, tuple]]]]:
    """k-way merge: each B id with the slices of the runs that hold it, in order of B ids."""
    heap = [(r.ids[0], k) for k, r in enumerate(runs)]
    heapq.heapify(heap)
    while heap:
        b, found = heap[0][0], []
        while heap and heap[0][0] == b:
            k = heap[0][1]
            r = runs[k]
            found.append((r, r.slice()))
            if r.at < len(r.ids):
                heapq.heapreplace(heap, (r.ids[r.at], k))
            else:
                heapq.heappop(heap)
        yield b, found


def _dealt(encoded: DataFrame) -> DataFrame:
    """Runs with a salt: as many tasks for a part as its runs need, each with a share of the chunks."""
    runs = encoded.where("kind = 1").select("chunk", "part", "n", "run")
    salts = runs.groupBy("part").agg(F.ceil(F.sum(F.length("run")) / MERGE_BYTES).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("chunk"), F.col("salts")).cast("int")
    return runs.join(F.broadcast(salts), "part").select("part", salt.alias("salt"), "chunk", "n", "run")  # a row per part


def _grouped(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of a task that come ordered by their first two columns, group by group."""
    key, held = None, []
    for row in rows_of(batches, *names):
        if row[:2] != key and held:
            yield key, held
            held = []
        key = row[:2]
        held.append(row[2:])
    if held:
        yield key, held


def _partial_counts(dealt: DataFrame) -> DataFrame:
    """part, n, run: pairs of a task's runs with their counts, in order."""

    def run(batches):
        out = Buffer("part", "n", "low", "run")
        for (part, _), rows in _grouped(batches, "part", "salt", "chunk", "n", "run"):
            pairs, counts = [], []
            for _, found in _merge([_Run(*r) for r in rows]):
                pair = np.concatenate([s[0] for _, s in found])
                times = np.concatenate([s[2] for _, s in found])
                each, place = np.unique(pair, return_inverse=True)
                pairs.append(each)
                counts.append(np.bincount(place, weights=times).astype(np.int64))
            pair, count = np.concatenate(pairs), np.concatenate(counts)
            blob = _pack(np.diff(pair, prepend=0), count & 0xFFFFFFFF, count >> 32)
            out.add(part, len(pair), int(pair[0]), blob, size=len(blob))
            if out.full():
                yield out.take()
        yield out.take()

    sorted_ = dealt.repartition("part", "salt").sortWithinPartitions("part", "salt")
    return map_batches(sorted_, run, "part int, n int, low long, run binary")


def _totals(partial: DataFrame) -> DataFrame:
    """part, n, run: all pairs of a part with count and whether it is the highest of its B id."""

    def run(batches):
        for (part, _), rows in _grouped(batches, "part", "part2", "n", "run"):
            pair, count = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
            for n, blob in rows:
                step, low, high = _unpack(blob, n)
                both = np.concatenate([pair, np.cumsum(step, dtype=np.int64)])
                pair, place = np.unique(both, return_inverse=True)
                count = np.bincount(place, weights=np.concatenate([count, low.astype(np.int64) | high.astype(np.int64) << 32]))
                count = count.astype(np.int64)
            b = pair >> _A_BITS
            starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            highest = np.repeat(np.maximum.reduceat(count, starts), np.diff(np.append(starts, len(b))))
            blob = _pack(np.diff(pair, prepend=0), count & 0xFFFFFFFF, count >> 32, count == highest)
            yield {"part": [part], "n": [len(pair)], "run": [blob]}

    met = partial.select("part", F.col("part").alias("part2"), "n", "run").repartition("part").sortWithinPartitions("part")
    return map_batches(met, run, "part int, n int, run binary")


def _given_back(dealt: DataFrame, totals: DataFrame) -> DataFrame:
    """chunk, n, run: what documents of the chunk get from a part: place, links with the highest count, sum of counts."""
    # The counts of a part go to every task that has runs of it.
    tasks = dealt.select("part", "salt").distinct()
    counts = totals.join(tasks, "part").select("part", "salt", F.lit(None).cast("long").alias("chunk"), "n", "run")
    both = dealt.unionByName(counts).repartition("part", "salt").sortWithinPartitions("part", "salt")

    def run(batches):
        out = Buffer("chunk", "n", "run")
        for _, rows in _grouped(batches, "part", "salt", "chunk", "n", "run"):
            (n, blob), = [r[1:] for r in rows if r[0] is None]
            step, low, high, best = _unpack(blob, n)
            pairs = np.cumsum(step, dtype=np.int64)
            count = low.astype(np.int64) | high.astype(np.int64) << 32
            runs = [_Run(*r) for r in rows if r[0] is not None]
            sums = {r.chunk: [np.zeros(int(r.doc.max()) + 1, dtype=np.int64) for _ in range(2)] for r in runs}
            for _, found in _merge(runs):
                for r, (pair, doc, times) in found:
                    at = np.searchsorted(pairs, pair)
                    times = times.astype(np.int64)
                    n_best, total = sums[r.chunk]
                    np.add.at(n_best, doc, times * best[at])
                    np.add.at(total, doc, times * count[at])
            for chunk, (n_best, total) in sums.items():
                place = np.flatnonzero(total)
                best_, sum_ = n_best[place], total[place]
                blob = _pack(np.diff(place, prepend=0), best_, sum_ & 0xFFFFFFFF, sum_ >> 32)
                out.add(chunk, len(place), blob, size=len(blob))
            if out.full():
                yield out.take()
        yield out.take()

    return map_batches(both, run, "chunk long, n int, run binary")


def align_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, a_file: str = A_FILE, b_file: str = B_FILE
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per row of ``docs``.

    A encodes space + text (byte-level vocabulary), B the text (it adds the space itself). Byte offsets where tokens of both end
    cut the tokens into groups; the last tokens of a group are linked. A pair of ids counts as often as it is linked in
    all documents. ``n_best``: links whose count is the highest of their B id, ties included; ``count_sum``: counts added up
    over the document's links; ``groups_sha256``: digest of the groups as ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and texts whose tokens do not give back their bytes (for B a text with U+2581), have zeros and an
    empty digest. Rows are counted one by one: repeated rows, equal ids and null ids count and are returned as often as they occur.
    ``folder`` must hold the two vocabulary files on every executor.
    """
    encoded = _encoded(texts(docs, id_col, text_col), folder, a_file, b_file)
    dealt = _dealt(encoded)
    totals = _totals(_partial_counts(dealt))
    back = _given_back(dealt, totals)
    rows = encoded.where("kind = 0").select("chunk", F.lit(1).alias("kind"), "place", "doc_id", "n_a", "n_b", "n_groups", "sha",
                                            F.lit(0).alias("n"), F.lit(None).cast("binary").alias("run"))
    given = back.select("chunk", F.lit(0).alias("kind"), *[F.lit(None).cast(t).alias(c) for c, t in (
        ("place", "int"), ("doc_id", "long"), ("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("sha", "string"))], "n", "run")
    met = rows.unionByName(given).repartition("chunk").sortWithinPartitions("chunk", "kind")
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

    def run(batches):
        out, chunk, sums = Buffer(*names), None, np.zeros((2, 0), dtype=np.int64)
        for c, kind, place, doc_id, n_a, n_b, n_groups, sha, n, blob in rows_of(
            batches, "chunk", "kind", "place", "doc_id", "n_a", "n_b", "n_groups", "sha", "n", "run"
        ):
            if c != chunk:
                chunk, sums = c, np.zeros((2, 0), dtype=np.int64)
            if kind == 0:
                step, best, low, high = _unpack(blob, n)
                places = np.cumsum(step, dtype=np.int64)
                if places[-1] >= sums.shape[1]:
                    sums = np.pad(sums, ((0, 0), (0, int(places[-1]) + 1 - sums.shape[1])))
                sums[0, places] += best
                sums[1, places] += low.astype(np.int64) | high.astype(np.int64) << 32
                continue
            there = place < sums.shape[1]
            best, total = (int(sums[0, place]), int(sums[1, place])) if there else (0, 0)
            out.add(doc_id, n_a, n_b, n_groups, n_groups, best, total, sha)
            if out.full():
                yield out.take()
        yield out.take()

    return map_batches(met, run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
