"""Substring deduplication with automata of repeated phrases.

1. Find. Of the 26 runs of 25 words inside a window of 50 words, the one with the least hash is the window's anchor.
   A window that occurs in two documents has its anchor in both, so only windows of recurring anchors are looked at.
2. Confirm. Those windows are grouped by their hash; one that occurs in several documents belongs to the smallest of
   them, and neighbouring windows of one owner make a passage.
3. Locate. Passages are dealt into shards of bounded size. Per shard an Aho-Corasick automaton over words is compiled from
   the passages' pieces of 25 words (every window of a passage holds one whole piece). Of every document, the stretches
   that share an anchor with a shard stream through it; where a piece ends, the windows around it are compared with the passage word for word.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries.llm.common import Buffer, WordIds, gram_hashes, hash64, map_batches, rows_of, signed, sliding, texts
from hydroseries.session import cut_lineage

SPAN, PIECE = 50, 25
CHUNK = 2_000
#: Words of passages in one automaton, and bytes of documents that one task streams through it.
SHARD_WORDS, STREAM_BYTES = 400_000, 32 << 20
_LAST = (1 << 63) - 1


def anchors(words: list[bytes], ids: WordIds) -> np.ndarray:
    """The anchor of each window of ``SPAN`` words."""
    if len(words) < SPAN:
        return np.empty(0, dtype=np.uint64)
    grams = gram_hashes(np.array([ids[w] for w in words], dtype=np.uint64), PIECE)
    return sliding(grams, SPAN - PIECE + 1, np.minimum)


def _node(words: list[bytes]) -> tuple[int, bytes]:
    digest = hashlib.sha256(b" ".join(words)).digest()
    return int.from_bytes(digest[:8], "big", signed=True), digest


def _pack(text: bytes, coder=[]) -> bytes:
    if not coder:
        import zstandard

        coder.append(zstandard.ZstdCompressor(level=3))
    return coder[0].compress(text)


def _unpack(packed: bytes, coder=[]) -> list[bytes]:
    if not coder:
        import zstandard

        coder.append(zstandard.ZstdDecompressor())
    return coder[0].decompress(packed).split()


def _base(rows: DataFrame) -> DataFrame:
    """doc, node, n_words, sha, fps: doc is the id, with null after all others."""

    def run(batches):
        ids, out = WordIds(hash64), Buffer("doc", "node", "n_words", "sha", "fps")
        for who, text in rows_of(batches, "doc_id", "text"):
            words = (text or b"").split()
            node, digest = _node(words)
            fps = signed(np.unique(anchors(words, ids)))
            out.add(_LAST if who is None else who, node, len(words), digest, fps, size=8 * len(fps) + 80)
            if out.full():
                yield out.take()
        yield out.take()

    return map_batches(rows, run, "doc long, node long, n_words long, sha binary, fps array<long>")


def _with_text(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, node, fps and the packed text of the documents of ``wanted``."""

    def run(batches):
        out = Buffer("doc", "z")
        for who, text in rows_of(batches, "doc_id", "text"):
            z = _pack(text or b"")
            out.add(_LAST if who is None else who, z, size=len(z))
            if out.full():
                yield out.take()
        yield out.take()

    def same(batches):
        """One id may stand for several texts: only the one meant stays."""
        out = Buffer("doc", "node", "fps", "z")
        for doc, node, fps, z in rows_of(batches, "doc", "node", "fps", "z"):
            if _node(_unpack(z))[0] == node:
                out.add(doc, node, fps, z, size=len(z) + 8 * len(fps))
            if out.full():
                yield out.take()
        yield out.take()

    joined = map_batches(rows, run, "doc long, z binary").join(wanted, "doc")
    return map_batches(joined, same, "doc long, node long, fps array<long>, z binary").dropDuplicates(["doc", "node"])


def _windows(found: DataFrame) -> DataFrame:
    """w, doc, node, at: the windows with a recurring anchor."""

    def run(batches):
        ids, out = WordIds(hash64), Buffer("w", "doc", "node", "at")
        for doc, node, fps, z in rows_of(batches, "doc", "node", "fps", "z"):
            words = _unpack(z)
            at = np.flatnonzero(np.isin(signed(anchors(words, ids)), np.array(fps)))
            if not len(at):
                continue
            w = gram_hashes(np.array([ids[x] for x in words], dtype=np.uint64), SPAN)[at]
            yield {"w": signed(w), "doc": np.full(len(at), doc), "node": np.full(len(at), node), "at": at.astype(np.int32)}
        yield out.take()

    return map_batches(found, run, "w long, doc long, node long, at int")


def _passages(owned: DataFrame, found: DataFrame, shards: int) -> DataFrame:
    """shard, doc, z, fps: passages of up to ``CHUNK`` windows. ``owned``: doc, node, places of the windows it owns."""

    def run(batches):
        ids, out = WordIds(hash64), Buffer("shard", "doc", "z", "fps")
        for doc, z, places in rows_of(batches, "doc", "z", "places"):
            words, at = _unpack(z), np.unique(np.array(places))
            fps = anchors(words, ids)
            for run_ in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                for k in range(0, len(run_), CHUNK):
                    first, last = int(run_[k]), int(run_[min(k + CHUNK, len(run_)) - 1])
                    part = words[first : last + SPAN]
                    packed = _pack(b" ".join(part))
                    shard = hash64(b"%d %d" % (doc, first // SHARD_WORDS)) % shards
                    own = signed(np.unique(fps[first : last + 1]))
                    out.add(shard, doc, packed, own, size=len(packed) + 8 * len(own))
            if out.full():
                yield out.take()
        yield out.take()

    joined = owned.join(found.select("doc", "node", "z"), ["doc", "node"])
    return map_batches(joined.select("doc", "z", "places"), run, "shard int, doc long, z binary, fps array<long>")


class Shard:
    """The passages of one shard, and the automaton over their pieces."""

    def __init__(self, passages: list[tuple[int, list[bytes]]]):
        import ahocorasick

        self.number: dict[bytes, int] = {}
        number = self.number
        arrays = [np.array([number.setdefault(w, len(number) + 1) for w in words], dtype=np.int64) for _, words in passages]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        hashes, places, owners, start = [], [], [], 0
        for (owner, _), x in zip(passages, arrays):
            for o in range(0, len(x) - PIECE + 1, PIECE):
                automaton.add_word(tuple(x[o : o + PIECE].tolist()), 1)
            h = gram_hashes(x.astype(np.uint64), SPAN)
            hashes.append(h)
            places.append(start + np.arange(len(h)))
            owners.append(np.full(len(h), owner))
            start += len(x)
        automaton.make_automaton()
        self.automaton = automaton
        self.flat = np.concatenate(arrays)
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.hashes, self.places, self.owners = h[order], np.concatenate(places)[order], np.concatenate(owners)[order]

    def covered(self, doc: int, words: list[bytes]) -> list[tuple[int, int]]:
        """Spans [from, to) of ``words`` that windows of smaller documents cover."""
        n = len(words)
        if n < SPAN:
            return []
        get = self.number.get
        seq = [get(w, 0) for w in words]
        near = np.zeros(n + 1, dtype=np.int64)
        some = False
        for end, _ in self.automaton.iter(tuple(seq)):
            near[max(0, end - SPAN + 1)] += 1
            near[max(0, end - PIECE + 1) + 1] -= 1
            some = True
        if not some:
            return []
        x = np.array(seq, dtype=np.int64)
        starts = np.flatnonzero(np.cumsum(near[: n - SPAN + 1]) > 0)
        h = gram_hashes(x.astype(np.uint64), SPAN)[starts]
        slot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = (self.hashes[slot] == h) & (self.owners[slot] < doc)
        starts, there = starts[hit], self.places[slot[hit]]
        if not len(starts):
            return []
        cut = np.flatnonzero((np.diff(starts) != 1) | (np.diff(there) != 1)) + 1
        out = []
        for s, t in zip(np.split(starts, cut), np.split(there, cut)):
            a, b, size = int(s[0]), int(t[0]), len(s) + SPAN - 1
            if (x[a : a + size] == self.flat[b : b + size]).all():
                out.append((a, a + size))
        return out


def _stretches(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """shard, doc, node, first, z: the parts of a document whose windows have an anchor of the shard, cut out in one pass.

    ``wanted``: doc, node, routes (pairs of anchor and shard).
    """

    def run(batches):
        ids, out = WordIds(hash64), Buffer("shard", "doc", "node", "first", "z")
        for doc, node, z, routes in rows_of(batches, "doc", "node", "z", "routes"):
            words = _unpack(z)
            fps = signed(anchors(words, ids))
            keys = np.array([r["fp"] for r in routes])
            shards = np.array([r["shard"] for r in routes])
            at = np.flatnonzero(np.isin(fps, keys))
            for shard in np.unique(shards).tolist():
                own = at[np.isin(fps[at], keys[shards == shard])]
                for run_ in np.split(own, np.flatnonzero(np.diff(own) > SPAN) + 1):
                    first = int(run_[0])
                    packed = _pack(b" ".join(words[first : int(run_[-1]) + SPAN]))
                    out.add(shard, doc, node, first, packed, size=len(packed) + 40)
            if out.full():
                yield out.take()
        yield out.take()

    joined = wanted.join(found.select("doc", "node", "z"), ["doc", "node"])
    return map_batches(joined, run, "shard int, doc long, node long, first int, z binary")


def _locate(passages: DataFrame, found: DataFrame) -> DataFrame:
    """doc, node, spans: where documents repeat passages of smaller ones, per shard."""
    routes = passages.select("shard", "doc", F.explode("fps").alias("fp")).groupBy("fp", "shard").agg(F.min("doc").alias("owner"))
    wanted = found.select("doc", "node", F.explode("fps").alias("fp")).join(routes, "fp").where(F.col("owner") < F.col("doc"))
    wanted = wanted.groupBy("doc", "node").agg(F.collect_list(F.struct("fp", "shard")).alias("routes"))
    streams = cut_lineage(_stretches(found, wanted))
    # A shard that very many documents meet is given to several tasks, each with a share of the documents.
    salts = streams.groupBy("shard").agg(F.ceil(F.sum(F.length("z")) * 3 / STREAM_BYTES).cast("int").alias("salts"))
    docs = streams.join(salts, "shard").select(
        "shard", F.pmod(F.xxhash64("doc", "node"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), "doc", "node",
        "first", "z",
    )
    parts = passages.join(salts, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), "doc",
        F.lit(0).cast("long").alias("node"), F.lit(0).alias("first"), "z",
    )
    dealt = docs.unionByName(parts).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def run(batches):
        out, key, held, shard = Buffer("doc", "node", "spans"), None, [], None
        for number, salt, kind, doc, node, first, z in rows_of(batches, "shard", "salt", "kind", "doc", "node", "first", "z"):
            if (number, salt) != key:
                key, held, shard = (number, salt), [], None
            if kind == 0:
                held.append((doc, _unpack(z)))
                continue
            if shard is None:
                shard, held = Shard(held), []
            spans = shard.covered(doc, _unpack(z))
            if spans:
                out.add(doc, node, [first + y for s in spans for y in s], size=8 * len(spans))
            if out.full():
                yield out.take()
        yield out.take()

    return map_batches(dealt, run, "doc long, node long, spans array<int>")


def _cut(spans: DataFrame, found: DataFrame) -> DataFrame:
    """doc, node, n_removed, kept: what is left of documents that lose words."""

    def run(batches):
        out = Buffer("doc", "node", "n_removed", "kept", "spans")
        for doc, node, z, parts in rows_of(batches, "doc", "node", "z", "parts"):
            words = _unpack(z)
            gone = np.zeros(len(words), dtype=bool)
            for part in parts:
                for a, b in zip(part[::2], part[1::2]):
                    gone[a:b] = True
            kept = b" ".join(w for w, g in zip(words, gone.tolist()) if not g)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            out.add(doc, node, int(gone.sum()), hashlib.sha256(kept).digest(), edges.astype(np.int32), size=100 + 4 * len(edges))
            if out.full():
                yield out.take()
        yield out.take()

    together = spans.groupBy("doc", "node").agg(F.collect_list("spans").alias("parts"))
    joined = together.join(found.select("doc", "node", "z"), ["doc", "node"])
    return map_batches(joined, run, "doc long, node long, n_removed long, kept binary, spans array<int>")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans: one row per row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes if a window of 50 consecutive words covers it whose sequence also
    starts in a document with a smaller id; windows are judged on the input. ``kept_sha256`` is the digest of the kept words
    joined by one space, ``spans`` the removed ones as [from, to, from, to, ...].

    Null and empty texts have no words and the digest of the empty text. A null id is larger than any other. Rows of
    one id are no reason to remove anything from each other, whether their texts are equal or not; repeated rows
    get the same result each.
    """
    rows = texts(docs, id_col, text_col)
    base = cut_lineage(_base(rows))
    owners = base.groupBy("node").agg(F.min("doc").alias("first"))
    base_owned = base.join(owners, "node")
    # A copy of a whole smaller document repeats all its windows: nothing is left to look for.
    firsts = base_owned.where((F.col("doc") == F.col("first")) & (F.size("fps") > 0)).select("doc", "node", "fps")
    firsts = firsts.dropDuplicates(["doc", "node"])
    single = firsts.select("doc", "node", F.explode("fps").alias("fp"))
    shared = single.groupBy("fp").agg(F.min("doc").alias("_lo"), F.max("doc").alias("_hi")).where(F.col("_lo") < F.col("_hi"))
    wanted = single.join(shared.select("fp"), "fp").groupBy("doc", "node").agg(F.collect_set("fp").alias("fps"))
    found = cut_lineage(_with_text(rows, wanted))
    own = F.min(F.struct("doc", "node", "at")).alias("own")
    windows = _windows(found).groupBy("w").agg(own, F.max("doc").alias("_hi")).where(F.col("own.doc") < F.col("_hi"))
    owned = windows.groupBy(F.col("own.doc").alias("doc"), F.col("own.node").alias("node")).agg(
        F.collect_list("own.at").alias("places")
    )
    owned = cut_lineage(owned)
    total = owned.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    passages = cut_lineage(_passages(owned, found, max(1, -(-total // SHARD_WORDS))))
    cut = _cut(_locate(passages, found), found)
    out = base_owned.join(cut, ["doc", "node"], "left")
    copy = (F.col("doc") > F.col("first")) & (F.col("n_words") >= SPAN)
    nothing = F.lower(F.sha2(F.lit("").cast("binary"), 256))
    return out.select(
        F.when(F.col("doc") < _LAST, F.col("doc")).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, nothing).otherwise(F.lower(F.hex(F.coalesce("kept", "sha")))).alias("kept_sha256"),
        F.when(copy, F.array(F.lit(0), F.col("n_words").cast("int"))).otherwise(
            F.coalesce("spans", F.array().cast("array<int>"))
        ).alias("spans"),
    )
