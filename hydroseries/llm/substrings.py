"""Substring deduplication by suffix order.

1. Route. Of the 69 runs of 32 bytes inside a window of 100 bytes, the one with the least hash is the window's anchor; equal
   windows have equal anchors. Windows whose anchor occurs nowhere else are alone. The others go to the shard of the text
   in which their anchor is found first, as stretches, so that all equal windows meet and a passage stays in one piece. This
   step only chooses what is sorted; whether windows are equal is decided by the sort.
2. Sort. Each shard's stretches are sorted by external induced sorting (``induction``), and windows that share 100 bytes with
   their neighbour in the order are one group: all but the earliest go. A shard whose passages very many documents hold is given to several
   tasks; the windows each of them keeps are then compared by a hash of 128 bits.
3. Cut. What the shards found is put together per document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries.llm.common import Buffer, bucketed, map_batches, mix, rows_of, signed, sliding, texts
from hydroseries.llm.induction import Store, suffix_order
from hydroseries.session import cut_lineage

SPAN, GRAM = 100, 32
#: Bytes of texts per shard (only their stretches are sorted), of stretches that one task sorts, and of texts per partition.
SHARD_BYTES, SORT_BYTES, PART_BYTES = 8 << 20, 16 << 20, 128 << 20
#: Bytes whose anchors are found in one go (places in them have 20 bits); stretches closer than this are one.
_BLOCK, _GAP = 1 << 20, 64
_HIGH = np.uint64(~((1 << 20) - 1) & ((1 << 64) - 1))
_LAST = (1 << 63) - 1
_ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _pack(text: bytes, coder=[]) -> bytes:
    if not coder:
        import zstandard

        coder.append(zstandard.ZstdCompressor(level=1))
    return coder[0].compress(text)


def _unpack(packed: bytes, coder=[]) -> bytes:
    if not coder:
        import zstandard

        coder.append(zstandard.ZstdDecompressor())
    return coder[0].decompress(packed)


def _pieces(texts: list[bytes]) -> list[list[tuple[int, int, bytes]]]:
    """Blocks of pieces (text, offset, bytes); long texts are cut so that every window lies in one piece."""
    blocks, block, size = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - SPAN + 1), _BLOCK // 2):
            part = text[at : at + _BLOCK // 2 + SPAN - 1]
            if len(part) < SPAN:
                continue
            if size + len(part) > _BLOCK:
                blocks.append(block)
                block, size = [], 0
            block.append((k, at, part))
            size += len(part)
    return [*blocks, block] if block else blocks


def anchor_runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor, all texts at once, in order: text, first window, end (the window after the last), anchor.

    The anchor is the run of 32 bytes whose hash has the least leading 44 bits, the first such run on a tie: equal windows have it
    at the same place, so two equal windows of one text belong to two runs of the same anchor.
    """
    found = []
    for block in _pieces(texts):
        sizes = np.array([len(part) for _, _, part in block])
        joined = b"".join([part for _, _, part in block])
        words = np.ndarray((len(joined) - 7,), dtype="<u8", buffer=joined, strides=(1,)).copy()
        m = len(joined) - GRAM + 1
        grams = words[:m] * _ODD[0]
        for k in (1, 2, 3):
            grams += words[8 * k : 8 * k + m] * _ODD[k]
        grams = mix(grams)
        place = np.arange(m, dtype=np.uint64)
        least = sliding((grams & _HIGH) | place, SPAN - GRAM + 1, np.minimum)
        # Windows over the end of a piece are none: a run ends there, and the next one begins with the next piece.
        ends = np.cumsum(sizes)
        first = ends - sizes
        cut = least[1:] != least[:-1]
        after = ends - SPAN + 1
        cut[first[1:] - 1] = True
        cut[after[:-1] - 1] = True
        starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
        stops = np.append(starts[1:], len(least))
        piece = np.searchsorted(first, starts, side="right") - 1
        good = starts < after[piece]
        starts, stops, piece = starts[good], stops[good], piece[good]
        anchors = grams[(least[starts] & ~_HIGH).astype(np.int64)]
        shift = np.array([at for _, at, _ in block])[piece] - first[piece]
        found.append((np.array([k for k, _, _ in block])[piece], starts + shift, stops + shift, anchors))
    if not found:
        return tuple(np.empty(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _some(rows, at: int):
    """Rows some at a time, by the size of their packed text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[at])
        if size >= _BLOCK // 2:
            yield held
            held, size = [], 0
    if held:
        yield held


def _base(rows: DataFrame) -> DataFrame:
    """doc, sha, n_bytes: doc is the id, with null after all others."""

    def run(batches):
        out = Buffer("doc", "sha", "n_bytes")
        for who, text in rows_of(batches, "doc_id", "text"):
            out.add(_LAST if who is None else who, hashlib.sha256(text or b"").digest(), len(text or b""))
            if out.full():
                yield out.take()
        yield out.take()

    return map_batches(rows, run, "doc long, sha binary, n_bytes long")


def _distinct(rows: DataFrame, firsts: DataFrame, total: int) -> tuple[DataFrame, int]:
    """uid, doc, sha, z: every distinct text long enough to hold a window once, with its smallest document.

    ``uid`` is a hash of doc and sha, and the rows are a table bucketed by it: later joins by ``uid`` move only what they add to the
    texts. Two texts of one uid do no harm: their document tells them apart.
    """

    def run(batches):
        out = Buffer("doc", "sha", "z")
        for who, text in rows_of(batches, "doc_id", "text"):
            if text and len(text) >= SPAN:
                z = _pack(text)
                out.add(_LAST if who is None else who, hashlib.sha256(text).digest(), z, size=len(z))
            if out.full():
                yield out.take()
        yield out.take()

    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES))
    uid = F.xxhash64("doc", "sha").alias("uid")
    packed = map_batches(rows, run, "doc long, sha binary, z binary").select(uid, "doc", "sha", "z").repartition(n, "uid")  # as many as buckets: dealt out once
    first = firsts.select(F.xxhash64("first", "sha").alias("uid"), F.col("first").alias("_doc"), F.col("sha").alias("_sha"))
    # Written as a difference: as an equality it would become a key of the join, and the texts would be dealt out anew.
    same = (F.col("doc") - F.col("_doc") == 0) & (F.xxhash64("sha") - F.xxhash64("_sha") == 0)
    once = packed.join(first, "uid").where(same)
    return once.select("uid", "doc", "sha", "z").dropDuplicates(["uid", "doc", "sha"]), n


def _anchors(distinct: DataFrame) -> DataFrame:
    """fp, uid, n: the anchors of each text, and whether the text holds it once or at several places (2)."""

    def run(batches):
        for rows in _some(rows_of(batches, "uid", "z"), 1):
            text, _, _, anchors = anchor_runs([_unpack(z) for _, z in rows])
            order = np.lexsort((anchors, text))
            text, anchors = text[order], anchors[order]
            first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (anchors[1:] != anchors[:-1])])[: len(text)])
            n = np.minimum(np.diff(np.append(first, len(text))), 2)
            uids = np.array([uid for uid, _ in rows], dtype=np.int64)
            yield {"fp": signed(anchors[first]), "uid": uids[text[first]], "n": n}

    return map_batches(distinct.select("uid", "z"), run, "fp long, uid long, n long")


def _stretches(distinct: DataFrame, wanted: DataFrame) -> DataFrame:
    """shard, doc, uid, firsts, sizes, z: of a text, the stretches that one shard sorts. ``wanted``: uid, routes (anchor, shard)."""

    def run(batches):
        out = Buffer("shard", "doc", "uid", "firsts", "sizes", "n", "z")
        for rows in _some(rows_of(batches, "uid", "doc", "fps", "shards", "z"), 4):
            texts = [_unpack(r[4]) for r in rows]
            text_of, starts, ends, anchors = anchor_runs(texts)
            edges = np.searchsorted(text_of, np.arange(len(rows) + 1))
            for k, (uid, doc, fps, shards, _) in enumerate(rows):
                mine = slice(int(edges[k]), int(edges[k + 1]))
                cut(out, texts[k], uid, doc, fps, shards, starts[mine], ends[mine], signed(anchors[mine]))
                if out.full():
                    yield out.take()
        yield out.take()

    def cut(out, text, uid, doc, fps, shards, starts, ends, anchors):
        fps, shards = np.array(fps, dtype=np.int64), np.array(shards)
        order = np.argsort(fps)
        fps, shards = fps[order], shards[order]
        at = np.minimum(np.searchsorted(fps, anchors), len(fps) - 1)
        found = np.flatnonzero(fps[at] == anchors)
        to = shards[at[found]]
        by = np.argsort(to, kind="stable")
        found, to = found[by], to[by]
        s, e = starts[found], ends[found]
        # Runs of one shard close to each other are one stretch.
        new = np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1]) | (s[1:] - e[:-1] > _GAP)]))
        s, e, to = s[new], e[np.append(new[1:], len(e)) - 1] + SPAN - 1, to[new]
        edges = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            whole = b"".join([text[x:y] for x, y in zip(s[a:b].tolist(), e[a:b].tolist())])
            packed = _pack(whole)
            out.add(int(to[a]), doc, uid, s[a:b], (e - s)[a:b], len(whole), packed, size=len(packed) + 16 * (b - a))

    joined = distinct.select("uid", "doc", "z").join(wanted, "uid")
    return map_batches(joined, run, "shard long, doc long, uid long, firsts array<long>, sizes array<long>, n long, z binary")


def repeated_windows(text: np.ndarray, sizes: np.ndarray, store: Store | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each window start of concatenated stretches: whether it lies in one stretch, and whether an equal one starts before it."""
    order, common = suffix_order(text, store, SPAN)
    n = len(text)
    inside = np.ones(n, dtype=bool)
    ends = np.cumsum(sizes)
    for k in range(1, SPAN):
        inside[ends - k] = False
    group = np.flatnonzero(np.append(common[1:] >= SPAN, False) | (common >= SPAN))
    repeated = np.zeros(n, dtype=bool)
    if len(group):
        first = np.flatnonzero(common[group] < SPAN)
        place = np.array(order[group], dtype=np.int64)
        # Windows that cross the end of a stretch are none; they come last in their group.
        least = np.minimum.reduceat(np.where(inside[place], place, n), first)
        repeated[place] = place != np.repeat(least, np.diff(np.append(first, len(group))))
    return inside, repeated & inside


def _sorted(dealt: DataFrame, memory: int) -> DataFrame:
    """doc, uid, at, kind: starts of windows that go (kind 0), or, for shards of several tasks, kept ones with their hash (kind 1).

    Starts come as pairs of first window and number of windows.
    """
    names = ("doc", "uid", "kind", "at", "high", "low")

    def finish(rows, several, out):
        text = np.frombuffer(b"".join([_unpack(r[4]) for r in rows]), dtype=np.uint8)
        sizes = np.concatenate([np.array(r[3], dtype=np.int64) for r in rows])
        inside, repeated = repeated_windows(text, sizes, Store(memory))
        start = 0
        for doc, uid, firsts, sizes_, _ in rows:
            spans: list[int] = []
            for first, size in zip(firsts, sizes_):
                gone = repeated[start : start + size]
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    spans += [first + a, b - a]
                if several:
                    raw = text[start : start + size].tobytes()
                    for p in np.flatnonzero(inside[start : start + size] & ~gone).tolist():
                        h = xxhash.xxh3_128_digest(raw[p : p + SPAN])
                        out.add(doc, uid, 1, [first + p], int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True))
                start += size
                if out.full():
                    yield out.take()
            if spans:
                out.add(doc, uid, 0, spans, None, None, size=8 * len(spans))
            if out.full():
                yield out.take()

    def run(batches):
        out, key, held, several = Buffer(*names), None, [], False
        for shard, salt, salts, doc, uid, firsts, sizes, z in rows_of(batches, "shard", "salt", "salts", "doc", "uid", "firsts", "sizes", "z"):
            if (shard, salt) != key:
                if held:
                    yield from finish(held, several, out)
                key, held, several = (shard, salt), [], salts > 1
            held.append((doc, uid, firsts, sizes, z))
        if held:
            yield from finish(held, several, out)
        yield out.take()

    return map_batches(dealt, run, "doc long, uid long, kind int, at array<long>, high long, low long")


def _cut(spans: DataFrame, distinct: DataFrame) -> DataFrame:
    """doc, sha, n_removed, n_spans, kept, spans: what is left of texts that lose bytes."""

    def run(batches):
        out = Buffer("doc", "sha", "n_removed", "kept", "spans")
        for doc, sha, z, parts in rows_of(batches, "doc", "sha", "z", "parts"):
            text = np.frombuffer(_unpack(z), dtype=np.uint8)
            step = np.zeros(len(text) + 1, dtype=np.int64)
            for part in parts:
                at = np.array(part, dtype=np.int64)
                np.add.at(step, at[::2], 1)
                np.add.at(step, at[::2] + at[1::2] + SPAN - 1, -1)
            gone = np.cumsum(step[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            kept = hashlib.sha256(text[~gone].tobytes()).digest()
            out.add(doc, sha, int(gone.sum()), kept, edges, size=100 + 8 * len(edges))
            if out.full():
                yield out.take()
        yield out.take()

    together = spans.groupBy("uid", "doc").agg(F.collect_list("at").alias("parts")).withColumnRenamed("doc", "_doc")
    joined = distinct.join(together, "uid").where(F.col("doc") - F.col("_doc") == 0).select("doc", "sha", "z", "parts")
    return map_batches(joined, run, "doc long, sha binary, n_removed long, kept binary, spans array<long>")


def _repeats(distinct: DataFrame, shards: int, memory: int) -> DataFrame:
    """doc, sha, n_removed, kept, spans of the texts that lose bytes."""
    single = _anchors(distinct)
    shared = single.groupBy("fp").agg(F.min("uid").alias("_lo"), F.sum("n").alias("_n")).where("_n > 1")
    route = single.join(shared.select("fp", F.pmod(F.xxhash64("_lo"), F.lit(shards)).alias("shard")), "fp")
    wanted = route.groupBy("uid").agg(F.collect_list("fp").alias("fps"), F.collect_list("shard").alias("shards"))
    parts = cut_lineage(_stretches(distinct, wanted))
    salts = parts.groupBy("shard").agg(F.ceil(F.sum("n") / SORT_BYTES).cast("int").alias("salts"))
    salt = F.pmod(F.xxhash64("uid"), F.col("salts")).cast("int")
    dealt = parts.join(salts, "shard").withColumn("salt", salt).repartition("shard", "salt")
    found = cut_lineage(_sorted(dealt.sortWithinPartitions("shard", "salt", "doc", "uid"), memory))
    gone = found.where("kind = 0").select("uid", "doc", "at")
    # Shards of several tasks: of equal windows that different tasks keep, all but the earliest go too.
    kept = found.where("kind = 1").select("high", "low", "doc", "uid", F.col("at")[0].alias("first"))
    earliest = kept.groupBy("high", "low").agg(F.min(F.struct("doc", "uid", "first")).alias("_least"), F.count("*").alias("_n"))
    late = kept.join(earliest.where("_n > 1"), ["high", "low"]).where(F.struct("doc", "uid", "first") > F.col("_least"))
    gone = gone.unionByName(late.select("uid", "doc", F.array(F.col("first"), F.lit(1).cast("long")).alias("at")))
    return cut_lineage(_cut(gone, distinct))


def repeated_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory: int = 512 << 20
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans: one row per row of ``docs``.

    A byte of a text (UTF-8) goes if a string of 100 bytes covers it that also starts earlier: in a document with a smaller id, or in the
    same document before. Strings may overlap themselves and are judged on the input; none crosses documents. ``kept_sha256`` is
    the digest of the bytes that stay, ``spans`` the others as [from, to, from, to, ...], ``n_spans`` their number.

    Null and empty texts lose nothing and have the digest of the empty text. A null id is larger than any other. Repeated rows get the same
    result each and are no reason to remove anything from each other; rows of one id with different texts count as one before
    the other, in an order that is fixed for a run. ``memory``: bytes of arrays that one sort holds before it goes on in files.
    """
    rows = texts(docs, id_col, text_col)
    base = cut_lineage(_base(rows))
    firsts = base.groupBy("sha").agg(F.min("doc").alias("first"), F.max("n_bytes").alias("_n"))
    total = base.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_BYTES))
    with bucketed(*_distinct(rows, firsts.where(F.col("_n") >= SPAN), total), "uid") as distinct:
        cut = _repeats(distinct, shards, memory)
    out = base.join(firsts.select("sha", "first"), "sha").join(cut, ["doc", "sha"], "left")
    copy = (F.col("doc") > F.col("first")) & (F.col("n_bytes") >= SPAN)
    nothing = F.lower(F.sha2(F.lit("").cast("binary"), 256))
    spans = F.when(copy, F.array(F.lit(0).cast("long"), F.col("n_bytes"))).otherwise(
        F.coalesce("spans", F.array().cast("array<long>"))
    )
    return out.select(
        F.when(F.col("doc") < _LAST, F.col("doc")).alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        (F.size(spans) / 2).cast("long").alias("n_spans"),
        F.when(copy, nothing).otherwise(F.lower(F.hex(F.coalesce("kept", "sha")))).alias("kept_sha256"),
        spans.alias("spans"),
    )
