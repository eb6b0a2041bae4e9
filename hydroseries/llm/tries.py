"""Exact deduplication by owners in compressed radix tries.

Texts are dealt out by length and content hash; every task inserts the full byte strings of its
share into a Patricia trie. A terminal node stores the best document of its text (most code points
of the original, then smallest id) and counts the copies. A trie that outgrows its budget gives its
largest subtree away: before the shuffle the subtree's terminals go on to the next step, after it they
go to a file of the task, which is worked off as a trie of its own at the end.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries.llm.common import SPACES, Buffer, map_batches, rows_of, texts

#: What one node costs beside its label: the object, its dictionary, its terminal.
NODE_BYTES = 400
_RECORD = "<qqqq32s"


class _Node:
    __slots__ = ("file", "kids", "label", "owner")

    def __init__(self, label: bytes, owner: list | None = None):
        self.label, self.owner, self.kids, self.file = label, owner, {}, None


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while low + 1 < high:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


class PatriciaTrie:
    """text -> owner [-code points, id, copies, digest]; the smaller (-code points, id) stays."""

    def __init__(self, budget: int, folder: str | None = None):
        self.root, self.budget, self.folder, self.size = _Node(b""), budget, folder, 0

    def insert(self, text: bytes, owner: list) -> Iterator[tuple[bytes, list]]:
        """Yields the terminals that a trie without a folder gives away."""
        node, rest = self.root, memoryview(text)
        while True:
            if node.file is not None:
                node.file.write(struct.pack(_RECORD, owner[0], owner[1], owner[2], len(rest), owner[3]))
                node.file.write(rest)
                return
            if not rest:
                mine = node.owner
                if mine is None:
                    node.owner = owner
                else:
                    mine[2] += owner[2]
                    if owner[:2] < mine[:2]:
                        mine[:2] = owner[:2]
                return
            kid = node.kids.get(rest[0])
            if kid is None:
                node.kids[rest[0]] = _Node(bytes(rest), owner)
                self.size += NODE_BYTES + len(rest)
                break
            label = kid.label
            if rest[: len(label)] == label:
                node, rest = kid, rest[len(label) :]
                continue
            n = _common(label, bytes(rest[: len(label)]))
            middle = _Node(label[:n])
            kid.label = label[n:]
            middle.kids[kid.label[0]] = kid
            node.kids[label[0]] = middle
            self.size += NODE_BYTES
            node, rest = middle, rest[n:]
        if self.size > self.budget:
            yield from self._shed()

    def _weigh(self) -> dict[int, int]:
        """Bytes of every subtree, by the node's identity."""
        weight: dict[int, int] = {}
        stack = [(self.root, False)]
        while stack:
            node, ready = stack.pop()
            if ready:
                weight[id(node)] = NODE_BYTES + len(node.label) + sum(weight[id(k)] for k in node.kids.values())
            else:
                stack.append((node, True))
                stack.extend((k, False) for k in node.kids.values())
        return weight

    def _shed(self) -> Iterator[tuple[bytes, list]]:
        """Gives away the largest subtree below the first node where the trie really branches."""
        weight = self._weigh()
        node, path = self.root, b""
        while True:
            open_kids = [k for k in node.kids.values() if k.file is None and (k.kids or self.folder is None)]
            if not open_kids:
                self.budget = 2 * self.size  # single texts only: nothing can be split off
                return
            kid = max(open_kids, key=lambda k: weight[id(k)])
            path += node.label
            if weight[id(kid)] <= self.size * 0.7 or not any(k.kids and k.file is None for k in kid.kids.values()):
                break
            node = kid
        self.size -= weight[id(kid)]
        if self.folder is None:
            del node.kids[kid.label[0]]
            yield from self._walk(kid, path)
            return
        stub = _Node(kid.label)
        handle, name = tempfile.mkstemp(dir=self.folder)
        stub.file = os.fdopen(handle, "w+b", buffering=1 << 16)
        os.unlink(name)  # the space is free again as soon as the file is closed, also after a failure
        for text, owner in self._walk(kid, b""):
            rest = text[len(kid.label) :]
            stub.file.write(struct.pack(_RECORD, owner[0], owner[1], owner[2], len(rest), owner[3]))
            stub.file.write(rest)
        node.kids[kid.label[0]] = stub
        self.size += NODE_BYTES + len(kid.label)

    def _walk(self, top: _Node, path: bytes) -> Iterator[tuple[bytes, list]]:
        stack = [(top, path)]
        while stack:
            node, before = stack.pop()
            whole = before + node.label
            if node.owner is not None:
                yield whole, node.owner
            if node.file is not None:
                node.file.seek(0)
                part = PatriciaTrie(self.budget, self.folder)
                while head := node.file.read(struct.calcsize(_RECORD)):
                    points, who, copies, n, digest = struct.unpack(_RECORD, head)
                    for _ in part.insert(node.file.read(n), [points, who, copies, digest]):
                        pass
                node.file.close()
                for text, owner in part.items():
                    yield whole + text, owner
            stack.extend((k, whole) for k in node.kids.values())

    def items(self) -> Iterator[tuple[bytes, list]]:
        return self._walk(self.root, b"")


#: A null id loses against any other at equal length.
_NO_ID = (1 << 63) - 1
_OWNERS = "n_bytes long, digest binary, text binary, points long, keep_id long, copies long"


def _normal(batch: pa.RecordBatch) -> Iterator[tuple]:
    """id, code points, normalised text of each row of a batch with doc_id and text."""
    column = batch.column(batch.schema.get_field_index("text"))
    points = pc.utf8_length(column.cast(pa.string())).to_pylist()
    for who, n, text in zip(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), points, column.to_pylist()):
        yield who, n or 0, (text or b"").translate(None, SPACES)


def text_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and digest (SHA-256) of the normalised text; ``docs`` as from ``common.texts``."""

    def run(batches):
        out = Buffer("doc_id", "n_bytes", "digest")
        for batch in batches:
            for who, _, text in _normal(batch):
                out.add(who, len(text), hashlib.sha256(text).digest())
                if out.full():
                    yield out.take()
        yield out.take()

    return map_batches(docs, run, "doc_id long, n_bytes long, digest binary")


def text_owners(docs: DataFrame, budget_mb: int = 48) -> DataFrame:
    """n_bytes, digest, keep_id, copies: one row per distinct normalised text. ``docs`` as from ``common.texts``."""
    budget = budget_mb << 20

    def put(out: Buffer, text: bytes, owner: list) -> None:
        out.add(len(text), owner[3], text, -owner[0], owner[1], owner[2], size=len(text))

    names = ("n_bytes", "digest", "text", "points", "keep_id", "copies")

    def local(batches):
        """Copies within the task meet before anything is shuffled, so a large group costs a row per task."""
        trie, out = PatriciaTrie(budget), Buffer(*names)
        for batch in batches:
            for who, n, text in _normal(batch):
                owner = [-n, _NO_ID if who is None else who, 1, hashlib.sha256(text).digest()]
                for t, o in trie.insert(text, owner):
                    put(out, t, o)
                if out.full():
                    yield out.take()
        for t, o in trie.items():
            put(out, t, o)
            if out.full():
                yield out.take()
        yield out.take()

    def final(batches):
        with tempfile.TemporaryDirectory() as folder:
            trie, out = PatriciaTrie(budget, folder), Buffer(*names)
            for _, digest, text, points, who, copies in rows_of(batches, *names):
                for _ in trie.insert(text, [-points, who, copies, digest]):
                    pass
            for t, o in trie.items():
                out.add(len(t), o[3], None, -o[0], o[1], o[2])
                if out.full():
                    yield out.take()
            yield out.take()

    met = map_batches(docs, local, _OWNERS).repartition("n_bytes", F.xxhash64("digest"))
    owners = map_batches(met, final, _OWNERS)
    keep = F.when(F.col("keep_id") < _NO_ID, F.col("keep_id"))
    return owners.select("n_bytes", "digest", keep.alias("keep_id"), F.col("copies").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget_mb: int = 48) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Texts are equal when they are identical without the characters of ``[\\x20\\x09-\\x0D]``; a null text counts as empty.
    Of equal texts the row with most code points stays, then the smallest id; a null id loses against others. Repeated
    rows (same id, same text) are copies of each other that carry one id: they all show ``kept`` when their id stays.
    """
    rows = texts(docs, id_col, text_col)
    joined = text_digests(rows).join(text_owners(rows, budget_mb), ["n_bytes", "digest"])
    return joined.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
