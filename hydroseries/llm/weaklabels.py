"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on every document. Expectation-maximisation estimates
each heuristic's accuracies from how the votes agree; the posterior of good, not a hand label, then
trains a linear scorer over hashed features of the text.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries.llm.common import Buffer, WordIds, map_batches, rows_of, texts
from hydroseries.session import cut_lineage

GOOD, BAD, NONE = "g", "b", "-"
_SYMBOLS = b"#$%&*|<>{}[]~^=@\\_/+"
_LETTERS_LOW = bytes(range(97, 123))
_DIGITS = b"0123456789"


def _vote(value: float, good: tuple[float, float], bad_below: float, bad_above: float) -> str:
    if value < bad_below or value > bad_above:
        return BAD
    return GOOD if good[0] <= value <= good[1] else NONE


#: What each place of a vote text stands for.
LABELLERS = (
    "length", "symbols", "repeated_lines", "distinct_words", "word_length", "sentence_ends", "short_words", "digits",
)


def votes(text: bytes) -> str:
    """One letter per labeller. Empty text: bad by length, no other vote."""
    words = text.split()
    n = len(words)
    if not n:
        return BAD + NONE * (len(LABELLERS) - 1)
    size = len(text)
    symbols = (size - len(text.translate(None, _SYMBOLS))) / size
    digits = (size - len(text.translate(None, _DIGITS))) / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines)
    distinct = len(set(words)) / n ** 0.9
    mean = sum(map(len, words)) / n
    ends = sum(x.rstrip()[-1:] in b".!?\"" for x in lines) / len(lines)
    short = sum(len(w) <= 3 for w in words) / n
    return "".join((
        _vote(n, (40, 1e9), 12, 1e12),
        _vote(symbols, (0, 0.005), 0, 0.03),
        _vote(repeated, (0, 0.0), 0, 0.25) if len(lines) >= 3 else NONE,
        _vote(distinct, (0.6, 9), 0.35, 99) if n >= 20 else NONE,
        _vote(mean, (3.5, 9), 2.5, 14),
        _vote(ends, (0.7, 1), 0.3, 1),
        _vote(short, (0.2, 0.75), 0.06, 0.9) if n >= 20 else NONE,
        _vote(digits, (0, 0.02), 0, 0.12),
    ))


def fit_labellers(patterns: list[tuple[str, int]], rounds: int = 60) -> tuple[float, np.ndarray, dict[str, float]]:
    """Prior of good, table (labeller, class, vote) of probabilities, posterior of good for each vote text.

    ``patterns`` counts the distinct vote texts: three to the power of the labellers at most, whatever the input.
    Labellers count as independent given the class; a vote of nothing tells nothing.
    """
    if not patterns:
        return 0.5, np.zeros((len(LABELLERS), 2, 2)), {}
    x = np.array([[{GOOD: 1, BAD: 0, NONE: -1}[c] for c in p] for p, _ in patterns])
    n = np.array([c for _, c in patterns], dtype=float)
    cast = x >= 0
    # The majority is the first guess, which also says which class is called good.
    post = ((x == 1).sum(1) + 1) / (cast.sum(1) + 2)
    for _ in range(rounds):
        prior = np.clip((n * post).sum() / n.sum(), 0.02, 0.98)
        table = np.empty((x.shape[1], 2, 2))
        for k in range(x.shape[1]):
            for c, weight in ((0, n * (1 - post)), (1, n * post)):
                for v in (0, 1):
                    # Smoothed towards a labeller that is right three times in four.
                    table[k, c, v] = (weight[x[:, k] == v].sum() + (3.0 if v == c else 1.0)) / (weight[cast[:, k]].sum() + 4)
        log = np.log(table)
        odds = np.full(len(n), np.log(prior / (1 - prior)))
        for k in range(x.shape[1]):
            gain = log[k, 1] - log[k, 0]
            odds += np.where(cast[:, k], gain[np.maximum(x[:, k], 0)], 0)
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return float(prior), table, {p: float(q) for (p, _), q in zip(patterns, post)}


def _shape(word: bytes) -> bytes:
    """Runs of letters, digits and bytes beyond ASCII fold to one sign each; other signs stay as they are."""
    out = bytearray()
    for c in word:
        kind = 97 if 97 <= (c | 32) <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c
        if not out or out[-1] != kind or kind not in (97, 48):
            out.append(kind)
    return bytes(out[:12])


class Features:
    """Hashed features of a text: words, word shapes, pairs of shapes, and line marks; unit length."""

    def __init__(self, bits: int):
        mask = (1 << bits) - 1
        self.mask = mask
        self.ids = WordIds(lambda w: (zlib.crc32(w) & mask) << 32 | zlib.crc32(b"s " + _shape(w)) & mask)

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if not words:
            return np.zeros(1, dtype=np.int64), np.ones(1)
        ids = self.ids
        both = np.array([ids[w] for w in words], dtype=np.int64)
        word, shape = both >> 32, both & 0xFFFFFFFF
        pair = (shape[:-1] * 0x9E3779B1 + shape[1:]) & self.mask
        lines = text.split(b"\n")
        again = int(8 * (1 - len(set(lines)) / len(lines)))
        long = min(12, len(words).bit_length())
        marks = np.array([zlib.crc32(b"again %d" % again) & self.mask, zlib.crc32(b"size %d" % long) & self.mask, 0])
        groups = []
        for part, weight in ((word, 0.5), (shape, 1.0), (pair, 0.7), (marks, 1.0)):
            at, n = np.unique(part, return_counts=True)
            v = np.log1p(n)
            groups.append((at, weight * v / max(np.linalg.norm(v), 1e-9)))
        return np.concatenate([g[0] for g in groups]), np.concatenate([g[1] for g in groups])


def vote_rows(rows: DataFrame) -> DataFrame:
    """doc_id, votes; ``rows`` as from ``common.texts``."""

    def run(batches):
        out = Buffer("doc_id", "votes")
        for who, text in rows_of(batches, "doc_id", "text"):
            out.add(who, votes(text or b""))
            if out.full():
                yield out.take()
        yield out.take()

    return map_batches(rows, run, "doc_id long, votes string")


def train_scorer(
    rows: DataFrame, posterior: dict[str, float], bits: int = 15, most: int = 20_000, rounds: int = 12, rows_in_all: int = 0
) -> np.ndarray:
    """Weights of the linear scorer, from posteriors as soft labels.

    Fitted on a sample of about ``most`` documents, chosen by a hash of id and text (all documents, if there are no more).
    Each round sums the gradient over the sample in Spark; 2^bits numbers come back.
    """
    spark = rows.sparkSession
    if not rows_in_all:
        return np.zeros(1 << bits)
    # Of 2^20 hash values so many are in the sample; equal rows fall in or out together.
    limit = min(1 << 20, int(most / rows_in_all * (1 << 20)) + 1)
    sample = rows.where(F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(1 << 20)) < limit)
    label = spark.sparkContext.broadcast(posterior)

    def features(batches):
        f, out = Features(bits), Buffer("y", "at", "v")
        for (text,) in rows_of(batches, "text"):
            at, v = f.of(text or b"")
            out.add(label.value.get(votes(text or b""), 0.5), at, v.astype(np.float32), size=12 * len(at))
            if out.full():
                yield out.take()
        yield out.take()

    table = cut_lineage(map_batches(sample, features, "y double, at array<int>, v array<float>"))
    w, step, past = np.zeros(1 << bits), 1.0, np.zeros(1 << bits)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(w)

        def gradient(batches, now=now):
            g, n = np.zeros(len(now.value)), 0
            for y, at, v in rows_of(batches, "y", "at", "v"):
                at, v = np.asarray(at), np.asarray(v)
                p = 1 / (1 + np.exp(-np.clip(now.value[at] @ v, -30, 30)))
                np.add.at(g, at, (p - y) * v)
                n += 1
            # Whole numbers, so that the sum doesn't depend on its order; place -1 counts the rows.
            used = np.flatnonzero(g)
            yield {"at": np.concatenate([[-1], used]).astype(np.int32), "g": np.rint(np.concatenate([[n], g[used]]) * 1e6).astype(np.int64)}

        sums = map_batches(table, gradient, "at int, g long").groupBy("at").agg(F.sum("g").alias("g")).toPandas()
        now.unpersist()
        at, g = sums["at"].to_numpy(), sums["g"].to_numpy() / 1e6
        n = max(1.0, g[at < 0].sum())
        full = np.zeros(1 << bits)
        full[at[at >= 0]] = g[at >= 0]
        full = full / n + 1e-6 * w
        past += full ** 2
        w = w - step * full / (np.sqrt(past) + 1e-6)
    return w


def quality_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 15, most: int = 20_000, threshold: float = 0.5
) -> DataFrame:
    """doc_id, posterior (of the votes), score (of the linear scorer, 0 to 1), kept (score at or above the threshold).

    Null text counts as empty: bad by length. Null or repeated ids are rows like others. Empty table: no rows.
    """
    rows = texts(docs, id_col, text_col)
    voted = cut_lineage(vote_rows(rows))
    counts = voted.groupBy("votes").agg(F.count("*").alias("n")).collect()  # 3^labellers rows at most
    patterns = sorted((r["votes"], r["n"]) for r in counts)
    _, _, posterior = fit_labellers(patterns)
    w = train_scorer(rows, posterior, bits, most, rows_in_all=sum(n for _, n in patterns))
    sc = docs.sparkSession.sparkContext
    weights, label = sc.broadcast(w), sc.broadcast(posterior)

    def run(batches):
        f, out = Features(bits), Buffer("doc_id", "posterior", "score")
        for who, text in rows_of(batches, "doc_id", "text"):
            at, v = f.of(text or b"")
            p = 1 / (1 + np.exp(-np.clip(weights.value[at] @ v, -30, 30)))
            out.add(who, round(label.value[votes(text or b"")], 6), round(float(p), 6))
            if out.full():
                yield out.take()
        yield out.take()

    scored = map_batches(rows, run, "doc_id long, posterior double, score double")
    return scored.withColumn("kept", F.col("score") >= threshold)
