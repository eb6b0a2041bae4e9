"""Hidden Markov language model over whole texts.

Words are counted in all training texts. The commonest are symbols of the model; every other word belongs to
one of a few hundred classes (by its last two bytes), inside which it has its share of the training counts. Baum-Welch
runs over all training texts: tasks add up expected counts, Spark sums them by symbol. The scaled forward
recursion then gives the exact likelihood of every text.

    P(text) = forward(symbols) * product over rarer words of P(word | class)
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries.llm.common import Buffer, is_held_out, map_batches, rows_of, texts
from hydroseries.session import cut_lineage

CLASSES = 256
STATES = 8
BLUR = 0.05
END = b""  # no word is empty


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def count_words(rows: DataFrame) -> DataFrame:
    """word, n over all texts of ``rows``: lower-cased A-Z, with one end token (the empty word) per text."""

    def run(batches):
        counts: Counter = Counter()
        for (text,) in rows_of(batches, "text"):
            counts.update((text or b"").lower().split())
            counts[END] += 1
            if len(counts) > 200_000:
                yield {"word": list(counts), "n": list(counts.values())}
                counts.clear()
        yield {"word": list(counts), "n": list(counts.values())}

    return map_batches(rows, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _chunks(rows, most: int = 1 << 20):
    """Rows (key, symbols, ...) in runs of about ``most`` symbols."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += len(row[1])
        if held >= most:
            yield part
            part, held = [], 0
    if part:
        yield part


class _Lattice:
    """Forward recursion over many sequences at once: step t handles all sequences longer than t."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        self.rank = np.repeat(np.arange(len(lengths)), lengths)
        flat = np.concatenate([sequences[i] for i in self.order]).astype(np.int64)
        time = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        by_time = np.argsort(time, kind="stable")  # sequences stay in order of length within a step
        self.symbols, self.rank = flat[by_time], self.rank[by_time]
        self.active = np.bincount(time)
        self.starts = np.concatenate([[0], np.cumsum(self.active)])

    def forward(self, start, move, emit, keep: bool):
        """ln likelihood per sequence (in the given order), and if kept the scaled alphas and scales, step after step."""
        n = self.active[0]
        alpha = np.repeat(start[None], n, axis=0)
        alphas = emit[self.symbols] if keep else np.empty((0, len(start)))  # weights of the symbols first, then the alphas
        scales = np.empty(len(self.symbols))
        for t, width in enumerate(self.active.tolist()):
            at = slice(self.starts[t], self.starts[t + 1])
            alpha = (alpha[:width] @ move if t else alpha) * (alphas[at] if keep else emit[self.symbols[at]])
            c = alpha.sum(axis=1)
            alpha /= c[:, None]
            scales[at] = c
            if keep:
                alphas[at] = alpha
        out = np.empty(n)
        out[self.order] = np.bincount(self.rank, np.log(scales), minlength=n)
        return out, alphas, scales

    def expect(self, start, move, emit):
        """Expected counts: starts, moves, posteriors per token (step after step), and the ln likelihoods."""
        ll, gamma, scales = self.forward(start, move, emit, True)
        beta = np.ones((self.active[0], len(start)))
        moves = np.zeros_like(move)
        for t in range(len(self.active) - 2, -1, -1):
            here, there = slice(self.starts[t], self.starts[t + 1]), slice(self.starts[t + 1], self.starts[t + 2])
            wide = self.active[t + 1]
            ahead = emit[self.symbols[there]] * beta[:wide] / scales[there, None]
            moves += gamma[here][:wide].T @ ahead
            beta[:wide] = ahead @ move.T
            gamma[here] *= beta[: self.active[t]]
        return gamma[: self.active[0]].sum(axis=0), moves * move, gamma, ll


def initial_model(words: list[bytes], share: np.ndarray):
    """First guess: states by three marks of a word (short, beyond ASCII, ends in a mark), blurred, moves that like to stay."""
    symbols = len(share)
    kind = np.arange(symbols) % STATES
    for i, w in enumerate(words):
        kind[i] = (len(w) <= 3) | (any(c >= 128 for c in w) << 1) | ((not w[-1:].isalnum() and w[-1:] < b"\x80") << 2)
    emit = np.full((symbols, STATES), 1.0)
    emit[np.arange(symbols), kind] = 6.0
    emit *= share[:, None]
    emit /= emit.sum(axis=0)
    move = np.full((STATES, STATES), 0.5 / STATES) + 0.5 * np.eye(STATES)
    return np.full(STATES, 1 / STATES), move, emit


def _encode(rows: DataFrame, words: list[bytes], counts: list[int], symbols: int) -> DataFrame:
    """One row per text: the symbols (16 bits each), what its dictionary words add to the sums, its other words."""
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast((words, np.array(counts)))  # bounded by the dictionary's size

    def run(batches):
        held, n = shared.value
        number = {w: i for i, w in enumerate(held)}
        symbol = np.array([i if i < symbols else symbols + word_class(w) for i, w in enumerate(held)], dtype=np.int64)
        logs = np.log10(n + 1.0)
        names = ("doc_id", "held_out", "n_tokens", "n_known", "sum_log", "sum_rare", "symbols", "others")
        out = Buffer(*names)
        get = number.get
        for who, out_of, text in rows_of(batches, "doc_id", "held_out", "text"):
            tokens = (text or b"").lower().split()
            tokens.append(END)
            at = np.array([get(w, -1) for w in tokens], dtype=np.int64)
            known = at >= 0
            s = symbol[at]
            rest = [tokens[i] for i in np.flatnonzero(~known).tolist()]
            if rest:
                s[~known] = [symbols + word_class(w) for w in rest]
            got = at[known]
            rare = logs[got[got >= symbols]].sum()
            out.add(
                who, out_of, len(tokens), len(got), float(logs[got].sum()), float(rare), s.astype(np.uint16).tobytes(), rest,
                size=2 * len(s) + 16 * len(rest),
            )
            if out.full():
                yield out.take()
        yield out.take()

    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, sum_log double, sum_rare double, symbols binary, "
        "others array<binary>"
    )
    return map_batches(rows, run, schema)


def train(coded: DataFrame, words: list[bytes], share: np.ndarray, rounds: int = 4):
    """Baum-Welch over all of ``coded``; symbols times states numbers come back from each round."""
    sc = coded.sparkSession.sparkContext
    start, move, emit = initial_model(words, share)
    size = len(share)
    for _ in range(rounds):
        model = sc.broadcast((start, move, emit))

        def expect(batches, model=model):
            a, b, e = model.value
            starts, moves, sums = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((size, STATES))
            for part in _chunks(rows_of(batches, "doc_id", "symbols")):
                lattice = _Lattice([np.frombuffer(s, dtype=np.uint16) for _, s in part])
                first, m, gamma, _ = lattice.expect(a, b, e)
                starts += first
                moves += m
                for k in range(STATES):
                    sums[:, k] += np.bincount(lattice.symbols, gamma[:, k], minlength=size)
            used = np.flatnonzero(sums.any(axis=1))
            # Places after the symbols hold the starts and the moves. Whole numbers sum alike in any order.
            at = np.concatenate([used, size + np.arange(STATES + 1)]).astype(np.int32)
            values = np.rint(np.concatenate([sums[used], starts[None], moves]) * 4096).astype(np.int64)
            yield {"at": at, **{f"s{k}": values[:, k] for k in range(STATES)}}

        columns = [f"s{k}" for k in range(STATES)]
        partial = map_batches(coded, expect, "at int, " + ", ".join(f"{c} long" for c in columns))
        got = partial.groupBy("at").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()
        model.unpersist()
        table = np.zeros((size + STATES + 1, STATES))
        table[got["at"].to_numpy()] = got[columns].to_numpy() / 4096
        start = (table[size] + 1) / (table[size].sum() + STATES)
        move = table[size + 1 :] + 1
        move /= move.sum(axis=1, keepdims=True)
        # Every symbol keeps some weight in every state, by its share of all tokens: classes of words never seen too.
        emit = table[:size] + 1e-3 * share[:, None]
        emit = (1 - BLUR) * emit / emit.sum(axis=0) + BLUR * share[:, None]
    return start, move, emit


def _commonest(counts: DataFrame, most: int):
    """Words and counts above a limit, commonest first: the lowest limit that leaves no more than ``most`` words.

    The limit comes from the number of words of each count, so only what stays is collected. Each count that can matter has a
    word, so ``most`` of the counts are enough.
    """
    sizes = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(most + 1).toPandas()
    fits = sizes["words"].cumsum() <= most
    limit = int(sizes["n"][fits].min()) if fits.any() else 1 << 62
    return counts.where(F.col("n") >= limit).toPandas().sort_values(["n", "word"], ascending=[False, True], kind="stable")


def score_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dictionary: int = 262_144, symbols: int = 16_384,
    rounds: int = 4,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    Learns from the texts whose crc32(doc_id) modulo 7 is not 2 (a null id counts as the empty text). ``base_score`` is the
    add-one unigram score; ``score`` the log10 probability by the model. A null text is the end token alone. Without training
    texts every count is 0 and both scores are those of unknown words alone. Repeated rows are scored, and learned from, each.

    ``symbols`` is part of the model: so many of the commonest words have weights of their own in every state, all others share those of
    their class (by their last two bytes). It changes ``score``; 65,280 is the most. ``dictionary`` bounds memory only, as words beyond it
    are looked up by a join: it holds the words that occur oftener than a limit, the lowest that leaves no more than that
    (so ``symbols`` can be no more either).
    """
    if symbols + CLASSES > 1 << 16:
        raise ValueError(f"symbols and the {CLASSES} classes must fit into 16 bits")
    rows = texts(docs, id_col, text_col).withColumn("held_out", is_held_out(7))
    counts = cut_lineage(count_words(rows.where(~F.col("held_out"))))
    total = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")
    ).first()
    n, v = total["n"], total["v"]
    top = _commonest(counts, dictionary)
    words = [bytes(w) for w in top["word"]]
    number = top["n"].tolist()
    symbols = min(symbols, len(words))
    rare = (
        counts.withColumn("class", F.crc32(F.expr("substring(word, greatest(length(word) - 1, 1), 2)")) % CLASSES)
        .groupBy("class").agg(F.sum("n").alias("n"), F.sum(F.col("n") + 1).alias("weight")).collect()
    )  # one row per class
    of_class, weight = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rare:
        of_class[r["class"]], weight[r["class"]] = r["n"], r["weight"]
    for w, c in zip(words[:symbols], number[:symbols]):
        of_class[word_class(w)] -= c
        weight[word_class(w)] -= c + 1
    # One unit for words never seen, as in the unigram score.
    class_log = np.log10(weight + 1)
    share = np.concatenate([np.array(number[:symbols], dtype=float), of_class + 1])
    share /= share.sum()
    # Texts of like length next to each other: a step of the recursion then handles many texts, not the one long text of each run.
    coded = cut_lineage(_encode(rows, words, number, symbols).sortWithinPartitions("n_tokens", "doc_id"))
    start, move, emit = train(coded.where(~F.col("held_out")).select("doc_id", "symbols"), words[:symbols], share, rounds)
    model = docs.sparkSession.sparkContext.broadcast((start, move, emit))
    base = float(np.log10(n + v + 1))

    names = ("row", "word", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "copies")

    def run(batches):
        from pyspark import TaskContext

        a, b, e = model.value
        prefix, at, out = TaskContext.get().partitionId() << 36, 0, Buffer(*names)
        wanted = rows_of(batches, "doc_id", "symbols", "held_out", "n_tokens", "n_known", "sum_log", "sum_rare", "others")
        for part in _chunks(wanted):
            coded_ = [np.frombuffer(r[1], dtype=np.uint16) for r in part]
            ll = _Lattice(coded_).forward(a, b, e, False)[0] / np.log(10)
            for (who, _, out_of, tokens, known, logs, rare_logs, others), s, x in zip(part, coded_, ll.tolist()):
                key = prefix | at
                at += 1
                drop = class_log[s[s >= symbols].astype(np.int64) - symbols].sum()
                own = b"\n%d" % key  # like no word, so that these rows spread
                out.add(key, own, who, out_of, tokens, known, logs - base * tokens, x + rare_logs - drop, 0)
                for w, c in Counter(others).items():
                    out.add(key, w, None, None, None, None, None, None, c)
                if out.full():
                    yield out.take()
        yield out.take()

    schema = (
        "row long, word binary, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
        "copies long"
    )
    mapped = map_batches(coded, run, schema)
    # Counts of words beyond the dictionary; a text's own row matches none.
    joined = mapped.join(counts.withColumnRenamed("n", "c"), "word", "left")
    more = F.coalesce(F.log10(F.col("c") + 1) * F.col("copies"), F.lit(0.0))
    seen = F.when(F.col("c").isNotNull(), F.col("copies")).otherwise(0)
    out = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.sum(seen)).alias("n_known"),
        (F.max("base_score") + F.sum(more)).alias("base_score"), (F.max("score") + F.sum(more)).alias("score"),
    )
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"
    )
