"""The hidden Markov recursions, the latent space and its candidates against brute force."""

import itertools
import math
import random

import numpy as np
import pytest

from hydroseries.llm import latent
from hydroseries.llm.common import texts
from hydroseries.llm.markov import _Lattice, score_texts

from .odd import sentence


def paths(seq, start, move, emit):
    """Probability of every sequence of states."""
    for states in itertools.product(range(len(start)), repeat=len(seq)):
        p = start[states[0]] * emit[seq[0], states[0]]
        for a, b, x in zip(states, states[1:], seq[1:]):
            p *= move[a, b] * emit[x, b]
        yield states, p


def test_forward_and_expected_counts_equal_all_paths():
    rng = np.random.default_rng(2)
    k, symbols = 3, 5
    start, move = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), size=k)
    emit = rng.dirichlet(np.ones(symbols), size=k).T
    seqs = [rng.integers(0, symbols, n) for n in (4, 1, 6, 3, 6)]
    starts, moves, sums, want = np.zeros(k), np.zeros((k, k)), np.zeros((symbols, k)), []
    for seq in seqs:
        all_ = list(paths(seq, start, move, emit))
        total = sum(p for _, p in all_)
        want.append(math.log(total))
        for states, p in all_:
            starts[states[0]] += p / total
            for a, b in zip(states, states[1:]):
                moves[a, b] += p / total
            for s, x in zip(states, seq):
                sums[x, s] += p / total
    lattice = _Lattice(seqs)
    np.testing.assert_allclose(lattice.forward(start, move, emit, False)[0], want)
    first, got_moves, gamma, ll = lattice.expect(start, move, emit)
    np.testing.assert_allclose(ll, want)
    np.testing.assert_allclose(first, starts)
    np.testing.assert_allclose(got_moves, moves)
    np.testing.assert_allclose(np.array([np.bincount(lattice.symbols, gamma[:, s], minlength=symbols) for s in range(k)]).T, sums)


def test_more_symbols_than_bits_are_refused(spark):
    with pytest.raises(ValueError, match="16 bits"):
        score_texts(spark.createDataFrame([(1, "a")], "doc_id long, text string"), symbols=65_300)


def test_latent_space_and_candidates(spark):
    """The randomised SVD keeps nearly as much as the best space of its rank, and the candidates are all windows near an item."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, sentence(rng, 90, "abcdefgh")) for i in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(i, sentence(rng, rng.randint(16, 60), "abcdefgh")) for i in range(50)], "item_id long, text string").repartition(4)
    idf = latent.inverse_frequencies(texts(docs))
    passages = latent.item_passages(items, idf, "item_id", "text")
    space = latent.latent_space(passages, 20)
    held = passages.collect()
    a = np.zeros((len(held), latent.TERMS))
    for row, r in zip(a, held):
        row[r["at"]] = r["v"]
    np.testing.assert_allclose(space.T @ space, np.eye(20), atol=1e-8)
    best = (np.linalg.svd(a, compute_uv=False)[:20] ** 2).sum()
    assert ((a @ space) ** 2).sum() > 0.9 * best
    searcher = latent.Searcher([(r["item_id"], r["words"], np.array(r["at"]), np.array(r["v"])) for r in held], idf, space, 0.35, 0.75, 0.6, 0.75)
    searcher.prepare()
    batch = [r["text"].encode().split() for r in docs.collect()[:20]] + [[w for r in held[:3] for w in map(bytes, r["words"])], []]
    got = {(int(t), int(x), int(n), int(q)) for part in searcher.windows(batch) for t, x, n, q in zip(*part[:4])}
    kept = a @ space
    aims = kept / (kept**2).sum(axis=1, keepdims=True)
    want, close = set(), set()
    for t, words in enumerate(batch):
        blocks = -(-len(words) // latent.BLOCK)
        for x in range(blocks):
            for width in latent.WIDTHS:
                n = min(width, blocks - x)
                v = np.zeros(latent.TERMS)
                for w in words[x * latent.BLOCK : (x + n) * latent.BLOCK]:
                    v[latent.term(w)] += idf[latent.term(w)]
                size = math.sqrt(sum(idf[latent.term(w)] ** 2 for w in words[x * latent.BLOCK : (x + n) * latent.BLOCK]))
                for q, cosine in enumerate(aims @ (v @ space) / size):
                    (close if abs(cosine - 0.35) < 1e-4 else want if cosine >= 0.35 else set()).add((t, x, n, q))
    assert got - close == want - close and len(want) > 10
