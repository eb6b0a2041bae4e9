"""Token alignment, substring deduplication and whitening against brute force, with awkward rows."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from hydroseries.llm import alignment, substrings
from hydroseries.llm.alignment import align_tokens
from hydroseries.llm.induction import Store, suffix_order
from hydroseries.llm.substrings import repeated_substrings
from hydroseries.llm.whitening import inertia, leading_eigenpairs, whitened_rows

from .odd import empty, frame, rows, sentence


def plain(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


# --- suffix order ---------------------------------------------------------------------------------------------------


def shared(a, b, most):
    k = 0
    while k < min(len(a), len(b), most) and a[k] == b[k]:
        k += 1
    return k


@pytest.mark.parametrize("budget", [64, 1 << 20])
def test_suffix_order_and_common_prefixes(budget):
    """Random, periodic and constant texts; in memory and with queues on disk."""
    for seed in range(120):
        rng = np.random.default_rng(seed)
        n, letters = int(rng.integers(1, 260)), int(rng.integers(1, 6))
        x = rng.integers(0, letters, n).astype(np.uint8)
        if seed % 3 == 0:
            x = np.tile(x[: max(1, n // 5)], 5)
        if seed % 7 == 0:
            x = np.concatenate([x, np.full(50, 3, np.uint8), x, np.full(20, 3, np.uint8)])
        b = x.tobytes()
        want = sorted(range(len(b)), key=lambda i: b[i:])
        store = Store(budget)
        order, common = suffix_order(x, store, cap=20)
        assert order.tolist() == want
        assert common.tolist() == [0] + [shared(b[p:], b[q:], 20) for p, q in zip(want, want[1:])]
        assert store.on_disk == 0 or budget == 64
    assert suffix_order(np.empty(0, np.uint8), cap=9)[0].tolist() == []


# --- substrings -----------------------------------------------------------------------------------------------------


def brute_substrings(table, span=100):
    """Rows in order of id (null last); rows of one id and text are no reason to remove anything from each other."""
    last = 1 << 63
    seen, memo, out = {}, {}, []
    for who, text in sorted(table, key=lambda r: (last if r[0] is None else r[0])):
        b = (text or "").encode()
        if (who, b) not in memo:
            gone = bytearray(len(b))
            for p in range(len(b) - span + 1):
                w = b[p : p + span]
                if w in seen:
                    gone[p : p + span] = b"\1" * span
                else:
                    seen[w] = who
            runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
            kept = bytes(x for x, g in zip(b, gone) if not g)
            memo[who, b] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
        out.append((who, *memo[who, b]))
    return sorted(out, key=repr)


def passages(seed=5):
    rng = random.Random(seed)
    stock = ["alpha", "beta", "gamma", "delta", "zeta", "eta", "theta", "été"]
    shared_ = [" ".join(rng.choice(stock) for _ in range(30)) for _ in range(6)]
    out = []
    for i in range(150):
        parts = [rng.choice([rng.choice(shared_), sentence(rng, rng.randint(1, 20))]) for _ in range(rng.randint(0, 6))]
        out.append((i, " ".join(parts)))
    return out + [(200, "a" * 1000), (201, "a" * 99), (202, "ab" * 300), (203, None), (204, ""), (205, "a" * 100 + "b" + "a" * 150), (206, out[5][1])]


COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("most", [16 << 20, 2000])
def test_substrings_equal_brute_force(spark, monkeypatch, most):
    """With one sort per shard, and with shards dealt over several tasks."""
    monkeypatch.setattr(substrings, "SORT_BYTES", most)
    table = passages()
    got = repeated_substrings(spark.createDataFrame(table, "doc_id long, text string").repartition(4), memory=1 << 16)
    assert plain(got, *COLUMNS) == brute_substrings(table)
    for r in got.collect():
        assert sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])) == r.n_removed


def test_substrings_of_awkward_rows(spark):
    table = [(r[0], r[1]) for r in rows() if r[0] != 18]
    got = repeated_substrings(frame(spark).where("doc_id is null or doc_id != 18"))
    assert plain(got, *COLUMNS) == brute_substrings(table)
    assert repeated_substrings(empty(spark)).count() == 0
    # Two texts of one id that share a passage: one of the two keeps it.
    passage = sentence(random.Random(2), 60)
    two = spark.createDataFrame([(1, "x " + passage), (1, "y " + passage)], "doc_id long, text string")
    assert sorted(r.n_removed > 0 for r in repeated_substrings(two).collect()) == [False, True]


def test_long_texts_are_cut_for_anchors_only(spark, monkeypatch):
    monkeypatch.setattr(substrings, "_BLOCK", 600)
    table = passages(6)[:60] + [(90, sentence(random.Random(1), 400)), (91, sentence(random.Random(1), 400)[300:] + " end")]
    got = repeated_substrings(spark.createDataFrame(table, "doc_id long, text string"))
    assert plain(got, *COLUMNS) == brute_substrings(table)


# --- alignment ------------------------------------------------------------------------------------------------------

needs_files = pytest.mark.skipif(not os.path.exists(alignment.FOLDER), reason="no vocabulary files")


def brute_alignment(table):
    """Both tokenizers over whole texts by their own libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.A_FILE}")
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.B_FILE}")
    stand_in = alignment._byte_level()
    links, rows_ = Counter(), []
    for who, text in table:
        a = a_side.encode(" " + text, add_special_tokens=False) if text else None
        a_ids, b_ids = (a.ids, b_side.encode(text)) if text else ([], [])
        a_bytes = [bytes(stand_in[c] for c in t) for t in a.tokens] if text else []
        b_bytes = []
        for i in b_ids:
            p = b_side.id_to_piece(i)
            b_bytes.append(bytes([int(p[3:5], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode())
        whole = (" " + text).encode() if text else b""
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            rows_.append((who, 0, 0, [], []))
            continue
        a_ends = np.cumsum([len(x) for x in a_bytes]).tolist()
        b_ends = np.cumsum([len(x) for x in b_bytes]).tolist()
        groups, mine, i0, j0 = [], [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            i, j = a_ends.index(end) + 1, b_ends.index(end) + 1
            groups.append(f"{','.join(map(str, a_ids[i0:i]))}|{','.join(map(str, b_ids[j0:j]))}")
            mine.append((b_ids[j - 1], a_ids[i - 1]))
            i0, j0 = i, j
        links.update(mine)
        rows_.append((who, len(a_ids), len(b_ids), groups, mine))
    top = {}
    for (b, _), n in links.items():
        top[b] = max(top.get(b, 0), n)
    return sorted([
        (who, n_a, n_b, len(g), len(m), sum(links[x] == top[x[0]] for x in m), sum(links[x] for x in m),
         hashlib.sha256(";".join(g).encode()).hexdigest() if n_a else "") for who, n_a, n_b, g, m in rows_
    ], key=repr)


ODD_TEXTS = ["<|endoftext|> <s> </s> <unk> <0x0A>", "  two  spaces   and\ttabs\n\nlines ", " lead", "trail ", "a b   c", "▁ low line ▁x",
             "中文 没有 空格的文字", "emoji 👩‍👩‍👧 é é ﬁ", "x" * 5000, "don't won't 12,345.67 \x1c \x85 end", " ", "\n", "a b  c　d", "​ zero", "\x00 nul"]


@needs_files
def test_alignment_equals_whole_text_encoding(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_LINKS", 500)
    monkeypatch.setattr(alignment, "MERGE_BYTES", 400)
    rng = random.Random(4)
    table = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(100 + i, sentence(rng, 30, "aeiounrst ")) for i in range(60)]
    table += [(r[0], r[1]) for r in rows()]
    got = align_tokens(spark.createDataFrame(table, "doc_id long, text string").repartition(3))
    assert plain(got) == brute_alignment(table)
    assert align_tokens(empty(spark)).count() == 0
    assert align_tokens(frame(spark)).count() == len(rows())


@needs_files
def test_remembered_segments_are_forgotten_in_time(monkeypatch):
    pair, fresh = alignment.Pair(), alignment.Pair()
    monkeypatch.setattr(alignment, "_SEGMENTS", 40)
    rng = random.Random(7)
    for _ in range(30):
        text = sentence(rng, 25, "abc")
        (n_a, n_b, groups, links), want = pair.encode([text])[0], fresh.encode([text])[0]
        assert (n_a, n_b, groups, links.tolist()) == (*want[:3], want[3].tolist())
        fresh.clear()
        assert len(pair.groups) <= 40 + 26 + 20


# --- whitening ------------------------------------------------------------------------------------------------------


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 12, 30):
        m = rng.normal(size=(n, n))
        m = m + m.T
        for shift in (*rng.normal(0, 3, 6), 0.0):
            assert inertia(m, shift) == (np.linalg.eigvalsh(m) < shift).sum()
    # A zero diagonal needs pivots of two.
    assert inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_eigenpairs_with_equal_and_zero_eigenvalues():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(20, 20)))
    for spectrum in (np.r_[9, 9, 9, 5, 5, np.arange(4, 0, -0.5), np.zeros(7)], np.r_[np.ones(20)], np.r_[7, np.zeros(19)], np.linspace(1, 1 + 1e-9, 20)):
        v = q @ np.diag(np.sort(spectrum)[::-1]) @ q.T
        values, vectors = leading_eigenpairs((v + v.T) / 2, 16)
        want = np.sort(spectrum)[::-1][:16]
        want = want[want > 1e-9]
        np.testing.assert_allclose(values, want, rtol=1e-10)
        np.testing.assert_allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-10)
        np.testing.assert_allclose(v @ vectors, vectors * values, atol=1e-9)
    assert leading_eigenpairs(np.zeros((4, 4)))[0].size == 0


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 0.3, (400, 6)) @ rng.normal(size=(6, 18)) + rng.normal(0, 0.05, (400, 18)) + 2
    table = [(i, [float(v) for v in x], "clash") for i, x in enumerate(base)] + [(i, [float(v) for v in base[0]], "copy") for i in range(400, 520)]
    odd = [(600, None, "x"), (601, [1.0] * 17 + [None], "x"), (602, [1.0] * 17 + [float("nan")], "x"), (603, [float("inf")] * 18, "x"), (604, [], "x"), (None, table[3][1], "x"), (605, [1.0], "short")]
    df = spark.createDataFrame(table + odd, "vec_id long, embedding array<double>, component string").repartition(5)
    out = whitened_rows(df).toPandas()
    x = np.floor(64 * np.array([t[1] for t in table])).astype(int) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    v = np.cov(fit.T, bias=True)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    assert len(out) == (len(table) + 1) * 16 and set(out.n) == {n} and out.vec_id.isna().sum() == 16
    got = out[out.vec_id.notna()].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    np.testing.assert_allclose(np.abs(got), np.abs((x - fit.mean(axis=0)) @ u / np.sqrt(e)), atol=1e-8)
    np.testing.assert_allclose(out.groupby("component").explained.first(), e / np.trace(v), rtol=1e-10)
    assert out.identity_error.nunique() == 1 and out.identity_error[0] < 1e-9
    want = ((n * x - total) ** 2).sum(axis=1)
    assert out[out.vec_id.notna()].drop_duplicates("vec_id").set_index("vec_id").deviation.sort_index().tolist() == want.tolist()


def test_whitening_of_few_equal_or_huge_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    assert whitened_rows(spark.createDataFrame([], kind)).count() == 0
    assert whitened_rows(spark.createDataFrame([(1, [1.0, 2.0])] * 3, kind)).count() == 0
    line = whitened_rows(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0])], kind)).collect()
    assert sorted((r.vec_id, r.component, abs(round(r.whitened, 9))) for r in line) == [(1, 1, 1.0), (2, 1, 1.0)]
    huge = whitened_rows(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1e15, 5.0])], kind)).collect()
    assert {r.deviation for r in huge} == {None} and all(np.isfinite(r.whitened) for r in huge)
