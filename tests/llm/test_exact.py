"""Exact operators against brute force: owners, mixing, shards, phrases, near-duplicates, unigram scores."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hydroseries.llm import dartmin, phrases, tries
from hydroseries.llm.markov import score_texts
from hydroseries.llm.mixing import mix_sources, mixed_documents, source_targets
from hydroseries.llm.sharding import shard_rows, sharded_documents

from .odd import empty, frame, rows, sentence

LAST = 1 << 63


def words(text):
    return (text or "").encode().split()


def plain(df):
    return sorted(map(tuple, df.collect()), key=repr)


def order(i):
    return LAST if i is None else i


@pytest.mark.parametrize("budget", [48, 0])
def test_owners(spark, budget):
    groups = defaultdict(list)
    for i, t, *_ in rows():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), order(i), i))
    want = []
    for norm, members in groups.items():
        keep = min(members)[2]
        for _, _, i in members:
            want.append((i, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    assert plain(tries.exact_groups(frame(spark), budget_mb=budget)) == sorted(want, key=repr)
    assert tries.exact_groups(empty(spark)).count() == 0


def test_trie_sheds_subtrees(tmp_path):
    """Whatever the budget, and whether subtrees are given on or kept in files, every text is counted once in all."""
    rng = random.Random(3)
    stock = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    want = Counter(stock)
    for budget in (1, 3_000, 20_000, 1 << 30):
        kept, given = tries.PatriciaTrie(budget, str(tmp_path)), tries.PatriciaTrie(budget)
        passed = Counter()
        for n, text in enumerate(stock):
            assert not list(kept.insert(text, [0, n, 1, bytes(32)]))
            for t, owner in given.insert(text, [0, n, 1, bytes(32)]):
                passed[t] += owner[2]
        for t, owner in given.items():
            passed[t] += owner[2]
        found = dict(kept.items())
        assert passed == want and {t: o[2] for t, o in found.items()} == dict(want)
        assert all(o[1] == stock.index(t) for t, o in found.items())
    assert not list(tmp_path.iterdir())


def test_targets_stop_and_share_the_excess(spark):
    sizes = {"a": 100, "b": 1000, "c": 50, None: 10, "d": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, want = 1.5 * sum(sizes.values()), set(sizes), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            want |= {s: level * weight[s] for s in free}
            break
        for s in over:
            want[s] = 2 * sizes[s]
            left -= want[s]
        free -= over
    assert got == pytest.approx(want)


def test_mix(spark):
    got = mix_sources(frame(spark)).join(frame(spark).select("doc_id").distinct(), "doc_id", "left").collect()
    assert len(got) == len(rows())
    size = Counter()
    for _, t, _, s, *_ in rows():
        size[s] += len(words(t))
    per = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        per[r["source_size"], r["target"]] += r["taken"]
    assert sorted(s for s, _ in per) == sorted(size.values())
    for (_, target), taken in per.items():
        assert taken == math.floor(target + 0.5)
    assert sum(t for _, t in per) == pytest.approx(1.5 * sum(size.values()))
    assert plain(mix_sources(frame(spark))) == plain(mix_sources(frame(spark).repartition(7)))
    assert mix_sources(empty(spark)).count() == 0 and mixed_documents(empty(spark)).count() == 0


def test_mixed_documents(spark):
    """A row per copy, columns as before; repeated rows share their copies."""
    taken = mix_sources(frame(spark), whole=True).where("taken > 0")
    want = sum(r["taken"] // r["size"] for r in taken.collect())
    got = mixed_documents(frame(spark))
    assert got.columns == frame(spark).columns and got.count() == want
    texts = {t for _, t, *_ in rows()}
    assert all(r["text"] in texts for r in got.collect())


def test_shards(spark):
    many = frame(spark).withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(20)))).drop("_k")
    got = shard_rows(many).collect()
    n = 20 * len(rows())
    assert len(got) == n
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter({k: 20 * v for k, v in want.items()})
    assert plain(shard_rows(frame(spark))) == plain(shard_rows(frame(spark).repartition(6)))
    assert shard_rows(empty(spark)).count() == 0


def test_shards_match_the_mixture(spark):
    df = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source")
    )
    got = sharded_documents(df).groupBy("source", "shard").count().collect()
    per = defaultdict(list)
    for r in got:
        per[r["source"]].append(r["count"])
    assert all(len(v) == 24 and max(v) - min(v) <= 2 for v in per.values())


def test_sharded_documents_keep_rows(spark):
    got = sharded_documents(frame(spark))
    assert got.count() == len(rows()) and set(frame(spark).columns) <= set(got.columns)
    assert sorted(r["slot"] for r in got.where("law = 'rows'").collect())[0] == 0


def brute_phrases(docs):
    first = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, LAST), order(i))
    out = []
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < order(i):
                gone[k : k + 50] = [True] * 50
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_phrases(spark):
    got = phrases.repeated_spans(frame(spark)).drop("spans")
    assert plain(got) == brute_phrases([(i, t) for i, t, *_ in rows()])
    assert phrases.repeated_spans(empty(spark)).count() == 0


def test_phrases_woven(spark, monkeypatch):
    """Passages cut from each other at random borders, overlapping and repeated inside documents; small shards."""
    monkeypatch.setattr(phrases, "SHARD_WORDS", 150)
    monkeypatch.setattr(phrases, "CHUNK", 60)
    rng = random.Random(11)
    pool = [sentence(rng, 130).split() for _ in range(6)]
    docs = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(pool)
            a = rng.randint(0, 70)
            w += p[a : a + rng.randint(40, 60)] + sentence(rng, rng.randint(0, 8)).split()
        docs.append((i * 7 % 60, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert plain(phrases.repeated_spans(df).drop("spans")) == brute_phrases(docs)


def brute_classes(docs):
    sets = []
    for _, t in docs:
        w = words(t)
        g = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
        sets.append(g)
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b]:
                inter, union = sum((sets[a] & sets[b]).values()), sum((sets[a] | sets[b]).values())
                if inter * 10 >= union * 8:
                    up[max(root(a), root(b))] = min(root(a), root(b))
    groups = defaultdict(list)
    for k, (i, _) in enumerate(docs):
        groups[root(k)].append(i)
    out = []
    for members in groups.values():
        ids = [i for i in members if i is not None]
        out += [(i, min(ids) if ids else None, len(members)) for i in members]
    return sorted(out, key=repr)


def test_near_classes(spark):
    docs = [(i, t) for i, t, *_ in rows()]
    assert plain(dartmin.near_classes(frame(spark)).select("doc_id", "class_id", "class_size")) == brute_classes(docs)
    assert dartmin.near_classes(empty(spark)).count() == 0
    kept = dartmin.without_near_copies(frame(spark))
    assert kept.columns == frame(spark).columns and kept.where("doc_id = 7").count() == 1 and kept.where("doc_id in (8, 9, 10)").count() == 0


def test_one_row_of_each_class_stays(spark):
    """Whatever is repeated or null: a class ends with one row, rows of other texts and those without words all stay."""
    docs = rows()
    base, other = docs[6][1], sentence(random.Random(9), 80)
    docs += [(18, base, "xx", "a", 0, *docs[0][5:]), (None, other, "xx", "a", 0, *docs[0][5:]), (None, other, "xx", "b", 0, *docs[0][5:])]
    df = spark.createDataFrame(docs, frame(spark).schema).repartition(3)
    got = Counter((r["doc_id"], r["text"]) for r in dartmin.without_near_copies(df).collect())
    want = Counter((i, t) for i, t, *_ in docs)
    for i in (8, 18, None):
        del want[i, base]
    for i, t in [k for k in want if k[0] in (9, 10)]:
        del want[i, t]
    del want[6, "one  two\tthree"]
    want[7, base] = want[None, other] = 1
    assert got == want and got[2, ""] == 2 and sum(i == 18 for i, _ in got) == 2


def test_near_classes_of_a_large_group(spark, monkeypatch):
    """Copies of one original around the threshold, compared in several blocks."""
    monkeypatch.setattr(dartmin, "BLOCK", 15)
    rng = random.Random(5)
    base = sentence(rng, 100).split()
    docs = []
    for i in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(100)] = "x%d" % rng.randrange(9999)
        docs.append((i, " ".join(w)))
    docs += [(100 + i, sentence(rng, 60)) for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert plain(dartmin.near_classes(df).select("doc_id", "class_id", "class_size")) == brute_classes(docs)


def test_darts_estimate_weighted_similarity():
    import numpy as np

    rng = np.random.default_rng(2)
    elements = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    a, b = rng.random(300) * 3 + 0.1, rng.random(300) * 3 + 0.1
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    darts = dartmin.Darts(2048)
    got = (darts.signature(elements, a) == darts.signature(elements, b)).mean()
    assert abs(got - want) < 0.05
    few = darts.signature(elements[:1], np.array([0.01]))
    assert len(np.unique(few)) == 2048


def test_unigram_part_and_gain(spark):
    got = plain(score_texts(frame(spark), dictionary=20, symbols=8))
    whole = plain(score_texts(frame(spark)))
    docs = [(i, t) for i, t, *_ in rows()]
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    counts = Counter()
    for i, t in docs:
        if not held(i):
            counts.update((t or "").encode().lower().split())
            counts[b""] += 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in docs:
        w = (t or "").encode().lower().split() + [b""]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        want.append((i, held(i), len(w), sum(x in counts for x in w), n, round(base, 6)))
    for result in (got, whole):
        assert sorted(((*r[:5], round(r[5], 6)) for r in result), key=repr) == sorted(want, key=repr)
        assert all(r[6] < 0 for r in result)
    assert sum(r[6] for r in whole if not r[1]) > sum(r[5] for r in whole if not r[1])
    assert score_texts(empty(spark)).count() == 0


def test_model_is_a_distribution(spark):
    """Over all texts of at most two words of a closed vocabulary the probabilities add up to less than one."""
    docs = [(i, t) for i, t in enumerate(["a b", "a", "b b", "a b", "b", "a a"] * 5)]
    tries_ = [(1000 + k, t) for k, t in enumerate(["", "a", "b", "a a", "a b", "b a", "b b"])]
    df = spark.createDataFrame(docs + tries_, "doc_id long, text string")
    got = {r["doc_id"]: 10 ** r["score"] for r in score_texts(df).collect()}
    assert 0.1 < sum(got[i] for i, _ in tries_) < 1
