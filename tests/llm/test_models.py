"""Operators that learn or search: held-out accuracy, planted cases, odd rows, empty tables."""

import random
import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from hydroseries.llm import hyperdim, latent, licenses, weaklabels

from .odd import empty, frame, rows, sentence

DATA = "/root/testdata/sf0.001"


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = hyperdim.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and len(held) > 20
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_languages_of_odd_rows(spark):
    got = hyperdim.identify_languages(frame(spark)).collect()
    assert len(got) == len(rows())
    known = {r[2] for r in rows() if r[2]}
    want = {i: t is not None and any(c.isalpha() for c in t) for i, t, *_ in rows()}
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] != 18:
            assert (r["lang_pred"] in known) == want[r["doc_id"]] and (r["lang_pred"] == "und") != want[r["doc_id"]]
    assert hyperdim.identify_languages(empty(spark)).count() == 0
    kept = hyperdim.keep_known_languages(frame(spark))
    assert kept.columns == frame(spark).columns
    assert {1, 2, 3, 15}.isdisjoint(r["doc_id"] for r in kept.collect()) and kept.count() == len(rows()) - 5
    # Without any labelled text there is no language to name.
    assert {r["lang_pred"] for r in hyperdim.identify_languages(frame(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_encoder_in_parts():
    """Vectors do not depend on the batch or on how often the caches were emptied."""
    import numpy as np

    rng = random.Random(4)
    batch = [sentence(rng, 40, "abcdefghijklmnopqrstuvwxyzéü").encode() for _ in range(9)] + [None, b"", "日本語 \U00020000".encode()]
    small, large = hyperdim.Encoder(most=50), hyperdim.Encoder()
    whole = large.encode(batch)
    assert np.allclose(whole, small.encode(batch), atol=1e-5)
    assert np.allclose(whole, np.concatenate([small.encode([t]) for t in batch]), atol=1e-5)
    assert not whole[9].any() and not whole[10].any() and whole[11].any()


def test_quality_against_labels(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = weaklabels.quality_scores(docs)
    assert got.count() == docs.count()
    both = got.join(labels, "doc_id").toPandas()
    rank, good = both["score"].rank(), both["quality"] == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.9
    assert both[good]["kept"].mean() > 0.97


def test_quality_of_odd_rows(spark):
    got = weaklabels.quality_scores(frame(spark)).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 and 0 <= r["posterior"] <= 1 for r in got)
    assert weaklabels.quality_scores(empty(spark)).count() == 0


def test_em_finds_accuracies():
    """Votes drawn from known accuracies: the estimates come near them and the posterior beats each labeller."""
    rng = random.Random(9)
    right = [0.9, 0.8, 0.7, 0.65, 0.85, 0.6, 0.75, 0.7]
    truth, counts = [], {}
    for _ in range(4000):
        y = rng.random() < 0.6
        v = "".join("-" if rng.random() < 0.3 else "gb"[(rng.random() < p) != y] for p in right)
        truth.append((v, y))
        counts[v] = counts.get(v, 0) + 1
    prior, table, post = weaklabels.fit_labellers(sorted(counts.items()))
    assert abs(prior - 0.6) < 0.05
    assert all(abs(table[k, 1, 1] - p) < 0.06 for k, p in enumerate(right))
    assert sum((post[v] > 0.5) == y for v, y in truth) / len(truth) > 0.85


def test_license_spans(spark):
    mit = licenses.TEMPLATES["MIT/text"]
    changed = mit.replace("free of charge", "without any charge").replace("sublicense", "relicense")
    docs = [
        (1, "Intro é ü.\nReleased under the MIT License. More."), (2, "x y " * 500 + changed + " and so on"), (3, None), (4, ""),
        (5, "Licensed under the Apache License, Version 2.0."), (6, "licensed under something else entirely"),
        (7, "Released under the MIT License. " * 2), (7, "Released under the MIT License. " * 2),
    ]
    got = licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["license"]), []).append(r)
    assert set(by) == {(1, "MIT/line"), (2, "MIT/text"), (5, "Apache-2.0/line"), (7, "MIT/line")}
    r = by[1, "MIT/line"][0]
    assert docs[0][1][r["char_from"] : r["char_to"]] == "Released under the MIT License" and r["coverage"] == 1
    assert 0.9 < by[2, "MIT/text"][0]["coverage"] < 1 and by[2, "MIT/text"][0]["word_from"] == 1000
    assert len(by[7, "MIT/line"]) == 4
    assert licenses.scan_licenses(empty(spark)).count() == 0
    assert {r["doc_id"] for r in licenses.scan_licenses(frame(spark)).collect()} == {19}


def test_leaks(spark):
    rng = random.Random(6)
    items = [(k, sentence(rng, rng.randint(15, 60), "abcdefghijkl")) for k in range(30)] + [(90, None), (91, ""), (92, "two words"), (7, None)]
    docs, want = [], set()
    for i in range(80):
        w = sentence(rng, rng.randint(0, 300), "abcdefghijkl").split()
        if i % 4 == 0:
            k = rng.randrange(30)
            part = items[k][1].split()
            if i % 8 == 0:  # a paraphrase: every ninth word changed, one missing
                part = [x if n % 9 else "other" for n, x in enumerate(part)]
                del part[len(part) // 2]
            at = rng.randint(0, len(w))
            w[at:at] = part
            want.add((i, k))
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = latent.find_leaks(df, bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    clean = latent.without_leaks(df, bench)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert latent.find_leaks(empty(spark), bench).count() == 0
    assert latent.find_leaks(df, bench.where("false")).count() == 0
    assert latent.find_leaks(frame(spark), bench).count() == 0
    assert latent.without_leaks(frame(spark), bench).count() == len(rows())


def planted(rng, n):
    """n items in documents of their own, every second one as a paraphrase; (documents, items)."""
    items = [(k, sentence(rng, rng.randint(16, 59), "abcdefghijkl")) for k in range(n)]
    docs = []
    for k, text in items:
        w, part = sentence(rng, rng.randint(40, 120), "abcdefghijkl").split(), text.split()
        if k % 2:  # every ninth word changed, one missing
            part = [x if i % 9 else "other" for i, x in enumerate(part)]
            del part[len(part) // 2]
        at = rng.randint(0, len(w))
        w[at:at] = part
        docs.append((k, " ".join(w)))
    return docs, items


def test_leaks_of_a_large_benchmark(spark):
    """What is found does not depend on how many items there are."""
    docs, items = planted(random.Random(11), 2_500)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    got = latent.find_leaks(df, spark.createDataFrame(items, "item_id long, text string").repartition(3))
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(k, k) for k in range(2_500)]


def test_leaks_in_parts(spark):
    """A benchmark of more passages than a part holds is searched whole, and an item of passages in several parts is one row."""
    docs, items = planted(random.Random(12), 150)
    long = " ".join(text for _, text in items[:8])
    docs += [(1_000, long), (1_000, long), (None, items[0][1])]
    items += [(500, long), (3, items[3][1]), (None, items[4][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = latent.find_leaks(df, bench).collect()
    assert {(k, k) for k in range(150)} | {(4, None), (1_000, 500), (None, 0)} <= {(r["doc_id"], r["item_id"]) for r in want}
    got = latent.find_leaks(df, bench, most=40)
    assert sorted(got.collect(), key=repr) == sorted(want, key=repr)
    assert latent.without_leaks(df, bench, most=40).count() == 0


def test_common_length():
    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], max(row[j + 1], row[j], last + 1 if x == y else 0)
        return row[-1]

    rng = random.Random(8)
    for _ in range(200):
        a, b = ([bytes([rng.randrange(97, 102)]) for _ in range(rng.randint(1, 70))] for _ in range(2))
        assert latent.common_length(latent.place_masks(a), len(a), b) == brute(a, b)


def test_pipeline(spark):
    """Every stage against what it promises, on its own input."""
    docs, columns = spark.read.parquet(f"{DATA}/documents.parquet"), None
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        before, after = docs.toPandas(), out.toPandas()
        if name != "shard":
            assert out.columns == columns
        if name in ("language", "near_dedup", "decontaminate"):
            assert after["doc_id"].is_unique and set(after["doc_id"]) <= set(before["doc_id"])
        if name == "language":
            assert len(after) == sum(any(c.isalpha() for c in t) for t in before["text"])
        if name == "near_dedup":
            from .test_exact import brute_classes

            classes = brute_classes(list(zip(before["doc_id"].tolist(), before["text"])))
            assert set(after["doc_id"]) == {c for _, c, _ in classes}
        if name == "decontaminate":
            bench = spark.read.parquet(f"{DATA}/benchmark.parquet").toPandas()["text"]
            leaks = {i for i, t in zip(before["doc_id"], before["text"]) if any(b in t for b in bench)}
            assert leaks and set(after["doc_id"]) == set(before["doc_id"]) - leaks
        if name == "mix":
            size = dict(zip(before["doc_id"], before["text"].map(lambda t: len(t.encode().split()))))
            assert after["doc_id"].value_counts().max() <= 2
            assert abs(after["doc_id"].map(size).sum() / (1.5 * sum(size.values())) - 1) < 0.15
        if name == "shard":
            counts = after["shard"].value_counts()
            assert len(after) == len(before) and counts.max() - counts.min() <= 1
        docs = spark.createDataFrame(after[columns], docs.schema) if name != "shard" else out
    assert corpus_pipeline.run(spark, DATA).count() == len(after)
