"""Names by an index of rare pairs of letters: no similar pair is missed, and few others are compared."""

import random

import pytest
from pyspark.sql import functions as F

from hydroseries.functions.text import edit_similarity
from hydroseries.operators import match


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, name, stock):
    out = list(name)
    for _ in range(rng.randint(0, max(1, len(name) // 2))):
        at = rng.randint(0, len(out))
        kind = rng.random()
        if kind < 0.35:
            out.insert(at, rng.choice(stock))
        elif at < len(out) and kind < 0.7:
            del out[at]
        elif at < len(out):
            out[at] = rng.choice(stock)
    return "".join(out)


@pytest.mark.parametrize("stock,cutoff", [("ab", 0.6), ("abcdefghij $^", 0.5), ("abcdefghij", 0.8), ("abc", 0.4), ("aab", 1.0)])
def test_no_similar_pair_is_missed(spark, stock, cutoff):
    rng = random.Random(len(stock))
    a = ["".join(rng.choice(stock) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    b = ["".join(rng.choice(stock) for _ in range(rng.randint(0, 14))) for _ in range(30)] + [edited(rng, x, stock) for x in a]
    left = spark.createDataFrame([(x,) for x in a + a[:5] + [None]], "a string")
    right = spark.createDataFrame([(x,) for x in b + [None]], "b string")
    got = {(r.a, r.b) for r in match.edit_pairs(left, right, cutoff).collect()}
    want = {(x, y) for x in a for y in b if x and y and 1 - distance(x, y) / max(len(x), len(y)) >= cutoff - 1e-12}
    assert want <= got
    best = {r.a: (r.b, r.score) for r in match.edit_matches(left, right, cutoff).collect()}
    for x in {x for x, _ in want}:
        assert best[x] == min(((y, 1 - distance(x, y) / max(len(x), len(y))) for z, y in want if z == x), key=lambda m: (-m[1], m[0]))
    assert set(best) == {x for x, _ in want}


def test_fewer_names_meet_than_by_letters(spark):
    """Meetings in the index, counted before any check of the pair."""
    rng = random.Random(1)
    syllables = [c + v for c in "bcdghjklmnprstw" for v in "aeiou"]
    names = sorted({" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(2, 3))) for _ in range(2)) for _ in range(400)})
    left, right = (spark.createDataFrame([(x,) for x in names], f"{c} string") for c in "ab")
    new, old = match.edit_pairs(left, right, 0.8), match.similar_pairs(left, right, 0.8, 1.25)
    similar = edit_similarity(F.col("a"), F.col("b")) >= 0.8
    assert new.where(similar).count() == old.where(similar).count() >= len(names)
    n = F.length("a")
    letters = left.select(F.explode(F.slice(match._tokens(F.col("a")), F.lit(1), (n - F.ceil(n * 0.8) + 1).cast("int"))).alias("tok"))
    seen = match._grams(left, "a").groupBy("gram").agg(F.count("*").alias("_seen"))
    meetings = lambda t: t.groupBy(t.columns[-1]).count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    assert 2 * meetings(match._rare_grams(left, "a", seen, 0.8).select("gram")) < meetings(letters)


def test_stations_by_edit_similarity(spark):
    st = spark.createDataFrame([(1, "P.A. Kali Asin"), (2, "Kali Asin laut"), (3, "zzz"), (4, "")], "station_id int, name string")
    cand = spark.createDataFrame([("gates", 1, "Kali Mati", "-6.1", "106.8"), ("pumps", 1, "Kali Asin", "-6.2", "106.9")],
                                 "source string, pos int, name string, lat string, lon string")
    out = match.station_match(st, cand, (-6.35, -5.95, 106.6, 107.05), ["gates", "pumps"], alias={2: 1}, measure="edit")
    got = {r.station_id: (r.match, r.score) for r in out.collect()}
    assert got == {1: ("Kali Asin", 1.0), 2: ("Kali Asin", 1.0), 3: (None, 0.0), 4: (None, 0.0)}
