"""Fuzzy matching of names, exact without comparing every pair."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries.functions.cleaning import in_box, to_number
from hydroseries.functions.text import clean_name, edit_similarity, sequence_ratio
from hydroseries.operators.frames import first_per_key

CUTOFF = 0.6
RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate"


def _tokens(name: Column) -> Column:
    """Letters with a running number per letter, so that a set stands for the multiset; rarest first."""
    letters = F.array_sort(F.split(name, ""))
    numbered = F.transform(
        letters,
        lambda c, i: F.struct(
            (F.array_position(letters, c) - 1 - i).cast("int").alias("nth"), F.instr(F.lit(RARE_FIRST), c).alias("rank"), c.alias("c")
        ),
    )
    return F.array_sort(numbered)


def similar_pairs(left: DataFrame, right: DataFrame, share: float, longest: float) -> DataFrame:
    """Pairs of distinct names (a, b) that may be similar; no similar pair is missed.

    ``share``: a similar pair has at least this part of either name's letters in common.
    ``longest``: the longer name has at most this many times the letters of the shorter.
    With letters in a fixed order, two sets with k elements in common share an element
    among the first n - k + 1 of each, so pairs are found by equality on those elements.
    """

    def side(df, name):
        n = F.length(name)
        need = F.ceil(n * share - 1e-9)
        t = df.select(F.col(name)).distinct().withColumn("_t", _tokens(F.col(name)))
        return t.select(name, F.explode(F.slice("_t", F.lit(1), (n - need + 1).cast("int"))).alias("tok"), n.alias(f"_n_{name}"), "_t")

    a = side(left.select(F.col("a")).where(F.length("a") > 0), "a").withColumnRenamed("_t", "_ta")
    b = side(right.select(F.col("b")).where(F.length("b") > 0), "b").withColumnRenamed("_t", "_tb")
    shorter, longer = F.least("_n_a", "_n_b"), F.greatest("_n_a", "_n_b")
    common = F.size(F.array_intersect("_ta", "_tb"))
    pairs = a.join(b, "tok").where((longer <= shorter * longest) & (common >= share * longer - 1e-9))
    return pairs.select("a", "b").distinct()


def _rare_grams(names: DataFrame, name: str, seen: DataFrame, cutoff: float) -> DataFrame:
    """name, gram, pos: the rarest pairs of letters of each name, as many as a similar name must meet one of.

    A name of n letters, framed, has n + 1 pairs of letters. Each edit spoils two of them, so names of similarity
    ``cutoff`` or more have (2 cutoff - 1) n + 1 in common; one of those is among the others, plus one, that come first.
    """
    grams = _grams(names, name).join(seen, "gram")
    row = F.array_sort(F.collect_list(F.struct("_seen", "gram", "pos")))
    common = F.ceil((2 * cutoff - 1) * F.length(name) + 1 - 1e-9)
    kept = F.slice("_g", F.lit(1), (F.length(name) + 2 - common).cast("int"))
    return grams.groupBy(name).agg(row.alias("_g")).select(name, F.inline(kept)).drop("_seen")


def _grams(names: DataFrame, name: str) -> DataFrame:
    framed = F.concat(F.lit("^"), F.col(name), F.lit("$"))
    at = F.sequence(F.lit(1), F.length(name) + 1)
    return names.select(name, F.inline(F.transform(at, lambda i: F.struct(F.substr(framed, i, F.lit(2)).alias("gram"), i.alias("pos")))))


def edit_pairs(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """Pairs of distinct names (a, b) that may reach the cutoff of the edit similarity; none that does is missed.

    An inverted index of rare pairs of letters, in the order of the number of places they have: pairs of letters that an
    alignment of two names leaves alone come in the same order in both and lie no farther apart than there are edits, so the
    rarest of them is among the indexed ones of both names. For cutoffs below a half letters are indexed, see ``similar_pairs``.
    """
    if cutoff < 0.5:
        return similar_pairs(left, right, cutoff, 1 / cutoff)
    lone = {n: df.select(n).where(F.length(n) > 0).distinct() for n, df in (("a", left), ("b", right))}
    every = _grams(lone["a"], "a").select("gram").unionByName(_grams(lone["b"], "b").select("gram"))
    seen = every.groupBy("gram").agg(F.count("*").alias("_seen"))
    a = _rare_grams(lone["a"], "a", seen, cutoff)
    b = _rare_grams(lone["b"], "b", seen, cutoff).withColumnRenamed("pos", "_pos")
    shorter, longer = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
    edits = F.floor((1 - cutoff) * longer + 1e-9)
    near = (longer - shorter <= edits) & (F.abs(F.col("pos") - F.col("_pos")) <= edits)
    return a.join(b, "gram").where(near).select("a", "b").distinct()


def edit_matches(left: DataFrame, right: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Best partner (b) of each name (a) by 1 - distance / longer length, if it reaches the cutoff; the first in the alphabet on ties."""
    pairs = edit_pairs(left, right, cutoff)
    scored = pairs.withColumn("score", edit_similarity(F.col("a"), F.col("b"))).where(F.col("score") >= cutoff)
    best = scored.groupBy("a").agg(F.min_by(F.struct("b", "score"), F.struct(-F.col("score"), F.col("b"))).alias("_m"))
    return best.select("a", "_m.b", "_m.score")


def sequence_matches(left: DataFrame, right: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Best partner by the Ratcliff/Obershelp ratio; the later name in the alphabet on ties.

    Equal names need no comparison; only the remaining candidate pairs reach Python.
    """
    lone = left.select("a").distinct()
    same = lone.join(right.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select(
        "a", F.col("a").alias("b"), F.lit(1.0).alias("score")
    )
    rest = lone.join(same.select("a"), "a", "left_anti")
    # ratio = 2 * common / (n_a + n_b), so the shorter name has at least cutoff / (2 - cutoff) of the longer one's
    # letters, and of the longer name at least that share is common.
    span = (2 - cutoff) / cutoff
    pairs = similar_pairs(rest, right, 1 / span, span)
    close = pairs.withColumn("_r", sequence_ratio(F.col("b"), F.col("a"))).where(F.col("_r") >= cutoff)
    best = close.groupBy("a").agg(F.max_by("b", F.struct("_r", "b")).alias("b"))
    return same.unionByName(best.withColumn("score", sequence_ratio(F.col("a"), F.col("b"))))


MEASURES = {"ratio": sequence_matches, "edit": edit_matches}


def station_match(
    stations: DataFrame, candidates: DataFrame, box: tuple[float, float, float, float],
    source_order: list[str], alias: Mapping[int, int] | None = None, cutoff: float = CUTOFF, measure: str = "ratio",
) -> DataFrame:
    """Coordinates for stations from the best named place of several sources.

    ``stations``: station_id, name. ``candidates``: source, name, lat, lon (text) and
    ``pos``, the order in the source. Per source the first place of a cleaned name counts;
    the best score over the sources wins, the earlier source on ties. Below the cutoff or
    outside the box there is no match. ``alias`` lets a station share the result of another.
    ``measure``: ``ratio`` (see ``sequence_matches``) or ``edit`` (``edit_matches``, column expressions only).
    """
    c = candidates.select(
        "source", "pos", F.col("name").alias("match"), clean_name(F.col("name")).alias("b"),
        to_number(F.col("lat")).alias("lat"), to_number(F.col("lon")).alias("lon"),
    ).where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("b") != ""))
    c = first_per_key(c, ["source", "b"], [F.col("pos")]).drop("pos")
    alias = dict(alias or {})
    s = stations.select("station_id", "name", clean_name(F.col("name")).alias("a"))
    order = F.array_position(F.array(*[F.lit(x) for x in source_order]), F.col("source"))

    best = None
    for source in source_order:
        part = c.where(F.col("source") == source)
        hit = MEASURES[measure](s, part, cutoff).join(part, "b")
        best = hit if best is None else best.unionByName(hit)
    row = F.struct("match", "score", "lat", "lon", "source")
    best = best.groupBy("a").agg(F.min_by(row, F.struct(-F.col("score"), order)).alias("_m"))
    m = F.col("_m")
    ok = (m["score"] >= cutoff) & in_box(m["lat"], m["lon"], box)
    found = s.join(best, "a", "left").select(
        "station_id", "name", *[F.when(ok, m[f]).alias(f) for f in ("match", "lat", "lon", "source")],
        F.when(ok, m["score"]).otherwise(0.0).alias("score"),
    )
    if not alias:
        return found
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in alias.items()])
    via = F.try_element_at(F.map_from_entries(pairs), F.col("station_id").cast("int"))
    own = found.select("station_id", "name", F.coalesce(via, F.col("station_id").cast("int")).alias("_via"))
    shared = found.drop("name").withColumn("_via", F.col("station_id").cast("int")).drop("station_id")
    return own.join(shared, "_via", "left").drop("_via")
