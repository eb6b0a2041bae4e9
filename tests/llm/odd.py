"""Small tables with everything that is awkward: nulls, empties, long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType(
    [StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
     StructField("source", StringType()), StructField("n_chars", LongType())]
    # Names that the operators use for their own columns.
    + [StructField(c, StringType()) for c in ("score", "shard", "size", "node", "kept", "_h", "h", "word", "n", "doc", "_id", "taken")]
)


def sentence(rng: random.Random, n: int, stock: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(stock) for _ in range(rng.randint(2, 7))) for _ in range(n))


def rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    shared = sentence(rng, 70)
    base = sentence(rng, 120)
    near = base.split()
    near[40] = "changed"
    long = sentence(rng, 12_000)
    out = [
        (1, None, "xx", "a", 0), (2, "", "xx", "a", 0), (3, " \t\n\r\x0b\x0c", None, None, 0),
        (4, "one", "xx", "b", 3), (5, "one two three", None, "b", 0), (6, "one  two\tthree", "xx", "b", 0),
        (7, base, "xx", "a", 0), (8, base, "xx", "b", 0), (9, base.replace(" ", "\n"), "xx", None, 0), (10, " ".join(near), "xx", "a", 0),
        (11, sentence(rng, 30) + " " + shared + " " + sentence(rng, 30), "yy", "a", 0),
        (12, sentence(rng, 20, "mnopqrst") + " " + shared + " " + sentence(rng, 9, "mnopqrst"), "yy", "c", 0),
        (13, long, "yy", "c", 0), (14, sentence(rng, 50, "éèêàùç"), "zz", "c", 0), (15, "12 34 56 !!! ***", None, "c", 0),
        (16, "  x y z", "zz", "a", 0), (17, "same same same same same same same same same", "xx", "a", 0),
        (18, "\n".join([sentence(rng, 12)] * 30), "xx", "a", 0), (18, sentence(rng, 80), "xx", "a", 0),
        (None, base, None, "a", 0), (None, "null id", None, None, 0), (7, base, "xx", "a", 0), (2, "", "xx", "a", 0),
        (-5, shared + " tail", "yy", "c", 0), (19, "Released under the MIT License.", "yy", "c", 0),
    ]
    return [(*r, *(["clash"] * 12)) for r in out]


def frame(spark, seed: int = 1):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
