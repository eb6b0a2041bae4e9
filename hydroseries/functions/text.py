"""Name clean-up and string similarity."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words and bracketed remarks taken out of a station name, in this order.
NAME_REMARKS = ("(bubble)", "(laut)", "(kali)")
NAME_WORDS = ("p.a.", "p.s.", "pompa", "rumah pompa", "pintu air", "bendung.", "waduk")


def clean_name(c: Column) -> Column:
    """Lower case, without remarks, type words, digits and punctuation, single spaces."""
    s = F.lower(c)
    for word in NAME_REMARKS + NAME_WORDS:
        s = F.replace(s, F.lit(word), F.lit(""))
    s = F.regexp_replace(s, r"\d+", "")
    s = F.regexp_replace(s, r"[^a-z\s]", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return 1 - F.levenshtein(a, b) / F.nullif(longest, F.lit(0))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of the standard library; Arrow batches, only on candidate pairs."""
    m = difflib.SequenceMatcher(None)
    out = []
    for x, y in zip(a, b):
        m.set_seqs(x, y)
        out.append(m.ratio())
    return pd.Series(out, dtype="float64")
