"""Coverage, missing rates and gaps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructType

from hydroseries.functions import timeparts as tp
from hydroseries.functions.cleaning import nan_to_null
from hydroseries.operators.frames import scan_series, top_per_key


def coverage(df: DataFrame, keys: Sequence[str], ts: str, share: str | None = None) -> DataFrame:
    aggs = [F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n")]
    if share:
        aggs.append(F.round(F.avg(share), 4).alias("mean_share"))
    return df.groupBy(*keys).agg(*aggs)


def monthly_missing(df: DataFrame, keys: Sequence[str], ts: str, per_day: int = 144) -> DataFrame:
    """Rows per month against the number expected at ``per_day`` rows a day."""
    month = tp.month_of(F.col(ts))
    n = df.groupBy(*keys, month.alias("month")).agg(F.count("*").alias("n_obs"))
    expected = (tp.days_in_month(F.col("month")) * per_day).cast("long")
    return n.withColumn("expected", expected).withColumn(
        "missing_rate", F.greatest(F.lit(0.0), 1 - F.col("n_obs") / F.col("expected"))
    )


def monthly_null_rates(df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str]) -> DataFrame:
    month = tp.month_of(F.col(ts)).alias("month")
    return df.groupBy(*keys, month).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])


def flag_histogram(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Rows per flag, missing flags included."""
    return df.groupBy(*keys, flag).agg(F.count("*").alias("n")).orderBy(*keys, flag)


def flag_share_by_month(df: DataFrame, keys: Sequence[str], ts: str, flag: str, wanted: int) -> DataFrame:
    hit = F.coalesce((F.col(flag) == wanted).cast("double"), F.lit(0.0))
    return df.groupBy(*keys, tp.month_of(F.col(ts)).alias("month")).agg((F.avg(hit) * 100).alias("share_pct"))


def longest_gaps(df: DataFrame, keys: Sequence[str], ts: str, tie: str, n: int = 5) -> DataFrame:
    """The ``n`` longest times between consecutive rows of each series, in minutes."""
    work = df.select(*keys, ts, tie).withColumn("_chunk", tp.day_number(F.col(ts)))
    work = scan_series(work, keys, "_chunk", [ts, tie], prev={"gap_from": F.col(ts)})
    work = work.where(F.col("gap_from").isNotNull()).select(
        *keys, "gap_from", F.col(ts).alias("gap_to"),
        tp.minutes_between(F.col(ts), F.col("gap_from")).alias("minutes"),
    )
    return top_per_key(work, keys, [F.col("minutes").desc(), F.col("gap_from")], n)


def longest_missing(df: DataFrame, keys: Sequence[str], ts: str, value: str, n: int = 5) -> DataFrame:
    """The ``n`` longest stretches of rows without a value: first and last row, rows."""
    work = df.select(*keys, ts, value).withColumn("_chunk", F.floor(tp.day_number(F.col(ts)) / 16))
    known = F.when(F.col(value).isNotNull(), F.col(ts))
    work = scan_series(work, keys, "_chunk", [ts], ffill={"_since": known})
    gaps = (
        work.where(F.col(value).isNull())
        .groupBy(*keys, "_since")
        .agg(F.min(ts).alias("gap_from"), F.max(ts).alias("gap_to"), F.count("*").alias("n_rows"))
        .drop("_since")
    )
    return top_per_key(gaps, keys, [F.col("n_rows").desc(), F.col("gap_from")], n)


def _gap_summary(ts: np.ndarray, missing: np.ndarray) -> dict:
    """Rows without a value in one chunk, in order of time: those at its start and end, and the longest run between."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], missing, [False]]).astype(np.int8)))
    first, last = edges[::2], edges[1::2] - 1
    size = last - first + 1
    out = {"n_lead": 0, "lead_to": None, "n_trail": 0, "trail_from": None, "n_inner": 0, "inner_from": None, "inner_to": None, "inner_runs": 0}
    inner = np.ones(len(first), dtype=bool)
    if len(first) and first[0] == 0:
        out |= {"n_lead": int(size[0]), "lead_to": int(ts[last[0]])}
        inner[0] = False
    if len(first) and last[-1] == len(ts) - 1:
        out |= {"n_trail": int(size[-1]), "trail_from": int(ts[first[-1]])}
        inner[-1] = False
    if inner.any():
        best = np.flatnonzero(inner)[size[inner].argmax()]
        out |= {"n_inner": int(size[best]), "inner_from": int(ts[first[best]]), "inner_to": int(ts[last[best]]), "inner_runs": int(inner.sum())}
    return out


def quality_report(df: DataFrame, keys: Sequence[str], ts: str, value: str, flag: str, flags: Sequence[int] = range(10)) -> DataFrame:
    """One row per series: start, end, n_rows, n_missing, missing_rate, n_gaps, longest gap (from, to, rows) and rows per flag.

    A gap is a run of rows without a value. Series are cut into chunks of 16 days; a chunk is summed up in one pass, with its
    gaps at both ends and the longest between, and such summaries are put together along the series: one shuffle of
    the rows and one of a summary per chunk. Of equally long gaps the first counts; rows without a time are left out.
    """
    keys, flags = list(keys), list(flags)
    work = df.where(F.col(ts).isNotNull()).select(
        *keys, F.floor(tp.day_number(F.col(ts)) / 16).alias("_chunk"), tp.micros(F.col(ts)).alias("_us"),
        nan_to_null(F.col(value).cast("double")).isNull().alias("_missing"), F.col(flag).cast("int").alias("_flag"),
    )
    times = ("lead_to", "trail_from", "inner_from", "inner_to")
    counts = ("n_lead", "n_trail", "n_inner", "inner_runs")
    schema = StructType([work.schema[k] for k in keys])
    for name in ("_chunk", "start", "end", "n", "n_missing", *counts, *times):
        schema = schema.add(name, LongType())
    schema = schema.add("n_flags", ArrayType(LongType()))

    def run(table: pa.Table) -> pa.Table:
        us, missing = table["_us"].to_numpy(), table["_missing"].to_numpy(zero_copy_only=False).astype(bool)
        order = np.argsort(us, kind="stable")
        us, missing = us[order], missing[order]
        given = table["_flag"].to_pylist()
        row = {k: table[k][0].as_py() for k in keys} | {"_chunk": table["_chunk"][0].as_py(), "start": int(us[0]), "end": int(us[-1])}
        row |= {"n": len(us), "n_missing": int(missing.sum()), **_gap_summary(us, missing), "n_flags": [given.count(f) for f in flags]}
        return pa.Table.from_pylist([row], schema=to_arrow_schema(schema))

    chunks = work.groupBy(*keys, "_chunk").applyInArrow(run, schema)
    per = chunks.groupBy(*keys).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n_rows"), F.sum("n_missing").alias("n_missing"),
        *[F.sum(F.get("n_flags", F.lit(i))).alias(f"n_flag_{f}") for i, f in enumerate(flags)],
        F.array_sort(F.collect_list(F.struct("_chunk", "start", "end", "n", "n_missing", *counts, *times))).alias("_chunks"),
    )
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")

    def gap(n, a, b):
        return F.struct(n.alias("n"), a.alias("a"), b.alias("b"))

    def state(open_, best, runs):
        return F.struct(open_.alias("open"), best.alias("best"), runs.alias("runs"))

    def longer(best, other):
        return F.when(other["n"] > best["n"], other).otherwise(best)

    def step(s, c):
        all_missing = c["n"] == c["n_missing"]
        going = gap(s["open"]["n"] + c["n"], F.coalesce(s["open"]["a"], c["start"]), c["end"])
        ended = gap(s["open"]["n"] + c["n_lead"], F.coalesce(s["open"]["a"], F.when(c["n_lead"] > 0, c["start"])), F.coalesce(c["lead_to"], s["open"]["b"]))
        best = longer(longer(s["best"], ended), gap(c["n_inner"], c["inner_from"], c["inner_to"]))
        runs = s["runs"] + (ended["n"] > 0).cast("long") + c["inner_runs"]
        trail = gap(c["n_trail"], c["trail_from"], F.when(c["n_trail"] > 0, c["end"]))
        return F.when(all_missing, state(going, s["best"], s["runs"])).otherwise(state(trail, best, runs))

    nothing = gap(zero, none, none)
    done = F.aggregate("_chunks", state(nothing, nothing, zero), step, lambda s: F.struct(
        longer(s["best"], s["open"]).alias("best"), (s["runs"] + (s["open"]["n"] > 0).cast("long")).alias("runs")))
    per = per.withColumn("_g", done)
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return per.select(
        *keys, time(F.col("start")).alias("start"), time(F.col("end")).alias("end"), "n_rows", "n_missing",
        (F.col("n_missing") / F.col("n_rows")).alias("missing_rate"), F.col("_g.runs").alias("n_gaps"),
        time(F.col("_g.best.a")).alias("gap_from"), time(F.col("_g.best.b")).alias("gap_to"), F.col("_g.best.n").alias("gap_rows"),
        *[f"n_flag_{f}" for f in flags],
    )


def correlations(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Pearson matrix in long form: a, b, corr for every ordered pair of columns, incl. the diagonal."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    wide = df.groupBy(*keys).agg(
        *[F.corr(F.when(both(a, b), F.col(a)), F.when(both(a, b), F.col(b))).alias(f"{a}|{b}") for a, b in pairs]
    )
    cells: list[Column] = []
    for a, b in pairs:
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"`{a}|{b}`").alias("corr")))
    return wide.select(*keys, F.inline(F.array(*cells)))
