"""Point-level quality flags: flag, never drop or fill.

0 pass, 1 sentinel or outside the 0.1 / 99.9 percentiles, 2 stuck for more than an hour,
3 rate of change beyond its 99.9 percentile, 4 repeated time. Priority 1 > 4 > 2 > 3 > 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hydroseries.functions import timeparts as tp
from hydroseries.functions.cleaning import SENTINELS, holds, is_sentinel, nan_to_null
from hydroseries.operators.frames import first_per_key, join_per_key
from hydroseries.operators.quantiles import exact_quantiles
from hydroseries.session import share


def drop_repeated_times(df: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """Keep the first row (by ``tie``) of every key and time."""
    return first_per_key(df, [*keys, ts], [F.col(tie)])


def flag_repeated_times(df: DataFrame, keys: Sequence[str], ts: str, tie: str, out: str = "is_copy") -> DataFrame:
    """True for all rows of a key and time but the first by ``tie``; missing keys or times equal each other.

    The first copy comes from an aggregate, so a time with very many copies is folded
    before the shuffle; the join back is one adaptive execution can split.
    """
    first = df.groupBy(*keys, ts).agg(F.min(tie).alias("_first"))
    first = first.select("_first", *[F.col(c).alias(f"_of_{c}") for c in (*keys, ts)])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*keys, ts)])
    return df.join(first, same).select(*df.columns, (~F.col(tie).eqNullSafe(F.col("_first"))).alias(out))


def _instants(df: DataFrame, part: Sequence[str], ts: str, tie: str) -> DataFrame:
    """One row per key and time: first and last value, whether all copies agree."""
    v = F.col("_v")
    return df.groupBy(*part, "_chunk", ts).agg(
        F.min(tie).alias("_tie"),
        F.min_by(F.struct(v.alias("v")), tie)["v"].alias("_first"),
        F.max_by(F.struct(v.alias("v")), tie)["v"].alias("_last"),
        holds((F.count(v) == F.count("*")) & (F.min(v) == F.max(v))).alias("_same"),
    )


def _runs_and_rates(inst: DataFrame, part: Sequence[str], ts: str) -> DataFrame:
    """First and last time of the run of equal values each instant belongs to, and its rate.

    Inside a chunk runs are found by looking one instant back and ahead. A run that
    touches the border of a chunk is continued with the chunk summaries: its start is the
    last break of an earlier chunk, its end the first break of a later one.
    """
    part = list(part)
    up = Window.partitionBy(*part, "_chunk").orderBy(ts)
    down = Window.partitionBy(*part, "_chunk").orderBy(F.col(ts).desc())
    running = Window.unboundedPreceding, 0
    edge = F.struct(F.col(ts).alias("ts"), F.col("_first").alias("first"), F.col("_last").alias("last"),
                    F.col("_same").alias("same"))

    def started(here, before):
        """Known start of the run of ``here``, NULL when it goes on from ``before``."""
        cut = ~holds(here["first"] == before["last"])
        return F.when(before.isNull(), None).when(cut, here["ts"]).when(~before["same"], before["ts"])

    def ended(here, after):
        cut = ~holds(here["last"] == after["first"])
        return F.when(~here["same"], here["ts"]).when(after.isNotNull() & cut, here["ts"])

    local = inst.withColumns({"_e": edge}).repartition(*part, "_chunk").withColumns(
        {"_p": F.lag("_e").over(up), "_x": F.lead("_e").over(up)}
    )
    local = local.withColumns(
        {"_starts": started(F.col("_e"), F.col("_p")), "_ends": ended(F.col("_e"), F.col("_x"))}
    ).select(*part, "_chunk", ts, "_tie", "_e", "_p", "_starts", "_ends")
    local = share(local)

    at = F.col(ts)
    chunks = local.groupBy(*part, "_chunk").agg(
        F.min_by("_e", at).alias("_f"),
        F.max_by("_e", at).alias("_l"),
        F.max_by("_starts", F.when(F.col("_starts").isNotNull(), at)).alias("_in_start"),
        F.min_by("_ends", F.when(F.col("_ends").isNotNull(), at)).alias("_in_end"),
    )
    fwd = Window.partitionBy(*part).orderBy("_chunk")
    back = Window.partitionBy(*part).orderBy(F.col("_chunk").desc())
    earlier = Window.unboundedPreceding, -1
    chunks = chunks.withColumns({"_pl": F.lag("_l").over(fwd), "_nf": F.lead("_f").over(fwd)})
    chunks = chunks.withColumns(
        {
            "_at_first": F.when(F.col("_pl").isNull(), F.col("_f.ts")).otherwise(started(F.col("_f"), F.col("_pl"))),
            "_at_last": F.when(F.col("_nf").isNull(), F.col("_l.ts")).otherwise(ended(F.col("_l"), F.col("_nf"))),
        }
    )
    start_known = F.coalesce("_in_start", "_at_first")
    end_known = F.coalesce("_in_end", "_at_last")
    chunks = chunks.select(
        *part, "_chunk", "_pl",
        F.coalesce("_at_first", F.last(start_known, True).over(fwd.rowsBetween(*earlier))).alias("_start0"),
        F.coalesce("_at_last", F.last(end_known, True).over(back.rowsBetween(*earlier))).alias("_end0"),
    )
    local = local.withColumns(
        {
            "_from": F.last("_starts", True).over(up.rowsBetween(*running)),
            # A running last over the descending order is linear; a frame to the end is quadratic.
            "_to": F.last("_ends", True).over(down.rowsBetween(*running)),
        }
    )
    before = F.coalesce("_p", "_pl")
    gap = F.nullif(tp.minutes_between(F.col(ts), before["ts"]), F.lit(0.0))
    return local.join(chunks, [*part, "_chunk"]).select(
        *part, "_chunk", ts, "_tie",
        F.coalesce("_from", "_start0").alias("_run_from"),
        F.coalesce("_to", "_end0").alias("_run_to"),
        (F.abs(F.col("_e.first") - before["last"]) / gap * 10).alias("_rate"),
    )


def point_qc(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    tie: str,
    calibration: str = "series_year",
    sentinels: Sequence[float] = SENTINELS,
    stuck_minutes: float = 60.0,
    min_obs: int = 100,
    out: str = "qc_flag",
) -> DataFrame:
    """Add the flag to every row. ``tie`` orders rows of equal time and must be unique there.

    ``calibration``: ``series_year`` computes percentiles, runs and rates inside one key and
    year of ``ts`` (local time), ``series`` over the whole key. A row without key or time gets flag 1
    and takes no part in the limits, runs and rates of others.
    """
    keys = list(keys)
    year = F.year(ts) if calibration == "series_year" else F.lit(0)
    part = [*keys, "_cal"]
    rows = df.withColumns(
        {"_cal": year, "_chunk": tp.day_number(F.col(ts)), "_v": nan_to_null(F.col(value))}
    )
    lost = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in (*keys, ts)])
    placed = rows.where(~lost)
    inst = _instants(placed, part, ts, tie)

    runs = _runs_and_rates(inst, part, ts)

    limits = exact_quantiles(placed, part, F.col("_v"), {"_lo": 0.001, "_hi": 0.999}, "_n_v", "_n")
    rates = exact_quantiles(runs, part, F.col("_rate"), {"_rate_max": 0.999}, "_n_rate")
    limits = limits.join(rates, part, "left")

    marks = runs.select(
        *part, "_chunk", ts, "_tie", "_rate",
        (tp.minutes_between(F.col("_run_to"), F.col("_run_from")) > stuck_minutes).alias("_stuck"),
    )
    enough = F.col("_n") >= min_obs
    bad_value = is_sentinel(F.col("_v"), sentinels) | holds(
        enough & ((F.col("_v") < F.col("_lo")) | (F.col("_v") > F.col("_hi")))
    )
    spike = holds((F.col("_n_rate") >= min_obs) & (F.col("_rate") > F.col("_rate_max")))
    flag = (
        F.when(lost | bad_value, 1)
        .when(F.col(tie) != F.col("_tie"), 4)
        .when(F.col("_stuck"), 2)
        .when(spike, 3)
        .otherwise(0)
    )
    joined = join_per_key(rows.join(marks, [*part, "_chunk", ts], "left"), limits, part, spread=ts)
    return joined.select(*df.columns, flag.cast("tinyint").alias(out))
