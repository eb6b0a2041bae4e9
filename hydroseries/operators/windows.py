"""Forecast windows, baselines and a learned linear baseline."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries.functions import timeparts as tp
from hydroseries.operators.frames import in_blocks, with_position


def positioned(df: DataFrame, keys: Sequence[str], ts: str, strict_time: bool) -> DataFrame:
    """Adds ``pos``: the hour number (``strict_time``) or the row number in the series.

    Row numbers join unrelated hours across a missing stretch. Hour numbers never do: frames over them
    (``shifted``, ``span``) count hours, and an hour without a row is missing.
    """
    if strict_time:
        return df.withColumn("pos", tp.hour_number(F.col(ts)))
    return with_position(df.withColumn("_chunk", tp.day_number(F.col(ts))), keys, "_chunk", [ts], "pos").drop("_chunk")


def shifted(column: str, by: int, strict_time: bool) -> Callable[[object], Column]:
    """The column ``by`` rows later, or with ``strict_time`` at the position exactly ``by`` hours later (NULL if it has no row)."""
    if by == 0:
        return lambda w: F.col(column)
    if strict_time:
        return lambda w: F.max(column).over(w.rangeBetween(by, by))
    return lambda w: (F.lead(column, by) if by > 0 else F.lag(column, -by)).over(w)


def span(w, first: int, last: int, strict_time: bool):
    return w.rangeBetween(first, last) if strict_time else w.rowsBetween(first, last)


def make_windows(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    target: str,
    known: str,
    driver: str,
    flag: str,
    lookback: int = 72,
    horizon: int = 1,
    extra: bool = False,
    strict_time: bool = False,
) -> DataFrame:
    """One row per window without missing values: history [t-lookback+1 .. t], target t+horizon.

    ``history`` is an array of structs of target, ``known`` and ``driver`` over the history.
    ``known`` is a driver known ahead, its value at the target time is ``known_future``.
    ``extra`` adds the value 24 hours before the target, the change of ``known`` and the
    last value; it needs ``horizon <= 24``. Steps are rows, with ``strict_time`` hours: then a window
    with an absent hour is left out like one with a missing value. At most one row per series and hour.
    """
    if extra and horizon > 24:
        raise ValueError("the 24-hour persistence inputs need horizon <= 24")
    L, h = int(lookback), int(horizon)
    back = 24 - h

    cols = {
        "history": lambda w: F.collect_list(F.struct(target, known, driver)).over(span(w, 1 - L, 0, strict_time)),
        "_n": lambda w: F.least(*[F.count(c).over(span(w, 1 - L, 0, strict_time)) for c in (target, known, driver)]),
        "_flags": lambda w: F.max(flag).over(span(w, 1 - L, 0, strict_time)),
        "target_ts": shifted(ts, h, strict_time),
        "y": shifted(target, h, strict_time),
        "known_future": shifted(known, h, strict_time),
        "qc_target": shifted(flag, h, strict_time),
    }
    if extra:
        cols["y_day_before"] = shifted(target, -back, strict_time)
    out = in_blocks(positioned(df, keys, ts, strict_time), keys, "pos", cols, before=max(L - 1, back), after=h)
    ok = (F.col("_n") == L) & F.col("y").isNotNull() & F.col("known_future").isNotNull()
    picked = [
        *keys, F.col(ts), F.col("target_ts"), F.col("history"), F.col("known_future"), F.col("y"),
        F.col(target).alias("y_last"), F.col("qc_target"), F.greatest("_flags", "qc_target").alias("qc_any"),
    ]
    if extra:
        ok = ok & F.col("y_day_before").isNotNull()
        picked += [F.col("y_day_before"), (F.col("known_future") - F.col(known)).alias("known_change")]
    return out.where(ok).select(*picked)


def baseline_forecast(
    df: DataFrame, keys: Sequence[str], ts: str, target: str, horizon: int, strict_time: bool = True
) -> DataFrame:
    """For each time t: y(t+h), persistence y(t), day-before y(t+h-24) and the residual against the latter.

    Hours by ``strict_time``: times without a row at t+h are left out, an absent day-before is NULL.
    """
    h = int(horizon)
    back = 24 - h
    cols = {
        "target_ts": shifted(ts, h, strict_time),
        "y": shifted(target, h, strict_time),
        "day_before": shifted(target, -back, strict_time),
    }
    out = in_blocks(positioned(df, keys, ts, strict_time), keys, "pos", cols, before=max(back, 0), after=max(h, -back))
    return out.where(F.col("target_ts").isNotNull()).select(
        *keys, ts, "target_ts", F.lit(h).alias("horizon"), "y",
        F.col(target).alias("persistence"), "day_before", (F.col("y") - F.col("day_before")).alias("residual"),
    )


def standardise(df: DataFrame, columns: Sequence[str], train: str, weight: str | None = None) -> DataFrame:
    """(x - mean) / (std + 1e-8) with mean and population deviation of the training rows.

    ``weight`` counts a row several times, as overlapping windows do. The statistics are
    one row and enter as a scalar subquery.
    """
    t = F.col(train)
    wt = F.when(t, F.col(weight).cast("double") if weight else F.lit(1.0))
    aggs, scaled = [], []
    for c in columns:
        x = F.when(t & F.col(c).isNotNull(), F.col(c).cast("double"))
        n = F.sum(F.when(x.isNotNull(), wt))
        mean = F.sum(wt * x) / n
        spread = F.sqrt(F.greatest(F.sum(wt * x * x) / n - mean * mean, F.lit(0.0))) if weight else F.stddev_pop(x)
        aggs += [mean.alias(f"m_{c}"), spread.alias(f"d_{c}")]
        m, d = F.col("_stats")[f"m_{c}"], F.col("_stats")[f"d_{c}"]
        scaled.append(((F.col(c) - m) / (d + 1e-8)).alias(f"{c}_scaled"))
    stats = df.agg(F.struct(*aggs)).scalar()
    return df.withColumn("_stats", stats).select(*df.columns, *scaled)


def train_linear(windows: DataFrame, horizon_rows: str, peak_weight: float = 5.0, peak_prob: float = 0.9):
    """Least squares on the window features, training rows marked by the boolean ``horizon_rows``.

    Features are the history, the known driver at the target time and the last value;
    targets above the ``peak_prob`` quantile of training weigh ``peak_weight``. Returns the
    fitted pipeline model and the windows with ``yhat``.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    from hydroseries.operators.quantiles import exact_quantiles

    train = windows.where(horizon_rows)
    peak = exact_quantiles(train.withColumn("_g", F.lit(0)), ["_g"], F.col("y"), {"peak": peak_prob})
    flat = F.flatten(F.transform("history", lambda s: F.array(*[s[c].cast("double") for c in _fields(windows)])))
    ready = windows.withColumns({"history_vec": array_to_vector(flat), "peak": peak.select("peak").scalar()})
    ready = ready.withColumn("weight", F.when(F.col("y") > F.col("peak"), peak_weight).otherwise(1.0)).drop("peak")
    steps = [
        VectorAssembler(inputCols=["history_vec", "known_future", "y_last"], outputCol="features"),
        LinearRegression(
            featuresCol="features", labelCol="y", weightCol="weight", predictionCol="yhat", regParam=1e-6, solver="normal"
        ),
    ]
    model = Pipeline(stages=steps).fit(ready.where(horizon_rows))
    return model, model.transform(ready).drop("features", "history_vec")


def _fields(windows: DataFrame) -> list[str]:
    return [f.name for f in windows.schema["history"].dataType.elementType.fields]
