"""Forecast scores: regression, exceedance, anomaly and event scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries.functions import timeparts as tp
from hydroseries.functions.cleaning import holds
from hydroseries.operators.frames import join_per_key
from hydroseries.operators.harmonize import trailing_median
from hydroseries.operators.quantiles import exact_quantiles, medians

COUNTS = ("tp", "fp", "fn", "n_obs_hours")


def regression_aggs(y: Column, yhat: Column, prefix: str = "", where: Column | None = None, suffix: str = "") -> list[Column]:
    """NSE, RMSE, MAE and n in one pass; NSE is NULL when the observations do not vary."""
    ok = y.isNotNull() & yhat.isNotNull()
    if where is not None:
        ok = ok & where
    e = F.when(ok, y - yhat)
    spread = F.var_pop(F.when(ok, y)) * F.count(e)
    return [
        (1 - F.sum(e * e) / F.nullif(spread, F.lit(0.0))).alias(f"{prefix}nse{suffix}"),
        F.sqrt(F.avg(e * e)).alias(f"{prefix}rmse{suffix}"),
        F.avg(F.abs(e)).alias(f"{prefix}mae{suffix}"),
        F.count(e).alias(f"{prefix}n{suffix}"),
    ]


def forecast_scores(
    pred: DataFrame, by: Sequence[str], y: str, methods: Mapping[str, str], flag: str | None = None
) -> DataFrame:
    """Scores of each method over all rows and, with ``flag``, over the rows of flag 0."""
    aggs = []
    for name, column in methods.items():
        aggs += regression_aggs(F.col(y), F.col(column), f"{name}_")
        if flag:
            aggs += regression_aggs(F.col(y), F.col(column), f"{name}_", F.col(flag) == 0, "_flag0")
    return pred.groupBy(*by).agg(*aggs)


def pinball(y: Column, yhat: Column, tau: float = 0.9) -> Column:
    e = y - yhat
    return F.avg(F.greatest(tau * e, (tau - 1) * e))


def peak_weighted_error(y: Column, yhat: Column, peak: Column, weight: float = 5.0) -> Column:
    return F.avg(F.when(y > peak, weight).otherwise(1.0) * (y - yhat) * (y - yhat))


def lookup_back(df: DataFrame, series: DataFrame, keys: Sequence[str], ts: str, value: str, hours, out: str) -> DataFrame:
    """Left lookup of the series value ``hours`` earlier (number or column), by exact time."""
    right = series.select(*keys, F.col(ts).alias("_at"), F.col(value).alias(out))
    return df.withColumn("_at", tp.shift_hours(F.col(ts), -hours)).join(right, [*keys, "_at"], "left").drop("_at")


def confusion_aggs(obs: Column, pred: Column, name: str) -> list[Column]:
    o, p = holds(obs), holds(pred)
    return [
        F.struct(
            F.lit(name).alias("method"),
            F.count_if(o & p).alias("tp"),
            F.count_if(~o & p).alias("fp"),
            F.count_if(o & ~p).alias("fn"),
            F.count_if(o).alias("n_obs_hours"),
        ).alias(name)
    ]


def with_rates(counts: DataFrame) -> DataFrame:
    """F1, CSI, POD and FAR out of the counts; NULL where the denominator is 0."""
    tp_, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {
            "f1": F.try_divide(2 * tp_, 2 * tp_ + fp + fn),
            "csi": F.try_divide(tp_, tp_ + fp + fn),
            "pod": F.try_divide(tp_, tp_ + fn),
            "far": F.try_divide(fp, tp_ + fp),
        }
    )


def confusion_scores(df: DataFrame, by: Sequence[str], obs: Column, methods: Mapping[str, Column]) -> DataFrame:
    """One row per group and method; all methods are counted in one pass and stacked afterwards."""
    aggs = [c for name, p in methods.items() for c in confusion_aggs(obs, p, name)]
    wide = df.groupBy(*by).agg(*aggs)
    return with_rates(wide.select(*by, F.inline(F.array(*[F.col(m) for m in methods]))))


def exceedance_scores(
    pred: DataFrame, thresholds: DataFrame, keys: Sequence[str], by: Sequence[str], y: str, methods: Mapping[str, str],
    threshold: str = "threshold", ts: str = "ts",
) -> DataFrame:
    """Level x method scores; ``thresholds`` holds keys, level columns and the threshold."""
    levels = [c for c in thresholds.columns if c not in keys and c != threshold]
    t = F.col(threshold)
    rows = join_per_key(pred, thresholds, keys, spread=ts, how="inner")
    return confusion_scores(
        rows, [*keys, *by, *levels], F.col(y) >= t, {m: F.col(c) >= t for m, c in methods.items()}
    )


def anomaly_scores(
    pred: DataFrame, series: DataFrame, keys: Sequence[str], ts: str, value: str, train: Column,
    methods: Mapping[str, str], horizons: Sequence[int], fixed: DataFrame | None = None, prob: float = 0.95,
    hours: int = 24, min_obs: int = 12,
) -> DataFrame:
    """Scores against thresholds taken from each series itself.

    ``p95``: quantile of the training part of the series. ``rise``: value minus the trailing
    median ending ``horizon`` hours before, against the quantile of that rise in training.
    ``fixed``: a given level per key (column ``threshold``). ``pred`` has the keys, ``ts``,
    ``horizon``, ``y`` and the method columns; ``train`` is a predicate over ``series``.
    """
    keys = list(keys)
    series = series.select(*keys, ts, value)
    level = exact_quantiles(series.where(train), keys, F.col(value), {"_p95": prob}).drop("n")
    base = trailing_median(series, keys, ts, value, hours, min_obs, "_base").select(*keys, ts, "_base")
    # A base value serves each horizon once: shift it forward and join on the exact time.
    steps = F.array(*[F.lit(int(h)) for h in horizons])
    ahead = base.withColumn("horizon", F.explode(steps)).withColumn(ts, tp.shift_hours(F.col(ts), F.col("horizon")))
    rise = exact_quantiles(
        series.where(train).join(ahead, [*keys, ts]), [*keys, "horizon"], F.col(value) - F.col("_base"), {"_rise": prob}
    ).drop("n")
    rows = pred.join(ahead, [*keys, "horizon", ts], "left")
    rows = join_per_key(join_per_key(rows, level, keys, ts), rise, [*keys, "horizon"], ts)
    tests = {"p95": (F.col("_p95"), F.lit(0.0)), "rise": (F.col("_rise"), F.col("_base"))}
    if fixed is not None:
        rows = join_per_key(rows, fixed.select(*keys, F.col("threshold").alias("_fixed")), keys, ts)
        tests["fixed"] = (F.col("_fixed"), F.lit(0.0))
    y = F.col("y")
    aggs, cells = [], []
    for name, (limit, minus) in tests.items():
        for m, c in methods.items():
            cell = f"{name}_{m}"
            aggs.append(confusion_aggs(y - minus >= limit, F.col(c) - minus >= limit, m)[0].alias(cell))
            cells.append(F.struct(F.lit(name).alias("definition"), F.col(cell)["method"].alias("method"),
                                  *[F.col(cell)[k].alias(k) for k in COUNTS]))
    wide = rows.groupBy(*keys, "horizon").agg(*aggs)
    return with_rates(wide.select(*keys, "horizon", F.inline(F.array(*cells))))


def in_windows(df: DataFrame, ts: str, events: DataFrame, pad_days: int, start: str = "start", end: str = "end") -> DataFrame:
    """Rows inside a padded event window, once per event; borders included.

    Windows are cut into days so that the join is an equality on the day.
    """
    lo = F.col(start).cast("timestamp_ntz") - F.make_interval(days=F.lit(pad_days))
    hi = F.col(end).cast("timestamp_ntz") + F.make_interval(days=F.lit(pad_days))
    days = events.withColumns({"_lo": lo, "_hi": hi}).withColumn(
        "_day", F.explode(F.sequence(F.col("_lo").cast("date"), F.col("_hi").cast("date")))
    )
    hit = df.withColumn("_day", F.col(ts).cast("date")).join(days, "_day")
    return hit.where(F.col(ts).between(F.col("_lo"), F.col("_hi"))).drop("_day", "_lo", "_hi")


def event_scores(
    pred: DataFrame, events: DataFrame, thresholds: DataFrame, keys: Sequence[str], ts: str,
    methods: Mapping[str, str], model: str, pad_days: int = 1, base_horizon: int = 1,
) -> DataFrame:
    """Scores per event, series, horizon and method, first observed exceedance and longest lead.

    The lead is the largest horizon whose forecast already exceeded at the first observed
    exceedance: 0 if none did, NULL if nothing was observed. ``events`` has ``event``,
    ``start`` and ``end``; ``thresholds`` one ``threshold`` per key.
    """
    keys = list(keys)
    t = F.col("threshold")
    limited = join_per_key(pred, thresholds, keys, ts, "inner")
    rows = in_windows(limited, ts, events.select("event", "start", "end"), pad_days)
    scores = confusion_scores(
        rows, ["event", *keys, "horizon"], F.col("y") >= t, {m: F.col(c) >= t for m, c in methods.items()}
    )
    first = (
        rows.where(F.col("horizon") == base_horizon)
        .groupBy("event", *keys)
        .agg(F.min(F.when(F.col("y") >= t, F.col(ts))).alias("t_first"))
    )
    told = limited.where(F.col(model) >= t).select(*keys, F.col(ts).alias("t_first"), "horizon")
    in_event = rows.select("event", *keys, "horizon").distinct()
    lead = (
        first.where(F.col("t_first").isNotNull())
        .join(told, [*keys, "t_first"])
        .join(in_event, ["event", *keys, "horizon"], "left_semi")
        .groupBy("event", *keys)
        .agg(F.max("horizon").alias("_lead"))
    )
    out = scores.join(first, ["event", *keys], "left").join(lead, ["event", *keys], "left")
    max_lead = F.when(F.col("t_first").isNotNull(), F.coalesce(F.col("_lead"), F.lit(0)))
    return out.select(*scores.columns, "t_first", max_lead.cast("int").alias("max_lead_hours"))


def compare_runs(runs: Mapping[str, DataFrame | None], columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Union of metric tables with their run name; columns a run lacks are NULL. Also the names of missing runs."""
    missing = [name for name, df in runs.items() if df is None]
    out = None
    for name, df in runs.items():
        if df is None:
            continue
        part = df.select(*[c for c in columns if c in df.columns]).withColumn("config", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out, missing


def pivot_runs(runs: DataFrame, by: Sequence[str], value: str, configs: Sequence[str]) -> DataFrame:
    return runs.groupBy(*by).pivot("config", list(configs)).agg(F.avg(value))


def best_run(runs: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Configuration of the highest value per group; the smaller name on ties."""
    ok = F.when(F.col(value).isNotNull(), F.struct(-F.col(value), F.col("config")))
    return runs.groupBy(*by).agg(F.min_by("config", ok).alias("best_config"), F.max(value).alias(value))


def lift_over(runs: DataFrame, by: Sequence[str], base: str, score: str, loss: str, gain: float = 0.02, may_lose: float = 0.05) -> DataFrame:
    """Self-join with the base run: gain in ``score``, drop in ``loss``, and whether that is a lift."""
    b = runs.where(F.col("config") == base).select(*by, F.col(score).alias("_s"), F.col(loss).alias("_l"))
    out = runs.where(F.col("config") != base).join(b, list(by))
    up, down = F.col(score) - F.col("_s"), F.col("_l") - F.col(loss)
    return out.select(*by, "config", up.alias("gain"), down.alias("drop"), holds((up >= gain) & (down <= may_lose)).alias("lift"))


def replace_series(table: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of re-run keys replaced by the new rows."""
    return join_per_key(table, fresh.select(*keys).distinct(), keys, how="left_anti").unionByName(fresh)


def median_scores(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    return medians(df, by, values)


def sample_gate(counts: DataFrame, needs: Mapping[str, int], note: str = "too few windows") -> DataFrame:
    """Mark groups whose counts stay below the needed minimum."""
    short = F.lit(False)
    for c, need in needs.items():
        short = short | (F.col(c) < need)
    return counts.withColumn("note", F.when(holds(short), F.lit(note)))


def split_label(ts: Column, ranges: Mapping[str, tuple[str, str]]) -> Column:
    """Name of the first closed range that holds the time; NULL outside all of them."""
    out = F.lit(None).cast("string")
    for name, (lo, hi) in reversed(list(ranges.items())):
        inside = ts.between(F.lit(lo).cast("timestamp_ntz"), F.lit(hi).cast("timestamp_ntz"))
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out


def training_rows(series: DataFrame, overrides: DataFrame, keys: Sequence[str], ts: str, start: str, end: str) -> DataFrame:
    """Boolean ``is_train``: the common half-open period, or the closed one of the key's override (``start``, ``end``)."""
    o = overrides.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"))
    own = F.col(ts).between(F.col("_s"), F.col("_e"))
    common = (F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz"))
    out = join_per_key(series, o, keys, ts)
    return out.select(*series.columns, F.when(F.col("_s").isNotNull(), own).otherwise(common).alias("is_train"))

