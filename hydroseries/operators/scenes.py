"""Choice of satellite scenes for an event and of dry reference scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hydroseries.functions import timeparts as tp
from hydroseries.operators.frames import top_per_key

# Fixed values of the choice rules.
NEAR_DAYS, WIDE_DAYS = 4, 6
SEASON_DAYS, YEARS_BACK, SKIP_DAYS = 20, 3, 3
DRY_MM, STRICT_AT_LEAST, KEEP = 1.0, 3, 5


def _by_day(df: DataFrame, first, last) -> DataFrame:
    return df.withColumn("_day", F.explode(F.sequence(first.cast("date"), last.cast("date"))))


def event_scenes(scenes: DataFrame, peaks: DataFrame, keep: int | None = None) -> DataFrame:
    """Scenes around each peak by time gap: rank 1 is chosen, the rest are alternatives.

    Scenes of +/- 4 days if there are any, else of +/- 6 days (``wide``). Whole days count,
    one more at the end. ``scenes``: scene_id, acquired, orbit; ``peaks``: event, peak.
    ``keep``: only the closest so many per event, chosen in every task before they meet; all by default.
    """
    peak = F.col("peak")
    days = lambda n: F.make_interval(days=F.lit(n))
    window = _by_day(peaks, peak - days(WIDE_DAYS), peak + days(WIDE_DAYS + 1))
    day = F.col("_day")
    near = day.between((peak - days(NEAR_DAYS)).cast("date"), (peak + days(NEAR_DAYS + 1)).cast("date"))
    hits = scenes.withColumn("_day", F.col("acquired").cast("date")).join(window.withColumn("wide", ~near), "_day")
    hits = hits.withColumn("gap_hours", F.abs(tp.hours_between(F.col("acquired"), peak)))
    kind = hits.groupBy("event").agg(F.min("wide").alias("wide"))
    hits = hits.join(kind, ["event", "wide"])
    order = [F.col("gap_hours"), F.col("scene_id")]
    if keep is None:
        # At most a dozen days of scenes per event.
        ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("event").orderBy(*order)))
    else:
        ranked = top_per_key(hits, ["event"], order, keep)
    return ranked.select("event", "scene_id", "acquired", "orbit", "wide", "gap_hours", "rank")


def prior_rain(scenes: DataFrame, rain: DataFrame, hours: int = 72, ts: str = "ts", value: str = "rain_mm") -> DataFrame:
    """Rain sum of the ``hours`` up to each scene, borders included; scenes without any rain row are left out."""
    from_ = tp.shift_hours(F.col("acquired"), -hours)
    window = _by_day(scenes.select("scene_id", "acquired"), from_, F.col("acquired"))
    r = rain.withColumn("_day", F.col(ts).cast("date"))
    hit = window.join(r, "_day").where(F.col(ts).between(from_, F.col("acquired")))
    return hit.groupBy("scene_id").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("prior_mm"))


def reference_scenes(scenes: DataFrame, peaks: DataFrame, rain: DataFrame) -> DataFrame:
    """Driest scenes of the same season in this and three earlier years, away from the peak.

    The five driest below the dry limit if at least three are, else the five driest of all.
    """
    peak = F.col("peak")
    centre = tp.same_day_in_year(peak, F.year(peak) - F.col("_back"))
    years = peaks.withColumn("_back", F.explode(F.array(*[F.lit(i) for i in range(YEARS_BACK + 1)])))
    season = _by_day(years, F.date_sub(centre, SEASON_DAYS), F.date_add(centre, SEASON_DAYS + 1))
    found = scenes.withColumn("_day", F.col("acquired").cast("date")).join(season, "_day")
    found = found.where(F.abs(tp.hours_between(F.col("acquired"), peak)) > SKIP_DAYS * 24)
    found = found.join(prior_rain(scenes, rain), "scene_id").select("event", "scene_id", "acquired", "prior_mm")
    best = top_per_key(found, ["event"], [F.col("prior_mm"), F.col("acquired").desc(), F.col("scene_id")], KEEP)
    dry = found.groupBy("event").agg(F.count_if(F.col("prior_mm") < DRY_MM).alias("_dry"))
    out = best.join(dry, "event").withColumn("strict", F.col("_dry") >= STRICT_AT_LEAST)
    return out.where(~F.col("strict") | (F.col("prior_mm") < DRY_MM)).drop("_dry")
