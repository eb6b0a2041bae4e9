"""Query registry and the tables every query starts from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroseries.functions.cleaning import null_normalise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return null_normalise(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def ntz(c):
    return c.cast("timestamp_ntz")


def hourly_events(spark: SparkSession, sf_dir: str, key: str = "event_type", digits: int = 9) -> DataFrame:
    """k, ts (hour), v (mean), vmax, n: the hourly series of ``events``."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col(key).alias("k"), ntz(F.date_trunc("hour", "ts")).alias("ts")).agg(
        F.round(F.avg("value"), digits).alias("v"), F.max("value").alias("vmax"), F.count("*").alias("n")
    )


HOURLY_SQL = """
h AS (SELECT {key} AS k, date_trunc('hour', ts) AS ts, round(avg(value), 9) AS v, max(value) AS vmax, count(*) AS n
      FROM events GROUP BY 1, 2)"""
GRID_SQL = """
gb AS (SELECT k, min(ts) AS lo, max(ts) AS hi FROM h GROUP BY k),
gg AS (SELECT k, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM gb),
g AS (SELECT gg.k, gg.ts, h.v, h.vmax, h.n FROM gg LEFT JOIN h ON h.k = gg.k AND h.ts = gg.ts)"""


def hourly_sql(key: str = "event_type", grid: bool = False) -> str:
    return HOURLY_SQL.format(key=key) + ("," + GRID_SQL if grid else "")


def grid_events(spark: SparkSession, sf_dir: str, key: str = "event_type", digits: int = 9) -> DataFrame:
    """The hourly series on a complete grid."""
    from hydroseries.operators.grid import complete_grid

    return complete_grid(hourly_events(spark, sf_dir, key, digits), ["k"], "ts")


def rain_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    return e.groupBy(ntz(F.date_trunc("day", "ts")).alias("day")).agg(F.round(F.avg("value"), 9).alias("rain_mm"))


def tide_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "view")
    return e.groupBy(ntz(F.date_trunc("hour", "ts")).alias("ts")).agg(
        F.round(F.avg("value") / 100 - 0.5, 9).alias("tide_m")
    )


DRIVERS_SQL = """
rain AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, round(avg(value), 9) AS rain_mm FROM events
         WHERE event_type = 'purchase' GROUP BY 1),
tide AS (SELECT date_trunc('hour', ts) AS ts, round(avg(value) / 100 - 0.5, 9) AS tide_m FROM events
         WHERE event_type = 'view' GROUP BY 1)"""

HORIZONS = (1, 6, 12, 24)


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, ts, horizon, y, yhat (mean of the values h and 24 hours before), y_persist, qc_flag."""
    from hydroseries.operators.scores import lookup_back

    h = hourly_events(spark, sf_dir)
    rows = h.select("k", "ts", F.col("v").alias("y"), F.when(F.col("n") < 2, 9).otherwise(0).alias("qc_flag"))
    rows = rows.withColumn("horizon", F.explode(F.array(*[F.lit(x) for x in HORIZONS])))
    rows = lookup_back(rows, h, ["k"], "ts", "v", F.col("horizon"), "y_persist")
    rows = lookup_back(rows, h, ["k"], "ts", "v", 24, "_day")
    yhat = F.round((F.col("y_persist") + F.col("_day")) / 2, 9)
    return rows.withColumn("yhat", yhat).where(F.col("yhat").isNotNull()).drop("_day")


PRED_SQL = """
hz AS (SELECT unnest([1, 6, 12, 24])::INTEGER AS horizon),
pred AS (SELECT h.k, h.ts, hz.horizon, h.v AS y, a.v AS y_persist, round((a.v + b.v) / 2, 9) AS yhat,
                (CASE WHEN h.n < 2 THEN 9 ELSE 0 END)::INTEGER AS qc_flag
         FROM h CROSS JOIN hz
         JOIN h a ON a.k = h.k AND a.ts = h.ts - to_hours(hz.horizon)
         JOIN h b ON b.k = h.k AND b.ts = h.ts - INTERVAL 24 HOUR)"""

EVENTS = (
    ("E1", "2024-01-05", "2024-01-06", "pluvial+tidal"),
    ("E2", "2024-01-12", "2024-01-15", "pluvial"),
    ("E3", "2024-01-20", "2024-01-21", "Compound"),
)


def event_windows(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(list(EVENTS), "event string, start string, `end` string, type string")
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


EVENTS_SQL = "\nev(event, s, e, type) AS (VALUES " + ", ".join(
    f"('{i}', TIMESTAMP '{a}', TIMESTAMP '{b}', '{t}')" for i, a, b, t in EVENTS
) + ")"


def rates_sql(prefix: str = "") -> str:
    """F1, CSI, POD, FAR out of tp, fp, fn, rounded."""
    return """round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6)::DOUBLE AS f1, round(tp * 1.0 / nullif(tp + fp + fn, 0), 6)::DOUBLE AS csi,
    round(tp * 1.0 / nullif(tp + fn, 0), 6)::DOUBLE AS pod, round(fp * 1.0 / nullif(tp + fp, 0), 6)::DOUBLE AS far"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
