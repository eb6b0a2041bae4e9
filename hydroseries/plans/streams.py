"""Streaming queries: the event table is read as a file stream to its end, results are written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from hydroseries.functions import timeparts as tp
from hydroseries.plans.landed import INGEST_SQL, folder
from hydroseries.plans.registry import query, rounded, table
from hydroseries.streaming import ingest as st
from hydroseries.streaming import stuck


def event_stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def drained(df, spark):
    out = folder(spark)
    q = df.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    back = spark.read.parquet(f"{out}/data")
    return back.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in back.dtypes])


@query("st03_drop_repeated", "SELECT DISTINCT user_id, date_trunc('hour', ts) AS ts FROM events")
def st03_drop_repeated(spark, sf_dir):
    s = event_stream(spark, sf_dir).select("user_id", tp.hour_of(F.col("ts")).alias("ts"))
    return drained(st.drop_repeated(s, ["user_id"], "ts"), spark)


@query("st04_hourly", """WITH d AS (SELECT DISTINCT event_type, ts, value FROM events),
    h AS (SELECT event_type, date_trunc('hour', ts) AS ts, sum(round(value * 1000000)::BIGINT)::BIGINT AS s, max(value) AS max, count(value) AS n_obs
          FROM d GROUP BY 1, 2)
    SELECT event_type, ts, ((CASE WHEN s < 0 THEN -1 ELSE 1 END) * ((2 * abs(s) + n_obs) // (2 * n_obs)))::DOUBLE / 1000000::DOUBLE AS mean, max, n_obs,
    (CASE WHEN n_obs < 2 THEN 9 ELSE 0 END)::INTEGER AS qc_flag FROM h
    WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def st04_hourly(spark, sf_dir):
    """Closed hours only: the last ones stay open until later rows arrive. Rows of equal type, time and value count once; the mean is
    exact, rounded to six decimals, halves away from zero."""
    s = st.drop_repeated(event_stream(spark, sf_dir).select("event_type", "ts", "value"), ["event_type", "value"], "ts")
    return drained(st.hourly(s, ["event_type"], "ts", "value", digits=6), spark)


@query("st05_ingest_stream", INGEST_SQL.replace("SELECT k, ts, round(mean, 6)", "SELECT k AS series_id, ts, round(mean, 6)"))
def st05_ingest_stream(spark, sf_dir):
    """Each micro-batch is merged into the stored points and hours."""
    out = folder(spark)
    s = event_stream(spark, sf_dir).select(
        F.col("event_type").alias("series_id"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"),
        (F.floor(F.col("value") / 10) * 10).cast("double").alias("value"),
    )
    st.ingest_stream(s, f"{out}/points", f"{out}/hourly", f"{out}/state", order="value").awaitTermination()
    back = spark.read.parquet(f"{out}/hourly")
    return rounded(back.select(F.col("series_id").cast("string").alias("series_id"), "ts", "mean", "max", "n_obs", "pct_flagged", "qc_flag"), "mean")


@query("st06_stuck_flags", """WITH a AS (SELECT event_type AS series, ts, event_id AS tie, floor(value / 50)::DOUBLE AS value FROM events),
    b AS (SELECT *, lag(ts) OVER w AS pt, CASE WHEN value = lag(value) OVER w THEN NULL ELSE ts END AS st FROM a WINDOW w AS (PARTITION BY series ORDER BY ts, tie)),
    c AS (SELECT *, max(st) OVER (PARTITION BY series ORDER BY ts, tie) AS since FROM b)
    SELECT series, ts, tie, value, (CASE WHEN ts <= pt THEN 4 WHEN ts - since > INTERVAL 60 MINUTE THEN 2 ELSE 0 END)::INTEGER AS flag FROM c""")
def st06_stuck_flags(spark, sf_dir):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    stuck.use_rocksdb(spark)
    try:
        s = event_stream(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 50))
        return drained(stuck.stuck_flags(s, "event_type", "ts", "value", "event_id"), spark)
    finally:
        spark.conf.set(name, before)


@query("st07_silences", """WITH a AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS pt FROM events),
    b AS (SELECT *, sum(CASE WHEN pt IS NULL OR ts - pt >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM a)
    SELECT user_id, min(ts) AS first_heard, max(ts) AS last_heard, count(*) AS n_rows FROM b GROUP BY user_id, s
    HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def st07_silences(spark, sf_dir):
    return drained(st.silences(event_stream(spark, sf_dir).select("user_id", "ts"), ["user_id"], "ts", "6 hours"), spark)


@query("st02_last_times", "SELECT event_type, max(ts) AS last_ts FROM events GROUP BY 1")
def st02_last_times(spark, sf_dir):
    from hydroseries.sources.ingest import last_times

    return last_times(table(spark, sf_dir, "events"), "event_type", "ts")
