"""Raw gauge files as a stream: points, provisional hours, silence, and the stored tables.

Percentile flags need whole series-years, so a stream only gives provisional flags; the
stored tables are the truth and are rebuilt for the touched series-years per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hydroseries.functions.cleaning import exact_mean
from hydroseries.sources.gauge_text import Gauge, parse_gauge_text
from hydroseries.sources.ingest import ingest


def raw_file_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> Gauge:
    """New raw files of ``{path}/{series}/``; each is read once, the checkpoint remembers which.

    Points carry ``_from``, the start of their file (from its name) and their place in it: the order by which the batch load
    chooses among several values of one time.
    """
    raw = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("recursiveFileLookup", True)
        .load(path)
        .select(
            F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("series_id"),
            F.regexp_extract(F.col("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})_[^/]*$", 1).try_cast("date").alias("chunk_start"),
            F.col("value").alias("raw"),
        )
    )
    parsed = parse_gauge_text(raw, ["series_id", "chunk_start"], place="place")
    points = parsed.points.withColumn("_from", F.struct("chunk_start", "place")).drop("chunk_start", "place")
    return Gauge(points, parsed.limits.drop("chunk_start"), parsed.rejects.drop("chunk_start"))


def watermarked(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermarks need an instant: a time without zone is taken in the session time zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def drop_repeated(stream: DataFrame, keys: list[str], ts: str, delay: str = "2 hours") -> DataFrame:
    """One row per key and time among rows that arrive within ``delay`` of each other."""
    return watermarked(stream, ts, delay).dropDuplicatesWithinWatermark([*keys, ts])


def hourly(stream: DataFrame, keys: list[str], ts: str, value: str, digits: int | None = None) -> DataFrame:
    """Hourly mean, maximum and count of a stream that already has a watermark; late rows are left to the batch load.

    With ``digits`` the mean is exact and rounded to that many decimals, halves away from zero, in whatever order rows arrive.
    """
    v = F.col(value)
    agg = stream.groupBy(*keys, F.window(ts, "1 hour").alias("_w")).agg(
        (F.avg(v) if digits is None else exact_mean(v, digits)).alias("mean"), F.max(v).alias("max"), F.count(v).alias("n_obs")
    )
    flag = F.when(F.col("n_obs") < 2, 9).otherwise(0)
    return agg.select(*keys, F.col("_w.start").alias(ts), "mean", "max", "n_obs", flag.alias("qc_flag"))


def silences(stream: DataFrame, keys: list[str], ts: str, gap: str = "70 minutes", delay: str = "2 hours") -> DataFrame:
    """One row whenever a series has been silent for ``gap``: first and last time heard, rows in between."""
    s = watermarked(stream, ts, delay).groupBy(*keys, F.session_window(ts, gap).alias("_s"))
    out = s.agg(F.max(ts).alias("last_heard"), F.count("*").alias("n_rows"))
    return out.select(*keys, F.col("_s.start").alias("first_heard"), "last_heard", "n_rows")


def ingest_stream(
    points: DataFrame, points_path: str, hourly_path: str, checkpoint: str, key: str = "series_id", order: str = "_from",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Merge each micro-batch into the stored tables; a repeated batch changes nothing, stored rows win.

    Of several new values of one time in a batch the first by ``order`` stays, as in the batch load: for points of
    ``raw_file_stream`` that is the order of files and of places in them. ``trigger`` are the arguments of Spark's ``trigger``, by default
    all that is there now, then the end; ``{"processingTime": "5 minutes"}`` goes on.
    """

    def load(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            if not batch.isEmpty():
                ingest(batch.sparkSession, batch, points_path, hourly_path, key, order)
        finally:
            batch.unpersist()

    writer = points.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
