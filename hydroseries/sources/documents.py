"""Nested documents: station configuration, open-data pages, crowd reports, waterway extracts."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATION_SCHEMA = (
    "id int, nama string, koordinat struct<lat:double,lon:double,sumber:string>,"
    " ambang_siaga_cm struct<siaga1:double,siaga2:double,siaga3:double>"
)
REPORT_SCHEMA = (
    "features array<struct<properties:struct<pkey:string,created_at:string,disaster_type:string,status:string,"
    "source:string,text:string,report_data:struct<flood_depth:double>,tags:struct<city:string,local_area_id:string>>,"
    "geometry:struct<coordinates:array<double>>>>"
)
WAY_SCHEMA = (
    "elements array<struct<type:string,id:bigint,nodes:array<bigint>,"
    "geometry:array<struct<lat:double,lon:double>>,tags:map<string,string>>>"
)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Station configuration (YAML or JSON with a ``stations`` list) as a flat dimension.

    The file is a hand-kept configuration; it is parsed on the driver.
    """
    body = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith(".json"):
        doc = json.loads(body)
    else:
        import yaml

        doc = yaml.safe_load(body)
    return flatten_stations(spark.createDataFrame(doc["stations"], STATION_SCHEMA, verifySchema=False))


def flatten_stations(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("id").alias("station_id"),
        F.col("nama").alias("name"),
        F.col("koordinat.lat").alias("lat"),
        F.col("koordinat.lon").alias("lon"),
        F.col("koordinat.sumber").alias("coordinate_source"),
        *[F.col(f"ambang_siaga_cm.siaga{i}").alias(f"limit{i}") for i in (1, 2, 3)],
    )


def read_pages(spark: SparkSession, path: str, drop: Sequence[str] = ("rn",), multi_line: bool = True) -> DataFrame:
    """Landed pages ``{"meta": .., "rows": [..]}`` to one row per record; values stay text, columns may differ."""
    raw = spark.read.option("multiLine", multi_line).option("primitivesAsString", True).json(path)
    return raw.select(F.explode("rows").alias("r")).select("r.*").drop(*drop)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON crowd reports to eleven flat columns; absent nested parts are NULL."""
    raw = spark.read.schema(REPORT_SCHEMA).option("multiLine", True).json(path)
    return flatten_reports(raw.select(F.explode("features").alias("f")).select("f.properties", "f.geometry.coordinates"))


def flatten_reports(df: DataFrame) -> DataFrame:
    p = F.col("properties")
    return df.select(
        p["pkey"].alias("pkey"),
        F.try_to_timestamp(p["created_at"]).cast("timestamp_ntz").alias("created_at"),
        p["disaster_type"].alias("disaster_type"),
        p["status"].alias("status"),
        p["source"].alias("source"),
        p["report_data"]["flood_depth"].alias("flood_depth_cm"),
        p["text"].alias("text"),
        p["tags"]["city"].alias("city"),
        p["tags"]["local_area_id"].alias("local_area_id"),
        F.get("coordinates", F.lit(0)).alias("lon"),
        F.get("coordinates", F.lit(1)).alias("lat"),
    )


def read_ways(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Waterway extract: one row per way with tags and its nodes in order (node, lat, lon)."""
    raw = spark.read.schema(WAY_SCHEMA).option("multiLine", multi_line).json(path)
    e = raw.select(F.posexplode("elements").alias("way_order", "e")).where(F.col("e.type") == "way")
    return e.select(
        "way_order",
        F.col("e.id").alias("way_id"),
        F.coalesce(F.col("e.tags")["waterway"], F.lit("")).alias("waterway"),
        F.coalesce(F.col("e.tags")["name"], F.lit("")).alias("name"),
        F.zip_with(
            "e.nodes", "e.geometry", lambda n, g: F.struct(n.alias("node"), g["lat"].alias("lat"), g["lon"].alias("lon"))
        ).alias("path"),
    ).where(F.size("path") > 1)
