"""Trips, stations and weather derived from the events table, for data without a trip feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..params import IngestParams
from .trips import keep_valid


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def trips_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trip an event; the destination is the user's number shifted by props.k, modulo the number of users."""
    e = events(spark, sf_dir)
    n = e.agg((F.max("user_id") + 1).alias("n_users"))
    return e.crossJoin(F.broadcast(n)).select(
        F.col("event_id").cast("string").alias("ride_id"),
        F.col("ts").alias("started_at"),
        F.timestamp_add("SECOND", F.floor(F.col("value") * 10).cast("int"), F.col("ts")).alias("ended_at"),
        F.col("user_id").alias("start_station_id"),
        ((F.col("user_id") + F.get_json_object("props", "$.k").cast("bigint")) % F.col("n_users")).alias("end_station_id"),
        F.col("event_type").alias("rideable_type"),
        F.when(F.col("user_id") % 2 == 0, "member").otherwise("casual").alias("member_casual"),
    )


def trips(spark: SparkSession, sf_dir: str, params: IngestParams = IngestParams()) -> DataFrame:
    return keep_valid(trips_raw(spark, sf_dir), params)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A station a user, on a grid of twelve columns; some have null or zero docks on purpose."""
    ids = events(spark, sf_dir).select(F.col("user_id").alias("station_id")).distinct()
    i = F.col("station_id")
    return ids.select(
        "station_id",
        F.when(i % 23 == 0, None).when(i % 29 == 0, 0).otherwise(2 + i % 5).cast("int").alias("capacity"),
        (F.lit(40.70) + 0.002 * F.floor(i / 12)).alias("lat"),
        (F.lit(-74.00) + 0.002 * (i % 12)).alias("lng"),
        F.concat(F.lit("z"), F.floor(i / 6).cast("string")).alias("zone_agg"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly rows over the span of the events."""
    hour = lambda c: F.date_trunc("hour", c).cast("timestamp_ntz")
    span = events(spark, sf_dir).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    rows = span.select(F.explode(F.sequence(hour(F.col("a")), hour(F.col("b")), F.expr("interval 1 hour"))).alias("timestamp"))
    h = F.timestamp_diff("HOUR", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("timestamp"))
    rows = rows.withColumn("h", h)
    return rows.select(
        "timestamp",
        (10 + F.col("h") % 7).cast("double").alias("temp_c"),
        F.when(F.col("h") % 11 == 0, 1.5).otherwise(0.0).alias("precip_mm"),
        (5 + F.col("h") % 9).cast("double").alias("wind_kph"),
        (40 + F.col("h") % 50).cast("double").alias("humidity_pct"),
    )
