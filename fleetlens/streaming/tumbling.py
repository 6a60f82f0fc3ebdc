"""The panel's interval counts as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def departures_stream(trips: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """station_id, interval_start, departures from a stream of trips (started_at timestamp, start_station_id).

    Trips later than the delay are left out; append mode gives each interval once.
    """
    counts = trips.withWatermark("started_at", delay).groupBy(F.window("started_at", "15 minutes").alias("w"), F.col("start_station_id").alias("station_id")).agg(F.count("*").alias("departures"))
    return counts.select("station_id", F.col("w.start").alias("interval_start"), "departures")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes all that is there to Parquet and stops."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def run_complete(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All counts of what is there, open intervals too; each batch rewrites the Parquet files at path."""
    def put(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(path)

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def event_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in events as a stream of trip starts."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.select(F.col("ts").cast("timestamp").alias("started_at"), F.col("user_id").alias("start_station_id"))
