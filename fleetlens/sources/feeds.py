"""Station, weather and rebalancing feeds from files."""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship

STATION_JSON = "last_updated bigint, data struct<stations: array<struct<station_id: string, short_name: string, name: string, lat: double, lon: double, capacity: int>>>"
WEATHER_JSON = "hourly struct<time: array<string>, temperature_2m: array<double>, precipitation: array<double>, wind_speed_10m: array<double>, relative_humidity_2m: array<double>>"

#: Reported sentence of a monthly rebalancing report, and a month with or without a year: fixed patterns.
REBALANCED = re.compile(r"(?i)rebalanced\s+(?:a\s+total\s+of\s+)?([0-9][0-9,]*)\s+(?:bikes|bicycles)")
MONTH = re.compile(rf"\b({'|'.join(calendar.month_name[1:])})\b(?:,?\s+(\d{{4}}))?")


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """station_id (the feed's short name), name, lat, lng, capacity from a station-information file."""
    raw = spark.read.schema(STATION_JSON).option("multiLine", True).json(path)
    s = raw.select(F.explode("data.stations").alias("s"))
    return s.select(F.col("s.short_name").alias("station_id"), F.col("s.name").alias("name"), F.col("s.lat").alias("lat"), F.col("s.lon").alias("lng"), F.col("s.capacity").alias("capacity"))


def duplicate_stations(stations: DataFrame) -> DataFrame:
    """station_id, n of ids that come more than once."""
    return stations.groupBy("station_id").agg(F.count("*").alias("n")).filter("n > 1")


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """Hourly rows from a file of parallel arrays."""
    raw = spark.read.schema(WEATHER_JSON).option("multiLine", True).json(path)
    h = raw.select(F.explode(F.arrays_zip(*[F.col(f"hourly.{c}").alias(c) for c in ("time", "temperature_2m", "precipitation", "wind_speed_10m", "relative_humidity_2m")])).alias("h"))
    return h.select(
        F.expr("try_cast(h.time AS timestamp_ntz)").alias("timestamp"), F.col("h.temperature_2m").alias("temp_c"), F.col("h.precipitation").alias("precip_mm"),
        F.col("h.wind_speed_10m").alias("wind_kph"), F.col("h.relative_humidity_2m").alias("humidity_pct"),
    )


def covers_range(weather: DataFrame, trips: DataFrame) -> DataFrame:
    """One row: first and last day of trips and of weather, and whether the latter covers the former."""
    t = trips.agg(F.to_date(F.min("started_at")).alias("first_trip"), F.to_date(F.max("started_at")).alias("last_trip"))
    w = weather.agg(F.to_date(F.min("timestamp")).alias("first_weather"), F.to_date(F.max("timestamp")).alias("last_weather"))
    return t.crossJoin(w).withColumn("covered", (F.col("first_weather") <= F.col("first_trip")) & (F.col("last_weather") >= F.col("last_trip")))


def parse_report(text: str, name: str) -> tuple[date, int]:
    """(first day of the month, bikes) of a report; raises where there is no such sentence, no month in it, or another one than in the file's name."""
    found, named = REBALANCED.search(text), re.search(r"(\d{4})-(\d{2})", name)
    if not found:
        raise ValueError(f"{name}: no rebalancing sentence in the report")
    if not named or not 1 <= int(named[2]) <= 12:
        raise ValueError(f"{name}: no month in the file's name")
    sentence = text[text.rfind(".", 0, found.start()) + 1 :].partition(".")[0]
    said = MONTH.search(sentence) or MONTH.search(text)
    if not said:
        raise ValueError(f"{name}: the report names no month")
    month = list(calendar.month_name).index(said[1].capitalize())
    if month != int(named[2]) or said[2] not in (None, named[1]):
        raise ValueError(f"{name}: the report is about {said[0]}")
    return date(int(named[1]), month, 1), int(found[1].replace(",", ""))


@dataclass
class ReportFile(InputPartition):
    path: str


class ReportReader(DataSourceReader):
    """A task a file; files are found and opened by Arrow's file systems (a folder, or one file, of any store that those reach)."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[ReportFile]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else str(Path(self.path).absolute()))
        info = store.get_file_info(at)
        files = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File]
        prefix = self.path.split("://")[0] + "://" if "://" in self.path else ""
        return [ReportFile(prefix + f.path) for f in sorted(files, key=lambda f: f.path) if not f.base_name.startswith((".", "_"))]

    def read(self, partition: ReportFile) -> Iterator[tuple]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(partition.path)
        with store.open_input_stream(at) as stream:
            text = stream.read().decode()
        name = at.rsplit("/", 1)[-1]
        yield (*parse_report(text, name), name)


class ReportSource(DataSource):
    """spark.read.format("monthly_report").load(folder): a row a report."""

    @classmethod
    def name(cls) -> str:
        return "monthly_report"

    def schema(self) -> str:
        return "month_start date, rebalanced_bikes_total bigint, source_file string"

    def reader(self, schema) -> ReportReader:  # noqa: ANN001
        return ReportReader(self.options["path"])


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """month_start, rebalanced_bikes_total, source_file of the text reports in a folder, whose names hold yyyy-mm; a report about another month raises."""
    ship(spark)
    spark.dataSource.register(ReportSource)
    return spark.read.format("monthly_report").load(path)
