"""Trip files of two layouts, quality rules in one pass, and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..params import IngestParams
from ..session import exists

#: Target layout; ids are strings, so that "5406.02" stays what it is.
TARGET = "ride_id string, started_at timestamp_ntz, ended_at timestamp_ntz, start_station_id string, end_station_id string, start_lat double, start_lng double, end_lat double, end_lng double, rideable_type string, member_casual string"

#: Header names of the two layouts, fixed values.
ERA_A = ["tripduration", "starttime", "stoptime", "start station id", "start station name", "start station latitude", "start station longitude", "end station id", "end station name", "end station latitude", "end station longitude", "bikeid", "usertype", "birth year", "gender"]
ERA_B = ["ride_id", "rideable_type", "started_at", "ended_at", "start_station_name", "start_station_id", "end_station_name", "end_station_id", "start_lat", "start_lng", "end_lat", "end_lng", "member_casual"]


def detect_era(columns: list[str]) -> str:
    """"A" or "B" by the header; raises for any other layout."""
    have = {c.strip().lower() for c in columns}
    if set(ERA_B) <= have:
        return "B"
    if {c for c in ERA_A if c not in ("birth year", "gender", "tripduration")} <= have:
        return "A"
    raise ValueError(f"unknown trip layout: {sorted(have)}")


def _as_read(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def normalize_era_a(df: DataFrame) -> DataFrame:
    user = F.col("usertype")
    return df.select(
        F.xxhash64(F.concat_ws("-", "bikeid", "starttime", "stoptime")).cast("string").alias("ride_id"),
        F.expr("try_cast(starttime AS timestamp_ntz)").alias("started_at"),
        F.expr("try_cast(stoptime AS timestamp_ntz)").alias("ended_at"),
        F.col("`start station id`").alias("start_station_id"),
        F.col("`end station id`").alias("end_station_id"),
        *[F.expr(f"try_cast(`{c} station {x}` AS double)").alias(f"{c}_{y}") for c in ("start", "end") for x, y in (("latitude", "lat"), ("longitude", "lng"))],
        F.lit(None).cast("string").alias("rideable_type"),
        F.when(user == "Subscriber", "member").when(user == "Customer", "casual").alias("member_casual"),
    ).select(*[f.split()[0] for f in TARGET.split(", ")])


def normalize_era_b(df: DataFrame) -> DataFrame:
    return df.select(
        "ride_id",
        F.expr("try_cast(started_at AS timestamp_ntz)").alias("started_at"),
        F.expr("try_cast(ended_at AS timestamp_ntz)").alias("ended_at"),
        "start_station_id", "end_station_id",
        *[F.expr(f"try_cast({c} AS double)").alias(c) for c in ("start_lat", "start_lng", "end_lat", "end_lng")],
        "rideable_type", "member_casual",
    )


def read_trips(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files in the target layout. Spark reads one line of each for its header; ids are never inferred."""
    by_era: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    for path in paths:
        header = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
        by_era.setdefault((detect_era(header), tuple(c.strip().lower() for c in header)), []).append(path)
    out = None
    for (era, columns), own in sorted(by_era.items()):
        raw = spark.read.schema(_as_read(list(columns))).option("header", True).option("enforceSchema", True).csv(own)
        part = normalize_era_a(raw) if era == "A" else normalize_era_b(raw)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], TARGET)


def duration_s() -> Column:
    return F.timestamp_diff("SECOND", F.col("started_at"), F.col("ended_at"))


def failing_rule(params: IngestParams = IngestParams()) -> Column:
    """The first rule that a trip breaks, "kept" for none."""
    return (
        F.when(F.col("started_at").isNull() | F.col("ended_at").isNull(), "null_timestamp")
        .when(F.col("start_station_id").isNull() | F.col("end_station_id").isNull(), "null_station")
        .when(duration_s() < params.min_duration_s, "too_short")
        .when((F.col("start_station_id") == F.col("end_station_id")) & (duration_s() < params.self_loop_min_s), "short_self_loop")
        .otherwise("kept")
    )


def keep_valid(trips: DataFrame, params: IngestParams = IngestParams()) -> DataFrame:
    return trips.filter(failing_rule(params) == "kept")


def quality_counts(trips: DataFrame, params: IngestParams = IngestParams()) -> DataFrame:
    """rule, n: rows by the first rule they break, in one pass."""
    return trips.groupBy(failing_rule(params).alias("rule")).agg(F.count("*").alias("n"))


def assertion_counts(trips: DataFrame, params: IngestParams = IngestParams()) -> DataFrame:
    """One row of counts, each 0 for clean trips."""
    bad = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    return trips.agg(
        bad(F.col("started_at").isNull())("null_started_at"), bad(F.col("ended_at").isNull())("null_ended_at"),
        bad(F.col("start_station_id").isNull())("null_start_station"), bad(F.col("end_station_id").isNull())("null_end_station"),
        bad(F.col("ended_at") < F.col("started_at"))("ends_before_start"),
    )


#: The rules in the order in which they are tried.
RULES = ("null_timestamp", "null_station", "too_short", "short_self_loop", "kept")


def write_counted(raw: DataFrame, folder: str, params: IngestParams = IngestParams()) -> dict[str, int]:
    """Writes the valid trips (write_trips) and counts on the way: rows read, rows by the first rule they break, and what assertion_counts gives of the rows written.

    The counts are observed by the writing job itself, so raw is read once; a
    stage that is run again is counted again. Raises AssertionError where rows
    that must not be there were written.
    """
    seen, kept = Observation("read"), Observation("written")
    counted = raw.withColumn("rule_", failing_rule(params)).observe(seen, F.count("*").alias("rows"), *[F.count_if(F.col("rule_") == r).alias(r) for r in RULES])
    bad = {"null_started_at": F.col("started_at").isNull(), "null_ended_at": F.col("ended_at").isNull(), "null_start_station": F.col("start_station_id").isNull(), "null_end_station": F.col("end_station_id").isNull(), "ends_before_start": F.col("ended_at") < F.col("started_at")}
    valid = counted.filter(F.col("rule_") == "kept").drop("rule_").observe(kept, *[F.count_if(F.coalesce(x, F.lit(False))).alias(n) for n, x in bad.items()])
    write_trips(valid, folder)
    if raw.isEmpty():  # then the optimizer may leave the observations out
        return dict.fromkeys(("rows", *RULES, *bad), 0)
    faults = kept.get
    if any(faults.values()):
        raise AssertionError(f"trips break rules: { {k: v for k, v in faults.items() if v} }")
    return seen.get | faults


def assert_clean(trips: DataFrame) -> None:
    counts = assertion_counts(trips).first().asDict()
    if any(counts.values()):
        raise AssertionError(f"trips break rules: { {k: v for k, v in counts.items() if v} }")


def monthly_totals(trips: DataFrame) -> DataFrame:
    return trips.groupBy(F.date_format("started_at", "yyyy-MM").alias("month_key")).agg(F.count("*").alias("n_trips"))


def hour_of_week_profile(trips: DataFrame) -> DataFrame:
    from ..functions.columns import hour_of_week

    return trips.groupBy(hour_of_week(F.col("started_at")).alias("hour_of_week")).agg(F.count("*").alias("departures"))


def write_trips(trips: DataFrame, folder: str) -> None:
    """Parquet files in a folder a month (month_key=yyyy-mm); months that are written again replace what was there.

    A month is dealt to as many tasks as its size asks for, each of which sorts its part of the month.
    """
    rows = trips.withColumn("month_key", F.date_format("started_at", "yyyy-MM"))
    rows.hint("rebalance", "month_key").sortWithinPartitions("month_key", "started_at").write.partitionBy("month_key").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(folder)


def read_parts(spark: SparkSession, folder: str, single: str) -> DataFrame:
    """All files of a folder, or the single file where there is no such folder."""
    return spark.read.parquet(folder if exists(spark, folder) else single)
