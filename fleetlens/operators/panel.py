"""The dense station x interval panel."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.columns import floor_hour, floor_interval, hour_of_week
from ..session import shuffle_partitions


def build_departures(trips: DataFrame) -> DataFrame:
    return trips.groupBy(F.col("start_station_id").alias("station_id"), floor_interval(F.col("started_at")).alias("interval_start")).agg(F.count("*").alias("departures"))


def build_arrivals(trips: DataFrame) -> DataFrame:
    return trips.groupBy(F.col("end_station_id").alias("station_id"), floor_interval(F.col("ended_at")).alias("interval_start")).agg(F.count("*").alias("arrivals"))


def combine_observed(trips: DataFrame) -> DataFrame:
    """station_id, interval_start, departures, arrivals of the intervals with any.

    Each trip gives two half rows, so that one shuffle counts both sides; a
    full join of the two counts would shuffle twice.
    """
    ends = F.array(
        F.struct(F.col("start_station_id").alias("station_id"), floor_interval(F.col("started_at")).alias("interval_start"), F.lit(1).alias("d"), F.lit(0).alias("a")),
        F.struct(F.col("end_station_id").alias("station_id"), floor_interval(F.col("ended_at")).alias("interval_start"), F.lit(0).alias("d"), F.lit(1).alias("a")),
    )
    halves = trips.select(F.explode(ends).alias("e")).select("e.*")
    return halves.groupBy("station_id", "interval_start").agg(F.sum("d").alias("departures"), F.sum("a").alias("arrivals"))


def station_bounds(observed: DataFrame) -> DataFrame:
    return observed.groupBy("station_id").agg(F.min("interval_start").alias("first_interval"), F.max("interval_start").alias("last_interval"))


def fill_gaps(observed: DataFrame, stations: DataFrame) -> DataFrame:
    """Every interval between a station's own first and last observed one, with station metadata; those in between have zeros.

    An observed interval gives its own row and those up to the next one, so the
    dense rows are made where the observed ones lie: no grid is joined, sorted or
    shuffled, and none can be taken for small and broadcast. The metadata joins
    the observed rows for the same reason. Rows are dealt by station to as many
    tasks as there are shuffle partitions, by their observed size adaptive
    execution would make too few, and stay so dealt.
    """
    step = F.expr("interval 15 minutes")
    following = F.lead("interval_start").over(W.partitionBy("station_id").orderBy("interval_start"))
    dealt = observed.repartition(shuffle_partitions(observed.sparkSession), "station_id")
    upto = dealt.withColumn("last_", F.coalesce(following - step, "interval_start"))
    rows = join_station_metadata(upto, stations).withColumn("at_", F.explode(F.sequence("interval_start", "last_", step)))
    count = lambda c: F.when(F.col("at_") == F.col("interval_start"), F.col(c)).otherwise(0).alias(c)
    others = [c for c in rows.columns if c not in ("station_id", "interval_start", "departures", "arrivals", "last_", "at_")]
    return rows.select("station_id", F.col("at_").alias("interval_start"), count("departures"), count("arrivals"), *others)


def join_station_metadata(panel: DataFrame, stations: DataFrame) -> DataFrame:
    """Capacity and zones; stations without a match keep their rows with nulls."""
    return panel.join(stations.drop("lat", "lng", "name"), "station_id", "left")


def us_federal_holidays(spark: SparkSession, first: str, last: str) -> DataFrame:
    """holiday_date rows of the US federal calendar, a few a year."""
    from pandas.tseries.holiday import USFederalHolidayCalendar

    days = USFederalHolidayCalendar().holidays(pd.Timestamp(first), pd.Timestamp(last))
    values = ", ".join(f"(date '{d.date()}')" for d in days)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(holiday_date)") if values else spark.createDataFrame([], "holiday_date date")


def add_calendar(panel: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """hour, dow (0 = Monday), month, hour_of_week and, with holidays, is_holiday."""
    t = F.col("interval_start")
    out = panel.withColumns({"hour": F.hour(t), "dow": F.weekday(t), "month": F.month(t), "hour_of_week": hour_of_week(t)})
    if holidays is None:
        return out
    marked = holidays.select(F.col("holiday_date").alias("holiday_"), F.lit(True).alias("is_holiday"))
    return out.join(F.broadcast(marked), F.to_date(t) == F.col("holiday_"), "left").drop("holiday_").withColumn("is_holiday", F.coalesce("is_holiday", F.lit(False)))


def join_weather(panel: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather of the hour; hours without any keep nulls."""
    return panel.withColumn("timestamp", floor_hour(F.col("interval_start"))).join(weather, "timestamp", "left").drop("timestamp")


def build_counts(trips: DataFrame, stations: DataFrame) -> DataFrame:
    """The dense panel with station metadata."""
    return fill_gaps(combine_observed(trips), stations)


def build_panel(trips: DataFrame, stations: DataFrame, weather: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    return join_weather(add_calendar(build_counts(trips, stations), holidays), weather)


def panel_checks(panel: DataFrame, trips: DataFrame) -> DataFrame:
    """One row: trips, sums of departures and arrivals, stations, and how many of them have a gap."""
    per = panel.groupBy("station_id").agg(F.count("*").alias("n"), F.min("interval_start").alias("a"), F.max("interval_start").alias("b"), F.sum("departures").alias("d"), F.sum("arrivals").alias("r"))
    gap = (F.timestamp_diff("MINUTE", F.col("a"), F.col("b")) / 15 + 1).cast("bigint") != F.col("n")
    sums = per.agg(F.sum("d").alias("departures"), F.sum("r").alias("arrivals"), F.count("*").alias("stations"), F.sum(F.when(gap, 1).otherwise(0)).alias("stations_with_gaps"))
    return sums.crossJoin(trips.agg(F.count("*").alias("trips")))


def capacity_coverage(panel: DataFrame) -> DataFrame:
    """One row: stations and rows, all and without capacity."""
    null = F.col("capacity").isNull()
    return panel.agg(
        F.countDistinct("station_id").alias("stations"), F.countDistinct(F.when(null, F.col("station_id"))).alias("null_stations"),
        F.count("*").alias("n_rows"), F.count_if(null).alias("null_rows"),
    )


def station_activity(trips: DataFrame) -> DataFrame:
    """station_id, departures, arrivals over all trips."""
    d = trips.groupBy(F.col("start_station_id").alias("station_id")).agg(F.count("*").alias("departures"))
    a = trips.groupBy(F.col("end_station_id").alias("station_id")).agg(F.count("*").alias("arrivals"))
    return d.join(a, "station_id", "full").select("station_id", F.coalesce("departures", F.lit(0)).alias("departures"), F.coalesce("arrivals", F.lit(0)).alias("arrivals"))


def reconcile_capacity(activity: DataFrame, stations: DataFrame, warn_share: float = 0.02) -> DataFrame:
    """One row: share of stations and of activity without a capacity, and whether the latter is over warn_share."""
    joined = activity.join(stations.select("station_id", "capacity"), "station_id", "left").withColumn("volume", F.col("departures") + F.col("arrivals"))
    null = F.col("capacity").isNull()
    out = joined.agg(
        F.count("*").alias("stations"), F.count_if(null).alias("unmatched_stations"), F.sum("volume").alias("volume"),
        F.coalesce(F.sum(F.when(null, F.col("volume"))), F.lit(0)).alias("unmatched_volume"),
    )
    share = F.try_divide("unmatched_volume", "volume")
    return out.withColumns({"unmatched_share": F.round(share, 9), "warn": share > warn_share})
