"""Zone x hour-of-week losses, their confidence bounds and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import hour_label, week_start


def n_weeks_covered(net: DataFrame) -> DataFrame:
    """One row, n_weeks: the span of interval starts in weeks (a fraction)."""
    return net.agg((F.timestamp_diff("SECOND", F.min("interval_start"), F.max("interval_start")) / 604800).alias("n_weeks"))


def _weekly(sums: DataFrame, net: DataFrame) -> DataFrame:
    out = sums.crossJoin(F.broadcast(n_weeks_covered(net)))
    return out.withColumns({c: F.try_divide(c, "n_weeks") for c in ("dep_net_lost", "arr_net_lost")}).drop("n_weeks")


def zone_hour_net_lost(net: DataFrame) -> DataFrame:
    """zone_agg, hour_of_week, dep_net_lost, arr_net_lost a week."""
    known = net.filter(F.col("zone_agg").isNotNull())
    return _weekly(known.groupBy("zone_agg", "hour_of_week").agg(F.sum("dep_net_lost").alias("dep_net_lost"), F.sum("arr_net_lost").alias("arr_net_lost")), net)


def station_net_lost(net: DataFrame) -> DataFrame:
    return _weekly(net.groupBy("station_id").agg(F.sum("dep_net_lost").alias("dep_net_lost"), F.sum("arr_net_lost").alias("arr_net_lost")), net)


def station_scatter(net: DataFrame, stations: DataFrame) -> DataFrame:
    """station_id, lat, lng and the losses a week of both directions, null taken for 0; stations without a place are left out."""
    placed = stations.filter("lat is not null").select("station_id", "lat", "lng")
    return station_net_lost(net).join(placed, "station_id").select("station_id", "lat", "lng", *[F.coalesce(c, F.lit(0.0)).alias(f"{c}_per_week") for c in ("dep_net_lost", "arr_net_lost")])


def zone_capacity(stations: DataFrame) -> DataFrame:
    return stations.filter("zone_agg is not null").groupBy("zone_agg").agg(F.sum("capacity").alias("zone_capacity"))


def boxed_zones(stations: DataFrame, lng: float, lat: float) -> DataFrame:
    """zone_agg, boxed: the zone's centre lies west of lng and at lat or north of it."""
    return stations.filter("zone_agg is not null").groupBy("zone_agg").agg(((F.avg("lng") < lng) & (F.avg("lat") >= lat)).alias("boxed"))


def exclude_boxed(rows: DataFrame, stations: DataFrame, lng: float = -74.02, lat: float = 40.68) -> DataFrame:
    return rows.join(boxed_zones(stations, lng, lat).filter("boxed").select("zone_agg"), "zone_agg", "left_anti")


def add_per_dock(rows: DataFrame, capacity: DataFrame) -> DataFrame:
    """rows with losses a dock; null for a zone of no docks."""
    joined = rows.join(capacity, "zone_agg", "left")
    return joined.withColumns({f"{d}_net_lost_per_dock": F.try_divide(f"{d}_net_lost", "zone_capacity") for d in ("dep", "arr")})


def per_dock_ci(net: DataFrame, capacity: DataFrame, z: float = 1.96) -> DataFrame:
    """zone_agg, hour_of_week, n_weeks and, a direction, mean, se and lower bound of weekly losses a dock.

    A week counts where the cell has rows; the bound is null below two weeks.
    """
    weekly = net.filter("zone_agg is not null").groupBy("zone_agg", "hour_of_week", week_start(F.col("interval_start")).alias("week_start")).agg(F.sum("dep_net_lost").alias("dep_net_lost"), F.sum("arr_net_lost").alias("arr_net_lost"))
    rows = add_per_dock(weekly, capacity)
    columns = [F.count("*").alias("n_weeks")]
    for d in ("dep", "arr"):
        x = f"{d}_net_lost_per_dock"
        se = F.stddev_samp(x) / F.sqrt(F.count("*"))
        columns += [F.avg(x).alias(f"{d}_mean"), se.alias(f"{d}_se"), (F.avg(x) - z * se).alias(f"{d}_lower")]
    return rows.groupBy("zone_agg", "hour_of_week").agg(*columns)


def top_zones_by_lower(ci: DataFrame, n: int = 40) -> DataFrame:
    """zone_agg, best_lower: the zones with the highest bound over hours and directions (null: none)."""
    low = lambda c: F.coalesce(c, F.lit(float("-inf")))
    best = ci.groupBy("zone_agg").agg(F.max(F.greatest(low("dep_lower"), low("arr_lower"))).alias("best_lower"))
    return best.filter(F.col("best_lower") > float("-inf")).orderBy(F.desc("best_lower"), "zone_agg").limit(n)


def top_zones(zone_hour: DataFrame, n: int = 40) -> DataFrame:
    """zone_agg, total of the zones that lose most in both directions together."""
    return zone_hour.groupBy("zone_agg").agg(F.sum(F.col("dep_net_lost") + F.col("arr_net_lost")).alias("total")).orderBy(F.desc("total"), "zone_agg").limit(n)


def matrix(zone_hour: DataFrame, value: str) -> DataFrame:
    """A row a zone with columns h0..h167, 0 where there is nothing."""
    wide = zone_hour.groupBy("zone_agg").pivot("hour_of_week", list(range(168))).agg(F.first(value)).fillna(0.0)
    return wide.select("zone_agg", *[F.col(f"`{h}`").alias(f"h{h}") for h in range(168)])


def peak_hours(zone_hour: DataFrame, value: str) -> DataFrame:
    """zone_agg, hour_of_week, label, peak: the first of the hours with the highest value."""
    best = zone_hour.groupBy("zone_agg").agg(F.max(F.struct(F.col(value).alias("v"), (-F.col("hour_of_week")).alias("h"))).alias("b"))
    how = (-F.col("b.h")).cast("int")
    return best.select("zone_agg", how.alias("hour_of_week"), hour_label(how).alias("label"), F.col("b.v").alias("peak"))
