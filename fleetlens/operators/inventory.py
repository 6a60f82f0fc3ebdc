"""Inventory from flow balance.

With a prior weight over 1 the least-movement programme (minimise what is added
and removed outside of trips, keep 0 <= level <= capacity) is solved by the
reflected walk level <- clip(level + flow, 0, capacity), which moves bikes as
late as possible. Only intervals with a flow change the level, so the walk
visits those alone and levels are carried forward to the others. A step is the
map "add the flow, then clamp", and such maps compose, so the walk is a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import week_start
from ..params import InventoryParams
from ..session import shuffle_partitions


def usable_panel(panel: DataFrame) -> DataFrame:
    """Rows of stations with a capacity, without those that have 0 docks and yet some activity; adds net_flow and week_start."""
    known = panel.filter(F.col("capacity").isNotNull())
    impossible = known.filter((F.col("capacity") == 0) & (F.col("departures") + F.col("arrivals") > 0)).select("station_id").distinct()
    return known.join(impossible, "station_id", "left_anti").withColumns({"net_flow": F.col("arrivals") - F.col("departures"), "week_start": week_start(F.col("interval_start"))})


def varying_capacities(usable: DataFrame) -> DataFrame:
    """One row: stations, and how many of them have more than one capacity (null counts as one)."""
    per = usable.groupBy("station_id").agg(F.min("capacity").alias("low"), F.max("capacity").alias("high"), F.count("capacity").alias("known"), F.count("*").alias("n"))
    varies = (F.col("low") != F.col("high")) | ((F.col("known") > 0) & (F.col("known") < F.col("n")))
    return per.agg(F.count("*").alias("stations"), F.count_if(F.coalesce(varies, F.lit(False))).alias("varying"))


def assert_constant_capacity(usable: DataFrame) -> None:
    """Raises where a station's capacity changes: the walk takes it to be constant."""
    found = varying_capacities(usable).first()
    if found.varying:
        raise AssertionError(f"{found.varying} of {found.stations} stations have more than one capacity")


def dropped_stations(panel: DataFrame) -> DataFrame:
    """reason, stations, n_rows, volume of what usable_panel leaves out, and of what it keeps."""
    per = panel.groupBy("station_id").agg(F.first("capacity").alias("capacity"), F.count("*").alias("n"), F.sum(F.col("departures") + F.col("arrivals")).alias("v"))
    reason = F.when(F.col("capacity").isNull(), "no_capacity").when((F.col("capacity") == 0) & (F.col("v") > 0), "zero_capacity_active").otherwise("kept")
    return per.groupBy(reason.alias("reason")).agg(F.count("*").alias("stations"), F.sum("n").alias("n_rows"), F.sum("v").alias("volume"))


def clamp(level: Column, m: Column) -> Column:
    """What the map m (shift, low, high) makes of a level: least(high, greatest(low, level + shift))."""
    return F.least(m["high"], F.greatest(m["low"], level + m["shift"]))


def compose(first: Column, then: Column) -> Column:
    """The map that does first and then `then`: clamps are closed under composition, so blocks of steps are as small as a step."""
    return F.struct((first["shift"] + then["shift"]).alias("shift"), clamp(first["low"], then).alias("low"), clamp(first["high"], then).alias("high"))


def step(flow: Column, capacity: Column) -> Column:
    return F.struct(flow.alias("shift"), F.lit(0.0).alias("low"), capacity.alias("high"))


IDENTITY = "named_struct('shift', 0.0D, 'low', double('-infinity'), 'high', double('infinity'))"


def sparse_walk(usable: DataFrame, params: InventoryParams = InventoryParams()) -> DataFrame:
    """station_id, interval_start, level_before, level_after, n_in, n_out at intervals with a flow.

    A scan in three steps, all of built-in expressions: the steps of a station
    and day are composed to one map; the maps of a station, a row a day, give the
    level at each day's start; and the days are walked from there, each by
    itself. So the longest sequence that is walked is a day's, or the number of
    days.
    """
    flow = F.col("net_flow").cast("double")
    moved = usable.filter("net_flow != 0").select("station_id", F.to_date("interval_start").alias("day"), F.struct("interval_start", flow.alias("flow")).alias("s"), F.col("capacity").cast("double").alias("capacity"))
    days = moved.groupBy("station_id", "day").agg(F.sort_array(F.collect_list("s")).alias("steps"), F.first("capacity").alias("capacity"))
    whole = F.aggregate("steps", F.expr(IDENTITY), lambda m, s: compose(m, step(s["flow"], F.col("capacity"))))
    maps = days.select("station_id", "capacity", F.struct("day", whole.alias("map")).alias("d"))
    stations = maps.groupBy("station_id").agg(F.sort_array(F.collect_list(F.struct(F.col("d.day").alias("day"), F.col("d.map.shift").alias("shift"), F.col("d.map.low").alias("low"), F.col("d.map.high").alias("high")))).alias("days"), F.first("capacity").alias("capacity"))
    begun = F.aggregate(
        "days", F.struct((F.lit(params.first_fraction) * F.col("capacity")).alias("level"), F.expr("cast(array() as array<struct<day: date, level: double>>)").alias("out")),
        lambda a, d: F.struct(clamp(a["level"], d).alias("level"), F.concat(a["out"], F.array(F.struct(d["day"].alias("day"), a["level"].alias("level")))).alias("out")), lambda a: a["out"],
    )
    starts = stations.select("station_id", F.explode(begun).alias("b")).select("station_id", F.col("b.day").alias("day"), F.col("b.level").alias("start"))
    walked = F.aggregate(
        "steps", F.struct(F.col("start").alias("level"), F.expr("cast(array() as array<struct<interval_start: timestamp_ntz, flow: double, before: double>>)").alias("out")),
        lambda a, s: F.struct(clamp(a["level"], step(s["flow"], F.col("capacity"))).alias("level"), F.concat(a["out"], F.array(F.struct(s["interval_start"].alias("interval_start"), s["flow"].alias("flow"), a["level"].alias("before")))).alias("out")), lambda a: a["out"],
    )
    out = days.join(starts, ["station_id", "day"]).select("station_id", "capacity", F.explode(walked).alias("w"))
    raw = F.col("w.before") + F.col("w.flow")
    return out.select("station_id", F.col("w.interval_start").alias("interval_start"), F.col("w.before").alias("level_before"), F.least(F.col("capacity"), F.greatest(F.lit(0.0), raw)).alias("level_after"), F.greatest(F.lit(0.0), -raw).alias("n_in"), F.greatest(F.lit(0.0), raw - F.col("capacity")).alias("n_out"))


def reconstruct_inventory(usable: DataFrame, params: InventoryParams = InventoryParams()) -> DataFrame:
    """usable with inventory (before the interval's flow), flags, minutes and inferred non-trip movement."""
    steps = sparse_walk(usable, params).drop("level_before")
    joined = usable.join(steps, ["station_id", "interval_start"], "left")
    joined = joined.repartition(shuffle_partitions(usable.sparkSession), "station_id")  # the windows' sorts are larger than what is shuffled, by whose size tasks would be merged
    carried = F.last("level_after", ignorenulls=True).over(W.partitionBy("station_id").orderBy("interval_start").rowsBetween(W.unboundedPreceding, -1))
    out = joined.withColumn("inventory", F.coalesce(carried, params.first_fraction * F.col("capacity"))).drop("level_after")
    empty, full = F.col("inventory") <= params.epsilon, F.col("inventory") >= F.col("capacity") - params.epsilon
    return out.withColumns({
        "is_bike_empty": empty, "is_dock_full": full, "minutes_empty": F.when(empty, 15).otherwise(0), "minutes_full": F.when(full, 15).otherwise(0),
        "inferred_nontrip_in": F.coalesce("n_in", F.lit(0.0)), "inferred_nontrip_out": F.coalesce("n_out", F.lit(0.0)),
    }).drop("n_in", "n_out")


def bounds_check(inventory: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """One row: rows, and how many have a level outside of 0..capacity."""
    bad = (F.col("inventory") < -epsilon) | (F.col("inventory") > F.col("capacity") + epsilon)
    return inventory.agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("violations"))


def daily_nontrip(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy(F.to_date("interval_start").alias("day")).agg(F.sum("inferred_nontrip_in").alias("nontrip_in"), F.sum("inferred_nontrip_out").alias("nontrip_out"), F.sum("minutes_empty").alias("minutes_empty"), F.sum("minutes_full").alias("minutes_full"))


def monthly_cross_check(inventory: DataFrame, reported: DataFrame, low: float = 0.95, high: float = 5.0) -> DataFrame:
    """month_start, inferred, reported, ratio, flag against reported monthly totals (month_start, rebalanced_bikes_total)."""
    own = inventory.groupBy(F.to_date(F.date_trunc("month", "interval_start")).alias("month_start")).agg(F.sum(F.col("inferred_nontrip_in") + F.col("inferred_nontrip_out")).alias("inferred"))
    ratio = F.try_divide("inferred", F.col("rebalanced_bikes_total"))
    flag = F.when(ratio < low, "below").when(ratio > high, "above").when(ratio.isNull(), "no_report").otherwise("ok")
    return own.join(reported, "month_start", "left").select("month_start", "inferred", F.col("rebalanced_bikes_total").alias("reported"), F.round(ratio, 9).alias("ratio"), flag.alias("flag"))
