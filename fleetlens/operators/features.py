"""Lags, run lengths, neighbour demand and target encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import floor_hour


def _by_station() -> W:
    return W.partitionBy("station_id").orderBy("interval_start")


def weather_lags(weather: DataFrame) -> DataFrame:
    """weather with precip_lag1h and precip_lag2h: the rain one and two hours before, matched by hour.

    An equi-join on shifted hours needs no global window, and a missing hour
    gives null instead of the hour before it.
    """
    own = weather
    for h in (1, 2):
        shifted = weather.select((F.col("timestamp") + F.expr(f"interval {h} hour")).alias("timestamp"), F.col("precip_mm").alias(f"precip_lag{h}h"))
        own = own.join(shifted, "timestamp", "left")
    return own


def add_own_lags(panel: DataFrame, column: str, prefix: str, lag_rows: int = 4, week_rows: int = 672) -> DataFrame:
    """Mean of the lag_rows rows before, and the row week_rows before (the panel is dense)."""
    w = _by_station()
    return panel.withColumns({f"{prefix}_own_lag_1h": F.avg(column).over(w.rowsBetween(-lag_rows, -1)), f"{prefix}_own_lag_1week": F.lag(column, week_rows).over(w)})


def add_week_ago(panel: DataFrame, column: str, out: str) -> DataFrame:
    """panel with column of the interval seven days before, as an equi-join on the shifted time; null where there is no such row."""
    before = panel.select("station_id", (F.col("interval_start") + F.expr("interval 7 days")).alias("interval_start"), F.col(column).alias(out))
    return panel.join(before, ["station_id", "interval_start"], "left")


def add_neighbor_demand(panel: DataFrame, column: str, prefix: str) -> DataFrame:
    """The zone's total in the interval less the station's own; null without a zone."""
    total = F.sum(column).over(W.partitionBy("zone_agg", "interval_start"))
    return panel.withColumn(f"{prefix}_neighbor_demand", F.when(F.col("zone_agg").isNotNull(), total - F.col(column)))


def add_run_length(panel: DataFrame, flag: str, out: str) -> DataFrame:
    """Full length of the run of true flags that a row is in, 0 where the flag is false. Runs don't cross stations."""
    w = _by_station()
    change = F.when(F.col(flag) != F.coalesce(F.lag(flag).over(w), ~F.col(flag)), 1).otherwise(0)
    marked = panel.withColumn("change_", change).withColumn("run_", F.sum("change_").over(w.rowsBetween(W.unboundedPreceding, 0)))
    n = F.count("*").over(W.partitionBy("station_id", "run_"))
    return marked.withColumn(out, F.when(F.col(flag), n).otherwise(0)).drop("change_", "run_")


def add_run_lengths(inventory: DataFrame) -> DataFrame:
    """Run lengths of both flags; a table that has them already is left as it is."""
    out = inventory
    for flag, name in (("is_bike_empty", "bike_empty_run_len"), ("is_dock_full", "dock_full_run_len")):
        out = out if name in out.columns else add_run_length(out, flag, name)
    return out


def capacity_staleness(panel: DataFrame) -> DataFrame:
    """station_id, is_capacity_stale: more trips met in one interval than there are docks."""
    return panel.groupBy("station_id").agg((F.first("capacity") < F.max(F.col("departures") + F.col("arrivals"))).alias("is_capacity_stale"))


def build_features(inventory: DataFrame, weather: DataFrame) -> DataFrame:
    """The feature table of both directions; station windows share one partitioning."""
    out = add_own_lags(add_own_lags(inventory, "departures", "dep"), "arrivals", "arr")
    out = add_run_lengths(out)
    out = add_neighbor_demand(add_neighbor_demand(out, "departures", "dep"), "arrivals", "arr")
    return out.withColumn("timestamp", floor_hour(F.col("interval_start"))).join(weather_lags(weather), "timestamp", "left").drop("timestamp")


def target_encoding(rows: DataFrame, key: str, target: str) -> DataFrame:
    """key, enc: mean target of each key; callers fill what is missing with the global mean."""
    return rows.groupBy(key).agg(F.avg(target).alias("enc"))


def apply_target_encoding(rows: DataFrame, encoding: DataFrame, key: str, global_mean: DataFrame, out: str) -> DataFrame:
    """rows with the key's mean, or the one-row global_mean (column m)."""
    return rows.join(encoding.withColumnRenamed("enc", out), key, "left").crossJoin(F.broadcast(global_mean)).withColumn(out, F.coalesce(out, "m")).drop("m")
