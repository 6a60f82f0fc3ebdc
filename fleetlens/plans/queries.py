"""Queries of the chain over the stand-in tables, each beside its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import columns as C
from ..operators import allocate, censoring, compare, demand, features, heatmap, inventory, od, panel, policies, simulate, validate, value, zones
from ..operators.boosting import BoostParams
from ..session import checkpoint_dir
from ..sources import trips
from ..streaming import tumbling
from . import replicates
from .chain import Chain, chain_of
from .model_sql import TOTALS, newton_parts, tree_parts
from .oracle import PARTS, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show; -0 becomes 0."""
    return df.select(*[(F.round(f.name, digits) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def query(oracle: str | None = None, **parts: str):
    """Registers a function of a Chain under its name, with the SQL that gives the same rows."""
    def take(f: Callable[[Chain], DataFrame]) -> Callable[[Chain], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(chain_of(spark, sf_dir))
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle, **parts)
        return f

    return take


def _r(*names: str, digits: int = 9) -> str:
    return ", ".join(f"round({n.split(' AS ')[0]}, {digits}) + 0.0::DOUBLE AS {n.split(' AS ')[-1]}" for n in names)


# Trips and the panel


@query("SELECT how AS hour_of_week, count(*) AS departures FROM trips GROUP BY ALL")
def q_hour_of_week_departures(c: Chain) -> DataFrame:
    return trips.hour_of_week_profile(c.trips)


@query("SELECT strftime(started_at, '%Y-%m') AS month_key, count(*) AS n_trips FROM trips GROUP BY ALL")
def q_monthly_totals(c: Chain) -> DataFrame:
    return trips.monthly_totals(c.trips)


@query("""SELECT CASE WHEN started_at IS NULL OR ended_at IS NULL THEN 'null_timestamp' WHEN start_station_id IS NULL OR end_station_id IS NULL THEN 'null_station'
    WHEN date_diff('second', started_at, ended_at) < 60 THEN 'too_short' WHEN start_station_id = end_station_id AND date_diff('second', started_at, ended_at) < 120 THEN 'short_self_loop' ELSE 'kept' END AS rule,
    count(*) AS n FROM trips_raw GROUP BY ALL""")
def q_ingest_quality(c: Chain) -> DataFrame:
    return trips.quality_counts(c.trips_raw)


@query("""SELECT count(*) FILTER (WHERE started_at IS NULL) AS null_started_at, count(*) FILTER (WHERE ended_at IS NULL) AS null_ended_at, count(*) FILTER (WHERE start_station_id IS NULL) AS null_start_station,
    count(*) FILTER (WHERE end_station_id IS NULL) AS null_end_station, count(*) FILTER (WHERE ended_at < started_at) AS ends_before_start FROM trips""")
def q_ingest_assertions(c: Chain) -> DataFrame:
    return trips.assertion_counts(c.trips)


RULE_COUNTS = """SELECT count(*) AS rows, count(*) FILTER (WHERE started_at IS NULL OR ended_at IS NULL) AS null_timestamp, count(*) FILTER (WHERE started_at IS NOT NULL AND ended_at IS NOT NULL AND (start_station_id IS NULL OR end_station_id IS NULL)) AS null_station,
    count(*) FILTER (WHERE start_station_id IS NOT NULL AND end_station_id IS NOT NULL AND s < 60) AS too_short, count(*) FILTER (WHERE s >= 60 AND s < 120 AND start_station_id = end_station_id) AS short_self_loop,
    count(*) FILTER (WHERE start_station_id IS NOT NULL AND end_station_id IS NOT NULL AND s >= 60 AND (s >= 120 OR start_station_id <> end_station_id)) AS kept,
    0::BIGINT AS null_started_at, 0::BIGINT AS null_ended_at, 0::BIGINT AS null_start_station, 0::BIGINT AS null_end_station, 0::BIGINT AS ends_before_start FROM (SELECT *, date_diff('second', started_at, ended_at) AS s FROM trips_raw)"""


@query(RULE_COUNTS)
def q_written_counts(c: Chain) -> DataFrame:
    """What the job that writes the trips has counted on the way."""
    counts = trips.write_counted(c.trips_raw, f"{checkpoint_dir(c.spark)}/{uuid.uuid4().hex}", c.params.ingest)
    return c.spark.createDataFrame([tuple(counts.values())], ", ".join(f"{k} bigint" for k in counts))


ACTIVITY = {"activity": "SELECT station_id, sum(d)::BIGINT AS departures, sum(a)::BIGINT AS arrivals FROM (SELECT start_station_id AS station_id, 1 AS d, 0 AS a FROM trips UNION ALL SELECT end_station_id, 0, 1 FROM trips) GROUP BY ALL"}


@query("SELECT * FROM activity", **ACTIVITY)
def q_station_activity(c: Chain) -> DataFrame:
    return panel.station_activity(c.trips)


@query("""SELECT *, round(unmatched_volume / volume, 9) AS unmatched_share, unmatched_volume / volume > 0.02 AS warn FROM (
    SELECT count(*) AS stations, count(*) FILTER (WHERE capacity IS NULL) AS unmatched_stations, sum(departures + arrivals)::BIGINT AS volume, coalesce(sum(departures + arrivals) FILTER (WHERE capacity IS NULL), 0)::BIGINT AS unmatched_volume
    FROM activity a LEFT JOIN stations s ON a.station_id = s.station_id)""", **ACTIVITY)
def q_capacity_reconcile(c: Chain) -> DataFrame:
    return panel.reconcile_capacity(panel.station_activity(c.trips), c.stations)


@query("SELECT hour_of_week, count(*) AS n_rows, sum(departures)::BIGINT AS departures, sum(arrivals)::BIGINT AS arrivals, count(capacity) AS with_capacity FROM panel GROUP BY ALL")
def q_panel_dense(c: Chain) -> DataFrame:
    return c.panel.groupBy("hour_of_week").agg(F.count("*").alias("n_rows"), F.sum("departures").alias("departures"), F.sum("arrivals").alias("arrivals"), F.count("capacity").alias("with_capacity"))


@query("SELECT station_id, first_interval, last_interval, (date_diff('minute', first_interval, last_interval) // 15 + 1)::BIGINT AS n_intervals FROM bounds")
def q_panel_bounds(c: Chain) -> DataFrame:
    b = panel.station_bounds(panel.combine_observed(c.trips))
    return b.withColumn("n_intervals", (F.timestamp_diff("MINUTE", F.col("first_interval"), F.col("last_interval")) / 15 + 1).cast("bigint"))


@query("SELECT (SELECT count(*) FROM trips) AS trips, sum(departures)::BIGINT AS departures, sum(arrivals)::BIGINT AS arrivals, count(DISTINCT station_id) AS stations, (SELECT count(*) FROM (SELECT station_id FROM panel GROUP BY station_id HAVING date_diff('minute', min(interval_start), max(interval_start)) / 15 + 1 <> count(*))) AS stations_with_gaps FROM panel")
def q_panel_checks(c: Chain) -> DataFrame:
    out = panel.panel_checks(c.panel, c.trips)
    return out.select("trips", "departures", "arrivals", "stations", F.col("stations_with_gaps").cast("bigint").alias("stations_with_gaps"))


@query("SELECT count(DISTINCT station_id) AS stations, count(DISTINCT station_id) FILTER (WHERE capacity IS NULL) AS null_stations, count(*) AS n_rows, count(*) FILTER (WHERE capacity IS NULL) AS null_rows FROM panel")
def q_capacity_coverage(c: Chain) -> DataFrame:
    return panel.capacity_coverage(c.panel)


@query(f"""SELECT hour_of_week, {_r('avg(temp_c) AS temp_c', 'sum(precip_mm) AS precip_mm', 'avg(wind_kph) AS wind_kph', 'avg(humidity_pct) AS humidity_pct')}, count(w.timestamp) AS n_matched
    FROM panel p LEFT JOIN weather w ON w.timestamp = time_bucket(INTERVAL 1 HOUR, p.interval_start) GROUP BY ALL""")
def q_calendar_weather_join(c: Chain) -> DataFrame:
    p = panel.join_weather(c.panel, c.weather)
    return rounded(p.groupBy("hour_of_week").agg(F.avg("temp_c").alias("temp_c"), F.sum("precip_mm").alias("precip_mm"), F.avg("wind_kph").alias("wind_kph"), F.avg("humidity_pct").alias("humidity_pct"), F.count("temp_c").alias("n_matched")))


@query("SELECT interval_start::DATE AS day, interval_start::DATE IN (DATE '2024-01-01', DATE '2024-01-15') AS is_holiday, sum(departures)::BIGINT AS departures FROM panel GROUP BY ALL")
def q_holiday_flag(c: Chain) -> DataFrame:
    p = panel.add_calendar(c.panel.drop("hour", "dow", "month", "hour_of_week"), panel.us_federal_holidays(c.spark, "2024-01-01", "2024-02-15"))
    return p.groupBy(F.to_date("interval_start").alias("day"), "is_holiday").agg(F.sum("departures").alias("departures"))


# Space


@query("SELECT station_id, neighbor_id, round(distance_m, 3) AS distance_m FROM pairs")
def q_radius_pairs(c: Chain) -> DataFrame:
    return rounded(c.pairs, 3)


@query("SELECT station_id, hop::INTEGER AS hop, neighbor_id, round(distance_m, 3) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY distance_m, neighbor_id) AS hop FROM dist WHERE distance_m <= 1000) WHERE hop <= 3")
def q_reroute_neighbors(c: Chain) -> DataFrame:
    return rounded(zones.reroute_neighbors(c.stations), 3)


@query("SELECT zone_agg, count(*) AS stations FROM stations GROUP BY ALL")
def q_zone_sizes(c: Chain) -> DataFrame:
    return zones.zone_sizes(c.stations)


@query("SELECT count(*) AS zones, count(*) FILTER (WHERE n = 1) AS singletons, min(n) AS smallest, max(n) AS largest, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75 FROM (SELECT zone_agg, count(*) AS n FROM stations GROUP BY ALL)")
def q_zone_summary(c: Chain) -> DataFrame:
    return zones.zone_summary(zones.zone_sizes(c.stations))


@query("""SELECT s.zone_agg, any_value(n) AS stations, coalesce(round(max(distance_m), 3), 0.0::DOUBLE) AS diameter_m FROM stations s JOIN (SELECT zone_agg, count(*) AS n FROM stations GROUP BY ALL) z ON s.zone_agg = z.zone_agg
    LEFT JOIN (SELECT d.station_id, distance_m FROM dist d JOIN stations a ON a.station_id = d.station_id JOIN stations b ON b.station_id = d.neighbor_id AND a.zone_agg = b.zone_agg) x ON x.station_id = s.station_id GROUP BY s.zone_agg""")
def q_zone_diameters(c: Chain) -> DataFrame:
    return rounded(zones.zone_diameters(c.stations), 3)


#: The transverse Mercator series and cube rounding once more; e is the squared eccentricity, g the second one.
HEX = {
    "ell": "SELECT station_id, radians(lat) AS p, cos(radians(lat)) * radians(lng + 75.0::DOUBLE) AS d, (1 / 298.257223563::DOUBLE) * (2 - 1 / 298.257223563::DOUBLE) AS e FROM stations",
    "ell2": "SELECT *, 6378137.0::DOUBLE / sqrt(1 - e * sin(p) ** 2) AS n, tan(p) ** 2 AS t, e / (1 - e) AS g, e / (1 - e) * cos(p) ** 2 AS c FROM ell",
    "metres": """SELECT station_id, 0.9996::DOUBLE * n * (d + (1 - t + c) * d ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * g) * d ** 5 / 120) + 500000 AS x, 0.9996::DOUBLE * (6378137.0::DOUBLE * ((1 - e / 4 - 3 * e ** 2 / 64 - 5 * e ** 3 / 256) * p
        - (3 * e / 8 + 3 * e ** 2 / 32 + 45 * e ** 3 / 1024) * sin(2 * p) + (15 * e ** 2 / 256 + 45 * e ** 3 / 1024) * sin(4 * p) - (35 * e ** 3 / 3072) * sin(6 * p))
        + n * tan(p) * (d * d / 2 + (5 - t + 9 * c + 4 * c * c) * d ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * g) * d ** 6 / 720)) AS y FROM ell2""",
    "axial": "SELECT station_id, (x * sqrt(3.0::DOUBLE) / 3 - y / 3) / 460 AS q, (y * 2 / 3) / 460 AS r FROM metres",
    "cube": "SELECT station_id, round(q) AS a, round(r) AS b, round(-q - r) AS s, abs(round(q) - q) AS da, abs(round(r) - r) AS db, abs(round(-q - r) - (-q - r)) AS ds FROM axial",
}


@query("SELECT station_id, CASE WHEN da > db AND da > ds THEN -b - s ELSE a END::BIGINT::VARCHAR || ':' || CASE WHEN da > db AND da > ds THEN b WHEN db > ds THEN -a - s ELSE b END::BIGINT::VARCHAR AS zone_hex FROM cube", **HEX)
def q_hex_zones(c: Chain) -> DataFrame:
    return zones.hex_zones(c.stations)


#: The way up from resolution 8 as a recursive query; a digit weighs the steps along the three axes 4, 2 and 1.
H3 = {
    "globe": "SELECT station_id, radians(lat) AS p, radians(lng) + 1.347517358900396623::DOUBLE AS d, 1.054751253523952054::DOUBLE AS o, 0.780213654393430055::DOUBLE AS axis FROM stations",
    "face": """SELECT station_id, axis, (cos(o) * sin(p) - sin(o) * cos(p) * cos(d)) / (sin(o) * sin(p) + cos(o) * cos(p) * cos(d)) AS north, cos(p) * sin(d) / (sin(o) * sin(p) + cos(o) * cos(p) * cos(d)) AS east FROM globe
        WHERE sin(o) * sin(p) + cos(o) * cos(p) * cos(d) > 0""",
    "polar": "SELECT station_id, axis, 7.0::DOUBLE ** 4 / 0.38196601125010500003::DOUBLE * sqrt(north * north + east * east) AS far, axis - atan2(east, north) AS angle FROM face",
    "inside": "SELECT station_id, far * cos(angle) + far * sin(angle) / sqrt(3.0::DOUBLE) AS i, 2 * far * sin(angle) / sqrt(3.0::DOUBLE) AS j FROM polar WHERE greatest(-far * cos(angle), -far * cos(angle + 2 * pi() / 3), -far * cos(angle - 2 * pi() / 3)) <= 7.0::DOUBLE ** 4",
    "near": "SELECT station_id, i, j, round(i) AS a, round(j - i) AS b, round(-j) AS s FROM inside",
    "cells": """SELECT station_id, (CASE WHEN abs(a - i) > abs(b - j + i) AND abs(a - i) > abs(s + j) THEN -b - s ELSE a END)::BIGINT AS i,
        (CASE WHEN abs(a - i) > abs(b - j + i) AND abs(a - i) > abs(s + j) OR abs(b - j + i) > abs(s + j) THEN -s ELSE a + b END)::BIGINT AS j FROM near""",
}


@query("""SELECT s.station_id, t.zone_h3 FROM stations s LEFT JOIN (
    WITH RECURSIVE up AS (
        SELECT station_id, 8 AS r, i, j, 0::BIGINT AS digits FROM cells
        UNION ALL
        SELECT station_id, r - 1, pi, pj, digits + (4 * (di - least(di, dj, 0)) + 2 * (dj - least(di, dj, 0)) - least(di, dj, 0)) * (8 ** (15 - r))::BIGINT FROM (
            SELECT *, i - CASE WHEN r % 2 = 1 THEN 2 * pi + pj ELSE 3 * pi - pj END AS di, j - CASE WHEN r % 2 = 1 THEN 3 * pj - pi ELSE pi + 2 * pj END AS dj FROM (
                SELECT *, CASE WHEN r % 2 = 1 THEN round((3 * i - j) / 7.0::DOUBLE) ELSE round((2 * i + j) / 7.0::DOUBLE) END::BIGINT AS pi, CASE WHEN r % 2 = 1 THEN round((i + 2 * j) / 7.0::DOUBLE) ELSE round((3 * j - i) / 7.0::DOUBLE) END::BIGINT AS pj FROM up WHERE r > 0)))
    SELECT station_id, lower(to_hex((1::BIGINT << 59) + (8::BIGINT << 52) + ((CASE WHEN j = -1 THEN 21 ELSE 19 END)::BIGINT << 45) + digits + 2097151)) AS zone_h3 FROM up WHERE r = 0 AND i = -1 AND j IN (-1, 0)) t ON t.station_id = s.station_id""", **H3)
def q_h3_zones(c: Chain) -> DataFrame:
    return zones.h3_zones(c.stations)


@query()
def q_linkage_zones(c: Chain) -> DataFrame:
    return zones.linkage_zones(c.stations, c.params.space.linkage_m)


@query("SELECT count(*) AS stations, 0::BIGINT AS over_cut, 0::BIGINT AS mergeable FROM stations")
def q_linkage_faults(c: Chain) -> DataFrame:
    """Clusters that are too wide, or that could still be joined: complete linkage leaves neither."""
    return zones.linkage_faults(c.stations, zones.linkage_zones(c.stations, c.params.space.linkage_m), c.params.space.linkage_m)


# Inventory


@query("SELECT count(*) AS stations, count(*) FILTER (WHERE n > 1) AS varying FROM (SELECT station_id, count(DISTINCT capacity) AS n FROM usable GROUP BY ALL)")
def q_varying_capacities(c: Chain) -> DataFrame:
    return inventory.varying_capacities(c.usable)


@query("SELECT reason, count(*) AS stations, sum(n)::BIGINT AS n_rows, sum(v)::BIGINT AS volume FROM (SELECT station_id, CASE WHEN any_value(capacity) IS NULL THEN 'no_capacity' WHEN any_value(capacity) = 0 AND sum(departures + arrivals) > 0 THEN 'zero_capacity_active' ELSE 'kept' END AS reason, count(*) AS n, sum(departures + arrivals) AS v FROM panel GROUP BY station_id) GROUP BY reason")
def q_dropped_stations(c: Chain) -> DataFrame:
    return inventory.dropped_stations(c.panel)


@query("SELECT station_id, any_value(capacity) AS capacity, count(*) AS n_rows, sum(net_flow)::BIGINT AS net_flow, count(DISTINCT week_start) AS weeks FROM usable GROUP BY station_id")
def q_usable_stations(c: Chain) -> DataFrame:
    return c.usable.groupBy("station_id").agg(F.first("capacity").alias("capacity"), F.count("*").alias("n_rows"), F.sum("net_flow").alias("net_flow"), F.countDistinct("week_start").alias("weeks"))


@query("SELECT station_id, interval_start, b AS level_before, e AS level_after, greatest(0.0::DOUBLE, -(b + f)) AS n_in, greatest(0.0::DOUBLE, b + f - capacity) AS n_out FROM walk")
def q_inventory_walk(c: Chain) -> DataFrame:
    return inventory.sparse_walk(c.usable)


@query(f"SELECT station_id, {_r('avg(inventory) AS mean_inventory')}, count(*) FILTER (WHERE is_bike_empty) AS n_empty, count(*) FILTER (WHERE is_dock_full) AS n_full FROM inv GROUP BY ALL")
def q_inventory_dense(c: Chain) -> DataFrame:
    return rounded(c.inventory.groupBy("station_id").agg(F.avg("inventory").alias("mean_inventory"), F.count_if("is_bike_empty").alias("n_empty"), F.count_if("is_dock_full").alias("n_full")))


@query("SELECT interval_start::DATE AS day, sum(nontrip_in) AS nontrip_in, sum(nontrip_out) AS nontrip_out, 15 * count(*) FILTER (WHERE is_bike_empty) AS minutes_empty, 15 * count(*) FILTER (WHERE is_dock_full) AS minutes_full FROM inv GROUP BY ALL")
def q_inventory_daily_nontrip(c: Chain) -> DataFrame:
    return inventory.daily_nontrip(c.inventory)


@query("SELECT count(*) AS n_rows, count(*) FILTER (WHERE inventory < -1e-6::DOUBLE OR inventory > capacity + 1e-6::DOUBLE) AS violations FROM inv")
def q_bounds_check(c: Chain) -> DataFrame:
    return inventory.bounds_check(c.inventory)


@query("""SELECT month_start, inferred, reported, round(inferred / reported, 9) AS ratio, CASE WHEN inferred / reported < 0.95 THEN 'below' WHEN inferred / reported > 5 THEN 'above' WHEN reported IS NULL THEN 'no_report' ELSE 'ok' END AS flag
    FROM (SELECT date_trunc('month', interval_start)::DATE AS month_start, sum(nontrip_in + nontrip_out) AS inferred FROM inv GROUP BY ALL) LEFT JOIN (SELECT DATE '2024-01-01' AS m, 5000::BIGINT AS reported) ON m = month_start""")
def q_monthly_cross_check(c: Chain) -> DataFrame:
    reported = c.spark.sql("SELECT date '2024-01-01' AS month_start, 5000L AS rebalanced_bikes_total")
    return inventory.monthly_cross_check(c.inventory, reported)


# Features and demand


@query("SELECT w.timestamp, w.precip_mm, a.precip_mm AS precip_lag1h, b.precip_mm AS precip_lag2h FROM weather w LEFT JOIN weather a ON a.timestamp = w.timestamp - INTERVAL 1 HOUR LEFT JOIN weather b ON b.timestamp = w.timestamp - INTERVAL 2 HOUR")
def q_weather_lags(c: Chain) -> DataFrame:
    return features.weather_lags(c.weather).select("timestamp", "precip_mm", "precip_lag1h", "precip_lag2h")


@query(f"""SELECT hour_of_week, {_r('sum(l) AS lag_1h', 'sum(w) AS lag_1week')}, count(l) AS n_1h, count(w) AS n_1week FROM (
    SELECT hour_of_week, avg(departures) OVER (PARTITION BY station_id ORDER BY interval_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS l, lag(departures, 672) OVER (PARTITION BY station_id ORDER BY interval_start)::DOUBLE AS w FROM panel) GROUP BY ALL""")
def q_own_lags(c: Chain) -> DataFrame:
    p = features.add_own_lags(c.panel, "departures", "dep")
    return rounded(p.groupBy("hour_of_week").agg(F.sum("dep_own_lag_1h").alias("lag_1h"), F.sum(F.col("dep_own_lag_1week").cast("double")).alias("lag_1week"), F.count("dep_own_lag_1h").alias("n_1h"), F.count("dep_own_lag_1week").alias("n_1week")))


@query("SELECT a.station_id, count(b.departures) AS n, sum(b.departures)::BIGINT AS week_ago FROM panel a LEFT JOIN panel b ON b.station_id = a.station_id AND b.interval_start = a.interval_start - INTERVAL 7 DAY GROUP BY ALL")
def q_week_ago_lag(c: Chain) -> DataFrame:
    return features.add_week_ago(c.panel, "departures", "week_ago").groupBy("station_id").agg(F.count("week_ago").alias("n"), F.sum("week_ago").alias("week_ago"))


@query(f"""SELECT hour_of_week, count(*) AS n, sum(l)::BIGINT AS longest, sum(dn)::BIGINT AS dep_neighbor, sum(an)::BIGINT AS arr_neighbor, count(aw) AS n_week, {_r('sum(dl) AS dep_lag', 'sum(al) AS arr_lag', 'sum(temp_c) AS temp', 'sum(lag1) AS rain_before')} FROM (
    SELECT i.hour_of_week, i.dep_len + i.arr_len AS l, w.temp_c, x.precip_mm AS lag1, avg(departures) OVER s AS dl, avg(arrivals) OVER s AS al, lag(arrivals, 672) OVER (PARTITION BY station_id ORDER BY interval_start) AS aw,
    CASE WHEN zone_agg IS NOT NULL THEN sum(departures) OVER z - departures END AS dn, CASE WHEN zone_agg IS NOT NULL THEN sum(arrivals) OVER z - arrivals END AS an
    FROM runlens i LEFT JOIN weather w ON w.timestamp = date_trunc('hour', i.interval_start) LEFT JOIN weather x ON x.timestamp = date_trunc('hour', i.interval_start) - INTERVAL 1 HOUR
    WINDOW s AS (PARTITION BY station_id ORDER BY interval_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), z AS (PARTITION BY zone_agg, interval_start)) GROUP BY ALL""")
def q_features(c: Chain) -> DataFrame:
    """The joined feature table of both directions, summed by hour of the week."""
    total = lambda x, n: F.sum(x).alias(n)
    return rounded(c.features.groupBy("hour_of_week").agg(
        F.count("*").alias("n"), total(F.col("bike_empty_run_len") + F.col("dock_full_run_len"), "longest"), total("dep_neighbor_demand", "dep_neighbor"), total("arr_neighbor_demand", "arr_neighbor"),
        F.count("arr_own_lag_1week").alias("n_week"), total("dep_own_lag_1h", "dep_lag"), total("arr_own_lag_1h", "arr_lag"), total("temp_c", "temp"), total("precip_lag1h", "rain_before"),
    ))


@query("SELECT station_id, count(x) AS n, sum(x)::BIGINT AS neighbor_demand FROM (SELECT station_id, CASE WHEN zone_agg IS NOT NULL THEN sum(departures) OVER (PARTITION BY zone_agg, interval_start) - departures END AS x FROM panel) GROUP BY ALL")
def q_neighbor_demand(c: Chain) -> DataFrame:
    return features.add_neighbor_demand(c.panel, "departures", "dep").groupBy("station_id").agg(F.count("dep_neighbor_demand").alias("n"), F.sum("dep_neighbor_demand").alias("neighbor_demand"))


def _both(c: Chain, rows: Callable[[str, str, str, str], DataFrame]) -> DataFrame:
    """rows(direction, target, flag, run length) of both directions, with their name."""
    parts = [rows(d, *names).select(F.lit(d).alias("direction"), "*") for d, names in demand.DIRECTIONS.items()]
    return parts[0].unionByName(parts[1])


def _two(body: str) -> str:
    """SQL of both directions from one with {d}, {y}, {flag}."""
    one = [body.format(d=d, y=y, flag=flag) for d, y, flag in (("dep", "departures", "is_bike_empty"), ("arr", "arrivals", "is_dock_full"))]
    return f"SELECT 'dep' AS direction, * FROM ({one[0]}) UNION ALL SELECT 'arr', * FROM ({one[1]})"


@query(_two("SELECT station_id, max({d}_len) AS longest, sum({d}_len)::BIGINT AS total, count(*) FILTER (WHERE {d}_len > 0) AS n_in_runs FROM runlens GROUP BY ALL"))
def q_run_length(c: Chain) -> DataFrame:
    def of(d: str, y: str, flag: str, run: str) -> DataFrame:
        r = features.add_run_length(c.inventory, flag, "len")
        return r.groupBy("station_id").agg(F.max("len").alias("longest"), F.sum("len").alias("total"), F.count_if(F.col("len") > 0).alias("n_in_runs"))

    return _both(c, of)


@query(_two("SELECT CASE WHEN {d}_len <= 1 THEN 0 WHEN {d}_len <= 4 THEN 1 ELSE 2 END::INTEGER AS bucket, count(*) AS n FROM runlens WHERE {flag} GROUP BY ALL"))
def q_run_length_bucket(c: Chain) -> DataFrame:
    return _both(c, lambda d, y, flag, run: c.rated.filter(flag).groupBy(C.upper_bucket(F.col(run), c.params.demand.run_edges).alias("bucket")).agg(F.count("*").alias("n")))


@query("SELECT station_id, any_value(capacity) < max(departures + arrivals) AS is_capacity_stale FROM usable GROUP BY station_id")
def q_capacity_staleness(c: Chain) -> DataFrame:
    return features.capacity_staleness(c.usable)


@query(_two("""SELECT u.station_id, round(any_value(coalesce(e.m, g.m)), 9) AS station_enc, round(any_value(coalesce(z.m, g.m)), 9) AS zone_enc FROM usable u LEFT JOIN (SELECT station_id, avg({y}) AS m FROM inv WHERE NOT {flag} GROUP BY ALL) e ON e.station_id = u.station_id
    LEFT JOIN (SELECT zone_agg, avg({y}) AS m FROM inv WHERE NOT {flag} GROUP BY ALL) z ON z.zone_agg = u.zone_agg, (SELECT avg({y}) AS m FROM inv WHERE NOT {flag}) g GROUP BY u.station_id"""))
def q_target_encoding(c: Chain) -> DataFrame:
    def of(d: str, y: str, flag: str, run: str) -> DataFrame:
        free = c.inventory.filter(~F.col(flag))
        overall = free.agg(F.avg(y).alias("m"))
        rows = c.usable.select("station_id", "zone_agg").distinct()
        rows = features.apply_target_encoding(rows, features.target_encoding(free, "station_id", y), "station_id", overall, "station_enc")
        rows = features.apply_target_encoding(rows, features.target_encoding(free, "zone_agg", y), "zone_agg", overall, "zone_enc")
        return rows.select("station_id", "station_enc", "zone_enc")

    return rounded(_both(c, of))


@query(f"SELECT count(*) AS n, {_r('sum(abs(departures - dep_d)) / sum(departures) AS dep_wmape', 'sum(abs(arrivals - arr_d)) / sum(arrivals) AS arr_wmape')} FROM unmet")
def q_rate_model_wmape(c: Chain) -> DataFrame:
    return rounded(c.unmet.agg(F.count("*").alias("n"), demand.wmape("departures", "dep_D_hat").alias("dep_wmape"), demand.wmape("arrivals", "arr_D_hat").alias("arr_wmape")))


@query(f"SELECT decile, count(*) AS n, {_r('sum(abs(departures - d)) / nullif(sum(departures), 0) AS wmape')} FROM (SELECT departures, d, len(list_filter(e, lambda x: x <= d))::INTEGER AS decile FROM (SELECT departures, round(dep_d, 9) AS d FROM unmet), (SELECT quantile_cont(round(dep_d, 9), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM unmet)) GROUP BY decile")
def q_wmape_by_decile(c: Chain) -> DataFrame:
    rows = c.unmet.select("departures", F.round("dep_D_hat", 9).alias("d"))
    return rounded(demand.wmape_by_decile(rows, "departures", "d"))


def _model_totals(c: Chain, kind: str, boost: BoostParams = BoostParams()) -> DataFrame:
    """Totals by station of both directions side by side, by one kind of model trained before the holdout."""
    rows = c.features
    for d in demand.DIRECTIONS:
        rows = demand.fit(c.features, d, c.params.demand.holdout_start, kind=kind, boost=boost).predict(rows)
    return rounded(demand.unmet_table(rows).groupBy("station_id").agg(*[F.sum(x).alias(x) for d, (y, *_) in demand.DIRECTIONS.items() for x in (f"{d}_D_hat", f"{d}_gross_unmet", y)]), 3)


@query(TOTALS, **newton_parts(steps=6))
def q_glm_unmet(c: Chain) -> DataFrame:
    """The Poisson regression; the SQL takes six Newton steps, of which the last changes nothing that shows."""
    return _model_totals(c, "poisson")


#: Few and shallow trees, which the SQL grows as well.
SMALL_TREES = BoostParams(rounds=3, rate=0.3, depth=2, bins=16)


@query(TOTALS, **tree_parts(SMALL_TREES))
def q_boosted_unmet(c: Chain) -> DataFrame:
    """The boosted trees."""
    return _model_totals(c, "boosted", SMALL_TREES)


@query(_two("SELECT station_id, interval_start, true_d AS \"true_D\", censored_y AS \"censored_Y\", len AS synthetic_run_length FROM cut_{d}"))
def q_synthetic_runs(c: Chain) -> DataFrame:
    p = c.params.demand
    return _both(c, lambda d, y, flag, run: censoring.synthetic_runs(c.held_out.filter(~F.col(flag)), y, p.calibration_runs, p.runs_each, p.seed))


RECOVERY = """SELECT stratum, run_length_bucket, is_capacity_stale, round(mae, 9) + 0.0::DOUBLE AS mae, round(bias, 9) + 0.0::DOUBLE AS bias, n FROM (
    SELECT 'overall' AS stratum, NULL::INTEGER AS run_length_bucket, NULL::BOOLEAN AS is_capacity_stale, avg(abs(err)) AS mae, avg(err) AS bias, count(*) AS n FROM {cut}_{d} HAVING count(*) > 0
    UNION ALL SELECT 'bucket', CASE WHEN len <= 1 THEN 0 WHEN len <= 4 THEN 1 ELSE 2 END::INTEGER, NULL, avg(abs(err)), avg(err), count(*) FROM {cut}_{d} GROUP BY 2
    UNION ALL SELECT 'stale', NULL, is_stale, avg(abs(err)), avg(err), count(*) FROM {cut}_{d} c JOIN stale s ON c.station_id = s.station_id GROUP BY 3)"""


@query(_two(RECOVERY.replace("{cut}", "cut")))
def q_synthetic_recovery(c: Chain) -> DataFrame:
    return rounded(_both(c, lambda d, *_: c.calibration[d][0]))


@query(_two("SELECT b AS run_length_bucket, round(bias, 9) + 0.0::DOUBLE AS bias FROM bias_{d}"))
def q_bucket_bias(c: Chain) -> DataFrame:
    return rounded(_both(c, lambda d, *_: c.calibration[d][1]))


@query(_two("""SELECT 'overall' AS stratum, NULL::INTEGER AS decile, count(*) AS n, round(sum(abs({y} - {d}_d)) / sum({y}), 9) AS wmape FROM rated WHERE NOT {flag} AND interval_start >= TIMESTAMP '2024-01-22'
    UNION ALL SELECT 'decile', decile, count(*), round(sum(abs({y} - d)) / nullif(sum({y}), 0), 9) FROM (SELECT {y}, d, len(list_filter(e, lambda x: x <= d))::INTEGER AS decile FROM
    (SELECT {y}, round({d}_d, 9) AS d FROM rated WHERE NOT {flag} AND interval_start >= TIMESTAMP '2024-01-22'),
    (SELECT quantile_cont(round({d}_d, 9), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM rated WHERE NOT {flag} AND interval_start >= TIMESTAMP '2024-01-22')) GROUP BY decile"""))
def q_held_out_wmape(c: Chain) -> DataFrame:
    return rounded(_both(c, lambda d, *_: demand.held_out_wmape(c.rated.withColumn(f"{d}_D_hat", F.round(f"{d}_D_hat", 9)), d, c.params.demand.holdout_start)))


#: The matched test of departures: edges and proportions of censored rows, run starts and the runs themselves.
STRATA = {
    "edges": "SELECT quantile_cont(round(dep_d, 9), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS d, quantile_cont(capacity, [0.25, 0.5, 0.75]) AS c FROM rated WHERE is_bike_empty",
    "strata": "SELECT u.*, concat_ws('_', len(list_filter(e.d, lambda x: x <= round(dep_d, 9))), len(list_filter(e.c, lambda x: x <= capacity)), hour_of_week) AS stratum FROM rated u, edges e",
    "props": "SELECT stratum, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM strata WHERE is_bike_empty GROUP BY stratum",
    "pool0": "SELECT station_id, interval_start, stratum, departures AS y, round(dep_d, 9) AS dhat, row_number() OVER (PARTITION BY station_id ORDER BY interval_start) - 1 AS pos, count(*) OVER (PARTITION BY station_id) AS n_rows FROM strata WHERE NOT is_bike_empty",
    "pool": "SELECT p.*, l.length FROM pool0 p, (SELECT unnest([1, 2, 3, 4, 6, 8, 12])::INTEGER AS length) l WHERE pos <= n_rows - 12",
    "want": "SELECT stratum, p AS target_mass, round_even(p * 2000, 0)::BIGINT AS desired FROM props",
    "taken": """SELECT * FROM (SELECT p.station_id, p.pos, p.stratum, p.length, w.desired, row_number() OVER (PARTITION BY p.length, p.stratum ORDER BY
        ((((((0 + 1)::BIGINT * 48271 + p.length * 16807 + 11) % 2147483647) * 48271 + station_id * 16807 + 11) % 2147483647) * 48271 + pos * 16807 + 11) % 2147483647, station_id, pos) AS nth
        FROM pool p JOIN want w ON p.stratum = w.stratum) WHERE nth <= desired""",
    "cover": "SELECT w.stratum, l.length, w.target_mass, w.desired, coalesce(t.n, 0) AS taken FROM want w CROSS JOIN (SELECT unnest([1, 2, 3, 4, 6, 8, 12])::INTEGER AS length) l LEFT JOIN (SELECT stratum, length, count(*) AS n FROM taken GROUP BY ALL) t ON t.stratum = w.stratum AND t.length = l.length",
    "poolcaps": "SELECT station_id, list_sort(list(y))[(round_even((count(*) - 1) * 0.1::DOUBLE, 0) + 1)::INTEGER] AS cap FROM pool0 GROUP BY station_id",
    "matched": "SELECT f.station_id, f.interval_start, t.length AS len, greatest(0.0::DOUBLE, f.dhat - least(f.y, c.cap)) - (f.y - least(f.y, c.cap)) AS err FROM taken t JOIN pool0 f ON f.station_id = t.station_id AND f.pos BETWEEN t.pos AND t.pos + t.length - 1 JOIN poolcaps c ON c.station_id = f.station_id",
}


def _rounded_rates(c: Chain) -> DataFrame:
    return c.rated.withColumn("dep_D_hat", F.round("dep_D_hat", 9))


@query(f"SELECT stratum, n, {_r('p')} FROM props", **STRATA)
def q_strata(c: Chain) -> DataFrame:
    rows = _rounded_rates(c).select("station_id", "hour_of_week", "capacity", "is_bike_empty", F.col("dep_D_hat").alias("D_hat"))
    censored = rows.filter("is_bike_empty")
    return rounded(censoring.stratum_proportions(censoring.assign_strata(censored, censoring.stratum_edges(censored))))


@query(f"""SELECT m.decile, {_r('m.target_mass AS target_mass')}, s.desired, s.taken, {_r('s.taken::DOUBLE / nullif(s.desired, 0) AS fill_rate')} FROM
    (SELECT split_part(stratum, '_', 1)::INTEGER AS decile, sum(target_mass) AS target_mass FROM want GROUP BY ALL) m JOIN
    (SELECT split_part(stratum, '_', 1)::INTEGER AS decile, sum(desired)::BIGINT AS desired, sum(taken)::BIGINT AS taken FROM cover GROUP BY ALL) s ON m.decile = s.decile""", **STRATA)
def q_matched_coverage(c: Chain) -> DataFrame:
    return rounded(censoring.coverage_by_decile(demand.calibrate_matched(_rounded_rates(c), "dep", 2000)[1]))


@query(f"""SELECT stratum, run_length_bucket, is_capacity_stale, {_r('mae', 'bias')}, n FROM (
    SELECT 'overall' AS stratum, NULL::INTEGER AS run_length_bucket, NULL::BOOLEAN AS is_capacity_stale, avg(abs(err)) AS mae, avg(err) AS bias, count(*) AS n FROM matched
    UNION ALL SELECT 'bucket', CASE WHEN len <= 1 THEN 0 WHEN len <= 4 THEN 1 ELSE 2 END::INTEGER, NULL, avg(abs(err)), avg(err), count(*) FROM matched GROUP BY 2
    UNION ALL SELECT 'stale', NULL, is_stale, avg(abs(err)), avg(err), count(*) FROM matched c JOIN (SELECT station_id, any_value(capacity) < max(departures + arrivals) AS is_stale FROM usable GROUP BY station_id) s ON c.station_id = s.station_id GROUP BY 3)""", **STRATA)
def q_matched_recovery(c: Chain) -> DataFrame:
    return rounded(demand.calibrate_matched(_rounded_rates(c), "dep", 2000)[0])


@query(f"SELECT station_id, {_r('sum(dep_gross) AS dep_gross_unmet', 'sum(arr_gross) AS arr_gross_unmet', digits=6)} FROM unmet GROUP BY ALL")
def q_gross_unmet(c: Chain) -> DataFrame:
    return rounded(c.unmet.groupBy("station_id").agg(F.sum("dep_gross_unmet").alias("dep_gross_unmet"), F.sum("arr_gross_unmet").alias("arr_gross_unmet")), 6)


@query(f"SELECT station_id, {_r('sum(dep_displaced) AS dep_displaced', 'sum(dep_net_lost) AS dep_net_lost', 'sum(arr_displaced) AS arr_displaced', 'sum(arr_net_lost) AS arr_net_lost', digits=6)} FROM net GROUP BY ALL")
def q_substitution_net(c: Chain) -> DataFrame:
    names = ("dep_displaced", "dep_net_lost", "arr_displaced", "arr_net_lost")
    return rounded(c.net.groupBy("station_id").agg(*[F.sum(n).alias(n) for n in names]), 6)


@query(f"SELECT direction, {_r('gross', 'displaced', 'net_lost', 'displaced / gross AS displaced_fraction', 'net_lost / gross AS net_lost_fraction', digits=6)} FROM (SELECT 'dep' AS direction, sum(dep_gross) AS gross, sum(dep_displaced) AS displaced, sum(dep_net_lost) AS net_lost FROM net UNION ALL SELECT 'arr', sum(arr_gross), sum(arr_displaced), sum(arr_net_lost) FROM net)")
def q_displaced_summary(c: Chain) -> DataFrame:
    from ..operators.substitution import summarize_displaced

    return rounded(summarize_displaced(c.net), 6)


# Heatmap


@query(f"SELECT zone_agg, hour_of_week, {_r('dep_net_lost', 'arr_net_lost', digits=6)} FROM zone_hour")
def q_zone_hour_net_lost(c: Chain) -> DataFrame:
    return rounded(c.zone_hour, 6)


@query(f"SELECT station_id, {_r('sum(dep_net_lost) / (SELECT w FROM span) AS dep_net_lost', 'sum(arr_net_lost) / (SELECT w FROM span) AS arr_net_lost', digits=6)} FROM net GROUP BY station_id")
def q_station_net_lost(c: Chain) -> DataFrame:
    return rounded(heatmap.station_net_lost(c.net), 6)


@query(f"SELECT n.station_id, s.lat, s.lng, {_r('n.d / (SELECT w FROM span) AS dep_net_lost_per_week', 'n.a / (SELECT w FROM span) AS arr_net_lost_per_week', digits=6)} FROM (SELECT station_id, sum(dep_net_lost) AS d, sum(arr_net_lost) AS a FROM net GROUP BY station_id) n JOIN stations s ON s.station_id = n.station_id")
def q_station_scatter(c: Chain) -> DataFrame:
    return rounded(heatmap.station_scatter(c.net, c.stations), 6)


@query(f"SELECT zone_agg, hour_of_week, n_weeks, {_r('dep_mean', 'dep_se', 'dep_lower', 'arr_mean', 'arr_se', 'arr_lower')} FROM ci")
def q_zone_hour_per_dock_ci(c: Chain) -> DataFrame:
    return rounded(c.ci)


@query("SELECT zone_agg, best_lower FROM (SELECT zone_agg, round(max(greatest(coalesce(dep_lower, '-infinity'::DOUBLE), coalesce(arr_lower, '-infinity'::DOUBLE))), 9) + 0.0::DOUBLE AS best_lower FROM ci GROUP BY zone_agg) WHERE best_lower > '-infinity'::DOUBLE ORDER BY best_lower DESC, zone_agg LIMIT 40")
def q_top_zones_lb(c: Chain) -> DataFrame:
    return heatmap.top_zones_by_lower(rounded(c.ci), c.params.heatmap.top)


@query("SELECT zone_agg, round(sum(dep_net_lost + arr_net_lost), 9) AS total FROM zone_hour GROUP BY zone_agg ORDER BY sum(dep_net_lost + arr_net_lost) DESC, zone_agg LIMIT 40")
def q_top_zones(c: Chain) -> DataFrame:
    return rounded(heatmap.top_zones(c.zone_hour, c.params.heatmap.top))


@query(_two("""SELECT zone_agg, hour_of_week, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][hour_of_week // 24 + 1] || ' ' || lpad((hour_of_week % 24)::VARCHAR, 2, '0') || ':00' AS label, v AS peak FROM (
    SELECT zone_agg, hour_of_week, round({d}_net_lost, 9) + 0.0::DOUBLE AS v, row_number() OVER (PARTITION BY zone_agg ORDER BY round({d}_net_lost, 9) DESC, hour_of_week) AS rn FROM zone_hour) WHERE rn = 1"""))
def q_peak_hour(c: Chain) -> DataFrame:
    return _both(c, lambda d, *_: heatmap.peak_hours(rounded(c.zone_hour), f"{d}_net_lost"))


@query(_two("SELECT zone_agg, " + ", ".join(f"round(coalesce(sum({{d}}_net_lost) FILTER (WHERE hour_of_week = {h}), 0.0::DOUBLE), 9) + 0.0::DOUBLE AS h{h}" for h in range(168)) + " FROM zone_hour GROUP BY zone_agg"))
def q_heatmap_matrix(c: Chain) -> DataFrame:
    return rounded(_both(c, lambda d, *_: heatmap.matrix(c.zone_hour, f"{d}_net_lost")))


@query("SELECT zone_agg, count(*) AS n_hours FROM zone_hour WHERE zone_agg NOT IN (SELECT zone_agg FROM stations GROUP BY zone_agg HAVING avg(lng) < -73.99::DOUBLE AND avg(lat) >= 40.72::DOUBLE) GROUP BY zone_agg")
def q_zone_box_exclusion(c: Chain) -> DataFrame:
    return heatmap.exclude_boxed(c.zone_hour, c.stations, -73.99, 40.72).groupBy("zone_agg").agg(F.count("*").alias("n_hours"))


@query(f"SELECT z.zone_agg, hour_of_week, {_r('dep_net_lost / nullif(zone_capacity, 0) AS dep_net_lost_per_dock', 'arr_net_lost / nullif(zone_capacity, 0) AS arr_net_lost_per_dock')} FROM zone_hour z LEFT JOIN zone_cap c ON z.zone_agg = c.zone_agg")
def q_zone_hour_per_dock(c: Chain) -> DataFrame:
    return rounded(heatmap.add_per_dock(c.zone_hour, heatmap.zone_capacity(c.stations)).select("zone_agg", "hour_of_week", "dep_net_lost_per_dock", "arr_net_lost_per_dock"))


# Origins and destinations


@query("""SELECT 'station_hour' AS tier, count(*) AS n_keys, sum(n)::BIGINT AS n_trips FROM (SELECT start_station_id, hour_of_week, end_station_id, count(*) AS n FROM od GROUP BY ALL)
    UNION ALL SELECT 'zone_hour', count(*), sum(n)::BIGINT FROM (SELECT start_zone_agg, hour_of_week, end_station_id, count(*) AS n FROM od WHERE start_zone_agg IS NOT NULL GROUP BY ALL)
    UNION ALL SELECT 'zone_daypart', count(*), sum(n)::BIGINT FROM (SELECT start_zone_agg, daypart, end_station_id, count(*) AS n FROM od WHERE start_zone_agg IS NOT NULL GROUP BY ALL)
    UNION ALL SELECT 'global', count(*), sum(n)::BIGINT FROM (SELECT end_station_id, count(*) AS n FROM od GROUP BY ALL)""")
def q_od_counts(c: Chain) -> DataFrame:
    out = None
    for tier, counts in c.od_counts.items():
        row = counts.agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_trips")).select(F.lit(tier).alias("tier"), "n_keys", "n_trips")
        out = row if out is None else out.unionByName(row)
    return out


def _tier_sql(tier: str, keys: list[str]) -> str:
    named = ", ".join(k if k in keys else f"NULL::{t} AS {k}" for k, t in OD_KEYS.items())
    own = ", ".join([*keys, "end_station_id"])
    over = f"PARTITION BY {', '.join(keys)}" if keys else ""
    return f"SELECT '{tier}' AS tier, {named}, end_station_id, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER ({over}), 9) AS prob FROM od {'WHERE start_zone_agg IS NOT NULL' if 'start_zone_agg' in keys else ''} GROUP BY {own}"


OD_KEYS = {"start_station_id": "BIGINT", "start_zone_agg": "VARCHAR", "hour_of_week": "INTEGER", "daypart": "INTEGER"}


@query(" UNION ALL ".join(_tier_sql(t, k) for t, k in od.TIERS.items()))
def q_od_probs(c: Chain) -> DataFrame:
    """The shares of all four tiers, keys that a tier doesn't have null."""
    out = None
    kinds = {"start_station_id": "bigint", "start_zone_agg": "string", "hour_of_week": "int", "daypart": "int"}
    for tier, shares in od.od_probabilities(c.od_counts).items():
        own = shares.select(F.lit(tier).alias("tier"), *[F.col(k) if k in od.TIERS[tier] else F.lit(None).cast(t).alias(k) for k, t in kinds.items()], "end_station_id", "n", "prob")
        out = own if out is None else out.unionByName(own)
    return rounded(out)


@query("""SELECT c.station_id, c.hour_of_week, CASE WHEN a.n >= 30 THEN 'station_hour' WHEN b.n >= 30 THEN 'zone_hour' WHEN d.n >= 30 THEN 'zone_daypart' ELSE 'global' END AS tier FROM (
    SELECT station_id, zone_agg, h::INTEGER AS hour_of_week, ((CASE WHEN h % 24 >= 7 THEN 1 ELSE 0 END) + (CASE WHEN h % 24 >= 10 THEN 1 ELSE 0 END) + (CASE WHEN h % 24 >= 16 THEN 1 ELSE 0 END) + (CASE WHEN h % 24 >= 19 THEN 1 ELSE 0 END)
    + (CASE WHEN h % 24 >= 22 THEN 1 ELSE 0 END) + (CASE WHEN h >= 120 THEN 6 ELSE 0 END))::INTEGER AS daypart FROM stations, range(0, 168) t(h)) c
    LEFT JOIN (SELECT start_station_id, hour_of_week, count(*) AS n FROM od GROUP BY ALL) a ON a.start_station_id = c.station_id AND a.hour_of_week = c.hour_of_week
    LEFT JOIN (SELECT start_zone_agg, hour_of_week, count(*) AS n FROM od GROUP BY ALL) b ON b.start_zone_agg = c.zone_agg AND b.hour_of_week = c.hour_of_week
    LEFT JOIN (SELECT start_zone_agg, daypart, count(*) AS n FROM od GROUP BY ALL) d ON d.start_zone_agg = c.zone_agg AND d.daypart = c.daypart""")
def q_od_cell_tier(c: Chain) -> DataFrame:
    return od.cell_tier(c.od_counts, c.stations, c.params.od)


# Value


@query(f"SELECT station_id, hour_of_week, week_start, capacity, zone_agg, {_r('p_stockout', 'dep_d AS mean_dep_D_hat', 'arr_d AS mean_arr_D_hat', 'net_lost AS mean_dep_net_lost', 'inventory AS mean_inventory', 'nontrip_in AS mean_nontrip_in', 'nontrip_out AS mean_nontrip_out')}, n AS n_intervals FROM weekly")
def q_station_hour_week(c: Chain) -> DataFrame:
    return rounded(c.weekly)


RATES = ("p_stockout_empirical", "dep_rate", "arr_rate", "nontrip_in_rate", "nontrip_out_rate", "mu", "lam")


@query(f"SELECT station_id, hour_of_week, capacity, n_weeks, {_r(*RATES)} FROM rates")
def q_station_hour_rates(c: Chain) -> DataFrame:
    return rounded(c.rates)


@query(f"SELECT station_id, hour_of_week, {_r('avg(net_lost * n) AS e_net_lost_given_stockout')} FROM weekly WHERE p_stockout > 0 GROUP BY ALL")
def q_net_lost_given_stockout(c: Chain) -> DataFrame:
    return rounded(value.net_lost_given_stockout(c.weekly))


@query(f"SELECT count(*) AS cells, count(*) FILTER (WHERE min_inventory <= 1) AS eligible_cells, {_r('sum(net_lost) AS net_lost', 'sum(net_lost) FILTER (WHERE min_inventory <= 1) AS eligible_net_lost', 'count(*) FILTER (WHERE min_inventory <= 1)::DOUBLE / count(*) AS cell_share', 'sum(net_lost) FILTER (WHERE min_inventory <= 1) / sum(net_lost) AS net_lost_share', digits=6)} FROM low")
def q_eligibility(c: Chain) -> DataFrame:
    return rounded(value.eligibility(c.low, c.params.value), 6)


@query(f"SELECT bucket, cells, {_r('cells::DOUBLE / sum(cells) OVER () AS cell_share', 'net_lost / sum(net_lost) OVER () AS net_lost_share')} FROM (SELECT CASE WHEN low_frac = 0 THEN '0' WHEN low_frac <= 0.10 THEN '<=0.10' WHEN low_frac <= 0.25 THEN '<=0.25' WHEN low_frac <= 0.50 THEN '<=0.50' ELSE '>0.50' END AS bucket, count(*) AS cells, sum(net_lost) AS net_lost FROM low GROUP BY ALL)")
def q_low_frequency_buckets(c: Chain) -> DataFrame:
    return rounded(value.low_frequency_buckets(c.low))


@query(f"SELECT station_id, hour_of_week, n_weeks, {_r('mean_slot', 'std_slot', 'modal_share')} FROM timing")
def q_chronic_timing(c: Chain) -> DataFrame:
    return rounded(c.timing)


@query(f"SELECT station_id, hour_of_week, {_r('-s AS slope')}, n_weeks, {_r('(lo + hi) / 2 AS midpoint')} FROM (SELECT station_id, hour_of_week, regr_slope(net_lost * n, inventory) AS s, count(*) AS n_weeks, min(inventory) AS lo, max(inventory) AS hi, var_pop(inventory) AS v FROM weekly GROUP BY ALL) WHERE n_weeks >= 3 AND hi > lo AND v * n_weeks * n_weeks > 1e-6")
def q_cross_check_slope(c: Chain) -> DataFrame:
    return rounded(value.cross_check_slopes(c.weekly, c.params.value))


@query(f"""SELECT x.*, m.mv_ AS mv, round(slope_ - m.mv, 9) + 0.0::DOUBLE AS diff, CASE WHEN m.mv >= 1e-9::DOUBLE THEN printf('%.8e', slope_ / m.mv) END AS ratio FROM (SELECT station_id, hour_of_week, {_r('-s AS slope')}, -s AS slope_, n_weeks, {_r('(lo + hi) / 2 AS midpoint')}, round_even((lo + hi) / 2, 0)::INTEGER AS k FROM (
    SELECT station_id, hour_of_week, regr_slope(net_lost * n, inventory) AS s, count(*) AS n_weeks, min(inventory) AS lo, max(inventory) AS hi, var_pop(inventory) AS v FROM weekly GROUP BY ALL) WHERE n_weeks >= 3 AND hi > lo AND v * n_weeks * n_weeks > 1e-6) x
    LEFT JOIN (SELECT *, round(mv, 9) + 0.0::DOUBLE AS mv_ FROM mv) m ON m.station_id = x.station_id AND m.hour_of_week = x.hour_of_week AND m.k = x.k""".replace("SELECT x.*,", "SELECT x.station_id, x.hour_of_week, x.slope, x.n_weeks, x.midpoint, x.k,"))
def q_cross_check_report(c: Chain) -> DataFrame:
    report = value.cross_check_report(value.cross_check_slopes(c.weekly, c.params.value), c.mv)
    return rounded(report.withColumn("ratio", F.format_string("%.8e", "ratio")).withColumn("ratio", F.when(F.col("mv") >= 1e-9, F.col("ratio"))))


@query(f"SELECT low_frac > 0.5 AS is_chronic, count(*) AS cells, {_r('median(nontrip_in_rate) AS nontrip_in', 'median(dep_rate) AS dep_rate', 'median(nontrip_in_rate / (dep_rate + 1e-6::DOUBLE)) AS intensity')} FROM rates r JOIN low l ON r.station_id = l.station_id AND r.hour_of_week = l.hour_of_week GROUP BY ALL")
def q_rebalancing_vs_chronicity(c: Chain) -> DataFrame:
    return rounded(value.rebalancing_vs_chronicity(c.rates, c.low))


@query(f"SELECT decile, is_chronic, count(*) AS cells, {_r('median(intensity) AS intensity')} FROM (SELECT len(list_filter(list_distinct(e), lambda x: x < dep_rate))::INTEGER AS decile, low_frac > 0.5 AS is_chronic, nontrip_in_rate / (dep_rate + 1e-6::DOUBLE) AS intensity FROM (SELECT round(r.dep_rate, 9) AS dep_rate, nontrip_in_rate, low_frac FROM rates r JOIN low l ON r.station_id = l.station_id AND r.hour_of_week = l.hour_of_week), (SELECT quantile_cont(round(dep_rate, 9), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM rates)) GROUP BY ALL")
def q_rebalancing_by_decile(c: Chain) -> DataFrame:
    return rounded(value.rebalancing_by_decile(c.rates.withColumn("dep_rate", F.round("dep_rate", 9)), c.low))


@query(f"""SELECT station_id, hour_of_week, {_r('CASE WHEN capacity <= 0 THEN 1.0::DOUBLE WHEN mu = 0 THEN NULL WHEN abs(lam / nullif(mu, 0) - 1) < 1e-12 THEN 1 / (capacity + 1.0::DOUBLE) ELSE (1 - lam / nullif(mu, 0)) / (1 - power(lam / nullif(mu, 0), capacity + 1.0::DOUBLE)) END AS p0')}, round(CASE WHEN lam < mu THEN 15 / power(sqrt(mu) - sqrt(lam), 2) END, 3) AS relaxation_minutes FROM (SELECT station_id, hour_of_week, capacity, round(mu, 9) AS mu, round(lam, 9) AS lam FROM rates)""")
def q_mm1k_relaxation(c: Chain) -> DataFrame:
    r = c.rates.select(*value.CELL, "capacity", F.round("mu", 9).alias("mu"), F.round("lam", 9).alias("lam"))
    return rounded(r.select(*value.CELL, C.mm1k_p0(F.col("lam"), F.col("mu"), F.col("capacity")).alias("p0"), F.round(C.relaxation_minutes(F.col("lam"), F.col("mu")), 3).alias("relaxation_minutes")))


@query(f"SELECT station_id, hour_of_week, k, {_r('mv')}, is_concave, first_violation_k FROM mv")
def q_mv_curve(c: Chain) -> DataFrame:
    return rounded(c.mv)


@query("SELECT is_concave, count(*) AS cells, min(first_violation_k) AS first_violation_k FROM mv WHERE k = 1 GROUP BY is_concave")
def q_concavity(c: Chain) -> DataFrame:
    return c.mv.filter("k = 1").groupBy("is_concave").agg(F.count("*").alias("cells"), F.min("first_violation_k").alias("first_violation_k"))


# Allocation


@query(f"SELECT station_id, hour_of_week, {_r('low_frac', 'modal_share')}, tier FROM tiers")
def q_tiers(c: Chain) -> DataFrame:
    return rounded(c.tiers)


@query(f"SELECT station_id, hour_of_week, {_r('min_inventory', 'origin_cost')} FROM origins")
def q_origins(c: Chain) -> DataFrame:
    return rounded(c.origins)


@query(f"SELECT station_id, hour_of_week, k, {_r('cum_mv')}, k_max FROM cum")
def q_dest_cum_mv(c: Chain) -> DataFrame:
    return rounded(c.cumulative)


@query(f"SELECT station_id, hour_of_week, tier, k_max, origin_station_id, {_r('low_frac', 'origin_cost', 'flow_prob')} FROM moves")
def q_candidate_moves(c: Chain) -> DataFrame:
    return rounded(c.moves)


@query(f"SELECT station_id, hour_of_week, origin_station_id, rank::INTEGER AS rank, {_r('payout', 'induced', 'value', 'dollar_cost', 'nvpd')} FROM ranked")
def q_rank_targets(c: Chain) -> DataFrame:
    return rounded(c.ranked.select("station_id", "hour_of_week", "origin_station_id", "rank", "payout", "induced", "value", "dollar_cost", "nvpd"))


@query(f"SELECT station_id, hour_of_week, rank::INTEGER AS rank, {_r('dollar_cost', 'running AS running_cost', digits=6)} FROM (SELECT *, sum(dollar_cost) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS running FROM ranked) WHERE running <= 60")
def q_budget_cutoff(c: Chain) -> DataFrame:
    return rounded(allocate.budget_cutoff(c.ranked, c.params.allocation.budget).select("station_id", "hour_of_week", "rank", "dollar_cost", "running_cost"), 6)


@query("SELECT * FROM tops", dest=PARTS["dest"].removesuffix(" LIMIT 3000"))
def q_elasticity_sweep(c: Chain) -> DataFrame:
    """The sweep over all destinations; the queries below take those with the highest ceilings."""
    return c.all_tops


@query("""SELECT draw_i, draw_j, count(*) AS n_common, CASE WHEN count(*) >= 2 THEN round(corr(pi, pj), 9) END AS rho FROM (
    SELECT draw_i, draw_j, row_number() OVER (PARTITION BY draw_i, draw_j ORDER BY ri) AS pi, row_number() OVER (PARTITION BY draw_i, draw_j ORDER BY rj) AS pj
    FROM (SELECT a.draw AS draw_i, b.draw AS draw_j, a.rank AS ri, b.rank AS rj FROM tops a JOIN tops b ON a.station_id = b.station_id AND a.hour_of_week = b.hour_of_week AND a.draw < b.draw)) GROUP BY draw_i, draw_j""")
def q_sweep_stability(c: Chain) -> DataFrame:
    return rounded(allocate.spearman_stability(c.tops))


@query("SELECT station_id, hour_of_week, round(count(*) / 25.0::DOUBLE, 9) AS appearance_frac FROM tops GROUP BY ALL")
def q_stable_core(c: Chain) -> DataFrame:
    return rounded(allocate.stable_core(c.tops, 25))


@query("""SELECT n_pairs, least_rho, median_rho, cells, in_every_draw FROM (SELECT count(rho) AS n_pairs, round(min(rho), 9) AS least_rho, round(median(rho), 9) AS median_rho FROM (
    SELECT CASE WHEN count(*) >= 2 THEN corr(pi, pj) END AS rho FROM (SELECT draw_i, draw_j, row_number() OVER (PARTITION BY draw_i, draw_j ORDER BY ri) AS pi, row_number() OVER (PARTITION BY draw_i, draw_j ORDER BY rj) AS pj
    FROM (SELECT a.draw AS draw_i, b.draw AS draw_j, a.rank AS ri, b.rank AS rj FROM tops a JOIN tops b ON a.station_id = b.station_id AND a.hour_of_week = b.hour_of_week AND a.draw < b.draw)) GROUP BY draw_i, draw_j)),
    (SELECT count(*) AS cells, count(*) FILTER (WHERE n = 25) AS in_every_draw FROM (SELECT count(*) AS n FROM tops GROUP BY station_id, hour_of_week))""")
def q_rank_stability(c: Chain) -> DataFrame:
    return rounded(allocate.stability_table(allocate.spearman_stability(c.tops), allocate.stable_core(c.tops, 25)))


@query("SELECT round(n / 25.0::DOUBLE, 9) AS appearance_frac, count(*) AS cells FROM (SELECT count(*) AS n FROM tops GROUP BY station_id, hour_of_week) GROUP BY n")
def q_appearance_counts(c: Chain) -> DataFrame:
    return rounded(allocate.appearance_counts(allocate.stable_core(c.tops, 25)))


# Policies


def _candidates(c: Chain) -> DataFrame:
    return policies.shared_candidates(c.moves, c.rates)


CURVES = {
    "candidates": "SELECT m.*, r.mu FROM moves m LEFT JOIN rates r ON m.station_id = r.station_id AND m.hour_of_week = r.hour_of_week",
    "points": "SELECT tier, a, b, i * 500.0::DOUBLE / 19999 AS p, a * (1 - exp(-b * i * 500.0::DOUBLE / 19999)) * (i * 500.0::DOUBLE / 19999) * 0.2::DOUBLE AS cost FROM range(0, 20000) r(i), (VALUES (1, 2.0::DOUBLE, 0.15::DOUBLE), (2, 3.0::DOUBLE, 0.25::DOUBLE)) t(tier, a, b)",
    "segments": "SELECT *, lead(p) OVER (PARTITION BY tier ORDER BY p) AS p1, lead(cost) OVER (PARTITION BY tier ORDER BY p) AS c1 FROM points",
    "even": "SELECT *, 60.0::DOUBLE / count(*) OVER () AS dollars FROM candidates",
    "bymu": "SELECT * FROM (SELECT *, 60.0::DOUBLE * mu / sum(mu) OVER () AS dollars FROM candidates) WHERE dollars > 0",
}


def _paid(rows: str) -> str:
    return f"""SELECT station_id, hour_of_week, tier, origin_station_id, round(a * (1 - exp(-b * payout)), 9) + 0.0::DOUBLE AS induced_trips, round(payout, 9) + 0.0::DOUBLE AS payout, round(a * (1 - exp(-b * payout)) * payout * 0.2::DOUBLE, 9) + 0.0::DOUBLE AS dollar_cost
        FROM (SELECT e.*, s.a, s.b, CASE WHEN s.c1 IS NULL THEN s.p ELSE s.p + (e.dollars - s.cost) * (s.p1 - s.p) / (s.c1 - s.cost) END AS payout FROM {rows} e ASOF JOIN segments s ON e.tier = s.tier AND e.dollars >= s.cost)"""


@query(_paid("even"), **CURVES)
def q_policy_uniform(c: Chain) -> DataFrame:
    return rounded(policies.uniform(_candidates(c), c.params.allocation.budget, c.params.allocation))


@query(_paid("bymu"), **CURVES)
def q_policy_proportional(c: Chain) -> DataFrame:
    return rounded(policies.proportional(_candidates(c), c.params.allocation.budget, c.params.allocation))


TOPN = {"flat": """SELECT m.*, round(r.p_stockout_empirical, 9) AS p, CASE WHEN tier = 1 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END * (1 - exp(-CASE WHEN tier = 1 THEN 0.15::DOUBLE ELSE 0.25::DOUBLE END * 10.0::DOUBLE)) AS induced
    FROM moves m LEFT JOIN rates r ON m.station_id = r.station_id AND m.hour_of_week = r.hour_of_week""",
    "topn": "SELECT * FROM (SELECT *, induced * 2.0::DOUBLE AS cost, sum(induced * 2.0::DOUBLE) OVER (ORDER BY p DESC NULLS LAST, station_id, hour_of_week ROWS UNBOUNDED PRECEDING) AS running FROM flat) WHERE running <= 60"}


def _top_n(c: Chain) -> DataFrame:
    rows = _candidates(c).withColumn("p_stockout", F.round("p_stockout", 9))
    return policies.top_n_stockout(rows, c.params.allocation.budget, c.params.allocation)


@query(f"SELECT station_id, hour_of_week, tier, origin_station_id, {_r('induced AS induced_trips', '10.0::DOUBLE AS payout', 'cost AS dollar_cost')} FROM topn", **TOPN)
def q_policy_topn(c: Chain) -> DataFrame:
    return rounded(_top_n(c))


@query(f"SELECT station_id, hour_of_week, {_r('least(induced, 1.8::DOUBLE) AS induced_trips', 'cost AS dollar_cost')} FROM topn", **TOPN)
def q_move_cap(c: Chain) -> DataFrame:
    return rounded(policies.apply_move_cap(_top_n(c), 1.8).select("station_id", "hour_of_week", "induced_trips", "dollar_cost"))


@query(f"SELECT station_id, hour_of_week, tier, origin_station_id, {_r('induced AS induced_trips', 'payout', 'dollar_cost')} FROM (SELECT *, sum(dollar_cost) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS running FROM ranked) WHERE running <= 60")
def q_policy_allocator(c: Chain) -> DataFrame:
    return rounded(policies.allocator(c.ranked, c.params.allocation.budget))


COST = "CASE WHEN {t} = 1 THEN 2.0::DOUBLE * (1 - exp(-0.15::DOUBLE * {p})) ELSE 3.0::DOUBLE * (1 - exp(-0.25::DOUBLE * {p})) END * {p} * 0.2::DOUBLE"
LEVEL = "[1.0::DOUBLE, 2, 5, 10, 20, 30, 50]"
#: The rounds of raises as a recursion, a cell a step; moved says whether the round so far has raised any.
RAISES = {
    "prefix": "SELECT *, row_number() OVER (ORDER BY rank) AS i FROM (SELECT *, sum(dollar_cost) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) AS running FROM ranked) WHERE running <= 60",
    "lists": f"SELECT list(tier ORDER BY i) AS tiers, list(list_position({LEVEL}, payout) ORDER BY i) AS lv, count(*) AS n, 60.0::DOUBLE - sum(dollar_cost) AS rest FROM prefix",
    "raised": f"""SELECT 1::BIGINT AS step, lv, rest, false AS moved, tiers, n FROM lists WHERE n > 0
        UNION ALL SELECT step + 1, CASE WHEN ok THEN list_concat(list_concat(lv[1:pos - 1], [lv[pos] + 1]), lv[pos + 1:]) ELSE lv END, rest - CASE WHEN ok THEN more ELSE 0.0::DOUBLE END, CASE WHEN pos = 1 THEN ok ELSE moved OR ok END, tiers, n
        FROM (SELECT *, lv[pos] < 7 AND more > 0 AND more <= rest AS ok FROM (SELECT *, {COST.format(t="tiers[pos]", p=f"{LEVEL}[least(lv[pos] + 1, 7)]")} - {COST.format(t="tiers[pos]", p=f"{LEVEL}[lv[pos]]")} AS more
        FROM (SELECT *, (step - 1) % n + 1 AS pos FROM raised))) WHERE NOT (pos = 1 AND step > 1 AND NOT moved)""",
    "levels": "SELECT unnest(lv) AS l, generate_subscripts(lv, 1) AS i FROM (SELECT lv FROM raised ORDER BY step DESC LIMIT 1)",
}


@query(f"""SELECT station_id, hour_of_week, tier, origin_station_id, round(cost / payout / 0.2::DOUBLE, 9) AS induced_trips, payout, round(cost, 9) AS dollar_cost FROM (
    SELECT p.* EXCLUDE (payout), {LEVEL}[l] AS payout, {COST.format(t="tier", p=f"{LEVEL}[l]")} AS cost FROM prefix p JOIN levels v ON v.i = p.i)""", **RAISES)
def q_policy_full_budget(c: Chain) -> DataFrame:
    return rounded(policies.allocator_full_budget(c.ranked, c.params.allocation.budget, c.params.allocation))


# Simulation and comparison

#: A frozen log in place of a simulated week: every event a simulated trip whose fate its number decides.
LOG = {
    "sim": """SELECT ride_id, started_at, start_station_id, end_station_id, CASE WHEN ride_id::BIGINT % 10 < 7 THEN 'direct' WHEN ride_id::BIGINT % 10 < 9 THEN 'rerouted' ELSE 'lost' END AS outcome,
        CASE WHEN ride_id::BIGINT % 10 BETWEEN 7 AND 8 THEN (ride_id::BIGINT % 3 + 1)::INTEGER END AS hops, CASE WHEN ride_id::BIGINT % 10 BETWEEN 7 AND 8 THEN (ride_id::BIGINT % 900)::DOUBLE END AS distance_m,
        CASE WHEN ride_id::BIGINT % 4 = 0 THEN 'station_hour' WHEN ride_id::BIGINT % 4 = 1 THEN 'zone_hour' ELSE 'global' END AS tier FROM trips_raw""",
    "simcells": "SELECT station_id, interval_start, hour_of_week, zone_agg, least(capacity, inventory + station_id % 2) AS inventory, is_bike_empty AND station_id % 3 <> 0 AS is_bike_empty, departures AS direct_arrivals, 0 AS rerouted_arrivals, CASE WHEN is_bike_empty THEN 1 ELSE 0 END AS lost_no_bike, CASE WHEN is_dock_full THEN 1 ELSE 0 END AS lost_past_cap_arrivals FROM inv",
}


def _sim_log(c: Chain) -> DataFrame:
    i = F.col("ride_id").cast("bigint")
    moved = (i % 10 >= 7) & (i % 10 <= 8)
    return c.trips_raw.withColumns({
        "outcome": F.when(i % 10 < 7, "direct").when(i % 10 < 9, "rerouted").otherwise("lost"), "hops": F.when(moved, (i % 3 + 1).cast("int")),
        "distance_m": F.when(moved, (i % 900).cast("double")), "tier": F.when(i % 4 == 0, "station_hour").when(i % 4 == 1, "zone_hour").otherwise("global"),
    })


def _sim_cells(c: Chain) -> DataFrame:
    s = F.col("station_id")
    return c.inventory.select(
        "station_id", "interval_start", "hour_of_week", "zone_agg", F.least(F.col("capacity").cast("double"), F.col("inventory") + s % 2).alias("inventory"), (F.col("is_bike_empty") & (s % 3 != 0)).alias("is_bike_empty"),
        F.col("departures").alias("direct_arrivals"), F.lit(0).alias("rerouted_arrivals"), F.col("is_bike_empty").cast("int").alias("lost_no_bike"), F.col("is_dock_full").cast("int").alias("lost_past_cap_arrivals"),
    )


@query("SELECT simulated, actual, round(abs(simulated - actual)::DOUBLE / actual, 9) AS pct_error FROM (SELECT (SELECT count(*) FROM sim WHERE outcome <> 'lost') AS simulated, (SELECT count(*) FROM trips) AS actual)", **LOG)
def q_total_trips_error(c: Chain) -> DataFrame:
    return rounded(validate.total_trips_error(_sim_log(c), c.trips))


@query("""SELECT round(sum(abs(a.n - coalesce(s.n, 0)))::DOUBLE / sum(a.n), 9) AS zone_wmape FROM (SELECT zone_agg, count(*) AS n FROM trips t JOIN stations x ON t.start_station_id = x.station_id GROUP BY ALL) a
    LEFT JOIN (SELECT zone_agg, count(*) AS n FROM sim t JOIN stations x ON t.start_station_id = x.station_id WHERE outcome <> 'lost' GROUP BY ALL) s ON a.zone_agg = s.zone_agg""", **LOG)
def q_zone_wmape(c: Chain) -> DataFrame:
    return rounded(validate.per_zone_wmape(_sim_log(c), c.trips, c.stations.select("station_id", "zone_agg")))


@query("SELECT round(sum(abs(a.n - coalesce(s.n, 0)))::DOUBLE / sum(a.n), 9) AS hourly_wmape FROM (SELECT extract(hour FROM started_at) AS h, count(*) AS n FROM trips GROUP BY ALL) a LEFT JOIN (SELECT extract(hour FROM started_at) AS h, count(*) AS n FROM sim WHERE outcome <> 'lost' GROUP BY ALL) s ON a.h = s.h", **LOG)
def q_hourly_profile_wmape(c: Chain) -> DataFrame:
    return rounded(validate.hourly_profile_wmape(_sim_log(c), c.trips))


@query("SELECT tier, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS fraction FROM sim GROUP BY tier", **LOG)
def q_tier_usage(c: Chain) -> DataFrame:
    return rounded(validate.tier_usage(_sim_log(c)))


@query(f"SELECT outcome, count(*) AS n, {_r('avg(hops) AS mean_hops', 'avg(distance_m) AS mean_m', 'quantile_cont(distance_m, 0.9) AS p90_m', 'count(*)::DOUBLE / sum(count(*)) OVER () AS fraction')} FROM sim GROUP BY outcome", **LOG)
def q_reroute_breakdown(c: Chain) -> DataFrame:
    return rounded(validate.reroute_breakdown(_sim_log(c)))


@query("SELECT count(*) AS stations, round(corr(a.m, s.m), 9) AS corr FROM (SELECT station_id, 15 * count(*) FILTER (WHERE is_bike_empty) AS m FROM inv GROUP BY ALL) a JOIN (SELECT station_id, 15 * count(*) FILTER (WHERE is_bike_empty) AS m FROM simcells GROUP BY ALL) s ON a.station_id = s.station_id", **LOG)
def q_stockout_correlation(c: Chain) -> DataFrame:
    return rounded(validate.stockout_minutes_correlation(_sim_cells(c), c.inventory))


@query(f"SELECT count(*) AS n, {_r('corr(a.inventory, s.inventory) AS corr', 'avg(abs(a.inventory - s.inventory)) AS mean', 'quantile_cont(abs(a.inventory - s.inventory), 0.5) AS median', 'quantile_cont(abs(a.inventory - s.inventory), 0.9) AS p90', 'quantile_cont(abs(a.inventory - s.inventory), 0.99) AS p99', 'max(abs(a.inventory - s.inventory)) AS max')} FROM inv a JOIN simcells s ON a.station_id = s.station_id AND a.interval_start = s.interval_start", **LOG)
def q_inventory_diagnostics(c: Chain) -> DataFrame:
    return rounded(validate.inventory_diagnostics(_sim_cells(c), c.inventory))


@query(f"SELECT count(*) AS cells, {_r('corr(a.r, s.r) AS corr', 'avg(abs(a.r - s.r)) AS mean_diff', 'median(abs(a.r - s.r)) AS median_diff', 'sum(abs(a.r - s.r)) / sum(a.r) AS wmape')} FROM (SELECT station_id, hour_of_week, avg(is_bike_empty::INTEGER) AS r FROM inv GROUP BY ALL) a JOIN (SELECT station_id, hour_of_week, avg(is_bike_empty::INTEGER) AS r FROM simcells GROUP BY ALL) s ON a.station_id = s.station_id AND a.hour_of_week = s.hour_of_week", **LOG)
def q_stockout_rate_summary(c: Chain) -> DataFrame:
    return rounded(validate.stockout_rate_summary(validate.stockout_rates(_sim_cells(c), c.inventory)))


@query("""SELECT level, zone, fulfilled, lost, round(fulfilled::DOUBLE / nullif(fulfilled + lost, 0), 9) AS fill_rate FROM (
    SELECT 'system' AS level, NULL AS zone, sum(direct_arrivals + rerouted_arrivals)::BIGINT AS fulfilled, sum(lost_no_bike + lost_past_cap_arrivals)::BIGINT AS lost FROM simcells
    UNION ALL SELECT 'zone', zone_agg, sum(direct_arrivals + rerouted_arrivals)::BIGINT, sum(lost_no_bike + lost_past_cap_arrivals)::BIGINT FROM simcells WHERE zone_agg IS NOT NULL GROUP BY zone_agg)""", **LOG)
def q_fill_rate(c: Chain) -> DataFrame:
    return rounded(compare.fill_rates(_sim_cells(c)))


@query("SELECT fulfilled, lost, round(fulfilled::DOUBLE / nullif(fulfilled + lost, 0), 9) AS fill_rate FROM (SELECT sum(direct_arrivals + rerouted_arrivals)::BIGINT AS fulfilled, sum(lost_no_bike + lost_past_cap_arrivals)::BIGINT AS lost FROM simcells s WHERE EXISTS (SELECT 1 FROM topn t WHERE t.station_id = s.station_id AND t.hour_of_week = s.hour_of_week))", **LOG, **TOPN)
def q_treated_fill(c: Chain) -> DataFrame:
    return rounded(compare.treated_fill(_sim_cells(c), _top_n(c)))


#: Frozen results of 21 replicates of two policies beside doing nothing, from days and zones of the cells.
RESULTS = {
    "base0": "SELECT extract(day FROM interval_start)::INTEGER % 21 AS replicate, zone_agg, sum(direct_arrivals)::BIGINT AS f, sum(lost_no_bike + lost_past_cap_arrivals)::BIGINT AS l FROM simcells WHERE zone_agg IS NOT NULL GROUP BY ALL",
    "base1": "SELECT replicate, 'zone' AS level, zone_agg AS zone, f, l FROM base0 UNION ALL SELECT replicate, 'system', NULL, sum(f)::BIGINT, sum(l)::BIGINT FROM base0 GROUP BY replicate",
    "res0": """SELECT replicate, policy, level, zone, f + least(l, extra * (replicate % 4)) AS fulfilled, l - least(l, extra * (replicate % 4)) AS lost, cost FROM base1, (VALUES ('do_nothing', 0, 0.0::DOUBLE), ('a', 1, 50.0::DOUBLE), ('b', 2, 80.0::DOUBLE)) p(policy, extra, cost)""",
    "results": "SELECT *, fulfilled::DOUBLE / nullif(fulfilled + lost, 0) AS fill_rate FROM res0",
    "paired": "SELECT r.*, (r.fill_rate - b.fill_rate) * 100 AS lift, r.fulfilled - b.fulfilled AS recovered FROM results r JOIN results b ON r.replicate = b.replicate AND r.level = b.level AND r.zone IS NOT DISTINCT FROM b.zone AND b.policy = 'do_nothing' WHERE r.policy <> 'do_nothing'",
    "ptab": "SELECT policy, level, zone, count(*) AS replicates, " + ", ".join(
        f"round(quantile_cont({x}, {q}), 9) + 0.0::DOUBLE AS {n}_{s}" for x, n in (("fill_rate", "fill"), ("lift", "lift_pp"), ("recovered", "recovered"), ("CASE WHEN recovered > 0 THEN cost / recovered END", "cost_per_trip")) for q, s in ((0.5, "median"), (0.05, "p5"), (0.95, "p95"))
    ) + ", round(avg(CASE WHEN recovered > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 9) AS undefined_share, round(avg(CASE WHEN lift > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS p_lift FROM paired GROUP BY policy, level, zone",
}


def _results(c: Chain) -> DataFrame:
    cells = _sim_cells(c).withColumn("replicate", F.dayofmonth("interval_start") % 21)
    base = compare.fill_rates(cells.filter("zone_agg is not null"), ["replicate"]).select("replicate", "level", "zone", F.col("fulfilled").alias("f"), F.col("lost").alias("l"))
    kinds = c.spark.sql("SELECT * FROM VALUES ('do_nothing', 0, cast(0 as double)), ('a', 1, cast(50 as double)), ('b', 2, cast(80 as double)) AS t(policy, extra, dollar_cost)")
    won = F.least(F.col("l"), F.col("extra") * (F.col("replicate") % 4))
    rows = base.crossJoin(F.broadcast(kinds)).withColumns({"fulfilled": F.col("f") + won, "lost": F.col("l") - won})
    return rows.withColumn("fill_rate", F.try_divide("fulfilled", F.col("fulfilled") + F.col("lost"))).drop("f", "l", "extra")


@query("SELECT * FROM ptab", **LOG, **RESULTS)
def q_bootstrap_ci(c: Chain) -> DataFrame:
    return rounded(compare.policy_comparison(_results(c)))


@query("SELECT level, count(*) AS policies, count(*) FILTER (WHERE lift_pp_p5 > 0 OR lift_pp_p95 < 0) AS significant FROM ptab GROUP BY level", **LOG, **RESULTS)
def q_significant_lift(c: Chain) -> DataFrame:
    return compare.significant_lift(rounded(compare.policy_comparison(_results(c))))


@query("SELECT count(*) AS zone_rows, round(avg((fill_rate IS NULL)::INTEGER), 9) AS undefined_share FROM results WHERE level = 'zone'", **LOG, **RESULTS)
def q_zone_activity(c: Chain) -> DataFrame:
    return rounded(compare.zone_activity(_results(c)))


@query("SELECT policy, round(quantile_cont(lift, 0.5), 9) + 0.0::DOUBLE AS lift_pp_median, round(quantile_cont(lift, 0.05), 9) + 0.0::DOUBLE AS lift_pp_p5, round(quantile_cont(lift, 0.95), 9) + 0.0::DOUBLE AS lift_pp_p95, 10::INTEGER AS budget FROM paired WHERE level = 'system' GROUP BY policy", **LOG, **RESULTS)
def q_lift_vs_budget(c: Chain) -> DataFrame:
    return rounded(compare.lift_vs_budget(_results(c).withColumn("budget", F.lit(10))))


@query("""SELECT policy, round(quantile_cont(lift, 0.5), 9) + 0.0::DOUBLE AS lift_pp_median, round(quantile_cont(lift, 0.05), 9) + 0.0::DOUBLE AS lift_pp_p5, round(quantile_cont(lift, 0.95), 9) + 0.0::DOUBLE AS lift_pp_p95,
    quantile_cont(recovered, 0.5)::DOUBLE AS recovered_median, quantile_cont(recovered, 0.05)::DOUBLE AS recovered_p5, quantile_cont(recovered, 0.95)::DOUBLE AS recovered_p95, round(avg(CASE WHEN lift > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS p_lift
    FROM paired WHERE level = 'system' GROUP BY policy""", **LOG, **RESULTS)
def q_treated_ci(c: Chain) -> DataFrame:
    r = _results(c).filter("level = 'system'")
    base = r.filter("policy = 'do_nothing'").select("replicate", F.col("fulfilled").alias("base_fulfilled"), F.col("lost").alias("base_lost"))
    return rounded(compare.treated_comparison(r.filter("policy != 'do_nothing'").join(base, "replicate")))


@query("SELECT interval_start::DATE AS day, round(sum(departures) / sum(dep_d), 9) AS ratio FROM unmet WHERE NOT is_bike_empty AND interval_start >= TIMESTAMP '2024-01-22' GROUP BY ALL")
def q_residual_ratios(c: Chain) -> DataFrame:
    return rounded(compare.residual_ratios(c.held_out.filter(~F.col("is_bike_empty")), "departures", "dep_D_hat"))


def _system(c: Chain, count: int) -> DataFrame:
    sums, funded = replicates.simulated(c, count, (c.params.allocation.budget,))
    return replicates.system_results(sums, funded)


@query()
def q_sim_week(c: Chain) -> DataFrame:
    """A whole week of all six policies, two replicates, with each replicate's own elasticity and demand."""
    return rounded(_system(c, 2))


@query()
def q_sim_policy_comparison(c: Chain) -> DataFrame:
    """Intervals over four replicates of real simulator output."""
    return rounded(compare.policy_comparison(_system(c, 4)))


@query()
def q_sim_treated(c: Chain) -> DataFrame:
    """The cells that each policy funds, against the same cells under doing nothing."""
    return rounded(replicates.treated_results(*replicates.simulated(c, 2, (c.params.allocation.budget,))))


@query()
def q_sim_budget_sweep(c: Chain) -> DataFrame:
    """Lift of three policies at ten budgets."""
    budgets = tuple(c.params.allocation.budget * i / 5 for i in range(1, 11))
    sums, funded = replicates.simulated(c, 1, budgets, ("top_n_stockout", "allocator", "allocator_full_budget"))
    return rounded(compare.lift_vs_budget(replicates.system_results(sums, funded)))


@query()
def q_sim_week_trend(c: Chain) -> DataFrame:
    """Stockout rates pooled over one, two and three simulated weeks, against the real ones."""
    return rounded(validate.pooled_trend(replicates.weekly_stockouts(c, 3), (1, 2, 3)))


@query()
def q_sim_modes(c: Chain) -> DataFrame:
    """Trips and losses of the week in the three modes: drawn, real counts, real trips."""
    cells = _modes(c)
    total = [F.sum(x).alias(x) for x in (*simulate.COUNTS, "created", "destroyed")]
    return rounded(cells.groupBy("mode").agg(F.sum("departures_actual").alias("trips"), *total))


def _modes(c: Chain, modes: tuple[str, ...] = simulate.MODES) -> DataFrame:
    p = c.params.simulation
    network = replicates.network_of(c)
    real = c.once("real trips", lambda: simulate.true_trips(c.trips, network, p.week_start, p.steps))
    return simulate.run_modes(c.spark, network, replicates.sampler_of(c), real, p.seed, "bigint", p, modes)


#: The replay of the week's real trips as a recursion over events: departures of a step, its arrivals, and what is added and removed at its end.
REPLAY = {
    "rp_net": """SELECT s.station_id, row_number() OVER (ORDER BY s.station_id) AS i, s.capacity::DOUBLE AS cap, coalesce(v.inventory, 0.5::DOUBLE * s.capacity) AS begin FROM stations s
        LEFT JOIN (SELECT station_id, inventory FROM inv WHERE interval_start = TIMESTAMP '2024-01-08') v ON v.station_id = s.station_id WHERE s.station_id IN (SELECT station_id FROM inv)""",
    "rp_near": """SELECT a.i, list(b.i ORDER BY n.hop) AS to_ FROM (SELECT station_id, neighbor_id, row_number() OVER (PARTITION BY station_id ORDER BY distance_m, neighbor_id) AS hop FROM dist WHERE distance_m <= 1000) n
        JOIN rp_net a ON a.station_id = n.station_id JOIN rp_net b ON b.station_id = n.neighbor_id WHERE n.hop <= 3 GROUP BY a.i""",
    "rp_trips": """SELECT step, a, b, row_number() OVER (ORDER BY step, a, b) AS t FROM (SELECT date_diff('second', TIMESTAMP '2024-01-08', t.started_at) // 900 AS step, a.i AS a, b.i AS b FROM trips t
        JOIN rp_net a ON a.station_id = t.start_station_id JOIN rp_net b ON b.station_id = t.end_station_id WHERE t.started_at >= TIMESTAMP '2024-01-08' AND t.started_at < TIMESTAMP '2024-01-15')""",
    "rp_moved": """SELECT date_diff('second', TIMESTAMP '2024-01-08', v.interval_start) // 900 AS step, map(list(n.i), list(v.nontrip_in - v.nontrip_out)) AS delta FROM inv v JOIN rp_net n ON n.station_id = v.station_id
        WHERE v.interval_start >= TIMESTAMP '2024-01-08' AND v.interval_start < TIMESTAMP '2024-01-15' AND (v.nontrip_in > 0 OR v.nontrip_out > 0) GROUP BY 1""",
    "rp_events": """MATERIALIZED SELECT e.*, row_number() OVER (ORDER BY step, kind, x, y, t) AS n FROM (SELECT step, 0 AS kind, a AS x, b AS y, t, a, b, NULL::BIGINT[] AS to_, NULL AS delta FROM rp_trips
        UNION ALL SELECT step, 1, b, a, t, a, b, list_concat([b], coalesce(to_, [])), NULL FROM rp_trips LEFT JOIN rp_near ON i = b UNION ALL SELECT step, 2, 0, 0, 0, 0, 0, NULL, delta FROM rp_moved) e""",
    "rp_caps": "MATERIALIZED SELECT list(cap ORDER BY i) AS caps, list(begin ORDER BY i) AS begin FROM rp_net",
    "rp_run": """SELECT 0::BIGINT AS n, begin AS lvl, [0]::BIGINT[] AS served, NULL::BIGINT AS hit FROM rp_caps UNION ALL
        SELECT r.n + 1, CASE WHEN r.kind = 0 THEN list_transform(lvl, lambda v, i: CASE WHEN i = a AND hit IS NOT NULL THEN v - 1 ELSE v END) WHEN r.kind = 1 THEN list_transform(lvl, lambda v, i: CASE WHEN i = hit THEN v + 1 ELSE v END)
            ELSE list_transform(lvl, lambda v, i: greatest(0.0::DOUBLE, least(caps[i], v + coalesce(delta[i], 0.0::DOUBLE)))) END, CASE WHEN r.kind = 0 AND hit IS NOT NULL THEN list_append(served, t) ELSE served END, hit
        FROM (SELECT p.n, p.lvl, CASE WHEN e.kind = 0 AND NOT list_contains(p.served, -e.step) THEN [-e.step] ELSE p.served END AS served, e.kind, e.a, e.t, e.delta, c.caps,
            CASE WHEN e.kind = 0 THEN CASE WHEN p.lvl[e.a] >= 1 - 1e-9 THEN e.a END WHEN e.kind = 1 AND list_contains(p.served, e.t) THEN coalesce(list_filter(e.to_, lambda x: c.caps[x] - p.lvl[x] >= 1 - 1e-9)[1], -1) END AS hit
            FROM rp_run p JOIN rp_events e ON e.n = p.n + 1, rp_caps c) r""",
    "rp_log": "MATERIALIZED SELECT e.kind, e.a, e.b, r.hit, e.delta, p.lvl AS before FROM rp_run r JOIN rp_events e ON e.n = r.n LEFT JOIN (SELECT n + 1 AS n, lvl FROM rp_run) p ON p.n = r.n AND e.kind = 2",
}


@query("""SELECT n.station_id, coalesce(d.sampled, 0) AS departures_sampled, coalesce(d.gone, 0) AS departures_actual, coalesce(d.sampled - d.gone, 0) AS lost_no_bike, coalesce(h.direct, 0) AS direct_arrivals, coalesce(h.rerouted, 0) AS rerouted_arrivals,
    coalesce(l.lost, 0) AS lost_past_cap_arrivals, round(coalesce(m.created, 0.0::DOUBLE), 6) AS created, round(coalesce(m.destroyed, 0.0::DOUBLE), 6) AS destroyed FROM rp_net n
    LEFT JOIN (SELECT a, count(*) AS sampled, count(hit) AS gone FROM rp_log WHERE kind = 0 GROUP BY a) d ON d.a = n.i
    LEFT JOIN (SELECT hit, count(*) FILTER (WHERE hit = b) AS direct, count(*) FILTER (WHERE hit <> b) AS rerouted FROM rp_log WHERE kind = 1 AND hit > 0 GROUP BY hit) h ON h.hit = n.i
    LEFT JOIN (SELECT b, count(*) AS lost FROM rp_log WHERE kind = 1 AND hit = -1 GROUP BY b) l ON l.b = n.i
    LEFT JOIN (SELECT i, sum(greatest(0.0::DOUBLE, -raw)) AS created, sum(greatest(0.0::DOUBLE, raw - cap)) AS destroyed FROM (SELECT x.i, x.cap, before[x.i] + coalesce(delta[x.i], 0.0::DOUBLE) AS raw FROM rp_log, rp_net x WHERE kind = 2) GROUP BY i) m ON m.i = n.i""", **REPLAY)
def q_sim_replay(c: Chain) -> DataFrame:
    """The mode sanity_true_dest by station: real trips, replayed by the simulator in a task and by a recursive query in SQL."""
    cells = _modes(c, ("sanity_true_dest",))
    return rounded(cells.groupBy("station_id").agg(*[F.sum(x).alias(x) for x in (*simulate.COUNTS, "created", "destroyed")]), 6)


# Streaming


@query("SELECT user_id AS station_id, time_bucket(INTERVAL 15 MINUTES, ts) AS interval_start, count(*) AS departures FROM events GROUP BY ALL")
def q_stream_tumbling(c: Chain) -> DataFrame:
    """A run of the stream over all that is there, in complete mode, so that the last intervals are closed too."""
    stream = tumbling.event_departures(c.spark, c.sf_dir)
    counts = stream.groupBy(F.window("started_at", "15 minutes").alias("w"), F.col("start_station_id").alias("station_id")).agg(F.count("*").alias("departures"))
    folder = f"{checkpoint_dir(c.spark)}/stream-{uuid.uuid4().hex}"
    out = tumbling.run_complete(counts, f"{folder}/out", f"{folder}/checkpoint")
    return out.select("station_id", F.col("w.start").cast("timestamp_ntz").alias("interval_start"), "departures")
