import itertools

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fleetlens.functions import columns as C
from fleetlens.operators import boosting, censoring, demand, features, heatmap, inventory, panel, substitution, zones


def make(spark, schema, *rows):
    df = spark.createDataFrame(list(rows), schema)
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in ("interval_start", "started_at", "ended_at", "week_start", "timestamp") else F.col(c) for c in df.columns])


TRIPS = "start_station_id string, started_at string, end_station_id string, ended_at string"


@pytest.fixture(scope="module")
def week(spark):
    t = make(
        spark, TRIPS, ("A", "2025-01-06 08:01:00", "B", "2025-01-06 08:20:00"), ("A", "2025-01-06 08:14:59", "A", "2025-01-06 08:14:59"), ("A", "2025-01-06 08:15:00", "B", "2025-01-06 08:40:00"),
        ("B", "2025-01-12 23:40:00", "A", "2025-01-12 23:50:00"),
    )
    s = spark.createDataFrame([("A", 40.7, -74.0, 25, "z0"), ("X", 40.7, -74.0, 30, "z0")], "station_id string, lat double, lng double, capacity int, zone_agg string")
    w = make(spark, "timestamp string, temp_c double, precip_mm double, wind_kph double, humidity_pct double", ("2025-01-06 08:00:00", 5.0, 0.5, 1.0, 2.0))
    return t, s, w


def test_panel_by_hand(spark, week):
    t, s, w = week
    p = panel.build_panel(t, s, w, panel.us_federal_holidays(spark, "2025-01-01", "2025-12-31"))
    rows = {(r.station_id, str(r.interval_start)): r for r in p.collect()}
    first = rows["A", "2025-01-06 08:00:00"]
    assert (first.departures, first.arrivals, first.hour_of_week, first.temp_c, first.capacity, first.is_holiday) == (2, 1, 8, 5.0, 25, False)
    assert rows["A", "2025-01-06 08:15:00"].departures == 1
    assert rows["B", "2025-01-06 08:15:00"].capacity is None  # kept without a match
    assert sum(r.departures for r in rows.values()) == sum(r.arrivals for r in rows.values()) == 4
    n = [k for k in rows if k[0] == "A"]
    assert len(n) == 6 * 96 + 63 + 1 and rows["A", "2025-01-12 23:45:00"].arrivals == 1
    checks = panel.panel_checks(p, t).first()
    assert checks.stations_with_gaps == 0 and checks.trips == 4
    assert panel.capacity_coverage(p).first().null_stations == 1
    r = panel.reconcile_capacity(panel.station_activity(t), s).first()
    assert (r.stations, r.unmatched_stations, r.unmatched_volume, r.warn) == (2, 1, 3, True)


def test_calendar_values(spark):
    df = make(spark, "interval_start string", ("2025-01-01 00:00:00",), ("2025-01-05 23:45:00",), ("2025-07-04 12:00:00",))
    got = panel.add_calendar(df, panel.us_federal_holidays(spark, "2025-01-01", "2025-12-31")).orderBy("interval_start").collect()
    assert [(r.hour_of_week, r.dow, r.is_holiday) for r in got] == [(48, 2, True), (167, 6, False), (4 * 24 + 12, 4, True)]


def test_columns(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("x")).first().x
    assert v(C.hour_label(F.lit(8))) == "Mon 08:00" and v(C.hour_label(F.lit(167))) == "Sun 23:00"
    assert [v(C.daypart(F.lit(h))) for h in (0, 7, 16, 23, 120, 143)] == [0, 1, 3, 5, 6, 11]
    assert [v(C.upper_bucket(F.lit(n), [1, 4])) for n in (1, 2, 4, 5)] == [0, 1, 1, 2]
    assert v(C.mm1k_p0(F.lit(1.0), F.lit(1.0), F.lit(4))) == 0.2 and v(C.mm1k_p0(F.lit(1.0), F.lit(2.0), F.lit(0))) == 1
    assert abs(v(C.mm1k_p0(F.lit(1.0), F.lit(2.0), F.lit(2))) - 0.5 / (1 - 0.125)) < 1e-12
    assert v(C.relaxation_minutes(F.lit(2.0), F.lit(1.0))) is None and v(C.relaxation_minutes(F.lit(1.0), F.lit(4.0))) == 15
    assert v(C.induced_trips(F.lit(10.0), F.lit(2.0), F.lit(0.15))) == pytest.approx(2 * (1 - np.exp(-1.5)))
    east, north = C.utm_metres(F.lit(40.7128), F.lit(-74.0060))
    assert abs(v(east) - 583959.96) < 2 and abs(v(north) - 4507350.99) < 2


def least_cost(flow, cap, prior):
    """Least movement by dynamic programming over half bikes, and the end levels that reach it."""
    grid = np.arange(0, cap + 0.5, 0.5)
    cost = np.where(grid == prior, 0.0, 2 * np.abs(grid - prior))
    for f in flow:
        cost = np.array([min(c + abs(x - (g + f)) for c, g in zip(cost, grid, strict=True)) for x in grid])
    return cost.min(), grid[np.isclose(cost, cost.min())]


def walk(flow, capacity, prior):
    """The reflected walk step by step: levels before and after each flow (n + 1), added, removed."""
    level, added, removed = [float(prior)], [], []
    for f in flow:
        raw = level[-1] + f
        level.append(min(float(capacity), max(0.0, raw)))
        added.append(max(0.0, -raw))
        removed.append(max(0.0, raw - capacity))
    return np.array(level), np.array(added), np.array(removed)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-4, 4), min_size=1, max_size=7), st.integers(1, 6), st.integers(0, 12))
def test_walk_is_a_least_movement_plan(flow, cap, half):
    prior = min(half / 2, cap)
    level, added, removed = walk(flow, cap, prior)
    best, ends = least_cost(flow, cap, prior)
    assert added.sum() + removed.sum() == pytest.approx(best) and list(ends) == [level[-1]]
    assert level.min() >= 0 and level.max() <= cap


def test_walk_cases():
    assert not any(x.any() for x in walk([1, -1, 2, -2, 0, 1, -1.0], 20, 10)[1:])
    level, added, _ = walk([-8, 0, 0.0], 20, 5)
    assert added[0] == 3 and level[1] == 0
    level, _, removed = walk([5, 0.0], 10, 8)
    assert removed[0] == 3 and level[1] == 10


def test_scan_of_clamps_equals_the_walk(spark):
    """Several stations, days without a flow, capacities of 0 and half levels at the start; no Python in the plan."""
    rng, rows = np.random.default_rng(2), []
    for s in range(8):
        cap, flow = int(rng.integers(0, 9)) if s else 0, rng.integers(-5, 6, 700)
        flow[rng.uniform(size=700) < 0.5] = 0
        flow[96 * 2 : 96 * 4] = 0
        rows += [(s, i, cap, int(f)) for i, f in enumerate(flow)]
    at = F.timestamp_add("MINUTE", F.col("i") * 15, F.lit("2025-01-06 07:00:00").cast("timestamp_ntz"))
    usable = spark.createDataFrame(rows, "station_id int, i int, capacity int, net_flow int").withColumn("interval_start", at)
    scan = inventory.sparse_walk(usable)
    assert "Python" not in scan._jdf.queryExecution().toString() and "Pandas" not in scan._jdf.queryExecution().toString()
    got = scan.join(usable.select("station_id", "interval_start", "i"), ["station_id", "interval_start"]).toPandas().sort_values("i")
    for s, own in got.groupby("station_id"):
        flow, cap = [f for t, _, _, f in rows if t == s and f], next(c for t, _, c, _ in rows if t == s)
        level, added, removed = walk(flow, cap, 0.5 * cap)
        assert np.array_equal(own["level_before"], level[:-1]) and np.array_equal(own["level_after"], level[1:])
        assert np.array_equal(own["n_in"], added) and np.array_equal(own["n_out"], removed)
    assert got["station_id"].nunique() == 8 and inventory.sparse_walk(usable.filter("i < 0")).count() == 0


def test_inventory_table(spark):
    schema = "station_id string, interval_start string, departures bigint, arrivals bigint, capacity int, zone_agg string, hour_of_week int"
    rows = [("A", f"2025-01-06 0{h}:00:00", d, a, 4, "z", h) for h, (d, a) in enumerate([(3, 0), (0, 0), (0, 6), (0, 0)])]
    rows += [("Z", "2025-01-06 00:00:00", 1, 0, 0, "z", 0), ("N", "2025-01-06 00:00:00", 1, 0, None, "z", 0)]
    p = make(spark, schema, *rows)
    assert {r.reason: r.stations for r in inventory.dropped_stations(p).collect()} == {"kept": 1, "zero_capacity_active": 1, "no_capacity": 1}
    got = inventory.reconstruct_inventory(inventory.usable_panel(p)).orderBy("interval_start").collect()
    assert [r.inventory for r in got] == [2, 0, 0, 4] and [r.is_bike_empty for r in got] == [False, True, True, False]
    assert [r.inferred_nontrip_in for r in got] == [1, 0, 0, 0] and [r.inferred_nontrip_out for r in got] == [0, 0, 2, 0] and got[3].is_dock_full and got[3].minutes_full == 15
    inv = inventory.reconstruct_inventory(inventory.usable_panel(p))
    assert inventory.bounds_check(inv).first().violations == 0
    reported = spark.sql("SELECT date '2025-01-01' AS month_start, 3L AS rebalanced_bikes_total")
    assert inventory.monthly_cross_check(inv, reported).first().ratio == 1


def test_run_length_does_not_bridge_stations(spark):
    flags = [("A", 0, True), ("A", 1, True), ("A", 2, False), ("A", 3, True), ("B", 0, True), ("B", 1, True), ("B", 2, True)]
    df = spark.createDataFrame(flags, "station_id string, interval_start int, f boolean")
    got = {(r.station_id, r.interval_start): r.n for r in features.add_run_length(df, "f", "n").collect()}
    assert [got["A", i] for i in range(4)] == [2, 2, 0, 1] and [got["B", i] for i in range(3)] == [3, 3, 3]


def test_lags_and_neighbors(spark):
    rows = [("A", i, i + 1, "z") for i in range(6)] + [("B", i, 10, "z") for i in range(6)] + [("N", 0, 7, None), ("M", 0, 7, None)]
    df = spark.createDataFrame(rows, "station_id string, interval_start int, d int, zone_agg string")
    got = {(r.station_id, r.interval_start): r for r in features.add_neighbor_demand(features.add_own_lags(df, "d", "dep", week_rows=2), "d", "dep").collect()}
    assert got["A", 0].dep_own_lag_1h is None and got["A", 5].dep_own_lag_1h == (2 + 3 + 4 + 5) / 4 and got["A", 5].dep_own_lag_1week == 4
    assert got["A", 2].dep_neighbor_demand == 10 and got["N", 0].dep_neighbor_demand is None


def test_staleness_and_encoding(spark):
    df = spark.createDataFrame([("A", 3, 2, 2), ("A", 3, 0, 0), ("B", 5, 1, 1)], "station_id string, capacity int, departures int, arrivals int")
    assert {r.station_id: r.is_capacity_stale for r in features.capacity_staleness(df).collect()} == {"A": True, "B": False}
    enc = features.target_encoding(df, "station_id", "departures")
    out = features.apply_target_encoding(spark.createDataFrame([("A",), ("C",)], "station_id string"), enc, "station_id", df.agg(F.avg("departures").alias("m")), "e")
    assert {r.station_id: r.e for r in out.collect()} == {"A": 1.0, "C": 1.0}


def test_impute_and_bias(spark):
    df = spark.createDataFrame([(1, True, 2, 5.0), (1, False, 0, 5.0), (9, True, 2, 5.0)], "departures int, is_bike_empty boolean, bike_empty_run_len int, dep_D_hat double")
    assert [r.dep_gross_unmet for r in demand.impute_unmet(df, "dep").collect()] == [4.0, 0.0, 0.0]
    recovery = spark.createDataFrame([("bucket", 1, 1.5, 30), ("bucket", 0, -2.5, 5), ("overall", None, 9.0, 99)], "stratum string, run_length_bucket int, bias double, n int")
    bias = demand.bucket_bias(recovery)
    assert bias.count() == 1
    assert [r.dep_gross_unmet for r in demand.impute_unmet(df, "dep", bias).collect()] == [2.5, 0.0, 0.0]


def test_rates_of_one_pass_equal_those_of_each_direction(spark):
    rows = [("A", 0, "z", 1, False), ("A", 0, "z", 3, False), ("A", 1, "z", 9, True), ("B", 1, "z", 4, False), ("C", 5, None, 2, True)]
    df = spark.createDataFrame(rows, "station_id string, hour_of_week int, zone_agg string, departures int, is_bike_empty boolean").withColumns({"arrivals": F.lit(2), "is_dock_full": F.col("station_id") == "B"})
    a = sorted((r.station_id, r.hour_of_week, r.dep_D_hat) for r in demand.add_rates(df, "dep").collect())
    both = demand.add_all_rates(df)
    assert a == sorted((r.station_id, r.hour_of_week, r.dep_D_hat) for r in both.collect()) and ("A", 1, 4.0) in a and ("C", 5, 8 / 3) in a
    assert {r.arr_D_hat for r in both.collect()} == {2.0} and set(both.columns) == {*df.columns, "dep_D_hat", "arr_D_hat"}


def test_matched_calibration(spark):
    rows = [(s, i, i % 168, 10, i % 4, i % 2 == 0 and s == 0, 1.5) for s in range(3) for i in range(300)]
    df = spark.createDataFrame(rows, "station_id bigint, i int, hour_of_week int, capacity int, departures int, is_bike_empty boolean, dep_D_hat double")
    df = df.withColumns({"interval_start": F.timestamp_add("MINUTE", F.col("i") * 15, F.lit("2025-01-06 00:00:00").cast("timestamp_ntz")), "arrivals": F.lit(0)})
    recovery, coverage = demand.calibrate_matched(df, "dep", 300, (1, 2))
    got = {(r.stratum, r.run_length_bucket): r for r in recovery.collect()}
    taken = coverage.agg(F.sum(F.col("taken") * F.col("length"))).first()[0]
    assert got["overall", None].n == taken > 0 and got["bucket", 0].n < got["bucket", 1].n
    starts = coverage.filter("taken > 0").select(F.element_at(F.split("stratum", "_"), 3).cast("int").alias("h")).distinct()
    assert starts.filter("h % 2 = 1").count() == 0  # only the hours in which stations ran empty


def test_substitution_cases(spark):
    schema = "station_id string, interval_start int, departures int, arrivals int, dep_D_hat double, arr_D_hat double, is_bike_empty boolean, is_dock_full boolean, dep_gross_unmet double, arr_gross_unmet double"
    pairs = spark.createDataFrame([("A", "B"), ("B", "A"), ("C", "B"), ("B", "C")], "station_id string, neighbor_id string")
    row = lambda s, i, dep, hat, empty, gross: (s, i, dep, 0, hat, 0.0, empty, False, gross, 0.0)
    df = spark.createDataFrame([
        row("A", 0, 0, 5.0, True, 5.0), row("B", 0, 12, 2.0, False, 0.0),  # fully displaced
        row("A", 1, 0, 6.0, True, 6.0), row("C", 1, 0, 3.0, True, 3.0), row("B", 1, 5, 2.0, False, 0.0),  # competing for 3
        row("A", 2, 0, 6.0, True, 6.0), row("B", 2, 9, 2.0, True, 0.0),  # censored neighbour
    ], schema)
    net = {(r.station_id, r.interval_start): r for r in substitution.add_substitution(df, pairs).collect()}
    assert (net["A", 0].dep_displaced, net["A", 0].dep_net_lost) == (5, 0)
    assert (net["A", 1].dep_displaced, net["C", 1].dep_displaced) == (2, 1) and net["A", 1].dep_net_lost == 4
    assert net["A", 2].dep_displaced == 0 and net["A", 2].dep_net_lost == 6 and net["B", 0].dep_displaced == 0
    s = {r.direction: r for r in substitution.summarize_displaced(substitution.add_substitution(df, pairs)).collect()}
    assert s["dep"].gross == 20 and s["dep"].displaced == 8 and s["arr"].displaced_fraction is None


def test_radius_pairs_and_zones(spark):
    s = spark.createDataFrame([("A", 40.7300, -73.99, "z"), ("B", 40.7313, -73.99, "z"), ("C", 40.7750, -73.99, "y")], "station_id string, lat double, lng double, zone_agg string")
    got = {(r.station_id, r.neighbor_id): r.distance_m for r in zones.radius_pairs(s, 400).collect()}
    assert set(got) == {("A", "B"), ("B", "A")} and abs(got["A", "B"] - 144.6) < 0.1
    d = {r.zone_agg: (r.stations, round(r.diameter_m, 1)) for r in zones.zone_diameters(s).collect()}
    assert d == {"z": (2, 144.6), "y": (1, 0.0)}
    z = {r.station_id: r.zone_link for r in zones.linkage_zones(s).collect()}
    assert z["A"] == z["B"] != z["C"]
    h = {r.station_id: r.zone_hex for r in zones.hex_zones(s).collect()}
    assert h["A"] != h["C"]


def test_h3_cells(spark):
    """Published ids of known points; neighbours share a cell, far points don't; each child lies under its parent; no id beyond the listed base cells."""
    rows = [("square", 40.735863, -73.991084), ("near", 40.735863 + 50 / 111_000, -73.991084), ("far", 40.735863 + 5_000 / 111_000, -73.991084), ("statue", 40.689167, -74.044444), ("paris", 48.86, 2.35), ("pole", -89.0, 10.0), ("nowhere", None, -74.0)]
    s = spark.createDataFrame(rows, "station_id string, lat double, lng double")
    at = {k: {r.station_id: r.zone_h3 for r in zones.h3_zones(s, k).collect()} for k in (7, 8, 10)}
    assert at[8]["square"] == at[8]["near"] == "882a100d27fffff" != at[8]["far"] and at[10]["statue"] == "8a2a1072b59ffff" and at[8]["statue"] == "882a1072b5fffff"
    assert int(at[7]["square"][2:8], 16) == int(at[8]["square"][2:8], 16) and at[7]["square"].endswith("2ffffff")
    assert at[8]["paris"] is at[8]["pole"] is at[8]["nowhere"] is None
    grid = spark.range(4000).selectExpr("id AS station_id", "36 + (id % 64) * 0.15 AS lat", "-92 + (id div 64) * 0.3 AS lng")
    both = zones.h3_zones(grid, 9).withColumnRenamed("zone_h3", "child").join(zones.h3_zones(grid, 8), "station_id").filter("child IS NOT NULL AND zone_h3 IS NOT NULL").collect()
    digits = lambda cell, n: (int(cell, 16) >> 3 * (15 - n)) & ((1 << 45 - 3 * (15 - n)) - 1)
    assert len(both) > 3000 and len({r.zone_h3 for r in both}) > 3000
    assert sum(digits(r.child, 7) == digits(r.zone_h3, 7) for r in both) > 0.85 * len(both)  # sevenths do not tile their parent exactly
    with pytest.raises(ValueError):
        zones.h3_zones(s, 0)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=12, unique=True))
def test_complete_linkage_keeps_its_cut(points):
    x, y = np.array([p[0] for p in points], float), np.array([p[1] for p in points], float)
    root = zones.complete_linkage(x, y, 10.0)
    for c in set(root):
        own = np.flatnonzero(root == c)
        assert max([0.0, *(np.hypot(x[i] - x[j], y[i] - y[j]) for i, j in itertools.combinations(own, 2))]) <= 10
    for a, b in itertools.combinations(set(root), 2):  # no two clusters could still be merged
        i, j = np.flatnonzero(root == a), np.flatnonzero(root == b)
        assert max(np.hypot(x[p] - x[q], y[p] - y[q]) for p in i for q in j) > 10


def test_per_dock_bounds(spark):
    mondays = ["2025-01-06", "2025-01-13", "2025-01-20", "2025-01-27"]
    rows = [("z0", 8, f"{d} 08:00:00", 5.0, 0.0) for d in mondays] + [("z1", 8, f"{d} 08:00:00", x, 0.0) for d, x in zip(mondays, [0.0, 0.0, 0.0, 20.0], strict=True)] + [("z2", 8, "2025-01-06 08:00:00", 1.0, 0.0)]
    net = make(spark, "zone_agg string, hour_of_week int, interval_start string, dep_net_lost double, arr_net_lost double", *rows)
    cap = spark.createDataFrame([("z0", 10), ("z1", 10), ("z2", 0)], "zone_agg string, zone_capacity int")
    ci = heatmap.per_dock_ci(net, cap)
    got = {r.zone_agg: r for r in ci.collect()}
    assert got["z0"].dep_mean == got["z1"].dep_mean == 0.5 and got["z0"].dep_lower == 0.5
    assert got["z1"].dep_lower == pytest.approx(-0.48, abs=1e-9) and got["z2"].dep_lower is None
    assert [r.zone_agg for r in heatmap.top_zones_by_lower(ci).collect()][0] == "z0"
    zh = heatmap.zone_hour_net_lost(net)
    assert heatmap.n_weeks_covered(net).first().n_weeks == 3
    assert {r.zone_agg: r.dep_net_lost for r in zh.collect()}["z1"] == pytest.approx(20 / 3)
    assert {r.zone_agg: r.label for r in heatmap.peak_hours(zh, "dep_net_lost").collect()}["z0"] == "Mon 08:00"
    m = heatmap.matrix(zh, "dep_net_lost")
    assert len(m.columns) == 169 and m.filter("zone_agg = 'z0'").first().h9 == 0
    s = spark.createDataFrame([("a", "z0", -74.05, 40.70), ("b", "z1", -73.9, 40.7)], "station_id string, zone_agg string, lng double, lat double")
    assert heatmap.exclude_boxed(zh, s).count() == 2


def test_synthetic_runs_and_recovery(spark):
    free = spark.createDataFrame([(s, i, i % 5) for s in range(4) for i in range(20)], "station_id bigint, interval_start int, departures int")
    runs = censoring.synthetic_runs(free, "departures", (1, 3), 3).collect()
    assert sum(r.synthetic_run_length == 1 for r in runs) == 3 and sum(r.synthetic_run_length == 3 for r in runs) == 9
    assert all(r.censored_Y <= r.true_D for r in runs)
    assert sorted(map(tuple, runs)) == sorted(map(tuple, censoring.synthetic_runs(free, "departures", (1, 3), 3).collect()))
    rows = spark.createDataFrame([(3.0, 2.0, 1.0, 1, False), (-1.0, 2.0, 1.0, 6, True)], "D_hat double, true_D double, censored_Y double, synthetic_run_length int, is_capacity_stale boolean")
    got = {(r.stratum, r.run_length_bucket, r.is_capacity_stale): (r.mae, r.bias, r.n) for r in censoring.evaluate_recovery(rows).collect()}
    assert got == {("overall", None, None): (1, 0, 2), ("bucket", 0, None): (1, 1, 1), ("bucket", 2, None): (1, -1, 1), ("stale", None, False): (1, 1, 1), ("stale", None, True): (1, -1, 1)}


def test_matched_runs_report_shortfall(spark):
    target = spark.createDataFrame([("t", i, 1.0 if i < 5 else 9.0, 10, 0) for i in range(10)], "station_id string, interval_start int, D_hat double, capacity int, hour_of_week int")
    edges = censoring.stratum_edges(target, deciles=2, bands=2)
    props = censoring.stratum_proportions(censoring.assign_strata(target, edges))
    assert sorted(r.p for r in props.collect()) == [0.5, 0.5]
    low = censoring.assign_strata(spark.createDataFrame([(1, i, 1.0, 10, 0) for i in range(30)], "station_id bigint, interval_start int, D_hat double, capacity int, hour_of_week int"), edges)
    starts, coverage = censoring.matched_runs(low, props, (1, 2), 10)
    got = sorted((r.length, r.desired, r.taken) for r in coverage.collect())
    assert got == [(1, 5, 0), (1, 5, 5), (2, 5, 0), (2, 5, 5)] and starts.count() == 10
    assert sorted(r.fill_rate for r in censoring.coverage_by_decile(coverage).collect()) == [0, 1]


def test_poisson_regression(spark, tmp_path):
    rows = [(f"S{s}", "z0", float(i), i % 168, 2 * (i % 168 // 12 % 2), i % 40 == 0) for s in range(3) for i in range(400)]
    df = spark.createDataFrame(rows, "station_id string, zone_agg string, i double, hour_of_week int, departures int, is_bike_empty boolean")
    df = df.withColumn("interval_start", F.timestamp_add("MINUTE", (F.col("i") * 15).cast("int"), F.lit("2025-01-06 00:00:00").cast("timestamp_ntz")))
    for c in demand.NUMERIC:
        df = df.withColumn(c, F.lit(1.0))
    df = df.withColumns({"dep_own_lag_1h": F.col("departures") * 1.0, "dep_own_lag_1week": F.lit(None).cast("double"), "dep_neighbor_demand": F.lit(0.0), "month": F.month("interval_start")})
    df = df.withColumns({"arrivals": F.col("departures") + 1, "is_dock_full": F.lit(False), "arr_own_lag_1h": F.lit(0.0), "arr_own_lag_1week": F.lit(0.0), "arr_neighbor_demand": F.lit(0.0)})
    fitted = demand.fit(df, "dep", "2025-02-01", sample=900)
    got = fitted.predict(df)
    high, low = (got.filter(F.col("departures") == n).agg(F.avg("dep_D_hat")).first()[0] for n in (2, 0))
    assert high > 2 * low and demand.month_quota_sample(df, 100).count() <= 100
    both = demand.fit(df, "arr").predict(got)  # the second direction beside the first
    assert both.columns == [*df.columns, "dep_D_hat", "arr_D_hat"] and both.agg(F.avg("arr_D_hat")).first()[0] == pytest.approx(df.agg(F.avg("arrivals")).first()[0], rel=0.1)
    trees = demand.fit(df, "dep", "2025-02-01", kind="boosted", boost=boosting.BoostParams(rounds=12, rate=0.2, depth=4))
    trees.save(str(tmp_path / "trees"))
    boosted = demand.load_fitted(spark, "dep", str(tmp_path / "trees")).predict(df)
    assert boosted.agg(F.avg("dep_D_hat")).first()[0] == pytest.approx(df.filter(~F.col("is_bike_empty")).agg(F.avg("departures")).first()[0], rel=0.1)
    high, low = (boosted.filter(F.col("departures") == n).agg(F.avg("dep_D_hat")).first()[0] for n in (2, 0))
    assert high > 1.5 and 0 <= low < 0.5
    # taken apart for the simulator, the regression gives what it predicts
    import pandas as pd

    stations = df.select("station_id", "zone_agg", "capacity").distinct()
    weather = df.select(F.date_trunc("hour", "interval_start").cast("timestamp_ntz").alias("timestamp"), *[c for c in demand.NUMERIC if c != "capacity"]).distinct()
    own, step, lags = fitted.parts(stations, weather, pd.Timestamp("2025-01-06"), 40)
    for r in fitted.predict(df.withColumn("hour_of_week", C.hour_of_week(F.col("interval_start")))).filter("station_id = 'S1' and i < 40").collect():
        lag = lags["lag_1h"] * r.dep_own_lag_1h
        assert np.exp(own["S1"] + step[int(r.i)] + lag) == pytest.approx(r.dep_D_hat)
    fitted.save(str(tmp_path / "m"))
    again = demand.load_fitted(spark, "dep", str(tmp_path / "m")).predict(df)
    assert again.agg(F.sum("dep_D_hat")).first()[0] == pytest.approx(got.agg(F.sum("dep_D_hat")).first()[0])


def test_months_are_made_once(spark, tmp_path, monkeypatch):
    rows = spark.sql("SELECT 1L AS station_id, timestamp_ntz '2025-01-31 23:45:00' + make_dt_interval(0, 0, id * 15) AS interval_start, 0 AS departures, 0 AS arrivals, true AS is_bike_empty, false AS is_dock_full, 1 AS bike_empty_run_len, 0 AS dock_full_run_len FROM range(3)")

    class Ones:
        made = 0

        def __init__(self, direction):
            self.direction = direction

        def predict(self, df):
            Ones.made += 1
            return df.withColumn(f"{self.direction}_D_hat", F.lit(1.0))

    fitted = {d: Ones(d) for d in demand.DIRECTIONS}
    got = demand.impute_months(rows, fitted, {}, str(tmp_path / "unmet"))
    assert got.count() == 3 and got.agg(F.sum("dep_gross_unmet")).first()[0] == 3 and Ones.made == 4
    demand.impute_months(rows, fitted, {}, str(tmp_path / "unmet"))
    assert Ones.made == 4


def test_sim_week_runs_all_policies_over_the_whole_week(spark, monkeypatch):
    from fleetlens.operators import simulate
    from fleetlens.plans import queries

    seen, run = [], simulate.run_weeks

    def spied(session, network, sampler, runs, kind, params, *more):
        seen.append((runs, params.steps, network.added.shape[1], network.demand))
        return run(session, network, sampler, runs, kind, params, *more)

    monkeypatch.setattr(simulate, "run_weeks", spied)
    rows = queries.QUERIES["q_sim_week"](spark, "/root/testdata/sf0.001").collect()
    six = {"do_nothing", "uniform", "proportional", "top_n_stockout", "allocator", "allocator_full_budget"}
    (runs, steps, width, fed), = seen
    assert steps == width == 672 and fed is not None and {(r, p) for r, p, *_ in runs} == {(r.replicate, r.policy) for r in rows} == {(i, p) for i in (0, 1) for p in six}
    assert len({(m, s) for _, _, s, m, _ in runs}) == 2 and all(r.fill_rate is None or 0 <= r.fill_rate <= 1 for r in rows)


def test_radius_pairs_at_every_latitude(spark):
    places = [(1, 70.0, 10.0), (2, 70.0, 10.0103), (3, 80.0, 0.0), (4, 80.0, 0.02), (5, 80.0, 0.01), (6, 0.0, 179.999), (7, 0.0, -179.999), (8, 40.7, -74.0), (9, 40.7, -73.9)]
    st = spark.createDataFrame(places, "station_id bigint, lat double, lng double")
    got = {(r.station_id, r.neighbor_id) for r in zones.radius_pairs(st, 400.0).collect()}
    assert got == {(a, b) for own in ((1, 2), (3, 4, 5), (6, 7)) for a in own for b in own if a != b}


def test_linkage_by_components_is_linkage_of_all(spark):
    """Three clumps far apart, and a lone station: components cluster by themselves, as the whole network does."""
    rng, rows = np.random.default_rng(4), []
    for clump, (lat, lng) in enumerate(((40.70, -74.0), (40.75, -73.95), (40.80, -74.05))):
        rows += [(clump * 100 + i, lat + float(rng.uniform(0, 0.02)), lng + float(rng.uniform(0, 0.02))) for i in range(25 + clump)]
    stations = spark.createDataFrame([*rows, (999, 41.0, -73.5)], "station_id bigint, lat double, lng double")
    got = {r.station_id: r.zone_link for r in zones.linkage_zones(stations).collect()}
    east, north = C.utm_metres(F.col("lat"), F.col("lng"))
    placed = stations.select("station_id", east.alias("x"), north.alias("y")).toPandas().sort_values("station_id").reset_index(drop=True)
    root = zones.complete_linkage(placed["x"].to_numpy(), placed["y"].to_numpy(), 700.0)
    assert got == {s: f"c{placed['station_id'][root == r].min()}" for s, r in zip(placed["station_id"], root, strict=True)}
    components = {r.station_id: r.component for r in zones.radius_components(stations, 700 * 1.02).collect()}
    assert len(set(components.values())) >= 4 and components[999] == 999
    links = zones.linkage_zones(stations)
    assert tuple(zones.linkage_faults(stations, links).first()) == (len(rows) + 1, 0, 0)
    wide = links.withColumn("zone_link", F.when(F.col("station_id") < 300, "all").otherwise(F.col("zone_link")))
    assert zones.linkage_faults(stations, wide).first().over_cut == 1
    split = links.withColumn("zone_link", F.col("station_id").cast("string"))
    assert zones.linkage_faults(stations, split).first().mergeable > 0


def test_components_follow_long_chains(spark):
    chain = spark.createDataFrame([(i * 37 % 60, 40.7, -74.0 + 0.004 * i) for i in range(60)], "station_id bigint, lat double, lng double")
    assert {r.component for r in zones.radius_components(chain, 400.0).collect()} == {0}


def test_capacities_that_change_are_refused(spark):
    rows = spark.createDataFrame([(1, 5), (1, 5), (2, 5), (2, 6), (3, None), (3, 4), (4, None)], "station_id int, capacity int")
    assert tuple(inventory.varying_capacities(rows).first()) == (4, 2)
    inventory.assert_constant_capacity(rows.filter("station_id = 1"))
    with pytest.raises(AssertionError, match="2 of 4 stations"):
        inventory.assert_constant_capacity(rows)


def test_bucketed_tables_spare_shuffles_by_station(spark, tmp_path):
    from fleetlens.session import bucketed

    rows = spark.range(2000).select((F.col("id") % 7).alias("station_id"), F.timestamp_add("MINUTE", (F.floor(F.col("id") / 7) * 15).cast("int"), F.lit("2025-01-06 00:00:00").cast("timestamp_ntz")).alias("interval_start"), F.lit("z").alias("zone_agg"), (F.col("id") % 3).alias("departures"), (F.col("id") % 2).alias("arrivals"), (F.col("id") % 5 == 0).alias("is_bike_empty"), (F.col("id") % 4 == 0).alias("is_dock_full"))
    weather = spark.sql("SELECT timestamp_ntz '2025-01-06 00:00:00' AS timestamp, 1.0D AS temp_c, 0.0D AS precip_mm, 1.0D AS wind_kph, 1.0D AS humidity_pct")
    kept = bucketed(rows, str(tmp_path / "rows"), "station_id", "interval_start")
    made, plain = features.build_features(kept, weather), features.build_features(rows, weather)
    assert "hashpartitioning(station_id" not in made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(station_id" in plain._jdf.queryExecution().executedPlan().toString()
    assert made.exceptAll(plain).count() == 0 and made.count() == 2000


def test_stored_rows_are_joined_by_their_real_size(spark, tmp_path):
    """Rows whose files are small since their values repeat must not be taken for a table to broadcast; a small table still is."""
    from fleetlens.session import bucketed, tabled

    rows = spark.range(800_000).select((F.col("id") % 3).alias("station_id"), F.lit(1.5).alias("x"), F.lit("z1").alias("zone_agg"))
    few = spark.range(3).select(F.col("id").alias("station_id"), F.lit(2).alias("capacity"))
    for name, kept in (("a", tabled(rows, str(tmp_path / "a"))), ("b", bucketed(rows, str(tmp_path / "b"), "station_id"))):
        assert sum(f.stat().st_size for f in (tmp_path / name).iterdir()) < 1 << 20 and kept.count() == 800_000
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan(kept.withColumnRenamed("x", "own").join(kept.select("station_id", "x"), "station_id"))
        assert "BroadcastHashJoin" in plan(kept.join(tabled(few, str(tmp_path / f"few_{name}")), "station_id"))


def test_cubes_of_the_radius_join_are_not_broadcast(spark):
    stations = spark.range(60).selectExpr("id AS station_id", "40.7D + 0.002D * floor(id / 12) AS lat", "-74.0D + 0.002D * (id % 12) AS lng")
    pairs = zones.radius_pairs(stations, 400.0)
    assert pairs.count() == pairs.select("station_id", "neighbor_id").distinct().count() > 60
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_dense_panel_is_not_broadcast(spark):
    """A filter that takes zeros out must not turn the dense rows into the small side of a join; tasks are not merged by the size of the sparse rows."""
    at = F.lit("2025-01-06 00:00:00").cast("timestamp_ntz")
    ends = spark.range(400).select((F.col("id") % 40).alias("start_station_id"), F.timestamp_add("HOUR", (F.col("id") * 7 % 700).cast("int"), at).alias("started_at"), ((F.col("id") + 1) % 40).alias("end_station_id"), F.timestamp_add("HOUR", (F.col("id") * 7 % 700).cast("int") + 1, at).alias("ended_at"))
    s = spark.range(40).selectExpr("id AS station_id", "cast(id % 5 AS int) AS capacity", "40.7D AS lat", "-74.0D AS lng", "'z' AS zone_agg")
    dense = panel.build_counts(ends, s)
    usable = inventory.usable_panel(dense)
    seen = {(r.station_id, r.interval_start): (r.departures, r.arrivals) for r in panel.combine_observed(ends).collect()}
    rows = dense.collect()
    assert {(r.station_id, r.interval_start): (r.departures, r.arrivals) for r in rows if r.departures + r.arrivals} == seen
    per = {i: [r.interval_start for r in rows if r.station_id == i] for i in range(40)}
    assert all(len(set(x)) == len(x) == (max(x) - min(x)).total_seconds() / 900 + 1 for x in per.values()) and len(rows) > 50 * len(seen)
    assert dense.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    moved = usable.filter("net_flow != 0").select("station_id", "interval_start")
    moved.collect()
    plan = moved._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    sides = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert not any("interval_start" in line for line in sides)


def test_linkage_in_tiles_is_linkage_of_all(spark, monkeypatch):
    """One component over many squares, with exact ties: rounds of tiles give what the whole matrix gives, and no task makes that matrix."""
    rng = np.random.default_rng(11)
    rows = [(int(i), 40.5 + float(a), -74.0 + float(b)) for i, a, b in zip(rng.permutation(900), rng.uniform(0, 0.4, 900), rng.uniform(0, 0.1, 900), strict=True)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(30)]
    stations = spark.createDataFrame(rows, "station_id bigint, lat double, lng double")
    east, north = C.utm_metres(F.col("lat"), F.col("lng"))
    placed = stations.select("station_id", east.alias("x"), north.alias("y")).toPandas().sort_values("station_id").reset_index(drop=True)
    root = zones.complete_linkage(placed["x"].to_numpy(), placed["y"].to_numpy(), 700.0)
    monkeypatch.setattr(zones, "complete_linkage", None)
    got = {r.station_id: r.zone_link for r in zones.linkage_zones(stations, 700.0, tile_stations=40).collect()}
    assert got == {s: f"c{placed['station_id'][root == r].min()}" for s, r in zip(placed["station_id"], root, strict=True)}


def moved_rows(spark):
    """Rows that the stages of the session so far have shuffled."""
    jvm, none = spark._jvm, spark._jvm.java.util.ArrayList
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_only_observed_rows_are_shuffled(spark):
    from fleetlens.plans.chain import Chain

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c = Chain(spark, "/root/testdata/sf0.001")
        before = moved_rows(spark)
        net = c.net
        moved = moved_rows(spark) - before
        c.weekly  # stored rows that lie by station are summed where they lie
        later = moved_rows(spark) - before - moved
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert moved < net.count() and later < c.weekly.count()
