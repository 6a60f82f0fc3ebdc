import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import allocate, compare, od, policies, simulate, validate, value
from fleetlens.params import AllocationParams, ValueParams

CELL = "station_id bigint, hour_of_week int"


def test_first_passage():
    rng = np.random.default_rng(0)
    lam, mu = np.array([0.7, 0.0, 3.0]), np.array([1.1, 0.0, 0.2])
    chance = value.empty_within(lam, mu, 6)
    assert (chance[:, 0] == 1).all() and (np.diff(chance) <= 1e-12).all() and not chance[1, 1:].any()
    for cell, level in ((0, 1), (0, 3), (2, 2)):  # against played weeks
        at, gone = np.full(200_000, level), np.zeros(200_000, bool)
        for _ in range(4):
            at = np.clip(at + rng.poisson(lam[cell], len(at)) - rng.poisson(mu[cell], len(at)), 0, 6)
            gone |= at == 0
        assert gone.mean() == pytest.approx(chance[cell, level], abs=0.005)
    worth = value.bike_values(lam, mu, 6, np.array([10.0, 5.0, 0.0]))
    assert worth[0].sum() == pytest.approx(10 * (1 - chance[0, -1])) and worth[1].tolist() == [5, 0, 0, 0, 0, 0] and not worth[2].any()
    # capacity 1: the bike is there until the first step that takes it
    p, zero = value.net_flow(lam[:1], mu[:1], 1)
    assert p.sum() == pytest.approx(1) and value.empty_within(lam[:1], mu[:1], 1)[0, 1] == pytest.approx(1 - p[0, zero:].sum() ** 4)
    assert value.first_rise(np.array([[3, 2, 1], [1, 2, 1], [1, 1, 2]])).tolist() == [0, 1, 2]


def test_mv_table(spark):
    cells = spark.createDataFrame([(1, 0, 0.5, 1.0, 9, 4.0), (2, 0, 0.5, 1.0, 2, 4.0), (3, 0, 0.5, 1.0, None, 4.0), (4, 0, 0.5, 1.0, 3, None)], f"{CELL}, lam double, mu double, capacity int, e_net_lost_given_stockout double")
    got = {}
    for r in value.mv_table(cells).collect():
        got.setdefault(r.station_id, []).append((r.k, r.mv))
    assert {k: len(v) for k, v in got.items()} == {1: 4, 2: 2, 4: 3} and got[4][0][1] == 0
    assert [m for _, m in got[1]] == pytest.approx(value.bike_values(np.array([0.5]), np.array([1.0]), 9, np.array([4.0]))[0, :4].tolist())


@pytest.fixture(scope="module")
def weekly(spark):
    rows = [(1, 0, w, 10, 0.5 if w % 2 else 0.0, d, 0.0, (10 - 2 * inv) / 4, float(inv), 0.0, 0.0, 4) for w, (inv, d) in enumerate([(1, 4.0), (2, 2.0), (3, 2.0), (4, 2.0), (1, 2.0), (2, 2.0)])]
    rows += [(2, 0, w, 10, 0.0, 1.0, 0.0, 0.0, 9.0, 0.0, 0.0, 4) for w in range(6)]
    return spark.createDataFrame(rows, f"{CELL}, week_start int, capacity int, p_stockout double, mean_dep_D_hat double, mean_arr_D_hat double, mean_dep_net_lost double, mean_inventory double, mean_nontrip_in double, mean_nontrip_out double, n_intervals bigint")


def test_reports(weekly):
    rates = {r.station_id: r for r in value.station_hour_rates(weekly).collect()}
    assert rates[1].dep_rate == pytest.approx(14 / 6) and rates[1].mu == rates[1].dep_rate
    assert value.net_lost_given_stockout(weekly).first().e_net_lost_given_stockout == pytest.approx(np.mean([6, 2, 6]))
    slopes = value.cross_check_slopes(weekly, ValueParams(min_weeks=5)).collect()
    assert [(s.station_id, round(s.slope, 9), s.midpoint) for s in slopes] == [(1, 2.0, 2.5)]
    assert not value.cross_check_slopes(weekly, ValueParams(min_weeks=7)).collect()
    low = value.low_frequency(weekly)
    assert {r.station_id: r.low_frac for r in low.collect()} == {1: 1.0, 2: 0.0}
    e = value.eligibility(low).first()
    assert (e.cells, e.eligible_cells, e.net_lost_share) == (2, 1, 1.0)
    assert {r.bucket: r.cells for r in value.low_frequency_buckets(low).collect()} == {"0": 1, ">0.50": 1}
    assert {r.is_chronic: r.cells for r in value.rebalancing_vs_chronicity(value.station_hour_rates(weekly), low).collect()} == {True: 1, False: 1}


def test_timing(spark):
    slots = spark.createDataFrame([(1, 0, w, s) for w, s in enumerate([0, 0, 0, 3])] + [(2, 0, 0, 1)], f"{CELL}, week_start int, first_slot int")
    got = {r.station_id: r for r in value.chronic_timing(slots).collect()}
    assert got[1].modal_share == 0.75 and got[1].mean_slot == 0.75 and got[1].std_slot == pytest.approx(1.5)
    assert got[2].std_slot is None and got[2].modal_share == 1


@pytest.fixture(scope="module")
def market(spark):
    low = spark.createDataFrame([(1, 0, 0.8, 0.0), (2, 0, 0.8, 0.5), (3, 0, 0.3, 1.0), (4, 0, 0.0, 9.0), (5, 0, 0.1, 3.6), (6, 0, 0.0, 9.0)], f"{CELL}, low_frac double, min_inventory double")
    timing = spark.createDataFrame([(1, 0, 0.9), (2, 0, 0.4)], f"{CELL}, modal_share double")
    mv = spark.createDataFrame([(s, 0, k, m / k) for s, m in ((1, 9.0), (2, 6.0), (3, 3.0), (5, 1.0)) for k in (1, 2, 3, 4)], f"{CELL}, k int, mv double")
    zones = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a"), (5, "b"), (6, "c")], "station_id bigint, zone_agg string")
    flows = spark.createDataFrame([(6, 0, 3, 0.4)], "start_station_id bigint, hour_of_week int, end_station_id bigint, prob double")
    tiers, origins, cum = allocate.assign_tiers(low, timing), allocate.qualifying_origins(low, mv), allocate.dest_cumulative_mv(mv)
    return tiers, origins, cum, allocate.candidate_moves(tiers, cum, origins, zones, flows)


def test_tiers_origins_moves(market):
    tiers, origins, cum, moves = market
    assert {r.station_id: r.tier for r in tiers.collect()} == {1: 1, 2: 2, 3: 2, 5: 2}
    cost = {r.station_id: r.origin_cost for r in origins.collect()}
    assert cost == {4: 0.0, 5: 0.25, 6: 0.0}
    c = {(r.station_id, r.k): r.cum_mv for r in cum.collect()}
    assert c[1, 1] == 9 and c[1, 4] == pytest.approx(9 * (1 + 1 / 2 + 1 / 3 + 1 / 4))
    got = {r.station_id: (r.origin_station_id, r.flow_prob) for r in moves.collect()}
    assert got == {1: (4, 0.0), 2: (4, 0.0), 3: (6, 0.4)}  # 5 has no other origin in its zone


def test_ranking_budget_sweep(spark, market):
    _, _, cum, moves = market
    p = AllocationParams()
    options = allocate.value_options(moves, cum, allocate.payout_grid(spark, p), p)
    ranked = allocate.rank_targets(options)
    rows = ranked.orderBy("rank").collect()
    assert [r.station_id for r in rows] == [1, 2, 3] and [r.nvpd for r in rows] == sorted((r.nvpd for r in rows), reverse=True)
    assert all(r.dollar_cost == pytest.approx(r.induced * r.payout * 0.2) for r in rows)
    cut = allocate.budget_cutoff(ranked, rows[0].dollar_cost + rows[1].dollar_cost + 1e-9)
    assert cut.count() == 2
    tops = allocate.elasticity_sweep(moves, cum, allocate.payout_grid(spark, p), allocate.elasticity_grid(spark, p), p)
    assert tops.count() == 75
    rho = allocate.spearman_stability(tops)
    assert rho.count() == 300 and rho.filter("rho > 1.0000001 or rho < -1.0000001").count() == 0
    assert {r.appearance_frac for r in allocate.stable_core(tops, 25).collect()} == {1.0}
    flip = spark.createDataFrame([(d, i, 0, r) for d, ranks in ((0, [1, 2, 3]), (1, [3, 2, 1])) for i, r in enumerate(ranks)] + [(2, 0, 0, 1)], "draw int, station_id bigint, hour_of_week int, rank int")
    got = {(r.draw_i, r.draw_j): r.rho for r in allocate.spearman_stability(flip).collect()}
    assert got[0, 1] == pytest.approx(-1) and got[0, 2] is None


def test_policies(spark, market):
    _, _, cum, moves = market
    p = AllocationParams()
    rates = spark.createDataFrame([(1, 0, 1.0, 0.2), (2, 0, 3.0, 0.9), (3, 0, 0.0, 0.5)], f"{CELL}, mu double, p_stockout_empirical double")
    cand = policies.shared_candidates(moves, rates)
    uni = policies.uniform(cand, 3.0).collect()
    assert [r.dollar_cost for r in uni] == pytest.approx([1.0] * 3, abs=1e-3)
    prop = {r.station_id: r.dollar_cost for r in policies.proportional(cand, 4.0).collect()}
    assert prop == {1: pytest.approx(1, abs=1e-3), 2: pytest.approx(3, abs=1e-3)}
    one = policies.top_n_stockout(cand, 1e9).filter("station_id = 2").first().dollar_cost
    assert [r.station_id for r in policies.top_n_stockout(cand, 1.5 * one).collect()] == [2]
    ranked = allocate.rank_targets(allocate.value_options(moves, cum, allocate.payout_grid(spark, p), p))
    natural = policies.allocator(ranked, 1e9)
    total = natural.agg(F.sum("dollar_cost")).first()[0]
    exact = policies.allocator_full_budget(ranked, total).agg(F.sum("dollar_cost")).first()[0]
    more = policies.allocator_full_budget(ranked, 5 * total)
    assert exact == pytest.approx(total) and total < more.agg(F.sum("dollar_cost")).first()[0] <= 5 * total and more.agg(F.max("payout")).first()[0] <= 50
    draws = spark.createDataFrame([(0, *p.tier1, *p.tier2), (1, 1.0, 0.1, 1.0, 0.2)], "draw int, a1 double, b1 double, a2 double, b2 double")
    drawn = allocate.rank_targets(allocate.value_options(moves, cum, allocate.payout_grid(spark, p), p, draws), ["draw"])
    many = policies.shared_candidates(moves, rates, draws)
    rows = lambda df: sorted((r.station_id, round(r.payout, 6), round(r.dollar_cost, 6)) for r in df.collect())
    for one, all_ in ((policies.uniform(cand, 3.0, p), policies.uniform(many, 3.0, p, ["draw"])), (policies.proportional(cand, 4.0, p), policies.proportional(many, 4.0, p, ["draw"])), (policies.top_n_stockout(cand, 1.5 * one, p), policies.top_n_stockout(many, 1.5 * one, p, ["draw"])), (policies.allocator(ranked, total), policies.allocator(drawn, total, ["draw"])), (policies.allocator_full_budget(ranked, 2 * total, p), policies.allocator_full_budget(drawn, 2 * total, p, ["draw"]))):
        assert rows(one) == rows(all_.filter("draw = 0")) and all_.filter("draw = 1").count()
    capped = policies.apply_move_cap(natural, 0.1)
    assert capped.agg(F.max("induced_trips")).first()[0] == 0.1 and capped.agg(F.sum("dollar_cost")).first()[0] == pytest.approx(total)
    assert policies.do_nothing(spark).count() == 0 and "moves_per_hour" in policies.simulator_moves(natural).columns


def network(capacity, start, n=3):
    near = [[(j, 200.0 * abs(i - j)) for j in sorted(range(n), key=lambda j: abs(i - j)) if j != i and abs(i - j) <= 3] for i in range(n)]
    return simulate.Network([10, 20, 30][:n], ["a", "a", "b"][:n], np.array(capacity, float), np.array(start, float), near, np.zeros((n, 168)), np.zeros((n, 672)), np.zeros((n, 672)))


def test_routing_conserves_trips():
    net = network([2, 5, 5], [2, 5, 2])
    go = lambda room: simulate.route(net, np.full(6, 1), np.zeros(6, int), np.array(room))
    log = go([0.0, 0.0, 3.0])
    assert (log["hop"] == 0).sum() == 0 and (log["hop"] > 0).sum() == 3 and (log["hop"] == -1).sum() == 3 and np.bincount(log["reached"] + 1).tolist() == [3, 0, 0, 3]
    log = go([9.0, 0.0, 0.0])
    assert (log["hop"] == 0).all() and (log["reached"] == 0).all()
    log = go([1.0, 2.0, 9.0])  # in turn: itself, the nearest, the next
    assert log["reached"].tolist() == [0, 1, 1, 2, 2, 2] and log["hop"].tolist() == [0, 1, 1, 2, 2, 2] and log["distance_m"].tolist() == [0, 200, 200, 400, 400, 400]
    assert not len(simulate.route(net, np.zeros(0, int), np.zeros(0, int), np.ones(3))["hop"])
    assert simulate.induced_by_step([(2, 0, 10, 8.0)], 10) == ({2: 2.0}, {0: 2.0}) and simulate.induced_by_step([(2, 0, 10, 8.0)], 11) == ({}, {})


SHARES = {"global": {(): (np.array([10, 20, 30]), np.array([0.2, 0.3, 0.5]))}}


def test_arrivals_count_where_bikes_land(spark):
    net = network([10, 2, 3], [8, 2, 3])
    sampler = od.OdSampler(SHARES, {}, {})
    # six trips from station 0 to station 1, which is full; so is 2: room for what 0 has given up
    cells, log = simulate.simulate_week(net, sampler, 0, steps=1, forced={0: [(0, 1)] * 6})
    a, b, c = cells.itertuples()
    assert (a.departures_actual, a.rerouted_arrivals, a.direct_arrivals, a.lost_past_cap_arrivals) == (6, 6, 0, 0)
    assert (b.direct_arrivals, b.rerouted_arrivals, b.lost_past_cap_arrivals) == (0, 0, 0) and set(log.hop) == {1}
    net.neighbors[1] = [(2, 200.0)]  # where nobody can go on, trips are lost at the full destination
    cells, _ = simulate.simulate_week(net, sampler, 0, steps=1, forced={0: [(0, 1)] * 6 + [(1, 2), (1, 1), (1, 0)]})
    a, b, c = cells.itertuples()
    assert (b.departures_actual, b.lost_no_bike) == (2, 1) and a.lost_past_cap_arrivals == 0
    assert cells.departures_actual.sum() == (cells.direct_arrivals + cells.rerouted_arrivals + cells.lost_past_cap_arrivals).sum() == 8
    assert (b.direct_arrivals, b.lost_past_cap_arrivals, c.lost_past_cap_arrivals) == (2, 5, 0)
    assert (a.rerouted_arrivals, cells.rerouted_arrivals.sum()) == (1, 1)  # 2 is full too, and the second next to it has room


def test_simulated_week_and_runs(spark):
    net = network([10, 10, 10], [5, 5, 5])
    net.rate[:] = 0.4
    sampler = od.OdSampler(SHARES, {}, {10: "a", 20: "a", 30: "b"})
    cells, log = simulate.simulate_week(net, sampler, 3, steps=40)
    assert len(cells) == 120 and (cells.departures_actual <= cells.departures_sampled).all()
    assert cells.departures_actual.sum() == len(log) == (cells.direct_arrivals + cells.rerouted_arrivals + cells.lost_past_cap_arrivals).sum()
    by_step = cells.groupby("step")
    assert np.allclose(by_step.inventory.sum().diff().iloc[1:], -by_step.lost_past_cap_arrivals.sum().iloc[:-1])  # bikes only leave with lost trips
    again, _ = simulate.simulate_week(net, sampler, 3, steps=40)
    assert cells.equals(again)
    forced, _ = simulate.simulate_week(net, sampler, 0, steps=2, forced={0: [(0, 1)] * 9})
    assert forced.iloc[0].departures_actual == 5 and forced.iloc[0].lost_no_bike == 4
    real = {0: [(0, 1)] * 3 + [(2, 1)], 5: [(1, 1)]}
    for mode in ("sanity_od", "sanity_true_dest"):
        replay, own = simulate.run_mode(net, sampler, mode, 1, real, 8)
        assert replay.departures_sampled.sum() == len(own) == 5
    assert sorted(zip(own.origin, own.wanted, strict=True)) == sorted(real[0] + real[5])
    with pytest.raises(ValueError):
        simulate.run_mode(net, sampler, "other", 1)
    from fleetlens.params import SimulationParams

    runs = [(0, "do_nothing", 3, 1.0, []), (0, "p", 3, 1.0, [(0, 2, 0, 2.0)])]
    out = simulate.run_weeks(spark, net, sampler, runs, params=SimulationParams(steps=8))
    assert {(r.policy, r["count"]) for r in out.groupBy("policy").count().collect()} == {("do_nothing", 24), ("p", 24)}
    sums = simulate.run_weeks(spark, net, sampler, runs, "bigint", SimulationParams(steps=8), simulate.summed, simulate.SUMMED)
    total = lambda df: df.filter("policy = 'p'").agg(F.sum("direct_arrivals"), F.sum("lost_no_bike")).first()
    assert total(sums) == total(out) and sums.count() == 2 * 3 * 2
    with pytest.raises(KeyError):
        od.OdSampler({"global": {}}, {}, {}).draw(np.random.default_rng(0), 10, 0, 1)
    with pytest.raises(KeyError):  # a destination that the network doesn't have
        simulate.simulate_week(net, od.OdSampler({"global": {(): (np.array([99]), np.array([1.0]))}}, {}, {}), 3, steps=40)


def test_demand_follows_what_was_simulated():
    week = np.zeros((3, 672))
    week[2, 1] = 4
    d = simulate.StepDemand(np.log([1.0, 2.0, 1.0]), np.zeros(672), 0.5, 0.25, 0.1, week, np.zeros((3, 4)), np.array([0, 0, -1]))
    quiet = d.rates(0, np.zeros((3, 4)))
    assert quiet == pytest.approx([1, 2, 1]) and d.rates(1, np.zeros((3, 4)))[2] == pytest.approx(np.exp(1))
    last = np.array([[0, 0, 0, 2.0], [0, 0, 0, 0], [4, 0, 0, 4]])
    assert d.rates(0, last) == pytest.approx([np.exp(0.25), 2 * np.exp(0.2), np.exp(1.0)])
    assert d.rates(0, np.full((3, 4), 1e6)).max() == pytest.approx(np.exp(5))
    net = network([50, 50, 50], [40, 40, 40])
    shares = od.OdSampler(SHARES, {}, {})
    plain, _ = simulate.simulate_week(net, shares, 1, steps=50)
    net.demand = d
    fed, _ = simulate.simulate_week(net, shares, 1, steps=50)
    assert plain.departures_sampled.sum() == 0 and fed.departures_sampled.sum() > 50


def test_shares_are_drawn_as_given():
    sampler = od.OdSampler({"global": {(): (np.array([10, 20]), np.array([0.25, 0.75]))}, "station_hour": {(20, 5): (np.array([10]), np.array([1.0]))}}, {(20, 5): "station_hour"}, {})
    shares = sampler.bound([10, 20])
    got = shares.draw(np.random.default_rng(0), np.repeat([0, 1], 4000), 5)
    assert (got[4000:] == 0).all() and got[:4000].mean() == pytest.approx(0.75, abs=0.03)


def test_od_tiers(spark):
    trips = spark.sql("SELECT 1L AS start_station_id, timestamp_ntz '2025-01-06 08:00:00' AS started_at, id % 2 + 1 AS end_station_id FROM range(40) UNION ALL SELECT 2L, timestamp_ntz '2025-01-06 09:00:00', 3L")
    stations = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "station_id bigint, zone_agg string")
    rows = od.od_trips(trips, stations, stations.filter("station_id < 3"))
    counts = od.od_counts(rows)
    assert counts["global"].agg(F.sum("n")).first()[0] == 40  # the trip to an unusable station is out
    probs = od.od_probabilities(counts)
    assert probs["station_hour"].groupBy("start_station_id", "hour_of_week").agg(F.sum("prob").alias("s")).filter("abs(s - 1) > 1e-9").count() == 0
    tier = {(r.station_id, r.hour_of_week): r.tier for r in od.cell_tier(counts, stations).collect()}
    assert tier[1, 8] == "station_hour" and tier[2, 8] == "zone_hour" and tier[2, 9] == "zone_daypart" and tier[3, 8] == "global" and len(tier) == 3 * 168
    s = od.sampler(probs, od.cell_tier(counts, stations), stations)
    ends, used = s.draw(np.random.default_rng(0), 1, 8, 10)
    assert len(ends) == 10 and used == "station_hour" and set(ends) <= {1, 2}


def test_fill_rates_by_hand(spark):
    cells = spark.createDataFrame([("A", 1, "Z1", 9, 1, 1, 0), ("A", 2, "Z1", 6, 0, 1, 1), ("B", 2, "Z2", 3, 0, 1, 0), ("C", 3, None, 0, 0, 0, 0)], "station_id string, hour_of_week int, zone_agg string, direct_arrivals int, rerouted_arrivals int, lost_no_bike int, lost_past_cap_arrivals int")
    got = {(r.level, r.zone): (r.fulfilled, r.lost) for r in compare.fill_rates(cells).collect()}
    assert got == {("system", None): (19, 4), ("zone", "Z1"): (16, 3), ("zone", "Z2"): (3, 1)}
    t = compare.treated_fill(cells, spark.createDataFrame([("A", 1), ("B", 2)], "station_id string, hour_of_week int")).first()
    assert (t.fulfilled, t.lost) == (13, 2)


def test_comparison(spark):
    rows = [(i, p, "system", None, 80 + (i if p == "a" else 0), 20 - (i if p == "a" else 0), 10.0 if p == "a" else 0.0) for i in range(5) for p in ("do_nothing", "a")]
    df = spark.createDataFrame(rows, "replicate int, policy string, level string, zone string, fulfilled bigint, lost bigint, dollar_cost double").withColumn("fill_rate", F.col("fulfilled") / (F.col("fulfilled") + F.col("lost")))
    c = compare.policy_comparison(df)
    r = c.first()
    assert (r.policy, r.replicates, r.recovered_median, r.undefined_share, r.p_lift) == ("a", 5, 2, 0.2, 0.8) and r.lift_pp_median == pytest.approx(2)
    assert r.cost_per_trip_median == pytest.approx(np.median([10, 5, 10 / 3, 2.5]))
    assert compare.significant_lift(c).first().significant == 1 and "| a |" in compare.markdown(c)
    t = df.filter("policy = 'a'").withColumns({"base_fulfilled": F.lit(80), "base_lost": F.lit(20)})
    assert compare.treated_comparison(t).first().recovered_median == 2
    text = compare.report(df, t, 10.0)
    assert "1 of 1 policies change" in text and "## Treated cells" in text and "| a | $10.00 | 0.20 |" in text and all(x in text for x in compare.CAVEATS)
    assert compare.lift_vs_budget(df.withColumn("budget", F.lit(5))).first().lift_pp_median == pytest.approx(2)
    d = compare.draw_replicate(3, [0.9, 1.1])
    assert d == compare.draw_replicate(3, [0.9, 1.1]) and 1 <= d.tier2[0] <= 5 and d.tier1[0] / d.tier2[0] == pytest.approx(2 / 3)


def test_validation(spark):
    cells = lambda x: spark.createDataFrame([(s, i, float(s + i + x * (s == 2)), (s + i) % 2 == 0, i % 3) for s in range(3) for i in range(6)], "station_id int, interval_start int, inventory double, is_bike_empty boolean, hour_of_week int")
    d = validate.inventory_diagnostics(cells(1), cells(0)).first()
    assert d.n == 18 and d["max"] == 1 and d["mean"] == pytest.approx(1 / 3)
    s = validate.stockout_rate_summary(validate.stockout_rates(cells(0), cells(0))).first()
    assert s.corr is None and s.wmape == 0  # every cell has the same rate
    assert validate.stockout_minutes_correlation(cells(0), cells(0), spark.createDataFrame([(2,)], "station_id int")).first().stations == 2
    weeks = spark.createDataFrame([(s, h, w, float(s), float(s)) for s in range(3) for h in range(2) for w in range(1, 7)], "station_id int, hour_of_week int, week int, actual double, simulated double")
    assert {r.weeks: r.wmape for r in validate.pooled_trend(weeks).collect()} == {1: 0, 2: 0, 4: 0, 6: 0}
    gate = validate.gate_report(spark.sql("SELECT 0.03D AS pct_error"), spark.sql("SELECT 0.2D AS zone_wmape")).first()
    assert gate.passed is False


def test_sweep_of_all_destinations(spark, market):
    """No destination is cut off before the ranking, and a bar from some of the moves changes no top."""
    from fleetlens.plans import queries

    tiers, origins, cum, every = market
    zones = spark.createDataFrame([(i, "a") for i in range(1, 7)], "station_id bigint, zone_agg string")
    flows = spark.createDataFrame([], "start_station_id bigint, hour_of_week int, end_station_id bigint, prob double")
    made = {n: allocate.candidate_moves(tiers, cum, origins, zones, flows, n).count() for n in (1, None)}
    assert made == {1: 1, None: 4}
    p = AllocationParams(top_n=1)
    grid = allocate.payout_grid(spark, p), allocate.elasticity_grid(spark, p), p
    rows = lambda df: sorted(map(tuple, df.collect()))
    for some in (every.filter("station_id = 1"), every.filter("station_id = 3"), every.limit(0)):
        assert rows(allocate.elasticity_sweep(every, cum, *grid, some)) == rows(allocate.elasticity_sweep(every, cum, *grid))
    assert "LIMIT 3000" not in queries.ORACLE_SQL["q_elasticity_sweep"] and "LIMIT 3000" in queries.ORACLE_SQL["q_candidate_moves"]
