"""Exact quantiles, Newton regression and histogram trees against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators import boosting, quantiles, regression


def frame(spark, **columns):
    names = list(columns)
    rows = list(zip(*(x.tolist() if isinstance(x, np.ndarray) else x for x in columns.values()), strict=True))
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(3)


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(5)
    a = np.concatenate((rng.normal(0, 1e6, 300), [0.0, -0.0, 1e-300, -1e300, math.inf, 5.5, 5.5, 5.5]))
    b = [float(x) if x > 2 else None for x in rng.integers(0, 9, len(a))]
    return a, b, frame(spark, a=a, b=b, c=[None] * len(a))


def test_ordered_keys_keep_the_order():
    x = np.array([-math.inf, -1e300, -2.0, -5e-324, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, math.inf])
    keys = quantiles.ordered_keys(x)
    assert (np.diff(keys.astype(object)) > 0).all() and np.array_equal(quantiles.key_values(keys), x)
    assert quantiles.ordered_keys(np.array([-0.0])) == quantiles.ordered_keys(np.array([0.0]))


def test_quantiles_equal_those_of_all_values(numbers):
    a, b, df = numbers
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 0.9, 1.0]
    kept = sorted(x for x in b if x is not None)
    finite = df.filter("a < double('infinity')")
    got = quantiles.exact_quantiles(finite, {"a": shares, "b": shares, "c": shares})
    assert got["a"] == pytest.approx(np.quantile(a[np.isfinite(a)], shares).tolist()) and got["c"] == []
    assert quantiles.exact_quantiles(df, {"b": shares})["b"] == pytest.approx(np.quantile(kept, shares).tolist())
    many = [i / 200 for i in range(1, 200)]  # more ranks than a dense table of digits takes
    want = [np.sort(a)[max(math.ceil(p * len(a)), 1) - 1] for p in many]
    assert quantiles.exact_quantiles(df, {"a": many}, discrete=True)["a"] == want
    assert quantiles.exact_quantiles(df.filter("a is null"), {"a": shares}) == {"a": []}


def test_ranks_in_groups_equal_sorted_lists(spark, numbers):
    df = numbers[2].withColumn("k", (F.col("b") % 3).cast("int"))
    got = {r.k: (r.n, r.v) for r in quantiles.grouped_rank(df.filter("b is not null"), ["k"], "a", F.bround((F.col("n") - 1) * 0.3), "v").collect()}
    own = {k: sorted(x.a for x in df.filter(f"k = {k}").collect()) for k in got}
    assert got == {k: (len(v), v[round((len(v) - 1) * 0.3)]) for k, v in own.items()} and len(got) == 3


@pytest.fixture(scope="module")
def counts(spark):
    """Counts whose rate is log-linear in u, jumps with v, and is high where v is missing; w says nothing, z never varies."""
    rng = np.random.default_rng(11)
    n = 4000
    u, v, w = rng.normal(size=n), rng.uniform(size=n), rng.normal(size=n)
    gone = rng.uniform(size=n) < 0.2
    y = rng.poisson(np.exp(0.3 + 0.5 * u) * np.where(gone, 3.0, np.where(v > 0.6, 2.0, 0.5)))
    cell = [None if g else float(x) for g, x in zip(gone, v, strict=True)]
    return (u, np.where(gone, np.nan, v), w, y.astype(float)), frame(spark, in_u=u, in_v=cell, in_w=w, in_z=np.full(n, 3.0), in_label=y.astype(float))


def test_newton_steps_reach_the_optimum(spark, counts, tmp_path):
    (u, v, w, y), df = counts
    filled = df.fillna(0.0, ["in_v"])
    model = regression.fit_poisson(filled, ["u", "v", "w", "z"], l2=1e-3)
    x = np.column_stack([u, np.nan_to_num(v), w])
    mean, scale = x.mean(0), x.std(0)
    mu = np.exp(model.intercept + x @ np.array(model.weights[:3]))
    slope = ((x - mean) / scale).T @ (y - mu) / len(y) - 1e-3 * np.array(model.weights[:3]) * scale  # 0 at the optimum
    assert np.abs(slope).max() < 1e-6 and abs((y - mu).mean()) < 1e-6 and model.weights[3] == 0.0
    assert (np.diff(model.objective) <= 1e-12).all() and len(model.objective) < 12
    model.save(spark, str(tmp_path / "m"))
    again = regression.PoissonRegression.load(spark, str(tmp_path / "m"))
    assert again == model and again.transform(filled).agg(F.sum("in_prediction")).first()[0] == pytest.approx(mu.sum())
    plan = again.transform(filled)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_regression_of_no_rows_and_of_zeros(spark, counts):
    df = counts[1].fillna(0.0)
    assert regression.fit_poisson(df.filter("in_u > 1e9"), ["u"]).weights == [0.0]
    zeros = regression.fit_poisson(df.withColumn("in_label", F.lit(0.0)), ["u", "w"])
    assert zeros.transform(df).agg(F.max("in_prediction")).first()[0] < 1e-3


def plain_boost(x, y, params):
    """Level-wise Poisson boosting on arrays, all candidate splits tried one by one."""
    n, features = x.shape
    edges = [sorted({float(np.sort(c[~np.isnan(c)])[max(math.ceil(i / params.bins * (~np.isnan(c)).sum()), 1) - 1]) for i in range(1, params.bins)}) for c in x.T]
    score = np.full(n, math.log(y.mean()))
    loss = []
    for _ in range(params.rounds):
        node = np.ones(n, int)
        for level in range(params.depth):
            for k in [k for k in np.unique(node) if k >= 1 << level]:
                own, best = node == k, (0.0, None)
                mu = np.exp(score)
                part = lambda m: (y[m] - mu[m]).sum() ** 2 / mu[m].sum() if m.any() else 0.0
                for f in range(features):
                    for e in [*edges[f], math.inf]:
                        for nulls_left in (False, True):
                            left = own & np.where(np.isnan(x[:, f]), nulls_left, x[:, f] <= e)
                            right = own & ~left
                            gain = round(part(left) + part(right) - part(own), 6)
                            if min(left.sum(), right.sum()) >= params.min_leaf and gain > best[0]:
                                best = (gain, (left, right))
                if best[1]:
                    node[best[1][0]], node[best[1][1]] = 2 * k, 2 * k + 1
        mu = np.exp(score)
        for k in np.unique(node):
            own = node == k
            score[own] += params.rate * (y[own] - mu[own]).sum() / mu[own].sum()
        loss.append((np.exp(score) - y * score).mean())
    return np.exp(score), loss


def test_trees_equal_a_search_over_all_splits(counts):
    (u, v, w, y), df = counts
    params = boosting.BoostParams(rounds=4, rate=0.3, depth=3, bins=8, refresh=2)
    want, loss = plain_boost(np.column_stack([u, v, w]), y, params)
    model = boosting.fit_boosted(df, ["u", "v", "w"], params)
    got = model.transform(df).select("in_u", "in_prediction").toPandas().sort_values("in_u")["in_prediction"].to_numpy()
    assert got == pytest.approx(want[np.argsort(u)]) and (np.diff(loss) < 0).all()
    first = model.trees[0]
    assert max(first.feature) >= 1 and any(first.nulls_left[k] or f == 1 for k, f in enumerate(first.feature))


def test_trees_learn_more_than_the_mean_and_are_kept(spark, counts, tmp_path):
    (u, v, w, y), df = counts
    model = boosting.fit_boosted(df, ["u", "v", "w", "z"], boosting.BoostParams(rounds=25, rate=0.2, depth=3, bins=40, refresh=10))
    model.save(spark, str(tmp_path / "m"))
    again = boosting.BoostedTrees.load(spark, str(tmp_path / "m"))
    assert again == model and len(model.trees) == 25
    out = again.transform(df).toPandas()
    deviance = lambda p: (p - out["in_label"] * np.log(p)).mean()
    assert deviance(out["in_prediction"]) < deviance(np.full(len(out), y.mean())) - 0.5
    missing, low = out[out["in_v"].isna()], out[out["in_v"] < 0.5]
    assert missing["in_prediction"].mean() > 4 * low["in_prediction"].mean()


def test_a_constant_and_no_rows_make_one_leaf(spark, counts):
    df = counts[1]
    flat = boosting.fit_boosted(df, ["z"], boosting.BoostParams(rounds=2, depth=2))
    assert all(f == -1 for t in flat.trees for f in t.feature)
    assert flat.transform(df).select("in_prediction").distinct().count() == 1
    none = boosting.fit_boosted(df.filter("in_u > 1e9"), ["u"], boosting.BoostParams(rounds=1, depth=1))
    assert none.transform(df).agg(F.max("in_prediction")).first()[0] < 1e-5


def test_a_step_of_the_simulator_is_what_the_trees_predict(spark):
    """TreeDemand with the lags of real rows gives the model's own predictions of those rows."""
    import pandas as pd

    from fleetlens.operators import demand, features, panel, simulate

    rng = np.random.default_rng(8)
    n, begin = 672 + 96, "2025-01-06 00:00:00"
    rows = [(s, f"z{s % 2}", 5 + s, i, int(rng.poisson(0.5 + (i // 4 % 24 > 7) + 0.2 * s))) for s in range(4) for i in range(n)]
    df = spark.createDataFrame(rows, "station_id bigint, zone_agg string, capacity int, i int, departures bigint")
    df = df.withColumn("interval_start", F.timestamp_add("MINUTE", F.col("i") * 15, F.lit(begin).cast("timestamp_ntz"))).withColumns({"arrivals": F.col("departures"), "is_bike_empty": F.lit(False), "is_dock_full": F.lit(False)})
    hours = spark.range(n // 4).select(F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit(begin).cast("timestamp_ntz")).alias("timestamp"), *[(F.col("id") % k).cast("double").alias(c) for k, c in ((7, "temp_c"), (3, "precip_mm"), (5, "wind_kph"), (11, "humidity_pct"))])
    holidays = panel.us_federal_holidays(spark, "2025-01-01", "2025-01-31")
    ready = features.build_features(panel.add_calendar(df, holidays), hours)
    fitted = demand.fit(ready, "dep", kind="boosted", boost=boosting.BoostParams(rounds=6, rate=0.3, depth=3, bins=32, min_leaf=5))
    stations = df.select("station_id", "zone_agg", "capacity").distinct()
    ids, week = [0, 1, 2, 3], pd.Timestamp(begin) + pd.Timedelta(days=7)
    network = simulate.Network(ids, [f"z{s % 2}" for s in ids], np.array([5.0, 6, 7, 8]), np.zeros(4), [[]] * 4, np.zeros((4, 168)), np.zeros((4, 96)), np.zeros((4, 96)))
    made = simulate.with_demand(network, fitted, df, stations, hours, str(week), 96).demand
    real = np.array([r[4] for r in rows]).reshape(4, n)
    want = fitted.predict(ready).filter("i >= 672").toPandas().pivot(index="station_id", columns="i", values="dep_D_hat")
    for step in (0, 1, 50, 95):
        got = made.rates(step, real[:, 672 + step - 4 : 672 + step].astype(float))
        rows_now = want[672 + step].to_numpy()
        near = ready.filter(f"i = {672 + step}").orderBy("station_id").select("dep_neighbor_demand").toPandas()["dep_neighbor_demand"].to_numpy()
        before = np.array([real[s ^ 2, 672 + step - 1] for s in ids])  # the simulator knows the zone's last step, the features this one
        x = made.fixed.copy()
        x[:, made.varying] = made.step[step]
        at = made.model.features.index
        x[:, at("lag_1h")], x[:, at("lag_1week")], x[:, at("neighbor")] = real[:, 668 + step : 672 + step].mean(1), real[:, step], near
        assert np.exp(made.model.base + made.model.scores(made.model.bins(x), made.model.trees)) == pytest.approx(rows_now)
        x[:, at("neighbor")] = before
        assert got == pytest.approx(np.exp(made.model.base + made.model.scores(made.model.bins(x), made.model.trees)))
    far = made.rates(0, np.full((4, 4), 1e9))
    assert np.isfinite(far).all() and far.max() < 100  # lags beyond the data change nothing


def test_leaves_take_no_pass_of_their_own(counts, monkeypatch):
    passes, own = [], boosting.histograms
    monkeypatch.setattr(boosting, "histograms", lambda *a: passes.append(a[4]) or own(*a))
    model = boosting.fit_boosted(counts[1], ["u", "w"], boosting.BoostParams(rounds=2, depth=2, bins=8, min_leaf=5))
    assert passes == [0, 1, 0, 1]
    leaves = [v for t in model.trees for f, v in zip(t.feature, t.value, strict=True) if f < 0 and v != 0.0]
    assert len(leaves) >= 4
