"""Demand behind stockouts: rate model, Poisson regression, calibration, imputation."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import quantile_bucket, upper_bucket
from ..session import checkpoint_dir, exists, stored
from .boosting import BoostedTrees, BoostParams, fit_boosted
from .quantiles import exact_quantiles
from .regression import PoissonRegression, fit_poisson

#: Target, censoring flag, run length and prefix of each direction.
DIRECTIONS = {"dep": ("departures", "is_bike_empty", "bike_empty_run_len"), "arr": ("arrivals", "is_dock_full", "dock_full_run_len")}


def rate_model(rows: DataFrame, direction: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mean target on uncensored rows by (station, hour of week), by (zone, hour of week), and overall."""
    target, flag, _ = DIRECTIONS[direction]
    free = rows.filter(~F.col(flag))
    cell = free.groupBy("station_id", "hour_of_week").agg(F.avg(target).alias("cell_mean"))
    zone = free.groupBy("zone_agg", "hour_of_week").agg(F.avg(target).alias("zone_mean"))
    return cell, zone, free.agg(F.avg(target).alias("all_mean"))


def predict_rates(rows: DataFrame, model: tuple[DataFrame, DataFrame, DataFrame], direction: str) -> DataFrame:
    """rows with <direction>_D_hat: the cell's mean, else the zone's, else the overall one."""
    cell, zone, overall = model
    out = rows.join(cell, ["station_id", "hour_of_week"], "left").join(zone, ["zone_agg", "hour_of_week"], "left").crossJoin(F.broadcast(overall))
    return out.withColumn(f"{direction}_D_hat", F.coalesce("cell_mean", "zone_mean", "all_mean")).drop("cell_mean", "zone_mean", "all_mean")


def add_rates(rows: DataFrame, direction: str) -> DataFrame:
    """predict_rates(rows, rate_model(rows)): one pass of partial sums, and joins of the small tables of means."""
    return predict_rates(rows, rate_model(rows, direction), direction)


def add_all_rates(rows: DataFrame) -> DataFrame:
    """add_rates of both directions from a single pass over rows: means by cell, of which those by zone and overall are sums."""
    sums = {f"{d}_{n}": x for d, (target, flag, _) in DIRECTIONS.items() for n, x in (("s", F.sum(F.when(~F.col(flag), F.col(target)))), ("n", F.count_if(~F.col(flag))))}
    cell = rows.groupBy("station_id", "zone_agg", "hour_of_week").agg(*[x.alias(c) for c, x in sums.items()])
    means = lambda own, *keys: [F.try_divide(F.sum(f"{d}_s"), F.sum(f"{d}_n")).alias(f"{d}_{own}") for d in DIRECTIONS]
    by_cell = cell.groupBy("station_id", "hour_of_week").agg(*means("cell"))
    by_zone = cell.filter("zone_agg is not null").groupBy("zone_agg", "hour_of_week").agg(*means("zone"))
    rates = cell.select("station_id", "zone_agg", "hour_of_week").join(by_cell, ["station_id", "hour_of_week"]).join(by_zone, ["zone_agg", "hour_of_week"], "left").crossJoin(F.broadcast(cell.agg(*means("all"))))
    rates = rates.select("station_id", F.col("zone_agg").alias("zone_"), "hour_of_week", *[F.coalesce(f"{d}_cell", f"{d}_zone", f"{d}_all").alias(f"{d}_D_hat") for d in DIRECTIONS])
    return rows.join(rates, ["station_id", "hour_of_week"]).filter(F.col("zone_agg").eqNullSafe(F.col("zone_"))).drop("zone_")


def wmape(actual: str, predicted: str) -> Column:
    """Sum of absolute errors over sum of absolute values; null where that is 0."""
    return F.try_divide(F.sum(F.abs(F.col(actual) - F.col(predicted))), F.sum(F.abs(F.col(actual))))


def wmape_by_decile(rows: DataFrame, actual: str, predicted: str, deciles: int = 10) -> DataFrame:
    """decile, n, wmape of rows cut at the quantiles of the prediction; equal edges leave deciles out."""
    edges = exact_quantiles(rows, {predicted: [i / deciles for i in range(1, deciles)]})[predicted]
    cut = rows.withColumn("decile", quantile_bucket(F.col(predicted), F.array(*[F.lit(e) for e in edges]).cast("array<double>")))
    return cut.groupBy("decile").agg(F.count("*").alias("n"), wmape(actual, predicted).alias("wmape"))


def bucket_bias(recovery: DataFrame, min_n: int = 20) -> DataFrame:
    """run_length_bucket, bias of the recovery strata with enough rows."""
    return recovery.filter((F.col("stratum") == "bucket") & (F.col("n") >= min_n)).select("run_length_bucket", "bias")


def impute_unmet(rows: DataFrame, direction: str, bias: DataFrame | None = None, edges: tuple[int, ...] = (1, 4)) -> DataFrame:
    """rows with <direction>_gross_unmet = max(0, max(0, D_hat - Y) - bias of the run length's bucket), 0 where not censored."""
    target, flag, run = DIRECTIONS[direction]
    raw = F.greatest(F.lit(0.0), F.col(f"{direction}_D_hat") - F.col(target))
    out = rows
    if bias is not None:
        out = out.withColumn("run_length_bucket", upper_bucket(F.col(run), edges)).join(F.broadcast(bias), "run_length_bucket", "left")
        raw = F.greatest(F.lit(0.0), raw - F.coalesce("bias", F.lit(0.0)))
    return out.withColumn(f"{direction}_gross_unmet", F.when(F.col(flag), raw).otherwise(0.0)).drop("run_length_bucket", "bias")


def unmet_table(rated: DataFrame, bias: dict[str, DataFrame] | None = None, edges: tuple[int, ...] = (1, 4)) -> DataFrame:
    """Both directions of rows with D_hat side by side, never summed.

    With bias (by run-length bucket) rows need the run lengths of DIRECTIONS.
    """
    out = rated
    for d in DIRECTIONS:
        out = impute_unmet(out, d, (bias or {}).get(d), edges)
    return out


def _known(rows: DataFrame, runs: DataFrame, direction: str) -> DataFrame:
    """runs with the rows' own D_hat, joined by station and interval, never by row order, and the station's staleness."""
    from .features import capacity_staleness

    own = rows.select("station_id", "interval_start", F.col(f"{direction}_D_hat").alias("D_hat"))
    return runs.join(own, ["station_id", "interval_start"]).join(capacity_staleness(rows), "station_id")


def calibrate(rows: DataFrame, direction: str, runs_each: int = 300, lengths: tuple[int, ...] = (1, 2, 3, 4, 6, 8, 12), min_n: int = 20, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(recovery table, bias by run-length bucket) of the rows' own <direction>_D_hat, from artificially censored runs."""
    from .censoring import evaluate_recovery, synthetic_runs

    target, flag, _ = DIRECTIONS[direction]
    runs = synthetic_runs(rows.filter(~F.col(flag)), target, lengths, runs_each, seed)
    recovery = evaluate_recovery(_known(rows, runs, direction))
    return recovery, bucket_bias(recovery, min_n)


def calibrate_matched(rows: DataFrame, direction: str, runs_each: int = 300, lengths: tuple[int, ...] = (1, 2, 3, 4, 6, 8, 12), seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(recovery table, coverage): calibrate's test on runs whose starts match the censored rows' strata.

    Strata are deciles of the prediction, bands of capacity and hours of the
    week, with the edges of the censored rows. It reports and corrects nothing:
    strata that the pool can't fill stay short, as coverage shows.
    """
    from .censoring import assign_strata, evaluate_recovery, matched_runs, runs_from, stratum_edges, stratum_proportions

    target, flag, _ = DIRECTIONS[direction]
    own = rows.select("station_id", "interval_start", "hour_of_week", "capacity", flag, target, F.col(f"{direction}_D_hat").alias("D_hat"))
    strata = assign_strata(own, stratum_edges(own.filter(F.col(flag))))
    free = strata.filter(~F.col(flag))
    starts, coverage = matched_runs(free, stratum_proportions(strata.filter(F.col(flag))), lengths, runs_each, seed)
    return evaluate_recovery(_known(rows, runs_from(free, starts, target), direction)), coverage


def held_out_wmape(rows: DataFrame, direction: str, holdout_start: str, deciles: int = 10) -> DataFrame:
    """stratum (overall, decile), decile, n, wmape on uncensored rows from holdout_start on."""
    target, flag, _ = DIRECTIONS[direction]
    held = rows.filter(~F.col(flag) & (F.col("interval_start") >= F.lit(holdout_start).cast("timestamp_ntz")))
    overall = held.agg(F.count("*").alias("n"), wmape(target, f"{direction}_D_hat").alias("wmape")).select(F.lit("overall").alias("stratum"), F.lit(None).cast("int").alias("decile"), "n", "wmape")
    return overall.unionByName(wmape_by_decile(held, target, f"{direction}_D_hat", deciles).select(F.lit("decile").alias("stratum"), "decile", "n", "wmape"))


NUMERIC = ["temp_c", "precip_mm", "precip_lag1h", "precip_lag2h", "wind_kph", "humidity_pct", "capacity"]
LAGS = {"lag_1h": "own_lag_1h", "lag_1week": "own_lag_1week", "neighbor": "neighbor_demand"}
STATION = ("station_enc", "zone_enc", "capacity")


def _calendar() -> dict[str, Column]:
    """Hour of the day and of the week and the month as waves, weekend and holiday as flags."""
    how, month = F.col("hour_of_week"), F.col("month")
    wave = lambda x, period, k: {f"{f.__name__}_{period}_{k}": f(x * (2 * math.pi * k / period)) for f in (F.sin, F.cos)}
    out = wave(how, 24, 1) | wave(how, 24, 2) | wave(how, 24, 3) | wave(how, 168, 1) | wave(how, 168, 2) | wave(month, 12, 1)
    return out | {"weekend": (how >= 120).cast("double"), "holiday": F.coalesce(F.col("is_holiday").cast("double"), F.lit(0.0))}


def _tree_inputs(direction: str) -> dict[str, Column]:
    """The 15 inputs of the trees: nulls stay nulls."""
    plain = {"hour_of_week": F.col("hour_of_week"), "month": F.col("month"), "is_holiday": F.coalesce(F.col("is_holiday").cast("double"), F.lit(0.0))}
    plain |= {c: F.col(c) for c in NUMERIC} | {k: F.col(f"{direction}_{v}") for k, v in LAGS.items()}
    return plain | {c: F.coalesce(f"enc_{c}", F.col("enc_mean")) for c in ("station_enc", "zone_enc")}


def _inputs(direction: str) -> dict[str, Column]:
    """The regression's inputs, of rows with their encodings: nulls are 0."""
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    plain = {c: number(c) for c in NUMERIC} | {k: number(f"{direction}_{v}") for k, v in LAGS.items()}
    return plain | {c: F.coalesce(f"enc_{c}", F.col("enc_mean")) for c in ("station_enc", "zone_enc")} | _calendar()


@dataclass
class FittedDirection:
    """A fitted model with its encodings; predict() gives <direction>_D_hat.

    rows need station_id, zone_agg, interval_start's hour_of_week, month and
    is_holiday (missing: no holiday), NUMERIC, and the direction's lags.
    """

    direction: str
    model: BoostedTrees | PoissonRegression
    station: DataFrame
    zone: DataFrame
    overall: DataFrame

    def predict(self, rows: DataFrame) -> DataFrame:
        ready = model_columns(rows, self.direction, self.station, self.zone, self.overall, trees=isinstance(self.model, BoostedTrees))
        out = self.model.transform(ready).withColumn(f"{self.direction}_D_hat", F.greatest(F.col("in_prediction"), F.lit(0.0)))
        return out.select(*rows.columns, f"{self.direction}_D_hat")

    def save(self, path: str) -> None:
        self.model.save(self.station.sparkSession, f"{path}/model")
        for name in ("station", "zone", "overall"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    def parts(self, stations: DataFrame, weather: DataFrame, begin, steps: int) -> tuple[dict, np.ndarray, dict[str, float]]:
        """The regression's log rate taken apart: station_id to its part, the part of each step from begin, and weights of the lags.

        weather: an hour a row, with its lags. Only the Poisson regression is a sum of parts.
        """
        weight = dict(zip(self.model.features, self.model.weights, strict=True))
        overall = self.overall.first()["m"]
        one = lambda df, key: {r[key]: r.enc for r in df.collect()}
        by_station, by_zone = one(self.station, "station_id"), one(self.zone, "zone_agg")
        own = {
            r.station_id: self.model.intercept + weight["station_enc"] * by_station.get(r.station_id, overall) + weight["zone_enc"] * by_zone.get(r.zone_agg, overall) + weight["capacity"] * (r.capacity or 0)
            for r in stations.select("station_id", "zone_agg", "capacity").collect()
        }
        varying = {c: x for c, x in _inputs(self.direction).items() if c not in STATION and c not in LAGS}
        rows = _steps(weather, begin, steps).select("id", *[x.alias(c) for c, x in varying.items()]).orderBy("id").toPandas()
        return own, sum(weight[c] * rows[c].to_numpy(float) for c in varying), {k: weight[k] for k in LAGS}

    def inputs(self, stations: DataFrame, weather: DataFrame, begin, steps: int) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The trees' inputs that a simulation doesn't change: STATION by station_id, the others (but LAGS) by step from begin."""
        spark = stations.sparkSession
        known = stations.select("station_id", "zone_agg", "capacity").withColumns({c: F.lit(None).cast("double") for c in (*NUMERIC, *(f"{self.direction}_{v}" for v in LAGS.values())) if c != "capacity"} | {"hour_of_week": F.lit(0), "month": F.lit(0)})
        ready = model_columns(known, self.direction, self.station, self.zone, self.overall, trees=True)
        fixed = ready.select("station_id", *[F.col(f"in_{c}").cast("double").alias(c) for c in STATION]).toPandas().set_index("station_id")
        at = _steps(weather, begin, steps).withColumns({"enc_mean": F.lit(0.0), "enc_station_enc": F.lit(0.0), "enc_zone_enc": F.lit(0.0), "capacity": F.lit(0)} | {f"{self.direction}_{v}": F.lit(0.0) for v in LAGS.values()})
        varying = {c: x for c, x in _tree_inputs(self.direction).items() if c not in STATION and c not in LAGS}
        return fixed, at.select("id", *[x.cast("double").alias(c) for c, x in varying.items()]).orderBy("id").toPandas().drop(columns="id")


def _steps(weather: DataFrame, begin, steps: int) -> DataFrame:
    """id (a step from begin) with its calendar and weather; weather has an hour a row, with its lags."""
    from .panel import add_calendar, join_weather, us_federal_holidays

    spark = weather.sparkSession
    at = spark.range(steps).select("id", (F.lit(str(begin)).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 15).cast("int"))).alias("interval_start"))
    return join_weather(add_calendar(at, us_federal_holidays(spark, str(begin), str(begin + pd.Timedelta(minutes=15 * steps)))), weather)


def load_fitted(spark, direction: str, path: str) -> FittedDirection:
    kind = BoostedTrees if "trees" in json.loads(spark.read.parquet(f"{path}/model").first()["model"]) else PoissonRegression
    return FittedDirection(direction, kind.load(spark, f"{path}/model"), *(spark.read.parquet(f"{path}/{n}") for n in ("station", "zone", "overall")))


def model_columns(rows: DataFrame, direction: str, station: DataFrame, zone: DataFrame, overall: DataFrame, trees: bool = False) -> DataFrame:
    """rows with the inputs of one kind of model, as in_<name>; encodings of unseen stations and zones are the overall mean."""
    out = rows if "is_holiday" in rows.columns else rows.withColumn("is_holiday", F.lit(False))
    out = out.join(station.withColumnRenamed("enc", "enc_station_enc"), "station_id", "left").join(zone.withColumnRenamed("enc", "enc_zone_enc"), "zone_agg", "left").crossJoin(F.broadcast(overall.select(F.col("m").alias("enc_mean"))))
    return out.withColumns({f"in_{c}": x for c, x in (_tree_inputs if trees else _inputs)(direction).items()})


def fit(rows: DataFrame, direction: str, holdout_start: str | None = None, sample: int | None = None, seed: int = 0, kind: str = "poisson", boost: BoostParams = BoostParams()) -> FittedDirection:
    """A model of uncensored rows before holdout_start: kind "poisson" (Newton regression with log link) or "boosted" (histogram trees).

    Encodings use all training rows; with sample, the model uses an equal quota
    of rows of each month, in hash order.
    """
    target, flag, _ = DIRECTIONS[direction]
    train = rows.filter(~F.col(flag))
    if holdout_start:
        train = train.filter(F.col("interval_start") < F.lit(holdout_start).cast("timestamp_ntz"))
    station = train.groupBy("station_id").agg(F.avg(target).alias("enc"))
    zone = train.filter("zone_agg is not null").groupBy("zone_agg").agg(F.avg(target).alias("enc"))
    overall = train.agg(F.avg(target).alias("m"))
    if sample:
        train = month_quota_sample(train, sample, seed)
    trees = kind == "boosted"
    names = list((_tree_inputs if trees else _inputs)(direction))
    ready = model_columns(train, direction, station, zone, overall, trees).withColumn("in_label", F.col(target).cast("double"))
    inputs = stored(ready.select("in_label", *[F.col(f"in_{c}").cast("double").alias(f"in_{c}") for c in names]), f"{checkpoint_dir(rows.sparkSession)}/{uuid.uuid4().hex}")  # every pass reads them
    return FittedDirection(direction, fit_boosted(inputs, names, boost) if trees else fit_poisson(inputs, names), station, zone, overall)


def impute_months(features: DataFrame, fitted: dict[str, FittedDirection], bias: dict[str, DataFrame], folder: str, edges: tuple[int, ...] = (1, 4)) -> DataFrame:
    """The unmet table of all months, a month a folder; months that are there already (with a _SUCCESS mark) are not made again.

    A run that was broken off goes on with the month it was at.
    """
    spark = features.sparkSession
    month = F.date_format("interval_start", "yyyy-MM")
    months = sorted(r.m for r in features.select(month.alias("m")).distinct().collect())  # a dozen a year
    for m in months:
        if not exists(spark, f"{folder}/{m}/_SUCCESS"):
            rows = features.filter(month == m)
            for model in fitted.values():
                rows = model.predict(rows)
            unmet_table(rows, bias, edges).write.mode("overwrite").parquet(f"{folder}/{m}")
    return spark.read.parquet(*[f"{folder}/{m}" for m in months])


def month_quota_sample(rows: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """At most size rows, the same number from each month, chosen in the order of a seeded hash."""
    months = rows.select(F.date_format("interval_start", "yyyy-MM").alias("m")).distinct().count()
    w = W.partitionBy(F.date_format("interval_start", "yyyy-MM")).orderBy(F.xxhash64(F.lit(seed), "station_id", "interval_start"), "station_id", "interval_start")
    return rows.withColumn("nth_", F.row_number().over(w)).filter(F.col("nth_") <= max(1, size // max(1, months))).drop("nth_")
