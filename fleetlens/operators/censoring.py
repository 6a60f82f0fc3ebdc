"""Artificial censoring: runs of known demand are capped, to measure what the imputation recovers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import quantile_bucket, upper_bucket
from .quantiles import exact_quantiles, grouped_rank


def shuffle_key(seed: int, *columns: Column) -> Column:
    """A fixed pseudo-random order of integers that other SQL engines can repeat: modular multiplication. Text that is no integer counts by its crc32."""
    out = F.lit(seed + 1).cast("bigint")
    for c in columns:
        out = (out * 48271 + F.coalesce(c.try_cast("bigint"), F.crc32(c.cast("string").cast("binary"))) * 16807 + 11) % 2147483647
    return out


def synthetic_runs(free: DataFrame, target: str, lengths: Sequence[int], runs_each: int, seed: int = 0, cap_quantile: float = 0.1) -> DataFrame:
    """station_id, interval_start, true_D, censored_Y, synthetic_run_length.

    For every length L, up to runs_each stations with more than L rows are
    chosen in shuffled order; a run of L neighbouring rows of each, from a
    shuffled start, is capped at the station's quantile. free holds uncensored
    rows, so a run may bridge a censored stretch.
    """
    rows = free.select("station_id", "interval_start", F.col(target).alias("true_D"))
    rows = rows.withColumn("pos", F.row_number().over(W.partitionBy("station_id").orderBy("interval_start")) - 1)
    per = grouped_rank(rows, ["station_id"], "true_D", F.bround((F.col("n") - 1) * cap_quantile), "cap")
    wanted = per.withColumn("L", F.explode(F.array(*[F.lit(x) for x in lengths]))).filter("n > L")
    order = W.partitionBy("L").orderBy(shuffle_key(seed, F.col("L"), F.col("station_id")), "station_id")
    chosen = wanted.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= runs_each)
    chosen = chosen.withColumn("start", shuffle_key(seed + 7, F.col("station_id"), F.col("L")) % (F.col("n") - F.col("L") + 1))
    places = chosen.select("station_id", "cap", "L", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("L") - 1)).alias("pos"))
    return rows.join(places, ["station_id", "pos"]).select("station_id", "interval_start", "true_D", F.least("true_D", "cap").alias("censored_Y"), F.col("L").alias("synthetic_run_length"))


def evaluate_recovery(rows: DataFrame, estimate: str = "D_hat", truth: str = "true_D", run: str = "synthetic_run_length", edges: Sequence[int] = (1, 4)) -> DataFrame:
    """stratum (overall, bucket, stale), run_length_bucket, is_capacity_stale, mae, bias, n, in one pass over grouping sets.

    The error is that of the imputed gap, max(0, estimate - censored_Y), against the true one, truth - censored_Y.
    """
    error = F.greatest(F.lit(0.0), F.col(estimate) - F.col("censored_Y")) - (F.col(truth) - F.col("censored_Y"))
    cut = rows.withColumns({"run_length_bucket": upper_bucket(F.col(run), edges), "e_": error})
    grouped = cut.groupingSets([[], ["run_length_bucket"], ["is_capacity_stale"]], "run_length_bucket", "is_capacity_stale").agg(
        F.grouping("run_length_bucket").alias("gb"), F.grouping("is_capacity_stale").alias("gs"), F.avg(F.abs("e_")).alias("mae"), F.avg("e_").alias("bias"), F.count("*").alias("n")
    )
    stratum = F.when(F.col("gb") == 0, "bucket").when(F.col("gs") == 0, "stale").otherwise("overall")
    return grouped.select(stratum.alias("stratum"), "run_length_bucket", "is_capacity_stale", "mae", "bias", "n")


def stratum_edges(target_rows: DataFrame, value: str = "D_hat", capacity: str = "capacity", deciles: int = 10, bands: int = 4) -> DataFrame:
    """One row of exact quantile edges of the target population (found at once, by passes over digits)."""
    found = exact_quantiles(target_rows, {value: [i / deciles for i in range(1, deciles)], capacity: [i / bands for i in range(1, bands)]})
    return target_rows.sparkSession.createDataFrame([(found[value], found[capacity])], "d_edges array<double>, c_edges array<double>")


def assign_strata(rows: DataFrame, edges: DataFrame, value: str = "D_hat", capacity: str = "capacity") -> DataFrame:
    """rows with stratum "decile_band_hour"."""
    cut = rows.crossJoin(F.broadcast(edges))
    key = F.concat_ws("_", quantile_bucket(F.col(value), F.col("d_edges")), quantile_bucket(F.col(capacity), F.col("c_edges")), "hour_of_week")
    return cut.withColumn("stratum", key).drop("d_edges", "c_edges")


def stratum_proportions(rows: DataFrame) -> DataFrame:
    return rows.groupBy("stratum").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy()))


def matched_runs(pool: DataFrame, proportions: DataFrame, lengths: Sequence[int], runs_each: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(run starts: station_id, pos, stratum, synthetic_run_length; coverage: stratum, length, target_mass, desired, taken).

    Each (length, stratum) gets round(p * runs_each) starts, fewer if the pool
    has fewer; shortfalls are reported and never filled from other strata. A
    row may start a run if the longest one fits behind it.
    """
    longest = max(lengths)
    rows = pool.withColumn("pos", F.row_number().over(W.partitionBy("station_id").orderBy("interval_start")) - 1)
    rows = rows.withColumn("n_rows", F.count("*").over(W.partitionBy("station_id"))).filter(F.col("pos") <= F.col("n_rows") - longest)
    rows = rows.withColumn("length", F.explode(F.array(*[F.lit(x) for x in lengths])))
    want = proportions.select("stratum", F.col("p").alias("target_mass"), F.bround(F.col("p") * runs_each).cast("bigint").alias("desired"))
    order = W.partitionBy("length", "stratum").orderBy(shuffle_key(seed, F.col("length"), F.col("station_id"), F.col("pos")), "station_id", "pos")
    taken = rows.join(want, "stratum").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= F.col("desired"))
    starts = taken.select("station_id", "pos", "stratum", F.col("length").alias("synthetic_run_length"))
    wanted = want.withColumn("length", F.explode(F.array(*[F.lit(x) for x in lengths])))
    coverage = wanted.join(taken.groupBy("stratum", "length").agg(F.count("*").alias("taken")), ["stratum", "length"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    return starts, coverage.select("stratum", "length", "target_mass", "desired", "taken")


def runs_from(pool: DataFrame, starts: DataFrame, target: str, cap_quantile: float = 0.1) -> DataFrame:
    """The rows of matched_runs' starts, capped as in synthetic_runs: station_id, interval_start, true_D, censored_Y, synthetic_run_length."""
    rows = pool.select("station_id", "interval_start", F.col(target).alias("true_D"))
    rows = rows.withColumn("pos", F.row_number().over(W.partitionBy("station_id").orderBy("interval_start")) - 1)
    caps = grouped_rank(rows, ["station_id"], "true_D", F.bround((F.col("n") - 1) * cap_quantile), "cap").drop("n")
    places = starts.select("station_id", "synthetic_run_length", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("synthetic_run_length") - 1)).alias("pos"))
    return rows.join(places, ["station_id", "pos"]).join(caps, "station_id").select("station_id", "interval_start", "true_D", F.least("true_D", "cap").alias("censored_Y"), "synthetic_run_length")


def coverage_by_decile(coverage: DataFrame) -> DataFrame:
    """decile, target_mass (of its strata, each once), desired, taken, fill_rate."""
    decile = F.element_at(F.split("stratum", "_"), 1).cast("int").alias("decile")
    mass = coverage.select("stratum", "target_mass").distinct().groupBy(decile).agg(F.sum("target_mass").alias("target_mass"))
    sums = coverage.groupBy(decile).agg(F.sum("desired").alias("desired"), F.sum("taken").alias("taken"))
    return mass.join(sums, "decile").withColumn("fill_rate", F.try_divide("taken", "desired"))
