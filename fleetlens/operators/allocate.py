"""Tiers, origins, candidate moves, ranking, budget and the elasticity sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.columns import induced_trips, pearson
from ..params import AllocationParams, ValueParams

CELL = ["station_id", "hour_of_week"]


def assign_tiers(low: DataFrame, timing: DataFrame, params: AllocationParams = AllocationParams(), modal: float = ValueParams().modal_share) -> DataFrame:
    """Cells that are ever low: tier 1 if chronic at a steady time, else tier 2."""
    joined = low.filter("low_frac > 0").join(timing.select(*CELL, "modal_share"), CELL, "left")
    first = (F.col("low_frac") > params.chronic_low) & (F.col("modal_share") >= modal)
    return joined.select(*CELL, "low_frac", "modal_share", F.when(first, 1).otherwise(2).alias("tier"))


def qualifying_origins(low: DataFrame, mv: DataFrame, params: AllocationParams = AllocationParams(), k_max: int = 4) -> DataFrame:
    """Cells that are seldom low, with the value of the bike they would give up (0 where it has none)."""
    k = F.greatest(F.bround(F.least("min_inventory", F.lit(float(k_max)))), F.lit(1.0)).cast("int")
    own = low.filter(F.col("low_frac") <= params.origin_max_low).select(*CELL, "min_inventory", k.alias("k"))
    return own.join(mv.select(*CELL, "k", "mv"), [*CELL, "k"], "left").select(*CELL, "min_inventory", F.coalesce("mv", F.lit(0.0)).alias("origin_cost"))


def dest_cumulative_mv(mv: DataFrame) -> DataFrame:
    """station_id, hour_of_week, k, cum_mv, k_max."""
    w = W.partitionBy(*CELL)
    return mv.select(*CELL, "k", F.sum("mv").over(w.orderBy("k").rowsBetween(W.unboundedPreceding, 0)).alias("cum_mv"), F.max("k").over(w).alias("k_max"))


def candidate_moves(tiers: DataFrame, cumulative: DataFrame, origins: DataFrame, zones: DataFrame, flows: DataFrame, prefilter: int | None = 3000) -> DataFrame:
    """The destinations with the highest ceilings (prefilter None: all of them), each with its cheapest plausible origin.

    An origin is plausible in the same zone or with a flow to the destination
    in that hour. The OR is written as a union of two equi-joins, which stay
    hash joins; flows are start_station_id, hour_of_week, end_station_id, prob.
    """
    ceiling = cumulative.filter("k = k_max").select(*CELL, "k_max", F.col("cum_mv").alias("ceiling"))
    dest = tiers.join(ceiling, CELL).filter(F.round("ceiling", 9) > 0)
    if prefilter is not None:
        dest = dest.orderBy(F.round("ceiling", 9).desc(), *CELL).limit(prefilter)
    dest = dest.join(zones, "station_id", "left")
    src = origins.join(zones, "station_id", "left").select(F.col("station_id").alias("origin_station_id"), "hour_of_week", "origin_cost", F.col("zone_agg").alias("origin_zone"))
    edge = flows.select(F.col("start_station_id").alias("origin_station_id"), "hour_of_week", F.col("end_station_id").alias("station_id"), F.col("prob").alias("flow_prob"))
    names = [*CELL, "origin_station_id", "origin_cost"]
    d, s = dest.alias("d"), src.alias("s")
    same = d.join(s, (F.col("d.hour_of_week") == F.col("s.hour_of_week")) & (F.col("d.zone_agg") == F.col("s.origin_zone"))).filter("d.station_id != s.origin_station_id").select("d.station_id", "d.hour_of_week", "origin_station_id", "origin_cost")
    flowing = dest.select(*CELL).join(edge.filter("flow_prob > 0"), CELL).join(src, ["origin_station_id", "hour_of_week"]).filter("station_id != origin_station_id").select(*names)
    pairs = same.union(flowing).distinct().join(edge, [*CELL, "origin_station_id"], "left").fillna(0.0, ["flow_prob"])
    best = W.partitionBy(*CELL).orderBy(F.round("origin_cost", 9), F.round("flow_prob", 9).desc(), "origin_station_id")
    chosen = pairs.withColumn("nth", F.row_number().over(best)).filter("nth = 1").drop("nth")
    return dest.select(*CELL, "tier", "low_frac", "k_max").join(chosen, CELL)


def payout_grid(spark: SparkSession, params: AllocationParams = AllocationParams()) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {', '.join(f'(cast({p} as double))' for p in params.payouts)} AS t(payout)")


def value_options(moves: DataFrame, cumulative: DataFrame, payouts: DataFrame, params: AllocationParams = AllocationParams(), draws: DataFrame | None = None) -> DataFrame:
    """Every candidate x payout (x draw of elasticities a1, b1, a2, b2): induced, value, dollar_cost, nvpd.

    A move meets its cell's values once and takes them along, so that the grid is
    neither shuffled nor sorted.
    """
    one = lambda i: F.when(F.col("tier") == 1, F.lit(params.tier1[i])).otherwise(F.lit(params.tier2[i]))
    curves = cumulative.groupBy(*CELL).agg(F.map_from_entries(F.collect_list(F.struct("k", "cum_mv"))).alias("curve_"))
    grid = moves.join(curves, CELL).crossJoin(F.broadcast(payouts))
    if draws is not None:
        grid = grid.crossJoin(F.broadcast(draws))
        one = lambda i: F.when(F.col("tier") == 1, F.col(("a1", "b1")[i])).otherwise(F.col(("a2", "b2")[i]))
    grid = grid.withColumn("induced", induced_trips(F.col("payout"), one(0), one(1)))
    grid = grid.withColumn("k", F.greatest(F.lit(1), F.least(F.bround("induced").cast("int"), F.col("k_max"))))
    out = grid.withColumn("cum_mv", F.try_element_at("curve_", F.col("k"))).drop("curve_").filter("cum_mv is not null")
    out = out.withColumn("value", F.col("cum_mv") - F.col("induced") * F.col("origin_cost")).withColumn("dollar_cost", F.col("induced") * F.col("payout") * params.dollars_per_point)
    return out.withColumn("nvpd", F.try_divide(F.col("value") - F.col("dollar_cost"), F.col("dollar_cost")))


def rank_targets(options: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The best payout of each cell, ranked by net value per dollar (within by)."""
    by = by or []
    worth = F.round("nvpd", 9).desc_nulls_last()  # ties are ties, whatever the order of a sum
    best = W.partitionBy(*by, *CELL).orderBy(worth, "payout")
    order = (W.partitionBy(*by) if by else W.partitionBy()).orderBy(worth, *CELL)
    return options.withColumn("nth", F.row_number().over(best)).filter("nth = 1").drop("nth").withColumn("rank", F.row_number().over(order))


def budget_cutoff(ranked: DataFrame, budget: float, by: list[str] | None = None) -> DataFrame:
    """The leading rows whose running cost stays within the budget (within by)."""
    running = F.sum("dollar_cost").over(W.partitionBy(*(by or [])).orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return ranked.withColumn("running_cost", running).filter(F.col("running_cost") <= budget)


def elasticity_grid(spark: SparkSession, params: AllocationParams = AllocationParams()) -> DataFrame:
    """draw, a1, b1, a2, b2: the product of two even grids, for both tiers alike."""
    def steps(low: float, high: float, n: int) -> list[float]:
        return [low + (high - low) * i / (n - 1) for i in range(n)]

    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in steps(*params.sweep_a) for b in steps(*params.sweep_b))]
    values = ", ".join(f"({i}, cast({a!r} as double), cast({b!r} as double), cast({a!r} as double), cast({b!r} as double))" for i, a, b in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(draw, a1, b1, a2, b2)")


def elasticity_sweep(moves: DataFrame, cumulative: DataFrame, payouts: DataFrame, draws: DataFrame, params: AllocationParams = AllocationParams(), some: DataFrame | None = None) -> DataFrame:
    """draw, station_id, hour_of_week, rank: the top of every draw's ranking, in one job.

    some: a few of the moves. What the last of their own top is worth, every move
    of the whole top reaches, so others are left out before anything is sorted;
    a draw in which some are too few for a top leaves none out.
    """
    options = value_options(moves, cumulative, payouts, params, draws)
    if some is not None:
        worth = F.round("nvpd", 9)
        last = rank_targets(value_options(some, cumulative, payouts, params, draws), ["draw"]).filter(F.col("rank") == params.top_n).select("draw", worth.alias("bar_"))
        options = options.join(F.broadcast(last), "draw", "left").filter(F.col("bar_").isNull() | (worth >= F.col("bar_"))).drop("bar_")
    ranked = rank_targets(options, ["draw"])
    return ranked.filter(F.col("rank") <= params.top_n).select("draw", *CELL, "rank")


def spearman_stability(tops: DataFrame) -> DataFrame:
    """draw_i, draw_j, n_common, rho of the ranks (renumbered) of the cells that two draws share; null below two."""
    a = tops.select(F.col("draw").alias("draw_i"), *CELL, F.col("rank").alias("ri"))
    b = tops.select(F.col("draw").alias("draw_j"), *CELL, F.col("rank").alias("rj"))
    both = a.join(b, CELL).filter("draw_i < draw_j")
    pair = W.partitionBy("draw_i", "draw_j")
    again = both.withColumns({"pi": F.row_number().over(pair.orderBy("ri")), "pj": F.row_number().over(pair.orderBy("rj"))})
    return again.groupBy("draw_i", "draw_j").agg(F.count("*").alias("n_common"), F.when(F.count("*") >= 2, pearson("pi", "pj")).alias("rho"))


def stable_core(tops: DataFrame, n_draws: int) -> DataFrame:
    """station_id, hour_of_week, appearance_frac over the draws."""
    return tops.groupBy(*CELL).agg((F.count("*") / n_draws).alias("appearance_frac"))


def stability_table(pairs: DataFrame, core: DataFrame) -> DataFrame:
    """One row behind the figure of rank stability: pairs of draws with a correlation, its least and median; cells that ever rank, and those that do in every draw."""
    rho = pairs.filter("rho is not null").agg(F.count("*").alias("n_pairs"), F.min("rho").alias("least_rho"), F.median("rho").alias("median_rho"))
    cells = core.agg(F.count("*").alias("cells"), F.count_if(F.col("appearance_frac") == 1).alias("in_every_draw"))
    return rho.crossJoin(F.broadcast(cells))


def appearance_counts(core: DataFrame) -> DataFrame:
    """appearance_frac, cells: the bars of that figure, counted."""
    return core.groupBy("appearance_frac").agg(F.count("*").alias("cells"))
