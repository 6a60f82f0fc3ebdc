"""How much of the unmet demand moved to neighbouring stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .demand import DIRECTIONS


def estimate_substitution(unmet: DataFrame, pairs: DataFrame, direction: str) -> DataFrame:
    """station_id, interval_start, <d>_displaced, <d>_net_lost of the stockout rows.

    A neighbour's uplift, max(0, observed - D_hat), or 0 while it is censored
    itself, is split among the stockouts around it in proportion to their gross
    unmet demand; a stockout displaces no more than its gross. Only rows with an
    uplift, at most one a trip, meet the neighbour edges, and then the stockouts:
    stockouts times their neighbours would be many times the panel.
    """
    target, flag, _ = DIRECTIONS[direction]
    gross = f"{direction}_gross_unmet"
    out = unmet.filter(F.col(flag)).select("station_id", "interval_start", F.col(gross).alias("gross"))
    uplift = F.when(F.col(flag), 0.0).otherwise(F.greatest(F.lit(0.0), F.col(target) - F.col(f"{direction}_D_hat")))
    near = unmet.select(F.col("station_id").alias("neighbor_id"), "interval_start", uplift.alias("uplift")).filter("uplift > 0")
    met = out.join(near.join(pairs.select("station_id", "neighbor_id"), "neighbor_id"), ["station_id", "interval_start"])
    competing = F.sum("gross").over(W.partitionBy("neighbor_id", "interval_start"))
    share = met.withColumn("part", F.coalesce(F.try_divide(F.col("uplift") * F.col("gross"), competing), F.lit(0.0)))
    got = share.groupBy("station_id", "interval_start").agg(F.sum("part").alias("got"))
    joined = out.join(got, ["station_id", "interval_start"], "left")
    displaced = F.least("gross", F.coalesce("got", F.lit(0.0)))
    return joined.select("station_id", "interval_start", displaced.alias(f"{direction}_displaced"), (F.col("gross") - displaced).alias(f"{direction}_net_lost"))


def add_substitution(unmet: DataFrame, pairs: DataFrame) -> DataFrame:
    """unmet with displaced and net_lost of both directions, 0 where there is no stockout."""
    out = unmet
    for d in DIRECTIONS:
        out = out.join(estimate_substitution(unmet, pairs, d), ["station_id", "interval_start"], "left").fillna(0.0, [f"{d}_displaced", f"{d}_net_lost"])
    return out


def summarize_displaced(net: DataFrame) -> DataFrame:
    """direction, gross, displaced, net_lost and the latter two as fractions."""
    sums = net.agg(*[F.sum(f"{d}_{c}").alias(f"{d}_{c}") for d in DIRECTIONS for c in ("gross_unmet", "displaced", "net_lost")])
    rows = F.array(*[F.struct(F.lit(d).alias("direction"), *[F.col(f"{d}_{c}").alias(o) for c, o in (("gross_unmet", "gross"), ("displaced", "displaced"), ("net_lost", "net_lost"))]) for d in DIRECTIONS])
    return sums.select(F.explode(rows).alias("r")).select("r.*").withColumns({"displaced_fraction": F.try_divide("displaced", "gross"), "net_lost_fraction": F.try_divide("net_lost", "gross")})
