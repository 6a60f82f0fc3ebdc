"""Origin-destination shares with back-off."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.columns import daypart, hour_of_week
from ..params import OdParams
from ..session import shuffle_partitions

#: Keys of each tier, the most specific first.
TIERS = {
    "station_hour": ["start_station_id", "hour_of_week"],
    "zone_hour": ["start_zone_agg", "hour_of_week"],
    "zone_daypart": ["start_zone_agg", "daypart"],
    "global": [],
}


def od_trips(trips: DataFrame, stations: DataFrame, usable: DataFrame, params: OdParams = OdParams()) -> DataFrame:
    """start_station_id, start_zone_agg, hour_of_week, daypart, end_station_id of trips that end at a usable station."""
    zones = stations.select(F.col("station_id").alias("start_station_id"), F.col("zone_agg").alias("start_zone_agg"))
    kept = trips.join(usable.select(F.col("station_id").alias("end_station_id")).distinct(), "end_station_id", "left_semi")
    how = hour_of_week(F.col("started_at"))
    return kept.select("start_station_id", "end_station_id", how.alias("hour_of_week")).withColumn("daypart", daypart(F.col("hour_of_week"), params.daypart_edges)).join(zones, "start_station_id", "left")


def od_counts(rows: DataFrame) -> dict[str, DataFrame]:
    """n by tier key and destination. The finest counts are made once and summed up for the other tiers.

    Few trips share all keys, so a task holds about a row a trip: they are dealt to as many tasks as there are shuffle partitions.
    """
    fine = rows.repartition(shuffle_partitions(rows.sparkSession), "start_station_id", "hour_of_week").groupBy("start_station_id", "start_zone_agg", "hour_of_week", "daypart", "end_station_id").agg(F.count("*").alias("n"))
    out = {}
    for tier, keys in TIERS.items():
        own = fine.filter(F.col("start_zone_agg").isNotNull()) if "start_zone_agg" in keys else fine
        out[tier] = own.groupBy(*keys, "end_station_id").agg(F.sum("n").alias("n"))
    return out


def normalize(counts: DataFrame, keys: list[str]) -> DataFrame:
    """prob = n over the key's total; without a key the total is joined, as a window would hold all rows in one task."""
    if not keys:
        return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total_")))).withColumn("prob", F.col("n") / F.col("total_")).drop("total_")
    return counts.withColumn("prob", F.col("n") / F.sum("n").over(W.partitionBy(*keys)))


def od_probabilities(counts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {tier: normalize(c, TIERS[tier]) for tier, c in counts.items()}


def cell_tier(counts: dict[str, DataFrame], stations: DataFrame, params: OdParams = OdParams()) -> DataFrame:
    """station_id, hour_of_week, tier: the most specific tier with enough trips, for every station and hour."""
    total = {t: c.groupBy(*TIERS[t]).agg(F.sum("n").alias(f"n_{t}")) for t, c in counts.items() if t != "global"}
    hours = F.explode(F.sequence(F.lit(0), F.lit(167))).alias("hour_of_week")
    cells = stations.select(F.col("station_id").alias("start_station_id"), F.col("zone_agg").alias("start_zone_agg"), hours)
    cells = cells.withColumn("daypart", daypart(F.col("hour_of_week"), params.daypart_edges))
    for t, sums in total.items():
        cells = cells.join(sums, TIERS[t], "left")
    tier = F.lit("global")
    for t in reversed(list(total)):
        tier = F.when(F.col(f"n_{t}") >= params.min_trips, t).otherwise(tier)
    return cells.select(F.col("start_station_id").alias("station_id"), "hour_of_week", tier.alias("tier"))


@dataclass
class Shares:
    """The shares of one network as arrays: all distributions end to end, each cumulated within its own unit interval."""

    #: Distribution of each [station, hour of week], -1 where there is none.
    of: np.ndarray
    ends: np.ndarray
    cumulated: np.ndarray
    ids: list

    def draw(self, rng: np.random.Generator, origins: np.ndarray, how: int) -> np.ndarray:
        """A destination (station number) for each origin, all in one search; a missing distribution or an end outside the network raises."""
        own = self.of[origins, how]
        if (own < 0).any():
            raise KeyError(f"no distribution for station {self.ids[origins[own < 0][0]]} at hour {how}")
        got = self.ends[np.searchsorted(self.cumulated, own + rng.random(len(own)), "right")]
        if (got < 0).any():
            raise KeyError("a destination is outside the network")
        return got


@dataclass
class OdSampler:
    """Destination shares for tasks to draw from: (destinations, probabilities) by tier and key."""

    shares: dict[str, dict[tuple, tuple[np.ndarray, np.ndarray]]]
    tier_of: dict[tuple, str]
    zone_of: dict
    edges: tuple[int, ...] = OdParams().daypart_edges

    def key(self, tier: str, station, how: int) -> tuple:
        part = sum(how % 24 >= e for e in self.edges) + (len(self.edges) + 1 if how >= 120 else 0)
        return {"station_hour": (station, how), "zone_hour": (self.zone_of.get(station), how), "zone_daypart": (self.zone_of.get(station), part), "global": ()}[tier]

    def draw(self, rng: np.random.Generator, station, how: int, n: int) -> tuple[np.ndarray, str]:
        """n destinations and the tier; an unseen origin uses the global one; a missing distribution raises."""
        tier = self.tier_of.get((station, how), "global")
        found = self.shares[tier].get(self.key(tier, station, how))
        if found is None:
            raise KeyError(f"no {tier} distribution for station {station} at hour {how}")
        return np.repeat(found[0], rng.multinomial(n, found[1])), tier

    def bound(self, ids: list) -> Shares:
        """The shares as arrays over these stations."""
        index = {s: i for i, s in enumerate(ids)}
        number, ends, cumulated = {}, [], []
        for tier, by_key in self.shares.items():
            for key, (stations, p) in by_key.items():
                number[tier, key] = at = len(number)
                ends.append(np.array([index.get(s, -1) for s in stations], np.int64))
                top = at + np.cumsum(p)
                top[-1] = at + 1
                cumulated.append(top)
        of = np.full((len(ids), 168), -1, np.int64)
        for i, station in enumerate(ids):
            for how in range(168):
                tier = self.tier_of.get((station, how), "global")
                of[i, how] = number.get((tier, self.key(tier, station, how)), -1)
        return Shares(of, np.concatenate(ends) if ends else np.zeros(0, np.int64), np.concatenate(cumulated) if cumulated else np.zeros(0), ids)


def sampler(probabilities: dict[str, DataFrame], tiers: DataFrame, stations: DataFrame) -> OdSampler:
    """Collects the sparse shares of one network (bounded by its cells that have trips) for tasks to draw from."""
    shares: dict[str, dict] = {}
    for tier, df in probabilities.items():
        keys = TIERS[tier]
        shares[tier] = {}
        grouped = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("end_station_id", "prob"))).alias("d"))
        table = grouped.toArrow().combine_chunks()  # by columns: a station is read as a slice of arrays
        if table.num_rows:
            lists = table.column("d").combine_chunks()
            lists = lists.chunk(0) if hasattr(lists, "num_chunks") else lists
            at, ends, probs = lists.offsets.to_numpy(), lists.values.field("end_station_id").to_numpy(zero_copy_only=False), lists.values.field("prob").to_numpy()
            named = zip(*(table.column(k).to_pylist() for k in keys), strict=True) if keys else [()] * table.num_rows  # the global tier has no key
            for i, key in enumerate(named):
                p = probs[at[i] : at[i + 1]]
                shares[tier][key] = (ends[at[i] : at[i + 1]], p / p.sum())
    levels = tiers.select("station_id", "hour_of_week", "tier").toArrow()
    tier_of = dict(zip(zip(levels.column("station_id").to_pylist(), levels.column("hour_of_week").to_pylist(), strict=True), levels.column("tier").to_pylist(), strict=True))
    return OdSampler(shares, tier_of, {r.station_id: r.zone_agg for r in stations.collect()})
