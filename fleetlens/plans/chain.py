"""The stand-in chain: every intermediate table of the estimation over a data directory."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import allocate, demand, features, heatmap, inventory, od, panel, substitution, value, zones
from ..params import AllocationParams, DemandParams, Params, SimulationParams, ValueParams
from ..session import bucketed, checkpoint_dir, dealt_by_any_key, exists, tabled
from ..sources import standin, trips

#: Four weeks of events: fewer weeks are asked for, the last of them are held out, and a small budget and low levels suit the small docks.
STANDIN = Params(value=ValueParams(min_weeks=3, low_inventory=1.0), allocation=AllocationParams(budget=60.0), demand=DemandParams(holdout_start="2024-01-22"), simulation=SimulationParams(week_start="2024-01-08"))


class Chain:
    """The tables, lazy but for those that several others are made of.

    The inventory, features, rates, net losses, weekly cells, values of a bike and
    candidate moves are phase boundaries: they are computed once, when first asked for, and written
    to the checkpoint folder. Without that, each table above them would run them
    again. A session shares them between its queries (chain_of).
    """

    def __init__(self, spark: SparkSession, sf_dir: str, params: Params = STANDIN) -> None:
        self.spark, self.sf_dir, self.params = spark, sf_dir, params
        dealt_by_any_key(spark)
        self.written: list[str] = []
        self.made: dict = {}

    def once(self, name: str, make: Callable[[], Any]) -> Any:
        """What make gives, made once for the chain: models, networks and shares."""
        if name not in self.made:
            self.made[name] = make()
        return self.made[name]

    @cached_property
    def trips_raw(self) -> DataFrame:
        return standin.trips_raw(self.spark, self.sf_dir)

    @cached_property
    def trips(self) -> DataFrame:
        return trips.keep_valid(self.trips_raw, self.params.ingest)

    @cached_property
    def stations(self) -> DataFrame:
        return standin.stations(self.spark, self.sf_dir)

    @cached_property
    def weather(self) -> DataFrame:
        return standin.weather(self.spark, self.sf_dir)

    @cached_property
    def panel(self) -> DataFrame:
        return panel.add_calendar(panel.build_counts(self.trips, self.stations))

    @cached_property
    def usable(self) -> DataFrame:
        return inventory.usable_panel(self.panel)

    @cached_property
    def inventory(self) -> DataFrame:
        """The inventory with run lengths, which both the rates and the features take from it."""
        return self._stored(features.add_run_lengths(inventory.reconstruct_inventory(self.usable, self.params.inventory)), "interval_start")

    def _stored(self, df: DataFrame, order: str | None = None) -> DataFrame:
        """df, written once; with order: in buckets by station, sorted by it, so that joins, windows and groups by station need no shuffle."""
        self.written.append(f"{checkpoint_dir(self.spark)}/{uuid.uuid4().hex}")
        return bucketed(df, self.written[-1], "station_id", order) if order else tabled(df, self.written[-1])

    @cached_property
    def rated(self) -> DataFrame:
        """The inventory with the rates of both directions."""
        return self._stored(demand.add_all_rates(self.inventory), "interval_start")

    @cached_property
    def held_out(self) -> DataFrame:
        return self.rated.filter(F.col("interval_start") >= F.lit(self.params.demand.holdout_start).cast("timestamp_ntz"))

    @cached_property
    def calibration(self) -> dict[str, tuple[DataFrame, DataFrame]]:
        """Recovery and bias of each direction, on the held-out weeks."""
        p = self.params.demand
        return {d: demand.calibrate(self.held_out, d, p.runs_each, p.calibration_runs, p.min_bias_n, p.seed) for d in demand.DIRECTIONS}

    @cached_property
    def unmet(self) -> DataFrame:
        return demand.unmet_table(self.rated, {d: bias for d, (_, bias) in self.calibration.items()}, self.params.demand.run_edges)

    @cached_property
    def pairs(self) -> DataFrame:
        return zones.radius_pairs(self.stations, self.params.space.substitution_radius_m)

    @cached_property
    def net(self) -> DataFrame:
        return self._stored(substitution.add_substitution(self.unmet, self.pairs), "interval_start")

    @cached_property
    def zone_hour(self) -> DataFrame:
        return heatmap.zone_hour_net_lost(self.net)

    @cached_property
    def ci(self) -> DataFrame:
        return heatmap.per_dock_ci(self.net, heatmap.zone_capacity(self.stations), self.params.heatmap.z)

    @cached_property
    def features(self) -> DataFrame:
        return self._stored(features.build_features(self.inventory, self.weather))

    @cached_property
    def weekly(self) -> DataFrame:
        return self._stored(value.station_hour_week(self.net), "hour_of_week")

    @cached_property
    def rates(self) -> DataFrame:
        return value.station_hour_rates(self.weekly)

    @cached_property
    def low(self) -> DataFrame:
        return value.low_frequency(self.weekly, self.params.value)

    @cached_property
    def timing(self) -> DataFrame:
        chronic = self.low.filter(F.col("low_frac") > self.params.allocation.chronic_low)
        return value.chronic_timing(value.chronic_slots(self.unmet, chronic, self.params.value))

    @cached_property
    def cells(self) -> DataFrame:
        return self.rates.join(value.net_lost_given_stockout(self.weekly), value.CELL, "left")

    @cached_property
    def mv(self) -> DataFrame:
        return self._stored(value.mv_table(self.cells, self.params.value), "hour_of_week")

    @cached_property
    def od_rows(self) -> DataFrame:
        """A station's observed rows tell whether it is usable as well as all of its panel does."""
        observed = panel.join_station_metadata(panel.combine_observed(self.trips), self.stations)
        return od.od_trips(self.trips, self.stations, inventory.usable_panel(observed).select("station_id"), self.params.od)

    @cached_property
    def od_counts(self) -> dict[str, DataFrame]:
        return od.od_counts(self.od_rows)

    @cached_property
    def tiers(self) -> DataFrame:
        return allocate.assign_tiers(self.low, self.timing, self.params.allocation, self.params.value.modal_share)

    @cached_property
    def origins(self) -> DataFrame:
        return allocate.qualifying_origins(self.low, self.mv, self.params.allocation, self.params.value.k_max)

    @cached_property
    def cumulative(self) -> DataFrame:
        return allocate.dest_cumulative_mv(self.mv)

    @cached_property
    def flows(self) -> DataFrame:
        return od.normalize(self.od_counts["station_hour"], od.TIERS["station_hour"]).drop("n")

    def _moves(self, prefilter: int | None) -> DataFrame:
        return self._stored(allocate.candidate_moves(self.tiers, self.cumulative, self.origins, self.stations.select("station_id", "zone_agg"), self.flows, prefilter), "hour_of_week")

    @cached_property
    def moves(self) -> DataFrame:
        return self._moves(self.params.allocation.prefilter)

    @cached_property
    def all_moves(self) -> DataFrame:
        """The moves to every destination of any value, for the sweep over all of them."""
        return self._moves(None)

    @cached_property
    def options(self) -> DataFrame:
        return allocate.value_options(self.moves, self.cumulative, allocate.payout_grid(self.spark, self.params.allocation), self.params.allocation)

    @cached_property
    def ranked(self) -> DataFrame:
        return allocate.rank_targets(self.options)

    @cached_property
    def tops(self) -> DataFrame:
        p = self.params.allocation
        return allocate.elasticity_sweep(self.moves, self.cumulative, allocate.payout_grid(self.spark, p), allocate.elasticity_grid(self.spark, p), p)

    @cached_property
    def all_tops(self) -> DataFrame:
        """tops of all moves."""
        p = self.params.allocation
        return allocate.elasticity_sweep(self.all_moves, self.cumulative, allocate.payout_grid(self.spark, p), allocate.elasticity_grid(self.spark, p), p, self.moves)


def chain_over(spark: SparkSession, params: Params, trips: DataFrame, stations: DataFrame) -> Chain:
    """The chain over valid trips and a station table (station_id, capacity, lat, lng, zone_agg) of one's own; it has no weather."""
    chain = Chain(spark, "", params)
    chain.trips, chain.stations = trips, stations
    return chain


_chains: dict[tuple, Chain] = {}


def chain_of(spark: SparkSession, sf_dir: str, params: Params = STANDIN) -> Chain:
    """The session's chain over a data directory; a new one where what it has written is gone."""
    key = (spark.sparkContext.applicationId, sf_dir, params)
    if key not in _chains or not all(exists(spark, path) for path in _chains[key].written):
        _chains[key] = Chain(spark, sf_dir, params)
    return _chains[key]
