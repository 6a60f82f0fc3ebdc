"""Command line: python -m fleetlens ingest|unmet|allocate|report ... ; paths are whatever Spark reads."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .operators import allocate, compare, demand, features, inventory, panel
from .params import load_params
from .plans import chain
from .session import exists, get_session, resumed
from .sources import feeds, trips


def ingest(args: argparse.Namespace) -> None:
    """Trip files to valid trips, a folder a month; prints what was read, dropped by each rule and written."""
    params, spark = load_params(args.params), get_session("ingest")
    print(json.dumps(trips.write_counted(trips.read_trips(spark, args.trips), args.out, params.ingest)))


def unmet(args: argparse.Namespace) -> None:
    """Trip files to the unmet table, a folder a month; what is there already is not made again."""
    params, spark = load_params(args.params), get_session("unmet")
    rows = trips.keep_valid(trips.read_trips(spark, args.trips), params.ingest)
    stations, weather = spark.read.parquet(args.stations), feeds.read_weather(spark, args.weather)
    holidays = panel.us_federal_holidays(spark, args.first, args.last)
    usable = inventory.usable_panel(panel.add_calendar(panel.build_counts(rows, stations), holidays))
    if not exists(spark, f"{args.out}/inventory/_SUCCESS"):
        inventory.assert_constant_capacity(usable)
    table = resumed(inventory.reconstruct_inventory(usable, params.inventory), f"{args.out}/inventory")
    ready = resumed(features.build_features(table, weather), f"{args.out}/features")
    p = params.demand
    models, bias = {}, {}
    for d in demand.DIRECTIONS:
        models[d] = demand.fit(ready, d, p.holdout_start, p.sample_size, p.seed, args.kind)
        models[d].save(f"{args.out}/model-{d}")
        held = models[d].predict(ready.filter(F.col("interval_start") >= F.lit(p.holdout_start).cast("timestamp_ntz")))
        bias[d] = demand.calibrate(held, d, p.runs_each, p.calibration_runs, p.min_bias_n, p.seed)[1]
    demand.impute_months(ready, models, bias, f"{args.out}/unmet", p.run_edges)


def allocate_moves(args: argparse.Namespace) -> None:
    """Trip files to candidate moves, their ranking, what the budget funds, and how ranks hold over the elasticity sweep; prints the counts."""
    params, spark = load_params(args.params), get_session("allocate")
    rows = trips.keep_valid(trips.read_trips(spark, args.trips), params.ingest)
    c = chain.chain_over(spark, params, rows, spark.read.parquet(args.stations))
    p, written = params.allocation, {}

    def phase(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{args.out}/{name}"
        written[name] = spark.read.parquet(path) if exists(spark, f"{path}/_SUCCESS") else resumed(make(), path)
        return written[name]

    phase("moves", lambda: c.moves)
    ranking = phase("ranking", lambda: c.ranked)
    phase("funded", lambda: allocate.budget_cutoff(ranking, p.budget))
    tops = phase("tops", lambda: c.tops)
    phase("stability", lambda: allocate.spearman_stability(tops))
    phase("core", lambda: allocate.stable_core(tops, p.sweep_a[2] * p.sweep_b[2]))
    print(json.dumps({name: table.count() for name, table in written.items()}))


def report(args: argparse.Namespace) -> None:
    """Written results of replicates to a Markdown report."""
    spark = get_session("report")
    print(compare.report(spark.read.parquet(args.results), spark.read.parquet(args.treated), args.budget))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="fleetlens", description=__doc__)
    commands = parser.add_subparsers(required=True)
    zero = commands.add_parser("ingest", help=ingest.__doc__)
    zero.add_argument("--trips", nargs="+", required=True, help="CSV files of either layout")
    zero.add_argument("--out", required=True)
    zero.add_argument("--params")
    zero.set_defaults(run=ingest)
    one = commands.add_parser("unmet", help=unmet.__doc__)
    one.add_argument("--trips", nargs="+", required=True, help="CSV files of either layout")
    for name in ("stations", "weather", "out", "first", "last"):
        one.add_argument(f"--{name}", required=True)
    one.add_argument("--params")
    one.add_argument("--kind", choices=("poisson", "boosted"), default="boosted")
    one.set_defaults(run=unmet)
    more = commands.add_parser("allocate", help=allocate_moves.__doc__)
    more.add_argument("--trips", nargs="+", required=True, help="CSV files of either layout")
    for name in ("stations", "out"):
        more.add_argument(f"--{name}", required=True)
    more.add_argument("--params")
    more.set_defaults(run=allocate_moves)
    two = commands.add_parser("report", help=report.__doc__)
    for name in ("results", "treated"):
        two.add_argument(f"--{name}", required=True)
    two.add_argument("--budget", type=float, required=True)
    two.set_defaults(run=report)
    args = parser.parse_args(argv)
    args.run(args)


if __name__ == "__main__":
    main()
