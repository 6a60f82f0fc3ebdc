"""Parameters of the chain, with their defaults. Fixed values shared by all modules."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class IngestParams:
    min_duration_s: int = 60
    self_loop_min_s: int = 120


@dataclass(frozen=True)
class InventoryParams:
    prior_weight: float = 2.0
    first_fraction: float = 0.5
    epsilon: float = 1e-6


@dataclass(frozen=True)
class DemandParams:
    run_edges: tuple[int, ...] = (1, 4)
    holdout_start: str = "2025-10-01"
    sample_size: int = 8_000_000
    seed: int = 0
    lag_rows: int = 4
    week_rows: int = 672
    calibration_runs: tuple[int, ...] = (1, 2, 3, 4, 6, 8, 12)
    runs_each: int = 300
    min_bias_n: int = 20
    cap_quantile: float = 0.1
    deciles: int = 10
    capacity_bands: int = 4


@dataclass(frozen=True)
class SpaceParams:
    substitution_radius_m: float = 400.0
    linkage_m: float = 700.0
    box_lng: float = -74.02
    box_lat: float = 40.68


@dataclass(frozen=True)
class OdParams:
    min_trips: int = 30
    daypart_edges: tuple[int, ...] = (7, 10, 16, 19, 22)


@dataclass(frozen=True)
class SimulationParams:
    reroute_max_m: float = 1000.0
    reroute_max_hops: int = 3
    seed: int = 0
    week_start: str = "2025-10-06"
    steps: int = 672


@dataclass(frozen=True)
class ValueParams:
    min_weeks: int = 10
    window_minutes: int = 60
    k_max: int = 4
    modal_share: float = 0.7
    low_inventory: float = 4.0


@dataclass(frozen=True)
class AllocationParams:
    dollars_per_point: float = 0.20
    budget: float = 10_000.0
    tier1: tuple[float, float] = (2.0, 0.15)
    tier2: tuple[float, float] = (3.0, 0.25)
    move_cap: float = 3.0
    origin_max_low: float = 0.10
    chronic_low: float = 0.5
    payouts: tuple[int, ...] = (1, 2, 5, 10, 20, 30, 50)
    prefilter: int = 3000
    top_n: int = 100
    sweep_a: tuple[float, float, int] = (1.0, 5.0, 5)
    sweep_b: tuple[float, float, int] = (0.05, 0.5, 5)
    flat_payout: float = 10.0


@dataclass(frozen=True)
class HeatmapParams:
    z: float = 1.96
    top: int = 40


@dataclass(frozen=True)
class Params:
    ingest: IngestParams = field(default_factory=IngestParams)
    inventory: InventoryParams = field(default_factory=InventoryParams)
    demand: DemandParams = field(default_factory=DemandParams)
    space: SpaceParams = field(default_factory=SpaceParams)
    od: OdParams = field(default_factory=OdParams)
    simulation: SimulationParams = field(default_factory=SimulationParams)
    value: ValueParams = field(default_factory=ValueParams)
    allocation: AllocationParams = field(default_factory=AllocationParams)
    heatmap: HeatmapParams = field(default_factory=HeatmapParams)


def load_params(path: str | Path | None = None) -> Params:
    """Defaults, overridden section by section from a YAML file; unknown names raise."""
    if path is None:
        return Params()
    import yaml

    given: dict[str, dict[str, Any]] = yaml.safe_load(Path(path).read_text()) or {}
    sections = {f.name: f.default_factory for f in fields(Params)}
    if unknown := set(given) - set(sections):
        raise KeyError(f"unknown sections: {sorted(unknown)}")
    made = {}
    for name, values in given.items():
        known = {f.name for f in fields(sections[name]())}
        if bad := set(values) - known:
            raise KeyError(f"unknown names in {name}: {sorted(bad)}")
        made[name] = sections[name](**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
    return Params(**made)
