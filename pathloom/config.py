"""Settings of the engine: one frozen record with the defaults, and the road-class tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

# Speed cap and typical speed (m/s) by road class; "_link" classes follow their parent.
SPEED_CAPS = {"motorway": 45.0, "trunk": 45.0, "primary": 42.0, "secondary": 35.0, "tertiary": 25.0, "unclassified": 22.0, "residential": 12.0, "service": 12.0, "living_street": 12.0}
TYPICAL_SPEEDS = {"motorway": 27.5, "trunk": 22.0, "primary": 13.5, "secondary": 11.0, "tertiary": 9.0, "unclassified": 8.0, "residential": 6.0, "service": 4.0, "living_street": 3.0}
OTHER_CAP, OTHER_TYPICAL = 40.0, 8.0
#: Feature slot of a road class; classes without one count in the length only.
CLASS_SLOTS = {"motorway": 5, "trunk": 6, "primary": 7, "secondary": 8, "tertiary": 9, "unclassified": 10, "residential": 10, "service": 11, "living_street": 11}
FEATURES = [
    "length_km", "left_turns", "right_turns", "signals", "stops", "motorway", "trunk", "primary", "secondary", "tertiary", "minor", "local",
    "travel_min", "dwell_min", "dwell_ratio", "start_perp", "end_perp", "intersections", "violation_runs",
]
N_FEATURES = len(FEATURES)
VIOLATION_DEFAULT = -2.0


@dataclass(frozen=True)
class Config:
    """All knobs. weights: one for each feature; typical_speeds: overrides by class."""

    hdop_max: float = 10.0
    spike_speed_ms: float = 150.0
    spike_bridge_speed_ms: float = 100.0
    spike_max_length: int = 3
    collapse_epsilon_m: float = 5.0
    max_speed_factor: float = 1.2
    replay_max_speed_ms: float = 40.0
    replay_k_consistent: int = 2
    replay_moving_threshold_ms: float = 1.0
    subgraph_buffer_m: float = 5000.0
    candidate_radius_m: float = 50.0
    candidate_max_radius_m: float = 200.0
    max_state_candidates: int = 5
    max_path_candidates: int = 100
    paths_per_pair: int = 3
    path_budget_slack: float = 1.5
    path_penalty_lambda: float = 0.3
    diversify_truncation: bool = True
    enable_direction_violation: bool = True
    direction_violation_cost_factor: float = 3.0
    enable_offroad: bool = True
    offroad_max_straight_m: float = 120.0
    offroad_min_detour_ratio: float = 3.0
    offroad_min_overslack: float = 1.0
    emission_scale: float = 10.0
    emission_df: float = 4.0
    weights: tuple[float, ...] = ()
    typical_speeds: Mapping[str, float] | None = None

    def __post_init__(self) -> None:
        if self.weights and len(self.weights) != N_FEATURES:
            raise ValueError(f"weights need {N_FEATURES} values")
        if self.emission_scale <= 0 or self.emission_df <= 0:
            raise ValueError("emission scale and df must be positive")

    def mu(self) -> tuple[float, ...]:
        return self.weights or generic_prior()


def fitted_weights(values: list[float] | None) -> tuple[float, ...]:
    """Stored weights: none are zeros, 18 get the default for violations, other sizes are refused."""
    if values is None:
        return (0.0,) * N_FEATURES
    if len(values) == N_FEATURES - 1:
        return (*values, VIOLATION_DEFAULT)
    if len(values) != N_FEATURES:
        raise ValueError(f"expected {N_FEATURES} weights, got {len(values)}")
    return tuple(values)


def generic_prior(length: float = 2.0, time: float = 0.0, violation: float = 1.0) -> tuple[float, ...]:
    """A sparse prior: costs on length, travel time and wrong-way runs."""
    return tuple({0: -length, 12: -time, 18: -violation}.get(i, 0.0) for i in range(N_FEATURES))


def parent_class(road_class: str | None) -> str | None:
    return road_class.removesuffix("_link") if road_class else road_class
