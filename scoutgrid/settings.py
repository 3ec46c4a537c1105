"""Tunable constants of the search model, grouped by the operator that reads them."""

from __future__ import annotations

from dataclasses import dataclass, replace

# They must equal the published defaults for results to agree.
NEIGHBOURS = (
    (-1, -1), (-1, 0), (-1, 1),
    (0, -1), (0, 1),
    (1, -1), (1, 0), (1, 1),
)  # (row step, column step); rows grow southward, columns eastward

LAYER_ORDER = ("topography", "personality", "weather", "roads", "sea_drift")
HIGHWAY_CLASSES = ("primary", "secondary", "tertiary", "residential", "path", "footway", "track")
METRES_PER_DEGREE = 111_320.0
FEET_TO_METRES = 0.3048
MIN_GRID, MAX_GRID = 8, 512


@dataclass(frozen=True)
class Settings:
    # grid and clock
    grid_size: int = 128
    grid_resolution_m: float = 0.1
    base_step_sec: float = 10.0
    inspect_resolution_m: float = 25.0
    inspect_hours: float = 2.0
    # travel cost and diffusion
    cost_road: float = 1.0
    cost_offroad: float = 4.0
    cost_steep: float = 8.0
    cost_water: float = 20.0
    cost_floor: float = 0.5
    trail_bonus: float = 0.35
    distance_share: float = 0.28
    topology_share: float = 0.72
    weight_scale: float = 1.0
    diffusion_self: float = 0.11
    diffusion_steps: int = 6
    diffusion_steps_max: int = 18
    first_tick_steps: int = 0
    warmup_ticks: int = 3
    reference_dt_sec: float = 60.0
    # drift
    drift_speed_mps: float = 0.4
    drift_heading_deg: float = 90.0
    drift_strength: float = 1.2
    advection_strength: float = 2.5
    advection_self: float = 0.15
    advection_steps: int = 2
    advection_steps_max: int = 96
    current_fallback_u: float = 1.0
    current_fallback_v: float = 0.5
    wind_u: float = 4.0
    wind_v: float = 2.5
    # roads
    road_decay_m: float = 20.0
    road_snap_m: float = 80.0
    road_bonus: float = 1.05
    # terrain
    land_threshold_m: float = 1.0
    steep_deg: float = 30.0
    cliff_deg: float = 45.0
    tpi_window: int = 3
    ridge_m: float = 5.0
    valley_m: float = 5.0
    steep_weight: float = 0.7
    cliff_weight: float = 0.2
    valley_weight: float = 1.15
    ridge_weight: float = 0.9
    flat_speed_kmh: float = 4.2
    elevation_samples: int = 256
    # layers
    topography_weight: float = 0.55
    roads_weight: float = 0.88
    reach_floor: float = 0.12
    # evidence
    history_decay: float = 0.6
    clean_decay: float = 0.9
    clean_strength: float = 0.8
    boost_strength: float = 0.6
    sweep_radius_m: float = 10.0
    search_floor: float = 1e-8
    search_log_below: float = 1e-6
    # flights
    launch_delay_sec: float = 120.0
    launch_delays_sec: str = "120,225"
    sortie_gap_sec: float = 10.0
    north_offsets_m: str = "60,0"
    sortie_max_points: int = 300
    # telemetry merge
    merge_tolerance_sec: float = 0.15
    gps_tolerance_sec: float = 1.0
    gps_clock_offset_sec: float = 11675.626
    session_gap_sec: float = 10.0
    flight_zone: str = "Asia/Jerusalem"
    # points and ranking
    kde_bandwidth: float = 1.1
    peak_limit: int = 200
    min_mass: float = 1e-12
    route_candidates: int = 128
    route_stops: int = 12
    route_length_m: float = 6000.0
    route_radius_cells: int = 2
    route_distance_m: float = 750.0
    # messages
    delta_threshold: float = 1e-7
    search_delta_threshold: float = 1e-10
    alert_cooldown_sec: float = 5.0
    log_interval_sec: float = 1.0
    log_backlog: int = 200
    trail_fade_sec: float = 12.0
    trail_fade_done_sec: float = 7.0

    def but(self, **changes) -> "Settings":
        return replace(self, **changes)


DEFAULTS = Settings()
