"""Column expressions for timestamps, clocks, casts, flags and mission arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..settings import DEFAULTS, FEET_TO_METRES, LAYER_ORDER, Settings


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def seconds(ts: Column) -> Column:
    """Seconds since the epoch with microsecond precision."""
    return F.unix_micros(ts) / 1e6


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to an instant; no zone means UTC, bad text means null."""
    return F.try_to_timestamp(F.when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}"), F.trim(text)))


def parse_flight_clock(date: Column, time: Column, zone: str = DEFAULTS.flight_zone) -> Column:
    """Local flight-log date and 12-hour time to an instant; ``zone`` may be an offset."""
    text = F.concat_ws(" ", F.trim(date), F.trim(time))
    local = F.try_to_timestamp(text, F.lit("M/d/y h:mm:ss.SSSSSS a"))
    return F.when((F.trim(date) != "") & (F.trim(time) != ""), F.to_utc_timestamp(local, zone))


def safe_double(value: Column) -> Column:
    return F.trim(value.cast("string")).try_cast("double")


def feet_to_metres(value: Column) -> Column:
    return value * FEET_TO_METRES


def valid_position(lat: Column, lon: Column, north_m: Column | float = 0.0) -> Column:
    """Position struct shifted north, or null when missing or out of range."""
    shift = (north_m if isinstance(north_m, Column) else F.lit(float(north_m))) / 111_320.0
    moved = lat + shift
    return F.when(moved.between(-90, 90) & lon.between(-180, 180), F.struct(moved.alias("lat"), lon.alias("lon")))


def tick_of(ts: Column, anchor: Column, step_sec: Column) -> Column:
    """Tick whose half-open window holds ``ts``; below 1 means before the mission."""
    return (F.floor((F.unix_micros(ts) - F.unix_micros(anchor)) / (step_sec * 1e6)) + 1).cast("bigint")


def step_seconds(pace: Column, settings: Settings = DEFAULTS) -> Column:
    return pace * settings.base_step_sec


def scenario_clock(anchor: Column, tick: Column, step_sec: Column) -> Column:
    return F.timestamp_micros((F.unix_micros(anchor) + tick * step_sec * 1e6).cast("bigint"))


def live_elapsed_sec(tick: Column, start_tick: Column, step_sec: Column) -> Column:
    return F.greatest(F.lit(0), tick - start_tick) * step_sec


def tick_count(anchor: Column, until: Column, step_sec: Column) -> Column:
    elapsed = F.greatest(F.lit(0.0), (F.unix_micros(until) - F.unix_micros(anchor)) / 1e6)
    return F.floor(elapsed / step_sec).cast("bigint")


def expand_ticks(missions: DataFrame, n_ticks: Column, out: str = "tick") -> DataFrame:
    """One row per mission and tick 0..n."""
    return missions.withColumn(out, F.explode(F.sequence(F.lit(0).cast("bigint"), n_ticks)))


def text_list(text: Column) -> Column:
    """Comma list of trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(text, ","), lambda part: F.trim(part)), lambda part: part != "")


def offset_list(text: Column) -> Column:
    """Comma list of numbers; blank or bad parts are 0."""
    return F.transform(F.split(text, ","), lambda p: F.coalesce(F.trim(p).try_cast("double"), F.lit(0.0)))


def delay_list(text: Column) -> Column:
    """Comma list of numbers; blank or bad parts are null, blank text is an empty list."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("double"))
    return F.when(F.trim(text) == "", F.array().cast("array<double>")).otherwise(parts)


def launch_delays(explicit: Column, configured: Column, first: Column, default_first: float = DEFAULTS.launch_delay_sec) -> Column:
    """Explicit list, else the configured one with its head overridable, else one default."""
    merged = F.when(first.isNull(), configured).otherwise(
        F.concat(F.array(first), F.slice(configured, 2, F.greatest(F.size(configured) - 1, F.lit(0)))))
    single = F.array(F.coalesce(first, F.lit(float(default_first))))
    return F.when(F.size(explicit) > 0, explicit).when(F.size(configured) > 0, merged).otherwise(single)


def video_time(frame: Column, fps: Column) -> Column:
    """``HH:MM:SS.mmm`` of a frame."""
    sec = frame / fps
    hours, rest = F.floor(sec / 3600), sec % 3600
    return F.format_string("%02d:%02d:%06.3f", hours, F.floor(rest / 60), rest % 60)


def duration_text(total_sec: Column) -> Column:
    """``H:MM:SS`` from one hour on, else ``M:SS``."""
    s = F.greatest(F.lit(0).cast("bigint"), F.floor(total_sec))
    hours, minutes, sec = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, sec)).otherwise(
        F.format_string("%d:%02d", minutes, sec))


def marine_summary(speed: Column, direction: Column, source: Column) -> Column:
    label = F.when(source == "open_meteo", "Open-Meteo").otherwise("fallback")
    return F.format_string("%.2f m/s toward %.0f° (%s)", speed, direction, label)


def unit_scale(value: Column, low: Column, high: Column, eps: float = 1e-8) -> Column:
    """Map to 0..1 between ``low`` and ``high``; 0 for a degenerate range."""
    return F.when(high - low <= eps, F.lit(0.0)).otherwise(clamp((value - low) / (high - low), 0.0, 1.0))


def mask_on(value: Column, low: Column, high: Column, threshold: float = 0.5, kind: str = "scalar",
            field: str | None = None, eps: float = 0.0) -> Column:
    """Whether a cell is highlighted: masks by 0.5 (water for is_land), scalars by normalised threshold."""
    if kind == "mask":
        return value < 0.5 if field == "is_land" else value > 0.5
    span = F.when(high - low == 0, F.lit(1.0)).otherwise(high - low)
    return (value - low) / span >= clamp(F.lit(float(threshold)), 0.0, 1.0)


def every_nth(frame: Column, n: int) -> Column:
    return frame % n == 0


def mobility(age: Column, fitness: Column, injured: Column) -> Column:
    by_age = clamp(1.20 - (age - 10) / 100.0, 0.35, 1.20)
    return by_age * (0.85 + 0.10 * (fitness - 1)) * F.when(injured, 0.45).otherwise(1.0)


def hiking_speed_kmh(grade: Column, settings: Settings = DEFAULTS) -> Column:
    """Tobler's function scaled so that flat ground has the configured speed."""
    return settings.flat_speed_kmh * F.exp(3.5 * 0.05 - 3.5 * F.abs(grade + 0.05))


def horizon_hours(tick: Column, step_sec: Column, anchor: Column | None = None, now: Column | None = None) -> Column:
    """Walking horizon; with ``anchor`` and ``now`` (live mode) elapsed time is added."""
    simulated = (tick + 1) * step_sec / 3600.0
    if anchor is not None and now is not None:
        simulated = simulated + F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(anchor)) / 3.6e9)
    return F.greatest(step_sec / 3600.0, simulated)


def diffusion_steps(dt_sec: Column, weight: float, tick: Column, settings: Settings = DEFAULTS) -> Column:
    """Diffusion steps of a tick: none at 0, ramped during warm-up, capped."""
    scaled = settings.diffusion_steps * weight * F.greatest(dt_sec, F.lit(1.0)) / max(settings.reference_dt_sec, 1.0)
    full = clamp(F.bround(scaled, 0), 1.0, float(settings.diffusion_steps_max))
    warm = max(1, settings.warmup_ticks)
    ramp = F.greatest(F.lit(1.0), F.bround(full * (tick / warm), 0))
    steps = F.when(tick <= 0, F.lit(float(settings.first_tick_steps))).when(tick < warm, ramp).otherwise(full)
    return steps.cast("int")


def drift_steps(tick: Column, settings: Settings = DEFAULTS) -> Column:
    per_tick = max(1, settings.advection_steps)
    cap = max(per_tick, settings.advection_steps_max)
    return F.least(F.lit(cap), per_tick * F.greatest(F.lit(1), tick)).cast("int")


def resolve_layers(flags: Column, lkp_is_land: Column | None = None) -> Column:
    """Layer switches: unknown keys dropped, all off means topography, a wet pin means drift only."""
    known = F.map_filter(flags, lambda k, v: k.isin(*LAYER_ORDER))
    asked = F.coalesce(F.exists(F.map_values(known), lambda v: v), F.lit(False))
    defaults = {"topography": True, "roads": True, "personality": False, "weather": False, "sea_drift": False}

    def chosen(name: str) -> Column:
        given = F.coalesce(F.element_at(known, name), F.lit(defaults[name]))
        return F.when(flags.isNull() | (F.size(flags) == 0), F.lit(defaults[name])).otherwise(
            F.when(~asked & F.lit(name == "topography"), F.lit(True)).otherwise(given))

    picked = {name: chosen(name) for name in LAYER_ORDER}
    none = ~reduce(lambda a, b: a | b, picked.values())
    picked["topography"] = picked["topography"] | none
    if lkp_is_land is not None:
        wet = ~lkp_is_land
        picked = {n: F.when(wet, F.lit(n == "sea_drift")).otherwise(c) for n, c in picked.items()}
    return F.struct(*[picked[n].alias(n) for n in LAYER_ORDER])


def validate_missions(requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Split requests into accepted missions and rejected ones with a reason."""
    lkp_ts = F.coalesce(F.col("lkp_timestamp"), F.col("timestamp"))
    offline = F.col("mode") == "offline"
    start = F.when(offline, F.coalesce(F.col("simulation_start_timestamp"), now)).otherwise(
        F.col("simulation_start_timestamp"))
    pace = F.coalesce(F.col("pace"), F.lit(1.0))
    reason = (
        F.when(~F.col("lat").between(-90, 90) | ~F.col("lon").between(-180, 180) | F.col("lat").isNull()
               | F.col("lon").isNull(), "lkp out of range")
        .when(~pace.between(0.1, 120.0), "pace out of range")
        .when(~F.coalesce(F.col("mode"), F.lit("live")).isin("live", "offline"), "unknown mode")
        .when(F.col("age").isNotNull() & ~F.col("age").between(1, 120), "age out of range")
        .when(F.col("fitness").isNotNull() & ~F.col("fitness").between(1, 5), "fitness out of range")
        .when(offline & lkp_ts.isNull(), "lkp_timestamp is required for offline mode")
        .when(offline & (start < lkp_ts), "simulation start before lkp_timestamp")
    )
    personal = F.coalesce(F.element_at("layers", "personality"), F.lit(False))
    def default_trait(name: str, value) -> Column:
        return F.when(personal, F.coalesce(F.col(name), F.lit(value))).otherwise(F.col(name))
    checked = requests.select(
        *[c for c in requests.columns if c not in
          {"lkp_timestamp", "simulation_start_timestamp", "pace", "mode", "age", "fitness", "injured"}],
        lkp_ts.alias("lkp_timestamp"), start.alias("simulation_start_timestamp"), pace.alias("pace"),
        F.coalesce(F.col("mode"), F.lit("live")).alias("mode"), default_trait("age", 35).alias("age"),
        default_trait("fitness", 3).alias("fitness"), default_trait("injured", False).alias("injured"),
        (pace * DEFAULTS.base_step_sec).alias("step_sec"), reason.alias("reason"))
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")
