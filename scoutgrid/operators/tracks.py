"""Flights: schedule, revealed paths, trails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import geo
from ..functions.scalars import valid_position
from ..settings import DEFAULTS, METRES_PER_DEGREE, Settings
from .joins import salted_join
from .slices import previous, with_slice
from .telemetry import subsample

FLIGHT = ["mission_id", "sortie"]


def thinned(records: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Records as flights show them: all finds and an even share of the others, ``sortie_max_points`` per flight unless the finds alone are more.

    A choice of the caller: schedule, tracks and evidence work on all records they are given.
    """
    return subsample(records, FLIGHT, settings.sortie_max_points, tie=("record_id",))


def sortie_schedule(records: DataFrame, plan: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Start and duration of every flight that has records.

    ``plan`` is (mission_id, delays array<double>, first_delay): a flight starts at its explicit
    delay, else after the flight before plus the gap; flights without records do not count. A
    flight with an explicit start (or the first one) opens a segment, and inside a segment the
    starts are a running sum.
    """
    bounds = records.groupBy(*FLIGHT).agg(
        F.min("ts").alias("base_ts"), F.max("ts").alias("last_ts"), F.bool_or("person").alias("found"), F.count("*").alias("n_records"))
    order = W.partitionBy("mission_id").orderBy("sortie")
    out = bounds.join(plan, "mission_id").withColumns({
        "duration": (F.unix_micros("last_ts") - F.unix_micros("base_ts")) / 1e6,
        "_explicit": F.try_element_at("delays", (F.col("sortie") + 1).cast("int"))})
    opens = F.col("_explicit").isNotNull() | (F.row_number().over(order) == 1)
    out = out.withColumn("_open", opens).withColumn("_seg", F.sum(F.col("_open").cast("int")).over(order))
    inside = W.partitionBy("mission_id", "_seg").orderBy("sortie")
    head = F.coalesce(F.col("_explicit"), F.col("first_delay").cast("double"))
    earlier = F.coalesce(F.sum(F.col("duration") + settings.sortie_gap_sec).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return out.withColumn("_head", F.first(head).over(inside)).withColumn("start_sec", F.col("_head") + earlier).select(
        *FLIGHT, F.concat(F.lit("drone-"), (F.col("sortie") + 1).cast("string")).alias("asset_id"), "found", "n_records",
        "base_ts", "start_sec", "duration")


def reveal(records: DataFrame, schedule: DataFrame, offsets: Column | None = None) -> DataFrame:
    """Records with the mission second at which they show, shifted north per flight.

    ``offsets`` is an array of metres by flight number; absent ones are 0.
    """
    timeline = schedule.select(*FLIGHT, "asset_id", "found", "base_ts", "start_sec", "duration")
    out = salted_join(records, timeline, FLIGHT)
    north = F.coalesce(F.try_element_at(offsets, (F.col("sortie") + 1).cast("int")), F.lit(0.0)) if offsets is not None else F.lit(0.0)
    return out.withColumn("north_m", north).withColumn(
        "reveal_sec", F.col("start_sec") + (F.unix_micros("ts") - F.unix_micros("base_ts")) / 1e6).drop("base_ts")


def reveal_tick(step_sec: Column) -> Column:
    """Tick whose half-open window holds the reveal second."""
    return (F.floor(F.col("reveal_sec") / step_sec) + 1).cast("bigint")


def track_snapshot(revealed: DataFrame, now_sec: Column) -> DataFrame:
    """Path so far, last position and state of each launched flight at mission second ``now``.

    A path is as long as the flight's records: those of ``thinned`` bound it.
    """
    shown = revealed.withColumn("_now", now_sec).where((F.col("start_sec") < F.col("_now")) & (F.col("reveal_sec") < F.col("_now"))
                                                      & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    lat = F.col("lat") + F.col("north_m") / METRES_PER_DEGREE
    point = F.struct("reveal_sec", "record_id", F.col("lon").alias("lon"), lat.alias("lat"))
    items = shown.groupBy(*FLIGHT, "asset_id", "found").agg(
        F.array_sort(F.collect_list(point)).alias("_path"), F.max(point).alias("_last"), F.first("start_sec").alias("start_sec"),
        F.first("duration").alias("duration"), F.first("_now").alias("now_sec"))
    active = (F.col("start_sec") <= F.col("now_sec")) & (F.col("now_sec") < F.col("start_sec") + F.col("duration"))
    return items.select(*FLIGHT, "asset_id", "found", active.alias("active"), F.struct(F.col("_last.lat").alias("lat"), F.col("_last.lon").alias("lon")).alias("position"),
                        F.transform("_path", lambda p: F.array(p["lon"], p["lat"])).alias("path"), "now_sec")


def track_heads(items: DataFrame) -> DataFrame:
    """Per mission the latest active flight, else the last launched, plus all items."""
    item = F.struct("asset_id", "found", "active", "position", "path")
    return items.groupBy("mission_id").agg(
        F.max_by(F.struct("asset_id", "position", "path"), F.struct("active", "sortie")).alias("head"),
        F.transform(F.array_sort(F.collect_list(F.struct("sortie", item.alias("item")))), lambda s: s["item"]).alias("drones")).select(
        "mission_id", "head.*", "drones")


def trail_segments(revealed: DataFrame, now_sec: Column, settings: Settings = DEFAULTS, slice_sec: float = 3600.0) -> DataFrame:
    """Path legs with the second they show and their opacity at ``now``.

    A flight that is over fades faster.
    """
    lat = F.col("lat") + F.col("north_m") / METRES_PER_DEGREE
    points = revealed.where("lat is not null and lon is not null").withColumn("_now", now_sec).where(F.col("reveal_sec") < F.col("_now"))
    points = with_slice(points.withColumn("_lat", lat), F.col("reveal_sec"), slice_sec)
    legs = previous(points, FLIGHT, ["reveal_sec", "record_id"], F.struct(F.col("lon").alias("lon"), F.col("_lat").alias("lat")))
    active = (F.col("start_sec") <= F.col("_now")) & (F.col("_now") < F.col("start_sec") + F.col("duration"))
    fade = F.when(active, settings.trail_fade_sec).otherwise(settings.trail_fade_done_sec)
    opacity = F.greatest(F.lit(0.0), 1.0 - (F.col("_now") - F.col("reveal_sec")) / fade)
    return legs.where("prev is not null").select(
        *FLIGHT, "record_id", F.col("prev.lon").alias("from_lon"), F.col("prev.lat").alias("from_lat"), F.col("lon").alias("to_lon"),
        F.col("_lat").alias("to_lat"), "reveal_sec", "found", opacity.alias("opacity"))


def marker_opacity(segments: DataFrame, items: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Opacity of each flight's marker: full while active, else that of its newest leg."""
    newest = segments.groupBy(*FLIGHT).agg(F.max("reveal_sec").alias("_newest"))
    age = F.col("now_sec") - F.col("_newest")
    faded = F.coalesce(F.greatest(F.lit(0.0), 1.0 - age / settings.trail_fade_done_sec), F.lit(0.0))
    return items.join(newest, FLIGHT, "left").select(*FLIGHT, F.when(F.col("active"), 1.0).otherwise(faded).alias("opacity"))


def normalized_paths(items: DataFrame) -> DataFrame:
    """Path that ends at the reported position, and the anchor point; nothing known gives no row."""
    spot = F.when(F.col("position").isNotNull(), F.array(F.col("position.lon"), F.col("position.lat")))
    end = F.try_element_at("path", F.lit(-1))
    same = (F.abs(end[0] - spot[0]) < 1e-9) & (F.abs(end[1] - spot[1]) < 1e-9)
    body = F.when(F.coalesce(same, F.lit(False)), F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).otherwise(F.col("path"))
    path = F.when(spot.isNull(), F.col("path")).otherwise(F.concat(body, F.array(spot)))
    out = items.where("position is not null or size(path) > 0").withColumn("path", path)
    tip = F.element_at("path", -1)
    return out.withColumn("anchor", F.struct(tip[0].alias("lon"), tip[1].alias("lat")))


def path_headings(items: DataFrame) -> DataFrame:
    """Bearing of the last leg of each path, 0 with fewer than two points."""
    a, b = F.try_element_at("path", F.lit(-2)), F.try_element_at("path", F.lit(-1))
    return items.withColumn("heading_deg", geo.bearing_deg(a[1], a[0], b[1], b[0]))


def mpp_trail(mpps: DataFrame, missions: DataFrame) -> DataFrame:
    """Slot 0 is the pin, slot tick + 1 the most probable position of that tick."""
    pins = missions.select("mission_id", F.lit(0).cast("bigint").alias("slot"), F.col("lkp_lat").alias("lat"), F.col("lkp_lon").alias("lon"))
    return pins.unionByName(mpps.select("mission_id", (F.col("tick") + 1).cast("bigint").alias("slot"), "lat", "lon"))


def all_evidence(feed: DataFrame, revealed: DataFrame, step_sec: Column) -> DataFrame:
    """Bag union of the live feed and the flights' revealed records as (mission, tick, source, person, lat, lon, confidence).

    ``feed`` carries its tick; a flight's record counts in the tick that reveals it, at its shifted place. Nothing is
    deduplicated: a find that both report raises its cell twice.
    """
    columns = ["mission_id", "tick", "person", "lat", "lon", "confidence"]
    flown = revealed.withColumn("tick", reveal_tick(step_sec)).withColumn("_p", valid_position(F.col("lat"), F.col("lon"), F.col("north_m")))
    flown = flown.withColumns({"lat": F.col("_p.lat"), "lon": F.col("_p.lon")})
    return feed.select(*columns, F.lit("feed").alias("source")).unionByName(flown.select(*columns, F.lit("sortie").alias("source")))
