"""Field statistics, display ranges, warnings, exports and current arrows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo
from .grid import few, mission_window

# Published field catalogue, warnings and arrow geometry.
FIELDS = (
    ("road_proximity", "Road proximity", "scalar", None, "0..1 closeness to nearest OSM road (decay by distance)."),
    ("is_road", "Road cells (mask)", "mask", None, "Cells within snap radius of a road."),
    ("reachability", "Reachability", "scalar", None,
     "Tobler/Dijkstra walking reach from LKP: 1 at pin, 0 beyond time horizon, smooth falloff."),
    ("elevation", "Elevation", "scalar", "m", "SRTM elevation sampled at mission create."),
    ("slope", "Slope", "scalar", "°", "Terrain steepness in degrees."),
    ("is_land", "Land / Water (mask)", "mask", None, "Cells above the land elevation threshold."),
    ("wind_u", "Wind east (u)", "scalar", "m/s", "Per-cell wind east component at mission create."),
    ("wind_v", "Wind north (v)", "scalar", "m/s", "Per-cell wind north component at mission create."),
    ("current_u", "Current east (u)", "scalar", "m/s", "Sea-surface current east component (water cells only)."),
    ("current_v", "Current north (v)", "scalar", "m/s", "Sea-surface current north component (water cells only)."),
    ("current_speed", "Current speed", "scalar", "m/s", "Sea-surface current magnitude √(u²+v²); zero on land."),
    ("current_heading", "Current heading", "scalar", "°", "Compass direction the current flows toward (0=N, 90=E)."),
    ("current_vectors", "Current vectors (map)", "vector", "m/s",
     "Arrow overlay: flow direction and speed on water cells (Open-Meteo at LKP)."),
)
WARN_ROADS = "No roads were fetched from OSM providers for this area/time (road_proximity is all zeros)."
WARN_ELEVATION = ("Elevation provider returned no usable terrain; elevation/slope/reachability may be flat fallback. "
                  "Road fields are still valid.")
WARN_LAND = "Land mask is empty (all water) at this resolution."
WARN_REACH = "Reachability is all zero (topography layer off, sea mode, or flat elevation fallback)."
ARROW_M, MIN_SPEED, HEAD_SHARE, WING, ARROWS_PER_SIDE = 600.0, 0.02, 0.22, 0.42, 14

FIELD_NAMES = tuple(f[0] for f in FIELDS if f[2] != "vector")


def catalogue(spark) -> DataFrame:
    return spark.createDataFrame(FIELDS, "id string, label string, kind string, unit string, description string")


def inspect_fields(cells: DataFrame) -> DataFrame:
    """The twelve published fields of each cell as doubles."""
    u, v = F.col("current_u"), F.col("current_v")
    return cells.select(
        "mission_id", "row", "col", "size", "road_proximity", F.col("is_road").cast("double").alias("is_road"),
        F.col("reach_score").alias("reachability"), "elevation", F.degrees("slope").alias("slope"),
        F.col("is_land").cast("double").alias("is_land"), "wind_u", "wind_v", "current_u", "current_v",
        F.hypot(u, v).alias("current_speed"), geo.heading_deg(u, v).alias("current_heading"))


def unpivot_fields(fields: DataFrame, names=FIELD_NAMES) -> DataFrame:
    return fields.unpivot(["mission_id", "row", "col"], list(names), "field", "value")


def field_stats(long: DataFrame) -> DataFrame:
    """Min, max and share of values above 1e-9 per mission and field."""
    v = F.when(~F.isnan("value"), F.col("value"))
    share = F.count_if(F.col("value") > 1e-9) / F.count("*")
    return long.groupBy("mission_id", "field").agg(
        F.coalesce(F.min(v), F.lit(0.0)).alias("min"), F.coalesce(F.max(v), F.lit(0.0)).alias("max"), share.alias("nonzero_frac"))


def field_warnings(stats: DataFrame) -> DataFrame:
    """Data-quality warnings per mission from its field statistics."""
    def stat(field: str, name: str) -> Column:
        return F.max(F.when(F.col("field") == field, F.col(name)))
    flags = stats.groupBy("mission_id").agg(
        (stat("road_proximity", "max") <= 1e-9).alias("_r"),
        ((stat("elevation", "max") <= 1e-9) & (stat("slope", "max") <= 1e-9)).alias("_e"),
        (stat("is_land", "nonzero_frac") <= 1e-9).alias("_l"), (stat("reachability", "max") <= 1e-9).alias("_s"))
    return flags.select("mission_id", F.array_compact(F.array(
        F.when(F.col("_r"), WARN_ROADS), F.when(F.col("_e"), WARN_ELEVATION), F.when(F.col("_l"), WARN_LAND),
        F.when(F.col("_s"), WARN_REACH))).alias("warnings"))


def field_range(long: DataFrame) -> DataFrame:
    """Display range per mission and field.

    Elevation and slope take the 2nd and 98th percentile by floor index, reach 0..max, the rest
    min..max; degenerate ranges open up to width 1. A group is one mission's grid.
    """
    finite = long.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))
    tail = F.col("field").isin("elevation", "slope")
    got = finite.groupBy("mission_id", "field").agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count("*").alias("_n"),
        F.max(F.when(F.col("value") > 1e-9, F.col("value"))).alias("_reach"),
        F.array_sort(F.collect_list(F.when(tail, F.col("value")))).alias("_s"))
    def pick(q: float) -> Column:
        return F.try_element_at("_s", (F.floor(F.col("_n") * q) + 1).cast("int"))
    lo = F.when(tail, F.coalesce(pick(0.02), F.col("_lo"))).otherwise(F.col("_lo"))
    hi = F.when(tail, F.coalesce(pick(0.98), F.col("_hi"))).otherwise(F.col("_hi"))
    out = got.select("mission_id", "field", lo.alias("_a"), hi.alias("_b"), "_reach")
    reach = F.col("field") == "reachability"
    flat = F.col("_b") - F.col("_a") < 1e-9
    return out.select(
        "mission_id", "field", F.when(reach, 0.0).otherwise(F.col("_a")).alias("range_min"),
        F.when(reach, F.coalesce("_reach", F.lit(1.0))).when(flat, F.col("_a") + 1.0).otherwise(F.col("_b")).alias("range_max"))


def color_range(cells: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Grid-wide min and max of ``p``; (0, 1) when flat."""
    got = cells.groupBy("mission_id").agg(F.min("p").alias("_a"), F.max("p").alias("_b"))
    flat = F.col("_b") - F.col("_a") <= eps
    return got.select("mission_id", F.when(flat, 0.0).otherwise(F.col("_a")).alias("range_min"),
                      F.when(flat, 1.0).otherwise(F.col("_b")).alias("range_max"),
                      F.greatest(F.col("_b"), F.lit(eps)).alias("grid_max"), F.col("_a").alias("grid_min"))


def unit_surface(cells: DataFrame, eps: float = 1e-8) -> DataFrame:
    """``p`` mapped to 0..1 by the mission's own range, as ``unit``."""
    w = mission_window()
    out = cells.withColumn("_a", F.min("p").over(w)).withColumn("_b", F.max("p").over(w))
    flat = F.col("_b") - F.col("_a") <= eps
    lo, hi = F.when(flat, 0.0).otherwise(F.col("_a")), F.when(flat, 1.0).otherwise(F.col("_b"))
    return out.withColumn("unit", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("p") - lo) / (hi - lo)))).drop("_a", "_b")


def low_mass(cells: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Missions whose positive cells are some, but below one percent."""
    share = F.count_if(F.col("p") > eps) / F.count("*")
    return cells.groupBy("mission_id").agg(share.alias("share")).withColumn("low_mass", (F.col("share") > 0) & (F.col("share") < 0.01))


def flatten_field(cells: DataFrame, value: str = "p", out: str = "probabilities") -> DataFrame:
    """Row-major array per mission; a mission's grid bounds it."""
    packed = F.array_sort(F.collect_list(F.struct("row", "col", F.col(value).alias("v"))))
    return cells.groupBy("mission_id").agg(F.transform(packed, lambda s: s["v"]).alias(out))


def heatmap_export(cells: DataFrame, metadata: DataFrame) -> DataFrame:
    """Surface with its grid metadata, one row per mission."""
    meta = metadata.select("mission_id", F.struct(
        F.struct(F.col("lkp_lat").alias("lat"), F.col("lkp_lon").alias("lon")).alias("origin"), F.col("res_m").alias("resolution_m"),
        F.col("size").alias("rows"), F.col("size").alias("cols"), F.col("epsg").alias("crs_epsg"), "bounds", "corners").alias("metadata"))
    return flatten_field(cells).join(few(meta), "mission_id")


def terrain_report(cells: DataFrame, metadata: DataFrame) -> DataFrame:
    """Inspection answer per mission: fields, statistics, warnings and metadata."""
    fields = inspect_fields(cells)
    stats = field_stats(unpivot_fields(fields))
    packed = F.array_sort(F.collect_list(F.struct("row", "col", *FIELD_NAMES)))
    arrays = fields.groupBy("mission_id").agg(packed.alias("_a")).select("mission_id", *[F.col(f"_a.{n}").alias(n) for n in FIELD_NAMES])
    as_map = F.map_from_entries(F.collect_list(F.struct("field", F.struct("min", "max", "nonzero_frac"))))
    return (
        arrays.select("mission_id", F.struct(*FIELD_NAMES).alias("fields"))
        .join(few(stats.groupBy("mission_id").agg(as_map.alias("field_stats"))), "mission_id")
        .join(few(field_warnings(stats)), "mission_id")
        .join(few(metadata.select("mission_id", "size", "res_m", "epsg", "bounds", "corners")), "mission_id")
    )


def _arrow(lon: Column, lat: Column, u: Column, v: Column, length: Column) -> dict[str, Column]:
    """Shaft end and the two wing ends of an arrow along (u, v)."""
    dlon, dlat = geo.degree_step(lat, u, v, length)
    speed = F.hypot(u, v)
    ux, uy = u / speed, v / speed
    tip_lon, tip_lat = lon + dlon, lat + dlat
    def wing(side: float) -> tuple[Column, Column]:
        return geo.degree_step(tip_lat, -ux * WING - side * uy * WING, -uy * WING + side * ux * WING, length * HEAD_SHARE)
    (llon, llat), (rlon, rlat) = wing(1.0), wing(-1.0)
    return {"tip_lon": tip_lon, "tip_lat": tip_lat, "left_lon": tip_lon - llon, "left_lat": tip_lat - llat,
            "right_lon": tip_lon - rlon, "right_lat": tip_lat - rlat}


def current_vectors(cells: DataFrame, metadata: DataFrame, marine: DataFrame | None = None) -> DataFrame:
    """Arrow rows for water cells on a stride, plus the pin's own arrow.

    ``marine`` is (mission_id, u, v, speed, source). Positions are spread evenly in the outer
    bounds, as the map overlay does.
    """
    u, v = F.col("current_u"), F.col("current_v")
    joined = cells.select("mission_id", "row", "col", "size", "is_land", "current_u", "current_v").join(
        few(metadata.select("mission_id", "bounds")), "mission_id")
    if marine is not None:
        joined = joined.join(few(marine.select("mission_id", F.col("u").alias("_mu"), F.col("v").alias("_mv"), F.col("speed").alias("_ms"), "source")), "mission_id", "left")
    else:
        joined = joined.withColumns({"_mu": F.lit(None).cast("double"), "_mv": F.lit(None).cast("double"),
                                     "_ms": F.lit(None).cast("double"), "source": F.lit(None).cast("string")})
    speed = F.hypot(u, v)
    wet = F.max(F.when(~F.col("is_land"), speed)).over(mission_window())
    top = F.greatest(F.lit(MIN_SPEED), F.coalesce(wet, F.lit(0.0)), F.coalesce("_ms", F.lit(0.0)))
    b = F.col("bounds")
    placed = joined.withColumn("_top", top).withColumn(
        "lon", b["west"] + (F.col("col") + 0.5) / F.col("size") * (b["east"] - b["west"])).withColumn(
        "lat", b["north"] - (F.col("row") + 0.5) / F.col("size") * (b["north"] - b["south"])).withColumn(
        "_step", F.greatest(F.lit(1), F.floor(F.col("size") / ARROWS_PER_SIDE)))
    flow = placed.where((F.col("row") % F.col("_step") == 0) & (F.col("col") % F.col("_step") == 0) & ~F.col("is_land") & (speed >= MIN_SPEED))
    flow = flow.select("mission_id", "row", "col", "lon", "lat", u.alias("u"), v.alias("v"), speed.alias("speed"),
                       (ARROW_M * (0.35 + 0.65 * (speed / F.col("_top")))).alias("length_m"), F.lit("shaft").alias("kind"), F.lit(None).cast("string").alias("source"))
    mid = F.floor(F.col("size") / 2)
    pin = placed.where((F.col("row") == mid) & (F.col("col") == mid) & (F.col("_ms") >= MIN_SPEED)).select(
        "mission_id", "row", "col", "lon", "lat", F.col("_mu").alias("u"), F.col("_mv").alias("v"), F.col("_ms").alias("speed"),
        F.lit(ARROW_M * 1.35).alias("length_m"), F.lit("lkp").alias("kind"), "source")
    arrows = flow.unionByName(pin)
    return arrows.withColumns(_arrow(F.col("lon"), F.col("lat"), F.col("u"), F.col("v"), F.col("length_m")))


def vectors_geojson(arrows: DataFrame) -> DataFrame:
    """Shaft and head features of each arrow as GeoJSON text."""
    def feature(points: list[tuple[str, str]], kind: Column) -> Column:
        line = F.array(*[F.array(F.col(x), F.col(y)) for x, y in points])
        return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"),
                                  F.struct(kind.alias("kind"), "speed", "source").alias("properties")))
    own = F.col("kind")
    shaft = feature([("lon", "lat"), ("tip_lon", "tip_lat")], own)
    head = feature([("left_lon", "left_lat"), ("tip_lon", "tip_lat"), ("right_lon", "right_lat")], F.when(own == "shaft", "head").otherwise(own))
    return arrows.select("mission_id", "row", "col", F.explode(F.array(shaft, head)).alias("feature"))


