"""Search routes: greedy coverage for all missions at once, uncrossing, length and crossings."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..session import cut_lineage
from ..settings import DEFAULTS, Settings
from .grid import CELL_KEYS, with_cell_latlon

STOP = T.StructType([
    T.StructField("mission_id", T.LongType()), T.StructField("stop", T.IntegerType()),
    T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()),
    T.StructField("easting", T.DoubleType()), T.StructField("northing", T.DoubleType())])


def _greedy(mass: np.ndarray, res: float, s: Settings) -> list[tuple[int, int]]:
    """Cells of the stops in the order chosen: most new mass per distance first.

    Ties go to the larger new mass, then to the earlier candidate.
    """
    n, r = len(mass), s.route_radius_cells
    flat = mass.ravel()
    pool = np.lexsort((-np.arange(flat.size), -flat))[:s.route_candidates]
    rows, cols = np.divmod(pool[flat[pool] > s.min_mass], n)
    east, north = (cols - n // 2) * res, (n // 2 - rows) * res
    left = np.pad(mass, r)
    areas = np.lib.stride_tricks.sliding_window_view(left, (2 * r + 1, 2 * r + 1))
    here, flown, taken, stops = (0.0, 0.0), 0.0, np.zeros(len(rows), dtype=bool), []
    while len(stops) < s.route_stops:
        leg = np.hypot(east - here[0], north - here[1])
        gain = areas[rows, cols].sum(axis=(1, 2))
        score = np.where(taken | (flown + leg > s.route_length_m), -1.0, gain / (1.0 + leg / s.route_distance_m))
        if not len(score) or score.max() < 0:
            break
        best = np.flatnonzero(score == score.max())
        i = best[np.argmax(gain[best])]
        if gain[i] <= s.min_mass:
            break
        stops.append((int(rows[i]), int(cols[i])))
        taken[i], flown, here = True, flown + leg[i], (east[i], north[i])
        left[rows[i]:rows[i] + 2 * r + 1, cols[i]:cols[i] + 2 * r + 1] = 0.0
    return stops


def plan_routes(cells: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Stops of every mission's route in the order they were chosen.

    A dozen dependent choices on one bounded grid: one group per mission, fed with the surface
    and nothing else. Needs ``size``, ``res_m`` and the origin columns.
    """
    def choose(table: pa.Table) -> pa.Table:
        n, res = table["size"][0].as_py(), table["res_m"][0].as_py()
        mass = np.zeros(n * n)
        mass[table["row"].to_numpy() * n + table["col"].to_numpy()] = table["p"].to_numpy()
        stops = np.array(_greedy(mass.reshape(n, n), res, settings), dtype="int32").reshape(-1, 2)
        return pa.table({
            "mission_id": np.full(len(stops), table["mission_id"][0].as_py(), dtype="int64"), "stop": np.arange(1, len(stops) + 1, dtype="int32"),
            "row": stops[:, 0], "col": stops[:, 1], "easting": table["origin_e"][0].as_py() + (stops[:, 1] - n // 2) * res,
            "northing": table["origin_n"][0].as_py() + (n // 2 - stops[:, 0]) * res})

    return cells.select("mission_id", "row", "col", "size", "res_m", "origin_e", "origin_n", "p").groupBy("mission_id").applyInArrow(choose, STOP)


def _uncrossed(points: np.ndarray) -> np.ndarray:
    """Order of an open path, first point fixed, that no reversal of a stretch of stops shortens.

    A route has a dozen stops, so every pass weighs all reversals in one matrix: turning the stretch from
    place a to place b replaces the leg into a and the leg out of b. The best one is taken (the first
    of equals), until none saves more than a rounding error; two crossing legs always leave one that does.
    """
    order = np.arange(len(points))
    while len(order) > 2:
        x = points[order]
        apart = np.hypot(*(x[:, None] - x[None, :]).transpose(2, 0, 1))
        into = np.diagonal(apart, 1)  # into[a - 1] leads into place a; the last place has no leg out
        out = np.append(into[1:], 0.0)
        across = np.hstack([apart[1:, 2:], np.zeros((len(x) - 1, 1))])
        saved = into[:, None] + out[None, :] - apart[:-1, 1:] - across
        saved = np.triu(saved, 1)
        a, b = np.unravel_index(saved.argmax(), saved.shape)
        if saved[a, b] <= 1e-9:
            break
        order[a + 1:b + 2] = order[a + 1:b + 2][::-1]
    return order


def polish_routes(stops: DataFrame, missions: DataFrame) -> DataFrame:
    """Shorten each route by uncrossing it; the launch point and the set of stops stay."""
    joined = stops.join(missions.select("mission_id", "origin_e", "origin_n"), "mission_id")

    def shorten(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("stop").reset_index(drop=True)
        points = np.vstack([frame[["origin_e", "origin_n"]].iloc[:1], frame[["easting", "northing"]]])
        order = _uncrossed(points)[1:] - 1
        return frame.loc[order].assign(stop=range(1, len(order) + 1))[STOP.names]

    return joined.groupBy("mission_id").applyInPandas(shorten, STOP)


def path_length(stops: DataFrame, missions: DataFrame) -> DataFrame:
    """Length of each route from the launch point."""
    start = missions.select("mission_id", F.lit(0).alias("stop"), F.col("origin_e").alias("easting"), F.col("origin_n").alias("northing"))
    w = W.partitionBy("mission_id").orderBy("stop")
    legs = stops.select("mission_id", "stop", "easting", "northing").unionByName(start).withColumn(
        "_leg", F.hypot(F.col("easting") - F.lag("easting").over(w), F.col("northing") - F.lag("northing").over(w)))
    return legs.groupBy("mission_id").agg(F.coalesce(F.sum("_leg"), F.lit(0.0)).alias("length_m"), (F.count("*") - 1).alias("route_points"))


def covered_mass(stops: DataFrame, cells: DataFrame, radius: int = DEFAULTS.route_radius_cells) -> DataFrame:
    """Mass of the distinct cells under a route's footprints."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    area = stops.withColumn("_dr", F.explode(steps)).withColumn("_dc", F.explode(steps)).select(
        "mission_id", (F.col("row") + F.col("_dr")).alias("row"), (F.col("col") + F.col("_dc")).alias("col")).distinct()
    return cells.join(area, list(CELL_KEYS), "left_semi").groupBy("mission_id").agg(F.sum("p").alias("expected_coverage"))


def _side(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def route_crossings(stops: DataFrame, missions: DataFrame) -> DataFrame:
    """Pairs of legs of one route that properly cross; a route has at most 12 legs."""
    start = missions.select("mission_id", F.lit(0).alias("stop"), F.col("origin_e").alias("easting"), F.col("origin_n").alias("northing"))
    path = stops.select("mission_id", "stop", "easting", "northing").unionByName(start).groupBy("mission_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("stop", F.col("easting").alias("x"), F.col("northing").alias("y")))),
                    lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("_path"))
    legs = F.arrays_zip(F.slice("_path", 1, F.size("_path") - 1).alias("a"), F.slice("_path", 2, F.size("_path") - 1).alias("b"))
    def crosses(p: Column, q: Column) -> Column:
        return (_side(p["a"], p["b"], q["a"]) * _side(p["a"], p["b"], q["b"]) < 0) & (
            _side(q["a"], q["b"], p["a"]) * _side(q["a"], q["b"], p["b"]) < 0)
    hits = F.aggregate("_legs", F.lit(0), lambda n, p: n + F.size(F.filter("_legs", lambda q: crosses(p, q))))
    return path.where(F.size("_path") > 1).withColumn("_legs", legs).select("mission_id", (hits / 2).cast("int").alias("crossings"))


def drone_routes(cells: DataFrame, missions: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Polished stops with positions, and one summary row per mission.

    The stops (at most twelve small rows per mission) feed several results, so they are kept.
    """
    stops = cut_lineage(polish_routes(plan_routes(cells, settings), missions))
    placed = with_cell_latlon(stops.join(missions.select("mission_id", "epsg"), "mission_id"))
    summary = path_length(stops, missions).join(covered_mass(stops, cells, settings.route_radius_cells), "mission_id", "left").withColumn(
        "expected_coverage", F.coalesce("expected_coverage", F.lit(0.0)))
    return placed, summary


def route_geojson(placed: DataFrame, missions: DataFrame) -> DataFrame:
    """Each route as a GeoJSON LineString that starts at the pin."""
    point = F.struct("stop", F.array("lon", "lat").alias("xy"))
    lines = placed.groupBy("mission_id").agg(F.transform(F.array_sort(F.collect_list(point)), lambda s: s["xy"]).alias("_xy"))
    out = missions.select("mission_id", "lkp_lat", "lkp_lon").join(lines, "mission_id", "left")
    coordinates = F.concat(F.array(F.array("lkp_lon", "lkp_lat")), F.coalesce("_xy", F.array().cast("array<array<double>>")))
    return out.select("mission_id", F.to_json(F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates"))).alias("route"))
