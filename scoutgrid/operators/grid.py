"""Grid tables: one row per (mission, row, col), hash-partitioned once by mission.

A mission's grid is the unit of work: every per-mission window or Arrow group below is as large as one
grid, whatever its size, and missions of different sizes share a table. ``hash(mission_id)`` satisfies windows on
(mission_id, row) and (mission_id, col): the raster operators add sorts, not shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import geo
from ..session import shuffle_partitions

CELL_KEYS = ("mission_id", "row", "col")


def with_origin(missions: DataFrame) -> DataFrame:
    """Add ``epsg`` and the pin in UTM metres."""
    return geo.with_utm(
        missions.withColumn("epsg", geo.utm_epsg(F.col("lkp_lon"), F.col("lkp_lat"))),
        "lkp_lat", "lkp_lon", "epsg", "origin_e", "origin_n")


def grid_metadata(missions: DataFrame) -> DataFrame:
    """Corners (true quad), outer bounds and UTM extent of each mission's grid."""
    size, res = F.col("size"), F.col("res_m")
    before, after = geo.edge_before(size, res), geo.edge_after(size, res)
    out = with_origin(missions).withColumns({
        "min_e": F.col("origin_e") - before, "max_e": F.col("origin_e") + after,
        "min_n": F.col("origin_n") - after, "max_n": F.col("origin_n") + before})
    for name, e, n in (("nw", "min_e", "max_n"), ("ne", "max_e", "max_n"), ("se", "max_e", "min_n"), ("sw", "min_e", "min_n")):
        out = geo.with_latlon(out, e, n, "epsg", f"{name}_lat", f"{name}_lon")
    def outer(pick, part: str) -> Column:
        return pick(*[F.col(f"{c}_{part}") for c in ("nw", "ne", "se", "sw")])
    corners = F.struct(*[F.struct(F.col(f"{c}_lat").alias("lat"), F.col(f"{c}_lon").alias("lon")).alias(c)
                         for c in ("nw", "ne", "se", "sw")])
    bounds = F.struct(outer(F.greatest, "lat").alias("north"), outer(F.least, "lat").alias("south"),
                      outer(F.greatest, "lon").alias("east"), outer(F.least, "lon").alias("west"))
    return out.withColumn("corners", corners).withColumn("bounds", bounds).withColumn(
        "area_m2", geo.total_area_m2(size, res)).drop(
        *[f"{c}_{p}" for c in ("nw", "ne", "se", "sw") for p in ("lat", "lon")])


def make_cells(missions: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every cell of every mission with the impulse ``p`` = 1 on the pin's cell.

    The mission rows are spread first (an explicit partition number, so that the tiny
    input is not coalesced into one task) and blown up afterwards; nothing larger than
    a mission row is shuffled.
    """
    n = partitions or shuffle_partitions(missions.sparkSession)
    axis = F.sequence(F.lit(0), F.col("size") - 1)
    half = F.floor(F.col("size") / 2)
    return (
        with_origin(missions).repartition(n, "mission_id")
        .withColumn("row", F.explode(axis)).withColumn("col", F.explode(axis))
        .withColumn("is_pin", (F.col("row") == half) & (F.col("col") == half))
        .withColumn("p", F.col("is_pin").cast("double"))
        .withColumn("easting", geo.cell_easting(F.col("origin_e"), F.col("col"), F.col("size"), F.col("res_m")))
        .withColumn("northing", geo.cell_northing(F.col("origin_n"), F.col("row"), F.col("size"), F.col("res_m")))
    )


def dense(cells: DataFrame) -> DataFrame:
    """Rows blown up from few, as cells are: Spark's size check goes by the few and would send all of them through the driver.

    A join with these sorts and merges both sides.
    """
    return cells.hint("merge")


def few(rows: DataFrame) -> DataFrame:
    """About one row per mission, to be joined to cells: each task keeps those of its own missions, the cells stay where they are."""
    return rows.hint("shuffle_hash")


def attach_missions(cells: DataFrame, missions: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Give slim cells their mission's pin, zone, named columns and their own UTM centre.

    Fields that do not change while a surface is worked on need not travel through every step;
    the join key is the cells' partitioning, so the cells stay where they are.
    """
    wanted = ["lkp_lat", "lkp_lon", "epsg", "origin_e", "origin_n", "size", "res_m", *columns]
    have = set(cells.columns)
    right = with_origin(missions).select("mission_id", *[c for c in dict.fromkeys(wanted) if c not in have])
    out = cells.join(few(right), "mission_id")
    return out.withColumn("easting", geo.cell_easting(F.col("origin_e"), F.col("col"), F.col("size"), F.col("res_m"))).withColumn(
        "northing", geo.cell_northing(F.col("origin_n"), F.col("row"), F.col("size"), F.col("res_m")))


def with_cell_latlon(cells: DataFrame) -> DataFrame:
    return geo.with_latlon(cells, "easting", "northing", "epsg", "lat", "lon")


def with_quad_latlon(cells: DataFrame) -> DataFrame:
    """Approximate cell position through the corner quad (needs ``corners``)."""
    u = (F.col("col") + 0.5) / F.col("size")
    v = (F.col("row") + 0.5) / F.col("size")
    return cells.withColumn("lat", geo.quad_point(u, v, F.col("corners"), "lat")).withColumn(
        "lon", geo.quad_point(u, v, F.col("corners"), "lon"))


def mission_window(keys=("mission_id",)):
    return W.partitionBy(*keys)


def mission_sum(value, keys=("mission_id",)) -> Column:
    return F.sum(value).over(mission_window(keys))


def at_pin(value, keys=("mission_id",)) -> Column:
    """Value of the pin's cell, repeated on every cell of the mission."""
    column = F.col(value) if isinstance(value, str) else value
    return F.max(F.when(F.col("is_pin"), column)).over(mission_window(keys))


def normalize(cells: DataFrame, value: str = "p", keys=("mission_id",)) -> DataFrame:
    """Scale to mission mass 1; a mission without mass is left as it is."""
    total = mission_sum(value, keys)
    return cells.withColumn("_total", total).withColumn(
        value, F.when(F.col("_total") > 0, F.col(value) / F.col("_total")).otherwise(F.col(value))).drop("_total")


def point_to_cell(points: DataFrame, outside: str = "drop", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Planimetric point to cell. ``points`` already carries its mission's columns.

    ``drop`` removes points off the grid, ``clamp`` moves them to the border cell. The
    fractional indexes stay as ``row_f`` / ``col_f``.
    """
    size, res = F.col("size"), F.col("res_m")
    out = geo.with_utm(points, lat, lon, "epsg", "point_e", "point_n")
    out = out.withColumn("row_f", geo.fractional_row(F.col("point_n"), F.col("origin_n"), size, res)).withColumn(
        "col_f", geo.fractional_col(F.col("point_e"), F.col("origin_e"), size, res))
    row, col = F.floor("row_f").cast("int"), F.floor("col_f").cast("int")
    if outside == "clamp":
        top = size - 1
        return out.withColumn("row", F.greatest(F.lit(0), F.least(top, row))).withColumn(
            "col", F.greatest(F.lit(0), F.least(top, col)))
    # dropped in a generator: as a filter on row and col the projection would be pushed down
    # into every one of its comparisons
    inside = (row >= 0) & (row < size) & (col >= 0) & (col < size)
    placed = F.explode(F.when(inside, F.array(F.struct(row.alias("row"), col.alias("col")))))
    return out.withColumn("_cell", placed).withColumn("row", F.col("_cell.row")).withColumn("col", F.col("_cell.col")).drop("_cell")
