"""Time and space joins that need neither a cross join nor a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import geo
from ..settings import DEFAULTS, Settings
from .grid import CELL_KEYS, dense, few, mission_window, point_to_cell
from .slices import ROWS, SLICE, sliced

SALTS = 16


def salted_join(many: DataFrame, few: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS, meet: str = "shuffle_hash") -> DataFrame:
    """Join a large, possibly skewed side to one with few rows per key.

    Rows of a hot key are spread over ``salts`` tasks; ``few`` is repeated that often. The copies never go through
    the driver, since Spark's size check does not see the repeats: each task hashes its share of them, or with
    ``meet="merge"`` sorts it, which suits a ``few`` of about as many rows as ``many``.
    """
    hashed = [f.name for f in many.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    spread = many.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in hashed]), F.lit(salts)).cast("int"))
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies.hint(meet), [*on, "_salt"], how).drop("_salt")


def asof_nearest(left: DataFrame, right: DataFrame, on: list[str], tolerance_sec: float, tie: str = "later",
                 left_ts: str = "ts", right_ts: str = "ts", slice_sec: float | None = None, prefix: str = "r_", rows: int = ROWS) -> DataFrame:
    """Two-sided nearest match in time, left outer, gap <= tolerance.

    Both sides are put in one order per key, at one time left rows before right ones, and cut into slices: each left row takes
    the last right row before it and the first at or after it, from its slice or else from what the slices around it
    hand on. No pairs are formed, and a burst of rows is split like any other stretch.
    Right rows with equal time: the last (by all columns) stands before, the first after.
    """
    width = max(slice_sec or 3600.0, 1e-3)
    tol = int(round(tolerance_sec * 1e6))
    names = [c for c in right.columns if c not in on]
    payload = F.struct(F.unix_micros(F.col(right_ts)).alias("_t"), *[F.col(c).alias(c) for c in names])
    r = right.select(*on, payload.alias("_r")).where("_r._t is not null").select(
        *on, F.col("_r._t").alias("_t"), F.lit(0).alias("_side"), "_r", F.lit(None).cast(left.schema).alias("_l"))
    l = left.select(*on, F.unix_micros(F.col(left_ts)).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"),
                    F.struct(*[F.col(c) for c in left.columns]).alias("_l"))
    both = sliced(r.unionByName(l), on, [F.col("_t"), F.desc("_side"), F.col("_r")], F.col("_t") / 1e6, width, rows)
    w, upto = W.partitionBy(*on, SLICE), (W.unboundedPreceding, 0)
    before = F.last("_r", ignorenulls=True).over(w.orderBy("_t", F.desc("_side"), "_r").rowsBetween(*upto))
    # the same order read backwards: a frame open to the end would be rescanned for every row
    after = F.last("_r", ignorenulls=True).over(w.orderBy(F.desc("_t"), "_side", F.desc("_r")).rowsBetween(*upto))
    ends = both.where("_side = 0").groupBy(*on, SLICE).agg(F.max("_r").alias("_last"), F.min("_r").alias("_first"))
    # slices of left rows alone need the chain's states as well
    ends = both.where("_side = 1").select(*on, SLICE).distinct().join(ends, [*on, SLICE], "full")
    along, past = W.partitionBy(*on), (W.unboundedPreceding, -1)
    ends = ends.select(*on, SLICE, F.last("_last", ignorenulls=True).over(along.orderBy(SLICE).rowsBetween(*past)).alias("_before"),
                       F.last("_first", ignorenulls=True).over(along.orderBy(F.desc(SLICE)).rowsBetween(*past)).alias("_after"))
    found = both.withColumn("_b", before).withColumn("_a", after).where("_side = 1").join(ends, [*on, SLICE], "left")
    found = found.withColumns({"_b": F.coalesce("_b", "_before"), "_a": F.coalesce("_a", "_after")})
    back, ahead = F.col("_t") - F.col("_b._t"), F.col("_a._t") - F.col("_t")
    take_after = F.col("_b").isNull() | (ahead <= back if tie == "later" else ahead < back)
    best = F.when(F.col("_a").isNotNull() & take_after, F.col("_a")).otherwise(F.col("_b"))
    found = found.withColumn("_m", best).withColumn("_gap", F.abs(F.col("_m._t") - F.col("_t")))
    found = found.withColumn("_m", F.when(F.col("_gap") <= tol, F.col("_m")))
    return found.select("_l.*", *[F.col(f"_m.{c}").alias(prefix + c) for c in names],
                        F.when(F.col("_m").isNotNull(), F.col("_gap") / 1e6).alias("gap_sec"))


def asof_claim(detections: DataFrame, samples: DataFrame, on: list[str], tolerance_sec: float, sample_id: str,
               order: tuple[str, ...] = ("ts", "source_index"), slice_sec: float | None = None, rows: int = ROWS) -> DataFrame:
    """Nearest match where a sample serves one detection: the earliest one wins, losers stay unmatched.

    The earliest claimant of a sample is a minimum, taken with a partial aggregate.
    """
    near = asof_nearest(detections, samples, on, tolerance_sec, "earlier", slice_sec=slice_sec, rows=rows)
    rank = F.struct(*[F.col(c) for c in order])
    claims = near.where(F.col(f"r_{sample_id}").isNotNull())
    winners = claims.groupBy(*on, f"r_{sample_id}").agg(F.min(rank).alias("_won"))
    judged = near.join(winners, [*on, f"r_{sample_id}"], "left")
    won = F.coalesce(rank == F.col("_won"), F.lit(False))
    cleared = [F.when(won, F.col(c)).alias(c) for c in near.columns if c.startswith("r_") or c == "gap_sec"]
    return judged.select(*[c for c in near.columns if not c.startswith("r_") and c != "gap_sec"], *cleared)


# --- space ---------------------------------------------------------------------------------

def _crossings(ring: Column, lon: Column, lat: Column) -> Column:
    """Number of ring edges crossed by the ray going east from the point."""
    legs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))
    def hit(leg: Column) -> Column:
        a, b = leg["a"], leg["b"]
        straddles = (a["lat"] > lat) != (b["lat"] > lat)
        at = (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]
        return F.when(straddles & (lon < at), 1).otherwise(0)
    return F.aggregate(legs, F.lit(0), lambda n, leg: n + hit(leg))


def point_in_polygon(rings: Column, lon: Column, lat: Column) -> Column:
    """Even-odd test over all rings (outer ring and holes), each closed."""
    total = F.aggregate(rings, F.lit(0), lambda n, ring: n + _crossings(ring, lon, lat))
    return total % 2 == 1


def parse_polygon(geojson: Column) -> Column:
    """GeoJSON Polygon text to rings of (lon, lat) points."""
    parsed = F.from_json(geojson, "type string, coordinates array<array<array<double>>>")
    return F.when(parsed["type"] == "Polygon", F.transform(parsed["coordinates"], lambda ring: F.transform(
        ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))))


BLOCK = 16
#: Level k has squares of 2 ** -k degrees.
LEVELS = 20


def _squares(low: Column, high: Column, level: Column) -> Column:
    scale = F.pow(F.lit(2.0), level)
    return F.sequence(F.floor(low * scale), F.floor(high * scale))


def _edge_meets_box(rings: Column, box: dict[str, Column]) -> Column:
    """Whether the box around any ring edge touches the box."""
    def touches(ring: Column) -> Column:
        legs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))
        def near(leg: Column) -> Column:
            a, b = leg["a"], leg["b"]
            return ((F.greatest(a["lat"], b["lat"]) >= box["south"]) & (F.least(a["lat"], b["lat"]) <= box["north"])
                    & (F.greatest(a["lon"], b["lon"]) >= box["west"]) & (F.least(a["lon"], b["lon"]) <= box["east"]))
        return F.exists(legs, near)
    return F.exists(rings, touches)


def polygon_blocks(cells: DataFrame, polygons: DataFrame) -> DataFrame:
    """Polygons with the blocks of ``BLOCK`` x ``BLOCK`` cells (``_br``, ``_bc``) that they may hold cells of.

    Polygons and blocks meet on squares of a hierarchy: a polygon takes the level at which it spans two squares a side, or the finest at
    which a block of its mission still does, blocks name their squares of all these levels. ``_whole`` tells blocks
    without a piece of the polygon's edge: they lie inside as a whole, and those outside are dropped.
    """
    blocks = cells.groupBy("mission_id", F.floor(F.col("row") / BLOCK).alias("_br"), F.floor(F.col("col") / BLOCK).alias("_bc")).agg(
        F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
    extent = lambda south, north, west, east: F.greatest(north - south, east - west, F.lit(1e-9))
    level = lambda size: F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.floor(-F.log2(size)))).cast("int")
    box = [F.col(c) for c in ("south", "north", "west", "east")]
    blocks = blocks.withColumn("_finest", level(F.max(extent(*box)).over(mission_window())))
    finest = blocks.groupBy("mission_id").agg(F.max("_finest").alias("_finest"))
    flat = F.flatten("rings")
    side = lambda pick, part: pick(F.transform(flat, lambda p: p[part]))
    boxed = polygons.withColumns({"_south": side(F.array_min, "lat"), "_north": side(F.array_max, "lat"),
                                  "_west": side(F.array_min, "lon"), "_east": side(F.array_max, "lon")}).where("_south is not null")
    boxed = salted_join(boxed, few(finest), ["mission_id"])
    own = [F.col(f"_{c}") for c in ("south", "north", "west", "east")]
    boxed = boxed.withColumn("_level", F.least("_finest", level(extent(*own)))).drop("_finest")
    boxed = boxed.withColumn("_y", F.explode(_squares(own[0], own[1], F.col("_level")))).withColumn("_x", F.explode(_squares(own[2], own[3], F.col("_level"))))
    placed = blocks.withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_finest")))).drop("_finest")
    placed = placed.withColumn("_y", F.explode(_squares(box[0], box[1], F.col("_level")))).withColumn("_x", F.explode(_squares(box[2], box[3], F.col("_level"))))
    met = boxed.join(dense(placed), ["mission_id", "_level", "_y", "_x"]).where(
        (F.col("north") >= own[0]) & (F.col("south") <= own[1]) & (F.col("east") >= own[2]) & (F.col("west") <= own[3]))
    # a pair that shares several squares counts in the first of them
    first = lambda a, b: F.floor(F.greatest(a, b) * F.pow(F.lit(2.0), F.col("_level")))
    met = met.where((F.col("_y") == first(own[0], box[0])) & (F.col("_x") == first(own[2], box[2])))
    edge = _edge_meets_box(F.col("rings"), {c: F.col(c) for c in ("south", "north", "west", "east")})
    met = met.withColumn("_whole", ~edge)
    return met.where(~F.col("_whole") | point_in_polygon(F.col("rings"), F.col("west"), F.col("south"))).drop(
        "south", "north", "west", "east", "_level", "_y", "_x")


def cells_in_polygon(cells: DataFrame, polygons: DataFrame) -> DataFrame:
    """Cells whose centre lies in a polygon of their mission; a cell once per polygon that holds it.

    ``cells`` carries lat/lon; ``polygons`` is (mission_id, rings, ...). Polygons meet blocks of cells (``polygon_blocks``), and only
    blocks that the polygon's edge runs through are tested cell by cell. Polygons without points hold nothing.
    """
    block = {"_br": F.floor(F.col("row") / BLOCK), "_bc": F.floor(F.col("col") / BLOCK)}
    near = dense(cells).withColumns(block).join(polygon_blocks(cells, polygons), ["mission_id", "_br", "_bc"])
    inside = F.col("lon").between(F.col("_west"), F.col("_east")) & F.col("lat").between(F.col("_south"), F.col("_north"))
    hit = F.when(F.col("_whole"), F.lit(True)).when(inside, point_in_polygon(F.col("rings"), F.col("lon"), F.col("lat"))).otherwise(F.lit(False))
    return near.where(hit).drop("_br", "_bc", "_west", "_east", "_south", "_north", "_whole")


def disc_cells(points: DataFrame, radius_m: float, res_m: float, keep: list[str]) -> DataFrame:
    """Cells whose centre is within ``radius_m`` of each point, at least the cell under it.

    Points off the grid are dropped. The cell under the point has the nearest centre of all,
    so keeping it always equals "the disc, or that cell when the disc holds no centre".
    ``res_m`` is the finest resolution of the table: it sets how many cells are looked at.
    """
    placed = point_to_cell(points)
    reach = 0 if radius_m <= 0 else -int(-radius_m // res_m)
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    out = placed.withColumn("_dr", F.explode(steps)).withColumn("_dc", F.explode(steps))
    row, col = F.col("row") + F.col("_dr"), F.col("col") + F.col("_dc")
    size, res = F.col("size"), F.col("res_m")
    de = geo.cell_easting(F.col("origin_e"), col, size, res) - F.col("point_e")
    dn = geo.cell_northing(F.col("origin_n"), row, size, res) - F.col("point_n")
    near = (de * de + dn * dn <= radius_m * radius_m) | ((F.col("_dr") == 0) & (F.col("_dc") == 0))
    inside = (row >= 0) & (row < size) & (col >= 0) & (col < size)
    return out.where(inside & near).select(*keep, row.alias("row"), col.alias("col"))


def lookup_cells(points: DataFrame, cells: DataFrame, values: list[str]) -> DataFrame:
    """Attribute lookup of placed points; salted because one cell may hold most points.

    The dense table meets the distinct cells of the points first, so that only cells in use are repeated per salt.
    """
    used = dense(cells).select(*CELL_KEYS, *values).join(points.select(*CELL_KEYS).distinct(), list(CELL_KEYS))
    return salted_join(points, used, list(CELL_KEYS), meet="merge")


def nearest_cell(places: DataFrame, cells: DataFrame, wanted: Column) -> DataFrame:
    """Nearest cell of the same mission where ``wanted`` holds, for placed points that need one.

    The answer depends on the cell only, so it is found once per distinct (mission, cell): the
    column-wise nearest by running windows, then the best column of the row (the same two
    passes as the road distance). First in row-major order on ties.
    """
    down = W.partitionBy("mission_id", "col").orderBy("row")
    hits = cells.withColumn("_hit", F.when(wanted, F.col("row")))
    hits = hits.withColumn("_n", F.last("_hit", ignorenulls=True).over(down.rowsBetween(W.unboundedPreceding, 0))).withColumn(
        "_s", F.last("_hit", ignorenulls=True).over(
            W.partitionBy("mission_id", "col").orderBy(F.desc("row")).rowsBetween(W.unboundedPreceding, 0)))
    nearest = F.when(F.col("_s").isNull() | (F.col("row") - F.col("_n") <= F.col("_s") - F.col("row")), F.col("_n")).otherwise(F.col("_s"))
    needed = places.select(*CELL_KEYS).distinct()
    # a row's candidates are gathered once per row that is asked for, one per column
    asked = hits.withColumn("_r", nearest).where("_r is not null").join(needed.select("mission_id", "row").distinct(), ["mission_id", "row"], "left_semi")
    lines = needed.join(asked.groupBy("mission_id", "row").agg(F.collect_list(F.struct("col", F.col("_r").alias("r"))).alias("_line")), ["mission_id", "row"])
    def candidate(x: Column) -> Column:
        dr, dc = x["r"] - F.col("row"), x["col"] - F.col("col")
        return F.struct((dr * dr + dc * dc).alias("d2"), x["r"].alias("row"), x["col"].alias("col"))
    answers = lines.withColumn("_b", F.array_min(F.transform("_line", candidate))).select(
        *CELL_KEYS, F.col("_b.row").alias("near_row"), F.col("_b.col").alias("near_col"), F.col("_b.d2").alias("near_d2"))
    return salted_join(places, answers, list(CELL_KEYS), "left", meet="merge")


def ticks_join(records: DataFrame, missions: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Records with their mission's columns and the tick whose window holds them."""
    from ..functions.scalars import tick_of
    joined = salted_join(records, missions, ["mission_id"])
    return joined.withColumn("tick", tick_of(F.col("ts"), F.col("lkp_ts"), F.col("step_sec"))).where("tick >= 1")
