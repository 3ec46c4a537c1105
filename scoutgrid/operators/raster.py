"""Map algebra on cell tables: focal windows, slope, land, roads, resampling, fades."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import geo
from ..settings import DEFAULTS, Settings
from .grid import CELL_KEYS, dense, few, mission_sum, mission_window

# The smoothing kernel before slopes are taken.
SMOOTH_KERNEL = ((1, 2, 1), (2, 4, 2), (1, 2, 1))


def _line(keys, fixed: str, moving: str):
    return W.partitionBy(*keys, fixed).orderBy(moving)


def _nearest_along(value: str, step: int, window) -> Column:
    """Value ``step`` places along the window; past the border the last cell repeats."""
    shift = F.lead if step > 0 else F.lag
    return F.coalesce(*[shift(value, k).over(window) for k in range(abs(step), 0, -1)], F.col(value))


def neighbourhood(cells: DataFrame, value: str, reach: int, keys=("mission_id",)) -> DataFrame:
    """Columns ``_n<dr>_<dc>`` of the (2 reach + 1)^2 neighbours, borders replicated.

    Two sorts inside the mission's partition (along rows, then along columns).
    """
    steps = range(-reach, reach + 1)
    across, down = _line(keys, "row", "col"), _line(keys, "col", "row")
    out = cells.select("*", *[_nearest_along(value, s, across).alias(f"_h{s}") for s in steps])
    return out.select(
        *cells.columns, *[_nearest_along(f"_h{c}", r, down).alias(f"_n{r}_{c}") for r in steps for c in steps])


def focal_sum(cells: DataFrame, value: str, kernel, out: str, keys=("mission_id",)) -> DataFrame:
    """Weighted sum over a square odd kernel with replicated borders."""
    reach = len(kernel) // 2
    terms = [F.col(f"_n{r}_{c}") * float(kernel[r + reach][c + reach])
             for r in range(-reach, reach + 1) for c in range(-reach, reach + 1) if kernel[r + reach][c + reach]]
    near = neighbourhood(cells, value, reach, keys)
    kept = [F.col(c) for c in cells.columns if c != out]
    return near.select(*kept, reduce(lambda a, b: a + b, terms).alias(out))


def smooth(cells: DataFrame, value: str = "elevation", passes: int = 1, keys=("mission_id",)) -> DataFrame:
    weight = sum(map(sum, SMOOTH_KERNEL))
    kernel = [[k / weight for k in line] for line in SMOOTH_KERNEL]
    for _ in range(passes):
        cells = focal_sum(cells, value, kernel, value, keys)
    return cells


def _central(value: str, window, spacing: Column) -> Column:
    """Central difference, one-sided at the ends."""
    ahead, behind = F.lead(value).over(window), F.lag(value).over(window)
    gap = ahead.isNotNull().cast("int") + behind.isNotNull().cast("int")
    rise = F.coalesce(ahead, F.col(value)) - F.coalesce(behind, F.col(value))
    return F.when(gap == 0, 0.0).otherwise(rise / (gap * spacing))


def slope_aspect(cells: DataFrame, value: str = "elevation", keys=("mission_id",), northward_aspect: bool = False) -> DataFrame:
    """Slope (radians) and the unit downhill direction.

    ``aspect_n`` is the negated gradient along rows, which grow southward; ``northward_aspect`` turns
    the axis, so that it points downhill toward north.
    """
    gx = _central(value, _line(keys, "row", "col"), F.col("res_m"))
    gy = _central(value, _line(keys, "col", "row"), F.col("res_m"))
    out = cells.withColumn("_gx", gx).withColumn("_gy", gy)
    steep = F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))
    north = F.col("_gy") / (steep + 1e-8)
    return out.withColumns({
        "slope": F.atan(steep), "aspect_e": -F.col("_gx") / (steep + 1e-8),
        "aspect_n": north if northward_aspect else -north}).drop("_gx", "_gy")


def land_mask(cells: DataFrame, settings: Settings = DEFAULTS, keys=("mission_id",)) -> DataFrame:
    """``is_land`` from elevation; a mission without usable elevation is flat land."""
    usable = F.max("elevation").over(mission_window(keys)) > 1e-9
    return (
        cells.withColumn("_usable", F.coalesce(usable, F.lit(False)))
        .withColumn("elevation", F.when(F.col("_usable"), F.col("elevation")).otherwise(0.0))
        .withColumn("is_land", ~F.col("_usable") | (F.col("elevation") > settings.land_threshold_m))
        .drop("_usable")
    )


def terrain_classes(cells: DataFrame, settings: Settings = DEFAULTS, keys=("mission_id",)) -> DataFrame:
    """Steep, cliff, ridge and valley flags (needs ``slope``) and the topographic position."""
    k = settings.tpi_window
    near = focal_sum(cells, "elevation", [[1] * k] * k, "_around", keys)
    tpi = F.col("elevation") - (F.col("_around") - F.col("elevation")) / (k * k - 1)
    deg = F.degrees("slope")
    return near.withColumn("tpi", tpi).withColumns({
        "is_steep": deg >= settings.steep_deg, "is_cliff": deg >= settings.cliff_deg,
        "is_valley": F.col("tpi") <= -settings.valley_m, "is_ridge": F.col("tpi") >= settings.ridge_m}).drop("_around")


def terrain_weight(settings: Settings = DEFAULTS) -> Column:
    pairs = (("is_steep", settings.steep_weight), ("is_cliff", settings.cliff_weight),
             ("is_valley", settings.valley_weight), ("is_ridge", settings.ridge_weight))
    return reduce(lambda a, b: a * b, [F.when(F.col(c), w).otherwise(1.0) for c, w in pairs])


# --- sampling and resampling ---------------------------------------------------------------

def sample_stride(size: Column, samples: int = DEFAULTS.elevation_samples) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sqrt(size * size / F.lit(float(samples)))).cast("int"))


def strided_cells(cells: DataFrame, stride: Column | None = None) -> DataFrame:
    """Every n-th cell in both directions, with its place ``coarse_row``/``coarse_col``."""
    step = stride if stride is not None else sample_stride(F.col("size"))
    return cells.withColumn("_step", step).where((F.col("row") % F.col("_step") == 0) & (F.col("col") % F.col("_step") == 0)).withColumns({
        "coarse_row": (F.col("row") / F.col("_step")).cast("int"),
        "coarse_col": (F.col("col") / F.col("_step")).cast("int")}).drop("_step")


def scatter_samples(samples: DataFrame, readings: DataFrame, value: str) -> DataFrame:
    """Attach provider readings to the sampled cells by (mission, row, col); absent ones are 0."""
    got = readings.select(*CELL_KEYS, F.col(value).alias("_reading"))
    return samples.join(got, list(CELL_KEYS), "left").withColumn(value, F.coalesce("_reading", F.lit(0.0))).drop("_reading")


def resample_bilinear(targets: DataFrame, source: DataFrame, value: str, source_size: Column, out: str,
                      edge: str = "zero", keep: tuple[str, ...] = CELL_KEYS) -> DataFrame:
    """Bilinear sample of ``source`` (mission, row, col, value) at ``row_f``/``col_f`` of the targets.

    Each target reads its four corners from its mission's field, which is one array of cells in row-major order (an equi-join by
    mission: targets stay where they are and are not multiplied), and adds them up. A field with gaps is searched by cell. Outside the
    source ``zero`` gives 0 while ``clamp`` extends the border cell.
    """
    top = source_size - 1
    r0, c0 = F.floor("row_f").cast("int"), F.floor("col_f").cast("int")
    inside = (r0 >= 0) & (c0 >= 0) & (r0 <= top) & (c0 <= top)
    def limit(x: Column) -> Column:
        return F.greatest(F.lit(0), F.least(top, x))
    base = targets.select(*keep, "row_f", "col_f", inside.alias("_in"), limit(r0).alias("_r0"), limit(c0).alias("_c0"), top.alias("_top"))
    dr, dc = F.col("row_f") - F.col("_r0"), F.col("col_f") - F.col("_c0")
    r1, c1 = F.least(F.col("_r0") + 1, F.col("_top")), F.least(F.col("_c0") + 1, F.col("_top"))
    def weight(w: Column) -> Column:
        return w if edge == "clamp" else F.when(F.col("_in"), w).otherwise(0.0)
    corners = {"00": (F.col("_r0"), F.col("_c0"), (1 - dr) * (1 - dc)), "01": (F.col("_r0"), c1, (1 - dr) * dc),
               "10": (r1, F.col("_c0"), dr * (1 - dc)), "11": (r1, c1, dr * dc)}
    asked = base.select(*keep, *[x for n, (r, c, w) in corners.items() for x in (r.alias(f"_r{n}"), c.alias(f"_c{n}"), weight(w).alias(f"_w{n}"))])
    known = source.where("row >= 0 and col >= 0").groupBy(*CELL_KEYS).agg(F.sum(value).alias("_v"))
    known = known.withColumn("_width", F.max(F.col("col") + 1).over(mission_window()))
    fields = known.groupBy("mission_id", F.col("_width").cast("bigint").alias("_width")).agg(
        F.sort_array(F.collect_list(F.struct((F.col("row") * F.col("_width").cast("bigint") + F.col("col")).alias("k"), F.col("_v").alias("v")))).alias("_f"))
    fields = fields.select("mission_id", "_width", F.col("_f.k").alias("_k"), F.col("_f.v").alias("_v")).withColumn(
        "_whole", F.element_at("_k", -1) == F.size("_k") - 1)
    joined = asked.join(few(fields), "mission_id")
    places = []
    for n in corners:
        k = F.col(f"_r{n}") * F.col("_width") + F.col(f"_c{n}")
        at = F.when(F.col("_whole"), F.when(k < F.size("_k"), k)).otherwise(F.array_position("_k", k) - 1)
        places.append(F.when((F.col(f"_c{n}") < F.col("_width")) & (at >= 0), at.cast("int")).alias(f"_at{n}"))
    found = joined.select(*keep, "_v", *[f"_w{n}" for n in corners], *places)
    terms = [F.when(F.col(f"_at{n}").isNotNull(), F.col(f"_w{n}") * F.get("_v", F.col(f"_at{n}"))) for n in corners]
    total = F.when(F.coalesce(*terms).isNotNull(), sum(F.coalesce(t, F.lit(0.0)) for t in terms))
    met = F.coalesce(*[F.col(f"_at{n}") for n in corners]).isNotNull()
    return found.select(*keep, total.alias("_sum"), met.alias("_met")).where("_met").groupBy(*keep).agg(F.sum("_sum").alias(out))


def upsample_targets(cells: DataFrame, coarse_size: Column) -> DataFrame:
    """Place of each fine cell on a coarse grid whose outer samples meet the outer cells."""
    scale = (coarse_size - 1) / F.greatest(F.col("size") - 1, F.lit(1))
    return cells.withColumn("row_f", F.col("row") * scale).withColumn("col_f", F.col("col") * scale)


def regrid_targets(cells: DataFrame, factor: int) -> DataFrame:
    """Places on the cell grid of a display ``factor`` times finer."""
    fine = F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))
    return (
        cells.withColumn("_i", fine).withColumn("_j", fine)
        .withColumn("out_row", F.col("row") * factor + F.col("_i")).withColumn("out_col", F.col("col") * factor + F.col("_j"))
        .withColumn("row_f", (F.col("out_row") + 0.5) / factor - 0.5).withColumn("col_f", (F.col("out_col") + 0.5) / factor - 0.5)
        .drop("_i", "_j")
    )


def fields_on_grid(display: DataFrame, source_missions: DataFrame) -> DataFrame:
    """Fractional source-grid place of each display cell when the two grids differ.

    ``source_missions`` names the source grid of each mission as ``source_origin_e``,
    ``source_origin_n``, ``source_epsg``, ``source_size`` and ``source_res_m``.
    """
    placed = geo.with_latlon(display.join(few(source_missions), "mission_id"), "easting", "northing", "epsg", "_lat", "_lon")
    placed = geo.with_utm(placed, "_lat", "_lon", "source_epsg", "_e", "_n")
    size, res = F.col("source_size"), F.col("source_res_m")
    return placed.withColumn("row_f", geo.fractional_row(F.col("_n"), F.col("source_origin_n"), size, res)).withColumn(
        "col_f", geo.fractional_col(F.col("_e"), F.col("source_origin_e"), size, res)).drop("_lat", "_lon", "_e", "_n")


# --- roads ---------------------------------------------------------------------------------

def _inside_range(before: Column, span: Column) -> tuple[Column, Column]:
    """First and last sample number of a leg that may lie on the grid, a sample to spare on both sides."""
    steps = F.col("steps")
    def along(start: Column, move: Column) -> tuple[Column, Column]:
        """Sample numbers at which start + k / steps * move enters and leaves 0 .. span."""
        a, b = -start / move * steps, (span - start) / move * steps
        out = (start < 0) | (start > span)
        still = move == 0
        return (F.when(still, F.when(out, steps + 2.0).otherwise(0.0)).otherwise(F.least(a, b)),
                F.when(still, F.when(out, -2.0).otherwise(steps.cast("double"))).otherwise(F.greatest(a, b)))
    e0, e1 = along(F.col("ae") - (F.col("origin_e") - before), F.col("de"))
    n0, n1 = along(F.col("origin_n") + before - F.col("an"), -F.col("dn"))
    low, high = F.greatest(e0, n0) - 1, F.least(e1, n1) + 1
    return (F.greatest(F.lit(0.0), F.least(F.floor(low).cast("double"), steps + 1.0)).cast("int"),
            F.greatest(F.lit(-1.0), F.least(F.ceil(high).cast("double"), steps.cast("double"))).cast("int"))


def road_cells(roads: DataFrame, missions: DataFrame, cell_convention: bool = False) -> DataFrame:
    """Cells touched by polylines with their mean unit tangent and the grid's size.

    ``roads`` is (mission_id, way_id, pts array<struct<lon,lat>>), ``missions`` carries the
    origin. Edges are split inside their own row, so polylines are never regrouped; samples
    are averaged per cell with a map-side partial aggregate. The grid edge lies size * res / 2 from the pin;
    ``cell_convention`` puts it where cells have theirs, half a cell farther for even sizes. Legs are cut to the
    samples whose place can lie on the grid before any sample is made.
    """
    size, res = F.col("size"), F.col("res_m")
    legs = F.arrays_zip(F.slice("pts", 1, F.size("pts") - 1).alias("a"), F.slice("pts", 2, F.size("pts") - 1).alias("b"))
    edges = (
        roads.where(F.size("pts") >= 2).select("mission_id", F.explode(legs).alias("leg"))
        .select("mission_id", *[F.col(f"leg.{k}.{p}").alias(f"{k}_{p}") for k in "ab" for p in ("lon", "lat")])
        .join(missions.select("mission_id", "epsg", "origin_e", "origin_n", "size", "res_m"), "mission_id")
    )
    edges = geo.with_utm(edges, "a_lat", "a_lon", "epsg", "ae", "an")
    edges = geo.with_utm(edges, "b_lat", "b_lon", "epsg", "be", "bn")
    edges = edges.withColumn("de", F.col("be") - F.col("ae")).withColumn("dn", F.col("bn") - F.col("an"))
    edges = edges.withColumn("length", F.hypot("de", "dn")).withColumn(
        "steps", F.greatest(F.lit(1), F.floor(F.col("length") / (res * 0.5)).cast("int")))
    before = geo.edge_before(size, res) if cell_convention else size * res / 2
    t = F.col("k") / F.col("steps")
    first, last = _inside_range(before, size * res)
    places = F.when((F.col("length") > 0) & (first <= last), F.sequence(first, last))  # no filter: see point_to_cell
    samples = edges.withColumn("k", F.explode(places)).select(
        "mission_id", size.alias("_size"),
        F.floor((F.col("origin_n") + before - (F.col("an") + t * F.col("dn"))) / res).cast("int").alias("row"),
        F.floor((F.col("ae") + t * F.col("de") - (F.col("origin_e") - before)) / res).cast("int").alias("col"),
        (F.col("de") / F.col("length")).alias("te"), (F.col("dn") / F.col("length")).alias("tn"))
    inside = (F.col("row") >= 0) & (F.col("row") < F.col("_size")) & (F.col("col") >= 0) & (F.col("col") < F.col("_size"))
    return samples.where(inside).groupBy(*CELL_KEYS).agg(
        F.avg("te").alias("tangent_e"), F.avg("tn").alias("tangent_n"), F.max("_size").alias("size"))


def _nearest_marks(rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    """Index of the nearest mark for every cell of an n x n grid, row-major.

    First the nearest mark of each column, then the best column of each row. Ties go to the
    smaller column, then the smaller row.
    """
    far = 4 * n
    line = np.arange(n)
    away, which = np.full((n, n), far), np.full((n, n), -1)
    for i in np.lexsort((-rows, cols)):  # larger rows first, so that smaller ones win ties
        gap = np.abs(line - rows[i])
        closer = gap <= away[:, cols[i]]
        away[closer, cols[i]], which[closer, cols[i]] = gap[closer], i
    best, answer = np.full((n, n), 2 * far * far), np.full((n, n), -1)
    for c in np.unique(cols):
        total = (away[:, [c]]) ** 2 + (line[None, :] - c) ** 2
        closer = total < best
        best = np.where(closer, total, best)
        answer = np.where(closer, which[:, [c]], answer)
    return answer.ravel()


def road_fields(cells: DataFrame, touched: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Exact distance to the nearest road cell, proximity and that cell's tangent.

    A mission's road cells (never more than its grid holds) go to one group, which answers for
    all its cells; the dense table is not shipped there. Missions without roads get zeros.
    """
    def answer(table: pa.Table) -> pa.Table:
        n = table["size"][0].as_py()
        rows, cols = table["row"].to_numpy(), table["col"].to_numpy()
        at = _nearest_marks(rows, cols, n)
        r, c = np.divmod(np.arange(n * n), n)
        return pa.table({
            "mission_id": np.full(n * n, table["mission_id"][0].as_py(), dtype="int64"), "row": r.astype("int32"), "col": c.astype("int32"),
            "_d": np.hypot(r - rows[at], c - cols[at]), "_te": table["tangent_e"].to_numpy()[at], "_tn": table["tangent_n"].to_numpy()[at]})

    near = touched.select("mission_id", "row", "col", "size", "tangent_e", "tangent_n").groupBy("mission_id").applyInArrow(answer, "mission_id bigint, row int, col int, _d double, _te double, _tn double")
    dist = F.col("_d") * F.col("res_m")
    out = cells.join(dense(near), list(CELL_KEYS), "left")
    return out.select(
        *cells.columns, dist.alias("road_dist_m"), F.coalesce(F.exp(-dist / settings.road_decay_m), F.lit(0.0)).alias("road_proximity"),
        F.coalesce("_te", F.lit(0.0)).alias("road_tangent_e"), F.coalesce("_tn", F.lit(0.0)).alias("road_tangent_n"))


def is_road(proximity: Column, settings: Settings = DEFAULTS) -> Column:
    return proximity >= F.exp(F.lit(-settings.road_snap_m / settings.road_decay_m))


def road_factor(proximity: Column, weight: float = 1.0, settings: Settings = DEFAULTS) -> Column:
    return 1.0 + settings.road_bonus * weight * proximity


# --- assembled node fields -----------------------------------------------------------------

def node_fields(cells: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Defaults and derived fields of a cell: roads, wind, and current on water only.

    Missing inputs fall back to a field of zeros, flat land and reach 1. ``weather`` switches
    the wind on; ``current_u``/``current_v`` per mission come from the marine reader.
    """
    have = set(cells.columns)
    zero = {"elevation", "slope", "road_proximity", "road_tangent_e", "road_tangent_n", "reach_score", "searched_clean"} - have
    out = cells.withColumns({c: F.lit(0.0) for c in sorted(zero)}) if zero else cells
    if "is_land" not in have:
        out = out.withColumn("is_land", F.lit(True))
    if "reach" not in have:
        out = out.withColumn("reach", F.lit(1.0))
    heading = F.radians(F.lit(settings.drift_heading_deg))
    u = F.coalesce("marine_u", settings.drift_speed_mps * F.sin(heading)) if "marine_u" in have else settings.drift_speed_mps * F.sin(heading)
    v = F.coalesce("marine_v", settings.drift_speed_mps * F.cos(heading)) if "marine_v" in have else settings.drift_speed_mps * F.cos(heading)
    windy = F.coalesce(F.col("weather"), F.lit(False)) if "weather" in have else F.lit(False)
    return out.withColumns({
        "altitude": F.col("elevation"), "is_road": is_road(F.col("road_proximity"), settings),
        "wind_u": F.when(windy, settings.wind_u).otherwise(0.0), "wind_v": F.when(windy, settings.wind_v).otherwise(0.0),
        "current_u": F.when(F.col("is_land"), 0.0).otherwise(u), "current_v": F.when(F.col("is_land"), 0.0).otherwise(v)})


# --- fades ---------------------------------------------------------------------------------

def _smoothstep(t: Column) -> Column:
    return t * t * (3.0 - 2.0 * t)


def _rescaled(cells: DataFrame, fade: Column, value: str, keys) -> DataFrame:
    out = cells.withColumn("_f", F.col(value) * fade).withColumn("_t", mission_sum("_f", keys))
    return out.withColumn(value, F.when(F.col("_t") > 0, F.col("_f") / F.col("_t")).otherwise(F.col("_f"))).drop("_f", "_t")


def edge_fade(cells: DataFrame, fade_cells: int, value: str = "p", keys=("mission_id",)) -> DataFrame:
    if fade_cells <= 0:
        return cells
    last = F.col("size") - 1
    border = F.least(F.col("row"), last - F.col("row"), F.col("col"), last - F.col("col"))
    return _rescaled(cells, _smoothstep(F.least(border / F.lit(float(fade_cells)), F.lit(1.0))), value, keys)


def radial_fade(cells: DataFrame, fade_end: float, value: str = "p", keys=("mission_id",)) -> DataFrame:
    if fade_end >= 1.0:
        return cells
    mid = (F.col("size") - 1) / 2.0
    dist = F.sqrt(F.pow((F.col("row") - mid) / mid, 2) + F.pow((F.col("col") - mid) / mid, 2))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dist - fade_end) / max(1.0 - fade_end, 1e-3)))
    return _rescaled(cells, 1.0 - _smoothstep(t), value, keys)
