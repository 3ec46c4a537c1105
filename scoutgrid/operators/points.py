"""Weighted points: density surface, effective sample size, resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import geo
from ..session import shuffle_partitions
from ..settings import DEFAULTS, Settings
from .grid import CELL_KEYS, normalize
from .raster import edge_fade, road_factor
from .joins import salted_join
from .slices import SLICE, previous, running_sum, slice_of

CHUNK = 10_000
#: Points of a mission that are spread over its cells in one place.
PART_POINTS = 2_000


def effective_sample_size(points: DataFrame, keys=("mission_id",)) -> DataFrame:
    """1 / sum of squared weights, and whether it calls for resampling (< n / 2)."""
    ess = 1.0 / F.sum(F.col("weight") * F.col("weight"))
    return points.groupBy(*keys).agg(ess.alias("ess"), F.count("*").alias("n")).withColumn("resample", F.col("ess") < F.col("n") / 2)


def kde_surface(points: DataFrame, cells: DataFrame, road_weight: float = 1.0, fade_cells: int = 0, settings: Settings = DEFAULTS) -> DataFrame:
    """Gaussian density of weighted points on all cells of the grid, mass 1 per mission (0 everywhere for one without points).

    ``points`` carries weight, point_e, point_n and its mission's origin, size and res_m; ``cells`` are (mission_id, row, col, size), with
    ``road_proximity`` where roads attract. A point is spread over the cells of its support only. A mission's points meet in parts of
    about ``PART_POINTS`` first, so that their cells are summed where they are spread and a part gives at most its grid; a busy mission has many
    parts. The grid comes in as rows of no weight under the last aggregate, so that no cells are joined.
    """
    reach = max(4, math.ceil(3.0 * settings.kde_bandwidth))
    size, res = F.col("size"), F.col("res_m")
    # place measured in cells from the centre of cell (0, 0)
    row_f = geo.fractional_row(F.col("point_n"), F.col("origin_n"), size, res) - 0.5
    col_f = geo.fractional_col(F.col("point_e"), F.col("origin_e"), size, res) - 0.5
    def support(x: Column) -> Column:
        lo = F.greatest(F.lit(0), F.floor(x - reach).cast("int"))
        hi = F.least(size - 1, F.ceil(x + reach).cast("int"))
        return F.when(lo <= hi, F.sequence(lo, hi))
    placed = points.select("mission_id", "size", "weight", row_f.alias("_rf"), col_f.alias("_cf"))
    parts = points.groupBy("mission_id").agg(F.ceil(F.count("*") / PART_POINTS).alias("_parts"))
    dealt = salted_join(placed, parts, ["mission_id"]).withColumn("_part", F.pmod(F.xxhash64("_rf", "_cf", "weight"), F.col("_parts")))
    dealt = dealt.drop("_parts").repartition(shuffle_partitions(points.sparkSession), "mission_id", "_part")
    spread = dealt.select(
        "mission_id", "size", "weight", "_part", "_rf", "_cf", F.explode(support(F.col("_rf"))).alias("row"), support(F.col("_cf")).alias("_cols"))
    spread = spread.select("mission_id", "size", "weight", "_part", "_rf", "_cf", "row", F.explode("_cols").alias("col"))
    dr, dc = F.col("row") - F.col("_rf"), F.col("col") - F.col("_cf")
    kernel = F.exp(-0.5 * (dr * dr + dc * dc) / settings.kde_bandwidth**2)
    near = F.col("road_proximity") if "road_proximity" in cells.columns else F.lit(0.0)
    local = spread.groupBy(*CELL_KEYS, "size", "_part").agg(F.sum(F.col("weight") * kernel).alias("p"))
    rows = local.select(*CELL_KEYS, "size", "p", F.lit(0.0).alias("_near")).unionByName(
        cells.select(*CELL_KEYS, "size", F.lit(0.0).alias("p"), near.alias("_near")))
    summed = rows.groupBy(*CELL_KEYS, "size").agg(F.sum("p").alias("p"), F.max("_near").alias("_near"))
    lifted = summed.withColumn("p", F.col("p") * road_factor(F.col("_near"), road_weight, settings)).drop("_near")
    return edge_fade(normalize(lifted), fade_cells)


def systematic_resample(points: DataFrame, u0: Column, order: str = "idx", keys: list[str] | None = None, block: int = 100_000) -> DataFrame:
    """Systematic resampling with one offset ``u0`` in [0, 1/n) per set; weights become 1/n.

    Point i is drawn once for every position u0 + j/n in (sum before, sum with it]; the running
    sum is built in two levels and long runs of copies are dealt out in chunks.
    """
    keys = keys or ["mission_id"]
    n = points.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(order).alias("_last"))
    blocks = points.withColumn(SLICE, slice_of(F.col(order), block))
    summed = running_sum(blocks, keys, [order], "weight", "_hi")
    bounded = previous(summed, keys, [order], F.struct(F.col("_hi").alias("hi"))).drop(SLICE)
    sized = salted_join(bounded, n, keys).withColumn("_u0", u0)
    def upto(total: Column) -> Column:
        return F.floor((total - F.col("_u0")) * F.col("_n")).cast("bigint")
    low = F.coalesce(F.greatest(F.lit(0).cast("bigint"), upto(F.col("prev.hi")) + 1), F.lit(0).cast("bigint"))
    high = F.when(F.col(order) == F.col("_last"), F.col("_n") - 1).otherwise(F.least(F.col("_n") - 1, upto(F.col("_hi"))))
    drawn = sized.withColumn("_lo", low).withColumn("_to", high).where(F.col("_lo") <= F.col("_to"))
    chunks = drawn.withColumn("_c", F.explode(F.sequence(F.col("_lo"), F.col("_to"), F.lit(CHUNK).cast("bigint"))))
    copies = chunks.withColumn("draw", F.explode(F.sequence(F.col("_c"), F.least(F.col("_to"), F.col("_c") + CHUNK - 1))))
    return copies.withColumn("weight", 1.0 / F.col("_n")).select(*points.columns, "draw")


def top_points(points: DataFrame, limit: int = DEFAULTS.peak_limit, order: str = "idx") -> DataFrame:
    """Heaviest points per mission (the limit is the feature)."""
    w = W.partitionBy("mission_id").orderBy(F.desc("weight"), F.desc(order))
    return points.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
