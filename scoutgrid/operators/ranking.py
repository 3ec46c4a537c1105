"""Where to look: most probable position and top cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..settings import DEFAULTS, Settings
from .grid import mission_window, with_cell_latlon


def mpp(cells: DataFrame, settings: Settings = DEFAULTS, keys=("mission_id",)) -> DataFrame:
    """Weighted centre of the cells at or above the 95th percentile of positive mass.

    The one-cell border is left out unless nothing else has mass; without any mass the pin
    is the answer. Everything runs on the mission's partition.
    """
    w = mission_window(keys)
    least, last = settings.min_mass, F.col("size") - 1
    interior = ((F.col("row") > 0) & (F.col("row") < last) & (F.col("col") > 0) & (F.col("col") < last)) | (F.col("size") <= 2)
    out = cells.withColumn("_in", interior)
    out = out.withColumn("_has", F.max(F.col("_in") & (F.col("p") > least)).over(w))
    out = out.withColumn("_v", F.when(F.col("_in") | ~F.col("_has"), F.col("p")).otherwise(0.0))
    out = out.withColumn("_cut", F.percentile(F.when(F.col("_v") > least, F.col("_v")), F.lit(0.95)).over(w))
    out = with_cell_latlon(out.withColumn("_w", F.when(F.col("_v") >= F.col("_cut"), F.col("_v")))
                           .where("_w is not null or is_pin"))
    mass = F.sum("_w")
    return out.groupBy(*keys).agg(
        F.coalesce(F.sum(F.col("_w") * F.col("lat")) / mass, F.max(F.when(F.col("is_pin"), F.col("lkp_lat")))).alias("lat"),
        F.coalesce(F.sum(F.col("_w") * F.col("lon")) / mass, F.max(F.when(F.col("is_pin"), F.col("lkp_lon")))).alias("lon"),
        F.count("_w").alias("n_cells"))


def ranked_cells(cells: DataFrame, limit: int, settings: Settings = DEFAULTS, keys=("mission_id",), positive: Column | None = None) -> DataFrame:
    """The ``limit`` heaviest cells per mission above the least mass; ties to the later cell in row-major order."""
    w = W.partitionBy(*keys).orderBy(F.desc("p"), F.desc("row"), F.desc("col"))
    return cells.where(F.col("p") > settings.min_mass).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def top_cells(cells: DataFrame, limit: int | None = None, settings: Settings = DEFAULTS, keys=("mission_id",)) -> DataFrame:
    """Peaks as (lat, lon, weight); positions are computed for the picked cells only."""
    return with_cell_latlon(ranked_cells(cells, limit or settings.peak_limit, settings, keys))
