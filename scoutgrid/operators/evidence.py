"""Evidence folded into a surface: sweeps, detections, searched polygons, history, deltas."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.scalars import valid_position
from ..session import cut_lineage
from ..settings import DEFAULTS, Settings
from .grid import CELL_KEYS, dense, mission_sum, mission_window, point_to_cell
from .joins import cells_in_polygon, disc_cells


def _located(records: DataFrame, north_m: str | None = None) -> DataFrame:
    shift = F.col(north_m) if north_m else 0.0
    return records.withColumn("_pos", valid_position(F.col("lat"), F.col("lon"), shift)).where("_pos is not null").withColumn(
        "lat", F.col("_pos.lat")).withColumn("lon", F.col("_pos.lon")).drop("_pos")


def swept_cells(records: DataFrame, res_m: float, settings: Settings = DEFAULTS, north_m: str | None = None) -> DataFrame:
    """(mission, tick, cell) overflown without a find; records carry mission columns and ``tick``."""
    empty = _located(records.where("not person"), north_m)
    keep = ["mission_id", "tick"]
    return disc_cells(empty, settings.sweep_radius_m, res_m, keep).distinct()


def person_events(records: DataFrame, north_m: str | None = None) -> DataFrame:
    """Finds as events; the position is null when out of range."""
    shift = F.col(north_m) if north_m else 0.0
    return records.where("person").withColumn("position", valid_position(F.col("lat"), F.col("lon"), shift))


def clean_scores(swept: DataFrame, tick: Column | int, settings: Settings = DEFAULTS, keys=CELL_KEYS) -> DataFrame:
    """Clean score of swept cells at a tick: decay ^ (ticks since the last sweep). A ``tick`` that is a column belongs to ``keys``."""
    now = tick if isinstance(tick, Column) else F.lit(tick)
    last = swept.where(F.col("tick") <= now).groupBy(*keys).agg(F.max("tick").alias("last_sweep"))
    return last.withColumn("clean", F.pow(F.lit(settings.clean_decay), now - F.col("last_sweep")))


def boost_factors(events: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Product of the boosts of all finds in a cell and tick; finds off the grid do not count.

    A hot cell is reduced on the map side before anything is shuffled.
    """
    strength = settings.boost_strength
    placed = point_to_cell(_located(events))
    return placed.groupBy("mission_id", "tick", "row", "col").agg(
        F.product(1.0 + strength * F.col("confidence")).alias("boost"), F.count("*").alias("n_events"))


def suppress(cells: DataFrame, settings: Settings = DEFAULTS, keys=("mission_id",)) -> DataFrame:
    """Take mass off clean cells (column ``clean``) and renormalise; untouched without any sweep."""
    clean = F.coalesce(F.col("clean"), F.lit(0.0))
    out = cells.withColumn("_f", F.col("p") * (1.0 - settings.clean_strength * F.greatest(F.lit(0.0), F.least(F.lit(1.0), clean))))
    out = out.withColumns({"_swept": F.max(clean).over(mission_window(keys)) > 0, "_t": mission_sum("_f", keys)})  # one pass of windows
    use = F.col("_swept") & (F.col("_t") > 0)
    return out.withColumn("p", F.when(use, F.col("_f") / F.col("_t")).otherwise(F.col("p"))).drop("_swept", "_f", "_t")


def boost(cells: DataFrame, keys=("mission_id",)) -> DataFrame:
    """Multiply by ``boost`` and renormalise missions with at least one find on the grid."""
    out = cells.withColumn("_f", F.col("p") * F.coalesce(F.col("boost"), F.lit(1.0)))
    out = out.withColumns({"_hit": F.max(F.col("boost").isNotNull()).over(mission_window(keys)), "_t": mission_sum("_f", keys)})
    use = F.col("_hit") & (F.col("_t") > 0)
    return out.withColumn("p", F.when(use, F.col("_f") / F.col("_t")).otherwise(F.col("_f"))).drop("_hit", "_f", "_t")


#: Up to so many searches a mission, each is a pass of windows; beyond, a mission's cells are folded in one Arrow group.
WINDOW_SEARCHES = 8


def negative_search(cells: DataFrame, searches: DataFrame, settings: Settings = DEFAULTS, sequence: str | None = None) -> DataFrame:
    """Lower the mass inside each mission's searched polygons by their probability of detection, one after the other.

    ``cells`` carries lat/lon; ``searches`` is (mission_id, rings, pod) and, if a mission has several, ``sequence`` names
    the column of their order; without it, and among equal values, the smaller probability and then the polygon decide, so that
    every search counts. After every search each of its cells has at least the floor and the mission is
    renormalised; a polygon that holds no cell changes nothing. Adds ``searched``. A cell stays one row.
    """
    pod = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("pod")))
    place = F.col(sequence).cast("long") if sequence else F.lit(0).cast("long")
    steps = F.row_number().over(W.partitionBy("mission_id").orderBy(place.asc_nulls_first(), "pod", "rings"))
    asked = searches.select("mission_id", "rings", pod.alias("pod"), steps.alias("_seq"))
    hits = cells_in_polygon(cells.select(*CELL_KEYS, "lat", "lon"), asked).groupBy(*CELL_KEYS).agg(
        F.sort_array(F.collect_list(F.struct("_seq", "pod"))).alias("_hits"))
    hits = cut_lineage(hits)
    given = cells.join(dense(hits), list(CELL_KEYS), "left").withColumn("searched", F.col("_hits").isNotNull())
    most = hits.agg(F.max(F.element_at("_hits", -1)["_seq"])).first()[0] or 0
    floor = settings.search_floor
    if most > WINDOW_SEARCHES:
        return _searched_in_groups(given, floor)
    for step in range(1, most + 1):
        found = F.filter(F.col("_hits"), lambda h: h["_seq"] == step)
        given = given.withColumn("_pod", F.get(found, F.lit(0))["pod"]).withColumn(
            "_q", F.when(F.col("_pod").isNotNull(), F.greatest(F.col("p") * (1.0 - F.col("_pod")), F.lit(floor))).otherwise(F.col("p")))
        given = given.withColumns({"_any": F.max(F.col("_pod").isNotNull()).over(mission_window()), "_total": mission_sum("_q"),
                                   "_n": F.count("*").over(mission_window())})
        given = given.withColumn("p", F.when(~F.col("_any"), F.col("p")).when(F.col("_total") < floor, 1.0 / F.col("_n")).otherwise(
            F.col("_q") / F.col("_total"))).drop("_pod", "_q", "_any", "_total", "_n")
    return given.drop("_hits")


def _searched_in_groups(given: DataFrame, floor: float) -> DataFrame:
    """The same for long sequences: all steps of a mission as array arithmetic."""
    kept = [c for c in given.columns if c != "_hits"]
    schema = T.StructType([f for f in given.schema.fields if f.name in kept])

    def fold(table: pa.Table) -> pa.Table:
        p, rows = table["p"].to_numpy().astype(float), table["_hits"].combine_chunks()
        found = rows.flatten()
        at = np.repeat(np.arange(len(p)), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(rows), 0)))
        order, share = found.field("_seq").to_numpy(), found.field("pod").to_numpy()
        for step in np.unique(order):
            here = order == step
            p = p.copy()
            p[at[here]] = np.maximum(p[at[here]] * (1.0 - share[here]), floor)
            total = p.sum()
            p = np.full(len(p), 1.0 / len(p)) if total < floor else p / total
        return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p)).select(kept)

    return given.groupBy("mission_id").applyInArrow(fold, schema)


def blend_history(cells: DataFrame, prior: str = "prior", settings: Settings = DEFAULTS, keys=("mission_id",)) -> DataFrame:
    """Keep a share of the prior surface; drift missions and massless priors take the current one."""
    d = settings.history_decay
    if d <= 0:
        return cells
    old = F.coalesce(F.col(prior), F.lit(0.0))
    mixed = old if d >= 1 else d * old + (1.0 - d) * F.col("p")
    fresh = F.col("sea_drift") | (F.coalesce(mission_sum(old, keys), F.lit(0.0)) <= 0)
    return cells.withColumn("_fresh", fresh).withColumn("p", F.when(F.col("_fresh"), F.col("p")).otherwise(mixed)).drop("_fresh")


def history_closed_form(surfaces: DataFrame, last_tick: int, settings: Settings = DEFAULTS) -> DataFrame:
    """Blended surface at ``last_tick`` without evidence, from all ticks at once.

    ``surfaces`` is (mission, tick 0..n, row, col, p, sea_drift): the fold is a weighted sum.
    """
    d = settings.history_decay
    age = F.lit(last_tick) - F.col("tick")
    weight = F.when(F.col("sea_drift"), (F.col("tick") == last_tick).cast("double")).otherwise(
        F.pow(F.lit(d), age) * F.when(F.col("tick") == 0, 1.0).otherwise(1.0 - d))
    return surfaces.where(F.col("tick") <= last_tick).groupBy(*CELL_KEYS).agg(F.sum(weight * F.col("p")).alias("p"))


# --- snapshots and deltas ------------------------------------------------------------------

def heatmap_delta(old: DataFrame, new: DataFrame, threshold: float = DEFAULTS.delta_threshold) -> DataFrame:
    """Cells that changed by more than ``threshold``, with the new value."""
    was = old.select(*CELL_KEYS, F.col("p").alias("_old"))
    return new.join(dense(was), list(CELL_KEYS)).where(F.abs(F.col("p") - F.col("_old")) > threshold).select(*CELL_KEYS, "p")


def merge_deltas(deltas: DataFrame, sequence: str = "seq") -> DataFrame:
    """One delta per cell, the last one wins."""
    return deltas.groupBy(*CELL_KEYS).agg(F.max_by("p", sequence).alias("p"))


def apply_deltas(cells: DataFrame, deltas: DataFrame, sequence: str = "seq") -> DataFrame:
    """Upsert merged deltas; cells off the grid are ignored."""
    merged = merge_deltas(deltas, sequence).withColumnRenamed("p", "_new")
    return cells.join(dense(merged), list(CELL_KEYS), "left").withColumn("p", F.coalesce("_new", "p")).drop("_new")


def complement(cells: DataFrame, covered: DataFrame) -> DataFrame:
    """Cells that are not in ``covered``."""
    return cells.join(dense(covered.select(*CELL_KEYS)), list(CELL_KEYS), "left_anti")


def distinct_footprint(*parts: DataFrame) -> DataFrame:
    """Set union of cell footprints."""
    out = parts[0].select(*CELL_KEYS)
    for part in parts[1:]:
        out = out.unionByName(part.select(*CELL_KEYS))
    return out.distinct()
