"""Moving probability between neighbouring cells, and least travel time.

Diffusion and drift are the same thing here: a static 8-neighbour stencil. Weights and all steps of a
mission are array arithmetic on stacks of whole grids, which know their own size; as a chain of windows
each step costs about fifty times as much. With ``tile`` a mission is cut into tiles of that side, which
exchange halos from round to round: the way for grids that are too large for one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.scalars import hiking_speed_kmh
from ..session import cut_lineage, shuffle_partitions
from ..settings import DEFAULTS, NEIGHBOURS, Settings
from .grid import dense, few, mission_sum, mission_window
from .joins import salted_join
from .raster import terrain_weight
from .tiles import TILE, Frame, Stack, own_tile, per_grid, per_tile

#: Steps between two exchanges of halos.
ROUND_STEPS = 32

def neighbour_values(cells: DataFrame, values: list[str], keys=("mission_id",)) -> DataFrame:
    """Columns ``_n0`` .. ``_n7``: the named values of the eight neighbours as structs, null off the grid.

    Two passes of windows, along columns and then along rows, that need no grid size: missions of
    different sizes stand side by side in one table.
    """
    down, across = W.partitionBy(*keys, "col").orderBy("row"), W.partitionBy(*keys, "row").orderBy("col")
    lines = cells.withColumn("_v0", F.struct(*values)).withColumns({"_v-1": F.lag("_v0").over(down), "_v1": F.lead("_v0").over(down)})
    pick = {-1: F.lag, 1: F.lead}
    return lines.select(*cells.columns, *[
        (pick[dc](f"_v{dr}").over(across) if dc else F.col(f"_v{dr}")).alias(f"_n{i}") for i, (dr, dc) in enumerate(NEIGHBOURS)])


def neighbours(cells: DataFrame) -> DataFrame:
    """Cell to neighbour pairs inside the grid, nine at most (index 4 is the cell itself)."""
    steps = list(NEIGHBOURS[:4]) + [(0, 0)] + list(NEIGHBOURS[4:])
    offsets = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(r).alias("dr"), F.lit(c).alias("dc")) for i, (r, c) in enumerate(steps)])
    out = cells.withColumn("_o", F.explode(offsets)).withColumns({
        "idx": F.col("_o.idx"), "dr": F.col("_o.dr"), "dc": F.col("_o.dc"),
        "n_row": F.col("row") + F.col("_o.dr"), "n_col": F.col("col") + F.col("_o.dc")}).drop("_o")
    return out.where((F.col("n_row") >= 0) & (F.col("n_row") < F.col("size")) & (F.col("n_col") >= 0) & (F.col("n_col") < F.col("size")))


def normalize_weights(pairs: DataFrame, weight: str, keys=("mission_id", "row", "col")) -> DataFrame:
    """Scale each cell's neighbour weights to 1; all zero means everything stays."""
    total = F.sum(weight).over(W.partitionBy(*keys))
    return pairs.withColumn("_t", total).withColumn(
        weight, F.when(F.col("_t") > 0, F.col(weight) / F.col("_t")).otherwise((F.col("idx") == 4).cast("double"))).drop("_t")


# --- cost and weights ----------------------------------------------------------------------

def travel_cost(is_road: Column, slope: Column, is_land: Column, settings: Settings = DEFAULTS) -> Column:
    base = F.when(is_road, settings.cost_road).otherwise(settings.cost_offroad)
    steep = F.when(F.degrees(slope) >= settings.steep_deg, F.greatest(base, F.lit(settings.cost_steep))).otherwise(base)
    wet = F.when(~is_land, F.greatest(steep, F.lit(settings.cost_water))).otherwise(steep)
    return F.greatest(wet, F.lit(settings.cost_floor))


def conductance(cost: Column, settings: Settings = DEFAULTS) -> Column:
    """Distance-free part of the weight of moving onto a cell."""
    return settings.weight_scale * (settings.distance_share + settings.topology_share / F.greatest(cost, F.lit(settings.cost_floor)))


def transition_weight(distance: Column, cost_to: Column, road_from: Column, road_to: Column, settings: Settings = DEFAULTS) -> Column:
    pull = F.when(~road_from & road_to, 1.0 + settings.trail_bonus).otherwise(1.0)
    return conductance(cost_to, settings) / distance * pull


def flat_transition_weight(road_from: Column, road_to: Column, settings: Settings = DEFAULTS) -> Column:
    """Unit-distance weight between flat land cells."""
    cost = F.when(road_to, settings.cost_road).otherwise(settings.cost_offroad)
    return transition_weight(F.lit(1.0), cost, road_from, road_to, settings)


def transition_edges(cells: DataFrame, settings: Settings = DEFAULTS, keys=("mission_id",)) -> DataFrame:
    """Outgoing weights of every cell as rows (needs ``cost`` and ``on_road``)."""
    near = neighbour_values(cells, ["cost", "on_road"], keys)
    steps = F.array(*[F.struct(F.lit(i if i < 4 else i + 1).alias("idx"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc"),
                               F.col(f"_n{i}.cost").alias("cost"), F.col(f"_n{i}.on_road").alias("road"))
                      for i, (dr, dc) in enumerate(NEIGHBOURS)])
    edges = near.withColumn("_e", F.explode(steps)).where("_e.cost is not null")
    weight = transition_weight(F.hypot(F.col("_e.dr"), F.col("_e.dc")), F.col("_e.cost"), F.col("on_road"), F.col("_e.road"), settings)
    return edges.select(*keys, "row", "col", (F.col("row") + F.col("_e.dr")).alias("n_row"),
                        (F.col("col") + F.col("_e.dc")).alias("n_col"), F.col("_e.idx").alias("idx"), weight.alias("weight"))


# --- the stencil ---------------------------------------------------------------------------

def _diffusion_shares(cost: np.ndarray, road: np.ndarray, s: Settings) -> tuple[np.ndarray, list[np.ndarray]]:
    """Share of a cell's mass that stays, and the shares that go to its eight neighbours.

    The denominator always counts eight neighbours: one off the grid has the floor cost and
    is no road, and the share sent to it is lost. That leak is part of the result.
    """
    height, width = cost.shape[-2:]
    ring = [(0, 0)] * (cost.ndim - 2) + [(1, 1)] * 2
    pull = np.pad(s.weight_scale * (s.distance_share + s.topology_share / np.maximum(cost, s.cost_floor)), ring,
                  constant_values=s.weight_scale * (s.distance_share + s.topology_share / s.cost_floor))
    roads = np.pad(road, ring)
    out = []
    for dr, dc in NEIGHBOURS:
        there = (..., slice(1 + dr, 1 + dr + height), slice(1 + dc, 1 + dc + width))
        bonus = np.where(~road & roads[there], 1.0 + s.trail_bonus, 1.0)
        out.append(pull[there] * bonus / math.hypot(dr, dc))
    total = s.diffusion_self + sum(out)
    return s.diffusion_self / total, [w / total for w in out]


def _drift_shares(u: np.ndarray, v: np.ndarray, land: np.ndarray, bias: float, s: Settings) -> tuple[np.ndarray, list[np.ndarray]]:
    """The same for one drift step along the current; land and still water keep all."""
    speed = np.hypot(u, v)
    active = ~land & (speed > 1e-9)
    out = []
    for dr, dc in NEIGHBOURS:
        along = (u * dc - v * dr) / np.maximum(speed * math.hypot(dr, dc), 1e-12)
        out.append(np.where(active, 1.0 + bias * np.maximum(along, 0.0), 0.0))
    total = s.advection_self + sum(out)
    return np.where(active, s.advection_self / total, 1.0), [w / total for w in out]


def _stepped(surface: np.ndarray, stay: np.ndarray, shares: list[np.ndarray], times: int) -> np.ndarray:
    """``times`` steps of moving mass to the neighbours."""
    flows = [(*_overlap(surface.shape, *step), share) for step, share in zip(NEIGHBOURS, shares)]  # of one grid or a stack
    flows = [(here, there, share[here]) for here, there, share in flows]
    for _ in range(times):
        moved = surface * stay
        for here, there, share in flows:
            moved[there] += surface[here] * share
        surface = moved
    return surface


def _per_mission(cells: DataFrame, keys, alike: list[str], work, schema: T.StructType, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Run an Arrow function on whole grids, stacked where ``alike`` are equal; a mission's grid must fit a task.

    Its output goes back to one place per mission with an explicit partition number: what
    follows is heavy per byte and must not be coalesced by size. ``then`` is done before, so that columns which only it reads are not moved.
    """
    done = then(per_grid(cells, keys, alike, work, schema))
    return done.repartition(shuffle_partitions(cells.sparkSession), "mission_id")


def _overlap(shape: tuple[int, ...], dr: int, dc: int):
    """Slices of the cells that have a neighbour at (dr, dc), and of those neighbours."""
    height, width = shape[-2:]
    here = (..., slice(max(0, -dr), height - max(0, dr)), slice(max(0, -dc), width - max(0, dc)))
    there = (..., slice(max(0, dr), height - max(0, -dr)), slice(max(0, dc), width - max(0, -dc)))
    return here, there


def _rewritten(cells: DataFrame, steps: Column | int, work, value: str, keys, tile: int | None, extra: int,
               then: Callable[[DataFrame], DataFrame] = lambda df: df, **given: Column) -> DataFrame:
    """Rewrite ``value`` by ``work(frame, times)`` on stacks of whole grids, or tile by tile.

    A grid reads its own size from its rows. Many steps on a small grid are array arithmetic; weights and steps
    share one pass through Python. Tiles do ``ROUND_STEPS`` steps at a time, with a ring as wide as these reach and ``extra``
    cells more for the weights; a mission that has done its steps passes the rounds that others still need.
    """
    wanted = steps if isinstance(steps, Column) else F.lit(steps)
    given = {"_steps": wanted.cast("int"), **given}
    kept, schema = list(cells.columns), cells.schema

    def replaced(frame: Frame | Stack, times: int) -> pa.Table:
        table, rows = frame.table, frame.inner
        if times > 0:
            table = table.set_column(table.schema.get_field_index(value), value, pa.array(work(frame, times).ravel()[frame.at]))
        return table if rows.all() else table.filter(pa.array(rows))

    if tile is None:
        def whole(stack: Stack) -> pa.Table:
            return replaced(stack, stack.table["_steps"][0].as_py() or 0).select(kept)
        return _per_mission(cells.withColumns(given), keys, ["size", "_steps"], whole, schema, then)
    state, most = cells.withColumns(given), steps
    if isinstance(steps, Column):
        state = cut_lineage(state)
        most = state.agg(F.coalesce(F.max("_steps"), F.lit(0))).first()[0]
    names = state.columns
    for done in range(0, most, ROUND_STEPS):
        times = min(ROUND_STEPS, most - done)
        # a round is kept only if another one reads it
        keep = cut_lineage if done + times < most else lambda df: df
        state = keep(per_tile(state, keys, tile, times + extra, lambda frame, done=done, times=times: replaced(
            frame, min(times, (frame.first("_steps") or 0) - done)).select(names), state.schema))
    return then(state.select(kept))


def diffuse(cells: DataFrame, steps: Column | int, settings: Settings = DEFAULTS, keys=("mission_id",), tile: int | None = None,
            then: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Cost-surface diffusion of ``p`` (needs ``cost``, ``on_road`` and ``size``); ``then`` finishes rows before they are moved to their mission's place."""
    def work(frame: Frame | Stack, times: int) -> np.ndarray:
        return _stepped(frame.read("p"), *_diffusion_shares(frame.read("cost"), frame.read("on_road") > 0, settings), times)
    return _rewritten(cells, steps, work, "p", keys, tile, 1, then)


def diffuse_flat(cells: DataFrame, steps: Column | int, settings: Settings = DEFAULTS, keys=("mission_id",)) -> DataFrame:
    """Diffusion over flat land with ``on_road`` as the only difference between cells."""
    cost = travel_cost(F.col("on_road"), F.lit(0.0), F.lit(True), settings)
    return diffuse(cells.withColumn("cost", cost), steps, settings, keys)


def drift(cells: DataFrame, steps: Column | int, dt_sec: Column, strength: float = 1.0,
          settings: Settings = DEFAULTS, keys=("mission_id",), tile: int | None = None,
          then: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Advect ``p`` on water. Each step keeps the mission's mass; as the step is linear, one
    rescale at the end gives the same surface. ``then`` finishes rows as in ``diffuse``."""
    bias = strength * settings.advection_strength * F.sqrt(F.greatest(dt_sec, F.lit(1.0)) / max(settings.reference_dt_sec, 1.0))

    def moved(frame: Frame | Stack, times: int) -> np.ndarray:
        shares = _drift_shares(frame.read("current_u"), frame.read("current_v"), frame.read("is_land") > 0, frame.first("_bias"), settings)
        return _stepped(frame.read("p"), *shares, times)

    def work(stack: Stack, times: int) -> np.ndarray:
        done = moved(stack, times)
        for grid, start in zip(done, stack.read("p")):
            mass, left = start.sum(), grid.sum()
            if left > 1e-15 and mass > 0:
                grid *= mass / left
        return done

    if tile is None:
        return _rewritten(cells, steps, work, "p", keys, None, 0, then, _bias=bias)
    start = cut_lineage(cells)
    done = cut_lineage(_rewritten(start, steps, moved, "p", keys, tile, 0, _bias=bias))
    mass = lambda df, name: df.groupBy(*keys).agg(F.sum("p").alias(name))  # noqa: E731 - partial sums, one row per mission
    scale = mass(start, "_mass").join(few(mass(done, "_left")), list(keys)).select(
        *keys, F.when((F.col("_left") > 1e-15) & (F.col("_mass") > 0), F.col("_mass") / F.col("_left")).otherwise(F.lit(1.0)).alias("_scale"))
    return then(salted_join(done, few(scale), list(keys)).withColumn("p", F.col("p") * F.col("_scale")).select(*cells.columns))


# --- directional weights -------------------------------------------------------------------

def directional_weights(cells: DataFrame, east: Column, north: Column, strength: Column, min_speed: float = 1e-6, diagonal_norm: bool = True) -> DataFrame:
    """Weight of each neighbour by how well it lies downstream of (east, north)."""
    speed = F.hypot(east, north)
    norm = F.hypot(F.col("dr"), F.col("dc")) if diagonal_norm else F.lit(1.0)
    along = (east * F.col("dc") - north * F.col("dr")) / (speed * norm)
    use = (speed >= min_speed) & (F.col("idx") != 4) & (along > 0)
    return neighbours(cells).withColumn("weight", F.when(use, strength * along).otherwise(0.0))


def wind_weights(cells: DataFrame, dt_sec: Column, weight: float = 1.0, settings: Settings = DEFAULTS) -> DataFrame:
    u, v = F.col("wind_u"), F.col("wind_v")
    strength = weight * F.sqrt(F.greatest(dt_sec, F.lit(1.0)) / settings.reference_dt_sec) * F.least(F.hypot(u, v) / 5.0, F.lit(1.5))
    return directional_weights(cells, u, v, strength, diagonal_norm=False)


def current_weights(cells: DataFrame, dt_sec: Column, weight: float = 1.0, settings: Settings = DEFAULTS) -> DataFrame:
    u, v = F.col("current_u"), F.col("current_v")
    reach = F.least(F.hypot(u, v) * F.greatest(dt_sec, F.lit(1.0)) / F.col("res_m"), F.lit(1.5))
    strength = F.when(F.col("is_land"), 0.0).otherwise(weight * settings.drift_strength * settings.advection_strength * reach)
    return directional_weights(cells, u, v, strength)


def road_weights(cells: DataFrame, weight: float, settings: Settings = DEFAULTS) -> DataFrame:
    return transition_edges(cells, settings).withColumn("weight", F.col("weight") * weight)


# --- least travel time ---------------------------------------------------------------------

def _relax(elevation: np.ndarray, res: float | np.ndarray, hours: np.ndarray, flat_speed: float, limit: float | np.ndarray) -> np.ndarray:
    """Walking hours from what is known: neighbour relaxation until nothing improves, on one grid or on a stack of them."""
    hours = hours.copy()
    moves = []
    for dr, dc in NEIGHBOURS:
        here, there = _overlap(elevation.shape, dr, dc)
        run = math.hypot(dr, dc) * res
        grade = (elevation[there] - elevation[here]) / run
        speed = np.maximum(flat_speed * np.exp(3.5 * 0.05 - 3.5 * np.abs(grade + 0.05)), 1e-6)
        moves.append((here, there, run / 1000.0 / speed))
    changed = True
    while changed:
        before = hours.copy()
        for here, there, cost in moves:
            arrive = hours[here] + cost
            np.minimum(hours[there], np.where(arrive <= limit, arrive, np.inf), out=hours[there])
        changed = not np.array_equal(before, hours)
    return hours


def travel_time(cells: DataFrame, max_hours: str = "max_hours", settings: Settings = DEFAULTS, keys=("mission_id",),
                tile: int | None = None) -> DataFrame:
    """Add ``travel_h``: least walking time from the pin, null beyond ``max_hours``.

    Whole grids, or tiles, relaxed to their fixed point inside the task; the land mask plays no part. Solve once at the
    largest horizon of a mission and derive the score of every tick from it.
    """
    schema = T.StructType(cells.schema.fields + [T.StructField("travel_h", T.DoubleType())])
    flat_speed = settings.flat_speed_kmh
    if tile is not None:
        return _travel_by_tiles(cells, max_hours, flat_speed, list(keys), tile)

    kept = list(cells.columns)

    def solve(stack: Stack) -> pa.Table:
        start = np.where(stack.read("is_pin") > 0, 0.0, np.inf)
        hours = _relax(stack.read("elevation"), stack.first("res_m"), start, flat_speed, stack.first(max_hours)).ravel()[stack.at]
        return stack.table.select(kept).append_column("travel_h", pa.array(hours, mask=~np.isfinite(hours)))

    return _per_mission(cells, keys, ["size"], solve, schema)


#: Sides up to which tiles go to Python many at a time; a larger tile is an Arrow group.
SMALL_TILE = 32
#: Cells that are relaxed as one stack of tiles.
STACK_CELLS = 1 << 15


def _travel_by_tiles(cells: DataFrame, max_hours: str, flat_speed: float, keys: list[str], side: int) -> DataFrame:
    """The wave goes from tile to tile: each round solves the tiles next to a cell that got better, until none does.

    A tile is one row with its cells in arrays. A solved tile sends those of its border cells that got better to the tiles they
    touch, so a round moves rows of tiles and strips, never cells. Times are sums along a path and the least one wins, so the order
    of the rounds does not show in the result. A cell that comes twice stays two rows.
    """
    spark, place = cells.sparkSession, [*keys, *TILE]
    packed = cut_lineage(cells.withColumns(dict(zip(TILE, own_tile(side)))).groupBy(*place).agg(F.collect_list(F.struct(*cells.columns)).alias("_cells")))
    first = F.col("_cells")[0]
    relief = cut_lineage(packed.select(
        *place, first["size"].alias("size"), first["res_m"].cast("double").alias("res_m"), first[max_hours].cast("double").alias("_limit"),
        *[F.col(f"_cells.{name}").alias(name) for name in ("row", "col", "elevation", "is_pin")]))
    names = {f.name: f.dataType.simpleString() for f in relief.schema.fields}
    schema = ", ".join([f"`{k}` {names[k]}" for k in place] + ["_way int", "hours array<double>", "strip array<double>"])
    news = "array<struct<_way:int,hours:array<double>,strip:array<double>>>"

    def solve(tiles: pa.RecordBatch) -> pa.RecordBatch:
        return _solved_tiles(tiles, keys, side, flat_speed)

    def batches(given):
        step = max(1, STACK_CELLS // side ** 2)
        for batch in given:
            for at in range(0, batch.num_rows, step):
                yield solve(batch.slice(at, step))

    def alone(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([solve(table.combine_chunks().to_batches()[0])])

    work = relief.where(F.exists("is_pin", lambda pin: pin)).select("*", F.lit(None).cast(news).alias("_news"), F.lit(None).cast("array<double>").alias("_known"))
    work, known = work.repartition(shuffle_partitions(spark), *place), None
    while True:
        done = cut_lineage(work.mapInArrow(batches, schema) if side <= SMALL_TILE else work.groupBy(*place).applyInArrow(alone, schema))
        solved = done.where("_way < 0").select(*place, F.col("hours").alias("_known"))
        known = solved if known is None else cut_lineage(known.join(dense(solved.select(*place)), place, "left_anti").unionByName(solved))
        sent = done.where("_way >= 0")
        if sent.isEmpty():
            break
        sent = sent.groupBy(*place).agg(F.collect_list(F.struct("_way", "hours", "strip")).alias("_news"))
        work = relief.repartition(shuffle_partitions(spark), *place).join(dense(sent), place).join(dense(known), place, "left").select(
            *relief.columns, "_news", "_known")
    at = (F.col("_c.row") - F.col(TILE[0]) * side) * side + F.col("_c.col") - F.col(TILE[1]) * side
    rows = packed.repartition(shuffle_partitions(spark), *place).join(dense(known), place, "left").withColumn("_c", F.explode("_cells"))
    hours = F.get("_known", at.cast("int"))
    ahead = [*keys, "row", "col"]
    return rows.select(*[F.col(f"_c.{c}").alias(c) for c in [*ahead, *[c for c in cells.columns if c not in ahead]]],
                       F.when(hours < float("inf"), hours).alias("travel_h"))


def _strip(way: int, inner: bool) -> tuple:
    """Where the border cells towards a neighbour lie in a stack of tiles (``inner``), or those that came from there in a stack with rings."""
    def part(step: int):
        if not step:
            return slice(None) if inner else slice(1, -1)
        return -1 if (step > 0) == inner else 0
    return tuple(part(step) for step in NEIGHBOURS[way])


def _solved_tiles(tiles: pa.RecordBatch, keys: list[str], side: int, flat_speed: float) -> pa.RecordBatch:
    """Relax a stack of tiles from their pins or known hours and from what neighbours sent.

    Gives each tile's hours (``_way`` -1) and, addressed to the tile there, the border cells towards a neighbour (``_way``) of which
    any got better. Off the grid, and on a ring that nobody sent, the relief is NaN, which no step crosses.
    """
    n, wide = tiles.num_rows, side + 2
    number = lambda name: tiles[name].to_numpy(zero_copy_only=False)
    corner = np.stack([number(name) for name in TILE])
    sizes = number("size")
    on_grid = [(a[:, None] * side + np.arange(side)) < sizes[:, None] for a in corner]
    relief = np.full((n, wide, wide), np.nan)
    relief[:, 1:-1, 1:-1] = np.where(on_grid[0][:, :, None] & on_grid[1][:, None, :], 0.0, np.nan)
    hours = np.full((n, wide, wide), np.inf)

    def owner(lists: pa.ListArray) -> np.ndarray:
        return np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy())

    t = owner(tiles["row"])
    at = (t, *(tiles[axis].flatten().to_numpy() - corner[i][t] * side + 1 for i, axis in enumerate(("row", "col"))))
    heights = tiles["elevation"].flatten()
    relief[at] = heights.fill_null(0.0).to_numpy()
    solved = tiles["_known"].is_valid().to_numpy(zero_copy_only=False)
    hours[solved, 1:-1, 1:-1] = tiles["_known"].flatten().to_numpy().reshape(-1, side, side)
    before = hours[:, 1:-1, 1:-1].copy()
    pins = tiles["is_pin"].flatten().fill_null(False).to_numpy(zero_copy_only=False) & ~solved[t]
    hours[tuple(a[pins] for a in at)] = 0.0
    news, to = tiles["_news"].flatten(), owner(tiles["_news"])
    came = news.field("_way").to_numpy()
    for way in np.unique(came):
        here = np.flatnonzero(came == way)
        row, col = _strip(way, False)
        for grid, name in ((hours, "hours"), (relief, "strip")):
            values = news.field(name).take(pa.array(here)).flatten().to_numpy().reshape(len(here), -1)
            grid[to[here], row, col] = values if slice(1, -1) in (row, col) else values[:, 0]

    done = _relax(relief, number("res_m")[:, None, None], hours, flat_speed, number("_limit")[:, None, None])[:, 1:-1, 1:-1]
    better = done < before
    last = (sizes - 1) // side
    source, targets, ways = [np.arange(n)], [corner], [np.full(n, -1)]
    values, strips, lengths = [done.reshape(-1)], [], [np.full(n, side * side)]
    for way, step in enumerate(NEIGHBOURS):
        there = corner + np.array(step)[:, None]
        row, col = _strip(way, True)
        better_here = better[:, row, col].reshape(n, -1)
        go = np.flatnonzero(better_here.any(axis=1) & ((there >= 0) & (there <= last)).all(axis=0))
        source.append(go)
        targets.append(there[:, go])
        ways.append(np.full(len(go), way))
        values.append(np.where(better_here[go], done[go, row, col].reshape(better_here[go].shape), np.inf).reshape(-1))
        strips.append(relief[:, 1:-1, 1:-1][go, row, col].reshape(-1))
        lengths.append(np.full(len(go), better_here.shape[1]))
    source, targets, length = np.concatenate(source), np.concatenate(targets, axis=1), np.concatenate(lengths)
    lists = lambda count, flat: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(flat))
    columns = {k: tiles[k].take(pa.array(source)) for k in keys} | {name: pa.array(a, pa.int32()) for name, a in zip(TILE, targets)}
    columns |= {"_way": pa.array(np.concatenate(ways), pa.int32()), "hours": lists(length, np.concatenate(values)),
                "strip": lists(np.where(np.arange(len(length)) < n, 0, length), np.concatenate(strips))}
    return pa.RecordBatch.from_pydict(columns)


def hop_hours(distance_m: Column, climb_m: Column, settings: Settings = DEFAULTS) -> Column:
    """Walking hours of one hop."""
    return distance_m / 1000.0 / F.greatest(hiking_speed_kmh(climb_m / distance_m, settings), F.lit(1e-6))


def reach_score(travel_h: Column, horizon: Column) -> Column:
    """1 at the pin, falling to 0 at the horizon."""
    h = F.when(horizon <= 0, 0.1).otherwise(horizon)
    return F.coalesce(F.when(travel_h <= h, (h - travel_h) / h), F.lit(0.0))


def reach_probability(cells: DataFrame, horizon: Column, method: str = "linear", weight: Column | None = None,
                      out: str = "reach", keys=("mission_id",)) -> DataFrame:
    """Travel time to a probability that sums to 1 per mission."""
    if method not in ("linear", "exponential"):
        raise ValueError(f"unsupported method {method!r}")
    h = F.when(horizon <= 0, 0.1).otherwise(horizon)
    raw = (h - F.col("travel_h")) / h if method == "linear" else F.exp(-F.col("travel_h") / (h / 3.0))
    scaled = F.coalesce(F.when(F.col("travel_h") <= h, raw * (weight if weight is not None else F.lit(1.0))), F.lit(0.0))
    out_df = cells.withColumn("_r", scaled).withColumn("_t", mission_sum("_r", keys))
    return out_df.withColumn(out, F.when(F.col("_t") > 0, F.col("_r") / F.col("_t")).otherwise(F.col("_r"))).drop("_r", "_t")


def reachability(cells: DataFrame, horizon: Column, settings: Settings = DEFAULTS, keys=("mission_id",)) -> DataFrame:
    """Prior (terrain-weighted, mass 1) and score from one solved ``travel_h``; needs terrain classes."""
    return reach_probability(cells, horizon, "linear", terrain_weight(settings), "reach", keys).withColumn(
        "reach_score", reach_score(F.col("travel_h"), horizon))


def blend_reach(cells: DataFrame, weight: float = 1.0, settings: Settings = DEFAULTS, keys=("mission_id",)) -> DataFrame:
    """Weigh ``p`` by the reach prior (floored at a share of its peak) and renormalise."""
    if weight <= 0:
        return cells
    peak = F.max("reach").over(mission_window(keys))
    out = cells.withColumn("_peak", peak).withColumn("_r", F.greatest(F.col("reach"), F.col("_peak") * settings.reach_floor, F.lit(1e-12)))
    out = out.withColumn("_b", F.col("p") * ((1.0 - weight) + weight * F.col("_r"))).withColumn("_t", mission_sum("_b", keys))
    return out.withColumn("p", F.when(F.col("_t") > 0, F.col("_b") / F.col("_t")).otherwise(F.col("_b"))).drop("_peak", "_r", "_b", "_t")
