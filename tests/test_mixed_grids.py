"""Missions of different sizes in one table, searches in sequence, axis conventions and uncrossed routes."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutgrid.operators import evidence as ev
from scoutgrid.operators import grid, joins, raster, routes, tiles
from scoutgrid.operators import transport as tp


def missions(spark, sizes):
    return spark.createDataFrame(
        [(i, 32.794, 34.9896 + 0.1 * i, n, 50.0) for i, n in enumerate(sizes)],
        "mission_id long, lkp_lat double, lkp_lon double, size int, res_m double")


def field(cells):
    r, c = F.col("row"), F.col("col")
    return cells.withColumns({
        "on_road": (r == 3) | (c == 5), "cost": 1.0 + (r * 7 + c * 3) % 5, "is_land": (r + c) % 4 == 0, "p": F.col("p") + (r * c % 3) / 10.0,
        "current_u": F.lit(0.4), "current_v": -0.1 * (c % 3)})


def rows(df, *names):
    return {(x["mission_id"], x["row"], x["col"]): tuple(x[n] for n in names) for x in df.collect()}


def test_mixed_sizes_equal_each_mission_alone(spark):
    sizes = (8, 16, 11)
    together = field(grid.make_cells(missions(spark, sizes)))
    for run in (lambda c: tp.diffuse(c, 3), lambda c: tp.drift(c, 2, F.lit(60.0))):
        whole = rows(run(together), "p")
        assert len(whole) == sum(n * n for n in sizes)
        for i in range(len(sizes)):
            alone = rows(run(together.where(F.col("mission_id") == i)), "p")
            assert alone == {k: v for k, v in whole.items() if k[0] == i}
    edges = tp.transition_edges(together).groupBy("mission_id").count().collect()
    assert {x["mission_id"]: x["count"] for x in edges} == {i: 8 * n * n - 12 * n + 4 for i, n in enumerate(sizes)}
    kept = tp.drift(together, 2, F.lit(60.0)).groupBy("mission_id").agg(F.sum("p").alias("m"))
    start = together.groupBy("mission_id").agg(F.sum("p").alias("m"))
    assert {x["mission_id"]: round(x["m"], 9) for x in kept.collect()} == {x["mission_id"]: round(x["m"], 9) for x in start.collect()}


def test_grid_is_never_clipped(spark):
    assert grid.make_cells(missions(spark, (520,))).count() == 520 * 520


def square(west, south, east, north):
    return [[(west, south), (east, south), (east, north), (west, north), (west, south)]]


def test_searches_follow_each_other(spark):
    cells = spark.createDataFrame([(1, r, c, float(r), float(c), 1 / 16) for r in range(4) for c in range(4)],
                                  "mission_id long, row int, col int, lat double, lon double, p double")
    searches = spark.createDataFrame(
        [(1, square(-0.5, -0.5, 1.5, 1.5), 0.85, 2), (1, square(-0.5, -0.5, 1.5, 3.5), 0.5, 1), (1, square(50.0, 50.0, 51.0, 51.0), 0.9, 3)],
        "mission_id long, rings array<array<struct<lon:double,lat:double>>>, pod double, seq int")
    p = np.full((4, 4), 1 / 16)
    for area, pod in (((slice(0, 4), slice(0, 2)), 0.5), ((slice(0, 2), slice(0, 2)), 0.85)):
        p[area] *= 1 - pod
        p /= p.sum()
    got = ev.negative_search(cells, searches, sequence="seq").collect()
    assert len(got) == 16
    assert all(abs(x["p"] - p[x["row"], x["col"]]) < 1e-12 and x["searched"] == (x["col"] < 2) for x in got)


def test_aspect_follows_the_rows(spark):
    cells = grid.make_cells(missions(spark, (8,))).withColumn("elevation", F.col("row") * 50.0)
    for x in raster.slope_aspect(cells).collect():
        assert abs(x["aspect_n"] + 1) < 1e-6 and abs(x["slope"] - np.pi / 4) < 1e-6
    assert raster.slope_aspect(cells, northward_aspect=True).agg(F.min("aspect_n")).first()[0] > 0.99


def test_roads_end_at_half_the_extent(spark):
    m = grid.with_origin(missions(spark, (8,)))
    lat, lon = m.select("lkp_lat", "lkp_lon").first()
    road = spark.createDataFrame([(0, 0, [(lon - 0.05, lat - 1e-4), (lon + 0.05, lat - 1e-4)])], "mission_id long, way_id int, pts array<struct<lon:double,lat:double>>")
    got = raster.road_cells(road, m).collect()
    assert {x["col"] for x in got} == set(range(8)) and {x["row"] for x in got} <= {3, 4, 5}
    # the pin lies on the border of cells 3 and 4 here, and in the middle of cell 4 by the cell convention
    near = spark.createDataFrame([(0, 0, [(lon + 1e-5, lat - 1e-5), (lon + 3e-4, lat - 1e-5)])], "mission_id long, way_id int, pts array<struct<lon:double,lat:double>>")
    assert {(x["row"], x["col"]) for x in raster.road_cells(near, m).collect()} == {(4, 4)}
    assert {(x["row"], x["col"]) for x in raster.road_cells(near, m, cell_convention=True).collect()} == {(4, 4), (4, 5)}


def test_routes_are_uncrossed_and_never_longer():
    rng = np.random.default_rng(3)
    length = lambda p, o: np.hypot(*(p[o][1:] - p[o][:-1]).T).sum()
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    for n in (0, 1, 2, 3, 5, 8, 13, 13, 13):
        p = rng.random((n, 2)) * 1000
        order = routes._uncrossed(p)
        assert sorted(order) == list(range(n)) and (n == 0 or order[0] == 0)
        assert length(p, order) <= length(p, np.arange(n)) + 1e-6
        x = p[order]
        for i, j in itertools.combinations(range(max(0, n - 1)), 2):
            a, b, c, d = x[i], x[i + 1], x[j], x[j + 1]
            assert not (side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0)
    assert routes._uncrossed(np.array([(0, 0), (2, 0), (1, 0), (3, 0.0)])).tolist() == [0, 2, 1, 3]


@pytest.mark.parametrize("side", [5, 8, 33])
def test_tiles_equal_whole_grids(spark, side, monkeypatch):
    """Odd tile sides, missions of different sizes and step counts, several rounds of halos."""
    monkeypatch.setattr(tp, "ROUND_STEPS", 3)
    cells = field(grid.make_cells(missions(spark, (8, 33, 11)))).withColumn("n", F.col("mission_id") * 3 + 1)
    assert rows(tp.diffuse(cells, F.col("n"), tile=side), "p") == rows(tp.diffuse(cells, F.col("n")), "p")
    a, b = (rows(tp.drift(cells, F.col("n"), F.lit(60.0), tile=t), "p") for t in (side, None))
    assert a.keys() == b.keys() and all(abs(a[k][0] - b[k][0]) < 1e-12 for k in a)


@pytest.mark.parametrize("side", [6, 17])
def test_travel_time_by_tiles_equals_whole_grids(spark, side):
    """A wall that the wave has to go round, so that it comes back into tiles it has left."""
    r, c = F.col("row"), F.col("col")
    cells = grid.make_cells(missions(spark, (40, 9))).withColumns({
        "elevation": F.when((r == 12) & (c < 36), 4000.0).otherwise((r * 5 + c * 3) % 7), "max_hours": F.lit(3.0), "extra": r})
    a, b = (rows(tp.travel_time(cells, tile=t), "travel_h", "extra") for t in (side, None))
    assert a == b and any(v[0] is None for v in a.values()) and sum(v[0] is not None for v in a.values()) > 900


def test_no_tile_holds_more_than_its_square_and_ring(spark):
    cells = grid.make_cells(missions(spark, (200,)))
    spread = tiles.haloed(cells, 32, 4).groupBy(*tiles.TILE).count().collect()
    assert len(spread) == 49 and max(x["count"] for x in spread) <= 40 * 40


def star(rng, lat, lon, reach):
    """A closed polygon of 3 to 9 corners around a point."""
    angles = np.sort(rng.random(rng.integers(3, 10)) * 2 * np.pi)
    radius = reach * (0.3 + 0.7 * rng.random(len(angles)))
    ring = [(float(lon + r * np.cos(a)), float(lat + r * np.sin(a))) for a, r in zip(angles, radius)]
    return ring + ring[:1]


def inside(rings, lon, lat):
    odd = False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
            odd ^= (y0 > lat) != (y1 > lat) and lon < (x1 - x0) * (lat - y0) / (y1 - y0) + x0
    return odd


def test_many_polygons_meet_blocks_of_cells(spark):
    """Hundreds of polygons of all sizes in one mission, with holes, off the grid, and covering whole blocks."""
    rng = np.random.default_rng(4)
    cells = grid.with_cell_latlon(grid.make_cells(missions(spark, (50, 20)))).select("mission_id", "row", "col", "lat", "lon").cache()
    mine = {i: [x for x in cells.collect() if x["mission_id"] == i] for i in (0, 1)}
    polygons = []
    for n in range(260):
        mission = int(n % 5 == 0)
        centre = mine[mission][rng.integers(len(mine[mission]))]
        rings = [star(rng, centre["lat"] + rng.normal() * 0.002, centre["lon"] + rng.normal() * 0.002, 10 ** -rng.uniform(1.8, 4.5))]
        if n % 4 == 0:
            rings.append(star(rng, centre["lat"], centre["lon"], 0.001))
        polygons.append((mission, n, rings))
    polygons += [(0, 900, [square(-170.0, -80.0, 170.0, 80.0)[0]]), (0, 901, []), (0, 902, None), (7, 903, [square(34.9, 32.7, 35.2, 32.9)[0]])]
    table = spark.createDataFrame(polygons, "mission_id long, polygon int, rings array<array<struct<lon:double,lat:double>>>")
    got = joins.cells_in_polygon(cells, table)
    assert set(got.columns) == {"mission_id", "row", "col", "lat", "lon", "polygon", "rings"}
    got = sorted((x["mission_id"], x["polygon"], x["row"], x["col"]) for x in got.collect())
    want = sorted((m, n, x["row"], x["col"]) for m, n, rings in polygons if rings for x in mine.get(m, []) if inside(rings, x["lon"], x["lat"]))
    assert got == want and len(want) > 5000
    blocks = joins.polygon_blocks(cells, table)
    assert blocks.count() == blocks.select("polygon", "_br", "_bc").distinct().count()


@pytest.mark.parametrize("windows", [0, 8])
def test_overlapping_searches_without_sequence_all_count(spark, monkeypatch, windows):
    monkeypatch.setattr(ev, "WINDOW_SEARCHES", windows)
    cells = spark.createDataFrame([(m, r, c, float(r), float(c), 1 / 16) for m in (1, 2) for r in range(4) for c in range(4)],
                                  "mission_id long, row int, col int, lat double, lon double, p double")
    twice = square(-0.5, -0.5, 1.5, 3.5)
    searches = spark.createDataFrame([(1, twice, 0.5), (1, twice, 0.5), (1, square(-0.5, -0.5, 1.5, 1.5), 0.85), (1, square(9.0, 9.0, 10.0, 10.0), 0.9)],
                                     "mission_id long, rings array<array<struct<lon:double,lat:double>>>, pod double")
    p = np.full((4, 4), 1 / 16)
    for area, pod in (((slice(0, 4), slice(0, 2)), 0.5), ((slice(0, 4), slice(0, 2)), 0.5), ((slice(0, 2), slice(0, 2)), 0.85)):
        p[area] *= 1 - pod
        p /= p.sum()
    for x in ev.negative_search(cells, searches).collect():
        assert abs(x["p"] - (p[x["row"], x["col"]] if x["mission_id"] == 1 else 1 / 16)) < 1e-12
        assert x["searched"] == (x["mission_id"] == 1 and x["col"] < 2)
