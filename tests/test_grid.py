"""Geometry, terrain, transport and layers on tiny grids against direct computation."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoutgrid.functions import geo, scalars as sc
from scoutgrid.operators import evidence as ev, grid, joins, layers, raster, transport as tp
from scoutgrid.settings import DEFAULTS, NEIGHBOURS


def missions(spark, size=16, res=50.0, n=1, lat=31.7170, lon=35.9993):
    return spark.createDataFrame([(i, lat, lon, size, res) for i in range(n)], "mission_id bigint, lkp_lat double, lkp_lon double, size int, res_m double")


def matrix(df, value, n):
    out = np.zeros((n, n))
    for r in df.select("row", "col", value).collect():
        out[r[0], r[1]] = r[2] if r[2] is not None else np.inf
    return out


def with_matrix(spark, cells, name, values):
    rows = [(r, c, float(values[r][c])) for r in range(len(values)) for c in range(len(values))]
    return cells.join(spark.createDataFrame(rows, f"row int, col int, {name} double"), ["row", "col"])


def test_projection_matches_a_published_point(spark):
    d = spark.createDataFrame([(43.642567, -79.387139)], "lat double, lon double").withColumn("epsg", geo.utm_epsg(F.col("lon"), F.col("lat")))
    r = geo.with_utm(d, "lat", "lon", "epsg").first()
    assert r.epsg == 32617 and abs(r.easting - 630084.3) < 0.1 and abs(r.northing - 4833438.59) < 0.1


def test_missing_coordinates_stay_null(spark):
    d = spark.createDataFrame([(None, 35.0, 32636)], "lat double, lon double, epsg int")
    assert geo.with_utm(d, "lat", "lon", "epsg").first().easting is None


def test_pin_is_the_centre_of_its_cell_and_corners_are_close(spark):
    m = missions(spark, 128)
    c = grid.with_cell_latlon(grid.make_cells(m))
    pin = c.where("is_pin").first()
    assert abs(pin.lat - 31.7170) < 1e-9 and abs(pin.lon - 35.9993) < 1e-9
    q = grid.with_quad_latlon(grid.make_cells(m).join(grid.grid_metadata(m).select("mission_id", "corners"), "mission_id"))
    both = c.select("row", "col", "lat", "lon").join(q.select("row", "col", F.col("lat").alias("qlat"), F.col("lon").alias("qlon")), ["row", "col"])
    off = both.agg(F.max(F.hypot((F.col("lat") - F.col("qlat")) * 111320, (F.col("lon") - F.col("qlon")) * 94000))).first()[0]
    assert off < 1.0


def dijkstra(elev, res, start, limit):
    n, done = len(elev), np.full(elev.shape, np.inf)
    done[start] = 0.0
    heap = [(0.0, start)]
    while heap:
        t, (r, c) = heapq.heappop(heap)
        if t > done[r, c]:
            continue
        for dr, dc in NEIGHBOURS:
            a, b = r + dr, c + dc
            if 0 <= a < n and 0 <= b < n:
                run = math.hypot(dr, dc) * res
                speed = 4.2 / math.exp(-3.5 * 0.05) * math.exp(-3.5 * abs((elev[a, b] - elev[r, c]) / run + 0.05))
                new = t + run / 1000 / max(speed, 1e-6)
                if new < done[a, b] and new <= limit:
                    done[a, b] = new
                    heapq.heappush(heap, (new, (a, b)))
    return done


def test_travel_time_equals_dijkstra(spark):
    n = 16
    elev = np.random.default_rng(3).uniform(0, 120, (n, n))
    c = with_matrix(spark, grid.make_cells(missions(spark, n)), "elevation", elev).withColumn("max_hours", F.lit(0.4))
    got = matrix(tp.travel_time(c.select("mission_id", "row", "col", "size", "res_m", "is_pin", "elevation", "max_hours")), "travel_h", n)
    want = dijkstra(elev, 50.0, (8, 8), 0.4)
    assert np.isinf(want).any() and np.allclose(got, want, atol=1e-12)


def test_flat_ground_has_the_configured_speed(spark):
    assert abs(spark.range(1).select(sc.hiking_speed_kmh(F.lit(0.0))).first()[0] - 4.2) < 1e-12


def test_nearest_marks_equal_brute_force():
    rng = np.random.default_rng(5)
    for n, k in ((8, 1), (13, 5), (24, 60)):
        cells = rng.choice(n * n, size=k, replace=False)
        rows, cols = np.divmod(cells, n)
        got = raster._nearest_marks(rows, cols, n)
        for i in range(n * n):
            r, c = divmod(i, n)
            best = min(range(k), key=lambda j: ((rows[j] - r) ** 2 + (cols[j] - c) ** 2, cols[j], rows[j]))
            assert got[i] == best


def test_nearest_wanted_cell_equals_brute_force(spark):
    n = 12
    rng = np.random.default_rng(7)
    land = rng.uniform(size=(n, n)) < 0.06
    c = with_matrix(spark, grid.make_cells(missions(spark, n)), "land", land.astype(float)).withColumn("is_land", F.col("land") > 0)
    c = c.select("mission_id", "row", "col", "is_land")
    places = c.where("not is_land").drop("is_land")
    spots = [(int(r), int(k)) for r, k in zip(*np.where(land))]
    for r in joins.nearest_cell(places, c, F.col("is_land")).collect():
        want = min(spots, key=lambda s: ((s[0] - r.row) ** 2 + (s[1] - r.col) ** 2, s))
        assert (r.near_row, r.near_col) == want


def test_diffusion_prefers_roads_and_leaks_only_at_the_border(spark):
    n = 16
    c = grid.make_cells(missions(spark, n)).withColumn("on_road", F.col("row") == 8)
    p = matrix(tp.diffuse_flat(c.select("mission_id", "row", "col", "size", "on_road", "p"), 4), "p", n)
    assert abs(p.sum() - 1) < 1e-12 and p[8, 10] > p[10, 8]
    edge = c.withColumn("p", ((F.col("row") == 0) & (F.col("col") == 0)).cast("double"))
    assert matrix(tp.diffuse_flat(edge.select("mission_id", "row", "col", "size", "on_road", "p"), 1), "p", n).sum() < 1


def test_drift_moves_downstream_and_keeps_mass(spark):
    n = 16
    c = grid.make_cells(missions(spark, n)).withColumns({"is_land": F.lit(False), "current_u": F.lit(0.4), "current_v": F.lit(0.0)})
    p = matrix(tp.drift(c.select("mission_id", "row", "col", "size", "is_land", "current_u", "current_v", "p"), 8, F.lit(60.0)), "p", n)
    assert abs(p.sum() - 1) < 1e-12 and (p * np.arange(n)[None, :]).sum() > 9


def test_step_count_rules(spark):
    got = spark.createDataFrame([(0, 60.0), (1, 600.0), (2, 600.0), (3, 600.0), (3, 60.0)], "t int, dt double").select(
        sc.diffusion_steps(F.col("dt"), 0.88, F.col("t"))).collect()
    assert [r[0] for r in got] == [0, 6, 12, 18, 5]


def test_registering_a_layer_twice_fails():
    with pytest.raises(ValueError):
        layers.register_layer(layers.Layer("roads", layers.roads, lambda s: 1.0))


def test_registered_layer_takes_part(spark):
    layer = layers.Layer("halve", lambda cells, ctx, w: cells.withColumn("p", F.col("p") * (1 - 0.5 * w)), lambda s: 1.0)
    layers.register_layer(layer)
    try:
        c = grid.make_cells(missions(spark, 8)).withColumns({"halve": F.lit(True), "is_land": F.lit(True), "sea_drift": F.lit(False)})
        out = layers.apply_layers(c, layers.LayerContext(), ("halve",))
        assert abs(out.agg(F.sum("p")).first()[0] - 0.5) < 1e-12
    finally:
        layers.REGISTRY.remove(layer)


def test_search_lowers_mass_inside_and_keeps_one(spark):
    m = missions(spark, 16)
    c = grid.with_cell_latlon(grid.make_cells(m)).withColumn("p", F.lit(1.0) / 256)
    ring = [[(35.998, 31.716), (36.0006, 31.716), (36.0006, 31.7182), (35.998, 31.7182), (35.998, 31.716)]]
    s = spark.createDataFrame([(0, ring, 0.85)], "mission_id bigint, rings array<array<struct<lon: double, lat: double>>>, pod double")
    out = ev.negative_search(c, s)
    inside = out.where("searched")
    assert inside.count() > 0 and inside.agg(F.max("p")).first()[0] < 1 / 256 and abs(out.agg(F.sum("p")).first()[0] - 1) < 1e-12
    far = spark.createDataFrame([(0, [[(x + 5, y) for x, y in ring[0]]], 0.85)], s.schema)
    assert ev.negative_search(c, far).agg(F.max("p")).first()[0] == 1 / 256


def test_reach_and_classes_on_a_step(spark):
    n = 32
    elev = np.zeros((n, n))
    elev[8:24, 8:24] = np.linspace(0, 200, 16)[None, :]
    c = raster.slope_aspect(with_matrix(spark, grid.make_cells(missions(spark, n)), "elevation", elev + 5))
    t = raster.terrain_classes(c)
    assert t.where("is_cliff and not is_steep").count() == 0 and t.where("is_steep").count() > 0
    gy, gx = np.gradient(elev + 5, 50.0, 50.0)
    assert np.allclose(matrix(c, "slope", n), np.arctan(np.hypot(gx, gy)))
