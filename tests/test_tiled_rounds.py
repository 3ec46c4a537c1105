"""Tiled diffusion keeps a round only for another one to read, and gives what whole grids give."""

from pyspark.sql import functions as F

from scoutgrid.operators import grid, transport as tp


def test_rounds_are_kept_only_between(spark, monkeypatch):
    kept = []
    cut = tp.cut_lineage
    monkeypatch.setattr(tp, "cut_lineage", lambda df: kept.append(1) or cut(df))
    monkeypatch.setattr(tp, "ROUND_STEPS", 2)
    m = spark.createDataFrame([(i, 32.794, 34.9896, n, 50.0) for i, n in enumerate((9, 16))], "mission_id long, lkp_lat double, lkp_lon double, size int, res_m double")
    r, c = F.col("row"), F.col("col")
    cells = grid.make_cells(m).select("mission_id", "row", "col", "size", "p").withColumns({"on_road": (r == 3) | (c == 5), "cost": 1.0 + (r * 7 + c * 3) % 5})
    values = lambda df: {(x["mission_id"], x["row"], x["col"]): x["p"] for x in df.collect()}
    for steps, times in ((2, 0), (5, 2)):
        kept.clear()
        tiled = values(tp.diffuse(cells, steps, tile=6))
        whole = values(tp.diffuse(cells, steps))
        assert tiled.keys() == whole.keys() and all(abs(tiled[k] - v) < 1e-12 for k, v in whole.items())
        assert len(kept) == times


def test_travel_time_rounds_keep_tiles(spark, monkeypatch):
    """What a round keeps are rows of tiles and strips, not cells; a mission that comes twice stays twice."""
    kept = []
    cut = tp.cut_lineage
    monkeypatch.setattr(tp, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    m = spark.createDataFrame([(i, 32.794, 34.9896, n, 50.0) for i, n in ((0, 9), (1, 16), (2, 16), (2, 16))], "mission_id long, lkp_lat double, lkp_lon double, size int, res_m double")
    r, c = F.col("row"), F.col("col")
    cells = grid.make_cells(m).select("mission_id", "row", "col", "size", "res_m", "is_pin").withColumns(
        {"elevation": F.when((c == 7) & (r != 1), 900.0).otherwise(10.0 + (r * 7 + c * 3) % 5), "max_hours": F.lit(0.6)})
    values = lambda df: sorted(tuple(-1.0 if v is None else v for v in x) for x in df.select("mission_id", "row", "col", "travel_h").collect())
    whole = values(tp.travel_time(cells))
    assert len(whole) == 81 + 3 * 256 and any(x[3] > 0.1 for x in whole)
    # 4 tiles of the smaller grid, 9 of each larger one; a solved tile gives itself and eight strips at most
    for side, most in ((6, (4 + 2 * 9) * 9), (40, 3)):
        kept.clear()
        assert values(tp.travel_time(cells, tile=side)) == whole
        assert max(df.count() for df in kept) <= most
