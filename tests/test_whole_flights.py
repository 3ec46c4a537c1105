"""Flight queries work on every record of a flight, however many it has."""

import datetime as dt

import pytest

from scoutgrid.plans.queries import QUERIES

LONG = 95


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """One mission with a flight of many records and a short one, a minute apart."""
    out = str(tmp_path_factory.mktemp("flights"))
    at = dt.datetime(2024, 1, 1, 1)
    flown = [(u * 1000 + i, at + dt.timedelta(minutes=i), u, "purchase" if i % 50 == 7 else "view", float(i % 90)) for u, n in ((0, LONG), (1, 12)) for i in range(n)]
    spark.createDataFrame([(0, "s", 1, 1.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{out}/supplier.parquet")
    spark.createDataFrame(flown, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{out}/events.parquet")
    return out


def test_flights_are_whole(spark, folder):
    rows = lambda name: QUERIES[name](spark, folder).collect()
    assert {r["sortie"]: r["n_records"] for r in rows("sortie_schedule")} == {0: LONG, 1: 12}
    # the path ends at the last position, which the records hold already
    assert {r["sortie"]: r["n_points"] for r in rows("drone_tracks")} == {0: LONG, 1: 12}
    assert [(r["mission_id"], r["n_drones"]) for r in rows("track_heads")] == [(0, 2)]
    assert sum(r["sortie"] == 0 for r in rows("trail_segments")) == LONG - 1
    flown = [r for r in rows("all_evidence") if r["source"] == "sortie"]
    assert sum(r["finds"] + r["sweeps"] for r in flown) == LONG + 12


def test_every_record_sweeps(spark, folder):
    """Live sweep against the cells of the records' own discs."""
    from pyspark.sql import functions as F
    from scoutgrid.operators import evidence as ev, joins, tracks
    from scoutgrid.plans import queries as q, tables as tb
    from scoutgrid.operators import grid
    m = grid.with_origin(tb.missions(spark, folder)).select("mission_id", "epsg", "origin_e", "origin_n", "size", "res_m")
    shown = q.revealed(spark, folder)
    assert shown.count() == LONG + 12
    flown = shown.withColumn("tick", tracks.reveal_tick(F.lit(q.STEP))).where("not person")
    placed = joins.salted_join(flown.select("mission_id", "tick", "person", "lat", "lon", "north_m"), m, ["mission_id"])
    want = {tuple(r) for r in ev.swept_cells(placed, tb.RES_M, north_m="north_m").collect()}
    assert {tuple(r) for r in QUERIES["live_sweep"](spark, folder).collect()} == want
