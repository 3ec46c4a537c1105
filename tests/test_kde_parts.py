"""Kernel surface of a busy mission, spread in parts, against brute force."""

import math

from pyspark.sql import functions as F

from scoutgrid.operators import points
from scoutgrid.settings import DEFAULTS


def test_parts_of_a_busy_mission_add_up(spark, monkeypatch):
    monkeypatch.setattr(points, "PART_POINTS", 50)
    size, res = 12, 50.0
    flown = [(m, 1.0 + i % 5, 1000.0 + (i * 37 % 550), 5000.0 - (i * 53 % 550)) for m, n in ((0, 700), (1, 9)) for i in range(n)]
    given = spark.createDataFrame(flown, "mission_id long, weight double, point_e double, point_n double").withColumns(
        {"origin_e": F.lit(1275.0), "origin_n": F.lit(4725.0), "size": F.lit(size), "res_m": F.lit(res)})
    cells = spark.range(3).select(F.col("id").alias("mission_id"), F.lit(size).alias("size")).withColumn(
        "row", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    placed = given.select("mission_id", "weight", (points.geo.fractional_row(F.col("point_n"), F.col("origin_n"), F.col("size"), F.col("res_m")) - 0.5).alias("r"),
                          (points.geo.fractional_col(F.col("point_e"), F.col("origin_e"), F.col("size"), F.col("res_m")) - 0.5).alias("c")).collect()
    want = {(m, r, c): 0.0 for m in range(3) for r in range(size) for c in range(size)}
    for p in placed:
        for r in range(max(0, math.floor(p["r"] - 4)), min(size - 1, math.ceil(p["r"] + 4)) + 1):
            for c in range(max(0, math.floor(p["c"] - 4)), min(size - 1, math.ceil(p["c"] + 4)) + 1):
                want[p["mission_id"], r, c] += p["weight"] * math.exp(-0.5 * ((r - p["r"]) ** 2 + (c - p["c"]) ** 2) / DEFAULTS.kde_bandwidth ** 2)
    mass = {m: sum(v for k, v in want.items() if k[0] == m) for m in range(3)}
    got = {(x["mission_id"], x["row"], x["col"]): x["p"] for x in points.kde_surface(given, cells).collect()}
    assert got.keys() == want.keys() and mass[0] > 0 and mass[2] == 0
    assert all(abs(got[k] - (v / mass[k[0]] if mass[k[0]] else 0.0)) < 1e-9 for k, v in want.items())
