"""Whole grids reach Python many at a time, and give what each gives alone."""

from pyspark.sql import functions as F

from scoutgrid.operators import grid, transport as tp


def test_grids_are_stacked(spark):
    sizes = [9, 16, 9, 5, 16, 9]
    m = spark.createDataFrame([(i, 32.794, 34.9896, n, 50.0 + i) for i, n in enumerate(sizes)], "mission_id long, lkp_lat double, lkp_lon double, size int, res_m double")
    r, c, k = F.col("row"), F.col("col"), F.col("mission_id")
    cells = grid.make_cells(m).select("mission_id", "row", "col", "size", "res_m", "is_pin", "p").withColumns({
        "on_road": (r == 3) | (c == 2), "cost": 1.0 + (r * 7 + c * 3 + k) % 5, "elevation": 10.0 + (r * 7 + c * 3 + k) % 11, "max_hours": 0.05 + k / 50, "n": (k % 4).cast("int"),
        "is_land": r + c < 3, "current_u": F.lit(0.4), "current_v": 0.1 * k})
    runs = {"p": lambda df: tp.diffuse(df, F.col("n")), "travel_h": tp.travel_time, "q": lambda df: tp.drift(df, F.col("n"), F.lit(60.0) + k).withColumnRenamed("p", "q")}
    for value, run in runs.items():
        values = lambda df: {(x["mission_id"], x["row"], x["col"]): x[value] for x in df.collect()}
        plan = run(cells)._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" not in plan
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")  # grids lie across batches
        try:
            split = values(run(cells))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        alone = {}
        for i in range(len(sizes)):
            alone |= values(run(cells.where(k == i)))
        assert split == alone == values(run(cells)) and len(split) == sum(n * n for n in sizes)
