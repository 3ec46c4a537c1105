"""Streaming forms agree with their batch twins."""

import datetime as dt
import json

import numpy as np
from pyspark.sql import functions as F

from scoutgrid.operators import evidence as ev, folds, grid, telemetry as tm
from scoutgrid.plans import heatmap as hm, queries as q, tables as tb
from scoutgrid.streaming import ticks as st
from test_telemetry import hot_events


def stored(spark, df, path, files=3):
    df.repartition(files).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_ticks(spark, small, tmp_path):
    d = tb.detections(spark, small)
    m = tb.missions(spark, small)
    live = drained(st.stream_ticks(stored(spark, d, str(tmp_path / "d")), m, "60 days"), "ticks")
    want = q.tick_join(spark, small)
    got = live.groupBy("mission_id", "tick").agg(F.count_if("person").alias("finds"), F.count_if(~F.col("person")).alias("sweeps"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def run_once(stream, out, checkpoint):
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()


def test_throttle_stream_keeps_whole_rows_across_a_restart(spark, tmp_path):
    """Three files in time order, the last one after a restart from the checkpoint: the rows kept are those of the batch rule."""
    _, df = hot_events(spark, 400, 4000)
    df = df.withColumn("extra", F.concat(F.lit("e"), "id")).cache()
    cuts = df.select(F.expr("percentile(unix_micros(ts), array(0.4, 0.7))").alias("c")).first()["c"]
    parts = [F.unix_micros("ts") <= cuts[0], (F.unix_micros("ts") > cuts[0]) & (F.unix_micros("ts") <= cuts[1]), F.unix_micros("ts") > cuts[1]]
    path, out, checkpoint = (str(tmp_path / n) for n in ("e", "out", "ck"))
    for n, part in enumerate(parts):
        df.where(part).coalesce(1).write.mode("append").parquet(path)
        if n > 0:  # the second run starts from the state of the first
            stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
            run_once(st.stream_throttle(stream, ["k"], 20.0, tie=("id",)), out, checkpoint)
    got, want = spark.read.parquet(out), folds.throttle(df, ["k"], 20.0, tie=("id",), slice_sec=300.0)
    assert got.columns == df.columns and got.count() == want.count() > 100
    assert got.exceptAll(want).count() == 0


def test_kept_by_cooldown():
    t = np.array([0, 1, 5, 5, 9, 10, 30])
    assert st.kept_by_cooldown(t, 5, None).tolist() == [0, 2, 5, 6] and st.kept_by_cooldown(t, 5, 2).tolist() == [4, 6]
    assert st.kept_by_cooldown(t, 5, 100).tolist() == st.kept_by_cooldown(t[:0], 5, None).tolist() == []


def test_idle_missions_decay_by_timer(spark, tmp_path):
    """Mission 1 sends once and falls silent while mission 2 moves the watermark; a restart from the checkpoint lies between."""
    start = dt.datetime(2026, 1, 1)
    missions = spark.createDataFrame([(1, start, 60.0), (2, start, 60.0)], "mission_id bigint, lkp_ts timestamp, step_sec double")
    at = lambda tick: start + dt.timedelta(seconds=60 * tick - 30)
    sweeps = [(1, 3, 3, 1), (1, 4, 4, 2), (2, 0, 0, 1)]
    later = [(2, 0, 1, 5), (1, 3, 3, 5)]
    last = [(2, 9, 9, 9)]
    path, out, checkpoint = (str(tmp_path / n) for n in ("s", "out", "ck"))
    for part in (sweeps, later, last):
        spark.createDataFrame([(m, r, c, t, at(t)) for m, r, c, t in part], "mission_id bigint, row int, col int, tick bigint, ts timestamp").coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("mission_id bigint, row int, col int, tick bigint, ts timestamp").parquet(path)
        run_once(st.stream_clean_scores(stream, missions, delay="0 seconds", least=0.5), out, checkpoint)
    got = {(r["mission_id"], r["tick"], r["row"], r["col"]): r["clean"] for r in spark.read.parquet(out).collect()}
    want = {}
    swept = sweeps + later
    for tick in range(1, 9):  # the watermark ends in tick 9
        for m, r, c in {s[:3] for s in swept}:
            known = [t for a, b, d, t in swept if (a, b, d) == (m, r, c) and t <= tick]
            if known and 0.9 ** (tick - max(known)) >= 0.5:
                want[m, tick, r, c] = 0.9 ** (tick - max(known))
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    assert (1, 8, 4, 4) in got and (2, 3, 0, 0) in got


def test_live_sweep_as_a_stream(spark, small, tmp_path):
    """Three batches of records against a streamed launch plan give the sweep of the batch query."""
    shown = q.revealed(spark, small).where("lat is not null").cache()
    launches = shown.groupBy("mission_id", "sortie").agg(F.min("ts").alias("base_ts"), F.first("start_sec").alias("start_sec"), F.first("north_m").alias("north_m"))
    records = shown.drop("start_sec", "north_m", "reveal_sec", "asset_id", "found", "duration", "base_ts")
    left = stored(spark, records, str(tmp_path / "r"))
    right = stored(spark, launches, str(tmp_path / "l"), 1)
    live = st.stream_live_sweep(left, right, q.STEP, "60 days", "60 days")
    run_once(live, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out"))
    m = grid.with_origin(tb.missions(spark, small)).select("mission_id", "epsg", "origin_e", "origin_n", "size", "res_m")
    keep = [c for c in got.columns if c == "mission_id" or c not in m.columns]
    swept = ev.swept_cells(got.select(*keep).join(m, "mission_id"), tb.RES_M, north_m="north_m").select("mission_id", "tick", "row", "col")
    want = q.live_sweep(spark, small).select(*swept.columns)
    assert got.count() == records.count() and swept.exceptAll(want).count() == want.exceptAll(swept).count() == 0


def test_sessions_and_first_events(spark, tmp_path):
    _, df = hot_events(spark, 300, 9000)
    late = spark.createDataFrame([(-1, 9, dt.datetime(2026, 7, 1), 0.0)], df.schema)
    df.unionByName(late).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "s"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    got = drained(st.stream_sessions(read(), ["k"], "30 seconds", "1 minute"), "ses").where("k < 9")
    want = tm.session_bounds(tm.sessionize(df, ["k"], 30.0, tie=("id",)), ["k"]).drop("session")
    assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).count() == 0
    events = read().withColumnRenamed("k", "mission_id").withColumn("frame", (F.col("id") % 20).cast("int"))
    seen = drained(st.first_events(events, "60 days"), "first")
    assert seen.where("mission_id < 9").count() == df.select("k", F.col("id") % 20).distinct().count()


def test_fold_and_relayer(spark, small, tmp_path):
    m = tb.missions(spark, small)
    fields = hm.prepare_fields(tb.terrain_of(m), 3, F.lit(3600.0)).cache()
    first = hm.raw_surfaces(fields, F.array(F.lit(0)))
    start = first.select("mission_id", "row", "col", "p", "tick", F.lit(None).cast("bigint").alias("last_sweep")).withColumn("tick", F.col("tick").cast("bigint"))
    state = st.StateTable(str(tmp_path / "state"), start)
    records = q.ticked(spark, small).where("tick = 1")
    records.write.mode("overwrite").parquet(str(tmp_path / "rec"))
    fold = st.fold_batches(fields, state, m, 50.0)
    stream = spark.readStream.schema(records.schema).parquet(str(tmp_path / "rec"))
    st.run_fold(fold, stream, str(tmp_path / "ck")).awaitTermination()
    got = {(r.mission_id, r.row, r.col): r.p for r in state.latest().collect()}
    both = hm.raw_surfaces(fields, F.array(F.lit(0), F.lit(1)))
    want = hm.run_ticks(both, 1, ev.swept_cells(records, 50.0), ev.boost_factors(ev.person_events(records).drop("position")))
    live = {r.mission_id for r in records.select("mission_id").distinct().collect()}
    checked = [r for r in want.collect() if r.mission_id in live]
    assert checked and all(abs(got[(r.mission_id, r.row, r.col)] - r.p) < 1e-12 for r in checked)
    fold(spark.read.parquet(str(tmp_path / "rec")), 0)  # the same batch again leaves the same state
    assert {(r.mission_id, r.row, r.col): r.p for r in state.latest().collect()} == got
    control = spark.createDataFrame([(1, json.dumps({"event": "update_layers", "mission_id": "1", "layers": {"topography": False, "roads": True, "bogus": True}}))], "seq bigint, value string")
    st.relayer_batches(fields, state)(control, 1)
    again = {(r.mission_id, r.row, r.col): r.p for r in state.latest().collect()}
    assert any(again[k] != got[k] for k in got if k[0] == 1) and all(again[k] == got[k] for k in got if k[0] != 1)


def test_three_ticks_in_one_batch_equal_the_batch_fold(spark, small, tmp_path):
    m = tb.missions(spark, small).where("mission_id <= 4")
    fields = hm.prepare_fields(tb.terrain_of(m), 3, F.lit(3600.0)).cache()
    surfaces = hm.raw_surfaces(fields, F.array(*[F.lit(t) for t in range(4)])).cache()
    start = surfaces.where("tick = 0").select("mission_id", "row", "col", "p", F.col("tick").cast("bigint").alias("tick"), F.lit(None).cast("bigint").alias("last_sweep"))
    placed = q.ticked(spark, small).where("mission_id <= 4")
    # the first two missions report in all ticks, the third only in tick 3, the last never
    records = placed.withColumn("tick", F.when(F.col("mission_id") <= 2, 1 + F.col("event_id") % 3).otherwise(3)).where("mission_id <= 3").cache()
    state = st.StateTable(str(tmp_path / "state"), start)
    st.fold_batches(fields, state, m, 50.0)(records, 0)
    got = {(r.mission_id, r.row, r.col): (r.p, r.tick) for r in state.latest().collect()}
    want = hm.run_ticks(surfaces, 3, ev.swept_cells(records, 50.0), ev.boost_factors(ev.person_events(records).drop("position"))).collect()
    moved = {r.mission_id for r in records.select("mission_id").distinct().collect()}
    assert len(moved) >= 2
    for r in want:
        p, tick = got[r.mission_id, r.row, r.col]
        assert (abs(p - r.p) < 1e-12 and tick == 3) if r.mission_id in moved else tick == 0


def test_new_missions_fold_all_ticks_and_late_records_are_kept(spark, small, tmp_path):
    m = tb.missions(spark, small).where("mission_id IN (1, 2)")
    fields = hm.prepare_fields(tb.terrain_of(m), 3, F.lit(3600.0)).cache()
    records = q.ticked(spark, small).where("mission_id IN (1, 2)").withColumn("tick", 2 + F.col("event_id") % 3).cache()
    none = spark.createDataFrame([], "mission_id bigint, row int, col int, p double, tick bigint, last_sweep bigint")
    read = lambda state: {(r.mission_id, r.row, r.col): (round(r.p, 12), r.tick, r.last_sweep) for r in state.latest().collect()}
    assert records.select("mission_id", "tick").distinct().count() == 6
    whole, parts = st.StateTable(str(tmp_path / "whole"), none), st.StateTable(str(tmp_path / "parts"), none)
    st.fold_batches(fields, whole, m, 50.0)(records, 0)
    for tick in (2, 3, 4):
        st.fold_batches(fields, parts, m, 50.0)(records.where(F.col("tick") == tick), tick)
    assert read(whole) == read(parts) and {t for _, t, _ in read(whole).values()} == {4} and whole.late() is None
    # mission 1 sends only old ticks, mission 2 an old and a new one
    more = records.withColumn("tick", F.when(F.col("mission_id") == 1, F.col("tick")).when(F.col("tick") == 2, 3).otherwise(5))
    before = read(whole)
    for _ in range(2):  # run again, it leaves the same
        st.fold_batches(fields, whole, m, 50.0)(more, 1)
        assert whole.late().drop("batch").exceptAll(more.where("tick < 5")).count() == 0 and whole.late().count() == more.where("tick < 5").count()
    st.fold_batches(fields, parts, m, 50.0)(more.where("tick = 5"), 5)
    after = read(whole)
    assert after == read(parts) and {k[0]: v[1] for k, v in after.items()} == {1: 4, 2: 5}
    assert all(after[k] == before[k] for k in before if k[0] == 1)


def test_state_keeps_two_older_versions(spark, tmp_path):
    state = st.StateTable(str(tmp_path / "s"), spark.range(0))
    for batch in range(5):
        state.write(batch, spark.range(batch + 1))
    assert state._versions() == [2, 3, 4] and state.latest().count() == 5 and state.before(4).count() == 4


def test_delta_batches(spark, tmp_path):
    grid = spark.createDataFrame([(1, r, c, 0.0) for r in range(2) for c in range(2)], "mission_id bigint, row int, col int, p double")
    state = st.StateTable(str(tmp_path / "d"), grid)
    def delta(p):
        return json.dumps({"type": "heatmap_delta", "mission_id": "1", "timestamp": "t", "cells": [{"row": 0, "col": 1, "probability": p}, {"row": 9, "col": 9, "probability": p}]})
    batch = spark.createDataFrame([(1, delta(0.25)), (2, delta(0.75)), (3, "{broken")], "seq bigint, value string")
    st.merge_delta_batches(state)(batch, 0)
    assert {(r.row, r.col): r.p for r in state.latest().collect()} == {(0, 0): 0.0, (0, 1): 0.75, (1, 0): 0.0, (1, 1): 0.0}


def test_state_by_bucket(spark, tmp_path):
    """A batch of one mission writes one bucket; run again it leaves the same state; buckets that no kept version names go."""
    grid = spark.createDataFrame([(m, r, c, float(m)) for m in range(40) for r in range(2) for c in range(2)], "mission_id bigint, row int, col int, p double")
    state = st.StateTable(str(tmp_path / "s"), grid, buckets=8)
    read = lambda df: {(r.mission_id, r.row, r.col): r.p for r in df.collect()}
    want = read(grid)
    apply = st.merge_delta_batches(state)

    def batch(mission, p):
        text = '{"type":"heatmap_delta","mission_id":"%d","timestamp":"t","cells":[{"row":1,"col":0,"probability":%f}]}' % (mission, p)
        return spark.createDataFrame([(text, 1)], "value string, seq bigint")

    written = lambda n: sorted(f.name for f in (tmp_path / "s" / f"version={n}").glob("state_bucket=*"))
    for n, mission in enumerate([7, 7, 30, 7, 7, 11]):
        for _ in range(2):
            apply(batch(mission, n + 0.5), n)
        want[(mission, 1, 0)] = n + 0.5
        assert read(state.latest()) == want
        assert len(written(n)) == (8 if n == 0 else 1)
    apply(batch(7, 0.25).limit(0), 6)
    assert state._versions() == [3, 4, 5] and read(state.latest()) == want
    assert written(1) == [] and len(written(0)) < 8  # version 1 held only what version 3 and later replace
    touched = state.buckets_of(spark.createDataFrame([(7,)], "mission_id bigint"))
    assert len(touched) == 1
    assert read(state.before(6, touched)).items() <= want.items() and (7, 1, 0) in read(state.before(6, touched))
