"""ETL, ordered rules on hot keys, and routes against direct computation."""

import datetime as dt
import json
import math
import os
import random

import numpy as np
from pyspark.sql import functions as F

from scoutgrid.operators import folds, grid, joins, points, routes, slices, telemetry as tm
from scoutgrid.settings import DEFAULTS
from scoutgrid.sources import readers, sinks

BASE = dt.datetime(2026, 6, 11, 10, 0, tzinfo=dt.timezone.utc)


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def hot_events(spark, n=3000, span=40000):
    """Three keys; one of them holds most rows."""
    rng = np.random.default_rng(11)
    t = np.sort(rng.integers(0, span * 1000, n))
    key = np.where(rng.uniform(size=n) < 0.7, 0, rng.integers(1, 3, n))
    rows = [(int(i), int(k), at(int(x) / 1000), float(v)) for i, (k, x, v) in enumerate(zip(key, t, rng.uniform(1, 9, n)))]
    return rows, spark.createDataFrame(rows, "id bigint, k bigint, ts timestamp, x double")


def flight(spark, seconds):
    return spark.createDataFrame([(0, i, at(s), 32.7, 35.0, 100.0) for i, s in enumerate(seconds)],
                                 "flight bigint, source_index bigint, ts timestamp, lat double, lon double, altitude_ft double")


def found(spark, seconds):
    return spark.createDataFrame([(0, i, at(18000 + s), True, 0.8, [1.0, 2.0, 3.0, 4.0], 7) for i, s in enumerate(seconds)],
                                 "flight bigint, source_index bigint, ts timestamp, person boolean, confidence double, bbox array<double>, frame int")


def test_merge_matches_nearest_across_clocks(spark):
    a, d = flight(spark, [0.0, 0.1, 0.2]), found(spark, [0.11])
    merged, chosen = tm.merge_flights(a, d, ["flight"])
    out = {r.source_timestamp: r for r in tm.output_records(merged, ["flight"]).collect()}
    first = out["2026-06-11T10:00:00.000Z"]
    assert first.person_found and first.confidence_percent == 80.0 and abs(first.altitude - 30.48) < 1e-9
    assert sum(r.person_found for r in out.values()) == 1
    rep = tm.merge_report(a, d, merged, chosen, ["flight"]).first()
    assert rep.matched_records == 1 and abs(rep.clock_offset_seconds - 18000.11) < 1e-6


def test_outside_tolerance_is_unmatched(spark):
    a, d = flight(spark, [0.0, 0.1, 0.2]), found(spark, [0.0, 0.5])
    merged, chosen = tm.merge_flights(a, d, ["flight"], DEFAULTS.but(merge_tolerance_sec=0.05))
    rep = tm.merge_report(a, d, merged, chosen, ["flight"]).first()
    assert (rep.matched_records, rep.unmatched_json_records, rep.unmatched_selected_json_records, rep.unmatched_csv_rows) == (1, 1, 1, 2)


def test_readers_and_writers(spark, tmp_path):
    lines = tmp_path / "d.jsonl"
    lines.write_text('﻿{"ts":"bad","person":true}\n{"ts":"2026-06-11T10:00:00Z","person":true,"confidence":3,"latitude":1}\nnot json\n[1]\n')
    merge = readers.read_merge_detections(spark, str(lines))
    assert merge.where("malformed").count() == 3 and merge.where("not malformed").count() == 1
    r = readers.read_detections(spark, str(lines)).collect()
    assert len(r) == 1 and r[0].confidence == 1.0 and r[0].lat is None
    array = tmp_path / "d.json"
    array.write_text(json.dumps([{"timestamp": "2026-06-11T10:00:00+00:00", "person_found": None, "person": True}, {"ts": "2026-06-11T10:00:01Z", "person": True, "bbox": [1, 2]}]))
    got = readers.read_detections(spark, str(array), "array").orderBy("ts").collect()
    assert [g.person for g in got] == [False, True] and got[1].bbox == [1.0, 2.0]
    assert readers.read_detections(spark, str(tmp_path / "none.json")).count() == 0
    log = tmp_path / "f.csv"
    cols = ["CUSTOM.date [local]", "CUSTOM.updateTime [local]", "OSD.latitude", "OSD.longitude", "OSD.altitude [ft]"]
    log.write_text("﻿sep=,\n" + ",".join(cols) + "\n6/11/2026,1:00:00.00 PM,32.7,35.0,100\n6/11/2026,oops,32.7,35.0,100\n")
    f = readers.read_flight_log(spark, str(log), cols).orderBy("source_index").collect()
    assert [x.malformed for x in f] == [False, True] and f[0].ts == dt.datetime(2026, 6, 11, 10, 0)
    out = str(tmp_path / "out")
    sinks.write_json_arrays(spark.createDataFrame([(2, "b"), (1, "a")], "n int, v string"), out, [], ["n"])
    body = "".join(open(os.path.join(out, p)).read() for p in os.listdir(out) if p.startswith("part"))
    assert json.loads(body) == [{"n": 1, "v": "a"}, {"n": 2, "v": "b"}]


def test_osm_xml(spark, tmp_path):
    p = tmp_path / "m.xml"
    p.write_text('<osm><node id="1" lat="32.1" lon="35.1"/><node id="2" lat="32.2" lon="35.2"/><way id="9"><nd ref="2"/><nd ref="7"/><nd ref="1"/><tag k="highway" v="path"/></way>'
                 '<way id="8"><nd ref="1"/><nd ref="2"/><tag k="highway" v="motorway"/></way></osm>')
    r = readers.roads_from_osm_xml(spark, str(p)).collect()
    assert len(r) == 1 and [q.lat for q in r[0].pts] == [32.2, 32.1]


def test_throttle_and_smoothing_on_a_hot_key(spark):
    rows, df = hot_events(spark)
    want, last = set(), {}
    smooth, state = {}, {}
    for i, k, t, x in rows:
        if k not in last or (t - last[k]).total_seconds() >= 7.5:
            want.add(i)
            last[k] = t
        state[k] = x if k not in state else 0.9 * state[k] + 0.1 * x
        smooth[i] = state[k]
    assert {r.id for r in folds.throttle(df, ["k"], 7.5, tie=("id",), slice_sec=600.0).collect()} == want
    got = {r.id: r.smooth for r in folds.ewma(df, ["k"], "x", tie=("id",), slice_sec=600.0).collect()}
    assert got.keys() == smooth.keys() and all(abs(got[i] - smooth[i]) < 1e-9 for i in got)


def test_sessions_ranks_and_previous_do_not_depend_on_slices(spark):
    rows, df = hot_events(spark)
    number, last, count, rank = {}, {}, {}, {}
    for i, k, t, _ in rows:
        if k not in last or (t - last[k]).total_seconds() > 30:
            count[k] = count.get(k, 0) + 1
        last[k] = t
        rank[k] = rank.get(k, 0) + 1
        number[i] = (count[k], rank[k])
    for width in (300.0, 1e6):
        s = tm.sessionize(df, ["k"], 30.0, slice_sec=width, tie=("id",))
        r = slices.running_rank(slices.with_slice(s, F.unix_micros("ts") / 1e6, width), ["k"], ["ts", "id"])
        assert {x.id: (x.session, x["rank"]) for x in r.collect()} == number


def test_nearest_match_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    a = [(i, int(rng.integers(0, 2)), float(t)) for i, t in enumerate(rng.integers(0, 2000, 300) / 2)]
    b = [(i, int(rng.integers(0, 2)), float(t)) for i, t in enumerate(rng.choice(4000, 400, replace=False) / 4)]
    schema = "id bigint, k bigint, ts timestamp"
    left = spark.createDataFrame([(i, k, at(t)) for i, k, t in a], schema)
    right = spark.createDataFrame([(i, k, at(t)) for i, k, t in b], schema)
    for tie in ("later", "earlier"):
        got = {r.id: r.r_id for r in joins.asof_nearest(left, right, ["k"], 1.0, tie, slice_sec=7.0).collect()}
        for i, k, t in a:
            near = [(abs(u - t), -u if tie == "later" else u, j) for j, q, u in b if q == k and abs(u - t) <= 1.0]
            assert got[i] == (min(near)[2] if near else None)


def test_resample_copies_follow_the_weights(spark):
    w = np.array([0.05, 0.4, 0.0, 0.25, 0.3])
    p = spark.createDataFrame([(0, i, float(x)) for i, x in enumerate(w)], "mission_id bigint, idx bigint, weight double")
    u0 = 0.11
    got = {r.idx: r["count"] for r in points.systematic_resample(p, F.lit(u0), block=2).groupBy("idx").count().collect()}
    drawn = np.clip(np.searchsorted(np.cumsum(w), u0 + np.arange(5) / 5), 0, 4)
    assert got == {int(i): int((drawn == i).sum()) for i in np.unique(drawn)}


def test_subsample_keeps_finds(spark):
    rows = [(i, 0, at(i), i % 90 == 0) for i in range(1000)]
    got = {r.id for r in tm.subsample(spark.createDataFrame(rows, "id bigint, k bigint, ts timestamp, person boolean"), ["k"], 100, slice_sec=60.0, tie=("id",)).collect()}
    others = [i for i in range(1000) if i % 90]
    keep = 100 - (1000 - len(others))
    want = {i for i in range(1000) if i % 90 == 0} | {others[min(len(others) - 1, int(j * (len(others) / keep)))] for j in range(keep)}
    assert got == want


def test_routes_equal_brute_force_and_do_not_cross(spark):
    n, rng = 24, np.random.default_rng(9)
    p = rng.uniform(size=(n, n)) ** 6
    p /= p.sum()
    m = spark.createDataFrame([(0, 32.794, 34.9896, n, 50.0)], "mission_id bigint, lkp_lat double, lkp_lon double, size int, res_m double")
    rows = [(r, c, float(p[r, c])) for r in range(n) for c in range(n)]
    cells = grid.make_cells(m).drop("p").join(spark.createDataFrame(rows, "row int, col int, p double"), ["row", "col"])
    order = sorted(((p[r, c], r, c) for r in range(n) for c in range(n)), reverse=True)[:128]
    here, flown, covered, want = (0.0, 0.0), 0.0, set(), []
    while len(want) < 12:
        best = None
        for _, r, c in order:
            x, y = (c - n // 2) * 50.0, (n // 2 - r) * 50.0
            leg = math.hypot(x - here[0], y - here[1])
            if (r, c) in want or flown + leg > 6000:
                continue
            gain = sum(p[a, b] for a in range(max(0, r - 2), min(n, r + 3)) for b in range(max(0, c - 2), min(n, c + 3)) if (a, b) not in covered)
            if best is None or gain / (1 + leg / 750) > best[0]:
                best = (gain / (1 + leg / 750), r, c, leg, (x, y))
        _, r, c, leg, here = best
        want.append((r, c))
        flown += leg
        covered |= {(a, b) for a in range(max(0, r - 2), min(n, r + 3)) for b in range(max(0, c - 2), min(n, c + 3))}
    stops = routes.plan_routes(cells)
    assert [(s.row, s.col) for s in stops.orderBy("stop").collect()] == want
    pins = grid.with_origin(m)
    placed, summary = routes.drone_routes(cells, pins)
    s = summary.first()
    assert s.length_m <= flown + 1e-6 and abs(s.expected_coverage - sum(p[q] for q in covered)) < 1e-12
    assert routes.route_crossings(placed, pins).first().crossings == 0
    assert {(x.row, x.col) for x in placed.collect()} == set(want)


def burst(spark):
    """One key with a third of all rows: a burst of 30 rows a second, ties, then an idle month; others sparse."""
    rng = random.Random(11)
    start = 1_700_000_000_000_000
    times = [start + i * 33_333 for i in range(3000)] + [start + 100_000_000] * 40 + [start + 30 * 86_400_000_000 + i * 700_000 for i in range(500)]
    rows = [(1, t) for t in times] + [(2 + rng.randrange(40), start + rng.randrange(40 * 86_400_000_000)) for _ in range(7000)]
    rows = [(i, k, t, rng.random() * 10) for i, (k, t) in enumerate(rows)]
    return rows, spark.createDataFrame(rows, "id bigint, k bigint, t bigint, x double").select("id", "k", F.timestamp_micros("t").alias("ts"), "x")


def test_slices_are_bounded_by_rows(spark):
    rows, df = burst(spark)
    order = [F.unix_micros("ts"), F.col("id")]
    timed = slices.sliced(df, ["k"], order, F.unix_micros("ts") / 1e6, 3600.0, 5000)
    assert timed.groupBy("k", slices.SLICE).count().agg(F.max("count")).first()[0] > 3000
    cut = slices.sliced(df, ["k"], order, F.unix_micros("ts") / 1e6, 3600.0, 200)
    assert cut.groupBy("k", slices.SLICE).count().agg(F.max("count")).first()[0] <= 400
    assert cut.count() == len(rows)
    same = spark.createDataFrame([(1, 5)] * 3000, "k bigint, t bigint")
    assert slices.row_slices(same, ["k"], [F.col("t")], 200).groupBy(slices.SLICE).count().agg(F.max("count")).first()[0] <= 400


def test_burst_equals_plain_loops(spark):
    rows, df = burst(spark)
    by_key = {}
    for i, k, t, x in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        by_key.setdefault(k, []).append((i, t, x))
    kept, smooth, session = set(), {}, {}
    for k, items in by_key.items():
        last, state, n, before = None, None, 0, None
        for i, t, x in items:
            if last is None or t - last >= 5_000_000:
                last = t
                kept.add(i)
            state = x if state is None else 0.9 * state + 0.1 * x
            smooth[i] = state
            n += before is None or t - before > 10_000_000
            session[i], before = n, t
    for limit in (200, 100_000):
        assert {r.id for r in folds.throttle(df, ["k"], 5.0, tie=("id",), slice_sec=3600.0, rows=limit).collect()} == kept
        got = {r.id: r.smooth for r in folds.ewma(df, ["k"], "x", tie=("id",), rows=limit).collect()}
        assert got.keys() == smooth.keys() and all(abs(got[i] - v) < 1e-9 for i, v in smooth.items())
        assert {r.id: r.session for r in tm.sessionize(df, ["k"], 10.0, tie=("id",), rows=limit).collect()} == session
    samples = df.where("id % 3 = 0").select("k", "ts", F.col("id").alias("sample"))
    found = df.where("id % 3 <> 0")
    a = {r.id: (r.r_sample, r.gap_sec) for r in joins.asof_nearest(found, samples, ["k"], 20.0, rows=150).collect()}
    b = {r.id: (r.r_sample, r.gap_sec) for r in joins.asof_nearest(found, samples, ["k"], 20.0, slice_sec=1e9, rows=10**9).collect()}
    assert a == b and len(a) == found.count() and any(v[0] is not None for v in a.values())


def test_cool_down_tables_stay_short(spark, monkeypatch):
    """Many slices per key, composed in runs of three: the tables hold entries of one cool-down only, and the rows kept are those of a loop."""
    monkeypatch.setattr(slices, "FAN", 3)
    times = sorted(random.Random(5).randrange(400_000) for _ in range(6000))
    df = spark.createDataFrame([(1, t, i) for i, t in enumerate(times)] + [(2, 7, 0)], "k bigint, s bigint, id bigint").select("k", "id", F.timestamp_seconds("s").alias("ts"))
    last, want = None, {(2, 7)}
    for t in times:
        if last is None or t - last >= 900:
            last = t
            want.add((1, t))
    got = folds.throttle(df, ["k"], 900.0, tie=("id",), slice_sec=1800.0, rows=100).select("k", F.unix_seconds("ts").alias("s")).collect()
    assert {(r.k, r.s) for r in got} == want and len(got) == len(want)
    table = folds._composed([folds._table(t[0], np.array(t), np.array(t)[folds._jumps(np.array(t), 900)[-1]], 900) for t in (times[:50], times[50:100], times[100:150])], 900)
    assert len(table["first"]) <= 1 + sum(t <= times[0] + 900 for t in times[:150])


def test_thinned_flights_bound_paths(spark):
    """Schedule and paths of thinned flights against a plain loop: finds stay, the rest is picked evenly."""
    from scoutgrid.operators import tracks
    at = dt.datetime(2026, 6, 11, 10)
    flown = [(1, f, f * 1000 + i, at + dt.timedelta(seconds=i * 2), i % 17 == 3, 32.0 + i / 1e4, 35.0) for f, n in ((0, 90), (1, 12), (2, 400)) for i in range(n)]
    records = spark.createDataFrame(flown, "mission_id long, sortie int, record_id long, ts timestamp, person boolean, lat double, lon double")
    want = {}
    for f in range(3):
        rows = [r for r in flown if r[1] == f]
        found, others = [r for r in rows if r[4]], [r for r in rows if not r[4]]
        keep = 20 - len(found)
        if len(rows) > 20:
            rows = found + [others[min(len(others) - 1, int(i * (len(others) / keep)))] for i in range(max(keep, 0))]
        want[f] = sorted(r[2] for r in rows)
    thin = tracks.thinned(records, DEFAULTS.but(sortie_max_points=20)).cache()
    got = {f: sorted(r["record_id"] for r in thin.where(f"sortie = {f}").collect()) for f in range(3)}
    assert got == want and [len(want[f]) for f in range(3)] == [20, 12, 24]
    plan = spark.createDataFrame([(1, [], 120.0)], "mission_id long, delays array<double>, first_delay double")
    paths = tracks.track_snapshot(tracks.reveal(thin, tracks.sortie_schedule(thin, plan)), F.lit(1e6)).collect()
    assert {p["sortie"]: len(p["path"]) for p in paths} == {f: len(want[f]) for f in range(3)}
