"""The merge from files of several flights: headers of different orders, quoted line breaks, bad rows counted."""

import json

from pyspark.sql import functions as F

from scoutgrid.operators import slices
from scoutgrid.plans import merge_job
from scoutgrid.settings import DEFAULTS
from scoutgrid.sources import readers

COLS = list(readers.LOG_COLUMNS)


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def log_text(columns, rows, head=""):
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') else v
    return head + "\n".join(",".join(map(quoted, r)) for r in [columns, *[[row.get(c, "") for c in columns] for row in rows]]) + "\n"


def sample(seconds, **more):
    return {"CUSTOM.date [local]": "6/11/2026", "CUSTOM.updateTime [local]": f"1:00:{seconds:05.2f} PM", "OSD.latitude": "32.7", "OSD.longitude": "35.0",
            "OSD.altitude [ft]": "100", **more}


def test_headers_in_any_order_and_quoted_line_breaks(spark, tmp_path):
    back = ["note", *reversed(COLS)]
    folder = write(tmp_path / "logs", "a.csv", log_text(COLS, [sample(0.0), sample(0.1)], "﻿sep=,\n"))
    write(tmp_path / "logs", "b.csv", log_text(back, [sample(0.2, note='say "hi", then\nsep=,\nthe end'), sample(0.3, note="plain"), sample(0.4, **{"OSD.altitude [ft]": "1,000"})]))
    write(tmp_path / "logs", "c.csv", "OSD.latitude,CUSTOM.date [local]\r\n32.1,6/11/2026\r\n\r\n32.2\r\n")
    got = readers.read_flight_log(spark, folder, line_breaks=True).withColumn("flight", merge_job.flight_of(F.col("source_path")))
    rows = {k: sorted((r for r in got.collect() if r["flight"] == k), key=lambda r: r["source_index"]) for k in "abc"}
    assert [len(rows[k]) for k in "abc"] == [2, 3, 2]
    assert [r["csv_row"]["note"] for r in rows["b"]] == ['say "hi", then\nsep=,\nthe end', "plain", ""]
    assert all(r["OSD.latitude"] == "32.7" and r["CUSTOM.date [local]"] == "6/11/2026" and not r["malformed"] for k in "ab" for r in rows[k])
    assert rows["b"][2]["OSD.altitude [ft]"] == "1,000" and rows["b"][0]["ts"].microsecond == 200_000
    assert [(r["OSD.latitude"], r["CUSTOM.date [local]"], r["OSD.altitude [ft]"], r["malformed"]) for r in rows["c"]] == [("32.1", "6/11/2026", None, True), ("32.2", None, None, True)]
    assert readers.read_flight_log(spark, str(tmp_path / "none*.csv")).count() == 0


def test_records_are_split_across_blocks_of_a_file(spark):
    """Line breaks inside quotes, with the lines of one file in several blocks."""
    lines = ['x,"one', 'two', 'three"', 'y,plain', 'z,"a ""b""', 'c"', 'last,1']
    table = spark.createDataFrame([("f", n // 2, n, v) for n, v in enumerate(lines)], f"source_path string, {slices.SLICE} bigint, source_index bigint, value string")
    got = [r["value"] for r in readers.log_records(table).orderBy("source_index").collect()]
    assert got == ['x,"one\ntwo\nthree"', 'y,plain', 'z,"a ""b""\nc"', 'last,1']


def test_merge_of_files_counts_everything(spark, tmp_path):
    logs = write(tmp_path / "logs", "f1.csv", log_text(COLS, [sample(0.0), sample(0.1), sample(0.1), sample(0.2), {**sample(0.3), "CUSTOM.updateTime [local]": "soon"}]))
    write(tmp_path / "logs", "f2.csv", log_text(COLS[::-1], [sample(5.0), sample(6.0)]))
    blank = write(tmp_path / "empty", "f1.csv", log_text(COLS, [sample(0.0), sample(1.0), {"OSD.latitude": "1"}]))
    at = lambda s, **more: json.dumps({"ts": f"2026-06-11T15:00:{s:06.3f}Z", "person": True, "confidence": 0.8, "frame": 7, **more})
    found = write(tmp_path / "found", "f1.jsonl", "\n".join([at(0.11), at(0.31), at(0.31), '{"ts":"bad"}', "not json", "[]", at(40.0)]) + "\n")
    write(tmp_path / "found", "f2.jsonl", at(0.0) + "\n" + at(1.0, bbox=[1, 2, 3, 4]) + "\n")
    parts = merge_job.merged_files(spark, logs, found, blank, zone="+03:00")
    report = {r["flight"]: r.asDict() for r in parts["report"].collect()}
    want = {"total_json_records": 4, "total_csv_rows": 4, "matched_records": 2, "selected_json_records": 3, "unmatched_json_records": 2, "unmatched_selected_json_records": 1,
            "unselected_json_records": 1, "unmatched_csv_rows": 2, "duplicate_json_timestamps": 1, "duplicate_csv_timestamps": 1, "malformed_json_timestamps": 3,
            "malformed_csv_timestamps": 1, "malformed_not_found_csv_timestamps": 1, "not_found_csv_rows": 2}
    assert {k: report["f1"][k] for k in want} == want
    assert report["f2"]["matched_records"] == 2 and report["f2"]["malformed_json_timestamps"] == report["f2"]["not_found_csv_rows"] == 0
    merged = parts["merged"].collect()
    assert len(merged) == 6 and sum(r["person_found"] for r in merged) == 4
    assert [r["bbox"] for r in merged if r["flight"] == "f2" and r["bbox"]] == [[1.0, 2.0, 3.0, 4.0]]
    empty = parts["not_found"].collect()
    assert len(empty) == 2 and not any(r["person_found"] for r in empty) and empty[0]["csv_row"]["OSD.latitude"] == "32.7"
    merge_job.run_merge(spark, logs, found, blank, str(tmp_path / "out"), zone="+03:00")
    assert spark.read.json(str(tmp_path / "out" / "report.json")).count() == 2 and spark.read.json(str(tmp_path / "out" / "merged.jsonl")).count() == 6
    assert DEFAULTS.merge_tolerance_sec == 0.15
