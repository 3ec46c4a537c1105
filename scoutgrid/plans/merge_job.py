"""The merge job from files: flight logs and detections of many flights in, merged records and a report per flight out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import safe_double
from ..operators import telemetry as tm
from ..settings import DEFAULTS, Settings
from ..sources import readers, sinks

KEY = "flight"


def flight_of(path: Column) -> Column:
    """A file's flight: its name up to the first point."""
    return F.regexp_extract(path, r"([^/.]+)[^/]*$", 1)


def log_samples(log: DataFrame) -> DataFrame:
    """Readable rows of a flight log as telemetry, in file order."""
    return log.where("not malformed").select(
        KEY, F.struct("source_block", "source_index").alias("source_index"), "ts", safe_double(F.col("`OSD.latitude`")).alias("lat"),
        safe_double(F.col("`OSD.longitude`")).alias("lon"), safe_double(F.col("`OSD.altitude [ft]`")).alias("altitude_ft"), "csv_row")


def merged_files(spark: SparkSession, logs: str, detections: str, not_found_logs: str, layout: str = "lines", zone: str = DEFAULTS.flight_zone,
                 settings: Settings = DEFAULTS, line_breaks: bool = False) -> dict[str, DataFrame]:
    """``merged`` and ``not_found`` (records in the published shape) and ``report`` (all counters), by flight.

    Rows without a readable time are left out and counted. The rows of flights without finds are only put in shape.
    """
    log, empty = (readers.read_flight_log(spark, path, zone=zone, line_breaks=line_breaks).withColumn(KEY, flight_of(F.col("source_path"))) for path in (logs, not_found_logs))
    raw = readers.read_merge_detections(spark, detections, layout).withColumn(KEY, flight_of(F.col("source_path")))
    found = tm.normalize_detections(raw.where("not malformed").drop("ts", "malformed"))
    samples, blank = log_samples(log), log_samples(empty)
    merged, chosen = tm.merge_flights(samples, found.select(KEY, "source_index", "ts", "person", "confidence", "bbox", "frame"), [KEY], settings)
    report = tm.merge_report(samples, found, merged, chosen, [KEY], blank, {
        "json": raw.where("malformed"), "csv": log.where("malformed"), "not_found_csv": empty.where("malformed")})
    kind = merged.schema["detection"].dataType
    shaped = blank.withColumns({"source_ts": F.col("ts"), "detection": F.lit(None).cast(kind)})
    return {"merged": tm.output_records(merged, [KEY], "csv_row"), "not_found": tm.output_records(shaped, [KEY], "csv_row"), "report": report}


def run_merge(spark: SparkSession, logs: str, detections: str, not_found_logs: str, out: str, **options) -> None:
    """Write ``merged`` and ``not_found`` as lines and the report as one object per flight."""
    parts = merged_files(spark, logs, detections, not_found_logs, **options)
    for name in ("merged", "not_found"):
        sinks.write_jsonl(parts[name], f"{out}/{name}.jsonl")
    sinks.write_report(parts["report"], f"{out}/report.json")
