"""Telemetry and detection ETL: normalising, sessions, the merge job and its report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import clamp, feet_to_metres, parse_flight_clock, parse_iso, safe_double, video_time
from ..settings import DEFAULTS, Settings
from .joins import asof_claim, asof_nearest, salted_join
from .slices import ROWS, SLICE, chained, join_back, running_rank, sliced, within


# --- normalising ---------------------------------------------------------------------------

def _truthy(text: Column) -> Column:
    """Truth of a JSON scalar kept as text: false, 0, empty and null are false."""
    number = text.try_cast("double")
    return F.coalesce(~(F.lower(text).isin("false", "", "null") | F.coalesce(number == 0, F.lit(False))), F.lit(False))


def normalize_detections(raw: DataFrame, text: str = "value") -> DataFrame:
    """JSON objects as text to clean detections; rows without a readable time are dropped.

    Keys are read through a map, so a key that is present with null differs from an absent
    one: ``person_found: null`` is false and does not fall through to ``person``.
    """
    m = F.col("_m")
    def get(key: str) -> Column:
        return F.try_element_at(m, F.lit(key))
    person = F.when(F.map_contains_key(m, "person_found"), _truthy(get("person_found"))).otherwise(_truthy(get("person")))
    stamp = F.coalesce(F.when(get("timestamp") != "", get("timestamp")), get("ts"))
    # a number is not a time text
    stamp = F.when(stamp.try_cast("double").isNull(), stamp)
    lat, lon = safe_double(get("latitude")), safe_double(get("longitude"))
    both = lat.isNotNull() & lon.isNotNull()
    confidence = clamp(F.coalesce(safe_double(get("confidence")), F.lit(0.0)), 0.0, 1.0)
    boxes = F.from_json(get("bbox"), "array<string>")
    box = F.transform(boxes, lambda x: x.try_cast("double"))
    whole = F.when(boxes.isNotNull() & ~F.exists(box, lambda x: x.isNull()), box)
    frame = get("frame")
    # parsed in a generator: filters on what follows are not pushed below it, where each
    # mention of the map would parse the text again
    parsed = raw.withColumn("_m", F.explode(F.filter(F.array(F.from_json(F.col(text), "map<string,string>")), lambda x: x.isNotNull())))
    return parsed.select(
        *[c for c in raw.columns if c != text],
        parse_iso(stamp).alias("ts"), F.when(both, lat).alias("lat"), F.when(both, lon).alias("lon"),
        safe_double(F.coalesce(get("altitude"), get("alt_m"))).alias("alt"), person.alias("person"),
        confidence.alias("confidence"),
        clamp(F.coalesce(safe_double(get("confidence_percent")), confidence * 100.0), 0.0, 100.0).alias("confidence_percent"),
        F.coalesce(frame.try_cast("int"), frame.try_cast("double").cast("int")).alias("frame"),
        whole.alias("bbox"),
    ).where("ts is not null")


def gps_track(log: DataFrame, zone: str = "+03:00", offset_sec: float = DEFAULTS.gps_clock_offset_sec) -> DataFrame:
    """Flight-log rows to clean, clock-shifted fixes; no-fix rows at (0, 0) are dropped."""
    ts = parse_flight_clock(F.col("`CUSTOM.date [local]`"), F.col("`CUSTOM.updateTime [local]`"), zone)
    shifted = F.timestamp_micros(F.unix_micros(ts) + F.lit(int(round(offset_sec * 1e6))))
    keys = [c for c in log.columns if "[" not in c and "." not in c]
    fixes = log.select(*keys, shifted.alias("ts"), safe_double(F.col("`OSD.latitude`")).alias("lat"),
                       safe_double(F.col("`OSD.longitude`")).alias("lon"))
    return drop_no_fix(fixes.where("ts is not null and lat is not null and lon is not null"))


def drop_no_fix(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.where(~((F.col(lat) == 0) & (F.col(lon) == 0)))


def attach_gps(detections: DataFrame, track: DataFrame, on: list[str], settings: Settings = DEFAULTS, slice_sec: float | None = None) -> DataFrame:
    """Position of the nearest fix within the tolerance, the later one on a tie."""
    joined = asof_nearest(detections, track.select(*on, "ts", "lat", "lon"), on, settings.gps_tolerance_sec, "later", slice_sec=slice_sec)
    return joined.drop("r_ts", "gap_sec").withColumnRenamed("r_lat", "latitude").withColumnRenamed("r_lon", "longitude")


# --- sessions ------------------------------------------------------------------------------

def sessionize(df: DataFrame, keys: list[str], gap_sec: float, ts: str = "ts", slice_sec: float = 86400.0,
               tie: tuple[str, ...] = (), rows: int = ROWS) -> DataFrame:
    """Number the sessions of each key from 1; a gap strictly above ``gap_sec`` starts one.

    Gaps inside a slice come from a lag there; the gap to the slice before and the count
    of earlier sessions are carried along the key's slices.
    """
    gap = int(round(gap_sec * 1e6))
    cut = sliced(df.withColumn("_t", F.unix_micros(F.col(ts))), keys, [F.col("_t"), *[F.col(c) for c in tie]], F.col("_t") / 1e6, slice_sec, rows)
    order = within(keys, "_t", *tie)
    local = cut.withColumn("_new", F.coalesce((F.col("_t") - F.lag("_t").over(order) > gap).cast("int"), F.lit(0)))
    local = local.withColumn("_k", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    bounds = local.groupBy(*keys, SLICE).agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"), F.sum("_new").alias("_n"))
    before = F.lag("_hi").over(chained(keys))
    bounds = bounds.withColumn("_opens", (before.isNull() | (F.col("_lo") - before > gap)).cast("int"))
    bounds = bounds.withColumn("_base", F.sum(F.col("_opens")).over(chained(keys)) + F.coalesce(
        F.sum("_n").over(chained(keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return join_back(local, bounds.select(*keys, SLICE, "_base"), keys).withColumn(
        "session", F.col("_base") + F.col("_k")).drop("_t", "_new", "_k", "_base", SLICE)


def session_bounds(sessions: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    return sessions.groupBy(*keys, "session").agg(
        F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count("*").alias("session_rows"))


def matching_session(sessions: DataFrame, flights: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the session whose length is nearest the flight's; the first one on a tie.

    ``flights`` has one row per key with ``flight_start`` and ``flight_end`` in file order.
    """
    def micros(name: str) -> Column:
        return F.unix_micros(F.col(name))
    bounds = session_bounds(sessions, keys).join(flights, keys)
    miss = F.abs((micros("session_end") - micros("session_start")) - (micros("flight_end") - micros("flight_start")))
    best = bounds.groupBy(*keys).agg(F.min_by(F.struct("session", "session_start", "session_end", "session_rows", "flight_start"),
                                              F.struct(miss, "session_start")).alias("_b"))
    return best.select(*keys, "_b.*").withColumn("offset_us", micros("session_start") - micros("flight_start"))


def flight_bounds(samples: DataFrame, keys: list[str], order: str = "source_index") -> DataFrame:
    """First and last sample time of each flight in file order."""
    return samples.groupBy(*keys).agg(F.min_by("ts", order).alias("flight_start"), F.max_by("ts", order).alias("flight_end"))


def merge_flights(samples: DataFrame, detections: DataFrame, keys: list[str], settings: Settings = DEFAULTS,
                  session_slice_sec: float = 86400.0, match_slice_sec: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Align every flight with its best detection session and match one to one.

    Returns the merged telemetry (one row per sample with its detection, if any) and the chosen
    session of each key.
    """
    sessions = sessionize(detections, keys, settings.session_gap_sec, slice_sec=session_slice_sec, tie=("source_index",))
    chosen = matching_session(sessions, flight_bounds(samples, keys), keys)
    picked = salted_join(sessions, chosen.select(*keys, "session"), [*keys, "session"]).drop("session")
    aligned = salted_join(samples, chosen.select(*keys, "offset_us"), keys).withColumn("source_ts", F.col("ts")).withColumn(
        "ts", F.timestamp_micros(F.unix_micros("ts") + F.col("offset_us"))).drop("offset_us")
    stamps = aligned.select(*keys, "ts", F.col("source_index").alias("sample"))
    claimed = asof_claim(picked, stamps, keys, settings.merge_tolerance_sec, "sample", ("ts", "source_index"), match_slice_sec)
    found = claimed.where("r_sample is not null").select(
        *keys, F.col("r_sample").alias("source_index"), F.struct(*[c for c in detections.columns if c not in keys]).alias("detection"))
    return aligned.join(found, [*keys, "source_index"], "left"), chosen


def output_records(merged: DataFrame, keys: list[str], raw: str | None = None) -> DataFrame:
    """Merged rows in the published shape; find details stay blank where nothing was found."""
    d = F.col("detection")
    person = F.coalesce(d["person"], F.lit(False))
    confidence = F.when(person, d["confidence"])
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    return merged.select(
        *keys, F.date_format("ts", iso).alias("timestamp"), F.date_format("source_ts", iso).alias("source_timestamp"),
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), feet_to_metres(F.col("altitude_ft")).alias("altitude"),
        *([F.col(raw).alias("csv_row")] if raw else []), person.alias("person_found"), confidence.alias("confidence"),
        F.coalesce(F.round(confidence * 100.0, 4), F.lit(0.0)).alias("confidence_percent"),
        F.when(person, d["bbox"]).alias("bbox"), d["frame"].alias("frame"))


def duplicate_count(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Rows beyond the first for each time, per key (two partial aggregates, no distinct set)."""
    per_time = df.groupBy(*keys, ts).agg(F.count("*").alias("_n"))
    return per_time.groupBy(*keys).agg(F.sum(F.col("_n") - 1).alias("duplicates"))


def merge_report(samples: DataFrame, detections: DataFrame, merged: DataFrame, chosen: DataFrame, keys: list[str],
                 not_found: DataFrame | None = None, malformed: dict[str, DataFrame] | None = None) -> DataFrame:
    """The merge counters, one row per key of ``chosen``.

    All rows to count are one tagged union that is aggregated twice, by time and by key. ``not_found`` holds the rows of the flights without
    finds; ``malformed`` the rows without a readable time of ``json``, ``csv`` and ``not_found_csv``.
    """
    bad = {f"bad_{kind}": rows for kind, rows in (malformed or {}).items()}
    parts = {"json": detections, "csv": samples, "match": merged.where("detection is not null"), **({"not_found": not_found} if not_found is not None else {}), **bad}
    timed = {"json", "csv"}
    rows = reduce(DataFrame.unionAll, [df.select(*keys, F.lit(kind).alias("_kind"), (F.unix_micros("ts") if kind in timed else F.lit(None).cast("bigint")).alias("_t"))
                                       for kind, df in parts.items()])
    counts = rows.groupBy(*keys, "_kind", "_t").agg(F.count("*").alias("_n"))
    number = lambda kind, less=0: F.coalesce(F.sum(F.when(F.col("_kind") == kind, F.col("_n") - less)), F.lit(0)).cast("bigint")
    totals = counts.groupBy(*keys).agg(
        number("json").alias("total_json_records"), number("csv").alias("total_csv_rows"), number("match").alias("matched_records"),
        number("json", 1).alias("duplicate_json_timestamps"), number("csv", 1).alias("duplicate_csv_timestamps"),
        number("not_found").alias("not_found_csv_rows"), number("bad_json").alias("malformed_json_timestamps"),
        number("bad_csv").alias("malformed_csv_timestamps"), number("bad_not_found_csv").alias("malformed_not_found_csv_timestamps"))
    picked = chosen.select(*keys, F.col("session_rows").alias("selected_json_records"),
                           F.date_format("session_start", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("selected_session_start"),
                           (F.col("offset_us") / 1e6).alias("clock_offset_seconds"))
    col = F.col
    return picked.join(totals, keys).withColumns({
        "unmatched_json_records": col("total_json_records") - col("matched_records"),
        "unmatched_selected_json_records": col("selected_json_records") - col("matched_records"),
        "unselected_json_records": col("total_json_records") - col("selected_json_records"),
        "unmatched_csv_rows": col("total_csv_rows") - col("matched_records")})


# --- flights and frames --------------------------------------------------------------------

def subsample(records: DataFrame, keys: list[str], max_points: int = DEFAULTS.sortie_max_points, slice_sec: float = 86400.0,
              tie: tuple[str, ...] = (), rows: int = ROWS) -> DataFrame:
    """Thin each key to ``max_points``: all finds stay, the rest is picked evenly.

    Whether the k-th other row is picked has a closed form: some i < keep has floor(i * step) = k.
    """
    if max_points <= 0:
        return records
    totals = records.groupBy(*keys).agg(F.count("*").alias("_all"), F.count_if("person").alias("_found"))
    sized = salted_join(records, totals, keys)
    keep, others = F.lit(max_points) - F.col("_found"), F.col("_all") - F.col("_found")
    whole = sized.where((F.col("_all") <= max_points) | F.col("person")).select(*records.columns)
    rest = sized.where((F.col("_all") > max_points) & ~F.col("person") & (keep > 0))
    cut = sliced(rest, keys, [F.unix_micros("ts"), *[F.col(c) for c in tie]], F.unix_micros("ts") / 1e6, slice_sec, rows)
    ranked = running_rank(cut, keys, ["ts", *tie], "_rank").withColumn("_k", F.col("_rank") - 1).withColumn("_s", others / keep)
    near = F.ceil(F.col("_k") / F.col("_s"))
    def picked(i: Column) -> Column:
        return (i >= 0) & (i < keep) & (F.least(others - 1, F.floor(i * F.col("_s"))) == F.col("_k"))
    return whole.unionByName(ranked.where(picked(near) | picked(near - 1) | picked(near + 1)).select(*records.columns))


def best_detection(boxes: DataFrame, frames: DataFrame, keys: list[str], min_confidence: float = 0.5, label: str = "person") -> DataFrame:
    """Best box of each frame, or a not-found row; ties go to the first box."""
    good = boxes.where((F.col("label") == label) & (F.col("confidence") >= min_confidence))
    best = good.groupBy(*keys, "frame").agg(F.max_by(F.struct("confidence", "bbox"), F.struct("confidence", (-F.col("box_no")).alias("n"))).alias("_b"))
    return frames.join(best, [*keys, "frame"], "left").withColumns({
        "person": F.col("_b").isNotNull(), "confidence": F.round(F.col("_b.confidence"), 3), "bbox": F.col("_b.bbox")}).drop("_b")


def clip_summary(frames: DataFrame, keys: list[str]) -> DataFrame:
    done = F.count("*")
    return frames.groupBy(*keys).agg(F.count_if("person").alias("found"), done.alias("processed"),
                                     (100.0 * F.count_if("person") / F.greatest(done, F.lit(1))).alias("percent"))


def carry_boxes(frames: DataFrame, inferred: DataFrame, keys: list[str], every_n: int) -> DataFrame:
    """Give each frame the result of the last inferred frame; a miss there clears the box.

    Every n-th frame is inferred, so the frame to look at is arithmetic and the rest an equi-join.
    """
    source = frames.withColumn("source_frame", (F.floor(F.col("frame") / every_n) * every_n).cast(frames.schema["frame"].dataType))
    results = inferred.select(*keys, F.col("frame").alias("source_frame"), "bbox", "confidence")
    return source.join(results, [*keys, "source_frame"], "left")


def recent_entries(log: DataFrame, keys: list[str], limit: int = DEFAULTS.log_backlog, ts: str = "ts", tie: tuple[str, ...] = ()) -> DataFrame:
    """Latest entries per source, for a reader that joins late (the limit is the feature)."""
    newest = [F.desc(ts), *[F.desc(c) for c in tie]]
    if not keys:
        return log.orderBy(*newest).limit(limit)
    return log.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*newest))).where(F.col("_r") <= limit).drop("_r")


def time_sorted(df: DataFrame, ts: str = "ts", *tie: str) -> DataFrame:
    return df.orderBy(ts, *tie)


def frame_times(frames: DataFrame, fps: Column) -> DataFrame:
    return frames.withColumn("video_ts", video_time(F.col("frame"), fps))
