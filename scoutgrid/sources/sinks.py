"""Writers and the push-message stream as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.grid import dense, few
from ..settings import LAYER_ORDER


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, written by all tasks."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def json_arrays(df: DataFrame, keys: list[str], order: list[str], buckets: Column | None = None) -> DataFrame:
    """Records gathered into JSON arrays, one per key and bucket, in order.

    An array document cannot be split, so give ``buckets`` (a time slice, say) that bounds it.
    """
    body = [c for c in df.columns if c not in keys]
    part = buckets if buckets is not None else F.lit(0)
    packed = F.array_sort(F.collect_list(F.struct(*order, F.struct(*body).alias("_rec"))))
    return df.withColumn("_bucket", part).groupBy(*keys, "_bucket").agg(packed.alias("_a")).select(
        *keys, F.col("_bucket").alias("bucket"), F.to_json(F.transform("_a", lambda s: s["_rec"]), {"ignoreNullFields": "false"}).alias("value"))


def write_json_arrays(df: DataFrame, path: str, keys: list[str], order: list[str], buckets: Column | None = None, mode: str = "overwrite") -> None:
    """One array document per key and bucket, in key folders when there are keys."""
    docs = json_arrays(df, keys, order, buckets)
    docs.select(*keys, "value").write.mode(mode).partitionBy(*keys).text(path) if keys else docs.select("value").write.mode(mode).text(path)


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Report rows as JSON objects."""
    report.write.mode(mode).option("ignoreNullFields", "false").json(path)


# --- messages ------------------------------------------------------------------------------

def _message(df: DataFrame, rank: int, kind: str, body: Column, tick: str = "tick") -> DataFrame:
    return df.select("mission_id", F.col(tick).cast("bigint").alias("tick"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                     F.to_json(body).alias("value"))


def full_messages(exports: DataFrame, timestamp: Column) -> DataFrame:
    body = F.struct(F.lit("heatmap_full").alias("type"), F.col("mission_id").cast("string").alias("mission_id"), timestamp.alias("timestamp"), "metadata", "probabilities")
    return _message(exports, 0, "heatmap_full", body)


def delta_messages(deltas: DataFrame, timestamp: Column) -> DataFrame:
    """Changed cells of one mission and tick in one message."""
    packed = deltas.groupBy("mission_id", "tick").agg(F.array_sort(F.collect_list(F.struct("row", "col", F.col("p").alias("probability")))).alias("cells"))
    body = F.struct(F.lit("heatmap_delta").alias("type"), F.col("mission_id").cast("string").alias("mission_id"), timestamp.alias("timestamp"), "cells")
    return _message(packed, 0, "heatmap_delta", body)


def engine_tick_messages(mpps: DataFrame, peaks: DataFrame, missions: DataFrame) -> DataFrame:
    """Tick state: pin, most probable position, layer switches, peaks in rank order."""
    matrix = peaks.groupBy("mission_id", "tick").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", F.array("lat", "lon", "p").alias("m")))), lambda s: s["m"]).alias("particle_matrix"))
    joined = mpps.join(few(missions.select("mission_id", "lkp_lat", "lkp_lon", *LAYER_ORDER)), "mission_id").join(dense(matrix), ["mission_id", "tick"], "left")
    body = F.struct(F.lit("engine_tick").alias("event"), F.col("tick").alias("tick_count"),
                    F.struct(F.col("lkp_lat").alias("lat"), F.col("lkp_lon").alias("lon")).alias("lkp_coords"), F.struct("lat", "lon").alias("mpp_coords"),
                    F.struct(*LAYER_ORDER).alias("layers"), F.coalesce("particle_matrix", F.array().cast("array<array<double>>")).alias("particle_matrix"))
    return _message(joined, 1, "engine_tick", body)


def detection_messages(events: DataFrame) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.struct(F.lit("detection_event").alias("type"), F.col("mission_id").cast("string").alias("mission_id"), F.coalesce("asset_id", F.lit("drone")).alias("asset_id"),
                    stamp.alias("timestamp"), F.lit(True).alias("person_found"), "confidence", "confidence_percent", "frame", "bbox", "position")
    return _message(events, 2, "detection_event", body)


def track_messages(heads: DataFrame, timestamp: Column) -> DataFrame:
    body = F.struct(F.lit("drone_track").alias("type"), F.col("mission_id").cast("string").alias("mission_id"), "asset_id", timestamp.alias("timestamp"),
                    "position", "path", "drones")
    return _message(heads, 3, "drone_track", body)


def tick_messages(ticks: DataFrame, full: DataFrame | None = None, deltas: DataFrame | None = None, engine: DataFrame | None = None,
                  detections: DataFrame | None = None, tracks: DataFrame | None = None) -> DataFrame:
    """All messages of each mission and tick in sending order (``rank``).

    ``ticks`` is (mission_id, tick, full_refresh). A tick with a full refresh sends the surface;
    else its deltas; else, when there is a tick state, the surface again.
    """
    parts = []
    keys = ["mission_id", "tick"]
    if full is not None:
        refresh = ticks.where("full_refresh").select(*keys)
        quiet = ticks.where("not full_refresh").select(*keys)
        if deltas is not None:
            quiet = quiet.join(deltas.select(*keys), keys, "left_anti")
        quiet = quiet.join(engine.select(*keys), keys, "left_semi") if engine is not None else quiet.limit(0)
        parts.append(full.join(refresh.unionByName(quiet), keys, "left_semi"))
    if deltas is not None:
        parts.append(deltas.join(ticks.where("not full_refresh").select(*keys), keys, "left_semi"))
    parts += [part for part in (engine, detections, tracks) if part is not None]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def latest_state(messages: DataFrame) -> DataFrame:
    """What a late subscriber gets: the newest surface, tick state and track of its mission."""
    wanted = messages.where(F.col("kind").isin("heatmap_full", "engine_tick", "drone_track"))
    return wanted.groupBy("mission_id", "kind").agg(F.max_by(F.struct("tick", "rank", "value"), "tick").alias("_m")).select("mission_id", "kind", "_m.*")


def mission_status(missions: DataFrame, ticks: DataFrame) -> DataFrame:
    """Published status row of each mission with its tick count."""
    done = ticks.groupBy("mission_id").agg(F.max("tick").alias("tick_count"))
    return missions.join(done, "mission_id", "left").withColumn("tick_count", F.coalesce("tick_count", F.lit(0).cast("bigint")))
