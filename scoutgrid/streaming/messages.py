"""Message parsing and routing for the push stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..settings import LAYER_ORDER

# The published message shapes.
POINT = "struct<lat: double, lon: double>"
CORNERS = f"struct<nw: {POINT}, ne: {POINT}, se: {POINT}, sw: {POINT}>"
METADATA = (f"struct<origin: {POINT}, resolution_m: double, rows: int, cols: int, crs_epsg: int, "
            f"bounds: struct<north: double, south: double, east: double, west: double>, corners: {CORNERS}>")
ENVELOPE = (
    f"type string, event string, mission_id string, timestamp string, metadata {METADATA}, probabilities array<double>, "
    "cells array<struct<row: int, col: int, probability: double>>, asset_id string, person_found boolean, confidence double, "
    f"confidence_percent double, frame int, bbox array<double>, position {POINT}, path array<array<double>>, "
    f"drones array<struct<asset_id: string, found: boolean, active: boolean, position: {POINT}, path: array<array<double>>>>, "
    f"tick_count bigint, lkp_coords {POINT}, mpp_coords {POINT}, layers map<string, boolean>, particle_matrix array<array<double>>")

REQUIRED = {
    "heatmap_full": ("mission_id", "timestamp", "metadata", "probabilities"),
    "heatmap_delta": ("mission_id", "timestamp", "cells"),
    "detection_event": ("mission_id", "asset_id", "timestamp", "person_found", "confidence", "confidence_percent"),
    "drone_track": ("mission_id", "timestamp", "path"),
    "engine_tick": ("tick_count", "lkp_coords", "mpp_coords"),
    "update_layers": ("layers",),
}


def _complete(msg: Column, names: tuple[str, ...]) -> Column:
    ok = F.lit(True)
    for name in names:
        ok = ok & msg[name].isNotNull()
    return ok


def parse_messages(raw: DataFrame, text: str = "value") -> DataFrame:
    """Message text to (kind, msg, ok): the discriminator routes, required fields validate.

    Works on a stream as on a table. ``ok`` is false for text that is no object, unknown kinds
    and messages with missing fields; ``quarantine`` keeps those.
    """
    msg = F.col("msg")
    # one parse per text: see normalize_detections
    parsed = raw.withColumn("msg", F.explode(F.array(F.from_json(text, ENVELOPE))))
    kind = F.when(msg["event"].isin("engine_tick", "update_layers"), msg["event"]).otherwise(msg["type"])
    parsed = parsed.withColumn("kind", kind)
    ok = F.lit(False)
    for name, fields in REQUIRED.items():
        ok = F.when(F.col("kind") == name, _complete(msg, fields)).otherwise(ok)
    ok = ok & F.when(F.col("kind") == "detection_event", F.coalesce(msg["person_found"], F.lit(False))).otherwise(F.lit(True))
    return parsed.withColumn("ok", F.coalesce(ok, F.lit(False)))


def route(parsed: DataFrame, kind: str) -> DataFrame:
    """Valid messages of one kind, unpacked."""
    return parsed.where(F.col("ok") & (F.col("kind") == kind)).select(*[c for c in parsed.columns if c not in ("msg", "kind", "ok")], "msg.*")


def quarantine(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.col("ok"))


def delta_rows(deltas: DataFrame, sequence: str) -> DataFrame:
    """Cells of routed delta messages as rows for ``merge_deltas``."""
    return deltas.select(F.col("mission_id").cast("bigint").alias("mission_id"), F.col(sequence).alias("seq"), F.explode("cells").alias("c")).select(
        "mission_id", "seq", F.col("c.row").alias("row"), F.col("c.col").alias("col"), F.col("c.probability").alias("p"))


def layer_switches(controls: DataFrame, missions: DataFrame, sequence: str) -> DataFrame:
    """Missions with the latest layer control message applied; unknown keys are ignored, all off means topography."""
    latest = controls.groupBy("mission_id").agg(F.max_by("layers", sequence).alias("_l"))
    latest = latest.select(F.col("mission_id").cast("bigint").alias("mission_id"), "_l")
    known = F.map_filter("_l", lambda k, v: k.isin(*LAYER_ORDER))
    out = missions.join(latest, "mission_id").withColumn("_k", known)
    asked = F.coalesce(F.exists(F.map_values("_k"), lambda v: v), F.lit(False))
    new = {n: F.coalesce(F.try_element_at("_k", F.lit(n)), F.col(n)) for n in LAYER_ORDER}
    new["topography"] = F.when(asked, new["topography"]).otherwise(F.lit(True))
    return out.withColumns(new).drop("_l", "_k")
