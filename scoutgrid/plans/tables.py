"""Search inputs derived from the driver tables: missions, terrain, roads, detections, flights.

Every supplier is a mission and every event a drone fix or detection, so that the work grows
with the tables. The rules are integer arithmetic, which any SQL engine repeats exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.grid import make_cells, with_origin
from ..operators.raster import slope_aspect
from ..session import spread, use_utc
from ..settings import METRES_PER_DEGREE

SIZE, RES_M, STEP_SEC = 32, 50.0, 3600.0
START = "2024-01-01 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{folder}/{name}.parquet")


def missions(spark: SparkSession, folder: str) -> DataFrame:
    """One mission per supplier; every 11th has its pin on water."""
    s = table(spark, folder, "supplier")
    m, wet = F.col("s_suppkey"), F.col("s_suppkey") % 11 == 0
    return s.select(
        m.cast("bigint").alias("mission_id"), (32.7940 + 0.05 * (F.col("s_nationkey") % 5)).alias("lkp_lat"),
        (34.9896 + 0.002 * F.col("s_nationkey")).alias("lkp_lon"), F.lit(SIZE).alias("size"), F.lit(RES_M).alias("res_m"),
        F.lit(START).cast("timestamp").alias("lkp_ts"), F.lit(STEP_SEC).alias("step_sec"),
        F.when(wet, 44).otherwise(8).alias("shore"),
        (~wet).alias("topography"), (~wet & (m % 2 == 0)).alias("roads"), (~wet & (m % 3 == 0)).alias("personality"),
        (~wet & (m % 5 == 0)).alias("weather"), wet.alias("sea_drift"),
        (20 + m % 60).cast("int").alias("age"), (1 + m % 5).cast("int").alias("fitness"), (m % 7 == 0).alias("injured"))


def cells(spark: SparkSession, folder: str) -> DataFrame:
    return make_cells(missions(spark, folder))


def terrain_of(chosen: DataFrame) -> DataFrame:
    """Cells of some missions with relief, slope, land flag and the cross of roads."""
    return cross_proximity(slope_aspect(with_elevation(make_cells(chosen))).withColumn("is_land", F.col("elevation") > 1.0))


def with_elevation(grid: DataFrame) -> DataFrame:
    """Shore, gentle relief, a steep band from column 20 and a cliff at column 26."""
    r, c = F.col("row"), F.col("col")
    height = 20 + (r * 13 + c * 7 + F.col("mission_id") * 5) % 23 + F.when(c >= 20, 70).otherwise(0) + F.when(c >= 26, 120).otherwise(0)
    return grid.withColumn("elevation", F.when(r + c < F.col("shore"), 0).otherwise(height).cast("double"))


def terrain(spark: SparkSession, folder: str) -> DataFrame:
    """Cells with elevation, slope and land flag."""
    grid = with_elevation(cells(spark, folder))
    return slope_aspect(grid).withColumn("is_land", F.col("elevation") > 1.0)


def cross_proximity(grid: DataFrame) -> DataFrame:
    """Road proximity of a cross through the pin, in closed form."""
    half = SIZE // 2
    away = F.least(F.abs(F.col("row") - half), F.abs(F.col("col") - half)) * RES_M
    return grid.withColumn("road_proximity", F.exp(-away / 20.0)).withColumn("is_road", F.col("road_proximity") >= F.exp(F.lit(-4.0)))


def roads(spark: SparkSession, folder: str) -> DataFrame:
    """Two polylines through every pin: an east-west and a slanted one with a bend."""
    m = spread(missions(spark, folder))
    def at(dx: float, dy: float):
        return F.struct((F.col("lkp_lon") + dx).alias("lon"), (F.col("lkp_lat") + dy).alias("lat"))
    lines = F.array(F.array(at(-0.006, 0.0), at(0.006, 0.0)), F.array(at(-0.002, -0.005), at(0.0, 0.001), at(0.004, 0.005)))
    return m.select("mission_id", F.posexplode(lines).alias("way_id", "pts"))


def events(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "events")).withColumn("ts", F.col("ts").cast("timestamp"))


def detections(spark: SparkSession, folder: str) -> DataFrame:
    """One detection per event within about 800 m of its mission's pin."""
    e = events(spark, folder).withColumn("mission_id", F.floor(F.col("user_id") * 2 / 3).cast("bigint"))
    pins = missions(spark, folder).select("mission_id", "lkp_lat", "lkp_lon")
    east = (F.col("event_id") * 7919) % 1601 - 800
    north = (F.col("event_id") * 104729) % 1601 - 800
    from ..operators.joins import salted_join
    return salted_join(e, pins, ["mission_id"]).select(
        "mission_id", "event_id", "user_id", "ts", (F.col("lkp_lat") + north / METRES_PER_DEGREE).alias("lat"),
        (F.col("lkp_lon") + east / (METRES_PER_DEGREE * F.cos(F.radians("lkp_lat")))).alias("lon"),
        (F.col("event_type") == "purchase").alias("person"), F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"),
        (F.col("event_id") % 1000).cast("int").alias("frame"))


def placed_detections(spark: SparkSession, folder: str) -> DataFrame:
    """Detections with their mission's grid columns."""
    from ..operators.joins import salted_join
    m = with_origin(missions(spark, folder)).select("mission_id", "epsg", "origin_e", "origin_n", "size", "res_m", "lkp_ts", "step_sec")
    return salted_join(detections(spark, folder), m, ["mission_id"])


def raw_detections(spark: SparkSession, folder: str) -> DataFrame:
    """Detections as the JSON text a drone would write, with alias keys and some bad rows."""
    d = detections(spark, folder)
    e = F.col("event_id")
    stamp = F.when(e % 97 == 0, F.lit("not a time")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    person = F.col("person").cast("string")
    lat, lon, conf = F.format_string("%.6f", F.col("lat")), F.format_string("%.6f", F.col("lon")), F.format_string("%.6f", F.col("confidence") * 1.25)
    head = F.when(e % 3 == 0, F.format_string('{"ts":"%s","person":%s,"altitude":%d', stamp, person, e % 500)).when(
        e % 3 == 1, F.format_string('{"timestamp":"%s","person_found":%s,"alt_m":"%d"', stamp, person, e % 500)).otherwise(
        F.format_string('{"timestamp":"","ts":"%s","person_found":null,"person":true', stamp))
    spot = F.when(e % 5 == 0, F.format_string(',"latitude":%s', lat)).otherwise(F.format_string(',"latitude":%s,"longitude":"%s"', lat, lon))
    tail = F.when(e % 4 == 0, F.format_string(',"frame":%d,"bbox":[1,2,%d,4.5]}', e % 1000, e % 7)).when(
        e % 4 == 1, F.lit(',"frame":"x","bbox":[1,"bad",3,4],"confidence_percent":120}')).otherwise(F.lit(',"bbox":7}'))
    return d.select("event_id", F.concat(head, spot, F.when(e % 6 == 0, F.lit(',"confidence":null')).otherwise(F.format_string(',"confidence":%s', conf)), tail).alias("value"))


def flight_records(spark: SparkSession, folder: str) -> DataFrame:
    """Detections as flights: eight per mission at most, by user."""
    return placed_detections(spark, folder).withColumn("sortie", (F.col("user_id") % 8).cast("int")).withColumn("record_id", F.col("event_id"))


def flight_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Explicit starts for even flights of even missions only."""
    starts = F.when(F.col("mission_id") % 2 == 0, F.array(*[F.lit(600.0 * i if i % 2 == 0 else None).cast("double") for i in range(8)])).otherwise(
        F.array().cast("array<double>"))
    return missions(spark, folder).select("mission_id", starts.alias("delays"), F.lit(120.0).alias("first_delay"))


def telemetry(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the sampling kinds as flight telemetry of their user."""
    e = events(spark, folder).where(F.col("event_type").isin("view", "click"))
    return e.select("user_id", F.col("event_id").alias("source_index"), "ts", F.col("value").alias("lat"), (F.col("value") / 2).alias("lon"),
                    F.col("value").alias("altitude_ft"))


def merge_detections(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the other kinds as detections of their user."""
    e = events(spark, folder).where(F.col("event_type").isin("purchase", "signup"))
    return e.select("user_id", F.col("event_id").alias("source_index"), "ts", (F.col("event_type") == "purchase").alias("person"),
                    F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"), F.array(F.lit(1.0), F.col("value")).alias("bbox"),
                    (F.col("event_id") % 1000).cast("int").alias("frame"))
