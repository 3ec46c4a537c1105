"""Readers: detections, flight logs, road and marine payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.geo import current_east, current_north, heading_deg
from ..functions.scalars import parse_flight_clock, parse_iso
from ..operators.joins import salted_join
from ..operators.slices import SLICE, running_sum
from ..operators.telemetry import normalize_detections
from ..session import cut_lineage
from ..settings import DEFAULTS, HIGHWAY_CLASSES, Settings


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def json_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Files cut at every closing brace (which the pieces lack), by as many tasks as the files have splits."""
    return spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias(SLICE),
                                                     F.monotonically_increasing_id().alias("source_index"), "value")


def array_elements(pieces: DataFrame) -> DataFrame:
    """Pieces (source_path, _slice, source_index, value) of documents to the elements of their arrays: (source_path, source_index, value).

    ``source_index`` becomes the element's place in its array. Whether a piece starts inside a string follows from the quotes before it, and how
    deep its end lies from the brackets outside strings before it: running sums in two levels, within a split and over splits, so that no
    task needs a whole file. A brace that leads back to the array's own depth ends a chunk, which holds one object and what stands before it.
    A document that is no array is one element. A chunk that is no JSON is one null element; a quote that is never closed spoils
    what follows it in its file. Blank files and empty arrays have no elements.
    """
    keys, order = ["source_path"], ["source_index"]
    place = F.struct(SLICE, "source_index")

    def net(head: str) -> Column:
        plain = F.regexp_replace(F.concat(F.lit(head), F.col("_bare")), r'"[^"]*("|\z)', "")
        return F.length(F.translate(plain, "]", "")) - F.length(F.translate(plain, "{[", ""))

    bare = pieces.withColumn("_bare", F.regexp_replace("value", r"(?s)\\.", ""))
    kept = cut_lineage(bare.withColumns({"_quotes": F.length("_bare") - F.length(F.translate("_bare", '"', "")), "_out": net(""), "_in": net('"')}).drop("_bare"))
    files = kept.groupBy(*keys).agg(F.max(place).alias("_end"), F.min_by("value", place).alias("_head"))
    files = files.select(*keys, "_end", F.col("_head").rlike(r"^\uFEFF?\s*\[").alias("_array"))
    steps = salted_join(kept.drop("value"), files, keys).withColumn("_end", place == F.col("_end"))
    quoted = cut_lineage(running_sum(steps, keys, order, "_quotes", "_upto"))
    closes = (F.col("_upto") % 2 == 0) & ~F.col("_end")  # whether the last piece had a brace is not known
    start = F.when((F.col("_upto") - F.col("_quotes")) % 2 == 1, F.col("_in")).otherwise(F.col("_out"))
    level = running_sum(quoted.withColumn("_closes", closes).withColumn("_net", start - F.col("_closes").cast("int")).drop("_upto"), keys, order, "_net", "_depth")
    level = cut_lineage(level.withColumn("_cut", (F.col("_closes") & F.col("_array") & (F.col("_depth") == 1)).cast("int")))
    numbered = running_sum(level, keys, order, "_cut", "_upto").select(
        *keys, SLICE, *order, "_array", "_cut", (F.col("_upto") - F.col("_cut")).cast("bigint").alias("_chunk"), F.when(F.col("_end"), F.col("_depth")).alias("_left"))
    chunks = kept.select(*keys, SLICE, *order, "value").join(numbered, [*keys, SLICE, *order]).groupBy(*keys, "_chunk").agg(
        F.min(SLICE).alias(SLICE), F.first("_array").alias("_array"), F.max("_cut").alias("_cut"), F.max("_left").alias("_left"),
        F.array_sort(F.collect_list(F.struct(SLICE, "source_index", "value"))).alias("_pieces"))
    brace = (F.col("_cut") == 1) | F.coalesce(~F.col("_array") & (F.col("_left") == 1), F.lit(False))
    text = F.regexp_replace(F.concat(F.array_join("_pieces.value", "}"), F.when(brace, "}").otherwise("")), r"^\uFEFF", "")
    body = F.regexp_replace(F.col("_text"), F.when(F.col("_chunk") == 0, F.lit(r"^\s*\[")).otherwise(F.lit(r"^\s*,")), F.lit(""))
    body = F.when(F.col("_cut") == 1, body).otherwise(F.regexp_replace(body, r"\]\s*\z", ""))
    items = F.when(F.col("_array"), F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>")).otherwise(F.array("_text"))
    found = chunks.withColumn("_text", text).where(F.col("_array") | F.col("_text").rlike(r"\S")).select(
        *keys, SLICE, "_chunk", F.coalesce(items, F.array(F.lit(None).cast("string"))).alias("_items"))
    found = cut_lineage(found.withColumn("_n", F.size("_items")).withColumn("_size", F.col("_n")))
    before = running_sum(found.drop("_n"), keys, ["_chunk"], "_size", "_upto")
    return before.select(*keys, (F.col("_upto") - F.col("_size")).cast("bigint").alias("_first"), F.posexplode("_items").alias("_i", "value")).select(
        *keys, (F.col("_first") + F.col("_i")).alias("source_index"), "value")


def read_json_objects(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """JSON objects as text, one per row with its ``source_path``; a missing path is empty.

    ``lines`` is JSONL. ``array`` reads documents that are one array or one object. Both split: a large file is read by many tasks
    (``array_elements``). Text that is no object comes through as null, so that callers can count it.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], "source_index bigint, value string, source_path string")
    if layout == "array":
        text = array_elements(json_pieces(spark, path)).select("source_index", "value", "source_path")
    else:
        text = spark.read.text(path).withColumn("source_path", F.col("_metadata.file_path"))
        body = F.regexp_replace(F.trim("value"), "^\\uFEFF", "")
        text = text.select(F.monotonically_increasing_id().alias("source_index"), body.alias("value"), "source_path").where(
            "trim(value) <> ''")
    is_object = F.startswith(F.trim("value"), F.lit("{")) & F.from_json("value", "map<string,string>").isNotNull()
    return text.withColumn("value", F.when(is_object, F.col("value")))


def read_detections(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Clean detections; bad lines, non-objects and unreadable times are dropped."""
    return normalize_detections(read_json_objects(spark, path, layout).where("value is not null"))


def flag_malformed(raw: DataFrame) -> DataFrame:
    """JSON objects as text (null where the text was none) with ``malformed``: no readable time."""
    m = F.from_json("value", "map<string,string>")
    stamp = F.coalesce(F.when(F.try_element_at(m, F.lit("timestamp")) != "", F.try_element_at(m, F.lit("timestamp"))), F.try_element_at(m, F.lit("ts")))
    return raw.withColumn("ts", parse_iso(stamp)).withColumn("malformed", F.col("ts").isNull())


def read_merge_detections(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Detections for the merge with a ``malformed`` flag; bad rows are kept and counted."""
    return flag_malformed(read_json_objects(spark, path, layout))


LOG_COLUMNS = ("CUSTOM.date [local]", "CUSTOM.updateTime [local]", "OSD.latitude", "OSD.longitude", "OSD.altitude [ft]")


def _cells(line: Column) -> Column:
    """Values of a CSV record; one comma more makes every value end in one, so that an empty last value counts."""
    found = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(r'("(?:[^"]|"")*"|[^,]*),'), F.lit(1))
    quoted = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(found, lambda c: F.when(F.startswith(c, F.lit('"')) & F.endswith(c, F.lit('"')) & (F.length(c) >= 2), quoted(c)).otherwise(c))


def log_records(lines: DataFrame) -> DataFrame:
    """Lines (source_path, _slice, source_index, value) to records: a line break inside quotes does not end one.

    A line goes on with the record before it if the quotes of its file so far are odd in number. Running sums in two
    levels, within a block of a file and over its blocks, tell; no file has to be read by one task.
    """
    counted = lines.withColumn("_quotes", F.length("value") - F.length(F.replace("value", F.lit('"'))))
    upto = running_sum(counted, ["source_path"], ["source_index"], "_quotes", "_upto")
    first = ((F.col("_upto") - F.col("_quotes")) % 2 == 0).cast("int")
    numbered = running_sum(upto.withColumn("_first", first), ["source_path"], ["source_index"], "_first", "_record")
    joined = numbered.groupBy("source_path", "_record").agg(
        F.min("source_index").alias("source_index"), F.min(SLICE).alias(SLICE), F.array_sort(F.collect_list(F.struct(SLICE, "source_index", "value"))).alias("_lines"))
    return joined.select("source_path", SLICE, "source_index", F.array_join(F.col("_lines.value"), "\n").alias("value"))


def read_flight_log(spark: SparkSession, path: str, columns: list[str] | None = None, zone: str = DEFAULTS.flight_zone,
                    line_breaks: bool = False) -> DataFrame:
    """Flight-log CSV files, each with a header of its own, an optional ``sep=`` line before it and a BOM; all values stay text.

    ``columns`` are the ones wanted (``LOG_COLUMNS``), found by name in each file's header, wherever they stand there; one that a file lacks is
    null, and so is a value that a short record lacks. Headers are a table of one row per file, joined to its records. Each row carries its
    file, its place there, ``csv_row`` (the untouched record by column name), ``ts`` and ``malformed`` (no readable local time). With
    ``line_breaks`` quoted values may hold line breaks. A missing path is empty.
    """
    columns = list(columns or LOG_COLUMNS)
    if not _exists(spark, path):
        text = spark.createDataFrame([], f"source_path string, {SLICE} bigint, source_index bigint, value string")
    else:
        text = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias(SLICE),
                                            F.monotonically_increasing_id().alias("source_index"), F.regexp_replace("value", "^\\uFEFF|\r$", "").alias("value"))
    if line_breaks:
        text = log_records(text)
    body = text.where(~F.startswith(F.lower("value"), F.lit("sep=")) & (F.trim("value") != ""))
    place = F.struct(SLICE, "source_index")
    headers = body.groupBy("source_path").agg(F.min(F.struct(place.alias("at"), "value")).alias("_h")).select(
        "source_path", F.col("_h.at").alias("_at"), _cells(F.col("_h.value")).alias("_names"))
    rows = body.join(headers, "source_path").where(place != F.col("_at")).withColumn("_cells", _cells(F.col("value")))
    found = lambda c: F.get("_cells", F.array_position("_names", F.lit(c)).cast("int") - 1)  # noqa: E731 - place 0 is none
    known = F.array_distinct("_names")
    raw = F.map_from_arrays(known, F.transform(known, lambda n: F.get("_cells", F.array_position("_names", n).cast("int") - 1)))
    out = rows.select("source_path", F.col(SLICE).alias("source_block"), "source_index", *[found(c).alias(c) for c in columns], raw.alias("csv_row"))
    ts = parse_flight_clock(F.col("`CUSTOM.date [local]`"), F.col("`CUSTOM.updateTime [local]`"), zone)
    return out.withColumn("ts", ts).withColumn("malformed", ts.isNull())


def raw_row(df: DataFrame, columns: list[str]) -> DataFrame:
    """The untouched log row as a map column ``csv_row``."""
    pairs = [x for c in columns for x in (F.lit(c), F.col(f"`{c}`"))]
    return df.withColumn("csv_row", F.create_map(*pairs))


def roads_from_overpass(payloads: DataFrame, keys: list[str], text: str = "value") -> DataFrame:
    """Overpass JSON documents to polylines: ways with at least two points."""
    schema = "elements array<struct<type string, id bigint, geometry array<struct<lon double, lat double>>>>"
    ways = payloads.select(*keys, F.explode(F.from_json(text, schema)["elements"]).alias("e"))
    return ways.where((F.col("e.type") == "way") & (F.size("e.geometry") >= 2)).select(
        *keys, F.col("e.id").alias("way_id"), F.transform("e.geometry", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("pts"))


def assemble_roads(nodes: DataFrame, ways: DataFrame, keys: list[str]) -> DataFrame:
    """Resolve node references in order, drop missing ones, keep ways with two points or more.

    ``nodes`` is (id, lat, lon), ``ways`` is (way_id, highway, refs array).
    """
    kept = ways.where(F.col("highway").isin(*HIGHWAY_CLASSES)).select(*keys, "way_id", F.posexplode("refs").alias("pos", "id"))
    placed = kept.join(nodes.where("lat is not null and lon is not null").select(*keys, "id", "lat", "lon"), [*keys, "id"])
    lines = placed.groupBy(*keys, "way_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("_p"))
    return lines.where(F.size("_p") >= 2).select(*keys, "way_id", F.transform("_p", lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("pts"))


def roads_from_osm_xml(spark: SparkSession, path: str) -> DataFrame:
    """OSM map XML to polylines of the walkable highway classes."""
    nodes = spark.read.format("xml").option("rowTag", "node").schema("_id string, _lat double, _lon double").load(path).select(
        F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))
    ways = spark.read.format("xml").option("rowTag", "way").schema(
        "_id string, nd array<struct<_ref: string>>, tag array<struct<_k: string, _v: string>>").load(path)
    tags = F.filter("tag", lambda t: t["_k"] == "highway")
    ways = ways.select(F.col("_id").alias("way_id"), F.try_element_at(tags, F.lit(-1))["_v"].alias("highway"), F.transform("nd", lambda n: n["_ref"]).alias("refs"))
    return assemble_roads(nodes, ways, [])


def parse_marine(payloads: DataFrame, text: str = "value", settings: Settings = DEFAULTS) -> DataFrame:
    """Marine payloads to the surface current; errors and gaps take the configured fallback.

    Adds ``u``, ``v``, ``speed``, ``direction`` and ``source``.
    """
    doc = F.from_json(text, "error boolean, current struct<ocean_current_velocity: double, ocean_current_direction: double>")
    out = payloads.withColumn("_d", doc).withColumn("_s", F.col("_d.current.ocean_current_velocity")).withColumn("_a", F.col("_d.current.ocean_current_direction"))
    good = ~F.coalesce(F.col("_d.error"), F.lit(False)) & F.col("_s").isNotNull() & F.col("_a").isNotNull()
    fu, fv = F.lit(settings.current_fallback_u), F.lit(settings.current_fallback_v)
    out = out.withColumn("_ok", F.coalesce(good, F.lit(False)))
    out = out.withColumn("u", F.when(F.col("_ok"), current_east(F.col("_s"), F.col("_a"))).otherwise(fu)).withColumn(
        "v", F.when(F.col("_ok"), current_north(F.col("_s"), F.col("_a"))).otherwise(fv))
    still = F.when(F.hypot(fu, fv) > 1e-9, heading_deg(fu, fv)).otherwise(0.0)
    return out.withColumn("speed", F.hypot("u", "v")).withColumn("direction", F.when(F.col("_ok"), F.col("_a")).otherwise(still)).withColumn(
        "source", F.when(F.col("_ok"), "open_meteo").otherwise("fallback")).drop("_d", "_s", "_a", "_ok")
