"""Merkle dataset manifest by nested-struct rollup.

Leaves are ranked within their source. A rank's lowest digits (base ``FAN``) become columns; grouping them away one after the
other nests the nodes of a level as structs in their parent, up to one row per block of ``FAN ** DIGITS`` leaves, however large
the source. Block tops are the leaves of a smaller manifest, made the same way until a tree is one block. A block's row then holds all
siblings of its leaves: a transform hands every leaf its path, an explode makes it a row; levels are never joined to each
other. Only the path above a block, one row per block, is joined to the block's row.
Texts are hashed where they are read and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scoutgrid.llm.ranks import ranked
from scoutgrid.session import cut_lineage

FAN, DIGITS = 3, 6


def record_digest(columns: list[Column]) -> Column:
    """SHA-256 of values as ``-`` (null) or byte count, colon and value, one after the other."""
    fields = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*fields), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path (``left`` and ``right`` siblings by level) lead to."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.array_join(F.concat(step["left"], F.array(digest), step["right"]), ""), 256))


def path_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda step: F.concat(step["left"], step["right"]))), ""), 256)


def _blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """(tree, size, block, digest, kids): one row per block of the nodes (tree, rank, size, digest, payload)."""
    width = FAN ** DIGITS
    digit = lambda d: F.pmod(F.floor(F.col("rank") / FAN ** d), F.lit(FAN)).cast("int")
    rows = nodes.select("tree", "size", F.floor(F.col("rank") / width).alias("block"), *[digit(d).alias(f"d{d}") for d in range(DIGITS)], "digest", *payload)
    rows = rows.repartition("tree", "block")  # every grouping below finds its rows in place
    inner = ["digest", *payload]
    for level in range(DIGITS):
        above = [f"d{d}" for d in range(level + 1, DIGITS)]
        rows = rows.groupBy("tree", "size", "block", *above).agg(F.array_sort(F.collect_list(F.struct(f"d{level}", *inner))).alias("kids"))
        joint = F.sha2(F.array_join(F.transform("kids", lambda k: k["digest"]), ""), 256)
        rows = rows.withColumn("digest", F.when(F.col("size") > FAN ** level, joint).otherwise(F.col("kids")[0]["digest"]))
        inner = ["digest", "kids"]
    return rows


def _leaves(kids: Column, level: int, path: Column, payload: list[str]) -> Column:
    """All leaves below ``kids`` as structs of rank offset, digest, payload and path, lowest level first."""
    digests = F.transform(kids, lambda k: k["digest"])

    def of(kid: Column, at: Column) -> Column:
        step = F.struct(F.slice(digests, F.lit(1), at).alias("left"), F.slice(digests, at + 2, F.lit(FAN)).alias("right"))
        here = F.concat(F.when(F.col("size") > FAN ** level, F.array(step)).otherwise(F.array().cast("array<struct<left:array<string>,right:array<string>>>")), path)
        if level == 0:
            return F.struct(kid["digest"].alias("digest"), *[kid[p].alias(p) for p in payload], here.alias("path"))
        return _leaves(kid["kids"], level - 1, here, payload)

    out = F.transform(kids, of)
    return out if level == 0 else F.flatten(out)


def _proved(nodes: DataFrame, payload: list[str], largest: int) -> DataFrame:
    """(tree, digest, payload, path, top) of every node: path to and digest of its tree's top."""
    blocks = _blocks(nodes, payload)
    if largest <= FAN ** DIGITS:
        blocks = blocks.withColumn("above", F.array().cast("array<struct<left:array<string>,right:array<string>>>")).withColumn("top", F.col("digest"))
    else:
        blocks = cut_lineage(blocks)
        tops = blocks.select("tree", F.col("block").alias("rank"), F.ceil(F.col("size") / FAN ** DIGITS).alias("size"), "digest",
                             F.col("block").alias("of_block"))
        above = _proved(tops, ["of_block"], -(-largest // FAN ** DIGITS)).select(
            F.col("tree").alias("of_tree"), "of_block", F.col("path").alias("above"), "top")
        blocks = blocks.join(above, (blocks["tree"] == above["of_tree"]) & (blocks["block"] == above["of_block"]))
    leaves = _leaves(F.col("kids"), DIGITS - 1, F.col("above"), payload)
    return blocks.select("tree", "top", F.inline(leaves))


def manifest(docs: DataFrame, key: str = "doc_id", source: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             claims: dict[str, Column] | None = None) -> DataFrame:
    """``key``, ``source``, leaf, claim, subroot, root and path (array of left and right siblings, leaf level first) of every row.

    A leaf is the digest of ``fields``; ``claim`` is the digest of the same row with the columns of ``claims`` in place of
    its own, for a later check (equal to leaf without any). Leaves of a source ascend by key, nulls first, rows with equal keys by
    leaf; equal rows are interchangeable, each with its own path. Sources ascend bytewise, null first, and are a source like any
    other. A source of one row has that leaf as subroot. Very long texts are digested where they are read. Null fields are ``-``.
    Columns other than ``fields`` are ignored, whatever their names; an empty table gives no rows.
    """
    own = {f: docs[f"`{f}`"] for f in fields}
    other = {**own, **(claims or {})}
    leaves = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{source}`"].cast("string").alias("source"), record_digest(list(own.values())).alias("digest"),
                         record_digest(list(other.values())).alias("claim"))
    leaves = cut_lineage(leaves).withColumn("row_at", F.monotonically_increasing_id())
    order = [F.col("key").asc_nulls_first(), F.col("digest"), F.col("row_at")]
    leaves = ranked(leaves, "source", order).drop("row_at")
    sources = leaves.groupBy("source").agg(F.first("size").alias("rows")).withColumn("all", F.lit(0))
    sources = cut_lineage(ranked(sources, "all", [F.col("source").asc_nulls_first()]).select(
        F.col("source").alias("name"), F.col("rank").alias("tree"), F.col("size").alias("sources"), "rows"))
    largest = sources.agg(F.coalesce(F.max("rows"), F.lit(0)), F.coalesce(F.max("sources"), F.lit(0))).first()
    nodes = leaves.join(sources, leaves["source"].eqNullSafe(sources["name"])).select("tree", "rank", "size", "digest", "key", "claim")
    inner = cut_lineage(_proved(nodes, ["key", "claim"], largest[0]))
    subroots = inner.groupBy("tree").agg(F.first("top").alias("digest")).join(sources, "tree").select(
        F.lit(0).alias("tree"), F.col("tree").alias("rank"), F.col("sources").alias("size"), "digest", "name", F.col("tree").alias("of_tree"))
    outer = _proved(subroots, ["name", "of_tree"], largest[1]).select("of_tree", "name", F.col("path").alias("rest"), F.col("top").alias("root"))
    both = inner.join(outer, inner["tree"] == outer["of_tree"])
    return both.select("key", F.col("name").alias("source"), F.col("digest").alias("leaf"), "claim", F.col("top").alias("subroot"), "root",
                       F.concat("path", "rest").alias("path"))
