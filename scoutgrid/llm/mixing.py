"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks per source and shard, then seeded block selection.

Only sizes travel: texts are counted where they are read. A source is cut into shards of bounded size, so that the largest
source is as many tasks' work as it has shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scoutgrid.llm.text import packed, words
from scoutgrid.session import cut_lineage

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 32
SHARD_WORDS = 2_000_000
MAX_REPEATS = 3
SEED = 42


def targets(sources: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, place, target) from (source, source_size).

    Sources in code point order, null last, take ``weights`` in turn. All targets together are all sizes; a
    target stops at ``max_repeats`` times its source's size and the excess goes to the others by weight. The level where
    this settles is found in one pass: by growing size per weight, a source is full if the level of the sources
    from it on would lift it above its limit. The table has a row per source, whatever the number of documents.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights))
    rows = sources.select("source", "source_size", place.alias("place")).withColumn("weight", weight)
    limit = max_repeats * F.col("source_size")
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "*", F.sum("source_size").over(everything).alias("all_size"),
        F.coalesce(F.sum(limit).over(before), F.lit(0)).alias("full_size"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open_weight"))
    level = (F.col("all_size") - F.col("full_size")) / F.col("open_weight")
    rows = rows.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= limit)
    settled = F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("settled", settled).select(
        "source", "source_size", "weight", "place",
        F.least(limit.cast("double"), F.coalesce(F.col("settled") * F.col("weight"), limit.cast("double"))).alias("target"))


def apportioned(parties: DataFrame, votes: str, seats: str, by: list[str], tie: list[str]) -> DataFrame:
    """Add ``quota``: Sainte-Lague shares of ``seats`` (equal within ``by``) in proportion to ``votes``.

    Seats go to the highest quotients votes / (2 a + 1). All but a few are settled by dividing by a divisor that is
    surely too large; those between it and one surely too small (at most twice the number of parties) compete
    by quotient, ties by ``tie``. Parties without votes get none.
    """
    group = Window.partitionBy(*by)
    n = F.sum((F.col(votes) > 0).cast("long")).over(group)
    total = F.sum(votes).over(group)
    share = lambda s: F.when(F.col(votes) > 0, F.greatest(F.lit(0), F.floor(
        F.col(votes) * s / total + 0.5))).otherwise(F.lit(0)).cast("long")
    bounds = parties.withColumn("low", share(F.col(seats) - n / 2.0 - 1)).withColumn("high", share(F.col(seats) + n / 2.0 + 1))
    bounds = bounds.withColumn("open", F.col(seats) - F.sum("low").over(group))
    bids = bounds.where("high > low").select(*by, *[c for c in tie if c not in by], votes, "open",
                                             F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("seat"))
    order = Window.partitionBy(*by).orderBy(F.desc(F.col(votes) / (2 * F.col("seat") + 1)), *tie)
    names = list(dict.fromkeys([*by, *tie]))
    won = bids.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= F.col("open")).groupBy(*names).agg(
        F.count("*").alias("won"))
    won = won.select(*[F.col(c).alias(f"_{c}") for c in names], "won")
    same = [bounds[c].eqNullSafe(won[f"_{c}"]) for c in names]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return bounds.join(won, on, "left").select(*[bounds[c] for c in parties.columns], (
        F.col("low") + F.coalesce("won", F.lit(0))).alias("quota"))


def _body(docs: DataFrame, text: str) -> Column:
    return F.coalesce(docs[f"`{text}`"].cast("string"), F.lit(""))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, max_repeats: int = MAX_REPEATS,
          block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """Words to take of every document: ``key``, body_hash, size, source_size, target, taken.

    Each source's target becomes whole blocks of
    ``block_words`` by Sainte-Lague, and these are shared out likewise among its shards (source_size / ``shard_words``, rounded up;
    a document belongs to one by a hash). A shard lays its documents on a line in seeded order and takes the whole line as
    often as its quota covers it, then the first blocks of the line; a block may begin or end inside a document. No document
    is taken more than ``max_repeats`` times. The same rows give the same result on any cluster; rows equal in key and text are interchangeable.
    Null and blank texts have size 0 and lie on no line; rows equal in source, key and text are one stretch of a line, however many. Null sources form
    a source of their own; texts are counted where they are read, very long ones too. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    body = _body(docs, text)
    sizes = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{source}`"].cast("string").alias("source"),
                        F.size(words(body)).cast("long").alias("size"), F.xxhash64(body).alias("body_hash"))
    sizes = cut_lineage(sizes.groupBy("key", "source", "size", "body_hash").agg(F.count("*").alias("copies")).withColumn(
        "place_hash", F.xxhash64(F.lit(seed), "key", "body_hash")))
    per_source = cut_lineage(targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, max_repeats)
                             .withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("int")))
    blocks = F.round(F.sum("source_size").over(Window.partitionBy()) / block_words).cast("long")
    seats = apportioned(per_source.withColumn("all", F.lit(1)).withColumn("blocks", blocks), "target", "blocks", ["all"], ["place"])
    seats = seats.select("source", "source_size", "target", "shards", F.col("quota").alias("source_quota"))
    rows = sizes.join(seats, sizes["source"].eqNullSafe(seats["source"])).select(
        "key", sizes["source"], "size", "copies", "source_size", "target", "source_quota", "place_hash", "body_hash",
        F.pmod("place_hash", F.col("shards").cast("long")).alias("shard"))
    blank = rows.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    rows = rows.where("size > 0")
    length = F.col("size") * F.col("copies")
    shard = rows.groupBy("source", "shard").agg(F.sum(length).alias("shard_size"), F.first("source_quota").alias("source_quota"))
    quotas = apportioned(shard, "shard_size", "source_quota", ["source"], ["shard"]).select(
        F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", "quota")
    rows = rows.join(quotas, rows["source"].eqNullSafe(quotas["_source"]) & (rows["shard"] == quotas["_shard"])).drop("_source", "_shard")
    line = Window.partitionBy("source", "shard").orderBy("place_hash", "body_hash", "key")
    end = F.sum(length).over(line.rowsBetween(Window.unboundedPreceding, 0))
    words_due = F.least(F.col("quota") * block_words, max_repeats * F.col("shard_size"))
    rows = rows.withColumn("begin", end - length).withColumn("due", words_due).withColumn("rounds", F.floor(F.col("due") / F.col("shard_size")))
    each = rows.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    left = F.col("due") - F.col("rounds") * F.col("shard_size") - F.col("begin") - F.col("nth") * F.col("size")
    each = each.withColumn("taken", F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left)))
    out = ["key", "body_hash", "size", "source_size", "target", "taken"]
    return each.select(*out).unionAll(blank.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).select(*out))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents of the mix with their own columns, size, source_size, target and taken; those of which no word is taken go.

    The words to take come back to the texts by key and text hash, rows equal in both one by one: texts are shuffled once.
    An own column with the name of an added one gives way to it.
    """
    added = ["size", "source_size", "target", "taken"]
    nth = lambda order: F.row_number().over(Window.partitionBy("key", "body_hash").orderBy(order))
    due = mixed(docs, key, text, **options).where("taken > 0").withColumn("nth", nth(F.desc("taken")))
    rows = packed(docs, key=docs[f"`{key}`"], body_hash=F.xxhash64(_body(docs, text))).withColumn("nth", nth(F.col("body_hash")))
    due = due.select(F.col("key").alias("due_key"), F.col("body_hash").alias("due_hash"), F.col("nth").alias("due_nth"), *added)
    both = rows.join(due, rows["key"].eqNullSafe(due["due_key"]) & (rows["body_hash"] == due["due_hash"]) & (rows["nth"] == due["due_nth"]))
    return both.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in added], *added)
