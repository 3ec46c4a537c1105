"""Ordered work on keys of any size: slices with a carried state.

A window over a whole key would put a hot key (a third of all rows, say) into one task.
Here each key is cut into slices along its order; windows run per (key, slice), one summary
row per slice is chained over the key, and what the chain yields is joined back. Slices have a
fixed width of time where that keeps every one of them below ``ROWS`` rows; a burst that does not
is met by slices of about equal row counts, cut by a sort of all rows (``sliced`` looks and decides). Summaries
that are too long for one value per key are folded in a tree (``scanned``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage, shuffle_partitions

SLICE = "_slice"
ROWS = 250_000
FAN = 16


def slice_of(order: Column, width: float) -> Column:
    """Slice number of a timestamp (width in seconds) or of a number."""
    return F.floor(order / width).cast("bigint")


def with_slice(df: DataFrame, seconds: Column, width: float) -> DataFrame:
    return df.withColumn(SLICE, slice_of(seconds, width))


def row_slices(df: DataFrame, keys: list[str], order: list, rows: int = ROWS) -> DataFrame:
    """Slices of about ``rows`` rows whatever the times: parts of one sort by key and order.

    Rows that tie in all of it are told apart by their place, so that a part can end among them. The sorted rows
    are kept: a lost executor does not cut them anew. A small key may share its part with others, a large
    key spans several.
    """
    kept = cut_lineage(df).withColumn("_place", F.monotonically_increasing_id())
    parts = max(shuffle_partitions(df.sparkSession), -(-kept.count() // rows))
    along = [*[F.col(k) for k in keys], *order, F.col("_place")]
    dealt = cut_lineage(kept.repartitionByRange(parts, *along).sortWithinPartitions(*along).drop("_place"))
    return dealt.withColumn(SLICE, F.shiftright(F.monotonically_increasing_id(), 33))


def sliced(df: DataFrame, keys: list[str], order: list, seconds: Column, width: float, rows: int = ROWS) -> DataFrame:
    """Add ``_slice``, never falling along ``order`` (which starts with the time ``seconds``) within a key.

    Time slices need no sort of the whole table; they serve as long as the fullest one has at most ``rows`` rows.
    """
    timed = with_slice(df, seconds, width)
    fullest = timed.groupBy(*keys, SLICE).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0]
    return timed if (fullest or 0) <= rows else row_slices(df, keys, order, rows)


def scanned(steps: DataFrame, keys: list[str], compose: Callable[[Column], Column], enter: Callable[[Column, Column], Column]) -> DataFrame:
    """(keys, ``_slice``, ``_entry``): the state that enters each slice, from one row (keys, ``_slice``, ``_step``) per slice.

    Runs of ``FAN`` steps are composed into one, these again, up to one step per key; going back down, every run hands its
    entry on through its steps. No value holds more than a run. ``compose`` turns an array of steps into a step,
    ``enter`` an array of steps and the first one's entry (null at the very start) into the entries of all.
    """
    place = F.row_number().over(chained(keys)) - 1
    level = cut_lineage(steps.select(*keys, SLICE, place.cast("long").alias("_pos"), "_step"))
    longest = level.agg(F.max("_pos")).first()[0]
    if longest is None:
        return level.select(*keys, SLICE, enter(F.array("_step"), F.lit(None))[0].alias("_entry"))
    marks = level.select(*keys, SLICE, "_pos")
    levels, left = [], longest + 1
    while True:
        runs = level.groupBy(*keys, F.floor(F.col("_pos") / FAN).alias("_pos")).agg(F.array_sort(F.collect_list(F.struct("_pos", "_step"))).alias("_run"))
        runs = cut_lineage(runs.select(*keys, "_pos", F.col("_run._step").alias("_run")))
        levels.append(runs)
        left = -(-left // FAN)
        if left <= 1:
            break
        level = runs.select(*keys, "_pos", compose(F.col("_run")).alias("_step"))
    entry = None
    for runs in reversed(levels):
        if entry is None:
            entered = runs.withColumn("_in", enter(F.col("_run"), F.lit(None)))
        else:
            entered = runs.join(entry, [*keys, "_pos"]).withColumn("_in", enter(F.col("_run"), F.col("_entry")))
        entry = entered.select(*keys, "_pos", F.posexplode("_in").alias("_i", "_entry")).select(
            *keys, (F.col("_pos") * FAN + F.col("_i")).alias("_pos"), "_entry")
    return marks.join(entry, [*keys, "_pos"]).select(*keys, SLICE, "_entry")


def within(keys: list[str], *order) -> W:
    return W.partitionBy(*keys, SLICE).orderBy(*order)


def chained(keys: list[str]) -> W:
    """Window over the slice summaries of a key."""
    return W.partitionBy(*keys).orderBy(SLICE)


def join_back(rows: DataFrame, summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Bring each slice's carried state to its rows."""
    return rows.join(summaries, [*keys, SLICE], "left")


def running_rank(df: DataFrame, keys: list[str], order: list, out: str = "rank") -> DataFrame:
    """1-based rank over the whole key (``_slice`` must be set and follow ``order``)."""
    local = df.withColumn("_local", F.row_number().over(within(keys, *order)))
    counts = df.groupBy(*keys, SLICE).agg(F.count("*").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(chained(keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return join_back(local, counts.drop("_n"), keys).withColumn(out, F.col("_before") + F.col("_local")).drop("_local", "_before")


def running_sum(df: DataFrame, keys: list[str], order: list, value: str, out: str) -> DataFrame:
    """Inclusive running sum over the whole key, in two levels."""
    local = df.withColumn("_local", F.sum(value).over(within(keys, *order).rowsBetween(W.unboundedPreceding, 0)))
    sums = df.groupBy(*keys, SLICE).agg(F.sum(value).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(chained(keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    return join_back(local, sums.drop("_n"), keys).withColumn(out, F.col("_before") + F.col("_local")).drop("_local", "_before")


def previous(df: DataFrame, keys: list[str], order: list[str], payload: Column, out: str = "prev") -> DataFrame:
    """Payload of the row before, over the whole key (``_slice`` must be set).

    The first row of a slice takes the last payload of the key's slice before.
    """
    held = df.withColumn("_p", payload)
    local = held.withColumn("_local", F.lag("_p").over(within(keys, *order))).withColumn(
        "_first", F.row_number().over(within(keys, *order)) == 1)
    ends = held.groupBy(*keys, SLICE).agg(F.max_by("_p", F.struct(*order)).alias("_end")).withColumn(
        "_end", F.lag("_end").over(chained(keys)))
    return join_back(local, ends, keys).withColumn(out, F.when(F.col("_first"), F.col("_end")).otherwise(F.col("_local"))).drop(
        "_p", "_local", "_first", "_end")
