"""Sequential rules (cool-down, smoothing) on keys of any size.

A cool-down reduces each slice of a key to a table from the first time it may keep to the last it then keeps; these
tables are composed in a tree, and each slice is finished with the time it starts from. The array steps are Pandas
functions over a column of slices, so many small slices share one Arrow batch. Smoothing is linear: blocks of equal row counts
are summed by windows, and a block needs what the few before it end with.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..settings import DEFAULTS
from .slices import ROWS, SLICE, previous, running_rank, scanned, sliced


def _jumps(t: np.ndarray, wait: int) -> list[np.ndarray]:
    """Place reached from every place after 1, 2, 4, ... waits; the end of a chain stays. The last array gives the ends."""
    n = len(t)
    ahead = np.searchsorted(t, t + wait)
    steps = [np.where(ahead < n, ahead, np.arange(n))]
    while n and (steps[-1][steps[-1]] != steps[-1]).any():
        steps.append(steps[-1][steps[-1]])
    return [*steps, steps[-1]]


_TABLE = "struct<lo:bigint,first:array<bigint>,end:array<bigint>>"


def _table(lo: int, first: np.ndarray, end: np.ndarray, wait: int) -> dict:
    """The table for rows from time ``lo`` on: kept rows before it leave nothing to look up beyond ``lo + wait`` but one entry."""
    count = min(len(first), int(np.searchsorted(first, lo + wait)) + 1)
    first, end = first[:count], end[:count]
    keep = np.append(end[1:] != end[:-1], True)[:count]  # of a run with one outcome the largest time is enough
    return {"lo": lo, "first": first[keep], "end": end[keep]}


def _looked_up(table, last: np.ndarray, wait: int) -> np.ndarray:
    """Last kept time after the table's rows for each last kept time before them."""
    first, end = np.asarray(table["first"], np.int64), np.asarray(table["end"], np.int64)
    at = np.searchsorted(first, last + wait)
    return np.where(at < len(first), end[np.minimum(at, len(first) - 1)], last)


def _composed(run, wait: int) -> dict:
    lo, first, end = run[0]["lo"], np.asarray(run[0]["first"], np.int64), np.asarray(run[0]["end"], np.int64)
    for table in run[1:]:
        joined = _table(lo, np.concatenate((first, table["first"])).astype(np.int64),
                        np.concatenate((_looked_up(table, end, wait), table["end"])).astype(np.int64), wait)
        first, end = joined["first"], joined["end"]
    return {"lo": lo, "first": first, "end": end}


def throttle(df: DataFrame, keys: list[str], cooldown_sec: float, ts: str = "ts", tie: tuple[str, ...] = (),
             slice_sec: float | None = None, rows: int = ROWS) -> DataFrame:
    """Keep a row only if it is at least ``cooldown_sec`` after the last row kept for its key.

    Of rows with one time the first by ``tie`` counts, the others are never kept.
    """
    wait = int(round(cooldown_sec * 1e6))
    # rows of one time: only the first can ever be kept
    firsts = df.withColumn("_t", F.unix_micros(F.col(ts))).groupBy(*keys, "_t").agg(
        F.min_by(F.struct(*df.columns), F.struct(*[F.col(c) for c in (tie or keys)])).alias("_row"))
    width = max(slice_sec or 3600.0, 2.0 * cooldown_sec)
    cut = sliced(firsts.select(*keys, "_t"), keys, [F.col("_t")], F.col("_t") / 1e6, width, rows)
    slices = cut.groupBy(*keys, SLICE).agg(F.sort_array(F.collect_list("_t")).alias("_times"))

    @F.pandas_udf(_TABLE)
    def exits(times: pd.Series) -> pd.DataFrame:
        """Last kept time of a slice for each time its first kept row can have."""
        return pd.DataFrame([_table(int(t[0]), t, t[_jumps(t, wait)[-1]], wait) for t in times], columns=["lo", "first", "end"])

    @F.pandas_udf(_TABLE)
    def compose(runs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_composed(run, wait) for run in runs], columns=["lo", "first", "end"])

    @F.pandas_udf("array<bigint>")
    def enter(runs: pd.Series, entries: pd.Series) -> pd.Series:
        """Last kept time before each slice of a run."""
        out = []
        for run, entry in zip(runs, entries):
            last, before = None if pd.isna(entry) else int(entry), []
            for table in run:
                before.append(last)
                last = int(table["end"][0]) if last is None else int(_looked_up(table, np.array([last]), wait)[0])
            out.append(before)
        return pd.Series(out)

    @F.pandas_udf("array<bigint>")
    def kept(times: pd.Series, starts: pd.Series) -> pd.Series:
        out = []
        for t, start in zip(times, starts):
            at = np.arange(len(t))[0 if pd.isna(start) else np.searchsorted(t, int(start) + wait):][:1]
            for jump in reversed(_jumps(t, wait)[:-1]):  # 1, 2, 4, ... kept rows on from those found so far
                further = jump[at]
                at = np.concatenate((at, further[further != at]))
            out.append(t[np.unique(at)])
        return pd.Series(out)

    steps = slices.select(*keys, SLICE, exits("_times").alias("_step"))
    started = scanned(steps, keys, compose, lambda run, entry: enter(run, entry.cast("bigint")))
    picked = slices.join(started, [*keys, SLICE]).select(*keys, F.explode(kept("_times", "_entry")).alias("_t"))
    return firsts.join(picked, [*keys, "_t"], "left_semi").select("_row.*")


def ewma(df: DataFrame, keys: list[str], value: str, alpha: float = 0.1, ts: str = "ts", tie: tuple[str, ...] = (),
         slice_sec: float = 86400.0, out: str = "smooth", rows: int = ROWS) -> DataFrame:
    """Exponential smoothing in time order; the first value of a key seeds it. Rows without a value are left out.

    Rows are numbered along their key and fall into blocks of equal counts, chosen so that a value fades to 1e-12 across one.
    A window sums each block; the state it starts from is what the four blocks before it ended with, faded (older ones would add
    less than 1e-48 of themselves). Only numbers are joined back, and no task sees more than a slice or a block.
    """
    keep = 1.0 - alpha
    df = df.where(F.col(value).isNotNull())
    if keep <= 0.0:
        return df.withColumn(out, F.col(value).cast("double"))
    block = max(1, int(12 * math.log(10) / -math.log(keep))) if keep < 1.0 else 1
    order = [F.unix_micros(ts), *[F.col(c) for c in tie]]
    ranked = running_rank(sliced(df, keys, order, F.unix_micros(ts) / 1e6, slice_sec, rows), keys, [F.col(ts), *tie], "_rank").drop(SLICE)
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1).withColumn("_block", F.floor(F.col("_rank") / block)).withColumn("_at", F.col("_rank") % block)
    faded = lambda n: F.pow(F.lit(keep), n)
    weight = F.when(F.col("_rank") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    upto = W.partitionBy(*keys, "_block").orderBy("_rank").rowsBetween(W.unboundedPreceding, 0)
    local = ranked.withColumn("_y", F.sum(weight * F.col(value).cast("double") / faded(F.col("_at"))).over(upto) * faded(F.col("_at")))
    ends = local.groupBy(*keys, "_block").agg(F.max_by("_y", "_rank").alias("_end"))
    ahead = ends.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("_far"), "_block", "_end").select(
        *keys, (F.col("_block") + 1 + F.col("_far")).alias("_block"), (F.col("_end") * faded(F.col("_far") * block)).alias("_part"))
    state = ahead.groupBy(*keys, "_block").agg(F.sum("_part").alias("_state"))
    done = local.join(state, [*keys, "_block"], "left")
    return done.select(*df.columns, (F.col("_y") + F.coalesce(F.col("_state") * faded(F.col("_at") + 1), F.lit(0.0))).alias(out))


def smoothed_rate(df: DataFrame, keys: list[str], ts: str = "ts", tie: tuple[str, ...] = (), alpha: float = 0.1,
                  slice_sec: float = 86400.0, rows: int = ROWS) -> DataFrame:
    """Frames per second between consecutive rows, smoothed; rows without a gap are skipped."""
    order = [F.unix_micros(ts), *[F.col(c) for c in tie]]
    cut = sliced(df, keys, order, F.unix_micros(ts) / 1e6, slice_sec, rows)
    stepped = previous(cut, keys, [ts, *tie], F.struct(F.unix_micros(ts).alias("t"))).drop(SLICE)
    gap = F.unix_micros(ts) - F.col("prev.t")
    return ewma(stepped.withColumn("rate", 1e6 / gap).where(gap > 0).drop("prev"), keys, "rate", alpha, ts, tie, slice_sec, "fps", rows)


def alerts(events: DataFrame, keys: list[str], cooldown_sec: float = DEFAULTS.alert_cooldown_sec, slice_sec: float | None = None,
           rows: int = ROWS) -> DataFrame:
    """First event per (mission, frame or time), then at most one per cool-down."""
    ident = F.concat_ws(":", F.col("mission_id").cast("string"), F.coalesce(F.col("frame").cast("string"), F.unix_micros("ts").cast("string")))
    seen = events.withColumn("event_key", ident)
    first = seen.groupBy(*keys, "event_key").agg(F.min_by(F.struct(*events.columns), F.struct("ts", "event_id")).alias("_r"))
    return throttle(first.select("_r.*"), keys, cooldown_sec, "ts", ("event_id",), slice_sec, rows)
