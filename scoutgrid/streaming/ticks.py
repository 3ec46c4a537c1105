"""Structured Streaming forms of the tick, alert and session operators."""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import tick_of
from ..operators import evidence as ev
from ..operators.grid import CELL_KEYS
from ..session import cut_lineage, shuffle_partitions
from ..plans.heatmap import raw_surfaces
from ..settings import DEFAULTS, Settings
from .messages import delta_rows, layer_switches, parse_messages, route


def stream_ticks(records: DataFrame, missions: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Detections with the tick of their mission's own clock; late ones fall behind the watermark.

    Ticks are anchored per mission, so the window is arithmetic on the mission's columns rather
    than ``window``. The missions are a static side.
    """
    clock = missions.select("mission_id", "lkp_ts", "step_sec")
    joined = records.withWatermark("ts", delay).join(clock, "mission_id")
    return joined.withColumn("tick", tick_of(F.col("ts"), F.col("lkp_ts"), F.col("step_sec"))).where("tick >= 1")


def tick_counts(ticked: DataFrame, width: str = "1 hour") -> DataFrame:
    """Finds and sweeps per mission and tick, emitted once the watermark closes the slice."""
    return ticked.groupBy("mission_id", "tick", F.window("ts", width).alias("w")).agg(
        F.count_if("person").alias("finds"), F.count_if(~F.col("person")).alias("sweeps"))


def stream_reveals(reveals: DataFrame, step_sec: Column) -> DataFrame:
    """Live sweep: revealed records with their tick, ready for ``swept_cells`` and ``person_events``."""
    return reveals.withColumn("tick", (F.floor(F.col("reveal_sec") / step_sec) + 1).cast("bigint"))


def first_events(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First event per mission and frame (or time) within the watermark."""
    key = F.concat_ws(":", F.col("mission_id").cast("string"), F.coalesce(F.col("frame").cast("string"), F.unix_micros("ts").cast("string")))
    return events.withColumn("event_key", key).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_key"])


def kept_by_cooldown(times: np.ndarray, wait: int, last: int | None) -> np.ndarray:
    """Places in sorted ``times`` that are kept, each at least ``wait`` after the one kept before (``last`` at the start): a search per kept place."""
    at = 0 if last is None else int(np.searchsorted(times, last + wait))
    kept = []
    while at < len(times):
        kept.append(at)
        at = int(np.searchsorted(times, times[at] + wait))
    return np.array(kept, np.int64)


class _Cooldown(StatefulProcessor):
    """State of a key: the time last emitted."""

    def __init__(self, wait: int, ts: str, tie: list[str], columns: list[str]):
        self.wait, self.ts, self.tie, self.columns = wait, ts, tie, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values([self.ts, *self.tie], kind="stable", ignore_index=True)
        times = batch[self.ts].astype("datetime64[us]").astype("int64").to_numpy()
        last = self.last.get()[0] if self.last.exists() else None
        kept = kept_by_cooldown(times, self.wait, last)
        if len(kept):
            last = int(times[kept[-1]])
        if last is not None:
            self.last.update((last,))
        yield batch.iloc[kept][self.columns]

    def close(self) -> None:
        pass


def stream_throttle(events: DataFrame, keys: list[str], cooldown_sec: float, delay: str = "10 minutes", ts: str = "ts", tie: tuple[str, ...] = ()) -> DataFrame:
    """At most one event per cool-down after the last one emitted, in event time, with all its columns.

    State is the last emitted time of the key. A micro-batch of a key is put in time order (then by ``tie``), so
    its size (set by the source's rate limit) bounds the group. Events behind the last emitted time plus the cool-down are dropped, late ones as well.
    """
    wait = int(round(cooldown_sec * 1e6))
    return events.withWatermark(ts, delay).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Cooldown(wait, ts, list(tie), events.columns), outputStructType=events.schema, outputMode="append", timeMode="None")


class _CleanScores(StatefulProcessor):
    """State of a mission: of each cell its last reported sweep and those of ticks to come, and a timer at the end of the next tick to report."""

    def __init__(self, decay: float, least: float):
        self.decay, self.least = decay, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sweeps = handle.getMapState("sweeps", "row int, col int", "ticks array<bigint>")
        self.clock = handle.getValueState("clock", "start bigint, step bigint, next bigint")

    def _wake(self, start: int, step: int, tick: int) -> None:
        self.clock.update((start, step, tick))
        self.handle.registerTimer(start + tick * step)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        for (row, col), ticks in batch.groupby(["row", "col"])["tick"].unique().items():
            cell = (int(row), int(col))
            known = self.sweeps.getValue(cell)[0] if self.sweeps.containsKey(cell) else []
            self.sweeps.updateValue(cell, (sorted({*map(int, known), *map(int, ticks)}),))
        if not self.clock.exists():
            start, step = int(batch["start_ms"].iloc[0]), int(batch["step_ms"].iloc[0])
            self._wake(start, step, int(batch["tick"].min()))
        yield pd.DataFrame({"mission_id": [], "tick": [], "row": [], "col": [], "clean": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, step, tick = self.clock.get()
        cells = {(int(cell[0]), int(cell[1])): [int(t) for t in value[0]] for cell, value in self.sweeps.iterator()}
        before, out = dict(cells), []
        while cells and start + tick * step <= timerValues.getCurrentWatermarkInMs():
            for cell, ticks in list(cells.items()):
                past = [t for t in ticks if t <= tick]
                score = self.decay ** (tick - past[-1]) if past else 0.0
                if score >= self.least:
                    out.append((key[0], tick, *cell, score))
                    past = past[-1:]
                else:
                    past = []
                cells[cell] = past + [t for t in ticks if t > tick]
                if not cells[cell]:
                    del cells[cell]
            tick += 1
        for cell, ticks in before.items():
            if cell not in cells:
                self.sweeps.removeKey(cell)
            elif cells[cell] != ticks:
                self.sweeps.updateValue(cell, (cells[cell],))
        if cells:
            self._wake(start, step, tick)
        else:
            self.clock.clear()
        yield pd.DataFrame(out, columns=["mission_id", "tick", "row", "col", "clean"])

    def close(self) -> None:
        pass


def stream_clean_scores(swept: DataFrame, missions: DataFrame, settings: Settings = DEFAULTS, delay: str = "10 minutes", least: float = 1e-3) -> DataFrame:
    """(mission_id, tick, row, col, clean) at the end of every tick, from swept cells (mission_id, row, col, tick, ts), without a surface in the state.

    A tick is reported once the watermark passes its end, whether the mission sent anything or not: an idle mission decays by its timer.
    Cells below ``least`` are forgotten; a mission without cells is until it sends again.
    """
    ms = lambda c: F.floor(c / 1000).cast("bigint")
    clock = missions.select("mission_id", ms(F.unix_micros("lkp_ts")).alias("start_ms"), (F.col("step_sec") * 1000).cast("bigint").alias("step_ms"))
    timed = swept.select("mission_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("tick").cast("bigint").alias("tick"), "ts")
    timed = timed.withWatermark("ts", delay).join(clock, "mission_id")
    return timed.groupBy("mission_id").transformWithStateInPandas(
        statefulProcessor=_CleanScores(settings.clean_decay, least), outputStructType="mission_id bigint, tick bigint, row int, col int, clean double",
        outputMode="append", timeMode="EventTime")


def stream_live_sweep(records: DataFrame, launches: DataFrame, step_sec: float, delay: str = "1 hour", within: str = "1 day") -> DataFrame:
    """Flight records joined to the launch plan of their flight as both arrive: all record columns, reveal_sec, tick and north_m.

    ``records`` are (mission_id, sortie, ts, ...), ``launches`` (mission_id, sortie, base_ts, start_sec, north_m): a launch says when a flight
    started and how its clock begins. A record meets its launch if it was taken at most ``within`` after the launch's first record;
    watermarks on both sides bound how long either waits. Records without a launch are dropped when the watermark passes them.
    """
    left = records.withWatermark("ts", delay).alias("r")
    right = launches.select(F.col("mission_id").alias("_mission"), F.col("sortie").alias("_sortie"), "base_ts", "start_sec", "north_m").withWatermark("base_ts", delay).alias("l")
    met = left.join(right, (F.col("mission_id") == F.col("_mission")) & (F.col("sortie") == F.col("_sortie")) & (F.col("ts") >= F.col("base_ts"))
                    & (F.col("ts") <= F.col("base_ts") + F.expr(f"INTERVAL {within}")))
    reveal = F.col("start_sec") + (F.unix_micros("ts") - F.unix_micros("base_ts")) / 1e6
    return stream_reveals(met.withColumn("reveal_sec", reveal).drop("_mission", "_sortie", "base_ts", "start_sec"), F.lit(step_sec))


def stream_sessions(events: DataFrame, keys: list[str], gap: str = "10 seconds", delay: str = "10 minutes") -> DataFrame:
    """Sessions with a strict gap, emitted when the watermark passes them."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", delay).groupBy(*keys, w.alias("w")).agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count("*").alias("session_rows")).drop("w")


class StateTable:
    """Versions of a keyed table in a shared folder, one per micro-batch, in buckets of keys.

    A version writes only the buckets it is told it touched, and then a pointer of one row per bucket that names the version holding
    it; the pointer makes the version count, so that a batch which fails half-way leaves the state as it was, and one that is run again
    leaves the same state. The first version holds all buckets. The two versions before a written one stay readable, for a
    rerun and for readers of the last; buckets that none of them names are removed. A table without the key column is one bucket.
    """

    def __init__(self, folder: str, initial: DataFrame, key: str = "mission_id", buckets: int = 64):
        self.folder, self.initial, self.spark = folder.rstrip("/"), initial, initial.sparkSession
        self.key, self.buckets = key, buckets

    def _bucket(self, df: DataFrame) -> Column:
        return (F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)) if self.key in df.columns else F.lit(0)).cast("int")

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """Buckets of the rows' keys: at most ``buckets`` numbers, read on the driver."""
        return sorted(r[0] for r in rows.select(self._bucket(rows)).distinct().collect())

    def _files(self, path: str):
        root = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, path: str, name: str) -> list[int]:
        """Numbers of the folders ``name=number``."""
        root, fs = self._files(path)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{name}="))

    def _delete(self, path: str) -> None:
        root, fs = self._files(path)
        fs.delete(root, True)

    def _pointer(self, version: int) -> str:
        return f"{self.folder}/pointers/version={version}"

    def _versions(self) -> list[int]:
        def written(version: int) -> bool:
            root, fs = self._files(f"{self._pointer(version)}/_SUCCESS")
            return fs.exists(root)
        return [v for v in self._numbers(f"{self.folder}/pointers", "version") if written(v)]

    def _holders(self, version: int) -> dict[int, int]:
        """The version that holds each bucket."""
        return {r["bucket"]: r["at"] for r in self.spark.read.schema("bucket int, at bigint").parquet(self._pointer(version)).collect()}

    def before(self, batch_id: int, buckets: list[int] | None = None) -> DataFrame:
        """The state that a batch finds, or some buckets of it."""
        older = [v for v in self._versions() if v < batch_id]
        if not older:
            return self.initial if buckets is None else self.initial.where(self._bucket(self.initial).isin(buckets))
        paths = [f"{self.folder}/version={v}/state_bucket={b}" for b, v in self._holders(older[-1]).items() if buckets is None or b in buckets]
        return self.spark.read.parquet(*paths) if paths else self.initial.limit(0)

    def write(self, batch_id: int, state: DataFrame, buckets: list[int] | None = None) -> None:
        """Write ``state``, which replaces all, or those ``buckets`` (it must not have rows of others)."""
        older = [v for v in self._versions() if v < batch_id]
        held = {}
        if buckets is not None and older:
            held = {b: v for b, v in self._holders(older[-1]).items() if b not in buckets}
        elif buckets is not None:
            state = state.unionByName(self.initial.where(~self._bucket(self.initial).isin(buckets)).select(*state.columns))
        target = f"{self.folder}/version={batch_id}"
        state.withColumn("state_bucket", self._bucket(state)).write.mode("overwrite").partitionBy("state_bucket").parquet(target)
        held |= {b: batch_id for b in self._numbers(target, "state_bucket")}
        self.spark.createDataFrame(sorted(held.items()), "bucket int, at bigint").coalesce(1).write.mode("overwrite").parquet(self._pointer(batch_id))
        kept = [*older[-2:], batch_id]
        for old in [v for v in older if v < kept[0]]:
            self._delete(self._pointer(old))
        named = {(v, b) for pointer in kept for b, v in self._holders(pointer).items()}
        for version in [v for v in self._numbers(self.folder, "version") if v < kept[0]]:
            present = self._numbers(f"{self.folder}/version={version}", "state_bucket")
            unused = [b for b in present if (version, b) not in named]
            for path in [f"/state_bucket={b}" for b in unused] if len(unused) < len(present) else [""]:
                self._delete(f"{self.folder}/version={version}{path}")

    def write_late(self, batch_id: int, records: DataFrame) -> None:
        """Keep records that came too late for their tick; batches of them are never removed, one that is run again is overwritten."""
        if not records.isEmpty():
            records.write.mode("overwrite").parquet(f"{self.folder}/late/batch={batch_id}")

    def late(self) -> DataFrame | None:
        """All late records with their ``batch``, or None if there are none."""
        root, fs = self._files(f"{self.folder}/late")
        return self.spark.read.parquet(f"{self.folder}/late") if fs.exists(root) else None

    def latest(self) -> DataFrame:
        return self.before(1 << 62)


def fold_batches(fields: DataFrame, state: StateTable, missions: DataFrame, res_m: float,
                 settings: Settings = DEFAULTS) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: advance the surfaces of the missions seen, tick by tick.

    The state table holds (mission, row, col, p, tick, last_sweep). A batch carries records with their ``tick`` and
    mission columns. Each of its ticks is folded in order, and so are the ticks without records that a mission has passed since its
    last one; the numbers of distinct ticks are the only thing read on the driver. A mission without state starts at the first tick
    of its records in the batch. Missions without records in the batch keep their state; only buckets with missions of the batch are read and written. Records whose tick the mission's state has
    already reached cannot be folded any more: they leave the state as it is and go to ``state.late()``.
    """
    keys = list(CELL_KEYS)
    columns = [*keys, "p", "tick", "last_sweep"]

    def advance(prior: DataFrame, records: DataFrame, moving: DataFrame, tick: int) -> DataFrame:
        """The missions in ``moving`` at ``tick``, the others as they were."""
        n = shuffle_partitions(prior.sparkSession)
        active = fields.join(moving, "mission_id").repartition(n, "mission_id")
        surface = raw_surfaces(active, F.array(F.lit(tick)), settings)
        swept = ev.swept_cells(records, res_m, settings).groupBy(*keys).agg(F.max("tick").alias("_new"))
        boosts = ev.boost_factors(ev.person_events(records).drop("position"), settings).groupBy(*keys).agg(F.product("boost").alias("boost"))
        merged = surface.join(prior.select(*keys, F.col("p").alias("prior"), "last_sweep"), keys, "left").join(swept, keys, "left").join(boosts, keys, "left")
        merged = merged.withColumn("last_sweep", F.greatest("last_sweep", "_new")).withColumn(
            "clean", F.pow(F.lit(settings.clean_decay), F.col("tick") - F.col("last_sweep"))).drop("_new")
        out = ev.boost(ev.suppress(ev.blend_history(merged, "prior", settings), settings))
        idle = prior.join(moving, "mission_id", "left_anti").select(*columns)
        return out.select(*columns).unionByName(idle)

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch = batch.cache()
        touched = state.buckets_of(batch)
        current = state.before(batch_id, touched)
        reached = batch.groupBy("mission_id").agg(F.min("tick").alias("_least"), F.max("tick").alias("_to"))
        passed = current.groupBy("mission_id").agg(F.max("tick").alias("_from"))
        state.write_late(batch_id, batch.join(passed, "mission_id").where("tick <= _from").select(*batch.columns))
        first = F.coalesce(F.col("_from") + 1, F.col("_least"))
        due = reached.join(passed, "mission_id", "left").select("mission_id", F.explode(F.when(
            first <= F.col("_to"), F.sequence(first, F.greatest(first, F.col("_to"))))).alias("tick")).cache()
        ticks = [r["tick"] for r in due.select("tick").distinct().orderBy("tick").collect()]
        for tick in ticks:
            current = advance(current, batch.where(F.col("tick") == tick), due.where(F.col("tick") == tick).select("mission_id"), tick)
            if tick != ticks[-1]:
                current = cut_lineage(current)
        if touched:
            state.write(batch_id, current, touched)
        due.unpersist()
        batch.unpersist()

    return apply


def merge_delta_batches(state: StateTable) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: upsert the deltas of a batch of messages, the last one wins.

    Messages carry ``seq``; a cell is written once per batch, and only buckets with missions of the batch are.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        deltas = delta_rows(route(parse_messages(batch), "heatmap_delta"), "seq")
        touched = state.buckets_of(deltas)
        if touched:
            state.write(batch_id, ev.apply_deltas(state.before(batch_id, touched), deltas), touched)
    return apply


def relayer_batches(fields: DataFrame, state: StateTable, settings: Settings = DEFAULTS) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: recompute toggled missions at their tick, without history.

    ``fields`` carries the switches; control messages replace them. The state's tick stays.
    """
    keys = list(CELL_KEYS)

    def apply(batch: DataFrame, batch_id: int) -> None:
        controls = route(parse_messages(batch), "update_layers")
        touched = state.buckets_of(controls)
        if not touched:
            return
        prior = state.before(batch_id, touched)
        ticks = prior.groupBy("mission_id").agg(F.max("tick").alias("now"))
        switched = layer_switches(controls, fields, "seq").join(ticks, "mission_id").repartition(
            shuffle_partitions(batch.sparkSession), "mission_id")
        fresh = raw_surfaces(switched, F.array("now"), settings).select(*keys, F.col("p").alias("_p"))
        out = prior.join(fresh, keys, "left").withColumn("p", F.coalesce("_p", "p")).drop("_p")
        state.write(batch_id, out, touched)

    return apply


def run_fold(batch_fold: Callable[[DataFrame, int], None], stream: DataFrame, checkpoint: str):
    """Start a fold over everything available and return the query."""
    return stream.writeStream.foreachBatch(batch_fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["stream_ticks", "tick_counts", "stream_reveals", "stream_live_sweep", "stream_clean_scores", "first_events", "kept_by_cooldown", "stream_throttle", "stream_sessions",
           "StateTable", "fold_batches", "merge_delta_batches", "relayer_batches", "run_fold"]
