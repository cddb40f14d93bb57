"""Stateful operators in Spark's state store: a map of voxels, the goal relay, latest frames, and counts of late rows.

They need the RocksDB provider, which run_to_end() and state_store() set. State survives restarts from the checkpoint, and work is in proportion to a batch.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.spatial import voxelise

#: Voxels of a block along an axis: a block is one key of the state store.
BLOCK = 16

PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_store(spark: SparkSession):
    """Queries that begin here keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class Voxels(StatefulProcessor):
    """Class counts of a block's voxels as map state. A batch of a later epoch clears what the block held before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getMapState("cells", "ix int, iy int, iz int", "counts array<bigint>, epoch int")
        self.epoch = handle.getValueState("epoch", "epoch int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        held = self.epoch.get()[0] if self.epoch.exists() else -1
        newest = int(new["epoch"].max())
        if newest > held:
            self.cells.clear()
            self.epoch.update((newest,))
        new = new[new["epoch"] == max(newest, held)]
        for at, classes in new.groupby(["ix", "iy", "iz"])["label"]:
            at = tuple(map(int, at))
            counts = list(self.cells.getValue(at)[0]) if self.cells.containsKey(at) else []
            for k, n in classes.value_counts().items():
                counts += [0] * (int(k) + 1 - len(counts))
                counts[int(k)] += int(n)
            self.cells.updateValue(at, (counts, max(newest, held)))
        yield pd.DataFrame({"touched": [len(new)]})

    def close(self) -> None:
        pass


def keep_voxels(points: DataFrame, size: tuple[float, float, float], epoch: str | None = None) -> DataFrame:
    """A stream (x, y, z, class from 0) whose state is the map; its rows say how many points a block took. Write it with outputMode("update").

    epoch: a column of whole numbers that never falls; a reset of the map raises it. read_voxels() gives the map.
    """
    cells = voxelise(points, size).select("ix", "iy", "iz", F.col("class").cast("int").alias("label"), (F.col(epoch) if epoch else F.lit(0)).cast("int").alias("epoch"))
    blocks = cells.withColumns({f"b{k}": F.floor(F.col(f"i{k}") / BLOCK).cast("int") for k in "xyz"}).groupBy("bx", "by", "bz")
    return blocks.transformWithStateInPandas(Voxels(), "touched long", "Update", "None")


def read_voxels(spark: SparkSession, checkpoint: str, most: int | None = None) -> DataFrame:
    """(ix, iy, iz, class, n) out of the state store of a stopped or running query: the cells of the newest epoch.

    most: of these only the `most` surest voxels, and those as sure as the last of them; the cut is a scalar subquery.
    """
    held = spark.read.format("statestore").option("stateVarName", "cells").load(checkpoint)
    held = held.select("user_map_key.ix", "user_map_key.iy", "user_map_key.iz", "user_map_value.counts", "user_map_value.epoch")
    held = held.where(F.col("epoch") == held.agg(F.max("epoch")).scalar())
    if most is not None:
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
        held = held.withColumn("confidence", F.round(F.array_max("counts") / total, 6))
        least = held.select("confidence").orderBy(F.desc("confidence")).limit(most).agg(F.min("confidence")).scalar()
        held = held.where(F.col("confidence") >= least)
    return held.select("ix", "iy", "iz", F.posexplode("counts").alias("class", "n")).where("n > 0")


class Relay(StatefulProcessor):
    """The goal that a robot drives to. Timers in event time give notice to replan and cancel; what falls due between two goals of a batch is done on the way."""

    def __init__(self, tolerance: float, timeout: float, replan: float):
        self.tolerance, self.timeout, self.replan = tolerance, int(timeout * 1e6), int(replan * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.goal = handle, handle.getValueState("goal", "x double, y double, sent bigint, told boolean")

    def due(self, goal, now: int):
        """Actions that fall due before now, and the goal after them."""
        out = []
        if goal and not goal[3] and now > goal[2] + self.replan:
            out.append((goal[2] + self.replan, goal[0], goal[1], "replan"))
            goal = (*goal[:3], True)
        if goal and now > goal[2] + self.timeout:
            out.append((goal[2] + self.timeout, goal[0], goal[1], "cancel"))
            goal = None
        return out, goal

    def settle(self, key, goal, actions) -> Iterator[pd.DataFrame]:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if goal is None:
            self.goal.clear()
        else:
            self.goal.update(goal)
            self.handle.registerTimer((goal[2] + (self.timeout if goal[3] else self.replan)) // 1000 + 1)
        if actions:
            yield pd.DataFrame([(key[0], *a) for a in actions], columns=["robot", "at", "x", "y", "action"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        goal, actions = (tuple(self.goal.get()) if self.goal.exists() else None), []
        for t, x, y in pd.concat(list(rows)).sort_values(["at", "x", "y"])[["at", "x", "y"]].itertuples(index=False):
            done, goal = self.due(goal, int(t))
            actions += done
            if goal is None or (x - goal[0]) ** 2 + (y - goal[1]) ** 2 >= self.tolerance**2:
                goal = (float(x), float(y), int(t), False)
                actions.append((int(t), float(x), float(y), "send"))
        yield from self.settle(key, goal, actions)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        goal = tuple(self.goal.get()) if self.goal.exists() else None
        actions, goal = self.due(goal, timerValues.getCurrentWatermarkInMs() * 1000)
        yield from self.settle(key, goal, actions)

    def close(self) -> None:
        pass


def relay_goals(goals: DataFrame, late: str = "0 seconds", tolerance: float = 0.5, timeout: float = 60.0, replan: float = 10.0) -> DataFrame:
    """(robot, at in microseconds, x, y, action) of a stream of goals (robot, ts, x, y): send, replan after `replan` seconds, cancel after `timeout`.

    A goal nearer than tolerance to the present one is left out; any other takes its place. All times are event times, so the stream ends with availableNow.
    """
    rows = goals.withWatermark("ts", late).select("robot", "ts", F.unix_micros("ts").alias("at"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    kind = goals.schema["robot"].dataType.simpleString()
    out = f"robot {kind}, at long, x double, y double, action string"
    return rows.groupBy("robot").transformWithStateInPandas(Relay(tolerance, timeout, replan), out, "Append", "EventTime")


class Latest(StatefulProcessor):
    """The newest frame of a key in each batch, and how many frames were passed over so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "at bigint, worked bigint, dropped bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, worked, dropped = self.held.get() if self.held.exists() else (-(1 << 62), 0, 0)
        new = pd.concat(list(rows)).sort_values(["at", "id"])
        top = new.iloc[-1]
        fresh = int(top["at"]) > at  # a frame older than one already worked on is stale
        worked, dropped = worked + fresh, dropped + len(new) - fresh
        self.held.update((max(at, int(top["at"])), int(worked), int(dropped)))
        if fresh:
            yield pd.DataFrame({"key": [key[0]], "id": [top["id"]], "at": [int(top["at"])], "worked": [int(worked)], "dropped": [int(dropped)]})

    def close(self) -> None:
        pass


def latest_frames(frames: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """(key, id, at, worked, dropped) of a stream: under load only the newest frame of a key in each micro-batch is worked on; worked and dropped count all so far. The source's rate limit sets the batches."""
    rows = frames.select(F.col(key).alias("key"), F.unix_micros(ts).alias("at"), F.col(tie).alias("id"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy("key").transformWithStateInPandas(Latest(), f"key {types['key']}, id {types['id']}, at long, worked long, dropped long", "Update", "None")


class LateRows(StreamingQueryListener):
    """Counts, for each query by name: rows that came in (by an observation named `rows`) and rows that stateful operators dropped behind the watermark."""

    def __init__(self):
        self.lock, self.seen, self.dropped, self.names, self.ended = threading.Condition(), {}, {}, {}, set()

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.names[event.runId] = event.name

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.lock:
            self.dropped[p.name] = self.dropped.get(p.name, 0) + sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
            if (row := p.observedMetrics.get("rows")) is not None:
                self.seen[p.name] = self.seen.get(p.name, 0) + row["n"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.ended.add(self.names.get(event.runId))
            self.lock.notify_all()

    def wait(self, name: str, seconds: float = 60) -> bool:
        """Whether the query has ended and all its progress is counted."""
        with self.lock:
            return self.lock.wait_for(lambda: name in self.ended, seconds)


def counted(stream: DataFrame) -> DataFrame:
    """stream with the observation that LateRows reads."""
    return stream.observe("rows", F.count(F.lit(1)).alias("n"))


class Numbered(StatefulProcessor):
    """How many rows of a key came so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        n = self.seen.get()[0] if self.seen.exists() else 0
        self.seen.update((n + len(new),))
        yield pd.DataFrame({"key": [key[0]] * len(new), "id": new["id"], "n": range(n + 1, n + 1 + len(new))})

    def close(self) -> None:
        pass


def kept_rows(stream: DataFrame, key: str, ts: str, tie: str, late: str) -> DataFrame:
    """(key, id, n) of the rows that are not behind the watermark: n numbers a key's rows as they came."""
    rows = counted(stream).withWatermark(ts, late).select(F.col(key).alias("key"), F.col(ts), F.col(tie).alias("id"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy("key").transformWithStateInPandas(Numbered(), f"key {types['key']}, id {types['id']}, n long", "Append", "EventTime")


def run_to_end(out: DataFrame, path: str, checkpoint: str, name: str | None = None, mode: str = "append") -> StreamingQuery:
    """Write a stream's rows as Parquet until its source is read."""
    if mode == "append":
        writer = out.writeStream.format("parquet").option("path", path)
    else:  # Parquet takes rows only, not updates of them; each batch's rows are put down under its number, so a repeated batch replaces itself
        writer = out.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/batch={n}"))
    writer = writer.queryName(name) if name else writer
    with state_store(out.sparkSession):
        query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
