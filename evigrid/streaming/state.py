"""Keyed state of streams: histories with a time to live, dynamic status, goal dedupe, and time-synchronised pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def status(events: DataFrame, window: float = 10.0, ttl_ms: int = 30_000, alpha: float = 0.1) -> DataFrame:
    """(key, frames, transitions, dynamic, u, occupancy) of a stream (key string, ts, class): the state after each batch of a key.

    transitions: changes of class less than window seconds after the last change; dynamic from two on. u: 1 - the share of
    the most frequent class, 0.5 at the first row. A key's state goes when the watermark passes its last row by ttl_ms.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frames, n, last, previous, occupied, classes, counts = state.get if state.exists else (0, 0, 0.0, None, 0.0, [], [])
        seen, newest = dict(zip(classes, counts, strict=True)), 0
        for b in batches:
            b = b.sort_values(["ts", "class"])
            for ts, c in zip(b["ts"], b["class"], strict=True):
                t = ts.timestamp()
                if previous is not None and c != previous:
                    n, last = n + (t - last < window), t
                frames, previous, occupied = frames + 1, int(c), alpha + (1 - alpha) * occupied
                seen[int(c)] = seen.get(int(c), 0) + 1
                newest = max(newest, int(t * 1000))
        state.update((frames, int(n), last, previous, occupied, list(seen), list(seen.values())))
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + ttl_ms)
        u = 0.5 if frames == 1 else 1 - max(seen.values()) / frames
        yield pd.DataFrame({"key": [key[0]], "frames": [frames], "transitions": [int(n)], "dynamic": [bool(n >= 2)], "u": [round(u, 6)], "occupancy": [round(occupied, 6)]})

    out = "key string, frames long, transitions long, dynamic boolean, u double, occupancy double"
    held = "frames long, n long, last double, previous int, occupied double, classes array<int>, counts array<long>"
    keyed = events.withWatermark("ts", f"{ttl_ms} milliseconds").groupBy("key")
    return keyed.applyInPandasWithState(fold, out, held, "update", GroupStateTimeout.EventTimeTimeout)


def accepted_goals(goals: DataFrame, tolerance: float = 0.5, timeout_ms: int = 60_000) -> DataFrame:
    """Goals (robot string, ts, x, y) that go on to the robot: those at least tolerance away from the current one, which is given up after timeout_ms without a goal."""

    def relay(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            x, y = state.get
            state.remove()
            yield pd.DataFrame({"robot": [key[0]], "x": [x], "y": [y], "action": ["cancel"]})
            return
        now = state.get if state.exists else None
        sent = []
        for b in batches:
            for x, y in b.sort_values(["ts", "x", "y"])[["x", "y"]].itertuples(index=False):
                if now is None or (x - now[0]) ** 2 + (y - now[1]) ** 2 >= tolerance * tolerance:
                    now = (float(x), float(y))
                    sent.append(now)
        if now is not None:
            state.update(now)
            if sent:
                state.setTimeoutDuration(timeout_ms)
        if sent:
            yield pd.DataFrame({"robot": key[0], "x": [s[0] for s in sent], "y": [s[1] for s in sent], "action": "send"})

    schema = "robot string, x double, y double, action string"
    return goals.groupBy("robot").applyInPandasWithState(relay, schema, "x double, y double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def sync(left: DataFrame, right: DataFrame, key: str, skew: str, late: str) -> DataFrame:
    """Pairs of two streams (key, ts, and a frame id `id`) whose stamps differ by skew at most: key, left_id, right_id, gap in seconds."""
    a = left.withWatermark("ts", late).select(F.col(key), F.col("ts").alias("left_ts"), F.col("id").alias("left_id"))
    b = right.withWatermark("ts", late).select(F.col(key).alias("right_key"), F.col("ts").alias("right_ts"), F.col("id").alias("right_id"))
    near = (F.col(key) == F.col("right_key")) & F.col("right_ts").between(F.col("left_ts") - F.expr(f"INTERVAL {skew}"), F.col("left_ts") + F.expr(f"INTERVAL {skew}"))
    gap = F.abs(F.timestamp_diff("MICROSECOND", F.col("left_ts"), F.col("right_ts"))) / 1e6
    return a.join(b, near).select(key, "left_id", "right_id", gap.alias("gap"))


def sync_all(streams: list[DataFrame], key: str, skew: str, late: str) -> DataFrame:
    """Tuples of several streams (key, ts, id) whose stamps differ from the first one's by skew at most: key, id_0, id_1, ..., and gap (the largest, in seconds)."""
    out = streams[0].withWatermark("ts", late).select(F.col(key), F.col("ts").alias("ts_0"), F.col("id").alias("id_0"), F.lit(0.0).alias("gap"))
    for k, other in enumerate(streams[1:], 1):
        b = other.withWatermark("ts", late).select(F.col(key).alias("other_key"), F.col("ts").alias("other_ts"), F.col("id").alias(f"id_{k}"))
        near = F.col("other_ts").between(F.col("ts_0") - F.expr(f"INTERVAL {skew}"), F.col("ts_0") + F.expr(f"INTERVAL {skew}"))
        gap = F.abs(F.timestamp_diff("MICROSECOND", F.col("ts_0"), F.col("other_ts"))) / 1e6
        # The next join allows one event time on each side: the first stream's goes on.
        out = out.join(b, (F.col(key) == F.col("other_key")) & near).select(key, "ts_0", *(f"id_{j}" for j in range(k + 1)), F.greatest("gap", gap).alias("gap"))
    return out.drop("ts_0")
