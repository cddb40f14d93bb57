"""Frames of several streams put together by time, each used once."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Widths of a slot of the time line, in units of the largest spread of a tuple.
SLOT = 4096


def _micros(ts: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))


def matches(frames: Iterator[tuple[int, int, object]], streams: int, most: int) -> Iterator[tuple[list, int]]:
    """Tuples (ids, spread) of frames (time, stream, id) in order: as soon as every stream has a frame, the earliest of each are a tuple if they lie within `most`; if not, the earliest of all goes.

    Frames that nothing can reach any more go too, so only those of the last `most` are held.
    """
    held = [deque() for _ in range(streams)]
    for at, stream, name in frames:
        held[stream].append((at, name))
        while all(held):
            first = [q[0][0] for q in held]
            if max(first) - min(first) <= most:
                yield [q.popleft()[1] for q in held], max(first) - min(first)
            else:
                held[first.index(min(first))].popleft()
        for q in held:
            while q and q[0][0] < at - most:
                q.popleft()


def segments(df: DataFrame, key: str, most: int, order: list[str]) -> DataFrame:
    """df (key, at and others) with segment, a struct: runs of a key's frames without a gap wider than `most`.

    Two levels: gaps within slots of the time line, then one row per slot tells whether its first frame goes on what came before.
    """
    slot = df.withColumn("slot", F.floor(F.col("at") / (SLOT * max(most, 1))))
    inside = Window.partitionBy(key, "slot").orderBy("at", *order)
    cut = F.coalesce((F.col("at") - F.lag("at").over(inside) > most).cast("int"), F.lit(0))
    slot = slot.withColumn("cut", cut).withColumn("local", F.sum("cut").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = slot.groupBy(key, "slot").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.max("local").alias("cuts"))
    along = Window.partitionBy(key).orderBy("slot")
    ends = ends.withColumn("joined", F.coalesce(F.col("first") - F.lag("last").over(along) <= most, F.lit(False)))
    own = F.when((F.col("cuts") > 0) | ~F.col("joined"), F.struct(F.col("slot").alias("begin"), F.col("cuts").alias("part")))
    ends = ends.withColumn("own", own).withColumn("open", F.last("own", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.select(F.col(key).alias("_key"), F.col("slot").alias("_slot"), "joined", "open")
    out = slot.join(ends, F.col(key).eqNullSafe(F.col("_key")) & (F.col("slot") == F.col("_slot")))
    segment = F.when((F.col("local") == 0) & F.col("joined"), F.col("open")).otherwise(F.struct(F.col("slot").alias("begin"), F.col("local").alias("part")))
    return out.withColumn("segment", segment).drop("slot", "cut", "local", "_key", "_slot", "joined", "open")


def sync_once(frames: list[DataFrame], key: str, ts: str, tie: str, most: int) -> DataFrame:
    """(key, id_0, id_1, ..., spread): approximate-time matching of two or more streams; no frame is in two tuples. `most` in microseconds.

    Per key in order of time (ties by stream, then id): see matches(). No tuple spans a gap wider than `most`, so the runs between such
    gaps are dealt to tasks, each of which reads its frames in order and holds only those of the last `most`.
    """
    rows = [f.select(F.col(key).alias("key"), _micros(ts).alias("at"), F.lit(k).alias("stream"), F.col(tie).alias("id")) for k, f in enumerate(frames)]
    rows = segments(reduce(DataFrame.unionByName, rows).where("at IS NOT NULL"), "key", most, ["stream", "id"])
    rows = rows.repartition("key", "segment").sortWithinPartitions("key", "segment", "at", "stream", "id").select("key", F.struct("key", "segment").alias("run"), "at", "stream", "id")
    names = [f"id_{k}" for k in range(len(frames))]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out, schema = None, [], None

        def each():
            nonlocal schema
            for b in batches:
                schema = schema or pa.schema([("key", b.schema.field("key").type), *((n, b.schema.field("id").type) for n in names), ("spread", pa.int64())])
                yield from zip(*(b.column(c).to_pylist() for c in ("run", "key", "at", "stream", "id")), strict=True)

        def runs():
            nonlocal last
            it = each()
            row = next(it, None)
            while row is not None:
                last = row

                def own():
                    nonlocal row
                    now = last[0]
                    while row is not None and row[0] == now:
                        yield row[2:]
                        row = next(it, None)

                here = own()
                yield last[1], here
                for _ in here:  # what matches() left
                    pass

        for name, here in runs():
            for ids, spread in matches(here, len(names), most):
                out.append((name, *ids, spread))
                if len(out) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    fields = f"key {types['key']}, " + ", ".join(f"{n} {types['id']}" for n in names) + ", spread long"
    return rows.mapInArrow(run, fields).withColumnRenamed("key", key)
