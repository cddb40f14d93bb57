"""Maps that streams keep: voxels with their class counts, and primitives renewed frame by frame.

State is a folder of versions, one for each micro-batch that changed it. A batch reads the newest version before its own and
writes its own, so a batch that runs again after a failure writes the same; the version before is kept for readers.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import primitives, spatial
from ..operators.spatial import voxelise


def counts(points: DataFrame, size: tuple[float, float, float], late: str = "1 day") -> DataFrame:
    """Running points per voxel and class of a stream with a column ts; Spark keeps the state, rows later than `late` may be dropped."""
    return voxelise(points.withWatermark("ts", late), size).groupBy("ix", "iy", "iz", "class").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("seen"))


def versions(spark: SparkSession, path: str) -> list[int]:
    """Batches whose version is complete, in order."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        return []
    found = [re.fullmatch(r"v=(\d+)", f.getPath().getName()) for f in store.listStatus(at)]
    numbers = sorted(int(m[1]) for m in found if m)
    return [n for n in numbers if store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v={n}/_SUCCESS"))]


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest version (older than `before`), or nothing."""
    have = [n for n in versions(spark, path) if before is None or n < before]
    return spark.read.parquet(f"{path}/v={have[-1]}") if have else None


def _replace(spark: SparkSession, path: str, batch: int, table: DataFrame) -> None:
    table.write.mode("overwrite").parquet(f"{path}/v={batch}")
    for old in [n for n in versions(spark, path) if n < batch][:-1]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v={old}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def reset(spark: SparkSession, path: str) -> None:
    """Forget the map; the stream that keeps it goes on with an empty one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """step on each micro-batch: as soon as `every` says (e.g. "500 milliseconds", the rate at which a map is published), or, without it, until the source is read."""
    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def cap(cells: DataFrame, most: int) -> DataFrame:
    """Class counts of the `most` surest voxels (all that are as sure as the last of them)."""
    voxels = cells.groupBy("ix", "iy", "iz").agg((F.max("n") / F.sum("n")).alias("share"))
    ranked = voxels.withColumn("confidence", F.round("share", 6))
    by = ranked.groupBy("confidence").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("confidence")).collect()  # a million values at most
    total, least = 0, 0.0
    for r in by:
        if total >= most:
            break
        total, least = total + r["c"], r["confidence"]
    return cells.join(ranked.where(F.col("confidence") >= least).select("ix", "iy", "iz"), ["ix", "iy", "iz"], "left_semi")


class Due:
    """True when `seconds` have passed since it last was, or when someone has asked: says when a kept map is saved or published."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self.last, self.asked = seconds, clock, clock(), False

    def ask(self) -> None:
        self.asked = True

    def __call__(self) -> bool:
        due = self.asked or self.clock() - self.last >= self.seconds
        if due:
            self.last, self.asked = self.clock(), False
        return due


def keep_map(points: DataFrame, size: tuple[float, float, float], path: str, checkpoint: str, most: int = 1_000_000, every: str | None = None, publish: Callable[[DataFrame], None] | None = None, wanted: Callable[[], bool] = lambda: True) -> StreamingQuery:
    """Class counts (ix, iy, iz, class, n) of a stream's points as versions under path, with `most` voxels or a few more.

    publish gets the map after each batch, if someone wants it; with wanted=Due(60) it saves the map once a minute.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = voxelise(batch, size).groupBy("ix", "iy", "iz", "class").agg(F.count(F.lit(1)).alias("n"))
        old = current(spark, path, number)
        if old is not None:
            new = new.unionByName(old).groupBy("ix", "iy", "iz", "class").agg(F.sum("n").alias("n"))
        new = new.cache()
        kept = cap(new, most) if new.select("ix", "iy", "iz").distinct().count() > most else new
        _replace(spark, path, number, kept)
        new.unpersist()
        if publish and wanted():
            publish(current(spark, path))

    return run(points, step, checkpoint, every)


def keep_primitives(points: DataFrame, path: str, checkpoint: str, most: float = 0.5, least: int = 5, target: int = 128, rebuild: int = 0, every: str | None = None) -> StreamingQuery:
    """Primitives (as primitives.update()) of a stream's frames, a micro-batch each, as versions under path. Each `rebuild`-th frame they are built anew (0: only the first)."""

    def step(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        spark, frame = batch.sparkSession, batch.select("id", "x", "y", "z", "u").cache()
        prior = current(spark, path, number)
        if prior is None or (rebuild and number % rebuild == 0):
            built = spatial.build(frame, target, least)
            new = built.select(F.col("cluster").cast("long").alias("prim"), *(c for c in built.columns if c != "cluster")).withColumn("kept", F.lit(False))
        else:
            k = spatial.primitive_count(frame.count(), target, least)
            new = primitives.update(prior.select(F.col("prim").alias("id"), "x", "y", "z"), frame, most, least, k)
            taken = F.coalesce(F.max(F.col("prim")), F.lit(-1))
            top = prior.agg(taken.alias("top")).first()["top"]
            new = new.withColumn("prim", F.when(F.col("kept"), F.col("prim")).otherwise(top - F.col("prim")))
        _replace(spark, path, number, new)
        frame.unpersist()

    return run(points, step, checkpoint, every)
