from pyspark.sql import functions as F

from evigrid.operators.spatial import voxelise
from evigrid.sources.tables import points
from evigrid.streaming import state, voxels
from evigrid.streaming.voxels import keep_map

SF, SIZE = "/root/testdata/sf0.001", (5.0, 10.0, 2.0)


def halves(spark, tmp_path):
    """All points, and a stream of them in two files."""
    batch = points(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(2):
        batch.where(F.col("u") <= 0.5 if k else F.col("u") > 0.5).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    return batch, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "k=*"))


def test_stream_ends_with_the_counts_of_the_batch(spark, tmp_path):
    batch, stream = halves(spark, tmp_path)
    path, seen = str(tmp_path / "map"), []
    asked = iter([True, False])
    query = keep_map(stream, SIZE, path, str(tmp_path / "state"), publish=lambda m: seen.append(m.count()), wanted=lambda: next(asked))
    assert query.awaitTermination(120) and query.exception() is None
    want = voxelise(batch, SIZE).groupBy("ix", "iy", "iz", "class").agg(F.count(F.lit(1)).alias("n"))
    got = voxels.current(spark, path)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert voxels.versions(spark, path) == [0, 1] and len(seen) == 1  # published only when someone wanted it
    assert voxels.current(spark, path, 0) is None
    voxels.reset(spark, path)
    assert voxels.current(spark, path) is None


def test_running_counts_of_a_stream(spark, tmp_path):
    batch, stream = halves(spark, tmp_path)
    run(voxels.counts(stream, SIZE), "running_counts", tmp_path / "state", "complete")
    assert spark.table("running_counts").agg(F.sum("n")).first()[0] == batch.count()


def test_map_of_a_stream_stays_under_its_cap(spark, tmp_path):
    """The surest voxels stay; those as sure as the last of them, too."""
    rows = [(float(i), 0.0, 0.0, k) for i in range(20) for k in ([0] if i < 5 else [0, 1])]
    spark.createDataFrame(rows, "x double, y double, z double, class int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double, y double, z double, class int").parquet(str(tmp_path / "in"))
    keep_map(stream, (1.0, 1.0, 1.0), str(tmp_path / "map"), str(tmp_path / "state"), most=5).awaitTermination(120)
    assert sorted(r["ix"] for r in voxels.current(spark, str(tmp_path / "map")).collect()) == [0, 1, 2, 3, 4]


def test_primitives_of_frames(spark, tmp_path):
    """The first frame makes primitives, later ones renew them or add some, and every second one starts anew."""
    at = lambda frame, x: [(1000 * frame + i, x + i / 100, 0.0, 0.0, 0.1) for i in range(20)]
    stream = feed(spark, tmp_path, "id long, x double, y double, z double, u double", at(0, 0.0), at(1, 0.1) + at(3, 50.0), at(2, 50.0))
    for rebuild in (0, 2):
        path = str(tmp_path.parent / f"primitives-{rebuild}")
        voxels.keep_primitives(stream, path, str(tmp_path.parent / f"state-{rebuild}"), 1.0, 10, 1, rebuild).awaitTermination(120)
        rows = voxels.current(spark, path).collect()
        assert [(round(r["x"]), r["n"], r["kept"]) for r in rows] == [(50, 20, not rebuild)]
        if not rebuild:  # the frame before: one renewed, one new
            before = voxels.current(spark, path, 2).collect()
            assert sorted((round(r["x"]), r["n"], r["kept"]) for r in before) == [(0, 20, True), (50, 20, False)] and len({r["prim"] for r in before}) == 2


def run(stream, name, path, mode):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    ended = query.awaitTermination(120)
    query.stop()
    assert ended and query.exception() is None


def feed(spark, folder, schema, *batches):
    """A stream of one file a trigger, in order."""
    import os

    for i, rows in enumerate(batches):
        path = folder / f"{i}.parquet"
        spark.createDataFrame(rows, schema).toPandas().to_parquet(path, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(path, (1e9 + i, 1e9 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def at(second):
    from datetime import datetime, timedelta

    return datetime(2024, 1, 1) + timedelta(seconds=second)


def test_status_is_kept_across_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = feed(spark, tmp_path / "in", "key string, ts timestamp, class int", [("a", at(0), 1), ("a", at(1), 2), ("b", at(0), 1)], [("a", at(2), 1), ("a", at(3), 2), ("b", at(1), 1)])
    run(state.status(stream), "status", tmp_path / "ck", "update")
    got = {(r["key"], r["frames"]): (r["transitions"], r["dynamic"], r["u"]) for r in spark.table("status").collect()}
    assert got[("a", 4)] == (2, True, 0.5) and got[("b", 2)] == (0, False, 0.0) and got[("b", 1)] == (0, False, 0.5)


def test_near_goals_are_not_sent_again(spark, tmp_path):
    """A single batch a run: with a processing-time timeout a query has batches without end."""
    (tmp_path / "in").mkdir()
    schema = "robot string, ts timestamp, x double, y double"
    rows = [("r", at(0), 0.0, 0.0), ("r", at(1), 0.1, 0.0)], [("r", at(2), 0.2, 0.0), ("r", at(3), 2.0, 0.0)]
    for i in (1, 2):
        goals = state.accepted_goals(feed(spark, tmp_path / "in", schema, *rows[:i]), timeout_ms=3_600_000)
        out = goals.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(tmp_path / "out"))
        query = out.trigger(once=True).start()
        assert query.awaitTermination(120) and query.exception() is None
    assert [(r["x"], r["action"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("x").collect()] == [(0.0, "send"), (2.0, "send")]


def test_streams_pair_within_the_skew(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "r").mkdir()
    schema = "key string, ts timestamp, id long"
    left = feed(spark, tmp_path / "l", schema, [("k", at(0), 1), ("k", at(5), 2)])
    right = feed(spark, tmp_path / "r", schema, [("k", at(0.3), 7), ("k", at(9), 8), ("other", at(5), 9)])
    run(state.sync(left, right, "key", "500 milliseconds", "10 seconds"), "pairs", tmp_path / "ck", "append")
    assert [(r["left_id"], r["right_id"], r["gap"]) for r in spark.table("pairs").collect()] == [(1, 7, 0.3)]


def test_replay_falls_due_by_the_clock(spark, tmp_path):
    """Offsets are played time: what is due comes, once, and a later start goes on where the earlier one stopped."""
    import time

    import pyarrow as pa
    import pyarrow.parquet as pq

    from evigrid.sources.replaying import ReplayReader
    from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType, TimestampNTZType

    for k in range(2):  # two files; one row has no stamp
        pq.write_table(pa.table({"id": [k, 2 + k, 9], "ts": pa.array([1_000_000 * (5 + k), 1_000_000 * (7 + k), None], pa.timestamp("us"))}), tmp_path / f"{k}.parquet")
    schema = StructType().add("id", LongType()).add("ts", TimestampNTZType()).add("turn", IntegerType()).add("play_at", DoubleType())
    reader = lambda **o: ReplayReader(schema, {"path": str(tmp_path), "rate": "2", "turns": "2", **o})
    rows = lambda r, a, b: sorted((x["id"], x["turn"], x["play_at"]) for p in r.partitions(a, b) for batch in r.read(p) for x in batch.to_pylist())
    full = reader(began="0")
    end = full.latestOffset()
    assert end == {"played": 6_000_000} and reader(began=str(time.time() + 99)).latestOffset() == {"played": -1}
    every = rows(full, full.initialOffset(), end)
    assert every == [(0, 0, 0.0), (0, 1, 1.5), (1, 0, 0.5), (1, 1, 2.0), (2, 0, 1.0), (2, 1, 2.5), (3, 0, 1.5), (3, 1, 3.0)]
    middle = reader(began="0", until="1.0").latestOffset()
    assert middle == {"played": 2_000_000} and sorted(rows(full, full.initialOffset(), middle) + rows(full, middle, end)) == every
