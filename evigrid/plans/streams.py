"""Queries of streams that keep their state in Spark's state store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.replaying import Replay
from ..sources.tables import points, read_map, table, write_map
from ..streaming import stateful, voxels
from .connectors import folder
from .queries import POINTS, VOXEL, query


def feed(spark: SparkSession, files: list[DataFrame]) -> DataFrame:
    """A stream of one file a micro-batch, in order."""
    source = folder(spark, "feed")
    for f in files:
        f.coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(files[0].schema).option("maxFilesPerTrigger", 1).parquet(source)


def stamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


CAPPED = f"""{POINTS}, k AS (SELECT CAST(floor(x / 2.0) AS INT) AS ix, CAST(floor(y / 4.0) AS INT) AS iy, CAST(floor(z / 1.0) AS INT) AS iz, class, count(*) AS n FROM pts WHERE month(ts) > 3 GROUP BY ALL)"""


@query(f"""WITH {CAPPED}, c AS (SELECT ix, iy, iz, round(max(n) / sum(n), 6) AS c FROM k GROUP BY ALL), cut AS (SELECT min(c) AS least FROM (SELECT c FROM c ORDER BY c DESC LIMIT 300))
  SELECT k.* FROM k JOIN c USING (ix, iy, iz), cut WHERE c >= least""")
def t1_t5_t10_voxel_state(spark, sf_dir):
    """A map in the state store: three runs of a stream on one checkpoint, a reset after the first, and the surest 300 voxels of what is left."""
    p = points(spark, sf_dir).withColumn("epoch", (F.month("ts") > 3).cast("int"))
    source, path, state = folder(spark, "feed"), folder(spark, "touched"), folder(spark, "state")
    for part in (p.where("epoch = 0"), p.where("epoch = 1 AND u > 0.5"), p.where("epoch = 1 AND u <= 0.5")):
        part.coalesce(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(source)
        stateful.run_to_end(stateful.keep_voxels(stream, VOXEL, "epoch"), path, state, mode="update")
    return stateful.read_voxels(spark, state, 300)


GOALS = "g AS (SELECT user_id % 10 AS robot, epoch_us(ts) AS t, value / 100 AS x, event_id % 3 AS y, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, value, event_id) AS i FROM events)"


@query(f"""WITH RECURSIVE {GOALS}, r AS (SELECT robot, i, x, y, t AS sent, TRUE AS send FROM g WHERE i = 1
  UNION ALL SELECT robot, i, CASE WHEN far THEN gx ELSE x END, CASE WHEN far THEN gy ELSE y END, CASE WHEN far THEN t ELSE sent END, far
    FROM (SELECT g.robot, g.i, r.x, r.y, r.sent, g.x AS gx, g.y AS gy, g.t, g.t > r.sent + 7200000000 OR (g.x - r.x) ** 2 + (g.y - r.y) ** 2 >= 0.25 AS far FROM r JOIN g ON g.robot = r.robot AND g.i = r.i + 1)),
  s AS (SELECT robot, x, y, sent, coalesce(lead(sent) OVER (PARTITION BY robot ORDER BY i), (SELECT max(t) FROM g)) AS over FROM r WHERE send)
  SELECT robot, sent AS at, round(x, 6) AS x, CAST(y AS DOUBLE) AS y, 'send' AS action FROM s UNION ALL SELECT robot, sent + 1200000000, round(x, 6), y, 'replan' FROM s WHERE over > sent + 1200000000
  UNION ALL SELECT robot, sent + 7200000000, round(x, 6), y, 'cancel' FROM s WHERE over > sent + 7200000000""")
def t8_k19_goal_relay(spark, sf_dir):
    """Goals sent, given up after two hours, and noticed for replanning after twenty minutes."""
    e = stamped(spark, sf_dir).select((F.col("user_id") % 10).alias("robot"), "ts", (F.col("value") / 100).alias("x"), (F.col("event_id") % 3).alias("y"))
    goals = feed(spark, [e.where(F.dayofmonth("ts").between(a, b)) for a, b in ((1, 9), (10, 20), (21, 31))])
    path = folder(spark, "actions")
    out = stateful.relay_goals(goals, "0 seconds", 0.5, 7200.0, 1200.0)
    stateful.run_to_end(out, path, folder(spark, "state"))
    return spark.read.schema(out.schema).parquet(path).select("robot", "at", F.round("x", 6).alias("x"), "y", "action")


@query("""WITH f AS (SELECT user_id, event_id, ts, least(day(ts) // 8, 3) AS file FROM events), n AS (SELECT user_id, file, count(*) AS n, arg_max(event_id, ts) AS id FROM f GROUP BY ALL)
  SELECT user_id, arg_max(id, file) AS id, count(*) AS worked, CAST(sum(n) - count(*) AS BIGINT) AS dropped FROM n GROUP BY user_id""")
def t2_t3_latest_frames(spark, sf_dir):
    """Four micro-batches of frames, of which only the newest of each user is worked on; what the last one of each user counted."""
    e = stamped(spark, sf_dir).withColumn("file", F.least(F.floor(F.dayofmonth("ts") / 8), F.lit(3)))
    stream = feed(spark, [e.where(F.col("file") == k) for k in range(4)])
    path = folder(spark, "latest")
    out = stateful.latest_frames(stream, "user_id", "ts", "event_id")
    stateful.run_to_end(out, path, folder(spark, "state"), mode="update")
    rows = spark.read.parquet(path).groupBy(F.col("key").alias("user_id")).agg(F.max_by(F.struct("id", "worked", "dropped"), "worked").alias("s"))
    return rows.select("user_id", "s.id", "s.worked", "s.dropped")


@query("""WITH f AS (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 2 WHEN day(ts) > 12 THEN 1 ELSE 0 END AS file FROM events), w AS (SELECT file, epoch_ms(max(ts)) * 1000 - 172800000000 AS mark FROM f GROUP BY file),
  k AS (SELECT coalesce(epoch_us(ts) > (SELECT max(mark) FROM w WHERE w.file < f.file - 1), TRUE) AS kept FROM f)
  SELECT count(*) AS seen, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS dropped FROM k""")
def t11_late_rows(spark, sf_dir):
    """Rows behind the watermark, two days after the newest row: counted by a listener, and missing from what is kept. Spark tests a micro-batch against the mark that the batch before began with."""
    e = stamped(spark, sf_dir)
    file = F.when(F.col("event_id") % 3 == 0, 2).when(F.dayofmonth("ts") > 12, 1).otherwise(0)
    stream = feed(spark, [e.where(file == k) for k in range(3)])
    path, name, late = folder(spark, "kept"), f"late-{id(stream)}", stateful.LateRows()
    out = stateful.kept_rows(stream, "user_id", "ts", "event_id", "2 days")
    spark.streams.addListener(late)
    try:
        stateful.run_to_end(out, path, folder(spark, "state"), name)
        if not late.wait(name):
            raise TimeoutError("the query's progress didn't come")
    finally:
        spark.streams.removeListener(late)
    return spark.read.schema(out.schema).parquet(path).agg(F.lit(late.seen[name]).alias("seen"), F.count(F.lit(1)).alias("kept"), F.lit(late.dropped[name]).alias("dropped"))


@query("""WITH e AS (SELECT event_id, user_id, (epoch_us(ts) - (SELECT epoch_us(min(ts)) FROM events)) AS p FROM events)
  SELECT event_id, user_id, CAST(t AS INT) AS turn, round((p + t * (SELECT max(p) FROM e)) / 7200e6, 6) AS play_at FROM e, (SELECT unnest(range(2)) AS t)""")
def s8_replay_stream(spark, sf_dir):
    """Events played twice at two hours a second, as a stream that is stopped in the middle of the first turn and started again."""
    spark.dataSource.register(Replay)
    path, state = folder(spark, "played"), folder(spark, "state")
    for until in (100, 1e9):
        stream = spark.readStream.format("replay").options(path=f"{sf_dir}/events.parquet", ts="ts", rate=7200, turns=2, began=0, until=until).load()
        out = stream.select("event_id", "user_id", "turn", F.round("play_at", 6).alias("play_at"))
        stateful.run_to_end(out, path, state)
    return spark.read.schema(out.schema).parquet(path)


@query(f"""WITH {POINTS}, k AS (SELECT CAST(floor(x / 2.0) AS INT) AS ix, CAST(floor(y / 4.0) AS INT) AS iy, CAST(floor(z / 1.0) AS INT) AS iz, class, count(*) AS n FROM pts WHERE u > 0.25 GROUP BY ALL)
  SELECT ix + 0.0::DOUBLE AS x, iy + 0.0::DOUBLE AS y, iz + 0.0::DOUBLE AS z, class, n + 0.0::DOUBLE AS confidence FROM k""")
def k12_t13_saved_map(spark, sf_dir):
    """A streamed map that saves itself every second batch, by a clock that ticks with the batches, as text: what was saved last."""
    p = points(spark, sf_dir)
    stream = feed(spark, [p.where("u > 0.75"), p.where("u > 0.25 AND u <= 0.75"), p.where("u <= 0.25")])
    ticks, saved = iter(range(9)), []

    def save(cells):
        saved.append(folder(spark, "saved"))
        write_map(cells.select(*(F.col(f"i{k}").cast("double").alias(k) for k in "xyz"), "class", F.col("n").cast("double").alias("confidence")), saved[-1])

    due = voxels.Due(2, lambda: next(ticks) * 1.0)
    voxels.keep_map(stream, VOXEL, folder(spark, "map"), folder(spark, "state"), publish=save, wanted=due).awaitTermination()
    return read_map(spark, saved[-1])
