"""Queries that read and write: layouts, packed points, replays, text maps, clouds, streams kept as tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import folds, metrics, spatial
from ..sources import frames, sinks
from ..sources.tables import points, read_map, table, write_map
from ..streaming import state, voxels
from .queries import CELLS, JUDGED, POINTS, VOXEL, cells, judged, query


def r(c, name, digits=6):
    return F.round(c, digits).alias(name)


def folder(spark, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir or, in local mode only, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="evigrid-")
        atexit.register(shutil.rmtree, root, True)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT p_partkey AS source, p_size % 5 IN (0, 4) AS known FROM part")
def s5_known_layouts(spark, sf_dir):
    """Which sources pack their points as the fast decoder reads them: as it does, with a wider step, swapped, of another type, or with a further field."""
    good = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(o).alias("offset"), F.lit(t).alias("type")) for n, o, t in frames.LAYOUT))
    kind = F.col("p_size") % 5
    offset = lambda f: F.when((kind == 2) & (f["offset"] < 8), 4 - f["offset"]).otherwise(f["offset"]).cast("int")
    typed = lambda f: F.when((kind == 3) & (f["name"] == "x"), 8).otherwise(f["type"]).cast("int")
    fields = F.transform(good, lambda f: F.struct(f["name"].alias("name"), offset(f).alias("offset"), typed(f).alias("type")))
    more = F.when(kind == 4, F.array(F.struct(F.lit("ring").alias("name"), F.lit(24).alias("offset"), F.lit(4).alias("type")))).otherwise(F.slice(fields, 1, 0))
    clouds = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), F.when(kind == 1, 32).otherwise(24).alias("step"), F.concat(fields, more).alias("fields"))
    return frames.known_layout(clouds).select("source", "known")


@query(f"WITH {POINTS}, p AS (SELECT l_orderkey, l_linenumber, l_quantity::FLOAT::DOUBLE AS x, (l_extendedprice / 1000)::FLOAT::DOUBLE AS y, l_tax::FLOAT::DOUBLE AS u FROM lineitem) SELECT CAST(l_orderkey % 50 AS VARCHAR) AS frame, count(*) AS n, round(sum(x), 3) AS x, round(sum(y), 3) AS y, round(sum(u), 4) AS u FROM p GROUP BY 1")
def s3_k1_packed_points(spark, sf_dir):
    """Points packed into clouds of 24 bytes each, and read from them again."""
    line = table(spark, sf_dir, "lineitem")
    idx = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = line.select((F.col("l_orderkey") % 50).cast("string").alias("frame"), idx.alias("idx"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), F.lit(0.0).alias("z"), F.lit(255).cast("long").alias("rgb"), F.col("l_linenumber").cast("int").alias("label"), F.col("l_tax").cast("double").alias("uncertainty"))
    back = frames.decode_points(frames.encode_points(rows))
    return back.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), r(F.sum("x"), "x", 3), r(F.sum("y"), "y", 3), r(F.sum("uncertainty"), "u", 4))


@query("""WITH p AS (SELECT p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size::DOUBLE END AS x, p_partkey % 5 AS label, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size / 100.0 END AS c FROM part)
  SELECT id, CAST(CASE WHEN id % 3 = 0 THEN id % 2 ELSE label END AS INT) AS label, round(coalesce(c, 0.8), 6) AS confidence, round(1 - coalesce(c, 0.8), 6) AS uncertainty FROM p WHERE x IS NOT NULL""")
def s19_s20_display_points(spark, sf_dir):
    """Points as a display reads them, with defaults for what is missing."""
    k, size = F.col("p_partkey"), F.col("p_size")
    cloud = table(spark, sf_dir, "part").select(k.alias("id"), F.when(size % 7 != 0, size.cast("double")).otherwise(float("nan")).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z"), F.when(k % 3 != 0, k % 5).alias("label"), F.when(k % 4 != 0, size / 100.0).alias("confidence"))
    return frames.display_points(cloud, (F.col("id") % 2).cast("int")).select("id", "label", r(F.col("confidence"), "confidence"), r(F.col("uncertainty"), "uncertainty"))


@query(f"WITH {POINTS} SELECT class, count(*) AS n, round(avg(sqrt(x * x + y * y + z * z)), 4) AS range, round(avg(1 - CASE WHEN u > 0.5 THEN 0.3 ELSE u END), 6) AS confidence FROM pts WHERE x < 45 GROUP BY class")
def s4_f4_p4_semantic_points(spark, sf_dir):
    """Points with missing uncertainties and positions that aren't finite."""
    p = points(spark, sf_dir).select(F.when(F.col("x") < 45, F.col("x")).otherwise(float("inf")).alias("x"), "y", "z", F.col("class").alias("label"), F.when(F.col("u") <= 0.5, F.col("u")).alias("uncertainty"))
    return frames.semantic_points(p).groupBy(F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("range"), "range", 4), r(F.avg("confidence"), "confidence"))


@query(f"""WITH {POINTS}, o AS (SELECT CAST(floor(x / 2.0) AS INT) AS ix, CAST(floor(y / 4.0) AS INT) AS iy, CAST(floor(z / 1.0) AS INT) AS iz, ts, CASE WHEN class = 0 THEN ln(0.9 * 6) ELSE ln(0.01 * 6) END AS a0, CASE WHEN class = 3 THEN ln(0.9 * 6) ELSE ln(0.01 * 6) END AS a3 FROM pts)
  SELECT ix, iy, iz, count(*) AS n, {", ".join(f"round(list_reduce(list_prepend(0.0::DOUBLE, list(a{k} ORDER BY ts, a{k})), lambda h, a: least(greatest(h + a, -10), 10)), 6) AS h{k}" for k in (0, 3))} FROM o GROUP BY ix, iy, iz""")
def s17_label_ingest(spark, sf_dir):
    """Log-odds of voxels that labels alone made, clamped after each point."""
    p = spatial.voxelise(points(spark, sf_dir), VOXEL).withColumn("p", frames.label_probabilities(F.col("class"), 6)).withColumn("cell", F.struct("ix", "iy", "iz"))
    odds = [folds.clamped_fold(p, "cell", ["ts"], F.ln(F.col("p")[k] * 6), part=F.year("ts")).withColumnRenamed("h", f"h{k}") for k in (0, 3)]
    return odds[0].join(odds[1].drop("n"), "cell").select("cell.ix", "cell.iy", "cell.iz", "n", "h0", "h3")


@query("""WITH f AS (SELECT event_id, event_type, (epoch_us(ts) - (SELECT epoch_us(min(ts)) FROM events)) / 1e6 AS sec FROM events), w AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'depth' ELSE event_type END AS topic, (sec - 86400) / 2 AS p FROM f WHERE sec >= 86400 AND sec <= 5 * 86400),
  q AS (SELECT event_id, topic, p + CASE WHEN p > 3600 THEN 60 ELSE 0 END + CASE WHEN p > 7200 THEN 5 ELSE 0 END AS p FROM w) SELECT event_id, topic, CAST(t AS INT) AS turn, round(p + t * (SELECT max(p) FROM q), 3) AS play_at, epoch_us(TIMESTAMP '2030-01-01') + CAST(trunc((p + t * (SELECT max(p) FROM q)) * 1e6) AS BIGINT) AS stamp FROM q, (SELECT unnest(range(2)) AS t)""")
def s8_s9_replay(spark, sf_dir):
    """Four days of events at double speed, twice, with two pauses, one topic renamed, and stamps of the replay."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("topic"), "ts")
    out = frames.replay(e, "ts", 86400.0, 5 * 86400.0, 2.0, {"view": "depth"}, "topic", 2, ((3600.0, 60.0), (7200.0, 5.0)), "2030-01-01 00:00:00 UTC")
    return out.select("event_id", "topic", "turn", r(F.col("play_at"), "play_at", 3), F.unix_micros("ts").alias("stamp"))


MAP = f"WITH {CELLS} SELECT (ix + 0.5) * 2 AS x, (iy + 0.5) * 4 AS y, iz + 0.5 AS z, class, confidence FROM cells"


def placed(spark, sf_dir):
    return cells(spark, sf_dir).select(((F.col("ix") + 0.5) * 2).alias("x"), ((F.col("iy") + 0.5) * 4).alias("y"), (F.col("iz") + 0.5).alias("z"), "class", "confidence", F.col("n").alias("observations"))


@query(MAP)
def s11_text_map(spark, sf_dir):
    """The map written as text and read again."""
    path = folder(spark, "text-map")
    write_map(placed(spark, sf_dir), path)
    return read_map(spark, path)


@query(MAP.replace("class, confidence FROM", "class, confidence, n AS observations, 5.0 AS odds FROM"))
def s12_k13_saved_map(spark, sf_dir):
    """The map saved as cells and loaded again: evidence of 5 for the stored class."""
    path = folder(spark, "saved-map")
    frames.save_map(placed(spark, sf_dir), path)
    return frames.load_map(spark, path)


@query(f"SELECT 'ply' AS form, * FROM ({MAP}) UNION ALL SELECT 'pcd', * FROM ({MAP})")
def k9_clouds(spark, sf_dir):
    """The map as PLY and PCD files of a hundred points each, read again."""
    out = []
    for form in ("ply", "pcd"):
        path = folder(spark, form)
        sinks.write_cloud(sinks.coloured(placed(spark, sf_dir), "confidence"), path, form, 100)
        out.append(sinks.read_cloud(spark, path).withColumn("form", F.lit(form)))
    return out[0].unionByName(out[1])


@query(f"WITH {CELLS}, g AS (SELECT class, count(*) AS points, round(sum(CAST(round(confidence * 1e6) AS BIGINT)) / count(*)) / 1e6 AS mean_confidence FROM cells GROUP BY class) SELECT *, round(points / (SELECT sum(points) FROM g), 6) AS share FROM g")
def k11_a29_metadata(spark, sf_dir):
    """What stands in the metadata of a saved map."""
    return sinks.metadata(cells(spark, sf_dir))


@query(f"WITH {JUDGED} SELECT gt, {', '.join(f'count(*) FILTER (pred = {k}) AS {chr(34)}{k}{chr(34)}' for k in range(10))} FROM ok GROUP BY gt")
def k16_confusion_matrix(spark, sf_dir):
    """The confusion matrix as it goes to a CSV."""
    return metrics.csv_matrix(metrics.confusion(judged(spark, sf_dir), 10), 10)


@query(f"WITH {CELLS}, v AS (SELECT (ix + 0.5) * 2 AS x, (iy + 0.5) * 4 AS y, iz + 0.5 AS z, confidence AS cost FROM cells) SELECT x, y, z, cost, CAST(round(255 * cost) AS INT) AS r, CAST(round(255 * (1 - cost)) AS INT) AS g, 0 AS b FROM v WHERE sqrt((x - 20) ** 2 + (y - 40) ** 2 + (z - 5) ** 2) <= 12.5 AND cost >= 0.3")
def k7_cost_markers(spark, sf_dir):
    """Costly voxels near the robot."""
    return sinks.cost_markers(placed(spark, sf_dir).withColumnRenamed("confidence", "cost"), (20.0, 40.0, 5.0), 12.5)


@query(f"WITH {POINTS} SELECT CAST(floor(x / 2.0) AS INT) AS ix, CAST(floor(y / 4.0) AS INT) AS iy, CAST(floor(z / 1.0) AS INT) AS iz, class, count(*) AS n FROM pts GROUP BY ALL")
def t1_t5_streamed_map(spark, sf_dir):
    """The map that a stream of points, in three micro-batches, leaves as a table: the same as that of all points at once."""
    source, path = folder(spark, "points"), folder(spark, "map")
    points(spark, sf_dir).repartition(3).write.parquet(source)
    stream = spark.readStream.schema(points(spark, sf_dir).schema).option("maxFilesPerTrigger", 1).parquet(source)
    voxels.keep_map(stream, VOXEL, path, folder(spark, "state")).awaitTermination()
    return voxels.current(spark, path)


@query(f"""WITH {POINTS}, k AS (SELECT CAST(floor(x / 2.0) AS INT) AS ix, CAST(floor(y / 4.0) AS INT) AS iy, CAST(floor(z / 1.0) AS INT) AS iz, class, count(*) AS n FROM pts GROUP BY ALL), c AS (SELECT ix, iy, iz, round(max(n) / sum(n), 6) AS c FROM k GROUP BY ALL),
  cut AS (SELECT min(c) AS least FROM (SELECT c FROM c ORDER BY c DESC LIMIT 300)) SELECT k.* FROM k JOIN c USING (ix, iy, iz), cut WHERE c >= least""")
def t5_o3_capped_map(spark, sf_dir):
    """A streamed map of the 300 surest voxels."""
    source, path = folder(spark, "points"), folder(spark, "map")
    points(spark, sf_dir).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(points(spark, sf_dir).schema).parquet(source)
    voxels.keep_map(stream, VOXEL, path, folder(spark, "state"), most=300).awaitTermination()
    return voxels.current(spark, path)


@query("SELECT event_id, list_transform([0, 1, 2], lambda k: round(value / 100.0 * (k + 1) - k, 6)) AS logits, CAST(CASE WHEN value / 100.0 >= 1 THEN 2 ELSE 0 END AS INT) AS label FROM events WHERE event_type = 'view'")
def s18_inference(spark, sf_dir):
    """A model as a function over batches of frames; here a linear one of three classes."""

    def model(batch):
        import numpy as np
        import pandas as pd

        x = batch["value"].to_numpy()[:, None] / 100.0
        logits = np.round(x * np.arange(1, 4) - np.arange(3), 6)
        return pd.DataFrame({"event_id": batch["event_id"], "logits": list(logits), "label": np.where(x[:, 0] >= 1, 2, 0).astype("int32")})

    e = table(spark, sf_dir, "events").where("event_type = 'view'").select("event_id", "value")
    return frames.infer(e, model, "event_id long, logits array<double>, label int")


TRIPLES = "SELECT l.event_id AS id_0, v.event_id AS id_1, p.event_id AS id_2, greatest(abs(epoch_us(l.ts) - epoch_us(v.ts)), abs(epoch_us(l.ts) - epoch_us(p.ts))) / 1e6 AS gap FROM events l JOIN events v ON l.user_id = v.user_id AND abs(epoch_us(l.ts) - epoch_us(v.ts)) <= 3600000000 JOIN events p ON l.user_id = p.user_id AND abs(epoch_us(l.ts) - epoch_us(p.ts)) <= 3600000000 WHERE l.event_type = 'click' AND v.event_type = 'view' AND p.event_type = 'purchase'"


@query(TRIPLES)
def j2_t4_s1_stream_sync(spark, sf_dir):
    """Three streams of stamped frames, joined as they come: all tuples within an hour."""
    kinds, streams = ("click", "view", "purchase"), []
    for kind in kinds:
        source = folder(spark, kind)
        e = table(spark, sf_dir, "events").where(F.col("event_type") == kind)
        e = e.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))
        e.coalesce(1).write.parquet(source)
        streams.append(frames.stream_frames(spark, source, e.schema))
    path = folder(spark, "triples")
    out = state.sync_all(streams, "user_id", "1 hour", "100 days").select("id_0", "id_1", "id_2", "gap")
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", folder(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(path)
