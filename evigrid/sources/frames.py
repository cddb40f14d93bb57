"""Sources of frames: packed point clouds, image datasets, label arrays, saved maps, and replay."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Layout of a packed point, 24 bytes. Fixed by the wire format.
POINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("rgb", "<u4"), ("label", "<u4"), ("uncertainty", "<f4")])

#: Codes of field types in the wire format. Fixed values.
FLOAT32, UINT32 = 7, 6

#: Name, offset and type of a packed point's fields.
LAYOUT = tuple((name, POINT.fields[name][1], UINT32 if name in ("rgb", "label") else FLOAT32) for name in POINT.names)

POINT_SCHEMA = "frame string, idx int, x double, y double, z double, rgb long, label int, uncertainty double"


def known_layout(clouds: DataFrame) -> DataFrame:
    """clouds (step int, fields array of (name, offset, type)) with `known`: whether points are packed as decode_points() reads them. Checked once per source; fields of other names don't matter."""
    layout = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(o).alias("offset"), F.lit(t).alias("type")) for n, o, t in LAYOUT))
    wrong = F.exists("fields", lambda f: F.exists(layout, lambda k: (k["name"] == f["name"]) & ((k["offset"] != f["offset"]) | (k["type"] != f["type"]))))
    return clouds.withColumn("known", (F.col("step") == POINT.itemsize) & (F.size("fields") >= len(LAYOUT)) & ~wrong)


#: Points of one part of a packed cloud, and of one batch that is read from one.
PART = 1 << 16


def decode_points(clouds: DataFrame) -> DataFrame:
    """Points of packed clouds (frame, data binary): a row each, without points that aren't finite. A length that is no multiple of 24 is an error.

    idx is a point's place in its cloud; where clouds come in parts, their column `first` is the place of a part's first point.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for frame, first, data in zip(b["frame"], b["first"], b["data"], strict=True):
                points = np.frombuffer(data or b"", POINT)
                for at in range(0, len(points), PART):
                    a = points[at : at + PART]
                    ok = np.isfinite(a["x"]) & np.isfinite(a["y"]) & np.isfinite(a["z"])
                    yield pd.DataFrame({"frame": frame, "idx": np.flatnonzero(ok) + first + at, **{k: a[k][ok] for k in POINT.names}})

    first = F.col("first") if "first" in clouds.columns else F.lit(0).cast("long")
    return clouds.select("frame", first.alias("first"), "data").mapInPandas(decode, POINT_SCHEMA)


def encode_points(points: DataFrame) -> DataFrame:
    """(frame, first, data): packed clouds in parts of at most PART points, a frame's points in order of idx. first: how many come before a part's; a frame's data joined in this order is its cloud.

    Spark sorts by frame and idx over all tasks, so a task holds one part at a time and a frame may have any size. The packed parts are cut by
    checkpoint(); of each, one short row is counted and broadcast.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, now, part = [], 0, None, 0
        out = lambda: pd.DataFrame({"frame": [now], "task": [task], "part": [part], "n": [size], "data": [b"".join(held)]})
        for b in batches:
            frames, task = b["frame"].to_numpy(), int(b["task"].iloc[0]) if len(b) else 0
            a = np.zeros(len(b), POINT)
            for k in POINT.names:
                a[k] = b[k].to_numpy()
            at = 0
            while at < len(a):
                same = frames[at:] == frames[at]
                end = at + (len(same) if same.all() else int(np.argmin(same)))
                if size and (size == PART or frames[at] != now):
                    yield out()
                    held, size, part = [], 0, part + 1
                now, end = frames[at], min(end, at + PART - size)
                held.append(a[at:end].tobytes())
                size, at = size + end - at, end
        if size:
            yield out()

    rows = points.select("frame", "idx", *POINT.names).repartitionByRange("frame", "idx").sortWithinPartitions("frame", "idx")
    packed = rows.withColumn("task", F.spark_partition_id()).mapInPandas(encode, "frame string, task int, part long, n long, data binary").checkpoint()
    before = Window.partitionBy("frame").orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("first")
    firsts = packed.select("task", "part", first)
    return packed.join(F.broadcast(firsts), ["task", "part"]).select("frame", "first", "data")


def semantic_points(cloud: DataFrame) -> DataFrame:
    """x, y, z, label, uncertainty (0.3 if missing), confidence and range of a cloud with any columns. Without x, y or z it raises an error; rows whose position isn't finite go."""
    missing = [k for k in "xyz" if k not in cloud.columns]
    if missing:
        raise ValueError(f"a cloud needs the fields {', '.join(missing)}")
    has = lambda c, otherwise: F.coalesce(c, F.lit(otherwise)) if c in cloud.columns else F.lit(otherwise)
    u = has("uncertainty", 0.3).cast("double")
    out = cloud.select(*(F.col(k).cast("double").alias(k) for k in "xyz"), has("label", 0).cast("int").alias("label"), u.alias("uncertainty"))
    for k in "xyz":
        out = out.where(F.col(k).isNotNull() & ~F.isnan(k) & (F.abs(k) != float("inf")))
    return out.withColumn("confidence", 1 - F.col("uncertainty")).withColumn("range", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))


def files(spark: SparkSession, folder: str, extensions: tuple[str, ...]) -> DataFrame:
    """(stem, path, content) of a folder's files; of equal stems the first extension named wins."""
    rank = F.lit(len(extensions))
    for i, e in enumerate(extensions):
        rank = F.when(F.lower("ext") == e, i).otherwise(rank)
    found = spark.read.format("binaryFile").load(folder).select("path", "content", F.regexp_extract("path", r"([^/]+)\.([^./]+)$", 1).alias("stem"), F.regexp_extract("path", r"([^/]+)\.([^./]+)$", 2).alias("ext"))
    best = found.where(rank < len(extensions)).groupBy("stem").agg(F.min(F.struct(rank.alias("rank"), "path")).alias("b")).select("b.path")
    return found.join(best, "path", "left_semi").select("stem", "path", "content")


def dataset(spark: SparkSession, root: str, rgb: str = "rgb", depth: str = "depth", label: str | None = "label40") -> DataFrame:
    """Frames of an image dataset by file stem: rgb and depth must both exist, label may be null. Columns stem, rgb, depth, label."""
    images, maps = files(spark, f"{root}/{rgb}", ("png", "jpg", "jpeg")), files(spark, f"{root}/{depth}", ("png", "npy"))
    out = images.select("stem", F.col("content").alias("rgb")).join(maps.select("stem", F.col("content").alias("depth")), "stem")
    if label is None:
        return out.withColumn("label", F.lit(None).cast("binary"))
    return out.join(files(spark, f"{root}/{label}", ("png", "npy", "mat")).select("stem", F.col("content").alias("label")), "stem", "left")


def infer(frames: DataFrame, backend: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A segmentation model as an operator: backend maps a batch of frames to rows of schema (logits, labels, uncertainties)."""
    return frames.mapInPandas(lambda batches: (backend(b) for b in batches), schema)


def load_map(spark: SparkSession, path: str, odds: float = 5.0) -> DataFrame:
    """Cells of a map saved as text of one `key: value` a line, a cell starting with `- `: x, y, z, class, confidence, observations, and log-odds of the class."""
    text = spark.read.text(path, wholetext=True)
    block = F.explode(F.split("value", r"(?m)^\s*- ")).alias("block")
    number = lambda k: F.regexp_extract("block", rf"\b{k}:\s*(-?[0-9.eE+-]+)", 1)
    point = [F.regexp_extract("block", r"position:\s*\[([^\],]+),([^\],]+),([^\]]+)\]", i) for i in (1, 2, 3)]
    cells = text.select(block).where(F.col("block").contains("position:"))
    return cells.select(*(F.trim(c).cast("double").alias(k) for c, k in zip(point, "xyz", strict=True)), number("class").cast("int").alias("class"), number("confidence").cast("double").alias("confidence"), number("observations").cast("long").alias("observations"), F.lit(odds).alias("odds"))


def save_map(cells: DataFrame, path: str) -> None:
    """The form that load_map reads, in parts."""
    line = F.format_string("- position: [%s, %s, %s]\n  class: %d\n  confidence: %s\n  observations: %d", "x", "y", "z", "class", "confidence", "observations")
    cells.select(line).write.text(path)


def replay(
    df: DataFrame, ts: str, start: float = 0.0, end: float | None = None, rate: float = 1.0, rename: dict[str, str] | None = None, topic: str | None = None, loops: int = 1, pauses: tuple[tuple[float, float], ...] = (), now: str | None = None
) -> DataFrame:
    """Rows between start and end seconds after the first, with play_at: seconds after the start at that rate. rename maps topics.

    loops: how often the window is played, one time after the other (a column `turn`). pauses: (played seconds, length), each
    in every turn; a step is a pause that ends with the next row. now: the moment of the start; stamps are then those of playing.
    """
    first = df.agg(F.min(ts)).scalar()
    at = F.timestamp_diff("MICROSECOND", first.cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz")) / 1e6
    out = df.withColumn("play_at", (at - start) / rate).where(at >= start)
    if end is not None:
        out = out.where(at <= end)
    if topic and rename:
        new = F.col(topic)
        for a, b in rename.items():
            new = F.when(F.col(topic) == a, b).otherwise(new)
        out = out.withColumn(topic, new)
    played = F.col("play_at")
    for after, length in pauses:
        played = played + F.when(F.col("play_at") > after, length).otherwise(0.0)
    out = out.withColumn("play_at", played)
    if loops > 1:
        length = out.agg(F.max("play_at")).scalar()
        out = out.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(loops - 1)))).withColumn("play_at", F.col("play_at") + F.col("turn") * length)
    if now:
        out = out.withColumn(ts, F.timestamp_micros(F.unix_micros(F.lit(now).cast("timestamp")) + (F.col("play_at") * 1e6).cast("long")))
    return out


def display_points(cloud: DataFrame, nearest: Column | None = None) -> DataFrame:
    """cloud as a display reads it: label by its field, else by `nearest` (the class of the nearest palette colour), else 0; confidence 0.8 and uncertainty 1 - confidence where they are missing; rows without a finite position go."""
    has = lambda c: F.col(c) if c in cloud.columns else F.lit(None)
    out = cloud.withColumn("label", F.coalesce(has("label").cast("int"), F.lit(None).cast("int") if nearest is None else nearest, F.lit(0)))
    out = out.withColumn("confidence", F.coalesce(has("confidence").cast("double"), F.lit(0.8)))
    out = out.withColumn("uncertainty", F.coalesce(has("uncertainty").cast("double"), 1 - F.col("confidence")))
    for k in "xyz":
        out = out.where(F.col(k).isNotNull() & ~F.isnan(k) & (F.abs(k) != float("inf")))
    return out


def label_probabilities(label: Column, classes: int, hit: float = 0.9, miss: float = 0.01) -> Column:
    """What a label alone says of each class (not a distribution: its sum isn't 1)."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.when(k == label, hit).otherwise(miss))


def last_info(info: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key that came last: a camera's intrinsics, a robot's pose."""
    rest = [c for c in info.columns if c != key]
    return info.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(key, "row.*")


def stream_frames(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1) -> DataFrame:
    """Parquet frames of a folder as a stream, so many files a trigger; with a trigger every 1 / rate seconds (run()'s `every`), a replay at that rate."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
