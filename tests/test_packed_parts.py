from pyspark.sql import functions as F

from evigrid.sources import frames


def test_a_frame_of_many_parts(spark, monkeypatch):
    """No part is larger than its limit, however large a frame is, and a frame's parts hold its points in order of idx."""
    monkeypatch.setattr(frames, "PART", 64)
    n = 1000
    k = F.col("id")
    rows = spark.range(n).select(F.when(k < 900, "a").when(k < 999, "b").alias("frame"), ((n - k) * 7).alias("idx"), *((k / m).alias(c) for c, m in zip("xyz", (1, 2, 4), strict=True)), k.alias("rgb"), (k % 5).cast("int").alias("label"), (k / 1024).alias("uncertainty"))
    parts = frames.encode_points(rows).collect()
    assert max(len(p["data"]) for p in parts) == 24 * 64 and len(parts) < 40
    for frame, ids in (("a", range(899, -1, -1)), ("b", range(998, 899, -1)), (None, [999])):
        own = sorted((p["first"], bytes(p["data"])) for p in parts if p["frame"] == frame)
        assert [f for f, _ in own] == [sum(len(d) // 24 for _, d in own[:i]) for i in range(len(own))]
        got = frames.decode_points(spark.createDataFrame([(frame, b"".join(d for _, d in own))], "frame string, data binary")).orderBy("idx").collect()
        assert [(r["frame"], r["idx"], r["rgb"]) for r in got] == [(frame, i, k) for i, k in enumerate(ids)]
    back = frames.decode_points(frames.encode_points(rows)).orderBy("frame", "idx").collect()
    assert [r["rgb"] for r in back] == [999, *range(899, -1, -1), *range(998, 899, -1)]
    assert [r["idx"] for r in back] == [0, *range(900), *range(99)]


def test_equal_points_of_one_frame_go_into_parts(spark, monkeypatch):
    monkeypatch.setattr(frames, "PART", 64)
    rows = spark.range(500).select(F.lit("a").alias("frame"), F.lit(0).alias("idx"), *(F.lit(1.0).alias(c) for c in "xyz"), F.lit(1).cast("long").alias("rgb"), F.lit(2).alias("label"), F.lit(0.5).alias("uncertainty"))
    parts = frames.encode_points(rows)
    assert parts.where(F.octet_length("data") > 24 * 64).count() == 0 and frames.decode_points(parts).count() == 500
