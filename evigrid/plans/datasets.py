"""Queries of image datasets and array files, which Spark makes from the test tables first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..sources import images, parts
from ..sources.tables import table
from .connectors import MAP, folder, placed
from .queries import VECTORS, probabilities, query

CAMERA = {"nyuv2": "d / 1000.0", "sunrgbd": "CASE WHEN top > 100 THEN d / 10000.0 ELSE d END"}


@query(f"""WITH e AS (SELECT vec_id AS id, unnest(embedding[1:32]) AS v, unnest(range(32)) AS k FROM embeddings WHERE vec_id % 5 <> 0 AND vec_id % 4 <> 3), d AS (SELECT id, k, CAST(floor(abs(CAST(v AS DOUBLE)) * CASE WHEN id % 3 = 0 THEN 200 ELSE 9000 END) AS DOUBLE) AS d FROM e),
  t AS (SELECT *, max(d) OVER (PARTITION BY id) AS top FROM d)
  {" UNION ALL ".join(f"SELECT '{k}' AS dataset, 'v' || id AS stem, count(*) AS points, round(sum({f}), 6) AS depth, round(sum((k % 8 - {images.CAMERAS[k][2]}) * ({f}) / {images.CAMERAS[k][0]}), 5) AS x, id % 2 = 0 AS labelled FROM t WHERE d > 0 GROUP BY id" for k, f in CAMERA.items())}""")
def s6_s7_frames(spark, sf_dir):
    """Depth images of two kinds of dataset, by the stems that have an image and a depth; labels may be missing."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 32).alias("e"))
    i, name = F.col("id"), F.concat(F.lit("v"), F.col("id"))
    path = folder(spark, "dataset")
    depth = F.transform("e", lambda v: F.floor(F.abs(v.cast("double")) * F.when(i % 3 == 0, 200).otherwise(9000)).cast("double"))
    kinds = [
        e.where(i % 5 != 0).select(F.concat(F.lit("rgb/"), name, F.lit(".jpg")).alias("name"), F.lit(b"jpg").alias("content")),
        e.where(i % 4 != 3).select(F.concat(F.lit("depth/"), name, F.lit(".npy")).alias("name"), parts.array_file(depth, (4, 8), "u2").alias("content")),
        e.where(i % 2 == 0).select(F.concat(F.lit("label40/"), name, F.lit(".npy")).alias("name"), parts.array_file(depth, (4, 8), "u1").alias("content")),
    ]
    parts.write_files(reduce(DataFrame.unionByName, kinds), path)
    found = spark.read.format("frames").option("path", path).load()
    out = []
    for kind in CAMERA:
        d = images.depth_points(found, kind).groupBy("stem").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("depth"), 6).alias("depth"), F.round(F.sum("x"), 5).alias("x"))
        out.append(d.join(found.select("stem", F.col("label").isNotNull().alias("labelled")), "stem").withColumn("dataset", F.lit(kind)))
    return out[0].unionByName(out[1]).select("dataset", "stem", "points", "depth", "x", "labelled")


@query(f"""WITH {VECTORS}, s AS (SELECT id, label, CAST(list_position(p, list_max(p)) - 1 AS INT) AS pred FROM soft WHERE id % 3 <> 0 AND id % 7 <> 0) SELECT CAST(label AS INT) AS gt, pred, count(*) AS n FROM s GROUP BY ALL""")
def s10_j18_probability_maps(spark, sf_dir):
    """Probability maps against label images of the same stem; maps and labels without a partner are skipped."""
    p = probabilities(spark, sf_dir)
    i, name, path = F.col("id"), F.concat(F.lit("s"), F.col("id"), F.lit(".npy")), folder(spark, "maps")
    maps = p.where(i % 3 != 0).select(F.concat(F.lit("prob/"), name).alias("name"), parts.array_file(F.col("p"), (1, 1, 10), "f8").alias("content"))
    labels = p.where(i % 7 != 0).select(F.concat(F.lit("gt/"), name).alias("name"), parts.array_file(F.array("label"), (1, 1), "u1").alias("content"))
    parts.write_files(maps.unionByName(labels), path)
    found = spark.read.format("frames").options(path=path, folders="probability=prob,label=gt", required="probability,label").load()
    at = ["stem", "v", "u"]
    pred = images.pixels(found, "probability").groupBy(*at).agg(F.sort_array(F.collect_list(F.struct("c", "value"))).alias("p"))
    gt = images.pixels(found, "label").select(*at, F.col("value").cast("int").alias("gt"))
    both = pred.join(gt, at).select("gt", S.argmax(F.col("p.value")).alias("pred"))
    return both.groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("n"))


@query(MAP)
def k10_arrays(spark, sf_dir):
    """The map as numpy archives in parts, read back."""
    path = folder(spark, "arrays")
    parts.write_arrays(placed(spark, sf_dir).drop("observations").withColumnRenamed("class", "labels"), path)
    return parts.read_arrays(spark, path, "x double, y double, z double, labels int, confidence double").withColumnRenamed("labels", "class")


@query(MAP)
def s11_array_map(spark, sf_dir):
    """The map as .npy arrays of a few hundred cells each, read back."""
    path, numbers = folder(spark, "maps"), ("x", "y", "z", "class", "confidence")
    cells = placed(spark, sf_dir).withColumn("file", F.pmod(F.xxhash64("x", "y", "z"), F.lit(20)))
    rows = cells.groupBy("file").agg(F.flatten(F.collect_list(F.array(*(F.col(c).cast("double") for c in numbers)))).alias("a"))
    parts.write_files(rows.select(F.format_string("%d.npy", "file").alias("name"), parts.array_file(F.col("a"), (-1, 5), "f8").alias("content")), path)
    return parts.read_map_arrays(spark, path)


@query(MAP.replace("confidence FROM cells", "confidence::FLOAT::DOUBLE AS confidence, class * 40 AS r, 128 AS g, 0 AS b FROM cells"))
def k11_packed_map(spark, sf_dir):
    """The map as packed binary points with colours, read back."""
    path = folder(spark, "packed")
    cells = placed(spark, sf_dir).drop("observations").withColumns({"r": F.col("class") * 40, "g": F.lit(128), "b": F.lit(None).cast("int")})
    parts.write_packed(cells, path)
    return parts.read_packed(spark, path, 500)
