"""Sinks: point clouds as text, arrays, grids, reports, goals and coloured clouds. All but npz write in parts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, scalar


def cloud_lines(cells: DataFrame, form: str) -> DataFrame:
    """One text column: a point per row, as PLY or PCD write it. Rows without a position go; grey, class 0 and confidence 0.8 stand for what is missing."""
    points = cells.dropna(subset=["x", "y", "z"])
    rgb = [F.coalesce(c, F.lit(128)) for c in (F.col("r"), F.col("g"), F.col("b"))]
    rest = [F.coalesce("class", F.lit(0)), F.coalesce("confidence", F.lit(0.8))]
    if form == "ply":
        return points.select(F.format_string("%s %s %s %d %d %d %d %s", "x", "y", "z", *rgb, *rest).alias("value"))
    if form == "pcd":
        return points.select(F.format_string("%s %s %s %d %d %s", "x", "y", "z", geometry.pack_rgb(*rgb), *rest).alias("value"))
    raise ValueError(f"no such form: {form}")


def cloud_header(form: str, n: int) -> list[str]:
    """The lines above n points."""
    if form == "ply":
        fields = [f"property float {k}" for k in "xyz"] + [f"property uchar {k}" for k in ("red", "green", "blue")] + ["property int label", "property float confidence"]
        return ["ply", "format ascii 1.0", f"element vertex {n}", *fields, "end_header"]
    return ["VERSION 0.7", "FIELDS x y z rgb label confidence", "SIZE 4 4 4 4 4 4", "TYPE F F F U U F", "COUNT 1 1 1 1 1 1", f"WIDTH {n}", "HEIGHT 1", "VIEWPOINT 0 0 0 1 0 0 0", f"POINTS {n}", "DATA ascii"]


def write_cloud(cells: DataFrame, path: str, form: str = "ply", most: int = 1_000_000) -> int:
    """A folder of PLY or PCD files of about `most` points, each with its own header, so that any reader opens each; returns the number of points."""
    lines = cloud_lines(cells, form).cache()
    n = lines.count()

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(cloud_header(form, sum(b.num_rows for b in held)))], ["value"])
            yield from (pa.RecordBatch.from_arrays([b.column(0)], ["value"]) for b in held)

    lines.repartition(max(1, -(-n // most))).mapInArrow(head, "value string").write.text(path)
    lines.unpersist()
    return n


def read_cloud(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, class and confidence of what write_cloud() wrote."""
    fields = F.split("value", " ")
    rows = spark.read.text(path).where(F.col("value").rlike(r"^-?[0-9.][^ ]* -?[0-9.]+[^ ]* -?[0-9.]")).select(fields.alias("p"))
    return rows.select(*(F.col("p")[i].cast("double").alias(k) for i, k in enumerate("xyz")), F.element_at("p", -2).cast("int").alias("class"), F.element_at("p", -1).cast("double").alias("confidence"))


def write_npz(cells: DataFrame, path: str, most: int = 10_000_000) -> None:
    """positions, labels and confidences as one numpy archive, made by the driver; more than `most` cells are an error (write Parquet instead)."""
    import numpy as np

    if cells.count() > most:
        raise ValueError(f"more than {most} cells: write Parquet")
    a = cells.select("x", "y", "z", "class", "confidence").toPandas()
    np.savez_compressed(path, positions=a[["x", "y", "z"]].to_numpy(), labels=a["class"].to_numpy(), confidences=a["confidence"].to_numpy())


def write_report(metrics: DataFrame, path: str) -> None:
    """Benchmark or evaluation results as JSON lines."""
    metrics.coalesce(1).write.json(path)


def write_matrix(matrix: DataFrame, path: str) -> None:
    """A confusion matrix of few classes as one CSV."""
    matrix.coalesce(1).write.option("header", True).csv(path)


def metadata(cells: DataFrame) -> DataFrame:
    """Points and share of each class, and the mean confidence."""
    g = cells.groupBy("class").agg(F.count(F.lit(1)).alias("points"), scalar.mean_of_millionths(F.col("confidence")).alias("mean_confidence"))
    return g.withColumn("share", F.round(F.col("points") / F.lit(cells.select(F.count(F.lit(1))).scalar()), 6))


def cost_markers(voxels: DataFrame, centre: tuple[float, float, float], radius: float, least: float = 0.3) -> DataFrame:
    """Voxels (x, y, z, cost) worth showing: near the robot and costly, with a colour from green to red."""
    d = geometry.norm([F.col(k) - c for k, c in zip("xyz", centre, strict=True)])
    shown = voxels.where((d <= radius) & (F.col("cost") >= least))
    return shown.select("x", "y", "z", "cost", F.round(255 * F.col("cost")).cast("int").alias("r"), F.round(255 * (1 - F.col("cost"))).cast("int").alias("g"), F.lit(0).alias("b"))


def goal_markers(goals: DataFrame) -> DataFrame:
    """Goals (rank, x, y, z, qw..qz, utility) as poses; the first is the one to drive to."""
    return goals.select("rank", F.struct("x", "y", "z").alias("position"), F.struct("qw", "qx", "qy", "qz").alias("orientation"), (F.col("rank") == 1).alias("best"), "utility")


def ramp(v: Column) -> list[Column]:
    """Blue at 0, green at 0.5, red at 1."""
    clipped = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return [F.round(255 * F.greatest(F.lit(0.0), 2 * clipped - 1)).cast("int"), F.round(255 * (1 - F.abs(2 * clipped - 1))).cast("int"), F.round(255 * F.greatest(F.lit(0.0), 1 - 2 * clipped)).cast("int")]


def coloured(cells: DataFrame, by: str, palette: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """cells with r, g, b by class (grey outside the palette), uncertainty (1 - confidence) or confidence."""
    if by == "class":
        names = zip("rgb", range(3), strict=True)
        table = F.array(*(F.array(*map(F.lit, c)) for c in palette or []))
        colour = F.when((F.col("class") >= 0) & (F.col("class") < len(palette or [])), F.try_element_at(table, F.col("class") + 1))
        return cells.withColumns({n: F.coalesce(colour[i], F.lit(128)) for n, i in names})
    value = {"uncertainty": 1 - F.col("confidence"), "confidence": F.col("confidence")}[by]
    return cells.withColumns(dict(zip("rgb", ramp(value), strict=True)))
