"""Queries that a client asks of a map: points, regions, summaries, loading with a transform, resets.

A map has rows ix, iy, iz, n (observations), class, confidence and p (class probabilities).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, scalar
from . import maps, spatial

Box = tuple[tuple[int, int, int], tuple[int, int, int]]


def evidence_cells(points: DataFrame, size: tuple[float, float, float], classes: int) -> DataFrame:
    """The voxel map of points with class shares as probabilities."""
    counts = [F.count_if(F.col("class") == k).alias(f"c{k}") for k in range(classes)]
    grid = spatial.voxelise(points, size).groupBy("ix", "iy", "iz").agg(F.count(F.lit(1)).alias("n"), *counts)
    p = F.array(*(F.col(f"c{k}") / F.col("n") for k in range(classes)))
    out = grid.select("ix", "iy", "iz", "n", p.alias("p"))
    return out.select("ix", "iy", "iz", "n", scalar.argmax(F.col("p")).alias("class"), F.array_max("p").alias("confidence"), "p")


def nav_cost(free: list[int], avoided: list[int]) -> Column:
    """0 on classes to walk on, 100 on those to avoid and where the class is sure, else -1 (not decided)."""
    return F.when(F.col("class").isin(*free), 0).when(F.col("class").isin(*avoided) | (F.col("confidence") > 0.5), 100).otherwise(-1)


def centres(cells: DataFrame, *rest: str) -> DataFrame:
    """Cells as points (x, y, z in cells) with their key as id."""
    return cells.select(maps.cell_key().alias("id"), *((F.col(f"i{k}") + 0.5).alias(k) for k in "xyz"), *rest)


def nearest_traversable(points: DataFrame, cells: DataFrame, free: list[int], most: float) -> DataFrame:
    """(id, cell, distance): for each point (id, x, y, z) the nearest cell of a free class nearer than most, or nulls."""
    found = spatial.nearest(points.select("id", "x", "y", "z"), centres(cells.where(F.col("class").isin(*free))), most)
    return found.select("id", F.col("nearest").alias("cell"), "distance")


def query_points(points: DataFrame, cells: DataFrame, free: list[int], avoided: list[int], radius: float = 0.0, reach: float = 6.0) -> DataFrame:
    """What the map knows at each point (id, x, y, z, in cells).

    The cell that holds the point; with a radius, where that is unknown, the nearest known cell within it. found tells whether
    there is one; neighbours counts known cells within the radius. reachability falls with the distance to the nearest cell to
    walk on, to 0 beyond reach; obstacle is the distance to the nearest obstacle, however far.
    """
    known = cells.withColumn("nav_cost", nav_cost(free, avoided)).withColumn("cell", maps.cell_key())
    at = points.select("id", "x", "y", "z", *(F.floor(k).cast("int").alias(f"i{k}") for k in "xyz"))
    exact = at.join(known.select("ix", "iy", "iz", "cell"), ["ix", "iy", "iz"], "left").select("id", F.col("cell").alias("exact"))
    if radius > 0:
        pairs = spatial.radius_pairs(points.select("id", "x", "y", "z"), centres(cells), radius)
        near = pairs.groupBy("id").agg(F.min(F.struct("d2", "other_id"))["other_id"].alias("near"), F.count(F.lit(1)).alias("neighbours"))
    else:
        near = points.select("id", F.lit(None).cast("long").alias("near"), F.lit(0).cast("long").alias("neighbours"))
    chosen = exact.join(near, "id", "left").select("id", F.coalesce("exact", "near").alias("cell"), F.coalesce("neighbours", F.lit(0)).alias("neighbours"))
    blocked = spatial.nearest_of_all(points.select("id", "x", "y", "z"), centres(known.where((F.col("nav_cost") == 100) & (F.col("confidence") >= 0.5))), 2.0)
    walk = nearest_traversable(points, cells, free, reach)
    out = chosen.join(known.drop("id"), "cell", "left").join(blocked.select("id", F.col("distance").alias("obstacle")), "id", "left").join(walk.select("id", F.col("distance").alias("walk")), "id", "left")
    seen = F.col("n").isNotNull()
    return out.select(
        "id",
        seen.alias("found"),
        "class",
        "p",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce(1 - F.col("confidence"), F.lit(1.0)).alias("uncertainty"),
        F.coalesce(scalar.entropy(F.col("p")), F.lit(1.0)).alias("entropy"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce(F.col("class").isin(*free), F.lit(False)).alias("traversable"),
        F.coalesce((F.col("nav_cost") == 100) & (F.col("confidence") >= 0.5), F.lit(False)).alias("occupied"),
        F.coalesce("nav_cost", F.lit(-1)).alias("nav_cost"),
        F.coalesce(F.exp(-F.col("walk")), F.lit(0.0)).alias("reachability"),
        "obstacle",
        "neighbours",
        *((F.col(f"i{k}") + 0.5).alias(f"cell_{k}") for k in "xyz"),
    )


def share(part: Column, whole: Column) -> Column:
    """part / whole, NaN of nothing."""
    return F.when(whole > 0, part / whole).otherwise(float("nan"))


def region(cells: DataFrame, box: Box, classes: int, free: list[int], avoided: list[int], only: list[int] | None = None, least: float = 0.0) -> DataFrame:
    """One row about the cells of a box (both ends included) of the wanted classes and confidence: counts, dominant class (the lowest of equals) and its share, counts by class, means, coverage of the box, centroid.

    Where no cell is wanted, all classes are equal (at 0), the share is NaN, and means and centroid are null.
    """
    inside = cells.where(maps.inside(*box) & (F.col("confidence") >= least))
    if only is not None:
        inside = inside.where(F.col("class").isin(*only))
    cost = nav_cost(free, avoided)
    volume = 1
    for a, b in zip(*box, strict=True):
        volume *= b - a + 1
    counts = F.array(*(F.count_if(F.col("class") == k) for k in range(classes)))
    g = inside.agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(F.col("n") > 0).alias("observed"),
        F.count_if(F.col("class").isin(*free)).alias("traversable"),
        F.count_if((cost == 100) & (F.col("confidence") >= 0.5)).alias("obstacles"),
        counts.alias("class_counts"),
        F.avg("confidence").alias("mean_confidence"),
        *(F.avg(F.col(f"i{k}") + 0.5).alias(f"centroid_{k}") for k in "xyz"),
    )
    most = F.array_max("class_counts")
    return g.select(
        "cells", "observed", "traversable", "obstacles",
        scalar.argmax(F.col("class_counts")).alias("dominant"),
        share(most, F.col("cells")).alias("dominant_share"),
        "class_counts", "mean_confidence",
        (1 - F.col("mean_confidence")).alias("mean_uncertainty"),
        (F.col("observed") / volume).alias("coverage"),
        "centroid_x", "centroid_y", "centroid_z",
    )


#: Bytes of a cell in memory: three indices, a count, a class, a confidence, and eight for each class probability.
CELL_BYTES = 40


def map_info(cells: DataFrame, grid: tuple[int, int, int], classes: int, free: list[int], avoided: list[int]) -> DataFrame:
    """One row about the whole map; grid: its size in cells."""
    total, cost, c = grid[0] * grid[1] * grid[2], nav_cost(free, avoided), F.col("confidence")
    counts = F.array(*(F.count_if(F.col("class") == k) for k in range(classes)))
    g = cells.agg(
        F.count(F.lit(1)).alias("known"),
        F.count_if(cost == 100).alias("occupied"),
        F.count_if(cost == 0).alias("free"),
        F.count_if(F.col("class").isin(*free)).alias("traversable"),
        F.count_if((cost == 100) & (c >= 0.5)).alias("obstacles"),
        F.min(c).alias("min_confidence"), F.avg(c).alias("mean_confidence"), F.max(c).alias("max_confidence"),
        F.sum("n").alias("observations"), F.avg("n").alias("mean_observations"), F.max("n").alias("max_observations"),
        counts.alias("class_counts"),
    )
    return g.select(
        F.lit(total).cast("long").alias("total"), "known", (total - F.col("known")).alias("unknown"), "occupied", "free", "traversable", "obstacles",
        (F.col("known") / total).alias("coverage"),
        "min_confidence", "mean_confidence", "max_confidence",
        (1 - F.col("max_confidence")).alias("min_uncertainty"), (1 - F.col("mean_confidence")).alias("mean_uncertainty"), (1 - F.col("min_confidence")).alias("max_uncertainty"),
        "observations", "mean_observations", "max_observations", "class_counts",
        F.transform("class_counts", lambda n: share(n, F.col("known"))).alias("class_shares"),
        (F.col("known") * (CELL_BYTES + 8 * classes)).alias("bytes"),
    )


def moved(cells: DataFrame, turn: tuple[float, float, float, float], shift: tuple[float, float, float], size: tuple[float, float, float]) -> DataFrame:
    """A map (ix, iy, iz, class, confidence) after a rigid transform of its cells' centres: turn as a quaternion (w, x, y, z), shift in metres. Of cells that meet, the surest stays (the lowest class of equals)."""
    at = [(F.col(f"i{k}") + 0.5) * s for k, s in zip("xyz", size, strict=True)]
    new = geometry.transform([F.lit(float(q)) for q in turn], [F.lit(float(s)) for s in shift], at)
    out = cells.select(*(F.floor(F.round(v, 9) / s).cast("int").alias(f"i{k}") for v, k, s in zip(new, "xyz", size, strict=True)), "class", "confidence")
    best = out.groupBy("ix", "iy", "iz").agg(F.max(F.struct("confidence", (-F.col("class")).alias("minus"))).alias("b"))
    return best.select("ix", "iy", "iz", (-F.col("b.minus")).alias("class"), "b.confidence")


def reset(cells: DataFrame, mode: str, box: Box | None = None) -> DataFrame:
    """The map after a reset: full (no cells), partial (none in the box), or soft: cells stay, without observations, class (-1) and confidence."""
    if mode == "full":
        return cells.limit(0)
    if mode == "partial":
        return maps.reset(cells, *box)
    if mode != "soft":
        raise ValueError(f"no such reset: {mode}")
    return cells.withColumns({"n": F.lit(0).cast("long"), "class": F.lit(-1), "confidence": F.lit(0.0)})


def support(prims: DataFrame, points: DataFrame, length: float) -> DataFrame:
    """(id, prim): points whose Mahalanobis distance to a primitive is below the length. Primitives are joined by classes of reach (spatial.by_reach())."""
    names = ("cxx", "cxy", "cxz", "cyy", "cyz", "czz")
    reach = length * F.sqrt(geometry.eigenvalues([F.col(c) for c in names])[2])
    pairs = spatial.by_reach(points.select("id", "x", "y", "z"), prims.select("id", "x", "y", "z", *names, reach.alias("reach")).where("reach > 0"))
    if pairs is None:
        return prims.select("id", F.col("id").alias("prim")).limit(0)
    d = geometry.mahalanobis([F.col(f"other_{c}") for c in names], [F.col(k) - F.col(f"other_{k}") for k in "xyz"])
    return pairs.where(d < length).select("id", F.col("other_id").alias("prim"))


def palette(relevant: list[int], colours: list[tuple[int, int, int]], other: tuple[int, int, int] = (255, 165, 0)) -> list[tuple[int, int, int]]:
    """Colours of the compact classes: those of the sorted relevant ones (other's for classes without one), then other's."""
    return [*(colours[k] if 0 <= k < len(colours) else other for k in sorted(set(relevant))), other]


def legend(names: list[str], colours: list[tuple[int, int, int]], cells: DataFrame) -> DataFrame:
    """(class, name, r, g, b, cells): what a display needs beside a coloured map; classes without cells, too."""
    rows = [(k, n, *c) for k, (n, c) in enumerate(zip(names, colours, strict=True))]
    table = cells.sparkSession.createDataFrame(rows, "class int, name string, r int, g int, b int")
    counted = cells.groupBy("class").agg(F.count(F.lit(1)).alias("cells"))
    return table.join(counted, "class", "left").na.fill(0, ["cells"])


def frontier_markers(frontier: DataFrame, goals: DataFrame) -> DataFrame:
    """(kind, id, x, y, z, scale): a point for each frontier cell and an arrow for each goal (rank, x, y, z, utility), the best one twice as large."""
    points = frontier.select(F.lit("frontier").alias("kind"), maps.cell_key().alias("id"), *((F.col(f"i{k}") + 0.5).alias(k) for k in "xyz"), F.lit(1.0).alias("scale"))
    arrows = goals.select(F.lit("goal").alias("kind"), F.col("rank").cast("long").alias("id"), *(F.col(k).cast("double").alias(k) for k in "xyz"), F.when(F.col("rank") == 1, 2.0).otherwise(1.0).alias("scale"))
    return points.unionByName(arrows)
