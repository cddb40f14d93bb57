"""Rays and views over a map of obstacle cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry


def _key(names, res: float):
    return {f"i{k}": F.floor(c / res).cast("int") for k, c in zip("xyz", names, strict=True)}


def blocked(rays: DataFrame, ids: list[str], obstacles: DataFrame, res: float) -> DataFrame:
    """ids of rays from (x, y, z) to (tx, ty, tz) that pass an obstacle cell (ix, iy, iz). Each ray is sampled every half cell, its ends left out."""
    step = res * 0.5
    d = [F.col(f"t{k}") - F.col(k) for k in "xyz"]
    long = rays.withColumn("len", geometry.norm(d)).where(F.col("len") >= 1e-10)
    last = F.ceil((F.col("len") - step) / step) - 1
    at = long.withColumn("last", last).where("last >= 1").withColumn("s", F.explode(F.transform(F.sequence(F.lit(1), F.col("last").cast("int")), lambda i: i * F.lit(step))))
    keys = _key([F.col(k) + c / F.col("len") * F.col("s") for k, c in zip("xyz", d, strict=True)], res)
    passed = at.select(*ids, *(v.alias(k) for k, v in keys.items())).distinct()
    return passed.join(obstacles.select("ix", "iy", "iz"), ["ix", "iy", "iz"], "left_semi").select(*ids).distinct()


def clear(rays: DataFrame, ids: list[str], obstacles: DataFrame, res: float) -> DataFrame:
    """Rays that no obstacle blocks."""
    return rays.join(blocked(rays, ids, obstacles, res), ids, "left_anti")


def visible(views: DataFrame, obstacles: DataFrame, res: float, reach: float, horizontal: float, vertical: float, rise: float = 1.0) -> DataFrame:
    """(id, ix, iy, iz): cells that each view (id, x, y, z, qw, qx, qy, qz) sees, one row for each point of its lattice.

    The lattice has the map's spacing and starts at the view itself, so it need not be the map's grid.
    """
    across, up = round(2 * reach / res), round(2 * rise / res)
    rays = views
    for k, n, low in (("x", across, reach), ("y", across, reach), ("z", up, rise)):
        rays = rays.withColumn(f"g{k}", F.explode(F.sequence(F.lit(0), F.lit(n)))).withColumn(f"t{k}", F.col(k) - low + F.col(f"g{k}") * res)
    q = [F.col(f"q{k}") for k in "wxyz"]
    rays = rays.where(geometry.in_view(q, [F.col(k) for k in "xyz"], [F.col(f"t{k}") for k in "xyz"], reach, horizontal, vertical))
    seen = clear(rays, ["id", "gx", "gy", "gz"], obstacles, res)
    return seen.select("id", *(v.alias(k) for k, v in _key([F.col(f"t{k}") for k in "xyz"], res).items()))


def gains(seen: DataFrame, cells: DataFrame) -> DataFrame:
    """Per view: expected information (entropy, 1 for unknown cells), unknown cells, mean entropy of known ones, and half the mean doubt."""
    known = cells.select("ix", "iy", "iz", "entropy", "confidence")
    e, c = F.col("entropy"), F.col("confidence")
    return (
        seen.join(known, ["ix", "iy", "iz"], "left")
        .groupBy("id")
        .agg(
            F.count(F.lit(1)).alias("seen"),
            F.round(F.sum(F.coalesce(e, F.lit(1.0))), 5).alias("emi"),
            F.count_if(e.isNull()).alias("unknown"),
            F.round(F.coalesce(F.avg(e), F.lit(0.0)), 6).alias("semantic"),
            F.round(0.5 * F.avg(F.coalesce(1 - c, F.lit(1.0))), 6).alias("reduction"),
        )
    )


def unsafe(goals: DataFrame, obstacles: DataFrame, res: float, margin: float) -> DataFrame:
    """ids of goals (id, x, y, z) with an obstacle in the square of half width margin, sampled at the map's spacing."""
    n = round(2 * margin / res)
    offsets = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: i * res))
    near = goals.withColumn("ox", offsets).withColumn("oy", offsets).withColumns({f"n{k}": F.col(k) - margin + F.col(f"o{k}") for k in "xy"})
    keys = _key([F.col("nx"), F.col("ny"), F.col("z")], res)
    return near.select("id", *(v.alias(k) for k, v in keys.items())).join(obstacles.select("ix", "iy", "iz"), ["ix", "iy", "iz"], "left_semi").select("id").distinct()
