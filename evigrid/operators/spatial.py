"""Voxel grids and bucketed spatial joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from . import neighbours, ranks


def cell(c: Column, size: float, origin: float = 0.0) -> Column:
    return F.floor((c - origin) / size).cast("int")


def voxelise(df: DataFrame, size: tuple[float, float, float]) -> DataFrame:
    """df with ix, iy, iz."""
    return df.withColumns({f"i{k}": cell(F.col(k), s) for k, s in zip("xyz", size, strict=True)})


def class_evidence(df: DataFrame, size: tuple[float, float, float], classes: int) -> DataFrame:
    """One row per voxel: points, most frequent class (the lowest of equals) and its share. One aggregation, combined on the map side."""
    counts = [F.count_if(F.col("class") == k).alias(f"c{k}") for k in range(classes)]
    grid = voxelise(df, size).groupBy("ix", "iy", "iz").agg(F.count(F.lit(1)).alias("n"), *counts)
    each = F.array(*(f"c{k}" for k in range(classes)))
    return grid.select("ix", "iy", "iz", "n", scalar.argmax(each).alias("class"), F.round(F.array_max(each) / F.col("n"), 6).alias("confidence"))


#: Rows of left that one task meets at most in a cell, about, and the number of cells that can be told to be dense: each holds
#: more than 1 / DENSE of all rows.
SHARE, DENSE = 4096, 1000


def radius_pairs(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of rows (id, x, y, z, and others) closer than radius: equi-join on cells of that size, of which right fills 27.

    Columns of right get the prefix other_. A pair of different ids appears once. The rows of a dense cell of left are dealt to
    many tasks, each of which gets the cell's rows of right; the list of dense cells, DENSE at most, is broadcast.
    """
    grid = ["cx", "cy", "cz"]
    near = left.withColumns({f"c{k}": cell(F.col(k), radius) for k in "xyz"})
    sizes = near.groupBy(*grid).agg(F.count(F.lit(1)).alias("size"))
    most = sizes.agg(F.greatest(F.lit(SHARE), F.ceil(F.sum("size") / DENSE))).scalar()
    dense = F.broadcast(sizes.withColumn("parts", F.ceil(F.col("size") / most).cast("int")).where("parts > 1").select(*grid, "parts"))
    parts = F.coalesce("parts", F.lit(1))
    near = near.join(dense, grid, "left").withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).drop("parts")
    far = right.select(*(F.col(c).alias(f"other_{c}") for c in right.columns)).withColumns({f"c{k}": cell(F.col(f"other_{k}"), radius) for k in "xyz"})
    for k in grid:
        far = far.withColumn(k, F.explode(F.array(*(F.col(k) + d for d in (-1, 0, 1)))))
    far = far.join(dense, grid, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    d2 = sum(((F.col(k) - F.col(f"other_{k}")) * (F.col(k) - F.col(f"other_{k}")) for k in "xyz"), F.lit(0.0))
    return near.join(far, [*grid, "part"]).withColumn("d2", d2).where(F.col("d2") < radius * radius).drop(*grid, "part")


def by_reach(points: DataFrame, wide: DataFrame) -> DataFrame | None:
    """radius_pairs() of points with rows that have a reach of their own (above 0), or nothing if there are none: all pairs within reach, and some that are not.

    Rows are joined by classes of reach, each twice as far as the one before, on cells of its own, so that a wide row doesn't
    coarsen the cells of narrow ones. There is a join for each power of two.
    """
    power = wide.withColumn("_power", F.ceil(F.log2("reach")).cast("int"))
    found = None
    for k in sorted(r["_power"] for r in power.select("_power").distinct().collect()):
        pairs = radius_pairs(points, power.where(F.col("_power") == k).drop("_power", "reach"), 2.0**k + 1e-9)
        found = pairs if found is None else found.unionByName(pairs)
    return found


def spatial_uncertainty(df: DataFrame, radius: float, least: int = 3) -> DataFrame:
    """Per id: neighbours within radius, how many have the same label, 1 - their share (1.0 if fewer than least), and density."""
    out = neighbours.neighbour_counts(df, radius)
    u = F.when(F.col("n") < least, 1.0).otherwise(1 - F.col("same") / F.col("n"))
    volume = 4 / 3 * 3.141592653589793 * radius**3
    return out.select("id", "n", "same", F.round(u, 6).alias("u_spatial"), F.round(F.col("n") / volume, 4).alias("density"))


def nearest(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Each id of left with the nearest id of right within radius (the smallest of equals), or null."""
    best = radius_pairs(left, right, radius).groupBy("id").agg(F.min(F.struct("d2", "other_id")).alias("best"))
    return left.select("id").join(best, "id", "left").select("id", F.col("best.other_id").alias("nearest"), F.round(F.sqrt("best.d2"), 6).alias("distance"))


Point = tuple[float, float, float]

#: More centres than this stand in one constant array instead of one expression each.
EXPRESSIONS = 16


def distances(centroids: list[Point]) -> Column:
    """Array of (d2, j): squared distances from x, y, z to each of a short list of points."""
    d2 = lambda c: sum(((F.col(k) - c[i]) * (F.col(k) - c[i]) for i, k in enumerate("xyz")), F.lit(0.0))
    if len(centroids) <= EXPRESSIONS:
        return F.array(*(F.struct(d2(c).alias("d2"), F.lit(j).alias("j")) for j, c in enumerate(centroids)))
    table = F.array(*(F.array(*map(F.lit, c)) for c in centroids))
    return F.transform(table, lambda c, j: F.struct(d2(c).alias("d2"), j.alias("j")))


def assign(df: DataFrame, centroids: list[Point]) -> DataFrame:
    """df with cluster: the nearest of a short list of centroids (the first of equals), without a shuffle."""
    return df.withColumn("cluster", F.array_min(distances(centroids))["j"])


def unit(key: Column, turn: int) -> Column:
    """A number between 0 and 1 for a key and a turn, from an MD5."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"-{turn}"))), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 32)


def seeds(df: DataFrame, k: int, doubt: float = 1.0) -> list[Point]:
    """k-means++ over rows (id, x, y, z, u): the first drawn by 1 / (u + 0.1), the others by squared distance to the nearest seed times (1 + doubt * u).

    A weighted draw is the row with the smallest -ln(U) / weight, U being a hash of its id: one aggregation to one row for each
    seed, over df, which should be cached or written. Fewer than k seeds come out if points don't differ.
    """
    chosen: list[Point] = []
    for turn in range(1, k + 1):
        weight = (1 + doubt * F.col("u")) * F.array_min(distances(chosen))["d2"] if chosen else 1 / (F.col("u") + 0.1)
        draw = df.select("id", "x", "y", "z", weight.alias("w"), unit(F.col("id"), turn).alias("r")).where("w > 0")
        best = draw.agg(F.min(F.struct((-F.ln("r") / F.col("w")).alias("wait"), "id", "x", "y", "z")).alias("b")).first()["b"]
        if best is None:
            break
        chosen.append((best["x"], best["y"], best["z"]))
    return chosen


def kmeans(df: DataFrame, k: int, rounds: int = 15, tolerance: float = 0.01, start: list[Point] | None = None) -> tuple[DataFrame, list[Point]]:
    """Lloyd's rounds with weights 1 / (u + 0.1) over rows (id, x, y, z, u); each is one aggregation to k rows.

    A cluster that has lost all its points starts anew at the point farthest from its centre (the next farthest cluster's
    point for the next such cluster). start: centres; by default seeds().
    """
    centroids = start or seeds(df, k)
    for _ in range(rounds if centroids else 0):
        w, near = 1 / (F.col("u") + 0.1), F.array_min(distances(centroids))
        far = F.max(F.struct("near.d2", (-F.col("id")).alias("minus"), "x", "y", "z")).alias("far")
        sums = [(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in "xyz"]
        rows = df.withColumn("near", near).groupBy(F.col("near.j").alias("cluster")).agg(*sums, far).collect()
        new, moved = {r["cluster"]: (r["x"], r["y"], r["z"]) for r in rows}, 0.0
        spare = sorted((r["far"] for r in rows if r["far"]["d2"] > 0), reverse=True)
        for j, old in enumerate(centroids):
            if j not in new and spare:
                best = spare.pop(0)
                new[j], moved = (best["x"], best["y"], best["z"]), float("inf")
            moved = max(moved, sum((a - b) ** 2 for a, b in zip(new.get(j, old), old, strict=True)))
        centroids = [new.get(j, old) for j, old in enumerate(centroids)]
        if moved < tolerance**2:
            break
    return assign(df, centroids) if centroids else df.withColumn("cluster", F.lit(0)), centroids


def primitive_count(n: int, target: int, least: int) -> int:
    """Clusters for n points: the target, but so few that each can have `least` points; 1 at least."""
    return max(1, min(target, n // least))


def automatic_count(n: int, low: int = 16, high: int = 256) -> int:
    """The root of n / 2, between low and high."""
    return min(max(int((n / 2) ** 0.5), low), high)


def gate(prims: DataFrame, least: int, conflict: float, most_u: float = 1.0) -> DataFrame:
    """Primitives with enough points, little conflict and no more uncertainty than that."""
    return prims.where((F.col("n") >= least) & (F.col("conflict") < conflict) & (F.col("u") <= most_u))


def build(df: DataFrame, target: int | None, least: int, rounds: int = 15, tolerance: float = 0.01) -> DataFrame:
    """primitives() of a frame's points (id, x, y, z, u) by `cluster`: as many as primitive_count() allows of target (None: automatic_count()), without those of fewer than least points. Too few points make none."""
    n = df.count()
    k = primitive_count(n, automatic_count(n) if target is None else target, least)
    return primitives(kmeans(df, k if n >= least else 1, rounds, tolerance)[0], "cluster").where(F.col("n") >= (least if n >= least else n + 1))


def primitives(df: DataFrame, by: str, ridge: float = 0.001) -> DataFrame:
    """Gaussian summary per group: weighted centroid, covariance (upper triangle, ridge on the diagonal), mean uncertainty. One pass."""
    w = 1 / (F.col("u") + 0.1)
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    sums = [F.sum(w).alias("w"), F.count(F.lit(1)).alias("n"), F.avg("u").alias("u")]
    sums += [F.sum(w * F.col(a)).alias(f"s{a}") for a in "xyz"] + [F.sum(w * F.col(a) * F.col(b)).alias(f"s{a}{b}") for a, b in pairs]
    g = df.groupBy(by).agg(*sums)
    mean = {a: F.col(f"s{a}") / F.col("w") for a in "xyz"}
    cov = [F.round(F.col(f"s{a}{b}") / F.col("w") - mean[a] * mean[b] + (ridge if a == b else 0.0), 4).alias(f"c{a}{b}") for a, b in pairs]
    return g.select(by, "n", F.round("u", 6).alias("u"), *(F.round(mean[a], 4).alias(a) for a in "xyz"), *cov)


def order_statistic(df: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """(by, value): the value of rank ceil(share * n) of each group, by selection."""
    return ranks.order_statistics(df, [by], value, lambda n: F.array(F.greatest(F.ceil(share * n) - 1, F.lit(0)))).select(by, "value")


#: Cells that a point's neighbourhood is cut into, along an axis, to leave out parts that can't hold the nearest point.
FINE = 4


def nearest_in_cells(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """nearest(), but right's points are met by fine cells: one point of each cell bounds the distance, and only cells that can hold a nearer one are opened. Rows of left without a point in reach are left out."""
    step = radius / FINE
    fine = [cell(F.col(k), step).alias(f"f{k}") for k in "xyz"]
    cells = right.select("id", "x", "y", "z", *fine)
    stand_ins = cells.groupBy("fx", "fy", "fz").agg(F.min_by(F.struct("x", "y", "z"), "id").alias("p"), F.min("id").alias("id"))
    near = radius_pairs(left.select("id", "x", "y", "z"), stand_ins.select("id", "p.x", "p.y", "p.z", "fx", "fy", "fz"), 2 * radius)
    # The nearest point is no farther than the nearest stand-in; a cell's nearest corner or face says whether it can hold it.
    gap = [F.greatest(F.col(f"other_f{k}") * step - F.col(k), F.col(k) - (F.col(f"other_f{k}") + 1) * step, F.lit(0.0)) for k in "xyz"]
    bound = F.least(F.min("d2").over(Window.partitionBy("id")), F.lit(radius * radius))
    opened = near.withColumn("bound", bound).where(sum((g * g for g in gap), F.lit(0.0)) <= F.col("bound") * (1 + 1e-9))
    opened = opened.select("id", "x", "y", "z", *(F.col(f"other_f{k}").alias(f"f{k}") for k in "xyz"))
    points = cells.select(F.col("id").alias("other_id"), *(F.col(k).alias(f"other_{k}") for k in "xyz"), "fx", "fy", "fz")
    d2 = sum(((F.col(k) - F.col(f"other_{k}")) * (F.col(k) - F.col(f"other_{k}")) for k in "xyz"), F.lit(0.0))
    best = opened.join(points, ["fx", "fy", "fz"]).withColumn("d2", d2).where(F.col("d2") < radius * radius).groupBy("id").agg(F.min(F.struct("d2", "other_id")).alias("best"))
    return best.select("id", F.col("best.other_id").alias("nearest"), F.round(F.sqrt("best.d2"), 6).alias("distance"))


def nearest_of_all(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Each id of left with the nearest id of right (the smallest of equals), however far: id, nearest, distance.

    The first radius is at least that of a cell which holds one point of right on average. It doubles each round for the points that met
    nothing yet; what meets something in a radius has its nearest there. A point meets one stand-in per fine cell, and the points of few
    cells, so a far away crowd costs as much as a single point. Ends when right's box lies within the radius of every point; without right
    there are no rows. What a round has met is cut by checkpoint().
    """
    span = [f(k).alias(f"{n}{k}") for k in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    box = left.select("x", "y", "z").union(right.select("x", "y", "z")).agg(*span).first()
    own = right.agg(F.count(F.lit(1)).alias("n"), *span).first()
    if not own["n"] or box["lox"] is None:
        return left.select("id", F.col("id").alias("nearest"), F.lit(0.0).alias("distance")).limit(0)
    wide = sum((box[f"hi{k}"] - box[f"lo{k}"]) ** 2 for k in "xyz") ** 0.5
    sides = [s for k in "xyz" if (s := own[f"hi{k}"] - own[f"lo{k}"]) > 0]
    radius = max(radius, (math.prod(sides) / own["n"]) ** (1 / len(sides)) if sides else 0.0)
    done, rest = None, left.select("id", "x", "y", "z")
    while True:
        met = nearest_in_cells(rest, right, radius).checkpoint()
        done = met if done is None else done.union(met)
        rest = rest.join(met, "id", "left_anti")
        if radius > wide or rest.isEmpty():
            return done
        radius *= 2


def given_neighbours(df: DataFrame, ids: str) -> DataFrame:
    """(id, n, same): existing neighbours among the listed ids, and those of the same label. Rows without one are left out."""
    each = df.select("id", "label", F.explode(ids).alias("other")).where("other >= 0 AND other <> id")
    other = df.select(F.col("id").alias("other"), F.col("label").alias("other_label"))
    return each.join(other, "other").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("other_label")).alias("same"))
