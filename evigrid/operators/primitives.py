"""Primitives over time: fusion, merging, splitting and incremental updates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, scalar
from .fusion import fuse_in_order, run
from .graph import components
from .influence import COVARIANCE
from .spatial import by_reach, kmeans, nearest, primitive_count, primitives, radius_pairs


def merge_groups(df: DataFrame, by: str) -> DataFrame:
    """One primitive per group: weighted centre, covariance by the parallel axis theorem, points, weight, point-weighted uncertainty.

    Merging in pairs gives the same in any order, so these are plain sums. Columns: x, y, z, covariance, n, w, u.
    """
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    w = F.col("w")
    sums = [F.sum(w).alias("w"), F.sum("n").alias("n"), F.sum(F.col("u") * F.col("n")).alias("un")]
    sums += [F.sum(w * F.col(a)).alias(f"s{a}") for a in "xyz"]
    sums += [F.sum(w * (F.col(f"c{a}{b}") + F.col(a) * F.col(b))).alias(f"s{a}{b}") for a, b in pairs]
    g = df.groupBy(by).agg(*sums)
    mean = {a: F.col(f"s{a}") / w for a in "xyz"}
    cov = [(F.col(f"s{a}{b}") / w - mean[a] * mean[b]).alias(f"c{a}{b}") for a, b in pairs]
    return g.select(by, *(v.alias(k) for k, v in mean.items()), *cov, "n", "w", (F.col("un") / F.col("n")).alias("u"))


def merge_in_order(df: DataFrame, by: str, order: list[str], part: Column | None = None) -> DataFrame:
    """merge_groups(), and what the order of merging decides: fused class probabilities p, their class, and the conflict of the last merge. Columns as there, and p."""
    fused = fuse_in_order(df, by, order, "p", "u", part, "n").select(F.col(by).alias("_by"), "p", scalar.argmax(F.col("p")).alias("class"), F.col("last_conflict").alias("conflict"))
    return merge_groups(df, by).join(fused, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def merge_near(df: DataFrame, most: float, calm: float) -> DataFrame:
    """(id, root, class, conflict, u, n): primitives (id, class, x, y, z, w, n, u, conflict, p) absorb later ones, in order of id; class and others are those of the merged primitive.

    A primitive absorbs one of its present class within `most` of its present centre while both have a conflict of at most calm. A merge renews
    centre, class probabilities, class, conflict and uncertainty, and all of these decide what comes next. After a merge the centre lies within
    `most` of what it absorbed, so whatever is merged hangs together by steps of 2 * most: components of that graph are
    independent of each other, and each is one group.
    """

    def absorb(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("id", ignore_index=True)
        at, p, quiet = g[["x", "y", "z"]].to_numpy(float), [np.asarray(x, float) for x in g["p"]], (g["conflict"] <= calm).to_numpy()
        classes, free, out = g["class"].to_numpy(), np.ones(len(g), bool), {}
        for i in range(len(g)):
            if not free[i]:
                continue
            centre, weight, q, u, n, c, conflict, members, j = at[i], g["w"][i], p[i], g["u"][i], g["n"][i], classes[i], g["conflict"][i], [i], i
            while conflict <= calm:
                near = free & quiet & (classes == c) & (((centre - at) ** 2).sum(1) <= most * most)
                later = np.flatnonzero(near[j + 1 :])
                if not len(later):
                    break
                j += 1 + int(later[0])
                q, u, _, conflict, _ = run(p[j][None], [g["u"][j]], [g["n"][j]], q, u, n, True)
                centre, weight, n, c = (centre * weight + at[j] * g["w"][j]) / (weight + g["w"][j]), weight + g["w"][j], n + g["n"][j], int(np.argmax(q))
                free[j] = False
                members.append(j)
            out |= {k: (g["id"][i], c, conflict, u, n) for k in members}
        rows = [(g["id"][k], *out[k]) for k in range(len(g))]
        return pd.DataFrame(rows, columns=["id", "root", "class", "conflict", "u", "n"])

    at = df.where(F.col("conflict") <= calm).select("id", "x", "y", "z")
    pairs = radius_pairs(at, at, 2 * most * (1 + 1e-9)).where("id < other_id").select(F.col("id").alias("a"), F.col("other_id").alias("b"))
    grouped = df.join(components(pairs), "id", "left").withColumn("component", F.coalesce("component", "id"))
    kind = df.schema["class"].dataType.simpleString()
    return grouped.groupBy("component").applyInPandas(absorb, f"id long, root long, class {kind}, conflict double, u double, n long")


def split_candidates(prims: DataFrame, points: DataFrame) -> DataFrame:
    """(prim, id): points nearer than three deviations (9 times the covariance's trace, squared) to primitives, joined by classes of reach (by_reach())."""
    trace = F.col("cxx") + F.col("cyy") + F.col("czz")
    wide = prims.select("id", "x", "y", "z", trace.alias("trace"), F.sqrt(9 * trace).alias("reach")).where("trace > 0")
    pairs = by_reach(points.select("id", "x", "y", "z"), wide)
    if pairs is None:
        return wide.select(F.col("id").alias("prim"), "id").limit(0)
    return pairs.where("d2 < 9 * other_trace").select(F.col("other_id").alias("prim"), "id")


def split(prims: DataFrame, points: DataFrame, rounds: int = 15, least: int = 5) -> DataFrame:
    """(prim, id, side): candidates of each primitive in two halves by Lloyd's rounds, all primitives at once.

    Seeds are the candidates' ends along x. Primitives with fewer than 2 * least candidates are left out.
    Each round is one aggregation to two rows per primitive, cut by checkpoint().
    """
    near = split_candidates(prims, points).join(points.select("id", "x", "y", "z"), "id")
    enough = near.groupBy("prim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2 * least)
    near = near.join(enough.select("prim"), "prim").checkpoint()
    ends = lambda f: f(F.struct("x", "y", "z", "id"))
    centres = near.groupBy("prim").agg(ends(F.min).alias("c0"), ends(F.max).alias("c1")).checkpoint()
    d2 = lambda c: sum(((F.col(k) - F.col(f"{c}.{k}")) ** 2 for k in "xyz"), F.lit(0.0))
    side = F.when(d2("c0") <= d2("c1"), 0).otherwise(1)
    for _ in range(rounds):
        halves = near.join(centres, "prim").select("*", side.alias("side"))
        mean = lambda s: F.struct(*(F.avg(F.when(F.col("side") == s, F.col(k))).alias(k) for k in "xyz"))
        new = halves.groupBy("prim").agg(mean(0).alias("n0"), mean(1).alias("n1"), F.first("c0").alias("c0"), F.first("c1").alias("c1"))
        kept = lambda i: F.struct(*(F.coalesce(f"n{i}.{k}", f"c{i}.{k}").alias(k) for k in "xyz"))
        moved = sum((F.abs(F.col(f"n{i}.{k}") - F.col(f"c{i}.{k}")) for i in (0, 1) for k in "xyz"), F.lit(0.0))
        new = new.select("prim", kept(0).alias("c0"), kept(1).alias("c1"), moved.alias("moved")).checkpoint()
        centres = new.select("prim", "c0", "c1")
        if new.where("moved > 1e-9").isEmpty():
            break
    return near.join(centres, "prim").select("prim", "id", side.alias("side"))


def update(prior: DataFrame, points: DataFrame, most: float, least: int, k: int) -> DataFrame:
    """Primitives after a frame: points (id, x, y, z, u) within `most` of a prior centre (id, x, y, z) renew it; the rest make up to k new ones, as many as can have `least` points each.

    A prior with fewer than least points keeps nothing, its points join the rest. Columns as primitives(): id of the prior
    or, for new ones, -1 - cluster; kept is false for those.
    """
    found = points.join(nearest(points.select("id", "x", "y", "z"), prior.select("id", "x", "y", "z"), most).select("id", "nearest"), "id")
    size = found.where("nearest IS NOT NULL").groupBy("nearest").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    found = found.join(size, "nearest", "left").checkpoint()
    old = primitives(found.where("size IS NOT NULL").withColumnRenamed("nearest", "prim"), "prim").withColumn("kept", F.lit(True))
    rest = found.where("size IS NULL").select("id", "x", "y", "z", "u")
    left = rest.count()
    if left < least:
        return old
    new = primitives(kmeans(rest, primitive_count(left, k, least))[0].withColumn("prim", (-1 - F.col("cluster")).cast("long")), "prim").where(F.col("n") >= least)
    return old.unionByName(new.withColumn("kept", F.lit(False)))


def markers(prims: DataFrame) -> DataFrame:
    """Ellipsoids: id, scale (twice the root of each eigenvalue, at least 0.01), and the turn to the eigenvectors as a quaternion (w, x, y, z), in numpy over Arrow batches."""

    def orient(batches):
        import numpy as np

        for b in batches:
            m = np.empty((len(b), 3, 3))
            for (i, j), c in zip([(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)], COVARIANCE, strict=True):
                m[:, i, j] = m[:, j, i] = b[c]
            values, vectors = np.linalg.eigh(m)
            vectors[:, :, 0] *= np.where(np.linalg.det(vectors) < 0, -1.0, 1.0)[:, None]
            q = np.empty((len(b), 4))
            d = np.einsum("nii->ni", vectors)
            q[:, 0] = np.sqrt(np.maximum(0, 1 + d.sum(1))) / 2
            for i in range(3):
                j, k = (i + 1) % 3, (i + 2) % 3
                q[:, i + 1] = np.copysign(np.sqrt(np.maximum(0, 1 + d[:, i] - d[:, j] - d[:, k])) / 2, vectors[:, k, j] - vectors[:, j, k])
            scale = 2 * np.sqrt(np.maximum(0.01, values))
            yield pd.DataFrame({"id": b["id"], "scale": list(scale), "turn": list(q)})

    return prims.select("id", *COVARIANCE).mapInPandas(orient, "id long, scale array<double>, turn array<double>")


def summary(prims: DataFrame) -> DataFrame:
    """Number of primitives, their largest trace and mean volume."""
    entries = [F.col(c) for c in COVARIANCE]
    return prims.agg(F.count(F.lit(1)).alias("n"), F.round(F.max(entries[0] + entries[3] + entries[5]), 6).alias("max_trace"), F.round(F.avg(geometry.volume(entries)), 6).alias("volume"))
