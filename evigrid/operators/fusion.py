"""Beliefs fused one after the other, by parts that run side by side.

Fusing the masses x (of sum 1, uncertainty u) with a belief q (of uncertainty v) gives, up to scale, d * x + c * sum(x), where
d = (1 - u)(1 - v) q + (1 - u) v and c = u (1 - v) q. The uncertainties don't depend on the masses and are summed first; then a run of steps
is one matrix. Parts of a group give their matrices, a group's matrices in order the masses that each part begins with, and from those
each part folds its own steps and finds its conflicts. No row holds more than one part of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import TINY

#: Steps after which a mean of two sides holds nothing of where it began: no double is as small as this power of a half.
FORGOTTEN = 1100


def _shares(p: np.ndarray) -> np.ndarray:
    return p / p.sum() if p.sum() > TINY else p * 0.0


def _next(u: float, w: float, v: float, x: float, weighted: bool) -> tuple[float, float]:
    return ((u * w + v * x) / (w + x), w + x) if weighted else ((u + v) / 2, w)


def run(beliefs: np.ndarray, us, ws, p: np.ndarray, u: float, w: float, weighted: bool) -> tuple:
    """Masses, uncertainty, largest and last conflict after fusing beliefs in order; lost: nothing agreed in some step."""
    most, last, lost = 0.0, 0.0, False
    for q, v, x in zip(beliefs, us, ws, strict=True):
        a, b = _shares(p) * (1 - u), _shares(q) * (1 - v)
        last = min(a.sum() * b.sum() - (a * b).sum(), 1 - TINY)
        joint = a * b + a * v + u * b
        lost |= joint.sum() <= TINY
        p = joint / joint.sum() if joint.sum() > TINY else joint
        most, (u, w) = max(most, last), _next(u, w, v, x, weighted)
    return p, u, most, last, lost


def product(beliefs: np.ndarray, us, ws, u: float, w: float, weighted: bool) -> np.ndarray:
    """The matrix of a run of steps, up to scale."""
    out = np.eye(beliefs.shape[1])
    for q, v, x in zip(beliefs, us, ws, strict=True):
        q = _shares(q)
        out = ((1 - u) * ((1 - v) * q + v))[:, None] * out + (u * (1 - v) * q)[:, None] * out.sum(0)
        out /= max(out.sum(), 1e-300)
        u, w = _next(u, w, v, x, weighted)
    return out


def fuse_in_order(df: DataFrame, by: str, order: list[str], p: str, u: str, part: Column | None = None, weight: str | None = None) -> DataFrame:
    """(by, p, u, conflict, last_conflict): beliefs of a group fused in order; conflict is the largest of a step, 0 for a single belief.

    u becomes the mean of both sides or, with a weight, the mean by weight. part: a number that rises with the order, of which
    none should hold more rows than a task takes. Groups in which some step finds nothing that agrees (the masses then say nothing of
    what was before) are folded again in one part.
    """
    kind, weighted = df.schema[by].dataType, weight is not None
    item = F.struct(*order, F.col(p).alias("p"), F.col(u).cast("double").alias("u"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    parts = df.groupBy(F.col(by).alias("key"), (F.lit(0) if part is None else part).cast("long").alias("part")).agg(F.sort_array(F.collect_list(item)).alias("i"))
    parts = parts.select("key", "part", F.flatten("i.p").alias("p"), F.col("i.u").alias("u"), F.col("i.w").alias("w"), F.size("i").alias("m")).checkpoint()

    half = lambda us, start: F.aggregate(us, start, lambda s, v: (s + v) / 2)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    at = Window.partitionBy("key").orderBy("part")
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    brief = parts.select(
        "key", "part", "m", F.col("u")[0].alias("u1"), half(F.col("u"), F.lit(0.0)).alias("half"), half(F.slice("u", F.lit(2), F.size("u")), F.col("u")[0]).alias("half1"),
        total(F.col("w")).alias("sw"), total(F.zip_with("u", "w", lambda a, b: a * b)).alias("swu"),
    )
    brief = brief.withColumn("steps", F.sum("m").over(before)).withColumn("final", F.lead("part").over(at).isNull())
    if weighted:
        brief = brief.withColumn("w0", F.sum("sw").over(before)).withColumn("u0", F.sum("swu").over(before) / F.col("w0"))
    else:  # what a part adds to u is halved by every step since
        brief = brief.withColumn("upto", F.coalesce("steps", F.lit(0)) + F.col("m")).withColumn("add", F.when(F.col("steps").isNull(), F.col("half1")).otherwise(F.col("half")))
        recent = F.collect_list(F.struct("upto", "add")).over(Window.partitionBy("key").orderBy("upto").rangeBetween(-FORGOTTEN, Window.currentRow))
        brief = brief.withColumn("recent", recent)
        after = F.aggregate("recent", F.lit(0.0), lambda s, e: s + e["add"] * F.pow(F.lit(0.5), (F.col("upto") - e["upto"]).cast("double")))
        brief = brief.withColumn("w0", F.lit(1.0)).withColumn("u0", F.lag(after).over(at))
    parts = parts.join(brief.select(F.col("key").alias("k"), F.col("part").alias("n"), "u0", "w0", F.col("steps").isNull().alias("first"), "final"), F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("n"))).drop("k", "n")

    def shaped(r) -> np.ndarray:
        return np.asarray(r.p, float).reshape(r.m, -1)

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                beliefs = shaped(r)
                if r.first:
                    out.append(run(beliefs[1:], r.u[1:], r.w[1:], beliefs[0], r.u[0], r.w[0], weighted)[0])
                else:
                    out.append(product(beliefs, r.u, r.w, r.u0, r.w0, weighted).ravel())
            yield pd.DataFrame({"key": b["key"], "part": b["part"], "matrix": out})

    def prefixes(group: pd.DataFrame) -> pd.DataFrame:
        """The masses after each part but the last: the first part's own, then each matrix times those before."""
        group, out = group.sort_values("part", ignore_index=True), []
        for matrix in group["matrix"]:
            now = _shares(matrix if not out else np.asarray(matrix, float).reshape(-1, len(out[-1])) @ out[-1])
            out.append(now)
        return pd.DataFrame({"key": group["key"], "part": group["part"], "p0": out})

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                beliefs = shaped(r)
                begin = (beliefs[1:], r.u[1:], r.w[1:], beliefs[0], r.u[0], r.w[0]) if r.first else (beliefs, r.u, r.w, np.asarray(r.p0, float), r.u0, r.w0)
                rows.append((r.key, r.part, *run(*begin, weighted)))
            yield pd.DataFrame(rows, columns=["key", "part", "p", "u", "most", "last", "lost"])

    fields = lambda *more: T.StructType([T.StructField("key", kind), T.StructField("part", T.LongType()), *(T.StructField(n, t) for n, t in more)])
    numbers, double = T.ArrayType(T.DoubleType()), T.DoubleType()
    found = parts.where(~F.col("final")).select("key", "part", "p", "u", "w", "m", "u0", "w0", "first").mapInPandas(matrices, fields(("matrix", numbers)))
    begins = found.groupBy("key").applyInPandas(prefixes, fields(("p0", numbers)))
    following = parts.select("key", "part", F.lag("part").over(at).alias("of"))
    begins = following.join(begins.select(F.col("key").alias("k"), F.col("part").alias("n"), "p0"), F.col("key").eqNullSafe(F.col("k")) & (F.col("of") == F.col("n"))).select("k", F.col("part").alias("of"), "p0")
    full = parts.join(begins, F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("of")), "left").select("key", "part", "p", "u", "w", "m", "u0", "w0", "first", "p0")
    done = full.mapInPandas(folded, fields(("p", numbers), ("u", double), ("most", double), ("last", double), ("lost", T.BooleanType()))).checkpoint()
    out = done.groupBy("key").agg(F.max_by(F.struct("p", "u", "last"), "part").alias("s"), F.max("most").alias("conflict"), F.max("lost").alias("lost"), F.count(F.lit(1)).alias("n"))
    again = out.where("lost AND n > 1").select("key")
    named = lambda x: x.select(F.col("key").alias(by), "s.p", "s.u", "conflict", F.col("s.last").alias("last_conflict"))
    if part is None or again.isEmpty():
        return named(out)
    rest = df.join(again.withColumnRenamed("key", "_again"), F.col(by).eqNullSafe(F.col("_again")), "left_semi")
    return named(out.where("NOT lost OR n = 1")).unionByName(fuse_in_order(rest, by, order, p, u, None, weight))
