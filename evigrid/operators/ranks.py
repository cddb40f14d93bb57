"""Exact order statistics of groups of any size: no task sorts or holds a group's values.

Values are counted in ranges between two bounds, one aggregation that combines on the map side; the range that holds a wanted rank
gives the next, tighter bounds, until few values or a single one are left between them. Only these are put in order. Ranges are
equal on a line in one round and on a scale of logarithms in the next, so neither a narrow crowd of values nor one over many
orders of magnitude takes more than about a dozen rounds; most take one or two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that values are counted in at once, and values that a task may put in order.
RANGES, FEW = 4096, 1 << 16

#: Bounds that go to every task at once; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def order_statistics(df: DataFrame, by: list[str], value: str, want: Callable[[Column], Column]) -> DataFrame:
    """(by, n, rank, value) of each group: the values of the wanted ranks (an array of numbers from 0, made of the group's size n).

    Nulls, NaN and infinite values are left out, as are groups without others. Each round is cut by checkpoint().
    """
    v = F.col(value).cast("double")
    rows = df.select(*by, v.alias("v")).where(F.abs("v") < float("inf"))
    start = rows.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    wanted = F.explode(F.array_distinct(want(F.col("n")).cast("array<bigint>"))).alias("rank")
    found = start.select(*by, "n", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), wanted).where("rank >= 0 AND rank < n").checkpoint()
    bounds = [*by, "lo", "hi"]

    def pick(of: DataFrame, counted: DataFrame, *extra: Column) -> DataFrame:
        """of (w) with the row of counted (r) that holds its rank."""
        at = F.col("w.rank") - F.col("w.below")
        own = _all([F.col(f"w.{k}").eqNullSafe(F.col(f"r.{k}")) for k in bounds] + [at >= F.col("r.before"), at < F.col("r.before") + F.col("r.c")])
        return of.alias("w").join(counted.alias("r"), own).select(*(F.col(f"w.{k}").alias(k) for k in by), "w.n", "w.rank", *extra)

    def between(rows: DataFrame, of: DataFrame, most: int) -> DataFrame:
        own = of.select(*(F.col(k).alias(f"own_{k}") for k in by), "lo", "hi").distinct()
        match = _all([F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in by] + [F.col("v").between(F.col("lo"), F.col("hi"))])
        return rows.join(_small(own, most), match).select(*by, "lo", "hi", "v")

    turn = 0
    while left := (wide := found.where((F.col("lo") < F.col("hi")) & (F.col("inside") > FEW))).count():
        lo, hi, v = (_log_scale(F.col(k)) if turn % 2 else F.col(k) / 2 for k in ("lo", "hi", "v"))
        part = F.when(hi > lo, (v - lo) / (hi - lo)).otherwise((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2))
        counted = between(rows, wide, left).withColumn("range", F.least(F.floor(part * RANGES), F.lit(RANGES - 1)))
        turn += 1
        counted = counted.groupBy(*bounds, "range").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("first"), F.max("v").alias("last"))
        before = Window.partitionBy(*bounds).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
        next_ = pick(wide, counted, F.col("r.first").alias("lo"), F.col("r.last").alias("hi"), (F.col("w.below") + F.col("r.before")).alias("below"), F.col("r.c").alias("inside"))
        found = found.where((F.col("lo") == F.col("hi")) | (F.col("inside") <= FEW)).unionByName(next_).checkpoint()
    single = found.where("lo = hi").select(*by, "n", "rank", F.col("lo").alias("value"))
    rest = found.where("lo < hi")
    counted = between(rows, rest, rest.count()).groupBy(*bounds, "v").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(*bounds).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0)))
    return single.unionByName(pick(rest, counted, F.col("r.v").alias("value")))


def _log_scale(v: Column) -> Column:
    """A scale that rises with v and gives every power of two the same room."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log2(F.abs(v)) + 1100))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row per group: exact quantiles by name, between two neighbouring values in proportion."""
    place = lambda p, n: F.lit(float(p)) * (n - 1)
    got = order_statistics(df, by, value, lambda n: F.array(*(f(place(p, n)).cast("long") for p in shares.values() for f in (F.floor, F.ceil))))
    at = lambda rank: F.max(F.when(F.col("rank") == rank.cast("long"), F.col("value")))

    def quantile(p: float) -> Column:
        pos = place(p, F.col("n"))
        low, high = at(F.floor(pos)), at(F.ceil(pos))
        part = F.max(pos - F.floor(pos))
        return low + (high - low) * part

    return got.groupBy(*by).agg(*(quantile(p).alias(name) for name, p in shares.items()))
