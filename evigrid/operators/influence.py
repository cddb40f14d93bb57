"""Primitives and observations that act on voxels in reach, and the evidence that voxels gather from them.

Cells are generated from each row's own bounds, so there is no join; the only shuffle is the one by cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, scalar

COVARIANCE = tuple(f"c{k}" for k in geometry.ENTRIES)


def reach(length: Column, m: list[Column], floor: float = 0.01) -> list[Column]:
    """Half widths of a primitive's box: length times the root of an eigenvalue, in ascending order for x, y, z, at least floor."""
    return [F.greatest(length * F.sqrt(F.greatest(v, F.lit(1e-10))), F.lit(floor)) for v in geometry.eigenvalues(m)]


def cells_around(df: DataFrame, half: dict[str, Column], res: float, bounds: tuple[float, float] | None = None) -> DataFrame:
    """One row for each row of df and cell of its box: ix, iy, iz, and dx, dy, dz from the centre to the cell's lower corner."""
    for k in "xyz":
        low, high = F.col(k) - half[k], F.col(k) + half[k]
        if bounds:
            low, high = F.greatest(low, F.lit(bounds[0])), F.least(high, F.lit(bounds[1]))
        df = df.withColumns({f"lo{k}": F.floor(low / res).cast("int"), f"hi{k}": F.floor(high / res).cast("int")})
    for k in "xyz":
        if bounds:  # a box may lie outside
            df = df.where(f"lo{k} <= hi{k}")
        df = df.withColumn(f"i{k}", F.explode(F.sequence(f"lo{k}", f"hi{k}"))).drop(f"lo{k}", f"hi{k}")
    return df.withColumns({f"d{k}": F.col(f"i{k}") * F.lit(res) - F.col(k) for k in "xyz"})


def influence(primitives: DataFrame, res: float, most: float = 0.7, ridge: float = 0.001, rate: float = 1.0, bounds: tuple[float, float] | None = None) -> DataFrame:
    """(id, ix, iy, iz, scale) with the other columns of primitives: weight of each primitive on each voxel in its support.

    primitives: id, x, y, z, covariance, u, length, dynamic, traversable. Those above the uncertainty `most` act on nothing.
    """
    weight = scalar.uncertainty_kernel(F.col("u")) * F.when(F.col("dynamic"), 0.5).otherwise(1.0) * scalar.confidence_weight(F.col("u"))
    entries = [F.col(c) for c in COVARIANCE]
    ready = primitives.where(F.col("u") <= most).withColumn("kw", weight)
    ready = ready.withColumns({f"h{k}": h for k, h in zip("xyz", reach(F.col("length"), entries), strict=True)})
    stiff = geometry.inverse([c + ridge if n in ("cxx", "cyy", "czz") else c for n, c in zip(COVARIANCE, entries, strict=True)])
    ready = ready.withColumns({f"m{k}": v for k, v in zip(geometry.ENTRIES, stiff, strict=True)})
    near = cells_around(ready, {k: F.col(f"h{k}") for k in "xyz"}, res, bounds)
    d = [F.col(f"d{k}") for k in "xyz"]
    near = near.withColumn("d", F.sqrt(F.greatest(geometry.quadratic([F.col(f"m{k}") for k in geometry.ENTRIES], d), F.lit(0.0))))
    kernel = scalar.sparse_kernel(F.col("d"), F.col("length"))
    near = near.withColumn("kernel", kernel).where("kernel >= 1e-10")
    scale = F.col("kernel") * scalar.reachability_kernel(F.col("traversable"), geometry.norm(d), rate) * F.col("kw")
    return near.select(*primitives.columns, "ix", "iy", "iz", scale.alias("scale"))


def evidence_map(acting: DataFrame, classes: int, prior: float, bound: float = 10.0, part: int = 4096) -> DataFrame:
    """Log-odds of each voxel: scale * ln(p / prior) of the primitives in order of id, clamped after each.

    A run of such steps is itself a step h -> clamp(h + a, low, high), so a voxel's primitives are folded by parts of `part` ids
    each, and then its parts: no row holds more.
    """
    odds = F.transform("p", lambda p: scalar.log_odds(p, prior))
    items = F.sort_array(F.collect_list(F.struct("id", F.transform(odds, lambda o: o * F.col("scale")).alias("a"))))
    step = lambda k: lambda s, e: F.struct((s["a"] + e["a"][k]).alias("a"), scalar.clamp(s["low"] + e["a"][k], -bound, bound).alias("low"), scalar.clamp(s["high"] + e["a"][k], -bound, bound).alias("high"))
    none = F.struct(F.lit(0.0).alias("a"), F.lit(-bound).alias("low"), F.lit(bound).alias("high"))
    parts = acting.groupBy("ix", "iy", "iz", F.floor(F.col("id") / part).alias("part")).agg(items.alias("items"))
    parts = parts.select("ix", "iy", "iz", "part", F.size("items").alias("n"), F.array(*(F.aggregate("items", none, step(k)) for k in range(classes))).alias("s"))
    runs = F.sort_array(F.collect_list(F.struct("part", "s")))
    fold = lambda k: F.aggregate(F.col("runs"), F.lit(0.0), lambda h, e: F.least(F.greatest(h + e["s"][k]["a"], e["s"][k]["low"]), e["s"][k]["high"]))
    cells = parts.groupBy("ix", "iy", "iz").agg(runs.alias("runs"), F.sum("n").cast("int").alias("n"))
    return cells.select("ix", "iy", "iz", "n", F.array(*(fold(k) for k in range(classes))).alias("h"))


def attributes(cells: DataFrame, traversable: list[int], avoided: list[int]) -> DataFrame:
    """Class, confidence, entropy and navigation cost of cells with log-odds h; cost -1 where neither class nor confidence decides."""
    out = cells.withColumn("p", scalar.softmax(F.col("h"))).withColumn("class", scalar.argmax(F.col("p"))).withColumn("confidence", F.array_max("p"))
    cost = F.when(F.col("class").isin(*traversable), 0).when(F.col("class").isin(*avoided) | (F.col("confidence") > 0.5), 100).otherwise(-1)
    return out.withColumn("entropy", scalar.entropy(F.col("p"))).withColumn("nav_cost", cost)


def is_traversable(cls: Column, observations: Column, traversable: list[int]) -> Column:
    """Whether a cell's class can be driven on; a cell that nothing was seen of, or that isn't there (null), can't."""
    return F.coalesce((observations > 0) & (cls >= 0) & cls.isin(*traversable), F.lit(False))


def is_obstacle(nav_cost: Column, observations: Column, confidence: Column | None = None, least: float = 0.5) -> Column:
    """Whether a cell blocks: of a map, by its navigation cost alone; of a cell by itself, if it is also as sure as `least`."""
    blocks = (observations > 0) & (nav_cost == 100)
    return F.coalesce(blocks if confidence is None else blocks & (confidence >= least), F.lit(False))


def dirichlet_map(observations: DataFrame, res: float, classes: int, base: float, beta: float = 0.5, gamma: float = 3.0, most: float = 0.7) -> DataFrame:
    """alpha = 1 + sum of kernel * p for each voxel near observations (x, y, z, u, p). A plain sum, combined on the map side."""
    length = scalar.observation_length(F.col("u"), base, beta, gamma)
    near = cells_around(observations.where(F.col("u") <= most).withColumn("length", length), {k: F.col("length") for k in "xyz"}, res)
    near = near.withColumn("k", scalar.sparse_kernel(geometry.norm([F.col(f"d{k}") for k in "xyz"]), F.col("length"))).where("k >= 1e-10")
    return near.groupBy("ix", "iy", "iz").agg(F.count(F.lit(1)).alias("n"), *((1 + F.sum(F.col("k") * F.col("p")[c])).alias(f"alpha{c}") for c in range(classes)))
