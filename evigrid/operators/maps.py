"""Cell maps: cost grids, inflation, frontiers, goals, merging and pruning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar
from . import spatial


def cost_grids(points: DataFrame, order: list[str], costs: dict[int, int], free: list[int], blocked: list[int], least: float = 0.3, band: tuple[int, int] | None = None) -> DataFrame:
    """2-D grids (ix, iy): `cost`, 0 or 100 by the last sure point of a free or blocked class in order, 50 where there is none;
    and `semantic`, the highest cost of the points' classes, each drawn towards 50 by doubt (-1 without a class that has one).

    band: layers iz that count, both ends included.
    """
    if band:
        points = points.where(F.col("iz").between(*band))
    sure = F.when(F.col("confidence") > least, F.when(F.col("class").isin(*free), 0).when(F.col("class").isin(*blocked), 100))
    own = F.lit(None).cast("int")
    for k, c in costs.items():
        own = F.when(F.col("class") == k, c).otherwise(own)
    blended = (own * F.col("confidence") + 50 * (1 - F.col("confidence"))).cast("int")
    last = F.max_by(sure, F.when(sure.isNotNull(), F.struct(*order)))
    return points.groupBy("ix", "iy").agg(F.coalesce(last, F.lit(50)).alias("cost"), F.coalesce(F.max(blended), F.lit(-1)).alias("semantic"))


def traversability(cost: Column) -> Column:
    """Unknown stays -1; below 50 is free (0), all else an obstacle (100)."""
    return F.when(cost < 0, -1).when(cost < 50, 0).otherwise(100)


def inflate(grid: DataFrame, radius: int, obstacle: int) -> DataFrame:
    """Costs of known cells near obstacles, at least 100 exp(-10 d / r): obstacles fill the disk's offsets, of fixed number."""
    offsets = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if 0 < i * i + j * j < radius * radius]
    at = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets))
    near = grid.where(F.col("cost") >= obstacle).select("ix", "iy", F.explode(at).alias("o"))
    d = F.sqrt((F.col("o.i") * F.col("o.i") + F.col("o.j") * F.col("o.j")).cast("double"))
    near = near.select((F.col("ix") + F.col("o.i")).alias("ix"), (F.col("iy") + F.col("o.j")).alias("iy"), scalar.inflation_cost(d, float(radius)).alias("c"))
    near = near.groupBy("ix", "iy").agg(F.max("c").alias("c"))
    new = F.when((F.col("cost") < 0) | (F.col("cost") >= obstacle), F.col("cost")).otherwise(F.greatest("cost", F.coalesce("c", F.lit(0))))
    return grid.join(near, ["ix", "iy"], "left").select("ix", "iy", new.alias("cost"))


FACES = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def cell_key() -> Column:
    """ix, iy and iz, each from -2^20 to 2^20 - 1, in one number."""
    i = [F.col(f"i{k}").cast("long") + F.lit(1 << 20) for k in "xyz"]
    return (i[0] * F.lit(1 << 21) + i[1]) * F.lit(1 << 21) + i[2]


def frontier(cells: DataFrame) -> DataFrame:
    """Cells with unknown face neighbours, and their number."""
    faces = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip("abc", f, strict=True))) for f in FACES))
    around = cells.select("ix", "iy", "iz", F.explode(faces).alias("f"))
    around = around.select("ix", "iy", "iz", *((F.col(f"i{k}") + F.col(f"f.{o}")).alias(f"n{k}") for k, o in zip("xyz", "abc", strict=True)))
    known = cells.select(*(F.col(f"i{k}").alias(f"n{k}") for k in "xyz"))
    return around.join(known, ["nx", "ny", "nz"], "left_anti").groupBy("ix", "iy", "iz").agg(F.count(F.lit(1)).alias("unknown"))


def rank_goals(goals: DataFrame, k: int) -> DataFrame:
    """The k goals of highest utility (ties by id), with ranks."""
    top = goals.orderBy(F.desc("utility"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("utility"), "id")))


def cap_cells(cells: DataFrame, most: int) -> DataFrame:
    """Drop cells whose confidence is below that of the most-th cell; equals stay, so a few more may remain.

    Counts per confidence (six digits, so a million values at most) come first: no task sorts cells.
    """
    counts = cells.groupBy("confidence").agg(F.count(F.lit(1)).alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy(F.desc("confidence"))))
    cut = upto.where(F.col("upto") - F.col("c") < most).agg(F.min("confidence").alias("cut"))
    return cells.where(F.col("confidence") >= cut.scalar())


def merge(left: DataFrame, right: DataFrame, mode: str = "confidence") -> DataFrame:
    """Union of two maps by cell: `overwrite` (right wins), `average` (confidence is the mean), or the more confident (left of equals)."""
    a, b = (d.select("ix", "iy", "iz", F.struct("class", "confidence").alias(s)) for d, s in ((left, "l"), (right, "r")))
    both = a.join(b, ["ix", "iy", "iz"], "full")
    winner = F.coalesce("r", "l") if mode == "overwrite" else F.when(F.col("l").isNull() | (F.col("r.confidence") > F.col("l.confidence")), F.coalesce("r", "l")).otherwise(F.col("l"))
    out = both.select("ix", "iy", "iz", winner.alias("w"), "l", "r")
    confidence = F.coalesce((F.col("l.confidence") + F.col("r.confidence")) / 2, "w.confidence") if mode == "average" else F.col("w.confidence")
    return out.select("ix", "iy", "iz", F.col("w.class").alias("class"), F.round(confidence, 6).alias("confidence"))


def region(cells: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int], least: float = 0.0) -> DataFrame:
    """Counts, mean confidence per class in a box (both ends included)."""
    inside = F.lit(True)
    for k, a, b in zip("xyz", low, high, strict=True):
        inside = inside & F.col(f"i{k}").between(a, b)
    return cells.where(inside & (F.col("confidence") >= least)).groupBy("class").agg(F.count(F.lit(1)).alias("cells"), scalar.mean_of_millionths(F.col("confidence")).alias("mean_confidence"), F.sum("n").alias("observations"))


def inside(low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    """Cells of a box, both ends included."""
    return reduce(lambda a, b: a & b, (F.col(f"i{k}").between(a, b) for k, a, b in zip("xyz", low, high, strict=True)))


def within(origin: tuple[float, float, float], size: tuple[float, float, float]) -> Column:
    """Points of a map: from its origin to, but not on, its far faces."""
    return reduce(lambda a, b: a & b, ((F.col(k) >= o) & (F.col(k) < o + s) for k, o, s in zip("xyz", origin, size, strict=True)))


def reset(cells: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """The map without a box."""
    return cells.where(~inside(low, high))


#: Uncertainties nearer than this are equal: averages of equal values differ in their last digits.
TIE = 1e-9


def moving_costs(points: DataFrame, size: tuple[float, float, float], costs: dict[int, int], alpha: float = 0.3, part: Column | None = None) -> DataFrame:
    """Cost, uncertainty and class of voxels, averaged in order of time (ts, class, u). A class replaces the last one if it is surer than the average before it (and so than the new one).

    A voxel's rows are folded part by part (part must rise with the order, e.g. a month), and its parts one after the other, so
    no row holds more than one part. m steps take an average v to (1 - alpha)^m v + b. Which class a part ends with depends on
    the uncertainty u before it: that of the last row whose own was below the average, a row that replaces the class wherever u
    is above some threshold. Of these only those stay that a later row with a lower threshold doesn't hide.
    """
    cost = F.lit(0.5)
    for k, c in costs.items():
        cost = F.when(F.col("class") == k, c / 100).otherwise(cost)
    rows = spatial.voxelise(points, size).withColumn("part", F.lit(0) if part is None else part)
    items = F.sort_array(F.collect_list(F.struct("ts", "class", "u", cost.alias("cost"))))
    parts = rows.groupBy("ix", "iy", "iz", "part").agg(items.alias("items"), F.count(F.lit(1)).alias("n"))
    turns = "array<struct<above: double, class: int>>"
    state = lambda m, cost, u, t: F.struct(m.alias("m"), cost.alias("cost"), u.alias("u"), t.alias("turns"))

    def step(s: Column, e: Column) -> Column:
        above = F.when(s["m"] > 1e-200, (e["u"] + TIE - s["u"]) / s["m"]).when(e["u"] + TIE < s["u"], float("-inf")).otherwise(float("inf"))
        seen = F.filter(s["turns"], lambda t: t["above"] < above)
        more = F.concat(seen, F.array(F.struct(above.alias("above"), e["class"].cast("int").alias("class"))))
        keep = 1 - alpha
        return state(keep * s["m"], alpha * e["cost"] + keep * s["cost"], alpha * e["u"] + keep * s["u"], F.when(above < 2, more).otherwise(s["turns"]).cast(turns))

    folded = F.aggregate("items", state(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.array().cast(turns)), step)
    # A voxel's first row sets the averages; taken as its state before, it changes nothing as the first step.
    first = F.struct(F.col("items")[0]["cost"].alias("cost"), F.col("items")[0]["u"].alias("u"), F.col("items")[0]["class"].cast("int").alias("class"))
    parts = parts.select("ix", "iy", "iz", "part", "n", first.alias("first"), folded.alias("s"))
    runs = F.sort_array(F.collect_list(F.struct("part", "n", "first", "s")))
    grid = parts.groupBy("ix", "iy", "iz").agg(runs.alias("runs"), F.sum("n").alias("n"))
    start = F.col("runs")[0]["first"]

    def join(v: Column, r: Column) -> Column:
        hit = F.filter(r["s"]["turns"], lambda t: t["above"] < v["u"])
        now = F.when(F.size(hit) > 0, F.element_at(hit, -1)["class"]).otherwise(v["class"])
        return F.struct((r["s"]["m"] * v["cost"] + r["s"]["cost"]).alias("cost"), (r["s"]["m"] * v["u"] + r["s"]["u"]).alias("u"), now.alias("class"))

    return grid.withColumn("v", F.aggregate("runs", start, join)).select("ix", "iy", "iz", "n", "v.cost", "v.u", "v.class")


def project_costs(voxels: DataFrame, low: int, high: int, robot: int, ground: int, floor: int = 1) -> DataFrame:
    """Highest total cost of a column between two layers, from 0 to 100."""
    total = scalar.total_cost(F.col("cost"), F.col("u"), F.col("iz") > robot, (F.col("iz") < ground) & (F.col("class") == floor))
    return voxels.where(F.col("iz").between(low, high)).groupBy("ix", "iy").agg(F.max((100 * total).cast("int")).alias("cost"))


def occupancy(cells: DataFrame, free: list[int], least: float = 0.3, band: tuple[int, int] | None = None) -> DataFrame:
    """0 free, 100 obstacle (the highest of a column), -1 where nothing is confident. band: layers iz that count, both ends included."""
    if band:
        cells = cells.where(F.col("iz").between(*band))
    cost = F.when(F.col("confidence") >= least, F.when(F.col("class").isin(*free), 0).otherwise(100))
    return cells.groupBy("ix", "iy").agg(F.coalesce(F.max(cost), F.lit(-1)).alias("cost"))


def dense_rows(grid: DataFrame, unknown: int = -1, layers: tuple[str, ...] = ("cost",)) -> DataFrame:
    """(iy, one row of values for each layer): all cells between the smallest and largest ix, for each iy in the grid's range. Rows stay apart, so no task holds the whole grid."""
    b = grid.agg(F.min("ix").alias("x0"), F.max("ix").alias("x1"), F.min("iy").alias("y0"), F.max("iy").alias("y1"))
    rows = grid.groupBy("iy").agg(*(F.map_from_entries(F.collect_list(F.struct("ix", c))).alias(f"known_{c}") for c in layers))
    full = b.where("x0 IS NOT NULL").select("x0", "x1", F.explode(F.sequence("y0", "y1")).alias("iy")).join(rows, "iy", "left")
    at = lambda c: F.transform(F.sequence("x0", "x1"), lambda i: F.coalesce(F.try_element_at(f"known_{c}", i), F.lit(unknown)))
    return full.select("iy", *(at(c).alias("row" if c == "cost" and len(layers) == 1 else c) for c in layers))


def query_points(points: DataFrame, cells: DataFrame, obstacles: DataFrame) -> DataFrame:
    """For each point (id, x, y, z in cells): the cell that holds it, and the distance to the nearest obstacle's centre."""
    at = points.select("id", *(F.floor(k).cast("int").alias(f"i{k}") for k in "xyz"))
    centres = obstacles.select((F.monotonically_increasing_id()).alias("id"), *((F.col(f"i{k}") + 0.5).alias(k) for k in "xyz"))
    near = spatial.nearest_of_all(points.select("id", "x", "y", "z"), centres, 2.0)
    found = at.join(cells.select("ix", "iy", "iz", "class", "confidence", "n"), ["ix", "iy", "iz"], "left")
    return found.join(near.select("id", F.col("distance").alias("obstacle")), "id", "left").select("id", "class", "confidence", F.coalesce("n", F.lit(0)).alias("n"), "obstacle")


def get_map(cells: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int], least: float, seen: int, factor: int, most: int) -> DataFrame:
    """Up to `most` cells of a box at a coarser resolution, each with the class of its surest part; the surest first, then by index."""
    part = cells.where(inside(low, high) & (F.col("confidence") >= least) & (F.col("n") >= seen))
    coarse = part.groupBy(*(F.floor(F.col(f"i{k}") / factor).cast("int").alias(f"i{k}") for k in "xyz"))
    best = F.max(F.struct("confidence", (-F.col("class")).alias("minus")))
    out = coarse.agg(best.alias("b"), F.sum("n").alias("n")).select("ix", "iy", "iz", (-F.col("b.minus")).alias("class"), "b.confidence", "n")
    return out.orderBy(F.desc("confidence"), "ix", "iy", "iz").limit(most)


def best_by_strategy(goals: DataFrame, k: int, far: float) -> DataFrame:
    """The k best goals (id, gain, d, size) by gain, nearness, size, and gain less a share of the distance; ties by id."""
    scores = {"emi": F.col("gain"), "nearest": -F.col("d"), "largest": F.col("size"), "hybrid": F.col("gain") - 0.3 * F.col("d") / far}
    tops = []
    for name, score in scores.items():
        top = goals.select(F.lit(name).alias("strategy"), "id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
        tops.append(top.withColumn("rank", F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("score"), "id"))))
    return reduce(DataFrame.unionByName, tops).select("strategy", "rank", "id", "score")
