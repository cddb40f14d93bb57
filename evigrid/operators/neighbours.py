"""Neighbours within a radius as counts or components, without a row for each pair."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph

#: Pairs of points that two cells may make; cells with more are cut in eight each, at most DEEPEST times.
OPEN, DEEPEST = 1 << 16, 20

_AXES = "xyz"


def _at(df: DataFrame, radius: float, level: int, prefix: str = "c") -> DataFrame:
    return df.withColumns({f"{prefix}{k}": F.floor(F.col(k) / (radius / 2**level)) for k in _AXES})


def _named(prefix: str) -> list[str]:
    return [f"{prefix}{k}" for k in _AXES]


def _boxes():
    return [f(k).alias(f"{name}{k}") for k in _AXES for name, f in (("lo", F.min), ("hi", F.max))]


def _square(d):
    return sum((x * x for x in d), F.lit(0.0))


def _met(pairs: DataFrame):
    """The least and the largest squared distance that the boxes of two cells a and b allow."""
    gap = [F.greatest(F.col(f"a_lo{k}") - F.col(f"b_hi{k}"), F.col(f"b_lo{k}") - F.col(f"a_hi{k}"), F.lit(0.0)) for k in _AXES]
    reach = [F.greatest(F.col(f"a_hi{k}") - F.col(f"b_lo{k}"), F.col(f"b_hi{k}") - F.col(f"a_lo{k}")) for k in _AXES]
    return _square(gap), _square(reach)


def neighbour_counts(df: DataFrame, radius: float) -> DataFrame:
    """(id, n, same) of rows (id, x, y, z, label; ids are different): other rows closer than radius, and those of the same label. Rows without a position have none.

    Cells as wide as the radius meet their neighbours. The boxes around the points of two cells tell whether all pairs are near, none is, or some
    are. Near cells add their counts by label to each other, whole; others are opened if that makes few pairs, or else meet again as
    cells of half the width. So a crowd costs what lies about its spheres, not all its pairs. Each level is cut by checkpoint().
    """
    points = df.select("id", *(F.col(k).cast("double").alias(k) for k in _AXES), "label").dropna(subset=list(_AXES)).checkpoint()
    found, pairs, level = [], None, 0
    while True:
        cells = _at(points, radius, level).groupBy(*_named("c")).agg(F.count(F.lit(1)).alias("n"), *_boxes()).checkpoint()
        if pairs is None:
            own = cells.select(*(F.col(c).alias(f"a_{c}") for c in cells.columns), *(F.col(f"c{k}").alias(f"m{k}") for k in _AXES))
            other = cells.select(*(F.col(c).alias(f"b_{c}") for c in cells.columns))
            for k in _AXES:
                other = other.withColumn(f"m{k}", F.explode(F.array(*(F.col(f"b_c{k}") + d for d in (-1, 0, 1)))))
            pairs = own.join(other, _named("m")).drop(*_named("m"))
        else:  # the children of both sides of each pair that was left
            child = cells.withColumns({f"p{k}": F.floor(F.col(f"c{k}") / 2) for k in _AXES})
            for s in "ab":
                side = child.select(*(F.col(c).alias(f"{s}_{c}") for c in cells.columns), *(F.col(f"p{k}").alias(f"{s}p{k}") for k in _AXES))
                pairs = pairs.join(side, _named(f"{s}p")).drop(*_named(f"{s}p"))
        gap, reach = _met(pairs)
        kind = F.when(reach < radius * radius, "whole").when((F.col("a_n") * F.col("b_n") <= OPEN) | F.lit(level == DEEPEST), "open").otherwise("halve")
        met = pairs.where(gap < radius * radius).select(*(f"{s}_c{k}" for s in "ab" for k in _AXES), "b_n", kind.alias("kind")).checkpoint()
        found += [_whole(points, met.where("kind = 'whole'"), radius, level), _opened(points, met.where("kind = 'open'"), radius, level)]
        rest = met.where("kind = 'halve'")
        if rest.isEmpty():
            break
        pairs = rest.select(*(F.col(f"{s}_c{k}").alias(f"{s}p{k}") for s in "ab" for k in _AXES))
        level += 1
    every = reduce(DataFrame.unionByName, found).groupBy("id").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))
    out = df.select("id").join(every, "id", "left")
    return out.select("id", *(F.coalesce(F.col(c) - 1, F.lit(0)).alias(c) for c in ("n", "same")))  # a row is near itself


def _whole(points: DataFrame, met: DataFrame, radius: float, level: int) -> DataFrame:
    """(id, n, same) from cells all of whose points are near."""
    placed = _at(points, radius, level, "b_c")
    labels = placed.groupBy(*_named("b_c"), "label").agg(F.count(F.lit(1)).alias("c"))
    total = met.groupBy(*_named("a_c")).agg(F.sum("b_n").alias("n"))
    same = met.join(labels, _named("b_c")).groupBy(*_named("a_c"), "label").agg(F.sum("c").alias("same"))
    own = _at(points, radius, level, "a_c")
    out = own.join(total, _named("a_c")).join(same, [*_named("a_c"), "label"], "left")
    return out.select("id", "n", F.coalesce("same", F.lit(0)).alias("same"))


def _opened(points: DataFrame, met: DataFrame, radius: float, level: int) -> DataFrame:
    """(id, n, same) from the pairs of points of two cells."""
    side = lambda s: _at(points, radius, level, f"{s}_c").select(*_named(f"{s}_c"), *(F.col(c).alias(f"{s}_{c}") for c in ("id", *_AXES, "label")))
    both = met.select(*_named("a_c"), *_named("b_c")).join(side("a"), _named("a_c")).join(side("b"), _named("b_c"))
    d2 = sum(((F.col(f"a_{k}") - F.col(f"b_{k}")) * (F.col(f"a_{k}") - F.col(f"b_{k}")) for k in _AXES), F.lit(0.0))
    near = both.where(d2 < radius * radius).groupBy(F.col("a_id").alias("id"))
    return near.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a_label").eqNullSafe(F.col("b_label"))).alias("same"))


#: Steps from a cell of half the radius to those, on one side of it, that can hold nearer points.
FORWARD = [d for d in product(range(-2, 3), repeat=3) if d > (0, 0, 0)]


def near_components(df: DataFrame, radius: float) -> DataFrame:
    """(id, component) of rows (id, x, y, z): the smallest id reachable by steps closer than radius. Rows without another id in reach, an id or a finite position have none.

    Points of a cell half as wide as the radius are all near each other: each is linked with the cell's smallest id, its stand-in. Two cells whose
    stand-ins are near, or whose boxes lie within the radius, are linked by these. What matters of the others is only whether any two points are
    near, and only where the links so far leave the cells apart: such cells are opened if that makes few pairs, or else meet again as cells of
    half the width, until one near pair is found or none is left. So rows grow with points and cells, not with pairs. Each level is cut by checkpoint().
    """
    points = df.select("id", *(F.col(k).cast("double").alias(k) for k in _AXES)).dropna()
    points = points.where(reduce(lambda a, b: a & b, (F.abs(k) < float("inf") for k in _AXES)))
    points = points.withColumns({f"c{k}": F.floor(F.col(k) / (radius / 2)).cast("int").cast("long") for k in _AXES}).checkpoint()
    stand_in = F.min(F.struct("id", *_AXES)).alias("p")
    cells = points.groupBy(*_named("c")).agg(stand_in, F.count(F.lit(1)).alias("n"), *_boxes()).checkpoint()
    star = points.join(cells.select(*_named("c"), F.col("p.id").alias("to")), _named("c")).where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b"))

    own = cells.select(*(F.col(c).alias(f"a_{c}") for c in cells.columns), *(F.col(f"c{k}").alias(f"m{k}") for k in _AXES))
    steps = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(_AXES, d, strict=True))) for d in FORWARD))
    other = cells.select(*(F.col(c).alias(f"b_{c}") for c in cells.columns), F.explode(steps).alias("d"))
    other = other.withColumns({f"m{k}": F.col(f"b_c{k}") - F.col(f"d.{k}") for k in _AXES}).drop("d")
    pairs = own.join(other, _named("m")).drop(*_named("m"))
    gap, reach = _met(pairs)
    near = (_square(F.col(f"a_p.{k}") - F.col(f"b_p.{k}") for k in _AXES) < radius * radius) | (reach < radius * radius)
    at = [f"{s}_c{k}" for s in "ab" for k in _AXES]
    met = pairs.where(gap < radius * radius).select(F.col("a_p.id").alias("a"), F.col("b_p.id").alias("b"), *at, (F.col("a_n") * F.col("b_n")).alias("many"), near.alias("near")).checkpoint()
    labels = graph.components(star.union(met.where("near AND a <> b").select("a", "b")))

    rest = met.where("NOT near")
    for s in "ab":
        known = labels.select(F.col("id").alias(s), F.col("component").alias(f"{s}_in"))
        rest = rest.join(known, s, "left").withColumn(f"{s}_in", F.coalesce(f"{s}_in", s))
    rest = rest.where("a_in <> b_in").select(F.col("a_in").alias("a"), F.col("b_in").alias("b"), *at, "many").checkpoint()
    found, level = None, 0
    while not rest.isEmpty():
        placed = _halved(points, radius, level)
        few = (F.col("many") <= OPEN) | F.lit(level == DEEPEST)
        opened = rest.where(few).drop("many")
        for s in "ab":
            opened = opened.join(placed.select(*(F.col(c).alias(f"{s}_{c}") for c in placed.columns)), [f"{s}_c{k}" for k in _AXES])
        d2 = _square(F.col(f"a_{k}") - F.col(f"b_{k}") for k in _AXES)
        hit = opened.where(d2 < radius * radius).select("a", "b").distinct()
        level += 1
        child = _halved(points, radius, level).groupBy(*_named("c")).agg(F.count(F.lit(1)).alias("n"), *_boxes())
        child = child.withColumns({f"p{k}": F.floor(F.col(f"c{k}") / 2) for k in _AXES}).checkpoint()
        pairs = rest.where(~few).drop("many").withColumnsRenamed({c: c.replace("c", "p") for c in at})
        for s in "ab":
            pairs = pairs.join(child.select(*(F.col(c).alias(f"{s}_{c}") for c in child.columns)), [f"{s}_p{k}" for k in _AXES])
        gap, reach = _met(pairs)
        met = pairs.where(gap < radius * radius).select("a", "b", *at, (F.col("a_n") * F.col("b_n")).alias("many"), (reach < radius * radius).alias("near")).checkpoint()
        hit = hit.union(met.where("near").select("a", "b")).distinct().checkpoint()
        found = hit if found is None else found.union(hit)
        rest = met.where("NOT near").drop("near").join(hit, ["a", "b"], "left_anti").checkpoint()
    if found is None or found.isEmpty():
        return labels
    merged = graph.components(found).select(F.col("id").alias("component"), F.col("component").alias("to"))
    alone = merged.join(labels, F.col("id") == merged["component"], "left_anti").select(F.col("component").alias("id"), "component")
    return labels.union(alone).join(merged, "component", "left").select("id", F.coalesce("to", "component").alias("component"))


def _halved(points: DataFrame, radius: float, level: int) -> DataFrame:
    """x, y, z and the cell of each point, half the radius wide at level 0."""
    return points.select(*_AXES, *(F.floor(F.col(k) / (radius / 2 ** (level + 1))).alias(f"c{k}") for k in _AXES))
