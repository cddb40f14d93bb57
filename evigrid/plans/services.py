"""Queries of the services of a map, its parameters, and what displays need."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import scalar as S
from ..operators import maps, services, spatial
from ..sources import sinks
from ..sources.tables import points, table, vectors
from .mapping import robots
from .queries import BLOCKED, CLASSES, FREE, PALETTE, POINTS, VECTORS, VOXEL, query
from .sequences import GAUSSIANS, gaussians


def r(c, name, digits=6):
    return F.round(c, digits).alias(name)


def world(spark, sf_dir):
    return services.evidence_cells(points(spark, sf_dir), VOXEL, CLASSES)


#: Cells with probabilities; nav as services.nav_cost, key as maps.cell_key.
WORLD = f"""{POINTS}, vox AS (SELECT CAST(floor(x / 2.0) AS INT) AS ix, CAST(floor(y / 4.0) AS INT) AS iy, CAST(floor(z / 1.0) AS INT) AS iz, class FROM pts),
  cnt AS (SELECT ix, iy, iz, count(*) AS n, list_transform(range(6), lambda k: 0) AS z, [{', '.join(f'count(*) FILTER (class = {k})' for k in range(6))}] AS c FROM vox GROUP BY ix, iy, iz),
  pro AS (SELECT ix, iy, iz, n, list_transform(c, lambda v: v / n) AS p FROM cnt),
  wld AS (SELECT *, CASE WHEN class IN (0, 2) THEN 0 WHEN class IN (3, 5) OR confidence > 0.5 THEN 100 ELSE -1 END AS nav, ((ix + 1048576)::BIGINT * 2097152 + iy + 1048576) * 2097152 + iz + 1048576 AS key
    FROM (SELECT *, CAST(list_position(p, list_max(p)) - 1 AS INT) AS class, list_max(p) AS confidence FROM pro)),
  robot AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey * 0.9::DOUBLE + 1.37 AS x, n_regionkey * 4 + 3.41::DOUBLE AS y, n_nationkey % 5 + 2.53::DOUBLE AS z FROM nation),
  far AS (SELECT id, key, ix, iy, iz, class, nav, confidence, (x - ix - 0.5) * (x - ix - 0.5) + (y - iy - 0.5) * (y - iy - 0.5) + (z - iz - 0.5) * (z - iz - 0.5) AS d2 FROM robot, wld)"""


@query(f"""WITH {WORLD}, ex AS (SELECT id, key FROM robot JOIN wld ON ix = CAST(floor(x) AS INT) AND iy = CAST(floor(y) AS INT) AND iz = CAST(floor(z) AS INT)),
  nr AS (SELECT id, arg_min(key, d2) AS key, count(*) AS neighbours FROM far WHERE d2 < 2.25 GROUP BY id), ob AS (SELECT id, round(sqrt(min(d2)), 6) AS obstacle FROM far WHERE nav = 100 AND confidence >= 0.5 GROUP BY id), wk AS (SELECT id, round(sqrt(min(d2)), 6) AS walk FROM far WHERE class IN (0, 2) AND d2 < 36 GROUP BY id)
  SELECT robot.id, w.n IS NOT NULL AS found, w.class, list_transform(w.p, lambda v: round(v, 6)) AS p, round(coalesce(w.confidence, 0), 6) AS confidence, round(coalesce(1 - w.confidence, 1), 6) AS uncertainty,
    round(coalesce(-list_sum(list_transform(w.p, lambda v: CASE WHEN v > 1e-10 THEN v * ln(v) ELSE 0 END)) / ln(6.0), 1), 6) AS entropy, coalesce(w.n, 0) AS n, coalesce(w.class IN (0, 2), FALSE) AS traversable, coalesce(w.nav = 100 AND w.confidence >= 0.5, FALSE) AS occupied, CAST(coalesce(w.nav, -1) AS INT) AS nav_cost,
    round(coalesce(exp(-walk), 0), 6) AS reachability, obstacle, coalesce(neighbours, 0) AS neighbours, w.ix + 0.5::DOUBLE AS cell_x, w.iy + 0.5::DOUBLE AS cell_y, w.iz + 0.5::DOUBLE AS cell_z
  FROM robot LEFT JOIN ex USING (id) LEFT JOIN nr USING (id) LEFT JOIN wld w ON w.key = coalesce(ex.key, nr.key) LEFT JOIN ob ON ob.id = robot.id LEFT JOIN wk ON wk.id = robot.id""")
def q1_query_point_in_full(spark, sf_dir):
    """All that the map knows at each robot's place or, within 1.5 cells, beside it."""
    out = services.query_points(robots(spark, sf_dir), world(spark, sf_dir), FREE, BLOCKED, 1.5)
    rounded = {k: F.round(k, 6) for k in ("confidence", "uncertainty", "entropy", "reachability")}
    return out.withColumns(rounded).withColumn("p", F.transform("p", lambda v: F.round(v, 6)))


SUMMARY = "count(*) AS cells, count(*) FILTER (n > 0) AS observed, count(*) FILTER (class IN (0, 2)) AS traversable, count(*) FILTER (nav = 100 AND confidence >= 0.5) AS obstacles"
COUNTS = f"[{', '.join(f'count(*) FILTER (class = {k})' for k in range(6))}]"


@query(f"""WITH {WORLD}, g AS (SELECT {SUMMARY}, {COUNTS} AS class_counts, avg(confidence) AS m, avg(ix + 0.5) AS a, avg(iy + 0.5) AS b, avg(iz + 0.5) AS c FROM wld WHERE ix BETWEEN 2 AND 15 AND iy BETWEEN 1 AND 12 AND iz BETWEEN 0 AND 7 AND confidence >= 0.2 AND class IN (0, 1, 2, 3, 4))
  SELECT cells, observed, traversable, obstacles, CAST(list_position(class_counts, list_max(class_counts)) - 1 AS INT) AS dominant, round(list_max(class_counts) / cells, 6) AS dominant_share, class_counts, round(m, 6) AS mean_confidence, round(1 - m, 6) AS mean_uncertainty, round(observed / (14 * 12 * 8), 6) AS coverage, round(a, 6) AS centroid_x, round(b, 6) AS centroid_y, round(c, 6) AS centroid_z FROM g""")
def q2_region_in_full(spark, sf_dir):
    """One row about a box of the map."""
    out = services.region(world(spark, sf_dir), ((2, 1, 0), (15, 12, 7)), CLASSES, FREE, BLOCKED, [0, 1, 2, 3, 4], 0.2)
    return out.withColumns({k: F.round(k, 6) for k in ("dominant_share", "mean_confidence", "mean_uncertainty", "coverage", "centroid_x", "centroid_y", "centroid_z")})


@query(f"WITH {WORLD} SELECT ix, iy, iz, class, round(confidence, 6) AS confidence FROM wld WHERE ix BETWEEN 2 AND 15 AND iy BETWEEN 1 AND 12 AND iz BETWEEN 0 AND 7 AND class = 3 AND confidence >= 0.3 AND n > 0")
def f7_f8_f9_f15_cells(spark, sf_dir):
    """The observed cells of a box that have one class and are sure of it."""
    w = world(spark, sf_dir).where(maps.inside((2, 1, 0), (15, 12, 7)) & (F.col("n") > 0))
    return w.where("class = 3 AND confidence >= 0.3").select("ix", "iy", "iz", "class", r(F.col("confidence"), "confidence"))


@query(f"""WITH {WORLD}, g AS (SELECT count(*) AS known, count(*) FILTER (nav = 100) AS occupied, count(*) FILTER (nav = 0) AS free, count(*) FILTER (class IN (0, 2)) AS traversable, count(*) FILTER (nav = 100 AND confidence >= 0.5) AS obstacles, min(confidence) AS lo, avg(confidence) AS m, max(confidence) AS hi, sum(n)::BIGINT AS observations, avg(n) AS mo, max(n) AS max_observations, {COUNTS} AS class_counts FROM wld)
  SELECT 7425::BIGINT AS total, known, 7425 - known AS unknown, occupied, free, traversable, obstacles, round(known / 7425, 6) AS coverage, round(lo, 6) AS min_confidence, round(m, 6) AS mean_confidence, round(hi, 6) AS max_confidence, round(1 - hi, 6) AS min_uncertainty, round(1 - m, 6) AS mean_uncertainty, round(1 - lo, 6) AS max_uncertainty,
    observations, round(mo, 6) AS mean_observations, max_observations, class_counts, list_transform(class_counts, lambda v: round(v / known, 6)) AS class_shares, known * 88 AS bytes FROM g""")
def q4_q9_map_info_in_full(spark, sf_dir):
    """One row about the map."""
    out = services.map_info(world(spark, sf_dir), (25, 27, 11), CLASSES, FREE, BLOCKED)
    names = [f"{f}_{k}" for f in ("min", "mean", "max") for k in ("confidence", "uncertainty")] + ["coverage", "mean_observations"]
    return out.withColumns({k: F.round(k, 6) for k in names}).withColumn("class_shares", F.transform("class_shares", lambda v: F.round(v, 6)))


@query(f"WITH {WORLD} SELECT robot.id, CAST(arg_min(key, d2) AS BIGINT) AS cell, round(sqrt(min(d2)), 6) AS distance FROM robot LEFT JOIN (SELECT * FROM far WHERE class IN (0, 2) AND d2 < 9) f USING (id) GROUP BY robot.id")
def j24_nearest_traversable(spark, sf_dir):
    """The nearest cell to walk on, less than three cells from each robot."""
    return services.nearest_traversable(robots(spark, sf_dir), world(spark, sf_dir), FREE, 3.0)


def _halves(spark, sf_dir):
    return [services.evidence_cells(points(spark, sf_dir).where(c), VOXEL, CLASSES).select("ix", "iy", "iz", "class", r(F.col("confidence"), "confidence", 5)) for c in ("u > 0.5", "u <= 0.5")]


#: Five digits, so that no mean of two ends in a 5 that the engines round in different ways.

_HALF = "SELECT ix, iy, iz, arg_max(class, c * 100 - class) AS class, round(max(c) / sum(c), 5) AS confidence FROM (SELECT CAST(floor(x / 2.0) AS INT) AS ix, CAST(floor(y / 4.0) AS INT) AS iy, CAST(floor(z / 1.0) AS INT) AS iz, class, count(*) AS c FROM pts WHERE u {} 0.5 GROUP BY ALL) GROUP BY ix, iy, iz"
#: A quarter turn about z takes (x, y) to (-y, x); cells are 2 by 4, so several meet in one.
MOVED = f"""{POINTS}, l AS ({_HALF.format('>')}), r0 AS ({_HALF.format('<=')}),
  m AS (SELECT CAST(floor(round(-(iy + 0.5) * 4 + 100, 9) / 2) AS INT) AS ix, CAST(floor(round((ix + 0.5) * 2 + 3, 9) / 4) AS INT) AS iy, CAST(floor(round((iz + 0.5) * 1 + 0.25, 9)) AS INT) AS iz, class, confidence FROM r0),
  r AS (SELECT ix, iy, iz, arg_max(class, confidence * 1e9 - class) AS class, max(confidence) AS confidence FROM m GROUP BY ALL)"""


@query(f"""WITH {MOVED}, w AS (SELECT ix, iy, iz, l.class AS lc, l.confidence AS lk, r.class AS rc, r.confidence AS rk, CASE WHEN l.class IS NULL OR r.confidence > l.confidence THEN coalesce(r.class, l.class) ELSE l.class END AS best, CASE WHEN l.class IS NULL OR r.confidence > l.confidence THEN coalesce(r.confidence, l.confidence) ELSE l.confidence END AS sure FROM l FULL JOIN r USING (ix, iy, iz))
  SELECT 'overwrite' AS mode, ix, iy, iz, coalesce(rc, lc) AS class, coalesce(rk, lk) AS confidence FROM w UNION ALL SELECT 'average', ix, iy, iz, best, round(coalesce((lk + rk) / 2, sure), 6) FROM w UNION ALL SELECT 'confidence', ix, iy, iz, best, sure FROM w""")
def q6_load_and_merge(spark, sf_dir):
    """A saved map turned by a quarter, shifted, and merged into another, in each mode."""
    left, right = _halves(spark, sf_dir)
    half = 0.5**0.5
    new = services.moved(right, (half, 0.0, 0.0, half), (100.0, 3.0, 0.25), VOXEL)
    out = [maps.merge(left, new, mode).select(F.lit(mode).alias("mode"), "ix", "iy", "iz", "class", "confidence") for mode in ("overwrite", "average", "confidence")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""WITH {WORLD}, k AS (SELECT 'full' AS mode, 0 AS remaining, 0 AS observations, 0 AS known UNION ALL SELECT 'partial', count(*), sum(n), count(*) FILTER (class >= 0) FROM wld WHERE NOT (ix BETWEEN 3 AND 9 AND iy BETWEEN 3 AND 9 AND iz BETWEEN 0 AND 10) UNION ALL SELECT 'soft', count(*), 0, 0 FROM wld)
  SELECT mode, (SELECT count(*) FROM wld) - CASE WHEN mode = 'soft' THEN 0 ELSE remaining END AS cleared, CAST(remaining AS BIGINT) AS remaining, CAST(observations AS BIGINT) AS observations, CAST(known AS BIGINT) AS known FROM k""")
def q7_t10_reset_modes(spark, sf_dir):
    """Cells that each kind of reset clears (a soft one clears all observations) and leaves."""
    w = world(spark, sf_dir)
    total = w.agg(F.count(F.lit(1)).alias("c"))
    out = None
    for mode in ("full", "partial", "soft"):
        left = services.reset(w, mode, ((3, 3, 0), (9, 9, 10)))
        g = left.agg(F.count(F.lit(1)).alias("remaining"), F.coalesce(F.sum("n"), F.lit(0)).alias("observations"), F.count_if(F.col("class") >= 0).alias("known"))
        g = g.select(F.lit(mode).alias("mode"), (total.scalar() - (0 if mode == "soft" else F.col("remaining"))).alias("cleared"), "remaining", "observations", "known")
        out = g if out is None else out.unionByName(g)
    return out


@query("""WITH c AS (SELECT count(*) FILTER (event_type = 'click') + 0.0 AS a, count(*) FILTER (event_type = 'view') + 0.0 AS b, count(*) FILTER (event_type = 'error') + 0.0 AS c, count(*) FILTER (event_type = 'signup') + 0.0 AS d, round(max(value), 3) AS top FROM events)
  SELECT 'uncertainty.w_semantic' AS name, round(a / (a + b + c + d), 9)::DOUBLE AS value FROM c UNION ALL SELECT 'uncertainty.w_spatial', round(b / (a + b + c + d), 9) FROM c UNION ALL SELECT 'uncertainty.w_observation', round(c / (a + b + c + d), 9) FROM c
  UNION ALL SELECT 'uncertainty.w_temporal', round(d / (a + b + c + d), 9) FROM c UNION ALL SELECT 'kernel.gamma', top FROM c UNION ALL SELECT 'map.resolution', 0.1 UNION ALL SELECT 'primitives.target_primitives', 128.0""")
def q8_s13_k14_parameters(spark, sf_dir):
    """Parameters that were saved, loaded with a change, and updated in some groups by what the events say: what holds at the end."""
    text = config.save(config.Config()).replace("resolution: 0.05", "resolution: 0.1  # metres")
    kinds = {"w_semantic": "click", "w_spatial": "view", "w_observation": "error", "w_temporal": "signup"}
    seen = table(spark, sf_dir, "events").agg(*(F.count_if(F.col("event_type") == k).alias(n) for n, k in kinds.items()), F.round(F.max("value"), 3).alias("top")).first()
    weights = {n: float(seen[n]) for n in kinds}
    own, _, _ = config.update(config.load(text), {"uncertainty": weights, "kernel": {"gamma": seen["top"], "none": 1}, "primitives": {"target_primitives": 9}}, {"uncertainty", "kernel"})
    names = [*(f"uncertainty.{n}" for n in kinds), "kernel.gamma", "map.resolution", "primitives.target_primitives"]
    rows = [(n, round(float(getattr(getattr(own, n.split(".")[0]), n.split(".")[1])), 9)) for n in names]
    return spark.createDataFrame(rows, "name string, value double")


@query("WITH w AS (SELECT p_partkey AS id, p_size::DOUBLE AS a, p_partkey % 7 + 0.0::DOUBLE AS b, p_partkey % 3 + 0.0::DOUBLE AS c FROM part) SELECT id, round(a / (a + b + c), 6) AS a, round(b / (a + b + c), 6) AS b, round(c / (a + b + c), 6) AS c, abs(a + b + c - 1) < 0.001 AS valid FROM w")
def m5_weight_normalisation(spark, sf_dir):
    """Weights that sum to 1, and whether they did before."""
    k = F.col("p_partkey")
    w = [F.col("p_size").cast("double"), (k % 7).cast("double"), (k % 3).cast("double")]
    new, valid = S.normalised(w)
    return table(spark, sf_dir, "part").select(k.alias("id"), *(r(c, n) for c, n in zip(new, "abc", strict=True)), valid.alias("valid"))


@query(f"""WITH {VECTORS}, e AS (SELECT id, label, CASE WHEN id % 5 = 0 THEN [] ELSE list_transform(logits, lambda v: greatest(v, 0)) END AS ev, CASE WHEN id % 3 = 0 THEN label / 8.0 ELSE -1 END AS given FROM vec)
  SELECT id, round(CASE WHEN given BETWEEN 0 AND 1 THEN given WHEN len(ev) > 0 THEN least(greatest(len(ev) / (list_sum(ev) + len(ev)), 0), 1) ELSE 1 END, 6) AS u FROM e""")
def m6_semantic_uncertainty(spark, sf_dir):
    """The given uncertainty where it is valid, else that of the evidence, else 1."""
    v = vectors(spark, sf_dir)
    i, given = F.col("id"), F.when(F.col("id") % 3 == 0, F.col("label") / 8.0).otherwise(-1.0)
    evidence = F.when(i % 5 == 0, F.array().cast("array<double>")).otherwise(F.transform("logits", lambda x: F.greatest(x, F.lit(0.0))))
    return v.select("id", r(S.semantic_uncertainty(given, evidence), "u"))


@query(f"WITH {GAUSSIANS} SELECT id FROM gs WHERE n >= 40 AND id % 4 / 10.0 < 0.3 AND u <= 0.7")
def f6_primitive_gates(spark, sf_dir):
    """Primitives with enough points, little conflict, and little uncertainty."""
    return spatial.gate(gaussians(spark, sf_dir), 40, 0.3, 0.7).select("id")


@query(f"WITH {POINTS} SELECT class, count(*) AS n FROM pts WHERE x >= 5 AND x < 5 + 30 AND y >= 10 AND y < 10 + 50 AND z >= 0 AND z < 0 + 9 GROUP BY class")
def f5_map_bounds(spark, sf_dir):
    """Points within the map: its origin belongs to it, its far faces don't."""
    return points(spark, sf_dir).where(maps.within((5.0, 10.0, 0.0), (30.0, 50.0, 9.0))).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {GAUSSIANS}, i AS (SELECT *, cxx*(cyy*czz-cyz*cyz)-cxy*(cxy*czz-cxz*cyz)+cxz*(cxy*cyz-cxz*cyy) AS det FROM gs), d AS (SELECT i.id AS prim, ((cyy*czz-cyz*cyz)*dx*dx + (cxx*czz-cxz*cxz)*dy*dy + (cxx*cyy-cxy*cxy)*dz*dz + 2*((cxz*cyz-cxy*czz)*dx*dy + (cxy*cyz-cxz*cyy)*dx*dz + (cxy*cxz-cxx*cyz)*dy*dz)) / det AS m2 FROM (SELECT i.*, v.x - i.x AS dx, v.y - i.y AS dy, v.z - i.z AS dz FROM i, vec v) i) SELECT prim, count(*) AS points FROM d WHERE sqrt(greatest(m2, 0)) < 1.5 GROUP BY prim")
def m34_m16_support(spark, sf_dir):
    """Points in the support of each primitive."""
    return services.support(gaussians(spark, sf_dir), vectors(spark, sf_dir), 1.5).groupBy("prim").agg(F.count(F.lit(1)).alias("points"))


RELEVANT = [5, 2, 9, 2, 0]


@query(f"WITH {POINTS}, k AS (SELECT CASE class WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 5 THEN 2 ELSE 4 END AS class, count(*) AS points FROM pts GROUP BY 1) SELECT k.class, points, r, g, b FROM k JOIN (VALUES (0, 0, 0, 0), (1, 0, 128, 0), (2, 200, 200, 200), (3, 255, 165, 0), (4, 255, 165, 0)) t(class, r, g, b) USING (class)")
def p6_o5_compact_palette(spark, sf_dir):
    """Points by compact class, and its colour."""
    colours = F.array(*(F.array(*map(F.lit, c)) for c in services.palette(RELEVANT, PALETTE)))
    counted = points(spark, sf_dir).groupBy(S.remap(F.col("class"), RELEVANT).alias("class")).agg(F.count(F.lit(1)).alias("points"))
    return counted.select("class", "points", *(F.get(colours, F.col("class"))[i].alias(c) for i, c in enumerate("rgb")))


NAMES = ["floor", "wall", "rug", "chair", "table", "door"]
LEGEND = ", ".join(f"({k}, '{n}', {c[0]}, {c[1]}, {c[2]})" for k, (n, c) in enumerate(zip(NAMES, PALETTE, strict=True)))


@query(f"WITH {WORLD} SELECT l.class, name, r, g, b, count(wld.class) AS cells FROM (VALUES {LEGEND}) l(class, name, r, g, b) LEFT JOIN wld ON wld.class = l.class GROUP BY ALL")
def k18_legend(spark, sf_dir):
    """What stands beside a map coloured by class."""
    return services.legend(NAMES, PALETTE, world(spark, sf_dir))


def _ramp(v):
    return f"CAST(round(255 * greatest(0, 2 * {v} - 1)) AS INT) AS r, CAST(round(255 * (1 - abs(2 * {v} - 1))) AS INT) AS g, CAST(round(255 * greatest(0, 1 - 2 * {v})) AS INT) AS b"


@query(f"""WITH {WORLD}, c AS (SELECT ix, iy, iz, class, round(confidence, 4) AS c FROM wld) SELECT 'confidence' AS by, ix, iy, iz, {_ramp('c')} FROM c UNION ALL SELECT 'uncertainty', ix, iy, iz, {_ramp('(1 - c)')} FROM c
  UNION ALL SELECT 'class', ix, iy, iz, {', '.join('CASE class ' + ' '.join(f'WHEN {k} THEN {c[i]}' for k, c in enumerate(PALETTE[:5])) + ' ELSE 128 END' for i in range(3))} FROM c""")
def k2_k3_k18_p9_coloured_cells(spark, sf_dir):
    """The map as a display shows it: by class (grey outside the palette), by confidence, by uncertainty."""
    cells = world(spark, sf_dir).withColumn("confidence", F.round("confidence", 4))
    views = [sinks.coloured(cells, by, PALETTE[:5]).select(F.lit(by).alias("by"), "ix", "iy", "iz", "r", "g", "b") for by in ("class", "confidence", "uncertainty")]
    return views[0].unionByName(views[1]).unionByName(views[2])


@query(f"""WITH {WORLD}, f6(a, b, c) AS (VALUES (1,0,0), (-1,0,0), (0,1,0), (0,-1,0), (0,0,1), (0,0,-1)), fr AS (SELECT key, ix, iy, iz, count(*) AS u FROM wld s, f6 WHERE NOT EXISTS (SELECT 1 FROM wld t WHERE t.ix = s.ix + a AND t.iy = s.iy + b AND t.iz = s.iz + c) GROUP BY ALL),
  g AS (SELECT *, row_number() OVER (ORDER BY u DESC, key) AS rank FROM fr) SELECT 'frontier' AS kind, key AS id, ix + 0.5::DOUBLE AS x, iy + 0.5::DOUBLE AS y, iz + 0.5::DOUBLE AS z, 1.0::DOUBLE AS scale FROM fr UNION ALL SELECT 'goal', rank, ix, iy, iz, CASE WHEN rank = 1 THEN 2.0 ELSE 1.0 END FROM g WHERE rank <= 5""")
def k17_frontier_markers(spark, sf_dir):
    """Frontier cells and the five goals with the most unknown faces."""
    edge = maps.frontier(world(spark, sf_dir))
    ranked = maps.rank_goals(edge.select(maps.cell_key().alias("id"), F.col("unknown").alias("utility"), *(F.col(f"i{k}").cast("double").alias(k) for k in "xyz")), 5)
    return services.frontier_markers(edge, ranked)
