"""Queries of evidence maps, views, goals and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalar as S
from ..operators import graph, influence, maps, spatial, visibility
from ..sources.tables import points, table, vectors
from .queries import CELLS, COSTS, POINTS, VECTORS, cells, query


def r(c, name, digits=6):
    return F.round(c, digits).alias(name)


RES, LENGTH, CLASSES = 0.02, 0.5, 4


def primitives(spark, sf_dir):
    """A primitive per label of the vectors: rounded moments, so that both engines start from equal numbers."""
    v = vectors(spark, sf_dir)
    moment = lambda a, b: F.avg(F.col(a) * F.col(b)) - F.avg(a) * F.avg(b) + (0.001 if a == b else 0.0)
    p = F.array(*(F.round(F.avg(F.exp(F.col("logits")[k])), 6) for k in range(CLASSES)))
    g = v.groupBy(F.col("label").cast("long").alias("id")).agg(*(r(F.avg(k), k) for k in "xyz"), *(r(moment(*k), f"c{k}") for k in G.ENTRIES), p.alias("e"))
    u = F.col("id") / 12.0
    share = F.transform("e", lambda x: F.round(x / S.total(F.col("e")), 6))
    return g.select("id", "x", "y", "z", *influence.COVARIANCE, u.alias("u"), F.lit(LENGTH).alias("length"), (F.col("id") % 5 == 0).alias("dynamic"), (F.col("id") % 2 == 0).alias("traversable"), share.alias("p"))


PRIMITIVES = f"""{VECTORS}, g0 AS (SELECT CAST(label AS BIGINT) AS id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, round(avg(x*x)-avg(x)*avg(x)+0.001, 6) AS a, round(avg(x*y)-avg(x)*avg(y), 6) AS b, round(avg(x*z)-avg(x)*avg(z), 6) AS c,
  round(avg(y*y)-avg(y)*avg(y)+0.001, 6) AS d, round(avg(y*z)-avg(y)*avg(z), 6) AS e, round(avg(z*z)-avg(z)*avg(z)+0.001, 6) AS f, [round(avg(exp(logits[1])), 6), round(avg(exp(logits[2])), 6), round(avg(exp(logits[3])), 6), round(avg(exp(logits[4])), 6)] AS ev FROM vec GROUP BY label),
  pr AS (SELECT *, id / 12.0 AS u, list_transform(ev, lambda v: round(v / list_sum(ev), 6)) AS pp, (a+d+f)/3 AS q FROM g0),
  pr1 AS (SELECT *, sqrt(((a-q)**2 + (d-q)**2 + (f-q)**2 + 2*(b*b+c*c+e*e))/6) AS sp FROM pr WHERE id / 12.0 <= 0.7),
  pr2 AS (SELECT *, acos(least(greatest(((a-q)*((d-q)*(f-q)-e*e)-b*(b*(f-q)-c*e)+c*(b*e-c*(d-q)))/(sp*sp*sp)/2, -1), 1))/3 AS t FROM pr1),
  pr3 AS (SELECT *, q + 2*sp*cos(t + 2*pi()/3) AS e1, q + 2*sp*cos(t) AS e3, a+0.001 AS ra, d+0.001 AS rd, f+0.001 AS rf FROM pr2),
  pr4 AS (SELECT *, greatest(0.5*sqrt(e1), 0.01) AS hx, greatest(0.5*sqrt(3*q-e1-e3), 0.01) AS hy, greatest(0.5*sqrt(e3), 0.01) AS hz, ra*(rd*rf-e*e)-b*(b*rf-c*e)+c*(b*e-c*rd) AS det,
    (CASE WHEN u >= 0.7 THEN 0 ELSE exp(-2*(u-0.3)**2) END) * (CASE WHEN id % 5 = 0 THEN 0.5 ELSE 1 END) * (1-u)**2 AS kw FROM pr3),
  ix AS (SELECT *, unnest(range(CAST(floor((x-hx)/0.02) AS INT), CAST(floor((x+hx)/0.02) AS INT) + 1)) AS ix FROM pr4), iy AS (SELECT *, unnest(range(CAST(floor((y-hy)/0.02) AS INT), CAST(floor((y+hy)/0.02) AS INT) + 1)) AS iy FROM ix),
  iz AS (SELECT *, unnest(range(CAST(floor((z-hz)/0.02) AS INT), CAST(floor((z+hz)/0.02) AS INT) + 1)) AS iz FROM iy),
  dd AS (SELECT *, ix*0.02-x AS dx, iy*0.02-y AS dy, iz*0.02-z AS dz FROM iz),
  dm AS (SELECT *, sqrt(greatest(0, ((rd*rf-e*e)*dx*dx + (ra*rf-c*c)*dy*dy + (ra*rd-b*b)*dz*dz + 2*((c*e-b*rf)*dx*dy + (b*e-c*rd)*dx*dz + (b*c-ra*e)*dy*dz))/det)) / 0.5 AS k FROM dd),
  act AS (SELECT id, CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, CAST(iz AS INT) AS iz, pp, ((2+cos(2*pi()*k))*(1-k)/3 + sin(2*pi()*k)/(2*pi())) * (CASE WHEN id % 2 = 0 THEN 1 ELSE exp(-sqrt(dx*dx+dy*dy+dz*dz)) END) * kw AS scale FROM dm WHERE k < 1 AND (2+cos(2*pi()*k))*(1-k)/3 + sin(2*pi()*k)/(2*pi()) >= 1e-10),
  evd AS (SELECT ix, iy, iz, list(list_transform(pp, lambda p: scale * ln(least(greatest(p, 1e-6), 1-1e-6) / 0.25)) ORDER BY id) AS a FROM act GROUP BY ALL),
  map AS (SELECT ix, iy, iz, len(a) AS n, list_transform(range(1, 5), lambda k: list_reduce(list_prepend(0.0::DOUBLE, list_transform(a, lambda v: v[k])), lambda h, v: least(greatest(h + v, -10), 10))) AS h FROM evd)"""


def evidence(spark, sf_dir):
    return influence.evidence_map(influence.influence(primitives(spark, sf_dir), RES), CLASSES, 1 / CLASSES)


@query(f"WITH {PRIMITIVES} SELECT id, count(*) AS cells, round(sum(scale), 5) AS weight, round(max(scale), 6) AS most FROM act GROUP BY id")
def j8_m14_m17_a27_influence(spark, sf_dir):
    """Cells that each primitive acts on, and the sum and maximum of its kernel."""
    return influence.influence(primitives(spark, sf_dir), RES).groupBy("id").agg(F.count(F.lit(1)).alias("cells"), r(F.sum("scale"), "weight", 5), r(F.max("scale"), "most"))


@query(f"WITH {PRIMITIVES} SELECT ix, iy, iz, CAST(n AS INT) AS n, round(h[1], 6) + 0.0 AS h0, round(h[2], 6) + 0.0 AS h1, round(h[3], 6) + 0.0 AS h2, round(h[4], 6) + 0.0 AS h3 FROM map")
def a8_evidence_map(spark, sf_dir):
    """The map of primitives: log-odds of each voxel, folded in order."""
    return evidence(spark, sf_dir).select("ix", "iy", "iz", "n", *((F.round(F.col("h")[k], 6) + 0.0).alias(f"h{k}") for k in range(CLASSES)))


@query(f"""WITH {PRIMITIVES}, ex1 AS (SELECT *, list_transform(h, lambda v: exp(v - list_max(h))) AS x FROM map), so AS (SELECT *, list_transform(x, lambda v: v / list_sum(x)) AS p FROM ex1),
  attr AS (SELECT *, CAST(list_position(p, list_max(p)) - 1 AS INT) AS class, list_max(p) AS conf FROM so)
  SELECT class, CAST(CASE WHEN class = 0 THEN 0 WHEN class = 1 OR conf > 0.5 THEN 100 ELSE -1 END AS INT) AS nav_cost, count(*) AS cells, round(avg(conf), 6) AS confidence, round(avg(-list_sum(list_transform(p, lambda v: v * ln(v))) / ln(4)), 6) AS entropy FROM attr GROUP BY ALL""")
def a9_cell_attributes(spark, sf_dir):
    """Class, confidence, entropy and navigation cost of the map's cells, by class and cost."""
    a = influence.attributes(evidence(spark, sf_dir), [0], [1])
    return a.groupBy("class", "nav_cost").agg(F.count(F.lit(1)).alias("cells"), r(F.avg("confidence"), "confidence"), r(F.avg("entropy"), "entropy"))


@query(f"""WITH {PRIMITIVES}, ex1 AS (SELECT *, list_transform(h, lambda v: exp(v - list_max(h))) AS x FROM map), so AS (SELECT *, list_transform(x, lambda v: v / list_sum(x)) AS p FROM ex1),
  attr AS (SELECT *, CAST(list_position(p, list_max(p)) - 1 AS INT) AS class, list_max(p) AS conf FROM so),
  cl AS (SELECT *, CASE WHEN class = 0 THEN 0 WHEN class = 1 OR conf > 0.5 THEN 100 ELSE -1 END AS nav FROM attr), q AS (SELECT p_partkey % 40 AS ix, p_size % 30 AS iy, p_partkey % 9 AS iz FROM part)
  SELECT coalesce(n > 0 AND class IN (0, 2), FALSE) AS traversable, coalesce(n > 0 AND nav = 100, FALSE) AS obstacle, coalesce(n > 0 AND nav = 100 AND round(conf, 6) >= 0.6, FALSE) AS sure, n IS NOT NULL AS seen, count(*) AS places FROM q LEFT JOIN cl USING (ix, iy, iz) GROUP BY ALL""")
def f16_cell_predicates(spark, sf_dir):
    """What can be said of places, of which some have a cell of the map: traversable, an obstacle, and one of which the cell is sure."""
    a = influence.attributes(evidence(spark, sf_dir), [0], [1]).select("ix", "iy", "iz", "n", "class", "nav_cost", F.round("confidence", 6).alias("confidence"))
    k = F.col("p_partkey")
    places = table(spark, sf_dir, "part").select((k % 40).alias("ix"), (F.col("p_size") % 30).alias("iy"), (k % 9).alias("iz"))
    both, n = places.join(a, ["ix", "iy", "iz"], "left"), F.col("n")
    said = both.select(influence.is_traversable(F.col("class"), n, [0, 2]).alias("traversable"), influence.is_obstacle(F.col("nav_cost"), n).alias("obstacle"), influence.is_obstacle(F.col("nav_cost"), n, F.col("confidence"), 0.6).alias("sure"), n.isNotNull().alias("seen"))
    return said.groupBy("traversable", "obstacle", "sure", "seen").agg(F.count(F.lit(1)).alias("places"))


@query(f"""WITH {VECTORS}, o AS (SELECT id, x, y, z, label / 12.0 AS u, p, greatest(0.1 * 0.5 * exp(1 - 3 * (label / 12.0)), 1e-3) AS l FROM soft WHERE label / 12.0 <= 0.7),
  ix AS (SELECT *, unnest(range(CAST(floor((x-l)/0.05) AS INT), CAST(floor((x+l)/0.05) AS INT) + 1)) AS ix FROM o), iy AS (SELECT *, unnest(range(CAST(floor((y-l)/0.05) AS INT), CAST(floor((y+l)/0.05) AS INT) + 1)) AS iy FROM ix),
  iz AS (SELECT *, unnest(range(CAST(floor((z-l)/0.05) AS INT), CAST(floor((z+l)/0.05) AS INT) + 1)) AS iz FROM iy), k AS (SELECT *, sqrt((ix*0.05-x)*(ix*0.05-x) + (iy*0.05-y)*(iy*0.05-y) + (iz*0.05-z)*(iz*0.05-z)) / l AS k FROM iz),
  w AS (SELECT *, (2+cos(2*pi()*k))*(1-k)/3 + sin(2*pi()*k)/(2*pi()) AS w FROM k WHERE k < 1)
  SELECT CAST(ix AS INT) AS ix, CAST(iy AS INT) AS iy, CAST(iz AS INT) AS iz, count(*) AS n, round(1 + sum(w * p[1]), 6) AS alpha0, round(1 + sum(w * p[2]), 6) AS alpha1 FROM w WHERE w >= 1e-10 GROUP BY ALL""")
def j9_a10_m13_dirichlet_map(spark, sf_dir):
    """Dirichlet evidence of voxels from single observations, each with its own length scale."""
    v = vectors(spark, sf_dir)
    o = v.select("id", "x", "y", "z", (F.col("label") / 12.0).alias("u"), S.softmax(F.col("logits")).alias("p"))
    m = influence.dirichlet_map(o, 0.05, 2, 0.1)
    return m.select("ix", "iy", "iz", "n", r(F.col("alpha0"), "alpha0"), r(F.col("alpha1"), "alpha1"))


def world(spark, sf_dir):
    """The voxel map with entropy (of the confidence against the rest) and its obstacles: class 3, at least 0.3 sure."""
    c = F.col("confidence")
    h = F.when(c >= 1, 0.0).otherwise(-(c * F.ln(c) + (1 - c) * F.ln(1 - c)) / F.ln(F.lit(2.0)))
    known = cells(spark, sf_dir).withColumn("entropy", h)
    return known, known.where("class = 3 AND confidence >= 0.3")


def robots(spark, sf_dir):
    """A view per nation: position in cells, and a turn about the vertical axis."""
    k = F.col("n_nationkey")
    half = (0.1 + k * 0.7) / 2
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("id"), (k * 0.9 + 1.37).alias("x"), (F.col("n_regionkey") * 4 + 3.41).alias("y"), (k % 5 + 2.53).alias("z"), F.cos(half).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"))


WORLD = f"""{CELLS}, ob AS (SELECT ix, iy, iz FROM cells WHERE class = 3 AND confidence >= 0.3),
  robot AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_nationkey * 0.9::DOUBLE + 1.37 AS x, n_regionkey * 4 + 3.41::DOUBLE AS y, n_nationkey % 5 + 2.53::DOUBLE AS z, (0.1 + n_nationkey * 0.7::DOUBLE) / 2 AS half FROM nation)"""
RAYS = """len AS (SELECT *, sqrt((tx-x)*(tx-x) + (ty-y)*(ty-y) + (tz-z)*(tz-z)) AS len FROM rays), smp AS (SELECT *, unnest(range(1, CAST(ceil((len - 0.5) / 0.5) AS BIGINT))) * 0.5::DOUBLE AS s FROM len WHERE len > 1e-10),
  hit AS (SELECT DISTINCT rid FROM smp s JOIN ob ON ob.ix = CAST(floor(x + (tx-x)/len*s) AS INT) AND ob.iy = CAST(floor(y + (ty-y)/len*s) AS INT) AND ob.iz = CAST(floor(z + (tz-z)/len*s) AS INT))"""


@query(f"WITH {WORLD}, rays AS (SELECT a.id AS id, b.id AS other, a.id * 100 + b.id AS rid, a.x, a.y, a.z, b.x AS tx, b.y AS ty, b.z AS tz FROM robot a JOIN robot b ON a.id <> b.id), {RAYS} SELECT id, count(*) AS pairs, count(*) FILTER (rid NOT IN (SELECT rid FROM hit)) AS clear FROM rays GROUP BY id")
def j12_f13_clear_rays(spark, sf_dir):
    """Of the rays from each robot to all others, those that no obstacle blocks. The robots are a set of fixed size."""
    _, obstacles = world(spark, sf_dir)
    a = robots(spark, sf_dir).select("id", "x", "y", "z")
    b = a.select(F.col("id").alias("other"), *(F.col(k).alias(f"t{k}") for k in "xyz"))
    rays = a.join(F.broadcast(b), F.col("id") != F.col("other"))
    hit = visibility.blocked(rays, ["id", "other"], obstacles, 1.0).withColumn("hit", F.lit(True))
    return rays.join(hit, ["id", "other"], "left").groupBy("id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("hit").isNull()).alias("clear"))


@query(
    f"""WITH {WORLD}, g AS (SELECT id, x, y, z, half, gx, gy, gz, x - 6.0::DOUBLE + gx * 1.0::DOUBLE AS tx, y - 6.0::DOUBLE + gy * 1.0::DOUBLE AS ty, z - 1.0::DOUBLE + gz * 1.0::DOUBLE AS tz FROM robot, (SELECT unnest(range(13)) AS gx), (SELECT unnest(range(13)) AS gy), (SELECT unnest(range(3)) AS gz)),
  f AS (SELECT *, sqrt((tx-x)*(tx-x) + (ty-y)*(ty-y) + (tz-z)*(tz-z)) AS l, sqrt((tx-x)*(tx-x) + (ty-y)*(ty-y)) AS flat FROM g),
  rays AS (SELECT id * 1000000 + gx * 10000 + gy * 100 + gz AS rid, * FROM f WHERE l > 1e-10 AND l <= 6 AND abs(asin(least(greatest((tz-z)/l, -1), 1))) <= 0.45 AND acos(least(greatest(CASE WHEN flat > 0 THEN ((tx-x)*cos(2*half) + (ty-y)*sin(2*half)) / flat ELSE 0 END, -1), 1)) <= 0.6), {RAYS.replace("len AS (SELECT *,", "len AS (SELECT rid, x, y, z, tx, ty, tz,")},
  seen AS (SELECT id, CAST(floor(tx) AS INT) AS ix, CAST(floor(ty) AS INT) AS iy, CAST(floor(tz) AS INT) AS iz FROM rays WHERE rid NOT IN (SELECT rid FROM hit)),
  e AS (SELECT ix, iy, iz, confidence AS c, CASE WHEN confidence >= 1 THEN 0 ELSE -(confidence * ln(confidence) + (1 - confidence) * ln(1 - confidence)) / ln(2) END AS h FROM cells)
  SELECT id, count(*) AS seen, round(sum(coalesce(h, 1)), 5) AS emi, count(*) FILTER (h IS NULL) AS unknown, round(coalesce(avg(h), 0), 6) AS semantic, round(0.5 * avg(coalesce(1 - c, 1)), 6) AS reduction FROM seen LEFT JOIN e USING (ix, iy, iz) GROUP BY id"""
)
def j13_f12_a19_view_gains(spark, sf_dir):
    """What each robot would learn from its view: cells in its angles that nothing hides, and their entropy."""
    known, obstacles = world(spark, sf_dir)
    return visibility.gains(visibility.visible(robots(spark, sf_dir), obstacles, 1.0, 6.0, 1.2, 0.9), known)


@query(f"WITH {WORLD}, n AS (SELECT id, CAST(floor(x - 2 + i) AS INT) AS ix, CAST(floor(y - 2 + j) AS INT) AS iy, CAST(floor(z) AS INT) AS iz FROM robot, (SELECT unnest(range(5)) AS i), (SELECT unnest(range(5)) AS j)) SELECT id FROM robot WHERE id NOT IN (SELECT id FROM n JOIN ob USING (ix, iy, iz))")
def j15_f13_safe_goals(spark, sf_dir):
    """Goals without an obstacle near them."""
    goals = robots(spark, sf_dir).select("id", "x", "y", "z")
    return goals.join(visibility.unsafe(goals, world(spark, sf_dir)[1], 1.0, 2.0), "id", "left_anti").select("id")


@query(f"""WITH {VECTORS}, d AS (SELECT g.id, p.id AS other, (g.x-p.x)*(g.x-p.x)+(g.y-p.y)*(g.y-p.y)+(g.z-p.z)*(g.z-p.z) AS d2 FROM vec g, vec p WHERE g.label < 5 AND p.label >= 5)
  SELECT id, arg_min(other, d2 + other * 1e-15) AS nearest, round(sqrt(min(d2)), 6) AS distance FROM d GROUP BY id""")
def j17_nearest_of_all(spark, sf_dir):
    """The nearest point of another set without a radius: rings that grow until each point has met one."""
    v = vectors(spark, sf_dir)
    return spatial.nearest_of_all(v.where("label < 5").select("id", "x", "y", "z"), v.where("label >= 5").select("id", "x", "y", "z"), 0.05)


@query(f"""WITH RECURSIVE {CELLS}, f6(a, b, c) AS (VALUES (1,0,0), (-1,0,0), (0,1,0), (0,-1,0), (0,0,1), (0,0,-1)),
  fr AS (SELECT ((ix + 1048576)::BIGINT * 2097152 + iy + 1048576) * 2097152 + iz + 1048576 AS id, ix, iy, iz, count(*) AS gain FROM cells s, f6 WHERE confidence < 0.4 AND NOT EXISTS (SELECT 1 FROM cells t WHERE t.confidence < 0.4 AND t.ix = s.ix + a AND t.iy = s.iy + b AND t.iz = s.iz + c) GROUP BY ALL HAVING count(*) >= 4),
  ed AS (SELECT p.id AS a, q.id AS b FROM fr p JOIN fr q ON (p.ix-q.ix)**2 + (p.iy-q.iy)**2 + (p.iz-q.iz)**2 < 2.25), re AS (SELECT id AS id, id AS c FROM fr UNION SELECT ed.b, re.c FROM re JOIN ed ON re.id = ed.a), co AS (SELECT id, min(c) AS component FROM re GROUP BY id)
  SELECT component, count(*) AS cells, CAST(sum(gain) AS BIGINT) AS gain, round(avg(ix), 6) AS x, round(avg(iy), 6) AS y, round(avg(iz), 6) AS z FROM fr JOIN co USING (id) GROUP BY component HAVING count(*) >= 2""")
def a18_i7_frontiers(spark, sf_dir):
    """Frontier cells of the doubtful part of the map, joined if nearer than 1.5: size, unknown faces and centre of each group of two or more."""
    edge = maps.frontier(cells(spark, sf_dir).where("confidence < 0.4")).where("unknown >= 4")
    key = maps.cell_key()
    at = edge.select(key.alias("id"), *(F.col(f"i{k}").cast("double").alias(k) for k in "xyz"), "unknown")
    pairs = spatial.radius_pairs(at.select("id", "x", "y", "z"), at.select("id", "x", "y", "z"), 1.5).where("id < other_id")
    groups = at.join(graph.components(pairs.select(F.col("id").alias("a"), F.col("other_id").alias("b"))), "id")
    return groups.groupBy("component").agg(F.count(F.lit(1)).alias("cells"), F.sum("unknown").alias("gain"), *(r(F.avg(k), k) for k in "xyz"))


COST_CASE = "CASE class " + " ".join(f"WHEN {k} THEN {v / 100}::DOUBLE" for k, v in COSTS.items()) + " END"
#: Moving averages of short decimals often end in a 5 that the two engines round in different ways; this much decides it.
NUDGE = 1e-9
EMA3 = f"""{POINTS}, o AS (SELECT CAST(floor(x / 2.0) AS INT) AS ix, CAST(floor(y / 4.0) AS INT) AS iy, CAST(floor(z / 1.0) AS INT) AS iz, list({{'c': {COST_CASE}, 'u': u, 'k': class}} ORDER BY ts, class, u) AS a, count(*) AS n FROM pts GROUP BY ALL),
  ema AS (SELECT ix, iy, iz, n, list_reduce(a, lambda s, e: {{'c': 0.3 * e.c + 0.7 * s.c, 'u': 0.3 * e.u + 0.7 * s.u, 'k': CASE WHEN e.u + 1e-9 < s.u THEN e.k ELSE s.k END}}) AS s FROM o)"""


@query(f"WITH {EMA3} SELECT ix, iy, iz, n, round(s.c + 1e-9, 6) AS cost, round(s.u + 1e-9, 6) AS u, CAST(s.k AS INT) AS class FROM ema")
def a16_moving_costs(spark, sf_dir):
    """3-D costs as moving averages per voxel, in order of time."""
    return maps.moving_costs(points(spark, sf_dir), (2.0, 4.0, 1.0), COSTS, part=F.year("ts")).select("ix", "iy", "iz", "n", r(F.col("cost") + NUDGE, "cost"), r(F.col("u") + NUDGE, "u"), "class")


@query(f"WITH {EMA3} SELECT ix, iy, CAST(greatest(0, least(100, max(CAST(trunc(100 * least(1, greatest(0, (round(s.c + 1e-9, 6) + 0.2 * round(s.u + 1e-9, 6)) * CASE WHEN iz > 7 THEN 0.1 WHEN iz < 2 AND s.k = 1 THEN 0 ELSE 1 END))) AS INT)))) AS INT) AS cost FROM ema WHERE iz BETWEEN 1 AND 8 GROUP BY ix, iy")
def a17_m26_project_costs(spark, sf_dir):
    """Highest 3-D cost of a column in the robot's band, as 0 to 100."""
    v = maps.moving_costs(points(spark, sf_dir), (2.0, 4.0, 1.0), COSTS, part=F.year("ts")).select("ix", "iy", "iz", r(F.col("cost") + NUDGE, "cost"), r(F.col("u") + NUDGE, "u"), "class")
    return maps.project_costs(v, 1, 8, 7, 2)


@query(f"""WITH {CELLS}, b AS (SELECT min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1 FROM cells WHERE iz BETWEEN 1 AND 8), g AS (SELECT ix, iy, max(CASE WHEN confidence < 0.3 THEN NULL WHEN class IN (0, 2) THEN 0 ELSE 100 END) AS cost FROM cells WHERE iz BETWEEN 1 AND 8 GROUP BY ix, iy),
  xs AS (SELECT unnest(range(x0, x1 + 1)) AS ix FROM b), ys AS (SELECT unnest(range(y0, y1 + 1)) AS iy FROM b), xy AS (SELECT ix, iy FROM xs, ys), d AS (SELECT xy.iy, xy.ix, coalesce(cost, -1) AS cost FROM xy LEFT JOIN g ON xy.ix = g.ix AND xy.iy = g.iy) SELECT CAST(iy AS INT) AS iy, list(CAST(cost AS INT) ORDER BY ix) AS row FROM d GROUP BY iy""")
def a13_f11_occupancy(spark, sf_dir):
    """Occupancy grid: 0 free, 100 obstacle, -1 unknown, one dense row of cells per y."""
    grid = maps.occupancy(cells(spark, sf_dir), [0, 2], band=(1, 8))
    return maps.dense_rows(grid)


@query(f"WITH {CELLS} SELECT round(count(*) / (25.0 * 27 * 11), 6) AS coverage, round(avg(confidence), 6) AS confidence, round(1 - avg(confidence), 6) AS uncertainty, count(DISTINCT class) AS classes, count(*) / (25.0 * 27 * 11) > 0.8 AND 1 - avg(confidence) < 0.2 AS complete FROM cells")
def a11_m32_coverage(spark, sf_dir):
    """Coverage of the map's bounds and whether exploration is complete."""
    share, doubt = F.count(F.lit(1)) / (25.0 * 27 * 11), 1 - F.avg("confidence")
    return cells(spark, sf_dir).agg(r(share, "coverage"), r(F.avg("confidence"), "confidence"), r(doubt, "uncertainty"), F.count_distinct("class").alias("classes"), ((share > 0.8) & (doubt < 0.2)).alias("complete"))


@query(f"""WITH {WORLD}, place AS (SELECT id, CAST(floor(x) AS INT) AS ix, CAST(floor(y) AS INT) AS iy, CAST(floor(z) AS INT) AS iz, x, y, z FROM robot),
  d AS (SELECT id, min((x - ix2 - 0.5)**2 + (y - iy2 - 0.5)**2 + (z - iz2 - 0.5)**2) AS d2 FROM place, (SELECT ix AS ix2, iy AS iy2, iz AS iz2 FROM ob) GROUP BY id)
  SELECT id, class, confidence, coalesce(n, 0) AS n, round(sqrt(d2), 6) AS obstacle FROM place LEFT JOIN cells USING (ix, iy, iz) LEFT JOIN d USING (id)""")
def q1_query_point(spark, sf_dir):
    """The cell at each robot's place (unknown: no class) and the distance to the nearest obstacle's centre."""
    known, obstacles = world(spark, sf_dir)
    return maps.query_points(robots(spark, sf_dir), known, obstacles)


@query(f"""WITH {CELLS}, k AS (SELECT CAST(floor(ix / 2) AS INT) AS ix, CAST(floor(iy / 2) AS INT) AS iy, CAST(floor(iz / 2) AS INT) AS iz, arg_max(class, confidence * 1e9 - class) AS class, max(confidence) AS confidence, CAST(sum(n) AS BIGINT) AS n FROM cells
  WHERE ix BETWEEN 1 AND 20 AND iy BETWEEN 1 AND 20 AND iz BETWEEN 0 AND 9 AND confidence >= 0.3 AND n >= 2 GROUP BY 1, 2, 3) SELECT * FROM k ORDER BY confidence DESC, ix, iy, iz LIMIT 200""")
def q3_get_map(spark, sf_dir):
    """Cells of a box, confident and seen often enough, at half the resolution, the surest first."""
    return maps.get_map(cells(spark, sf_dir), (1, 1, 0), (20, 20, 9), 0.3, 2, 2, 200)


@query("""WITH g AS (SELECT s_suppkey AS id, s_acctbal / 10000 AS gain, (s_suppkey * 37 % 100) / 10.0 AS d, s_suppkey * 13 % 50 AS size FROM supplier WHERE s_acctbal / 10000 >= 0.1 AND (s_suppkey * 37 % 100) / 10.0 <= 8),
  s AS (SELECT 'emi' AS strategy, id, gain AS score FROM g UNION ALL SELECT 'nearest', id, -d FROM g UNION ALL SELECT 'largest', id, size FROM g UNION ALL SELECT 'hybrid', id, gain - 0.3 * d / 10 FROM g),
  k AS (SELECT strategy, id, round(score, 6) AS score, row_number() OVER (PARTITION BY strategy ORDER BY round(score, 6) DESC, id) AS rank FROM s) SELECT strategy, CAST(rank AS INT) AS rank, id, score FROM k WHERE rank <= 5""")
def q5_goal_strategies(spark, sf_dir):
    """The five best goals by each strategy, among those with enough gain and near enough."""
    k = F.col("s_suppkey")
    g = table(spark, sf_dir, "supplier").select(k.alias("id"), (F.col("s_acctbal") / 10000).alias("gain"), (k * 37 % 100 / 10.0).alias("d"), (k * 13 % 50).cast("double").alias("size"))
    return maps.best_by_strategy(g.where("gain >= 0.1 AND d <= 8"), 5, 10.0)


@query(f"WITH {CELLS} SELECT count(*) AS left_cells, CAST(sum(n) AS BIGINT) AS observations FROM cells WHERE NOT (ix BETWEEN 3 AND 9 AND iy BETWEEN 3 AND 9 AND iz BETWEEN 0 AND 10) AND confidence >= 0.25 AND n >= 2")
def q7_f10_reset_and_prune(spark, sf_dir):
    """The map after a region was reset and doubtful or rarely seen cells were pruned."""
    kept = maps.reset(cells(spark, sf_dir), (3, 3, 0), (9, 9, 10)).where("confidence >= 0.25 AND n >= 2")
    return kept.agg(F.count(F.lit(1)).alias("left_cells"), F.sum("n").alias("observations"))
