"""Queries of projections, poses, covariances and evidential heads."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import evidential as E
from ..functions import geometry as G
from ..functions import scalar as S
from ..operators import ranks, spatial
from ..sources.tables import points, table, vectors
from .queries import POINTS, VECTORS, VOXEL, query


def r(c, name, digits=6):
    return F.round(c, digits).alias(name)


#: Focal lengths and centre at half size.
LENS = (193.0, 193.0, 160.0, 120.0)


@query("""WITH px AS (SELECT l_orderkey % 640 AS u, l_partkey % 480 AS v, l_quantity * 150 * 0.001 AS d, l_linenumber AS label, l_tax / 0.08 AS unc FROM lineitem)
  SELECT u // 2 AS u, v // 2 AS v, label, count(*) AS n, round(sum((u // 2 - 160.0) * d / 193.0), 4) AS x, round(sum((v // 2 - 120.0) * d / 193.0), 4) AS y, round(sum(d), 4) AS z
  FROM px WHERE u % 2 = 0 AND v % 2 = 0 AND d > 0.5 AND d < 5.5 AND label < 6 AND unc <= 0.7 GROUP BY ALL""")
def p1_p2_p12_f1_back_projection(spark, sf_dir):
    """Pixels with a millimetre depth, every second row and column: points of the lens, gated by depth, class and uncertainty."""
    px = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 640).alias("u"), (F.col("l_partkey") % 480).alias("v"), (F.col("l_quantity") * 150 * 0.001).alias("d"), F.col("l_linenumber").alias("label"), (F.col("l_tax") / 0.08).alias("unc"))
    px = px.where("u % 2 = 0 AND v % 2 = 0 AND d > 0.5 AND d < 5.5 AND NOT isnan(d) AND label < 6 AND unc <= 0.7").withColumns({k: F.floor(F.col(k) / 2) for k in "uv"})
    x, y, z = G.pinhole(F.col("u"), F.col("v"), F.col("d"), *LENS)
    return px.groupBy("u", "v", "label").agg(F.count(F.lit(1)).alias("n"), r(F.sum(x), "x", 4), r(F.sum(y), "y", 4), r(F.sum(z), "z", 4))


@query(f"""WITH {VECTORS}, t AS (SELECT id, x, y, z, cos(label / 10.0) AS w, sin(label / 10.0) * 0.6 AS i, sin(label / 10.0) * 0.8 AS k FROM vec)
  SELECT id, round(x * (1 - 2*k*k) - 2*w*k*y + 2*i*k*z + 1.5, 6) AS x, round(2*w*k*x + y * (1 - 2*i*i - 2*k*k) - 2*w*i*z - 0.5, 6) AS y, round(2*i*k*x + 2*w*i*y + z * (1 - 2*i*i) + 0.25, 6) AS z FROM t""")
def p3_rigid_transform(spark, sf_dir):
    """Points in the map's frame: a turn about (0.6, 0, 0.8) by the label, and a shift."""
    half = F.col("label") / 10.0
    q = [F.cos(half), F.sin(half) * 0.6, F.lit(0.0), F.sin(half) * 0.8]
    moved = G.transform(q, [F.lit(1.5), F.lit(-0.5), F.lit(0.25)], [F.col(k) for k in "xyz"])
    return vectors(spark, sf_dir).select("id", *(r(c, k) for c, k in zip(moved, "xyz", strict=True)))


@query("""SELECT p_partkey AS id, CAST((p_partkey * 2654435761) & 16777215 AS BIGINT) AS debug_rgb, CAST(((p_size % 256) << 16) | ((p_size * 3 % 256) << 8) | (p_size * 7 % 256) AS INT) AS rgb,
  CAST(p_size * 3 % 256 AS INT) AS green, p_size IN (1, 19) AS traversable, CAST(floor(255 * (p_size / 50.0)) AS INT) AS shade,
  CASE WHEN p_size / 50.0 < 0.3 THEN 'green' WHEN p_size / 50.0 < 0.6 THEN 'yellow' WHEN p_size / 50.0 < 0.9 THEN 'orange' ELSE 'red' END AS ramp FROM part""")
def p4_p7_p13_k8_colours(spark, sf_dir):
    """Colours of labels and costs, packed and unpacked again, and the traversable flag."""
    size, u = F.col("p_size"), F.col("p_size") / 50.0
    rgb = G.pack_rgb(size % 256, size * 3 % 256, size * 7 % 256)
    ramp = F.when(u < 0.3, "green").when(u < 0.6, "yellow").when(u < 0.9, "orange").otherwise("red")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") * 2654435761).bitwiseAND(F.lit(16777215)).alias("debug_rgb"), rgb.alias("rgb"), G.unpack_rgb(rgb)[1].alias("green"),
        size.isin(1, 19).alias("traversable"), F.floor(255 * u).cast("int").alias("shade"), ramp.alias("ramp"),
    )


@query(f"""WITH {VECTORS}, c AS (SELECT label, avg(x*x)-avg(x)**2+0.001 AS a, avg(x*y)-avg(x)*avg(y) AS b, avg(x*z)-avg(x)*avg(z) AS c, avg(y*y)-avg(y)**2+0.001 AS d, avg(y*z)-avg(y)*avg(z) AS e, avg(z*z)-avg(z)**2+0.001 AS f FROM vec GROUP BY label),
  m AS (SELECT *, (a+d+f)/3 AS q, sqrt(((a-(a+d+f)/3)**2 + (d-(a+d+f)/3)**2 + (f-(a+d+f)/3)**2 + 2*(b*b+c*c+e*e))/6) AS p, a*(d*f-e*e)-b*(b*f-c*e)+c*(b*e-c*d) AS det FROM c),
  g AS (SELECT *, acos(least(greatest(((a-q)*((d-q)*(f-q)-e*e)-b*(b*(f-q)-c*e)+c*(b*e-c*(d-q)))/(p*p*p)/2, -1), 1))/3 AS t FROM m)
  SELECT label, round(q + 2*p*cos(t + 2*pi()/3), 6) AS low, round(3*q - (q + 2*p*cos(t)) - (q + 2*p*cos(t + 2*pi()/3)), 6) AS middle, round(q + 2*p*cos(t), 6) AS high, round(det, 8) AS determinant, round(4/3*pi()*sqrt(det), 6) AS volume,
  round(sqrt(((d*f-e*e)*0.01 + (a*f-c*c)*0.04 + (a*d-b*b)*0.09 + 2*((c*e-b*f)*0.02 + (b*e-c*d)*0.03 + (b*c-a*e)*0.06))/det), 5) AS distance FROM g""")
def m16_m22_m23_ellipsoids(spark, sf_dir):
    """Eigenvalues, determinant and volume of the covariance of each label's points, and the Mahalanobis length of (0.1, 0.2, 0.3)."""
    mean = lambda a, b: F.avg(F.col(a) * F.col(b)) - F.avg(a) * F.avg(b) + (0.001 if a == b else 0.0)
    c = vectors(spark, sf_dir).groupBy("label").agg(*(mean(*k).alias(k) for k in G.ENTRIES))
    m = [F.col(k) for k in G.ENTRIES]
    names = zip(G.eigenvalues(m), ("low", "middle", "high"), strict=True)
    return c.select("label", *(r(v, n) for v, n in names), r(G.determinant(m), "determinant", 8), r(G.volume(m), "volume"), r(G.mahalanobis(m, [F.lit(0.1), F.lit(0.2), F.lit(0.3)]), "distance", 5))


@query("""WITH g AS (SELECT s_suppkey AS id, s_acctbal / 1000 AS x, (s_suppkey * 7 % 20) / 2.0 AS y FROM supplier), v AS (SELECT id, x, y, k, x - 4.2 * cos(k * pi() / 4) AS ex, y - 4.2 * sin(k * pi() / 4) AS ey FROM g, (SELECT unnest(range(8)) AS k)),
  d AS (SELECT *, sqrt((x-ex)**2 + (y-ey)**2 + 0.25) AS l FROM v)
  SELECT id, CAST(k AS INT) AS k, round(ex, 6) AS ex, round(ey, 6) AS ey, round(sqrt((1 + (x-ex)/l)/2), 6) AS qw, round(-sqrt((1 - (x-ex)/l)/2) * 0.5 / sqrt((y-ey)**2 + 0.25), 6) AS qy, round(sqrt((1 - (x-ex)/l)/2) * (y-ey) / sqrt((y-ey)**2 + 0.25), 6) AS qz FROM d""")
def m28_m29_viewpoints(spark, sf_dir):
    """Eight viewpoints on a ring around each target, at the robot's height, and the quaternions that face the target."""
    key = F.col("s_suppkey")
    g = table(spark, sf_dir, "supplier").select(key.alias("id"), (F.col("s_acctbal") / 1000).alias("x"), (key * 7 % 20 / 2.0).alias("y"))
    v = g.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    angle = F.col("k") * (math.pi / 4)
    v = v.withColumn("ex", F.col("x") - 4.2 * F.cos(angle)).withColumn("ey", F.col("y") - 4.2 * F.sin(angle))
    q = G.facing([F.col("ex"), F.col("ey"), F.lit(0.0)], [F.col("x"), F.col("y"), F.lit(0.5)])
    return v.select("id", "k", r(F.col("ex"), "ex"), r(F.col("ey"), "ey"), r(q[0], "qw"), r(q[2], "qy"), r(q[3], "qz"))


@query(f"""WITH {VECTORS}, s AS (SELECT id, label, p, list_transform(logits, lambda v: greatest(v, 0) + ln(1 + exp(-abs(v))) + 1) AS alpha, greatest(logits[1], 0) + ln(1 + exp(-abs(logits[1]))) + 1e-3 AS tau FROM soft),
  t AS (SELECT *, list_sum(alpha) + tau AS a0, list_transform(list_zip(alpha, p), lambda t: (t[1] + tau * t[2]) / (list_sum(alpha) + tau)) AS mu FROM s),
  w AS (SELECT *, list_transform(list_zip(mu, p), lambda t: t[1] * (1 - t[1]) / (a0 + 1) + tau * tau * t[2] * (1 - t[2]) / (a0 * (a0 + 1))) AS var, list_transform(alpha, lambda a: (a - 1) / list_sum(alpha)) AS b FROM t)
  SELECT id, CAST(list_position(mu, list_max(mu)) - 1 AS INT) AS best, round(list_max(mu), 6) AS mean, round(list_sum(var), 6) AS variance, round(10 / a0, 6) AS vacuity,
  round(list_sum(list_transform(range(1, 11), lambda i: b[i] * list_sum(list_transform(list_filter(range(1, 11), lambda j: j <> i), lambda j: b[j] * (1 - abs(b[i] - b[j]) / (b[i] + b[j] + 1e-9)))) / (list_sum(list_transform(list_filter(range(1, 11), lambda j: j <> i), lambda j: b[j])) + 1e-9))), 6) AS dissonance FROM w""")
def m21_flexible_head(spark, sf_dir):
    """Mean, variance, vacuity and dissonance of the flexible evidential head."""
    v = vectors(spark, sf_dir)
    p, tau = E.allocation(F.col("logits"))
    v = v.select("id", "label", p.alias("p"), tau.alias("tau"), F.transform(E.evidence(F.col("logits")), lambda e: e + 1).alias("alpha"))
    mean, var, vacuity = E.moments(F.col("alpha"), F.col("p"), F.col("tau"))
    v = v.withColumns({"mean": mean, "var": var, "vacuity": vacuity})
    return v.select("id", S.argmax(F.col("mean")).alias("best"), r(F.array_max("mean"), "mean"), r(S.total(F.col("var")), "variance"), r(F.col("vacuity"), "vacuity"), r(E.dissonance(F.col("alpha")), "dissonance"))


def losses(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("alpha", F.transform(E.evidence(F.col("logits")), lambda e: e + 1)).withColumn("hot", E.one_hot(F.col("label"), 10))
    return v, F.col("hot"), F.col("alpha")


@query(f"""WITH {VECTORS}, s AS (SELECT label, list_transform(logits, lambda v: greatest(v, 0) + ln(1 + exp(-abs(v))) + 1) AS alpha, list_transform(range(10), lambda k: CASE WHEN k = label THEN 1.0::DOUBLE ELSE 0 END) AS hot FROM vec),
  q AS (SELECT *, list_sum(alpha) AS s, list_transform(alpha, lambda a: a / list_sum(alpha)) AS m FROM s),
  v AS (SELECT label, list_sum(list_transform(list_zip(hot, m), lambda t: (t[1] - t[2]) ** 2)) AS e, list_sum(list_transform(m, lambda t: t * (1 - t) / (s + 1))) AS va, ln(s + 1e-9) - ln(alpha[label + 1] + 1e-9) AS l FROM q)
  SELECT count(*) AS n, round(avg(e + va), 6) AS mse, round(avg(e), 6) AS p_error, round(avg(l), 6) AS log FROM v""")
def a31_evidential_losses(spark, sf_dir):
    """Mean losses of the evidence against labels; 255 is masked."""
    v, hot, alpha = losses(spark, sf_dir)
    mean = F.transform(alpha, lambda a: a / S.total(alpha))
    return v.where("label <> 255").agg(F.count(F.lit(1)).alias("n"), r(F.avg(E.mse_loss(hot, alpha)), "mse"), r(F.avg(E.squared_error(hot, mean)), "p_error"), r(F.avg(E.log_loss(hot, alpha)), "log"))


def _digamma(x: str) -> str:
    z = f"({x} + 10)"
    steps = " + ".join(f"1 / ({x} + {i})" for i in range(10))
    return f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z} ** 2) + 1 / (120 * {z} ** 4) - 1 / (252 * {z} ** 6) - ({steps}))"


@query(f"""WITH {VECTORS}, s AS (SELECT label, list_transform(logits, lambda v: greatest(v, 0) + ln(1 + exp(-abs(v))) + 1) AS alpha FROM vec WHERE label <> 255),
  w AS (SELECT label, alpha, list_sum(alpha) AS s, list_transform(range(10), lambda k: CASE WHEN k = label THEN 1.0::DOUBLE ELSE alpha[k + 1] END) AS wrong FROM s),
  e AS (SELECT {_digamma('s')} - {_digamma('alpha[label + 1]')} AS d, list_sum(wrong) AS t, wrong FROM w),
  k AS (SELECT d, t, list_sum(list_transform(wrong, lambda a: (a - 1) * ({_digamma('a')} - {_digamma('t')}) - lgamma(a))) AS sp FROM e)
  SELECT count(*) AS n, round(avg(d), 6) AS digamma, round(avg(lgamma(t) - lgamma(10.0) + sp), 6) AS kl FROM k""")
def a31_digamma_losses(spark, sf_dir):
    """Losses that need the digamma and log-gamma functions, by series."""
    v, hot, alpha = losses(spark, sf_dir)
    return v.where("label <> 255").agg(F.count(F.lit(1)).alias("n"), r(F.avg(E.digamma_loss(hot, alpha)), "digamma"), r(F.avg(E.kl_regulariser(hot, alpha)), "kl"))


@query("SELECT p_partkey AS id, round(greatest(0.3 * 0.5 * exp(1 - 3 * (p_size / 50.0)), 1e-3), 6) AS length, round(least(1, greatest(0, (p_size / 50.0 + 0.2 * (p_size % 7) / 7.0) * CASE WHEN p_size > 40 THEN 0.1 WHEN p_size < 5 AND p_size % 2 = 1 THEN 0 ELSE 1 END)), 6) AS cost, round(0.1 / (0.1 + (1 - 0.1) * exp(-p_size / 10.0)), 6) AS p FROM part")
def m13_m18_m26_scalars(spark, sf_dir):
    """Observation length scale, 3-D cost by height, and the way back from log-odds."""
    size, u = F.col("p_size"), F.col("p_size") / 50.0
    cost = S.total_cost(u, size % 7 / 7.0, size > 40, (size < 5) & (size % 2 == 1))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), r(S.observation_length(u), "length"), r(cost, "cost"), r(S.from_log_odds(size / 10.0, 0.1), "p"))


@query(f"""WITH {VECTORS} SELECT id, round(CASE WHEN label >= 4 THEN logits[1] * (1 - 0.2 * (1 - p[1])) ELSE logits[1] END, 6) AS h0, round(list_sum(list_transform(list_zip(logits, p), lambda t: CASE WHEN label >= 4 THEN t[1] * (1 - 0.2 * (1 - t[2])) ELSE t[1] END)), 6) AS total FROM soft""")
def m19_m30_decay(spark, sf_dir):
    """Log-odds of cells older than an age fall towards the prior, the slower the likelier the class."""
    h = F.when(F.col("label") >= 4, S.decay(F.col("logits"), 0.2)).otherwise(F.col("logits"))
    return vectors(spark, sf_dir).withColumn("h", h).select("id", r(F.col("h")[0], "h0"), r(S.total(F.col("h")), "total"))


@query("SELECT user_id, CAST(bit_or(1 << (length(event_type) % 9)) AS INT) AS bits, CAST(bit_count(bit_or(1 << (length(event_type) % 9))) AS INT) AS held, bit_or(1 << (length(event_type) % 9)) & 32 <> 0 AS fifth FROM events GROUP BY user_id")
def m31_affordances(spark, sf_dir):
    """Affordances of a key as bits of one number."""
    bit = F.shiftleft(F.lit(1), 0)
    bits = F.bit_or(F.call_function("shiftleft", bit, F.length("event_type") % 9))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(bits.alias("bits")).select("user_id", "bits", F.bit_count("bits").cast("int").alias("held"), (F.col("bits").bitwiseAND(F.lit(32)) != 0).alias("fifth"))


@query(f"""WITH {POINTS}, q AS (SELECT class, list_sort(list(u)) AS us FROM pts GROUP BY class), g AS (SELECT class, least(0.9, us[CAST(ceil(0.9 * len(us)) AS INT)]) AS gate FROM q)
  SELECT class, round(gate, 6) AS gate, count(*) AS kept, round(sum(1 - u), 3) AS certainty FROM pts JOIN g USING (class) WHERE u <= gate GROUP BY ALL""")
def f3_order_statistic_gate(spark, sf_dir):
    """Per class, points whose uncertainty is at most that of the 90th hundredth, by its rank. The rank comes from counts of equal values."""
    p = points(spark, sf_dir)
    gate = spatial.order_statistic(p, "class", "u", 0.9).withColumn("gate", F.least(F.lit(0.9), "value"))
    return p.join(F.broadcast(gate), "class").where("u <= gate").groupBy("class", r(F.col("gate"), "gate")).agg(F.count(F.lit(1)).alias("kept"), r(F.sum(1 - F.col("u")), "certainty", 3))


@query(f"""WITH {POINTS} SELECT CAST(floor(x / {VOXEL[0]}) AS INT) AS ix, CAST(round_even(x / {VOXEL[0]}, 0) AS INT) AS nearest, count(*) AS n, round(min((floor(x / {VOXEL[0]}) + 0.5) * {VOXEL[0]}), 6) AS centre FROM pts GROUP BY ALL""")
def p10_voxel_index(spark, sf_dir):
    """Voxels by floor, those of the evaluation by the nearest even number, and centres."""
    ix = spatial.cell(F.col("x"), VOXEL[0])
    return points(spark, sf_dir).groupBy(ix.alias("ix"), F.rint(F.col("x") / VOXEL[0]).cast("int").alias("nearest")).agg(F.count(F.lit(1)).alias("n"), r(F.min((ix + 0.5) * VOXEL[0]), "centre"))


@query("SELECT round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, count(*) AS n, quantile_cont(l_quantity, 0.05) AS p5, quantile_cont(l_quantity, 0.95) AS p95, round(avg(least(greatest(l_quantity, 0), 25) / 25 * 255), 4) AS scaled FROM lineitem WHERE l_quantity > 0")
def a25_o9_f17_p11_depth_statistics(spark, sf_dir):
    """Mean, deviation and percentiles of valid depths, and their mean after clipping to a byte."""
    d = F.col("l_quantity")
    clipped = S.clamp(d, 0, 25) / 25 * 255
    depths = table(spark, sf_dir, "lineitem").where(d > 0).select(d, F.lit("all").alias("image"))
    moments = depths.groupBy("image").agg(r(F.avg(d), "mean"), r(F.stddev_pop(d), "std"), F.count(F.lit(1)).alias("n"), r(F.avg(clipped), "scaled", 4))
    return moments.join(ranks.quantiles(depths, ["image"], "l_quantity", {"p5": 0.05, "p95": 0.95}), "image").drop("image")
