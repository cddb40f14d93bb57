"""Operators as queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import folds, maps, metrics, neighbours, ranks, spatial
from ..sources.tables import points, table, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

VOXEL, CLASSES = (2.0, 4.0, 1.0), 6
COSTS = {0: 0, 1: 80, 2: 60, 3: 100, 4: 40, 5: 70}

POINTS = """pts AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z, l_tax / 0.08 AS u,
  CAST((CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) * 2 + (CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END) AS INT) AS class, l_shipdate AS ts FROM lineitem)"""
CELLS = f"""{POINTS}, vox AS (SELECT CAST(floor(x / 2.0) AS INT) AS ix, CAST(floor(y / 4.0) AS INT) AS iy, CAST(floor(z / 1.0) AS INT) AS iz, class FROM pts),
  cnt AS (SELECT ix, iy, iz, class, count(*) AS c FROM vox GROUP BY ALL),
  cells AS (SELECT ix, iy, iz, CAST(sum(c) AS BIGINT) AS n, arg_max(class, c * 100 - class) AS class, round(max(c) / sum(c), 6) AS confidence FROM cnt GROUP BY ix, iy, iz)"""
VECTORS = """vec AS (SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
  list_transform(embedding[1:10], lambda v: CAST(v AS DOUBLE) * 8.0) AS logits FROM embeddings),
  ex AS (SELECT *, list_transform(logits, lambda v: exp(v - list_max(logits))) AS e FROM vec),
  soft AS (SELECT id, label, x, y, z, logits, list_transform(e, lambda v: v / list_sum(e)) AS p FROM ex)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.class_evidence(points(spark, sf_dir), VOXEL, CLASSES)


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).withColumn("p", S.softmax(F.col("logits")))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pred, gt and confidence of the class probabilities. Some gt are 255 (no label) or 12, some pred 11: classes go from 0 to 9."""
    p, i = probabilities(spark, sf_dir), F.col("id")
    gt = F.when(i % 11 == 0, 255).when(i % 17 == 0, 12).otherwise(F.col("label")).cast("int")
    pred = F.when(i % 13 == 0, 11).otherwise(S.argmax(F.col("p"))).cast("int")
    return p.select("id", pred.alias("pred"), gt.alias("gt"), F.round(F.array_max("p"), 9).alias("confidence"))


JUDGED = f"""{VECTORS}, jud AS (SELECT id, CAST(CASE WHEN id % 13 = 0 THEN 11 ELSE list_position(p, list_max(p)) - 1 END AS INT) AS pred,
  CAST(CASE WHEN id % 11 = 0 THEN 255 WHEN id % 17 = 0 THEN 12 ELSE label END AS INT) AS gt, round(list_max(p), 9) AS confidence FROM soft),
  ok AS (SELECT * FROM jud WHERE gt <> 255 AND gt BETWEEN 0 AND 9 AND pred BETWEEN 0 AND 9)"""


@query(f"WITH {CELLS} SELECT * FROM cells")
def voxel_map(spark, sf_dir):
    return cells(spark, sf_dir)


@query(f"WITH {CELLS} SELECT count(*) AS cells, CAST(sum(n) AS BIGINT) AS observations, round(sum(CAST(round(confidence * 1e6) AS BIGINT)) / count(*)) / 1e6 AS mean_confidence, min(confidence) AS low, max(confidence) AS high FROM cells")
def q4_map_info(spark, sf_dir):
    c = F.col("confidence")
    return cells(spark, sf_dir).agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("observations"), S.mean_of_millionths(c).alias("mean_confidence"), F.min(c).alias("low"), F.max(c).alias("high"))


@query(f"WITH {CELLS} SELECT class, count(*) AS cells, round(sum(CAST(round(confidence * 1e6) AS BIGINT)) / count(*)) / 1e6 AS mean_confidence, CAST(sum(n) AS BIGINT) AS observations FROM cells WHERE ix BETWEEN 2 AND 15 AND iy BETWEEN 1 AND 12 AND iz BETWEEN 0 AND 7 AND confidence >= 0.2 GROUP BY class")
def q2_query_region(spark, sf_dir):
    return maps.region(cells(spark, sf_dir), (2, 1, 0), (15, 12, 7), 0.2)


@query(
    """SELECT p_partkey AS id, round(CASE WHEN d >= 0.8 THEN 0 ELSE (2 + cos(2 * pi() * d / 0.8)) * (1 - d / 0.8) / 3 + sin(2 * pi() * d / 0.8) / (2 * pi()) END, 6) AS sparse,
  round(exp(-0.5 * (d / 0.8) ** 2), 6) AS rbf, round(CASE WHEN d >= 0.7 THEN 0 ELSE exp(-2 * (d - 0.3) ** 2) END, 6) AS uncertainty,
  round(CASE WHEN p_size > 25 THEN 1 ELSE exp(-d) END, 6) AS reach,
  round(least(greatest((0.1 + 0.4 * least(greatest(cbrt(d / 2.0), 0), 1)) * least(greatest(exp(-1 + 3 * d), 0.5), 2.0), 0.1), 1.0), 6) AS length,
  round((1 - d) ** 2, 6) AS weight, round((1 - d) ** 2 * (1 - d * 0.9), 6) AS entropy_weight, CASE WHEN p_size % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS filter, round(ln(least(greatest(d, 1e-6), 1 - 1e-6) / 0.1), 6) AS odds
  FROM (SELECT *, p_size / 50.0 AS d FROM part)"""
)
def m7_m18_kernels(spark, sf_dir):
    d = F.col("p_size") / 50.0
    r = lambda c, n: F.round(c, 6).alias(n)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        r(S.sparse_kernel(d, F.lit(0.8)), "sparse"),
        r(S.rbf_kernel(d, F.lit(0.8)), "rbf"),
        r(S.uncertainty_kernel(d), "uncertainty"),
        r(S.reachability_kernel(F.col("p_size") > 25, d), "reach"),
        r(S.adaptive_length(d, 2.0, d), "length"),
        r(S.confidence_weight(d), "weight"),
        r(S.entropy_weight(d, d * 1.8, 2.0), "entropy_weight"),
        S.filter_kernel(F.col("p_size") % 3 == 0).alias("filter"),
        r(S.log_odds(d, 0.1), "odds"),
    )


@query(
    f"""WITH {VECTORS}, a AS (SELECT *, list_transform(e, lambda v: v * 3 + 1) AS alpha FROM (SELECT id, e FROM ex))
  SELECT id, round(-list_sum(list_transform(p, lambda v: CASE WHEN v > 1e-10 THEN v * ln(v) ELSE 0 END)) / ln(10.0), 6) AS entropy,
  CAST(list_position(p, list_max(p)) - 1 AS INT) AS best, round(list_max(p), 6) AS confidence, round(10 / (list_sum(e) * 3 + 10), 6) AS vacuity,
  round(alpha[1] / list_sum(alpha), 6) AS mean0, round(alpha[1] * (list_sum(alpha) - alpha[1]) / (list_sum(alpha) ** 2 * (list_sum(alpha) + 1)), 8) AS var0
  FROM soft JOIN a USING (id) JOIN (SELECT id, e FROM ex) USING (id)""".replace("JOIN (SELECT id, e FROM ex) USING (id)", "").replace("(SELECT *, list_transform(e, lambda v: v * 3 + 1) AS alpha FROM (SELECT id, e FROM ex))", "(SELECT id, e, list_transform(e, lambda v: v * 3 + 1) AS alpha FROM ex)")
)
def m1_m20_class_probabilities(spark, sf_dir):
    p, logits = F.col("p"), F.col("logits")
    v = probabilities(spark, sf_dir).withColumn("e", F.transform(logits, lambda x: 3 * F.exp(x - F.array_max(logits)))).withColumn("alpha", F.transform("e", lambda x: x + 1))
    r = lambda c, n, d=6: F.round(c, d).alias(n)
    return v.select("id", r(S.entropy(p), "entropy"), S.argmax(p).alias("best"), r(F.array_max(p), "confidence"), r(S.vacuity(F.col("e")), "vacuity"), r(S.dirichlet_mean(F.col("alpha"))[0], "mean0"), r(S.dirichlet_variance(F.col("alpha"))[0], "var0", 8))


@query(f"WITH {POINTS} SELECT class, count(*) AS n, round(avg(least(greatest(0.5 * sqrt(x * x + y * y + z * z) / 120, 0), 1)), 6) AS u_observation, round(avg(least(greatest(0.4 * u + 0.25 * least(greatest(0.5 * sqrt(x * x + y * y + z * z) / 120, 0), 1), 0), 1)), 6) AS u_total FROM pts GROUP BY class")
def m3_m4_observation(spark, sf_dir):
    d = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    o = S.observation_uncertainty(d, 120)
    return points(spark, sf_dir).groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(o), 6).alias("u_observation"), F.round(F.avg(S.total_uncertainty([F.col("u"), o], [0.4, 0.25])), 6).alias("u_total"))


@query(
    f"""WITH {VECTORS}, pr AS (SELECT a.id, a.label = b.label AS eq FROM vec a JOIN vec b ON a.id <> b.id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) < 0.2*0.2),
  g AS (SELECT id, count(*) AS n, count(*) FILTER (eq) AS same FROM pr GROUP BY id)
  SELECT v.id, coalesce(n, 0) AS n, coalesce(same, 0) AS same, round(CASE WHEN coalesce(n, 0) < 3 THEN 1.0 ELSE 1 - same / n END, 6) AS u_spatial,
  round(coalesce(n, 0) / (4 / 3 * 3.141592653589793 * 0.2 ** 3), 4) AS density FROM vec v LEFT JOIN g USING (id)"""
)
def j4_a1_radius_neighbours(spark, sf_dir):
    return spatial.spatial_uncertainty(vectors(spark, sf_dir), 0.2)


@query(
    f"""WITH {VECTORS}, c AS (SELECT CAST(label AS BIGINT) AS cid, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM vec GROUP BY label),
  d AS (SELECT v.id, cid, (v.x-c.x)*(v.x-c.x)+(v.y-c.y)*(v.y-c.y)+(v.z-c.z)*(v.z-c.z) AS d2 FROM vec v, c),
  b AS (SELECT id, arg_min(cid, d2 + cid * 1e-15) AS nearest, min(d2) AS d2 FROM d WHERE d2 < 0.15 * 0.15 GROUP BY id)
  SELECT v.id, nearest, round(sqrt(d2), 6) AS distance FROM vec v LEFT JOIN b USING (id)"""
)
def j6_nearest_centroid(spark, sf_dir):
    v = vectors(spark, sf_dir)
    c = v.groupBy(F.col("label").cast("long").alias("id")).agg(*(F.round(F.avg(k), 6).alias(k) for k in "xyz"))
    return spatial.nearest(v.select("id", "x", "y", "z"), c, 0.15)


def kmeans_sql(points: str, k: int, rounds: int = 15, tolerance: float = 0.01) -> str:
    """CTEs (for WITH RECURSIVE) that cluster a CTE of id, x, y, z, u: `clustered` has its rows with `cluster`."""
    chance = "((('0x' || substr(md5(id || '-' || {}), 1, 8))::UBIGINT + 0.5) / 4294967296.0::DOUBLE)"
    d2 = "(p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)"
    at = "{'x': x, 'y': y, 'z': z}"
    return f"""seeds AS (SELECT 1 AS k, [(SELECT arg_min({at}, -ln({chance.format(1)}) * (u + 0.1)) FROM {points})] AS c
  UNION ALL SELECT k + 1, list_append(c, (SELECT arg_min({at}, -ln({chance.format('(s.k + 1)')}) / ((1 + u) * near)) FROM (SELECT p.*, list_min(list_transform(s.c, lambda q: {d2})) AS near FROM {points} p) WHERE near > 0)) FROM seeds s WHERE k < {k}),
  lloyd AS (SELECT 0 AS r, c, FALSE AS done FROM seeds WHERE k = {k} UNION ALL SELECT r + 1, c,
    list_max(list_transform(list_zip(c, old), lambda t: (t[1].x - t[2].x) ** 2 + (t[1].y - t[2].y) ** 2 + (t[1].z - t[2].z) ** 2)) < {tolerance} ** 2
    FROM (SELECT r, l.c AS old, (SELECT list({at} ORDER BY j) FROM (SELECT list_position(d, list_min(d)) AS j, sum(x / (u + 0.1)) / sum(1 / (u + 0.1)) AS x, sum(y / (u + 0.1)) / sum(1 / (u + 0.1)) AS y, sum(z / (u + 0.1)) / sum(1 / (u + 0.1)) AS z
      FROM (SELECT p.*, list_transform(l.c, lambda q: {d2}) AS d FROM {points} p) GROUP BY 1)) AS c FROM lloyd l WHERE NOT done AND r < {rounds})),
  clustered AS (SELECT p.*, list_position(list_transform(c, lambda q: {d2}), list_min(list_transform(c, lambda q: {d2}))) - 1 AS cluster FROM {points} p, (SELECT c FROM lloyd ORDER BY r DESC LIMIT 1))"""


def primitives_sql(rows: str, by: str) -> str:
    """CTEs that summarise rows (x, y, z, u) by a column: `prims`."""
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    sums = ", ".join([f"sum(w * {a}) / sum(w) AS {a}" for a in "xyz"] + [f"sum(w * {a} * {b}) / sum(w) AS {a}{b}" for a, b in pairs])
    spread = ", ".join(f"round({a}{b} - {a} * {b}{' + 0.001' if a == b else ''}, 4) AS c{a}{b}" for a, b in pairs)
    return f"""weighed AS (SELECT *, 1 / (u + 0.1) AS w FROM {rows}), summed AS (SELECT {by}, count(*) AS n, avg(u) AS u, {sums} FROM weighed GROUP BY {by}),
  prims AS (SELECT {by}, n, round(u, 6) AS u, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, {spread} FROM summed)"""


FRAME = f"{VECTORS}, frame AS (SELECT id, x, y, z, label / 10.0::DOUBLE AS u FROM vec)"


def frame(spark, sf_dir):
    return vectors(spark, sf_dir).select("id", "x", "y", "z", (F.col("label") / 10).alias("u"))


@query(f"WITH RECURSIVE {FRAME}, {kmeans_sql('frame', 8)}, {primitives_sql('clustered', 'cluster')} SELECT CAST(cluster AS INT) AS cluster, * EXCLUDE (cluster) FROM prims")
def i1_i2_kmeans(spark, sf_dir):
    """Primitives of eight clusters from weighted seeds."""
    clustered, _ = spatial.kmeans(frame(spark, sf_dir).cache(), 8)
    return spatial.primitives(clustered, "cluster")


@query(f"WITH RECURSIVE {FRAME}, {kmeans_sql('frame', 5)}, {primitives_sql('clustered', 'cluster')} SELECT CAST(cluster AS INT) AS cluster, * EXCLUDE (cluster) FROM prims WHERE n >= 20")
def i3_f6_build(spark, sf_dir):
    """A frame's primitives: five wanted, each of 20 points at least."""
    return spatial.build(frame(spark, sf_dir).cache(), 5, 20)


@query(f"WITH {VECTORS}, c AS (SELECT label, count(*) AS n FROM vec GROUP BY label) SELECT label, n, greatest(1, least(128, n // 5)) AS wanted, CAST(least(greatest(floor(sqrt(n / 2.0)), 16), 256) AS BIGINT) AS automatic FROM c")
def i3_i4_counts(spark, sf_dir):
    """Numbers of primitives for frames of so many points, by target and automatic."""
    n = vectors(spark, sf_dir).groupBy("label").count().collect()
    rows = [(r["label"], r["count"], spatial.primitive_count(r["count"], 128, 5), spatial.automatic_count(r["count"])) for r in n]
    return spark.createDataFrame(rows, "label int, n long, wanted long, automatic long")


@query(
    f"""WITH {POINTS}, w AS (SELECT *, 1 / (u + 0.1) AS w FROM pts), g AS (SELECT class, count(*) AS n, avg(u) AS u, sum(w) AS w, sum(w*x)/sum(w) AS x, sum(w*y)/sum(w) AS y, sum(w*z)/sum(w) AS z,
  sum(w*x*x)/sum(w) AS xx, sum(w*x*y)/sum(w) AS xy, sum(w*x*z)/sum(w) AS xz, sum(w*y*y)/sum(w) AS yy, sum(w*y*z)/sum(w) AS yz, sum(w*z*z)/sum(w) AS zz FROM w GROUP BY class)
  SELECT class, n, round(u, 6) AS u, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, round(xx-x*x+0.001, 4) AS cxx, round(xy-x*y, 4) AS cxy, round(xz-x*z, 4) AS cxz, round(yy-y*y+0.001, 4) AS cyy, round(yz-y*z, 4) AS cyz, round(zz-z*z+0.001, 4) AS czz FROM g"""
)
def a3_a6_primitives(spark, sf_dir):
    return spatial.primitives(points(spark, sf_dir), "class")


@query(
    f"""WITH {VECTORS}, nx AS (SELECT id, p, 0.1 + label / 20.0 AS u, lead(p) OVER (ORDER BY id) AS q, lead(0.1 + label / 20.0) OVER (ORDER BY id) AS v FROM soft),
  m AS (SELECT id, u, v, list_transform(p, lambda t: t * (1 - u)) AS a, list_transform(q, lambda t: t * (1 - v)) AS b FROM nx WHERE q IS NOT NULL),
  j AS (SELECT id, list_transform(list_zip(a, b), lambda t: t[1] * t[2] + t[1] * v + u * t[2]) AS j, list_sum(a) * list_sum(b) - list_sum(list_transform(list_zip(a, b), lambda t: t[1] * t[2])) AS k FROM m)
  SELECT id, round(j[1] / list_sum(j), 6) AS m0, round(list_max(j) / list_sum(j), 6) AS best, round(k, 6) AS conflict FROM j"""
)
def a4_dempster_shafer(spark, sf_dir):
    v = probabilities(spark, sf_dir).withColumn("u", 0.1 + F.col("label") / 20)
    nxt = v.select((F.col("id") - 1).alias("id"), F.col("p").alias("q"), F.col("u").alias("v"))
    masses, conflict = S.fuse_masses(F.col("p"), F.col("u"), F.col("q"), F.col("v"))
    out = v.join(nxt, "id").withColumn("j", masses).withColumn("conflict", F.round(conflict, 6))
    return out.select("id", F.round(F.col("j")[0], 6).alias("m0"), F.round(F.array_max("j"), 6).alias("best"), "conflict")


@query("""WITH o AS (SELECT user_id, list(ln(greatest(value, 0.01) / 100) ORDER BY ts, event_id) AS a, count(*) AS n FROM events GROUP BY user_id)
  SELECT user_id, round(list_reduce(list_prepend(CAST(0 AS DOUBLE), a), lambda h, x: least(greatest(h + x, -10), 10)), 6) AS h, n FROM o""")
def a8_log_odds_fold(spark, sf_dir):
    return folds.clamped_fold(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.ln(F.greatest(F.col("value"), F.lit(0.01)) / 100), part=F.to_date("ts"))


@query("""WITH o AS (SELECT user_id, list(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END::DOUBLE ORDER BY ts, event_id) AS a FROM events GROUP BY user_id)
  SELECT user_id, round(list_reduce(list_prepend(CAST(0 AS DOUBLE), a), lambda m, x: 0.9 * m + 0.1 * x), 6) AS ema FROM o""")
def w3_moving_average(spark, sf_dir):
    return folds.moving_average(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "click", 1.0).otherwise(0.0), 0.1, F.to_date("ts"))


@query(f"WITH {VECTORS} SELECT label, round(1 + sum(0.5 * p[1]), 6) AS alpha0, round(1 + sum(0.5 * p[2]), 6) AS alpha1, round(1 + sum(0.5 * p[3]), 6) AS alpha2 FROM soft GROUP BY label")
def a10_dirichlet(spark, sf_dir):
    return folds.dirichlet_update(probabilities(spark, sf_dir), ["label"], F.lit(0.5), 3)


@query("""WITH s AS (SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS seen, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  m AS (SELECT *, max(seen) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS most FROM s) SELECT event_id, n, most, round(CASE WHEN n = 1 THEN 0.5 ELSE 1 - most / n END, 6) AS u_temporal FROM m""")
def w1_running_mode(spark, sf_dir):
    return folds.running_mode(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "n", "most", "u_temporal")


@query("""WITH g AS (SELECT event_id, user_id, ts, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
  SELECT user_id, event_id, round(CASE WHEN max(s) OVER w > min(s) OVER w THEN (count(*) OVER w - 1) / (max(s) OVER w - min(s) OVER w) END, 9) AS rate, round(avg(gap) OVER w, 3) AS mean_gap FROM g
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def w5_rolling_rate(spark, sf_dir):
    return folds.rolling_rate(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")


@query("""WITH c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click'), v AS (SELECT user_id, ts, max(event_id) AS found FROM events WHERE event_type = 'view' GROUP BY user_id, ts)
  SELECT c.user_id, c.event_id, v.found FROM c ASOF JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts""")
def j3_as_of(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("found_id"))
    return folds.as_of(e.where("event_type = 'click'").select("user_id", "ts", "event_id"), right, "user_id", "ts", "found_id", "event_id").withColumnRenamed("found_id", "found")


@query(f"WITH {JUDGED} SELECT gt, pred, count(*) AS n FROM ok GROUP BY gt, pred")
def a20_f14_confusion(spark, sf_dir):
    return metrics.confusion(judged(spark, sf_dir), 10)


CLASS_SUMS = "k AS (SELECT unnest(range(10))::INT AS class), g AS (SELECT class, count(*) FILTER (gt = class AND pred = class) AS hit, count(*) FILTER (gt = class OR pred = class) AS union_n, count(*) FILTER (gt = class) AS gt_n FROM ok, k GROUP BY class)"


@query(f"WITH {JUDGED}, {CLASS_SUMS} SELECT class, hit AS intersection, union_n, gt_n, round(hit / union_n, 6) AS iou, round(CASE WHEN gt_n > 0 THEN hit / gt_n END, 6) AS recall FROM g WHERE union_n > 0")
def a20_class_iou(spark, sf_dir):
    return metrics.class_iou(judged(spark, sf_dir), 10)


@query(f"""WITH {JUDGED}, {CLASS_SUMS} SELECT round(sum(hit) / sum(gt_n), 6) AS accuracy, round(avg(hit / gt_n) FILTER (gt_n > 0), 6) AS class_accuracy, round(avg(hit / union_n) FILTER (union_n > 0), 6) AS miou,
  round(avg(hit / union_n) FILTER (gt_n > 0), 6) AS miou_gt, round(sum(hit / greatest(union_n, 1)) / 10, 6) AS miou_all FROM g""")
def a20_scores(spark, sf_dir):
    """Accuracy, class accuracy and the three means of IoU."""
    return metrics.scores(judged(spark, sf_dir), 10)


@query(f"WITH {JUDGED}, b AS (SELECT ceil(confidence * 15) AS bin, count(*) AS n, abs(avg(confidence) - avg(CASE WHEN gt = pred THEN 1.0 ELSE 0 END)) AS gap FROM jud WHERE confidence > 0 AND gt <> 255 GROUP BY 1) SELECT round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS mce, CAST(sum(n) AS BIGINT) AS n FROM b")
def a21_calibration(spark, sf_dir):
    return metrics.calibration(judged(spark, sf_dir))


@query(
    f"""WITH {VECTORS}, g AS (SELECT round_even(x / 0.1, 0)::BIGINT AS i, round_even(y / 0.1, 0)::BIGINT AS j, round_even(z / 0.1, 0)::BIGINT AS k, arg_max({{'x': x, 'y': y, 'z': z}}, id) AS g FROM vec WHERE label < 5 GROUP BY ALL),
  p AS (SELECT round_even(x / 0.1, 0)::BIGINT AS i, round_even(y / 0.1, 0)::BIGINT AS j, round_even(z / 0.1, 0)::BIGINT AS k, arg_max({{'x': x, 'y': y, 'z': z}}, id) AS p FROM vec WHERE label >= 5 GROUP BY ALL),
  m AS (SELECT (g.x-p.x)**2 + (g.y-p.y)**2 + (g.z-p.z)**2 AS d2 FROM g JOIN p USING (i, j, k)), n AS (SELECT g.id, min((g.x-p.x)**2 + (g.y-p.y)**2 + (g.z-p.z)**2) AS d2 FROM vec g, vec p WHERE g.label < 5 AND p.label >= 5 GROUP BY g.id)
  SELECT (SELECT count(*) FROM m) AS matched, (SELECT round(sqrt(avg(d2)), 6) FROM m) AS rmse_matched, (SELECT round(sqrt(avg(d2)), 5) FROM n) AS rmse_nearest"""
)
def a23_position_rmse(spark, sf_dir):
    """Positions of two clouds: matched by voxel, and by the nearest point."""
    v = vectors(spark, sf_dir)
    return metrics.position_rmse(v.where("label >= 5"), v.where("label < 5"), 0.1, 0.05)


METHODS = ", ".join(f"round(avg(value) FILTER (event_type = '{m}'), 6) AS {m}" for m in ("click", "view", "purchase"))


@query(f"SELECT user_id % 5 AS method, {METHODS} FROM events GROUP BY 1")
def k15_comparison(spark, sf_dir):
    """A benchmark's table of methods by metrics."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("method"), F.col("event_type").alias("metric"), "value")
    return metrics.comparison(e, ["click", "view", "purchase"])


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS low, max(value) AS high, count(value) AS n, round(1000 / avg(value), 6) AS per_second FROM events GROUP BY event_type")
def a24_timing(spark, sf_dir):
    return metrics.timing(table(spark, sf_dir, "events"), "event_type", "value")


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END), 6) AS above, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def a26_summary(spark, sf_dir):
    return metrics.summary(table(spark, sf_dir, "events"), "event_type", "value", 100.0)


INFO = f"""{POINTS}, parts AS (SELECT class, u AS semantic, z / 10 AS spatial, least(greatest(0.5 * sqrt(x * x + y * y + z * z) / 120, 0), 1) AS observation, day(ts) / 31 AS temporal FROM pts),
  info AS (SELECT *, least(greatest(0.35 * semantic + 0.25 * spatial + 0.25 * observation + 0.15 * temporal, 0), 1) AS total FROM parts)"""
_PARTS = ("semantic", "spatial", "observation", "temporal")


@query(
    f"""WITH {INFO} SELECT class, count(*) AS num_points, count(*) FILTER (total > 0.6) AS num_filtered,
  {", ".join(f"round(min({c}), 6) AS {c}_min, round(max({c}), 6) AS {c}_max, round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_std, round(quantile_cont({c}, 0.5), 6) AS {c}_median" for c in (*_PARTS, "total"))},
  [{", ".join(f"count(*) FILTER (least(floor(total * 10), 9) = {k})" for k in range(10))}] AS histogram,
  {", ".join(f"round(quantile_cont(total, {p / 100}), 6) AS percentile_{p}" for p in (25, 50, 75, 90, 95))},
  {", ".join(f"round(corr({a}, {b}), 6) AS corr_{a}_{b}" for i, a in enumerate(_PARTS) for b in _PARTS[i + 1 :])} FROM info GROUP BY class"""
)
def a26_q9_uncertainty_info(spark, sf_dir):
    """All statistics of a frame's uncertainties; the class stands for the frame."""
    x, y, z = (F.col(k) for k in "xyz")
    p = points(spark, sf_dir).select("class", F.col("u").alias("semantic"), (z / 10).alias("spatial"), S.observation_uncertainty(F.sqrt(x * x + y * y + z * z), 120).alias("observation"), (F.dayofmonth("ts") / 31).alias("temporal"))
    p = p.withColumn("total", S.total_uncertainty([F.col(c) for c in _PARTS], [0.35, 0.25, 0.25, 0.15]))
    return metrics.uncertainty_info(p, "class", {c: c for c in _PARTS}, "total", 0.6)


COST_CASE = "CASE class " + " ".join(f"WHEN {k} THEN {v}" for k, v in COSTS.items()) + " END"
FREE, BLOCKED = [0, 2], [3, 5]
#: Points of a column in order of height.
GRIDS = f"""{CELLS}, grids AS (SELECT ix, iy,
  coalesce(arg_max(CASE WHEN class IN (0, 2) THEN 0 ELSE 100 END, iz) FILTER (confidence > 0.3 AND class IN (0, 2, 3, 5)), 50) AS cost,
  coalesce(max(CAST(trunc(({COST_CASE}) * confidence + 50 * (1 - confidence)) AS INT)), -1) AS semantic FROM cells WHERE iz BETWEEN 0 AND 8 GROUP BY ix, iy)"""


def grids(spark, sf_dir):
    return maps.cost_grids(cells(spark, sf_dir), ["iz"], COSTS, FREE, BLOCKED, 0.3, (0, 8))


@query(f"WITH {GRIDS} SELECT ix, iy, cost, semantic FROM grids")
def a14_f11_cost_grids(spark, sf_dir):
    """The binary grid by the last sure point of a column, and the semantic one by the highest cost, within a band of heights."""
    return grids(spark, sf_dir)


@query(f"WITH {GRIDS} SELECT ix, iy, CAST(CASE WHEN cost < 0 THEN -1 WHEN cost < 50 THEN 0 ELSE 100 END AS INT) AS traversable FROM grids")
def a15_traversability(spark, sf_dir):
    return grids(spark, sf_dir).select("ix", "iy", maps.traversability(F.col("cost")).alias("traversable"))


@query(
    f"""WITH {GRIDS}, b AS (SELECT min(ix) AS x0, max(ix) AS x1, min(iy) AS y0, max(iy) AS y1 FROM grids), xy AS (SELECT * FROM (SELECT unnest(range(x0, x1 + 1)) AS ix FROM b), (SELECT unnest(range(y0, y1 + 1)) AS iy FROM b)),
  d AS (SELECT xy.iy, xy.ix, coalesce(cost, -1) AS c, coalesce(semantic, -1) AS s FROM xy LEFT JOIN grids USING (ix, iy))
  SELECT CAST(iy AS INT) AS iy, list(CAST(c AS INT) ORDER BY ix) AS cost, list(CAST(s AS INT) ORDER BY ix) AS semantic, list(CAST(CASE WHEN c < 0 THEN -1 WHEN c < 50 THEN 0 ELSE 100 END AS INT) ORDER BY ix) AS traversable FROM d GROUP BY iy"""
)
def k6_occupancy_grids(spark, sf_dir):
    """Dense rows of the three grids: cost, semantic cost, traversability; -1 where nothing is known."""
    g = grids(spark, sf_dir).withColumn("traversable", maps.traversability(F.col("cost")))
    return maps.dense_rows(g, layers=("cost", "semantic", "traversable"))


@query(
    f"""WITH {GRIDS}, o AS (SELECT i, j FROM (SELECT unnest(range(-2, 3))::INT AS i), (SELECT unnest(range(-2, 3))::INT AS j) WHERE i * i + j * j > 0 AND i * i + j * j < 3 * 3),
  near AS (SELECT ix + i AS ix, iy + j AS iy, max(CAST(trunc(100 * exp(-10 * sqrt(i * i + j * j) / 3.0)) AS INT)) AS c FROM grids, o WHERE cost >= 100 GROUP BY ALL)
  SELECT ix, iy, CASE WHEN cost < 0 OR cost >= 100 THEN cost ELSE greatest(cost, coalesce(c, 0)) END AS cost FROM grids LEFT JOIN near USING (ix, iy)"""
)
def j14_inflation(spark, sf_dir):
    return maps.inflate(grids(spark, sf_dir).select("ix", "iy", "cost"), 3, 100)


@query(
    f"""WITH {CELLS}, f(a, b, c) AS (VALUES (1,0,0), (-1,0,0), (0,1,0), (0,-1,0), (0,0,1), (0,0,-1))
  SELECT s.ix, s.iy, s.iz, count(*) AS unknown FROM cells s, f WHERE NOT EXISTS (SELECT 1 FROM cells t WHERE t.ix = s.ix + a AND t.iy = s.iy + b AND t.iz = s.iz + c) GROUP BY ALL"""
)
def j10_frontier(spark, sf_dir):
    return maps.frontier(cells(spark, sf_dir))


@query("""WITH g AS (SELECT s_suppkey AS id, s_acctbal / 10000 AS gain, (s_suppkey * 37 % 100) / 10.0 AS d FROM supplier), u AS (SELECT id, round(gain - 0.3 * d / 10 + 0.5 * 0.2, 6) AS utility FROM g)
  SELECT id, utility, CAST(row_number() OVER (ORDER BY utility DESC, id) AS INT) AS rank FROM u ORDER BY utility DESC, id LIMIT 10""")
def o1_rank_goals(spark, sf_dir):
    g = table(spark, sf_dir, "supplier")
    u = S.utility(F.col("s_acctbal") / 10000, F.col("s_suppkey") * 37 % 100 / 10, F.lit(0.2), 10.0)
    return maps.rank_goals(g.select(F.col("s_suppkey").alias("id"), F.round(u, 6).alias("utility")), 10)


@query(f"WITH {CELLS}, cut AS (SELECT min(confidence) AS c FROM (SELECT confidence FROM cells ORDER BY confidence DESC LIMIT 500)) SELECT cells.* FROM cells, cut WHERE confidence >= c")
def o3_cap_cells(spark, sf_dir):
    return maps.cap_cells(cells(spark, sf_dir), 500)


def _halves(spark, sf_dir):
    return [spatial.class_evidence(points(spark, sf_dir).where(F.col("u") <= 0.5 if k else F.col("u") > 0.5), VOXEL, CLASSES) for k in (0, 1)]


_HALF = "SELECT ix, iy, iz, arg_max(class, c * 100 - class) AS class, round(max(c) / sum(c), 6) AS confidence FROM (SELECT CAST(floor(x / 2.0) AS INT) AS ix, CAST(floor(y / 4.0) AS INT) AS iy, CAST(floor(z / 1.0) AS INT) AS iz, class, count(*) AS c FROM pts WHERE u {} 0.5 GROUP BY ALL) GROUP BY ix, iy, iz"


@query(f"WITH {POINTS}, l AS ({_HALF.format('>')}), r AS ({_HALF.format('<=')}) SELECT ix, iy, iz, CASE WHEN l.class IS NULL OR r.confidence > l.confidence THEN coalesce(r.class, l.class) ELSE l.class END AS class, round(CASE WHEN l.class IS NULL OR r.confidence > l.confidence THEN coalesce(r.confidence, l.confidence) ELSE l.confidence END, 6) AS confidence FROM l FULL JOIN r USING (ix, iy, iz)")
def q6_merge_maps(spark, sf_dir):
    return maps.merge(*_halves(spark, sf_dir))


@query(f"WITH {POINTS}, l AS ({_HALF.format('>')}), r AS ({_HALF.format('<=')}) SELECT count(*) AS cells, count(*) FILTER (l.class = r.class) AS agree FROM l JOIN r USING (ix, iy, iz)")
def j16_o8_compare_maps(spark, sf_dir):
    """Cells that both maps know, and those of the same class."""
    a, b = _halves(spark, sf_dir)
    both = a.join(b.select("ix", "iy", "iz", F.col("class").alias("other")), ["ix", "iy", "iz"])
    return both.agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("class") == F.col("other")).alias("agree"))


@query(f"WITH {POINTS}, q AS (SELECT class, least(0.8, quantile_cont(u, 0.9)) AS gate FROM pts GROUP BY class) SELECT class, round(gate, 6) AS gate, count(*) AS kept FROM pts JOIN q USING (class) WHERE u <= gate GROUP BY class, gate")
def f2_adaptive_gate(spark, sf_dir):
    p = points(spark, sf_dir)
    gate = ranks.quantiles(p, ["class"], "u", {"gate": 0.9}).withColumn("gate", F.least(F.lit(0.8), "gate"))
    return p.join(F.broadcast(gate), "class").where("u <= gate").groupBy("class", F.round("gate", 6).alias("gate")).agg(F.count(F.lit(1)).alias("kept"))


@query("""WITH c AS (SELECT event_id AS click, user_id, epoch_us(ts) AS s FROM events WHERE event_type = 'click'), v AS (SELECT event_id AS view, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'view'),
  p AS (SELECT click, view, abs(s - t) AS gap, row_number() OVER (PARTITION BY click ORDER BY abs(s - t), view) AS k FROM c JOIN v ON c.user_id = v.user_id AND abs(s - t) <= 3600000000) SELECT click, view, gap FROM p WHERE k = 1""")
def j1_time_sync(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return folds.time_sync(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "user_id", "ts", "event_id", 3_600_000_000).select(F.col("left_id").alias("click"), F.col("right_id").alias("view"), "gap")


@query(
    f"""WITH RECURSIVE {VECTORS}, e AS (SELECT a.id AS a, b.id AS b FROM vec a JOIN vec b ON a.id <> b.id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) < 0.05*0.05),
  r AS (SELECT a AS id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a) SELECT id, min(c) AS component FROM r GROUP BY id"""
)
def i7_components(spark, sf_dir):
    return neighbours.near_components(vectors(spark, sf_dir), 0.05)


PALETTE = [(0, 0, 0), (128, 0, 0), (0, 128, 0), (0, 0, 128), (128, 128, 0), (200, 200, 200)]


@query("WITH c AS (SELECT p_partkey AS id, CAST(p_partkey * 37 % 256 AS INT) AS r, CAST(p_partkey * 91 % 256 AS INT) AS g, CAST(p_partkey * 53 % 256 AS INT) AS b FROM part), d AS (SELECT id, k, (r-x)*(r-x)+(g-y)*(g-y)+(b-z)*(b-z) AS d2 FROM c, (VALUES " + ", ".join(f"({k},{r},{g},{b})" for k, (r, g, b) in enumerate(PALETTE)) + ") p(k, x, y, z)) SELECT id, CAST(min(d2 * 100 + k) % 100 AS INT) AS class FROM d GROUP BY id")
def j21_nearest_colour(spark, sf_dir):
    key = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select(key.alias("id"), *((key * m % 256).cast("double").alias(n) for n, m in zip("xyz", (37, 91, 53), strict=True)))
    return spatial.assign(c, [tuple(map(float, p)) for p in PALETTE]).select("id", F.col("cluster").alias("class"))


@query("SELECT p_partkey AS id, CAST(CASE p_size WHEN 3 THEN 0 WHEN 7 THEN 1 WHEN 19 THEN 2 ELSE 3 END AS INT) AS class, list_transform(range(4), lambda k: round(CASE WHEN k = CASE p_size WHEN 3 THEN 0 WHEN 7 THEN 1 WHEN 19 THEN 2 ELSE 3 END THEN 0.7 ELSE 0.1 END, 6)::DOUBLE) AS p FROM part")
def p5_p8_remap(spark, sf_dir):
    """Relevant classes to 0..k-1, others to k; then the distribution that a confidence of 0.7 stands for."""
    new = S.remap(F.col("p_size"), [7, 3, 19])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), new.alias("class"), S.spread(new, F.lit(0.7), 4).alias("p"))


@query("SELECT event_id, count(*) OVER w AS frames, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def w9_running_totals(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count(F.lit(1)).over(w).alias("frames"), F.round(F.sum("value").over(w), 4).alias("total"))


@query("SELECT user_id, arg_max(value, ts) AS last, max(ts) AS ts FROM events GROUP BY user_id")
def w7_last_per_key(spark, sf_dir):
    latest = F.max_by("value", F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(latest.alias("last"), F.max("ts").alias("ts"))
