"""Queries of primitives over time, histories, ranked scores and pixel joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalar as S
from ..operators import folds, fusion, metrics, spatial, sync
from ..operators import primitives as P
from ..sources import frames
from ..sources.tables import table, vectors
from .queries import VECTORS, kmeans_sql, primitives_sql, probabilities, query


def r(c, name, digits=6):
    return F.round(c, digits).alias(name)


def gaussians(spark, sf_dir):
    """A primitive per label: moments, points, weight, uncertainty; class and conflict derived from the label."""
    v = vectors(spark, sf_dir)
    moment = lambda a, b: F.avg(F.col(a) * F.col(b)) - F.avg(a) * F.avg(b) + (0.001 if a == b else 0.0)
    g = v.groupBy(F.col("label").cast("long").alias("id")).agg(*(r(F.avg(k), k) for k in "xyz"), *(r(moment(*k), f"c{k}") for k in G.ENTRIES), F.count(F.lit(1)).alias("n"))
    return g.withColumns({"w": F.col("n") * (1 + F.col("id") / 10.0), "u": F.col("id") / 12.0, "class": (F.col("id") % 3).cast("int"), "conflict": (F.col("id") % 4) / 10.0})


GAUSSIANS = f"""{VECTORS}, gs AS (SELECT CAST(label AS BIGINT) AS id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, round(avg(x*x)-avg(x)*avg(x)+0.001, 6) AS cxx, round(avg(x*y)-avg(x)*avg(y), 6) AS cxy, round(avg(x*z)-avg(x)*avg(z), 6) AS cxz,
  round(avg(y*y)-avg(y)*avg(y)+0.001, 6) AS cyy, round(avg(y*z)-avg(y)*avg(z), 6) AS cyz, round(avg(z*z)-avg(z)*avg(z)+0.001, 6) AS czz, count(*) AS n, count(*) * (1 + label / 10.0) AS w, label / 12.0 AS u, label % 3 AS class FROM vec GROUP BY label)"""


@query(f"""WITH {VECTORS}, it AS (SELECT label, list({{'p': p, 'u': 0.2 + (id % 7) / 10.0::DOUBLE, 'k': 0.0::DOUBLE}} ORDER BY id) AS a FROM soft GROUP BY label),
  fo AS (SELECT label, list_reduce(a, lambda s, e: {{'p': list_transform(list_transform(range(1, 11), lambda i: s.p[i]*(1-s.u)*e.p[i]*(1-e.u) + s.p[i]*(1-s.u)*e.u + s.u*e.p[i]*(1-e.u)), lambda v: v / list_sum(list_transform(range(1, 11), lambda i: s.p[i]*(1-s.u)*e.p[i]*(1-e.u) + s.p[i]*(1-s.u)*e.u + s.u*e.p[i]*(1-e.u)))), 'u': (s.u + e.u) / 2,
    'k': greatest(s.k, list_sum(list_transform(s.p, lambda v: v * (1-s.u))) * list_sum(list_transform(e.p, lambda v: v * (1-e.u))) - list_sum(list_transform(range(1, 11), lambda i: s.p[i]*(1-s.u)*e.p[i]*(1-e.u))))}}) AS s FROM it)
  SELECT label, CAST(list_position(s.p, list_max(s.p)) - 1 AS INT) AS best, round(list_max(s.p), 6) AS mass, round(s.u, 6) AS u, round(s.k, 6) AS conflict FROM fo""")
def a5_fuse_in_order(spark, sf_dir):
    """Beliefs of each label fused in order of id."""
    v = probabilities(spark, sf_dir).withColumn("u", 0.2 + F.col("id") % 7 / 10)
    out = fusion.fuse_in_order(v, "label", ["id"], "p", "u", part=F.floor(F.col("id") / 64))
    return out.select("label", S.argmax(F.col("p")).alias("best"), r(F.array_max("p"), "mass"), r(F.col("u"), "u"), r(F.col("conflict"), "conflict"))


@query(f"""WITH {GAUSSIANS}, m AS (SELECT class, sum(w) AS w, CAST(sum(n) AS BIGINT) AS n, sum(u * n) / sum(n) AS u, sum(w*x)/sum(w) AS x, sum(w*y)/sum(w) AS y, sum(w*(cxx+x*x))/sum(w) AS xx, sum(w*(cxy+x*y))/sum(w) AS xy FROM gs GROUP BY class)
  SELECT class, n, round(w, 6) AS w, round(u, 6) AS u, round(x, 6) AS x, round(y, 6) AS y, round(xx - x*x, 6) AS cxx, round(xy - x*y, 6) AS cxy FROM m""")
def a7_merge_primitives(spark, sf_dir):
    """Primitives of a class merged into one."""
    m = P.merge_groups(gaussians(spark, sf_dir), "class")
    return m.select("class", "n", *(r(F.col(k), k) for k in ("w", "u", "x", "y", "cxx", "cxy")))


@query(f"WITH {GAUSSIANS} SELECT count(*) AS n, round(max(cxx + cyy + czz), 6) AS max_trace, round(avg(4/3*pi()*sqrt(cxx*(cyy*czz-cyz*cyz)-cxy*(cxy*czz-cxz*cyz)+cxz*(cxy*cyz-cxz*cyy))), 6) AS volume FROM gs")
def a12_m23_primitive_summary(spark, sf_dir):
    return P.summary(gaussians(spark, sf_dir))


def pieces(spark, sf_dir):
    """Primitives of parts of the labels, with class probabilities of their own."""
    v = vectors(spark, sf_dir).withColumn("pid", (F.col("label") * 8 + F.col("id") % 8).cast("long"))
    g = v.groupBy(F.col("pid").alias("id")).agg(*(r(F.avg(k), k) for k in "xyz"), F.count(F.lit(1)).alias("n"))
    i = F.col("id")
    parts = [1 + (i * 7 + k * k * 3) % 5 for k in range(3)]
    p = F.array(*(x / sum(parts[1:], parts[0]) for x in parts))
    return g.withColumns({"w": F.col("n") * (1 + i % 10 / 10), "u": i % 12 / 12, "class": (i % 3).cast("int"), "conflict": i % 4 / 10, "p": p})


PIECES = f"""{VECTORS}, p0 AS (SELECT CAST(label * 8 + id % 8 AS BIGINT) AS id, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM vec GROUP BY 1),
  pc AS (SELECT id, x, y, z, n, n * (1 + id % 10 / 10) AS w, id % 12 / 12 AS u, CAST(id % 3 AS INT) AS class, id % 4 / 10 AS conflict, list_transform([1 + id * 7 % 5, 1 + (id * 7 + 3) % 5, 1 + (id * 7 + 12) % 5], lambda v: v / (3 + id * 7 % 5 + (id * 7 + 3) % 5 + (id * 7 + 12) % 5)) AS p FROM p0)"""
#: Masses of a and e, fused but not yet of sum 1; and the conflict.
JOINT = "list_transform(range(1, 4), lambda i: a.p[i]*(1-a.u)*e.p[i]*(1-e.u) + a.p[i]*(1-a.u)*e.u + a.u*e.p[i]*(1-e.u))"
AGAINST = "(1 - a.u) * (1 - e.u) * (1 - list_sum(list_transform(range(1, 4), lambda i: a.p[i] * e.p[i])))"
MERGED = f"""{{'id': a.id, 'x': (a.x*a.w + e.x*e.w) / (a.w + e.w), 'y': (a.y*a.w + e.y*e.w) / (a.w + e.w), 'z': (a.z*a.w + e.z*e.w) / (a.w + e.w), 'w': a.w + e.w, 'n': a.n + e.n, 'u': (a.u*a.n + e.u*e.n) / (a.n + e.n),
  'class': CAST(list_position({JOINT}, list_max({JOINT})) - 1 AS INT), 'conflict': {AGAINST}, 'p': list_transform({JOINT}, lambda v: v / list_sum({JOINT})), 'got': list_concat(a.got, e.got)}}"""
PIECE = "{'id': id, 'x': x, 'y': y, 'z': z, 'w': w, 'n': n, 'u': u, 'class': class, 'conflict': conflict, 'p': p, 'got': [id]}"


@query(f"""WITH RECURSIVE {PIECES}, l0 AS (SELECT list({PIECE} ORDER BY id) AS l FROM pc), mg AS (SELECT l, l[1] AS done, 0 AS turn FROM l0
  UNION ALL SELECT list_filter(l[2:], lambda e: NOT list_contains(acc.got, e.id)), acc, turn + 1 FROM (SELECT l, turn,
    list_reduce(l, lambda a, e: CASE WHEN a.class = e.class AND (a.x-e.x)**2 + (a.y-e.y)**2 + (a.z-e.z)**2 <= 0.12 * 0.12 AND a.conflict <= 0.35 AND e.conflict <= 0.35 THEN {MERGED} ELSE a END) AS acc FROM mg WHERE len(l) > 0))
  SELECT id, done.id AS root, done.class AS class, round(done.conflict, 6) AS conflict, round(done.u, 6) AS u, CAST(done.n AS BIGINT) AS n FROM (SELECT done, unnest(done.got) AS id FROM mg WHERE turn > 0)""")
def j22_merge_near(spark, sf_dir):
    """Which primitives absorb which, and what becomes of them."""
    out = P.merge_near(pieces(spark, sf_dir), 0.12, 0.35)
    return out.select("id", "root", "class", r(F.col("conflict"), "conflict"), r(F.col("u"), "u"), "n")


@query(f"""WITH {PIECES}, it AS (SELECT id % 5 AS part, list({PIECE} ORDER BY id) AS l FROM pc GROUP BY 1), mg AS (SELECT part, list_reduce(l, lambda a, e: {MERGED}) AS m FROM it)
  SELECT part, CAST(m.n AS BIGINT) AS n, round(m.x, 6) AS x, round(m.w, 6) AS w, round(m.u, 6) AS u, m.class AS class, round(m.conflict, 6) AS conflict, round(m.p[1], 6) AS p0 FROM mg""")
def a7_merge_in_order(spark, sf_dir):
    """Primitives merged one after the other with their class probabilities, five groups."""
    own = pieces(spark, sf_dir).withColumn("part", F.col("id") % 5)
    zeros = {f"c{k}": F.lit(0.0) for k in G.ENTRIES}
    m = P.merge_in_order(own.withColumns(zeros), "part", ["id"], F.floor(F.col("id") / 20))
    return m.select("part", "n", r(F.col("x"), "x"), r(F.col("w"), "w"), r(F.col("u"), "u"), "class", r(F.col("conflict"), "conflict"), r(F.col("p")[0], "p0"))


@query(f"WITH {GAUSSIANS} SELECT gs.id AS prim, count(*) AS points FROM gs JOIN vec v ON (v.x-gs.x)*(v.x-gs.x)+(v.y-gs.y)*(v.y-gs.y)+(v.z-gs.z)*(v.z-gs.z) < 9*(gs.cxx+gs.cyy+gs.czz) GROUP BY gs.id")
def j23_split_candidates(spark, sf_dir):
    """Points within three deviations of each primitive."""
    return P.split_candidates(gaussians(spark, sf_dir), vectors(spark, sf_dir)).groupBy("prim").agg(F.count(F.lit(1)).alias("points"))


HALVES = f"""{GAUSSIANS}, nr AS (SELECT gs.id AS prim, v.id, v.x, v.y, v.z FROM gs JOIN vec v ON (v.x-gs.x)*(v.x-gs.x)+(v.y-gs.y)*(v.y-gs.y)+(v.z-gs.z)*(v.z-gs.z) < 9*(gs.cxx+gs.cyy+gs.czz)),
  en AS MATERIALIZED (SELECT * FROM nr WHERE prim IN (SELECT prim FROM nr GROUP BY prim HAVING count(*) >= 10)),
  hv AS (SELECT prim, 0 AS r, min({{'x': x, 'y': y, 'z': z}}) AS a, max({{'x': x, 'y': y, 'z': z}}) AS b FROM en GROUP BY prim
  UNION ALL SELECT prim, r + 1, {{'x': coalesce(avg(x) FILTER (sd = 0), any_value(a.x)), 'y': coalesce(avg(y) FILTER (sd = 0), any_value(a.y)), 'z': coalesce(avg(z) FILTER (sd = 0), any_value(a.z))}},
    {{'x': coalesce(avg(x) FILTER (sd = 1), any_value(b.x)), 'y': coalesce(avg(y) FILTER (sd = 1), any_value(b.y)), 'z': coalesce(avg(z) FILTER (sd = 1), any_value(b.z))}}
    FROM (SELECT en.*, r, a, b, CASE WHEN (x-a.x)**2 + (y-a.y)**2 + (z-a.z)**2 <= (x-b.x)**2 + (y-b.y)**2 + (z-b.z)**2 THEN 0 ELSE 1 END AS sd FROM hv JOIN en USING (prim) WHERE r < 15) GROUP BY prim, r)"""


@query(f"WITH RECURSIVE {HALVES} SELECT prim, CAST(CASE WHEN (x-a.x)**2 + (y-a.y)**2 + (z-a.z)**2 <= (x-b.x)**2 + (y-b.y)**2 + (z-b.z)**2 THEN 0 ELSE 1 END AS INT) AS side, count(*) AS points FROM hv JOIN en USING (prim) WHERE r = 15 GROUP BY 1, 2")
def i6_split(spark, sf_dir):
    """Halves of each primitive's candidates."""
    return P.split(gaussians(spark, sf_dir), vectors(spark, sf_dir)).groupBy("prim", "side").agg(F.count(F.lit(1)).alias("points"))


UPDATED = f"""{GAUSSIANS}, pt AS (SELECT id, x, y, z, label / 10.0::DOUBLE AS u FROM vec), ds AS (SELECT p.id, gs.id AS prim, (p.x-gs.x)*(p.x-gs.x)+(p.y-gs.y)*(p.y-gs.y)+(p.z-gs.z)*(p.z-gs.z) AS d2 FROM pt p, gs),
  fd AS (SELECT id, arg_min(prim, d2) AS prim FROM ds WHERE d2 < 0.15 * 0.15 GROUP BY id), bg AS (SELECT prim FROM fd GROUP BY prim HAVING count(*) >= 5),
  od AS MATERIALIZED (SELECT prim, pt.* FROM pt JOIN fd USING (id) WHERE prim IN (SELECT prim FROM bg)), rs AS MATERIALIZED (SELECT * FROM pt WHERE id NOT IN (SELECT id FROM od))"""


@query(f"""WITH RECURSIVE {UPDATED}, {kmeans_sql('rs', 8)}, {primitives_sql('od', 'prim').replace('weighed', 'w1').replace('summed', 's1').replace('prims', 'p1')},
  nw AS (SELECT CAST(-1 - cluster AS BIGINT) AS prim, * EXCLUDE (cluster) FROM clustered), {primitives_sql('nw', 'prim').replace('weighed', 'w2').replace('summed', 's2').replace('prims', 'p2')}
  SELECT *, TRUE AS kept FROM p1 UNION ALL SELECT *, FALSE FROM p2 WHERE n >= 5""")
def i5_o6_update(spark, sf_dir):
    """Primitives of the labels, renewed by all points as the next frame."""
    v = vectors(spark, sf_dir).select("id", "x", "y", "z", (F.col("label") / 10).alias("u"))
    return P.update(gaussians(spark, sf_dir), v, 0.15, 5, 8)


EIGEN = f"""{GAUSSIANS}, q AS (SELECT *, (cxx + cyy + czz) / 3 AS q FROM gs), s AS (SELECT *, sqrt(((cxx-q)**2 + (cyy-q)**2 + (czz-q)**2 + 2*(cxy*cxy+cxz*cxz+cyz*cyz))/6) AS s FROM q),
  t AS (SELECT *, acos(least(greatest(((cxx-q)*((cyy-q)*(czz-q)-cyz*cyz)-cxy*(cxy*(czz-q)-cyz*cxz)+cxz*(cxy*cyz-cxz*(cyy-q)))/(s*s*s)/2, -1), 1))/3 AS t FROM s)"""


@query(f"WITH {EIGEN} SELECT id, round(2*sqrt(greatest(0.01, q + 2*s*cos(t + 2*pi()/3))), 6) AS short, round(2*sqrt(greatest(0.01, 3*q - (q + 2*s*cos(t + 2*pi()/3)) - (q + 2*s*cos(t)))), 6) AS middle, round(2*sqrt(greatest(0.01, q + 2*s*cos(t))), 6) AS long, 0.0::DOUBLE AS off, 1.0::DOUBLE AS length FROM t")
def k5_m22_markers(spark, sf_dir):
    """Ellipsoids of the primitives. off: how far the covariance is from diagonal in the marker's axes, as a part of its trace; length: of the quaternion."""
    g = gaussians(spark, sf_dir)
    m = P.markers(g).join(g.select("id", *P.COVARIANCE), "id")
    q = [F.col("turn")[i] for i in range(4)]
    axes = [G.rotate(q, [F.lit(float(i == j)) for i in range(3)]) for j in range(3)]
    c = [F.col(k) for k in P.COVARIANCE]
    times = lambda v: [c[0] * v[0] + c[1] * v[1] + c[2] * v[2], c[1] * v[0] + c[3] * v[1] + c[4] * v[2], c[2] * v[0] + c[4] * v[1] + c[5] * v[2]]
    off = F.greatest(*(F.abs(G.dot(axes[i], times(axes[j]))) for i, j in ((0, 1), (0, 2), (1, 2)))) / (c[0] + c[3] + c[5])
    size = F.sqrt(sum((x * x for x in q), F.lit(0.0)))
    return m.select("id", *(r(F.col("scale")[i], n) for i, n in enumerate(("short", "middle", "long"))), r(off, "off"), r(size, "length"))


@query(f"""WITH {VECTORS}, nb AS (SELECT v.id, v.label, unnest([v.id + 1, v.id + 7, v.id * 3 % 400, -1, v.id]) AS nid FROM vec v) SELECT nb.id, count(*) AS n, count(*) FILTER (nb.label = o.label) AS same FROM nb JOIN vec o ON o.id = nb.nid WHERE nid >= 0 AND nid <> nb.id GROUP BY nb.id""")
def j5_given_neighbours(spark, sf_dir):
    """Agreement with neighbours given as lists of ids; invalid ones and the row itself don't count."""
    v = vectors(spark, sf_dir).select("id", "label")
    i = F.col("id")
    return spatial.given_neighbours(v.withColumn("neighbours", F.array(i + 1, i + 7, i * 3 % 400, F.lit(-1).cast("long"), i)), "neighbours")


@query(f"""WITH {VECTORS}, l AS (SELECT label = k AS hit, k AS class, round(p[k + 1], 6) AS score FROM soft, (SELECT unnest(range(10))::INT AS k) WHERE label <> 255), s AS (SELECT class, score, count(*) FILTER (hit) AS pos, count(*) AS n FROM l GROUP BY ALL),
  c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS cnt, sum(pos) OVER (PARTITION BY class) AS total FROM s WINDOW w AS (PARTITION BY class ORDER BY score DESC))
  SELECT class, round(sum(pos / total * (tp / cnt + CASE WHEN cnt > n THEN (tp - pos) / (cnt - n) ELSE 1 END) / 2), 6) AS auprc, CAST(max(total) AS BIGINT) AS positives FROM c WHERE total > 0 GROUP BY class""")
def a22_auprc(spark, sf_dir):
    """Area under the precision-recall curve of each class against the rest."""
    p = probabilities(spark, sf_dir).select("label", F.transform("p", lambda x: F.round(x, 6)).alias("p"))
    return metrics.auprc(p, "p", "label")


@query("""WITH it AS (SELECT user_id, list({'c': event_type, 't': epoch_us(ts) / 1e6, 'last': 0.0::DOUBLE, 'n': 0::BIGINT, 'o': 0.1::DOUBLE} ORDER BY ts, event_id) AS a FROM events GROUP BY user_id),
  fo AS (SELECT user_id, len(a) AS frames, list_reduce(a, lambda s, e: {'c': e.c, 't': e.t, 'last': CASE WHEN e.c <> s.c THEN e.t ELSE s.last END, 'n': s.n + CASE WHEN e.c <> s.c AND e.t - s.last < 86400 THEN 1 ELSE 0 END, 'o': 0.1 + 0.9 * s.o}) AS s FROM it)
  SELECT user_id, CAST(frames AS BIGINT) AS frames, s.n AS transitions, s.n >= 2 AS dynamic, round(s.o, 6) AS occupancy, s.last AS last_change FROM fo""")
def w2_t7_dynamic_status(spark, sf_dir):
    """Transitions of a key that follow another within a day, whether it is dynamic, and its occupancy average."""
    e = table(spark, sf_dir, "events")
    return folds.dynamic_status(e, "user_id", "event_type", "ts", ["event_id"], 86400.0, part=F.to_date("ts"))


STATUS = """it AS (SELECT user_id, list({'c': event_type, 't': epoch_us(ts) / 1e6, 'last': 0.0::DOUBLE, 'n': 0::BIGINT} ORDER BY ts, event_id) AS a FROM events GROUP BY user_id),
  fo AS (SELECT user_id, list_reduce(a, lambda s, e: {'c': e.c, 't': e.t, 'last': CASE WHEN e.c <> s.c THEN e.t ELSE s.last END, 'n': s.n + CASE WHEN e.c <> s.c AND e.t - s.last < 86400 THEN 1 ELSE 0 END}) AS s FROM it), nw AS (SELECT epoch_us(max(ts)) / 1e6 + 864000 AS now FROM events)"""


@query(f"""WITH {STATUS}, d AS (SELECT user_id, s.n AS n, greatest(s.n - greatest(ceil(now / 43200) - 1 - floor((s.last + 86400) / 43200), 0), 0)::BIGINT AS left_n FROM fo, nw)
  SELECT user_id, left_n AS transitions, n >= 2 AND left_n >= 2 AS dynamic FROM d""")
def w4_decayed_transitions(spark, sf_dir):
    """Transitions ten days after the last event, when each half day without a change for a day takes one away."""
    e = table(spark, sf_dir, "events")
    status = folds.dynamic_status(e, "user_id", "event_type", "ts", ["event_id"], 86400.0)
    now = e.agg((F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.max("ts").cast("timestamp_ntz")) / 1e6 + 864000).alias("now"))
    return folds.decay_transitions(status, now.scalar(), 86400.0, 43200.0).select("user_id", "transitions", "dynamic")


@query("""WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id), k AS (SELECT user_id FROM l WHERE last >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY ORDER BY last DESC, user_id DESC LIMIT 40)
  SELECT user_id, count(*) AS kept, min(event_id) AS first FROM events WHERE user_id IN (SELECT user_id FROM k) GROUP BY user_id""")
def o4_t6_history_eviction(spark, sf_dir):
    """Histories after eviction: those touched in the last twenty days, and of all of them the forty touched last."""
    kept = folds.evict(table(spark, sf_dir, "events"), "user_id", "ts", "20 days", 40)
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"), F.min("event_id").alias("first"))


KIND = "SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = '{}'"
NEAR = "{0} AS (SELECT l.event_id AS id_0, r.event_id AS {0}_id, abs(l.t - r.t) AS {0}_gap, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.t - r.t), r.event_id) AS {0}_k FROM l JOIN ({1}) r ON l.user_id = r.user_id AND abs(l.t - r.t) <= 7200000000)"


LISTS = ", ".join(f"list_sort(list({{'t': epoch_us(ts), 'id': event_id}}) FILTER (event_type = '{k}')) AS q{i}" for i, k in enumerate(("click", "view", "purchase", "error")))
FIRSTS = ", ".join(f"q{i}[i{i}].t" for i in range(4))


@query(f"""WITH RECURSIVE q AS (SELECT user_id % 3 AS robot, {LISTS} FROM events GROUP BY 1), go AS (SELECT robot, 1 AS i0, 1 AS i1, 1 AS i2, 1 AS i3, CAST(NULL AS BIGINT[]) AS ids, CAST(NULL AS BIGINT) AS spread FROM q
  UNION ALL SELECT robot, {", ".join(f"i{k} + CASE WHEN hi - lo <= 1800000000 OR first = {k} THEN 1 ELSE 0 END" for k in range(4))}, CASE WHEN hi - lo <= 1800000000 THEN ids END, hi - lo
    FROM (SELECT robot, i0, i1, i2, i3, greatest({FIRSTS}) AS hi, least({FIRSTS}) AS lo, list_position([{FIRSTS}], least({FIRSTS})) - 1 AS first, [{", ".join(f"q{k}[i{k}].id" for k in range(4))}] AS ids
      FROM go JOIN q USING (robot) WHERE {" AND ".join(f"i{k} <= len(q{k})" for k in range(4))}))
  SELECT robot, {", ".join(f"ids[{k + 1}] AS id_{k}" for k in range(4))}, spread FROM go WHERE ids IS NOT NULL""")
def j2_sync_once(spark, sf_dir):
    """Four streams put together within half an hour, each frame used once."""
    e = table(spark, sf_dir, "events").withColumn("robot", F.col("user_id") % 3)
    return sync.sync_once([e.where(F.col("event_type") == k) for k in ("click", "view", "purchase", "error")], "robot", "ts", "event_id", 1_800_000_000)


@query(f"WITH l AS ({KIND.format('click')}), {NEAR.format('v', KIND.format('view'))}, {NEAR.format('p', KIND.format('purchase'))} SELECT id_0, v_id AS id_1, p_id AS id_2, greatest(v_gap, p_gap) AS spread FROM v JOIN p USING (id_0) WHERE v_k = 1 AND p_k = 1")
def j1_j2_three_way_sync(spark, sf_dir):
    """Clicks with the nearest view and the nearest purchase of their user, both within two hours."""
    e = table(spark, sf_dir, "events")
    return folds.sync_many([e.where(F.col("event_type") == k) for k in ("click", "view", "purchase")], "user_id", "ts", "event_id", 7_200_000_000)


@query("WITH b AS (SELECT user_id, to_timestamp(floor(epoch(ts) / 3600) * 3600) AS b, max({'ts': ts, 'e': event_id}) AS m, count(*) - 1 AS dropped FROM events GROUP BY 1, 2) SELECT user_id, m.e AS event_id, dropped FROM b")
def t2_t3_latest_per_trigger(spark, sf_dir):
    """With one trigger an hour and work on the newest row only: what is worked on, and how many rows go."""
    return folds.latest_per_trigger(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3600).select("user_id", "event_id", "dropped")


@query("""WITH c AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click'), v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts), o AS (SELECT user_id, arg_max(value, event_id) AS odo FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0 GROUP BY user_id),
  f AS (SELECT c.user_id, c.event_id, CASE WHEN epoch_us(c.ts) - epoch_us(v.ts) <= 86400000000 THEN v.value END AS value FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts)
  SELECT user_id, event_id, coalesce(value, odo) AS value FROM f LEFT JOIN o USING (user_id) WHERE coalesce(value, odo) IS NOT NULL""")
def s15_s16_lookup(spark, sf_dir):
    """Transforms at a frame's stamp if not older than a day, else the last odometry of the robot; frames without either are dropped."""
    e = table(spark, sf_dir, "events")
    odometry = e.where("event_type = 'purchase' AND user_id % 2 = 0").groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"))
    return folds.lookup(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "user_id", "ts", "value", "event_id", 86400.0, odometry)


@query("WITH k AS (SELECT user_id, arg_max(value, event_id) AS focal FROM events WHERE event_type = 'view' GROUP BY user_id) SELECT e.event_id, round(e.value / k.focal, 6) AS x FROM events e JOIN k USING (user_id) WHERE e.event_type = 'click' AND k.focal > 0")
def s2_camera_info(spark, sf_dir):
    """Frames with the camera info that came last; those of a camera without one wait."""
    e = table(spark, sf_dir, "events")
    info = frames.last_info(e.where("event_type = 'view'"), "user_id", ["event_id"]).select("user_id", F.col("value").alias("focal"))
    return e.where("event_type = 'click'").join(info, "user_id").where("focal > 0").select("event_id", r(F.col("value") / F.col("focal"), "x"))


@query("WITH t AS (SELECT user_id, ts, event_id, event_type, CAST(trunc(value) AS INT) % 4 AS c, last(CASE WHEN event_type = 'view' THEN CAST(trunc(value) AS INT) % 4 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gt FROM events) SELECT gt, c AS pred, count(*) AS n FROM t WHERE event_type = 'click' AND gt IS NOT NULL GROUP BY ALL")
def s21_latest_truth(spark, sf_dir):
    """Confusion of each prediction with the truth that came last before it, whatever its stamp."""
    e = table(spark, sf_dir, "events").withColumn("c", F.col("value").cast("int") % 4)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    both = e.withColumn("gt", F.last(F.when(F.col("event_type") == "view", F.col("c")), ignorenulls=True).over(w))
    return metrics.confusion(both.where("event_type = 'click' AND gt IS NOT NULL").withColumnRenamed("c", "pred"))


@query("WITH k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events) SELECT user_id, event_id FROM k WHERE (i - 1) % 4 = 0")
def w8_k4_every_fourth(spark, sf_dir):
    """Every fourth row of a key: the display's sampling."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("i", F.row_number().over(w)).where("(i - 1) % 4 = 0").select("user_id", "event_id")


@query("""WITH e AS (SELECT user_id, event_type, ts, max(ts) OVER () - INTERVAL 5 DAY AS cut FROM events), o AS (SELECT user_id, event_type, count(*) AS n FROM e WHERE ts < cut GROUP BY ALL), f AS (SELECT user_id, event_type, count(*) AS n FROM e WHERE ts >= cut GROUP BY ALL)
  SELECT f.user_id, f.event_type, coalesce(o.n, 0) + f.n AS n, o.n IS NULL AS fresh FROM f LEFT JOIN o USING (user_id, event_type)""")
def o7_t9_changed_cells(spark, sf_dir):
    """Cells that the last five days touched, with their counts over all time: what an incremental publisher sends."""
    e = table(spark, sf_dir, "events")
    cut = e.agg((F.max("ts") - F.expr("INTERVAL 5 DAY")).alias("cut"))
    both = e.withColumn("cut", cut.scalar()).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts") >= F.col("cut")).alias("late"))
    return both.where("late > 0").select("user_id", "event_type", "n", (F.col("n") == F.col("late")).alias("fresh"))


@query("""WITH p AS (SELECT p_partkey % 20 AS u, p_partkey // 20 % 15 AS v, arg_max(p_size % 5, p_partkey) AS pred FROM part GROUP BY 1, 2), g AS (SELECT p_partkey % 40 AS u, p_partkey // 40 % 30 AS v, arg_max(CASE WHEN p_size > 45 THEN 255 ELSE p_size % 5 END, p_partkey) AS gt FROM part GROUP BY 1, 2)
  SELECT CAST(gt AS INT) AS gt, CAST(pred AS INT) AS pred, count(*) AS n FROM g JOIN p ON p.u = g.u // 2 AND p.v = g.v // 2 WHERE gt <> 255 GROUP BY ALL""")
def j19_resized_pixels(spark, sf_dir):
    """Confusion of a label image with a prediction of half its size, by the nearest pixel."""
    k, size = F.col("p_partkey"), F.col("p_size")
    image = lambda w, h, c: table(spark, sf_dir, "part").groupBy((k % w).alias("u"), (F.floor(k / w) % h).alias("v")).agg(F.max_by(c, k).alias("c"))
    pred, gt = image(20, 15, size % 5).withColumnRenamed("c", "pred"), image(40, 30, F.when(size > 45, 255).otherwise(size % 5)).withColumnRenamed("c", "gt")
    return metrics.confusion(metrics.resize_join(gt, pred, (40, 30), (20, 15)))


@query("SELECT user_id, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END), 6) AS reachability, min(CASE WHEN value > 50 THEN value END) AS nearest, round(CASE WHEN avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END) > 0.4 THEN 1 ELSE exp(-min(value) / 100) END, 6) AS kernel FROM events GROUP BY user_id")
def a28_m10_reachability(spark, sf_dir):
    """Share of reachable observations and the nearest of them, per key."""
    ok, share = F.col("value") > 50, F.avg((F.col("value") > 50).cast("double"))
    kernel = S.reachability_kernel(share > 0.4, F.min("value") / 100)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), r(share, "reachability"), F.min(F.when(ok, F.col("value"))).alias("nearest"), r(kernel, "kernel"))
