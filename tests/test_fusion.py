"""Beliefs fused by parts against one loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigrid.operators import fusion


def beliefs(seed, n, classes=4, sharp=False):
    rng = np.random.default_rng(seed)
    p = rng.random((n, classes)) ** (6 if sharp else 1)
    return [(i, "a" if i % 3 else None, (p[i] / p[i].sum() * (1 if i % 5 else 3)).tolist(), float(rng.random()), float(rng.integers(1, 9))) for i in range(n)]


def brute(rows, weighted):
    out = {}
    for key in {r[1] for r in rows}:
        own = [r for r in sorted(rows) if r[1] == key]
        p, u, w, most, last = np.array(own[0][2]), own[0][3], own[0][4], 0.0, 0.0
        for _, _, q, v, x in own[1:]:
            a, b = (m / m.sum() * (1 - t) if m.sum() > 1e-10 else m * 0 for m, t in ((np.array(p), u), (np.array(q), v)))
            last = min(sum(a[i] * b[j] for i in range(len(a)) for j in range(len(b)) if i != j), 1 - 1e-10)
            p = np.array([a[i] * b[i] + a[i] * v + u * b[i] for i in range(len(a))])
            p = p / p.sum() if p.sum() > 1e-10 else p
            u, w = ((u * w + v * x) / (w + x) if weighted else (u + v) / 2), w + x
            most = max(most, last)
        out[key] = (p, u, most, last)
    return out


@pytest.mark.parametrize(("n", "width", "weighted", "sharp"), [(700, 7, False, False), (700, 50, True, True), (90, 10_000, False, False), (3000, 1300, False, True), (1, 1, True, False)])
def test_parts_give_what_one_loop_gives(spark, n, width, weighted, sharp):
    rows = beliefs(n + width, n, sharp=sharp)
    df = spark.createDataFrame(rows, "id long, key string, p array<double>, u double, w double").repartition(3)
    got = fusion.fuse_in_order(df, "key", ["id"], "p", "u", part=F.floor(F.col("id") / width), weight="w" if weighted else None).collect()
    want = brute(rows, weighted)
    assert {r["key"] for r in got} == set(want)
    for r in got:
        p, u, most, last = want[r["key"]]
        assert r["p"] == pytest.approx(p, abs=1e-9) and r["u"] == pytest.approx(u) and r["conflict"] == pytest.approx(most) and r["last_conflict"] == pytest.approx(last)


def test_beliefs_that_contradict_each_other(spark):
    """Certain and opposite: nothing agrees, and what follows starts from nothing."""
    rows = [(i, "a", [1.0, 0.0] if i != 4 else [0.0, 1.0], 0.0, 1.0) for i in range(7)] + [(7, "a", [0.2, 0.8], 0.5, 1.0)] + [(i, "b", [0.6, 0.4], 0.3, 1.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, key string, p array<double>, u double, w double")
    want = brute(rows, False)
    for r in fusion.fuse_in_order(df, "key", ["id"], "p", "u", part=F.floor(F.col("id") / 2)).collect():
        assert r["p"] == pytest.approx(want[r["key"]][0]) and r["conflict"] == pytest.approx(want[r["key"]][2])


def test_changes_by_parts(spark):
    """Parts of any width give the transitions of one loop; changes come at, before and behind the ends of parts."""
    import random

    from evigrid.operators import folds

    rng = random.Random(8)
    rows = [(k, t, rng.choice("ab") if rng.random() < 0.4 else "a") for k in "xyz" for t in sorted(rng.sample(range(4000), 300))] + [("one", 5, "a")]
    want = {}
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        c, last, n = own[0][2], 0.0, 0
        for _, t, x in own[1:]:
            if x != c:
                n, last = n + (t - last < 30), t
            c = x
        want[key] = (len(own), n, n >= 2, last, round(1 - 0.9 ** len(own), 6))
    df = spark.createDataFrame(rows, "k string, t int, c string").withColumn("ts", F.timestamp_seconds("t"))
    for part in (None, F.floor(F.col("t") / 7), F.floor(F.col("t") / 500)):
        got = {r["k"]: (r["frames"], r["transitions"], r["dynamic"], r["last_change"], r["occupancy"]) for r in folds.dynamic_status(df, "k", "c", "ts", [], 30.0, part=part).collect()}
        assert got == want


def test_components_with_hubs(spark, monkeypatch):
    from evigrid.operators import graph

    monkeypatch.setattr(graph, "SHARE", 20)
    edges = [(0, k) for k in range(1, 150)] + [(k, k + 1) for k in range(200, 290)] + [(289, 500), (500, 501), (900, 899)] + [(700, 700)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(150)} | {k: 200 for k in [*range(200, 291), 500, 501]} | {899: 899, 900: 899, 700: 700}
