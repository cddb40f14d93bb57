import numpy as np
import pytest

from evigrid.operators import neighbours


def brute(rows, radius):
    """Components over all pairs of different ids nearer than radius."""
    to = {}

    def root(i):
        while to[i] != i:
            i = to[i]
        return i

    at = np.array([r[1:] for r in rows])
    for i, (a, *p) in enumerate(rows):
        d = at[i:] - np.array(p)
        for j in np.flatnonzero((d * d).sum(axis=1) < radius * radius) + i:
            b = rows[j][0]
            if a != b:
                to.setdefault(a, a), to.setdefault(b, b)
                x, y = sorted((root(a), root(b)))
                to[y] = x
    return {i: root(i) for i in to}


@pytest.mark.parametrize("most", [1 << 16, 4])
def test_components_of_points_against_all_pairs(spark, monkeypatch, most):
    """Scattered points, crowds just in and out of reach, repeated ids and places; and with cells halved down to few points."""
    monkeypatch.setattr(neighbours, "OPEN", most)
    rng = np.random.default_rng(5)
    rows = [(int(i), *map(float, p)) for i, p in enumerate(rng.normal(0, 1.0, (400, 3)))]
    for k, gap in enumerate((0.199, 0.2, 0.21, 0.35)):  # two crowds each, whose nearest points are that far apart
        for side in (0, 1):
            face = np.abs(rng.normal(0, 0.1, (60, 3)))
            face[:, 1:] = rng.uniform(0, 0.05, (60, 2))
            face[0] = 0
            rows += [(1000 + 200 * k + 100 * side + j, float(10 * (k + 1) + (gap + p[0] if side else -p[0])), float(p[1]), float(p[2])) for j, p in enumerate(face)]
    rows += [(7, 90.0, 0.0, 0.0), (7, 90.1, 0.0, 0.0), (5000, 90.25, 0.0, 0.0), (5001, 95.0, 0.0, 0.0), (5001, 95.0, 0.0, 0.0)]
    odd = [(6000, float("nan"), 0.0, 0.0), (6001, None, 0.0, 0.0), (6002, float("inf"), 0.0, 0.0), (6003, float("inf"), 0.0, 0.0), (None, 10.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows + odd, "id long, x double, y double, z double")
    got = neighbours.near_components(df, 0.2).collect()
    assert {r["id"]: r["component"] for r in got} == brute(rows, 0.2) and len(got) == len({r["id"] for r in got})


def test_a_crowd_makes_no_row_for_each_pair(spark, monkeypatch):
    """200,000 points within reach of each other (2e10 pairs): one link for each."""
    seen = []
    monkeypatch.setattr(neighbours.graph, "components", lambda edges, own=neighbours.graph.components: (seen.append(edges.count()), own(edges))[1])
    df = spark.range(200_000).selectExpr("id", "rand(1) / 100 x", "rand(2) / 100 y", "rand(3) / 100 z")
    got = neighbours.near_components(df, 0.05)
    assert got.where("component = 0").count() == 200_000 and max(seen) == 199_999
