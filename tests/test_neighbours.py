"""Neighbour counts against all pairs in numpy."""

import time

import numpy as np
import pytest

from evigrid.operators import neighbours, spatial


def brute(xyz, labels, radius, weights=None):
    """n and same for each row, itself not counted; weights: copies of a row."""
    w = np.ones(len(xyz), np.int64) if weights is None else weights
    n, same = np.zeros(len(xyz), np.int64), np.zeros(len(xyz), np.int64)
    for i, p in enumerate(xyz):
        d = p - xyz
        near = (0.0 + d[:, 0] * d[:, 0]) + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] < radius * radius
        n[i], same[i] = w[near].sum() - 1, w[near & (labels == labels[i])].sum() - 1
    return n, same


@pytest.mark.parametrize(("most", "deepest"), [(1 << 16, 20), (4, 20), (1, 2)])
def test_counts_by_cells(spark, monkeypatch, most, deepest):
    monkeypatch.setattr(neighbours, "OPEN", most)
    monkeypatch.setattr(neighbours, "DEEPEST", deepest)
    rng = np.random.default_rng(5)
    xyz = np.concatenate([rng.normal(0, 0.3, (250, 3)), rng.normal(2, 0.01, (120, 3)), rng.integers(-2, 2, (80, 3)) * 0.5])
    labels = rng.integers(0, 3, len(xyz))
    rows = [(i, *map(float, p), int(k)) for i, (p, k) in enumerate(zip(xyz, labels, strict=True))] + [(9000, None, 0.0, 0.0, 1), (9001, 1e6, 0.0, 0.0, 1)]
    got = {r["id"]: (r["n"], r["same"]) for r in neighbours.neighbour_counts(spark.createDataFrame(rows, "id long, x double, y double, z double, label long").repartition(3), 0.5).collect()}
    n, same = brute(xyz, labels, 0.5)
    assert got == {i: (n[i], same[i]) for i in range(len(xyz))} | {9000: (0, 0), 9001: (0, 0)}


def test_a_crowd_in_one_cell(spark):
    """200,000 points in one cell: 4e10 pairs, counted in a minute or two."""
    rng = np.random.default_rng(1)
    places = np.stack(np.meshgrid(*[np.arange(1, 10) * 0.1] * 3), -1).reshape(-1, 3).astype(float)
    of, label = rng.integers(0, len(places), 200_000), rng.integers(0, 2, 200_000)
    df = spark.createDataFrame(__import__("pandas").DataFrame({"id": np.arange(200_000), "x": places[of, 0], "y": places[of, 1], "z": places[of, 2], "label": label}))
    began = time.time()
    got = spatial.spatial_uncertainty(df, 1.0).select("id", "n", "same").toPandas().set_index("id").sort_index()
    assert time.time() - began < 400
    kinds, weights = np.unique(np.stack([of, label], 1), axis=0, return_counts=True)
    n, same = brute(places[kinds[:, 0]], kinds[:, 1], 1.0, weights)
    at = {tuple(k): i for i, k in enumerate(kinds)}
    rows = [at[o, k] for o, k in zip(of, label, strict=True)]
    assert (got["n"].to_numpy() == n[rows]).all() and (got["same"].to_numpy() == same[rows]).all()


def test_neighbours_of_one_class_and_of_five(spark):
    """Ten points a tenth apart: all of class 5, or of class i mod 5."""
    line = lambda label: spark.createDataFrame([(i, i / 10, 0.0, 0.0, label(i)) for i in range(10)], "id long, x double, y double, z double, label int")
    assert {r["u_spatial"] for r in spatial.spatial_uncertainty(line(lambda i: 5), 0.35).collect()} == {0.0}
    assert {r["u_spatial"] for r in spatial.spatial_uncertainty(line(lambda i: i % 5), 0.35).collect()} == {1.0}
