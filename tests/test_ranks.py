"""Exact selection against sorted lists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigrid.operators import metrics, ranks


def rows():
    rng = random.Random(3)
    out = [("a", rng.random()) for _ in range(2000)] + [("b", float(rng.randint(0, 3))) for _ in range(500)] + [("c", 5.0)] * 40 + [("d", None), ("d", float("nan"))]
    out += [(None, rng.gauss(0, 1e300)) for _ in range(300)] + [("e", 2.0**-k) for k in range(300)] + [("e", -(2.0**k)) for k in range(300)] + [("f", 1.0), ("f", float("inf"))]
    return out


@pytest.mark.parametrize(("few", "parts", "rows_"), [(1 << 16, 4096, 100_000), (20, 64, 0)])
def test_order_statistics(spark, monkeypatch, few, parts, rows_):
    for name, value in (("FEW", few), ("RANGES", parts), ("BROADCAST_ROWS", rows_)):
        monkeypatch.setattr(ranks, name, value)
    own = rows()
    df = spark.createDataFrame(own, "g string, v double").repartition(3)
    got = {(r["g"], r["rank"]): (r["n"], r["value"]) for r in ranks.order_statistics(df, ["g"], "v", lambda n: F.array(F.lit(0), F.floor(n / 3), n - 1, n)).collect()}
    want = {}
    for g in {g for g, _ in own}:
        v = sorted(v for k, v in own if k == g and v is not None and abs(v) < float("inf"))
        want |= {(g, k): (len(v), v[k]) for k in (0, len(v) // 3, len(v) - 1) if v}
    assert got == want


def test_quantiles_of_one_group_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", 50)
    v = np.random.default_rng(1).normal(size=5000).round(2)
    df = spark.createDataFrame([(1, float(x)) for x in v], "g int, v double")
    got = ranks.quantiles(df, ["g"], "v", {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.951, "e": 1.0}).first()
    assert [got[k] for k in "abcde"] == pytest.approx(np.quantile(v, [0, 0.05, 0.5, 0.951, 1]))
    assert ranks.quantiles(df.limit(0), ["g"], "v", {"a": 0.5}).count() == 0


def test_graded_uncertainty(spark):
    """50 points with uncertainties i / 50."""
    df = spark.createDataFrame([(0, i / 50, 1 - i / 50, 0.5) for i in range(50)], "frame int, u double, s double, t double")
    got = metrics.uncertainty_info(df, "frame", {"semantic": "u", "spatial": "s"}, "u", 0.6).first()
    assert got["num_points"] == 50 and got["num_filtered"] == 19 and got["histogram"] == [5] * 10
    assert got["semantic_median"] == pytest.approx(0.49) and got["percentile_95"] == pytest.approx(0.931) and got["corr_semantic_spatial"] == pytest.approx(-1)
    assert got["total_std"] == pytest.approx(np.std(np.arange(50) / 50), abs=1e-6)


def test_histogram_takes_in_both_ends(spark):
    df = spark.createDataFrame([(0, x) for x in (0.0, 0.1, 0.9999, 1.0, 1.2, -0.1)], "frame int, u double")
    got = metrics.uncertainty_info(df, "frame", {}, "u", 2.0).first()
    assert got["histogram"] == [1, 1, 0, 0, 0, 0, 0, 0, 0, 2]
