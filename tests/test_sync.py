"""Frames used once, against one loop; primitives that absorb others, against two loops."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigrid.operators import primitives, sync

START = datetime(2024, 1, 1)


def greedy(streams, most):
    """The earliest frames of all streams are a tuple, or else the earliest one goes."""
    queues, out = [sorted(s) for s in streams], []
    while all(queues):
        first = [q[0][0] for q in queues]
        if max(first) - min(first) <= most:
            out.append((*(q.pop(0)[1] for q in queues), max(first) - min(first)))
        else:
            queues[first.index(min(first))].pop(0)
    return out


@pytest.mark.parametrize(("streams", "slot", "span"), [(4, 4096, 300), (4, 1, 300), (2, 2, 4000), (3, 3, 60)])
def test_frames_are_used_once(spark, monkeypatch, streams, slot, span):
    monkeypatch.setattr(sync, "SLOT", slot)
    rng, most = random.Random(streams * slot), 5
    own = {(key, s): [(rng.randrange(span), i * 10 + s) for i in range(rng.choice([0, 60]) if key == "b" else 60)] for key in ("a", "b", None) for s in range(streams)}
    frames = [spark.createDataFrame([(key, START + timedelta(microseconds=t), i) for (key, k), f in own.items() if k == s for t, i in f] or [("z", START, -1)], "robot string, ts timestamp_ntz, id long") for s in range(streams)]
    got = sync.sync_once([f.repartition(3) for f in frames], "robot", "ts", "id", most).collect()
    for key in ("a", "b", None):
        assert sorted(tuple(r)[1:] for r in got if r["robot"] == key) == sorted(greedy([own[key, s] for s in range(streams)], most))
    for k in range(streams):
        ids = [(r["robot"], r[f"id_{k}"]) for r in got]
        assert len(ids) == len(set(ids))


def test_only_frames_in_reach_are_held():
    """A stream that stays silent doesn't fill the memory."""
    import tracemalloc

    tracemalloc.start()
    assert not list(sync.matches(((t, 0, t) for t in range(300_000)), 2, 10))
    assert tracemalloc.get_traced_memory()[1] < 1_000_000
    tracemalloc.stop()


def fuse(p, q, u, v):
    a, b = np.array(p) / sum(p) * (1 - u), np.array(q) / sum(q) * (1 - v)
    joint = a * b + a * v + u * b
    return joint / joint.sum(), sum(a[i] * b[j] for i in range(len(a)) for j in range(len(b)) if i != j)


def two_loops(rows, most, calm):
    out, gone = {}, set()
    rows = sorted(rows)
    for i, row in enumerate(rows):
        if i in gone:
            continue
        name, c, at, w, n, u, k, p = row
        at, members = np.array(at), [name]
        for j in range(i + 1, len(rows)):
            other, oc, oat, ow, on, ou, ok, op = rows[j]
            if j in gone or c != oc or ((at - oat) ** 2).sum() > most * most or k > calm or ok > calm:
                continue
            p, k = fuse(p, op, u, ou)
            at, w, u, n, c = (at * w + np.array(oat) * ow) / (w + ow), w + ow, (u * n + ou * on) / (n + on), n + on, int(np.argmax(p))
            gone.add(j)
            members.append(other)
        out |= {m: (name, c, round(k, 9), round(u, 9), n) for m in members}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_merges_renew_class_and_conflict(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(160):
        p = rng.random(3) ** 3
        rows.append((i, int(rng.integers(0, 3)), tuple(map(float, rng.random(3) * [3, 1, 0.2])), float(rng.integers(1, 9)), int(rng.integers(1, 30)), float(rng.random()), float(rng.random() * 0.5), (p / p.sum()).tolist()))
    df = spark.createDataFrame([(i, c, *at, w, n, u, k, p) for i, c, at, w, n, u, k, p in rows], "id long, class int, x double, y double, z double, w double, n long, u double, conflict double, p array<double>")
    got = {r["id"]: (r["root"], r["class"], round(r["conflict"], 9), round(r["u"], 9), r["n"]) for r in primitives.merge_near(df.repartition(3), 0.25, 0.3).collect()}
    want = two_loops(rows, 0.25, 0.3)
    assert got == want
    roots = {r[0]: r for r in rows}
    assert any(c != roots[root][1] for root, c, *_ in want.values())  # a merge changed the class
    assert any(k > 0.3 >= roots[root][6] for root, _, k, *_ in want.values())  # one made the conflict too large
