import glob
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigrid import config
from evigrid.functions import evidential as E
from evigrid.functions import geometry as G
from evigrid.operators import folds, influence, maps, metrics, primitives, spatial, visibility
from evigrid.sources import frames, images, sinks


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_digamma_and_lgamma(spark):
    got = one(spark, E.digamma(F.lit(1.0)), E.digamma(F.lit(5.5)), E.lgamma(F.lit(1.0)), E.lgamma(F.lit(7.0)))
    assert got == pytest.approx((-0.5772156649, 1.6110931485, 0.0, np.log(720)), abs=1e-8)


def test_evidence_values(spark):
    flat, sure, split = (F.array(*(F.lit(float(v)) for v in x)) for x in ([1, 1, 1, 1], [101, 1, 1, 1], [21, 21, 1, 1]))
    kl, d1, d2 = one(spark, E.kl_to_uniform(flat), E.dissonance(sure), E.dissonance(split))
    assert kl == pytest.approx(0, abs=1e-8) and d1 < 0.01 and d2 > 0.4
    mean, var, u = E.moments(flat, F.array(*[F.lit(0.25)] * 4), F.lit(4.0))
    assert one(spark, mean, u)[1] == 0.5


def test_facing_turns_x_to_the_target(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    q = G.facing(lit(0, 0, 0), lit(1, 2, 2))
    assert one(spark, *G.rotate(q, lit(1, 0, 0))) == pytest.approx((1 / 3, 2 / 3, 2 / 3))
    assert one(spark, *G.facing(lit(0, 0, 0), lit(2, 0, 0))) == (1, 0, 0, 0)


def test_eigenvalues_and_markers(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(20):
        a = rng.normal(size=(3, 3))
        m = a @ a.T
        rows.append((i, *map(float, m[np.triu_indices(3)])))
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"c{k} double" for k in G.ENTRIES))
    m = {r["id"]: r for r in df.select("id", F.array(*G.eigenvalues([F.col(f"c{k}") for k in G.ENTRIES])).alias("e")).collect()}
    turns = {r["id"]: r for r in primitives.markers(df).collect()}
    for i, *c in rows:
        full = np.zeros((3, 3))
        full[np.triu_indices(3)] = c
        full = full + full.T - np.diag(np.diag(full))
        assert m[i]["e"] == pytest.approx(list(np.linalg.eigvalsh(full)), rel=1e-6, abs=1e-9)
        w, x, y, z = turns[i]["turn"]
        r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
        back = r.T @ full @ r
        assert np.abs(back - np.diag(np.diag(back))).max() < 1e-6


def test_ray_behind_an_obstacle_is_blocked(spark):
    rays = spark.createDataFrame([(1, 0.5, 0.5, 0.5, 6.5, 0.5, 0.5), (2, 0.5, 0.5, 0.5, 0.5, 6.5, 0.5)], "id long, x double, y double, z double, tx double, ty double, tz double")
    wall = spark.createDataFrame([(3, 0, 0)], "ix int, iy int, iz int")
    assert [r["id"] for r in visibility.clear(rays, ["id"], wall, 1.0).collect()] == [2]


def test_later_primitives_join_the_first_of_their_class(spark):
    rows = [(1, 0, 0.0, 0.0, 0.0, 1.0, 0.0), (2, 0, 0.2, 0.0, 0.0, 1.0, 0.0), (3, 0, 0.35, 0.0, 0.0, 1.0, 0.0), (4, 1, 0.0, 0.0, 0.0, 1.0, 0.0), (5, 0, 0.1, 0.0, 0.0, 1.0, 0.9)]
    df = spark.createDataFrame(rows, "id long, class int, x double, y double, z double, w double, conflict double").selectExpr("*", "10L AS n", "0.9D AS u", "if(class = 0, array(0.9D, 0.1D), array(0.1D, 0.9D)) AS p")
    assert {r["id"]: r["root"] for r in primitives.merge_near(df, 0.3, 0.3).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_split_parts_two_groups(spark):
    points = spark.createDataFrame([(i, (i % 2) * 2.0 + i / 1000, 0.0, 0.0) for i in range(40)], "id long, x double, y double, z double")
    prim = spark.createDataFrame([(7, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.1, 0.0, 0.1)], "id long, x double, y double, z double, cxx double, cxy double, cxz double, cyy double, cyz double, czz double")
    sides = {r["id"]: r["side"] for r in primitives.split(prim, points).collect()}
    assert len(sides) == 40 and all(s == i % 2 for i, s in sides.items())


def test_nearest_of_all_has_no_radius(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 900.0, 0.0, 0.0)], "id long, x double, y double, z double")
    b = spark.createDataFrame([(8, 0.5, 0.0, 0.0), (9, 100.0, 0.0, 0.0)], a.schema)
    assert {r["id"]: (r["nearest"], r["distance"]) for r in spatial.nearest_of_all(a, b, 1.0).collect()} == {1: (8, 0.5), 2: (9, 800.0)}
    assert spatial.nearest_of_all(a, b.limit(0), 1.0).count() == 0


def cloud(spark, rng, n, first, *centres):
    rows = [(first + i, *map(float, np.round(rng.normal(centres[i % len(centres)], 0.7, 3), 2))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double, z double")


def test_spatial_joins_against_brute_force(spark, monkeypatch):
    """Dense cells dealt to several tasks, far groups, ties and equal points."""
    rng = np.random.default_rng(8)
    a, left = cloud(spark, rng, 150, 0, (0, 0, 0), (9, 0, 0))
    b, right = cloud(spark, rng, 120, 1000, (0, 0, 0), (40, 0, 0))
    b += [(5000 + i, *r[1:]) for i, r in enumerate(b[:10])]
    right = spark.createDataFrame(b, right.schema)
    d2 = lambda p, q: sum((u - v) * (u - v) for u, v in zip(p[1:], q[1:], strict=True))
    for share in (4096, 8):
        monkeypatch.setattr(spatial, "SHARE", share)
        for radius in (0.8, 3.0):
            pairs = spatial.radius_pairs(left, right, radius).select("id", "other_id").collect()
            assert len(pairs) == len(set(pairs)) and set(map(tuple, pairs)) == {(p[0], q[0]) for p in a for q in b if d2(p, q) < radius * radius}
    for radius in (0.3, 100.0):
        got = {r["id"]: (r["nearest"], r["distance"]) for r in spatial.nearest_of_all(left, right, radius).collect()}
        want = {p[0]: min((d2(p, q), q[0]) for q in b) for p in a}
        assert {k: v[0] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
        assert all(got[k][1] == pytest.approx(v[0] ** 0.5, abs=1e-6) for k, v in want.items())


def test_voxel_folds_by_parts(spark):
    """Evidence and moving costs are the same however their rows are parted."""
    rng = np.random.default_rng(9)
    rows = [(i, i % 3, 0, 0, float(s), [float(q) for q in rng.dirichlet([1, 1])]) for i, s in enumerate(rng.uniform(0, 9, 300))]
    acting = spark.createDataFrame(rows, "id long, ix int, iy int, iz int, scale double, p array<double>")
    for part in (1, 7, 4096):
        h = np.zeros((3, 2))
        for _, x, _, _, s, p in rows:
            h[x] = np.clip(h[x] + s * np.log(np.clip(p, 1e-6, 1 - 1e-6) / 0.5), -10, 10)
        got = {r["ix"]: (r["n"], r["h"]) for r in influence.evidence_map(acting, 2, 0.5, part=part).collect()}
        assert all(got[x][0] == 100 and got[x][1] == pytest.approx(list(h[x]), abs=1e-9) for x in range(3))
    seen = [(float(i % 3), 0.0, 0.0, float(np.round(u, 1)), int(k), i) for i, (u, k) in enumerate(zip(rng.random(300), rng.integers(0, 4, 300), strict=True))]
    points = spark.createDataFrame(seen, "x double, y double, z double, u double, class int, ts int")
    costs = {0: 0, 1: 80, 2: 60}
    want = {}
    for x, _, _, u, k, _ in seen:
        c = costs.get(k, 50) / 100
        if x in want:
            m, v, old = want[x]
            want[x] = (0.3 * c + 0.7 * m, 0.3 * u + 0.7 * v, k if u + maps.TIE < v else old)
        else:
            want[x] = (c, u, k)
    for part in (None, F.floor(F.col("ts") / 7), F.col("ts")):
        got = {float(r["ix"]): r for r in maps.moving_costs(points, (1.0, 1.0, 1.0), costs, part=part).collect()}
        for x, (m, v, k) in want.items():
            assert (got[x]["cost"], got[x]["u"]) == pytest.approx((m, v), abs=1e-9) and got[x]["class"] == k and got[x]["n"] == 100


def test_auprc_against_brute_force(spark):
    rng = np.random.default_rng(3)
    gt, p = rng.integers(0, 3, 60), np.round(rng.random((60, 3)), 1)  # many ties
    df = spark.createDataFrame([(list(map(float, q)), int(g)) for q, g in zip(p, gt, strict=True)] + [([1.0, 0.0, 0.0], 255)], "p array<double>, label int")
    got = {r["class"]: r["auprc"] for r in metrics.auprc(df, "p", "label").collect()}
    for c in range(3):
        curve = [(0.0, 1.0)]
        for t in sorted(set(p[:, c]), reverse=True):
            chosen = p[:, c] >= t
            hits = (chosen & (gt == c)).sum()
            curve.append((hits / (gt == c).sum(), hits / chosen.sum()))
        area = sum((x2 - x1) * (y1 + y2) / 2 for (x1, y1), (x2, y2) in zip(curve, curve[1:], strict=False))
        assert got[c] == pytest.approx(area, abs=1e-6)


def test_packed_points_round_trip(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 2.0, 3.0, 255, 4, 0.5), ("a", 1, 1.5, 2.0, 3.0, 1, 2, 0.25)], frames.POINT_SCHEMA)
    assert frames.decode_points(frames.encode_points(df)).orderBy("idx").collect() == df.collect()
    assert frames.decode_points(spark.createDataFrame([("e", None)], "frame string, data binary")).count() == 0


def test_cloud_with_missing_fields(spark):
    df = spark.createDataFrame([(1.0, 2.0, 2.0), (float("nan"), 0.0, 0.0)], "x double, y double, z double")
    assert [tuple(r) for r in frames.semantic_points(df).collect()] == [(1.0, 2.0, 2.0, 0, 0.3, 0.7, 3.0)]
    with pytest.raises(ValueError):
        frames.semantic_points(df.drop("z"))


def test_dataset_by_stem(spark, tmp_path):
    for folder, names in {"rgb": ["1.png", "2.png"], "depth": ["1.npy", "1.png", "3.png"], "label": ["9.npy"]}.items():
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_bytes(n.encode())
    got = frames.dataset(spark, str(tmp_path), label="label").collect()
    assert [(r["stem"], bytes(r["depth"]), r["label"]) for r in got] == [("1", b"1.png", None)]
    np.save(tmp_path / "label" / "a.npy", np.arange(6).reshape(2, 3))
    (tmp_path / "label" / "9.npy").unlink()
    pixels = images.pixels(frames.files(spark, str(tmp_path / "label"), ("npy",))).collect()
    assert sorted((r["v"], r["u"], r["value"]) for r in pixels) == [(i // 3, i % 3, float(i)) for i in range(6)]


def png(a, kinds):
    """A PNG of an array (height, width, channels) of 8 or 16 bits, its lines filtered in turn by the kinds."""
    bits, (height, width, channels) = a.dtype.itemsize * 8, a.shape
    raw = a.astype(a.dtype.newbyteorder(">")).reshape(height, -1).view(np.uint8).reshape(height, -1).astype(int)
    step, lines = channels * bits // 8, []
    for y in range(height):
        line, up = raw[y], raw[y - 1] if y else np.zeros_like(raw[0])
        left, corner = np.concatenate([np.zeros(step, int), line[:-step]]), np.concatenate([np.zeros(step, int), up[:-step]])
        rise = left + up - corner
        near = np.where((abs(rise - left) <= abs(rise - up)) & (abs(rise - left) <= abs(rise - corner)), left, np.where(abs(rise - up) <= abs(rise - corner), up, corner))
        kind = kinds[y % len(kinds)]
        lines.append(bytes([kind]) + ((line - [0, left, up, (left + up) // 2, near][kind]) % 256).astype(np.uint8).tobytes())
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    colour = {1: 0, 3: 2, 4: 6}[channels]
    head = struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, 0)
    data = zlib.compress(b"".join(lines))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", data[:7]) + chunk(b"IDAT", data[7:]) + chunk(b"IEND", b"")


def test_png_images(spark, tmp_path):
    rng = np.random.default_rng(4)
    for dtype, channels in ((np.uint8, 1), (np.uint16, 1), (np.uint8, 3), (np.uint8, 4), (np.uint16, 3)):
        a = rng.integers(0, np.iinfo(dtype).max, (11, 7, channels)).astype(dtype)
        for kinds in ([0], [1], [2], [3], [4], [4, 3, 2, 1, 0]):
            assert (images.read_image(png(a, kinds)) == a).all()
    with pytest.raises(ValueError, match="neither"):
        images.read_image(b"GIF89a")
    (tmp_path / "rgb").mkdir()
    (tmp_path / "depth").mkdir()
    mm = np.array([[[0], [1000]], [[2500], [50]]], np.uint16)
    (tmp_path / "depth" / "a.png").write_bytes(png(mm, [1]))
    np.save(tmp_path / "depth" / "b.npy", np.array([[1.5, 0.0]]))
    (tmp_path / "rgb" / "a.png").write_bytes(b"x")
    (tmp_path / "rgb" / "b.jpg").write_bytes(b"x")
    found = frames.dataset(spark, str(tmp_path), label=None).select("stem", "depth")
    nyu = {(r["v"], r["u"]): r for r in images.depth_points(found.where("stem = 'a'"), "nyuv2").collect()}
    assert {k: r["depth"] for k, r in nyu.items()} == {(0, 1): 1.0, (1, 0): 2.5, (1, 1): 0.05}
    assert nyu[1, 0]["x"] == pytest.approx((0 - 325.5824) * 2.5 / 518.8579) and nyu[1, 0]["y"] == pytest.approx((1 - 253.7362) * 2.5 / 519.4696) and nyu[1, 0]["z"] == 2.5
    sun = {(r["stem"], r["v"], r["u"]): r["depth"] for r in images.depth_points(found, "sunrgbd").collect()}
    assert sun == {("a", 0, 1): 0.1, ("a", 1, 0): 0.25, ("a", 1, 1): 0.005, ("b", 0, 0): 1.5}  # over 100: tenths of millimetres
    assert images.pixels(found, "depth", 2).where("stem = 'a'").count() == 1


def test_parameters():
    own = config.load("uncertainty:\n  w_semantic: 3\n  w_spatial: 1  # a comment\n  w_observation: 0\n  w_temporal: 0\nkernel:\n  traversable_classes: [2, 5]\n  unknown: 1\nother:\n  gamma: 9\nprocessing:\n  use_async_processing: false\nmap:\n  frame_id: \"odom\"\n")
    assert (own.uncertainty.w_semantic, own.uncertainty.w_spatial) == (0.75, 0.25) and own.uncertainty.sigma_range == 0.5
    assert own.kernel.traversable_classes == (2, 5) and own.kernel.gamma == 2.0 and not own.processing.use_async_processing and own.map.frame_id == "odom"
    assert config.load(config.save(own)) == own and config.load("") == config.Config()
    given = {"map/resolution": 0.1, "kernel/gamma": 1.0, "old_gamma": 4.0}
    both = config.from_parameters(given, {"kernel/gamma": "old_gamma", "map/size_x": "old_size"})
    assert both.map.resolution == 0.1 and both.kernel.gamma == 4.0 and both.map.size_x == 20.0
    new, done, failed = config.update(own, {"kernel": {"gamma": 1.5, "none": 1, "uncertainty_low": "high"}, "map": {"resolution": 1.0}}, {"kernel"})
    assert new.kernel.gamma == 1.5 and new.map.resolution == 0.05 and done == ["kernel.gamma"] and failed == ["kernel.none", "kernel.uncertainty_low"]


def test_empty_cluster_starts_at_the_farthest_point(spark):
    rows = [(i, float(i % 3), 0.0, 0.0, 0.1) for i in range(30)] + [(30, 100.0, 0.0, 0.0, 0.1)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, u double")
    _, centres = spatial.kmeans(df, 2, start=[(0.0, 0.0, 0.0), (-500.0, 0.0, 0.0)])
    assert sorted(round(c[0]) for c in centres) == [1, 100]
    assert len(spatial.seeds(df.where("id = 30"), 3)) == 1
    assert spatial.build(df.limit(3), 4, 5).count() == 0 and spatial.build(df, None, 5).count() >= 1


def test_folds_by_parts_are_folds(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), i, float(a)) for k in range(6) for i, a in enumerate(rng.normal(0, 4, 200))]
    df = spark.createDataFrame(rows, "k long, i int, a double")
    for part in (None, F.floor(F.col("i") / 7), F.col("i")):
        got = {r["k"]: r["h"] for r in folds.clamped_fold(df, "k", ["i"], F.col("a"), 10.0, part).collect()}
        ema = {r["k"]: r["ema"] for r in folds.moving_average(df, "k", ["i"], F.col("a"), 0.1, part).collect()}
        for k in range(6):
            h = m = 0.0
            for key, _, a in rows:
                if key == k:
                    h, m = min(max(h + a, -10.0), 10.0), 0.9 * m + 0.1 * a
            assert got[k] == pytest.approx(h, abs=1e-6) and ema[k] == pytest.approx(m, abs=1e-6)


def test_saved_map_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, 0.5, 2, 0.75, 3), (0.0, -1.0, 0.5, 1, 0.5, 9)], "x double, y double, z double, class int, confidence double, observations long")
    frames.save_map(df, str(tmp_path / "m"))
    assert sorted(frames.load_map(spark, str(tmp_path / "m")).drop("odds").collect()) == sorted(df.collect())


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, 0.5, 1, 0.75), (0.0, 0.0, 0.5, 9, 0.5)], "x double, y double, z double, class int, confidence double")
    c = sinks.coloured(df, "class", [(0, 0, 0), (1, 2, 3)])
    assert sorted((r["r"], r["g"], r["b"]) for r in c.collect()) == [(1, 2, 3), (128, 128, 128)]
    assert sinks.coloured(df, "uncertainty").where("b >= 0").count() == 2
    for form in ("ply", "pcd"):
        assert sinks.write_cloud(c, str(tmp_path / form), form) == 2
        (file,) = glob.glob(str(tmp_path / form / "part-*"))
        lines = open(file).read().splitlines()
        assert lines[0] == {"ply": "ply", "pcd": "VERSION 0.7"}[form] and {"ply": "element vertex 2", "pcd": "POINTS 2"}[form] in lines and len(lines) == {"ply": 14, "pcd": 12}[form]
        assert sorted(sinks.read_cloud(spark, str(tmp_path / form)).collect()) == sorted(df.collect())
    sinks.write_npz(df, str(tmp_path / "map.npz"))
    assert np.load(tmp_path / "map.npz")["positions"].shape == (2, 3)
    counts = spark.createDataFrame([(0, 1, 5), (1, 1, 2)], "gt int, pred int, n long")
    sinks.write_matrix(metrics.csv_matrix(counts, 2), str(tmp_path / "csv"))
    assert open(glob.glob(str(tmp_path / "csv/*.csv"))[0]).read().split() == ["gt,0,1", "0,0,5", "1,0,2"]
    sinks.write_report(sinks.metadata(df), str(tmp_path / "json"))
    assert {r["share"] for r in spark.read.json(str(tmp_path / "json")).collect()} == {0.5}


def test_replay_window_and_topics(spark):
    df = spark.sql("SELECT timestamp_seconds(100 + id) AS ts, concat('t', id % 2) AS topic FROM range(10)")
    got = frames.replay(df, "ts", 2, 4, rate=2.0, rename={"t0": "a"}, topic="topic").orderBy("ts").collect()
    assert [(r["topic"], r["play_at"]) for r in got] == [("a", 0.0), ("t1", 0.5), ("a", 1.0)]


def test_kmeans_finds_centres_of_separate_groups(spark):
    rows = [(100 * j + i, 50.0 * j + i / 100, 0.0, 0.0, 0.1) for j in range(2) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, u double")
    clustered, centres = spatial.kmeans(df, 2)
    assert len(centres) == 2 and sum(r["count"] for r in clustered.groupBy("cluster").count().collect()) == 60
    for r in clustered.collect():  # each point has its nearest centre
        assert min(range(2), key=lambda j: (r["x"] - centres[j][0]) ** 2) == r["cluster"]


def test_update_renews_and_adds(spark):
    prior = spark.createDataFrame([(5, 0.0, 0.0, 0.0), (6, 30.0, 0.0, 0.0)], "id long, x double, y double, z double")
    rows = [(i, i / 100, 0.0, 0.0, 0.1) for i in range(10)] + [(100 + i, 30.0, 0.0, 0.0, 0.1) for i in range(3)] + [(200 + i, 60.0 + i / 100, 0.0, 0.0, 0.1) for i in range(8)]
    points = spark.createDataFrame(rows, "id long, x double, y double, z double, u double")
    got = primitives.update(prior, points, 1.0, 5, 1).collect()
    assert sorted((r["prim"], r["n"], r["kept"]) for r in got) == [(-1, 11, False), (5, 10, True)]  # prior 6 has too few points
