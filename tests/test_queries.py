import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

from evigrid import registry
from evigrid.functions import scalar as S
from evigrid.operators import folds, maps, metrics, spatial
from evigrid.sources.tables import read_map, write_map

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert not differences(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], connect(SF))


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_kernel_values(spark):
    k = lambda d: S.sparse_kernel(F.lit(d), F.lit(1.0))
    got = one(spark, k(0.0), k(0.25), k(0.5), k(1.0))
    assert got[0] == 1 and got[3] == 0
    assert got[1] == pytest.approx(0.659155, abs=1e-6) and got[2] == pytest.approx(1 / 6)


def test_fusion_of_two_beliefs(spark):
    a, b = (F.array(*map(F.lit, x)) for x in ([0.8, 0.1, 0.1], [0.7, 0.2, 0.1]))
    m, k = S.fuse_masses(a, F.lit(0.2), b, F.lit(0.3))
    masses, conflict = one(spark, m, k)
    assert masses == pytest.approx([0.849662, 0.088964, 0.061374], abs=1e-6) and conflict == pytest.approx(0.2296)


def test_vacuity_and_entropy(spark):
    e = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert one(spark, S.vacuity(e(9, 9, 9, 9, 9)), S.entropy(e(0.5, 0.5)), S.entropy(e(1, 0))) == pytest.approx((0.1, 1.0, 0.0))


def test_iou_of_five_labels(spark):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1, 2, 0], [0, 1, 1, 1, 2, 255])), "pred int, gt int")
    assert {r["class"]: r["iou"] for r in metrics.class_iou(df).collect()} == {0: 0.5, 1: pytest.approx(2 / 3, abs=1e-6), 2: 1.0}


def test_transitions_of_alternating_classes(spark):
    df = spark.createDataFrame([("a", t, t % 2) for t in range(4)] + [("b", t, 1) for t in range(10)], "cell string, t int, class int").withColumn("ts", F.timestamp_seconds("t"))
    status = folds.dynamic_status(df, "cell", "class", "ts", [], 10.0)
    assert {r["cell"]: (r["dynamic"], r["transitions"]) for r in status.collect()} == {"a": (True, 3), "b": (False, 0)}
    decayed = lambda now: folds.decay_transitions(status, F.lit(now), 10.0, 1.0).where("cell = 'a'").first()
    assert decayed(13.0)["transitions"] == 3 and decayed(15.0)["transitions"] == 2 and decayed(15.0)["dynamic"]
    assert decayed(16.0)["transitions"] == 1 and not decayed(16.0)["dynamic"] and decayed(100.0)["transitions"] == 0


def test_three_separate_groups_make_three_clusters(spark):
    rows = [(30 * j + i, c[0] + i / 100, c[1], 0.0, 0.1) for j, c in enumerate([(0.0, 0.0), (50.0, 0.0), (0.0, 50.0)]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, x double, y double, z double, u double")
    assigned = spatial.assign(df, [(0.0, 0.0, 0.0), (50.0, 0.0, 0.0), (0.0, 50.0, 0.0)])
    summary = spatial.primitives(assigned, "cluster").collect()
    assert sorted(r["n"] for r in summary) == [30, 30, 30] and all(r["cxx"] > 0 for r in summary)


def test_merge_modes(spark):
    schema = "ix int, iy int, iz int, class int, confidence double"
    a, b = spark.createDataFrame([(0, 0, 0, 1, 0.9), (1, 0, 0, 1, 0.5)], schema), spark.createDataFrame([(0, 0, 0, 2, 0.5), (2, 0, 0, 2, 0.4)], schema)
    at = lambda mode: {r["ix"]: (r["class"], r["confidence"]) for r in maps.merge(a, b, mode).collect()}
    assert at("confidence") == {0: (1, 0.9), 1: (1, 0.5), 2: (2, 0.4)}
    assert at("overwrite")[0] == (2, 0.5) and at("average")[0] == (1, 0.7)


def test_map_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, 3.5, 2, 0.75)], "x double, y double, z double, class int, confidence double")
    write_map(df, str(tmp_path / "map"))
    assert read_map(spark, str(tmp_path / "map")).collect() == df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
