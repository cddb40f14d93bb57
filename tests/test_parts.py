"""Datasets by stem, files of rows, arrays in parts."""

import io
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigrid.sources import images, parts


def npy(a):
    out = io.BytesIO()
    np.save(out, a)
    return out.getvalue()


def fill(root):
    for folder in ("rgb", "depth", "label40"):
        (root / folder).mkdir()
    for i in range(10):
        (root / "rgb" / f"f{i}.jpg").write_bytes(b"jpg")
        if i % 3:
            (root / "depth" / f"f{i}.npy").write_bytes(npy(np.full((2, 3), 1000 + i, np.uint16)))
        if i % 2:
            (root / "label40" / f"f{i}.npy").write_bytes(npy(np.full((2, 3), i, np.uint8)))
    (root / "rgb" / "f1.png").write_bytes(b"png")  # comes before jpg
    (root / "rgb" / "f2.txt").write_bytes(b"no image")
    (root / "depth" / "alone.npy").write_bytes(b"x")


def test_frames_by_stem(spark, tmp_path):
    fill(tmp_path)
    parts.register(spark)
    load = lambda **o: spark.read.format("frames").options(path=str(tmp_path), filesPerTask=2, **o).load()
    got = {r["stem"]: r for r in load().collect()}
    assert sorted(got) == [f"f{i}" for i in (1, 2, 4, 5, 7, 8)]
    assert got["f1"]["rgb"] == b"png" and got["f2"]["rgb"] == b"jpg" and got["f2"]["label"] is None and got["f5"]["label"] is not None
    assert load().rdd.getNumPartitions() == 3
    some = load(columns="depth", required="depth,label")
    assert some.columns == ["stem", "depth"] and sorted(r["stem"] for r in some.collect()) == ["f1", "f5", "f7"]
    depth = images.depth_points(load(), "nyuv2")
    assert {r["stem"]: r["d"] for r in depth.groupBy("stem").agg(F.max("depth").alias("d")).collect()} == {f"f{i}": (1000 + i) / 1000 for i in (1, 2, 4, 5, 7, 8)}
    (tmp_path / "none").mkdir()
    assert spark.read.format("frames").option("path", str(tmp_path / "none")).load().count() == 0


def test_files_of_rows(spark, tmp_path):
    parts.register(spark)
    rows = [(f"a/{i}.bin", bytes([i] * i)) for i in range(20)] + [("empty", None)]
    spark.createDataFrame(rows, "name string, content binary").repartition(4).write.format("files").mode("append").option("path", str(tmp_path)).save()
    assert {n: (tmp_path / n).read_bytes() for n, _ in rows} == {n: c or b"" for n, c in rows}


@pytest.mark.parametrize("rows", [0, 5000])
def test_arrays_in_parts(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(parts, "PART_ROWS", 700)
    df = spark.range(rows).repartition(3).select(*((F.col("id") * k).cast("double").alias(c) for k, c in enumerate("xyz", 1)), (F.col("id") % 5).cast("int").alias("labels"), (F.col("id") / 7).alias("confidences"))
    path = str(tmp_path / "map")
    parts.write_arrays(df, path)
    back = parts.read_arrays(spark, path, "x double, y double, z double, labels int, confidences double")
    assert back.count() == rows and back.exceptAll(df).isEmpty()
    listed = json.load(open(f"{path}/manifest.json"))
    assert sum(n for _, n in listed) == rows and sorted(n for n, _ in listed) == sorted(f for f in os.listdir(path) if f.startswith("part-"))
    (tmp_path / "map" / "part-of-a-failed-task.npz").write_bytes(b"half")
    assert parts.read_arrays(spark, path, "labels int").count() == rows


def test_a_task_that_fails_leaves_nothing_that_counts(tmp_path, monkeypatch):
    """The task writes a part, dies, and runs again; another writes one; only what was committed is in the manifest."""
    import pyarrow as pa

    monkeypatch.setattr(parts, "PART_ROWS", 10)
    writer = parts.ArraysWriter({"path": str(tmp_path)})
    batch = lambda a, b: pa.RecordBatch.from_pydict({"labels": list(range(a, b))})

    def dies():
        yield batch(0, 15)
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(dies())
    done = [writer.write(iter([batch(0, 15), batch(15, 25)])), writer.write(iter([batch(25, 30)]))]
    writer.commit(done)
    listed = json.load(open(tmp_path / "manifest.json"))
    got = [int(x) for n, _ in listed for x in np.load(tmp_path / n)["labels"]]
    assert sorted(got) == list(range(30)) and len([f for f in os.listdir(tmp_path) if f.startswith("part-")]) == len(listed) + 1
    writer.abort(done)
    assert len([f for f in os.listdir(tmp_path) if f.startswith("part-")]) == 1


def test_packed_points_of_a_broken_file(spark, tmp_path):
    assert parts.PACKED.itemsize == 23
    (tmp_path / "a.bin").write_bytes(b"x" * 24)
    with pytest.raises(Exception, match="no whole number of points"):
        parts.read_packed(spark, str(tmp_path)).collect()
