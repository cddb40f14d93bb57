"""Python data sources: image datasets by file stem, files out of rows, and arrays in parts with a manifest.

    spark.dataSource.register(parts.Frames)
    spark.read.format("frames").option("path", root).load()

register() makes all of them known. Tasks reach the files by Arrow's file systems.
"""

from __future__ import annotations

import io
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Extensions that are looked for in each folder, the first one first.
EXTENSIONS = {"rgb": ("png", "jpg", "jpeg", "npy"), "depth": ("png", "npy"), "label": ("png", "npy", "mat"), "probability": ("npy",)}

#: Bytes of files in one batch, and rows of one array file.
BATCH_BYTES, PART_ROWS = 1 << 24, 1 << 20


def store(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and path."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    if "://" in path:
        scheme, _, rest = path.partition("://")
        return fs.FileSystem.from_uri(f"{scheme}://{quote(rest)}")
    return fs.LocalFileSystem(), path


@dataclass
class Stems(InputPartition):
    """Files of some stems: (stem, path or None for each column)."""

    rows: list


class FramesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.folders = dict(x.split("=") for x in options["folders"].split(",")) if "folders" in options else {"rgb": "rgb", "depth": "depth", "label": "label40"}
        self.columns = [c for c in options.get("columns", ",".join(self.folders)).split(",") if c]
        self.required = [c for c in options.get("required", "rgb,depth").split(",") if c]
        self.files = int(options.get("filesPerTask", 64))

    def listed(self, column: str) -> dict[str, str]:
        """The file of each stem: of several, that with the first extension."""
        where, path = store(f"{self.root}/{self.folders[column]}")
        found: dict[str, tuple[int, str]] = {}
        for info in where.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            stem, _, ext = info.base_name.rpartition(".")
            if info.type == fs.FileType.File and ext in EXTENSIONS[column]:
                found[stem] = min(found.get(stem, (99, "")), (EXTENSIONS[column].index(ext), info.path))
        return {stem: path for stem, (_, path) in found.items()}

    def partitions(self) -> list[InputPartition]:
        have = {c: self.listed(c) for c in {*self.columns, *self.required}}
        stems = sorted(set.intersection(*(set(have[c]) for c in self.required)) if self.required else set().union(*have.values()))
        rows = [(stem, [have[c].get(stem) for c in self.columns]) for stem in stems]
        return [Stems(rows[k : k + self.files]) for k in range(0, len(rows), self.files)] or [Stems([])]

    def read(self, partition: Stems) -> Iterator[pa.RecordBatch]:
        where, _ = store(self.root)
        schema = pa.schema([("stem", pa.string()), *((c, pa.binary()) for c in self.columns)])
        held, size = [], 0
        for stem, paths in partition.rows:
            held.append((stem, *(None if p is None else where.open_input_file(p).readall() for p in paths)))
            size += sum(len(x) for x in held[-1][1:] if x is not None)
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class Frames(DataSource):
    """Frames of an image dataset: (stem, then a binary column for each kind of file).

    Options: path; folders, as rgb=rgb,depth=depth,label=label40; columns, those that are wanted (only their files are read); required, those without
    which a stem is left out (others may be null); filesPerTask, stems of a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "stem string, " + ", ".join(f"{c} binary" for c in FramesReader(self.options).columns)

    def reader(self, schema) -> DataSourceReader:
        return FramesReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    files: list = field(default_factory=list)


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, path = store(self.path)
        out = Written()
        for batch in iterator:
            for name, content in zip(batch["name"].to_pylist(), batch["content"].to_pylist(), strict=True):
                to = f"{path}/{name}"
                where.create_dir(posixpath.dirname(to), recursive=True)
                with where.open_output_stream(to) as f:
                    f.write(content or b"")
                out.files.append(name)
        return out


class Files(DataSource):
    """A file for each row (name, content) under path. A task that runs again writes the same files."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FilesWriter(self.options)


class ArraysWriter(DataSourceArrowWriter):
    """Part files under names of their own; the manifest, written once all tasks are done, says which count."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, path = store(self.path)
        where.create_dir(path, recursive=True)
        out, held, rows = Written(), [], 0

        def put() -> None:
            t = pa.Table.from_batches(held)
            name, data = f"part-{uuid.uuid4().hex}.npz", io.BytesIO()
            arrays = {c: t[c].to_numpy() for c in t.column_names if c not in "xyz"}
            if {"x", "y", "z"} <= set(t.column_names):
                arrays["positions"] = np.stack([t[k].to_numpy() for k in "xyz"], 1)
            np.savez_compressed(data, **arrays)
            with where.open_output_stream(f"{path}/{name}") as f:
                f.write(data.getvalue())
            out.files.append([name, t.num_rows])

        for batch in iterator:
            while batch.num_rows:
                piece = batch.slice(0, PART_ROWS - rows)
                held, rows, batch = [*held, piece], rows + piece.num_rows, batch.slice(piece.num_rows)
                if rows == PART_ROWS:
                    put()
                    held, rows = [], 0
        if rows:
            put()
        return out

    def commit(self, messages: list) -> None:
        where, path = store(self.path)
        where.create_dir(path, recursive=True)
        with where.open_output_stream(f"{path}/manifest.json") as f:
            f.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())

    def abort(self, messages: list) -> None:
        where, path = store(self.path)
        for name in (x[0] for m in messages if m is not None for x in m.files):
            where.delete_file(f"{path}/{name}")


class Arrays(DataSource):
    """Columns as numpy archives of up to PART_ROWS rows each, and manifest.json with their names and rows; x, y and z become one array, positions. No copy on the driver."""

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        raise NotImplementedError("use read_arrays()")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArraysWriter(self.options)


def register(spark: SparkSession) -> None:
    for source in (Frames, Files, Arrays):
        spark.dataSource.register(source)


def write_arrays(df: DataFrame, path: str) -> None:
    """df in parts under path, a folder that isn't there yet."""
    register(df.sparkSession)
    df.write.format("arrays").mode("append").option("path", path).save()


def read_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_arrays() wrote, or others in its form; x, y and z come out of positions. Only files that the manifest names are read."""
    where, at = store(path)
    with where.open_input_file(f"{at}/manifest.json") as f:
        names = [n for n, _ in json.loads(f.readall())]
    wanted = [x.split()[0] for x in schema.split(",")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, at = store(path)
        for b in batches:
            for name in b["name"].to_pylist():
                with where.open_input_file(f"{at}/{name}") as f, np.load(io.BytesIO(f.readall()), allow_pickle=False) as a:
                    yield pa.RecordBatch.from_arrays([pa.array(a["positions"][:, "xyz".index(c)] if c in "xyz" else a[c]) for c in wanted], wanted)

    files = spark.createDataFrame([(n,) for n in names], "name string")
    return files.repartition(max(1, len(names))).mapInArrow(read, schema)


def array_file(values: Column, shape: tuple[int, ...], kind: str) -> Column:
    """The content of a .npy file from an array of numbers; kind as numpy names it, e.g. u2."""

    @F.arrow_udf(T.BinaryType())
    def encode(batch: pa.Array) -> pa.Array:
        out = []
        for v in batch.to_pylist():
            data = io.BytesIO()
            np.save(data, np.asarray(v, float).reshape(shape).astype(kind))
            out.append(data.getvalue())
        return pa.array(out, pa.binary())

    return encode(values)


#: A point of a packed map, fixed by the format: little-endian, without gaps.
PACKED = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("class", "<i4"), ("confidence", "<f4"), ("r", "u1"), ("g", "u1"), ("b", "u1")])


def write_packed(cells: DataFrame, path: str) -> None:
    """x, y, z, class, confidence, r, g and b as files of packed points, one or more for each task. Their metadata are sinks.metadata()."""
    register(cells.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = np.empty(b.num_rows, PACKED)
            for n in PACKED.names:
                a[n] = b[n].to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4().hex}.bin"]), pa.array([a.tobytes()], pa.binary())], ["name", "content"])

    filled = cells.select(*(F.coalesce(F.col(n), F.lit(0)).alias(n) for n in PACKED.names))
    write_files(filled.mapInArrow(pack, "name string, content binary"), path)


def read_packed(spark: SparkSession, path: str, chunk: int = 1 << 16) -> DataFrame:
    """The points of packed files of any size: tasks read a file by runs of `chunk` points. A length that is no whole number of points is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select("path", "length").where("length > 0")
    wrong = F.raise_error(F.format_string("%s: %d bytes are no whole number of points", "path", "length")).cast("long")
    points = F.when(F.col("length") % PACKED.itemsize == 0, F.floor(F.col("length") / PACKED.itemsize)).otherwise(wrong)
    runs = files.select("path", points.alias("points")).select("path", "points", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("points") - 1) / chunk))).alias("run"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, n, run in zip(*(b[c].to_pylist() for c in ("path", "points", "run")), strict=True):
                where, at = store(name)
                with where.open_input_file(at) as f:
                    a = np.frombuffer(f.read_at(min(chunk, n - run * chunk) * PACKED.itemsize, run * chunk * PACKED.itemsize), PACKED)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a[c]).astype(np.int32 if c in ("class", *"rgb") else np.float64)) for c in PACKED.names], list(PACKED.names))

    schema = "x double, y double, z double, class int, confidence double, r int, g int, b int"
    return runs.repartition("path", "run").mapInArrow(read, schema)


def read_map_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Maps saved as .npy arrays of x, y, z, class and, if there is a fifth column, confidence (else 1): a row for each of theirs. A file is read by one task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b["content"]:
                a = np.load(io.BytesIO(content.as_buffer()), allow_pickle=False).astype(float)
                sure = a[:, 4] if a.shape[1] > 4 else np.ones(len(a))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a[:, 0], a[:, 1], a[:, 2], a[:, 3].astype(np.int32), sure)], ["x", "y", "z", "class", "confidence"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("content")
    return files.mapInArrow(rows, "x double, y double, z double, class int, confidence double")


def write_files(rows: DataFrame, path: str) -> None:
    """rows (name, content) as files under path."""
    register(rows.sparkSession)
    rows.select("name", "content").write.format("files").mode("append").option("path", path).save()
