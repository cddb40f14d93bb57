"""Token counts of flat, unindexed token files.

A file is a run of fixed-width token ids; each document ends with one end-of-document id and nothing else says where
documents begin. Files are cut into blocks of equal size; each block is searched for separators at once in numpy, and
reports its length and where its separators are. A prefix scan over the
block reports (running sums in file order) then gives each block the number of the documents before it and where
its first document begins, so that documents which span blocks are counted once and whole.

Files may have any size: only their paths and lengths are listed, and tasks read the byte ranges of their own blocks.
Arrow reads them where it can open the store. Elsewhere Spark's fixed-length records of one token do, which is slower but
needs nothing that Spark lacks.

An empty file has no documents; two separators in a row enclose a document of 0 tokens; tokens after the last separator
are a document that lacks its end, and count as one. A file whose size isn't a multiple of the width raises an error.
write_flat() writes null and empty texts as documents of 0 tokens, and an empty table as no file. Keys may repeat or be null;
columns of docs may have any names. What a flat file holds says nothing of keys: the task that writes it leaves a list of them.
"""

from __future__ import annotations

import re
from itertools import groupby
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import Scratch, bounded_batches, ensure, ship, whole

BLOCK_TOKENS, FILE_DOCUMENTS = 1 << 18, 10_000

#: Bytes of files that a task reads, block by block.
TASK_BYTES = 1 << 26

LITTLE_ENDIAN = {2: "<u2", 4: "<u4"}


def separator(end: int, width: int) -> str:
    """The bytes of an id as characters of ISO-8859-1."""
    return int(end).to_bytes(width, "little").decode("latin-1")


def digits(end: int, width: int) -> str:
    """Sixteen characters of which no separator has any, for keys in hex."""
    return "".join(c for c in map(chr, range(48, 123)) if c.isalnum() and c not in separator(end, width))[:16]


def write_flat(
    spark: SparkSession, docs: DataFrame, path: str, ranks_path: str, pattern: str, end: int, text: str = "text", width: int = 2, key: str | None = None
) -> str:
    """Encode texts and write flat files: ids of `width` bytes (little-endian), each document followed by `end`. Returns their folder.

    Spark's text writer puts the bytes of a row down as they are, and the separator as it would a line's end, so files
    can go to any store that Spark writes to. An `end` that a text's tokens may hold, or that `width` bytes can't, is an error.

    With a key, the task that writes a flat file also writes the keys of its documents, in the same order and under the same
    task number, beside it (path/is_key=1; the flat files are in path/is_key=0): keys() reads them.
    """
    if end >= 1 << 8 * width or end in bpe.encoding(ranks_path, pattern)._mergeable_ranks.values():
        raise ValueError(f"{end} can't separate documents")
    ship(spark)
    bounded_batches(spark)

    @F.arrow_udf(T.BinaryType())
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array([np.array(bpe.encode_text(t or "", ranks_path, pattern), LITTLE_ENDIAN[width]).tobytes() for t in texts.to_pylist()], pa.binary())

    tokens = encode(whole(F.col(text))).cast("string")
    if key is None:
        rows = docs.select(tokens.alias("value")).write
    else:
        rows = docs.select(tokens.alias("tokens"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"), F.col(key).alias("key"))
        named = F.translate(F.hex(F.to_json(F.struct("place", "key"))), "0123456789ABCDEF", digits(end, width))
        both = F.array(F.struct(F.lit(0).alias("is_key"), F.col("tokens").alias("value")), F.struct(F.lit(1).alias("is_key"), named.alias("value")))
        rows = rows.select("place", F.inline(both)).sortWithinPartitions("is_key", "place").select("is_key", "value").write.partitionBy("is_key")
    rows.option("encoding", "ISO-8859-1").option("lineSep", separator(end, width)).option("compression", "none").option("maxRecordsPerFile", FILE_DOCUMENTS).text(path)
    if key is None:
        return path
    for kind in (0, 1):  # a table without rows writes neither
        ensure(spark, f"{path}/is_key={kind}")
    return f"{path}/is_key=0"


#: Numbers of the task and of the file among its files, by the names that Spark gives: the part between them is random, so the last number counts.
TASK_NUMBER, FILE_NUMBER = r"part-(\d+)-[^/]*$", r"(?s).*[-.]c(\d+)(?:\.[^/]*)?$"


def place_of(file: Column, document: Column) -> tuple[Column, Column]:
    """Number of the task that wrote a file, and a document's place among those that the task wrote."""
    number = lambda pattern: F.regexp_extract(file, pattern, 1).cast("long")
    return number(TASK_NUMBER), number(FILE_NUMBER) * FILE_DOCUMENTS + document


def keys(spark: SparkSession, path: str, end: int, kind: T.DataType, width: int = 2) -> DataFrame:
    """(part, place, key) of the documents that write_flat wrote with a key of that type: the writing task's number, and the document's place in it."""
    rows = spark.read.option("encoding", "ISO-8859-1").option("lineSep", separator(end, width)).text(f"{path}/is_key=1").where(F.col("value") != "")
    text = F.unhex(F.translate("value", digits(end, width), "0123456789ABCDEF")).cast("string")
    known = F.from_json(text, T.StructType([T.StructField("place", T.LongType()), T.StructField("key", kind)]))
    part, _ = place_of(F.col("_metadata.file_name"), F.lit(0))
    return rows.select(part.alias("part"), known.alias("known")).select("part", "known.place", "known.key")


def keyed(counted: DataFrame, known: DataFrame) -> DataFrame:
    """count_tokens() of files from write_flat with part, place and key, as keys() knows them. A document without a key, or the other way round, is an error."""
    part, place = place_of(F.col("file"), F.col("document"))
    both = counted.withColumn("part", part).withColumn("place", place).join(known.withColumn("known", F.lit(True)), ["part", "place"], "full")
    odd = F.col("known").isNull() | F.col("n_tokens").isNull()
    return both.withColumn("n_tokens", F.when(odd, F.raise_error(F.lit("files and documents don't match"))).otherwise(F.col("n_tokens"))).drop("known")


def locate(file: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and path of a file as Spark names it."""
    scheme, root, path = re.fullmatch(r"(?s)(\w[\w+.-]*):(//[^/]*)?(.*)", file).groups()
    return (fs.LocalFileSystem(), path) if scheme == "file" else fs.FileSystem.from_uri(f"{scheme}:{root or ''}{quote(path)}")


def opens(file: str, length: int) -> bool:
    """Whether Arrow finds the file."""
    try:
        store, path = locate(file)
        return store.get_file_info(path).size == length
    except (OSError, ValueError, NotImplementedError):
        return False


def read_ranges(size: int):
    """Rows of file, length and block to the blocks' contents."""

    def run(batches):
        for batch in batches:
            for file, rows in groupby(batch.to_pylist(), key=lambda r: r["file"]):
                store, path = locate(file)
                with store.open_input_file(path) as stream:
                    for row in rows:
                        start = row["block"] * size
                        content = stream.read_at(min(size, row["length"] - start), start)
                        if len(content) != min(size, row["length"] - start):
                            raise OSError(f"{file}: shorter than listed")
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([row["block"]], pa.int32()), pa.array([content], pa.binary())], ["file", "block", "content"])

    return run


def read_records(spark: SparkSession, files: list[str], width: int, block_tokens: int) -> DataFrame:
    """Blocks by Spark's reader of fixed-length records, in any store that Spark reads. Splits begin with blocks."""
    reader, span = "org.apache.spark.input.FixedLengthBinaryInputFormat", str(max(1, TASK_BYTES // (block_tokens * width)) * block_tokens * width)
    conf = {f"{reader}.recordLength": str(width)} | {f"mapreduce.input.fileinputformat.split.{k}size": span for k in ("min", "max")}

    def cut(file: str):
        def run(rows):
            for block, own in groupby(rows, key=lambda r: r[0] // block_tokens):
                yield file, block, b"".join(token for _, token in own)

        return run

    read = lambda file: spark.sparkContext.newAPIHadoopFile(file, reader, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)
    return spark.createDataFrame(spark.sparkContext.union([read(file).mapPartitions(cut(file)) for file in files]), "file string, block int, content binary")


def blocks(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, content): the files under a path, cut into blocks. Lists the files at once, reads them later."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    size = block_tokens * width
    wrong = F.raise_error(F.format_string("%s: %d bytes are no whole number of tokens", "file", "length")).cast("int")
    files = files.withColumn("n", F.when(F.col("length") % width == 0, F.ceil(F.col("length") / size).cast("int")).otherwise(wrong))
    first = files.agg(F.min(F.struct("file", "length")).alias("file"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.max("n")).first()
    if first["file"] and not opens(*first["file"]):
        return read_records(spark, [r["file"] for r in files.select("file").collect()], width, block_tokens)
    tasks = max(spark.sparkContext.defaultParallelism, -(-first["bytes"] // TASK_BYTES))
    cut = files.select("file", "length", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"))
    return cut.repartition(tasks, "file", "block").mapInArrow(read_ranges(size), "file string, block int, content binary")


def search(end: int, width: int):
    """Block contents to reports: tokens, and the places of separators."""

    def run(batches):
        for batch in batches:
            tokens, ends = [], []
            for content in batch["content"]:
                ids = np.frombuffer(content.as_buffer(), LITTLE_ENDIAN[width])
                tokens.append(len(ids))
                ends.append(np.flatnonzero(ids == end))
            yield pa.RecordBatch.from_arrays([batch["file"], batch["block"], pa.array(tokens, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["file", "block", "tokens", "ends"])

    return run


#: Blocks that one task of the prefix scan takes.
RANGE = 1024


def scan(reports: DataFrame) -> DataFrame:
    """(file, block, at, done, begun, final) of (file, block, tokens, seps, last): tokens and separators before a block, where its first document begins, whether it is the file's last.

    Two levels: blocks are scanned within ranges of RANGE of them, then one row per range is scanned within the file.
    """
    inside = Window.partitionBy("file", "range").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = reports.withColumn("range", F.floor(F.col("block") / RANGE))
    own = own.withColumn("at", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).withColumn("done", F.coalesce(F.sum("seps").over(inside), F.lit(0)))
    own = own.withColumn("opens", F.col("at") + F.col("last") + 1).withColumn("begun", F.max("opens").over(inside))
    sums = own.groupBy("file", "range").agg(F.sum("tokens").alias("tokens"), F.sum("seps").alias("seps"), F.max("opens").alias("opens"), F.max("block").alias("end"))
    before = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("at0", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("done0", F.coalesce(F.sum("seps").over(before), F.lit(0)))
    begun0 = F.coalesce(F.max(F.col("at0") + F.col("opens")).over(before), F.lit(0))
    sums = sums.select("file", "range", "at0", "done0", begun0.alias("begun0"), F.max("end").over(Window.partitionBy("file")).alias("end"))
    at, done, begun = F.col("at0") + F.col("at"), F.col("done0") + F.col("done"), F.coalesce(F.col("at0") + F.col("begun"), F.col("begun0"))
    return own.join(sums, ["file", "range"]).select("file", "block", at.alias("at"), done.alias("done"), begun.alias("begun"), (F.col("block") == F.col("end")).alias("final"))


def count_tokens(spark: SparkSession, cut: DataFrame, end: int, width: int = 2) -> DataFrame:
    """One row per document of the blocks: file, document (from 0), start (token), n_tokens.

    The prefix scan runs over one short row per block; documents stay with the reports of their blocks.
    """
    ship(spark)
    bounded_batches(spark)
    reports = Scratch(spark, "token_scan").save(cut.mapInArrow(search(end, width), "file string, block int, tokens long, ends array<long>"))
    brief = reports.select("file", "block", "tokens", F.size("ends").cast("long").alias("seps"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    placed = reports.join(scan(brief), ["file", "block"])
    stops = F.transform("ends", lambda e: F.col("at") + e)
    over = F.col("at") + F.col("tokens")
    opened = F.coalesce(F.col("at") + F.try_element_at("ends", F.lit(-1)) + 1, F.col("begun"))  # where the block's last document begins
    stops = F.when(F.col("final") & (opened < over), F.concat(stops, F.array(over))).otherwise(stops)
    rows = placed.select("file", "done", "begun", stops.alias("stops")).select("file", "done", "begun", "stops", F.posexplode("stops").alias("k", "stop"))
    start = F.when(F.col("k") > 0, F.get("stops", F.col("k") - 1) + 1).otherwise(F.col("begun"))
    rows = rows.select("file", (F.col("done") + F.col("k")).alias("document"), start.alias("start"), "stop")
    return rows.select("file", "document", "start", (F.col("stop") - F.col("start")).alias("n_tokens"))
