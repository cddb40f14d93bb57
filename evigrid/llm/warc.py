"""WARC archives without repeated payloads.

write() makes one record per row. Headers alone are shuffled by the payload's digest: of equal payloads of `least` bytes and more the
row with the smallest key becomes a response, the others revisit records that name it. Payloads are shuffled once each, compressed
and without copies, to the response that holds them. Every record gets a fresh header and is a gzip member of its own; archives go
out by Spark's text writer, which puts bytes down as they are, with an empty gzip member for a line's end.

read() gives the records of archives, compressed or not, from here or elsewhere: a task reads a file as a stream, so it holds one
record at a time, however long the file is. (gzip can't be split; write() ends a file after FILE_RECORDS.) Where Arrow can't
open the store, Spark hands a task the whole file. resolve() joins revisit records to the responses that they name, or whose digest they have.

Null payloads count as empty; payloads may hold anything, blank lines and WARC headers too. Null keys come last, ties and repeated rows
are told apart: one of them is the response. Line ends within a URI are written as %0D and %0A; a null URI has no header. An empty table
gives no file, and no records. Columns beside those named aren't read, so they may have any names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LEAST, Scratch, bounded_batches, ensure, free_name, ship, spread_join
from .token_scan import locate, opens

FILE_RECORDS = 20_000

#: Stands between records: a gzip member without content.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)

#: Fixed by the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = "file string, place long, type string, record_id string, refers_to string, uri string, date string, digest string, key string, payload_bytes long, payload_digest string, payload binary"

#: Bytes read at once.
BUFFER = 1 << 20


def base32(digest: Column) -> Column:
    """Base32 of a SHA-1 in hex: four groups of 40 bits."""
    chars = []
    for g in range(4):
        value = F.conv(F.substring(digest, 10 * g + 1, 10), 16, 10).cast("long")
        chars += [F.substring(F.lit(BASE32), (F.shiftright(value, s).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for s in range(35, -1, -5)]
    return F.concat(*chars)


def _urn(run: str, row: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{run}:"), row.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def decide(spark: SparkSession, docs: DataFrame, key: str, payload: str, uri: str, least: int) -> DataFrame:
    """(row, key, uri, sha, sha1, bytes, first): a header for each row; first is the response that it repeats (row, key, uri), null if it is a response."""
    content = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(uri).alias("uri"),
        F.sha2(content, 256).alias("sha"), F.sha1(content).alias("sha1"), F.octet_length(content).cast("long").alias("bytes"),
    )
    rows = Scratch(spark, "warc").save(rows)
    order = F.struct(F.col("key").isNull(), F.col("key"), F.col("row"))
    groups = rows.where(F.col("bytes") >= least).groupBy("sha").agg(F.min_by(F.struct("row", "key", "uri"), order).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = Scratch(spark, "warc").save(groups)
    out = spread_join(rows, groups.drop("size"), ["sha"], groups.select("sha", "size"), "row", "left")
    return out.withColumn("first", F.when(F.col("first.row") != F.col("row"), F.col("first")))


def members() -> Column:
    @F.arrow_udf(T.BinaryType())
    def member(head: pa.Array, packed: pa.Array) -> pa.Array:
        out = []
        for h, p in zip(head.to_pylist(), packed.to_pylist(), strict=True):
            out.append(gzip.compress(h.encode() + (zlib.decompress(p) if p is not None else b"") + b"\r\n\r\n", 6, mtime=0))
        return pa.array(out, pa.binary())

    return member


def pack() -> Column:
    @F.arrow_udf(T.BinaryType())
    def packed(content: pa.Array) -> pa.Array:
        return pa.array([zlib.compress(c, 1) for c in content.to_pylist()], pa.binary())

    return packed


def write(spark: SparkSession, docs: DataFrame, path: str, key: str, payload: str, uri: str, least: int = 0, date: str | None = None) -> None:
    """Archives of docs under path: a record per row, a response for each different payload, and each row's key as JSON in a header of its own."""
    ship(spark)
    bounded_batches(spark)
    run, date = uuid.uuid4().hex, date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    headers = Scratch(spark, "warc").save(decide(spark, docs, key, payload, uri, least))
    responses = headers.where(F.col("first").isNull())
    content = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    stored = docs.select(F.sha2(content, 256).alias("sha"), pack()(content).alias("packed")).groupBy("sha").agg(F.first("packed").alias("packed"))
    sizes = responses.groupBy("sha").agg(F.count(F.lit(1)).alias("size"))
    # Unless many rows below `least` share a payload, the payloads stay where they were put together.
    few = (sizes.agg(F.max("size")).first()[0] or 0) <= LEAST
    full = responses.join(stored.hint("merge"), "sha") if few else spread_join(responses, stored, ["sha"], sizes, "row")
    records = full.unionByName(headers.where(F.col("first").isNotNull()).withColumn("packed", F.lit(None).cast("binary")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    maybe = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    clean = lambda value: F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    again = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", _urn(run, F.col("row"))),
        line("WARC-Date", F.lit(date)),
        maybe("WARC-Target-URI", clean(F.col("uri"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _urn(run, F.col("first.row"))), maybe("WARC-Refers-To-Target-URI", clean(F.col("first.uri"))), line("WARC-Refers-To-Date", F.lit(date)))).otherwise(""),
        line("Record-Key", F.to_json(F.struct("key"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", (F.octet_length(http) + F.when(again, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit("\r\n"),
        http,
    )
    out = records.select(members()(head, F.col("packed")).cast("string").alias("value"))
    out.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("compression", "none").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    ensure(spark, path)


def unpacked(chunks):
    """The bytes of a stream that may be a run of gzip members."""
    chunks = iter(chunks)
    head = b""
    for chunk in chunks:
        head += chunk
        if len(head) > 1:
            break
    if head[:2] != b"\x1f\x8b":
        yield head
        yield from chunks
        return
    own = zlib.decompressobj(31)
    rest = head
    while True:
        while rest:
            yield own.decompress(rest, BUFFER)
            rest = own.unconsumed_tail or own.unused_data
            if own.eof:
                own = zlib.decompressobj(31)
        rest = next(chunks, b"")
        if not rest:
            return


class Stream:
    """Takes bytes from chunks, by number or up to a mark."""

    def __init__(self, chunks):
        self.chunks, self.held, self.at = iter(chunks), bytearray(), 0

    def more(self) -> bool:
        if self.at > BUFFER:
            del self.held[: self.at]
            self.at = 0
        for chunk in self.chunks:
            if chunk:
                self.held += chunk
                return True
        return False

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            if not self.more():
                raise ValueError("an archive ends within a record")
        self.at += n
        return bytes(self.held[self.at - n : self.at])

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (k := self.held.find(mark, self.at + max(0, seen - len(mark)))) < 0:
            seen = len(self.held) - self.at
            if not self.more():
                raise ValueError("an archive ends within a header")
        return self.take(k + len(mark) - self.at)

    def ended(self) -> bool:
        """Whether nothing but line ends is left; these are passed over."""
        while True:
            while self.held[self.at : self.at + 1] in (b"\r", b"\n"):
                self.at += 1
            if self.at < len(self.held):
                return False
            if not self.more():
                return True


def records(chunks):
    """(headers by lower-case name, payload) of each record of an archive."""
    stream = Stream(unpacked(chunks))
    while not stream.ended():
        head = stream.until(b"\r\n\r\n").decode("utf-8", "replace")
        version, *lines = re.sub(r"\r\n[ \t]+", " ", head).split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record begins with {version[:40]!r}")
        headers = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines if x)}
        block = stream.take(int(headers["content-length"]))
        if headers.get("content-type", "").startswith("application/http"):
            block = block.partition(b"\r\n\r\n")[2]
        yield headers, block


def rows_of(file: str, chunks, payloads: bool):
    """Arrow batches of RECORD."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    schema = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in RECORD.split(", ")])
    held, size = [], 0
    for place, (headers, payload) in enumerate(records(chunks)):
        get = headers.get
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        held.append((file, place, get("warc-type"), get("warc-record-id"), get("warc-refers-to"), get("warc-target-uri"), get("warc-date"), get("warc-payload-digest", "").removeprefix("sha1:") or None, get("record-key"), len(payload), digest, payload if payloads else None))
        size += len(payload) if payloads else 0
        if len(held) == 256 or size > BUFFER * 4:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*held, strict=True), strict=True)), schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*held, strict=True), strict=True)), schema)


def _chunks(file: str):
    store, path = locate(file)
    with store.open_input_stream(path, compression=None) as stream:
        while chunk := stream.read(BUFFER):
            yield chunk


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives under a path (RECORD), with or without their payloads. payload_bytes and payload_digest are measured, digest is what the header says."""
    ship(spark)
    bounded_batches(spark)
    every = spark.read.format("binaryFile").load(path)
    files = every.select(F.col("path").alias("file"), "length").where("length > 0")
    first = files.agg(F.min(F.struct("file", "length")).alias("file"), F.count(F.lit(1)).alias("n")).first()

    def by_name(batches):
        for batch in batches:
            for file in batch["file"].to_pylist():
                yield from rows_of(file, _chunks(file), payloads)

    def by_content(batches):
        for batch in batches:
            for file, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                yield from rows_of(file, [content.as_py()], payloads)

    if first["file"] and not opens(*first["file"]):
        return every.where("length > 0").select("path", "content").mapInArrow(by_content, RECORD)
    return files.repartition(max(1, min(first["n"], 100_000)), "file").mapInArrow(by_name, RECORD)


def resolve(spark: SparkSession, found: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of read() with original (the key of the response that a revisit stands for), and that response's measured payload; null where it isn't among them.

    A revisit belongs to the response that it names, or else to one with its digest. One whose digest isn't its response's is an error.
    """
    original = free_name(found, "original")
    answers = found.where(F.col("type") == "response")
    handles = F.explode(F.array(F.struct(F.lit("id").alias("by"), F.col("record_id").alias("handle")), F.struct(F.lit("digest").alias("by"), F.col("payload_digest").alias("handle")))).alias("h")
    held = ["key", "payload_bytes", "payload_digest", *(["payload"] if payloads else [])]
    answers = answers.select(handles, F.struct("record_id").alias("at"), F.struct(*held).alias("answer"))
    answers = answers.groupBy(F.col("h.by").alias("by"), F.col("h.handle").alias("handle")).agg(F.min_by("answer", "at").alias("answer"))
    by = F.when(F.col("refers_to").isNotNull(), "id").otherwise("digest")
    again = found.where(F.col("type") == "revisit").withColumn("by", by).withColumn("handle", F.coalesce("refers_to", "digest"))
    sizes = again.groupBy("by", "handle").agg(F.count(F.lit(1)).alias("size"))
    again = spread_join(again, answers, ["by", "handle"], sizes, "record_id", "left")
    wrong = F.col("digest") != F.col("answer.payload_digest")
    digest = F.when(wrong, F.raise_error(F.concat(F.col("record_id"), F.lit(" has another payload than its response")))).otherwise(F.col("answer.payload_digest"))
    measured = {"payload_bytes": F.col("answer.payload_bytes"), "payload_digest": digest} | ({"payload": F.col("answer.payload")} if payloads else {})
    again = again.withColumn(original, F.col("answer.key")).withColumns(measured).select(*found.columns, original)
    return found.where(~F.col("type").eqNullSafe("revisit")).withColumn(original, F.lit(None).cast("string")).unionByName(again)
