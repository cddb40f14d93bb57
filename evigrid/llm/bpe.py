"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts go to Python workers in short Arrow batches. A long text is cut where the split pattern must end a match anyway
(after a visible character, before white space), so that each piece gives the ids it has within the whole. Decoding
joins raw bytes, so that ids that cut a character in two survive.

Null texts count as empty and give no ids. Special tokens are never produced: their strings are ordinary text. Rows are
independent of each other; ties, repeated rows, an empty table and extra columns need no care.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, free_name, ship, whole

#: Characters encoded at once, about.
PIECE = 1 << 16

#: A cut that no match of the split pattern spans: none has white space after another character.
SAFE = regex.compile(r"(?<=[!-~\p{L}\p{N}])(?=[ \n\t\r])")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """The tokenizer of a rank file (base64 token and rank on each line); once per Python process."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE):
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode_text(text: str, ranks_path: str, pattern: str) -> list[int]:
    own = encoding(ranks_path, pattern)
    if len(text) <= PIECE:
        return own.encode_ordinary(text)
    return [i for piece in pieces(text) for i in own.encode_ordinary(piece)]


def encode_column(text: Column, ranks_path: str, pattern: str) -> Column:
    """array<int> of token ids."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        return pa.array([encode_text(t or "", ranks_path, pattern) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return encode(whole(text))


def decode_column(ids: Column, ranks_path: str, pattern: str) -> Column:
    """The bytes of token ids."""

    @F.arrow_udf(T.BinaryType())
    def decode(batch: pa.Array) -> pa.Array:
        own = encoding(ranks_path, pattern)
        return pa.array([own.decode_bytes(x or []) for x in batch.to_pylist()], pa.binary())

    return decode(ids)


def round_trip(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with two more columns, ids and decoded (bytes decoded from those ids), made in one pass through Python.

    Where docs has such a name, underscores follow the new one.
    """
    ship(spark)
    bounded_batches(spark)
    both = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])

    @F.arrow_udf(both)
    def encode_decode(texts: pa.Array) -> pa.Array:
        own = encoding(ranks_path, pattern)
        ids = [encode_text(t or "", ranks_path, pattern) for t in texts.to_pylist()]
        back = pa.array([own.decode_bytes(x) for x in ids], pa.binary())
        return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), back], ["ids", "decoded"])

    pair = free_name(docs, "_pair")
    out = docs.withColumn(pair, encode_decode(whole(F.col(text))))
    return out.select(*docs.columns, F.col(pair)["ids"].alias(free_name(docs, "ids")), F.col(pair)["decoded"].alias(free_name(docs, "decoded")))
