"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of whole labelled texts on the executors and sums the sparse counts natively; the matrix of log
probabilities (BUCKETS rows, one column for each language, both bounded) is broadcast. Scoring hashes the n-grams of a
batch of texts at once in numpy and sums the rows of the matrix that they hit.

Training takes at most SAMPLE labelled documents, those with the smallest hash of their id; all documents are scored.
A null text or one without a letter is `und`, with score 0. Rows are scored one by one; repeated rows get equal scores,
tied languages the first name. Without training rows every text is `und`. Columns of docs keep their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, free_name, ship

BUCKETS, ORDERS, SAMPLE, MOST_LANGUAGES = 1 << 15, (1, 2, 3), 20_000, 512

#: Characters scored at once, about. Longer texts are summed piece by piece; the n-grams that two pieces share count once.
CHARS = 1 << 17

_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
LETTER = regex.compile(r"\p{L}")


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)


def cut(chars: np.ndarray, size: int):
    """Pieces of size, each with the characters after it that its last n-grams reach, and its own number of characters."""
    for at in range(0, len(chars), size):
        yield chars[at : at + size + max(ORDERS) - 1], min(size, len(chars) - at)


def buckets(chars: np.ndarray) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that starts at each character; the last ones have no n-gram."""
    out = []
    for order in ORDERS:
        n = max(0, len(chars) - order + 1)
        h = np.full(n, order, np.uint32)
        for k in range(order):
            h = (h ^ chars[k : k + n]) * _FACTORS[k]
            h ^= h >> np.uint32(15)
        out.append(((h * np.uint32(0x27D4EB2F)) >> np.uint32(17)).astype(np.int64))
    return out


def count_texts(texts: list[str]) -> np.ndarray:
    total = np.zeros(BUCKETS, np.int64)
    for text in texts:
        for piece, own in cut(codes(text), CHARS):
            for h in buckets(piece):
                total += np.bincount(h[:own], minlength=BUCKETS)
    return total


def score_texts(texts: list[str | None], logs: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best language (-1: none) and its posterior for each text."""
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    sums = np.zeros((len(texts), len(prior)))
    real = [j for j, t in enumerate(texts) if t and LETTER.search(t)] if len(prior) else []
    group: list[tuple[int, np.ndarray, int]] = []  # text, characters, how many of them are its own

    def flush() -> None:
        if not group:
            return
        chars = np.concatenate([c for _, c, _ in group])
        ends = np.cumsum([len(c) for _, c, _ in group])
        starts = ends - [len(c) for _, c, _ in group]
        last = np.repeat([s + own for s, (_, _, own) in zip(starts, group, strict=True)], [len(c) for _, c, _ in group])
        for order, h in zip(ORDERS, buckets(chars), strict=True):
            rows = logs[h]
            rows[np.arange(len(rows)) >= last[: len(rows)]] = 0  # n-grams that begin after the piece's own characters
            for k in range(1, order):  # n-grams that reach into the next piece
                over = ends[:-1] - k
                rows[over[over >= 0]] = 0
            if len(rows):
                at = np.minimum(starts, len(rows) - 1)
                part = np.add.reduceat(rows, at, axis=0)
                part[starts >= len(rows)] = 0
                np.add.at(sums, [j for j, _, _ in group], part)
        group.clear()

    size = 0
    for j in real:
        for piece, own in cut(codes(texts[j]), CHARS):
            if size + len(piece) > CHARS:
                flush()
                size = 0
            group.append((j, piece, own))
            size += len(piece)
    flush()
    if real:
        total = sums[real] + prior
        best[real] = total.argmax(axis=1)
        score[real] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return best, score


def train(spark: SparkSession, labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log probabilities (BUCKETS x languages, float32) and log priors."""
    ship(spark)
    bounded_batches(spark)
    some = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    ids = some.select("key", F.xxhash64("key").alias("o")).orderBy("o", "key").limit(SAMPLE).select("key").distinct()
    rows = some.join(F.broadcast(ids), "key", "left_semi").select("lang", "text")

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in batches:
            for name, t in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                totals[name] = totals.get(name, 0) + count_texts([t])
                texts[name] = texts.get(name, 0) + 1
        for name, total in totals.items():
            at = np.flatnonzero(total)
            at, n = np.append(at, -1), np.append(total[at], texts[name])  # bucket -1: number of texts
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n, pa.int64())], ["lang", "bucket", "n"])

    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    names = sorted(set(got["lang"].to_pylist()))
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"{len(names)} languages; the model is made for {MOST_LANGUAGES} at most")
    at = np.array([names.index(x) for x in got["lang"].to_pylist()], np.int64)
    bucket, n = got["bucket"].to_numpy().astype(np.int64), got["n"].to_numpy()
    counts, docs = np.zeros((BUCKETS, len(names))), np.zeros(len(names))
    counts[bucket[bucket >= 0], at[bucket >= 0]] = n[bucket >= 0]
    docs[at[bucket < 0]] = n[bucket < 0]
    logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS)) if names else counts
    return names, logs.astype(np.float32), np.log(docs / docs.sum()) if names else docs


def identify(spark: SparkSession, docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """docs with lang_pred and score (the posterior of that language, 0 to 1)."""
    ship(spark)
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(texts: pa.Array) -> pa.Array:
        names, logs, prior = shared.value
        best, score = score_texts(texts.to_pylist(), logs, prior)
        return pa.StructArray.from_arrays([pa.array([names[b] if b >= 0 else "und" for b in best], pa.string()), pa.array(score)], ["lang", "score"])

    pair = free_name(docs, "_lang")
    out = docs.withColumn(pair, predict(F.col(text)))
    return out.select(*docs.columns, F.col(pair)["lang"].alias(free_name(docs, "lang_pred")), F.col(pair)["score"].alias(free_name(docs, "score")))


def held_out(key: Column, folds: int, fold: int) -> Column:
    """crc32 of the key as text falls in the fold; a null key falls in none."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))
