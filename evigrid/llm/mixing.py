"""Mixing sources to target weights, with soft membership.

A classifier learnt from a labelled table gives each document a posterior over domains. Rates (copies of a document, 0
or more) are then fitted by projected-gradient least squares, so that the expected tokens of each domain, that is the
sum over documents of rate * tokens * posterior, meet the targets.

Posteriors are whole multiples of 1 / GRID that sum to 1, and documents of one posterior have one rate, so one aggregation
(with partial sums on the map side) turns the corpus into cells, and every step is a pass over that much smaller table: numpy
sums on the executors, of which a few numbers per task reach the driver. A step measures the errors e of the domains' tokens
and moves each rate from r to max(0, r - p . g), where g = inverse(H) e and H is the sum of tokens * p p' over the documents
whose rate is above 0: the gradient step for errors weighted by the inverse of H, shortened if it doesn't lessen them. Rates begin
at 1, so that the mixture stays near the corpus. The fit ends when each domain is within CLOSE of its own target. Where targets
can't be met (no document is sure enough of a domain), such steps turn in circles; then the best rates so far go on with H over all
documents, which makes less error certain, until a step gains nothing, and a warning names the errors left.

The classifier is a logistic regression with an L1 penalty over the presence of words and of word shapes ("SPAM!!" is "A!"),
hashed; it sees the TELLING buckets that tell domains apart best, in at most SAMPLE distinct labelled texts (the first by a
hash). Whole texts are read. Tokens are words.

Null and empty texts have 0 tokens and the posterior of a text without words. Repeated rows get equal rates and are drawn
alike. Without labelled rows there is one domain, "all", and targets for other domains are left out. A domain that no
document belongs to can't be reached: its target is spread over the others. An empty table gives an empty result.
Columns of docs keep their names, whatever they are.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bounded_batches, free_name, ship
from .hashing import IS_SPACE, utf8, word_hashes

SAMPLE, BUCKETS, TELLING, MOST_DOMAINS = 10_000, 1 << 16, 768, 64

#: Weight of the L1 penalty, and steps of the regression.
PENALTY, ROUNDS = 3e-4, 200

#: Posteriors are multiples of 1 / GRID.
GRID = 512

#: Steps of the fit at most, and the error at which it ends (as a part of the domain's target, or of all tokens where that is 0).
STEPS, CLOSE = 60, 1e-3

#: Steps without less error after which the fit goes on in steps of certain descent.
PATIENCE = 6

#: A step that lessens the error by less than this part gains nothing.
STALL = 1e-3

#: What a byte counts for in a word's shape: letters (and all beyond ASCII) as a or A, digits as 0, others as they are.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = SHAPE[128:] = ord("a")
SHAPE[65:91], SHAPE[48:58], SHAPE[IS_SPACE] = ord("A"), ord("0"), ord(" ")


@dataclass(frozen=True)
class Model:
    names: list[str]
    features: np.ndarray  # the buckets that count
    weights: np.ndarray  # features x domains
    bias: np.ndarray

    def posterior(self, present: np.ndarray) -> np.ndarray:
        """Multiples of 1 / GRID for texts (rows) that have features (columns) or not. What rounding down leaves goes to the likeliest domain."""
        total = present @ self.weights + self.bias
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grid = np.floor(p * GRID).astype(np.int16)
        grid[np.arange(len(p)), p.argmax(axis=1)] += (GRID - grid.sum(axis=1)).astype(np.int16)
        return grid


def shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words' shapes: runs of one kind of character are one character."""
    kind = SHAPE[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[offsets[:-1][offsets[:-1] < len(kind)]] = True
    kept = [np.count_nonzero(keep[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return word_hashes(kind[keep], np.cumsum([0, *kept]), lower=False)


def buckets(array: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text the distinct buckets of its words and their shapes, and its number of words."""
    text = utf8(array)
    (h, first), (s, _) = word_hashes(*text), shapes(*text)
    both = [(x >> np.uint64(48)).astype(np.int32) for x in (h, s)]
    return [np.unique(np.concatenate([x[a:b] for x in both])) for a, b in zip(first[:-1], first[1:], strict=True)], np.diff(first)


def presence(texts: list[np.ndarray], features: np.ndarray) -> np.ndarray:
    """A row of 0 and 1 for each text."""
    place = np.full(BUCKETS, -1, np.int32)
    place[features] = np.arange(len(features))
    out = np.zeros((len(texts), len(features)), np.float32)
    for row, own in zip(out, texts, strict=True):
        at = place[own]
        row[at[at >= 0]] = 1
    return out


def regress(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of an L1 logistic regression over domains (y: one column each), by accelerated proximal gradient steps."""
    n, top = len(x), np.ones(x.shape[1], np.float32)
    for _ in range(20):  # the largest curvature, by power iteration
        top = x.T @ (x @ top)
        size = float(np.linalg.norm(top))
        top /= max(size, 1e-9)
    rate = 1 / (0.5 * (size / n + 1))
    w = z = np.zeros((x.shape[1], y.shape[1]), np.float32)
    b = c = np.log(y.mean(axis=0) + 1e-9).astype(np.float32)
    momentum = 1.0
    for _ in range(rounds):
        total = x @ z + c
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p = p / p.sum(axis=1, keepdims=True) - y
        step = z - x.T @ p * np.float32(rate / n)
        new = np.sign(step) * np.maximum(np.abs(step) - np.float32(rate * penalty), 0)
        bias = c - p.mean(axis=0) * np.float32(rate)
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        pull = np.float32((momentum - 1) / after)
        z, c, w, b, momentum = new + pull * (new - w), bias + pull * (bias - b), new, bias, after
    return w.astype(np.float64), b.astype(np.float64)


def train(spark: SparkSession, docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", domain: str = "domain") -> Model:
    """labelled: key and domain. Equal texts of one domain count once."""
    ship(spark)
    bounded_batches(spark)
    scratch = Scratch(spark, "mixing_model")
    own = labelled.where(F.col(domain).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(domain).alias("domain")).orderBy(F.xxhash64("k"), "k", "domain").limit(SAMPLE).distinct()
    texts = docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text"))
    rows = texts.join(F.broadcast(own), F.col("id") == F.col("k")).select("domain", F.sha2(F.coalesce("text", F.lit(b"")), 256).alias("digest"), "text")

    def sketch(batches):
        for batch in batches:
            found, _ = buckets(batch["text"])
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *found]), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["domain"], batch["digest"], lists], ["domain", "digest", "buckets"])

    seen = rows.mapInArrow(sketch, "domain string, digest string, buckets array<int>").dropDuplicates(["domain", "digest"])
    seen = scratch.save(seen.orderBy("digest", "domain").limit(SAMPLE).drop("digest"))
    sizes = {r["domain"]: r["n"] for r in seen.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy("domain").limit(MOST_DOMAINS + 1).collect()}
    names = list(sizes)
    if len(names) > MOST_DOMAINS:
        raise ValueError(f"over {MOST_DOMAINS} domains; the model is made for {MOST_DOMAINS} at most")
    if len(names) < 2:
        scratch.drop_all()
        return Model(names or ["all"], np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(1))
    got = seen.select("domain", F.explode("buckets").alias("bucket")).groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros((BUCKETS, len(names)))
    np.add.at(counts, (got["bucket"].to_numpy(), [names.index(x) for x in got["domain"].to_pylist()]), got["n"].to_numpy())
    # A bucket's share among the distinct buckets of a domain's texts: unlike a share of texts, it doesn't rise with their length.
    expected = counts.sum(axis=1, keepdims=True) * counts.sum(axis=0) / max(1.0, counts.sum())
    telling = (np.abs(counts - expected) / np.sqrt(expected + 1)).max(axis=1)
    features = np.sort(np.argsort(-telling, kind="stable")[:TELLING])
    features = features[telling[features] > 0]

    def pack(batches):
        for batch in batches:
            bits = np.packbits(presence([np.asarray(x, np.int32) for x in batch["buckets"].to_pylist()], features) > 0, axis=1)
            yield pa.RecordBatch.from_arrays([batch["domain"], pa.array([r.tobytes() for r in bits], pa.binary())], ["domain", "bits"])

    got = seen.mapInArrow(pack, "domain string, bits binary").toArrow()
    scratch.drop_all()
    packed = sorted(zip(got["domain"].to_pylist(), got["bits"].to_pylist(), strict=True))
    bits = np.frombuffer(b"".join(b for _, b in packed), np.uint8).reshape(len(packed), -1)
    x = np.unpackbits(bits, axis=1, count=len(features)).astype(np.float32)
    y = (np.array([d for d, _ in packed])[:, None] == np.array(names)).astype(np.float32)
    weights, bias = regress(x, y)
    some = np.abs(weights).max(axis=1) > 0
    return Model(names, features[some], weights[some], bias)


def members(spark: SparkSession, docs: DataFrame, model: Model, text: str = "text", name: str = "_member", gradients: list[list[float]] = ()) -> DataFrame:
    """docs with a struct column: tokens, p (the posterior of each domain in the model's order as multiples of 1 / GRID) and rate."""
    ship(spark)
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.StructType([T.StructField("tokens", T.LongType()), T.StructField("p", T.ArrayType(T.ShortType())), T.StructField("rate", T.DoubleType())]))
    def classify(texts: pa.Array) -> pa.Array:
        own = shared.value
        found, tokens = buckets(texts)
        p = own.posterior(presence(found, own.features))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * len(own.names), pa.int32()), pa.array(p.ravel(), pa.int16()))
        return pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), lists, pa.array(chain(p, gradients))], ["tokens", "p", "rate"])

    return docs.withColumn(name, classify(F.col(text).cast("binary")))


def chain(p: np.ndarray, gradients: list[list[float]]) -> np.ndarray:
    """Rates after the steps: r <- max(0, r - p . g), from 1. p: one row per document, in multiples of 1 / GRID."""
    rate, share = np.ones(len(p)), p / GRID
    for g in gradients:
        rate = np.maximum(0.0, rate - share @ np.asarray(g))
    return rate


def rows_of(p: pa.Array, n: int) -> np.ndarray:
    """Posteriors as a matrix."""
    return p.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def rate_udf(model: Model, gradients: list[list[float]]):
    """The rate of a posterior."""
    n = len(model.names)

    @F.arrow_udf(T.DoubleType())
    def rate(p: pa.Array) -> pa.Array:
        return pa.array(chain(rows_of(p, n), gradients))

    return rate


def measure(cells: DataFrame, n: int, gradients: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each domain after the steps, and the sum of tokens * p p' over documents whose rate is above 0."""

    def part(batches):
        now, gram = np.zeros(n), np.zeros((n, n))
        for batch in batches:
            p = rows_of(batch["p"], n)
            tokens, rate, share = batch["tokens"].to_numpy().astype(float), chain(p, gradients), p / GRID
            now += share.T @ (tokens * rate)
            gram += share.T @ (share * (tokens * (rate > 0))[:, None])
        yield pa.RecordBatch.from_arrays([pa.array([list(now)], pa.list_(pa.float64())), pa.array([list(gram.ravel())], pa.list_(pa.float64()))], ["now", "gram"])

    got = cells.select("p", "tokens").mapInArrow(part, "now array<double>, gram array<double>").collect()
    return sum((np.array(r["now"]) for r in got), np.zeros(n)), sum((np.array(r["gram"]) for r in got), np.zeros(n * n)).reshape(n, n)


def fit(cells: DataFrame, names: list[str], weights: dict[str, float], total: float | None = None) -> tuple[list[list[float]], dict[str, float]]:
    """Gradient vectors of the steps to the closest rates, and the shares of the wanted tokens that they reach.

    cells: p (multiples of 1 / GRID) and tokens; total: tokens wanted in all (default: as many as there are).
    """
    n = len(names)
    now, full = measure(cells, n, [])
    tokens = now.sum()
    if tokens <= 0:
        return [], {}
    want = np.array([weights.get(x, 0.0) for x in names]) * (now > 1e-9 * tokens)
    if want.sum() <= 0:
        return [], {}
    wanted = float(total or tokens)
    target, gram = want / want.sum() * wanted, full
    step_of = lambda h, e: np.linalg.pinv(h / tokens, rcond=1e-10) @ e / tokens
    loss = lambda e, h: float(e @ step_of(h, e))
    done = lambda e: (np.abs(e) / np.where(target > 0, target, wanted)).max() <= CLOSE
    gradients: list[list[float]] = []
    error = now - target
    best, gain_at = (loss(error, full), [], error, gram), 0
    while not done(error) and len(gradients) < STEPS and len(gradients) - gain_at < PATIENCE:
        for part in (1.0, 0.25, 0.0625):  # the longest step that lessens the error as these rates weigh it
            step = list(part * step_of(gram, error))
            now, after = measure(cells, n, [*gradients, step])
            if loss(now - target, gram) < (1 - STALL) * loss(error, gram):
                break
        else:
            break
        gradients.append(step)
        error, gram = now - target, after
        if loss(error, full) < best[0]:
            best, gain_at = (loss(error, full), list(gradients), error, gram), len(gradients)
    if not done(error):  # from the best rates so far by steps of certain descent
        least, gradients, error, _ = best
        while not done(error) and len(gradients) < 2 * STEPS:
            step = list(step_of(full, error))
            now, _ = measure(cells, n, [*gradients, step])
            if (new := loss(now - target, full)) > (1 - STALL) * least:
                break
            gradients.append(step)
            error, least = now - target, new
    off = np.abs(error) / np.where(target > 0, target, wanted)
    if off.max() > CLOSE:
        warnings.warn(f"no rates found that meet the targets; after {len(gradients)} steps the errors as parts of them are " + ", ".join(f"{k} {v:.2g}" for k, v in zip(names, off, strict=True)), stacklevel=2)
    return gradients, dict(zip(names, ((error + target) / wanted).tolist(), strict=True))


def solve(spark: SparkSession, docs: DataFrame, model: Model, weights: dict[str, float], key: str, text: str, total: float | None) -> tuple[Scratch, DataFrame, list[list[float]]]:
    """A table of key, tokens and p, and the gradients that give a posterior its rate."""
    scratch = Scratch(spark, "mixing")
    seen = members(spark, docs.select(F.col(key).alias("key"), F.col(text).alias("text")), model)
    seen = scratch.save(seen.select("key", "_member.tokens", "_member.p"))
    cells = scratch.save(seen.groupBy("p").agg(F.sum("tokens").alias("tokens")))
    gradients, _ = fit(cells, model.names, weights, total)
    scratch.drop(cells)
    return scratch, seen, gradients


def rates(spark: SparkSession, docs: DataFrame, model: Model, weights: dict[str, float], key: str = "doc_id", text: str = "text", total: float | None = None) -> tuple[DataFrame, list[list[float]]]:
    """(key, tokens, p_0, ..., rate) of each row of docs, and the gradients that give a posterior its rate."""
    _, seen, gradients = solve(spark, docs, model, weights, key, text, total)
    posterior = [(F.get("p", F.lit(d)) / F.lit(float(GRID))).alias(f"p_{d}") for d in range(len(model.names))]
    return seen.select(F.col("key").alias(key), "tokens", *posterior, rate_udf(model, gradients)("p").alias("rate")), gradients


def copies(rate: Column, key: Column, seed: int = 17) -> Column:
    """Whole copies: the rate rounded down or up, up with the chance of its fraction, drawn from a hash of the key."""
    draw = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def mix(spark: SparkSession, docs: DataFrame, model: Model, weights: dict[str, float], key: str = "doc_id", text: str = "text", total: float | None = None) -> DataFrame:
    """Rows of docs, each as often as its rate says. The posterior is computed again beside the text, so texts don't shuffle.

    Rows of no copies go by the empty array, not by a filter: Spark would push a filter below the projection, and classify twice.
    """
    scratch, _, gradients = solve(spark, docs, model, weights, key, text, total)
    scratch.drop_all()
    member, again = free_name(docs, "_member"), free_name(docs, "_copy")
    out = members(spark, docs, model, text, member, gradients)
    out = out.withColumn(again, F.explode(F.array_repeat(F.lit(True), copies(F.col(member)["rate"], F.col(key)).cast("int"))))
    return out.select(*docs.columns)
