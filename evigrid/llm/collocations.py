"""Phrase collocations: runs of words that occur together much more often than their parts do apart.

Texts are cut into pieces at stops and line ends, pieces into words at blanks; everything is counted for each language. A phrase's
score is the lowest, over its cuts into two parts, of 2,000,000 times its count over the sum of the parts' counts.

1. A sketch: every task hashes the phrases of its texts into buckets and reports the filled ones, slice by slice; tasks that each
   hold a few slices add the reports up. A bucket's sum is an upper bound of the count of every phrase in it, and one bit of it is kept: whether
   it reaches the least count. These bits (at most 2^MOST_BITS, so 128 MB) go to every task.
2. A scan: a task takes its texts in shards, compiles the phrases that occur in a shard and pass the sketch into Aho-Corasick automata
   whose patterns begin and end with a delimiter, and counts overlapping matches. The candidates of all shards are never in one place.
3. Sums of the shards' counts are exact; thresholds, scores and the check for longer phrases are joins on phrases, whose hot parts
   ("the" is a part of very many) are dealt to many tasks.

The sketch decides only what is counted, never a result: where its buckets are too few for the corpus (beyond about 2^35 phrase
occurrences), more phrases are counted in vain, at most one row for each phrase and shard. Within a shard phrases are told apart by 64-bit hashes:
of 5 million different ones, two share a hash with a chance of 7e-7, and one of these would go uncounted there.

Null texts count as empty, null languages as `und`; null and repeated keys don't matter, a repeated row counts again. Long texts are taken in
parts that end with a piece. Equal scores are put in order by count, then by the phrase's bytes. A corpus without frequent phrases, or
without rows, gives an empty result. Other columns of docs are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import hashing
from .common import Scratch, bounded_batches, ship, spread_join, whole

LONGEST = 4

#: A-Z to a-z, tabs to blanks, and whatever ends a piece to a line feed.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
BLANK = np.zeros(256, bool)
BLANK[[10, 32]] = True

#: Bytes of text that one automaton (or a few) is compiled for, and phrases of an automaton.
SHARD, MOST_PHRASES = 1 << 22, 100_000

#: Buckets that a task collects before it reports them, and bits of a bucket's number within its slice.
REPORT, SLICE_BITS = 1 << 23, 16

#: The sketch has a bucket for each BUCKET_BYTES of text, between these powers of two.
BUCKET_BYTES, LEAST_BITS, MOST_BITS = 32, 16, 30

#: Rows that one task of the final ranking sorts, about.
RANK_ROWS = 50_000


def parts(folded: bytes, size: int = SHARD):
    """A folded text in parts of about that size, each of which ends with a piece."""
    at = 0
    while len(folded) - at > size:
        cut = folded.rfind(b"\n", at, at + size) + 1 or folded.find(b"\n", at + size) + 1
        if not cut or cut == len(folded):
            break
        yield folded[at:cut]
        at = cut
    yield folded[at:] if at else folded


def shards(batches, size: int | None = None):
    """Lists of (language, folded text) of about SHARD bytes."""
    held, total, size = [], 0, size or SHARD
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            for part in parts(text.translate(FOLD), size):
                if held and total + len(part) > size:
                    yield held
                    held, total = [], 0
                held.append((lang, part))
                total += len(part)
    if held:
        yield held


class Grams:
    """The phrases of a shard: for each length 1 to LONGEST the hashes at every word, and where they are phrases (within a piece)."""

    def __init__(self, shard: list[tuple[str, bytes]]):
        self.bytes = b"".join(t for _, t in shard)
        self.data = np.frombuffer(self.bytes, np.uint8)
        offsets = np.cumsum([0, *(len(t) for _, t in shard)])
        self.begin, self.end = hashing.word_spans(self.data, offsets, BLANK)
        words = hashing.hash_spans(self.data, self.begin, self.end, False)
        self.text = np.searchsorted(offsets, self.begin, "right") - 1
        piece = self.text + np.searchsorted(np.flatnonzero(self.data == 10), self.begin)  # either grows at a new piece
        names = sorted({lang for lang, _ in shard})
        self.langs, code = names, np.array([names.index(lang) for lang, _ in shard], np.int64)
        seeds = hashing.hash_spans(*_spans([n.encode() for n in names]), False)
        self.lang = code[self.text]
        self.hashes, self.whole = [], []
        own = hashing.mix(words + hashing.mix(~seeds)[self.lang])  # never the sum of a word and a name, or en and es would be one with es and en
        for n in range(1, LONGEST + 1):
            if n > 1:
                own = hashing.mix(own[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[n - 1 :]) if len(own) else own
            self.hashes.append(own)
            self.whole.append(piece[: len(own)] == piece[n - 1 :] if len(own) else np.zeros(0, bool))


def _spans(names: list[bytes]):
    offsets = np.cumsum([0, *map(len, names)])
    return np.frombuffer(b"".join(names), np.uint8), offsets[:-1], offsets[1:]


def reports(bits: int, least: int):
    """Texts to filled buckets: slice, gaps between them within it, and their counts up to `least`."""
    count_type = np.uint8 if least < 256 else np.uint32

    def report(held):
        ids = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.diff(ids, prepend=ids[0] ^ np.uint32(1)))
        counts = np.minimum(np.diff(first, append=len(ids)), least).astype(count_type)
        ids = ids[first]
        part = ids >> np.uint32(SLICE_BITS)
        cuts = np.flatnonzero(np.diff(part, prepend=part[0] ^ np.uint32(1)))
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True):
            gaps = np.diff(ids[a:b] & np.uint32((1 << SLICE_BITS) - 1), prepend=np.uint32(0))
            rows.append((int(part[a]), gaps.astype(np.uint8 if gaps.max() < 256 else np.uint16).tobytes(), counts[a:b].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["slice", "gaps", "counts"])

    def run(batches):
        held, n = [], 0
        for shard in shards(batches):
            grams = Grams(shard)
            for own, ok in zip(grams.hashes, grams.whole, strict=True):
                held.append((own[ok] >> np.uint64(64 - bits)).astype(np.uint32))
                n += len(held[-1])
            if n >= REPORT:
                yield report(held)
                held, n = [], 0
        if n:
            yield report(held)

    return run


def add_reports(least: int):
    """Reports of some slices to the slices' bits: whether a bucket reaches `least`."""
    count_type = np.uint8 if least < 256 else np.uint32

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, gaps, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sums.setdefault(k, np.zeros(1 << SLICE_BITS, np.uint32))
                counts = np.frombuffer(counts, count_type)
                at = np.cumsum(np.frombuffer(gaps, np.uint8 if len(gaps) == len(counts) else np.uint16), dtype=np.int64)
                own[at] = np.minimum(own[at] + counts, least)
        if sums:
            bits = [np.packbits(own >= least).tobytes() for own in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], ["slice", "bits"])

    return run


def sketch(spark: SparkSession, docs: DataFrame, least: int) -> tuple[np.ndarray, int]:
    """The sketch's bits, and the power of two that is their number. docs: lang and text, not null."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, int(size // BUCKET_BYTES).bit_length()))
    slices = 1 << max(0, bits - SLICE_BITS)
    own = docs.mapInArrow(reports(bits, least), "slice int, gaps binary, counts binary").repartition(max(1, slices // 8), "slice")
    out = np.zeros(slices << max(0, SLICE_BITS - 3), np.uint8)
    for row in own.mapInArrow(add_reports(least), "slice int, bits binary").collect():
        out[row["slice"] << (SLICE_BITS - 3) :][: 1 << (SLICE_BITS - 3)] = np.frombuffer(row["bits"], np.uint8)
    return out, bits


def candidates(grams: Grams, filled: np.ndarray, bits: int) -> dict[str, list[bytes]]:
    """By language, the different phrases of a shard that the sketch lets pass, as all their shorter runs must."""
    out: dict[str, list[bytes]] = {lang: [] for lang in grams.langs}
    passed = None
    for n, (own, ok) in enumerate(zip(grams.hashes, grams.whole, strict=True), 1):
        bucket = own >> np.uint64(64 - bits)
        ok = ok & (filled[bucket >> np.uint64(3)] >> (np.uint64(7) - (bucket & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
        if passed is not None and len(own):
            ok &= passed[:-1] & passed[1:]
        passed, at = ok, np.flatnonzero(ok)
        at = at[np.unique(own[at], return_index=True)[1]]
        for lang, a, b in zip(grams.lang[at].tolist(), grams.begin[at].tolist(), grams.end[at + n - 1].tolist(), strict=True):
            phrase = grams.bytes[a:b]
            out[grams.langs[lang]].append(b" ".join(phrase.split()) if b"  " in phrase else phrase)
    return out


def count_matches(text: bytes, phrases: list[bytes]) -> Counter:
    """Overlapping matches of phrases in a text of pieces, by automata over `blank phrase blank`."""
    import ahocorasick

    guarded = re.sub(b" {2,}", b" ", b" " + text.replace(b"\n", b" \n ") + b" ").decode("latin-1")
    phrases = sorted(phrases)  # neighbours share most of their way into the automaton, which is then built faster
    found: Counter = Counter()
    for k in range(0, len(phrases), MOST_PHRASES):
        some = phrases[k : k + MOST_PHRASES]
        own = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, p in enumerate(some):
            own.add_word(f" {p.decode('latin-1')} ", i)  # bytes as characters: the library takes text only
        own.make_automaton()
        n = np.bincount(np.fromiter(map(itemgetter(1), own.iter(guarded)), np.int32), minlength=len(some))
        found.update({p: m for p, m in zip(some, n.tolist(), strict=True) if m})
    return found


def scan(filled, bits: int):
    """Texts to counts of candidates by shard (lang, phrase, a); the empty phrase stands for all words."""

    def run(batches):
        for shard in shards(batches):
            grams = Grams(shard)
            found = candidates(grams, filled.value, bits)
            n = np.bincount(grams.lang, minlength=len(grams.langs))
            del grams
            for lang, phrases in found.items():
                counts = count_matches(b"\n".join(t for own, t in shard if own == lang), phrases) if phrases else Counter()
                counts[b""] = int(n[sorted(found).index(lang)])
                names = pa.array(list(counts), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), names, pa.array(list(counts.values()), pa.int64())], ["lang", "phrase", "a"])

    return run


def counts(spark: SparkSession, docs: DataFrame, least: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, a): exact counts of all phrases of 1 to LONGEST words that occur `least` times; the empty phrase has the number of words."""
    ship(spark)
    bounded_batches(spark)
    docs = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), whole(F.col(text)).alias("text"))
    filled, bits = sketch(spark, docs, least)
    found = docs.mapInArrow(scan(spark.sparkContext.broadcast(filled), bits), "lang string, phrase string, a long")
    return found.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where((F.col("a") >= least) | (F.col("phrase") == ""))


def _exact(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def score(counted: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases of two words and more: the cut that scores lowest, of equal ones the first."""
    words = F.split("phrase", " ")
    cut = F.transform(
        F.sequence(F.lit(1), F.size(words) - 1),
        lambda k: F.struct(k.alias("k"), F.array(F.array_join(F.slice(words, F.lit(1), k), " "), F.array_join(F.slice(words, k + 1, F.size(words)), " ")).alias("sides")),
    )
    cuts = counted.where(F.size(words) > 1).select("lang", "phrase", "a", F.inline(cut))
    cuts = cuts.select("lang", "phrase", "a", "k", F.posexplode("sides").alias("side", "part"))
    sizes = cuts.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("size"))
    both = spread_join(cuts, counted.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")), ["lang", "part"], sizes, "phrase")
    side = lambda k: F.sum(F.when(F.col("side") == k, F.col("f")))
    both = both.groupBy("lang", "phrase", "a", "k").agg(side(0).alias("l"), side(1).alias("r"))
    both = both.withColumn("score", F.expr("CAST(a AS DECIMAL(38,0)) * 2000000 DIV (CAST(l AS DECIMAL(38,0)) + r)"))
    low = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    return low.select("lang", "phrase", "a", "low.l", "low.r", F.col("low.score").cast("long").alias("score"))


def covered(counted: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the count of the most frequent phrase that holds a phrase of two words or more and is longer."""
    words = F.split("phrase", " ")
    n = F.size(words)
    runs = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    held = counted.where(n > 2).select("lang", "a", F.explode(F.array_distinct(runs)).alias("phrase"))
    return held.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def mine(spark: SparkSession, docs: DataFrame, least: int = 30, most: int = 2000, cover: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `most` phrases by score, count, phrase.

    A phrase goes if a longer one that holds it has `cover` percent of its occurrences.
    """
    counted = Scratch(spark, "collocations").save(counts(spark, docs, least, text, lang))
    phrases = counted.where(F.col("phrase") != "")
    gone = _exact(F.col("longer")) * 100 >= _exact(F.col("a")) * cover
    kept = score(phrases).join(covered(phrases), ["lang", "phrase"], "left").where(~F.coalesce(gone, F.lit(False)))
    salts = max(1, phrases.count() // RANK_ROWS)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    totals = counted.where(F.col("phrase") == "").select("lang", F.col("a").alias("n"))
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
