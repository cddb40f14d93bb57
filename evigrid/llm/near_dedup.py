"""Near-duplicate documents by circulant MinHash.

Shingles are hashed into 32 bits. One permutation (sigma) scatters them; a second one (pi), shifted circularly by
k = 0, 1, 2, ..., gives coordinate k of the signature: min over shingles of pi(sigma(shingle) + k). Signatures are cut
into BANDS of ROWS coordinates; documents that share a band are candidates, and a candidate becomes a link only after
the exact Jaccard similarity of the full shingle sets is known. With 48 bands of 5, a pair of similarity 0.75 shares no
band with a chance of 2e-6, one of 0.8 with 6e-9.

Work is kept linear in the documents and in the links between different texts:

* documents with equal shingle sets become one class before any band is looked at, by an aggregation that combines on
  the map side, so that a group of copies with a third of all rows shuffles as one row per task;
* no bucket emits all its pairs. First every class meets the most popular class of its buckets only (in a group of near
  copies the original is in most buckets). Buckets that then hold one component need no more work: a pair inside a
  component can't change the result;
* what is left are documents that share a passage, or miss the wanted similarity with a popular text by little. Their
  candidates are dealt again by rare shingles: with the shingles of these documents in order of frequency, two sets of
  n and m shingles that share ceil(3/7 (n + m)), as similarity 0.75 demands, must share one of their first
  n - ceil(3/7 (n + m)) + 1. Sizes are put in classes 8 % wide, and each pair of classes has buckets of its own, so that
  m is known well; two members meet only if enough shingles follow the shared one in both. A common passage, or the text that near misses were made from, is rare enough for such a bucket only
  in documents that mostly consist of it. In these buckets a growing number of members (8, 64, 512, ... in a round)
  meets the members of other components, until each pair of different components in a bucket has been tested. Two bits of each
  signature's coordinate travel with the members, so that a pair goes on to the test on full sets only if its signatures are alike
  enough: texts from one template that fill its gaps from small sets of phrases share rare shingles with many others;
* texts are read again only for classes that share a band with another one;
* joins on a bucket, a shingle, a class that many others meet, or a class with many rows deal a hot key to many tasks (spread_join).

Every round is a written table in the shared folder, so lost executors recompute one round at most; links, labels and
sets never visit the driver, which only learns counts.

Null texts and texts without words have an empty set and are linked with nothing. A text shorter than SHINGLE words is
one shingle. Rows without a key are returned with a null component and kept. Rows with the same key and text are one
document, returned once for each row; a key with several texts is linked by any of them, and joins their components.
Classes have numbers of their own (rep), so that keys may repeat; components get their smallest key at the end. An empty
table gives an empty result; ties don't matter since components don't depend on the order of tests.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, free_name, ship, spread_join
from .hashing import mix, utf8, word_hashes

SHINGLE, ROWS, BANDS, PERCENT = 5, 5, 48, 75

#: Coordinates that two sets of the wanted similarity may have unlike, judged by two bits of each: the mean, (1 - 0.75) * 3 / 4 of
#: them, and 5.5 standard deviations. A link is taken for none with a chance of 2e-8.
MOST_UNLIKE = int(ROWS * BANDS * 3 / 16 + 5.5 * math.sqrt(ROWS * BANDS * 3 / 16 * 13 / 16))

#: 64-bit words that hold one bit of each coordinate.
WORDS = -(-ROWS * BANDS // 64)

#: Set sizes of one class differ by this factor at most.
CLASS_WIDTH = 1.08

#: Shingles whose coordinates are computed at once.
BLOCK = 1024

_SHIFTS = np.arange(ROWS * BANDS, dtype=np.uint32)[:, None]
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray):
    """For each text the sorted 64-bit hashes of its distinct shingles."""
    h, first = word_hashes(data, offsets)
    n = max(0, len(h) - SHINGLE + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        runs += h[k : k + n] * _ODD[k]
    runs = mix(runs)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= SHINGLE:
            yield np.unique(runs[a : b - SHINGLE + 1])
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                short = mix(short * _ODD[0] + h[k])
            yield short
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Circulant MinHash: ROWS * BANDS coordinates from one scattering and one shifted permutation of 32 bits."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x7FEB352D)  # sigma
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    low = np.full(len(_SHIFTS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), BLOCK):
        y = x[at : at + BLOCK] + _SHIFTS  # the shift is circular: sums wrap around
        t = y >> np.uint32(16)  # pi
        y ^= t
        y *= np.uint32(0x85EBCA6B)
        np.right_shift(y, np.uint32(13), out=t)
        y ^= t
        y *= np.uint32(0xC2B2AE35)
        np.right_shift(y, np.uint32(16), out=t)
        y ^= t
        np.minimum(low, y.min(axis=1), out=low)
    return low


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each signature and band."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    return mix((parts * _ODD[:ROWS]).sum(axis=2, dtype=np.uint64) + mix(np.arange(BANDS, dtype=np.uint64))).view(np.int64)


def planes(signatures: np.ndarray) -> np.ndarray:
    """For each signature two bits of every coordinate: WORDS words of first bits, then as many of second bits."""
    out = np.zeros((len(signatures), 2, WORDS * 8), np.uint8)
    for k in range(2):
        bits = np.packbits((signatures >> np.uint32(k)) & np.uint32(1), axis=1)
        out[:, k, : bits.shape[1]] = bits
    return out.reshape(len(signatures), 2 * WORDS * 8).view(np.int64)


def may_link(a: str, b: str) -> Column:
    """Whether two signatures' bit planes allow the wanted similarity."""
    x, y = F.col(a), F.col(b)
    unlike = lambda k: F.bit_count(x[k].bitwiseXOR(y[k]).bitwiseOR(x[k + WORDS].bitwiseXOR(y[k + WORDS])))
    return sum((unlike(k) for k in range(1, WORDS)), unlike(0)) <= MOST_UNLIKE


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(r) for r in rows)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))


def sketch(batches):
    """(key, text) to key, number of shingles, a 128-bit hash of the set (h1, h2), the band keys and the bit planes."""
    none = np.zeros((0, len(_SHIFTS)), np.uint32)
    for batch in batches:
        sets = list(shingle_sets(*utf8(batch.column(1))))
        n = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(n)
        signed = np.stack([signature(sets[j]) for j in full]) if len(full) else none
        bands, bits = [np.zeros(0, np.int64)] * len(sets), [np.zeros(0, np.int64)] * len(sets)
        for j, k, b in zip(full, band_keys(signed), planes(signed), strict=True):
            bands[j], bits[j] = k, b
        h1 = np.array([np.sum(s, dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
        h2 = np.array([np.sum(mix(s ^ _ODD[1]), dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(h1), pa.array(h2), _lists(bands), _lists(bits)], ["id", "n", "h1", "h2", "bands", "bits"])


def full_sets(batches):
    """(rep, text, h1) to id (the class) and the shingle hashes, for the text that h1 names."""
    for batch in batches:
        own = [np.sort(s.view(np.int64)) for s in shingle_sets(*utf8(batch.column(1)))]
        h1 = batch.column(2).to_numpy()
        good = [j for j, s in enumerate(own) if np.sum(s, dtype=np.int64) == h1[j]]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int64())), _lists([own[j] for j in good])], ["id", "shingles"])


def sizes_of(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("size"))


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id of each id's component, for the ids of edges (a, b). Labels spread along edges and jump."""
    both = scratch.save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.save(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("comp")))
    ends = scratch.save(sizes_of(both, "b"))
    while True:
        near = spread_join(both, labels.select(F.col("id").alias("b"), "comp"), ["b"], ends, "a").groupBy("a").agg(F.min("comp").alias("near"))
        spread = scratch.save(labels.join(near, F.col("id") == F.col("a")).select("id", "comp", F.least("comp", "near").alias("to")))
        jump = labels.select(F.col("id").alias("to"), F.col("comp").alias("jump"))
        new = scratch.save(spread_join(spread, jump, ["to"], sizes_of(spread, "to"), "id").select("id", F.col("comp").alias("old"), F.least("to", "jump").alias("comp")))
        same = not new.where(F.col("old") != F.col("comp")).limit(1).count()
        old, labels = labels, new.select("id", "comp")
        labels.scratch_path = new.scratch_path
        scratch.drop(old, spread)
        if same:
            scratch.drop(both, ends)
            return labels


def relabel(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels (id, comp), a written table, after the components found among comps."""
    found = found.select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    return spread_join(labels, found, ["comp"], sizes_of(labels, "comp"), "id", "left").select("id", F.coalesce("to", "comp").alias("comp"))


def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b), a written table, whose full sets are similar enough. A class that many others meet is met in many tasks."""
    left, right = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    both = spread_join(pairs, left, ["a"], sizes_of(pairs, "a"), "b")
    both = spread_join(both, right, ["b"], sizes_of(pairs, "b"), "a").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return both.where(100 * F.col("common") >= PERCENT * (F.size("set_a") + F.size("set_b") - F.col("common"))).select("a", "b")


def rare_buckets(scratch: Scratch, members: DataFrame, sets: DataFrame, bits: DataFrame) -> DataFrame:
    """(band, side, rep, n, pop, left, bits): members dealt by pairs of size classes and the rarest of their shingles.

    side: 0 for the smaller size class of the bucket's pair, 1 for the larger, 2 if both are the same; only different
    sides meet, but for 2. left: shingles from this one on, in order of frequency. Shingles that one class of texts alone
    has count among the rarest, but need no bucket.
    """
    one = members.groupBy("rep").agg(F.first("n").alias("n"), F.first("pop").alias("pop")).join(bits, "rep")
    items = sets.join(one.select(F.col("rep").alias("id")), "id").select("id", F.explode("shingles").alias("shingle"))
    common = scratch.save(sizes_of(items, "shingle").where("size > 1"))
    ranked = spread_join(items, common, ["shingle"], common, "id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("size", "shingle"))).alias("common"))
    ranked = ranked.join(one, F.col("id") == F.col("rep"))
    size_class = lambda n: F.floor(F.log(n) / math.log(CLASS_WIDTH)).cast("int")
    least = F.ceil(F.col("n") * PERCENT / 100)
    paired = ranked.withColumn("own", size_class(F.col("n")))
    paired = paired.withColumn("other", F.explode(F.sequence(size_class(least), size_class(F.floor(F.col("n") * 100 / PERCENT)))))
    partner = F.greatest(least, F.floor(F.pow(F.lit(CLASS_WIDTH), F.col("other"))))
    paired = paired.withColumn("needed", (F.size("common") - _overlap(F.col("n"), partner) + 1).cast("int")).where("needed > 0")
    dealt = paired.select("rep", "n", "pop", "bits", "own", "other", F.size("common").alias("k"), F.posexplode(F.slice("common", F.lit(1), F.col("needed"))).alias("i", "at"))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    band = F.xxhash64("at.shingle", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select(band.alias("band"), side.alias("side"), "rep", "n", "pop", (F.col("k") - F.col("i")).cast("long").alias("left"), "bits")


def _overlap(n, m):
    """Shingles that sets of n and m must share."""
    return F.ceil((n + m) * PERCENT / (100 + PERCENT))


def _alike(n: str, m: str):
    """Set sizes that allow the similarity."""
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def cluster(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: id, n (shingles) and component (the smallest key reachable)."""
    ship(spark)
    bounded_batches(spark)
    scratch = Scratch(spark, "near_dedup")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = scratch.save(texts.mapInArrow(sketch, "id long, n long, h1 long, h2 long, bands array<long>, bits array<long>"))
    classes = scratch.save(rows.where("n > 0 AND id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("id").alias("key"), F.any_value("bands").alias("bands"), F.any_value("bits").alias("bits")).withColumn("rep", F.monotonically_increasing_id()))

    banded = classes.select("rep", F.explode("bands").alias("band"))
    shared = scratch.save(sizes_of(banded, "band").where("size > 1"))
    members = scratch.save(spread_join(banded, shared, ["band"], shared, "rep"))
    popular = members.groupBy("rep").agg(F.sum("size").alias("pop"))
    members = scratch.save(members.join(popular.join(classes.select("rep", "n"), "rep"), "rep").select("band", "rep", "n", "pop"))

    wanted = members.select("rep").distinct().join(classes.select("rep", "h1", F.col("key").alias("id")), "rep")
    sets = texts.join(wanted, "id").select("rep", "text", "h1").mapInArrow(full_sets, "id long, shingles array<long>")
    sets = scratch.save(sets)

    # First round: each class meets the most popular class among its buckets.
    top = members.groupBy("band").agg(F.max(F.struct("pop", (-F.col("rep")).alias("minus"), F.col("n").alias("m"))).alias("top"))
    met = spread_join(members, top, ["band"], shared, "rep").where((F.col("rep") != -F.col("top.minus")) & _alike("n", "top.m"))
    first = met.groupBy("rep").agg(F.max("top").alias("top")).select((-F.col("top.minus")).alias("a"), F.col("rep").alias("b"))
    first = scratch.save(first)
    found = components(scratch, scratch.save(links(first, sets)))
    own = scratch.save(members.select(F.col("rep").alias("id"), F.col("rep").alias("comp")).distinct())
    labels = scratch.save(relabel(own, found))

    def unsettled(left: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows (band, side, rep, n, pop, left, ...), with comp, of buckets that hold several components and can have pairs; and the buckets' sizes."""
        left = left.join(labels.select(F.col("id").alias("rep"), "comp"), "rep")
        mixed = left.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("side").alias("first"), F.max("side").alias("last"), F.count(F.lit(1)).alias("size"))
        mixed = scratch.save(mixed.where("low < high AND (first < last OR first = 2)").select("band", "size"))
        return scratch.save(spread_join(left, mixed.select("band"), ["band"], mixed, "rep").select(*left.columns)), mixed

    mixed, sizes = unsettled(members.withColumn("side", F.lit(2)).withColumn("left", F.col("n")))
    scratch.drop(members, sizes)
    (left, sizes), slots, turn = unsettled(scratch.save(rare_buckets(scratch, mixed, sets, classes.select("rep", "bits")))), 8, 0
    scratch.drop(mixed)
    while left.limit(1).count():
        slot = F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(slots))
        chosen = F.max(F.struct("pop", (-F.col("rep")).alias("minus"), F.col("n").alias("m"), F.col("comp").alias("other"), F.col("left").alias("right"), F.col("bits").alias("face"))).alias("top")
        centers = left.groupBy("band", "side", slot.alias("slot")).agg(chosen)
        centers = scratch.save(centers.select("band", F.col("side").alias("facing"), (-F.col("top.minus")).alias("center"), "top.m", "top.other", "top.right", "top.face"))
        meets = (F.col("comp") != F.col("other")) & ((F.col("side") == 2) | (F.col("side") != F.col("facing"))) & _alike("n", "m")
        meets = meets & (F.least("left", "right") >= _overlap(F.col("n"), F.col("m")))  # else this is not their first common shingle, or they share too few
        pairs = spread_join(left, centers, ["band"], sizes, "rep").where(meets & may_link("bits", "face")).select(F.least("rep", "center").alias("a"), F.greatest("rep", "center").alias("b")).distinct()
        pairs = scratch.save(pairs)
        ends = [labels.select(F.col("id").alias(x), F.col("comp").alias(f"comp_{x}")) for x in "ab"]
        edges = links(pairs, sets).join(ends[0], "a").join(ends[1], "b").select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct()
        edges = scratch.save(edges)
        if edges.limit(1).count():
            labels = scratch.save(relabel(labels, components(scratch, edges)))
        rest = left.drop("comp").join(centers.select("band", F.col("center").alias("rep")), ["band", "rep"], "left_anti")
        old, (left, now) = left, unsettled(rest)
        scratch.drop(old, centers, pairs, edges, sizes)
        sizes, slots, turn = now, slots * 8, turn + 1
    scratch.drop(sets, left, sizes)

    known = classes.drop("bands", "bits").join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    several = rows.where("id IS NOT NULL").groupBy("id").agg(*(f(c).alias(f"{k}_{c}") for k, f in (("low", F.min), ("high", F.max)) for c in ("n", "h1", "h2")))
    several = scratch.save(several.where("low_n < high_n OR low_h1 < high_h1 OR low_h2 < high_h2").select("id"))
    repeats = several.limit(1).count() > 0
    if repeats:
        own = scratch.save(rows.join(several, "id").join(known, ["h1", "h2", "n"]).select("id", "comp").distinct())
        edges = own.groupBy("id").agg(F.min("comp").alias("a")).join(own.withColumnRenamed("comp", "b"), "id").where("a < b").select("a", "b").distinct()
        found = components(scratch, scratch.save(edges)).select(F.col("id").alias("comp"), F.col("comp").alias("to"))
        known = known.join(found, "comp", "left").withColumn("comp", F.coalesce("to", "comp"))
    known = scratch.save(known.select("h1", "h2", "n", "key", "comp"))
    names = known.groupBy("comp").agg(F.min("key").alias("component"))
    named = spread_join(known, names, ["comp"], sizes_of(known, "comp"), "key").select("h1", "h2", "n", "component")
    own = rows.select("id", "n", "h1", "h2")
    some = "n > 0 AND id IS NOT NULL"
    full, none = own.where(some), own.where(f"NOT ({some})").withColumn("component", F.lit(None).cast("long"))
    sizes = full.groupBy("h1", "h2", "n").agg(F.count(F.lit(1)).alias("size"))
    out = spread_join(full, named, ["h1", "h2", "n"], sizes, "id").unionByName(none)
    if repeats:  # rows without words go where their key's other texts are
        own = out.join(several, "id").groupBy("id").agg(F.min("component").alias("other"))
        out = out.join(own, "id", "left").withColumn("component", F.coalesce("component", "other"))
    return out.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def deduplicate(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component the document with the smallest key (rows without a key stay)."""
    gone = cluster(spark, docs, key, text).where("id <> component").select(F.col("id").alias(free_name(docs, "_gone")))
    return docs.join(gone, F.col(key) == gone[gone.columns[0]], "left_anti")
