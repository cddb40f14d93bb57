"""URL filters: host and path rules, and exact membership in a list of keys by a cascade of Bloom filters.

The first filter encodes the listed keys; the second the keys of the corpus that the first takes for listed although
they aren't; the third the listed keys that the second takes for such errors, and so on until no error is left. Since
the levels are built over every key that the corpus holds, a key of the corpus gets the right answer, without a join.

Filters are built by native aggregation (bit_or of words) and read as scalar subqueries, so probing is part of the scan.
Their size is known before they are built: bits are proportional to the keys of the level. Beyond MOST_BITS the list
is met by a join instead, with the same result; the rows of a hot host are then dealt to many tasks.

Null urls and urls without :// have an empty host and path; no rule fits them, and the empty key is never listed. Repeated
rows get the same verdict. An empty table gives an empty result; an empty list lists nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, free_name, spread_join, whole

#: (verdict, rule): host and path, as the rule's first / divides them.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

BITS_PER_KEY, PROBES, MOST_BITS = 12, 6, 1 << 27


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(whole(url), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(whole(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (of equals, the first) and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def positions(key: Column, level: int, bits: int) -> list[Column]:
    """Bit positions of a key; bits is a power of two."""
    return [F.xxhash64(key, F.lit(level), F.lit(probe)).bitwiseAND(F.lit(bits - 1)) for probe in range(PROBES)]


def build(spark: SparkSession, keys: DataFrame, n: int, level: int) -> tuple[DataFrame, int]:
    """One row, bits: array<bigint>, and the number of bits."""
    bits = max(64, 1 << (n * BITS_PER_KEY - 1).bit_length())
    set_ = keys.select(F.explode(F.array(*positions(F.col("key"), level, bits))).alias("at"))
    set_ = set_.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bits"))
    some = set_.groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))
    every = some.unionByName(spark.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")))
    words = every.groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))
    return words.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits")), bits


def might_contain(key: Column, filter_: Column, level: int, bits: int) -> Column:
    out = F.lit(True)
    for at in positions(key, level, bits):
        word = F.get(filter_, F.shiftright(at, 6).cast("int"))
        out = out & (F.call_function("getbit", word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return out


class Cascade:
    """Exact membership for every key of the universe it was built over."""

    def __init__(self, spark: SparkSession, universe: DataFrame, most_bits: int = MOST_BITS):
        """universe: key and listed (boolean), each key once."""
        scratch = Scratch(spark, "url_filter")
        self.keys = scratch.save(universe.select("key", "listed"))
        self.levels: list[tuple[DataFrame, int]] | None = []
        code, test = self.keys.where("listed").select("key"), self.keys.where(~F.col("listed")).select("key")
        while n := code.count():
            if n * BITS_PER_KEY > most_bits:
                self.levels = None
                return
            filter_, bits = build(spark, code, n, len(self.levels))
            self.levels.append((filter_ := scratch.save(filter_), bits))
            wrong = scratch.save(test.where(might_contain(F.col("key"), filter_.scalar(), len(self.levels) - 1, bits)))
            code, test = wrong, code

    def contains(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """df and a boolean column."""
        if self.levels is None:
            own, row = free_name(df, "_listed"), free_name(df, "_row")
            listed = self.keys.where("listed").select(F.col("key").alias(key), F.lit(True).alias(own))
            sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
            met = spread_join(df.withColumn(row, F.monotonically_increasing_id()), listed, [key], sizes, row, "left")
            return met.select(*df.columns, F.col(own).isNotNull().alias(name))
        inside = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            filter_, bits = self.levels[level]
            inside = F.when(might_contain(F.col(key), filter_.scalar(), level, bits), inside).otherwise(level % 2 == 1)
        return df.withColumn(name, inside)


def judge(spark: SparkSession, pages: DataFrame, listed: Column, url: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule and verdict; a page that no rule fits is blocked if its host is listed.

    listed: a boolean column over `key`, evaluated once for each host, which says what the list holds. Where pages has
    one of these names already, underscores follow the new one.
    """
    host, path, rule, verdict, hit = (free_name(pages, x) for x in ("host", "path", "rule", "verdict", "_hit"))
    out = pages.withColumn(host, host_of(F.col(url))).withColumn(path, path_of(F.col(url)))
    universe = out.select(F.col(host).alias("key")).distinct().withColumn("listed", (F.col("key") != "") & F.coalesce(listed, F.lit(False)))
    out = Cascade(spark, universe).contains(out, host, hit)
    named, ruled = rule_of(F.col(host), F.col(path), rules)
    out = out.withColumn(rule, named).withColumn(verdict, F.coalesce(ruled, F.when(F.col(hit), "block").otherwise("allow")))
    return out.drop(hit)
