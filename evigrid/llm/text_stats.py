"""Statistics of whole texts as native Spark columns.

Every expression runs in the JVM on one row at a time: no shuffle, no Python worker. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free_name, let, whole, words

#: Words in a window whose repetition counts.
WINDOW = 8


def window_hashes(w: Column, n: int = WINDOW) -> Column:
    """A 64-bit hash of each run of n words; two different runs of one text share one with a chance below 1e-10."""
    return F.when(
        F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
    ).otherwise(F.array().cast("array<bigint>"))


def covered_words(hashes: Column, n: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more: sorted hashes show the repeated ones, their starts in order the words."""

    def repeated(s: Column) -> Column:
        same = lambda e, k: F.get(s, k)["h"].eqNullSafe(e["h"])
        return F.sort_array(F.transform(F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    start = F.struct(F.lit(-n).alias("last"), F.lit(0).alias("total"))
    step = lambda a, i: F.struct(i.alias("last"), (a["total"] + F.least(F.lit(n), i - a["last"])).alias("total"))
    return let(ordered, lambda s: F.aggregate(repeated(s), start, step, lambda a: a["total"]))


def with_stats(df: DataFrame, text: str = "text", name: str = "stats", repeats: bool = True) -> DataFrame:
    """df and a struct column of statistics; with repeats=False without n_repeat_words, the costliest."""
    t, w, h, lines = (free_name(df, x) for x in ("_t", "_w", "_h", "_lines"))
    df = df.withColumn(t, whole(F.col(text)))
    df = df.withColumn(w, words(F.col(t)))
    df = df.withColumn(lines, F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t-\r]")))
    if repeats:
        df = df.withColumn(h, window_hashes(F.col(w)))
        repeated = F.when(F.size(F.array_distinct(h)) < F.size(h), covered_words(F.col(h))).otherwise(0).cast("long")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    stats = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(t, SPACES, "")).cast("long").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        count("!").alias("n_exclamations"),
        count(r"[A-Z]").alias("n_capitals"),
        count(r"[.?,;:]").alias("n_stops"),
        count(r"[0-9]").alias("n_digits"),
        *([repeated.alias("n_repeat_words")] if repeats else []),
    )
    return df.withColumn(name, stats).drop(t, w, h, lines)
