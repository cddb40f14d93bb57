"""Evidence per cell, order-dependent folds, and windows over sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar


def clamped_fold(df: DataFrame, key: str, order: list[str], amount: Column, bound: float = 10.0, part: Column | None = None) -> DataFrame:
    """h <- clamp(h + amount) in order, per key.

    A run of such steps is itself a step h -> clamp(h + a, low, high), so the rows of a key are folded part by part (part must
    rise with the order, e.g. a day), and a key's few parts one after the other: no row holds more than one part of a key.
    """
    items = F.sort_array(F.collect_list(F.struct(*order, amount.alias("a"))))
    state = lambda a, low, high: F.struct(a.alias("a"), low.alias("low"), high.alias("high"))
    step = lambda s, e: state(s["a"] + e["a"], scalar.clamp(s["low"] + e["a"], -bound, bound), scalar.clamp(s["high"] + e["a"], -bound, bound))
    parts = df.groupBy(key, (F.lit(0) if part is None else part).alias("part")).agg(items.alias("items"), F.count(F.lit(1)).alias("n"))
    parts = parts.select(key, "part", "n", F.aggregate("items", state(F.lit(0.0), F.lit(-bound), F.lit(bound)), step).alias("s"))
    runs = F.sort_array(F.collect_list(F.struct("part", "s.a", "s.low", "s.high")))
    fold = F.aggregate(runs, F.lit(0.0), lambda h, s: F.least(F.greatest(h + s["a"], s["low"]), s["high"]))
    return parts.groupBy(key).agg(F.round(fold, 6).alias("h"), F.sum("n").alias("n"))


def moving_average(df: DataFrame, key: str, order: list[str], value: Column, alpha: float, part: Column | None = None) -> DataFrame:
    """Exponential moving average from 0, in order, per key. Parts as in clamped_fold(): m steps take h to (1 - alpha)^m h + b."""
    items = F.sort_array(F.collect_list(F.struct(*order, value.alias("v"))))
    parts = df.groupBy(key, (F.lit(0) if part is None else part).alias("part")).agg(items.alias("items"), F.count(F.lit(1)).alias("n"))
    parts = parts.select(key, "part", "n", F.aggregate("items", F.lit(0.0), lambda m, e: (1 - alpha) * m + alpha * e["v"]).alias("b"))
    runs = F.sort_array(F.collect_list(F.struct("part", "n", "b")))
    return parts.groupBy(key).agg(F.round(F.aggregate(runs, F.lit(0.0), lambda h, s: F.pow(F.lit(1 - alpha), s["n"]) * h + s["b"]), 6).alias("ema"))


def dirichlet_update(df: DataFrame, keys: list[str], weight: Column, classes: int) -> DataFrame:
    """alpha = 1 + sum of weight * p for each class: a plain sum, combined on the map side."""
    return df.groupBy(*keys).agg(*(F.round(1 + F.sum(weight * F.col("p")[k]), 6).alias(f"alpha{k}") for k in range(classes)))


def running_mode(df: DataFrame, key: str, item: str, order: list[str]) -> DataFrame:
    """Temporal uncertainty at each row: 1 - the highest count of an item of the key so far / rows so far; 0.5 at the first."""
    so_far = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("seen", F.count(F.lit(1)).over(so_far(key, item))).withColumn("n", F.count(F.lit(1)).over(so_far(key)))
    out = out.withColumn("most", F.max("seen").over(so_far(key)))
    return out.withColumn("u_temporal", F.round(F.when(F.col("n") == 1, 0.5).otherwise(1 - F.col("most") / F.col("n")), 6)).drop("seen")


def rolling_rate(df: DataFrame, key: str, ts: str, tie: str, rows: int = 30) -> DataFrame:
    """Rows per second over the last rows of a key, and the mean gap."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    seconds = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz")) / 1e6
    out = df.select(key, tie, seconds.alias("s"), (seconds - F.lag(seconds).over(w)).alias("gap"), F.col(ts))
    last = w.rowsBetween(1 - rows, 0)
    span = F.max("s").over(last) - F.min("s").over(last)
    rate = F.when(span > 0, (F.count(F.lit(1)).over(last) - 1) / span)
    return out.select(key, tie, F.round(rate, 9).alias("rate"), F.round(F.avg("gap").over(last), 3).alias("mean_gap"))


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, tie: str) -> DataFrame:
    """left with the last value of right at or before its time, per key; rows without one go. Two inputs, one shuffle, one sort."""
    both = left.select(key, ts, F.col(tie).alias("tie"), F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("side"))
    both = both.unionByName(right.select(key, ts, F.col(value).cast("bigint").alias("tie"), value, F.lit(0).alias("side")))
    w = Window.partitionBy(key).orderBy(ts, "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("found", F.last(value, ignorenulls=True).over(w)).where("side = 1 AND found IS NOT NULL")
    return out.select(key, F.col("tie").alias(tie), F.col("found").alias(value))


def time_sync(left: DataFrame, right: DataFrame, key: str, ts: str, tie: str, most: int) -> DataFrame:
    """Each row of left with the row of right nearest in time, at most `most` microseconds away, per key: left_id, right_id, gap.

    Times are put in slots of that width; a row of right stands in three, so the join is an equi-join on key and slot.
    """
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))
    a = left.select(key, F.col(tie).alias("left_id"), at.alias("s")).withColumn("slot", F.floor(F.col("s") / most))
    b = right.select(key, F.col(tie).alias("right_id"), at.alias("t"))
    b = b.withColumn("slot", F.explode(F.array(*(F.floor(F.col("t") / most) + d for d in (-1, 0, 1)))))
    gap = F.abs(F.col("s") - F.col("t"))
    near = a.join(b, [key, "slot"]).where(gap <= most).groupBy("left_id").agg(F.min(F.struct(gap.alias("gap"), F.col("right_id"))).alias("m"))
    return near.select("left_id", "m.right_id", "m.gap")


def dynamic_status(df: DataFrame, key: str, item: str, ts: str, ties: list[str], window: float, alpha: float = 0.1, part: Column | None = None) -> DataFrame:
    """Per key, in order: changes of item less than `window` seconds after the last change (the first change never counts, as time starts at 0), dynamic from two on, and the occupancy average.

    Whether a change counts depends on the one before only, so a run of rows is summed up by its first and last item, its first row's time, its
    first and last change and the count behind the first: a key's rows are folded part by part (as in clamped_fold()), then
    its parts' sums. The average has a closed form.
    """
    seconds = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz")) / 1e6
    items = F.sort_array(F.collect_list(F.struct(F.col(ts), *ties, F.col(item).alias("c"), seconds.alias("t"))))
    none = F.lit(None).cast("double")
    state = lambda c, first, last, n: F.struct(c.alias("c"), first.alias("first"), last.alias("last"), n.alias("n"))

    def step(s: Column, e: Column) -> Column:
        changed = e["c"] != s["c"]
        near = F.coalesce(changed & (e["t"] - s["last"] < window), F.lit(False))
        return state(e["c"], F.when(changed, F.coalesce(s["first"], e["t"])).otherwise(s["first"]), F.when(changed, e["t"]).otherwise(s["last"]), s["n"] + near.cast("long"))

    parts = df.groupBy(key, (F.lit(0) if part is None else part).alias("part")).agg(items.alias("items"))
    first = F.col("items")[0]
    inner = F.aggregate(F.slice("items", F.lit(2), F.size("items")), state(first["c"], none, none, F.lit(0).cast("long")), step)
    parts = parts.select(key, "part", F.size("items").cast("long").alias("m"), first["c"].alias("begin"), first["t"].alias("t"), inner.alias("s"))
    runs = F.sort_array(F.collect_list(F.struct("part", "begin", "t", F.col("s.c").alias("c"), "s.first", "s.last", "s.n")))

    def join(s: Column, e: Column) -> Column:
        met = F.coalesce(e["begin"] != s["c"], F.lit(False))
        at = F.when(met, e["t"]).otherwise(s["last"])
        n = s["n"] + (met & (e["t"] - s["last"] < window)).cast("long") + F.coalesce((e["first"] - at < window).cast("long"), F.lit(0)) + e["n"]
        return state(e["c"], none, F.coalesce(e["last"], at), n)

    begin = state(F.lit(None).cast(df.schema[item].dataType), none, F.lit(0.0), F.lit(0).cast("long"))
    s = parts.groupBy(key).agg(runs.alias("runs"), F.sum("m").alias("frames")).withColumn("s", F.aggregate("runs", begin, join))
    occupancy = 1 - F.pow(F.lit(1 - alpha), F.col("frames"))
    return s.select(key, "frames", F.col("s.n").alias("transitions"), (F.col("s.n") >= 2).alias("dynamic"), F.round(occupancy, 6).alias("occupancy"), F.col("s.last").alias("last_change"))


def decay_transitions(status: DataFrame, now: Column, window: float, period: float) -> DataFrame:
    """status after a call every `period` seconds up to now: each that comes more than window after the last change takes one transition away, down to 0; below two nothing is dynamic."""
    calls = F.greatest(F.ceil(now / period) - 1 - F.floor((F.col("last_change") + window) / period), F.lit(0))
    left = F.greatest(F.col("transitions") - calls, F.lit(0)).cast("long")
    return status.withColumn("transitions", left).withColumn("dynamic", F.col("dynamic") & (F.col("transitions") >= 2))


def evict(df: DataFrame, key: str, ts: str, age: str, most: int) -> DataFrame:
    """Rows of the histories that stay: keys touched within age of the newest row, and of those the `most` touched last (the largest key of equals)."""
    last = df.groupBy(key).agg(F.max(ts).alias("last"))
    fresh = last.where(F.col("last") >= df.agg(F.max(ts) - F.expr(f"INTERVAL {age}")).scalar())
    kept = fresh.orderBy(F.desc("last"), F.desc(key)).limit(most)
    return df.join(kept.select(key), key, "left_semi")


def sync_many(frames: list[DataFrame], key: str, ts: str, tie: str, most: int) -> DataFrame:
    """Tuples of three or more inputs: each row of the first with the nearest row of every other one, at most `most` microseconds away; rows that lack one go. Columns id_0, id_1, ..., and spread (the largest gap)."""
    out = frames[0].select(F.col(tie).alias("left_id"))
    for k, other in enumerate(frames[1:], 1):
        near = time_sync(frames[0], other, key, ts, tie, most).select("left_id", F.col("right_id").alias(f"id_{k}"), F.col("gap").alias(f"gap_{k}"))
        out = out.join(near, "left_id")
    gaps = [F.col(f"gap_{k}") for k in range(1, len(frames))]
    return out.select(F.col("left_id").alias("id_0"), *(f"id_{k}" for k in range(1, len(frames))), (F.greatest(*gaps) if len(gaps) > 1 else gaps[0]).alias("spread"))


def latest_per_trigger(df: DataFrame, key: str, ts: str, tie: str, seconds: int) -> DataFrame:
    """Under load only the newest row of a key in each trigger of so many seconds is worked on; dropped: how many went."""
    trigger = F.window(ts, f"{seconds} seconds")["start"].alias("trigger")
    return df.groupBy(key, trigger).agg(F.max(F.struct(ts, tie))[tie].alias(tie), (F.count(F.lit(1)) - 1).alias("dropped"))


def lookup(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, tie: str, seconds: float, fallback: DataFrame | None = None) -> DataFrame:
    """as_of() with a timeout: values older than so many seconds don't count. Then rows take the value of their key in fallback (key, value), and go if that has none either."""
    stamped = right.withColumn(value, F.struct(F.col(ts).alias("at"), F.col(value).alias("v")))
    both = left.select(key, ts, F.col(tie).alias("tie"), F.lit(None).cast(stamped.schema[value].dataType).alias(value), F.lit(1).alias("side"))
    both = both.unionByName(stamped.select(key, ts, F.lit(0).cast("bigint").alias("tie"), value, F.lit(0).alias("side")))
    w = Window.partitionBy(key).orderBy(ts, "side", value, "tie").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("found", F.last(value, ignorenulls=True).over(w)).where("side = 1")
    age = F.timestamp_diff("MICROSECOND", F.col("found.at").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz")) / 1e6
    out = out.select(key, F.col("tie").alias(tie), F.when(age <= seconds, F.col("found.v")).alias(value))
    if fallback is not None:
        out = out.join(fallback.select(key, F.col(value).alias("otherwise")), key, "left").withColumn(value, F.coalesce(value, "otherwise")).drop("otherwise")
    return out.where(F.col(value).isNotNull())
