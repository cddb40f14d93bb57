"""Segmentation and calibration metrics, timing and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantiles
from .spatial import nearest_of_all


def labelled(df: DataFrame, classes: int = 255) -> DataFrame:
    """Rows whose gt and pred are classes; 255 is no label."""
    return df.where((F.col("gt") != 255) & F.col("gt").between(0, classes - 1) & F.col("pred").between(0, classes - 1))


def confusion(df: DataFrame, classes: int = 255) -> DataFrame:
    """Counts per gt and pred."""
    return labelled(df, classes).groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("n"))


def class_iou(df: DataFrame, classes: int = 255) -> DataFrame:
    """Per class: intersection, union, IoU and recall, from one confusion table."""
    c = confusion(df, classes)
    sides = c.select(F.col("gt").alias("class"), (F.col("n") * (F.col("gt") == F.col("pred")).cast("long")).alias("hit"), F.col("n").alias("gt_n"), F.lit(0).cast("long").alias("pred_n"))
    sides = sides.unionByName(c.select(F.col("pred").alias("class"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("gt_n"), F.col("n").alias("pred_n")))
    g = sides.groupBy("class").agg(*(F.sum(k).alias(k) for k in ("hit", "gt_n", "pred_n")))
    union = F.col("gt_n") + F.col("pred_n") - F.col("hit")
    return g.select("class", F.col("hit").alias("intersection"), union.alias("union_n"), "gt_n", F.round(F.col("hit") / union, 6).alias("iou"), F.round(F.when(F.col("gt_n") > 0, F.col("hit") / F.col("gt_n")), 6).alias("recall"))


def scores(df: DataFrame, classes: int) -> DataFrame:
    """One row: accuracy, mean class accuracy, and mean IoU over three sets of classes.

    miou: classes that gt or pred has; miou_gt: classes that gt has; miou_all: all, with an IoU of 0 for the absent ones.
    """
    hit, iou, has_gt = F.col("intersection"), F.col("intersection") / F.col("union_n"), F.col("gt_n") > 0
    return class_iou(df, classes).agg(
        F.round(F.coalesce(F.sum(hit) / F.nullif(F.sum("gt_n"), F.lit(0)), F.lit(0.0)), 6).alias("accuracy"),
        F.round(F.avg(F.when(has_gt, hit / F.col("gt_n"))), 6).alias("class_accuracy"),
        F.round(F.avg(iou), 6).alias("miou"),
        F.round(F.avg(F.when(has_gt, iou)), 6).alias("miou_gt"),
        F.round(F.coalesce(F.sum(iou), F.lit(0.0)) / classes, 6).alias("miou_all"),
    )


def position_rmse(pred: DataFrame, gt: DataFrame, res: float, reach: float) -> DataFrame:
    """One row for two clouds (id, x, y, z): matched, rmse_matched and rmse_nearest.

    Matched are the points of pred and gt in one voxel (nearest index; the last id of each side). rmse_nearest goes from each
    point of gt to the nearest of pred, however far; reach is where that search begins.
    """
    at = [F.rint(F.col(k) / res).cast("long").alias(f"i{k}") for k in "xyz"]
    last = lambda df, name: df.groupBy(*at).agg(F.max_by(F.struct("x", "y", "z"), "id").alias(name))
    both = last(pred, "p").join(last(gt, "g"), ["ix", "iy", "iz"])
    d2 = sum(((F.col(f"p.{k}") - F.col(f"g.{k}")) ** 2 for k in "xyz"), F.lit(0.0))
    matched = both.agg(F.count(F.lit(1)).alias("matched"), F.round(F.sqrt(F.avg(d2)), 6).alias("rmse_matched"))
    far = nearest_of_all(gt.select("id", "x", "y", "z"), pred.select("id", "x", "y", "z"), reach)
    return matched.withColumn("rmse_nearest", far.agg(F.round(F.sqrt(F.avg(F.col("distance") ** 2)), 5)).scalar())


def comparison(results: DataFrame, metrics: list[str]) -> DataFrame:
    """A benchmark's table: one row per method, one column per metric, of rows (method, metric, value); the mean of repeated runs."""
    return results.groupBy("method").pivot("metric", metrics).agg(F.round(F.avg("value"), 6))


def calibration(df: DataFrame, bins: int = 15) -> DataFrame:
    """Expected and maximum calibration error over equal bins (low, high] of confidence. 255 is no label."""
    b = df.where("confidence > 0 AND gt <> 255").withColumn("bin", F.ceil(F.col("confidence") * bins))
    g = b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("confidence") - F.avg((F.col("gt") == F.col("pred")).cast("double"))).alias("gap"))
    return g.agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"), F.round(F.max("gap"), 6).alias("mce"), F.sum("n").alias("n"))


def timing(df: DataFrame, by: str, value: str) -> DataFrame:
    v = F.col(value)
    return df.groupBy(by).agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), F.count(v).alias("n"), F.round(1000 / F.avg(v), 6).alias("per_second"))


def summary(df: DataFrame, by: str, value: str, threshold: float) -> DataFrame:
    """Per group: how many, mean, the share above a threshold, and exact percentiles."""
    v, shares = F.col(value), (0.05, 0.25, 0.5, 0.75, 0.95)
    moments = df.groupBy(by).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.avg((v > threshold).cast("double")), 6).alias("above"))
    q = quantiles(df, [by], value, {f"p{round(100 * p)}": p for p in shares})
    return moments.join(q.select(F.col(by).alias("_by"), *(F.round(c, 6).alias(c) for c in q.columns[1:])), F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def uncertainty_info(df: DataFrame, by: str, parts: dict[str, str], total: str, threshold: float, bins: int = 10) -> DataFrame:
    """A frame's uncertainties (by: the frame) in one row: points, how many are above the threshold; minimum, maximum, mean, deviation and median of
    each part (name: column) and of the total; a histogram of the total over [0, 1] in equal bins (the last with its upper end); percentiles of the
    total; correlations between any two parts.

    Moments, bins and correlations come from one aggregation that combines on the map side, ranks from exact selection.
    """
    columns = parts | {"total": total}
    r = lambda c, name: F.round(c, 6).alias(name)
    moments = [r(f(c), f"{name}_{label}") for name, c in columns.items() for label, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))]
    t = F.col(total)
    at = F.least(F.floor(t * bins), F.lit(bins - 1))
    histogram = F.array(*(F.count_if((at == k) & t.between(0, 1)) for k in range(bins))).alias("histogram")
    names = list(parts)
    pairs = [r(F.corr(parts[a], parts[b]), f"corr_{a}_{b}") for i, a in enumerate(names) for b in names[i + 1 :]]
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("num_points"), F.count_if(t > threshold).alias("num_filtered"), *moments, histogram, *pairs)
    long = df.select(by, F.explode(F.create_map(*(x for name, c in columns.items() for x in (F.lit(name), F.col(c).cast("double"))))).alias("what", "value"))
    got = quantiles(long, [by, "what"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95})
    of = lambda name, p: F.max(F.when(F.col("what") == name, F.round(p, 6)))
    ranked = [of(name, "p50").alias(f"{name}_median") for name in columns] + [of("total", f"p{p}").alias(f"percentile_{p}") for p in (25, 50, 75, 90, 95)]
    ranked = got.groupBy(F.col(by).alias("_by")).agg(*ranked)
    return out.join(ranked, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


#: Score ranges of the precision-recall curve; running sums are taken within one, after those of the ranges above.
RANGES = 4096


def auprc(df: DataFrame, p: str, label: str) -> DataFrame:
    """Area under each class's precision-recall curve, one against the rest, by trapezoids over different scores.

    255 is no label; classes without a positive are left out. Counts per score come first; then running sums within ranges
    of scores, so that no task orders all scores of a class. At most RANGES rows per class are broadcast.
    """
    each = df.where((F.col(label) != 255) & (F.col(label) >= 0) & (F.col(label) < F.size(p))).select(F.col(label).alias("gt"), F.posexplode(p).alias("class", "score"))
    s = each.groupBy("class", "score").agg(F.count_if(F.col("gt") == F.col("class")).alias("pos"), F.count(F.lit(1)).alias("n"))
    s = s.withColumn("range", F.least(F.floor(F.col("score") * RANGES), F.lit(RANGES - 1)))
    high = Window.partitionBy("class").orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = s.groupBy("class", "range").agg(F.sum("pos").alias("rp"), F.sum("n").alias("rn"))
    above = ranges.select("class", "range", *(F.coalesce(F.sum(c).over(high), F.lit(0)).alias(f"above_{c}") for c in ("rp", "rn")), F.sum("rp").over(Window.partitionBy("class")).alias("total"))
    within = Window.partitionBy("class", "range").orderBy(F.desc("score"))
    c = s.join(F.broadcast(above.where("total > 0")), ["class", "range"])
    c = c.withColumn("tp", F.sum("pos").over(within) + F.col("above_rp")).withColumn("cnt", F.sum("n").over(within) + F.col("above_rn"))
    before = F.when(F.col("cnt") > F.col("n"), (F.col("tp") - F.col("pos")) / (F.col("cnt") - F.col("n"))).otherwise(1.0)
    area = F.col("pos") / F.col("total") * (F.col("tp") / F.col("cnt") + before) / 2
    return c.groupBy("class").agg(F.round(F.sum(area), 6).alias("auprc"), F.max("total").alias("positives"))


def resize_join(gt: DataFrame, pred: DataFrame, size: tuple[int, int], pred_size: tuple[int, int], image: list[str] | None = None) -> DataFrame:
    """Pixels (u, v) of gt with the nearest pixel of pred, an image of another size; image: further columns that name the image."""
    at = gt.withColumns({f"p{k}": F.floor(F.col(k) * p / s).cast("bigint") for k, s, p in zip("uv", size, pred_size, strict=True)})
    other = pred.select(*(image or []), F.col("u").cast("bigint").alias("pu"), F.col("v").cast("bigint").alias("pv"), "pred")
    return at.join(other, [*(image or []), "pu", "pv"]).drop("pu", "pv")


def csv_matrix(confusion_table: DataFrame, classes: int) -> DataFrame:
    """Confusion counts as one row per true class and one column per predicted class."""
    return confusion_table.groupBy("gt").pivot("pred", list(range(classes))).agg(F.sum("n")).na.fill(0).orderBy("gt")
