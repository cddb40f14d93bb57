"""The test tables as observations: points, class probabilities, event streams; text maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z, u, class, ts of lineitem."""
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_discount") * 100).alias("z"),
        (F.col("l_tax") / 0.08).alias("u"),
        (flag * 2 + F.when(F.col("l_linestatus") == "F", 0).otherwise(1)).alias("class"),
        F.col("l_shipdate").alias("ts"),
    )


def vectors(spark: SparkSession, sf_dir: str, n: int = 10, scale: float = 8.0) -> DataFrame:
    """id, label, x, y, z and logits (array<double>) of embeddings."""
    e = F.col("embedding")
    at = [e[i].cast("double") for i in range(3)]
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "label", *(c.alias(k) for c, k in zip(at, "xyz", strict=True)), F.transform(F.slice(e, 1, n), lambda v: v.cast("double") * scale).alias("logits")
    )


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """Text map: x y z class [confidence, 1 if missing], separated by white space; # starts a comment."""
    parts = F.split(F.trim(F.col("value")), r"\s+")
    rows = spark.read.text(path).where(~F.ltrim("value").startswith("#") & (F.trim("value") != "")).select(parts.alias("p"))
    return rows.select(*(F.get("p", F.lit(i)).cast("double").alias(k) for i, k in enumerate("xyz")), F.get("p", F.lit(3)).cast("int").alias("class"), F.coalesce(F.get("p", F.lit(4)).cast("double"), F.lit(1.0)).alias("confidence"))


def write_map(df: DataFrame, path: str) -> None:
    """The form that read_map reads."""
    df.select(F.format_string("%s %s %s %d %s", "x", "y", "z", "class", "confidence")).write.text(path)
