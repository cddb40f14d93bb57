"""Connected components of cells or points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Edges of a node, or nodes of a component, that one task takes, about: those of a hub are dealt to several tasks.
SHARE = 1 << 20


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b). Labels spread along edges and jump to their label's label.

    checkpoint() cuts the lineage of each round, in the folder that spark.checkpoint.dir names.
    """
    way = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    # Both ways by explode(): edges are computed once, and what Spark knows of them (a <> b and the like) doesn't grow from round to round.
    both = edges.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("e")).select("e.a", "e.b").distinct().checkpoint()
    hubs = both.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("parts")).where("parts > 1").checkpoint()
    hot = hubs.count()  # each has SHARE edges, so few are
    if hot:
        both = both.join(F.broadcast(hubs), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")).checkpoint()
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component")).checkpoint()
    salts = -(-labels.count() // SHARE)
    while True:
        ends = labels.select(F.col("id").alias("b"), "component")
        if hot:  # a hub's label is there once for each part of its edges
            ends = ends.join(F.broadcast(hubs), "b", "left").select("b", "component", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
        near = both.join(ends, ["b", "part"] if hot else "b").groupBy("a").agg(F.min("component").alias("near"))
        spread = labels.join(near, F.col("id") == F.col("a")).select("id", F.col("component").alias("old"), F.least("component", "near").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("component").alias("jump"))
        if salts > 1:  # only labels are jumped to: copies of their rows meet the nodes of a wide component in many tasks
            jump = jump.join(spread.select("to").distinct(), "to", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            spread = spread.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
        new = spread.join(jump, ["to", "salt"] if salts > 1 else "to").select("id", "old", F.least("to", "jump").alias("component")).checkpoint()
        labels = new.select("id", "component")
        if new.where("old <> component").isEmpty():
            return labels
