"""Exact dedup against a persistent digest index.

The index is a table of one row per distinct text, bucketed and sorted by the text's SHA-256, so that new data meets it
in a sort-merge anti-join for which the index isn't shuffled (a bucket that several batches added to is sorted in its task).
New digests are appended in the same buckets.

Rows of a batch are first reduced to one row per digest (with partial aggregation, so a text with a third of all rows
shuffles as one row per task); only these meet the index. When rows get their decision back, the digests that hold more than a
1,000th of all rows, of which there can be 1,000 at most, are dealt to many tasks.

Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts in a batch, the row with
the largest doc_id stays; null ids are the smallest; of rows that share id and text, one stays. A text that an earlier
batch brought is dropped for the document kept then; batches in descending order of ids (descending()) thus keep the largest id
of all. An empty table gives an empty result. Columns of docs may have any names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, delete, free_name, scratch_root, spread_join, whole


def digest(text: Column) -> Column:
    """SHA-256 (binary) of the normalised text."""
    return F.unhex(F.sha2(ascii_lower(whole(text)), 256))


#: Rows of a bucket, about: 100 MB of digests and ids.
BUCKET_ROWS = 2_000_000


class DigestIndex:
    """The table `name`: digest, keep_id and the batch that brought it.

    rows: documents that the index is made for; it gets a bucket for each BUCKET_ROWS of them, and 24 at least. An index that
    exists keeps its buckets. Its files are in a folder of its name in root, by default the shared folder that spark.checkpoint.dir
    names, never in a warehouse on some machine's own disk. Name a root that outlives the job for an index that later jobs use; where the catalog
    has forgotten the table, the same name, root and rows take the files up again.
    """

    def __init__(self, spark: SparkSession, name: str, rows: int = 0, root: str | None = None):
        self.spark, self.name, self.buckets = spark, name, max(24, -(-rows // BUCKET_ROWS))
        self.path = f"{(root or scratch_root(spark)).rstrip('/')}/{name}"
        if spark.catalog.tableExists(name):
            detail = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
            self.buckets = int(detail["Num Buckets"])
        else:
            buckets = self.buckets
            spark.sql(
                f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
            )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame, batch: str) -> DataFrame:
        """Rows of groups whose digest no other batch brought."""
        return groups.join(self.rows().where(F.col("batch") != batch).select("digest").hint("merge"), "digest", "left_anti")

    def seen(self, groups: DataFrame, batch: str) -> DataFrame:
        return groups.join(self.rows().where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("earlier")).hint("merge"), "digest")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add digests; those that this batch already added, before a failure, aren't added again."""
        own = self.rows().where(F.col("batch") == batch).select("digest").hint("merge")
        new = groups.join(own, "digest", "left_anti").select("digest", "keep_id", F.lit(batch).alias("batch"))
        new.repartition(self.buckets, "digest").write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def settle(spark: SparkSession, docs: DataFrame, index: DigestIndex, batch: str, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Tables of rows (doc_id, digest, row) and of their groups (digest, keep_id, keep_row: null if an earlier batch has the text, group_size). The index grows."""
    scratch = Scratch(spark, "exact_dedup")
    rows = scratch.save(docs.select(F.col(key).alias("doc_id"), digest(F.col(text)).alias("digest"), F.monotonically_increasing_id().alias("row")))
    groups = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("digest", F.col("top.doc_id").alias("keep_id"), F.col("top.row").alias("keep_row"), "group_size")
    seen = index.seen(groups, batch).select("digest", F.col("earlier").alias("keep_id"), F.lit(None).cast("long").alias("keep_row"), "group_size")
    decided = scratch.save(index.unseen(groups, batch).unionByName(seen))
    index.append(decided.where(F.col("keep_row").isNotNull()), batch)
    return rows, decided


def join_back(rows: DataFrame, decided: DataFrame) -> DataFrame:
    out = spread_join(rows, decided, ["digest"], decided.select("digest", F.col("group_size").alias("size")), "row")
    return out.select("doc_id", "digest", "keep_id", "group_size", F.col("row").eqNullSafe(F.col("keep_row")).alias("kept"))


def decide(spark: SparkSession, docs: DataFrame, index: DigestIndex, batch: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, digest, keep_id, group_size (rows of the batch with that text), kept. The index grows."""
    return join_back(*settle(spark, docs, index, batch, key, text))


def descending(docs: DataFrame, parts: int, key: str = "doc_id") -> list[DataFrame]:
    """docs cut into parts by whole-numbered key: the largest keys first, null keys last."""
    low, high = docs.agg(F.min(key), F.max(key)).first()
    if low is None or parts < 2:
        return [docs]
    cuts = sorted({low + (high - low + 1) * k // parts for k in range(1, parts)} - {low}, reverse=True)
    k = F.col(key)
    above = [docs.where(k >= cut) if i == 0 else docs.where((k >= cut) & (k < cuts[i - 1])) for i, cut in enumerate(cuts)]
    return [*above, docs.where(k.isNull() | (k < cuts[-1])) if cuts else docs]


def decide_batches(spark: SparkSession, batches: list[DataFrame], index: DigestIndex, name: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """decide() over batches in turn, each against what the index holds by then; group_size counts the rows of all of them."""
    rows, groups = [], []
    for k, batch in enumerate(batches):
        own, decided = settle(spark, batch, index, f"{name}-{k}", key, text)
        rows.append(own.withColumn("row", F.struct(F.lit(k).alias("batch"), F.col("row"))))
        groups.append(decided.withColumn("keep_row", F.when(F.col("keep_row").isNotNull(), F.struct(F.lit(k).alias("batch"), F.col("keep_row").alias("row")))))
    every = reduce(DataFrame.unionByName, groups).groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("keep_row").alias("keep_row"), F.sum("group_size").alias("group_size"))
    return join_back(reduce(DataFrame.unionByName, rows), Scratch(spark, "exact_dedup").save(every))


def deduplicate(spark: SparkSession, docs: DataFrame, index: DigestIndex, batch: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with the columns of docs. Texts shuffle once, by digest and id, so a hot text spreads."""
    d, k, row = (free_name(docs, x) for x in ("_digest", "_kept", "_row"))
    keep = decide(spark, docs, index, batch, key, text).where("kept").select(F.col("digest").alias(d), F.col("doc_id").alias(k))
    keyed = docs.withColumn(d, digest(F.col(text)))
    rows = keyed.join(keep, (keyed[d] == keep[d]) & keyed[key].eqNullSafe(keep[k]), "left_semi")
    # The text in a struct, which is never null: max_by ignores rows whose ordering value is.
    one = rows.groupBy(d, key).agg(F.max_by(F.struct(*(F.col(c) for c in docs.columns)), F.struct(F.col(text))).alias(row))
    return one.select(*(F.col(row)[c].alias(c) for c in docs.columns))
