"""Helpers shared by the corpus operators: scratch tables, native word splitting, Arrow batch limits."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch that is sent to a Python worker; texts can be long, so batches are kept short.
ARROW_ROWS = 256

#: Bytes of one such batch, about: a batch of long texts ends before its rows do.
ARROW_BYTES = 1 << 22

#: ASCII white space, as the contracts define it.
SPACES = r"[ \t-\r]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Lower the rows and bytes of an Arrow batch to ARROW_ROWS and ARROW_BYTES; smaller settings of the session stay."""
    for name, most in (("Records", ARROW_ROWS), ("Bytes", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.max{name}PerBatch"
        if not 0 < int(re.match(r"-?\d+", spark.conf.get(key))[0]) <= most:
            spark.conf.set(key, str(most))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names; a temporary one only in local mode and where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(scratch_root, "own"):
        scratch_root.own = tempfile.mkdtemp(prefix="evigrid-")
        atexit.register(shutil.rmtree, scratch_root.own, True)
    return scratch_root.own


class Scratch:
    """Tables written to the shared folder during one call of an operator, so that no later step recomputes them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *saved: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in saved:
            delete(self.spark, df.scratch_path)

    def drop_all(self) -> None:
        delete(self.spark, self.path)


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    store, at = _store(spark, path)
    store.delete(at, True)


def ensure(spark: SparkSession, path: str) -> None:
    """Make the folder if it isn't there."""
    store, at = _store(spark, path)
    store.mkdirs(at)


def whole(text: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is. lower() does the same for ASCII texts, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, SPACES), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, although body may use it in lambdas."""
    return F.transform(F.array(value), body)[0]


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores until no column of df has it (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key is hot if it holds more than a HOTth of all rows and more than LEAST; whatever the total, if it has more than MOST rows.
HOT, LEAST, MOST = 1000, 256, 1 << 24


def spread_join(left: DataFrame, right: DataFrame, on: list[str], sizes: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """left joined with right on columns, with the rows of a hot key dealt to many tasks.

    sizes: on and size, the number of rows of left for each key. Rows of left that have a hot key get one of several salts by a
    hash of the column `by`; rows of right that have one are there once for each salt. No task gets more than about MOST rows of a key. Only
    the list of hot keys is broadcast, which has HOT rows at most or one for each MOST rows of left (60,000 for 10^12 rows).
    """
    salt, parts = (max((free_name(df, x) for df in (left, right)), key=len) for x in ("_salt", "_parts"))
    cut = sizes.agg(F.greatest(F.lit(LEAST), F.least(F.ceil(F.sum("size") / HOT), F.lit(MOST))).alias("cut")).scalar()
    hot = sizes.withColumn(parts, F.ceil(F.col("size") / cut).cast("int")).where(F.col(parts) > 1).select(*on, parts)
    dealt = left.join(F.broadcast(hot), on, "left").withColumn(salt, F.pmod(F.xxhash64(by), F.coalesce(parts, F.lit(1))).cast("int")).drop(parts)
    copied = right.join(F.broadcast(hot), on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop(parts)
    return dealt.join(copied.hint("merge"), [*on, salt], how).drop(salt)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per context, so that they need no copy of their own."""
    context = spark.sparkContext
    if getattr(context, "_evigrid_shipped", False):
        return
    from pathlib import Path

    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="evigrid-ship-")
    atexit.register(shutil.rmtree, folder, True)
    context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
    context._evigrid_shipped = True
