"""A recording played again as a stream: a Python data source whose offsets are played time.

    spark.dataSource.register(Replay)
    spark.readStream.format("replay").options(path=..., ts="ts", rate=2, turns=3, began=...).load()
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructType

from .parts import store


@dataclass
class Stretch(InputPartition):
    """Rows of a file that are played in one turn: stamps from low to high, in microseconds, both included."""

    file: str
    turn: int
    low: int
    high: int


def _opened(path: str) -> ds.Dataset:
    where, at = store(path)
    return ds.dataset(at, filesystem=where, format="parquet")


def _micros(column):
    return column.cast(pa.timestamp("us", getattr(column.type, "tz", None))).cast(pa.int64())


class ReplayReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.ts = schema, options["path"], options.get("ts", "ts")
        self.rate, self.turns = float(options.get("rate", 1)), int(options.get("turns", 1))
        self.began, self.until = float(options.get("began", time.time())), float(options.get("until", "inf"))
        found = [b for b in _opened(self.path).to_batches(columns=[self.ts]) if b.num_rows]
        ends = [pc.min_max(_micros(b.column(0))).as_py() for b in found]
        self.first, last = min((e["min"] for e in ends), default=0), max((e["max"] for e in ends), default=-1)
        self.span = last - self.first  # -1: nothing to play

    def initialOffset(self) -> dict:
        return {"played": -1}

    def latestOffset(self) -> dict:
        """Microseconds of the recording that are played by now, all turns on end."""
        due = min((time.time() - self.began) * self.rate, self.until * self.rate) * 1e6
        return {"played": int(max(-1, min(due, self.span * self.turns)))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b, out = start["played"], end["played"], []
        files = _opened(self.path).files
        for turn in range(self.turns if self.span >= 0 else 0):
            low, high = max(a + 1 - turn * self.span, 0), min(b - turn * self.span, self.span)
            if low <= high:
                out += [Stretch(f, turn, self.first + low, self.first + high) for f in files]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        where, _ = store(self.path)
        names = [f.name for f in self.schema][:-2]
        target = to_arrow_schema(self.schema)
        for batch in ds.dataset(partition.file, filesystem=where, format="parquet").to_batches(columns=list(dict.fromkeys([*names, self.ts]))):
            at = _micros(batch.column(self.ts))
            keep = pc.and_(pc.greater_equal(at, partition.low), pc.less_equal(at, partition.high))
            batch, at = batch.filter(keep), at.filter(keep)
            if batch.num_rows:
                played = pc.divide(pc.cast(pc.add(pc.subtract(at, self.first), partition.turn * self.span), pa.float64()), 1e6 * self.rate)
                columns = [batch.column(n).cast(target.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([partition.turn] * batch.num_rows, pa.int32()), played], schema=target)

    def commit(self, end: dict) -> None:
        pass


class Replay(DataSource):
    """The rows of a Parquet table in the order of a time stamp, as they fall due: its columns, turn and play_at (seconds since the replay began).

    Options: path; ts, the column of stamps; rate, how much faster than recorded; turns, how often it is played; began, when the replay begins, in
    seconds since 1970 (give it, so that a restart goes on at the right place); until, seconds after which nothing more falls due.
    The first row of a later turn has the time of the one before's last. Rows without a stamp aren't played.
    """

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> StructType:
        own = from_arrow_schema(_opened(self.options["path"]).schema)
        return own.add("turn", IntegerType()).add("play_at", DoubleType())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ReplayReader(schema, self.options)
