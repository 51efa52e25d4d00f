"""Counts kept in a table of days, written from micro-batches, each once.

A batch is first written under its number. It is taken into the table when enough rows
or seconds have gathered, and each row of the table says up to which batch it has
counted; so a batch that comes again, before or after that, changes nothing.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evispark.operators import telemetry

#: Items and seconds after which counts are written, days that the counter keeps.
ITEMS, SECONDS, DAYS = 20, 5.0, 120


class DayTable:
    """Counts ``n`` by ``keys`` in folders of ``day`` under ``path``, which all executors see.

    The days of a batch are few and rewritten alone. ``keep`` of them stay, the latest.
    """

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], keep: int | None = None, items: int = ITEMS, seconds: float = SECONDS, clock: Callable[[], float] = time.time) -> None:
        self.spark, self.path, self.keys, self.keep, self.items, self.seconds, self.clock = spark, path.rstrip("/"), keys, keep, items, seconds, clock
        kinds = ", ".join(f"{k} {v}" for k, v in keys.items())
        self.schema, self.pending_schema = f"{kinds}, n long, batch long, day date", f"{kinds}, n long, day date, batch long"

    def _fs(self, path: str):  # noqa: ANN202
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, path: str) -> list[str]:
        where, store = self._fs(path)
        return sorted(s.getPath().getName() for s in store.listStatus(where) if s.isDirectory()) if store.exists(where) else []

    def _delete(self, path: str) -> None:
        where, store = self._fs(path)
        store.delete(where, True)

    def _read(self, path: str, schema: str) -> DataFrame:
        where, store = self._fs(path)
        return self.spark.read.schema(schema).parquet(path) if store.exists(where) else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """``day``, the keys and ``n`` as written so far."""
        return self._read(f"{self.path}/days", self.schema).select("day", *self.keys, "n")

    def add(self, counts: DataFrame, batch: int) -> None:
        """``counts(day, keys, n)`` of a batch; the same batch again is the same rows again."""
        counts.groupBy("day", *self.keys).agg(F.sum("n").cast("long").alias("n")).select(*self.keys, "n", "day").write.mode("overwrite").parquet(f"{self.path}/pending/batch={batch}")
        waiting = self._read(f"{self.path}/pending", self.pending_schema)
        where, store = self._fs(f"{self.path}/pending")
        oldest = min((s.getModificationTime() / 1000 for s in store.listStatus(where)), default=self.clock())
        if waiting.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] >= self.items or self.clock() - oldest >= self.seconds:
            self.flush()

    def flush(self) -> None:
        """Takes all that waits into the table. After a stop at any place it may be done again."""
        batches = self._children(f"{self.path}/pending")
        if not batches:
            return
        waiting = self._read(f"{self.path}/pending", self.pending_schema).where(F.col("batch").isin(*[int(b.split("=")[1]) for b in batches]))
        days = [r[0] for r in waiting.select("day").distinct().collect()]  # those of a few seconds
        old = self._read(f"{self.path}/days", self.schema).where(F.col("day").isin(*days) if days else F.lit(False))
        # a row has counted all batches up to its own
        new = waiting.alias("w").join(old.select("day", *self.keys, F.col("batch").alias("upto")), ["day", *self.keys], "left").where("upto is null or w.batch > upto")
        new = new.groupBy("day", *self.keys).agg(F.sum("n").alias("m"), F.max("batch").alias("to"))
        both = old.join(new, ["day", *self.keys], "full_outer")
        rows = both.select(*self.keys, (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"), F.greatest("batch", "to").alias("batch"), "day")
        beside = f"{self.path}/next-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(beside)
        self.spark.read.schema(self.schema).parquet(beside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.path}/days")
        self._delete(beside)
        for b in batches:
            self._delete(f"{self.path}/pending/{b}")
        if self.keep is not None:
            for day in self._children(f"{self.path}/days")[:-self.keep]:
                self._delete(f"{self.path}/days/{day}")


def _started(rows: DataFrame, table: DayTable, checkpoint: str, available: bool) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(lambda df, batch: table.add(df, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available else writer.trigger(processingTime=f"{table.seconds} seconds")).start()


def health_log(calls: DataFrame, path: str, checkpoint: str, available: bool = False, **options: object) -> tuple[StreamingQuery, DayTable]:
    """A stream of ``calls(ts, dep, ok)`` counted by day, dependency and outcome; unknown names are ``other``."""
    table = DayTable(calls.sparkSession, path, {"dep": "string", "ok": "boolean"}, **options)
    rows = calls.select(F.to_date("ts").alias("day"), telemetry.dependency(F.col("dep")).alias("dep"), F.coalesce("ok", F.lit(False)).alias("ok"), F.lit(1).cast("long").alias("n"))
    return _started(rows, table, checkpoint, available), table


def visit_log(uniques: DataFrame, path: str, checkpoint: str, available: bool = False, **options: object) -> tuple[StreamingQuery, DayTable]:
    """A stream of first visits ``(day, channel)`` counted by day and channel; the latest ``DAYS`` days stay."""
    table = DayTable(uniques.sparkSession, path, {"channel": "string"}, **({"keep": DAYS} | options))
    return _started(uniques.select("day", "channel", F.lit(1).cast("long").alias("n")), table, checkpoint, available), table
