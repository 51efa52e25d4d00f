"""Quota admission, a cache with a lifetime and jobs as streams, on keyed state with timers.

Each rule depends on what came before, so rows wait in state until the watermark has
passed them and then go by in the order of ``(ts, seq)``, however they were dealt into
micro-batches. State that no row can ask for again is dropped by timers. A restart from
the checkpoint finds rows and sums as they were, so nothing is admitted or handed out
twice. The state store must be RocksDB, which :func:`prepare` sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from evispark.functions import lexicon as L

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _ms(ts: pd.Timestamp) -> int:
    return int(ts.value // 1_000_000)


class InOrder(StatefulProcessor):
    """Rows ``(ts, seq, ..)`` of a key wait until the watermark has passed; :meth:`step` then gets them in order."""

    def __init__(self, waiting: str, columns: list[str]) -> None:
        self.waiting_schema, self.columns = waiting, columns
        self.fields = [f.split()[0] for f in waiting.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.opened(handle)

    def opened(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def step(self, key: tuple, rows: pd.DataFrame) -> list[tuple]:
        """Results of rows, which come in order."""
        raise NotImplementedError

    def expired(self, key: tuple, watermark: int) -> None:
        """Drops what lies before the watermark, in milliseconds."""

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = None
        for pdf in rows:
            pdf = pdf[self.fields]
            self.waiting.appendList([tuple(r) for r in pdf.itertuples(index=False)])
            last = pdf["ts"].max() if last is None else max(last, pdf["ts"].max())
        if last is not None:
            self.handle.registerTimer(_ms(last) + 1)  # all of this batch are past then
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held = pd.DataFrame(list(self.waiting.get()), columns=self.fields) if self.waiting.exists() else pd.DataFrame(columns=self.fields)
        out: list[tuple] = []
        if len(held):
            held["ts"] = pd.to_datetime(held["ts"])
            past = held["ts"].map(_ms) < watermark
            if past.any():
                rest = held[~past]
                if len(rest):
                    self.waiting.put([tuple(r) for r in rest.itertuples(index=False)])
                else:
                    self.waiting.clear()
                out = self.step(key, held[past].sort_values(["ts", "seq"], kind="stable"))
        self.expired(key, watermark)
        return iter([pd.DataFrame(out, columns=self.columns)] if out else [])


class Admission(InOrder):
    """Sums of a kind: of each scope for good, of each day until the watermark has left it."""

    def __init__(self, limits: dict[str, tuple[int, int]]) -> None:
        super().__init__("scope string, ts timestamp, seq long, amount long, own_key boolean", ["kind", "scope", "ts", "seq", "amount", "admitted"])
        self.limits = limits

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getMapState("session", "scope string", "used long")
        self.daily = handle.getMapState("daily", "day string", "used long")

    def step(self, key: tuple, rows: pd.DataFrame) -> list[tuple]:
        most, used, today, out = self.limits.get(key[0]), {}, {}, []
        value = lambda state, held, k: held[k] if k in held else (state.getValue((k,))[0] if state.containsKey((k,)) else 0)
        for r in rows.itertuples(index=False):
            day = r.ts.strftime("%Y-%m-%d")
            s, d = value(self.session, used, r.scope), value(self.daily, today, day)
            good = most is None or r.amount <= 0 or bool(r.own_key) or (s + r.amount <= most[0] and d + r.amount <= most[1])
            if good:
                used[r.scope], today[day] = s + r.amount, d + r.amount
            out.append((key[0], r.scope, r.ts, r.seq, r.amount, bool(good)))
        for state, held in ((self.session, used), (self.daily, today)):
            for k, v in held.items():
                state.updateValue((k,), (int(v),))
        return out

    def expired(self, key: tuple, watermark: int) -> None:
        today = pd.Timestamp(watermark, unit="ms").strftime("%Y-%m-%d")
        for day in [k[0] for k in self.daily.keys()]:
            if day < today:
                self.daily.removeKey((day,))


class Cache(InOrder):
    """The last write of a key, until its kind's days are over."""

    def __init__(self, days: dict[str, float]) -> None:
        super().__init__("ts timestamp, seq long, op string, value string", ["kind", "key", "ts", "seq", "hit", "value"])
        self.days = days

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "value string, ts timestamp")

    def step(self, key: tuple, rows: pd.DataFrame) -> list[tuple]:
        life, out = timedelta(days=self.days.get(key[0], 0)), []
        now = self.entry.get() if self.entry.exists() else None
        for r in rows.itertuples(index=False):
            if r.op == "put":
                now = (r.value, r.ts)
            elif r.op == "clear":
                now = None
            else:
                hit = now is not None and r.ts - pd.Timestamp(now[1]) <= life
                out.append((*key, r.ts, r.seq, hit, now[0] if hit else None))
        if now is None:
            self.entry.clear()
        else:
            self.entry.update((now[0], now[1]))
            self.handle.registerTimer(_ms(pd.Timestamp(now[1]) + life) + 1)
        return out

    def expired(self, key: tuple, watermark: int) -> None:
        if self.entry.exists() and _ms(pd.Timestamp(self.entry.get()[1]) + timedelta(days=self.days.get(key[0], 0))) < watermark:
            self.entry.clear()


class Jobs(InOrder):
    """A job's state, until ``keep`` days after its last row."""

    def __init__(self, keep: float) -> None:
        super().__init__("ts timestamp, seq long, event string", ["id", "ts", "seq", "granted"])
        self.keep = timedelta(days=keep)

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", "status string, ts timestamp")

    def step(self, key: tuple, rows: pd.DataFrame) -> list[tuple]:
        status, out, at = self.job.get()[0] if self.job.exists() else "", [], None
        for r in rows.itertuples(index=False):
            at = r.ts
            if r.event == "start" and not status:
                status = "running"
            elif r.event in ("done", "error") and status == "running":
                status = "finished"
            elif r.event == "consume":
                out.append((key[0], r.ts, r.seq, status == "finished"))
                status = "consumed" if status == "finished" else status
        self.job.update((status, at))
        self.handle.registerTimer(_ms(at + self.keep) + 1)
        return out

    def expired(self, key: tuple, watermark: int) -> None:
        if self.job.exists() and _ms(pd.Timestamp(self.job.get()[1]) + self.keep) < watermark:
            self.job.clear()


def _run(rows: DataFrame, keys: list[str], processor: InOrder, out: str, late: str) -> DataFrame:
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(*keys).transformWithStateInPandas(processor, out, "Append", "EventTime")


def quota_admission(requests: DataFrame, limits: dict[str, tuple[int, int]] | None = None, late: str = "1 day") -> DataFrame:
    """The stream of :func:`evispark.operators.telemetry.quota_admission`: rows ``(kind, scope, ts, seq, amount, own_key)`` that come up to ``late`` out of order."""
    rows = requests.select("kind", "scope", "ts", F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("amount").cast("long"), F.lit(0)).alias("amount"), F.coalesce("own_key", F.lit(False)).alias("own_key"))
    return _run(rows, ["kind"], Admission(L.QUOTA if limits is None else limits), "kind string, scope string, ts timestamp, seq long, amount long, admitted boolean", late)


def cache_reads(ops: DataFrame, days: dict[str, float] | None = None, late: str = "1 day") -> DataFrame:
    """The stream of :func:`evispark.operators.telemetry.cache_reads`: rows ``(kind, key, ts, seq, op, value)``."""
    rows = ops.select("kind", "key", "ts", F.col("seq").cast("long").alias("seq"), "op", "value")
    return _run(rows, ["kind", "key"], Cache({k: v for k, (v, _) in L.CACHE.items()} if days is None else days), "kind string, key string, ts timestamp, seq long, hit boolean, value string", late)


def job_grants(events: DataFrame, keep: float = 30.0, late: str = "1 day") -> DataFrame:
    """The stream of :func:`evispark.operators.telemetry.job_grants`: rows ``(id, ts, seq, event)``; a job is forgotten ``keep`` days after its last row."""
    rows = events.select("id", "ts", F.col("seq").cast("long").alias("seq"), "event")
    return _run(rows, ["id"], Jobs(keep), "id string, ts timestamp, seq long, granted boolean", late)
