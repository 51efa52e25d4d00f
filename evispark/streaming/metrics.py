"""What queries measure while they run: observed values, spans, and the progress of streams."""

from __future__ import annotations

import json
import threading
import time
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

LINES = "at double, level string, message string"
PROGRESS = "query string, batch long, at string, rows long, ms long, observed string, error string"


def measured(df: DataFrame, name: str, **values: Column) -> tuple[DataFrame, Observation]:
    """``df`` and an observation of aggregates over it, known when an action has run; the values are taken as rows pass, without another job."""
    seen = Observation(name)
    return df.observe(seen, *[v.alias(k) for k, v in values.items()]), seen


class Log:
    """The latest ``keep`` lines of one driver, as rows for :mod:`evispark.operators.telemetry`."""

    def __init__(self, keep: int = 10_000) -> None:
        self.lines: deque[tuple[float, str, str]] = deque(maxlen=keep)

    def write(self, level: str, message: str) -> None:
        self.lines.append((time.time(), level, message))

    @contextmanager
    def span(self, name: str, **fields: object) -> Iterator[None]:
        """Two lines around what is run inside; one that fails is marked and goes on."""
        extra = " ".join(f"{k}={v}" for k, v in fields.items())
        self.write("INFO", f"→ {name}" + (f" ({extra})" if extra else ""))
        began, failed = time.monotonic(), False
        try:
            yield
        except Exception as e:
            failed = True
            self.write("ERROR", f"✗ {name} 失败 | {type(e).__name__}: {e}")
            raise
        finally:
            self.write("INFO", f"← {name} {'失败' if failed else '完成'} · {int((time.monotonic() - began) * 1000)}ms")

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.lines), LINES)


class Progress(StreamingQueryListener):
    """A row for each micro-batch that a session's streams have ended, the latest ``keep``, and one for each that failed."""

    def __init__(self, keep: int = 10_000) -> None:
        self.rows: deque[tuple] = deque(maxlen=keep)
        self.ended = threading.Event()

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.ended.clear()

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        observed = {k: v.asDict() for k, v in p.observedMetrics.items()}
        self.rows.append((p.name or str(p.id), p.batchId, p.timestamp, p.numInputRows, p.batchDuration, json.dumps(observed, default=str, ensure_ascii=False), None))

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        if event.exception:
            self.rows.append((str(event.id), None, None, None, None, None, event.exception[:200]))
        self.ended.set()

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), PROGRESS)
