"""A search service read page by page, as a data source of Spark.

A search tells how many records it has; each page of their ids is a partition, fetched
by the task that reads it. How ids and records come is up to a transport, a class named
by an option: a service's client, or the files and tables here. Bounds on ``ord`` in a
filter leave out whole pages. What cannot be fetched is a row with its ``error``.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from evispark.functions import lexicon as L
from evispark.functions import text as X
from evispark.operators import funnel

FORMAT = "paged_records"
SCHEMA = "query string, total long, translation string, ord long, id string, record string, error string"
_ARROW = pa.schema([("query", pa.string()), ("total", pa.int64()), ("translation", pa.string()), ("ord", pa.int64()), ("id", pa.string()), ("record", pa.string()), ("error", pa.string())])


class Transport:
    """What a source asks of a service; made from the read's options, on the driver and in each task."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def search(self, query: str) -> dict:
        """``total`` and ``translation``, the query as it was understood."""
        raise NotImplementedError

    def ids(self, query: str, start: int, size: int) -> list[str]:
        """Ids of the hits ``start`` to ``start + size`` in their order."""
        raise NotImplementedError

    def fetch(self, ids: list[str]) -> dict[str, str]:
        """Records by id; ids that are not there failed."""
        raise NotImplementedError


class FolderTransport(Transport):
    """Replies stored in the folder ``root``: ``<digest of the query>.json`` with total, translation and ids, and a file for each id."""

    @staticmethod
    def reply(query: str) -> str:
        import hashlib

        return hashlib.sha256(query.encode()).hexdigest()[:24] + ".json"

    def _read(self, name: str) -> str:
        where, root = fs.FileSystem.from_uri(self.options["root"])
        with where.open_input_stream(f"{root}/{name}") as f:
            return f.read().decode()

    def search(self, query: str) -> dict:
        found = json.loads(self._read(self.reply(query)))
        return {"total": found.get("total", len(found["ids"])), "translation": found.get("translation", "")}

    def ids(self, query: str, start: int, size: int) -> list[str]:
        return json.loads(self._read(self.reply(query)))["ids"][start:start + size]

    def fetch(self, ids: list[str]) -> dict[str, str]:
        out = {}
        for i in ids:
            try:
                out[i] = self._read(i)
            except OSError:
                continue
        return out


class TableTransport(Transport):
    """A Parquet table ``root`` of ``(ord long from 0, id, record)``, of which each page reads its own row groups; every query finds all of it."""

    def _table(self, columns: list[str], where: ds.Expression) -> pa.Table:
        found, root = fs.FileSystem.from_uri(self.options["root"])
        return ds.dataset(root, filesystem=found, format="parquet").to_table(columns=columns, filter=where)

    def search(self, query: str) -> dict:
        found, root = fs.FileSystem.from_uri(self.options["root"])
        return {"total": ds.dataset(root, filesystem=found, format="parquet").count_rows(), "translation": query}

    def ids(self, query: str, start: int, size: int) -> list[str]:
        rows = self._table(["ord", "id"], (ds.field("ord") >= start) & (ds.field("ord") < start + size)).sort_by("ord")
        self._span = start, start + size
        return rows.column("id").to_pylist()

    def fetch(self, ids: list[str]) -> dict[str, str]:
        lo, hi = self._span
        rows = self._table(["id", "record"], (ds.field("ord") >= lo) & (ds.field("ord") < hi)).to_pylist()
        return {r["id"]: r["record"] for r in rows if r["record"] is not None}


def _transport(options: dict[str, str]) -> Transport:
    module, _, name = options["transport"].partition(":")
    return getattr(importlib.import_module(module), name)(options)


@dataclass
class Page(InputPartition):
    start: int
    size: int
    total: int
    translation: str


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.query = dict(options), options.get("query", "")
        self.limit, self.page = int(options.get("limit", 20)), int(options.get("page", 100))
        self.tries, self.wait = int(options.get("tries", 3)), float(options.get("wait", 0.5))
        self.low, self.high = 0, self.limit

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on ``ord`` choose pages; Spark still tests each row."""
        for f in filters:
            if getattr(f, "attribute", None) == ("ord",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value + (0 if isinstance(f, LessThan) else 1))
            yield f

    def _tried(self, what: Callable[[], object]) -> object:
        for left in range(self.tries - 1, -1, -1):
            try:
                return what()
            except Exception:  # noqa: BLE001  the last one is raised
                if not left:
                    raise
                time.sleep(self.wait * 2 ** (self.tries - 1 - left))

    def partitions(self) -> list[Page]:
        transport = _transport(self.options)
        try:
            found = self._tried(lambda: transport.search(self.query))
            total, translation = int(found.get("total") or 0), str(found.get("translation") or "").strip()
        except Exception as e:  # noqa: BLE001  the search's failure is a row
            return [Page(0, 0, -1, f"{type(e).__name__}: {e}"[:200])]
        high = min(self.high, total)
        first = self.low // self.page * self.page
        return [Page(at, min(self.page, high - at), total, translation) for at in range(first, high, self.page)] or [Page(0, 0, total, translation)]

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        def rows(ids: list, records: list, errors: list) -> pa.RecordBatch:
            n = len(errors)
            total = None if page.total < 0 else page.total
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([self.query] * n, [total] * n, [None if page.total < 0 else page.translation] * n, [page.start + i for i in range(n)], ids, records, errors), _ARROW)], schema=_ARROW)

        if page.total < 0:
            yield rows([None], [None], [page.translation])
            return
        if not page.size:
            return
        transport = _transport(self.options)
        try:
            ids = self._tried(lambda: transport.ids(self.query, page.start, page.size))
            got = self._tried(lambda: transport.fetch(ids))
        except Exception as e:  # noqa: BLE001  the page's failure is a row
            yield rows([None], [None], [f"{type(e).__name__}: {e}"[:200]])
            return
        yield rows(ids, [got.get(i) for i in ids], [None if i in got else "not fetched" for i in ids])


class PagedSource(DataSource):
    """``SCHEMA`` of one query. Options: ``transport`` as ``module:Class``, ``query``, ``limit`` of records (20), ``page`` size (100), ``tries`` (3), ``wait`` in seconds before the second try (0.5, then doubled), and the transport's own.

    A page or search that fails is one row with its error; an id that fails is a row too.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:  # noqa: ANN001
        return PagedReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets filters reach it."""
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, transport: type[Transport] | str, query: str, limit: int = 20, **options: object) -> DataFrame:
    """Records of one query, see :class:`PagedSource`."""
    register(spark)
    name = transport if isinstance(transport, str) else f"{transport.__module__}:{transport.__name__}"
    return spark.read.format(FORMAT).options(transport=name, query=query, limit=limit, **options).load()


def cache_key(query: Column, limit: Column, sort: Column) -> Column:
    return X.digest(query, limit.cast("string"), sort)


def search_cached(wanted: DataFrame, cache: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All records of ``wanted(query, limit, sort)`` and those of them that are new to the cache.

    ``cache(key, total, translation, ord, id, record)`` is asked first, by the digest of
    the three; ``fetch`` gets the rest, with their keys, and returns such rows with an
    ``error``. A search that found nothing or failed in part is no entry, so it is asked again.
    Repeated requests are asked once.
    """
    asked = wanted.withColumn("key", cache_key(F.col("query"), F.col("limit"), F.col("sort"))).dropDuplicates(["key"])
    known = cache.join(asked.select("key"), "key", "left_semi").withColumn("error", F.lit(None).cast("string"))
    fresh = fetch(asked.join(cache.select("key").distinct(), "key", "left_anti"))
    whole = fresh.groupBy("key").agg(F.count("error").alias("failed")).where("failed = 0").select("key")
    columns = ["key", "total", "translation", "ord", "id", "record"]
    return known.select(*columns, "error").unionByName(fresh.select(*columns, "error")), fresh.join(whole, "key", "left_semi").select(*columns)


def pulled(channels: DataFrame, replies: DataFrame) -> DataFrame:
    """Weekly ``channels`` with the visits of ``replies(week, json)``, JSON objects of a channel's count.

    Known channels and numbers only; text that is no JSON changes nothing. Other columns
    of a week's channel stay, channels not in a reply stay.
    """
    pairs = replies.select("week", F.explode(F.from_json("json", "map<string,string>")).alias("channel", "n"))
    n = F.col("n").try_cast("double").cast("long")
    good = pairs.where(F.col("channel").isin(*L.CHANNELS) & n.isNotNull() & ~F.lower("n").isin("true", "false", "nan", "inf", "infinity"))
    new = good.groupBy("week", "channel").agg(F.max(n).alias("landing_uv"))
    blank = [F.lit(None).cast(kind).alias(c) for c, kind in channels.dtypes if c not in ("week", "channel", "landing_uv")]
    kind = dict(channels.dtypes)["landing_uv"]
    changes = new.select("week", "channel", F.col("landing_uv").cast(kind).alias("landing_uv"), *blank)
    return funnel.upsert(channels, changes.select(*channels.columns), ["week", "channel"])
