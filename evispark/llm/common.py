"""Helpers shared by the training-data operators.

Intermediate results that are read more than once are written as Parquet under
the folder named by ``spark.checkpoint.dir``. All executors share that folder,
so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import itertools
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast; a row here is a few numbers wide.
BROADCAST_ROWS = 50_000
#: Setting by which a query's shuffle files are deleted at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_counter = itertools.count()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, named by ``spark.checkpoint.dir`` or set as the context's checkpoint folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/evispark-stages"
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{os.getpid()}-{next(_counter)}-{uuid.uuid4().hex[:8]}"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """``key`` set to ``value`` for what is run inside, and then as it was before."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once in the shared folder and return the table read back.

    The shuffle files of the write go with it, and do not wait on disk until the driver's garbage is collected.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    with setting(spark, CLEANUP, "true"):
        df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a table that :func:`stage` wrote; nothing may read it afterwards."""
    path = getattr(df, "_staged_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def trim() -> None:
    """Give back to the system what a Python worker has freed; workers live on after a task and idle beside others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not with every C library
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task`` over batches, with :func:`trim` at its end."""

    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        trim()

    return run


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``rows`` rows.

    Larger tables are returned as they are and get a shuffle join. Give it staged
    or aggregated tables, since the count is a job of its own.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame, what: str = "components", most: int = 60) -> DataFrame:
    """Connected components of ``edges(u long, v long)`` as ``(node, component)``.

    Alternates the large-star and small-star steps of Kiveris et al. (2014):
    every round is a group minimum joined back on the node, so no component has
    to fit into one task. A large hub is one join key; its edges are a streamed
    side that adaptive execution may split. ``component`` is the smallest node
    reachable. Edges with a null end are ignored; an empty table gives an empty
    result. Each round is written to the shared folder, which cuts lineage.
    """
    now = stage(
        edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), what)
    before = None
    for _ in range(most):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # small star: all u -> v have v < u
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(down, "u")
        small_star = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            down.select("u", F.col("m").alias("v"))).distinct()
        after = stage(small_star, what)
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        unstage(now)
        now = after
        if before is not None and tuple(mark) == before:
            break
        before = tuple(mark)
    else:
        raise RuntimeError("components did not converge")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
