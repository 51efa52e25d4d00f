"""Positions in an order, without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: str, name: str = "n", block: int = 65536) -> DataFrame:
    """``df`` with its rows' position in ``order``, from 1, as ``name`` long.

    ``order`` is a number; a null one comes first. Rows go in blocks of ``block`` of its
    values, each numbered alone; only the blocks' counts, far fewer than rows, are summed
    in one pass. Rows of equal order keep some order among them.
    """
    b = F.coalesce(F.floor(F.col(order) / block).cast("long"), F.lit(-(1 << 62)))
    rows = df.withColumn("_block", b)
    upto = F.sum("_c").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_c")).withColumn("_start", F.coalesce(upto, F.lit(0))).drop("_c")
    place: Column = F.row_number().over(Window.partitionBy("_block").orderBy(F.col(order).asc_nulls_first()))
    return rows.withColumn("_place", place).join(starts, "_block").withColumn(name, F.col("_start") + F.col("_place")).drop("_block", "_place", "_start")
