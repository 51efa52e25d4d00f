"""The anonymous counter as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_uniques(hits: DataFrame, late: str = "1 day") -> DataFrame:
    """``day, channel, n`` of a stream ``hits(ts, visitor, channel)``.

    Within the watermark a visitor's first arrival of a day counts; state is
    dropped when the day is over. The batch twin is :func:`evispark.operators.funnel.daily_uniques`.
    """
    day = F.window("ts", "1 day")
    once = hits.withWatermark("ts", late).withColumn("d", F.to_date("ts")).dropDuplicatesWithinWatermark(["d", "visitor"])
    return once.groupBy(day.alias("w"), "channel").agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "channel", "n")
