"""Weekly funnel and the anonymous counter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import lexicon as L


def lenient_int(c: Column) -> Column:
    v = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(~v.isin("", "-", "—", "?"), v.try_cast("double").cast("long"))


def iso_week(d: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def percent(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b * 100.0)


def weeks(channels: DataFrame, totals: DataFrame) -> DataFrame:
    """``week, l1, l2, l3, l4, members, ctr, join_rate, retention, conversion``; sums of nothing are null."""
    c = channels.groupBy("week").agg(F.nullif(F.sum(F.coalesce(lenient_int(F.col("impressions")), F.lit(0))), F.lit(0)).alias("l1"), F.nullif(F.sum(F.coalesce(lenient_int(F.col("landing_uv")), F.lit(0))), F.lit(0)).alias("l2"))
    t = totals.select("week", lenient_int(F.col("joins")).alias("l3"), lenient_int(F.col("active_next_week")).alias("l4"), lenient_int(F.col("members_end")).alias("members"))
    j = c.join(t, "week", "full_outer")
    return j.withColumns({"ctr": percent(F.col("l2"), F.col("l1")), "join_rate": percent(F.col("l3"), F.col("l2")), "retention": percent(F.col("l4"), F.col("l3")), "conversion": percent(F.col("l3"), F.col("l1"))})


def diagnose(by_week: DataFrame) -> DataFrame:
    s = by_week.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("l1", "l2", "l3", "l4")])
    low = lambda a, b, t: F.coalesce(percent(F.col(a), F.col(b)) < t, F.lit(False))
    return s.select(low("l2", "l1", 0.5).alias("low_ctr"), low("l3", "l2", 3).alias("low_join"), low("l4", "l3", 10).alias("low_retention"), (F.col("l3") < 30).alias("small_sample"))


def upsert(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Changes over rows by key; a null leaves what is there."""
    rest = [c for c in rows.columns if c not in keys]
    c = changes.select(*keys, *[F.col(x).alias("_" + x) for x in rest])
    return rows.join(c, keys, "full_outer").select(*keys, *[F.coalesce("_" + x, x).alias(x) for x in rest])


def channel(code: Column) -> Column:
    """A channel of a link's code; what is not known is a direct visit."""
    k = F.lower(F.trim(F.coalesce(code, F.lit(""))))
    table = F.create_map(*[F.lit(x) for kv in L.CHANNEL_CODES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, k), F.when(k.isin(*L.CHANNELS), k), F.lit("直接访问"))


def visitor(ip: Column, agent: Column, ts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(ip, F.lit("")), F.coalesce(agent, F.lit("")), F.to_date(ts).cast("string")), 256)


def daily_uniques(hits: DataFrame) -> DataFrame:
    """``day, channel, n`` of ``hits(ts, visitor, channel)``: a visitor counts once a day, with the first channel."""
    day = F.to_date("ts").alias("day")
    first = hits.groupBy(day, "visitor").agg(F.min_by("channel", F.struct("ts", "channel")).alias("channel"))
    return first.groupBy("day", "channel").agg(F.count(F.lit(1)).alias("n"))


def week_rollup(daily: DataFrame) -> DataFrame:
    return daily.groupBy(iso_week(F.col("day")).alias("week"), "channel").agg(F.sum("n").alias("n"))


def last_days(daily: DataFrame, days: int = 120) -> DataFrame:
    """Rows of the last days that have rows. Days are few, so they are ranked alone and joined back."""
    d = daily.select("day").distinct().withColumn("_n", F.row_number().over(Window.orderBy(F.desc("day")))).where(F.col("_n") <= days)
    return daily.join(F.broadcast(d.select("day")), "day", "left_semi")
