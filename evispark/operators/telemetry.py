"""Cache, quota, health, retry and survey rules over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import lexicon as L


def cache_live(entries: DataFrame, now: Column) -> DataFrame:
    """Entries ``(kind, key, value, t)`` within their kind's days; ``t`` and ``now`` are epoch seconds."""
    ttl = F.create_map(*[F.lit(x) for k, (days, _) in L.CACHE.items() for x in (k, days)])
    return entries.where(now - F.col("t") <= F.try_element_at(ttl, F.col("kind")) * 86400.0)


def cache_evict(entries: DataFrame) -> DataFrame:
    """The newest entries of each kind up to its limit; the last write of a key counts."""
    limit = F.create_map(*[F.lit(x) for k, (_, n) in L.CACHE.items() for x in (k, n)])
    last = entries.groupBy("kind", "key").agg(F.max_by("value", "t").alias("value"), F.max("t").alias("t"))
    w = Window.partitionBy("kind").orderBy(F.desc("t"), F.desc("key"))
    return last.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.try_element_at(limit, F.col("kind"))).drop("_n")


def cache_stats(counters: DataFrame, entries: DataFrame) -> DataFrame:
    """``hits, misses, hit_rate, total`` of ``counters(hits, misses)`` and the entries; the rate has one decimal, null without calls."""
    c = counters.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum("misses"), F.lit(0)).alias("misses"))
    rate = F.bround(F.try_divide(F.col("hits") * 100.0, F.col("hits") + F.col("misses")), 1)
    return c.crossJoin(F.broadcast(entries.agg(F.count(F.lit(1)).alias("total")))).select("hits", "misses", rate.alias("hit_rate"), "total")


def quota_admission(requests: DataFrame, limits: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """``kind, scope, ts, seq, amount, admitted`` of requests ``(kind, scope, ts, seq, amount, own_key)``, in time order.

    ``limits`` has for each kind the most of a session, a scope's sum over all days,
    and of a day, the sum of all scopes. A request that would pass either is refused
    and adds nothing. Own keys, amounts up to zero and kinds without a limit are
    always admitted, and count. What is admitted depends on what was before, in
    all scopes of a kind, so a kind's requests go by in order; only its sums are held.
    """
    limits = L.QUOTA if limits is None else limits

    def admit(batches):
        kind, session, daily = None, {}, {}
        for pdf in batches:
            ok = []
            for r in pdf.itertuples(index=False):
                if r.kind != kind:
                    kind, session, daily = r.kind, {}, {}
                most = limits.get(r.kind)
                used, today = session.get(r.scope, 0), daily.get(r.day, 0)
                good = most is None or r.amount <= 0 or bool(r.own_key) or (used + r.amount <= most[0] and today + r.amount <= most[1])
                if good:
                    session[r.scope], daily[r.day] = used + r.amount, today + r.amount
                ok.append(good)
            yield pdf.drop(columns=["day", "own_key"]).assign(admitted=ok)

    rows = requests.select("kind", "scope", "ts", "seq", F.coalesce(F.col("amount").cast("long"), F.lit(0)).alias("amount"), F.coalesce("own_key", F.lit(False)).alias("own_key"), F.to_date("ts").cast("string").alias("day"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("own_key", "day"))
    return rows.repartition("kind").sortWithinPartitions("kind", "ts", "seq").mapInPandas(admit, kinds + ", admitted boolean")


def remaining(usage: DataFrame, limits: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """``kind, scope, left`` of ``usage(kind, scope, session, day)``: what a scope may still take, never below zero; null without a limit."""
    limits = L.QUOTA if limits is None else limits
    most = F.create_map(*[x for k, (s, d) in limits.items() for x in (F.lit(k), F.struct(F.lit(s).alias("s"), F.lit(d).alias("d")))])
    m = F.try_element_at(most, F.col("kind"))
    return usage.select("kind", "scope", F.when(m.isNotNull(), F.greatest(F.lit(0), F.least(m["s"] - F.col("session"), m["d"] - F.col("day")))).alias("left"))


def health(calls: DataFrame, last_day: Column, days: int = 7, known: list[str] | None = None) -> DataFrame:
    """``dep, ok, fail, rate`` of calls ``(ts, dep, ok)`` in the last days; the rate has one decimal, null without calls.

    With ``known`` names, a call to any other is one of ``other``.
    """
    d = F.to_date("ts")
    c = calls.where((d > F.date_sub(last_day, days)) & (d <= last_day))
    if known is not None:
        c = c.withColumn("dep", F.when(F.col("dep").isin(*known), F.col("dep")).otherwise("other"))
    ok, fail = F.count_if("ok"), F.count_if(~F.col("ok"))
    return c.groupBy("dep").agg(ok.alias("ok"), fail.alias("fail"), F.bround(F.try_divide(ok * 100.0, F.count(F.lit(1))), 1).alias("rate"))


def dependency(name: Column) -> Column:
    """A call's dependency; names that are not known are ``other``."""
    return F.when(name.isin(*L.DEPENDENCIES), name).otherwise("other")


def health_rolling(calls: DataFrame, days: int = 7) -> DataFrame:
    """``day, dep, ok, fail, rate`` over ``days`` days up to each day, for each dependency from its first day to its last.

    Days without calls are there too. Calls are counted by day first, so a window has a
    row for a day. The rate has one decimal and is null where the days have no calls.
    """
    ok = F.coalesce("ok", F.lit(False))
    daily = calls.where("ts is not null").groupBy("dep", F.to_date("ts").alias("day")).agg(F.count_if(ok).alias("k"), F.count_if(~ok).alias("b"))
    span = daily.groupBy("dep").agg(F.min("day").alias("a"), F.max("day").alias("z")).select("dep", F.explode(F.sequence("a", "z")).alias("day"))
    full = span.withColumn("same", F.coalesce("dep", F.lit(""))).join(daily.select(F.coalesce("dep", F.lit("")).alias("same"), "day", "k", "b"), ["same", "day"], "left")
    w = Window.partitionBy("same").orderBy(F.unix_date("day")).rangeBetween(1 - days, 0)
    s = full.select("day", "dep", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("ok"), F.coalesce(F.sum("b").over(w), F.lit(0)).alias("fail"))
    return s.withColumn("rate", F.bround(F.try_divide(F.col("ok") * 100.0, F.col("ok") + F.col("fail")), 1))


def cache_reads(ops: DataFrame, days: dict[str, float] | None = None) -> DataFrame:
    """``kind, key, ts, seq, hit, value`` of each read in ``ops(kind, key, ts, seq, op, value)``, in the order of ``(ts, seq)``.

    A read hits what was put last, if its kind's days are not over and it was not cleared since.
    """
    life = F.create_map(*[F.lit(x) for k, v in ({k: v for k, (v, _) in L.CACHE.items()} if days is None else days).items() for x in (k, float(v))])
    w = Window.partitionBy("kind", "key").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("op").isin("put", "clear"), F.struct("op", "value", F.col("ts").alias("at"))), ignorenulls=True).over(w)
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("last.at").cast("timestamp"))
    fresh = age <= F.coalesce(F.try_element_at(life, F.col("kind")), F.lit(0.0)) * 86_400_000_000
    rows = ops.withColumn("last", last).where("op = 'get'").withColumn("hit", F.coalesce((F.col("last.op") == "put") & fresh, F.lit(False)))
    return rows.select("kind", "key", "ts", "seq", "hit", F.when(F.col("hit"), F.col("last.value")).alias("value"))


def job_grants(events: DataFrame) -> DataFrame:
    """``id, ts, seq, granted`` of each ``consume`` in ``events(id, ts, seq, event)``: the first after a job that was started has ended (done or error) gets its result, no other does."""
    w, at = Window.partitionBy("id"), F.struct("ts", "seq")
    first = lambda what, after=None: F.min(F.when(what if after is None else what & (at > after), at)).over(w)
    e = F.col("event")
    rows = events.withColumn("_start", first(e == "start"))
    rows = rows.withColumn("_end", first(e.isin("done", "error"), F.col("_start")))
    rows = rows.withColumn("_taken", first(e == "consume", F.col("_end")))
    return rows.where(e == "consume").select("id", "ts", "seq", F.coalesce(at == F.col("_taken"), F.lit(False)).alias("granted"))


def pruned(log: DataFrame, today: Column, days: int = 14) -> DataFrame:
    """Rows of ``log(ts)`` not older than ``days`` days."""
    return log.where(F.to_date("ts") >= F.date_sub(today, days))


def tail(log: DataFrame, lines: int = 100) -> DataFrame:
    """The latest ``lines`` rows of ``log(ts, seq)``, in order."""
    return log.orderBy(F.desc("ts"), F.desc("seq")).limit(lines).orderBy("ts", "seq")


def spans(log: DataFrame) -> DataFrame:
    """``ts, name, failed, ms`` of the lines of ``log(ts, message)`` that end a span: ``← name 完成 · 12ms``, or 失败 where it failed."""
    part = lambda i: F.regexp_extract("message", r"^← (.+) (完成|失败) · (\d{1,18})ms$", i)
    return log.where(part(1) != "").select("ts", part(1).alias("name"), (part(2) == "失败").alias("failed"), part(3).cast("long").alias("ms"))


def errors(log: DataFrame, last_day: Column, days: int = 7) -> DataFrame:
    """``errors, last_error`` of ``log(ts, detail)`` in the last days: how many with a detail, and the latest, cut to 200 characters."""
    d = F.to_date("ts")
    c = log.where((d > F.date_sub(last_day, days)) & (d <= last_day) & (F.coalesce("detail", F.lit("")) != ""))
    return c.agg(F.count(F.lit(1)).alias("errors"), F.coalesce(F.substring(F.max_by("detail", "ts"), 1, 200), F.lit("")).alias("last_error"))


def totals(calls: DataFrame) -> DataFrame:
    return calls.agg(F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("ok")).alias("failed"), F.bround(F.avg("ms"), 1).alias("mean_ms"))


def backoff(attempt: Column, retry_after: Column) -> Column:
    """Seconds before a retry, without the random part: the server's wish first, else doubling, to the cap."""
    cap = F.lit(L.RETRY["cap"])
    return F.when(retry_after > 0, F.least(retry_after, cap)).otherwise(F.least(L.RETRY["base"] * F.pow(F.lit(2.0), attempt), cap))


def retryable(status: Column) -> Column:
    return status.isin(*L.RETRY["statuses"])


def releases(calls: DataFrame, delay: float) -> DataFrame:
    """Calls ``(host, t)`` with ``release``: never closer to the release before than ``delay``. A release time is the greatest of ``t_i + delay * (n - i)``, so a running maximum gives it."""
    w = Window.partitionBy("host").orderBy("t")
    n = F.row_number().over(w)
    return calls.withColumn("_n", n).withColumn("release", F.max(F.col("t") - F.col("_n") * delay).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_n") * delay).drop("_n")


def should_prompt(count: Column, prompts: Column, muted: Column, done: Column) -> Column:
    """A survey is due after 15 uses and every 25 after each prompt, three times at most."""
    return ~muted & ~done & (prompts < 3) & (count >= 15 + 25 * prompts)
