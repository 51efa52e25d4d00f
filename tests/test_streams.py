"""Streams against their batch twins on shuffled micro-batches, and after restarts."""

import os

import pytest
from pyspark.sql import functions as F

from evispark.operators import telemetry
from evispark.plans import derived
from evispark.streaming import ledger, metrics, stateful

DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def shuffled(spark, rows, folder, parts=6):
    """Rows in files that a stream reads one at a time, out of order by up to two days, and a last row far later."""
    dealt = rows.withColumn("_day", (F.unix_date(F.to_date("ts")) + F.pmod(F.xxhash64("seq"), F.lit(2))).cast("int"))
    days = sorted(r[0] for r in dealt.select("_day").distinct().collect())
    paths = []
    for i in range(parts):
        own = days[i * len(days) // parts:(i + 1) * len(days) // parts]
        path = f"{folder}/all/{i}"
        dealt.where(F.col("_day").isin(*own)).drop("_day").orderBy(F.xxhash64("seq", F.lit(1))).coalesce(1).write.parquet(path)
        paths.append(path)
    return paths


def run(spark, paths, schema, twin, folder):
    """Feeds the files one by one to runs of a stream that each begin from the checkpoint."""
    stateful.prepare(spark)
    os.makedirs(f"{folder}/in", exist_ok=True)
    for k, path in enumerate([*paths, None]):
        if path:
            for name in os.listdir(path):
                if name.endswith(".parquet"):
                    os.rename(f"{path}/{name}", f"{folder}/in/{k}-{name}")
        if k % 2 == 0 and path:
            continue  # two files in one run, then a restart
        df = twin(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
        q = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def same(a, b):
    cols = a.columns
    cast = [F.col(c).cast("timestamp").alias(c) if c == "ts" else F.col(c) for c in cols]
    return sorted(map(repr, map(tuple, a.select(*cast).collect()))) == sorted(map(repr, map(tuple, b.select(*cast).collect())))


@needs_tables
def test_admission_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{DIR}/events.parquet")
    r = e.select(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("scope"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").cast("long").alias("amount"), (F.col("event_id") % 13 == 0).alias("own_key"))
    end = spark.createDataFrame([("click", "end", "2030-01-01 00:00:00", 10**9, 1, False)], "kind string, scope string, ts string, seq long, amount long, own_key boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    limits = {k: (40, 120) for k in ("click", "view", "purchase", "signup")}
    paths = shuffled(spark, r.unionByName(end), str(tmp_path))
    got = run(spark, paths, r.schema, lambda s: stateful.quota_admission(s, limits, "4 days"), str(tmp_path)).where("scope <> 'end'")
    want = telemetry.quota_admission(r, limits)
    assert same(got.select("kind", "scope", "ts", "seq", "amount", "admitted"), want.select("kind", "scope", "ts", "seq", "amount", "admitted"))
    assert got.where("admitted").count() > 20 and got.where("not admitted").count() > 20


@needs_tables
def test_cache_stream_equals_batch(spark, tmp_path):
    ops = derived._cache_ops(spark, DIR).withColumn("ts", F.col("ts").cast("timestamp"))
    end = spark.sql("select 'search' as kind, 'end' as key, timestamp'2030-01-01' as ts, 1000000000L as seq, 'get' as op, '' as value")
    paths = shuffled(spark, ops.unionByName(end), str(tmp_path))
    got = run(spark, paths, ops.schema, lambda s: stateful.cache_reads(s, late="4 days"), str(tmp_path)).where("key <> 'end'")
    assert same(got, telemetry.cache_reads(ops).select(got.columns)) and 0 < got.where("hit").count() < got.count()


@needs_tables
def test_jobs_stream_equals_batch(spark, tmp_path):
    events = derived._job_events(spark, DIR).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("id", F.regexp_replace("id", "-.*", ""))
    end = spark.sql("select 'end' as id, timestamp'2030-01-01' as ts, 1000000000L as seq, 'consume' as event")
    paths = shuffled(spark, events.unionByName(end), str(tmp_path))
    got = run(spark, paths, events.schema, lambda s: stateful.job_grants(s, 1000, "4 days"), str(tmp_path)).where("id <> 'end'")
    assert same(got, telemetry.job_grants(events).select(got.columns)) and got.where("granted").count() == got.where("granted").select("id").distinct().count() > 3


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    table = ledger.DayTable(spark, "file://" + str(tmp_path / "t"), {"dep": "string", "ok": "boolean"}, items=3, seconds=1e9)
    day = lambda n, *rows: spark.createDataFrame([(f"2024-01-0{n}", *r) for r in rows], "day string, dep string, ok boolean, n long").withColumn("day", F.col("day").cast("date"))
    table.add(day(1, ("llm", True, 1)), 0)
    assert table.read().count() == 0  # waits for more
    table.add(day(1, ("llm", True, 2), ("epmc", False, 1)), 1)
    read = lambda: sorted((str(r.day), r.dep, r.ok, r.n) for r in table.read().collect())
    first = [("2024-01-01", "epmc", False, 1), ("2024-01-01", "llm", True, 3)]
    assert read() == first
    table.add(day(1, ("llm", True, 2), ("epmc", False, 1)), 1)  # comes again
    table.flush()
    assert read() == first
    table.add(day(2, ("llm", True, 5)), 2)
    assert read() == [*first, ("2024-01-02", "llm", True, 5)]
    table.add(day(1, ("llm", True, 1)), 3)
    table.add(day(1, ("llm", True, 1)), 3)
    table.flush()
    assert read()[1] == ("2024-01-01", "llm", True, 4)


def test_a_stop_between_table_and_clearing(spark, tmp_path, monkeypatch):
    table = ledger.DayTable(spark, "file://" + str(tmp_path / "t"), {"channel": "string"}, keep=2, items=1, seconds=1e9)
    rows = lambda d, n: spark.createDataFrame([(d, "知乎", n)], "day string, channel string, n long").withColumn("day", F.col("day").cast("date"))
    real = table._delete
    monkeypatch.setattr(table, "_delete", lambda path: (_ for _ in ()).throw(OSError("stopped")) if "/pending/" in path else real(path))
    with pytest.raises(OSError):
        table.add(rows("2024-01-01", 2), 0)
    monkeypatch.setattr(table, "_delete", real)
    table.add(rows("2024-01-01", 2), 0)  # the batch comes again after the restart
    assert [r.n for r in table.read().collect()] == [2]
    table.add(rows("2024-01-02", 1), 1)
    table.add(rows("2024-01-03", 1), 2)
    assert sorted(str(r.day) for r in table.read().collect()) == ["2024-01-02", "2024-01-03"]


def test_health_log_stream_and_metrics(spark, tmp_path):
    calls = spark.createDataFrame([("2024-01-01 01:00:00", "llm", True), ("2024-01-01 02:00:00", "nobody", None), ("2024-01-02 02:00:00", "llm", False)] * 10, "t string, dep string, ok boolean").select(F.col("t").cast("timestamp").alias("ts"), "dep", "ok")
    calls.repartition(3).write.parquet(str(tmp_path / "in"))
    listener = metrics.Progress()
    spark.streams.addListener(listener)
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).observe("calls", F.count(F.lit(1)).alias("n"))
    for _ in range(2):
        q, table = ledger.health_log(stream, "file://" + str(tmp_path / "log"), str(tmp_path / "cp"), True, seconds=0.0)
        q.awaitTermination()
    table.flush()
    assert sorted((str(r.day), r.dep, r.ok, r.n) for r in table.read().collect()) == [("2024-01-01", "llm", True, 10), ("2024-01-01", "other", False, 10), ("2024-01-02", "llm", False, 10)]
    assert listener.ended.wait(20)
    rows = listener.table(spark).where("rows > 0").collect()
    assert sum(r.rows for r in rows) == 30 and all(r.error is None for r in rows) and '"n": ' in rows[0].observed
    spark.streams.removeListener(listener)


def test_spans_and_observed_values(spark):
    log = metrics.Log()
    with log.span("search", q="x"):
        pass
    with pytest.raises(ValueError), log.span("fetch"):
        raise ValueError("broken")
    table = log.table(spark).withColumn("ts", F.col("at").cast("timestamp")).withColumn("seq", F.monotonically_increasing_id())
    assert [(r.name, r.failed) for r in telemetry.spans(table).orderBy("ts").collect()] == [("search", False), ("fetch", True)]
    assert "→ search (q=x)" in [r.message for r in table.collect()] and len(telemetry.tail(table, 2).collect()) == 2
    df, seen = metrics.measured(spark.range(100), "range", rows=F.count(F.lit(1)), top=F.max("id"))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 100, "top": 99}
    old = spark.sql("select timestamp'2024-01-01' as ts union all select timestamp'2024-01-15 10:00:00'")
    assert telemetry.pruned(old, F.lit("2024-01-16").cast("date")).count() == 1


def test_rolling_health_with_gaps(spark):
    rows = [("2024-01-01", "a", True), ("2024-01-01", "a", False), ("2024-01-09", "a", True), ("2024-01-05", None, True), (None, "a", True)]
    c = spark.createDataFrame(rows, "t string, dep string, ok boolean").select(F.col("t").cast("timestamp").alias("ts"), "dep", "ok")
    got = {(str(r.day), r.dep): (r.ok, r.fail, r.rate) for r in telemetry.health_rolling(c).collect()}
    assert got[("2024-01-07", "a")] == (1, 1, 50.0) and got[("2024-01-08", "a")] == (0, 0, None) and got[("2024-01-09", "a")] == (1, 0, 100.0) and len(got) == 10
