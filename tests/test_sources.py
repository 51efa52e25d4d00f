"""Paged reads, searches kept in a cache, pulled counts, and exports of one file."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from evispark.sources import onefile, paged


@pytest.fixture()
def service(tmp_path):
    ids = [f"r{i}" for i in range(23)]
    (tmp_path / paged.FolderTransport.reply("heart")).write_text(json.dumps({"total": 57, "translation": " heart[all] ", "ids": ids}))
    (tmp_path / paged.FolderTransport.reply("nothing")).write_text(json.dumps({"total": 0, "ids": []}))
    for i in ids:
        if i != "r7":
            (tmp_path / i).write_text(f"<a>{i}</a>")
    return "file://" + str(tmp_path)


def test_pages_are_partitions(spark, service):
    df = paged.read(spark, paged.FolderTransport, "heart", 20, root=service, page=6, wait=0)
    rows = df.orderBy("ord").collect()
    assert [r.id for r in rows] == [f"r{i}" for i in range(20)] and df.rdd.getNumPartitions() == 4
    assert {r.total for r in rows} == {57} and {r.translation for r in rows} == {"heart[all]"}
    assert [(r.id, r.error) for r in rows if r.error] == [("r7", "not fetched")] and rows[3].record == "<a>r3</a>"
    assert paged.read(spark, paged.FolderTransport, "nothing", root=service).count() == 0


def test_bounds_leave_out_pages(spark, service):
    df = paged.read(spark, paged.FolderTransport, "heart", 20, root=service, page=6, wait=0).where("ord >= 7 and ord < 12")
    assert df.rdd.getNumPartitions() == 1 and [r.ord for r in df.orderBy("ord").collect()] == [7, 8, 9, 10, 11]
    assert paged.read(spark, paged.FolderTransport, "heart", 20, root=service, page=6).where("ord = 13").select("id").collect()[0][0] == "r13"


class Flaky(paged.FolderTransport):
    """Fails for good on the second page, and once on each other."""

    seen: set = set()

    def ids(self, query, start, size):
        if start == 6 or start not in self.seen:
            self.seen.add(start)
            raise TimeoutError(f"page {start}")
        return super().ids(query, start, size)


def test_failures_are_rows(spark, service):
    rows = paged.read(spark, "tests.test_sources:Flaky", "heart", 12, root=service, page=6, wait=0, tries=2).orderBy("ord").collect()
    assert [(r.ord, r.error) for r in rows if r.id is None] == [(6, "TimeoutError: page 6")] and sum(r.record is not None for r in rows) == 6
    (lost,) = paged.read(spark, paged.FolderTransport, "unknown", root=service, wait=0, tries=1).collect()
    assert lost.total is None and lost.id is None and "FileNotFoundError" in lost.error


def test_cache_is_asked_first(spark):
    wanted = spark.createDataFrame([("a", 20, "relevance"), ("a", 20, "relevance"), ("b", 20, "relevance"), ("c", 5, "date"), ("d", 5, "date")], "query string, limit int, sort string")
    keys = {r.query: r.key for r in wanted.withColumn("key", paged.cache_key(F.col("query"), F.col("limit"), F.col("sort"))).collect()}
    kind = "key string, total long, translation string, ord long, id string, record string"
    cache = spark.createDataFrame([(keys["a"], 9, "A", 0, "1", "one"), ("other", 1, "", 0, "2", "two")], kind)
    calls = spark.sparkContext.accumulator(0)

    def fetch(asked):
        def run(batches):
            for pdf in batches:
                for q, key in zip(pdf["query"], pdf["key"]):
                    calls.add(1)
                    rows = {"b": [(key, 2, "B", 0, "7", "x", None), (key, 2, "B", 1, "8", "y", None)], "c": [], "d": [(key, 3, "D", 0, None, None, "timeout")]}[q]
                    import pandas as pd
                    yield pd.DataFrame(rows, columns=["key", "total", "translation", "ord", "id", "record", "error"])
        return asked.mapInPandas(run, kind + ", error string")

    every, new = paged.search_cached(wanted, cache, fetch)
    got = sorted((r.key == keys["a"], r.record) for r in every.where("error is null").collect())
    assert got == [(False, "x"), (False, "y"), (True, "one")] and calls.value == 3
    assert {r.key for r in new.collect()} == {keys["b"]}


def test_pulled_counts(spark):
    channels = spark.createDataFrame([("W1", "知乎", 10, 5, "n"), ("W1", "小红书", 1, None, "")], "week string, channel string, impressions long, landing_uv long, note string")
    replies = spark.createDataFrame([("W1", '{"知乎": 12, "nobody": 3, "B站": "x", "微信群": 4.0, "小红书": true}'), ("W2", "{broken"), ("W3", None), ("W4", '{"知乎": 1}')], "week string, json string")
    got = {(r.week, r.channel): (r.impressions, r.landing_uv, r.note) for r in paged.pulled(channels, replies).collect()}
    assert got[("W1", "知乎")] == (10, 12, "n") and got[("W1", "小红书")] == (1, None, "") and got[("W4", "知乎")] == (None, 1, None)
    assert ("W1", "nobody") not in got and ("W1", "B站") not in got


def test_one_csv(spark, tmp_path):
    path = tmp_path / "out.csv"
    path.write_text("old")
    df = spark.range(100).selectExpr("id", "if(id % 7 = 0, null, concat('a, \"', id, '\"')) as `t x`").repartition(5).orderBy("id")
    onefile.write(df, str(path))
    data = path.read_bytes()
    assert data.startswith("﻿id,t x\r\n0,\r\n1,\"a, \"\"1\"\"\"\r\n".encode()) and data.count("﻿".encode()) == 1 and data.count(b"\r\n") == 101
    assert [p.name for p in tmp_path.iterdir()] == ["out.csv"]


def test_a_failed_task_leaves_the_old_file(spark, tmp_path):
    path = tmp_path / "out.csv"
    path.write_text("old")
    bad = spark.range(100).repartition(4).selectExpr("if(id = 50, raise_error('no'), id) as id")
    with pytest.raises(Exception, match="no"):
        onefile.write(bad, str(path))
    assert path.read_text() == "old" and [p.name for p in tmp_path.iterdir()] == ["out.csv"]
    with pytest.raises(Exception, match="kind is"):
        onefile.write(spark.range(3), str(path), "xlsx")


def test_one_zip_and_text(spark, tmp_path):
    rows = [(f"dir/文{i}.md", ("line %d\n" % i) * i) for i in range(40)] + [("empty", None)]
    onefile.write(spark.createDataFrame(rows, "name string, content string").repartition(6), str(tmp_path / "b.zip"), "zip")
    with zipfile.ZipFile(tmp_path / "b.zip") as z:
        assert z.testzip() is None and {n: z.read(n).decode() for n in z.namelist()} == {n: c or "" for n, c in rows}
    onefile.write(spark.range(30).orderBy("id").selectExpr("cast(id as string) as line"), str(tmp_path / "t.md"), "text")
    assert (tmp_path / "t.md").read_text() == "".join(f"{i}\n" for i in range(30))
    onefile.write(spark.range(0).selectExpr("cast(id as string) as line"), str(tmp_path / "t.md"), "text")
    assert (tmp_path / "t.md").read_text() == ""


def test_zip_beyond_four_gigabytes():
    """Offsets that 32 bits do not hold."""
    at, name = 5 << 32, b"far"
    entry = onefile._central(name, 1, 2, 3, at)
    assert entry[-12:-8] == b"\1\0\10\0"[:4] and int.from_bytes(entry[-8:], "little") == at
    assert onefile._ending(70_000, 10, at).startswith(b"PK\6\6")


def test_exports_in_order(spark, tmp_path):
    from evispark.sources import sinks

    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "ord int, text string").repartition(3)
    sinks.export_csv(df, str(tmp_path / "x.csv"), "ord")
    assert (tmp_path / "x.csv").read_bytes() == "\ufefford,text\r\n1,a\r\n2,\r\n3,c\r\n".encode()
    sinks.export_text(df, str(tmp_path / "x.md"))
    assert (tmp_path / "x.md").read_text() == "a\n\nc\n"
    sinks.keep_state(df.where("ord = 3"), str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == {"ord": 3, "text": "c"}
    sinks.export_zip(df.selectExpr("concat('f', ord) as name", "text as content"), str(tmp_path / "x.zip"))
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        assert sorted(z.namelist()) == ["f1", "f2", "f3"] and z.read("f2") == b""
