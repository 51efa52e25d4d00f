"""Appraisal and grade overviews, concept reports, translation segments, jobs, usage and other bookkeeping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import lexicon as L
from evispark.operators import vocab

#: Longest segment sent for translation, least place of a cut inside a sentence, characters after which one is cut.
SEGMENT, CUT_FROM, CUT_AT = 450, 200, "。；;，,）)．."
FINISHED_KEPT = 30


def _dimension(profiles: DataFrame) -> DataFrame:
    """Profiles with their design's appraisal tools and starting grade; an unknown design has no tools."""
    from evispark.operators import extract

    dim = extract.dimension(profiles.sparkSession).select(F.col("design").alias("_d"), F.col("toolkit").alias("_tools"), F.col("grade").alias("_grade"))
    known = profiles.withColumn("design", F.coalesce("design", F.lit(L.UNKNOWN_DESIGN)))
    return known.join(F.broadcast(dim), F.col("design") == F.col("_d"), "left").drop("_d")


def _tools(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\s*[,、/]\s*"), lambda x: F.trim(x)), lambda x: (x != "") & (x != "—"))


def appraisal_overview(profiles: DataFrame) -> DataFrame:
    """``tool, n``: articles for each appraisal tool, and of a null tool those whose design has none."""
    t = _dimension(profiles).withColumn("t", _tools(F.col("_tools")))
    return t.select(F.explode_outer("t").alias("tool")).groupBy("tool").agg(F.count(F.lit(1)).alias("n"))


def grade_overview(profiles: DataFrame) -> DataFrame:
    """``level, n``: articles for each starting grade."""
    return _dimension(profiles).groupBy(F.coalesce(F.col("_grade"), F.lit("待定")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def ordered_conflicts(conflicts: DataFrame) -> DataFrame:
    """Conflicts with ``rank``: opposite directions first, then the most studies."""
    w = Window.orderBy(F.when(F.col("type") == "效应方向", 0).otherwise(1), F.desc("count"), "term")
    return conflicts.withColumn("rank", F.row_number().over(w))


def concept_report(keywords: DataFrame, known: DataFrame) -> DataFrame:
    """``id, skipped, reason, concepts, matched`` of ``keywords(id, keyword)``: a blank or hand-written expression is skipped."""
    k = F.trim(F.coalesce("keyword", F.lit("")))
    reason = F.when(k == "", "blank").when(~vocab.is_plain(F.col("keyword")), "expression").otherwise("")
    rows = keywords.select("id", "keyword", reason.alias("reason"))
    found = vocab.split_concepts(rows.where("reason = ''").select("id", "keyword"), known)
    n = found.groupBy("id").agg(F.count(F.lit(1)).alias("concepts"), F.count("heading").alias("matched"))
    zero = F.lit(0).cast("long")
    return rows.join(n, "id", "left").select("id", (F.col("reason") != "").alias("skipped"), "reason", F.coalesce("concepts", zero).alias("concepts"), F.coalesce("matched", zero).alias("matched"))


def best_translation(candidates: Column) -> Column:
    """The first candidate that is a compact Chinese term: at most twelve characters, without punctuation and particles; else ''."""
    clean = F.transform(candidates, lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    good = F.filter(clean, lambda c: c.rlike("[一-鿿]") & (F.length(c) <= 12) & ~c.rlike("[。，！？；、：''\"“”()（）.,]") & ~c.rlike("[的地得了们这样那很]"))
    return F.coalesce(F.get(good, F.lit(0)), F.lit(""))


def segments(sentences: Column) -> Column:
    """Sentences packed into segments of at most ``SEGMENT`` characters; a longer sentence is cut after its last mark."""
    @F.pandas_udf("array<string>")
    def packed(col: pd.Series) -> pd.Series:
        return pd.Series([_pack(list(s) if s is not None else []) for s in col])

    return packed(sentences)


def _pack(sentences: list[str]) -> list[str]:
    done, now = [], ""
    for s in sentences:
        joined = f"{now} {s}".strip()
        if len(now) + len(s) < SEGMENT:
            now = joined
            continue
        done += [now] if now else []
        while len(s) > SEGMENT:
            at = max(s.rfind(mark, CUT_FROM, SEGMENT) for mark in CUT_AT) + 1
            at = at if at > CUT_FROM else SEGMENT
            done.append(s[:at])
            s = s[at:]
        now = s
    return done + ([now] if now else [])


def translation_plan(texts: DataFrame, cache: DataFrame, pair: str = "en|zh-CN") -> DataFrame:
    """``id, ord, segment, key, translation`` of ``texts(id, sentences)``; the translation is null where the cache ``(key, value)`` has none."""
    from evispark.functions import text as X

    s = texts.select("id", F.posexplode(segments(F.col("sentences"))).alias("ord", "segment")).withColumn("key", X.digest(F.col("segment"), F.lit(pair)))
    return s.join(cache.select("key", F.col("value").alias("translation")).dropDuplicates(["key"]), "key", "left").select("id", "ord", "segment", "key", "translation")


def kept_jobs(jobs: DataFrame, keep: int = FINISHED_KEPT) -> DataFrame:
    """Jobs ``(id, status, created)``: all that run and the newest ``keep`` of those that ended."""
    ended = F.col("status").isin("done", "error")
    newest = jobs.where(ended).orderBy(F.desc("created"), F.desc("id")).limit(keep)
    return jobs.where(~F.coalesce(ended, F.lit(False))).unionByName(newest)


def is_running(jobs: DataFrame) -> DataFrame:
    """``key`` of jobs that have not ended, so that none is started twice."""
    return jobs.where(F.col("status").isin("running", "pending") & (F.coalesce("key", F.lit("")) != "")).select("key").distinct()


def usage(admitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of admitted requests: ``scope, kind, used`` over all days and ``day, kind, used`` over all scopes."""
    ok = admitted.where("admitted")
    return (ok.groupBy("scope", "kind").agg(F.sum("amount").alias("used")), ok.groupBy(F.to_date("ts").alias("day"), "kind").agg(F.sum("amount").alias("used")))


def last_block(admitted: DataFrame) -> DataFrame:
    """``kind, scope, ts`` of the latest refused request; no row where none was refused."""
    return admitted.where("not admitted").orderBy(F.desc("ts"), F.desc("seq")).limit(1).select("kind", "scope", "ts")


def health_line(summary: DataFrame, errors: int, days: int = 7) -> DataFrame:
    """``line`` of a health table ``(dep, ok, fail, rate)``; a short remark without calls."""
    s = summary.where(F.col("ok") + F.col("fail") > 0)
    part = F.concat("dep", F.lit(" "), F.col("rate").cast("string"), F.lit("%("), (F.col("ok") + F.col("fail")).cast("string"), F.lit(")"))
    parts = s.agg(F.array_sort(F.collect_list(part)).alias("p"))
    return parts.select(F.when(F.size("p") == 0, f"近 {days} 天无外部调用记录").otherwise(F.concat(F.lit(f"近 {days} 天成功率 · "), F.array_join("p", " / "), F.lit(f" · 错误 {errors} 次"))).alias("line"))


def attempted(rows: DataFrame, fetch: Callable[[str], str], key: str = "key") -> DataFrame:
    """``key, ok, value, error``: ``fetch`` of each key; one that fails is a row with its error and stops no other."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k in pdf["key"]:
                try:
                    out.append((k, True, fetch(k), None))
                except Exception as e:  # noqa: BLE001  the error is the row's result
                    out.append((k, False, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["key", "ok", "value", "error"])

    return rows.select(F.col(key).cast("string").alias("key")).mapInPandas(run, "key string, ok boolean, value string, error string")


def split_narrative(drafts: DataFrame) -> DataFrame:
    """``id, ord, heading, body`` of Markdown ``drafts(id, text)`` by headings of the second level; what is before the first has no heading."""
    parts = F.split(F.concat(F.lit("\n"), F.coalesce("text", F.lit(""))), r"\n##\s+")
    p = drafts.select("id", F.posexplode(parts).alias("ord", "part"))
    first = F.col("ord") == 0
    heading = F.when(first, "").otherwise(F.trim(F.regexp_extract("part", r"^([^\n]*)", 1)))
    body = F.when(first, F.trim("part")).otherwise(F.trim(F.regexp_replace("part", r"^[^\n]*", "")))
    return p.select("id", "ord", heading.alias("heading"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body")).where("heading <> '' or body <> ''")
