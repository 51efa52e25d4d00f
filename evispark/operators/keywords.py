"""Keyword weights, sentence scores and the greedy choice of summary sentences."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.functions import lexicon as L
from evispark.functions import text as X
from evispark.sources import staging


#: Bytes of text that one task takes apart; its distinct terms take about eight times as much.
DEALT = 8 << 20


def _dealt(units: DataFrame, unit: str, text: str) -> DataFrame:
    """``units(unit, text)`` dealt by unit into tasks of about ``DEALT`` bytes of text, since what a task counts in grows with its texts' distinct terms."""
    size = int(units.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])
    return units.select(unit, text).repartition(max(units.sparkSession.sparkContext.defaultParallelism, -(-size // DEALT)), unit)


def _runs(terms: Column) -> Column:
    """Sorted terms as ``(term, new)``, where ``new`` counts the first of equal ones; no term is blank."""
    before = F.concat(F.array(F.lit("")), terms)
    return F.filter(F.zip_with(terms, before, lambda t, b: F.struct(t.alias("term"), (t != b).cast("long").alias("new"))), lambda x: x["term"].isNotNull())


def _counted(units: DataFrame, text: str) -> DataFrame:
    """``units``: how many have a token. A Latin letter begins one, so most texts are not taken apart for it."""
    return units.agg(F.count_if(F.coalesce(F.col(text).rlike("[A-Za-z]") | (F.size(X.tokens(F.col(text))) > 0), F.lit(False))).alias("units"))


def _weigh(terms: DataFrame, units: DataFrame, text: str) -> DataFrame:
    """``term, tf, df, weight`` of ``terms(a array)``, an array for each unit. A term's units are told apart in the array, so one shuffle is enough."""
    per = terms.select(F.sort_array("a").alias("a")).select(F.inline(_runs(F.col("a")))).groupBy("term").agg(F.count(F.lit(1)).alias("tf"), F.sum("new").alias("df"))
    return per.crossJoin(F.broadcast(_counted(units, text))).withColumn("weight", F.col("tf") * (0.35 + F.log1p(F.col("units") / (1 + F.col("df"))))).drop("units")


def token_weights(units: DataFrame, unit: str = "unit", text: str = "text", stop: list[str] | None = None) -> DataFrame:
    """``term, tf, df, weight`` of candidate tokens: ``tf * (0.35 + ln(1 + N / (1 + df)))`` over N units that have tokens."""
    return _token_weights(_dealt(units, unit, text), text, stop)


def _token_weights(units: DataFrame, text: str, stop: list[str] | None) -> DataFrame:
    return _weigh(units.select(F.filter(X.tokens(F.col(text)), lambda t: X.is_candidate(t, stop)).alias("a")), units, text)


def phrase_weights(units: DataFrame, unit: str = "unit", text: str = "text", stop: list[str] | None = None) -> DataFrame:
    """``term, tf, df, weight`` of two candidates side by side, twice or more, at 1.45 times a token's weight."""
    return _phrase_weights(_dealt(units, unit, text), text, stop)


def _phrase_weights(units: DataFrame, text: str, stop: list[str] | None) -> DataFrame:
    t = units.select(X.tokens(F.col(text)).alias("t"))
    t = t.withColumn("ok", F.transform("t", lambda w: X.is_candidate(w, stop)))
    pair = F.zip_with(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", 2, F.size("t")), lambda a, b: F.concat(a, F.lit(" "), b))
    good = F.zip_with(F.slice("ok", 1, F.greatest(F.size("ok") - 1, F.lit(0))), F.slice("ok", 2, F.size("ok")), lambda a, b: a & b)
    kept = F.filter(F.zip_with(pair, good, lambda p, g: F.when(g, p)), lambda p: p.isNotNull())
    return _weigh(t.select(kept.alias("a")), units, text).where("tf >= 2").withColumn("weight", F.col("weight") * 1.45)


def keywords(units: DataFrame, top: int = 20, unit: str = "unit", text: str = "text", stop: list[str] | None = None) -> DataFrame:
    """``rank, term, weight, count``: tokens, phrases and Chinese terms, best first.

    A phrase is passed over if one of its words is in a phrase taken before; if it
    is taken, words taken before that hardly stand outside of it (at most 1.2 times
    its count) give their places up, and later ones are passed over. A Chinese term
    that shares a character with one taken is passed over. Each choice depends on
    those before, so it is a fold, over the best; where they give fewer than ``top``,
    over four times as many, until there are ``top`` or no more terms. The weights
    are written, so that this costs no second count.
    """
    units = _dealt(units, unit, text)
    zh = _chinese_grams(units, unit, text, 2)
    zh = zh.crossJoin(F.broadcast(_counted(units, text))).select("gram", "tf", "df", (F.col("tf") * (0.35 + F.log1p(F.col("units") / (1 + F.col("df"))))).alias("weight")).withColumnRenamed("gram", "term")
    every = _token_weights(units, text, stop).unionByName(_phrase_weights(units, text, stop)).unionByName(zh)
    every, _ = staging.written(every.select("term", "tf", "weight"), "keyword-weights")
    most, size = every.count(), 20 * top
    while True:
        picks = _picked(every.orderBy(F.desc("weight"), "term").limit(size), top)
        if size >= most or picks.count() >= top:
            return picks
        size *= 4


def _picked(best: DataFrame, top: int) -> DataFrame:
    """``rank, term, weight, count``: what the fold takes of ``best(term, tf, weight)``."""
    rows = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "term", "tf"))).alias("a"))
    kind = "struct<p:array<struct<w:double,term:string,tf:bigint>>,c:array<struct<word:string,n:bigint>>>"
    zero = F.struct(F.array().alias("p"), F.array().alias("c")).cast(kind)
    little = lambda a, b: a <= b * 1.2
    chars = lambda t: F.split(t, "")

    def step(z, x):
        words = F.split(x["term"], " ")
        latin = x["term"].rlike("^[A-Za-z]")
        covered = F.exists(z["c"], lambda c: F.array_contains(words, c["word"]))
        given = F.filter(z["p"], lambda t: ~(F.array_contains(words, t["term"]) & little(t["tf"], x["tf"])))
        phrase = F.struct(F.array_append(given, x).alias("p"), F.concat(z["c"], F.transform(words, lambda w: F.struct(w.alias("word"), x["tf"].alias("n")))).alias("c")).cast(kind)
        held = F.exists(z["c"], lambda c: (c["word"] == x["term"]) & little(x["tf"], c["n"]))
        shared = ~latin & F.exists(z["p"], lambda t: ~t["term"].rlike("^[A-Za-z]") & F.arrays_overlap(chars(t["term"]), chars(x["term"])))
        token = F.struct(F.array_append(z["p"], x).alias("p"), z["c"].alias("c")).cast(kind)
        return (F.when(F.size(z["p"]) >= top, z).when(F.size(words) > 1, F.when(covered, z).otherwise(phrase)).when(held | shared, z).otherwise(token))

    picked = rows.select(F.posexplode(F.aggregate("a", zero, step)["p"]).alias("rank", "x"))
    return picked.select((F.col("rank") + 1).alias("rank"), "x.term", (-F.col("x.w")).alias("weight"), F.col("x.tf").alias("count"))


def chinese_grams(units: DataFrame, unit: str = "unit", text: str = "text", least: int = 2) -> DataFrame:
    """``gram, tf, df``: runs of 2 to 4 Chinese characters with ``least`` places that no longer gram, one character wider, covers equally often.

    Grams with a function character and stock words of papers are none.
    """
    return _chinese_grams(_dealt(units, unit, text), unit, text, least)


def _chinese_grams(units: DataFrame, unit: str, text: str, least: int) -> DataFrame:
    runs = units.select(unit, F.regexp_extract_all(F.col(text), F.lit("[一-鿿]{2,}"), F.lit(0)).alias("r")).groupBy(unit).agg(F.flatten(F.collect_list("r")).alias("r"))
    cut = lambda r, n: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - n + 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = F.filter(F.flatten(F.transform("r", lambda r: F.concat(cut(r, 2), cut(r, 3), cut(r, 4)))), lambda g: ~g.rlike(f"[{L.ZH_STOP}]") & ~g.isin(*L.ZH_WORD_STOP))
    each = runs.select(F.sort_array(grams).alias("a")).select(F.inline(_runs(F.col("a")))).withColumnRenamed("term", "gram")
    tf = each.groupBy("gram").agg(F.count(F.lit(1)).alias("tf"), F.sum("new").alias("df")).where(F.col("tf") >= least)
    wide = tf.where(F.length("gram") > 2).select("tf", F.explode(F.array(F.expr("left(gram, length(gram)-1)"), F.expr("right(gram, length(gram)-1)"))).alias("gram"))
    cover = wide.groupBy("gram").agg(F.max("tf").alias("over"))
    return tf.join(cover, "gram", "left").where(F.col("over").isNull() | (F.col("tf") > F.col("over"))).select("gram", "tf", "df")


_SCORED = "array<struct<pos:int,n:int,sentence:string,tokens:array<string>,score:double>>"


def _scores(tokens, title, label, number, stops: frozenset) -> list[float]:
    """Scores of one text's sentences from their tokens, the title's tokens, label weights and whether they hold a number."""
    content = [[t for t in s if t not in stops and len(t) > 1] for s in tokens]
    tf = Counter(t for s in content for t in s)
    df = Counter(t for s in content for t in set(s))
    words, n, out = {t for t in title if t not in stops}, len(tokens), []
    for i, (own, s) in enumerate(zip(content, tokens)):
        mean = sum(tf[t] / (1 + math.log(df[t])) for t in own) / len(own) if own else 0.0
        place = 1.25 if i == 0 else 1.1 if i < n * 0.25 else 1.0
        topic = 1 + min(0.5, len(words.intersection(s)) / len(words) if words else 0.0)
        out.append(mean * label[i] * place * (1.15 if number[i] else 1.0) * topic * min(len(s) / 15.0, 1.15))
    return out


def _chosen(tokens, scores: list[float], keep: int) -> list[int]:
    """The sentences of a summary, in text order: by score, those that differ enough from those taken before, in three passes."""
    order = sorted((i for i, x in enumerate(scores) if x > 0), key=lambda i: (-scores[i], i))
    sets, taken = [set(t) for t in tokens], []
    for limit in (0.55, 0.75, 1.0):
        for i in order:
            if len(taken) >= keep:
                break
            if i in taken or any(len(sets[i] & sets[j]) > limit * len(sets[i] | sets[j]) for j in taken):
                continue
            taken.append(i)
    return sorted(taken) or [0]


def _with_scores(docs: DataFrame, text: str, title: str | None, stop: list[str] | None) -> DataFrame:
    """``docs`` with ``_p``: sentences, tokens and all that their scores take, by column expressions."""
    named = lambda s: F.lower(F.regexp_extract(s, r"^\s*([A-Za-z一-鿿]{2,20}?)\s*[:：]", 1))
    one = lambda s: F.struct(s.alias("sentence"), X.tokens(s).alias("tokens"), F.coalesce(F.try_element_at(X._map(L.SENTENCE_WEIGHTS), named(s)), F.lit(1.0)).alias("label"), (F.size(X.numbers(s)) > 0).alias("number"))
    d = docs.withColumn("_s", X.sentences(F.col(text)))
    return d.withColumn("_p", F.transform("_s", one)).withColumn("_t", F.array_distinct(X.tokens(F.col(title) if title else F.lit("")))).drop("_s")


def _stops(stop: list[str] | None) -> frozenset:
    return frozenset(L.ENGLISH_STOP + L.GENERIC_STOP + list(L.ZH_STOP) if stop is None else stop)


def sentence_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", title: str | None = None, stop: list[str] | None = None) -> DataFrame:
    """``key, pos, n, sentence, tokens, score``: mean weight of content tokens, ``tf / (1 + ln df)``, times section label, position, numbers, title words and length.

    A score takes nothing from other texts, so a text's sentences are scored in one
    batch function, without a shuffle. ``stop`` are the words without content; the
    default has function words. The list of academic phrases is long, so it is the
    caller's.
    """
    stops = _stops(stop)

    @F.pandas_udf(_SCORED)
    def scored(parts: pd.Series, title: pd.Series) -> pd.Series:
        out = []
        for p, t in zip(parts, title):
            tokens = [list(x["tokens"]) for x in p]
            s = _scores(tokens, list(t), [x["label"] for x in p], [x["number"] for x in p], stops)
            out.append([{"pos": i, "n": len(p), "sentence": x["sentence"], "tokens": k, "score": v} for i, (x, k, v) in enumerate(zip(p, tokens, s))])
        return pd.Series(out)

    return _with_scores(docs, text, title, stop).select(key, F.inline(scored("_p", "_t")))


def summaries(docs: DataFrame, ratio: float = 0.3, most: int = 5, key: str = "doc_id", text: str = "text", title: str | None = None, stop: list[str] | None = None) -> DataFrame:
    """``key, pos, sentence``: the chosen sentences in text order.

    Three passes over the sentences by score take what differs enough from those
    taken before: Jaccard at most 0.55, then 0.75, then any. Where no sentence has a
    score, the first one stands; texts without sentences give no rows.
    """
    stops = _stops(stop)

    @F.pandas_udf("array<struct<pos:int,sentence:string>>")
    def chosen(parts: pd.Series, title: pd.Series) -> pd.Series:
        out = []
        for p, t in zip(parts, title):
            if not len(p):
                out.append([])
                continue
            tokens = [list(x["tokens"]) for x in p]
            s = _scores(tokens, list(t), [x["label"] for x in p], [x["number"] for x in p], stops)
            half = len(p) * ratio
            keep = max(1, min(most, round(half)))
            out.append([{"pos": i, "sentence": p[i]["sentence"]} for i in _chosen(tokens, s, keep)])
        return pd.Series(out)

    return _with_scores(docs, text, title, stop).select(key, F.inline(chosen("_p", "_t")))


def fulltext_stats(sections: DataFrame) -> DataFrame:
    """``doc_id, section, words, chars, boilerplate`` of ``sections(doc_id, title, text)``: words are runs of two Latin letters or more and single Chinese characters."""
    words = F.regexp_count("text", F.lit(r"[A-Za-z][A-Za-z'\-]+|[一-鿿]"))
    return sections.select("doc_id", F.col("title").alias("section"), words.alias("words"), F.length("text").alias("chars"), X.is_boilerplate(F.col("title")).alias("boilerplate"))


def fulltext_totals(sections: DataFrame) -> DataFrame:
    """``doc_id, words, chars, sections`` of whole documents, boilerplate too."""
    s = fulltext_stats(sections)
    return s.groupBy("doc_id").agg(F.sum("words").cast("long").alias("words"), F.sum("chars").cast("long").alias("chars"), F.count(F.lit(1)).alias("sections"))


def fulltext_summary(sections: DataFrame, most: int = 10) -> DataFrame:
    """``doc_id, ord, title, title_zh, quota, sentences`` of ``sections(doc_id, ord, title, text)``.

    Boilerplate and short sections are left out. Places go to sections by weight and
    length, the heaviest first, one at least while there are any, and the rest to
    the heaviest: a fold over a document's sections. A section gives its best
    sentences in score order.
    """
    s = sections.where(~X.is_boilerplate(F.col("title")) & (F.length("text") > 200))
    weight = F.coalesce(F.try_element_at(X._map(L.SECTION_WEIGHTS), F.lower(F.trim("title"))), F.lit(1.0))
    s = s.withColumn("w", weight * (F.length("text") + 300))
    g = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "ord"))).alias("a"), F.sum("w").alias("total"))
    zero = F.struct(F.lit(most).alias("left"), F.array().cast("array<struct<ord:int,quota:int>>").alias("q"))

    def step(z, x):
        k = F.least(F.greatest(F.lit(1), F.bround(most * -x["w"] / F.col("total")).cast("int")), z["left"])
        return F.when(z["left"] <= 0, z).otherwise(F.struct((z["left"] - k).alias("left"), F.array_append(z["q"], F.struct(x["ord"].cast("int").alias("ord"), k.alias("quota"))).alias("q")))

    g = g.withColumn("z", F.aggregate("a", zero, step)).withColumn("q", F.transform("z.q", lambda x, i: F.struct(x["ord"].alias("ord"), (x["quota"] + F.when(i == 0, F.greatest(F.col("z.left"), F.lit(0))).otherwise(0)).alias("quota"))))
    quota = g.select("doc_id", F.inline("q"))
    s = s.join(quota, ["doc_id", "ord"]).withColumn("unit", F.struct("doc_id", "ord"))
    best = sentence_scores(s, "unit").groupBy("unit").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("w"), "pos", "sentence"))).alias("a"))
    picked = F.filter(F.transform(F.slice("a", 1, F.col("quota")), lambda x: X.clean_lead(x["sentence"])), lambda x: F.length(x) > 10)
    return s.join(best, "unit").select("doc_id", "ord", X.plain_title(F.col("title")).alias("title"), X.zh_title(F.col("title")).alias("title_zh"), "quota", picked.alias("sentences"))


def metrics(sections: DataFrame, samples: int = 12) -> DataFrame:
    """``doc_id, kind, count, samples``: values of full texts without boilerplate, and the first distinct ones."""
    s = sections.where(~X.is_boilerplate(F.col("title"))).select("doc_id", "ord", F.explode(X.values(F.col("text"))).alias("v")).select("doc_id", "ord", F.col("v.ord").alias("pos"), "v.kind", "v.value")
    g = s.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list(F.struct("ord", "pos", "value"))).alias("a"))
    return g.select("doc_id", "kind", "count", F.slice(F.array_distinct(F.transform("a", lambda x: x["value"])), 1, samples).alias("samples"))
