"""Across articles: comparison table, statistics, corrections, conflicts, duplicates, screening flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import lexicon as L
from evispark.functions import text as X
from evispark.operators import extract, numbering
from evispark.sources import staging

#: A key is hot if it has one in so many of all rows; tasks over which its rows are dealt.
HOT, SALTS = 1000, 16

COMPARISON = {
    "标题": "title", "年份": "year", "期刊": "journal", "研究设计": "design", "证据等级": "cebm", "样本量": "n", "人群": "population", "主要终点": "primary_outcome", "关键效应量": "effects_text",
    "结论": "conclusion", "结论倾向": "polarity", "证据强度": "evidence.label", "偏倚提示": "bias_brief", "MeSH 主要主题": "mesh_topics", "数据来源": "source_label"}


def comparison(profiles: DataFrame, order: str = "ord") -> DataFrame:
    """The 16 visible columns. The number is the position in ``order``, a number."""
    return numbering.numbered(profiles, order, "序号").select(F.col("序号").cast("int").alias("序号"), *[F.col(c).alias(k) for k, c in COMPARISON.items()])


def md_cell(c: Column) -> Column:
    s = X.squeeze(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("／")))
    return F.when(F.length(s) <= 240, s).otherwise(F.concat(F.substring(s, 1, 240), F.lit("…")))


def summary(profiles: DataFrame) -> DataFrame:
    """``dimension, value, n`` for design, polarity and CEBM level, in one pass by grouping sets."""
    sets = profiles.groupingSets([["design"], ["polarity"], ["cebm"]], "design", "polarity", "cebm").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    which = F.when(F.col("g") == 3, "design").when(F.col("g") == 5, "polarity").otherwise("cebm")
    return sets.select(which.alias("dimension"), F.coalesce("design", "polarity", "cebm").alias("value"), "n")


def totals(profiles: DataFrame) -> DataFrame:
    y = F.substring("year", 1, 4).try_cast("int")
    return profiles.agg(F.count(F.lit(1)).alias("total"), F.min(y).alias("year_from"), F.max(y).alias("year_to"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"),
                        F.count_if(F.col("n").isNull()).alias("n_missing"), F.count_if(F.coalesce("pmcid", F.lit("")) != "").alias("with_fulltext"))


def missing_fields() -> Column:
    checks = {"研究设计": F.col("design") != L.UNKNOWN_DESIGN, "样本量": F.col("n").isNotNull(), "人群": F.col("population") != "", "主要终点": F.col("primary_outcome") != "",
              "关键效应量": F.col("effects_text") != "", "结论": F.col("conclusion") != ""}
    return F.filter(F.array(*[F.when(~F.coalesce(checks[f], F.lit(False)), F.lit(f)) for f in L.STRUCT_FIELDS]), lambda x: x.isNotNull())


def completeness(profiles: DataFrame) -> DataFrame:
    p = profiles.withColumn("missing", missing_fields()).withColumn("filled", len(L.STRUCT_FIELDS) - F.size("missing"))
    return p.withColumn("label", F.concat(F.col("filled").cast("string"), F.lit(f"/{len(L.STRUCT_FIELDS)}")))


def design_report(profiles: DataFrame) -> DataFrame:
    known = F.count_if(F.col("design") != L.UNKNOWN_DESIGN)
    return profiles.agg(F.count(F.lit(1)).alias("total"), known.alias("recognized"), (F.coalesce(F.try_divide(known * 100.0, F.count(F.lit(1))), F.lit(0.0))).alias("rate"))


def completeness_overview(profiles: DataFrame) -> DataFrame:
    """``total, avg, low``: articles, filled fields in the mean with one decimal, and articles with half of them or fewer."""
    c = completeness(profiles)
    return c.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.bround(F.avg("filled"), 1), F.lit(0.0)).alias("avg"), F.count_if(F.col("filled") <= len(L.STRUCT_FIELDS) / 2).alias("low"))


def missing_counts(profiles: DataFrame) -> DataFrame:
    """``field, n``: how many articles lack a field."""
    return profiles.select(F.explode(missing_fields()).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def unrecognised(profiles: DataFrame) -> DataFrame:
    """``title, year, pubtypes`` of articles without a known design."""
    types = F.coalesce("pubtypes", F.array().cast("array<string>")) if "pubtypes" in profiles.columns else F.array().cast("array<string>")
    return profiles.where(F.coalesce("design", F.lit(L.UNKNOWN_DESIGN)) == L.UNKNOWN_DESIGN).select("title", F.substring("year", 1, 4).alias("year"), types.alias("pubtypes"))


def by_design(profiles: DataFrame) -> DataFrame:
    """``design, n, cites``: a design's articles by first author and year, in their order."""
    who = F.coalesce(F.get(F.coalesce("authors", F.array().cast("array<string>")), F.lit(0)), F.lit("佚名"))
    year = F.coalesce(F.nullif(F.col("year"), F.lit("")), F.lit("年份不详"))
    cite = F.concat(who, F.lit(" 等（"), year, F.lit("）"))
    g = profiles.groupBy("design").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("ord", cite.alias("c")))).alias("a"))
    return g.select("design", "n", F.array_join(F.transform("a", lambda x: x["c"]), "、").alias("cites"))


def fill_targets(profiles: DataFrame) -> DataFrame:
    """``row_key, title, fields``: editable fields without a value, not corrected by hand, of articles with a text."""
    open_ = F.filter(F.map_keys("states"), lambda k: k.isin(*L.EDITABLE) & F.try_element_at("states", k).isin("not_extracted", "not_mentioned"))
    ordered = F.filter(X.lits(L.EDITABLE), lambda f: F.array_contains(open_, f))
    return profiles.where(X.filled(F.col("source"))).select("row_key", "title", ordered.alias("fields")).where(F.size("fields") > 0)


def parse_fills(replies: DataFrame, targets: DataFrame) -> DataFrame:
    """``row_key, field, value, quote`` of JSON replies ``(text)``: ``{"fills": [{"id": n, field: {"value", "quote"}}]}``.

    ``targets(id, row_key, fields)`` says what was asked; anything else, values
    without their quotes, and text that is no JSON give no rows.
    """
    body = F.regexp_extract("text", r"(?s)(\{.*\})", 1)
    rows = replies.select(F.explode(F.from_json(F.get_json_object(body, "$.fills"), "array<map<string,string>>")).alias("m"))
    one = rows.select(F.col("m")["id"].try_cast("int").alias("id"), F.explode("m").alias("field", "raw")).where("field <> 'id'")
    got = one.select("id", "field", F.trim(F.get_json_object("raw", "$.value")).alias("value"), F.trim(F.get_json_object("raw", "$.quote")).alias("quote"))
    asked = targets.select("id", "row_key", F.explode("fields").alias("field"))
    return got.join(asked, ["id", "field"]).where(X.filled(F.col("value")) & X.filled(F.col("quote"))).select("row_key", "field", "value", "quote")


def topic_terms(profiles: DataFrame, top: int = 8, least: int = 2) -> DataFrame:
    """``term, docs``: the first ``top`` keywords of titles and conclusions that stand in ``least`` articles or more."""
    from evispark.operators import keywords

    blob = profiles.select(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("conclusion", F.lit(""))).alias("t"))
    units = blob.select(F.explode(F.split("t", r"[.!?;:\n]+")).alias("text")).where("trim(text) <> ''").withColumn("unit", F.monotonically_increasing_id())
    words = keywords.keywords(units, 4 * top).where((F.length("term") >= 4) & ~F.lower("term").isin(*L.CONFLICT_STOP))
    hits = term_documents(profiles, words).groupBy("term").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= least)
    return words.join(hits, "term").orderBy("rank").limit(top).select("term", "docs")


def correct(profiles: DataFrame, corrections: DataFrame) -> DataFrame:
    """Manual values ``(row_key, field, value)`` over the five editable fields; evidence and polarity follow, nothing else does."""
    kept = corrections.where(F.col("field").isin(*L.EDITABLE)).groupBy("row_key").agg(
        *[F.max(F.when(F.col("field") == f, F.trim("value"))).alias(f) for f in L.EDITABLE])
    n = F.replace(F.regexp_extract("样本量", r"\d[\d,]*", 0), F.lit(","), F.lit("")).try_cast("long")
    j = profiles.join(kept, "row_key", "left")
    e = F.col("effects")
    new = {"n": F.when(F.col("样本量").isNotNull(), n).otherwise(F.col("n")), "population": F.coalesce("人群", "population"), "primary_outcome": F.coalesce("主要终点", "primary_outcome"),
           "effects_text": F.coalesce("关键效应量", "effects_text"), "conclusion": F.coalesce("结论", "conclusion"),
           "polarity": F.when(F.col("结论").isNotNull(), extract.polarity(F.col("结论"), extract.effect_direction(e))["label"]).otherwise(F.col("polarity")),
           "corrected": F.filter(F.array(*[F.when(F.coalesce(F.col(f), F.lit("")) != "", F.lit(f)) for f in L.EDITABLE]), lambda x: x.isNotNull())}
    j = j.withColumns(new).drop(*L.EDITABLE)
    return j.withColumn("evidence", extract.strength(F.col("base"), F.col("n"), (F.size(e["CI"]) > 0) | (F.size(e["P"]) > 0)))


def fill(profiles: DataFrame, fills: DataFrame) -> DataFrame:
    """Values ``(row_key, field, value, quote)`` for cells that are not ok; each needs its value and its quote. ``profiles`` is a stored table: what is derived again in each expression of a plan makes it too large."""
    good = fills.where(X.filled(F.col("value")) & X.filled(F.col("quote")))
    open_ = profiles.select("row_key", F.explode("states").alias("field", "state")).where("state <> 'ok'")
    return correct(profiles, good.join(open_, ["row_key", "field"], "left_semi"))


def annotate(value: Column, state: Column, corrected: Column, filled: Column, full: Column) -> Column:
    """A cell as shown: marks on own or filled values, and a reason where it is empty."""
    v = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    what = F.when(full, "原文").otherwise("摘要")
    why = F.when(state == "not_mentioned", F.concat(what, F.lit("未提及"))).when(state == "not_extracted", F.concat(F.when(full, "有原文").otherwise("有摘要"), F.lit("未抽到"))).when(state == "no_abstract", "无摘要").otherwise("")
    return F.when(v != "", F.concat(v, F.when(corrected, " ✎").when(filled, " ⧉").otherwise(""))).otherwise(why)


def _letters(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"\p{L}+"), F.lit(0)))


def term_documents(profiles: DataFrame, terms: DataFrame) -> DataFrame:
    """``profiles`` with ``term``, a row for each of their rows in whose title or conclusion a term stands and ends cleanly, with the lower-case text ``doc``.

    Terms are found through the runs of letters in them. A run inside a term is a whole
    run of the text too, and of these the rarest is the key; a term of one run may be the
    end of a longer one, which the ends of all different runs tell. A term without
    letters is found by its first sign. What is found is then looked up in the text, so
    no text meets a term of which it has nothing. Blank terms are in no text.
    """
    docs = profiles.withColumn("doc", F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("conclusion", F.lit("")))))
    asked = terms.select("term", F.lower("term").alias("low")).where("trim(term) <> ''").distinct()
    index = docs.select("row_key", F.explode(_letters(F.col("doc"))).alias("run"))
    known = index.groupBy("run").agg(F.count(F.lit(1)).alias("df"))

    inner = asked.withColumn("runs", F.array_distinct(F.regexp_extract_all("low", F.lit(r"\P{L}(\p{L}+)"), F.lit(1))))
    keyed = inner.select("term", F.explode("runs").alias("run")).join(known, "run").groupBy("term").agg(F.min(F.struct("df", "run"))["run"].alias("run"))
    ends = known.select("run", F.explode(F.transform(F.sequence(F.lit(1), F.length("run")), lambda i: F.right(F.col("run"), i))).alias("end"))
    lone = asked.where(F.col("low").rlike(r"^\p{L}+\P{L}*$") & (F.size(F.regexp_extract_all("low", F.lit(r"\P{L}(\p{L}+)"), F.lit(1))) == 0)).select("term", F.regexp_extract("low", r"^(\p{L}+)", 1).alias("end"))
    found = keyed.unionByName(lone.join(ends, "end").select("term", "run")).join(index, "run").select("term", "row_key")
    signs = docs.select("row_key", F.explode(F.array_distinct(F.split(F.regexp_replace("doc", r"[\p{L}\s]+", ""), ""))).alias("sign")).where("sign <> ''")
    bare = asked.where(~F.col("low").rlike(r"\p{L}")).select("term", F.regexp_extract("low", r"(?s)(\S)", 1).alias("sign"))
    found = found.unionByName(bare.join(signs, "sign").select("term", "row_key")).distinct()

    low = F.lower("term")
    clean = ~low.rlike(r"\p{L}$") | F.expr(r"doc rlike concat('\\Q', replace(lower(term), '\\E', '\\E\\\\E\\Q'), '\\E($|\\P{L})')")
    return docs.join(found, "row_key").where(F.contains("doc", low) & clean)


def conflicts(profiles: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms on which studies disagree: ``type, term, confidence, count, studies``, without those a wider one of the type covers."""
    hits = term_documents(profiles, terms)
    of = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("row_key"))))
    by = hits.groupBy("term").agg(of(F.col("polarity") == L.POSITIVE).alias("good"), of(F.col("polarity") == L.NULL).alias("null"), of(F.col("polarity") == L.HARM).alias("harm"),
                                  of(F.col("direction") < 0).alias("down"), of(F.col("direction") > 0).alias("up"), F.count(F.lit(1)).alias("docs")).where("docs >= 2")
    some = lambda c: F.size(c) > 0
    sides = some("good").cast("int") + some("null").cast("int") + some("harm").cast("int")
    pol = by.where(sides >= 2).select(F.lit("结论极性").alias("type"), "term", F.when(some("good"), "高").otherwise("中").alias("confidence"), F.array_union(F.array_union("good", "null"), "harm").alias("studies"))
    eff = by.where(some("down") & some("up")).select(F.lit("效应方向").alias("type"), "term", F.lit("高").alias("confidence"), F.array_union("down", "up").alias("studies"))
    both = pol.unionByName(eff).withColumn("count", F.size("studies"))
    # a wider one has all studies of a, so its first too
    a, b = both.withColumn("study", F.array_min("studies")).alias("a"), both.withColumn("study", F.explode("studies")).alias("b")
    wider = (F.col("a.type") == F.col("b.type")) & (F.col("a.study") == F.col("b.study")) & (F.size(F.array_except("a.studies", "b.studies")) == 0) & (
        (F.col("b.count") > F.col("a.count")) | ((F.col("b.count") == F.col("a.count")) & (F.col("b.term") < F.col("a.term"))))
    return a.join(b, wider, "left_anti").select("type", "term", "confidence", "count", F.array_sort("studies").alias("studies"))


def title_key(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9一-鿿]", ""), 1, 80)


def kept(articles: DataFrame, order: str = "ord", review: str | None = None) -> DataFrame:
    """``review, ord, kept`` of each article: kept is one whose pmid and title no kept article before it in ``order`` has.

    Goes in rounds over those that are open: who comes first with both of its keys is kept,
    and who shares a key with one kept is not. Blank keys are none. Articles of the same
    keys are one from the start; keys that many share are dealt to several tasks. Rounds
    are as many as the longest chain of articles, each of which hangs on the one before.
    """
    group = F.col(review).cast("string") if review else F.lit("")
    rows = articles.select(F.coalesce(group, F.lit("")).alias("review"), F.col(order).alias("ord"), F.trim(F.coalesce("pmid", F.lit(""))).alias("p"), title_key(F.col("title")).alias("t"))
    rows, _ = staging.written(rows.withColumn("at", F.struct("ord", F.monotonically_increasing_id().alias("i"))), "kept-rows")
    named = rows.where("p <> '' or t <> ''")
    open_, _ = staging.written(named.groupBy("review", "p", "t").agg(F.min("at").alias("at")), "kept-open")
    sides = lambda df: df.select("review", "at", F.explode(F.filter(F.array(F.concat(F.lit("p"), F.col("p")), F.concat(F.lit("t"), F.col("t"))), lambda k: F.length(k) > 1)).alias("key"))
    # at most HOT * 2 keys can be in so large a part of the rows
    shares = sides(open_).groupBy("review", "key").agg(F.count(F.lit(1)).alias("c"))
    every = open_.agg(F.count(F.lit(1)).alias("every"))
    hot, _ = staging.written(shares.join(F.broadcast(every)).where(F.col("c") * HOT >= F.col("every")).where("c > 1").select("review", "key", F.lit(True).alias("hot")), "kept-hot")
    taken = rows.where("false").select("review", "at")
    while open_.limit(1).count():
        keys = sides(open_)
        firsts = keys.groupBy("review", "key").agg(F.min("at").alias("at")).groupBy("review", "at").agg(F.count(F.lit(1)).alias("f"))
        new, _ = staging.written(open_.join(firsts, ["review", "at"]).where("f = cast(p <> '' as int) + cast(t <> '' as int)").drop("f"), "kept-new")
        taken = taken.unionByName(new.select("review", "at"))
        copies = sides(new).join(F.broadcast(hot), ["review", "key"], "left").select("review", "key", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
        dealt = keys.join(F.broadcast(hot), ["review", "key"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("at"), F.lit(SALTS)).cast("int")).otherwise(0))
        struck = dealt.join(copies, ["review", "key", "salt"], "left_semi").select("review", "at").distinct()
        open_, _ = staging.written(open_.join(struck, ["review", "at"], "left_anti"), "kept-open")
    alone = rows.where("p = '' and t = ''").select("review", "ord", F.lit(True).alias("kept"))
    return named.join(taken.withColumn("yes", F.lit(True)), ["review", "at"], "left").select("review", "ord", F.coalesce("yes", F.lit(False)).alias("kept")).unionByName(alone)


def duplicates(articles: DataFrame, order: str = "ord", review: str | None = None) -> DataFrame:
    """``n``, for each ``review`` if named: rows whose pmid or title a kept row had before, see :func:`kept`."""
    got = kept(articles, order, review).groupBy("review").agg(F.count_if(~F.col("kept")).cast("int").alias("n"))
    return got if review else got.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("int").alias("n"))


def prisma(records: DataFrame) -> DataFrame:
    c = lambda x: F.coalesce(F.col(x), F.lit(0))
    pos = lambda x: F.greatest(x, F.lit(0))
    screened = pos(c("retrieved") - c("duplicates"))
    assessed = pos(screened - c("excluded_screening"))
    return records.select(c("total_hits").alias("identified"), c("retrieved").alias("retrieved"), c("duplicates").alias("duplicates"), screened.alias("screened"), c("excluded_screening").alias("excluded_screening"),
                          assessed.alias("assessed"), c("excluded_fulltext").alias("excluded_fulltext"), pos(assessed - c("excluded_fulltext")).alias("included"), pos(c("total_hits") - c("retrieved")).alias("unretrieved"))


def pool(sources: list[DataFrame]) -> DataFrame:
    """Union of article sources; of one key the first source's first row stays."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_rank", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    first = Window.partitionBy(extract.article_key()).orderBy("source_rank", "ord")
    return out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
