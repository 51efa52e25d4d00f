"""A review's draft as ordered lines: facts that tables give, and marked places for the author.

A line is a row ``(part, at, line)``, so a draft is an ordered export and grows with its
tables in as many tasks as they have. Numbers in sentences come from aggregates.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.functions import lexicon as L
from evispark.operators import numbering, reports

#: Headings of a draft's parts, in order, and where a narrative's results and discussion go.
PARTS = ["摘要", "1　引言", "2　资料与方法", "3　结果", "4　讨论", "5　结论", "6　参考文献"]
BEFORE = {"results": ("## 4", "### 3.5　结果概述"), "discussion": ("## 5", "### 4.4　讨论"), "whole": ("## 5", "### 4.4　叙述段")}
RESULT_TITLES, DISCUSSION_TITLES = ["结果概述", "结果", "results", "results overview", "overview of results"], ["讨论", "discussion"]
UNKNOWN = {"zh": ("佚名", "年份不详", "未抽取", "未报告", "摘要未写明结论"), "en": ("Anonymous", "year unknown", "not extracted", "not reported", "no conclusion stated in the abstract")}


def todo(text: str | Column) -> Column:
    """A place that the author fills in."""
    return F.concat(F.lit("*<u>【待补充："), F.lit(text) if isinstance(text, str) else text, F.lit("】</u>*"))


def _or(c: str | Column, other: str) -> Column:
    return F.coalesce(F.nullif(F.trim(F.col(c).cast("string") if isinstance(c, str) else c), F.lit("")), F.lit(other))


def facts(profiles: DataFrame, language: str = "zh", order: str = "ord") -> DataFrame:
    """``at, line``: each article as one line of facts, for a narrative; in Chinese or English."""
    who, when, n, effect, conclusion = UNKNOWN[language]
    first = _or(F.get(F.coalesce("authors", F.array().cast("array<string>")), F.lit(0)), who)
    design = F.coalesce("design", F.lit(L.UNKNOWN_DESIGN))
    if language == "zh":
        line = F.concat(F.lit("- "), first, F.lit(" 等（"), _or("year", when), F.lit("，"), design, F.lit("，样本量 "), _or("n", n), F.lit("，效应量 "), _or("effects_text", effect), F.lit("）："), _or("conclusion", conclusion))
    else:
        line = F.concat(F.lit("- "), first, F.lit(" et al. ("), _or("year", when), F.lit(", "), design, F.lit(", n="), _or("n", n), F.lit(", effect size "), _or("effects_text", effect), F.lit("): "), _or("conclusion", conclusion))
    return profiles.select(F.col(order).alias("at"), line.alias("line"))


def totals(profiles: DataFrame) -> DataFrame:
    """One row: articles, years, participants, full texts, effects and their directions, and the distributions of conclusions, designs and levels as text."""
    def spread(c: str) -> DataFrame:
        n = profiles.where(F.coalesce(F.col(c), F.lit("")) != "").groupBy(F.col(c).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        a = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "k", "n")))
        return n.agg(F.coalesce(F.array_join(F.transform(a, lambda x: F.concat(x["k"], F.lit(" "), x["n"].cast("string"), F.lit(" 篇"))), "、"), F.lit("")).alias(f"{c}_text"), F.coalesce(F.get(a, F.lit(0))["k"], F.lit("—")).alias(f"{c}_top"))

    y = F.substring("year", 1, 4).try_cast("int")
    effect = F.trim(F.coalesce("effects_text", F.lit(""))) != ""
    one = profiles.agg(F.count(F.lit(1)).alias("total"), F.min(y).alias("year_from"), F.max(y).alias("year_to"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"), F.count_if(F.col("n").isNull()).alias("n_missing"), F.count_if(F.coalesce("pmcid", F.lit("")) != "").alias("with_fulltext"),
                       F.count_if(effect).alias("effects"), F.count_if(effect & (F.col("direction") < 0)).alias("down"), F.count_if(effect & (F.col("direction") > 0)).alias("up"))
    for c in ("polarity", "design", "cebm"):
        one = one.crossJoin(F.broadcast(spread(c)))
    return one


def lines(profiles: DataFrame, conflicts: DataFrame, screening: DataFrame | None = None, topic: str = "", order: str = "ord") -> DataFrame:
    """``part, at, line`` of a draft.

    ``profiles`` have ``ord, title, authors, journal, year, pmid, doi, pmcid, design, cebm, n,
    effects_text, conclusion, polarity, direction, bias_label, flags``; ``conflicts`` as of
    :func:`evispark.operators.compare.conflicts`; ``screening`` one row of
    :func:`evispark.operators.compare.prisma`. What only the author knows is a :func:`todo`.
    """
    name = F.lit(topic) if topic else todo("综述主题")
    s = totals(profiles).crossJoin(F.broadcast(conflicts.agg(F.count(F.lit(1)).alias("clashes"))))
    num = lambda c: F.col(c).cast("string")

    def fixed(part: int, at: str, line: Column, on: Column | None = None) -> Column:
        return F.when(F.lit(True) if on is None else on, F.struct(F.lit(part).alias("part"), F.lit(at).alias("at"), line.alias("line")))

    cat = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    effects = F.when(F.col("effects") > 0, cat(num("effects"), " 篇报告了可提取的关键效应量（", num("down"), " 篇偏向降低、", num("up"), " 篇偏向升高）")).otherwise("未提取到结构化效应量")
    spread = F.when(F.col("polarity_text") == "", "摘要均未写明结论").otherwise(F.col("polarity_text"))
    rows = [
        *[fixed(i, "00", F.lit(f"## {p}")) for i, p in enumerate(PARTS)],
        fixed(0, "01", cat("**目的**：系统梳理", name, "领域现有证据的整体走向与分歧。")), fixed(0, "02", cat("**方法**：纳入 ", num("total"), " 篇文献（", F.when(F.col("design_text") == "", "研究设计未识别").otherwise(F.col("design_text")), "）。")),
        fixed(0, "03", cat("**结果**：", effects, "；结论倾向：", spread, "；检出 ", num("clashes"), " 处可能的不一致。")), fixed(0, "04", cat("**结论**：", todo("一句话结论"))),
        fixed(1, "01", todo("研究背景")), fixed(1, "02", todo("拟解决的问题")), fixed(2, "01", todo("检索策略")), fixed(2, "02", todo("纳入与排除标准")), fixed(2, "04", todo("质量评价所用工具")),
        fixed(3, "10", cat("### 3.1　基本特征")), fixed(3, "11", cat("共纳入 ", num("total"), " 篇文献", F.when(F.col("year_from").isNotNull(), cat("，发表于 ", num("year_from"), "–", num("year_to"), " 年")).otherwise(""), "，其中 ", num("with_fulltext"), " 篇可获取全文。")),
        fixed(3, "12", cat("样本量合计 **", num("n_total"), "** 例（", num("n_missing"), " 篇未抽取到）。"), F.col("n_total") > 0), fixed(3, "20", F.lit("### 3.2　效应量")), fixed(3, "22", todo("效应量数据"), F.col("effects") == 0),
        fixed(3, "30", F.lit("### 3.3　结论一致性")), fixed(3, "31", cat("发现 **", num("clashes"), " 处**结论可能不一致："), F.col("clashes") > 0), fixed(3, "31", cat("未自动发现明显的结论冲突；结论倾向：", spread, "。"), F.col("clashes") == 0), fixed(3, "40", F.lit("### 3.4　偏倚提示")),
        fixed(4, "01", cat("研究设计以「", F.col("design_top"), "」为主，证据等级以「", F.col("cebm_top"), "」为主；结论倾向：", spread, "。")), fixed(4, "02", todo("对整体证据走向的判断")), fixed(4, "03", cat("纳入文献仅 ", num("total"), " 篇，外推需谨慎。"), F.col("total") < 10),
        fixed(4, "04", cat(num("n_missing"), " 篇未能抽取样本量。"), F.col("n_missing") > 0), fixed(4, "05", cat((F.col("total") - F.col("with_fulltext")).cast("string"), " 篇未能获取全文。"), F.col("with_fulltext") < F.col("total")),
        fixed(5, "01", cat("结论倾向：", spread, "；", F.when(F.col("clashes") > 0, cat("检出 ", num("clashes"), " 处不一致。")).otherwise("未检出明显的冲突。"))), fixed(5, "02", todo("直接回答 1.2 的问题"))]
    out = s.select(F.inline(F.filter(F.array(*rows), lambda x: x.isNotNull())))

    place = lambda head, c: cat(head, F.lpad(c.cast("string"), 12, "0"))
    first = _or(F.get(F.coalesce("authors", F.array().cast("array<string>")), F.lit(0)), "佚名")
    who = cat(first, " 等（", _or("year", "年份不详"))
    designs = profiles.groupBy(F.coalesce("design", F.lit(L.UNKNOWN_DESIGN)).alias("d")).agg(F.count(F.lit(1)).alias("k")).select(F.lit(3).alias("part"), cat(place("13", F.lit(10**11) - F.col("k")), F.col("d")).alias("at"), cat("- **", F.col("d"), "**（", num("k"), " 篇）").alias("line"))
    effect = profiles.where("trim(coalesce(effects_text, '')) <> ''").select(F.lit(3).alias("part"), place("21", F.col(order)).alias("at"), cat("- ", who, "，", F.coalesce("design", F.lit(L.UNKNOWN_DESIGN)), "）：", F.col("effects_text")).alias("line"))
    rank = F.when(F.col("type") == "效应方向", "0").otherwise("1")
    clash = conflicts.select(F.lit(3).alias("part"), cat("32", rank, F.lpad((F.lit(10**9) - F.col("count")).cast("string"), 10, "0"), F.col("term")).alias("at"), cat("- 主题词「", F.col("term"), "」· ", F.col("type"), "（可信度 ", F.col("confidence"), "）：", num("count"), " 篇").alias("line"))
    found = profiles.select(F.explode_outer("flags").alias("f")).where("f is not null").groupBy("f.label").agg(F.count(F.lit(1)).alias("k"))
    flags = found.select(F.lit(3).alias("part"), cat(place("41", F.lit(10**11) - F.col("k")), F.col("label")).alias("at"), cat("- ", F.col("label"), "：**", num("k"), "** 篇").alias("line"))
    refs = numbering.numbered(profiles, order, "_n").select("_n", order, "title", "authors", "journal", "year", "pmid", "doi")
    refs = reports.references(refs.withColumn("ord", F.col("_n")), "ord").select(F.lit(6).alias("part"), place("1", F.col("ord")).alias("at"), cat("[", num("ord"), "] ", F.col("line")).alias("line"))
    out = out.unionByName(designs).unionByName(effect).unionByName(clash).unionByName(flags).unionByName(refs)
    if screening is None:
        return out.unionByName(screening_less(profiles))
    flow = screening.select(F.lit(2).alias("part"), F.lit("03").alias("at"), cat("检索命中 ", num("identified"), " 篇，去重后 ", num("screened"), " 篇进入筛查，排除 ", num("excluded_screening"), " 篇；", num("assessed"), " 篇进入全文评估，排除 ", num("excluded_fulltext"), " 篇，最终纳入 **", num("included"), " 篇**。").alias("line"))
    return out.unionByName(flow)


def screening_less(profiles: DataFrame) -> DataFrame:
    return profiles.sparkSession.range(1).select(F.lit(2).alias("part"), F.lit("03").alias("at"), todo("筛选流程").alias("line"))


def _bare(line: Column) -> Column:
    """A line without the marks of a heading, in lower case."""
    return F.lower(F.regexp_replace(line, r"^[\s#*_：:]+|[\s#*_：:]+$", ""))


def split_narrative(text: Column) -> Column:
    """``results, discussion, split`` of a narrative by lines that are nothing but one of the known titles.

    Titles in the wrong order, or none, leave it whole; with the discussion's alone, what is before it are the results.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    ls = F.split(t, "\n")
    at = lambda names: F.coalesce(F.array_position(F.transform(ls, lambda x: _bare(x).isin(*names)), True), F.lit(0)).cast("int")
    r, d = at(RESULT_TITLES), at(DISCUSSION_TITLES)
    part = lambda lo, hi: F.regexp_replace(F.array_join(F.slice(ls, lo, F.greatest(hi - lo + 1, F.lit(0))), "\n"), r"^\s+|\s+$", "")
    n = F.size(ls)
    made = lambda a, b, ok: F.struct(a.alias("results"), b.alias("discussion"), F.lit(ok).alias("split"))
    none = F.lit("")
    return F.when((t == "") | ((r == 0) & (d == 0)) | ((r > 0) & (d > 0) & (d < r)), made(t, none, False)).when((r > 0) & (d > 0), made(part(r + 1, d - 1), part(d + 1, n), True)).when(d > 0, made(part(F.lit(1), d - 1), part(d + 1, n), True)).otherwise(made(part(r + 1, n), none, True))


def insert_before(doc: Column, heading: str, block: Column) -> Column:
    """``block`` before the line that begins with ``heading`` and no further digit; at the end where there is none."""
    rule = rf"(?m)^{re.escape(heading)}(?![\d.])"
    at = F.regexp_instr(doc, F.lit(rule))
    end = F.concat(F.regexp_replace(doc, r"\s+$", ""), F.lit("\n\n"), block, F.lit("\n"))
    return F.when(F.coalesce(at, F.lit(0)) == 0, end).otherwise(F.concat(F.substring(doc, F.lit(1), at - 1), block, F.lit("\n\n"), F.substring(doc, at, F.length(doc))))


def embed(drafts: DataFrame) -> DataFrame:
    """``id, text`` of ``drafts(id, draft, narrative)``: results at the end of part 3, discussion at the end of part 4, a narrative without titles whole there; without a draft it is the text."""
    parts = drafts.withColumn("p", split_narrative(F.col("narrative"))).withColumn("draft", F.coalesce("draft", F.lit("")))

    def put(doc: Column, kind: str, text: Column, on: Column) -> Column:
        where, title = BEFORE[kind]
        return F.when(on & (text != ""), insert_before(doc, where, F.concat(F.lit(f"{title}\n\n"), text))).otherwise(doc)

    d = parts.withColumn("draft2", put(F.col("draft"), "results", F.col("p.results"), F.col("p.split")))
    d = d.withColumn("draft3", put(F.col("draft2"), "discussion", F.col("p.discussion"), F.col("p.split")))
    d = d.withColumn("draft4", put(F.col("draft3"), "whole", F.col("p.results"), ~F.col("p.split")))
    return d.select("id", F.when(F.trim("draft") == "", F.trim(F.coalesce("narrative", F.lit("")))).otherwise(F.col("draft4")).alias("text"))
