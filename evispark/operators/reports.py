"""Report lines: each is a row with an order, so that a report is an ordered export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.functions import lexicon as L
from evispark.operators import keywords, services
from evispark.operators.compare import md_cell


def study(authors: Column, year: Column) -> Column:
    """First author and year, as studies are named in conflicts and drafts."""
    first = F.coalesce(F.get(authors, F.lit(0)), F.lit("（作者未获取）"))
    return F.concat(first, F.lit(" 等, "), F.coalesce(F.nullif(year, F.lit("")), F.lit("年份不详")))


def flags(profiles: DataFrame, order: str = "ord") -> DataFrame:
    """``ord, pos, line``: a heading for each article and a line for each flag, with its evidence."""
    p = profiles.select(order, "title", "bias_label", F.posexplode_outer("flags").alias("i", "f"))
    proof = F.when(F.col("f.evidence") != "", F.concat(F.lit("（"), F.col("f.evidence"), F.lit("）"))).otherwise("")
    lines = p.where("f is not null").select(order, (F.col("i") + 1).alias("pos"), F.concat(F.lit("- **"), F.col("f.level"), F.lit("** "), F.col("f.label"), proof).alias("line"))
    heads = profiles.select(order, F.lit(0).alias("pos"), F.concat(F.lit("### "), md_cell(F.col("title")), F.lit(" — "), F.col("bias_label")).alias("line"))
    return heads.unionByName(lines)


def applicability(profiles: DataFrame, order: str = "ord") -> DataFrame:
    cells = [F.col("population"), F.col("intervention"), F.col("outcome.label"), F.coalesce(F.nullif(F.col("followup.text"), F.lit("")), F.lit("摘要未说明")), F.col("setting"), F.col("availability")]
    return profiles.select(order, F.concat(F.lit("| "), F.concat_ws(" | ", md_cell(F.col("title")), *[md_cell(F.coalesce(F.nullif(c, F.lit("")), F.lit("摘要未写明"))) for c in cells]), F.lit(" |")).alias("line"))


def conflicts(found: DataFrame) -> DataFrame:
    """``rank, line`` of conflicts: effect directions first, then by the number of studies."""
    rank = F.struct(F.when(F.col("type") == "效应方向", 0).otherwise(1), -F.col("count"), F.col("term"))
    return found.select(rank.alias("rank"), F.concat(F.lit("- "), F.col("type"), F.lit("「"), F.col("term"), F.lit("」 "), F.col("count").cast("string"), F.lit(" 篇，可信度"), F.col("confidence")).alias("line"))


def prisma(counts: DataFrame) -> DataFrame:
    """``pos, line``: the screening flow as a list."""
    rows = [("识别", "identified"), ("获取", "retrieved"), ("去重", "duplicates"), ("筛选", "screened"), ("筛除", "excluded_screening"), ("全文评估", "assessed"), ("全文排除", "excluded_fulltext"), ("纳入", "included")]
    lines = F.array(*[F.struct(F.lit(i).alias("pos"), F.concat(F.lit(f"- {k}: "), F.col(c).cast("string")).alias("line")) for i, (k, c) in enumerate(rows)])
    return counts.select(F.inline(lines))


def references(articles: DataFrame, order: str = "ord") -> DataFrame:
    """``ord, line``: up to six authors, title, journal, year, identifiers."""
    a = F.coalesce("authors", F.array().cast("array<string>"))
    names = F.concat(F.array_join(F.slice(a, 1, 6), ", "), F.when(F.size(a) > 6, ", et al").otherwise(""))
    tail = F.concat_ws(". ", F.nullif(names, F.lit("")), F.nullif("title", F.lit("")), F.nullif("journal", F.lit("")), F.nullif("year", F.lit("")),
                       F.when(F.coalesce("pmid", F.lit("")) != "", F.concat(F.lit("PMID: "), "pmid")), F.when(F.coalesce("doi", F.lit("")) != "", F.concat(F.lit("doi:"), "doi")))
    return articles.select(order, tail.alias("line"))


def batches(rows: DataFrame, number: str = "序号", size: int = 40) -> DataFrame:
    """Rows with their draft batch of ``size``."""
    return rows.withColumn("batch", F.floor((F.col(number) - 1) / size).cast("int"))


def library(articles: DataFrame, meta: DataFrame, folders: DataFrame) -> DataFrame:
    """``pmid, line`` of a library export: title, folder, tags, note."""
    j = articles.join(meta, "pmid", "left").join(folders.select(F.col("id").alias("folder"), F.col("name").alias("folder_name")), "folder", "left")
    tags = F.array_join(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("#"), t)), " ")
    return j.select("pmid", F.concat_ws(" · ", F.concat(F.lit("- "), F.col("title")), F.nullif("folder_name", F.lit("")), F.nullif(tags, F.lit("")), F.nullif(F.trim("note"), F.lit(""))).alias("line"))


def appraisal_sheet(profiles: DataFrame, tools: DataFrame, questions: DataFrame, order: str = "ord") -> DataFrame:
    """``part, at, line``: which tools apply to how many articles, each article's tools, and each used tool's questions once.

    ``tools(design, id, name, formal)`` says what applies to a design, ``questions(id, pos,
    topic, question)`` what a tool asks; both are short and the user's own. ``at`` orders the lines of a part.
    """
    p = profiles.select(F.col(order).cast("long").alias("o"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("design", F.lit(L.UNKNOWN_DESIGN)).alias("design"))
    j = p.join(F.broadcast(tools), "design", "left")
    place = lambda *c: F.array(*[F.coalesce(x.cast("string"), F.lit("")) if isinstance(x, Column) else F.lit(x) for x in c])
    wide = lambda c: F.lpad(c.cast("string"), 12, "0")
    used = j.where("id is not null").groupBy("id", "name").agg(F.count(F.lit(1)).alias("n"))
    one = used.select(F.lit(1).alias("part"), place(wide(F.lit(10**11) - F.col("n")), F.col("name")).alias("at"), F.concat(F.lit("- **"), "name", F.lit("**：适用于 "), F.col("n").cast("string"), F.lit(" 篇")).alias("line"))
    per = j.groupBy("o", "title", "design").agg(F.count("id").alias("k"), F.array_join(F.array_sort(F.filter(F.collect_list("name"), lambda x: x.isNotNull())), "、").alias("names"))
    two = per.select(F.lit(2).alias("part"), place(wide(F.col("o"))).alias("at"), F.concat(F.lit("- "), F.col("title"), F.lit(" → "), "design", F.lit("｜适用工具："), F.when(F.col("k") == 0, "（研究类型未识别，请先判断设计）").otherwise(F.col("names"))).alias("line"))
    asked = F.broadcast(used.select("id").distinct()).join(tools.select("id", "name", "formal").distinct(), "id")
    heads = asked.select(F.lit(3).alias("part"), place(F.col("id"), "0").alias("at"), F.concat(F.lit("##### "), "name", F.lit(" — "), "formal").alias("line"))
    q = questions.join(asked.select("id"), "id")
    topics = q.groupBy("id", "topic").agg(F.min("pos").alias("pos")).select(F.lit(3).alias("part"), place(F.col("id"), "1", wide(F.col("pos")), "0").alias("at"), F.concat(F.lit("**"), "topic", F.lit("**")).alias("line"))
    lines = q.select(F.lit(3).alias("part"), place(F.col("id"), "1", wide(F.col("pos")), "1").alias("at"), F.concat(F.lit("- [ ] "), "question").alias("line"))
    return one.unionByName(two).unionByName(heads).unionByName(topics).unionByName(lines)


def grade_sheet(profiles: DataFrame, order: str = "ord") -> DataFrame:
    """``part, at, line``: how many articles start at each level, the level of each design, and of each article."""
    p = services._dimension(profiles.select(F.col(order).cast("long").alias("o"), F.coalesce("title", F.lit("")).alias("title"), "design")).withColumn("level", F.coalesce("_grade", F.lit("待定")))
    one = p.groupBy("level").agg(F.count(F.lit(1)).alias("n")).select(F.lit(1).alias("part"), F.concat(F.lpad((F.lit(10**11) - F.col("n")).cast("string"), 12, "0"), "level").alias("at"), F.concat(F.lit("- "), "level", F.lit("："), F.col("n").cast("string"), F.lit(" 篇")).alias("line"))
    two = p.select("design", "level").distinct().select(F.lit(2).alias("part"), F.col("design").alias("at"), F.concat(F.lit("| "), "design", F.lit(" | "), "level", F.lit(" |")).alias("line"))
    three = p.select(F.lit(3).alias("part"), F.lpad(F.col("o").cast("string"), 12, "0").alias("at"), F.concat(F.lit("- "), md_cell(F.col("title")), F.lit(" → "), "design", F.lit("：起始等级 "), "level").alias("line"))
    return one.unionByName(two).unionByName(three)


def concept_lines(concepts: DataFrame, shown: int = 6) -> DataFrame:
    """``id, pos, line`` of ``concepts(id, ord, text, heading, ui, matched_by, entry_terms)``: what each concept was found as, or that it was not."""
    how = F.when(F.col("matched_by") == "heading", "标题精确匹配").otherwise("命中入口词表")
    entries = F.slice(F.slice(F.coalesce("entry_terms", F.array().cast("array<string>")), 2, 1 << 20), 1, shown)
    found = F.concat(F.lit("**"), "text", F.lit("** → **"), "heading", F.lit("**（"), how, F.lit("，UI "), "ui", F.lit("）"), F.when(F.size(entries) > 0, F.concat(F.lit("｜入口词："), F.array_join(entries, "、"))).otherwise(""))
    return concepts.select("id", F.col("ord").alias("pos"), F.when(F.col("heading").isNull(), F.concat(F.lit("**"), "text", F.lit("** —— 未找到对应描述符（按原词检索）"))).otherwise(found).alias("line"))


def document_summary(meta: DataFrame, sections: DataFrame) -> DataFrame:
    """``doc_id, text``: a parsed document as Markdown: title, up to eight authors with journal and year, DOI, counts, sections."""
    g = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section", "title", "text"))).alias("s"))
    bits = F.concat_ws(" ", F.nullif(F.array_join(F.slice("authors", 1, 8), "、"), F.lit("")), F.nullif("journal", F.lit("")), F.nullif("year", F.lit("")))
    body = F.transform("s", lambda x: F.concat(F.lit("## "), x["title"], F.lit("\n\n"), x["text"], F.lit("\n")))
    chars = F.aggregate("s", F.lit(0), lambda n, x: n + F.length(x["text"]))
    counts = F.concat(F.lit("> "), F.format_number(chars, 0), F.lit(" 字符 ｜ "), F.size("s").cast("string"), F.lit(" 个章节\n"))
    head = F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce(F.nullif("title", F.lit("")), F.lit("PDF 全文解析")), F.lit("\n")), F.when(bits != "", F.concat(bits, F.lit("\n"))), F.when(F.col("doi") != "", F.concat(F.lit("DOI: "), "doi", F.lit("\n"))), counts)
    return meta.join(g, "doc_id").select("doc_id", F.concat(head, F.lit("\n"), F.array_join(body, "\n")).alias("text"))


def section_sheet(sections: DataFrame) -> DataFrame:
    """``doc_id, section, title, words, chars`` of each section ``(doc_id, ord, title, text)``, as :func:`evispark.operators.keywords.fulltext_stats` counts them."""
    counted = keywords.fulltext_stats(sections.select(F.struct("doc_id", F.col("ord").alias("section")).alias("doc_id"), "title", "text"))
    return counted.select("doc_id.doc_id", "doc_id.section", F.col("section").alias("title"), F.col("words").cast("long").alias("words"), F.col("chars").cast("long").alias("chars"))


def metric_sheet(metrics: DataFrame, shown: int = 6) -> DataFrame:
    """``doc_id, kind, count, samples`` of :func:`evispark.operators.keywords.metrics`, the samples as one cell."""
    return metrics.select("doc_id", "kind", "count", F.array_join(F.slice("samples", 1, shown), "；").alias("samples"))


#: Characters that a spreadsheet's cell takes, less a mark.
CELL = 32_000


def summary_sheet(docs: DataFrame) -> DataFrame:
    """Articles with the ``summary`` of :mod:`keywords` as a cell: longer ones end at ``CELL`` with a mark."""
    return docs.withColumn("summary", F.when(F.length("summary") > CELL, F.concat(F.left("summary", F.lit(CELL)), F.lit("…"))).otherwise(F.col("summary")))


def bundle(texts: dict[str, DataFrame], between: str = "\n") -> DataFrame:
    """``name, content``: each file's ordered ``(at, line)`` rows as its text, for a ZIP; a file is one user's export."""
    out = None
    for name, rows in texts.items():
        one = rows.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), between).alias("content")).select(F.lit(name).alias("name"), F.concat("content", F.lit("\n")).alias("content"))
        out = one if out is None else out.unionByName(one)
    return out
