"""A draft's lines, and a narrative put into it."""

from pyspark.sql import functions as F

from evispark.operators import compare, draft, extract
from evispark.plans import fixtures


def test_lines_of_a_draft(spark, tmp_path):
    a = fixtures.frame(spark, fixtures.ARTICLES, fixtures.ARTICLE_COLUMNS)
    extract.profile(a).write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p")).withColumn("direction", F.lit(0))
    none = compare.conflicts(p, spark.createDataFrame([], "term string"))
    flow = compare.prisma(spark.createDataFrame(fixtures.PRISMA[:1], "id int, total_hits int, retrieved int, duplicates int, excluded_screening int, excluded_fulltext int"))
    got = [r.line for r in draft.lines(p, none, flow, "drug A").orderBy("part", "at").collect()]
    assert [x for x in got if x.startswith("## ")] == [f"## {x}" for x in draft.PARTS]
    assert "**方法**：纳入 8 篇文献" in "\n".join(got) and any(x.startswith("检索命中 1863 篇，去重后 44 篇") for x in got)
    refs = [x for x in got if x.startswith("[")]
    assert len(refs) == 8 and refs[0].startswith("[1] Smith JA, Lee K, The A Study Group. Drug A in heart failure: a trial")
    assert any(x.startswith("- Smith JA 等（2021，随机对照试验）：") for x in got) and any("未自动发现明显的结论冲突" in x for x in got)
    plain = [r.line for r in draft.lines(p, none).collect()]
    assert any("【待补充：筛选流程】" in x for x in plain) and any("【待补充：综述主题】" in x for x in plain)


def test_facts_in_two_languages(spark):
    rows = spark.createDataFrame([(1, ["Li X"], "2020", "队列研究", 12, "HR 0.7", "Good."), (2, None, "", None, None, " ", None)], "ord int, authors array<string>, year string, design string, n int, effects_text string, conclusion string")
    assert [r.line for r in draft.facts(rows).orderBy("at").collect()] == ["- Li X 等（2020，队列研究，样本量 12，效应量 HR 0.7）：Good.", "- 佚名 等（年份不详，未识别，样本量 未抽取，效应量 未报告）：摘要未写明结论"]
    assert draft.facts(rows, "en").orderBy("at").first().line == "- Li X et al. (2020, 队列研究, n=12, effect size HR 0.7): Good."


def test_a_narrative_is_put_in_its_place(spark):
    doc = "# T\n\n## 3　结果\n\nold\n\n## 4　讨论\n\nmore\n\n## 5　结论\n\nend"
    rows = [(1, doc, "## 结果概述\nR one\n\n**讨论**：\nD one"), (2, doc, "no titles here"), (3, doc, "讨论\nD\n结果\nR"), (4, doc, "before\nDiscussion\nafter"), (5, doc, "Results:\nonly"), (6, " ", "text"), (7, doc, None), (8, "# no parts", "## 结果\nR")]
    got = {r.id: r.text for r in draft.embed(spark.createDataFrame(rows, "id int, draft string, narrative string")).collect()}
    assert got[1] == "# T\n\n## 3　结果\n\nold\n\n### 3.5　结果概述\n\nR one\n\n## 4　讨论\n\nmore\n\n### 4.4　讨论\n\nD one\n\n## 5　结论\n\nend"
    assert "### 4.4　叙述段\n\nno titles here\n\n## 5" in got[2] and "### 4.4　叙述段\n\n讨论\nD\n结果\nR\n\n## 5" in got[3]
    assert "### 3.5　结果概述\n\nbefore\n\n## 4" in got[4] and "### 4.4　讨论\n\nafter\n\n## 5" in got[4]
    assert "### 3.5　结果概述\n\nonly\n\n## 4" in got[5] and "4.4" not in got[5]
    assert got[6] == "text" and got[7] == doc and got[8] == "# no parts\n\n### 3.5　结果概述\n\nR\n"
