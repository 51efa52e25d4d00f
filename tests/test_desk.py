"""Bookkeeping, sheets and helpers, with rows worked out by hand."""

import random
import zipfile

from pyspark.sql import functions as F

from evispark.functions import text as X
from evispark.operators import cite, desk, extract, library, reports
from evispark.plans import fixtures
from evispark.sources import onefile


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_replies(spark):
    rows = [("a", '{"data": [{"id": " m2 "}, {"id": "m1"}, {"id": "m2"}, {"id": ""}, {}]}'), ("b", "{broken"), ("c", '{"data": []}'), ("d", None)]
    assert {r.id: r.models for r in desk.model_ids(frame(spark, rows, "id string, json string")).collect()} == {"a": ["m1", "m2"], "b": [], "c": [], "d": []}
    rows = [("a", '{"choices": [{"message": {"content": " x ", "reasoning_content": "no"}, "finish_reason": "length"}, {"message": {"content": "y"}}]}'), ("b", '{"choices": []}'), ("c", "no")]
    assert {(r.id, r.content, r.finish, r.cut) for r in desk.chat_replies(frame(spark, rows, "id string, json string")).collect()} == {("a", "x", "length", True), ("b", "", "", False), ("c", "", "", False)}
    pairs = [tuple(r[0]) for r in frame(spark, [(1, "en|zh-CN"), (2, None), (3, "de|zh-TW"), (4, "|fr"), (5, "en")], "i int, p string").orderBy("i").select(desk.language_pair(F.col("p"))).collect()]
    assert pairs == [("en", "zh"), ("en", "zh"), ("de", "zh-TW"), ("en", "fr"), ("en", "")]


def test_feedback_and_surveys(spark):
    day = lambda d, i: (f"2024-01-0{d} 00:00:{i % 60:02d}", i)
    rows = [("s", *day(1, i), "bug", f"text {i}", None) for i in range(230)] + [("s", *day(2, 1), "odd", " x" * 3000, "y" * 7000), ("t", *day(2, 2), "bug", "  ", None)]
    e = frame(spark, rows, "scope string, ts string, seq int, kind string, content string, diagnostics string").withColumn("ts", F.col("ts").cast("timestamp"))
    kept = desk.feedback(e)
    assert {(r.scope, r.n) for r in desk.feedback_count(kept).collect()} == {("s", 201)}
    last = kept.where("to_date(ts) = '2024-01-02'").first()
    assert last.kind == "other" and len(last.content) == 4000 and len(last.diagnostics) == 6000
    a = frame(spark, [("s", "2024-01-01", 1, None, "often", None, "5", "yes", "mail a.b@c.example now", "13812345678")], "scope string, ts string, seq int, usage_count int, freq string, useful string, satisfaction string, recommend string, improve string, contact string").withColumn("ts", F.col("ts").cast("timestamp"))
    r = desk.surveys(a).first()
    assert (r.usage_count, r.useful) == (0, "") and "a.b@c" not in r.improve and r.contact == "[手机号已隐去]"


def test_latest_of_days_neither_sort_nor_shuffle_texts(spark, monkeypatch):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.choice([None, "2024-01-01 00:00:01", "2024-01-01 23:00:00", "2024-01-02 00:00:00"]), r.choice([None, 1, 2, 3]), f"text {i}") for i in range(400)]
    df = frame(spark, rows, "scope string, ts string, seq int, content string").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3)
    days = {}
    for x in rows:
        days.setdefault((x[0], (x[1] or "")[:10]), []).append(x)
    for keep, cuts in ((7, desk.CUTS), (7, 0), (50, desk.CUTS), (1000, desk.CUTS)):
        monkeypatch.setattr(desk, "CUTS", cuts)
        want = sorted(x[3] for day in days.values() for x in sorted(sorted(day, key=lambda x: x[3]), key=lambda x: (x[1] or "", x[2] or 0), reverse=True)[:keep])
        assert sorted(x.content for x in desk._latest_of_days(df, keep).collect()) == want
    e = spark.range(300).selectExpr("'s' as scope", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) as ts", "id as seq", "'bug' as kind", "concat('text ', id) as content", "'' as diagnostics")
    kept = desk.feedback(e)
    assert sorted(x.seq for x in kept.collect()) == list(range(100, 300))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_states_and_paths(spark):
    s = frame(spark, [("u", "draft", 1, 1, "old"), ("u", "draft", 2, 1, "new"), ("u", "gone", 1, 1, "x"), ("u", "gone", 3, 1, None)], "scope string, name string, ts int, seq int, state string")
    assert [tuple(r) for r in desk.latest_state(s).collect()] == [("u", "draft", "new")]
    got = [r[0] for r in frame(spark, [(1, "local"), (2, "abcd-1234"), (3, "../x"), (4, None)], "i int, s string").orderBy("i").select(desk.scope_path(F.col("s"), F.lit("history"))).collect()]
    assert got == ["history", "users/abcd-1234/history", "history", "history"]
    d = frame(spark, [(1, "https://www.ebi.ac.uk/x"), (2, "no url"), (3, "https://eutils.ncbi.nlm.nih.gov/y")], "i int, u string").orderBy("i")
    assert [tuple(r) for r in d.select(desk.dependency_of(F.col("u")), desk.host_delay(F.col("u")), desk.host_delay(F.col("u"), True, {"www.ebi.ac.uk": -1})).collect()] == [("epmc", 0.34, 0.0), ("llm", 0.0, 0.0), ("pubmed", 0.36, 0.1)]


def test_newest_and_favourites(spark):
    rows = frame(spark, [("a", "2024-01-0%d" % i, f"p{i}") for i in range(1, 6)] + [("b", "2024-01-01", "q")], "scope string, time string, pmid string")
    assert [r.pmid for r in library.newest(rows, 2).collect()] == ["p5", "p4"]
    assert {r.pmid for r in library.newest(rows, 1, scope="scope").collect()} == {"p5", "q"}


def test_tables_of_pages(spark):
    rows = [("d", i + 1, 1, [["a ", None], ["", ""], ["b", " c  d"]]) for i in range(70)] + [("e", 1, 1, [["only"], ["one"]]), ("e", 1, 2, [["a", "b"]]), ("e", 2, 1, None)]
    got = desk.pdf_tables(frame(spark, rows, "doc_id string, page int, index int, rows array<array<string>>")).orderBy("page").collect()
    assert len(got) == 40 and got[0].rows == [["a", ""], ["b", "c d"]] and {r.doc_id for r in got} == {"d"}


def test_sheets_and_their_bundle(spark, tmp_path):
    p = frame(spark, [(1, "One | a", "随机对照试验"), (2, None, None), (3, "Three", "随机对照试验")], "ord int, title string, design string")
    tools = frame(spark, [("随机对照试验", "rob2", "RoB 2", "trials")], "design string, id string, name string, formal string")
    q = frame(spark, [("rob2", 1, "A", "One?"), ("rob2", 2, "A", "Two?")], "id string, pos int, topic string, question string")
    lines = reports.appraisal_sheet(p, tools, q).orderBy("part", "at").collect()
    assert [r.line for r in lines] == ["- **RoB 2**：适用于 2 篇", "- One | a → 随机对照试验｜适用工具：RoB 2", "-  → 未识别｜适用工具：（研究类型未识别，请先判断设计）", "- Three → 随机对照试验｜适用工具：RoB 2", "##### RoB 2 — trials", "**A**", "- [ ] One?", "- [ ] Two?"]
    grade = reports.grade_sheet(p)
    assert [r.line for r in grade.where("part < 3").orderBy("part", "at").collect()] == ["- 高：2 篇", "- 待定：1 篇", "| 未识别 | 待定 |", "| 随机对照试验 | 高 |"]
    ordered = lambda df: df.select(F.struct("part", "at").alias("at"), "line")
    onefile.write(reports.bundle({"appraisal.md": ordered(reports.appraisal_sheet(p, tools, q)), "grade.md": ordered(grade)}), str(tmp_path / "b.zip"), "zip")
    with zipfile.ZipFile(tmp_path / "b.zip") as z:
        assert sorted(z.namelist()) == ["appraisal.md", "grade.md"] and z.read("grade.md").decode().startswith("- 高：2 篇\n- 待定：1 篇\n")


def test_document_and_concept_lines(spark):
    m = frame(spark, [("d", "T", ["A B"], "J", "2020", "10.1/x", "")], "doc_id string, title string, authors array<string>, journal string, year string, doi string, pmid string")
    s = frame(spark, [("d", 2, "Two", "b"), ("d", 1, "One", "a" * 1200)], "doc_id string, section int, title string, text string")
    text = reports.document_summary(m, s).first().text
    assert text.startswith("# T\n\nA B J 2020\n\nDOI: 10.1/x\n\n> 1,201 字符 ｜ 2 个章节\n\n## One\n\naaa") and text.endswith("## Two\n\nb\n")
    c = frame(spark, [(1, 0, "asa", "Aspirin", "D1", "entry_term", ["Aspirin", "ASA"]), (1, 1, "x", None, None, None, None)], "id int, ord int, text string, heading string, ui string, matched_by string, entry_terms array<string>")
    assert [r.line for r in reports.concept_lines(c).orderBy("pos").collect()] == ["**asa** → **Aspirin**（命中入口词表，UI D1）｜入口词：ASA", "**x** —— 未找到对应描述符（按原词检索）"]
    long = reports.summary_sheet(frame(spark, [("x" * 40_000,), ("short",)], "summary string")).collect()
    assert len(long[0].summary) == 32_001 and long[1].summary == "short"


def test_renames(spark):
    f = frame(spark, [("f1", "A", ""), ("f2", "B", ""), ("f3", "C", "")], "id string, name string, created_at string")
    done, refused = library.rename_folders(f, frame(spark, [("f1", "b"), ("f2", " New  name "), ("f3", "NEW NAME"), ("f9", "x"), ("f3", "")], "id string, name string").where("id <> 'f3' or name <> ''"))
    assert {(r.id, r.name) for r in done.collect()} == {("f1", "A"), ("f2", "New name"), ("f3", "C")} and {(r.id, r.reason) for r in refused.collect()} == {("f1", "taken"), ("f3", "taken"), ("f9", "gone")}


def test_helpers(spark):
    one = lambda v, f, kind="string": frame(spark, [(v,)], f"x {kind}").select(f(F.col("x"))).first()[0]
    assert one("https://a.example/" + "p" * 80 + "?q=1", X.short_url) == "a.example/" + "p" * 59 + "…" and one("https://a.example/x", X.short_url) == "a.example/x"
    assert one(" abcd_1234 ", X.valid_token) and not one("short", X.valid_token) and not one(None, X.valid_token)
    assert one("inflamma-\n tion is\ncommon\n\nnew  part", X.clean_text) == "inflammation is common\n\nnew part"
    a = fixtures.frame(spark, fixtures.ARTICLES, fixtures.ARTICLE_COLUMNS)
    assert cite.render(a, "ris").count() == 8
    try:
        cite.render(a, "odd")
    except ValueError as e:
        assert "odd" in str(e)
    else:
        raise AssertionError
    line = reports.applicability(extract.profile(a.where("ord = 1"))).first().line
    assert line.startswith("| Drug A in heart failure: a trial | ") and line.count("|") == 8
    b = reports.batches(frame(spark, [(1,), (40,), (41,)], "`序号` int")).orderBy("序号").collect()
    assert [r.batch for r in b] == [0, 0, 1]
