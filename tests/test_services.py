"""Sources, sinks, library, comparison and bookkeeping, each with a hit and a case that must not hit."""

import pytest
from pyspark.sql import functions as F

from evispark.functions import text as X
from evispark.operators import compare, extract, funnel, keywords, library, locate, services, telemetry, vocab
from evispark.plans import fixtures
from evispark.sources import readers, sinks


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def value(spark, text, f):
    return frame(spark, [(text,)], "x string").select(f(F.col("x"))).first()[0]


def test_repeated_sentences_have_their_own_places(spark):
    text = "The same sentence here. Another one between. The same sentence here."
    got = locate.index_with_offsets(frame(spark, [(1, "S", text), (2, "", "")], "doc_id int, section string, text string")).orderBy("pos").collect()
    assert [(r.pos, r.start, r.end) for r in got] == [(0, 0, 23), (1, 24, 44), (2, 45, 68)]
    assert locate.index_stats(locate.index_with_offsets(frame(spark, [(1, "S", text)], "doc_id int, section string, text string"))).first()[:] == (3, 1)


def test_highlighting_escapes_and_merges(spark):
    assert value(spark, "A <b> dose & a Dose", lambda c: locate.highlight_query(c, "dose")) == 'A &lt;b&gt; <span class="loc-kw">dose</span> &amp; a <span class="loc-kw">Dose</span>'
    assert value(spark, "abab", lambda c: locate.highlight_query(c, "ab ba")) == '<span class="loc-kw">abab</span>'
    assert value(spark, "It fell (P < 0.05) by 12%.", locate.highlight_values) == 'It fell (<span class="loc-val">P &lt; 0.05</span>) by <span class="loc-val">12%</span>.'
    assert value(spark, "nothing", lambda c: locate.highlight_query(c, "dose")) == "nothing"


def test_quota_is_over_days_and_scopes(spark):
    rows = [("chars", s, f"2024-01-0{d} 00:00:0{i}", i, 60, False) for i, (s, d) in enumerate([("a", 1), ("b", 1), ("a", 2), ("c", 2)])]
    r = frame(spark, rows, "kind string, scope string, t string, seq int, amount long, own_key boolean").withColumn("ts", F.to_timestamp("t"))
    got = telemetry.quota_admission(r, {"chars": (100, 100)})
    assert [x.admitted for x in got.orderBy("seq").collect()] == [True, False, False, True]
    scope, day = services.usage(got)
    assert {(x.scope, x.used) for x in scope.collect()} == {("a", 60), ("c", 60)} and sorted(x.used for x in day.collect()) == [60, 60]
    assert services.last_block(got).first().scope == "a" and services.last_block(got.where("admitted")).count() == 0
    left = telemetry.remaining(frame(spark, [("chars", "a", 60, 90), ("free", "a", 1, 1), ("chars", "b", 200, 0)], "kind string, scope string, session long, day long"), {"chars": (100, 100)})
    assert {(x.kind, x.scope): x.left for x in left.collect()} == {("chars", "a"): 10, ("free", "a"): None, ("chars", "b"): 0}


def test_keyword_phrases_take_their_words_places(spark):
    text = ["overall survival improved", "overall survival was longer", "pembrolizumab pembrolizumab dose", "survival of cells"]
    got = [r.term for r in keywords.keywords(frame(spark, list(enumerate(text)), "unit int, text string"), 5).orderBy("rank").collect()]
    assert "overall survival" in got and "overall" not in got and "survival" in got
    zh = keywords.chinese_grams(frame(spark, [(1, "总生存期与总生存期"), (2, "总生存期，研究研究")], "unit int, text string")).collect()
    assert {(r.gram, r.tf, r.df) for r in zh} == {("总生存期", 3, 2)}


def test_summaries_differ_and_keep_order(spark):
    text = "Heart drugs lowered the mortality rate strongly. Heart drugs lowered the mortality rate strongly! Results: the mortality rate fell by 12% in adults. Weather was fine."
    got = [r.pos for r in keywords.summaries(frame(spark, [(1, text), (2, None), (3, "")], "doc_id int, text string"), 0.5, 2).collect()]
    assert got == sorted(got) and len(got) == 2 and not {0, 1} <= set(got)


def test_article_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text("""<?xml version="1.0"?><PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Journal><Title>J</Title><ISSN>1-2</ISSN>
<JournalIssue><Volume>3</Volume><PubDate><MedlineDate>2020 Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal><ArticleTitle>On  hearts</ArticleTitle>
<Abstract><AbstractText Label="METHODS">We looked.</AbstractText><AbstractText Label="Results">We saw.</AbstractText><AbstractText Label="METHODS">Again.</AbstractText></Abstract>
<AuthorList><Author><LastName>Li</LastName><Initials>X</Initials></Author><Author><CollectiveName>The Group</CollectiveName></Author></AuthorList><Language>eng</Language></Article></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle><PubmedBookArticle><PMID>8</PMID></PubmedBookArticle></PubmedArticleSet>""")
    got = readers.articles_xml(spark, str(tmp_path / "a.xml")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.pmid, r.title, r.year, r.authors, r.doi, r.pmcid) == ("7", "On hearts", "2020 Jan-Feb", ["Li X", "The Group"], "10.1/x", None)
    assert r.abstract_sections == {"METHODS": "We looked. Again.", "RESULTS": "We saw."}


def test_fulltext_xml(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<article><body><p>Lead.</p><sec><title>Methods</title><p>One.</p><p>Two.</p></sec><sec><title>Empty</title></sec></body></article>")
    s = readers.fulltext_xml(spark, str(tmp_path / "f.xml")).first().sections
    assert [(x.title, x.text) for x in s] == [("引言", "Lead."), ("Methods", "One. Two.")]


def test_tolerant_json_and_csv(spark, tmp_path):
    (tmp_path / "j.json").write_text('{"a": 1}\n{broken\n{"a": 2}\n')
    assert sorted(r.a for r in readers.tolerant_json(spark, str(tmp_path / "j.json"), "a int").collect()) == [1, 2]
    sinks.csv(frame(spark, [("x", 1)], "name string, n int").coalesce(1), str(tmp_path / "c"))
    (part,) = (tmp_path / "c").glob("*.csv")
    assert part.read_bytes().startswith("﻿name,n".encode())
    got = readers.funnel_csv(spark, str(tmp_path / "c"), ["name", "gone"]).first()
    assert tuple(got) == ("x", "")


def test_first_source_wins(spark):
    a, b = frame(spark, [("1", None), ("2", "a2")], "key string, value string"), frame(spark, [("1", "b1"), ("2", "b2")], "key string, value string")
    assert {tuple(r) for r in readers.first_of(("a", a), ("b", b)).collect()} == {("1", "b1", "b"), ("2", "a2", "a")}
    assert [r.key for r in readers.uncached(a, b.where("key = '1'"), ["key"]).collect()] == ["2"]


def test_links_and_figures(spark):
    got = frame(spark, [("PMC1", "10.1/x", "u"), (None, "", None)], "p string, d string, u string").select(readers.pdf_links(F.col("p"), F.col("d"), F.col("u")).alias("l"), readers.open_access(F.array("u", "u", F.lit("v"))).alias("o")).collect()
    assert got[0].l[1:] == ["https://doi.org/10.1/x", "u"] and got[0].o == ["u", "v"] and got[1].l == [] and got[1].o == ["v"]
    f = frame(spark, [(1, "F1", "fig-one.jpg"), (1, "F2", "none.gif")], "doc_id int, fig string, href string")
    files = frame(spark, [(1, "fig-one.png"), (1, "xfigonex.jpg"), (2, "none.gif")], "doc_id int, file string")
    assert [(r.fig, r.file) for r in readers.match_figures(f, files).collect()] == [("F1", "fig-one.png")]


def test_sinks(spark, tmp_path):
    df = frame(spark, [(2, "b|c"), (1, None)], "ord int, t string")
    assert sinks.markdown_text(df, "ord") == "| ord | t |\n| --- | --- |\n| 1 |  |\n| 2 | b／c |\n"
    sinks.table(df, str(tmp_path / "t"), "ord")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    lines = sinks.backup(frame(spark, [("f", "N", "c")], "id string, name string, created_at string"), frame(spark, [("1", "f", ["t"])], "pmid string, folder string, tags array<string>")).collect()
    assert {r.kind for r in lines} == {"folder", "meta"} and '"tags":["t"]' in [r.json for r in lines if r.kind == "meta"][0]


META = "pmid string, folder string, tags array<string>, note string, note_updated string"


def test_library(spark):
    folders = frame(spark, [("f1", "Heart", "1")], "id string, name string, created_at string")
    meta = frame(spark, [("1", "f1", ["A", "b"], "n", ""), ("2", "", ["a"], "", "")], META)
    more = library.add_folders(folders, frame(spark, [("f2", " heart ", "2"), ("f3", "Lung", "3"), ("f4", "lung", "4"), ("f5", " ", "5")], "id string, name string, created_at string"))
    assert {r.id for r in more.collect()} == {"f1", "f3"}
    up = {r.pmid: r for r in library.upsert(meta, frame(spark, [("1", None, ["c"], None), ("9", "f1", None, "x")], "pmid string, folder string, tags array<string>, note string")).collect()}
    assert up["1"].folder == "f1" and up["1"].tags == ["c"] and up["1"].note == "n" and up["9"].tags == [] and up["9"].note == "x"
    assert {r.pmid: r.tags for r in library.rename_tag(meta, "a", "B").collect()} == {"1": ["B"], "2": ["B"]}
    assert {r.pmid: r.tags for r in library.rename_tag(meta, "a", "").collect()} == {"1": ["b"], "2": []}
    assert library.delete_folder(meta, "f1").where("folder <> ''").count() == 0
    assert [r.pmid for r in library.prune(meta, frame(spark, [("2",)], "pmid string")).collect()] == ["2"]
    assert meta.select(library.remove_tags(F.col("tags"), F.array(F.lit("A")))).first()[0] == ["b"]
    fav = library.add_favourites(frame(spark, [("1", "T")], "pmid string, title string"), frame(spark, [("1", "U", 0), ("2", "V", 0)], "pmid string, title string, fulltext_sections int"))
    assert {(r.pmid, r.title) for r in fav.collect()} == {("1", "T"), ("2", "V")}
    assert library.promote(meta.select("pmid"), frame(spark, [("1",), ("3",)], "pmid string"), ["pmid"]).count() == 3


def test_fills(spark, tmp_path):
    extract.profile(fixtures.frame(spark, fixtures.ARTICLES, fixtures.ARTICLE_COLUMNS)).write.parquet(str(tmp_path / "profiles"))
    p = spark.read.parquet(str(tmp_path / "profiles"))
    t = compare.fill_targets(p).collect()
    assert t and all(set(r.fields) <= {"样本量", "人群", "主要终点", "关键效应量", "结论"} for r in t) and not any("研究设计" in r.fields for r in t)
    target = next(r for r in t if "样本量" in r.fields)
    asked = frame(spark, [(1, target.row_key, ["样本量"])], "id int, row_key string, fields array<string>")
    replies = [('noise {"fills": [{"id": 1, "样本量": {"value": "1,234", "quote": "we had 1,234"}, "结论": {"value": "x", "quote": "y"}}, {"id": 2, "样本量": {"value": "5", "quote": "q"}}]} end',), ("no json",),
               ('{"fills": [{"id": 1, "样本量": {"value": "77"}}]}',)]
    fills = compare.parse_fills(frame(spark, replies, "text string"), asked)
    assert [tuple(r) for r in fills.collect()] == [(target.row_key, "样本量", "1,234", "we had 1,234")]
    done = {r.row_key: r.n for r in compare.fill(p, fills).collect()}
    assert done[target.row_key] == 1234
    c = frame(spark, [("v", "ok", True, False, True), ("v", "ok", False, True, True), (None, "not_mentioned", False, False, False), ("", "not_extracted", False, False, True), (None, "no_abstract", False, False, False)],
              "v string, s string, c boolean, f boolean, full boolean")
    assert [r[0] for r in c.select(compare.annotate(*[F.col(x) for x in ("v", "s", "c", "f", "full")])).collect()] == ["v ✎", "v ⧉", "摘要未提及", "有原文未抽到", "无摘要"]


def test_overviews(spark):
    rows = [("k1", 1, "A", "随机对照试验", 5, "p", "o", "HR", "c", ["Li"], "2020"), ("k2", 2, "B", "未识别", None, "", "", "", "", None, "")]
    p = frame(spark, rows, "row_key string, ord int, title string, design string, n long, population string, primary_outcome string, effects_text string, conclusion string, authors array<string>, year string")
    assert compare.completeness_overview(p).first()[:] == (2, 3.0, 1) and compare.completeness_overview(p.limit(0)).first()[:] == (0, 0.0, 0)
    assert {r.field: r.n for r in compare.missing_counts(p).collect()}["样本量"] == 1
    assert [r.title for r in compare.unrecognised(p).collect()] == ["B"]
    assert {(r.design, r.n, r.cites) for r in compare.by_design(p).collect()} == {("随机对照试验", 1, "Li 等（2020）"), ("未识别", 1, "佚名 等（年份不详）")}
    assert sum(r.n for r in services.grade_overview(p).collect()) == 2
    assert any(r.tool is None and r.n == 1 for r in services.appraisal_overview(p).collect())


def test_topic_terms_and_conflict_order(spark):
    p = frame(spark, [("1", "Statins lower cholesterol", "Statins lower cholesterol; statins help"), ("2", "Statins and age", "Statins do nothing; cholesterol stays")], "row_key string, title string, conclusion string")
    got = {r.term: r.docs for r in compare.topic_terms(p).collect()}
    assert got.get("cholesterol") == 2 and "nothing" not in got
    c = frame(spark, [("结论极性", "a", 9), ("效应方向", "b", 2), ("结论极性", "c", 3)], "type string, term string, count int")
    assert [r.term for r in services.ordered_conflicts(c).orderBy("rank").collect()] == ["b", "a", "c"]


def test_pool_and_duplicates(spark):
    a = frame(spark, [("1", "X", 1), ("", "Y", 2)], "pmid string, title string, ord int")
    b = frame(spark, [("1", "Z", 1), ("", "y!", 2), ("3", "W", 3)], "pmid string, title string, ord int")
    assert {r.title for r in compare.pool([a, b]).collect()} == {"X", "Y", "W"}
    d = frame(spark, [("r", 1, "1", "T"), ("r", 2, "1", "U"), ("s", 1, "1", "T"), ("s", 2, "", "t!"), ("s", 3, "", "")], "review string, ord int, pmid string, title string")
    assert {r.review: r.n for r in compare.duplicates(d, review="review").collect()} == {"r": 1, "s": 1}


def test_vocabulary(spark):
    assert value(spark, '("heart failure"[Title] AND drugs) OR x', vocab.clean_topic) == "heart failure drugs x"
    assert value(spark, "heart failure", vocab.is_plain) and not value(spark, "heart[tiab]", vocab.is_plain) and not value(spark, " ", vocab.is_plain)
    names = frame(spark, [("The Heart & Soul.",), ("Unknown",)], "name string")
    cat = frame(spark, [("heart and soul", "Heart and Soul Extra", "HSE", 1), ("heart and soul", "Heart and Soul", "HS", 2)], "query string, title string, abbreviation string, ord int")
    assert {tuple(r) for r in vocab.resolve_journals(names, cat).collect()} == {("The Heart & Soul.", "HS"), ("Unknown", "Unknown")}
    long_ = "x" * 1390
    got = vocab.expand(frame(spark, [(1, 1, "a", long_), (1, 2, "b", '"b"[MeSH Terms]'), (2, 1, "c", "C")], "id int, ord int, term string, expression string")).orderBy("id").collect()
    assert got[0].expression == f"{long_} AND b" and got[1].expression == "C"
    k = frame(spark, [(1, "heart failure"), (2, " "), (3, "x[tiab]")], "id int, keyword string")
    rep = {r.id: (r.skipped, r.reason, r.matched) for r in services.concept_report(k, frame(spark, [("heart failure", "Heart Failure")], "term string, heading string")).collect()}
    assert rep == {1: (False, "", 1), 2: (True, "blank", 0), 3: (True, "expression", 0)}


def test_translation(spark):
    c = frame(spark, [(["good", "打出这样的球", "生存期"],), (["none"],)], "c array<string>").select(services.best_translation(F.col("c")).alias("t")).collect()
    assert [r.t for r in c] == ["生存期", ""]
    assert services._pack(["a" * 300, "b" * 200, "c" * 100]) == ["a" * 300, "b" * 200 + " " + "c" * 100]
    assert services._pack(["a" * 250 + "," + "b" * 300]) == ["a" * 250 + ",", "b" * 300] and services._pack(["x" * 900]) == ["x" * 450] * 2 and services._pack([]) == []
    texts = frame(spark, [(1, ["one sentence here", "two"])], "id int, sentences array<string>")
    plan = services.translation_plan(texts, frame(spark, [], "key string, value string")).collect()
    assert [(r.ord, r.segment, r.translation) for r in plan] == [(0, "one sentence here two", None)]
    again = services.translation_plan(texts, frame(spark, [(plan[0].key, "译文")], "key string, value string")).first()
    assert again.translation == "译文"


def test_jobs_health_and_cache(spark):
    jobs = frame(spark, [(i, "done" if i else "running", i, f"k{i}") for i in range(40)], "id int, status string, created int, key string")
    kept = {r.id for r in services.kept_jobs(jobs).collect()}
    assert kept == {0, *range(10, 40)} and [r.key for r in services.is_running(jobs).collect()] == ["k0"]
    calls = frame(spark, [("2024-01-02", "a", True), ("2024-01-02", "zz", False), ("2023-01-01", "a", False)], "d string, dep string, ok boolean").withColumn("ts", F.to_timestamp("d"))
    last = F.to_date(F.lit("2024-01-03"))
    h = telemetry.health(calls, last, known=["a"])
    assert {(r.dep, r.ok, r.fail) for r in h.collect()} == {("a", 1, 0), ("other", 0, 1)}
    assert services.health_line(h, 2).first().line == "近 7 天成功率 · a 100.0%(1) / other 0.0%(1) · 错误 2 次" and "无外部" in services.health_line(h.limit(0), 0).first().line
    log = frame(spark, [("2024-01-02", "x" * 300), ("2024-01-01", "old"), ("2024-01-03", "")], "d string, detail string").withColumn("ts", F.to_timestamp("d"))
    assert telemetry.errors(log, last).first()[:] == (2, "x" * 200)
    e = frame(spark, [("abs", "k", "v", 0.0), ("abs", "l", "v", 10 * 86400.0)], "kind string, key string, value string, t double")
    assert [r.key for r in telemetry.cache_live(e, F.lit(15 * 86400.0)).collect()] == ["l"]
    assert telemetry.cache_stats(frame(spark, [(3, 1)], "hits long, misses long"), e).first()[:] == (3, 1, 75.0, 2)
    assert telemetry.cache_stats(frame(spark, [], "hits long, misses long"), e).first().hit_rate is None
    assert [value(spark, "", lambda c, s=s: telemetry.retryable(F.lit(s))) for s in (429, 404)] == [True, False]


def test_attempts_keep_failures_apart(spark):
    def fetch(k):
        if k == "bad":
            raise ValueError("no")
        return k.upper()

    got = {r.key: (r.ok, r.value, r.error) for r in services.attempted(frame(spark, [("a",), ("bad",)], "key string"), fetch).collect()}
    assert got == {"a": (True, "A", None), "bad": (False, None, "ValueError: no")}


def test_narrative(spark):
    got = services.split_narrative(frame(spark, [(1, "intro\n## One\nbody 1\n\n## Two\nbody 2"), (2, None)], "id int, text string")).orderBy("ord").collect()
    assert [(r.heading, r.body) for r in got] == [("", "intro"), ("One", "body 1"), ("Two", "body 2")]


def test_funnel(spark):
    rows = frame(spark, [("w1", "a", 1), ("w2", "a", 2)], "week string, channel string, n int")
    got = {(r.week, r.n) for r in funnel.upsert(rows, frame(spark, [("w1", "a", None), ("w2", "a", 5), ("w3", "a", 7)], "week string, channel string, n int"), ["week", "channel"]).collect()}
    assert got == {("w1", 1), ("w2", 5), ("w3", 7)}
    daily = frame(spark, [(f"2024-01-0{i}", i) for i in range(1, 6)], "day string, n int")
    assert sorted(r.n for r in funnel.last_days(daily, 2).collect()) == [4, 5]


@pytest.mark.parametrize("msg,kind", [("SSLCertVerificationError: x", "certificate"), ("Max retries exceeded", "unreachable"), ("it timed out", "timeout"), ("other", "other")])
def test_friendly_error(spark, msg, kind):
    assert value(spark, msg, X.friendly_error) == kind
