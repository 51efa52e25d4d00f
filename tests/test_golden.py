"""Results that SQL cannot give, against values worked out by hand."""

from pyspark.sql import functions as F

from evispark.functions import text as X
from evispark.operators import cite, compare, extract, keywords, layout, library, locate, telemetry, vocab
from evispark.plans import catalogue, fixtures
from evispark.streaming import counter


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_sentences_keep_abbreviations(spark):
    assert one(spark, "As in Fig. 3 we saw it.  Short.  A second sentence here!", X.sentences) == ["As in Fig. 3 we saw it.", "A second sentence here!"]


def test_tokens(spark):
    assert one(spark, "Patients' studies; the approaches: 中文词 a", X.tokens) == ["patient", "study", "the", "approache", "中文", "文词", "a"]


def test_tags_and_lead(spark):
    assert one(spark, "RCT, heart；rct|  #new  tag ", X.parse_tags) == ["RCT", "heart", "new tag"]
    assert one(spark, "此外，然而，结果如此。", X.clean_lead) == "结果如此。"


def test_sections_of_labelled_text(spark):
    a = extract.with_sections(fixtures.frame(spark, fixtures.ARTICLES, fixtures.ARTICLE_COLUMNS)).where("ord = 6").select("sec.METHODS", "sec.CONCLUSIONS", "sec.PATIENTS").first()
    assert a[0] == "A total of 412 adults were enrolled across centers."
    assert a[1] == "Drug A lowered LDL and was well tolerated." and a[2] is None


def test_fulltext_wins_over_abstract(spark):
    row = [("1", "T", "METHODS: n = 20. RESULTS: none.", [("2. Methods", "We enrolled 350 adults."), ("", " ")])]
    a = spark.createDataFrame(row, "pmid string, title string, abstract string, fulltext_sections array<struct<title:string,text:string>>")
    p = extract.profile(a).select("n", "source_label").first()
    assert tuple(p) == (350, "全文")


def test_profiles(spark):
    rows = {r["ord"]: r for r in extract.profile(fixtures.frame(spark, fixtures.ARTICLES, fixtures.ARTICLE_COLUMNS)).collect()}
    assert rows[1]["design"] == "随机对照试验" and rows[1]["n"] == 1204 and rows[1]["polarity"] == "支持有效 / 正相关"
    assert rows[2]["polarity"] == "未明确" and rows[3]["design"] == "队列研究"
    assert rows[7]["bias_brief"] == "无摘要，无法评估"


def test_duplicates_fold(spark):
    assert compare.duplicates(fixtures.frame(spark, fixtures.ARTICLES, fixtures.ARTICLE_COLUMNS)).first()[0] == 1


def test_bibtex_suffix(spark):
    rows = [(1, ["Smith JA"], "Heart trial", "2020"), (2, ["Smith JB"], "Heart trial two", "2020")]
    got = [r.text.split(",")[0] for r in cite.bibtex(spark.createDataFrame(rows, "ord int, authors array<string>, title string, year string")).orderBy("ord").collect()]
    assert got == ["@article{smith2020heart", "@article{smith2020hearta"]



def test_concept_cover(spark):
    k = spark.createDataFrame([(1, "aspirin heart attack")], "id int, keyword string")
    known = spark.createDataFrame([("heart attack", "MI"), ("attack", "no")], "term string, heading string")
    assert [(r.text, r.heading) for r in vocab.split_concepts(k, known).orderBy("ord").collect()] == [("aspirin", None), ("heart attack", "MI")]


def test_merge_spans(spark):
    a = spark.createDataFrame([([(5, 9), (1, 3), (3, 4), (8, 12)],)], "x array<struct<start:int,end:int>>")
    assert [tuple(s) for s in a.select(locate.merge_spans(F.col("x"))).first()[0]] == [(1, 4), (5, 12)]


def test_layout_sections(spark):
    words = [("d", 1, x, x + 40.0, y, y + 10.0, size, "Times", w) for y, size, ws in [(50.0, 12.0, ["Introduction"]), (70.0, 10.0, ["Some", "words", "here"]), (90.0, 12.0, ["Methods"]), (110.0, 10.0, ["More", "words"])] for x, w in zip([50.0, 95.0, 140.0], ws)]
    got = {r.title: r.text for r in layout.sections(fixtures.frame(spark, words, "doc_id string, page int, x0 double, x1 double, top double, bottom double, size double, fontname string, text string")).collect()}
    assert got == {"Introduction": "Some words here", "Methods": "More words"}
    assert layout.NAMES[0] == "abstract"


def test_summary_takes_different_sentences(spark):
    d = spark.createDataFrame([(1, "Alpha beta gamma delta works. Alpha beta gamma delta works. Other words stand here now. Nothing else is said at all.")], "doc_id int, text string")
    assert len({r.sentence for r in keywords.summaries(d, 0.5, 2).collect()}) == 2


def test_folder_names_are_unique(spark):
    f = spark.createDataFrame(fixtures.FOLDERS, "id string, name string, created_at string")
    new = spark.createDataFrame([("n1", " to  read", "2"), ("n2", "Fresh", "1")], "id string, name string, created_at string")
    assert sorted(r.id for r in library.add_folders(f, new).collect()) == ["f1", "f2", "f3", "n2"]


def test_stream_equals_batch(spark, tmp_path):
    from evispark.operators import funnel

    rows = [("2024-01-01 01:00:00", "a", "x"), ("2024-01-01 02:00:00", "a", "y"), ("2024-01-01 03:00:00", "b", "x"), ("2024-01-02 01:00:00", "a", "y")]
    hits = spark.createDataFrame(rows, "t string, visitor string, channel string").select(F.col("t").cast("timestamp").alias("ts"), "visitor", "channel")
    hits.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = counter.daily_uniques(spark.readStream.schema(hits.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("uniq").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("uniq").collect())) == sorted(map(tuple, funnel.daily_uniques(hits).select("day", "channel", "n").collect()))


def test_fulltext_summary_quota(spark):
    from evispark.operators import keywords as K

    long = "Alpha beta gamma was seen in many places. Delta words stand in this second sentence. Other things are told in a third one. "
    rows = [(1, 0, "Funding", long * 3), (1, 1, "1. Results", long * 4), (1, 2, "Methods", long * 2 + "The HR was 0.8 here."), (1, 3, "Short", "Too short.")]
    s = spark.createDataFrame(rows, "doc_id int, ord int, title string, text string")
    got = {r.ord: r for r in K.fulltext_summary(s, 4).collect()}
    assert set(got) == {1, 2} and got[1].quota + got[2].quota == 4 and got[1].title == "Results" and got[1].title_zh == "结果"
    assert [tuple(r) for r in K.metrics(s).collect()] == [(1, "风险比/比值比", 1, ["HR was 0.8"])]


def test_report_lines(spark):
    from evispark.operators import reports
    from evispark.sources import sinks

    p = extract.profile(fixtures.frame(spark, fixtures.ARTICLES, fixtures.ARTICLE_COLUMNS).where("ord in (1, 7)"))
    lines = [r.line for r in reports.flags(p).orderBy("ord", "pos").collect()]
    assert lines[-1] == "- **信息缺失** 无摘要，无法评估" and lines[0].startswith("### Drug A in heart failure: a trial — ")
    flow = compare.prisma(spark.createDataFrame(fixtures.PRISMA[:1], "id int, total_hits int, retrieved int, duplicates int, excluded_screening int, excluded_fulltext int"))
    assert sinks.joined(reports.prisma(flow), "pos", "line", "\n").splitlines()[-1] == "- 纳入: 5"
    refs = reports.references(fixtures.frame(spark, fixtures.ARTICLES, fixtures.ARTICLE_COLUMNS)).where("ord = 3").first().line
    assert refs == "O'Neil P. Harms of drug A. BMJ. 2019. PMID: 103"


def test_bibtex_suffixes_after_one_byte(spark):
    a = spark.range(1, 402).selectExpr("cast(id as int) as ord", "array('Lee K') as authors", "'Rash after drug' as title", "'2020' as year")
    got = {r.ord: r.text.split(",\n")[0].removeprefix("@article{lee2020rash") for r in cite.bibtex(a).collect()}
    assert got == {n + 1: chr(96 + n) if n else "" for n in range(401)}
    codes = spark.createDataFrame([(0xD7FF - 96,), (0xD800 - 96,), (0x1F600 - 96,), (0x110000 - 96,)], "n int").select(cite._letter(F.col("n")).alias("c"))
    assert [r.c for r in codes.collect()] == ["퟿", f"-{0xD800 - 96}", "\U0001f600", f"-{0x110000 - 96}"]


def test_values_after_letters_of_other_scripts(spark):
    text = "合并OR 0.8与éHR 1.2 were found；样本量n = 120例, xHR 3 and _n = 4 are none."
    got = one(spark, text, lambda c: F.transform(X.values(c), lambda v: v["value"]))
    assert got == ["OR 0.8", "HR 1.2", "n = 120"]
    assert one(spark, text, lambda c: F.size(locate.value_spans(c))) == 3


def test_effects_after_letters_of_other_scripts(spark):
    text = "éRR 79.118 and 与HR 0.72; 合计WMD -1.5，其P < 0.05, xOR 3. 共纳入n = 412 例."
    got = one(spark, text, lambda c: extract.effects(c))
    assert (got.RR, got.HR, got.OR, got.MD, got.P) == (["79.118"], ["0.72"], [], ["WMD -1.5"], ["P < 0.05"])
    assert one(spark, text, extract.largest_size) == 412
    assert one(spark, "follow-up of 3 years与", lambda c: extract.followup(c)["months"]) == 36


def test_distinct_ci_works_its_array_out_once(spark):
    assert one(spark, ["RCT", "rct", "Heart", "RCT", "heart"], X.distinct_ci, "array<string>") == ["RCT", "Heart"]
    assert "array_position(transform(" not in spark.range(1).select(X.distinct_ci(F.array(F.lit("a"), F.lit("A"))))._jdf.queryExecution().analyzed().toString()
