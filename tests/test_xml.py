"""Mixed and nested XML, against values worked out by hand."""

import pyarrow as pa
from pyspark.sql import functions as F

from evispark.sources import readers, xmlrecords


def test_inline_markup_keeps_its_text(spark, tmp_path):
    (tmp_path / "a.xml").write_text("""<?xml version="1.0"?><!DOCTYPE PubmedArticleSet><PubmedArticleSet>
<PubmedArticle><MedlineCitation><PMID>1</PMID><Article><ArticleTitle>On <i>E. coli</i> and CO<sub>2</sub></ArticleTitle>
<Abstract><AbstractText Label="METHODS">We used <i>in vitro</i> cells (n = 120).</AbstractText><AbstractText><b>Bold</b> &amp; plain</AbstractText><AbstractText> </AbstractText></Abstract>
<AuthorList><Author><Initials>Q</Initials></Author><Author><LastName>Li</LastName></Author></AuthorList></Article></MedlineCitation></PubmedArticle>
<PubmedBookArticle><PMID>9</PMID></PubmedBookArticle>
<PubmedArticle Owner="x"><MedlineCitation><PMID>2</PMID></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>3</PMID><broken></MedlineCitation></PubmedArticle></PubmedArticleSet>""")
    got = {r.pmid: r for r in readers.articles_xml(spark, str(tmp_path / "a.xml")).collect()}
    assert set(got) == {"1", "2", None} and "mismatched" in got[None].error
    r = got["1"]
    assert r.title == "On E. coli and CO2" and r.abstract == "METHODS: We used in vitro cells (n = 120).\nBold & plain" and r.authors == ["Li"]
    assert r.abstract_sections == {"METHODS": "We used in vitro cells (n = 120)."} and r.error is None
    assert got["2"].title == "" and got["2"].authors == [] and got["2"].mesh == [] and got["2"].year is None


def test_mesh_and_ids(spark):
    xml = """<PubmedArticle xmlns="urn:x"><MedlineCitation><MeshHeadingList><MeshHeading><DescriptorName UI="D1" MajorTopicYN="Y">Heart</DescriptorName><QualifierName MajorTopicYN="Y">drugs</QualifierName></MeshHeading>
<MeshHeading><QualifierName>lost</QualifierName></MeshHeading><MeshHeading><DescriptorName>Rest</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="pmc"> PMC1 </ArticleId></ArticleIdList><ReferenceList><Reference><ArticleIdList><ArticleId IdType="pmc">PMC2</ArticleId></ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle>"""
    r = xmlrecords.articles(spark.createDataFrame([(xml, 5), (None, 6)], "xml string, article_ int")).orderBy("article_").collect()
    a = r[0].article
    assert [(m.heading, m.ui, m.major, [q.name for q in m.qualifiers]) for m in a.mesh] == [("Heart", "D1", True, ["drugs"]), ("Rest", "", False, [])]
    assert a.mesh_major == ["Heart"] and a.pmcid == "PMC1" and r[1].article is None


def test_nested_sections_and_fallback(spark, tmp_path):
    (tmp_path / "f.xml").write_text("""<article><body><p>We <i>lead</i>.</p><sec><p>No title</p></sec><sec><title>Methods</title><p>One.</p><sec><title>Cells</title><p>Two <b>bold</b>.</p><p> </p></sec></sec><sec><title>Empty</title></sec><p>late</p></body>
<sub-article><body><p>answer</p></body></sub-article></article><article><body><box><p>Only <i>in</i></p></box><p>boxes</p></body></article><article><front/></article><article><body><disp><p>Only</p><p>here</p></disp></body></article>""")
    got = [[(s.title, s.text) for s in r.sections] for r in readers.fulltext_xml(spark, str(tmp_path / "f.xml")).collect()]
    assert got[0] == [("引言", "We lead."), ("正文", "No title"), ("Methods", "One. Two bold .")]
    assert got[1:] == [[("引言", "boxes")], [], [("正文", "Only here")]]


def test_figures(spark, tmp_path):
    (tmp_path / "g.xml").write_text("""<article><body><sec><fig id="f1"><label>Fig. 1</label><caption><title>T.</title><p>Of <i>x</i></p></caption><graphic xmlns:x="http://www.w3.org/1999/xlink" x:href="a.jpg"/></fig>
<fig-group><fig><alternatives><graphic id="g2"/><graphic id="g3"/></alternatives></fig></fig-group><fig id="f3"><label>none</label></fig></sec></body></article>""")
    assert [tuple(r) for r in readers.figures_xml(spark, str(tmp_path / "g.xml")).collect()] == [("Fig. 1", "T.Of x", "a.jpg", "f1"), ("", "", "g2", "")]


def test_records_of_many_files_and_splits(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.xml").write_text("<PubmedArticleSet>" + "".join(f"<PubmedArticle><MedlineCitation><PMID>{k * 100 + i}</PMID></MedlineCitation></PubmedArticle>\n" for i in range(50)) + "</PubmedArticleSet>")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        got = readers.articles_xml(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 3 and sorted(int(r.pmid) for r in got.select("pmid").collect()) == sorted(k * 100 + i for k in range(3) for i in range(50))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_batch_is_parsed_in_runs_of_bounded_bytes(spark, monkeypatch):
    rows = pa.record_batch({"k": list(range(7)), "xml": ["é" * 5, None, "b" * 25, "", "c" * 4, "d" * 16, None]})
    monkeypatch.setattr(xmlrecords, "SLICE", 20)
    assert [x.column("k").to_pylist() for x in xmlrecords._slices(rows, "xml")] == [[0, 1], [2], [3, 4, 5, 6]]
    assert list(xmlrecords._slices(rows.slice(0, 0), "xml")) == []
    monkeypatch.undo()
    text = "<article><body><p>" + "x" * (xmlrecords.SLICE // 3) + "</p></body></article>"
    df = spark.range(0, 9, 1, 1).selectExpr("id", "if(id % 4 = 3, null, if(id = 5, '<a>', '')) as e").withColumn("xml", F.when(F.col("e") == "", F.lit(text)).otherwise(F.col("e")))
    got = xmlrecords.parsed(df, xmlrecords.sections, xmlrecords.SECTIONS).collect()
    assert [r.id for r in got if r.parsed is None] == [3, 7] and "no element" in got[5].parsed.error
    assert all(len(got[i].parsed.sections[0].text) == xmlrecords.SLICE // 3 for i in (0, 1, 2, 4, 6, 8))
