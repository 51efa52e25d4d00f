"""Queries whose articles, records and entries are derived from the given tables, each with its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from evispark.plans import catalogue
from evispark.plans import fixtures as S
from evispark.plans.catalogue import query, sents, t
from evispark.functions import lexicon as L
from evispark.functions import text as X
from evispark.operators import compare, desk, draft, extract, funnel, keywords, layout, library, locate, numbering, reports, services, telemetry, vocab
from evispark.sources import paged, readers, sinks, staging, xmlrecords

# --- XML that Spark makes of texts and pages, and what must be read back

_BAD = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def escaped(c: Column) -> Column:
    """A text as XML; carriage returns as references, since readers make line feeds of them."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


_SQUEEZE = lambda c: f"regexp_replace(regexp_replace({c}, '{_BLANK}+', ' ', 'g'), '^ | $', '', 'g')"
_STRIP = lambda c: f"regexp_replace(regexp_replace({c}, '^{_BLANK}+', ''), '{_BLANK}+$', '')"


@query(f"""WITH d AS (SELECT doc_id, source, lang, regexp_replace(coalesce(text, ''), '{_BAD}', '', 'g') AS x FROM documents),
 p AS (SELECT *, x[1:40] AS a, x[41:length(x) // 2] AS b, x[greatest(41, length(x) // 2 + 1):] AS c FROM d),
 q AS (SELECT doc_id, source, lang, {_SQUEEZE("a || 'H' || '2' || 'O'")} AS title, {_STRIP("a || b || '.'")} AS m, {_STRIP("c")} AS o FROM p)
 SELECT doc_id, title, md5(concat_ws(chr(10), 'Methods: ' || m, nullif(o, ''), 'METHODS:: again')) AS abstract, md5(m || ' again') AS methods, lang AS language, 'The ' || coalesce(source, '') || ' group' AS last_author,
  '10.1/' || doc_id AS doi, CASE WHEN doc_id % 2 = 0 THEN '2020' ELSE '2021 Jan-Feb' END AS year, 'M' || doc_id % 7 AS mesh_major, 'https://pubmed.ncbi.nlm.nih.gov/' || doc_id || '/' AS url FROM q""")
def xml_articles(spark, d):
    x = F.regexp_replace(F.coalesce("text", F.lit("")), _BAD, "")
    half = F.greatest(F.lit(40), F.floor(F.length("x") / 2)).cast("int")
    rows = t(spark, d, "documents").select("doc_id", "lang", "source", x.alias("x")).withColumns({"a": escaped(F.substring("x", 1, 40)), "b": escaped(F.substring(F.col("x"), F.lit(41), half - 40)), "c": escaped(F.substring(F.col("x"), half + 1, F.length("x")))})
    date = F.when(F.col("doc_id") % 2 == 0, "<Year>2020</Year>").otherwise("<MedlineDate>2021 Jan-Feb</MedlineDate>")
    key, group = F.col("doc_id").cast("string"), _cat("The ", escaped(F.coalesce("source", F.lit(""))), " group")
    xml = _cat(
        "<PubmedArticle><MedlineCitation><PMID Version='1'>", key, "</PMID><Article><Journal><JournalIssue><PubDate>", date, "</PubDate></JournalIssue></Journal><ArticleTitle>", F.col("a"), "<i>H<sub>2</sub>O</i></ArticleTitle>",
        "<Abstract><AbstractText Label='Methods'>", F.col("a"), "<b>", F.col("b"), "</b>.</AbstractText><AbstractText>", F.col("c"), "</AbstractText><AbstractText NlmCategory='METHODS:'>again</AbstractText></Abstract>",
        "<AuthorList><Author><LastName>Li</LastName><Initials>X</Initials></Author><Author><CollectiveName>", group, "</CollectiveName></Author></AuthorList><Language>", escaped(F.col("lang")), "</Language></Article>",
        "<CommentsCorrectionsList><CommentsCorrections><PMID>0</PMID></CommentsCorrections></CommentsCorrectionsList><MeshHeadingList><MeshHeading><DescriptorName UI='D1' MajorTopicYN='Y'>M", (F.col("doc_id") % 7).cast("string"),
        "</DescriptorName><QualifierName MajorTopicYN='N'>q</QualifierName></MeshHeading></MeshHeadingList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType='doi'>10.1/", key,
        "</ArticleId></ArticleIdList><ReferenceList><Reference><ArticleIdList><ArticleId IdType='doi'>10.9/other</ArticleId></ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle>")
    got = xmlrecords.articles(rows.select("doc_id", xml.alias("xml")))
    a = lambda f: F.col(f"article.{f}")
    return got.select("doc_id", a("title").alias("title"), F.md5(a("abstract")).alias("abstract"), F.md5(F.try_element_at(a("abstract_sections"), F.lit("METHODS"))).alias("methods"), a("language").alias("language"),
                      F.try_element_at(a("authors"), F.lit(-1)).alias("last_author"), a("doi").alias("doi"), a("year").alias("year"), F.array_join(a("mesh_major"), ";").alias("mesh_major"), a("url").alias("url"))


_PARAGRAPHS = f"list_filter(list_transform(regexp_extract_all(html, '<p[^>]*>([^<]*)</p>', 1), lambda p: regexp_replace(p, '{_BAD}', '', 'g')), lambda p: length(p) > 0)"


def _fulltext_xml(spark, d):
    """``page_id, xml``: paragraphs of pages as a lead, sections in sections, a section without title, and, of every third page, a box only."""
    plain = F.transform(F.regexp_extract_all("html", F.lit("<p[^>]*>([^<]*)</p>"), F.lit(1)), lambda p: F.regexp_replace(p, _BAD, ""))
    rows = t(spark, d, "pages").select("page_id", F.filter(plain, lambda p: F.length(p) > 0).alias("p"))
    at = lambda i: escaped(F.coalesce(F.get("p", F.lit(i)), F.lit("")))
    rest = F.array_join(F.transform(F.slice("p", 6, 1_000_000), lambda p: _cat("<p>", escaped(p), "</p>")), "")
    key = F.col("page_id").cast("string")
    figs = _cat("<floats-group><fig id='f", key, "'><label>Figure <b>1</b></label><caption><title>", at(0), "</title><p>", at(1), "</p></caption><alternatives><graphic xlink:href='img-", key, ".jpg' xmlns:xlink='http://www.w3.org/1999/xlink'/></alternatives></fig><fig id='none'><label>Figure 2</label></fig></floats-group>")
    nested = _cat("<body><p>", at(0), "<italic>", at(1), "</italic></p><sec><title>A <bold>", at(1), "</bold></title><p>", at(2), "</p><sec><title>inner</title><p>", at(3), "<sub>", at(4), "</sub></p><sec>", rest, "</sec></sec></sec><sec><title>empty</title><p> </p></sec><p>late</p><sec><p>", at(2), "</p></sec></body>")
    box = _cat("<body><boxed-text>", rest, "<p>", at(0), "<xref>1</xref></p></boxed-text></body>")
    return rows.select("page_id", _cat("<article><front><p>front</p></front>", F.when(F.col("page_id") % 3 == 0, box).otherwise(nested), figs, "<sub-article><body><p>answer</p></body></sub-article></article>").alias("xml"))


@query(f"""WITH a AS (SELECT page_id, {_PARAGRAPHS} AS p FROM pages), x AS (SELECT page_id, p, coalesce(p[1], '') AS a, coalesce(p[2], '') AS b, coalesce(p[3], '') AS c, coalesce(p[4], '') AS e, coalesce(p[5], '') AS f, coalesce(array_to_string(p[6:], ' '), '') AS r FROM a),
 s AS (SELECT page_id, 0 AS pos, '引言' AS title, {_SQUEEZE('a || b')} AS text FROM x WHERE page_id % 3 <> 0
  UNION ALL SELECT page_id, 1, {_STRIP("'A ' || b")}, {_SQUEEZE("concat_ws(' ', c, e, f, r)")} FROM x WHERE page_id % 3 <> 0
  UNION ALL SELECT page_id, 2, '正文', {_SQUEEZE('c')} FROM x WHERE page_id % 3 <> 0
  UNION ALL SELECT page_id, 0, '正文', {_SQUEEZE("concat_ws(' ', r, a, '1')")} FROM x WHERE page_id % 3 = 0
  UNION ALL SELECT page_id, 3, '正文', 'late' FROM x WHERE page_id % 3 <> 0 AND {_SQUEEZE("concat_ws(' ', a, b, c, e, f, r)")} = '')
 SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, title, md5(text) AS text FROM s WHERE text <> ''""")
def xml_fulltexts(spark, d):
    got = xmlrecords.fulltexts(_fulltext_xml(spark, d))
    return got.select("page_id", F.posexplode("fulltext.sections").alias("pos", "s")).select("page_id", F.col("pos").cast("long").alias("pos"), "s.title", F.md5("s.text").alias("text"))


@query(f"""SELECT page_id, 'Figure' AS label, md5({_STRIP("coalesce(p[1], '') || coalesce(p[2], '')")}) AS caption, 'img-' || page_id || '.jpg' AS file, 'f' || page_id AS fig_id FROM (SELECT page_id, {_PARAGRAPHS} AS p FROM pages)""")
def xml_figures(spark, d):
    got = xmlrecords.figure_rows(_fulltext_xml(spark, d))
    return got.select("page_id", F.explode("figures.figures").alias("f")).select("page_id", F.col("f.label").alias("label"), F.md5("f.caption").alias("caption"), "f.file", "f.fig_id")


# --- a source of pages, whose pages Spark writes from a table

@query("""SELECT doc_id::VARCHAR AS id, row_number() OVER (ORDER BY doc_id) - 1 AS ord, count(*) OVER () AS total, md5(text) AS record, CASE WHEN text IS NULL THEN 'not fetched' END AS error FROM documents""")
def paged_documents(spark, d):
    rows = numbering.numbered(t(spark, d, "documents").select("doc_id", "text"), "doc_id").select((F.col("n") - 1).alias("ord"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("record"))
    _, root = staging.written(rows.repartitionByRange("ord").sortWithinPartitions("ord"), "paged-documents")
    got = paged.read(spark, paged.TableTransport, "all", limit=1 << 40, root=root, page=2000)
    return got.select("id", "ord", "total", F.md5("record").alias("record"), "error")


# --- duplicates in reading order, terms in texts, nearest names

_ARTICLES = """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE (length(text) % 200)::VARCHAR END AS p, left(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9一-鿿]', '', 'g'), 80) AS t, doc_id % 7 = 0 AS bare FROM documents"""


@query(f"""WITH r AS (SELECT doc_id, list_filter(['p' || p, CASE WHEN bare THEN '' ELSE 't' || t END], lambda k: length(k) > 1) AS keys, doc_id % 5 AS review FROM ({_ARTICLES})),
 f AS (SELECT review, list_reduce([{{'k': NULL::VARCHAR[], 's': []::VARCHAR[], 'n': 0}}] || list({{'k': keys, 's': []::VARCHAR[], 'n': 0}} ORDER BY doc_id),
  lambda a, x: CASE WHEN list_has_any(a.s, x.k) THEN {{'k': x.k, 's': a.s, 'n': a.n + 1}} ELSE {{'k': x.k, 's': a.s || x.k, 'n': a.n}} END) AS z FROM r GROUP BY review)
 SELECT review::VARCHAR AS review, z.n AS n FROM f""")
def duplicates_by_review(spark, d):
    rows = t(spark, d, "documents").select(
        F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 3 == 0, "").otherwise((F.length("text") % 200).cast("string")).alias("pmid"),
        F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"), (F.col("doc_id") % 5).alias("review"))
    return compare.duplicates(rows, review="review")


@query("""WITH a AS (SELECT doc_id, lower(coalesce(text, '')) AS doc FROM documents),
 terms AS (SELECT DISTINCT lower(unnest([split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2), split_part(text, ' ', 3), split_part(text, ' ', 5) || ' ' || split_part(text, ' ', 6) || ' ' || split_part(text, ' ', 7)])) AS term FROM benchmark),
 h AS (SELECT term, doc_id, doc FROM terms, a WHERE trim(term) <> '' AND contains(doc, term))
 SELECT term, count(*) AS docs, sum(doc_id)::BIGINT AS ids FROM h
 WHERE NOT regexp_matches(term, '\\p{L}$') OR regexp_matches(doc, regexp_escape(term) || '($|\\P{L})') GROUP BY term""")
def terms_in_documents(spark, d):
    word = lambda i: F.split_part("text", F.lit(" "), F.lit(i))
    terms = t(spark, d, "benchmark").select(F.explode(F.array(F.concat_ws(" ", word(1), word(2)), word(3), F.concat_ws(" ", word(5), word(6), word(7)))).alias("term")).select(F.lower("term").alias("term"))
    rows = t(spark, d, "documents").select(F.col("doc_id").alias("row_key"), F.col("text").alias("title"), F.lit(None).cast("string").alias("conclusion"))
    return compare.term_documents(rows, terms).groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("row_key").alias("ids"))


_WORDS = "SELECT lower(unnest(regexp_extract_all({}, '[A-Za-z]{{3,}}'))) AS w FROM {}"


@query(f"""WITH v AS (SELECT w AS name, count(*) AS weight FROM ({_WORDS.format('text', 'documents')}) GROUP BY w HAVING count(*) >= 20), q AS (SELECT DISTINCT w AS term FROM ({_WORDS.format('text', 'benchmark')}) WHERE w NOT IN (SELECT name FROM v)),
 p AS (SELECT term, name, weight, levenshtein(term, name) AS edits FROM q, v WHERE abs(length(term) - length(name)) <= 2)
 SELECT term, name AS suggestion FROM p WHERE edits <= 2 QUALIFY row_number() OVER (PARTITION BY term ORDER BY edits, weight DESC, name) = 1""")
def spelling_suggestions(spark, d):
    words = lambda name: t(spark, d, name).select(F.explode(F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]{3,}"), F.lit(0))).alias("w")).select(F.lower("w").alias("w"))
    names = words("documents").groupBy(F.col("w").alias("name")).agg(F.count(F.lit(1)).alias("weight")).where("weight >= 20")
    return vocab.suggest(words("benchmark").select(F.col("w").alias("term")), names)


# --- calls, a cache, jobs and a log made of events

@query("""WITH c AS (SELECT event_type AS dep, ts::DATE AS day, count(*) FILTER (WHERE value >= 5) AS k, count(*) FILTER (WHERE NOT coalesce(value >= 5, false)) AS b FROM events WHERE ts IS NOT NULL AND extract('day' FROM ts) % 9 <> 4 GROUP BY ALL),
 s AS (SELECT dep, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM c GROUP BY dep), f AS (SELECT s.dep, s.day, coalesce(k, 0) AS k, coalesce(b, 0) AS b FROM s LEFT JOIN c ON c.dep = s.dep AND c.day = s.day),
 w AS (SELECT day, dep, (sum(k) OVER x)::BIGINT AS ok, (sum(b) OVER x)::BIGINT AS fail FROM f WINDOW x AS (PARTITION BY dep ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW))
 SELECT *, CASE WHEN ok + fail > 0 THEN round_even(ok * 100.0::DOUBLE / (ok + fail), 1) END AS rate FROM w""")
def health_rolling_7d(spark, d):
    calls = t(spark, d, "events").where("extract(day from ts) % 9 <> 4").select("ts", F.col("event_type").alias("dep"), (F.col("value") >= 5).alias("ok"))
    return telemetry.health_rolling(calls)


def _cache_ops(spark, d):
    n = F.col("event_id") % 10
    op = F.when(n < 3, "put").when(n == 3, "clear").otherwise("get")
    return t(spark, d, "events").select(F.when(F.col("event_id") % 3 == 0, "search").otherwise("fulltext").alias("kind"), F.concat(F.lit("k"), (F.col("user_id") % 40).cast("string")).alias("key"), "ts", F.col("event_id").alias("seq"), op.alias("op"), F.col("event_type").alias("value"))


@query("""WITH o AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'search' ELSE 'fulltext' END AS kind, 'k' || user_id % 40 AS key, ts, event_id AS seq, event_id % 10 AS n, event_type AS value FROM events),
 l AS (SELECT *, last_value(CASE WHEN n <= 3 THEN {'put': n < 3, 'value': value, 'at': ts} END IGNORE NULLS) OVER (PARTITION BY kind, key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS last FROM o),
 h AS (SELECT *, coalesce(last.put AND ts - last.at <= CASE kind WHEN 'search' THEN INTERVAL 3 DAYS ELSE INTERVAL 7 DAYS END, false) AS hit FROM l WHERE n > 3)
 SELECT kind, key, seq, hit, CASE WHEN hit THEN last.value END AS value FROM h""")
def cache_reads(spark, d):
    return telemetry.cache_reads(_cache_ops(spark, d)).drop("ts")


def _job_events(spark, d):
    n = F.col("event_id") % 7
    event = F.when(n == 0, "start").when(n < 3, "done").when(n == 3, "error").otherwise("consume")
    return t(spark, d, "events").select(F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("event_type"), F.lit("-"), F.dayofmonth("ts").cast("string")).alias("id"), "ts", F.col("event_id").alias("seq"), event.alias("event"))


@query("""WITH e AS (SELECT user_id || '-' || event_type || '-' || extract('day' FROM ts) AS id, (ts, event_id) AS p, event_id AS seq, event_id % 7 AS n FROM events),
 s AS (SELECT id, min(p) AS s FROM e WHERE n = 0 GROUP BY id), f AS (SELECT id, min(p) AS f FROM e JOIN s USING (id) WHERE n BETWEEN 1 AND 3 AND p > s GROUP BY id), c AS (SELECT id, min(p) AS c FROM e JOIN f USING (id) WHERE n > 3 AND p > f GROUP BY id)
 SELECT id, seq, coalesce(p = c, false) AS granted FROM e LEFT JOIN c USING (id) WHERE n > 3""")
def job_grants(spark, d):
    return telemetry.job_grants(_job_events(spark, d)).drop("ts")


@query("""WITH l AS (SELECT event_type || '/' || user_id % 3 AS name, event_id % 11 = 0 AS failed, (value * 10)::BIGINT AS ms FROM events WHERE event_id % 4 <> 0 AND ts::DATE >= DATE '2024-01-30' - 14)
 SELECT name, count(*) AS spans, count(*) FILTER (WHERE failed) AS failed, max(ms) AS longest_ms, sum(ms)::BIGINT AS total_ms FROM l GROUP BY name""")
def log_spans(spark, d):
    name, ms = F.concat(F.col("event_type"), F.lit("/"), (F.col("user_id") % 3).cast("string")), F.bround(F.col("value") * 10).cast("long").cast("string")
    line = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("→ "), name)).otherwise(F.concat(F.lit("← "), name, F.when(F.col("event_id") % 11 == 0, " 失败").otherwise(" 完成"), F.lit(" · "), ms, F.lit("ms")))
    log = telemetry.pruned(t(spark, d, "events").select("ts", line.alias("message")), F.lit("2024-01-30").cast("date"))
    return telemetry.spans(log).groupBy("name").agg(F.count(F.lit(1)).alias("spans"), F.count_if("failed").alias("failed"), F.max("ms").alias("longest_ms"), F.sum("ms").alias("total_ms"))


# --- pages laid out from documents: a title, authors, then ten words a line

_PAGE_WORDS = 400


def _page_words(spark, d):
    """Pages made of each document with their words: a large title and a line of authors, a heading on each page, and its words."""
    w = t(spark, d, "documents").select("doc_id", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0)).alias("w"))
    word = lambda x, y, size, font, text: F.struct(x.cast("double").alias("x0"), (x + 45).cast("double").alias("x1"), F.lit(y).cast("double").alias("top") if isinstance(y, (int, float)) else y.cast("double").alias("top"), F.lit(float(size)).alias("size"), F.lit(font).alias("fontname"), text.alias("text"))
    row = lambda y, size, font, *texts: [word(F.lit(50 + 50 * i), y, size, font, x) for i, x in enumerate(texts)]
    first = F.array(*row(20, 16, "Times", F.lit("About"), F.lit("document"), F.col("doc_id").cast("string")), *row(45, 10, "Times", F.lit("Smith"), F.lit("JA1,"), F.lit("Jones"), F.lit("B2*")), *row(65, 10, "Times-Bold", F.lit("Abstract")))
    last = F.greatest(F.ceil(F.size("w") / _PAGE_WORDS), F.lit(1)).cast("int")
    # a page has its own words only, not all of its document's
    pages = w.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), last), lambda p: F.slice("w", (p - 1) * _PAGE_WORDS + 1, _PAGE_WORDS))).alias("at", "w")).select("doc_id", (F.col("at") + 1).alias("page"), "w")
    later = F.array(*row(65, 10, "Times", F.concat(F.col("page").cast("string"), F.lit(".1")), F.lit("Statistical"), F.lit("analysis")))
    body = F.transform("w", lambda x, i: word(F.lit(50) + 50 * (i % 10), F.lit(90) + 15 * F.floor(i / 10), 10, "Times", x))
    placed = F.transform(F.concat(F.when(F.col("page") == 1, first).otherwise(later), body), lambda x: x.withField("bottom", x["top"] + 10))
    return pages.select("doc_id", "page", placed.alias("words"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"))


_LAID = f"""w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(1, greatest(ceil(len(w) / {_PAGE_WORDS}.0::DOUBLE)::BIGINT, 1) + 1)) AS page FROM w),
 b AS (SELECT doc_id, page, array_to_string(w[(page - 1) * {_PAGE_WORDS} + 1:page * {_PAGE_WORDS}], ' ') AS text FROM p)"""


@query(f"""WITH {_LAID} SELECT doc_id, 0::BIGINT AS section, '题录与摘要' AS title, md5('About document ' || doc_id || ' Smith JA1, Jones B2*') AS text FROM w
 UNION ALL SELECT doc_id, page, CASE WHEN page = 1 THEN 'Abstract' ELSE page || '.1 Statistical analysis' END, md5(text) FROM b WHERE length(text) >= 2""")
def pdf_sections(spark, d):
    return layout.sections(_page_words(spark, d)).select("doc_id", F.col("section").cast("long").alias("section"), "title", F.md5("text").alias("text"))


@query(f"""WITH {_LAID} SELECT doc_id, 'About document ' || doc_id AS title, 'Smith JA;Jones B' AS authors, '' AS pmid FROM w""")
def pdf_metadata(spark, d):
    return layout.metadata(_page_words(spark, d)).select("doc_id", "title", F.array_join("authors", ";").alias("authors"), "pmid")


# --- sheets, bookkeeping and replies

_TOOLS = [("随机对照试验", "rob2", "RoB 2", "trials"), ("队列研究", "nos", "NOS", "cohorts"), ("队列研究", "robins", "ROBINS-I", "interventions"), ("系统评价 / Meta 分析", "amstar2", "AMSTAR 2", "reviews")]
_QUESTIONS = [("rob2", 1, "Randomization", "Was the sequence random?"), ("rob2", 2, "Randomization", "Was it concealed?"), ("rob2", 3, "Outcome", "Was it blinded?"), ("nos", 1, "Selection", "Was the cohort representative?"), ("amstar2", 1, "Protocol", "Was there one?"), ("unused", 1, "None", "Nobody asks.")]
_TOOL_COLUMNS, _QUESTION_COLUMNS = "design string, id string, name string, formal string", "id string, pos int, topic string, question string"
_DESIGNED = "SELECT doc_id AS o, split_part(coalesce(text, ''), chr(10), 1) AS title, CASE doc_id % 5 WHEN 0 THEN '随机对照试验' WHEN 1 THEN '队列研究' WHEN 2 THEN '系统评价 / Meta 分析' WHEN 3 THEN '未识别' ELSE '横断面研究' END AS design FROM documents"


def _designed(spark, d):
    return t(spark, d, "documents").selectExpr("doc_id as ord", "split_part(coalesce(text, ''), '\\n', 1) as title", "case doc_id % 5 when 0 then '随机对照试验' when 1 then '队列研究' when 2 then '系统评价 / Meta 分析' when 3 then '未识别' else '横断面研究' end as design")


def _in_order(sheet):
    """Lines of a sheet with their place in their part; parts are counted one by one, the long ones by blocks of articles."""
    lines = sheet.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("a"))
    return lines.select("part", F.posexplode("a").alias("pos", "x")).select("part", (F.col("pos") + 1).cast("long").alias("pos"), F.md5("x.line").alias("line"))


@query(f"""WITH p AS ({_DESIGNED}), tools AS ({S.values(_TOOLS, _TOOL_COLUMNS)}), q AS ({S.values(_QUESTIONS, _QUESTION_COLUMNS)}), j AS (SELECT p.*, id, name, formal FROM p LEFT JOIN tools USING (design)), u AS (SELECT id, name, formal, count(*) AS n FROM j WHERE id IS NOT NULL GROUP BY ALL),
 l AS (SELECT 1 AS part, [lpad((100000000000 - n)::VARCHAR, 12, '0'), name] AS s, '- **' || name || '**：适用于 ' || n || ' 篇' AS line FROM u
  UNION ALL SELECT 2, [lpad(o::VARCHAR, 12, '0')], '- ' || title || ' → ' || design || '｜适用工具：' || coalesce(string_agg(name, '、' ORDER BY name), '（研究类型未识别，请先判断设计）') FROM j GROUP BY o, title, design
  UNION ALL SELECT 3, [id, '0'], '##### ' || name || ' — ' || formal FROM u UNION ALL SELECT 3, [id, '1', lpad(min(pos)::VARCHAR, 12, '0'), '0'], '**' || topic || '**' FROM q JOIN u USING (id) GROUP BY id, topic
  UNION ALL SELECT 3, [id, '1', lpad(pos::VARCHAR, 12, '0'), '1'], '- [ ] ' || question FROM q JOIN u USING (id))
 SELECT part, row_number() OVER (PARTITION BY part ORDER BY s, line) AS pos, md5(line) AS line FROM l""")
def appraisal_lines(spark, d):
    return _in_order(reports.appraisal_sheet(_designed(spark, d), S.frame(spark, _TOOLS, _TOOL_COLUMNS), S.frame(spark, _QUESTIONS, _QUESTION_COLUMNS)))


_LEVELS = S.values([(x[0], x[4]) for x in L.DESIGN_DIM], "design string, level string")
_CELL = "CASE WHEN length(c) <= 240 THEN c ELSE left(c, 240) || '…' END"


@query(f"""WITH p AS (SELECT o, regexp_replace(regexp_replace(replace(title, '|', '／'), '[\\s\\x0b\\x{{a0}}\\x{{3000}}]+', ' ', 'g'), '^ | $', '', 'g') AS c, design, coalesce(level, '待定') AS level FROM ({_DESIGNED}) LEFT JOIN ({_LEVELS}) USING (design)),
 l AS (SELECT 1 AS part, lpad((100000000000 - count(*))::VARCHAR, 12, '0') || level AS s, '- ' || level || '：' || count(*) || ' 篇' AS line FROM p GROUP BY level UNION ALL SELECT DISTINCT 2, design, '| ' || design || ' | ' || level || ' |' FROM p
  UNION ALL SELECT 3, lpad(o::VARCHAR, 12, '0'), '- ' || {_CELL} || ' → ' || design || '：起始等级 ' || level FROM p)
 SELECT part, row_number() OVER (PARTITION BY part ORDER BY s, line) AS pos, md5(line) AS line FROM l""")
def grade_lines(spark, d):
    return _in_order(reports.grade_sheet(_designed(spark, d)))


@query("""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS section FROM documents)
 SELECT doc_id, section, 'Part ' || section AS title, len(regexp_extract_all(x, '[A-Za-z][A-Za-z''\\-]+|[一-鿿]')) AS words, length(x) AS chars FROM s WHERE x <> ''""")
def section_sheet(spark, d):
    parts = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text")).where("text <> ''")
    return reports.section_sheet(parts.withColumn("ord", F.col("ord").cast("long")).withColumn("title", F.concat(F.lit("Part "), F.col("ord").cast("string"))))


@query("""WITH e AS (SELECT user_id::VARCHAR AS scope, ts, event_id AS seq, CASE WHEN event_type IN ('click', 'view') THEN 'bug' WHEN event_type = 'signup' THEN 'question' ELSE 'other' END AS kind, trim(repeat(event_type || ' ', event_id % 900)) AS c FROM events WHERE event_id % 3 <> 0),
 k AS (SELECT * FROM e WHERE c <> '' QUALIFY row_number() OVER (PARTITION BY scope, ts::DATE ORDER BY ts DESC, seq DESC) <= 200)
 SELECT scope, kind, count(*) AS n, sum(length(left(c, 4000)))::BIGINT AS chars FROM k GROUP BY scope, kind""")
def feedback_kept(spark, d):
    kind = F.when(F.col("event_type").isin("click", "view"), "bug").when(F.col("event_type") == "signup", "question").otherwise(F.col("event_type"))
    e = t(spark, d, "events").where("event_id % 3 <> 0").select(F.col("user_id").cast("string").alias("scope"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"), F.expr("repeat(concat(event_type, ' '), cast(event_id % 900 as int))").alias("content"), F.lit(None).cast("string").alias("diagnostics"))
    return desk.feedback(e).groupBy("scope", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


@query("""WITH u AS (SELECT user_id::VARCHAR AS scope, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS count, count(*) FILTER (WHERE event_type = 'purchase' AND event_id % 9 = 0) AS prompts, coalesce(bool_or(event_type = 'error' AND event_id % 40 = 0), false) AS muted, coalesce(bool_or(event_type = 'signup' AND event_id % 60 = 0), false) AS survey_done FROM events GROUP BY user_id)
 SELECT *, NOT muted AND NOT survey_done AND prompts < 3 AND count >= 15 + 25 * prompts AS due FROM u""")
def usage_prompts(spark, d):
    action = F.when(F.col("event_type").isin("click", "view"), "use").when((F.col("event_type") == "purchase") & (F.col("event_id") % 9 == 0), "prompt").when((F.col("event_type") == "error") & (F.col("event_id") % 40 == 0), "mute").when((F.col("event_type") == "signup") & (F.col("event_id") % 60 == 0), "survey").otherwise("none")
    u = desk.usage(t(spark, d, "events").select(F.col("user_id").cast("string").alias("scope"), "ts", action.alias("action"))).drop("first_use", "last_use")
    return u.withColumn("due", telemetry.should_prompt(F.col("count"), F.col("prompts"), F.col("muted"), F.col("survey_done")))


_HOSTED = "CASE page_id % 6 WHEN 0 THEN 'https://eutils.ncbi.nlm.nih.gov/e?id=' || page_id WHEN 1 THEN 'http://EuropePMC.org/x' WHEN 2 THEN 'https://api.unpaywall.org/v2/' || page_id WHEN 3 THEN 'https://api.mymemory.translated.net' ELSE url END"


@query(f"""WITH h AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'pubmed' WHEN 1 THEN 'epmc' WHEN 2 THEN 'unpaywall' WHEN 3 THEN 'translate' ELSE 'llm' END AS dep, CASE page_id % 6 WHEN 0 THEN 0.1::DOUBLE WHEN 1 THEN 0.34 WHEN 2 THEN 1.0 WHEN 3 THEN 0.2 ELSE 0 END AS delay, {_HOSTED} AS url FROM pages)
 SELECT CASE WHEN page_id % 10 = 0 THEN 'figures' ELSE dep END AS dep, count(*) AS requests, round(sum(delay), 6) AS least_seconds, count(DISTINCT url) AS urls FROM h GROUP BY ALL""")
def host_requests(spark, d):
    h = t(spark, d, "pages").select("page_id", F.expr(_HOSTED).alias("url"))
    h = h.select(desk.dependency_of(F.col("url"), F.when(F.col("page_id") % 10 == 0, "figures")).alias("dep"), desk.host_delay(F.col("url"), keyed=True).alias("delay"), "url")
    return h.groupBy("dep").agg(F.count(F.lit(1)).alias("requests"), F.round(F.sum("delay"), 6).alias("least_seconds"), F.countDistinct("url").alias("urls"))


@query("""SELECT user_id::VARCHAR AS scope, event_id AS seq, event_type AS query, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events QUALIFY place <= 50""")
def search_history(spark, d):
    s = t(spark, d, "events").select(F.col("user_id").cast("string").alias("scope"), "ts", F.col("event_id").alias("seq"), F.col("event_type").alias("query"))
    return desk.history(s).select("scope", "seq", "query", F.col("place").cast("long").alias("place"))


@query(f"""WITH f AS ({S.FOLDERS_SQL}), c AS (SELECT 'n' || n_nationkey AS id, CASE n_nationkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'done' WHEN 2 THEN 'Same name' WHEN 3 THEN lower(n_name) ELSE 'New ' || n_nationkey END AS new FROM nation UNION ALL SELECT 'zz', 'Anything'),
 r AS (SELECT c.*, CASE WHEN new = '' THEN 'blank' WHEN NOT EXISTS (SELECT 1 FROM f WHERE f.id = c.id) THEN 'gone' WHEN EXISTS (SELECT 1 FROM f WHERE lower(f.name) = lower(c.new) AND f.id <> c.id) OR row_number() OVER (PARTITION BY lower(new) ORDER BY id) > 1 THEN 'taken' ELSE '' END AS reason FROM c)
 SELECT coalesce(f.id, r.id) AS id, CASE WHEN r.reason = '' THEN r.new ELSE f.name END AS name, coalesce(r.reason, '') AS reason FROM f FULL JOIN r USING (id)""")
def folder_renames(spark, d):
    new = F.when(F.col("n_nationkey") % 5 == 0, "").when(F.col("n_nationkey") % 5 == 1, "done").when(F.col("n_nationkey") % 5 == 2, "Same  name").when(F.col("n_nationkey") % 5 == 3, F.lower("n_name")).otherwise(F.concat(F.lit("New "), F.col("n_nationkey").cast("string")))
    changes = t(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), new.alias("name")).unionByName(S.frame(spark, [("zz", "Anything")], "id string, name string"))
    done, refused = library.rename_folders(S.folders(spark, d), changes)
    return done.join(refused, "id", "full_outer").select("id", "name", F.coalesce("reason", F.lit("")).alias("reason"))


@query("""WITH p AS (SELECT doc_id, doc_id % 70 + 1 AS page, list_transform(string_split(text, chr(10)), lambda l: list_transform(string_split(l, ','), lambda c: trim(regexp_replace(c, '[ \\t\\x{a0}\\x{3000}]+', ' ', 'g')))) AS rows FROM documents),
 c AS (SELECT doc_id, page, list_filter(rows, lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS rows FROM p WHERE page <= 60)
 SELECT doc_id, page, len(rows)::INT AS n, md5(array_to_string(list_transform(rows, lambda r: array_to_string(r, '|')), chr(10))) AS cells FROM c WHERE len(rows) >= 2 AND list_max(list_transform(rows, lambda r: len(r))) >= 2""")
def pdf_tables(spark, d):
    rows = F.transform(F.split("text", "\n"), lambda l: F.split(l, ","))  # noqa: E741
    got = desk.pdf_tables(t(spark, d, "documents").select("doc_id", (F.col("doc_id") % 70 + 1).alias("page"), F.lit(1).alias("index"), rows.alias("rows")))
    return got.select("doc_id", "page", F.size("rows").alias("n"), F.md5(F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n")).alias("cells"))


@query("""SELECT doc_id AS id, md5(trim(coalesce(text, ''))) AS content, CASE doc_id % 3 WHEN 0 THEN 'length' WHEN 1 THEN 'stop' ELSE '' END AS finish, doc_id % 3 = 0 AS cut FROM documents""")
def chat_replies(spark, d):
    reply = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content"), F.lit("thoughts").alias("reasoning_content")).alias("message"), F.when(F.col("doc_id") % 3 == 0, "length").when(F.col("doc_id") % 3 == 1, " stop ").alias("finish_reason"))).alias("choices")))
    return desk.chat_replies(t(spark, d, "documents").select(F.col("doc_id").alias("id"), reply.alias("json"))).withColumn("content", F.md5("content"))


@query("""SELECT p_name || ' ' || p_partkey AS term, 'P' || p_partkey AS ui, p_brand AS heading, CASE WHEN p_partkey % 3 = 0 THEN 'descriptor' ELSE 'qualifier' END AS type, array_to_string([p_brand, p_type], ';') AS entry_terms, CASE WHEN p_partkey % 2 = 0 THEN 'C' || p_size ELSE '' END AS trees FROM part WHERE p_partkey % 7 <> 0""")
def vocabulary_candidates(spark, d):
    rec = t(spark, d, "part").selectExpr("concat(p_name, ' ', p_partkey) as term", "1 as ord", "concat('P', p_partkey) as ui", "if(p_partkey % 7 = 0, array(' ', null), array(' ', concat(' ', p_brand), p_type)) as terms", "if(p_partkey % 3 = 0, ' ', 'qualifier') as type", "null as mapped_to", "'note' as scope_note", "array('@12', if(p_partkey % 2 = 0, concat('C', p_size), null), '') as trees")
    got = desk.candidates(rec.withColumn("mapped_to", F.col("mapped_to").cast("string")))
    return got.select("term", "ui", "heading", "type", F.array_join("entry_terms", ";").alias("entry_terms"), F.array_join("tree_numbers", ";").alias("trees"))


# --- a draft's facts and counts

@query(f"""SELECT row_key AS at, md5('- 佚名 等（' || coalesce(nullif(trim(year), ''), '年份不详') || '，' || design || '，样本量 ' || coalesce(n::VARCHAR, '未抽取') || '，效应量 ' || coalesce(nullif(trim(effects_text), ''), '未报告') || '）：' || coalesce(nullif(trim(conclusion), ''), '摘要未写明结论')) AS line FROM ({S.ROWS_SQL})""")
def draft_facts(spark, d):
    rows = S.rows(spark, d).withColumn("authors", F.array().cast("array<string>"))
    return draft.facts(rows, order="row_key").withColumn("line", F.md5("line"))


_SPREAD = lambda c: f"(SELECT string_agg(k || ' ' || n || ' 篇', '、' ORDER BY n DESC, k) FROM (SELECT {c} AS k, count(*) AS n FROM r WHERE coalesce({c}, '') <> '' GROUP BY {c}))"


@query(f"""WITH r AS ({S.ROWS_SQL}) SELECT count(*) AS total, min(TRY_CAST(left(year, 4) AS INT)) AS year_from, max(TRY_CAST(left(year, 4) AS INT)) AS year_to, coalesce(sum(n), 0)::BIGINT AS n_total, count(*) FILTER (WHERE n IS NULL) AS n_missing, count(*) FILTER (WHERE coalesce(pmcid, '') <> '') AS with_fulltext,
 count(*) FILTER (WHERE trim(coalesce(effects_text, '')) <> '') AS effects, count(*) FILTER (WHERE trim(coalesce(effects_text, '')) <> '' AND direction < 0) AS down, count(*) FILTER (WHERE trim(coalesce(effects_text, '')) <> '' AND direction > 0) AS up,
 {_SPREAD('polarity')} AS polarity_text, {_SPREAD('design')} AS design_text, {_SPREAD('cebm')} AS cebm_text FROM r""")
def draft_totals(spark, d):
    return draft.totals(S.rows(spark, d)).drop("polarity_top", "design_top", "cebm_top")


@query("""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)
 SELECT doc_id, sum(len(regexp_extract_all(x, '[A-Za-z][A-Za-z''\\-]+|[一-鿿]')))::BIGINT AS words, sum(length(x))::BIGINT AS chars, count(*) AS sections FROM s WHERE x <> '' GROUP BY doc_id""")
def fulltext_totals(spark, d):
    parts = t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text")).where("text <> ''")
    return keywords.fulltext_totals(parts.withColumn("title", F.lit("Part")))


# --- chains of sources, links, lists and libraries

@query("""SELECT doc_id::VARCHAR AS key, CASE WHEN doc_id % 3 = 0 AND text IS NOT NULL THEN 'cache' WHEN doc_id % 2 = 0 THEN 'archive' ELSE 'page' END AS source, md5(CASE WHEN doc_id % 3 = 0 AND text IS NOT NULL THEN text WHEN doc_id % 2 = 0 THEN 'archive ' || doc_id ELSE 'page ' || doc_id END) AS value FROM documents""")
def fulltext_sources(spark, d):
    docs = t(spark, d, "documents").withColumn("key", F.col("doc_id").cast("string"))
    cache = docs.where("doc_id % 3 = 0").select("key", F.col("text").alias("value"))
    archive = docs.where("doc_id % 2 = 0").select("key", F.concat(F.lit("archive "), "key").alias("value"))
    page = docs.select("key", F.concat(F.lit("page "), "key").alias("value"))
    return readers.first_of(("cache", cache), ("archive", archive), ("page", page)).withColumn("value", F.md5("value"))


@query(f"""SELECT ord, concat_ws(' ', CASE WHEN coalesce(pmcid, '') <> '' THEN 'https://www.ncbi.nlm.nih.gov/pmc/articles/' || pmcid || '/pdf/' END, CASE WHEN coalesce(doi, '') <> '' THEN 'https://doi.org/' || doi END, nullif(url, '')) AS links FROM ({S.ARTICLES_SQL})""")
def article_links(spark, d):
    return S.articles(spark, d).select("ord", F.array_join(readers.pdf_links(F.col("pmcid"), F.col("doi"), F.col("url")), " ").alias("links"))


_JNAME = lambda c: f"lower(regexp_replace(replace(regexp_replace(trim(regexp_replace(trim({c}), '\\.+$', '')), '^[Tt][Hh][Ee]\\s+', ''), '&', 'and'), '\\s+', ' ', 'g'))"
_CATALOGUE = """SELECT 'The ' || p_name || ' & ' || p_partkey || '.' AS query, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' and ' || p_partkey ELSE 'Other' END AS title, CASE WHEN p_partkey % 5 <> 0 THEN 'A' || p_partkey END AS abbreviation, 1 AS ord FROM part
 UNION ALL SELECT 'the  ' || p_name || ' and ' || p_partkey, 'Second', 'B' || p_partkey, 0 FROM part WHERE p_partkey % 3 = 0"""


@query(f"""WITH c AS (SELECT *, {_JNAME('query')} AS k, {_JNAME('title')} = {_JNAME('query')} AS exact FROM ({_CATALOGUE}) WHERE trim(coalesce(abbreviation, '')) <> ''), b AS (SELECT k, abbreviation FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY NOT exact, ord, abbreviation) = 1),
 n AS (SELECT p_name || ' & ' || p_partkey AS name FROM part) SELECT name, coalesce(abbreviation, name) AS resolved FROM n LEFT JOIN b ON b.k = {_JNAME('name')}""")
def journals_resolved(spark, d):
    p = t(spark, d, "part")
    one = p.selectExpr("concat('The ', p_name, ' & ', p_partkey, '.') as query", "if(p_partkey % 2 = 0, concat(p_name, ' and ', p_partkey), 'Other') as title", "if(p_partkey % 5 <> 0, concat('A', p_partkey), null) as abbreviation", "1 as ord")
    two = p.where("p_partkey % 3 = 0").selectExpr("concat('the  ', p_name, ' and ', p_partkey) as query", "'Second' as title", "concat('B', p_partkey) as abbreviation", "0 as ord")
    return vocab.resolve_journals(p.selectExpr("concat(p_name, ' & ', p_partkey) as name"), one.unionByName(two))


_MD = lambda c: f"(SELECT CASE WHEN length(x) <= 240 THEN x ELSE left(x, 240) || '…' END FROM (SELECT regexp_replace(regexp_replace(replace(coalesce({c}::VARCHAR, ''), '|', '／'), '[\\s\\x0b\\x{{a0}}\\x{{3000}}]+', ' ', 'g'), '^ | $', '', 'g') AS x))"


@query(f"""SELECT doc_id AS ord, md5('| ' || {_MD('doc_id')} || ' | ' || {_MD('source')} || ' | ' || {_MD('text')} || ' |') AS line FROM documents""")
def markdown_rows(spark, d):
    return sinks.markdown(t(spark, d, "documents").select("doc_id", "source", "text"), "doc_id").withColumn("line", F.md5("line"))


@query(f"""SELECT ord, md5(concat_ws('. ', nullif(array_to_string(coalesce(authors, [])[1:6], ', ') || CASE WHEN len(coalesce(authors, [])) > 6 THEN ', et al' ELSE '' END, ''), nullif(title, ''), nullif(journal, ''), nullif(year, ''), CASE WHEN coalesce(pmid, '') <> '' THEN 'PMID: ' || pmid END, CASE WHEN coalesce(doi, '') <> '' THEN 'doi:' || doi END)) AS line FROM ({S.ARTICLES_SQL})""")
def reference_lines(spark, d):
    return reports.references(S.articles(spark, d)).withColumn("line", F.md5("line"))


@query(f"""WITH a AS (SELECT c_custkey AS k, (c_custkey + 1000)::VARCHAR AS pmid, c_name AS title FROM customer), m AS (SELECT * FROM ({S.META_SQL})), f AS (SELECT * FROM ({S.FOLDERS_SQL}))
 SELECT a.pmid, concat_ws(' · ', '- ' || a.title, nullif(f.name, ''), nullif(array_to_string(list_transform(coalesce(m.tags, []), lambda x: '#' || x), ' '), ''), nullif(trim(m.note), '')) AS line FROM a LEFT JOIN m USING (pmid) LEFT JOIN f ON f.id = m.folder""")
def library_lines(spark, d):
    a = t(spark, d, "customer").selectExpr("cast(c_custkey + 1000 as string) as pmid", "c_name as title")
    return reports.library(a, S.meta(spark, d), S.folders(spark, d))


@query(f"""WITH m AS ({S.META_SQL}) SELECT pmid, array_to_string(list_filter(list_transform(tags, lambda x: CASE WHEN lower(x) = 'rct' THEN 'Trial' ELSE x END), lambda x, i: x <> '' AND list_position(list_transform(tags, lambda y: CASE WHEN lower(y) = 'rct' THEN 'trial' ELSE lower(y) END), CASE WHEN lower(tags[i]) = 'rct' THEN 'trial' ELSE lower(tags[i]) END) = i), ';') AS tags FROM m""")
def tags_renamed(spark, d):
    return library.rename_tag(S.meta(spark, d), "rct", "Trial").select("pmid", F.array_join("tags", ";").alias("tags"))


@query(f"""WITH f AS ({S.FOLDERS_SQL}), n AS (SELECT id, left(regexp_replace(trim(name), '\\s+', ' ', 'g'), 40) AS name, created_at FROM ({S.IN_FOLDERS_SQL})), o AS (SELECT * FROM n WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY created_at, id) = 1)
 SELECT id, name FROM f UNION ALL SELECT id, name FROM o WHERE lower(name) NOT IN (SELECT lower(name) FROM f)""")
def folders_added(spark, d):
    return library.add_folders(S.folders(spark, d), S.in_folders(spark, d)).select("id", "name")


@query("""WITH d AS (SELECT doc_id, (doc_id % 400)::VARCHAR AS pmid, source FROM documents), f AS (SELECT pmid, min(source) AS source FROM d WHERE doc_id % 7 = 0 GROUP BY pmid)
 SELECT pmid, count(*) AS n FROM (SELECT pmid FROM f UNION ALL SELECT DISTINCT pmid FROM d WHERE pmid NOT IN (SELECT pmid FROM f)) GROUP BY pmid""")
def favourites_added(spark, d):
    docs = t(spark, d, "documents").select("doc_id", (F.col("doc_id") % 400).cast("string").alias("pmid"), "source", F.array("text").alias("fulltext_sections"))
    own = docs.where("doc_id % 7 = 0").groupBy("pmid").agg(F.min("source").alias("source"))
    got = library.add_favourites(own, docs.drop("doc_id"))
    return got.groupBy("pmid").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT user_id % 50 AS k, event_type AS kind, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY ALL), o AS (SELECT user_id % 50 AS k, event_type AS kind, count(*) AS n FROM events WHERE event_id % 11 = 0 GROUP BY ALL)
 SELECT * FROM o UNION ALL SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k = s.k AND o.kind = s.kind)""")
def promoted(spark, d):
    part = lambda m: t(spark, d, "events").where(f"event_id % {m} = 0").groupBy((F.col("user_id") % 50).alias("k"), F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return library.promote(part(11), part(2), ["k", "kind"])


@query("""WITH u AS (SELECT ts::DATE AS day, event_type AS channel, count(*) AS n FROM events WHERE event_id % 3 = 0 GROUP BY ALL) SELECT * FROM u WHERE day IN (SELECT DISTINCT day FROM u ORDER BY day DESC LIMIT 12)""")
def counter_days_kept(spark, d):
    daily = t(spark, d, "events").where("event_id % 3 = 0").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("channel")).agg(F.count(F.lit(1)).alias("n"))
    return funnel.last_days(daily, 12)


_TOOLKITS = S.values([(x[0], x[5]) for x in L.DESIGN_DIM], "design string, tool string")


@query(f"""SELECT tool, count(*) AS n FROM ({_DESIGNED}) LEFT JOIN ({_TOOLKITS}) USING (design) GROUP BY tool""")
def appraisal_tools(spark, d):
    return services.appraisal_overview(_designed(spark, d))


@query(f"""SELECT coalesce(level, '待定') AS level, count(*) AS n FROM ({_DESIGNED}) LEFT JOIN ({_LEVELS}) USING (design) GROUP BY ALL""")
def grade_levels(spark, d):
    return services.grade_overview(_designed(spark, d))


@query("""WITH x AS (SELECT doc_id AS id, string_split('before ' || chr(10) || '## ' || replace(coalesce(text, ''), chr(10), chr(10) || '## '), chr(10) || '## ') AS p FROM documents), u AS (SELECT id, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS ord FROM x),
 h AS (SELECT id, ord, CASE WHEN ord = 0 THEN '' ELSE trim(part) END AS heading, CASE WHEN ord = 0 THEN trim(part) ELSE '' END AS body FROM u)
 SELECT id, ord::INT AS ord, md5(regexp_replace(heading, '^\\s+|\\s+$', '', 'g')) AS heading, body FROM h WHERE heading <> '' OR body <> ''""")
def narrative_parts(spark, d):
    text = F.concat(F.lit("before \n## "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n## ")))
    got = services.split_narrative(t(spark, d, "documents").select(F.col("doc_id").alias("id"), text.alias("text")))
    return got.select("id", F.col("ord").cast("int").alias("ord"), F.md5(F.regexp_replace("heading", r"^\s+|\s+$", "")).alias("heading"), "body")


# --- text helpers, and files that are written and read back

_NUMBERED = "CASE doc_id % 6 WHEN 0 THEN doc_id || '. ' WHEN 1 THEN (doc_id % 9) || '.' || (doc_id % 4) || ' ' WHEN 2 THEN 'IV. ' WHEN 3 THEN 'Section ' || (doc_id % 30) || ': ' ELSE '' END"
_NAMED_SECTION = "CASE doc_id % 5 WHEN 0 THEN 'Results' WHEN 1 THEN 'Methods.' WHEN 2 THEN 'Materials and  Methods:' WHEN 3 THEN 'Conflict of Interest' ELSE coalesce(source, '') END"
_PREFIX_SQL = r"(?i)^(?:\d+(?:\.\d+)*\s*[.、)]?\s*|[ivxlcdm]+\s*[.、)]\s*|section\s+\d+\s*[:.、)]?\s*)+"
_ZH = S.values(list(L.SECTION_TITLES_ZH.items()), "low string, zh string")


def _titled(spark, d):
    number = "case doc_id % 6 when 0 then concat(doc_id, '. ') when 1 then concat(doc_id % 9, '.', doc_id % 4, ' ') when 2 then 'IV. ' when 3 then concat('Section ', doc_id % 30, ': ') else '' end"
    name = "case doc_id % 5 when 0 then 'Results' when 1 then 'Methods.' when 2 then 'Materials and  Methods:' when 3 then 'Conflict of Interest' else coalesce(source, '') end"
    return t(spark, d, "documents").selectExpr("doc_id", f"concat({number}, {name}) as title")


@query(f"""WITH x AS (SELECT doc_id, {_NUMBERED} || {_NAMED_SECTION} AS title FROM documents), y AS (SELECT *, regexp_replace(trim(regexp_replace(title, '\\s+', ' ', 'g')), '[.:]+$', '') AS s FROM x), z AS (SELECT *, trim(regexp_replace(s, '{_PREFIX_SQL}', '')) AS bare FROM y)
 SELECT doc_id, CASE WHEN bare = '' THEN s ELSE bare END AS plain, coalesce(zh, title) AS zh, {' OR '.join(f"contains(lower(title), '{w}')" for w in L.BOILERPLATE)} AS boilerplate FROM z LEFT JOIN ({_ZH}) ON low = lower(bare)""")
def section_titles(spark, d):
    return _titled(spark, d).select("doc_id", X.plain_title(F.col("title")).alias("plain"), X.zh_title(F.col("title")).alias("zh"), X.is_boilerplate(F.col("title")).alias("boilerplate"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'certificate' WHEN 1 THEN 'unreachable' WHEN 2 THEN 'timeout' ELSE event_type || ' ' || event_id END AS error FROM events""")
def friendly_errors(spark, d):
    msg = "case event_id % 5 when 0 then concat(event_type, ' CERTIFICATE_VERIFY_FAILED x') when 1 then 'HTTPS: Max retries exceeded' when 2 then if(event_id % 2 = 0, 'ReadTimeout', 'it Timed Out') else concat(event_type, ' ', event_id) end"
    return t(spark, d, "events").select("event_id", X.friendly_error(F.expr(msg)).alias("error"))


@query("""SELECT doc_id, md5(trim(CASE WHEN doc_id % 4 = 3 THEN '此外研究，' || coalesce(text, '') ELSE coalesce(text, '') END)) AS lead FROM documents""")
def leads_cleaned(spark, d):
    lead = F.when(F.col("doc_id") % 4 == 0, "此外，然而: ").when(F.col("doc_id") % 4 == 1, "值得注意的是：").when(F.col("doc_id") % 4 == 3, "此外研究，").otherwise("")
    return t(spark, d, "documents").select("doc_id", F.md5(X.clean_lead(F.concat(lead, F.trim(F.coalesce("text", F.lit("")))))).alias("lead"))


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"""WITH s AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, {sents('text')} AS l FROM documents))
 SELECT doc_id, pos::INT AS pos, md5(regexp_replace({_ESC.format('s')}, '((?:the|withe|with)+)', '<span class="loc-kw">\\1</span>', 'gi')) AS html FROM s""")
def highlighted_words(spark, d):
    return locate.index(t(spark, d, "documents")).select("doc_id", "pos", F.md5(locate.highlight_query(F.col("sentence"), "the With")).alias("html"))


@query("""SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment, '' AS gone FROM customer""")
def csv_read_back(spark, d):
    path = f"{staging.folder(spark)}/csv-{uuid.uuid4().hex[:12]}"
    sinks.csv(t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), path)
    return readers.funnel_csv(spark, path, ["c_custkey", "c_name", "c_mktsegment", "gone"])


@query("""SELECT event_id, event_type, CASE WHEN event_id % 4 <> 0 THEN user_id END AS user_id FROM events WHERE event_id % 10 <> 0""")
def json_read_back(spark, d):
    path = f"{staging.folder(spark)}/json-{uuid.uuid4().hex[:12]}"
    row = F.to_json(F.struct("event_id", "event_type", F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("user_id")))
    t(spark, d, "events").select(F.when(F.col("event_id") % 10 == 0, F.concat(F.lit('{"event_id": '), "event_type")).otherwise(row).alias("value")).write.text(path)
    return readers.tolerant_json(spark, path, "event_id long, event_type string, user_id long").where("event_id is not null")


@query(f"""WITH r AS ({S.ROWS_SQL}) SELECT title, left(year, 4) AS year FROM r WHERE coalesce(design, '未识别') = '未识别'""")
def designs_unrecognised(spark, d):
    return compare.unrecognised(S.rows(spark, d)).select("title", "year")


@query(f"""WITH a AS ({S.ARTICLES_SQL}), k AS (SELECT *, CASE WHEN ord % 3 = 0 THEN 0 WHEN ord % 3 = 1 THEN 1 ELSE 2 END AS src, trim(coalesce(pmid, '')) AS p FROM a WHERE trim(coalesce(pmid, '')) <> '')
 SELECT ord, src AS source_rank FROM k QUALIFY row_number() OVER (PARTITION BY p ORDER BY src, ord) = 1""")
def article_pool(spark, d):
    a = S.articles(spark, d).where("trim(coalesce(pmid, '')) <> ''")
    return compare.pool([a.where(f"ord % 3 = {i}") for i in range(3)]).select("ord", "source_rank")


# --- cells, fills, designs, tags, labelled texts

@query("""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN ' ' WHEN doc_id % 4 = 1 THEN NULL ELSE ' ' || source || ' ' END AS v, CASE doc_id % 3 WHEN 0 THEN 'not_mentioned' WHEN 1 THEN 'not_extracted' ELSE 'no_abstract' END AS state, doc_id % 5 = 0 AS corrected, doc_id % 7 = 0 AS filled, doc_id % 2 = 0 AS whole FROM documents)
 SELECT doc_id, CASE WHEN trim(coalesce(v, '')) <> '' THEN trim(v) || CASE WHEN corrected THEN ' ✎' WHEN filled THEN ' ⧉' ELSE '' END WHEN state = 'not_mentioned' THEN CASE WHEN whole THEN '原文' ELSE '摘要' END || '未提及' WHEN state = 'not_extracted' THEN CASE WHEN whole THEN '有原文' ELSE '有摘要' END || '未抽到' ELSE '无摘要' END AS cell FROM x""")
def cells_annotated(spark, d):
    c = F.col("doc_id")
    value = F.when(c % 4 == 0, " ").when(c % 4 == 1, None).otherwise(F.concat(F.lit(" "), "source", F.lit(" ")))
    state = F.when(c % 3 == 0, "not_mentioned").when(c % 3 == 1, "not_extracted").otherwise("no_abstract")
    return t(spark, d, "documents").select("doc_id", compare.annotate(value, state, c % 5 == 0, c % 7 == 0, c % 2 == 0).alias("cell"))


@query("""WITH x AS (SELECT doc_id, 'd' || doc_id AS row_key FROM documents WHERE doc_id % 2 = 0)
 SELECT row_key, '人群' AS field, 'adults ' || doc_id AS value, 'quote "q" ' || doc_id AS quote FROM x UNION ALL SELECT row_key, '结论', 'better', 'it was better' FROM x WHERE doc_id % 3 <> 0""")
def fills_parsed(spark, d):
    docs = t(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").cast("int").alias("id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("row_key"))
    one = lambda v, q: F.struct(v.alias("value"), q.alias("quote"))
    key = F.col("id").cast("string")
    fill = F.struct(F.col("id"), one(F.concat(F.lit(" adults "), key), F.concat(F.lit('quote "q" '), key)).alias("人群"), one(F.lit("better"), F.when(F.col("id") % 3 != 0, "it was better")).alias("结论"), one(F.lit("x"), F.lit("never asked")).alias("样本量"))
    replies = docs.select(F.concat(F.lit("Here: "), F.to_json(F.struct(F.array(fill).alias("fills"))), F.lit(" done")).alias("text"))
    return compare.parse_fills(replies, docs.withColumn("fields", F.array(F.lit("人群"), F.lit("结论"))))


@query(f"""SELECT design, count(*) AS n, md5(string_agg(coalesce(authors[1], '佚名') || ' 等（' || coalesce(nullif(year, ''), '年份不详') || '）', '、' ORDER BY ord)) AS cites FROM (SELECT ord, authors, year, CASE ord % 4 WHEN 0 THEN '队列研究' WHEN 1 THEN '随机对照试验' ELSE '未识别' END AS design FROM ({S.ARTICLES_SQL})) GROUP BY design""")
def studies_by_design(spark, d):
    a = S.articles(spark, d).withColumn("design", F.when(F.col("ord") % 4 == 0, "队列研究").when(F.col("ord") % 4 == 1, "随机对照试验").otherwise("未识别"))
    return compare.by_design(a).withColumn("cites", F.md5("cites"))


_CI = lambda a: f"list_filter({a}, lambda x, i: list_position(list_transform({a}, lambda y: lower(y)), lower(x)) = i)"


@query(f"""WITH m AS ({S.META_SQL}) SELECT pmid, array_to_string({_CI("(tags || ['Heart', 'RCT', 'new'])")}[1:30], ';') AS added, array_to_string(list_filter(tags, lambda x: lower(x) NOT IN ('rct', 'furniture')), ';') AS removed FROM m""")
def tags_changed(spark, d):
    lits = lambda *x: F.array(*map(F.lit, x))
    return S.meta(spark, d).select("pmid", F.array_join(library.add_tags(F.col("tags"), lits("Heart", "RCT", "new")), ";").alias("added"), F.array_join(library.remove_tags(F.col("tags"), lits("rct", "Furniture")), ";").alias("removed"))


@query(f"""WITH m AS ({S.META_SQL}), c AS (SELECT (c_custkey + 900)::VARCHAR AS pmid, CASE WHEN c_custkey % 2 = 0 THEN 'f2' END AS folder, CASE WHEN c_custkey % 3 = 0 THEN ['up'] END AS tags, CASE WHEN c_custkey % 5 = 0 THEN '' END AS note FROM customer)
 SELECT coalesce(m.pmid, c.pmid) AS pmid, coalesce(c.folder, m.folder, '') AS folder, array_to_string(coalesce(c.tags, m.tags, []), ';') AS tags, coalesce(c.note, m.note, '') AS note FROM m FULL JOIN c ON m.pmid = c.pmid""")
def library_upserted(spark, d):
    c = t(spark, d, "customer").selectExpr("cast(c_custkey + 900 as string) as pmid", "if(c_custkey % 2 = 0, 'f2', null) as folder", "if(c_custkey % 3 = 0, array('up'), null) as tags", "if(c_custkey % 5 = 0, '', null) as note")
    return library.upsert(S.meta(spark, d), c).select("pmid", "folder", F.array_join("tags", ";").alias("tags"), "note")


_PLAIN_WORDS = "regexp_replace(coalesce(text, ''), '[^A-Za-z]+', ' ', 'g')"


@query(f"""WITH x AS (SELECT doc_id, trim({_PLAIN_WORDS}) AS w FROM documents), p AS (SELECT doc_id, 'we began ' || trim(w[1:60]) || '.' AS b, 'we did ' || trim(w[61:200]) || '.' AS m, 'we found ' || trim(w[201:]) || '.' AS r FROM x)
 SELECT doc_id, md5(b) AS background, md5(m) AS methods, md5(r) AS results, CASE WHEN doc_id % 2 = 0 THEN md5('it works.') END AS conclusions FROM p""")
def labelled_sections(spark, d):
    w = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "))
    docs = t(spark, d, "documents").select("doc_id", w.alias("w"))
    part = lambda lead, a, n: F.concat(F.lit(lead), F.trim(F.substring(F.col("w"), F.lit(a), n)), F.lit("."))
    end = F.when(F.col("doc_id") % 2 == 0, " CONCLUSIONS: it works.").otherwise("")
    text = F.concat(F.lit("BACKGROUND: "), part("we began ", 1, F.lit(60)), F.lit(" METHODS: "), part("we did ", 61, F.lit(140)), F.lit(" RESULTS: "), part("we found ", 201, F.length("w")), end)
    a = extract.with_sections(docs.select("doc_id", F.col("doc_id").cast("string").alias("pmid"), F.lit("").alias("title"), text.alias("abstract")))
    return a.select("doc_id", *[F.md5(f"sec.{k}").alias(k.lower()) for k in ("BACKGROUND", "METHODS", "RESULTS", "CONCLUSIONS")])


# --- keywords, tags, keys, figures, reports and sums

_SPACED = lambda c: f"trim(regexp_replace({c}, '[\\s\\x0b\\x{{a0}}\\x{{3000}}]+', ' ', 'g'))"
_KEYWORD = "CASE doc_id % 6 WHEN 0 THEN source || '[tiab]' WHEN 1 THEN '\"' || source || '\"' WHEN 2 THEN source || ' AND ' || lang WHEN 3 THEN '  ' WHEN 4 THEN left(coalesce(text, ''), 50) ELSE 'Band of ' || lang END"


@query(f"""WITH k AS (SELECT doc_id, {_KEYWORD} AS k FROM documents) SELECT doc_id, regexp_replace(lower(k), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') AS key, trim(k) <> '' AND NOT regexp_matches(trim(k), '(?i)\\[[a-z0-9 /_-]{{2,30}}\\]') AND NOT regexp_matches(trim(k), '(?i)(?:^|\\s)(?:AND|OR|NOT)(?:\\s|$)') AND NOT regexp_matches(trim(k), '["“”]') AS plain,
 {_SPACED("regexp_replace(regexp_replace(regexp_replace(regexp_replace(k, '\\[[^\\]]*\\]', ' ', 'g'), '[\"“”]', ' ', 'g'), '\\b(?:AND|OR|NOT)\\b', ' ', 'g'), '[(),;，；（）]+', ' ', 'g')")} AS topic FROM k""")
def keywords_told_apart(spark, d):
    k = F.expr("case doc_id % 6 when 0 then concat(source, '[tiab]') when 1 then concat('\"', source, '\"') when 2 then concat(source, ' AND ', lang) when 3 then '  ' when 4 then left(coalesce(text, ''), 50) else concat('Band of ', lang) end")
    return t(spark, d, "documents").select("doc_id", vocab.key(k).alias("key"), vocab.is_plain(k).alias("plain"), vocab.clean_topic(k).alias("topic"))


_TAG_TEXT = "'#' || source || ', ' || upper(coalesce(lang, '')) || '；' || coalesce(lang, '') || '|' || left(regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g'), 60) || ',,x  y'"


@query(f"""WITH p AS (SELECT doc_id, regexp_split_to_array({_TAG_TEXT}, '[,，;；、|\\n\\r\\t]+') AS p FROM documents),
 n AS (SELECT doc_id, list_filter(list_transform(p, lambda x: trim(left(regexp_replace({_SPACED('x')}, '^[#＃,，;；、|/-]+|[#＃,，;；、|/-]+$', '', 'g'), 24))), lambda x: x <> '') AS t FROM p)
 SELECT doc_id, array_to_string({_CI('t')}[1:30], ';') AS tags FROM n""")
def tags_parsed(spark, d):
    text = F.concat(F.lit("#"), "source", F.lit(", "), F.upper(F.coalesce("lang", F.lit(""))), F.lit("；"), F.coalesce("lang", F.lit("")), F.lit("|"), F.left(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", ""), F.lit(60)), F.lit(",,x  y"))
    return t(spark, d, "documents").select("doc_id", F.array_join(X.parse_tags(text), ";").alias("tags"))


@query(f"""SELECT ord, coalesce(nullif(trim(pmid), ''), left(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9一-鿿]', '', 'g'), 60)) AS key, CASE WHEN length(s) <= 160 THEN s ELSE rtrim(left(s, 160)) || '…' END AS snippet FROM (SELECT *, {_SPACED("coalesce(abstract, '')")} AS s FROM ({S.ARTICLES_SQL}))""")
def article_snippets(spark, d):
    return S.articles(spark, d).select("ord", extract.article_key().alias("key"), X.snippet(F.col("abstract")).alias("snippet"))


@query("""WITH f AS (SELECT doc_id, 'F1' AS fig, 'fig-' || doc_id || '.jpg' AS href FROM documents UNION ALL SELECT doc_id, 'F2', 'Plate ' || source || '.gif' FROM documents),
 g AS (SELECT doc_id, 'FIG_' || doc_id || '.png' AS file FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'x-plate-' || source || '-y.jpg' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'fig-' || doc_id || '.tif' FROM documents WHERE doc_id % 5 = 0),
 a AS (SELECT *, regexp_replace(lower(regexp_replace(href, '\\.[A-Za-z0-9]{2,5}$', '')), '[^a-z0-9]', '', 'g') AS a FROM f), b AS (SELECT *, regexp_replace(lower(regexp_replace(file, '\\.[A-Za-z0-9]{2,5}$', '')), '[^a-z0-9]', '', 'g') AS b FROM g),
 m AS (SELECT a.doc_id, fig, file, CASE WHEN a = b AND regexp_replace(href, '\\.[A-Za-z0-9]{2,5}$', '') = regexp_replace(file, '\\.[A-Za-z0-9]{2,5}$', '') THEN 0 WHEN a = b THEN 1 ELSE 2 END AS tier FROM a JOIN b ON a.doc_id = b.doc_id AND (a = b OR (length(a) >= 4 AND length(b) >= 4 AND (contains(a, b) OR contains(b, a)))))
 SELECT doc_id, fig, file FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, fig ORDER BY tier, file) = 1""")
def figures_matched(spark, d):
    docs = t(spark, d, "documents")
    f = docs.selectExpr("doc_id", "'F1' as fig", "concat('fig-', doc_id, '.jpg') as href").unionByName(docs.selectExpr("doc_id", "'F2' as fig", "concat('Plate ', source, '.gif') as href"))
    g = docs.where("doc_id % 2 = 0").selectExpr("doc_id", "concat('FIG_', doc_id, '.png') as file").unionByName(docs.where("doc_id % 3 = 0").selectExpr("doc_id", "concat('x-plate-', source, '-y.jpg') as file"))
    return readers.match_figures(f, g.unionByName(docs.where("doc_id % 5 = 0").selectExpr("doc_id", "concat('fig-', doc_id, '.tif') as file")))


@query(f"""WITH p AS (SELECT coalesce(total_hits, 0) AS a, coalesce(retrieved, 0) AS b, coalesce(duplicates, 0) AS c, greatest(coalesce(retrieved, 0) - coalesce(duplicates, 0), 0) AS e, coalesce(excluded_screening, 0) AS f, coalesce(excluded_fulltext, 0) AS h FROM ({S.PRISMA_SQL})),
 q AS (SELECT *, greatest(e - f, 0) AS g, greatest(greatest(e - f, 0) - h, 0) AS i FROM p), l AS (SELECT unnest([(0, '- 识别: ' || a), (1, '- 获取: ' || b), (2, '- 去重: ' || c), (3, '- 筛选: ' || e), (4, '- 筛除: ' || f), (5, '- 全文评估: ' || g), (6, '- 全文排除: ' || h), (7, '- 纳入: ' || i)]) AS x FROM q)
 SELECT x[1]::INT AS pos, x[2] AS line, count(*) AS n FROM l GROUP BY ALL""")
def screening_lines(spark, d):
    return reports.prisma(compare.prisma(S.prisma(spark, d))).groupBy("pos", "line").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {catalogue._ADMITTED} SELECT w.scope, w.kind, sum(o.amount)::BIGINT AS used FROM w JOIN o ON o.kind = w.kind AND o.n = w.n WHERE w.admitted GROUP BY ALL")
def quota_used(spark, d):
    return services.usage(telemetry.quota_admission(catalogue._asked(spark, d), catalogue._LIMITS))[0]


# --- effects as text, conclusions, sentences with places

_RATIO = {k: p.replace("'", "''") for k, p in extract.RATIOS.items()}
_DISTINCT = lambda p: f"list_filter(regexp_extract_all(a, '{p}', 1), lambda x, i: list_position(regexp_extract_all(a, '{p}', 1), x) = i)"
_ANY_RATIO = "(?i)" + "|".join(p.replace("(?i)", "") for p in extract.RATIOS.values()).replace("'", "''")


@query(f"""WITH x AS (SELECT ord, coalesce(abstract, '') AS a FROM ({S.ARTICLES_SQL})), r AS (SELECT ord, a, {', '.join(f'{_DISTINCT(p)} AS "{k}"' for k, p in _RATIO.items())}, regexp_extract_all(a, '{extract.DIFFERENCE}')[1:4] AS "MD",
  list_filter(list_transform(regexp_extract_all(a, '{extract.INTERVAL}', 1), lambda c: regexp_replace(c, '^[ ,;，；]+|[ ,;，；]+$', '', 'g'))[1:6], lambda c: c <> '') AS ci, regexp_extract_all(a, '{extract.P_VALUE}')[1:6] AS p FROM x),
 f AS (SELECT ord, concat_ws('；', {', '.join(f'''CASE WHEN len("{k}") > 0 THEN '{k} ' || array_to_string("{k}"[1:2], '/') END''' for k in ('HR', 'OR', 'RR', 'IRR', 'MD'))}, '95% CI ' || ci[1], replace(p[1], ' ', '')) AS text, TRY_CAST(("HR" || "OR" || "RR" || "IRR")[1] AS DOUBLE) AS first,
  list_filter({sents('a')}, lambda s: regexp_matches(s, '{_ANY_RATIO}'))[1] AS s FROM r)
 SELECT ord, text, CASE WHEN first IS NULL OR abs(first - 1) < 1e-9 THEN 0 WHEN first < 1 THEN -1 ELSE 1 END AS direction, CASE WHEN s IS NULL THEN '' WHEN length(s) <= 220 THEN s ELSE rtrim(left(s, 220)) || '…' END AS snippet FROM f""")
def effect_texts(spark, d):
    e = S.articles(spark, d).select("ord", "abstract", extract.effects(F.col("abstract")).alias("e"))
    return e.select("ord", extract.effect_text(F.col("e")).alias("text"), extract.effect_direction(F.col("e")).alias("direction"), extract.effect_snippet(F.col("abstract")).alias("snippet"))


@query(f"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Conclusions: ' || trim({_PLAIN_WORDS}) ELSE trim({_PLAIN_WORDS}) || CASE WHEN doc_id % 3 = 1 THEN '. The second of two longer sentences. And this is the last one of them. Funding: nobody paid for this work.' ELSE '' END END AS a FROM documents),
 s AS (SELECT *, list_filter({sents('a')}, lambda s: length(s) >= 20 AND NOT regexp_matches(s, '(?i)^(trial registration|funding|registration|clinicaltrials\\.gov|copyright|©|conflict of interest|keywords|研究注册|注册号)')) AS l FROM x),
 t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_replace(a, '^Conclusions: *', '') WHEN len(l) = 0 THEN '' ELSE array_to_string(l[greatest(len(l) - 1, 1):], ' ') END AS text, CASE WHEN a = '' THEN '无摘要' WHEN doc_id % 3 = 0 THEN '结构化结论段' WHEN len(l) = 0 THEN '摘要过短' ELSE '摘要末句（无结构化标签）' END AS origin FROM s)
 SELECT doc_id, md5(CASE WHEN length(text) <= 900 THEN text ELSE rtrim(left(text, 900)) || '…' END) AS text, origin FROM t WHERE doc_id % 3 <> 0 OR text <> ''""")
def conclusions_found(spark, d):
    w = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]+", " "))
    more = F.when(F.col("doc_id") % 3 == 1, ". The second of two longer sentences. And this is the last one of them. Funding: nobody paid for this work.").otherwise("")
    docs = t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Conclusions: "), w)).otherwise(F.concat(w, more)).alias("abstract"), w.alias("w"))
    docs = docs.where("doc_id % 3 <> 0 or w <> ''")
    a = extract.with_sections(docs.select("doc_id", F.col("doc_id").cast("string").alias("pmid"), F.lit("").alias("title"), "abstract"))
    return a.select("doc_id", extract.conclusion().alias("c")).select("doc_id", F.md5("c.text").alias("text"), "c.origin")


@query(f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS section FROM documents), q AS (SELECT doc_id, section, trim(regexp_replace(x, '[\\s\\x0b\\x{{a0}}\\x{{3000}}]+', ' ', 'g')) AS x FROM p),
 s AS (SELECT doc_id, section, x, {sents('x')} AS l FROM q) SELECT count(*) AS sections, sum(len(l))::BIGINT AS sentences, sum(list_sum(list_transform(l, lambda y: length(y))))::BIGINT AS chars FROM s WHERE len(l) > 0""")
def sentences_placed(spark, d):
    parts = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("section", "text")).withColumn("text", X.squeeze(F.col("text")))
    placed = locate.index_with_offsets(parts)
    good = placed.join(parts, ["doc_id", "section"]).where(F.expr("substring(text, start + 1, end - start)") == F.col("sentence"))
    return good.agg(F.countDistinct("doc_id", "section").alias("sections"), F.count(F.lit(1)).alias("sentences"), F.sum(F.col("end") - F.col("start")).alias("chars"))
