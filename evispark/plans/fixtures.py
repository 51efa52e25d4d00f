"""Small literal tables, the same for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

A1 = ("We randomly assigned 1,204 adults aged 60 years or older with heart failure to drug A or placebo in a multicenter double-blind trial (NCT01234567). The primary outcome was cardiovascular death over a follow-up of 24 months. "
      "The hazard ratio was HR 0.72 (95% CI 0.58-0.90; P = 0.004). Drug A significantly reduced mortality compared with placebo. Analysis was by intention-to-treat and the trial was funded by a public grant.")
A2 = ("In this randomized controlled trial 86 patients with heart failure received drug A or usual care. There was no significant difference in mortality between groups (HR 1.05, 95% CI 0.80-1.38, P = 0.70). "
      "Follow-up was 12 weeks, and 24% were lost to follow-up. Subgroup analysis was exploratory analysis only. The study was sponsored by the manufacturer.")
A3 = ("We did a retrospective cohort study of 5320 patients treated with drug A at a single institution. Mortality was higher with drug A (OR 1.41, 95% CI 1.10-1.80). Drug A was associated with increased risk of bleeding due to its mechanism. Follow-up lasted 3 years.")
A4 = "We searched six databases and included 18 studies in this meta-analysis. Pooled RR 0.81 (95% CI 0.70-0.94). Heterogeneity was low (I2 = 12%). Drug A improved quality of life in heart failure."
A5 = "We report a case of a 45-year-old woman with rash after drug A. The rash resolved within 10 days after the drug was stopped."
A6 = "BACKGROUND: Heart failure is common. METHODS: A total of 412 adults were enrolled across centers. RESULTS: LDL fell by 12% (P<.001). CONCLUSIONS: Drug A lowered LDL and was well tolerated."
ARTICLES = [
    (1, "101", "Drug A in heart failure: a trial", "Heart J", "2021", ["Smith JA", "Lee K", "The A Study Group"], A1, "10.1000/a1", "PMC1", ["Randomized Controlled Trial"], "12", "3", "100--110", "1234-5678", "eng", "https://x.example/1"),
    (2, "102", "Drug A and usual care in heart failure", "Lancet & Co", "2022 Jan-Feb", ["Lee K", "Wu B", "Ng C", "Ito D", "Ray E", "Fox F", "Kim G"], A2, "10.1000/a2", None, [], "7", None, "5-9", None, "eng", None),
    (3, "103", "Harms of drug A", "BMJ", "2019", ["O'Neil P"], A3, None, None, ["Journal Article"], None, None, None, None, None, None),
    (4, "104", "Drug A: a systematic review of trials in heart failure", "Cochrane 100%", "2023", ["Smith JA", "Roe_X Y"], A4, "10.1000/a4", "PMC4", ["Meta-Analysis", "Review"], "1", "2", "e12", None, "eng", None),
    (5, None, "Rash after drug A", "Case J", "2018", ["Zed Q"], A5, None, None, ["Case Reports"], None, None, None, None, None, None),
    (6, "106", "LDL and drug A", "Lipid J", None, [], A6, None, None, None, None, None, None, None, None, None),
    (7, "107", "", "", "", ["Solo"], "", "", "", [], "", "", "", "", "", ""),
    (8, "101", "Drug A in heart failure: a trial.", "Heart J", "2021", ["Smith JA"], None, None, None, None, None, None, None, None, None, None),
]
ARTICLE_COLUMNS = "ord int, pmid string, title string, journal string, year string, authors array<string>, abstract string, doi string, pmcid string, pubtypes array<string>, volume string, issue string, pages string, issn string, language string, url string"

TEXTS = [
    (1, "Mortality fell (HR 0.72, 95% CI 0.58-0.90; P = 0.004), n = 1,204. Mean age was 64 ± 9 years and 45% were women. P<0.001 in all."),
    (2, "Values with mid-dots: 95% CI 0·64–0·98 and 12·5% of all, P = 0·02. See Fig. 3 for n = 12. The rate was 12.5% again."),
    (3, "Write to jane.doe@mail.example.org or call +86 13812345678 today. The number 138123456789 is no phone number."),
    (4, "No values here, e.g. none at all. Smith et al. said so! Did they? 这是一个中文句子，没有数字。 "),
]
ROWS = [  # comparison rows
    ("a", "随机对照试验", "支持有效 / 正相关", "1b", "2021", 1204, "adults", "death", "HR 0.72", "Drug A reduced mortality", "PMC1", -1, "Drug A in heart failure", 3.0, True),
    ("b", "随机对照试验", "无显著差异 / 无关联", "1b", "2022 Jan", 86, "", "", "HR 1.05", "No significant difference in mortality", None, 1, "Drug A and usual care in heart failure", 3.0, True),
    ("c", "队列研究", "提示风险增加 / 不利", "2b", "2019", None, "patients", "", "", "Higher mortality with drug A", None, 1, "Harms of drug A", 2.0, False),
    ("d", "未识别", "未明确", "—", "", None, "", "", "", "", "", 0, "Other", 0.0, False),
    ("e", "系统评价 / Meta 分析", "支持有效 / 正相关", "1a", "2023", 50, "adults", "qol", "RR 0.81", "Drug A improved quality of life in heart failure", "PMC4", -1, "Drug A: a review in heart failure", 4.0, True),
]
ROW_COLUMNS = "row_key string, design string, polarity string, cebm string, year string, n long, population string, primary_outcome string, effects_text string, conclusion string, pmcid string, direction int, title string, base double, has_interval boolean"
CORRECTIONS = [("b", "样本量", "90 例"), ("b", "人群", "adults with failure"), ("c", "结论", "No benefit was seen"), ("d", "研究设计", "ignored"), ("d", "样本量", "none")]
TERMS = ["heart failure", "mortality", "drug a", "quality"]
PRISMA = [(1, 1863, 50, 6, 30, 9), (2, None, 10, 20, 1, 1), (3, 5, None, None, None, None)]
SEARCHES = [
    (1, " lung cancer ", "PD-1 biomarker, chemo；", "NOT", "Smith J", "New England Journal", "China", "2020/01/01", "2021/12/31"), (2, "aspirin", "", "AND", "", "", "", "", ""), (3, "aspirin OR ibuprofen", None, None, None, "BMJ", None, "2020/01/01", None), (4, "a", "b,c", "OR", "", "", "", "", ""), (5, "a", "b", "XOR", "Lee K", "", "", "", "")]
VOCAB = [
    ("aspirin", 0, "D1", "Aspirin Resistance", ["Aspirin Resistance"], "descriptor"), ("aspirin", 1, "D2", "Aspirin", ["Aspirin", "Acetylsalicylic Acid", "acetylsalicylic acid", "ASA"], "descriptor"),
    ("heart attack", 0, "Q1", "heart attack", ["heart attack"], "qualifier"), ("heart attack", 1, "D3", "Myocardial Infarction", ["Myocardial Infarction", "Heart Attack", "Infarct, Myocardial"], "descriptor"), ("diabetes", 0, "D4", "Diabetes Mellitus", ["Diabetes Mellitus"], "descriptor")]
LOOKUPS = ["aspirin", "heart attack", "diabetes", "x", "nothing"]
FOLDERS = [("f1", "To Read", "2024-01-01"), ("f2", "Done", "2024-01-02"), ("f3", "Empty", "2024-01-03")]
META = [("101", "f1", ["RCT", "heart"], "key trial", "2024-02-01"), ("102", "f1", ["rct"], "", "2024-02-02"), ("103", "f2", ["Harm", "heart "], " ", "2024-02-03"), ("104", "", ["review"], "", None), ("105", "gone", [], "", None)]
IN_FOLDERS = [("g1", "to read", "2024-03-01"), ("g2", "New", "2024-03-02")]
IN_META = [("101", "g2", ["Heart", "new"], "", "x"), ("106", "g1", ["fresh"], "hello", "x")]
CHANNEL_ROWS = [("2024-W01", "知乎", "1,000", "30", ""), ("2024-W01", "GitHub", "2000", "6", ""), ("2024-W02", "知乎", "-", "?", ""), ("2024-W03", "B站", "500", "1.0", "x")]
TOTAL_ROWS = [("2024-W01", "120", "2", "1", ""), ("2024-W02", "—", "0", "", ""), ("2024-W04", "5", "1", "0", "")]


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table. Texts in fewer files than there are cores are dealt to all of them, since a file may be one row group, which one task reads."""
    df, cores = spark.read.parquet(f"{d}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and len(df.inputFiles()) < cores else df


_CLINICAL = ("concat(' A total of ', doc_id % 3000, ' patients were enrolled. HR 0.', lpad(cast(doc_id % 100 as string), 2, '0'), ' (95% CI 0.', doc_id % 5 + 1, '-1.', doc_id % 7 + 1, '; P = 0.0', doc_id % 9 + 1, '). Follow-up was ', doc_id % 40 + 1, ' months. ',"
             " case doc_id % 5 when 0 then 'Drug A significantly reduced mortality.' when 1 then 'There was no significant difference between groups.' when 2 then 'The drug was associated with increased risk of bleeding, a retrospective cohort study showed.'"
             " when 3 then 'In this randomized controlled trial it was not superior to placebo.' else '' end,"
             " case doc_id % 3 when 0 then ' The difference was MD -1.5 points.' else '' end)")


def articles(spark: SparkSession, d: str) -> DataFrame:
    """The literal articles, and one of each document: its whole text with a clinical sentence, other fields from its id and source."""
    own = table(spark, d, "documents").selectExpr(
        "cast(doc_id + 1000 as int) as ord", "if(doc_id % 11 = 0, null, cast(doc_id % 900 + 1000 as string)) as pmid", "split_part(coalesce(text, ''), '\n', 1) as title", "concat(source, ' J') as journal",
        "case doc_id % 5 when 0 then null when 1 then '2019' when 2 then '2022 Jan-Feb' when 3 then '' else cast(1990 + doc_id % 30 as string) end as year",
        "filter(transform(sequence(0, cast(doc_id % 9 as int)), i -> if(i = doc_id % 9, '', if(i = 2, concat('The ', source, ' Group'), concat('Name', i, ' ', char(65 + i), 'B')))), a -> a <> '') as authors",
        f"concat(coalesce(text, ''), {_CLINICAL}) as abstract", "if(doc_id % 3 = 0, null, concat('10.1/', doc_id)) as doi", "if(doc_id % 4 = 0, concat('PMC', doc_id), null) as pmcid",
        "case doc_id % 6 when 0 then array('Journal Article') when 1 then array('Review') when 2 then array('Randomized Controlled Trial', 'Multicenter Study') else null end as pubtypes",
        "if(doc_id % 2 = 0, cast(doc_id % 90 as string), null) as volume", "if(doc_id % 5 = 0, cast(doc_id % 12 as string), '') as issue", "case doc_id % 3 when 0 then concat(doc_id, '--', doc_id + 9) when 1 then concat('e', doc_id) else null end as pages",
        "if(doc_id % 7 = 0, '1234-5678', null) as issn", "lang as language", "if(doc_id % 2 = 0, concat('https://x.example/', doc_id), null) as url")
    return frame(spark, ARTICLES, ARTICLE_COLUMNS).unionByName(own)


def rows(spark: SparkSession, d: str) -> DataFrame:
    """The literal comparison rows, and one of each document."""
    own = table(spark, d, "documents").selectExpr(
        "concat('d', doc_id) as row_key", "case doc_id % 4 when 0 then '随机对照试验' when 1 then '队列研究' when 2 then '未识别' else '系统评价 / Meta 分析' end as design",
        "case doc_id % 3 when 0 then '支持有效 / 正相关' when 1 then '无显著差异 / 无关联' else '提示风险增加 / 不利' end as polarity", "case doc_id % 4 when 0 then '1b' when 1 then '2b' when 2 then '—' else '1a' end as cebm",
        "case doc_id % 5 when 0 then '' when 1 then '2022 Jan' when 2 then 'n.d.' else cast(1990 + doc_id % 30 as string) end as year", "if(doc_id % 6 = 0, null, cast(n_chars as bigint)) as n", "if(doc_id % 2 = 0, lang, '') as population",
        "if(doc_id % 3 = 0, source, '') as primary_outcome", "if(doc_id % 5 = 0, '', concat('HR 0.', doc_id % 90 + 10)) as effects_text", "coalesce(text, '') as conclusion", "if(doc_id % 4 = 0, concat('PMC', doc_id), null) as pmcid",
        "cast(doc_id % 3 - 1 as int) as direction", "split_part(coalesce(text, ''), '\n', 1) as title", "cast(doc_id % 5 as double) as base", "doc_id % 2 = 0 as has_interval")
    return frame(spark, ROWS, ROW_COLUMNS).unionByName(own)


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, list):
        return "[" + ", ".join(map(_lit, v)) + "]::VARCHAR[]"
    return "'" + v.replace("'", "''") + "'"


def values(rows: list, schema: str) -> str:
    """A SELECT of the rows, with types."""
    kinds = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}
    cols = [c.rsplit(" ", 1) for c in schema.split(", ")]
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    body = ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in rows)
    return "SELECT " + ", ".join(f"CAST({n} AS {kinds[t]}) AS {n}" for n, t in cols) + f" FROM (VALUES {body}) v({', '.join(n for n, _ in cols)})"


_TEXT_CLINICAL = _CLINICAL.replace("cast(doc_id % 100 as string)", "(doc_id % 100)::VARCHAR")
#: SQL of :func:`articles`.
ARTICLES_SQL = f"""{values(ARTICLES, ARTICLE_COLUMNS)} UNION ALL SELECT (doc_id + 1000)::INT AS ord, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (doc_id % 900 + 1000)::VARCHAR END AS pmid, split_part(coalesce(text, ''), chr(10), 1) AS title, source || ' J' AS journal,
 CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '2019' WHEN 2 THEN '2022 Jan-Feb' WHEN 3 THEN '' ELSE (1990 + doc_id % 30)::VARCHAR END AS year,
 list_transform(range(0, doc_id % 9), lambda i: CASE WHEN i = 2 THEN 'The ' || source || ' Group' ELSE 'Name' || i || ' ' || chr((65 + i)::INT) || 'B' END) AS authors,
 concat(coalesce(text, ''), {_TEXT_CLINICAL}) AS abstract, CASE WHEN doc_id % 3 <> 0 THEN '10.1/' || doc_id END AS doi, CASE WHEN doc_id % 4 = 0 THEN 'PMC' || doc_id END AS pmcid,
 CASE doc_id % 6 WHEN 0 THEN ['Journal Article'] WHEN 1 THEN ['Review'] WHEN 2 THEN ['Randomized Controlled Trial', 'Multicenter Study'] END AS pubtypes, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 90)::VARCHAR END AS volume, CASE WHEN doc_id % 5 = 0 THEN (doc_id % 12)::VARCHAR ELSE '' END AS issue,
 CASE doc_id % 3 WHEN 0 THEN doc_id || '--' || (doc_id + 9) WHEN 1 THEN 'e' || doc_id END AS pages, CASE WHEN doc_id % 7 = 0 THEN '1234-5678' END AS issn, lang AS language, CASE WHEN doc_id % 2 = 0 THEN 'https://x.example/' || doc_id END AS url FROM documents"""
#: SQL of :func:`rows`.
ROWS_SQL = f"""{values(ROWS, ROW_COLUMNS)} UNION ALL SELECT 'd' || doc_id AS row_key, CASE doc_id % 4 WHEN 0 THEN '随机对照试验' WHEN 1 THEN '队列研究' WHEN 2 THEN '未识别' ELSE '系统评价 / Meta 分析' END AS design,
 CASE doc_id % 3 WHEN 0 THEN '支持有效 / 正相关' WHEN 1 THEN '无显著差异 / 无关联' ELSE '提示风险增加 / 不利' END AS polarity, CASE doc_id % 4 WHEN 0 THEN '1b' WHEN 1 THEN '2b' WHEN 2 THEN '—' ELSE '1a' END AS cebm,
 CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '2022 Jan' WHEN 2 THEN 'n.d.' ELSE (1990 + doc_id % 30)::VARCHAR END AS year, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE n_chars::BIGINT END AS n, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS population,
 CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END AS primary_outcome, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'HR 0.' || (doc_id % 90 + 10) END AS effects_text, coalesce(text, '') AS conclusion, CASE WHEN doc_id % 4 = 0 THEN 'PMC' || doc_id END AS pmcid,
 (doc_id % 3 - 1)::INT AS direction, split_part(coalesce(text, ''), chr(10), 1) AS title, (doc_id % 5)::DOUBLE AS base, doc_id % 2 = 0 AS has_interval FROM documents"""


# --- other literal tables with rows of the given ones: each as a frame, and as SQL

PRISMA_COLUMNS = "id int, total_hits int, retrieved int, duplicates int, excluded_screening int, excluded_fulltext int"
SEARCH_COLUMNS = "id int, keyword string, secondary string, logic string, author string, journal string, country string, start_date string, end_date string"
VOCAB_COLUMNS = "term string, ord int, ui string, heading string, entry_terms array<string>, type string"
FOLDER_COLUMNS, META_COLUMNS = "id string, name string, created_at string", "pmid string, folder string, tags array<string>, note string, note_updated string"
CHANNEL_COLUMNS, TOTAL_COLUMNS = "week string, channel string, impressions string, landing_uv string, note string", "week string, members_end string, joins string, active_next_week string, note string"


def prisma(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").selectExpr("cast(doc_id + 10 as int) as id", "if(doc_id % 7 = 0, null, cast(n_chars as int)) as total_hits", "cast(n_chars % 500 as int) as retrieved", "if(doc_id % 5 = 0, null, cast(doc_id % 90 as int)) as duplicates",
                                                  "cast(doc_id % 200 as int) as excluded_screening", "cast(doc_id % 40 as int) as excluded_fulltext")
    return frame(spark, PRISMA, PRISMA_COLUMNS).unionByName(own)


PRISMA_SQL = f"""{values(PRISMA, PRISMA_COLUMNS)} UNION ALL SELECT doc_id + 10, CASE WHEN doc_id % 7 <> 0 THEN n_chars END, n_chars % 500, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 90 END, doc_id % 200, doc_id % 40 FROM documents"""


def searches(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").withColumn("w", F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).selectExpr(
        "cast(doc_id + 100 as int) as id", "concat(' ', coalesce(get(w, 0), 'none'), if(doc_id % 2 = 0, concat(' ', coalesce(get(w, 1), '')), '')) as keyword",
        "case doc_id % 4 when 0 then concat_ws(', ', get(w, 2), concat(get(w, 3), ' ', get(w, 4)), get(w, 5)) when 1 then concat_ws('；', get(w, 2), ' ', get(w, 3)) when 2 then '' else null end as secondary",
        "case doc_id % 5 when 0 then 'AND' when 1 then 'OR' when 2 then 'NOT' when 3 then 'XOR' else null end as logic", "if(doc_id % 3 = 0, concat('Name ', doc_id), '') as author", "if(doc_id % 4 = 1, source, concat(source, ' J')) as journal",
        "if(doc_id % 6 = 0, lang, null) as country", "if(doc_id % 7 < 3, '2020/01/01', '') as start_date", "if(doc_id % 7 < 2, '2021/12/31', null) as end_date")
    return frame(spark, SEARCHES, SEARCH_COLUMNS).unionByName(own)


SEARCHES_SQL = f"""{values(SEARCHES, SEARCH_COLUMNS)} UNION ALL SELECT doc_id + 100, ' ' || coalesce(w[1], 'none') || CASE WHEN doc_id % 2 = 0 THEN ' ' || coalesce(w[2], '') ELSE '' END,
 CASE doc_id % 4 WHEN 0 THEN concat_ws(', ', w[3], w[4] || ' ' || w[5], w[6]) WHEN 1 THEN concat_ws('；', w[3], ' ', w[4]) WHEN 2 THEN '' END, CASE doc_id % 5 WHEN 0 THEN 'AND' WHEN 1 THEN 'OR' WHEN 2 THEN 'NOT' WHEN 3 THEN 'XOR' END,
 CASE WHEN doc_id % 3 = 0 THEN 'Name ' || doc_id ELSE '' END, CASE WHEN doc_id % 4 = 1 THEN source ELSE source || ' J' END, CASE WHEN doc_id % 6 = 0 THEN lang END, CASE WHEN doc_id % 7 < 3 THEN '2020/01/01' ELSE '' END, CASE WHEN doc_id % 7 < 2 THEN '2021/12/31' END
 FROM (SELECT *, regexp_extract_all(text, '[A-Za-z]+') AS w FROM documents)"""


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Two records for each part's name, as a search would find them: its type, and itself or one that has it as an entry term."""
    p = table(spark, d, "part").withColumn("name", F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")))
    one = p.selectExpr("name as term", "0 as ord", "concat('T', p_partkey) as ui", "p_type as heading", "array(p_type, p_brand) as entry_terms", "if(p_partkey % 2 = 0, 'qualifier', 'descriptor') as type")
    two = p.selectExpr("name as term", "1 as ord", "concat('P', p_partkey) as ui", "if(p_partkey % 3 = 0, initcap(name), p_brand) as heading", "array(if(p_partkey % 3 = 0, initcap(name), p_brand), if(p_partkey % 3 = 1, upper(name), 'other'), p_type, lower(p_brand), concat(p_type, ' ', p_size), 'ab') as entry_terms", "'descriptor' as type")
    return frame(spark, VOCAB, VOCAB_COLUMNS).unionByName(one).unionByName(two)


def lookups(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, LOOKUPS, "term string").unionByName(table(spark, d, "part").selectExpr("concat(p_name, ' ', p_partkey) as term"))


_NAMED = "(SELECT *, p_name || ' ' || p_partkey AS name, array_to_string(list_transform(string_split(p_name || ' ' || p_partkey, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS cap FROM part)"
VOCAB_SQL = f"""{values(VOCAB, VOCAB_COLUMNS)} UNION ALL SELECT name, 0, 'T' || p_partkey, p_type, [p_type, p_brand], CASE WHEN p_partkey % 2 = 0 THEN 'qualifier' ELSE 'descriptor' END FROM {_NAMED}
 UNION ALL SELECT name, 1, 'P' || p_partkey, CASE WHEN p_partkey % 3 = 0 THEN cap ELSE p_brand END, [CASE WHEN p_partkey % 3 = 0 THEN cap ELSE p_brand END, CASE WHEN p_partkey % 3 = 1 THEN upper(name) ELSE 'other' END, p_type, lower(p_brand), p_type || ' ' || p_size, 'ab'], 'descriptor' FROM {_NAMED}"""
LOOKUPS_SQL = f"{values(LOOKUPS, 'term string')} UNION ALL SELECT p_name || ' ' || p_partkey FROM part"


def folders(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, FOLDERS, FOLDER_COLUMNS).unionByName(table(spark, d, "nation").selectExpr("concat('n', n_nationkey) as id", "n_name as name", "'2023-01-01' as created_at"))


def meta(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").selectExpr(
        "cast(c_custkey + 1000 as string) as pmid", "case c_custkey % 4 when 0 then '' when 1 then concat('n', c_nationkey) when 2 then 'gone' else 'f1' end as folder",
        "case c_custkey % 5 when 0 then cast(array() as array<string>) when 1 then array('RCT', c_mktsegment) else array(lower(c_mktsegment), concat(' tag', c_custkey % 13, ' ')) end as tags", "if(c_custkey % 3 = 0, concat('note of ', c_name), '') as note", "'2023-02-01' as note_updated")
    return frame(spark, META, META_COLUMNS).unionByName(own)


def in_folders(spark: SparkSession, d: str) -> DataFrame:
    return frame(spark, IN_FOLDERS, FOLDER_COLUMNS).unionByName(table(spark, d, "nation").selectExpr("concat('i', n_nationkey) as id", "if(n_nationkey % 2 = 0, lower(n_name), concat('In ', n_name)) as name", "'2024-03-03' as created_at"))


def in_meta(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "customer").where("c_custkey % 3 <> 1").selectExpr(
        "cast(c_custkey + if(c_custkey % 2 = 0, 1000, 1000000) as string) as pmid", "if(c_custkey % 5 = 0, '', concat('i', c_nationkey)) as folder", "array(upper(c_mktsegment), 'imported') as tags", "if(c_custkey % 4 = 0, 'new note', ' ') as note", "'x' as note_updated")
    return frame(spark, IN_META, META_COLUMNS).unionByName(own)


FOLDERS_SQL = f"{values(FOLDERS, FOLDER_COLUMNS)} UNION ALL SELECT 'n' || n_nationkey, n_name, '2023-01-01' FROM nation"
META_SQL = f"""{values(META, META_COLUMNS)} UNION ALL SELECT (c_custkey + 1000)::VARCHAR, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'n' || c_nationkey WHEN 2 THEN 'gone' ELSE 'f1' END,
 CASE c_custkey % 5 WHEN 0 THEN [] WHEN 1 THEN ['RCT', c_mktsegment] ELSE [lower(c_mktsegment), ' tag' || c_custkey % 13 || ' '] END, CASE WHEN c_custkey % 3 = 0 THEN 'note of ' || c_name ELSE '' END, '2023-02-01' FROM customer"""
IN_FOLDERS_SQL = f"{values(IN_FOLDERS, FOLDER_COLUMNS)} UNION ALL SELECT 'i' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE 'In ' || n_name END, '2024-03-03' FROM nation"
IN_META_SQL = f"""{values(IN_META, META_COLUMNS)} UNION ALL SELECT (c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 1000 ELSE 1000000 END)::VARCHAR, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'i' || c_nationkey END, [upper(c_mktsegment), 'imported'], CASE WHEN c_custkey % 4 = 0 THEN 'new note' ELSE ' ' END, 'x' FROM customer WHERE c_custkey % 3 <> 1"""


def channel_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("concat('E', date_format(ts, 'yyyy-MM-dd')) as week", "event_type as channel", "value", "user_id")
    own = e.groupBy("week", "channel").agg(F.sum(F.floor(F.col("value") * 100)).alias("i"), F.countDistinct("user_id").alias("u")).selectExpr("week", "channel", "if(i % 5 = 0, '-', cast(i as string)) as impressions", "if(u % 7 = 0, '?', concat(' ', u, '.0')) as landing_uv", "'' as note")
    return frame(spark, CHANNEL_ROWS, CHANNEL_COLUMNS).unionByName(own)


def total_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("concat('E', date_format(ts, 'yyyy-MM-dd')) as week", "event_id", "user_id")
    own = e.groupBy("week").agg(F.countDistinct("user_id").alias("u"), F.count_if(F.col("event_id") % 10 == 0).alias("j"), F.count_if(F.col("event_id") % 100 == 0).alias("a")).selectExpr("week", "cast(u as string) as members_end", "cast(j as string) as joins", "if(a = 0, '—', cast(a as string)) as active_next_week", "'' as note")
    return frame(spark, TOTAL_ROWS, TOTAL_COLUMNS).unionByName(own)


CHANNEL_SQL = f"""{values(CHANNEL_ROWS, CHANNEL_COLUMNS)} UNION ALL SELECT week, channel, CASE WHEN i % 5 = 0 THEN '-' ELSE i::VARCHAR END, CASE WHEN u % 7 = 0 THEN '?' ELSE ' ' || u || '.0' END, ''
 FROM (SELECT 'E' || strftime(ts, '%Y-%m-%d') AS week, event_type AS channel, sum(floor(value * 100))::BIGINT AS i, count(DISTINCT user_id) AS u FROM events GROUP BY ALL)"""
TOTAL_SQL = f"""{values(TOTAL_ROWS, TOTAL_COLUMNS)} UNION ALL SELECT week, u::VARCHAR, j::VARCHAR, CASE WHEN a = 0 THEN '—' ELSE a::VARCHAR END, ''
 FROM (SELECT 'E' || strftime(ts, '%Y-%m-%d') AS week, count(DISTINCT user_id) AS u, count(*) FILTER (WHERE event_id % 10 = 0) AS j, count(*) FILTER (WHERE event_id % 100 = 0) AS a FROM events GROUP BY ALL)"""
