"""Registered queries over the operators, each with its SQL twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.functions import lexicon as L
from evispark.functions import text as X
from evispark.operators import bias, cite, compare, extract, funnel, keywords, library, locate, services, telemetry, vocab
from evispark.plans import fixtures as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f
    return add


t = S.table


# --- SQL texts that several twins share

_WS = r"[\s\x0b\x{a0}\x{3000}]"
Q = lambda s: s.replace("'", "''")


def sq(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WS}+', ' ', 'g'))"


def sents(c: str) -> str:
    s = sq(f"coalesce({c}, '')")
    for a in L.ABBREVIATIONS:
        s = f"replace({s}, '{a}.', '{a}§')"
    return (f"list_filter(list_transform(string_split(regexp_replace({s}, '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda p: trim(replace(p, '§', '.'))), lambda p: length(p) > 10)")


def hit(low: str, cues: list[str]) -> str:
    """Whether a cue of a list is in a lower-case text."""
    parts = []
    for c in cues:
        k = Q(c.strip()).replace(".", r"\.")
        parts.append(rf"\b{k}\b" if c.isascii() and c.isalnum() else rf"(?:^|[^a-z0-9]){k}(?:$|[^a-z0-9])" if c != c.strip() else k)
    return f"regexp_matches({low}, '{'|'.join(parts)}')"


_NUM = r"\d+(?:[.·]\d+)?"
_STEM = """CASE WHEN length(w) <= 4 OR contains(w, '-') OR regexp_matches(w, '[0-9]') THEN w ELSE
 CASE WHEN length(c) < 3 THEN w ELSE c END END"""
_CAND = """CASE WHEN ends_with(w, 'ies') AND length(w) > 5 THEN left(w, length(w)-3) || 'y' WHEN ends_with(w, 'sses') AND length(w) > 5 THEN left(w, length(w)-2)
 WHEN ends_with(w, 'es') AND length(w) > 5 THEN CASE WHEN substr(w, length(w)-2, 1) IN ('s','x','z') THEN left(w, length(w)-2) ELSE left(w, length(w)-1) END
 WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') AND NOT ends_with(w, 'is') THEN left(w, length(w)-1) ELSE w END"""


# --- texts ---------------------------------------------------------------------

@query(f"SELECT doc_id, len({sents('text')})::INT AS sentences FROM documents")
def sentence_counts(spark, d):
    return t(spark, d, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).alias("sentences"))


def _value_sql() -> str:
    pats = {k: Q(p) for k, p in X.VALUE_PATTERNS.items()}
    arms = " UNION ALL ".join(f"SELECT doc_id, pos, '{k}' AS kind, unnest(regexp_extract_all(s, '{p}')) AS v FROM s" for k, p in pats.items())
    return f"""WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT -id, text FROM ({S.values(S.TEXTS, 'id long, text string')})),
 s AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, {sents('text')} AS l FROM d)), h AS ({arms}),
 n AS (SELECT doc_id, kind, {sq("replace(v, '·', '.')")} AS value FROM h WHERE kind <> '百分比' OR ends_with(v, '%'))
 SELECT kind, count(*) AS hits, count(DISTINCT doc_id) AS docs FROM (SELECT DISTINCT doc_id, kind, lower(regexp_replace(value, '{_WS}+', '', 'g')) FROM n) GROUP BY kind"""


@query(_value_sql())
def value_hits_by_type(spark, d):
    own = S.frame(spark, S.TEXTS, "id long, text string").select((-F.col("id")).alias("doc_id"), "text")
    hits = locate.values(t(spark, d, "documents").select("doc_id", "text").unionByName(own), per_type=1_000_000)
    return hits.groupBy("kind").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("doc_id").alias("docs"))


_STOPS = ", ".join(f"'{Q(w)}'" for w in L.ENGLISH_STOP + L.GENERIC_STOP)
_TOKENS = f"""raw AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''\\-]*'))) AS r FROM documents),
 a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(r, '^[''\\-]+|[''\\-]+$', '', 'g'), '''(s|re|ve|ll|d|m|t)$', ''), '[''\\-]+$', '') AS w FROM raw),
 b AS (SELECT doc_id, w, {_CAND} AS c FROM a WHERE w <> ''), tok AS (SELECT doc_id, {_STEM} AS term FROM b)"""


@query(f"""WITH {_TOKENS}, k AS (SELECT * FROM tok WHERE term NOT IN ({_STOPS}) AND (term IN ({', '.join(f"'{w}'" for w in L.SHORT_KEEP)}) OR (length(term) >= 3 AND replace(term, left(term, 1), '') <> ''))),
 g AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM k GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS units FROM tok)
 SELECT term, tf, df, round(tf * (0.35::DOUBLE + ln(1 + units / (1 + df))), 6) AS weight FROM g, n WHERE df >= 3""")
def token_weights(spark, d):
    return keywords.token_weights(t(spark, d, "documents"), "doc_id").where("df >= 3").withColumn("weight", F.round("weight", 6))


@query("""SELECT lang, count(*) AS docs, count(*) FILTER (WHERE la > cjk * 2 AND la > 20) AS english FROM
 (SELECT lang, len(regexp_extract_all(text, '[A-Za-z]')) AS la, len(regexp_extract_all(text, '[一-鿿]')) AS cjk FROM documents) GROUP BY lang""")
def mostly_english_by_lang(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count_if(X.mostly_english(F.col("text"))).alias("english"))


_MASK = r"""regexp_replace(regexp_replace(text, '[\w.+-]+@[\w-]+\.[\w.-]+', '[邮箱已隐去]', 'g'), '(^|[^0-9])(?:\+?86[- ]?)?1[3-9][0-9]{9}($|[^0-9])', '\1[手机号已隐去]\2', 'g')"""


@query(f"""SELECT doc_id, md5({_MASK}) AS masked, {_MASK} <> text AS changed FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -id, text FROM ({S.values(S.TEXTS, 'id long, text string')}) UNION ALL SELECT 1000000 + conv_id * 100 + turn, text FROM conversations)""")
def pii_masked(spark, d):
    own = S.frame(spark, S.TEXTS, "id long, text string").select((-F.col("id")).alias("doc_id"), "text")
    talk = t(spark, d, "conversations").select((F.lit(1000000) + F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "text")
    rows = t(spark, d, "documents").select("doc_id", "text").unionByName(own).unionByName(talk)
    return rows.select("doc_id", F.md5(X.sanitize(F.col("text"))).alias("masked"), (X.sanitize(F.col("text")) != F.col("text")).alias("changed"))


_IDX = f"s AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, {sents('text')} AS l FROM documents))"


@query(f"""WITH {_IDX}, h AS (SELECT doc_id, pos::INT AS pos, ((length(s) - length(replace(lower(s), 'the', ''))) / 3 + (length(s) - length(replace(lower(s), 'with', ''))) / 4)::INT AS count
 FROM s WHERE contains(lower(s), 'the') AND contains(lower(s), 'with')) SELECT doc_id, pos, count FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 80""")
def keyword_search(spark, d):
    return locate.search(t(spark, d, "documents"), "the With")


_NT = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_NUMS = "list_filter(list_distinct(regexp_extract_all({}, '\\d+(?:\\.\\d+)?')), lambda x: NOT (regexp_full_match(x, '\\d{{4}}') AND x::DOUBLE BETWEEN 1900 AND 2100))"
_LATIN = "list_distinct(list_transform(regexp_extract_all({}, '[A-Za-z][A-Za-z\\-'']{{2,}}'), lambda x: lower(x)))"


@query(f"""WITH {_IDX}, q AS (SELECT item_id AS query_id, s AS q FROM (SELECT item_id, ({sents('text')})[1] AS s FROM benchmark) WHERE s IS NOT NULL),
 qq AS (SELECT query_id, {_NT.format('q')} AS qn, {_NUMS.format('q')} AS qnum, {_LATIN.format('q')} AS qterm FROM q), ss AS (SELECT doc_id, pos, {_NT.format('s')} AS sn, {_NUMS.format('s')} AS snum, {_LATIN.format('s')} AS sterm FROM s),
 p AS (SELECT query_id, doc_id, pos, CASE WHEN sn = qn THEN 1 WHEN sn <> '' AND (contains(qn, sn) OR (length(qn) > 40 AND contains(sn, qn))) THEN 2 ELSE 3 END AS tier,
  len(list_intersect(qnum, snum)) AS a, len(list_intersect(qterm, sterm)) AS b, len(qnum) * 3 + len(qterm) * 2 AS of, len(snum) AS nums FROM qq, ss),
 r AS (SELECT *, CASE tier WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 0.95::DOUBLE ELSE (a * 3 + b * 2)::DOUBLE / of * CASE WHEN nums > 3 AND a < nums * 0.5 THEN 0.75::DOUBLE ELSE 1.0::DOUBLE END END AS raw FROM p WHERE tier < 3 OR (of > 0 AND a + b > 0)),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, raw DESC, doc_id, pos) AS n, min(tier) OVER (PARTITION BY query_id) AS first FROM r WHERE raw >= 0.3)
 SELECT query_id, doc_id, pos::INT AS pos, round_even(raw, 2) AS score FROM k WHERE n <= 2 AND tier = first""")
def locate_benchmark(spark, d):
    q = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.get(X.sentences(F.col("text")), F.lit(0)).alias("sentence")).where("sentence is not null")
    return locate.locate(q, t(spark, d, "documents"))


_PLAIN = "regexp_replace(html, '<[^>]*>', chr(10), 'g')"


@query(f"""WITH l AS (SELECT page_id, list_filter(list_transform(string_split_regex({_PLAIN}, '\\r\\n|\\n|\\r'), lambda x: trim(x)), lambda x: x <> '') AS ls FROM pages),
 s AS (SELECT *, coalesce(list_position(list_transform(ls, lambda x: regexp_full_match(x, '(?i)abstract|summary|highlights')), true), 1) - 1 AS st FROM l),
 e AS (SELECT *, coalesce(list_min(list_filter(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN i - 1 >= st + 10 AND regexp_full_match(ls[i], '(?i)references?|bibliography') THEN i - 1 END), lambda i: i IS NOT NULL)), len(ls)) AS en FROM s)
 SELECT page_id, md5(CASE WHEN length(array_to_string(ls[st + 1:en], chr(10))) > 1500 THEN array_to_string(ls[st + 1:en], chr(10)) ELSE array_to_string(ls, chr(10)) END) AS text FROM e""")
def page_text_clean(spark, d):
    return t(spark, d, "pages").select("page_id", F.md5(X.page_text(F.regexp_replace("html", "<[^>]*>", "\n"))).alias("text"))


@query("""SELECT min(doc_id) AS doc_id, count(*) AS copies, k AS title_key FROM (SELECT doc_id, left(regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9一-鿿]', '', 'g'), 80) AS k FROM documents) GROUP BY k""")
def title_dedupe_first(spark, d):
    k = compare.title_key(F.split_part("text", F.lit("\n"), F.lit(1)))
    return t(spark, d, "documents").groupBy(k.alias("title_key")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("""SELECT doc_id, lower(text[1:0]) || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, sha1(url || chr(31) || doc_id || chr(31)) AS digest FROM (SELECT page_id AS doc_id, url, html AS text FROM pages)""")
def url_digests(spark, d):
    return t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), X.host_of(F.col("url")).alias("host"), X.digest(F.col("url"), F.col("page_id")).alias("digest"))


# --- extraction ------------------------------------------------------------------

_ART = S.ARTICLES_SQL


def _sizes_sql() -> str:
    arms = " UNION ALL ".join(f"SELECT ord, unnest(regexp_extract_all(a, '{Q(p)}', 1)) AS v FROM x" for p in extract.SIZE_PATTERNS)
    return f"""WITH x AS (SELECT ord, coalesce(abstract, '') AS a FROM ({_ART})), h AS ({arms}), n AS (SELECT ord, max(v) AS n FROM (SELECT ord, TRY_CAST(replace(v, ',', '') AS BIGINT) AS v FROM h) WHERE v BETWEEN 10 AND 5000000 GROUP BY ord)
 SELECT x.ord, n.n FROM x LEFT JOIN n USING (ord)"""


@query(_sizes_sql())
def sample_size(spark, d):
    return S.articles(spark, d).select("ord", extract.largest_size(F.col("abstract")).alias("n"))


def _effects_sql() -> str:
    a = "coalesce(abstract, '')"
    keep = lambda p: f"list_filter(regexp_extract_all({a}, '{Q(p)}', 1), lambda x: true)"
    ratios = ", ".join(f"array_to_string({keep(p)}, '/') AS {k}" for k, p in extract.RATIOS.items())
    ci = f"array_to_string(list_transform(regexp_extract_all({a}, '{Q(extract.INTERVAL)}', 1), lambda c: regexp_replace(c, '^[ ,;，；]+|[ ,;，；]+$', '', 'g')), '|')"
    return f"SELECT ord, {ratios}, {ci} AS ci, array_to_string(regexp_extract_all({a}, '{Q(extract.P_VALUE)}'), '|') AS p, array_to_string(regexp_extract_all({a}, '{Q(extract.DIFFERENCE)}'), '|') AS md FROM ({_ART})"


@query(_effects_sql())
def effects(spark, d):
    e = S.articles(spark, d).select("ord", extract.effects(F.col("abstract")).alias("e"))
    return e.select("ord", *[F.array_join(F.col("e")[k], "/").alias(k) for k in extract.RATIOS], F.array_join(F.transform(F.col("e")["CI"], lambda c: F.replace(c, F.lit("95% CI "), F.lit(""))), "|").alias("ci"), F.array_join(F.col("e")["P"], "|").alias("p"), F.array_join(F.col("e")["MD"], "|").alias("md"))


def _polarity_sql() -> str:
    neg = "(?:" + "|".join(L.NEGATORS) + ")\\s*$"
    neg = Q(neg)

    def alone(c):
        k = Q(c)
        return (f"list_bool_or(list_transform(range(2, len(string_split(low, '{k}')) + 1), lambda i: NOT regexp_matches(right(array_to_string(string_split(low, '{k}')[1:i - 1], '{k}'), 14), '{neg}')))")

    def first(cues):
        return "coalesce(" + ", ".join(f"CASE WHEN contains(low, '{Q(c)}') AND {alone(c)} THEN '{Q(c)}' END" for c in cues) + ")"

    return f"""WITH x AS (SELECT ord, lower(coalesce(abstract, '')) AS low FROM ({_ART})), c AS (SELECT ord, {first(L.NULL_CUES)} AS n, {first(L.HARM_CUES)} AS h, {first(L.POSITIVE_CUES)} AS g FROM x)
 SELECT ord, CASE WHEN n IS NOT NULL THEN '{L.NULL}' WHEN h IS NOT NULL THEN '{L.HARM}' WHEN g IS NOT NULL THEN '{L.POSITIVE}' ELSE '{L.UNCLEAR}' END AS polarity, coalesce(n, h, g, '') AS cue FROM c"""


@query(_polarity_sql())
def polarity(spark, d):
    return S.articles(spark, d).select("ord", extract.polarity(F.col("abstract")).alias("p")).select("ord", F.col("p.label").alias("polarity"), "p.cue")


def _design_sql() -> str:
    """The label, and what gave it: a publication type, else a cue in the title, else in the abstract."""
    arms = [(f"list_bool_or(list_transform(types, lambda p: starts_with(lower(p), '{n}')))", k, f"'PubMed 文献类型「' || list_filter(types, lambda p: starts_with(lower(p), '{n}'))[1] || '」'") for k, ns in L.PUBTYPES.items() for n in ns]
    arms += [(f"contains(low, '{Q(c)}')", k, f"CASE WHEN contains(head, '{Q(c)}') THEN '标题' ELSE '摘要' END || '命中「{Q(c)}」'") for k, cs in L.DESIGN_CUES.items() for c in cs]
    pick = lambda i, other: f"CASE {' '.join(f'WHEN {a[0]} THEN ' + (a[i] if i == 2 else repr(a[i])) for a in arms)} ELSE '{other}' END"
    return f"""WITH x AS (SELECT ord, list_filter(list_transform(coalesce(pubtypes, []), lambda p: trim(p)), lambda p: p <> '') AS types, lower(coalesce(title, '')) AS head, lower(concat_ws(' ', coalesce(title, ''), coalesce(abstract, ''))) AS low FROM ({_ART}))
 SELECT ord, {pick(1, L.UNKNOWN_DESIGN)} AS design, {pick(2, '标题与摘要中未见明确的研究设计表述')} AS evidence FROM x"""


@query(_design_sql())
def design(spark, d):
    a = extract.with_sections(S.articles(spark, d))
    return a.select("ord", extract.design().alias("d")).select("ord", F.col("d.label").alias("design"), "d.evidence")


@query(f"""WITH x AS (SELECT ord, coalesce(abstract, '') AS a FROM ({_ART})), m AS (SELECT ord, regexp_extract(a, '{extract.FOLLOW_EN}', 1) AS v, lower(regexp_extract(a, '{extract.FOLLOW_EN}', 2)) AS u FROM x)
 SELECT ord, CASE WHEN v = '' THEN NULL ELSE round_even(CASE WHEN u IN ('month', 'mo') THEN v::DOUBLE WHEN u IN ('year', 'yr') THEN v::DOUBLE * 12 WHEN u = 'week' THEN v::DOUBLE / 4.345::DOUBLE ELSE v::DOUBLE / 30.44::DOUBLE END, 1) END AS months FROM m""")
def followup_months(spark, d):
    return S.articles(spark, d).select("ord", extract.followup(F.coalesce("abstract", F.lit("")))["months"].alias("months"))


_DIM = S.values(L.DESIGN_DIM, "design string, base double, layer string, cebm string, grade string, toolkit string")


@query(f"""SELECT r.row_key, d.layer, d.cebm, d.grade, d.toolkit, round(s, 1) AS score, CASE WHEN s >= 4 THEN '强' WHEN s >= 2.5 THEN '中' ELSE '弱' END AS strength FROM
 (SELECT row_key, design, base + CASE WHEN n >= 1000 THEN 1 WHEN n >= 100 THEN 0.5 ELSE 0 END + CASE WHEN has_interval THEN 0.5 ELSE 0 END AS s FROM ({S.ROWS_SQL})) r LEFT JOIN ({_DIM}) d USING (design)""")
def evidence_strength(spark, d):
    r = S.rows(spark, d).drop("cebm").join(F.broadcast(extract.dimension(spark).drop("base")), "design", "left")
    s = extract.strength(F.col("base"), F.col("n"), F.col("has_interval"))
    return r.select("row_key", "layer", "cebm", "grade", "toolkit", s["score"].alias("score"), s["label"].alias("strength"))


_LOWS = f"x AS (SELECT ord, coalesce(abstract, '') AS a, lower(coalesce(title, '') || '. ' || coalesce(abstract, '')) AS low FROM ({_ART}))"


@query(f"WITH {_LOWS} SELECT ord, " + ", ".join(f"{hit('low', c)} AS {k}" for k, c in L.CUES.items()) + " FROM x")
def bias_cues(spark, d):
    low = F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("abstract", F.lit(""))))
    return S.articles(spark, d).select("ord", low.alias("low")).select("ord", *[(X.first_hit(F.col("low"), c) != "").alias(k) for k, c in L.CUES.items()])


def _flag_sql() -> str:
    """The rules over the cue, size, effect, design, polarity and follow-up twins; fixtures have no full text, and one has labels."""
    o, e = ORACLES, "e.HR || e.\"OR\" || e.RR || e.IRR"
    trial, syn, obs = "g.design = '随机对照试验'", "g.design IN ('系统评价 / Meta 分析', '临床指南 / 专家共识', '叙述性综述')", "g.design IN ('队列研究', '病例对照研究', '横断面研究', '病例报告 / 病例系列')"
    lost = " UNION ALL ".join(f"SELECT ord, unnest(regexp_extract_all(a, '{Q(p)}', 1)) AS v FROM x" for p in extract.ATTRITION)
    rule = {
        "n_unknown": "s.n IS NULL", "small_n": "s.n < 100", "basic": "g.design = '基础 / 动物实验'", "no_control_case": "g.design = '病例报告 / 病例系列'", "no_control_desc": f"{trial} AND NOT control", "single_arm": "single_arm",
        "retrospective": "retrospective", "cross_sectional": "g.design = '横断面研究'", "no_blinding": f"{trial} AND NOT blind", "self_report": "self_report", "no_itt": f"{trial} AND NOT itt", "no_power": f"{trial} AND NOT power",
        "industry_funding": "industry", "funding_unknown": "NOT industry AND NOT funding AND NOT coi", "posthoc_subgroup": f"NOT {syn} AND posthoc", "baseline_imbalance": "imbalance", "composite_outcome": "composite",
        "no_adjustment": "g.design IN ('队列研究', '病例对照研究') AND NOT adjustment", "high_attrition": "coalesce(l.v, 0) >= 20", "pilot": f"{trial} AND pilot", "no_precision": "e.ci = '' AND e.p = ''", "no_ci_point": f"e.ci = '' AND {e} <> ''",
        "no_registration": f"{trial} AND NOT regexp_matches(x.a, '{Q(bias.REGISTRY)}')", "no_heterogeneity": "g.design = '系统评价 / Meta 分析' AND NOT heterogeneity", "single_center": f"NOT {syn} AND NOT multicenter AND single_center",
        "center_unknown": f"NOT {syn} AND NOT multicenter AND NOT single_center", "surrogate": "NOT hard_outcome AND surrogate", "followup_unknown": "f.months IS NULL", "short_followup": "f.months < 6",
        "causal_claim": f"{obs} AND known AND causal", "no_effect_size": f"known AND {e} = '' AND e.ci = '' AND e.p = ''"}
    arms = " UNION ALL ".join(f"SELECT ord, '{k}' AS key FROM j WHERE {c.replace('s.n', 'n').replace('g.design', 'design').replace('e.', '').replace('l.v', 'v').replace('x.a', 'a').replace('f.months', 'months')}" for k, c in rule.items())
    return f"""WITH {_LOWS}, lost AS ({lost}), j AS (SELECT x.a, c.*, pp.polarity <> '{L.UNCLEAR}' AS known, s.n, e.HR, e."OR", e.RR, e.IRR, e.ci, e.p, g.design, f.months, l.v FROM x JOIN ({o['bias_cues']}) c USING (ord) JOIN ({o['sample_size']}) s USING (ord) JOIN ({o['effects']}) e USING (ord)
 JOIN ({o['design']}) g USING (ord) JOIN ({o['followup_months']}) f USING (ord) JOIN ({o['polarity']}) pp USING (ord) LEFT JOIN (SELECT ord, max(v::DOUBLE) AS v FROM lost GROUP BY ord) l USING (ord) WHERE trim(x.a) <> '')
 SELECT ord, 'no_abstract' AS key FROM x WHERE trim(a) = '' UNION ALL {arms}"""


@query(_flag_sql())
def bias_flags(spark, d):
    p = extract.profile(S.articles(spark, d))
    return p.select("ord", F.explode_outer("flags").alias("f")).select("ord", "f.key")


@query()
def profiles(spark, d):
    p = extract.profile(S.articles(spark, d))
    return p.select("ord", "design", "n", "population", "intervention", "primary_outcome", "effects_text", "conclusion", "polarity", "polarity_cue", "bias_label", "bias_brief", "evidence.label", "setting", "source_label")


@query()
def comparison_table(spark, d):
    return compare.comparison(extract.profile(S.articles(spark, d)))


_LABELS = ", ".join(f"('{k}', '{label}', '{level}')" for k, label, level in L.FLAGS)


@query(f"""WITH f AS ({_flag_sql()}), l AS (SELECT * FROM (VALUES {_LABELS}) v(key, label, level)), c AS (SELECT count(DISTINCT ord) AS docs_with_focus FROM f JOIN l USING (key) WHERE level = '{L.FOCUS}')
 SELECT label, count(*) AS n, any_value(docs_with_focus) AS docs_with_focus FROM f JOIN l USING (key), c GROUP BY label""")
def bias_overview(spark, d):
    return bias.overview(extract.profile(S.articles(spark, d)))


# --- across articles ---------------------------------------------------------------

_ROWS = S.ROWS_SQL


def _rows(spark, d):
    return S.rows(spark, d)


@query(f"""SELECT CASE WHEN design IS NOT NULL THEN 'design' WHEN polarity IS NOT NULL THEN 'polarity' ELSE 'cebm' END AS dimension, coalesce(design, polarity, cebm) AS value, count(*) AS n FROM ({_ROWS}) GROUP BY GROUPING SETS ((design), (polarity), (cebm))""")
def summary_stats(spark, d):
    return compare.summary(_rows(spark, d))


@query(f"""SELECT count(*) AS total, min(y) AS year_from, max(y) AS year_to, coalesce(sum(n), 0)::BIGINT AS n_total, count(*) FILTER (WHERE n IS NULL) AS n_missing, count(*) FILTER (WHERE coalesce(pmcid, '') <> '') AS with_fulltext
 FROM (SELECT *, TRY_CAST(left(year, 4) AS INT) AS y FROM ({_ROWS}))""")
def summary_totals(spark, d):
    return compare.totals(_rows(spark, d))


@query(f"""SELECT row_key, (CASE WHEN design <> '未识别' THEN 1 ELSE 0 END + CASE WHEN n IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN population <> '' THEN 1 ELSE 0 END + CASE WHEN primary_outcome <> '' THEN 1 ELSE 0 END
 + CASE WHEN effects_text <> '' THEN 1 ELSE 0 END + CASE WHEN conclusion <> '' THEN 1 ELSE 0 END)::INT AS filled FROM ({_ROWS})""")
def completeness(spark, d):
    return compare.completeness(_rows(spark, d)).select("row_key", "filled")


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE design <> '未识别') AS recognized, count(*) FILTER (WHERE design <> '未识别') * 100.0::DOUBLE / count(*) AS rate FROM ({_ROWS})")
def design_report(spark, d):
    return compare.design_report(_rows(spark, d))


@query(f"""WITH c AS (SELECT row_key, max(value) FILTER (WHERE field = '样本量') AS n1, max(value) FILTER (WHERE field = '人群') AS p1, max(value) FILTER (WHERE field = '结论') AS c1 FROM ({S.values(S.CORRECTIONS, 'row_key string, field string, value string')}) GROUP BY row_key)
 SELECT row_key, CASE WHEN n1 IS NOT NULL THEN TRY_CAST(nullif(regexp_extract(n1, '\\d[\\d,]*'), '') AS BIGINT) ELSE n END AS n, coalesce(p1, population) AS population, coalesce(c1, conclusion) AS conclusion,
 CASE WHEN c1 IS NULL THEN polarity WHEN contains(lower(c1), 'no benefit') THEN '{L.NULL}' ELSE polarity END AS polarity FROM ({_ROWS}) LEFT JOIN c USING (row_key)""")
def corrections_applied(spark, d):
    none = F.array().cast("array<string>")
    r = _rows(spark, d).withColumn("effects", F.struct(*[none.alias(k) for k in ("HR", "OR", "RR", "IRR", "CI", "P", "MD")]))
    return compare.correct(r, S.frame(spark, S.CORRECTIONS, "row_key string, field string, value string")).select("row_key", "n", "population", "conclusion", "polarity")


def _conflict_sql() -> str:
    pol = {"good": f"polarity = '{L.POSITIVE}'", "nul": f"polarity = '{L.NULL}'", "harm": f"polarity = '{L.HARM}'", "down": "direction < 0", "up": "direction > 0"}
    aggs = ", ".join(f"coalesce(list(DISTINCT row_key) FILTER (WHERE {c}), []) AS {k}" for k, c in pol.items())
    return f"""WITH r AS (SELECT *, lower(title || ' ' || conclusion) AS doc FROM ({_ROWS})), t AS ({S.values(S.TERMS, 'term string')}), h AS (SELECT * FROM r JOIN t ON regexp_matches(doc, term || '($|[^\\p{{L}}])')),
 g AS (SELECT term, {aggs}, count(*) AS docs FROM h GROUP BY term HAVING count(*) >= 2),
 b AS (SELECT '结论极性' AS type, term, CASE WHEN len(good) > 0 THEN '高' ELSE '中' END AS confidence, list_sort(list_distinct(good || nul || harm)) AS studies FROM g WHERE (len(good) > 0)::INT + (len(nul) > 0)::INT + (len(harm) > 0)::INT >= 2
  UNION ALL SELECT '效应方向', term, '高', list_sort(list_distinct(down || up)) FROM g WHERE len(down) > 0 AND len(up) > 0)
 SELECT type, term, confidence, len(studies)::INT AS count, array_to_string(studies, ',') AS studies FROM b a WHERE NOT EXISTS (SELECT 1 FROM b c WHERE c.type = a.type AND list_has_all(c.studies, a.studies) AND (len(c.studies) > len(a.studies) OR (len(c.studies) = len(a.studies) AND c.term < a.term)))"""


@query(_conflict_sql())
def conflicts_by_term(spark, d):
    return compare.conflicts(_rows(spark, d), S.frame(spark, S.TERMS, "term string")).withColumn("studies", F.array_join("studies", ","))


@query(f"""WITH p AS (SELECT coalesce(total_hits, 0) AS identified, coalesce(retrieved, 0) AS retrieved, coalesce(duplicates, 0) AS duplicates, coalesce(excluded_screening, 0) AS excluded_screening, coalesce(excluded_fulltext, 0) AS excluded_fulltext FROM ({S.PRISMA_SQL})),
 s AS (SELECT *, greatest(retrieved - duplicates, 0) AS screened FROM p), a AS (SELECT *, greatest(screened - excluded_screening, 0) AS assessed FROM s)
 SELECT identified, retrieved, duplicates, screened, excluded_screening, assessed, excluded_fulltext, greatest(assessed - excluded_fulltext, 0) AS included, greatest(identified - retrieved, 0) AS unretrieved FROM a""")
def prisma_flow(spark, d):
    return compare.prisma(S.prisma(spark, d))


@query(f"""WITH r AS (SELECT ord, list_filter(['p' || trim(coalesce(pmid, '')), 't' || left(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9一-鿿]', '', 'g'), 80)], lambda k: length(k) > 1) AS keys FROM ({_ART}))
 SELECT list_reduce([{{'k': NULL::VARCHAR[], 's': []::VARCHAR[], 'n': 0}}] || list({{'k': keys, 's': []::VARCHAR[], 'n': 0}} ORDER BY ord), lambda a, x: CASE WHEN list_has_any(a.s, x.k) THEN {{'k': x.k, 's': a.s, 'n': a.n + 1}} ELSE {{'k': x.k, 's': a.s || x.k, 'n': a.n}} END).n AS n FROM r""")
def duplicate_count(spark, d):
    return compare.duplicates(S.articles(spark, d))


# --- vocabulary -----------------------------------------------------------------------

@query(f"""WITH x AS (SELECT id, trim(keyword) AS k, trim(coalesce(secondary, '')) AS s, CASE WHEN logic IN ('AND', 'OR', 'NOT') THEN logic ELSE 'AND' END AS op, trim(coalesce(author, '')) AS a, trim(coalesce(journal, '')) AS j, trim(coalesce(country, '')) AS c, trim(coalesce(start_date, '')) AS d1, trim(coalesce(end_date, '')) AS d2 FROM ({S.SEARCHES_SQL})),
 y AS (SELECT *, list_transform(list_filter(list_transform(string_split_regex(s, '[,，;；]'), lambda t: trim(t)), lambda t: t <> ''), lambda t: CASE WHEN contains(t, ' ') THEN '"' || t || '"' ELSE t END) AS ts FROM x),
 w AS (SELECT *, CASE WHEN s = '' THEN k ELSE '(' || k || ') ' || op || ' (' || CASE WHEN op = 'AND' THEN array_to_string(ts, ' AND ') ELSE array_to_string(ts, ' OR ') END || ')' END AS q,
  list_filter([CASE WHEN a <> '' THEN a || '[Author]' END, CASE WHEN j <> '' THEN CASE WHEN contains(j, ' ') THEN '"' || j || '"' ELSE j END || '[Journal]' END, CASE WHEN c <> '' THEN c || '[Affiliation]' END, CASE WHEN d1 <> '' AND d2 <> '' THEN d1 || ':' || d2 || '[Date - Publication]' END], lambda f: f IS NOT NULL) AS fs FROM y)
 SELECT id, CASE WHEN len(fs) = 0 THEN q ELSE CASE WHEN s <> '' THEN '(' || q || ')' ELSE q END || ' AND ' || array_to_string(fs, ' AND ') END AS query FROM w""")
def query_build(spark, d):
    return S.searches(spark, d).select("id", vocab.build_query().alias("query"))


_KEY = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"


@query(f"""WITH v AS (SELECT *, CASE WHEN {_KEY.format('heading')} = {_KEY.format('term')} THEN 0 WHEN list_contains(list_transform(entry_terms[2:], lambda x: {_KEY.format('x')}), {_KEY.format('term')}) THEN 1 END AS tier FROM ({S.VOCAB_SQL}) WHERE type <> 'qualifier'),
 b AS (SELECT term, ui, heading, CASE tier WHEN 0 THEN 'heading' ELSE 'entry_term' END AS matched_by FROM v WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY term ORDER BY tier, ord) = 1)
 SELECT t.term, b.ui, b.heading, b.matched_by FROM ({S.LOOKUPS_SQL}) t LEFT JOIN b USING (term) WHERE length(trim(t.term)) >= 2""")
def vocab_lookup(spark, d):
    return vocab.lookup(S.lookups(spark, d), S.vocabulary(spark, d)).drop("entry_terms")


_FOUND = f"""v AS (SELECT *, CASE WHEN {_KEY.format('heading')} = {_KEY.format('term')} THEN 0 WHEN list_contains(list_transform(entry_terms[2:], lambda x: {_KEY.format('x')}), {_KEY.format('term')}) THEN 1 END AS tier FROM ({S.VOCAB_SQL}) WHERE type <> 'qualifier'),
 b AS (SELECT t.term, heading, entry_terms FROM ({S.LOOKUPS_SQL}) t LEFT JOIN (SELECT * FROM v WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY term ORDER BY tier, ord) = 1) USING (term) WHERE length(trim(t.term)) >= 2)"""


@query(f"""WITH {_FOUND}, e AS (SELECT term, heading, list_filter(coalesce(entry_terms, []), lambda x: length({_KEY.format('x')}) >= 3 AND {_KEY.format('x')} <> {_KEY.format('heading')}) AS ts FROM b),
 k AS (SELECT *, list_transform(ts, lambda x: {_KEY.format('x')}) AS ks FROM e), u AS (SELECT *, list_filter(ts, lambda x, i: list_position(ks, {_KEY.format('x')}) = i)[1:6] AS us FROM k),
 p AS (SELECT *, ['"' || heading || '"[MeSH Terms]'] || list_transform(us, lambda x: '"' || x || '"[tiab]') || CASE WHEN list_contains([{_KEY.format('heading')}] || ks, {_KEY.format('term')}) THEN [] ELSE [CASE WHEN contains(term, ' ') THEN '"' || term || '"' ELSE term END || '[tiab]'] END AS ps FROM u)
 SELECT term, CASE WHEN heading IS NULL THEN CASE WHEN contains(term, ' ') THEN '"' || term || '"' ELSE term END WHEN len(ps) > 1 THEN '(' || array_to_string(ps, ' OR ') || ')' ELSE ps[1] END AS expression FROM p""")
def concept_expressions(spark, d):
    found = vocab.lookup(S.lookups(spark, d), S.vocabulary(spark, d))
    return found.select("term", vocab.concept_expression().alias("expression"))


@query()
def concept_cover(spark, d):
    first = lambda c, n: F.array_join(F.slice(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)), 1, n), " ")
    k = S.frame(spark, [(1, "aspirin after heart attack in elderly"), (2, "the of"), (3, "diabetes")], "id int, keyword string").unionByName(t(spark, d, "documents").select((F.col("doc_id") + 10).cast("int").alias("id"), first(F.col("text"), 9).alias("keyword")))
    known = S.frame(spark, [("aspirin", "Aspirin"), ("heart attack", "Myocardial Infarction")], "term string, heading string")
    words = t(spark, d, "documents").select(F.explode(F.array(*[first(F.col("text"), n) for n in (2, 3)])).alias("term")).where("length(term) > 3").distinct()
    return vocab.split_concepts(k, known.unionByName(words.select("term", F.upper("term").alias("heading"))))


# --- citations ---------------------------------------------------------------------------

_G = lambda c: f"trim(coalesce({c}, ''))"
_NAME = "list_transform(list_filter(coalesce(authors, []), lambda a: trim(a) <> ''), lambda a: {})"
_PERSON = "regexp_full_match(a, '.* [A-Z]{1,4}')"
_FAM, _INI = "trim(regexp_extract(a, '^(.*) [A-Z]{1,4}$', 1))", "regexp_extract(a, ' ([A-Z]{1,4})$', 1)"
_COMMA = f"CASE WHEN {_PERSON} THEN {_FAM} || ', ' || {_INI} ELSE a END"
_Y = f"CASE WHEN regexp_extract({_G('year')}, '(1[89]\\d\\d|20\\d\\d)', 1) = '' THEN {_G('year')} ELSE regexp_extract({_G('year')}, '(1[89]\\d\\d|20\\d\\d)', 1) END"
_PG = f"replace({_G('pages')}, '--', '-')"
_ISS = f"{_G('volume')} || CASE WHEN {_G('issue')} <> '' THEN '(' || {_G('issue')} || ')' ELSE '' END"


def _ln(tag: str, v: str, after: str = "") -> str:
    return f"CASE WHEN {v} <> '' THEN '{tag}' || {v} || '{after}' END"


def _lines(parts: list[str], sep: str = "chr(10)") -> str:
    return f"concat_ws({sep}, {', '.join(parts)})"


def _each(tag: str, body: str) -> str:
    return f"nullif(array_to_string({_NAME.format(f'''{chr(39)}{tag}{chr(39)} || ({body})''')}, chr(10)), '')"


_RIS = _lines(["'TY  - JOUR'", _each("AU  - ", _COMMA), _ln("TI  - ", _G("title")), _ln("JO  - ", _G("journal")), _ln("SP  - ", f"trim(string_split({_PG}, '-')[1])"), _ln("EP  - ", f"CASE WHEN contains({_PG}, '-') THEN trim(regexp_extract({_PG}, '-(.*)$', 1)) ELSE '' END"),
              _ln("VL  - ", _G("volume")), _ln("IS  - ", _G("issue")), _ln("PY  - ", f"({_Y})"), _ln("SN  - ", _G("issn")), _ln("DO  - ", _G("doi")), _ln("AN  - ", _G("pmid")), _ln("UR  - ", _G("url")), _ln("LA  - ", _G("language")), "'ER  - '"])


@query(f"SELECT ord, {_RIS} AS text FROM ({_ART})")
def cite_ris(spark, d):
    return cite.ris(S.articles(spark, d))


_END = _lines(["'%0 Journal Article'", _each("%A ", _COMMA), _ln("%T ", _G("title")), _ln("%J ", _G("journal")), _ln("%D ", f"({_Y})"), _ln("%V ", _G("volume")), _ln("%N ", _G("issue")), _ln("%P ", _PG), _ln("%@ ", _G("issn")), _ln("%R ", _G("doi")), _ln("%U ", _G("url")), _ln("%M ", _G("pmid"))])


@query(f"SELECT ord, {_END} AS text FROM ({_ART})")
def cite_endnote(spark, d):
    return cite.endnote(S.articles(spark, d))


_MED = _lines([_ln("PMID- ", _G("pmid")), _each("AU  - ", f"CASE WHEN {_PERSON} THEN {_FAM} || ' ' || {_INI} ELSE a END"), "nullif(array_to_string(list_transform(list_filter(coalesce(pubtypes, []), lambda p: trim(p) <> ''), lambda p: 'PT  - ' || trim(p)), chr(10)), '')", _ln("TI  - ", _G("title")), _ln("JT  - ", _G("journal")),
              _ln("DP  - ", f"({_Y})"), _ln("VI  - ", _G("volume")), _ln("IP  - ", _G("issue")), _ln("PG  - ", _PG), _ln("IS  - ", _G("issn")), f"nullif(array_to_string(list_transform(list_filter(string_split({_G('abstract')}, chr(10)), lambda p: trim(p) <> ''), lambda p: 'AB  - ' || trim(p)), chr(10)), '')",
              _ln("LID - ", _G("doi"), " [doi]"), _ln("AID - ", _G("doi"), " [doi]"), _ln("AID - ", _G("pmcid"), " [pmc]")])


@query(f"SELECT ord, {_MED} AS text FROM ({_ART})")
def cite_medline(spark, d):
    return cite.medline(S.articles(spark, d))


_VN = _NAME.format(f"CASE WHEN {_PERSON} THEN {_FAM} || ' ' || {_INI} ELSE a END")
_FEW = lambda n, k: f"array_to_string(({n})[1:{k}], ', ') || CASE WHEN len({n}) > {k} THEN ', et al' ELSE '' END"
_VP = f"CASE WHEN ({_Y}) <> '' THEN CASE WHEN {_G('journal')} <> '' THEN {_G('journal')} || '. ' ELSE '' END || ({_Y}) || CASE WHEN ({_ISS}) <> '' THEN ';' || ({_ISS}) ELSE '' END || CASE WHEN {_PG} <> '' THEN ':' || {_PG} ELSE '' END || '.' WHEN {_G('journal')} <> '' THEN {_G('journal')} || '.' END"
_VAN = _lines([_ln("", f"({_FEW(_VN, 6)})", "."), _ln("", f"rtrim({_G('title')}, '.')", "."), _VP, _ln("doi:", _G("doi"), "."), _ln("PMID: ", _G("pmid"), ".")], "' '")


@query(f"SELECT ord, row_number() OVER (ORDER BY ord) || '. ' || {_VAN} AS text FROM ({_ART})")
def cite_vancouver(spark, d):
    return cite.vancouver(S.articles(spark, d))


_GN = _NAME.format(f"CASE WHEN {_PERSON} THEN upper({_FAM}) || ' ' || array_to_string(regexp_extract_all({_INI}, '[A-Z]'), ' ') ELSE upper(a) END")
_GT = f"concat_ws(', ', nullif({_G('journal')}, ''), nullif(({_Y}), ''), nullif(({_ISS}), ''))"
_GBT = _lines([_ln("", f"({_FEW(_GN, 3)})", "."), _ln("", f"rtrim({_G('title')}, '.')", "[J]."), f"CASE WHEN {_GT} <> '' THEN {_GT} || CASE WHEN {_PG} <> '' THEN ': ' || {_PG} ELSE '' END || '.' END", _ln("DOI:", _G("doi"), ".")], "' '")


@query(f"SELECT ord, '[' || row_number() OVER (ORDER BY ord) || '] ' || {_GBT} AS text FROM ({_ART})")
def cite_gbt7714(spark, d):
    return cite.gbt7714(S.articles(spark, d))


_FOLD = lambda c: f"regexp_replace(strip_accents(lower({c})), '[^a-z0-9]', '', 'g')"
_TEX = lambda c: "array_to_string(list_transform(string_split(" + c + ", ''), lambda ch: CASE ch " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in cite.TEX.items()) + " ELSE ch END), '')"
_BIB = lambda k, v: f"CASE WHEN ({v}) <> '' THEN '  {k:<7} = {{' || ({v}) || '}}' END"
_AUTHORS = "list_filter(coalesce(authors, []), lambda a: trim(a) <> '')"


@query(f"""WITH a AS (SELECT *, {_AUTHORS} AS names FROM ({_ART})), k AS (SELECT *, coalesce(nullif({_FOLD(f"coalesce(list_filter(list_transform(names, lambda a: CASE WHEN {_PERSON} THEN {_FAM} END), lambda f: f IS NOT NULL)[1], '')")}, ''),
  nullif({_FOLD("coalesce(names[1], '')")}, ''), CASE WHEN len(names) = 0 THEN nullif({_FOLD(_G('journal'))}, '') END, 'anon') || {_FOLD(f'({_Y})')}
  || coalesce(list_filter(list_transform(string_split_regex({_G('title')}, '[\\s:;,.\\-()\\[\\]/]+'), lambda w: {_FOLD('w')}), lambda w: length(w) >= 4 AND w NOT IN ({', '.join(f"'{w}'" for w in L.KEY_STOP)}))[1], '') AS base FROM a),
 n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY ord) - 1 AS nth FROM k)
 SELECT ord, '@article{{' || base || CASE WHEN nth > 0 THEN chr((96 + nth)::INT) ELSE '' END || ',' || chr(10) || concat_ws(',' || chr(10), {_BIB('author', f"array_to_string(list_transform(names, lambda a: CASE WHEN {_PERSON} THEN {_FAM} || ', ' || {_INI} ELSE '{{' || trim(a) || '}}' END), ' and ')")},
  CASE WHEN {_G('title')} <> '' THEN '  title   = {{{{' || {_TEX(_G('title'))} || '}}}}' END, {_BIB('journal', _TEX(_G('journal')))}, {_BIB('year', _TEX(f'({_Y})'))}, {_BIB('volume', _TEX(_G('volume')))}, {_BIB('number', _TEX(_G('issue')))}, {_BIB('pages', _TEX(_G('pages')))}, {_BIB('doi', _TEX(_G('doi')))}, {_BIB('issn', _TEX(_G('issn')))},
  {_BIB('url', _TEX(_G('url')))}, CASE WHEN {_G('pmid')} <> '' THEN '  note    = {{PMID: ' || {_TEX(_G('pmid'))} || '}}' END) || chr(10) || '}}' AS text FROM n""")
def cite_bibtex(spark, d):
    return cite.bibtex(S.articles(spark, d))


@query(f"""SELECT ord, array_to_string(list_filter([CASE WHEN len(coalesce(authors, [])) = 0 THEN '作者' END, CASE WHEN {_G('title')} = '' THEN '标题' END, CASE WHEN {_G('journal')} = '' THEN '期刊' END, CASE WHEN ({_Y}) = '' THEN '年份' END], lambda x: x IS NOT NULL), ',') AS missing FROM ({_ART})""")
def cite_missing(spark, d):
    return cite.complete(S.articles(spark, d)).select("ord", F.array_join(cite.missing(), ",").alias("missing"))


# --- library ---------------------------------------------------------------------------------

def _lib(spark, d):
    f = S.folders(spark, d)
    return f, library.normalise(S.meta(spark, d), f)


_NORM = f"""m AS (SELECT pmid, folder, tags, note FROM (SELECT pmid, CASE WHEN folder IN (SELECT id FROM ({S.FOLDERS_SQL})) THEN folder ELSE '' END AS folder, list_filter(list_transform(tags, lambda t: trim(t)), lambda t: t <> '') AS tags, coalesce(note, '') AS note FROM ({S.META_SQL}))
 WHERE folder <> '' OR len(tags) > 0 OR trim(note) <> '')"""


@query(f"WITH {_NORM}, t AS (SELECT pmid, unnest(tags) AS tag FROM m) SELECT arg_min(tag, pmid) AS tag, count(*) AS n FROM t GROUP BY lower(tag)")
def library_tags(spark, d):
    return library.all_tags(_lib(spark, d)[1])


@query(f"WITH {_NORM} SELECT id, name, count(pmid) AS n FROM ({S.FOLDERS_SQL}) f LEFT JOIN m ON m.folder = f.id GROUP BY id, name")
def library_folders(spark, d):
    return library.folder_counts(*_lib(spark, d))


@query(f"WITH {_NORM} SELECT a.pmid FROM ({_ART}) a JOIN m USING (pmid) WHERE m.folder = 'f1' AND list_contains(list_transform(m.tags, lambda t: lower(t)), 'rct') AND contains(lower(a.title || ' ' || array_to_string(a.authors, ' ')), 'lee')")
def library_filter(spark, d):
    f, m = _lib(spark, d)
    return library.filtered(S.articles(spark, d).select("pmid", "title", "authors"), m, f, "f1", ["RCT"], "Lee")


@query(f"""WITH {_NORM}, g AS (SELECT n.id AS in_id, coalesce(o.id, n.id) AS own FROM ({S.IN_FOLDERS_SQL}) n LEFT JOIN ({S.FOLDERS_SQL}) o ON lower(o.name) = lower(n.name)),
 i AS (SELECT pmid, coalesce(g.own, '') AS folder, tags, note FROM ({S.IN_META_SQL}) x LEFT JOIN g ON g.in_id = x.folder),
 b AS (SELECT coalesce(m.pmid, i.pmid) AS pmid, coalesce(nullif(i.folder, ''), m.folder, '') AS folder, coalesce(m.tags, []) || coalesce(i.tags, []) AS tags, coalesce(nullif(trim(coalesce(i.note, '')), ''), m.note, '') AS note FROM m FULL JOIN i ON m.pmid = i.pmid)
 SELECT pmid, folder, array_to_string(list_filter(tags, lambda t, k: list_position(list_transform(tags, lambda y: lower(y)), lower(t)) = k)[1:30], ',') AS tags, note FROM b""")
def library_import(spark, d):
    f, m = _lib(spark, d)
    return library.merge(f, m, S.in_folders(spark, d), S.in_meta(spark, d))[1].withColumn("tags", F.array_join("tags", ","))


# --- telemetry over events -----------------------------------------------------------------------

def _epoch():
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1e6D")


def _hits(spark, d):
    return t(spark, d, "events").select("ts", F.col("user_id").cast("string").alias("visitor"), F.col("event_type").alias("channel"))


_DAILY = "SELECT day, channel, count(*) AS n FROM (SELECT ts::DATE AS day, user_id, event_type AS channel FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_type) = 1) GROUP BY day, channel"


@query(_DAILY)
def daily_unique_by_channel(spark, d):
    return funnel.daily_uniques(_hits(spark, d))


@query(f"SELECT strftime(day, '%G-W%V') AS week, channel, sum(n)::BIGINT AS n FROM ({_DAILY}) GROUP BY ALL")
def weekly_by_channel(spark, d):
    return funnel.week_rollup(funnel.daily_uniques(_hits(spark, d)))


@query("""WITH e AS (SELECT ts::DATE AS day, event_type AS dep, value >= 5 AS ok, (SELECT max(ts)::DATE FROM events) AS last FROM events) SELECT dep, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS fail, round_even(count(*) FILTER (WHERE ok) * 100.0::DOUBLE / count(*), 1) AS rate FROM e WHERE day > last - 7 GROUP BY dep""")
def health_7d(spark, d):
    e = t(spark, d, "events").select("ts", F.col("event_type").alias("dep"), (F.col("value") >= 5).alias("ok"))
    last = e.agg(F.to_date(F.max("ts")).alias("last"))
    return telemetry.health(e.crossJoin(F.broadcast(last)), F.col("last"))


@query("SELECT count(*) AS requests, count(*) FILTER (WHERE value < 5) AS failed, round_even(avg(value), 1) AS mean_ms FROM events")
def http_totals(spark, d):
    return telemetry.totals(t(spark, d, "events").select((F.col("value") >= 5).alias("ok"), F.col("value").alias("ms")))


@query("""WITH c AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'search' ELSE 'fulltext' END AS kind, user_id || '-' || (event_id % 97) AS key, epoch(ts) AS t, event_id FROM events), l AS (SELECT kind, key, max(t) AS t FROM c GROUP BY ALL)
 SELECT kind, key, t FROM l QUALIFY row_number() OVER (PARTITION BY kind ORDER BY t DESC, key DESC) <= CASE kind WHEN 'search' THEN 150 ELSE 120 END""")
def cache_evict(spark, d):
    kind = F.when(F.col("event_id") % 2 == 0, "search").otherwise("fulltext")
    e = t(spark, d, "events").select(kind.alias("kind"), F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 97).cast("string")).alias("key"), F.lit("").alias("value"), _epoch().alias("t"))
    return telemetry.cache_evict(e).drop("value")


_ASKED = [("chars", "a", "2024-01-01 08:00:00", 1, 60, False), ("chars", "b", "2024-01-01 09:00:00", 2, 60, False), ("chars", "a", "2024-01-02 09:00:00", 3, 60, False), ("chars", "a", "2024-01-02 10:00:00", 4, 40, False),
          ("chars", "b", "2024-01-02 11:00:00", 5, 500, True), ("chars", "c", "2024-01-02 12:00:00", 6, 1, False), ("calls", "a", "2024-01-02 12:30:00", 7, 3, False), ("calls", "a", "2024-01-02 12:40:00", 8, 0, False),
          ("other", "a", "2024-01-02 13:00:00", 9, 9999, False), ("chars", "c", "2024-01-03 12:00:00", 10, 100, False), ("chars", "c", "2024-01-03 13:00:00", 11, 1, False), ("calls", "b", "2024-01-03 13:30:00", 12, 2, False)]
_ASKED_COLUMNS = "kind string, scope string, moment string, seq int, amount long, own_key boolean"


_KINDS = ["click", "view", "purchase", "signup", "error"]
_LIMITS = {"chars": (100, 100), "calls": (4, 4)} | {k: (50, 300) for k in _KINDS}
_ASKED_SQL = f"""{S.values(_ASKED, _ASKED_COLUMNS)} UNION ALL SELECT event_type, user_id::VARCHAR, ts::VARCHAR, event_id + 100, value::BIGINT, event_id % 13 = 0 FROM (SELECT * REPLACE (floor(value) AS value) FROM events)"""
_ADMITTED = f"""v AS ({_ASKED_SQL}), lim AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {s}, {d})" for k, (s, d) in _LIMITS.items())}) x(kind, s, d)),
 o AS MATERIALIZED (SELECT v.*, left(moment, 10) AS day, row_number() OVER (PARTITION BY kind ORDER BY moment, seq) AS n, lim.s, lim.d FROM v LEFT JOIN lim USING (kind)),
 w AS (SELECT kind, 0::BIGINT AS n, MAP {{}}::MAP(VARCHAR, BIGINT) AS taken, '' AS scope, -1 AS seq, false AS admitted FROM (SELECT DISTINCT kind FROM o)
  UNION ALL SELECT kind, n, CASE WHEN ok THEN map_concat(taken, MAP {{'s' || scope: a + amount, 'd' || day: b + amount}}) ELSE taken END, scope, seq, ok FROM (SELECT *, s IS NULL OR own_key OR amount <= 0 OR (a + amount <= s AND b + amount <= d) AS ok
   FROM (SELECT w.kind, o.n, w.taken, o.scope, o.day, o.amount, o.seq, o.s, o.d, o.own_key, coalesce(w.taken['s' || o.scope], 0) AS a, coalesce(w.taken['d' || o.day], 0) AS b FROM w JOIN o ON o.kind = w.kind AND o.n = w.n + 1)))"""


def _asked(spark, d):
    own = t(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("scope"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") + 100).cast("int").alias("seq"), F.floor("value").cast("long").alias("amount"), (F.col("event_id") % 13 == 0).alias("own_key"))
    return S.frame(spark, _ASKED, _ASKED_COLUMNS).withColumn("ts", F.to_timestamp("moment")).drop("moment").unionByName(own)


@query(f"WITH RECURSIVE {_ADMITTED} SELECT kind, seq, admitted FROM w WHERE n > 0")
def quota_admission(spark, d):
    return telemetry.quota_admission(_asked(spark, d), _LIMITS).select("kind", "seq", "admitted")


@query(f"WITH RECURSIVE {_ADMITTED} SELECT kind, scope, count(*) FILTER (WHERE admitted) AS admitted, count(*) AS requests FROM w WHERE n > 0 GROUP BY kind, scope")
def quota_admission_events(spark, d):
    return telemetry.quota_admission(_asked(spark, d), _LIMITS).groupBy("kind", "scope").agg(F.count_if("admitted").alias("admitted"), F.count(F.lit(1)).alias("requests"))


@query("""WITH e AS (SELECT event_type AS host, epoch(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS n FROM events), r AS (SELECT host, t, n, max(t - n * 600.0::DOUBLE) OVER (PARTITION BY host ORDER BY n) + n * 600.0::DOUBLE AS r FROM e) SELECT host, count(*) AS calls, count(*) FILTER (WHERE r - t > 1e-3) AS delayed FROM r GROUP BY host""")
def throttle_delays(spark, d):
    e = t(spark, d, "events").select(F.col("event_type").alias("host"), _epoch().alias("t"))
    r = telemetry.releases(e, 600.0)
    return r.groupBy("host").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("release") - F.col("t") > 1e-3).alias("delayed"))


@query("""SELECT attempt, retry_after, CASE WHEN retry_after > 0 THEN least(retry_after, 8.0::DOUBLE) ELSE least(pow(2, attempt), 8.0::DOUBLE) END AS seconds, count(*) AS n
 FROM (SELECT range::INT AS attempt, retry_after FROM range(5), (VALUES (0.0::DOUBLE), (3.0), (20.0)) v(retry_after) UNION ALL SELECT (event_id % 6)::INT, CASE WHEN event_id % 4 = 0 THEN 0 ELSE value END FROM events) GROUP BY ALL""")
def backoff_schedule(spark, d):
    a = spark.range(5).select(F.col("id").cast("int").alias("attempt")).crossJoin(S.frame(spark, [(0.0,), (3.0,), (20.0,)], "retry_after double"))
    a = a.unionByName(t(spark, d, "events").select((F.col("event_id") % 6).cast("int").alias("attempt"), F.when(F.col("event_id") % 4 == 0, 0.0).otherwise(F.col("value")).alias("retry_after")))
    return a.select("attempt", "retry_after", telemetry.backoff(F.col("attempt"), F.col("retry_after")).alias("seconds")).groupBy("attempt", "retry_after", "seconds").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, count(*) AS uses, user_id % 4 AS prompts, CASE WHEN user_id % 11 = 0 OR user_id % 13 = 0 THEN false ELSE user_id % 4 < 3 AND count(*) >= 15 + 25 * (user_id % 4) END AS due FROM events GROUP BY user_id""")
def survey_due(spark, d):
    u = t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("uses"))
    prompts, muted, done = F.col("user_id") % 4, F.col("user_id") % 11 == 0, F.col("user_id") % 13 == 0
    return u.select("user_id", "uses", prompts.alias("prompts"), telemetry.should_prompt(F.col("uses"), prompts, muted, done).alias("due"))


_INT = lambda c: f"CASE WHEN trim({c}) IN ('', '-', '—', '?') THEN NULL ELSE TRY_CAST(trim({c}) AS DOUBLE)::BIGINT END"
_FW = f"""WITH c AS (SELECT week, nullif(sum(coalesce({_INT('impressions')}, 0)), 0)::BIGINT AS l1, nullif(sum(coalesce({_INT('landing_uv')}, 0)), 0)::BIGINT AS l2 FROM ({S.CHANNEL_SQL}) GROUP BY week),
 t AS (SELECT week, {_INT('joins')} AS l3, {_INT('active_next_week')} AS l4, {_INT('members_end')} AS members FROM ({S.TOTAL_SQL}))
 SELECT week, l1, l2, l3, l4, members, l2 / nullif(l1, 0) * 100.0::DOUBLE AS ctr, l3 / nullif(l2, 0) * 100.0::DOUBLE AS join_rate, l4 / nullif(l3, 0) * 100.0::DOUBLE AS retention, l3 / nullif(l1, 0) * 100.0::DOUBLE AS conversion FROM c FULL JOIN t USING (week)"""


@query(_FW)
def funnel_week(spark, d):
    return funnel.weeks(S.channel_rows(spark, d), S.total_rows(spark, d))


@query(f"""WITH w AS ({_FW}), s AS (SELECT coalesce(sum(l1), 0) AS a, coalesce(sum(l2), 0) AS b, coalesce(sum(l3), 0) AS c, coalesce(sum(l4), 0) AS d FROM w)
 SELECT coalesce(b / nullif(a, 0) * 100 < 0.5, false) AS low_ctr, coalesce(c / nullif(b, 0) * 100 < 3, false) AS low_join, coalesce(d / nullif(c, 0) * 100 < 10, false) AS low_retention, c < 30 AS small_sample FROM s""")
def funnel_diagnosis(spark, d):
    return funnel.diagnose(funnel.weeks(S.channel_rows(spark, d), S.total_rows(spark, d)))


# --- summaries, layout -----------------------------------------------------------------------------

@query()
def summaries(spark, d):
    return keywords.summaries(t(spark, d, "documents").select("doc_id", "text")).select("doc_id", "pos")


@query()
def keyword_picks(spark, d):
    return keywords.keywords(t(spark, d, "documents").select("doc_id", "text"), 20, "doc_id")


# --- relational shapes ---------------------------------------------------------------------------------

@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))""")
def order_counters(spark, d):
    return t(spark, d, "orders").groupingSets([["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2""")
def top_orders(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t(spark, d, "orders").withColumn("n", F.row_number().over(w)).where("n <= 2").select("o_custkey", "o_orderkey", "o_totalprice")


# --- overviews and bookkeeping -------------------------------------------------------

_GAPS = f"""SELECT row_key, unnest(list_filter(['研究设计', '样本量', '人群', '主要终点', '关键效应量', '结论'], lambda f: CASE f WHEN '研究设计' THEN coalesce(design, '未识别') = '未识别' WHEN '样本量' THEN n IS NULL
 WHEN '人群' THEN coalesce(population, '') = '' WHEN '主要终点' THEN coalesce(primary_outcome, '') = '' WHEN '关键效应量' THEN coalesce(effects_text, '') = '' ELSE coalesce(conclusion, '') = '' END)) AS field FROM ({_ROWS})"""


@query(f"SELECT field, count(*) AS n FROM ({_GAPS}) GROUP BY field")
def missing_fields_by_name(spark, d):
    return compare.missing_counts(_rows(spark, d))


@query(f"""WITH g AS ({_GAPS}), f AS (SELECT row_key, 6 - (SELECT count(*) FROM g WHERE g.row_key = r.row_key) AS filled FROM ({_ROWS}) r)
 SELECT count(*) AS total, round_even(avg(filled), 1) AS avg, count(*) FILTER (WHERE filled <= 3) AS low FROM f""")
def completeness_overview(spark, d):
    return compare.completeness_overview(_rows(spark, d))


@query("""WITH j AS (SELECT event_id AS id, CASE WHEN event_id % 50 = 0 THEN 'running' WHEN event_id % 7 = 0 THEN 'error' ELSE 'done' END AS status, epoch(ts) AS created FROM events)
 SELECT id, status FROM j WHERE status = 'running' UNION ALL (SELECT id, status FROM j WHERE status <> 'running' ORDER BY created DESC, id DESC LIMIT 30)""")
def jobs_kept(spark, d):
    status = F.when(F.col("event_id") % 50 == 0, "running").when(F.col("event_id") % 7 == 0, "error").otherwise("done")
    return services.kept_jobs(t(spark, d, "events").select(F.col("event_id").alias("id"), status.alias("status"), _epoch().alias("created"))).select("id", "status")


@query("""WITH e AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS dep, event_id % 10 <> 0 AS ok, ts::DATE AS d FROM events), m AS (SELECT max(d) AS last FROM e)
 SELECT dep, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS fail, round_even(count(*) FILTER (WHERE ok) * 100.0::DOUBLE / count(*), 1) AS rate FROM e, m WHERE d > last - 7 AND d <= last GROUP BY dep""")
def health_known_names(spark, d):
    e = t(spark, d, "events").select("ts", F.col("event_type").alias("dep"), (F.col("event_id") % 10 != 0).alias("ok"))
    last = e.agg(F.to_date(F.max("ts")).alias("last"))
    return telemetry.health(e.crossJoin(F.broadcast(last)), F.col("last"), known=["click", "view"])


from evispark.plans import derived  # noqa: E402, F401  it registers its own
