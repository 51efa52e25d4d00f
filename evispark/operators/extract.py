"""Structured extraction from articles, as staged projections.

An article has ``pmid, title, abstract`` strings and, optionally, ``pubtypes``
array<string>, ``abstract_sections`` map<string,string> and ``fulltext_sections``
array<struct<title,text>>. Columns that are not there count as null. Each step
adds columns that the next one reads, so that a pattern runs once a row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evispark.functions import lexicon as L
from evispark.functions import text as X

SECTION = T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))
OPTIONAL = {
    "pmid": "string", "title": "string", "journal": "string", "year": "string", "authors": "array<string>", "abstract": "string", "doi": "string", "pmcid": "string",
    "pubtypes": "array<string>", "abstract_sections": "map<string,string>", "fulltext_sections": "array<struct<title:string,text:string>>",
    "mesh": "array<struct<heading:string,major:boolean>>"}
KEYS = [*L.SECTIONS, "DISCUSSION", "LIMITATIONS"]
_ALIAS = {a: k for k, names in L.SECTIONS.items() for a in names}
_FT_ALIAS = {a: k for k, names in L.FULLTEXT_SECTIONS.items() for a in names}


def complete(articles: DataFrame) -> DataFrame:
    """The article columns, with nulls for those that are not there, and all others."""
    have = set(articles.columns)
    return articles.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in have})


# --- sections -----------------------------------------------------------------

def _label(c: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(X.squeeze(F.coalesce(c, F.lit(""))), "[:： ]+$", "")))


def section_keys(label: Column) -> Column:
    """Canonical sections of a label: the whole label's, or those of its known parts."""
    up, table = _label(label), X._map(_ALIAS)
    parts = F.split(up, r"\s*(?:,|/|&|\bAND\b|\bOR\b|和|与|及)\s*")
    known = F.filter(F.transform(parts, lambda p: F.try_element_at(table, F.trim(p))), lambda k: k.isNotNull())
    whole = F.try_element_at(table, up)
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.array_distinct(known))


def fulltext_keys(title: Column) -> Column:
    bare = F.regexp_replace(X.squeeze(F.coalesce(title, F.lit(""))), r"^\s*(?:\d+(?:\.\d+)*|[IVXLC]+)[.)、]?\s+", "")
    keys, extra = section_keys(bare), F.try_element_at(X._map(_FT_ALIAS), _label(bare))
    return F.when(F.size(keys) > 0, keys).when(extra.isNotNull(), F.array(extra)).otherwise(F.array().cast("array<string>"))


def _split_pattern() -> str:
    latin = sorted((a for a in _ALIAS if a.isascii()), key=len, reverse=True)
    one = "(?:" + "|".join(re.sub("[A-Z]", lambda m: f"[{m[0]}{m[0].lower()}]", a) for a in latin) + ")"
    sep = r"(?:\s*,\s*(?:[Aa][Nn][Dd]\s+)?|\s*[/&]\s*|\s+[Aa][Nn][Dd]\s+|\s+[Oo][Rr]\s+)"
    zh = "|".join(sorted((a for a in _ALIAS if not a.isascii()), key=len, reverse=True))
    return rf"(?:(?<=\n)|^|(?<=[.。；;]\s))[ \t*]*((?=[A-Z]){one}(?:{sep}{one})*)\s*[:：]\s*|[ \t*]*({zh})\s*[:：]\s*"


def text_sections(abstract: Column) -> Column:
    """Array of ``(keys, text)`` of a text with two labels or more; else empty."""
    text = F.coalesce(abstract, F.lit(""))
    marked = F.regexp_replace(text, _split_pattern(), "\u0001$1$2\u0002")
    pieces = F.filter(F.split(marked, "\u0001"), lambda p: F.contains(p, F.lit("\u0002")))
    parsed = lambda ps: F.transform(ps, lambda p: F.struct(section_keys(F.split_part(p, F.lit("\u0002"), F.lit(1))).alias("keys"), F.trim(F.regexp_replace(F.split_part(p, F.lit("\u0002"), F.lit(2)), r"^[ \t\n*]+|[ \t\n*]+$", "")).alias("text")))
    none = F.array().cast("array<struct<keys:array<string>,text:string>>")
    colon = F.contains(text, F.lit(":")) | F.contains(text, F.lit("："))
    found = X.let(pieces, lambda ps: F.when(F.size(ps) >= 2, F.filter(parsed(ps), lambda r: r["text"] != "")).otherwise(none))
    return F.when(colon, found).otherwise(none)


def with_sections(articles: DataFrame) -> DataFrame:
    """Adds ``source`` text and label, and ``sec``: a struct with a text for each canonical section.

    Full text wins over labelled parts of the abstract, these over labels found in
    its text; what repeats in one source is joined.
    """
    a = complete(articles)
    full = F.filter(F.coalesce("fulltext_sections", F.array().cast(SECTION)), lambda s: X.filled(s["text"]))
    a = a.withColumn("_full", full).withColumn("has_fulltext", F.size("_full") > 0)
    a = a.withColumn("fulltext", F.array_join(F.transform("_full", lambda s: F.trim(s["text"])), "\n"))
    a = a.withColumn("source", F.when(F.col("has_fulltext"), F.col("fulltext")).otherwise(F.coalesce("abstract", F.lit(""))))
    a = a.withColumn("source_label", F.when(F.col("has_fulltext"), "全文").when(X.filled(F.col("abstract")), "摘要").otherwise("无"))
    entries = F.coalesce(F.map_entries("abstract_sections"), F.array().cast("array<struct<key:string,value:string>>"))
    a = a.withColumn("_f", F.transform("_full", lambda s: F.struct(fulltext_keys(s["title"]).alias("keys"), F.trim(s["text"]).alias("text"))))
    a = a.withColumn("_l", F.transform(F.filter(entries, lambda e: X.filled(e["value"])), lambda e: F.struct(section_keys(e["key"]).alias("keys"), F.trim(e["value"]).alias("text"))))
    a = a.withColumn("_t", text_sections(F.col("abstract")))

    def of(col: str, key: str) -> Column:
        return F.nullif(F.array_join(F.transform(F.filter(col, lambda r: F.array_contains(r["keys"], key)), lambda r: r["text"]), " "), F.lit(""))

    sec = F.struct(*[F.coalesce(of("_f", k), of("_l", k), of("_t", k)).alias(k) for k in KEYS])
    return a.withColumn("sec", sec).drop("_full", "_f", "_l", "_t")


# --- sample size, effects -----------------------------------------------------

#: Fixed patterns of sample sizes; the tight ones are for full texts.
SIZE_PATTERNS = [
    r"\b[Nn]\s*=\s*(\d[\d,]{1,})", r"\b(\d[\d,]{1,})\s+(?:patients|participants|subjects|individuals|adults|children|neonates|infants|cases|records|people|women|men|pregnancies|eyes|lesions|samples|pairs|centers|centres)\b",
    r"\b(?:total of|enrolled|included|analyzed|analysed|recruited|randomized|randomised)\s+(\d[\d,]{1,})",
    r"共\s*(?:纳入|收集|分析)?\s*(\d[\d,]{1,})\s*(?:例|名|位|篇)",
    r"(?i)\b(\d[\d,]{2,})\s+(?:[a-z][a-z-]*\s+){0,3}(?:patients|participants|subjects|individuals|adults|children|women|men|persons|people|neonates|infants)\b"]
TIGHT_SIZES = [
    r"(?i)\b(?:total of|enrolled|included|analyzed|analysed|recruited|randomi[sz]ed|assigned|allocated|were\s+studied)\s+(\d[\d,]{1,})",
    r"\b[Nn]\s*=\s*(\d[\d,]{1,})", r"共\s*(?:纳入|收集|分析|随机|入选)\s*(\d[\d,]{1,})\s*(?:例|名|位|篇)"]


def largest_size(text: Column, patterns: list[str] | None = None) -> Column:
    """Largest number from 10 to 5,000,000 that any pattern finds; null without one."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(X.ascii_bounds(p)), F.lit(1)) for p in patterns or SIZE_PATTERNS])
    n = F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("long"))
    return F.array_max(F.filter(n, lambda x: x.between(10, 5_000_000)))


def sample_size() -> Column:
    seg = F.concat_ws(" ", *[F.col("sec")[k] for k in ("METHODS", "PATIENTS", "BACKGROUND", "RESULTS")])
    seg = F.nullif(F.trim(seg), F.lit(""))
    tight = F.when(F.col("has_fulltext"), largest_size(F.coalesce(seg, F.col("source")), TIGHT_SIZES))
    return F.coalesce(tight, largest_size(seg), largest_size(F.col("source")))


#: Fixed patterns of effect sizes.
RATIOS = {
    "HR": r"(?i)\b(?:aHR|HR|hazard ratio)\s*[=:]?\s*(\d+(?:\.\d+)?)",
    "OR": r"(?i)\b(?:aOR|OR|odds ratio)\s*[=:]?\s*(\d+(?:\.\d+)?)",
    "RR": r"(?i)\b(?:aRR|RR|risk ratio|relative risk)\s*[=:]?\s*(\d+(?:\.\d+)?)",
    "IRR": r"(?i)\b(?:IRR)\s*[=:]?\s*(\d+(?:\.\d+)?)"}
INTERVAL = r"(?i)95%\s*(?:CI|confidence interval)\s*[:：]?\s*([0-9][0-9.,\-–—\s]{2,28})"
P_VALUE = r"\b[Pp]\s*(?:<|>|=|≤|≥)\s*0?\.\d+"
DIFFERENCE = r"(?i)\b(?:WMD|SMD|MD)\s*[=:]?\s*[-−]?\s*\d+(?:\.\d+)?"


def effects(text: Column) -> Column:
    """Struct of arrays HR, OR, RR, IRR, CI, P, MD."""
    return X.let(F.coalesce(text, F.lit("")), _effects)


def _effects(t: Column) -> Column:
    all_ = lambda p, g: F.regexp_extract_all(t, F.lit(X.ascii_bounds(p)), F.lit(g))
    ci = F.filter(F.slice(F.transform(all_(INTERVAL, 1), lambda c: F.regexp_replace(c, r"^[ ,;，；]+|[ ,;，；]+$", "")), 1, 6), lambda c: c != "")
    return F.struct(*[F.array_distinct(all_(p, 1)).alias(k) for k, p in RATIOS.items()], F.transform(ci, lambda c: F.concat(F.lit("95% CI "), c)).alias("CI"),
                    F.slice(all_(P_VALUE, 0), 1, 6).alias("P"), F.slice(all_(DIFFERENCE, 0), 1, 4).alias("MD"))


def effect_text(e: Column) -> Column:
    parts = [F.when(F.size(e[k]) > 0, F.concat(F.lit(k + " "), F.array_join(F.slice(e[k], 1, 2), "/"))) for k in ("HR", "OR", "RR", "IRR", "MD")]
    return F.concat_ws("；", *parts, F.get(e["CI"], F.lit(0)), F.replace(F.get(e["P"], F.lit(0)), F.lit(" "), F.lit("")))


def effect_direction(e: Column) -> Column:
    first = F.get(F.concat(e["HR"], e["OR"], e["RR"], e["IRR"]), F.lit(0)).try_cast("double")
    return F.coalesce(F.when(F.abs(first - 1) < 1e-9, 0).when(first < 1, -1).otherwise(F.when(first > 1, 1)), F.lit(0))


def effect_snippet(text: Column) -> Column:
    any_ = X.ascii_bounds("|".join(p.replace("(?i)", "") for p in RATIOS.values()))
    return X.snippet(F.get(F.filter(X.sentences(text), lambda s: s.rlike("(?i)" + any_)), F.lit(0)), 220)


# --- conclusion, polarity -----------------------------------------------------

def strip_label(c: Column) -> Column:
    label = F.regexp_extract(c, r"^\s*([A-Z][A-Za-z0-9 \-,/&]{2,45}|[一-鿿]{2,8})\s*[:：]\s*", 1)
    rest = F.trim(F.regexp_replace(c, r"^\s*(?:[A-Z][A-Za-z0-9 \-,/&]{2,45}|[一-鿿]{2,8})\s*[:：]\s*", ""))
    return F.when((label != "") & (F.size(section_keys(label)) > 0), rest).otherwise(F.trim(c))


def conclusion(sentences: Column | None = None) -> Column:
    """Struct ``(text, origin)``: the section, a labelled line, or the last two of the ``sentences`` of the source."""
    lines = F.transform(F.split(F.col("source"), "\n"), lambda x: F.regexp_extract(F.trim(x), r"(?is)^\s*(?:conclusions?|结论)\s*[:：]\s*(.+)$", 1))
    line = F.get(F.filter(lines, lambda x: x != ""), F.lit(0))
    noise = r"(?i)^(trial registration|funding|registration|clinicaltrials\.gov|copyright|©|conflict of interest|keywords|研究注册|注册号)"
    fit = F.filter(X.sentences(F.col("source")) if sentences is None else sentences, lambda s: (F.length(s) >= 20) & ~s.rlike(noise))
    tail = X.let(fit, lambda f: F.slice(f, F.greatest(F.size(f) - 1, F.lit(1)), 2))
    short = F.struct(F.lit("").alias("text"), F.lit("摘要过短").alias("origin"))
    last = lambda x: F.when(F.size(x) == 0, short).otherwise(F.struct(X.snippet(strip_label(F.array_join(x, " ")), 900).alias("text"), F.lit("摘要末句（无结构化标签）").alias("origin")))
    named = F.coalesce(F.col("sec")["CONCLUSIONS"], line)
    return (F.when(~X.filled(F.col("source")), F.struct(F.lit("").alias("text"), F.lit("无摘要").alias("origin")))
            .when(named.isNotNull(), F.struct(X.snippet(named, 900).alias("text"), F.lit("结构化结论段").alias("origin")))
            .otherwise(X.let(tail, last)))


def cue(low: Column, cues: list[str]) -> Column:
    """First cue of a list that stands somewhere without a negator shortly before it; null if none does.

    Text before each place of a cue is what ``split`` leaves; no cue overlaps itself.
    """
    negated = r"(?:" + "|".join(L.NEGATORS) + r")\s*$"

    def alone(c):
        parts = F.split(low, F.concat(F.lit(r"\Q"), c, F.lit(r"\E")))
        heads = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(c, p)))
        return F.exists(F.slice(heads, 1, F.size(parts) - 1), lambda h: ~F.right(h, F.lit(L.NEGATION_REACH)).rlike(negated))

    there = F.filter(X.lits(cues), lambda c: F.contains(low, c))
    return F.get(F.filter(there, alone), F.lit(0))


def polarity(text: Column, direction: Column | None = None) -> Column:
    """Struct ``(label, cue)``: null wording before harm before benefit; then, if given, the effect's direction."""
    return X.let(F.lower(F.coalesce(text, F.lit(""))), lambda low: _polarity(low, direction))


def _polarity(low: Column, direction: Column | None) -> Column:
    null, harm, good = cue(low, L.NULL_CUES), cue(low, L.HARM_CUES), cue(low, L.POSITIVE_CUES)
    pair = lambda a, b: F.struct(F.lit(a).alias("label"), b.alias("cue"))
    out = F.when(null.isNotNull(), pair(L.NULL, null)).when(harm.isNotNull(), pair(L.HARM, harm)).when(good.isNotNull(), pair(L.POSITIVE, good))
    if direction is not None:
        adverse = F.exists(X.lits(L.ADVERSE_CUES), lambda c: F.contains(low, c))
        out = out.when((direction == -1) & adverse, pair(L.POSITIVE, F.lit(L.FALLBACK_CUE)))
    return out.otherwise(pair(L.UNCLEAR, F.lit("")))


# --- design, population, intervention, outcome, follow-up ------------------------

def design() -> Column:
    """Struct ``(label, evidence)``: publication type by rule order, then each cue of each rule in title, abstract, full text."""
    title = F.coalesce("title", F.lit(""))
    low_abs, low_full = F.lower(F.concat_ws(" ", title, F.coalesce("abstract", F.lit("")))), F.when(F.col("has_fulltext"), F.lower(F.concat_ws(" ", title, F.col("fulltext"))))
    return X.let(F.struct(F.lower(title).alias("title"), low_abs.alias("abstract"), low_full.alias("full")), _design)


def _design(text: Column) -> Column:
    low, low_title, low_abs, low_full = F.lower, text["title"], text["abstract"], text["full"]
    types = F.filter(F.transform(F.coalesce("pubtypes", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda t: t != "")
    pair = lambda a, b: F.struct(F.lit(a).alias("label"), b.alias("evidence"))
    def first(a):
        return F.get(F.filter(a, lambda x: x.isNotNull()), F.lit(0))

    def of_types(names):
        return first(F.flatten(F.transform(X.lits(names), lambda n: F.transform(types, lambda t: F.when(F.startswith(low(t), n), t)))))

    def of_text(cues):
        place = lambda where, text, c: F.when(F.contains(text, c), F.concat(F.lit(f"{where}命中「"), c, F.lit("」")))
        return first(F.flatten(F.transform(X.lits(cues), lambda c: F.array(place("标题", low_title, c), place("摘要", low_abs, c), place("全文", low_full, c)))))

    rules = []
    for label, names in L.PUBTYPES.items():
        hit = of_types(names)
        rules.append(F.when(hit.isNotNull(), pair(label, F.concat(F.lit("PubMed 文献类型「"), hit, F.lit("」")))))
    for label, cues in L.DESIGN_CUES.items():
        hit = of_text(cues)
        rules.append(F.when(hit.isNotNull(), pair(label, hit)))
    return F.coalesce(*rules, pair(L.UNKNOWN_DESIGN, F.lit("标题与摘要中未见明确的研究设计表述")))


#: Columns of a design's row: score, layer, CEBM level, GRADE start, toolkit.
_DIMENSION = {"base": "double", "layer": "string", "cebm": "string", "grade": "string", "toolkit": "string"}


def dimension(spark) -> DataFrame:
    """The row of each design: score, layer, CEBM level, GRADE start, toolkit."""
    return spark.createDataFrame(L.DESIGN_DIM, "design string, " + ", ".join(f"{c} {t}" for c, t in _DIMENSION.items()))


def with_dimension(a: DataFrame) -> DataFrame:
    """Adds the row of each ``design``. It is looked up, not joined: where only articles are counted their design is not worked out."""
    rows = F.create_map(*[x for d, *v in L.DESIGN_DIM for x in (F.lit(d), F.struct(*[F.lit(y).cast(t).alias(c) for (c, t), y in zip(_DIMENSION.items(), v)]))])
    a = a.withColumn("_row", F.try_element_at(rows, F.col("design")))
    return a.withColumns({c: F.col("_row")[c] for c in _DIMENSION}).drop("_row")


def strength(base: Column, n: Column, has_interval: Column) -> Column:
    """Struct ``(score, label)`` of the evidence hint."""
    s = base + F.when(n >= 1000, 1.0).when(n >= 100, 0.5).otherwise(0.0) + F.when(has_interval, 0.5).otherwise(0.0)
    return F.struct(F.round(s, 1).alias("score"), F.when(s >= 4, "强").when(s >= 2.5, "中").otherwise("弱").alias("label"))


#: Fixed patterns of populations, interventions and outcomes.
_VERBS = r"(?i)\b(?:were\s+(?:randomly\s+)?(?:assigned|allocated|enrolled|included|recruited|analyz|analys|stratified|followed)|underwent|received|participated|were\s+included)\b"
_STRIP = r"^[ ,.;:（）()]+|[ ,.;:（）()]+$"
#: Fixed patterns of populations, the more definite first.
POPULATIONS = [
    r"(?i)\b(?:patients|adults|children|adolescents|women|men|participants|individuals|neonates|infants)\s+(?:with|who)\s+([A-Za-z0-9\-/ ,]{3,70})",
    r"(?i)\b((?:patients?|participants?|subjects?|individuals?|persons?|adults?|children|adolescents?|women|men)\s+(?:aged|older than|younger than)\s+[\d\s\-–]{1,12}(?:years?|岁)(?:\s*(?:or\s+(?:older|younger)|and\s+older|以上|及以上))?)",
    r"(?i)\b((?:community-dwelling|hospitalized|hospitalised|older|elderly|ambulatory|outpatient|inpatient|pregnant|obese|healthy|high-risk)\s+(?:adults?|patients?|participants?|subjects?|women|men|children|individuals?))\b",
    r"([一-鿿]{2,20}(?:患者|病人|受试者|志愿者|儿童|孕妇|老年人))"]
INTERVENTION = r"(?i)\b(?:treated with|received|were given|assigned to|compared|underwent|administered|intervention was)\s+([A-Za-z0-9\-/ ,%+]{3,60})"
PRIMARY = r"(?i)\bprimary\s+(?:\w+\s+){0,2}(?:outcome|end\s?point)s?\b|\bmain\s+(?:\w+\s+){0,2}(?:outcome|end\s?point)s?\b|主要(?:终点|结局|评价指标)"
OUTCOME_HINT = r"(?i)\b(?:composite (?:of|end\s?point|outcome)|primary efficacy|mace|major adverse cardiovascular events|all-cause mortality|cardiovascular death|efficacy outcome|hospitali[sz]ation for|recurrence of)\b|(?:复合终点|一级终点|全因死亡|心血管死亡)"


def _before(c: Column, pattern: str) -> Column:
    return F.get(F.split(c, pattern, 2), F.lit(0))


def trim_population(c: Column, limit: int = 60) -> Column:
    s = _before(_before(X.squeeze(c), r"(?<=[.;])\s"), _VERBS)
    s = F.regexp_replace(F.regexp_replace(s, r"^[\d,.\s]*", ""), _STRIP, "")
    return X.let(s, lambda x: F.when(F.length(x) >= 3, X.snippet(x, limit)))


def _fragment(c: Column) -> Column:
    s = F.regexp_replace(_before(_before(F.trim(c), r"[.;,]\s|\bwere\b|\bwas\b|\bis\b|\band\b\s+\d"), _VERBS), _STRIP, "")
    return X.let(s, lambda x: F.when(F.length(x) >= 3, X.snippet(x, 60)))


def population() -> Column:
    sec = F.col("sec")
    pool = F.nullif(F.trim(F.concat_ws(" ", sec["OBJECTIVE"], sec["METHODS"], sec["BACKGROUND"])), F.lit(""))
    whole = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("abstract", F.lit("")))
    # a pattern runs once on a text, though what it finds is named several times
    found = [X.let(F.regexp_extract(src, p, 1), lambda x: F.when(x != "", _fragment(x))) for p in POPULATIONS for src in (pool, whole)]
    return F.coalesce(trim_population(sec["PATIENTS"]), trim_population(sec["SETTING"]), *found, F.lit(""))


def intervention() -> Column:
    first = X.snippet(F.regexp_replace(_before(F.col("sec")["INTERVENTIONS"], r"(?<=[.;])\s"), _STRIP, ""), 60)
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.col("source"))
    return F.coalesce(F.when(F.col("sec")["INTERVENTIONS"].isNotNull(), F.nullif(first, F.lit(""))), X.let(F.regexp_extract(text, INTERVENTION, 1), lambda x: X.snippet(x, 50)))


def primary_outcome(sentences: Column | None = None) -> Column:
    seg = F.col("sec")["OUTCOMES"]
    first = F.when(seg.isNotNull(), F.nullif(X.snippet(strip_label(_before(seg, r"(?<=[.;])\s")), 200), F.lit("")))
    sents = X.sentences(F.col("source")) if sentences is None else sentences
    # sentences are passed over once for a pattern
    defined = lambda a: F.get(F.filter(a, lambda s: s.rlike(r"(?i)\b(?:was|were|is|are|defined\s+as)\b")), F.lit(0))
    best = X.let(F.filter(sents, lambda s: s.rlike(PRIMARY)), lambda a: F.coalesce(defined(a), F.get(a, F.lit(0))))
    hint = F.get(F.filter(sents, lambda s: s.rlike(OUTCOME_HINT)), F.lit(0))
    note = F.when(F.col("has_fulltext"), "（原文未标注主要终点）").otherwise("（摘要未标注主要终点）")
    named = X.let(best, lambda x: F.when(x.isNotNull(), X.snippet(strip_label(x), 200)))
    hinted = X.let(hint, lambda x: F.when(x.isNotNull(), F.concat(note, X.snippet(strip_label(x), 180))))
    return F.coalesce(first, named, hinted, F.lit(""))


#: Fixed patterns of follow-up times.
FOLLOW_EN = r"(?i)follow[- ]?up[^.;\n]{0,40}?(\d+(?:\.\d+)?)\s*(day|week|month|year|mo|yr)s?\b"
FOLLOW_ZH = r"随访[^。；\n]{0,25}?(\d+(?:\.\d+)?)\s*(天|周|个月|月|年)"


def followup(text: Column) -> Column:
    """Struct ``(text, months)`` of the first follow-up time; '' and null without one."""
    def one(p):
        # groups are taken from what was found, which the pattern finds whole again, not from the text
        return X.let(F.regexp_extract(text, p, 0), lambda x: of(x, p))

    def of(x, p):
        v, unit = F.regexp_extract(x, p, 1).try_cast("double"), F.lower(F.regexp_extract(x, p, 2))
        m = (F.when(unit.isin("month", "mo", "个月", "月"), v).when(unit.isin("year", "yr", "年"), v * 12)
             .when(unit.isin("week", "周"), v / 4.345).otherwise(v / 30.44))
        return F.when(v.isNotNull(), F.struct(X.snippet(x, 60).alias("text"), F.bround(m, 1).alias("months")))
    return F.coalesce(one(X.ascii_bounds(FOLLOW_EN)), one(FOLLOW_ZH), F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("months")))


def outcome_class(low: Column) -> Column:
    hard, surrogate = X.first_hit(low, L.CUES["hard_outcome"]), X.first_hit(low, L.CUES["surrogate"])
    pair = lambda a, b: F.struct(F.lit(a).alias("label"), b.alias("cue"))
    return F.when(hard != "", pair(L.HARD_OUTCOME, hard)).when(surrogate != "", pair(L.SURROGATE_OUTCOME, surrogate)).otherwise(pair(L.OUTCOME_UNCLEAR, F.lit("")))


#: Fixed patterns of shares lost to follow-up.
ATTRITION = [
    r"(?i)(?:lost to follow[- ]?up|loss to follow[- ]?up|withdrew|withdrawal|dropped out|discontinued|attrition|失访|退出|脱落)[^.;\n%]{0,40}?(\d+(?:\.\d+)?)\s*%",
    r"(?i)(\d+(?:\.\d+)?)\s*%[^.;\n]{0,30}?(?:lost to follow[- ]?up|withdrawn|withdrew|dropped out|discontinued|attrition|失访|退出|脱落)"]


def attrition(text: Column) -> Column:
    """Largest share lost to follow-up, in percent, in either order of words."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(1)) for p in ATTRITION])
    return F.array_max(F.filter(F.transform(found, lambda x: x.try_cast("double")), lambda x: (x > 0) & (x <= 100)))


def article_key() -> Column:
    return F.coalesce(F.nullif(F.trim("pmid"), F.lit("")), F.substring(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), "[^a-z0-9一-鿿]", ""), 1, 60))


def mesh_topics(limit: int = 6) -> Column:
    mesh = F.filter(F.coalesce("mesh", F.array().cast(OPTIONAL["mesh"])), lambda h: F.coalesce(h["heading"], F.lit("")) != "")
    names = F.transform(mesh, lambda h: h["heading"])
    major = F.transform(F.filter(mesh, lambda h: h["major"]), lambda h: h["heading"])
    more = F.when(F.size(major) > limit, F.concat(F.lit(" 等 "), F.size(major).cast("string"), F.lit(" 个"))).otherwise("")
    return (F.when(F.size(major) > 0, F.concat(F.lit("★"), F.array_join(F.slice(major, 1, limit), "、"), more))
            .when(F.size(names) > 0, F.concat(F.array_join(F.slice(names, 1, limit), "、"), F.lit("（全文主题词）"))).otherwise(""))


#: Fixed hints that a field is in the text though it was not extracted.
HINTS = {
    "样本量": r"\b\d[\d,]{2,}\b",
    "人群": r"(?i)\b(?:patients?|participants?|subjects?|adults?|children|adolescents?|elderly|women|men|male|female|cohort|population|cases?|individuals?|infants?|neonates?)\b|患者|受试者|人群|病例",
    "主要终点": r"(?i)\b(?:end\s?points?|outcomes?|mortality|survival|response\s+rate|remission|relapse|recurrence|incidence|hospitali[sz]ation|complications?|score|scale)\b|终点|结局|疗效",
    "关键效应量": r"\b(?:HR|OR|RR|IRR|aHR|MD|SMD|WMD)\b|(?i:95%\s*CI|confidence\s+interval|hazard\s+ratio|odds\s+ratio|risk\s+ratio|\bP\s*[<>=])",
    "结论": r"(?i)\bconclusions?\b|\bfindings?\b|\bwe\s+(?:conclude|concluded|found)\b|results?\s+(?:show|showed|suggest|suggested|indicate|indicated)|结论|结果提示",
}


def states(filled: dict[str, Column]) -> Column:
    """Map of each field to ok, no_abstract, not_extracted or not_mentioned."""
    src = F.trim(F.col("source"))
    pairs = []
    for k, ok in filled.items():
        pairs += [F.lit(k), F.when(ok, "ok").when(src == "", "no_abstract").when(src.rlike(HINTS[k]), "not_extracted").otherwise("not_mentioned")]
    return F.create_map(*pairs)


def profile(articles: DataFrame) -> DataFrame:
    """All derived fields of each article, in four projections over its columns."""
    from evispark.operators import bias

    a = with_sections(articles).withColumns({"_sentences": X.sentences(F.col("source")), "_low": F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.col("source")))})
    a = a.withColumns({"design": design(), "n": sample_size(), "conclusion": conclusion(F.col("_sentences")), "population": population(), "intervention": intervention(),
                       "primary_outcome": primary_outcome(F.col("_sentences")), "followup": followup(F.col("source")), "outcome": outcome_class(F.col("_low")),
                       "effects": effects(F.when(F.col("has_fulltext"), F.coalesce(F.col("sec")["RESULTS"], F.col("source"))).otherwise(F.col("abstract")))}).drop("_sentences", "_low")
    a = a.withColumns({"effects_text": effect_text(F.col("effects")), "direction": effect_direction(F.col("effects")), "row_key": article_key(), "mesh_topics": mesh_topics(),
                       "design_evidence": F.col("design")["evidence"], "design": F.col("design")["label"], "conclusion_origin": F.col("conclusion")["origin"], "conclusion": F.col("conclusion")["text"]})
    a = a.withColumns({"polarity": polarity(F.coalesce(F.nullif("conclusion", F.lit("")), F.col("abstract")), F.col("direction"))})
    a = a.withColumns({"polarity_cue": F.col("polarity")["cue"], "polarity": F.col("polarity")["label"]})
    a = with_dimension(a)
    has = (F.size(F.col("effects")["CI"]) > 0) | (F.size(F.col("effects")["P"]) > 0)
    a = a.withColumns({"evidence": strength(F.col("base"), F.col("n"), has), "states": states({
        "样本量": F.col("n").isNotNull(), "人群": F.col("population") != "", "主要终点": F.col("primary_outcome") != "", "关键效应量": F.col("effects_text") != "", "结论": F.col("conclusion") != ""})})
    return bias.with_bias(a)
