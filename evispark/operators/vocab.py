"""Search expressions and vocabulary expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import lexicon as L
from evispark.functions import text as X

CANDIDATES, ENTRY_TERMS, MOST_CHARS, LOOKUPS = 8, 6, 1400, 8
_QUALIFIER, _BOOLEAN = r"(?i)\[[a-z0-9 /_-]{2,30}\]", r"(?i)(?:^|\s)(?:AND|OR|NOT)(?:\s|$)"


def _t(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def _quoted(c: Column) -> Column:
    return F.when(F.contains(c, F.lit(" ")), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c)


def build_query() -> Column:
    """The search expression of ``keyword, secondary, logic, author, journal, country, start_date, end_date``."""
    sec = _t("secondary")
    op = F.when(F.col("logic").isin("AND", "OR", "NOT"), F.col("logic")).otherwise("AND")
    terms = F.transform(F.filter(F.transform(F.split(sec, "[,，;；]"), lambda x: F.trim(x)), lambda t: t != ""), _quoted)
    group = F.when(op == "AND", F.array_join(terms, " AND ")).otherwise(F.array_join(terms, " OR "))
    words = F.when(sec == "", _t("keyword")).otherwise(F.concat(F.lit("("), _t("keyword"), F.lit(") "), op, F.lit(" ("), group, F.lit(")")))
    some = lambda n, v: F.when(_t(n) != "", v)
    filters = F.filter(F.array(
        some("author", F.concat(_t("author"), F.lit("[Author]"))), some("journal", F.concat(_quoted(_t("journal")), F.lit("[Journal]"))), some("country", F.concat(_t("country"), F.lit("[Affiliation]"))),
        F.when((_t("start_date") != "") & (_t("end_date") != ""), F.concat(_t("start_date"), F.lit(":"), _t("end_date"), F.lit("[Date - Publication]")))), lambda f: f.isNotNull())
    whole = F.when(sec != "", F.concat(F.lit("("), words, F.lit(")"))).otherwise(words)
    return F.when(F.size(filters) == 0, words).otherwise(F.concat(whole, F.lit(" AND "), F.array_join(filters, " AND ")))


def journal_name(c: Column) -> Column:
    """A journal name as it is compared: no leading article, no last dots, ``and`` for ``&``."""
    s = F.trim(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\.+$", ""))
    return F.lower(X.squeeze(F.replace(F.regexp_replace(s, r"(?i)^the\s+", ""), F.lit("&"), F.lit("and"))))


def resolve_journals(names: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``name, resolved``: abbreviation of the equal title, else the first one's in the catalogue, else the name.

    ``catalogue`` has ``query, title, abbreviation, ord``: what a catalogue search gave for a name.
    """
    c = catalogue.withColumns({"k": journal_name(F.col("query")), "exact": journal_name(F.col("title")) == journal_name(F.col("query"))}).where(X.filled(F.col("abbreviation")))
    best = c.groupBy("k").agg(F.min(F.struct((~F.col("exact")).alias("r"), "ord", "abbreviation")).alias("b"))
    return names.withColumn("k", journal_name(F.col("name"))).join(best, "k", "left").select("name", F.coalesce("b.abbreviation", "name").alias("resolved"))


def key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", "")


def is_plain(c: Column) -> Column:
    k = F.trim(F.coalesce(c, F.lit("")))
    return (k != "") & ~k.rlike(_QUALIFIER) & ~k.rlike(_BOOLEAN) & ~k.rlike('["“”]')


def query_words(c: Column) -> Column:
    strip = r"^[ ,;:()（）\[\]\"'“”‘’]+|[ ,;:()（）\[\]\"'“”‘’]+$"
    words = F.transform(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, strip, ""))
    return F.filter(words, lambda w: (key(w) != "") & ~F.lower(w).isin(*L.MESH_STOP))


def clean_topic(c: Column) -> Column:
    """A topic as words: no field tags, quotes or upper-case operators."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"\[[^\]]*\]", " ")
    return X.squeeze(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, '["“”]', " "), r"\b(?:AND|OR|NOT)\b", " "), r"[(),;，；（）]+", " "))


def lookup(terms: DataFrame, records: DataFrame) -> DataFrame:
    """``term, ui, heading, entry_terms, matched_by``: an equal heading, else an equal entry term; nothing near.

    ``records`` has ``term, ord, ui, heading, entry_terms, type``, the candidates of
    a term in order. Qualifiers are no matches.
    """
    r = records.where((F.coalesce("type", F.lit("")) != "qualifier") & X.filled(F.col("heading")) & (F.col("ord") < CANDIDATES))
    want = key(F.col("term"))
    tier = F.when(key(F.col("heading")) == want, 0).when(F.exists(F.slice("entry_terms", 2, 1000), lambda t: key(t) == want), 1)
    r = r.withColumn("tier", tier).where("tier is not null")
    best = Window.partitionBy("term").orderBy("tier", "ord")
    r = r.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("term", "ui", "heading", "entry_terms", F.when(F.col("tier") == 0, "heading").otherwise("entry_term").alias("matched_by"))
    return terms.select("term").where(F.length(F.trim("term")) >= 2).join(r, "term", "left")


def entry_terms() -> Column:
    """Entry terms that add something: other keys than the heading's, three characters, at most six."""
    pairs = F.filter(F.coalesce("entry_terms", F.array().cast("array<string>")), lambda t: (F.length(key(t)) >= 3) & (key(t) != key(F.col("heading"))))
    keys = F.transform(pairs, key)
    return F.slice(F.filter(pairs, lambda t, i: F.array_position(keys, key(t)) == i + 1), 1, ENTRY_TERMS)


def concept_expression() -> Column:
    """A concept ``term`` with its record as an expression; without a record the words themselves."""
    text, terms = F.trim("term"), entry_terms()
    more = F.transform(terms, lambda t: F.concat(F.lit('"'), t, F.lit('"[tiab]')))
    own = F.concat(_quoted(text), F.lit("[tiab]"))
    covered = F.array_contains(F.concat(F.array(key(F.col("heading"))), F.transform(terms, key)), key(text))
    parts = F.concat(F.array(F.concat(F.lit('"'), F.col("heading"), F.lit('"[MeSH Terms]'))), more, F.when(covered, F.array().cast("array<string>")).otherwise(F.array(own)))
    inner = F.array_join(parts, " OR ")
    return F.when(F.col("heading").isNull(), _quoted(text)).when(F.size(parts) > 1, F.concat(F.lit("("), inner, F.lit(")"))).otherwise(inner)


def expand(concepts: DataFrame) -> DataFrame:
    """``id, expression``: concepts ``(id, ord, term, expression)`` joined by AND; past 1400 characters the words stand for themselves."""
    rows = concepts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ord", "term", "expression"))).alias("a"))
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("p"))

    def step(s, x):
        piece = F.when(s["n"] + F.length(x["expression"]) > MOST_CHARS, x["term"]).otherwise(x["expression"])
        return F.struct((s["n"] + F.length(piece)).alias("n"), F.array_append(s["p"], piece).alias("p"))

    return rows.select("id", F.array_join(F.aggregate("a", zero, step)["p"], " AND ").alias("expression"))


def split_concepts(keywords: DataFrame, known: DataFrame) -> DataFrame:
    """``id, ord, text, heading``: words covered by the longest known phrases, left to right, at most eight lookups.

    ``known`` has ``term, heading``. All phrases of a keyword meet the vocabulary in one join; the cover is a fold over its own phrases.
    """
    w = keywords.withColumn("w", query_words(F.col("keyword"))).where(F.size("w") > 0)
    spans = w.select("id", "w", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda n: F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.struct((-n).alias("n"), i.alias("i")))))).alias("s"))
    spans = spans.withColumn("text", F.array_join(F.expr("slice(w, s.i + 1, -s.n)"), " ")).withColumn("k", key(F.col("text")))
    found = spans.join(known.select(key(F.col("term")).alias("k"), "heading").dropDuplicates(["k"]), "k", "left")
    a = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("s.n", "s.i", "text", "heading"))).alias("a"))
    kind = "array<struct<i:int,n:int,text:string,heading:string>>"
    zero = F.struct(F.lit(0).alias("looked"), F.array().cast(kind).alias("p"))

    def step(s, x):
        n = -x["n"]
        taken = F.exists(s["p"], lambda y: (y["i"] < x["i"] + n) & (x["i"] < y["i"] + y["n"]))
        look = ~taken & (s["looked"] < LOOKUPS)
        return F.when(~look, s).otherwise(F.struct((s["looked"] + 1).alias("looked"), F.when(x["heading"].isNull(), s["p"]).otherwise(
            F.array_append(s["p"], F.struct(x["i"].alias("i"), n.alias("n"), x["text"].alias("text"), x["heading"].alias("heading")))).alias("p")))

    got = a.select("id", F.aggregate("a", zero, step)["p"].alias("p")).join(w.select("id", "w"), "id")
    single = F.filter(F.transform("w", lambda t, i: F.struct(i.alias("i"), F.lit(1).alias("n"), t.alias("text"), F.lit(None).cast("string").alias("heading"))),
                      lambda x: ~F.exists("p", lambda y: (y["i"] <= x["i"]) & (x["i"] < y["i"] + y["n"])))
    return got.select("id", F.posexplode(F.array_sort(F.concat("p", single.cast(kind)))).alias("ord", "c")).select("id", "ord", "c.text", "c.heading")


#: Letters up to which a word's variants with letters left out are its keys, and longer ones their pieces.
SHORT = 16


def _left_out(word: Column) -> Column:
    """The word, and it without each one and each two of its letters."""
    without = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    once = without(word)
    return F.array_distinct(F.concat(F.array(word), once, F.flatten(F.transform(once, without))))


def _piece(n: Column, i: int) -> tuple[Column, Column]:
    """Start, from 1, and length of the third ``i`` of ``n`` letters."""
    lo, hi = F.floor(n * i / 3).cast("int"), F.floor(n * (i + 1) / 3).cast("int")
    return lo + 1, hi - lo


def _keys(word: Column, names: bool) -> Column:
    """Keys of which words within two edits share one.

    Two edits leave one of three pieces of a longer name whole, moved by two letters at
    most; which of its substrings that may be is tried for each length the name can have.
    """
    tagged = lambda a, tag: F.transform(a, lambda x: F.concat(tag, x))
    n, none = F.length(word), F.array().cast("array<string>")
    short = F.when(n <= SHORT + 2, tagged(_left_out(word), F.lit("d|"))).otherwise(none)

    def pieces(size: Column) -> list[Column]:
        out = []
        for i in range(3):
            start, width = _piece(size, i)
            tag = F.concat(F.lit(f"{i}|"), size.cast("string"), F.lit("|"))
            starts = F.array(start) if names else F.filter(F.array(*[start + k for k in range(-2, 3)]), lambda s: s >= 1)
            out.append(tagged(F.transform(starts, lambda s, width=width: F.substring(word, s, width)), tag))
        return out

    sizes = [n] if names else [n + k for k in range(-2, 3)]
    long = F.when(n > SHORT, F.array_distinct(F.concat(*[p for s in sizes for p in pieces(s)]))).otherwise(none)
    return F.concat(short, long)


def nearest(terms: DataFrame, names: DataFrame, most: int = 2) -> DataFrame:
    """``term, name, edits``: of ``names(name, weight)`` the nearest to each of ``terms(term)`` within ``most`` (1 or 2) edits.

    Of equally near ones the heaviest, then the first by code points. No pair of a term and
    a name is compared that shares no key: letters left out for short words, pieces for long ones.
    Case counts; nulls and blanks have no neighbours; terms without one give no row.
    """
    if most not in (1, 2):
        raise ValueError("most is 1 or 2")
    filled = lambda df, c: df.where(F.col(c).isNotNull() & (F.col(c) != ""))
    asked = filled(terms, "term").select("term").distinct().withColumn("key", F.explode(_keys(F.col("term"), False)))
    known = filled(names, "name").groupBy("name").agg(F.max("weight").alias("weight")).withColumn("key", F.explode(_keys(F.col("name"), True)))
    pairs = asked.join(known, "key").select("term", "name", "weight").distinct().withColumn("edits", F.levenshtein("term", "name", most)).where("edits >= 0")
    best = pairs.groupBy("term").agg(F.min(F.struct("edits", (-F.col("weight")).alias("w"), "name")).alias("b"))
    return best.select("term", "b.name", "b.edits")


def suggest(terms: DataFrame, names: DataFrame) -> DataFrame:
    """``term, suggestion`` for terms that are no name themselves, whatever the case, and have one within two edits."""
    low = names.select(F.lower("name").alias("name"), "weight")
    asked = terms.select("term", F.lower("term").alias("low")).where("low is not null").distinct()
    open_ = asked.join(low.select(F.col("name").alias("low")), "low", "left_anti")
    found = nearest(open_.select(F.col("low").alias("term")), low).select(F.col("term").alias("low"), F.col("name").alias("suggestion"))
    return open_.join(found, "low").select("term", "suggestion")


def resolve_nearest(names: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``name, resolved`` as :func:`resolve_journals` where the catalogue has the name, else the abbreviation of the title nearest to it within two edits, else the name."""
    titles = catalogue.where(X.filled(F.col("abbreviation"))).groupBy(journal_name(F.col("title")).alias("name")).agg(F.min(F.struct("ord", "abbreviation"))["abbreviation"].alias("abbreviation")).where("name <> ''")
    asked = names.select("name", journal_name(F.col("name")).alias("k")).distinct()
    near = nearest(asked.select(F.col("k").alias("term")), titles.select("name", F.lit(0).alias("weight"))).select(F.col("term").alias("k"), F.col("name").alias("title"))
    got = asked.join(near, "k", "left").join(titles.select(F.col("name").alias("title"), "abbreviation"), "title", "left")
    return names.join(got.select("name", F.coalesce("abbreviation", "name").alias("resolved")), "name")
