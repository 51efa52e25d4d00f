"""Citations in six formats: one row of text for each article."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import lexicon as L
from evispark.operators import numbering

FIELDS = ["pmid", "title", "journal", "year", "volume", "issue", "pages", "doi", "issn", "url", "language", "abstract", "pmcid"]
#: Letters that lose their marks in a key, by the rule of canonical decomposition.
_MARKED = [chr(c) for c in range(0xC0, 0x250) if unicodedata.normalize("NFKD", chr(c))[0].isascii() and len(unicodedata.normalize("NFKD", chr(c))) > 1]


def complete(articles: DataFrame) -> DataFrame:
    have = set(articles.columns)
    return articles.withColumns({c: F.lit(None).cast("string") for c in FIELDS if c not in have} | {c: F.lit(None).cast("array<string>") for c in ("authors", "pubtypes") if c not in have})


def s(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))


def line(tag: str, value: Column, after: str = "") -> Column:
    """``tag`` and value, or null without a value."""
    return F.when(value != "", F.concat(F.lit(tag), value, F.lit(after)))


def authors() -> Column:
    """Array of ``(family, initials, group)``: a last word of one to four capitals is initials, else the name is a group's."""
    names = F.filter(F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.trim(F.coalesce(a, F.lit("")))), lambda a: a != "")

    def split(a):
        person = a.rlike(r"^.* [A-Z]{1,4}$")
        return F.struct(F.when(person, F.trim(F.regexp_extract(a, r"^(.*) [A-Z]{1,4}$", 1))).otherwise(a).alias("family"), F.when(person, F.regexp_extract(a, r" ([A-Z]{1,4})$", 1)).otherwise("").alias("initials"), (~person).alias("group"))

    return F.transform(names, split)


def year() -> Column:
    y = F.regexp_extract(s("year"), r"(1[89]\d{2}|20\d{2})", 1)
    return F.when(y == "", s("year")).otherwise(y)


def pages() -> Column:
    return F.replace(s("pages"), F.lit("--"), F.lit("-"))


def fold(c: Column) -> Column:
    """Lower-case ASCII letters and digits, marks dropped."""
    plain = "".join(unicodedata.normalize("NFKD", x)[0] for x in _MARKED)
    return F.regexp_replace(F.lower(F.translate(c, "".join(_MARKED), plain)), "[^a-z0-9]", "")


def comma(a: Column) -> Column:
    return F.when(a["group"], a["family"]).otherwise(F.concat(a["family"], F.lit(", "), a["initials"]))


#: Fixed TeX escapes.
TEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def tex(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TEX.items() for x in kv])
    return F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")


def bib_base() -> Column:
    """Family of the first person, year, and first word of four letters that says something."""
    a = authors()
    person = F.get(F.filter(a, lambda x: ~x["group"]), F.lit(0))["family"]
    stem = F.coalesce(F.nullif(fold(person), F.lit("")), F.nullif(fold(F.get(a, F.lit(0))["family"]), F.lit("")), F.when(F.size(a) == 0, F.nullif(fold(s("journal")), F.lit(""))), F.lit("anon"))
    words = F.filter(F.transform(F.split(s("title"), r"[\s:;,.\-()\[\]/]+"), fold), lambda w: (F.length(w) >= 4) & ~w.isin(*L.KEY_STOP))
    return F.concat(stem, fold(year()), F.coalesce(F.get(words, F.lit(0)), F.lit("")))


def _letter(n: Column) -> Column:
    """The code point ``n`` after the one before a, where that is a character; else ``n`` in digits. ``chr`` would start anew at 256."""
    code = 96 + n
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when((code < 0xD800) | code.between(0xE000, 0x10FFFF), char).otherwise(F.concat(F.lit("-"), n.cast("string")))


def bibtex(articles: DataFrame, order: str = "ord") -> DataFrame:
    """``ord, text``; equal keys get a, b, c in input order, after z the code points that follow. The window is over articles of one key."""
    a = complete(articles).withColumn("_base", bib_base())
    nth = F.row_number().over(Window.partitionBy("_base").orderBy(order)) - 1
    key = F.concat("_base", F.when(nth > 0, _letter(nth)).otherwise(""))
    names = F.array_join(F.transform(authors(), lambda x: F.when(x["group"], F.concat(F.lit("{"), x["family"], F.lit("}"))).otherwise(comma(x))), " and ")
    field = lambda k, v: F.when(v != "", F.concat(F.lit(f"  {k:<7} = {{"), v, F.lit("}")))
    title = F.when(s("title") != "", F.concat(F.lit("{"), tex(s("title")), F.lit("}"))).otherwise("")
    note = F.when(s("pmid") != "", F.concat(F.lit("PMID: "), tex(s("pmid")))).otherwise("")
    body = F.concat_ws(",\n", field("author", names), field("title", title), field("journal", tex(s("journal"))), field("year", tex(year())), field("volume", tex(s("volume"))), field("number", tex(s("issue"))),
                       field("pages", tex(s("pages"))), field("doi", tex(s("doi"))), field("issn", tex(s("issn"))), field("url", tex(s("url"))), field("note", note))
    return a.select(order, F.concat(F.lit("@article{"), key, F.lit(",\n"), body, F.lit("\n}")).alias("text"))


def ris(articles: DataFrame, order: str = "ord") -> DataFrame:
    first, last = F.trim(F.split_part(pages(), F.lit("-"), F.lit(1))), F.when(F.contains(pages(), F.lit("-")), F.trim(F.regexp_extract(pages(), "-(.*)$", 1))).otherwise("")
    who = F.array_join(F.transform(authors(), lambda a: F.concat(F.lit("AU  - "), comma(a))), "\n")
    text = F.concat_ws("\n", F.lit("TY  - JOUR"), F.nullif(who, F.lit("")), line("TI  - ", s("title")), line("JO  - ", s("journal")), line("SP  - ", first), line("EP  - ", last), line("VL  - ", s("volume")), line("IS  - ", s("issue")),
                       line("PY  - ", year()), line("SN  - ", s("issn")), line("DO  - ", s("doi")), line("AN  - ", s("pmid")), line("UR  - ", s("url")), line("LA  - ", s("language")), F.lit("ER  - "))
    return complete(articles).select(order, text.alias("text"))


def endnote(articles: DataFrame, order: str = "ord") -> DataFrame:
    who = F.array_join(F.transform(authors(), lambda a: F.concat(F.lit("%A "), comma(a))), "\n")
    text = F.concat_ws("\n", F.lit("%0 Journal Article"), F.nullif(who, F.lit("")), line("%T ", s("title")), line("%J ", s("journal")), line("%D ", year()), line("%V ", s("volume")), line("%N ", s("issue")), line("%P ", pages()),
                       line("%@ ", s("issn")), line("%R ", s("doi")), line("%U ", s("url")), line("%M ", s("pmid")))
    return complete(articles).select(order, text.alias("text"))


def plain(a: Column) -> Column:
    return F.when(a["group"], a["family"]).otherwise(F.concat(a["family"], F.lit(" "), a["initials"]))


def medline(articles: DataFrame, order: str = "ord") -> DataFrame:
    each = lambda tag, arr: F.nullif(F.array_join(F.transform(arr, lambda x: F.concat(F.lit(tag), x)), "\n"), F.lit(""))
    types = F.filter(F.transform(F.coalesce("pubtypes", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda t: t != "")
    lines = F.filter(F.transform(F.split(s("abstract"), r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda t: t != "")
    text = F.concat_ws("\n", line("PMID- ", s("pmid")), each("AU  - ", F.transform(authors(), plain)), each("PT  - ", types), line("TI  - ", s("title")), line("JT  - ", s("journal")), line("DP  - ", year()), line("VI  - ", s("volume")),
                       line("IP  - ", s("issue")), line("PG  - ", pages()), line("IS  - ", s("issn")), each("AB  - ", lines), line("LID - ", s("doi"), " [doi]"), line("AID - ", s("doi"), " [doi]"), line("AID - ", s("pmcid"), " [pmc]"))
    return complete(articles).select(order, text.alias("text"))


def _few(names: Column, most: int) -> Column:
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), F.when(F.size(names) > most, ", et al").otherwise(""))


def _issue() -> Column:
    return F.concat(s("volume"), F.when(s("issue") != "", F.concat(F.lit("("), s("issue"), F.lit(")"))).otherwise(""))


def vancouver(articles: DataFrame, order: str = "ord") -> DataFrame:
    """Entries numbered by their position in ``order``, a number."""
    when = F.concat(year(), F.when(_issue() != "", F.concat(F.lit(";"), _issue())).otherwise(""), F.when(pages() != "", F.concat(F.lit(":"), pages())).otherwise(""))
    place = F.when(year() != "", F.concat(F.when(s("journal") != "", F.concat(s("journal"), F.lit(". "))).otherwise(""), when, F.lit("."))).otherwise(line("", s("journal"), "."))
    text = F.concat_ws(" ", line("", _few(F.transform(authors(), plain), 6), "."), line("", F.regexp_replace(s("title"), r"\.+$", ""), "."), place, line("doi:", s("doi"), "."), line("PMID: ", s("pmid"), "."))
    return numbering.numbered(complete(articles), order, "_n").select(order, F.concat(F.col("_n").cast("string"), F.lit(". "), text).alias("text"))


def gbt7714(articles: DataFrame, order: str = "ord") -> DataFrame:
    names = F.transform(authors(), lambda a: F.concat_ws(" ", F.upper(a["family"]), F.nullif(F.array_join(F.split(a["initials"], ""), " "), F.lit(""))))
    tail = F.concat_ws(", ", F.nullif(s("journal"), F.lit("")), F.nullif(year(), F.lit("")), F.nullif(_issue(), F.lit("")))
    tail = F.when(tail != "", F.concat(tail, F.when(pages() != "", F.concat(F.lit(": "), pages())).otherwise(""), F.lit(".")))
    text = F.concat_ws(" ", line("", _few(names, 3), "."), line("", F.regexp_replace(s("title"), r"\.+$", ""), "[J]."), tail, line("DOI:", s("doi"), "."))
    return numbering.numbered(complete(articles), order, "_n").select(order, F.concat(F.lit("["), F.col("_n").cast("string"), F.lit("] "), text).alias("text"))


FORMATS = {"bibtex": bibtex, "ris": ris, "endnote": endnote, "medline": medline, "vancouver": vancouver, "gbt7714": gbt7714}


def render(articles: DataFrame, fmt: str, order: str = "ord") -> DataFrame:
    """Entries ``(ord, text)`` in a format; :func:`evispark.sources.sinks.joined` makes one text of them."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown citation format {fmt}; known: {', '.join(FORMATS)}")
    return FORMATS[fmt](articles, order)


def missing() -> Column:
    """Missing fields among authors, title, journal and year."""
    return F.filter(F.array(F.when(F.size(F.coalesce("authors", F.array().cast("array<string>"))) == 0, "作者"), F.when(s("title") == "", "标题"), F.when(s("journal") == "", "期刊"), F.when(year() == "", "年份")), lambda x: x.isNotNull())
