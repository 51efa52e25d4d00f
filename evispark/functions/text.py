"""Text scalars as column expressions: Column in, Column out, no Python on executors."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from evispark.functions import lexicon as L

SPACE = r"[\s\u00a0\u3000]"
NUM = r"\d+(?:[.·]\d+)?"
RANGE = NUM + r"(?:\s*[–—-]\s*" + NUM + ")?"
#: Fixed patterns of the six value kinds; the lookahead of a percentage is a filter in :func:`values`.
VALUE_PATTERNS = {
    "P 值": r"(?i)P\s*[<=>]\s*(?:" + NUM + r"|[.·]\d+)",
    "置信区间": r"(?i)9[05]\s*%\s*CI\s*(?:\(\s*" + RANGE + r"\s*\)|" + RANGE + r"(?:\s*\(\s*" + RANGE + r"\s*\))?)",
    "风险比/比值比": r"(?i)\b(?:a?HR|OR|RR)\b[^.;]{0,20}?" + NUM,
    "百分比": NUM + r"%(?:\s*(?:[Cc]r?I|confidence)\b)?",
    "样本量": r"(?i)\bn\s*=\s*\d[\d,]*",
    "均值±标准差": NUM + r"\s*±\s*" + NUM,
}


#: A word boundary of ASCII letters, digits and _. Java's ``\b`` takes all letters for words before version 19 and not from it on.
_BOUND = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"


def ascii_bounds(pattern: str) -> str:
    """A pattern whose ``\\b`` is that of ASCII words, as in SQL engines, whatever the version of Java; what stands at its edges begins or ends words."""
    flag, p = re.match(r"((?:\(\?i\))?)(.*)", pattern, re.S).groups()
    if re.match(r"\\b(?:[A-Za-z]|\(?\\d|\[[A-Za-z]|\(\?:[A-Za-z|? ]+\))", p):  # one byte before is looked at only where a word may begin
        p = r"(?<!\w)" + p[2:]
    return flag + re.sub(r"(?<=[a-z]\))\\b", r"(?!\\w)", p).replace(r"\b", _BOUND)


def lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(c: Column, f) -> Column:
    """``f(c)`` with ``c`` worked out once a row, however often ``f`` names it; inside a lambda an expression is worked out anew for each element."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


#: White space that is not already one plain space; single spaces are passed over and not written anew.
_UNEVEN = r" *[\t-\r\u00a0\u3000][\s\u00a0\u3000]*| {2,}"


def squeeze(c: Column) -> Column:
    """White space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, _UNEVEN, " "))


def filled(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) != ""


def snippet(c: Column, limit: int = 160) -> Column:
    """Squeezed text, cut to ``limit`` characters with an ellipsis."""
    s = squeeze(F.coalesce(c, F.lit("")))
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, limit)), F.lit("…")))


#: A dot after an abbreviation. The dot comes first in the pattern, so other characters are passed over at once.
_ABBREVIATED = r"\.(?<=(?:" + "|".join(re.escape(a) for a in L.ABBREVIATIONS if a[-1] != ".") + r")\.)"


def sentences(c: Column) -> Column:
    """Array of sentences over ten characters; dots of known abbreviations do not end one."""
    s = F.regexp_replace(squeeze(F.coalesce(c, F.lit(""))), _ABBREVIATED, "§")
    parts = F.split(s, " (?<=[.!?。！？] )")
    parts = F.transform(parts, lambda p: F.trim(F.replace(p, F.lit("§"), F.lit("."))))
    return F.filter(parts, lambda p: F.length(p) > 10)


def stem(w: Column) -> Column:
    """Plural folded to singular; short words, hyphens and digits are left alone."""
    n, cut = F.length(w), lambda k: F.substring(w, F.lit(1), F.length(w) - k)
    ends = lambda x: w.endswith(x)
    es = F.when(F.substring(w, n - 2, F.lit(1)).isin("s", "x", "z"), cut(2)).otherwise(cut(1))
    cand = (F.when(ends("ies") & (n > 5), F.concat(cut(3), F.lit("y"))).when(ends("sses") & (n > 5), cut(2))
            .when(ends("es") & (n > 5), es).when(ends("s") & ~ends("ss") & ~ends("is"), cut(1)).otherwise(w))
    # cheap tests first: few words end in s, and only those are looked at closely
    return F.when(~ends("s") | (n <= 4), w).when(F.contains(w, F.lit("-")) | w.rlike("[0-9]"), w).when(F.length(cand) < 3, w).otherwise(cand)


def tokens(c: Column) -> Column:
    """Normal tokens: Latin words lower-case without possessive and plural, CJK runs as pairs of characters."""
    raw = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[A-Za-z][A-Za-z0-9'\-]*|[一-鿿]+"), F.lit(0))

    def one(w):
        bare = F.regexp_replace(F.lower(w), r"^['\-]+|['\-]+$", "")
        bare = F.regexp_replace(F.regexp_replace(bare, "'(s|re|ve|ll|d|m|t)$", ""), r"['\-]+$", "")
        low = F.when(F.contains(w, F.lit("'")) | F.contains(w, F.lit("-")), bare).otherwise(F.lower(w))
        latin = F.when(low == "", F.array().cast("array<string>")).otherwise(F.array(stem(low)))
        pairs = F.when(F.length(w) == 1, F.array(w)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2))))
        return F.when(F.ascii(w) < 128, latin).otherwise(pairs)

    return F.flatten(F.transform(raw, one))


def is_candidate(w: Column, stop: list[str] | None = None) -> Column:
    """Whether a token may be a keyword: no stop word, three characters or a known short form, not one letter repeated."""
    stops = L.ENGLISH_STOP + L.GENERIC_STOP if stop is None else stop
    same = F.replace(w, F.substring(w, 1, 1), F.lit("")) == ""
    return (F.ascii(w) < 128) & ~w.isin(*stops) & (w.isin(*L.SHORT_KEEP) | ((F.length(w) >= 3) & ~same))


def norm_metric(c: Column) -> Column:
    return squeeze(F.replace(c, F.lit("·"), F.lit(".")))


def norm_value(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, SPACE + "+", ""))


def values(c: Column) -> Column:
    """Array of ``(kind, ord, value)`` of all value patterns found in a text."""
    def named(k: str, found: Column) -> Column:
        return F.transform(found, lambda v, i: F.struct(F.lit(k).alias("kind"), i.alias("ord"), norm_metric(v).alias("value")))

    out = []
    for k, p in VALUE_PATTERNS.items():
        found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(ascii_bounds(p)), F.lit(0))
        if k == "百分比":  # a percentage that belongs to an interval is none
            found = F.filter(found, lambda v: v.endswith("%"))
        out.append(named(k, found))
    return F.flatten(F.array(*out))


def mostly_english(c: Column) -> Column:
    latin, cjk = F.regexp_count(c, F.lit("[A-Za-z]")), F.regexp_count(c, F.lit(r"[一-鿿]"))
    return (latin > cjk * 2) & (latin > 20)


def sanitize(c: Column) -> Column:
    """E-mail addresses and Chinese mobile numbers masked."""
    return F.regexp_replace(F.regexp_replace(c, r"[\w.+-]+@[\w-]+\.[\w.-]+", "[邮箱已隐去]"), r"(?<!\d)(?:\+?86[- ]?)?1[3-9]\d{9}(?!\d)", "[手机号已隐去]")


def is_boilerplate(title: Column) -> Column:
    low = F.lower(title)
    return F.exists(lits(L.BOILERPLATE), lambda x: F.contains(low, x))


_PREFIX = r"(?i)^(?:\d+(?:\.\d+)*\s*[.、)]?\s*|[ivxlcdm]+\s*[.、)]\s*|section\s+\d+\s*[:.、)]?\s*)+"


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def plain_title(c: Column) -> Column:
    """A section title without numbering."""
    t = F.regexp_replace(squeeze(F.coalesce(c, F.lit(""))), "[.:]+$", "")
    s = F.trim(F.regexp_replace(t, _PREFIX, ""))
    return F.when(s == "", t).otherwise(s)


def zh_title(c: Column) -> Column:
    t = F.regexp_replace(squeeze(F.coalesce(c, F.lit(""))), "[.:]+$", "")
    return F.coalesce(F.try_element_at(_map(L.SECTION_TITLES_ZH), F.lower(F.trim(F.regexp_replace(t, _PREFIX, "")))), c)


def clean_lead(c: Column) -> Column:
    """Leading Chinese connectives dropped, as often as they stand there."""
    return F.trim(F.regexp_replace(F.trim(c), r"^(?:(?:此外|另外|同时|然而|但是|因此|因而|并且|而且|总之|综上|一般而言|具体而言|值得注意的是|需要注意的是)[，,：:、]\s*)+", ""))


def clean_text(c: Column) -> Column:
    """Hyphen breaks joined, single line ends unwrapped, spaces squeezed."""
    s = F.regexp_replace(c, "\r\n?", "\n")
    s = F.regexp_replace(s, r"([a-z])-\s*\n\s*([a-z])", "$1$2")
    s = F.regexp_replace(s, r"(?<!\n)\n(?!\s*\n)", " ")
    return F.trim(F.regexp_replace(s, r"[ \t 　]{2,}", " "))


def norm_tag(c: Column) -> Column:
    s = F.regexp_replace(squeeze(F.coalesce(c, F.lit(""))), "^[#＃,，;；、|/-]+|[#＃,，;；、|/-]+$", "")
    return F.trim(F.substring(s, 1, L.LIBRARY["tag"]))


def distinct_ci(a: Column) -> Column:
    """Array without later spellings of what it has, whatever the case."""
    return let(a, lambda xs: let(F.transform(xs, lambda y: F.lower(y)), lambda low: F.filter(xs, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)))


def parse_tags(c: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[,，;；、|\n\r\t]+"), norm_tag), lambda t: t != "")
    return F.slice(distinct_ci(parts), 1, L.LIBRARY["tags"])


def folder_name(c: Column) -> Column:
    return F.trim(F.substring(squeeze(F.coalesce(c, F.lit(""))), 1, L.LIBRARY["folder_name"]))


def digest(*parts: Column) -> Column:
    return F.sha1(F.concat(*[x for p in parts for x in (p.cast("string"), F.lit("\u001f"))]))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def short_url(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.when(F.length(path) <= 60, path).otherwise(F.concat(F.substring(path, 1, 60), F.lit("…"))))


def valid_token(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))).rlike("^[A-Za-z0-9_-]{8,32}$")


def terms(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda t: t != "")


def norm_text(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def numbers(c: Column) -> Column:
    """Distinct numbers without years."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))
    return F.filter(found, lambda x: ~(x.rlike(r"^\d{4}$") & x.cast("double").between(1900, 2100)))


def latin_terms(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z][a-z\-']{2,}"), F.lit(0)))


def page_text(c: Column) -> Column:
    """Lines from the first abstract heading to the references ten lines later or more; all lines if that is short."""
    lines = F.filter(F.transform(F.split(c, r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    at = F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike("(?i)^(abstract|summary|highlights)$"), i)), lambda i: i.isNotNull()))
    start = F.coalesce(at, F.lit(0))
    # all places first: a lambda over the lines that names another array is slow, since it makes that array anew for each line
    ends = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike("(?i)^(references?|bibliography)$"), i)), lambda i: i.isNotNull())
    end = F.coalesce(F.array_min(F.filter(ends, lambda i: i >= start + 10)), F.size(lines))
    cut = F.array_join(F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))), "\n")
    return F.when(F.length(cut) > 1500, cut).otherwise(F.array_join(lines, "\n"))


def friendly_error(msg: Column) -> Column:
    """A message's class: certificate, unreachable, timeout, or the message itself."""
    has = lambda *x: F.greatest(*[F.contains(msg, F.lit(y)) for y in x]) if len(x) > 1 else F.contains(msg, F.lit(x[0]))
    return (F.when(has("SSLCertVerificationError", "CERTIFICATE_VERIFY_FAILED"), "certificate")
            .when(has("Max retries exceeded", "ConnectionError", "Connection aborted"), "unreachable")
            .when(has("ReadTimeout", "ConnectTimeout") | F.contains(F.lower(msg), F.lit("timed out")), "timeout").otherwise(msg))


def cue_pattern(cues: list[str]) -> str:
    """One pattern for a list: whole words where a cue is letters and digits, padded cues without the pads."""
    parts = []
    for c in cues:
        if re.fullmatch("[A-Za-z0-9]+", c):
            parts.append(rf"(?<!\w){c}(?!\w)")
        elif c != c.strip():
            parts.append(rf"(?:(?<![A-Za-z0-9]){re.escape(c.strip())}(?![A-Za-z0-9]))")
        else:
            parts.append(re.sub(r"([.+*?()\[\]{}|^$\\])", r"\\\1", c))
    return "(?i)" + "|".join(parts)


def _least(cues: list[str]) -> list[str]:
    """Cues in lower case without pads, and without those that have another in them: a text with any cue has one of these."""
    bare = dict.fromkeys(c.strip().lower() for c in cues)
    return [c for c in bare if not any(o in c for o in bare if o != c)]


def first_hit(low: Column, cues: list[str]) -> Column:
    """The leftmost cue in a lower-case text, or ''. ``low`` is best a column: it is named once for each cue.

    The pattern runs only on texts that have the letters of a cue, which a plain search tells in a tenth of the time.
    """
    there = functools.reduce(operator.or_, [F.contains(low, F.lit(c)) for c in _least(cues)])
    return F.when(there, F.trim(F.regexp_extract(low, cue_pattern(cues), 0))).otherwise(F.when(low.isNotNull(), ""))


def with_places(text: Column, parts: Column) -> Column:
    """Array of ``(sentence, start, end)``: each part's first place after the part before, or anywhere; parts that are not there are left out."""
    kind = "array<struct<sentence:string,start:int,end:int>>"
    zero = F.struct(F.lit(0).alias("base"), F.array().cast(kind).alias("out"))

    def step(z, p):
        onward = F.call_function("locate", p, text, z["base"] + 1)
        at = F.when(onward > 0, onward).otherwise(F.call_function("locate", p, text)) - 1
        end = (at + F.length(p)).cast("int")
        one = F.struct(p.alias("sentence"), at.cast("int").alias("start"), end.alias("end"))
        return F.when(at < 0, z).otherwise(F.struct(end.alias("base"), F.array_append(z["out"], one).alias("out")))

    return F.aggregate(parts, zero, step)["out"]


def tagged(text: Column, spans: Column, css: str) -> Column:
    """HTML of a text, escaped, with ``spans(start, end)``, sorted and apart, in ``<span class=...>``."""
    def escaped(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    cut = lambda a, b: escaped(F.substring(text, a + 1, b - a))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda z, s: F.struct(s["end"].alias("at"), F.concat(z["out"], cut(z["at"], s["start"]), F.lit(f'<span class="{css}">'), cut(s["start"], s["end"]), F.lit("</span>")).alias("out"))
    done = F.aggregate(spans, zero, step)
    return F.concat(done["out"], escaped(F.substring(text, done["at"] + 1, F.length(text))))
