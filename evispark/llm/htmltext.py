"""Main text of web pages by a linear-chain conditional random field.

A page is a sequence of leaf blocks: runs of text between block-level tags. The
field labels each block as article or not from its ancestors' tags, words in
their class, id and role, and the text itself. Weights are trained by stochastic
gradient on labelled pages; blocks are decoded by Viterbi.
"""

from __future__ import annotations

import functools
import html
import random
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|textarea|title|iframe|svg|select)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>|<[a-zA-Z/!?][^>]*+\Z", re.S | re.I)
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html label legend li main menu nav noscript ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES = {t: {"p"} for t in _BLOCKS} | {"li": {"p", "li"}, "dd": {"p", "dd", "dt"}, "dt": {"p", "dd", "dt"}, "tr": {"p", "tr", "td", "th"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "body": {"p", "head"}}
_SCOPE = frozenset("div section article aside main nav header footer form table ul ol dl blockquote figure body html".split())
#: Words in class, id and role that hint at a block's part.
_HINTS = {
    "menu": ("nav", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "tabs", "navbar", "navigation", "skip"),
    "head": ("header", "masthead", "topbar", "logo", "branding", "banner"),
    "foot": ("footer", "foot", "copyright", "bottom", "legal", "contentinfo", "colophon"),
    "side": ("sidebar", "side", "aside", "widget", "related", "recommended", "more", "trending", "popular", "complementary", "tags", "rail"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "banner-ad"),
    "notice": ("cookie", "cookies", "consent", "notice", "gdpr", "popup", "modal", "alert", "paywall", "overlay", "dialog", "toast"),
    "form": ("form", "newsletter", "subscribe", "signup", "login", "search", "register"),
    "share": ("share", "social", "sharing", "follow", "byline", "author", "meta", "date"),
    "comment": ("comment", "comments", "reply", "replies", "discussion", "disqus", "respond", "reader"),
    "main": ("article", "content", "main", "post", "entry", "story", "body", "text", "maincontent", "page"),
}
_OF = {w: part for part, words in _HINTS.items() for w in words}
#: Words that turn the name they stand in: what has no sidebar, or one somewhere, is none.
_TURNS = frozenset("no non not without with has have is free hide hidden off".split())
_TAGS = ("article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "table", "figure", "blockquote", "pre", "button", "label", "section", "div", "dl", "body", "head", "dialog", "details", "noscript")


def hints_of(names: str) -> frozenset[str]:
    """Hints of class names, ids and roles: of a whole name or its last word as they are, of its other words as ``part_``."""
    out = set()
    for name in names.lower().split():
        words = re.findall(r"[a-z]+", name)
        if not words or _TURNS.intersection(words):
            continue
        last = words[-1]
        whole = _OF.get("".join(words)) or _OF.get(last)
        if whole:
            out.add(whole)
        out.update(f"part_{_OF[w]}" for w in words[:-1] if w in _OF)
    return frozenset(out)


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    hints: frozenset[str]
    linked: int


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page with text, in page order; character references are decoded, white space is one space."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    parts: list[str] = []
    links = linked = 0

    def flush():
        nonlocal linked
        if parts:
            text = "".join(parts)
            parts.clear()
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(text, tuple(t for t, _ in stack), frozenset().union(*(h for _, h in stack)), min(linked, len(text))))
        linked = 0

    at, page = 0, page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at:m.start()]
            parts.append(piece)
            if links:
                linked += len(piece)
        at = m.end()
        end, tag, attrs = m.group(2, 3, 4) if m.group(3) else m.group(5, 6, 7)
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            links = 0 if end else 1
        elif tag == "hr":
            flush()
        elif tag in _BLOCKS:
            flush()
            if end:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                    if tag in ("p", "li", "td", "th", "tr", "dd", "dt") and stack[i][0] in _SCOPE:
                        break
            else:
                closes = _CLOSES[tag]
                while stack and stack[-1][0] in closes:
                    stack.pop()
                hints = frozenset()
                if attrs and "=" in attrs:
                    hints = hints_of(" ".join(x.strip("\"'") for x in _ATTR.findall(attrs)))
                stack.append((tag, hints))
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


_NAMES: dict[str, int] = {}


def _names() -> dict[str, int]:
    if not _NAMES:
        every = ["one", "first", "last", "long", "longer", "short", "tiny", "linked", "half_linked", "sentence", "points", "commas", "copyright", "digits", "rights"]
        every += [f"in_{t}" for t in _TAGS] + [f"is_{t}" for t in ("p", "h1", "h2", "li", "div", "td", "a", "span", "blockquote", "pre")] + [f"hint_{h}" for h in _HINTS] + [f"hint_part_{h}" for h in _HINTS]
        every += ["article_header", "article_aside", "article_footer", "article_nav", "article_list", "main_hint_comment", "bare", "heading"]
        _NAMES.update({n: i for i, n in enumerate(every)})
    return _NAMES


def features(of: list[Block]) -> np.ndarray:
    """Zero-one features (blocks, features)."""
    names = _names()
    x = np.zeros((len(of), len(names)))
    for i, b in enumerate(of):
        tags, n = set(b.path), len(b.text)
        on = {"one": True, "first": i == 0, "last": i == len(of) - 1, "tiny": n < 15, "short": n < 50, "long": n > 120, "longer": n > 300,
              "linked": b.linked > 0.8 * n, "half_linked": b.linked > 0.3 * n, "sentence": b.text[-1] in ".!?。！？\"”", "points": b.text.count(". ") > 1,
              "commas": b.text.count(",") > 2, "copyright": "©" in b.text, "rights": "rights reserved" in b.text.lower(), "digits": sum(map(b.text.count, "0123456789")) > 0.2 * n}
        inner = tags & {"article", "main"}
        on |= {"article_header": inner and "header" in tags, "article_aside": inner and "aside" in tags, "article_footer": inner and "footer" in tags,
               "article_nav": inner and "nav" in tags, "article_list": inner and "li" in tags, "main_hint_comment": inner and bool(b.hints & {"comment", "part_comment"}),
               "bare": not b.hints and not tags & {"article", "main"}, "heading": bool(b.path) and b.path[-1] in ("h1", "h2", "h3", "h4", "h5", "h6")}
        on |= {f"in_{t}": True for t in tags if f"in_{t}" in names} | {f"hint_{h}": True for h in b.hints}
        if b.path and f"is_{b.path[-1]}" in names:
            on[f"is_{b.path[-1]}"] = True
        x[i, [names[k] for k, v in on.items() if v]] = 1
    return x


@dataclass
class Field:
    """``state`` (features, 2) and ``step`` (2, 2) weights; label 1 is article."""

    state: np.ndarray
    step: np.ndarray

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.state
        back = np.zeros((len(s), 2), np.int64)
        best = s[0].copy()
        for t in range(1, len(s)):
            way = best[:, None] + self.step
            back[t] = way.argmax(0)
            best = way.max(0) + s[t]
        out = np.empty(len(s), np.int64)
        out[-1] = best.argmax()
        for t in range(len(s) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the labels' log-probability, by forward and backward sums."""
        s, n = x @ self.state, len(y)
        a, b = np.empty((n, 2)), np.zeros((n, 2))
        a[0] = s[0]
        for t in range(1, n):
            a[t] = np.logaddexp(a[t - 1, 0] + self.step[0], a[t - 1, 1] + self.step[1]) + s[t]
        for t in range(n - 2, -1, -1):
            w = s[t + 1] + b[t + 1]
            b[t] = np.logaddexp(self.step[:, 0] + w[0], self.step[:, 1] + w[1])
        z = np.logaddexp(*a[-1])
        p = np.exp(a + b - z)
        g = np.eye(2)[y] - p
        pair = np.exp(a[:-1, :, None] + self.step[None] + (s[1:] + b[1:])[:, None, :] - z)
        step = -pair.sum(0)
        np.add.at(step, (y[:-1], y[1:]), 1)
        return x.T @ g, step


def fit(pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 12, rate: float = 0.3, ridge: float = 1e-3, seed: int = 5) -> Field:
    """A field from pages of ``(features, labels)``, by AdaGrad over single pages."""
    field = Field(np.zeros((len(_names()), 2)), np.zeros((2, 2)))
    seen = [np.full_like(field.state, 1e-2), np.full_like(field.step, 1e-2)]
    order = random.Random(seed)
    pages = [p for p in pages if len(p[1])]
    for _ in range(rounds):
        order.shuffle(pages)
        for x, y in pages:
            for w, h, g in zip((field.state, field.step), seen, field.gradient(x, y)):
                g = g - ridge * w
                h += g * g
                w += rate * g / np.sqrt(h)
    return field


_MARK = "\ue000"


def labelled_pages(count: int = 400, seed: int = 3) -> list[str]:
    """Invented pages of many layouts; a block of the article begins with a private-use mark."""
    r = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgk"

    def word():
        return "".join(r.choice(letters) for _ in range(r.randint(2, 9)))

    def sentence(a=4, b=16):
        w = [word() + ("," if r.random() < 0.1 else "") for _ in range(r.randint(a, b))]
        return " ".join(w).capitalize().rstrip(",") + "."

    def para(mark=_MARK):
        style = r.random()
        body = " ".join(sentence() for _ in range(1 if style < 0.25 else r.randint(2, 8)))
        body = sentence(1, 3) if style < 0.1 else body
        if r.random() < 0.2:
            body = body.replace(" ", f' <a href="/{word()}">{word()}</a> ', 1)
        if r.random() < 0.15:
            body = f"<b>{body}<br>" if r.random() < 0.5 else f"<b>{body}</b><br>{word()}"
        close = "" if r.random() < 0.15 else "</p>"
        return f"<p>{mark}{body}{close}"

    def links(n, tag="li", long=False):
        return "".join(f'<{tag}><a href="/{word()}">{(sentence(3, 9) if long else word())}</a></{tag}>' for _ in range(n))

    def box(tags, names, inner):
        tag, name = r.choice(tags), r.choice(names)
        attr = f' class="{name}"' if r.random() < 0.6 else f' id="{name}"' if r.random() < 0.8 else ""
        if tag == "div" and not attr:
            attr = f' class="{name}"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    def extra():
        return r.choice([
            lambda: box(["div", "aside"], ["ad", "ads", "advert", "sponsored", "promo"], sentence() if r.random() < 0.5 else f"<p>{sentence()} {sentence()}</p>"),
            lambda: box(["div", "section"], ["cookie-notice", "consent", "notice", "popup"], f"<p>{sentence()}</p><button>{word()}</button>"),
            lambda: box(["aside", "div"], ["sidebar", "widget", "related", "popular"], f"<h3>{word()}</h3><ul>{links(r.randint(2, 6), long=True)}</ul>" + (para("") if r.random() < 0.3 else "")),
            lambda: f'<form action="/{word()}"><label>{word()} {word()}</label><input name="q"><button>{word()}</button><p>{sentence()}</p></form>',
            lambda: box(["div", "section"], ["comments", "comment-list", "replies", "discussion"], f"<h3>{word()}</h3>" + "".join(
                f'<{t} class="comment"><p>{sentence()} {sentence()}</p></{t}>' for t in [r.choice(["div", "li", "article"])] for _ in range(r.randint(1, 5)))),
            lambda: box(["div"], ["share", "social", "author", "tags"], links(r.randint(2, 4), "span")),
            lambda: f"<noscript>{sentence(3, 8)}</noscript>",
        ])()

    def plain_extra():
        """Parts that only their tags and texts tell."""
        return r.choice([
            lambda: f"<ul>{links(r.randint(3, 8))}</ul>",
            lambda: f"<div>{links(r.randint(2, 6), 'span')}</div>",
            lambda: f"<nav>{links(r.randint(2, 6), 'a')}</nav>",
            lambda: f'<form action="/{word()}"><label>{word()}</label><input name="q"><button>{word()}</button></form>',
            lambda: f"<footer><p>&copy; {r.randint(1990, 2026)} {word()}. {sentence(2, 5)}</p></footer>",
            lambda: f"<header><a href='/'>{word()}</a></header>",
            lambda: f"<aside><h3>{word()}</h3><ul>{links(r.randint(2, 5), long=True)}</ul></aside>",
        ])()

    out = []
    for _ in range(count):
        title = sentence(4, 9).rstrip(".")
        body = []
        for k in range(r.choice([0, 1, 1, 2, 3, 4, 6, 9])):
            body.append(para())
            if r.random() < 0.12:
                body.append(f"<h2>{_MARK}{sentence(2, 5).rstrip('.')}</h2>")
            if r.random() < 0.08:
                body.append("<ul>" + "".join(f"<li>{_MARK}{sentence(3, 9)}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            if r.random() < 0.05:
                body.append(f"<blockquote>{_MARK}{sentence()}</blockquote>")
            if r.random() < 0.04:
                body.append(f"<noscript>{_MARK}{sentence()} {sentence()}</noscript>")
            if r.random() < 0.06:
                body.append(extra())
        head = f"<h1>{_MARK}{title}</h1>" if r.random() < 0.9 else ""
        head = f"<header>{head}</header>" if head and r.random() < 0.1 else head
        shape = r.random()
        article = head + "".join(body)
        plain = 0.7 <= shape < 0.88
        noise = lambda: f' class="{" ".join(r.sample(["ad-free", "no-sidebar", "with-sidebar", "header-story", "more-info", "single", "post-12", "has-comments", "h-entry", "wide", "format-standard", "page-text", "main-story"], r.randint(1, 2)))}"' if r.random() < 0.35 else ""
        if shape < 0.42:
            article = f"<article{noise()}>{article}</article>"
        elif shape < 0.55:
            article = f"<main{noise()}>{article}</main>"
        elif shape < 0.6:
            article = f'<div role="main"{noise()}><section>{article}</section></div>'
        elif shape < 0.7:
            article = f"<section{noise()}>{article}</section>" if r.random() < 0.4 else f"<div{noise()}><article>{article}</article></div>"
        elif plain:
            deep = r.choice([0, 0, 1, 1, 2, 3])
            article = "<div>" * deep + article + "</div>" * deep
            article = f"<table><tr><td>{article}</td></tr></table>" if r.random() < 0.12 else article
        else:
            article = f'<div class="{r.choice(["content", "post", "entry-content", "article-body", "story"])}">{article}</div>'
        before, after = [], []
        if r.random() < 0.9:
            before.append(box(["nav", "nav", "div"], ["nav", "menu", "navbar"], f"<ul>{links(r.randint(2, 7))}</ul>"))
        if r.random() < 0.4:
            before.insert(r.randint(0, len(before)), box(["header", "header", "div"], ["header", "masthead", "banner"], r.choice([word(), f"<h1>{word()} {word()}</h1>", f"<p>{sentence()}</p>"])))
        for _ in range(r.choice([0, 1, 1, 2])):
            before.append(extra())
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            after.append(extra())
        if r.random() < 0.9:
            after.append(box(["footer", "footer", "div"], ["footer", "copyright", "legal"], f"&copy; {word()}.example &middot; {sentence()}" if r.random() < 0.6 else f"<p>{sentence()}</p><ul>{links(3)}</ul>"))
        if plain and r.random() < 0.6:
            before = [plain_extra() for _ in range(r.choice([0, 0, 1, 2]))]
            after = [plain_extra() for _ in range(r.choice([0, 0, 1, 2]))]
        root = r.choice([' class="home page with-sidebar"', ' class="single post-template"', ' id="page"']) if r.random() < 0.15 else ""
        page = f"<!DOCTYPE html><html><head><title>{title}</title><script>var t='</p>';</script></head><body{root}>{''.join(before)}{article}{''.join(after)}</body></html>"
        if r.random() < 0.1:
            page = page[:r.randint(len(page) // 2, len(page))]
        out.append(page)
    return out


def labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    of = blocks(page)
    y = np.array([_MARK in b.text for b in of], np.int64)
    for b in of:
        b.text = b.text.replace(_MARK, "") or "-"
    return features(of), y


@functools.cache
def model() -> Field:
    """The field of the labelled pages; a second of training, once a process."""
    return fit([labelled(p) for p in labelled_pages()])


def main_text(page: str | None, field: Field) -> str:
    of = blocks(page)
    if not of:
        return ""
    keep = field.viterbi(features(of))
    return "\n\n".join(b.text for b, k in zip(of, keep) if k)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages(page_id, url, html)``.

    Null and empty pages, and pages without an article, have an empty text; a page
    without block-level markup is one block, which the field may take for no article;
    scripts, styles, forms' lists and text areas, drawings and frames have no text,
    formulas do; rows that repeat have a row each; an empty
    table gives no rows; other columns are ignored.
    """
    field = field or model()
    text = F.pandas_udf(lambda col: pd.Series([main_text(p, field) for p in col], dtype=object), "string")
    return pages.select("page_id", "url", text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
