"""Main text by enumeration and on pages of another make; kept columns."""

import itertools
import random

import numpy as np
import pytest

from evispark.llm import htmltext, quality


def fields(seed, n):
    r = np.random.default_rng(seed)
    f = htmltext.Field(r.normal(size=(len(htmltext._names()), 2)), r.normal(size=(2, 2)))
    return f, (r.random((n, len(htmltext._names()))) < 0.2).astype(float)


def path_score(f, x, y):
    s = x @ f.state
    return sum(s[t, y[t]] for t in range(len(y))) + sum(f.step[a, b] for a, b in zip(y, y[1:]))


@pytest.mark.parametrize("seed", range(6))
def test_viterbi_and_gradient_by_enumeration(seed):
    f, x = fields(seed, 7)
    paths = list(itertools.product((0, 1), repeat=7))
    scores = np.array([path_score(f, x, y) for y in paths])
    assert tuple(f.viterbi(x)) == paths[scores.argmax()]
    p = np.exp(scores - scores.max())
    p /= p.sum()
    y = np.array(paths[seed * 5])
    state, step = f.gradient(x, y)
    want_state, want_step = np.zeros_like(f.state), np.zeros_like(f.step)
    for path, weight in [(tuple(y), 1.0), *zip(paths, -p)]:
        for t, label in enumerate(path):
            want_state[:, label] += weight * x[t]
        for a, b in zip(path, path[1:]):
            want_step[a, b] += weight
    assert np.allclose(state, want_state) and np.allclose(step, want_step)


TITLE, ONE, TWO = "Some title here", "First paragraph of the text, which says something. And more.", "Second paragraph goes on with words."
CASES = [
    (f"<body><h1>{TITLE}</h1><p>{ONE}</p><p>{TWO}</p></body>", [TITLE, ONE, TWO]),
    (f"<html><body><div><h1>{TITLE}</h1><p>{ONE}</p><p>{TWO}</p></div></body></html>", [TITLE, ONE, TWO]),
    (f'<body><article class="ad-free header-story"><h1>{TITLE}</h1><p>{ONE}</p><p>{TWO}</p></article></body>', [TITLE, ONE, TWO]),
    (f'<body class="no-sidebar"><nav><a href="/">Home</a></nav><div class="more-info"><h1>{TITLE}</h1><p>{ONE}</p></div><footer>Copyright 2020 x</footer></body>', [TITLE, ONE]),
    (f"<body><article><h1>{TITLE}</h1><p>{ONE}</p><noscript>{TWO}</noscript></article></body>", [TITLE, ONE, TWO]),
    ("<body><nav><ul><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul></nav><footer>&copy; 2020 Example. All rights reserved.</footer></body>", []),
]


@pytest.mark.parametrize("page,want", CASES)
def test_articles_without_a_name(page, want):
    assert htmltext.main_text(page, htmltext.model()) == "\n\n".join(want)


def test_names_and_their_words():
    assert htmltext.hints_of("main-nav cookie-notice") == {"menu", "notice", "part_main", "part_notice"} and htmltext.hints_of("ad-free no-sidebar has-comments") == frozenset()
    assert htmltext.hints_of("header-story") == {"main", "part_head"} and htmltext.hints_of("sideBar") == {"side"} and htmltext.hints_of("x 12") == frozenset()


def other_pages(seed, n):
    """Pages of another make: words of a list, layouts in tables, grids and custom names."""
    r = random.Random(seed)
    words = "market river council report winter machine garden theory signal people number village study reason season language history water music paper".split()
    sentence = lambda a=6, b=18: " ".join(r.choice(words) for _ in range(r.randint(a, b))).capitalize() + r.choice([".", ".", ".", "?", "!"])
    out = []
    for _ in range(n):
        want = [sentence(3, 7).rstrip(".?!")]
        body = f"<h1>{want[0]}</h1>"
        for _ in range(r.randint(2, 7)):
            text = " ".join(sentence() for _ in range(r.randint(2, 5)))
            want.append(text)
            body += f"<p>{text}</p>\n"
        wrap = r.choice(["{}", "<div>{}</div>", "<div class='col-8 grid'>{}</div>", "<div id='c1'><div class='inner'>{}</div></div>", "<section class='block block-news'>{}</section>", "<main>{}</main>", "<article class='node'>{}</article>"])
        top = r.choice(["", "<header><a href='/'>Daily</a></header>", "<nav class='nav-primary'>" + "".join(f"<a href='/{w}'>{w}</a> " for w in r.sample(words, 5)) + "</nav>", "<ul class='main-menu'>" + "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in r.sample(words, 5)) + "</ul>"])
        end = r.choice(["", f"<footer>&copy; 2024 {r.choice(words)} Ltd. All rights reserved.</footer>", "<aside class='widget-area'><h3>Latest</h3><ul>" + "".join(f"<li><a href='#'>{sentence(4, 8)}</a></li>" for _ in range(4)) + "</ul></aside>",
                        "<form class='newsletter'><label>Your mail</label><input><button>Send</button></form>", "<div class='cookie-banner'><p>We use cookies on this site.</p><button>Fine</button></div>"])
        out.append((f"<!doctype html><html><head><title>x</title></head><body>{top}{wrap.format(body)}{end}</body></html>", want))
    return out


def test_pages_of_another_make():
    field, right, blocks = htmltext.model(), 0, 0
    for page, want in other_pages(11, 300):
        got = htmltext.main_text(page, field).split("\n\n")
        every = {b.text for b in htmltext.blocks(page)}
        right += sum((b in got) == (b in want) for b in every)
        blocks += len(every)
    assert right / blocks > 0.97


def test_no_pages_and_a_long_page(spark):
    kind = "page_id long, url string, html string, Text string"
    assert htmltext.extract(spark.createDataFrame([], kind)).count() == 0
    long = "<article>" + "<p>Words that go on, and on. Then more of them follow.</p>" * 20_000 + "</article>"
    (r,) = htmltext.extract(spark.createDataFrame([(1, "u", long, "x")], kind).drop("Text")).collect()
    assert r.n_chars == len(r.text) == 20_000 * 51 + 19_999 * 2


def test_kept_rows_keep_their_columns(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["fine", "words", "stand", "here."]) for _ in range(60)) if i % 2 else "$$ %% 11 " * 30, 5.0 + i, i, 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score double, `a.b` int, score_ int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = quality.keep_good(docs, labels)
    assert got.columns == docs.columns
    kept = {x.doc_id: x for x in got.collect()}
    assert kept and all(x["Score"] == 5.0 + i and x["a.b"] == i for i, x in kept.items()) and set(kept) <= {i for i in range(60) if i % 2}


def test_lm_scores_do_not_hang_on_partitions(spark, monkeypatch):
    from evispark.llm import mixlm

    monkeypatch.setattr(mixlm, "SHARD", 20_000)
    r = random.Random(9)
    vocab = ["".join(r.choice("etaoinshrd") for _ in range(r.randint(2, 8))) for _ in range(400)]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 300)))) for i in range(120)] + [(500, None), (501, ""), (502, "x " * 9000), (502, "x " * 9000), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = ({(x.doc_id, x.n_tokens): x.score for x in mixlm.score(docs.repartition(n)).collect()} for n in (3, 17))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) <= 1e-9 * abs(one[k]) for k in one)
