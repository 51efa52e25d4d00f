"""Operators against brute force where a cut would show: pairs around the threshold, short units, special tokens."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.llm import common, decontaminate, htmltext, mixing, passages, quality, simhash, tokenstore, verified

DOCS = "doc_id long, text string"


def near_pairs(n=120, size=200, seed=5):
    """Texts, each with a copy in which some words are changed, from similarity 0.65 to 0.9."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(size)]
        c = list(w)
        for j in r.sample(range(size), 3 + i % 8):
            c[j] = "changed" + str(r.random())
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(c))]
    return rows


def groups(rows, similarity=0.8, words=5):
    """The least id of each text's group, by all pairs."""
    sets = [(d, set(simhash.hashes(t, words).tolist())) for d, t in rows]
    top = {d: d for d, _ in rows}
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and len(x & y) >= similarity * len(x | y)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(top[a], top[b])
            if top[a] != top[b]:
                top[a] = top[b] = low
                changed = True
    return top, links


def chain(seed=9, n=12, size=120):
    """Texts that each are near the next one only."""
    r = random.Random(seed)
    w = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(size)]
    rows = []
    for i in range(n):
        rows.append((10_000 + (7 * i) % n, " ".join(w)))
        w = w[3:] + ["n" + str(r.random()) for _ in range(3)]
    return rows


def test_near_dedup_equals_all_pairs(spark):
    rows = near_pairs() + chain()
    top, links = groups(rows)
    assert 20 < len(links) < 110
    got = {r.doc_id for r in simhash.keep_similar_one(spark.createDataFrame(rows, DOCS)).collect()}
    want = {d for d, t in top.items() if d == t}
    assert not want - got, "clean texts removed"
    assert got == want


def test_tokens_equal_the_library(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    vocab = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(vocab)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n it's", "plain text here", "a  b <|endoftext|", None, "", "end <|endoftext|>"]
    want = [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 220, 50256, 275]
    enc = tokenstore.Encoder(vocab)
    assert [enc.encode(t).tolist() for t in texts] == want
    path = f"file://{tmp_path}/store"
    tokenstore.write(spark.createDataFrame(list(enumerate(texts)), DOCS), path, vocab)
    got = {r.doc_id: list(r.ids) for r in tokenstore.read_ids(spark, path).collect()}
    assert [got[i] for i in range(len(texts))] == [w + [0] for w in want]


def test_passages_equal_all_pairs(spark):
    rows = near_pairs(60, seed=8)
    sets = {d: set(passages.shingle_set(passages.word_hashes(t)).tolist()) for d, t in rows}
    want = {d for d, _ in rows if d % 2 and len(sets[d] & sets[d - 1]) >= 0.8 * len(sets[d] | sets[d - 1])}
    got = passages.repeats(spark.createDataFrame(rows, DOCS)).where("kind = 'P' and removed").collect()
    assert 5 < len(want) < 50 and {r.doc_id for r in got} == want and all(r.keep_doc_id == r.doc_id - 1 for r in got)


def test_dense_groups_keep_all_links(spark):
    """Groups of near copies around the threshold: components equal those of all pairs, for both users of the links."""
    r, rows = random.Random(3), []
    for g in range(40):
        w = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(90)]
        for k in range(6):
            c = list(w)
            for j in r.sample(range(90), r.choice([0, 1, 1, 2, 2, 3])):
                c[j] = "x" + str(r.random())
            rows.append((10 * g + k, " ".join(c)))
    top, _ = groups(rows)
    df = spark.createDataFrame(rows, DOCS)
    assert {x.doc_id for x in simhash.keep_similar_one(df).collect()} == {d for d, t in top.items() if d == t}
    sets = {d: set(passages.shingle_set(passages.word_hashes(t)).tolist()) for d, t in rows}
    own = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and own[a] != own[b]:
                low, high = sorted((own[a], own[b]))
                own = {k: low if v == high else v for k, v in own.items()}
    got = {x.doc_id: x.keep_doc_id for x in passages.repeats(df).where("kind = 'P'").collect()}
    assert {d: got.get(d, d) for d in own} == own


@pytest.mark.parametrize("shard", [1_000_000, 300])
def test_open_groups_in_shards(spark, monkeypatch, shard):
    monkeypatch.setattr(verified, "SHARD", shard)
    r = random.Random(4)
    base = [r.getrandbits(60) for _ in range(80)]
    sets = {i: set(base) - set(r.sample(base, 3 + i % 9)) | {r.getrandbits(60) for _ in range(3 + i % 7)} for i in range(60)}
    sets[60], sets[61] = set(), set()
    first = spark.createDataFrame([(7, 0, i) for i in range(1, 62)], "g long, u long, v long")
    of = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "node long, s array<long>")
    links = verified.links(first, lambda n: of.join(n, "node", "left_semi"), 0.8, "t")
    got = {x.node: x.component for x in common.components(links).collect()}
    want = {i: i for i in sets}
    for a in sets:
        for b in range(a):
            both = len(sets[a] | sets[b])
            if (len(sets[a] & sets[b]) >= 0.8 * both if both else True) and want[a] != want[b]:
                low, high = sorted((want[a], want[b]))
                want = {k: low if v == high else v for k, v in want.items()}
    assert {i: got.get(i, i) for i in sets} == want and len(set(want.values())) > 3


def test_short_paragraphs_that_repeat(spark):
    rows = [(1, "five words in this line\nonly one here"), (2, "other text of its own here\nfive words in this line"), (3, "only one here"), (None, None), (4, "")]
    got = {(x.doc_id, x.start, x.removed) for x in passages.repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(1, 0, False), (2, 6, True)}  # fewer than five words have no shingle


def test_near_dedup_is_by_row(spark):
    a, b = "one two three four five six seven eight nine ten", "a wholly other text that stands by itself in this table"
    rows = [(1, a), (2, b), (2, a), (2, a), (None, a), (None, "alone without any id in all of this table"), (3, None), (4, ""), (5, " ")]
    got = sorted(map(str, (tuple(x) for x in simhash.keep_similar_one(spark.createDataFrame(rows, DOCS)).collect())))
    assert got == sorted(map(str, [(1, a), (2, b), (None, "alone without any id in all of this table"), (3, None)]))


def test_mix_is_applied_as_taken(spark):
    rows = [(i % 7, "w " * (3 + i % 5), f"s{i % 2}", i) for i in range(60)] + [(9, "same text", "s2", 1)] * 41 + [(10, None, None, 0), (11, "", "s0", 0), (None, "x y", None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    for name in ("rows", "i", "s", "t", "n", "_n", "size", "weight", "tie", "row", "target", "bin", "q", "Cut"):
        df = df.withColumn(name, F.lit("z"))
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    words = {x.source: x.n for x in out.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("n")).collect()}
    taken = {x.source: x.n for x in mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert words == {k: v for k, v in taken.items() if v}
    assert mixing.apply_mix(df.limit(0)).count() == 0


def test_decontaminate_equals_all_texts_by_all_items(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(r.choice([2, 5, 12, 30])))) for i in range(40)] + [(50, "aé ☃ b c d e f g h i j k l m n")]
    docs = []
    for i in range(120):
        t = [word() for _ in range(r.randint(0, 60))]
        own = list(r.choice(items)[1])
        for _ in range(r.randint(0, 1 + len(own) // 8)):
            own[r.randrange(len(own))] = r.choice(["", "z", "ab"])
        docs.append((i, " ".join(t[:20]) + " " + "".join(own) + " " + " ".join(t[20:])))
    docs += [(200, None), (201, ""), (202, " ".join(word() for _ in range(30_000)) + " " + items[3][1])]

    def least(p, t):
        row = np.arange(len(p) + 1)
        best, codes = row[-1], np.array([ord(c) for c in p])
        for c in t:
            new = np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)
            row = np.minimum.accumulate(np.concatenate(([0], new)) - np.arange(len(p) + 1)) + np.arange(len(p) + 1)
            best = min(best, row[-1])
        return int(best)

    want = set()
    for d, t in docs[:122]:
        for i, p in items:
            t_, p_ = decontaminate.normal(t), decontaminate.normal(p)
            edits = least(p_, t_)
            if edits <= decontaminate.budget(len(p_)):
                want.add((d, i, edits))
    got = {(x.doc_id, x.item_id, x.edits) for x in decontaminate.matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {x for x in got if x[0] < 202} == want and len(want) > 60 and (202, 3, 0) in got


def test_formulas_and_plain_pages():
    f = htmltext.model()
    page = "<article><h1>On areas</h1><p>The area is <math><mi>x</mi></math> metres wide, as the writer says, and no more.</p><p>It goes on for a while here, with words and points.</p></article>"
    assert "The area is x metres wide" in htmltext.main_text(page, f)
    long_ = "<article><p>" + "A sentence of the text goes here. " * 20_000 + "</p></article>"
    assert len(htmltext.main_text(long_, f)) > 600_000 and htmltext.main_text(None, f) == "" == htmltext.main_text("", f)


def test_stages_on_empty_and_odd_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a passage of the benchmark that is long enough")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "s", 0), (3, "word " * 50_000, "en", "s", 1), (3, "another text", None, "s", 1)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name == "token ids" or out.columns == docs.columns
            assert out.count() <= 3 * len(rows)
