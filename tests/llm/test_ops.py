"""Training-data operators against brute force, exact round trips and held-out accuracy, on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evispark.llm import annforest, common, decontaminate, htmltext, mixing, mixlm, passages, quality, simhash, substrings, tokenstore

DOCS = "doc_id long, text string, source string, extra int"


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


def corpus(seed=1, n=60):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append((i, "\n".join(sentence(r, r.randint(5, 60)) for _ in range(r.randint(1, 4))), f"s{i % 3}", 0))
    shared = sentence(r, 60)
    rows[5] = (5, rows[4][1], "s1", 0)
    rows[7] = (7, rows[7][1] + " " + shared + " end of it", None, 0)
    rows[9] = (9, "start " + shared + " and " + rows[9][1], "s0", 0)
    w = rows[20][1].split()
    if len(w) > 30:
        w[3] = "changed"
    rows[21] = (21, " ".join(w), "s2", 0)
    return rows + [(100, None, "s0", 0), (101, "", "s0", 0), (102, "  \n ", None, 0), (103, "one", "s1", 0), (103, "one", "s1", 0), (None, "no id here", "s1", 0), (104, "x y " * 3000, "s1", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_simhash_brute_force(spark, docs, empty):
    got = simhash.near_duplicates(docs).collect()
    rows = [(r.doc_id, simhash.fingerprint(r.text)) for r in docs.collect()]
    assert sorted(map(repr, ((r.doc_id, int(r.fingerprint, 16)) for r in got))) == sorted(map(repr, rows))
    comp = {i: i for i, _ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for i, a in rows:
            for j, b in rows:
                if i is not None and j is not None and (a ^ b).bit_count() <= 3 and comp[i] > comp[j]:
                    comp[i], changed = comp[j], True
    assert all(r.component_id == comp[r.doc_id] for r in got if r.doc_id is not None)
    assert simhash.near_duplicates(empty).count() == 0
    kept = {r.doc_id for r in simhash.keep_similar_one(docs).collect()}
    assert 4 in kept and 5 not in kept and None in kept


def test_trie_links_equal_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    v = np.unique(np.concatenate([base ^ np.uint64(1 << int(rng.integers(0, 40))) ^ np.uint64(1 << int(rng.integers(0, 40))) for _ in range(12)]))
    g = (v >> np.uint64(48)).astype(np.int64)
    lab = simhash.trie_links(g, v)
    want = np.arange(len(v))
    i, j = np.nonzero((np.bitwise_count(v[:, None] ^ v[None]) <= 3) & (g[:, None] == g[None]))
    simhash._settle(want, i, j)
    assert (lab == want).all()


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 50), (100, 60), (60, 50)], "u long, v long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and got[100] == got[60] == 50
    assert common.components(edges.limit(0)).count() == 0


def test_lm_counts_and_probability(spark, docs, empty):
    got = {r.doc_id: r for r in mixlm.score(docs.where("doc_id <> 103"), hot=50).collect()}
    train = {}
    for r in docs.where("doc_id <> 103").collect():
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            for w in [*mixlm.words_of(r.text), b""]:
                train[w] = train.get(w, 0) + 1
    n, v = sum(train.values()), len(train)
    for r in docs.where("doc_id <> 103").collect():
        w = [*mixlm.words_of(r.text), b""]
        g = got[r.doc_id]
        assert g.n_tokens == len(w) and g.n_known == sum(x in train for x in w) and g.train_tokens == n
        assert abs(g.base_score - sum(np.log10((train.get(x, 0) + 1) / (n + v + 1)) for x in w)) < 1e-6 * len(w)
        assert g.score < 0
    assert mixlm.score(empty).count() == 0


def stream(texts):
    (_, s), = mixlm.Texts(pa.array(texts, pa.string())).streams()
    return s


def model(texts):
    """Tables, weights and map learned from ``texts``, counted bit by bit."""
    s, bits = stream(texts), (12,) * len(mixlm.TABLES)
    b, counts = mixlm.Bits(s), np.zeros((mixlm._offsets(bits)[-1], 2), np.uint16)
    np.add.at(counts, (b.slots(s, bits, slice(None)), b.bit), 1)
    m = mixlm.Model(bits, mixlm.squeeze(*counts.astype(np.float32).T))
    m.learn(s, counts, False)
    m.learn(s, counts, True)
    return m, counts


def test_lm_bits_spell_the_text():
    """The codes give the bytes back, and a match expects the byte after the last place with the same bytes before."""
    texts = ["Ab  c\u00e9 ~x" + " once more this goes on" * 3, None, "", "q"]
    s = stream(texts)
    want = [b" ".join([*mixlm.words_of(t), b""]) + b" " for t in texts]
    assert bytes(s.raw) == b"".join(want)
    b, got = mixlm.Bits(s), []
    for i in range(len(s.raw)):
        x = "".join(map(str, b.bit[b.of == i]))
        got.append(int(x[5:], 2) if x[:5] == "11111" else mixlm.USUAL[int(x[:5], 2)])
    assert bytes(got) == bytes(s.raw)
    first = want[0]
    for i in range(len(first)):
        at = max((j for j in range(mixlm.REACH, i) if i >= mixlm.REACH and first[j - mixlm.REACH:j] == first[i - mixlm.REACH:i]), default=-1)
        assert s.guess[i] == (first[at] if at >= 0 else -1)


def test_lm_mix_brute_force():
    """Lanes equal a plain loop over the bits of each segment, weight by weight."""
    r = random.Random(3)
    m, _ = model([sentence(r, 80) for _ in range(30)])
    s = stream([sentence(r, 900), "", sentence(r, 30), "again and again " * 40])
    b = mixlm.Bits(s)
    z = m.mixed(s, b)
    at, first = b.slots(s, m.bits, slice(None)), {0, *s.end.tolist()}
    begin = 0
    for i in range(len(b.of)):
        byte = int(b.of[i])
        if b.place[i] == 0:
            begin = byte if byte in first else begin
            if (byte - begin) % mixlm.SEGMENT == 0:
                w = m.weights.astype(float).copy()
        cell = [int(x) for x in m.cells[at[:, i]]]
        st, conf = [((c & 255) - 128) / 12 for c in cell] + [int(b.match[i]) * 2.0], [c >> 8 for c in cell] + [int(b.run[i])]
        known = min((max(conf[5], conf[4] if conf[5] == 0 else 0) + 1) // 2, mixlm.KNOWN - 1)
        gate = int(b.place[i]) * mixlm.KNOWN + known
        mix = sum(w[gate, k, c] * x for k, (c, x) in enumerate(zip(conf, st)))
        assert abs(max(-15, min(15, mix)) - z[i]) < 2e-3
        for k, (c, x) in enumerate(zip(conf, st)):
            w[gate, k, c] += mixlm.LANE_RATE * (b.bit[i] - 1 / (1 + np.exp(-mix))) * x


def test_lm_is_a_distribution_and_sequential():
    r = random.Random(4)
    m, _ = model([sentence(r, 80) for _ in range(20)])
    one = [bytes([b]).decode() for b in range(33, 127) if not 65 <= b <= 90]
    assert 0 < sum(10 ** float(m.score(stream([x]))[0]) for x in ["", *one]) < 1
    words = (sentence(r, 30) + " ") * 3
    mixed = words.split()
    r.shuffle(mixed)
    whole, shuffled = m.score(stream([words, " ".join(mixed)]))
    assert whole > shuffled
    alone = m.score(stream([words]))[0]
    assert abs(whole - alone) < 1e-3


def test_lm_long_texts_in_runs(monkeypatch):
    r = random.Random(5)
    texts = [sentence(r, 400), "", sentence(r, 3), None, sentence(r, 300), ""]
    monkeypatch.setattr(mixlm, "SLICE", 500)
    owner, raw = [], [b""] * len(texts)
    for o, s in mixlm.Texts(pa.array(texts, pa.string())).streams():
        for i, (a, b) in enumerate(zip([0, *s.end[:-1]], s.end)):
            raw[o[i]] += bytes(s.raw[a:b])
            owner.append(int(o[i]))
    assert raw == [b"".join(w + b" " for w in [*mixlm.words_of(t), b""]) for t in texts]
    assert owner == sorted(owner) and len(owner) > len(texts)


def test_decontaminate(spark, docs, empty):
    items = [(1, docs.where("doc_id = 20").first().text[:120]), (2, "never to be seen in any of these texts at all, surely"), (3, None), (4, " ")]
    b = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, b).collect()}
    assert {(20, 1), (21, 1)} <= found and all(i == 1 for _, i in found)
    left = {r.doc_id for r in decontaminate.keep_clean(docs, b).collect()}
    assert not left & {d for d, _ in found} and 100 in left
    assert decontaminate.matches(empty, b).count() == 0 and decontaminate.matches(docs, b.limit(0)).count() == 0


def test_myers_equals_dynamic_programme():
    r = random.Random(3)
    for _ in range(60):
        p, t = ("".join(r.choice("abc") for _ in range(r.randint(1, n))) for n in (8, 20))
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            new = [0]
            for i, x in enumerate(p):
                new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
            row = new
            best = min(best, row[-1])
        assert decontaminate.myers(p, t)[0] == best


def test_token_store_round_trip(spark, docs, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    path, vocab = f"file://{tmp_path}/store", P.path("byte_bpe_50k.json")
    rows = docs.union(spark.createDataFrame([(200, "a  b\n c  d  ", "s", 0), (201, "<|endoftext|> it's 12a", "s", 0)], DOCS))
    tokenstore.write(rows, path, vocab)
    assert tokenstore.verify(spark, path)
    tok = tokenstore.Encoder(vocab).tokenizer
    want = sorted(((r.doc_id, tok.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in rows.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    got = tokenstore.read(spark, path).orderBy("start").collect()
    ids = {r.start: r.ids for r in tokenstore.read_ids(spark, path).collect()}
    start = 0
    for (d, i), r in zip(want, got, strict=True):
        assert (r.doc_id, r.start, r.n_tokens) == (d, start, len(i)) and ids[start] == i
        assert r.ids_crc32 == zlib.crc32(np.array(i, "<u4").tobytes())
        start += len(i)


def test_ann(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    x[10] = x[11]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] + [1.0] * 15)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = annforest.search(t, t.where("vec_id % 20 = 0"), 5).collect()
    hit = 0
    for q in range(0, 400, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        best = set(np.lexsort((np.arange(400), -s))[:5].tolist())
        mine = sorted((r.rank, r.vec_id) for r in got if r.query_id == q)
        assert [k for k, _ in mine] == [1, 2, 3, 4, 5]
        hit += len(best & {v for _, v in mine})
    assert hit >= 0.9 * 100 and annforest.search(t.limit(0), t, 5).count() == 0


def test_passages(spark, docs, empty):
    got = passages.repeats(docs).collect()
    assert {4, 5, 7, 9} <= {r.doc_id for r in got}
    assert any(r.kind == "P" and r.removed and r.doc_id == 5 and r.keep_doc_id == 4 for r in got)
    assert passages.repeats(empty).count() == 0


def brute_substrings(rows, k=200):
    seen = {}
    raws = [(t or "").encode() for t in rows]
    for b in raws:
        for j in range(len(b) - k + 1):
            seen[b[j:j + k]] = seen.get(b[j:j + k], 0) + 1
    out = []
    for b in raws:
        on = np.zeros(len(b), bool)
        for j in range(len(b) - k + 1):
            if seen[b[j:j + k]] > 1:
                on[j:j + k] = True
        kept = bytes(x for x, o in zip(b, on) if not o)
        spans = int((np.diff(np.concatenate(([0], on.astype(int)))) == 1).sum())
        out.append((len(b), int(on.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2, 200_000])
def test_substrings(spark, docs, empty, hot):
    rows = docs.collect()
    want = sorted(zip([str(r.doc_id) for r in rows], brute_substrings([r.text for r in rows])))
    got = sorted((str(r.doc_id), (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in substrings.dedup(docs, hot).collect())
    assert got == want and substrings.dedup(empty).count() == 0


def test_html(spark):
    f = htmltext.model()
    ok = n = 0
    for p in htmltext.labelled_pages(60, seed=77):
        x, y = htmltext.labelled(p)
        if len(y):
            ok, n = ok + int((f.viterbi(x) == y).sum()), n + len(y)
    assert ok / n > 0.97
    page = "<html><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>A &amp; B</h1><p>One\n two<br>three. It goes on here.<p>Four &lt; five, said the writer of it.</article><footer>&copy; me</footer>"
    t = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (3, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.extract(t).collect()}
    assert got[1][0] == "A & B\n\nOne two three. It goes on here.\n\nFour < five, said the writer of it." and got[2] == ("", 0) and got[1][1] == len(got[1][0])


def test_quality(spark):
    r = random.Random(6)
    rows = [(i, " ".join(w + ("###" if i % 2 else "") for w in sentence(r, 40).split()), "s", 0) for i in range(300)] + [(900, None, "s", 0), (901, "", "s", 0)]
    d = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(300)] + [(5000, 1), (None, 1)], "doc_id long, quality int")
    got = quality.classify(d, labels).collect()
    held = [x for x in got if x.held_out and x.doc_id < 300]
    assert len(held) > 50 and all(x.predicted == 1 - x.doc_id % 2 for x in held)
    assert all(0 <= x.score <= 1 for x in got) and len(got) == 302
    assert {x.score for x in quality.classify(d, labels.limit(0)).collect()} == {0.5}


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs).collect()
    size = {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.size
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    assert abs(sum({r.source: r.target for r in got}.values()) - sum(size.values())) < 1e-6
    for s in size:
        taken, target = sum(r.taken for r in got if r.source == s), next(r.target for r in got if r.source == s)
        assert target <= 3 * size[s] + 1e-9 and abs(taken - target) <= max(r.size for r in got if r.source == s)
    assert mixing.mix(empty).count() == 0
    assert sorted(map(repr, mixing.mix(docs).collect())) == sorted(map(repr, got))
    weighted = mixing.mix(docs.withColumn("w", F.lit(1.0) + F.col("doc_id") % 2), importance="w").where("size > 0")
    assert weighted.where("copies > 3").count() == 0
