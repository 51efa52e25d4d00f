"""The trie, collocations and cover trees against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from evispark.llm import covertree, phrases, prefixtrie

TURNS = "text string, conv_id long, rep int, turn long, role string, K1 int"


def plain_trie(rows):
    """Nodes of the rebuilt conversations, by one walk for each."""
    of = {}
    for text, c, _, turn, role, _ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            of.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in of.items()}
    nodes = {}
    for c in sorted(turns):
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
        path = turns.get(base, [])[:h] + turns[c][h:]
        for d in range(len(path) + 1):
            node = nodes.setdefault(tuple(path[:d]), {"in": [], "end": []})
            node["in"].append(c)
        node["end"].append(c)
    out = []
    for path, node in nodes.items():
        below = {p: n for p, n in nodes.items() if p[:len(path)] == path}
        parents = {p[:-1] for p in nodes if p}
        out.append((node["in"][0], len(path), nodes[path[:-1]]["in"][0] if path else None, len(node["in"]), sum(len(p) == len(path) + 1 for p in below), sum(p not in parents for p in below),
                    sum((len(n["in"]) - 1) * len(p[-1][1]) for p, n in below.items() if p), hashlib.sha256(",".join(map(str, node["end"])).encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(seed=3):
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(95, 130), -7, -120, 250, 301]:
        for t in range(r.randint(1, 8)):
            rows.append((r.choice(["hi", "yes", "no", None, "", "ünïcode"]), c, 0, t, r.choice(["user", "bot", None]), 1))
    rows += [("same", c, 0, t, "user", 1) for c in range(400, 460) for t in range(9)]
    rows += [("same", 470, 0, t, "user", 1) for t in range(2600)] + [("same", 471, 0, t, "user", 1) for t in range(2600)]
    rows += [("tie", 480, 0, 0, "a", 1), ("tie", 480, 0, 0, "a", 1), ("other", 480, 0, 0, "b", 1), ("null first", 480, 0, None, "a", 1), ("lost", None, 0, 1, "a", 1), ("x" * 200_000, 481, 0, 1, "a", 1)]
    return rows


def test_trie_against_walks(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "BLOCK", 64)
    rows = [x for x in talks() if x[1] not in (470, 471)] + [x for x in talks() if x[1] in (470, 471) and x[3] < 150]
    got = prefixtrie.conversation_trie(spark.createDataFrame(rows, TURNS).repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_trie(rows)


def test_trie_of_long_copies_and_nothing(spark):
    rows = [x for x in talks() if x[1] in (470, 471)]
    got = prefixtrie.conversation_trie(spark.createDataFrame(rows, TURNS)).orderBy("depth").collect()
    heads = [zlib.crc32(str(c).encode()) % 6 for c in (470, 471)]  # their base is not there
    assert len(got) == 2601 - min(heads) and sum(r.n_children == 0 for r in got) == got[0].n_leaves
    assert prefixtrie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    one = prefixtrie.conversation_trie(spark.createDataFrame([("a", 101, 0, 1, "u", 1)], TURNS)).collect()
    assert len(one) == (1 if zlib.crc32(b"101") % 6 else 2) and one[0].n_convs == 1


def plain_collocations(rows, max_n=3, least=10, covered=50, top=2000):
    f, n = {}, Counter()
    for lang, text, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f.setdefault(lang, Counter()).update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand, best = [p for p, a in c.items() if len(p) > 1 and a >= least], []
        for p in cand:
            a = c[p]
            score, k = min(((1_000_000 * a * a // (c[p[:k]] * c[p[k:]])), k) for k in range(1, len(p)))
            longer = [q for q in cand if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
            if not any(100 * c[q] >= covered * a for q in longer):
                best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, le, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, le, r, n[lang], -s))
    return sorted(out)


def babble(seed=5, docs=120):
    r = random.Random(seed)
    vocab = ["a", "B", "the", "The", "of", "ü", "x\x01", "x", "\x00", "x\x01y", "été", "10%", "|", "λ"]
    rows = [(r.choice(["en", "fr", None, "a\tb"]), "".join(r.choices(vocab, weights=range(14, 0, -1))[0] + r.choice([" ", "  ", "\t", " ", " ", ". ", "\n", ",", " \r\n"]) for _ in range(r.randint(0, 200))), 1) for _ in range(docs)]
    return rows + [("en", None, 1), ("en", "", 1), (None, " \t\n", 1), ("de", "ja " * 5000, 1), ("de", "ja " * 5000, 1)]


@pytest.mark.parametrize("together", [50, phrases.TOGETHER])
def test_collocations_against_counters(spark, monkeypatch, together):
    monkeypatch.setattr(phrases, "TOGETHER", together)
    rows = babble()
    docs = spark.createDataFrame(rows, "lang string, text string, k1 int").repartition(3)
    for top in (2000, 7):
        got = [tuple(r) for r in phrases.collocations(docs, top=top).collect()]
        assert sorted(got) == plain_collocations(rows, top=top)
    got = [tuple(r) for r in phrases.collocations(docs, 4, 3, 70, None).collect()]
    assert sorted(got) == plain_collocations(rows, 4, 3, 70, 10**9)


def test_collocations_count_in_batches_and_nothing(spark):
    """The stack carries prefixes from batch to batch."""
    import pyarrow as pa

    rows = babble(9, 30)
    whole = phrases._suffixes(iter([pa.RecordBatch.from_arrays([pa.array([(x[0] or "und").encode() for x in rows]), pa.array([(x[1] or "").encode() for x in rows])], ["lang", "text"])]), 3)
    table = pa.Table.from_batches(whole).sort_by([("k1", "descending"), ("w2", "descending"), ("w3", "descending")])
    results = []
    for size in (1, 3, 7, 10_000):
        found = pa.Table.from_batches(phrases._counts(iter(table.to_batches(max_chunksize=size)), 3, 2)).to_pylist()
        results.append(sorted(map(repr, found)))
    assert all(x == results[0] for x in results) and len(results[0]) > 50
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def plain_links(rows, cos=0.95):
    v = []
    for _, x in rows:
        ok = x and all(c is not None and math.isfinite(c) for c in x) and any(x)
        v.append(covertree.unit(np.array([x], float))[0] if ok else None)
    n, comp = [0] * len(rows), [r[0] for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if v[i] is not None and v[j] is not None and rows[i][0] is not None and rows[j][0] is not None and len(v[i]) == len(v[j]) and v[i] @ v[j] >= cos]
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if comp[i] != comp[j]:
                comp[i] = comp[j] = min(comp[i], comp[j])
                changed = True
    return sorted((repr((i, n[k], comp[k], i is not None and i == comp[k])) for k, (i, _) in enumerate(rows)))


def clouds(seed=2, dim=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, dim))
    x = [r.normal(size=dim) for _ in range(60)]
    for c, noise in zip(centres, (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 1e-5)):
        x += [c * r.uniform(0.5, 2) + r.normal(size=dim) * noise for _ in range(60)]
    x = [list(map(float, np.float32(v))) for v in x]
    rows = [(i * 3, v) for i, v in enumerate(x)]
    rows += [(5000 + i, x[70]) for i in range(90)] + [(7, x[70]), (7, x[140]), (7, x[141]), (None, x[0])]
    rows += [(6000, None), (6001, []), (6002, [0.0] * dim), (6003, [1.0, None] + [0.0] * (dim - 2)), (6004, [float("nan")] * dim), (6005, [float("inf")] + [1.0] * (dim - 1)), (6006, [1.0, 2.0]), (6007, [2.0, 4.0]), (6008, [1e30] * dim), (6009, [1e-30] * dim)]
    return rows


@pytest.mark.parametrize("chunk,direct,most", [(8192, 1 << 18, 4096), (40, 16, 4096), (25, 400, 3), (8, 1, 500)])
def test_cover_trees_against_all_pairs(spark, monkeypatch, chunk, direct, most):
    monkeypatch.setattr(covertree, "DIRECT", direct)
    rows = clouds()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as Node", "2 as cell").repartition(3)
    got = [repr(tuple(r)) for r in covertree.near_duplicates(df, chunk=chunk, most=most).collect()]
    assert sorted(got) == plain_links(rows)


@pytest.mark.parametrize("direct", [1, 64, 1 << 18])
def test_dual_traversal_in_one_process(monkeypatch, direct):
    """Trees and their traversal, with themselves and with one another, at several thresholds."""
    monkeypatch.setattr(covertree, "DIRECT", direct)
    x = covertree.unit(np.array([v for _, v in clouds(4)[:540]]))
    for cos in (0.5, 0.95, 0.999999):
        order, *nodes = covertree.build(x)
        lo, hi, radius, _ = nodes
        assert sorted(order.tolist()) == list(range(540))
        for a, b, r in zip(lo, hi, radius):
            assert covertree.apart(x[order[a:b]] @ x[order[a]]).max() <= r + 1e-7
        tree = covertree.Tree(x[order], np.ones(540, np.int64), *nodes)
        pairs = covertree.Pairs(tree, tree, cos)
        pairs.run()
        near = tree.x @ tree.x.T >= cos
        assert (pairs.counts[0] == near.sum(axis=1) - 1).all()
        half = [covertree.build(x[:270]), covertree.build(x[270:])]
        two = [covertree.Tree(y[o[0]], np.ones(270, np.int64), *o[1:]) for y, o in zip((x[:270], x[270:]), half)]
        pairs = covertree.Pairs(*two, cos)
        pairs.run()
        near = two[0].x @ two[1].x.T >= cos
        assert (pairs.counts[0] == near.sum(axis=1)).all() and (pairs.counts[1] == near.sum(axis=0)).all()


def test_cover_trees_of_nothing(spark):
    assert covertree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    got = covertree.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("name", ["op11_trie", "op12_phrases", "op13_embeddings"])
def test_twins(spark, name):
    import os

    import duckdb

    from evispark.llm import queries

    where = "/root/testdata/sf0.001"
    if not os.path.isdir(where):
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        c.sql(f"create view {t} as select * from '{where}/{t}.parquet'")
    df, rel = queries.QUERIES[name](spark, where), c.sql(queries.ORACLES[name])
    cols = sorted(df.columns)
    at = [rel.columns.index(x) for x in cols]
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
