"""Tests for the finding that op2_lm was stopped on 0.51 GB."""

import os
import random
import sys
import time

import numpy as np
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from evispark.llm import compiled, mixlm  # noqa: E402


def word(r, most=7):
    return "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, most)))


def raw_of(spark, texts):
    return spark.createDataFrame([(t.encode(),) for t in texts], "text binary").coalesce(1)


def test_lm_counts_of_many_words(spark):
    """More distinct words than a task holds, words that recur, and counts beyond 16 bits are those of each bit."""
    r = random.Random(21)
    texts = [" ".join(f"{i:05x}" for i in range(lo, lo + 20000)) for lo in range(0, 140_000, 20000)]
    texts += ["the cat of the " * 6000, " ".join(word(r, 20) + r.choice(["", "é", "X7"]) for _ in range(20000)), "z" * 3000, ""]
    bits = (12,) * len(mixlm.TABLES)
    want = np.zeros((mixlm._offsets(bits)[-1], 2), np.int64)
    for t in texts:
        for _, s in mixlm.Texts(pa.array([t], pa.string())).streams(mixlm.MANY):
            b = mixlm.Bits(s)
            np.add.at(want, (b.slots(s, bits, slice(None)), b.bit), 1)
    assert want.max() > 65535
    want = np.minimum(65535, np.ceil(want * np.minimum(1, 65535 / np.maximum(want.max(1, keepdims=True), 1))))  # 65536 became 0 before
    made = mixlm._counts(raw_of(spark, texts), bits)
    got = np.array(list(made.value()), "U1").view(np.uint32).reshape(-1, 2)
    odd = (want >= 0xD800) & (want < 0xE000)  # no characters of their own, so not to be had here
    assert ((got == want) | odd).all() and odd.mean() < 0.05


def test_lm_words_that_take_each_others_place(spark):
    """Cells kept for a word are its own, also when more words recur than are kept; learned weights, map and scores are numpy's."""
    r = random.Random(22)
    words = [word(r, 9) for _ in range(15000)] + ["café", "x" * 15, "y" * 16, "w" * 300]
    texts = [" ".join(r.choices(words, k=12000)) for _ in range(4)]
    bits = (12,) * len(mixlm.TABLES)
    raw = raw_of(spark, texts)
    shared, want, mass = mixlm._counts(raw, bits), mixlm.Model(bits, None), 0
    counts = np.zeros((mixlm._offsets(bits)[-1], 2), np.uint16)
    streams = [s for _, s in mixlm.Texts(pa.array(texts, pa.string())).streams(1 << 20)]
    for s in streams:
        b = mixlm.Bits(s)
        np.add.at(counts, (b.slots(s, bits, slice(None)), b.bit), 1)
    for s in streams:
        mass += want.learn(s, counts, None)
    got_mass, state = mixlm._taught(raw, mixlm.Model(bits, None), shared)
    assert got_mass == mass
    assert abs(state[:want.weights.size] / mass - want.weights.ravel()).max() < 2e-3
    assert abs(state[want.weights.size:] - want.map.ravel()).sum() < 2e-3 * mass
    want.cells = mixlm.squeeze(*counts.astype(np.float32).T)
    want.shared = compiled.instance(spark, "Mixer").cells(spark.sparkContext._jsc, shared)
    rows = spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string").coalesce(1)
    scores = {x.doc_id: x.model for x in mixlm.coded(rows, want).collect()}
    for i, t in enumerate(texts):
        (_, one), = mixlm.Texts(pa.array([t], pa.string())).streams(1 << 20)
        assert abs(want.score(one).sum() - scores[i]) < 1e-4 * abs(scores[i])


def test_lm_learning_costs_little_more_than_scoring(spark):
    """What waits is asked of the tables at once: learning took over three times as long as scoring, as its reads waited for one another."""
    r = random.Random(23)
    words = [word(r) for _ in range(60000)]
    texts = [" ".join(r.choices(words, k=1000)) for _ in range(800)]
    raw = raw_of(spark, texts).cache()
    rows = raw.selectExpr("1L doc_id", "false held_out", "cast(text as string) text").cache()
    model = mixlm.Model(mixlm.TABLES, None)
    counts = mixlm._counts(raw, model.bits)
    model.shared = compiled.instance(spark, "Mixer").cells(spark.sparkContext._jsc, counts)

    def least(job):
        spent = []
        for _ in range(3):
            began = time.perf_counter()
            job()
            spent.append(time.perf_counter() - began)
        return min(spent)

    rows.count()
    scoring = least(lambda: mixlm.coded(rows, model).agg({"model": "sum"}).first())
    learning = least(lambda: mixlm._taught(raw, model, counts))
    assert learning < 2.3 * scoring, (learning, scoring)
