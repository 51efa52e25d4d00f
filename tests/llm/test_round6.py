"""The tree of words: whole texts along it, in fewer bits, as probabilities."""

from __future__ import annotations

import heapq
import random
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from pyspark.sql import functions as F  # noqa: E402

from evispark.llm import mixlm  # noqa: E402


def trained(spark, texts, hot):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).cache()
    vocab = docs.select(F.explode(F.split(F.lower("text"), " ")).alias("word")).select(F.col("word").cast("binary")).groupBy("word").agg(F.count("*").alias("c"))
    vocab = vocab.union(spark.createDataFrame([(b"", len(texts))], "word binary, c long")).cache()
    n, v = vocab.agg(F.sum("c"), F.count("*")).first()
    return docs, {bytes(r.word): r.c for r in vocab.collect()}, mixlm.train(docs, mixlm.dictionary(vocab, n, v, hot))


def test_lm_codes_words_along_a_tree(spark):
    """Every bit of every text is taught, in under half the bits: all words were spelled, at 2523 CPU seconds a GB of 960."""
    r = random.Random(31)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(4, 9))) for _ in range(300)]
    texts = [" ".join(r.choices(words, k=200)) for _ in range(60)] + ["Zebraword", words[0] + " ONCEONLY"]
    _, counts, model = trained(spark, texts, 1000)
    bytewise = sum(sum(5 if b in mixlm.USUAL else mixlm.PLACES for b in w + b" ") * c for w, c in counts.items())
    spelled = sum(sum(5 if b in mixlm.USUAL else mixlm.PLACES for b in w + b" ") for w in (b"zebraword", b"onceonly"))
    lengths = huffman([c for w, c in counts.items() if c > 1 or not w] + [2])
    assert model.map.sum() == lengths + spelled < bytewise / 2


def huffman(counts):
    """Bits of all leaves, each as often as it is met."""
    heap, bits = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        bits += x
        heapq.heappush(heap, x)
    return bits


def test_lm_tree_gives_probabilities(spark):
    """Texts of one word each, and the empty one, have less than one together, and most of it where most words are known."""
    r = random.Random(32)
    words = ["aa", "bb", "cc", "dd", "ee"]
    texts = [" ".join(r.choices(words, [8, 4, 2, 1, 1], k=1)) for _ in range(400)]
    _, _, model = trained(spark, texts, 1000)
    one = spark.createDataFrame([(i, False, w) for i, w in enumerate([*words, "", "zz", "a", "aab"])], "doc_id long, held_out boolean, text string")
    got = {x.doc_id: x for x in mixlm.told(one, model).collect()}
    p = np.array([10 ** got[i].model for i in range(9)])
    assert 0.5 < p.sum() < 1 and p[0] == p.max() and p[5:].max() < p[4]
    assert [bytes(got[i].others) if got[i].others is not None else None for i in (0, 5, 6)] == [None, None, b"zz"]


def test_lm_words_outside_the_dictionary(spark):
    """With a dictionary of three words counts and base are those with all words, as others are spelled and joined."""
    r = random.Random(33)
    words = ["".join(r.choice("abcdé|X") for _ in range(r.randint(1, 20))) for _ in range(50)]
    rows = [(i, " ".join(r.choices(words, k=30)) + "  \t new%d" % i) for i in range(40)] + [(40, None), (41, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few, all_ = ({x.doc_id: x for x in mixlm.score(docs, hot).collect()} for hot in (3, 1000))
    assert len(few) == len(all_) == 42
    for i, x in few.items():
        y = all_[i]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (y.n_tokens, y.n_known, y.train_tokens)
        assert abs(x.base_score - y.base_score) < 1e-9 * x.n_tokens and x.score < 0 and y.score < 0
