"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text come from its byte histogram, its words and its lines. Trees
are complete and of one depth, so a model is three arrays and a batch of texts
goes down all trees at once.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.llm import common

#: Most labelled rows that a model is fitted on; scoring and everything else is over all rows.
SAMPLE = 20_000

_UPPER, _LOWER = slice(65, 91), slice(97, 123)
_SYMBOLS = np.frombuffer(rb"#$%&*@^~|\<>{}[]_=+", np.uint8)

FEATURES = ("bytes", "words", "word_mean", "upper", "digits", "symbols", "points", "exclaims", "bars", "not_ascii", "spaces",
            "entropy", "distinct", "top_word", "repeats", "lines", "line_mean", "line_copies", "one_word_lines", "word_ends", "long_words")


def statistics(text: str | None) -> list[float]:
    """The values of ``FEATURES`` for a text; all zero for a null or empty one."""
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(FEATURES)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    words = raw.split()
    m = len(words) or 1
    counts = Counter(words)
    p = hist[hist > 0] / n
    letters = hist[_UPPER].sum() + hist[_LOWER].sum() + 1
    lines = [x for x in raw.split(b"\n") if x]
    k = len(lines) or 1
    return [
        np.log1p(n), np.log1p(len(words)), n / m, hist[_UPPER].sum() / letters, hist[48:58].sum() / n, hist[_SYMBOLS].sum() / n,
        (hist[44] + hist[46]) / m, hist[33] / m, hist[124] / m, hist[128:].sum() / n, (hist[9:14].sum() + hist[32]) / n,
        float(-(p * np.log2(p)).sum()), len(counts) / m, max(counts.values(), default=0) / m,
        sum(map(bytes.__eq__, words, words[1:])) / m, np.log1p(len(lines)), np.log1p(n / k), 1 - len(set(lines)) / k,
        sum(b" " not in x for x in lines) / k, sum(not w[-1:].isalnum() and w[-1] < 128 for w in counts) / (len(counts) or 1),
        sum(len(w) > 24 for w in counts) / (len(counts) or 1)]


@dataclass
class Trees:
    """``feature`` and ``above`` are (trees, inner nodes), ``value`` is (trees, leaves)."""

    feature: np.ndarray
    above: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), np.int64)
        rows, every = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        for _ in range(int(np.log2(inner + 1))):
            at = 2 * at + 1 + (x[rows, self.feature[every, at]] > self.above[every, at])
        raw = self.base + self.value[every, at - inner].sum(1)
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 8, ridge: float = 1.0) -> Trees:
    """Boosted trees on histograms of binned statistics, grown level by level.

    Ties between splits go to the first feature and bin. With no rows the
    probability is a half, with one class it is that class's smoothed share.
    """
    inner, leaves = 2 ** depth - 1, 2 ** depth
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((1, inner), np.int64), np.full((1, inner), np.inf), np.zeros((1, leaves)), base)
    d = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    slot = code + np.arange(d) * bins
    raw = np.full(len(y), base)
    feats, aboves, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, above = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, wide = 2 ** level - 1, 2 ** level
            flat = ((node - first)[:, None] * (d * bins) + slot).ravel()
            hist = [np.bincount(flat, np.repeat(v, d), wide * d * bins).reshape(wide, d, bins) for v in (g, h, np.ones(len(y)))]
            gl, hl, nl = (np.cumsum(v, 2)[:, :, :-1] for v in hist)
            gt, ht, nt = (v.sum(2)[:, :1, None] for v in hist)
            gain = gl ** 2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt ** 2 / (ht + ridge)
            gain[(nl < least) | (nt - nl < least)] = -1
            best = gain.reshape(wide, -1).argmax(1)
            for i, b in enumerate(best):
                j, c = divmod(int(b), bins - 1)
                if gain[i, j, c] > 1e-9 and c < len(edges[j]):
                    feature[first + i], above[first + i] = j, edges[j][c]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > above[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        raw += value[leaf]
        feats.append(feature), aboves.append(above), values.append(value)
    return Trees(np.array(feats), np.array(aboves), np.array(values), base)


def held_out(doc_id: Column) -> Column:
    """Documents kept from training: crc32 of the id's text leaves 1 modulo 3. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **how) -> Trees:
    """A model from labelled documents that are not held out.

    At most ``sample`` of them, those with the smallest md5 of their id, are read
    on the driver, as numbers. Null labels, null ids and labels without a
    document are left out; an id with several labels has their greatest.
    """
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    good = good.groupBy("doc_id").agg(F.max("quality").alias("y"))
    good = good.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)
    stats = F.pandas_udf(lambda col: pd.Series([statistics(t) for t in col]), "array<double>")
    # of rows that repeat an id one is read, with the least text
    one = docs.select("doc_id", "text").join(F.broadcast(good), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = one.select("doc_id", "y", stats("text").alias("x")).toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows["y"].to_numpy(float), **how)


def score(docs: DataFrame, model: Trees, to: str = "score") -> DataFrame:
    """``docs`` with ``to`` double, the probability of label 1; null and empty texts get one too."""

    @F.pandas_udf("double")
    def scored(col: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in col], float).reshape(-1, len(FEATURES))
        return pd.Series(model.score(x))

    return docs.withColumn(to, scored("text"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``."""
    out = score(docs.select("doc_id", "text"), train(docs, labels, sample))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that a model accepts, with their own columns, whatever their names.

    Null and empty texts are scored as any other, repeated rows go together; an empty table gives none.
    """
    name = common.free_name(docs, "score")
    return score(docs, train(docs, labels, sample), name).where(F.col(name) >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
