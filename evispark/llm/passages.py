"""Substring dedup by MinHash banding of paragraphs.

Units are a text's paragraphs (lines) of ``LEAST`` words or more, which is the least
that has a shingle, and passages of ``SPAN`` words that start at content-defined
places, so that a passage repeated inside other paragraphs is met wherever it
stands: of any ``SPAN + PLACES + SHINGLE - 2`` words that repeat (50), one passage
lies inside and starts at the same word. Passages repeat if they are equal; of a
longer run up to ``PLACES - 1`` words at each end may lie outside all of its
passages. Paragraphs are near-duplicates at a Jaccard similarity of 0.8 of their
sets of five-word shingles: signatures of distinct paragraphs are banded, those of
one bucket are candidates, and links are verified by exact Jaccard
(:mod:`evispark.llm.verified`). Components of verified links are the groups; all but
a group's first unit are to be removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.llm import common, verified

LEAST, SPAN, PLACES, SHINGLE = 5, 32, 15, 5
#: A pair at the threshold of 0.8 shares one of these bands with a probability of 0.9992.
BANDS, ROWS = 10, 3
SIMILARITY = 0.8
#: Bytes of text that a worker takes apart at once.
SLICE = 4_000_000
_K = BANDS * ROWS
_A = np.random.default_rng(11).integers(1, 1 << 63, _K, np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_UNITS = "h long, doc_id long, start int, end int, bands array<long>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _sums(words: np.ndarray) -> np.ndarray:
    """Running sums of hashes times powers, from which :func:`_run` takes any run of words."""
    n = len(words) + 1
    if len(_powers[0]) < n:
        for i, b in enumerate((_P, pow(_P, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 16), b, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return np.concatenate(([np.uint64(0)], np.cumsum(_mixed(words) * _powers[0][:len(words)])))


def _run(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run of words, the same wherever it stands."""
    return _mixed((sums[end] - sums[start]) * _powers[1][start])


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Least value of each window of ``n``."""
    wide = 1
    while 2 * wide <= n:
        x = np.minimum(x[:-wide], x[wide:])
        wide *= 2
    return np.minimum(x[:len(x) - (n - wide)], x[n - wide:]) if n > wide else x


def places(anchors: np.ndarray) -> np.ndarray:
    """Positions that have the least anchor, the last of those, in some window of ``PLACES``."""
    if len(anchors) < PLACES:
        return np.empty(0, np.int64)
    low = np.uint64((1 << 24) - 1)
    at = (low - (_least((anchors & ~low) | (low - np.arange(len(anchors), dtype=np.uint64)), PLACES) & low)).astype(np.int64)
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def signatures(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(paragraphs, places): least values, as 32 bits, of each run's shingles under the fixed permutations."""
    count = np.maximum(end - start - SHINGLE + 1, 1)
    of = np.cumsum(count) - count
    first = np.repeat(start - of, count) + np.arange(int(count.sum()))
    h = _run(sums, first, np.minimum(first + SHINGLE, np.repeat(end, count)))
    out = np.empty((len(start), _K), np.uint32)
    for k in range(_K):
        out[:, k] = np.minimum.reduceat(h * _A[k], of) >> np.uint64(32)
    return out


def bands(sigs: np.ndarray) -> np.ndarray:
    """(paragraphs, bands): a hash of each band of a signature and of the band's number."""
    parts = sigs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * np.uint64(_P), parts.shape[:2])
    for r in range(ROWS):
        out = _mixed((out ^ parts[:, :, r]) * np.uint64(_P))
    return out.view(np.int64)


def shingle_set(words: np.ndarray) -> np.ndarray:
    n = len(words)
    at = np.arange(max(n - SHINGLE + 1, 1))
    return np.unique(_run(_sums(words), at, np.minimum(at + SHINGLE, n)))


def _hashes(words: pa.Array) -> np.ndarray:
    coded = words.dictionary_encode()
    h = xxhash.xxh3_64_intdigest
    return np.array([h(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)[coded.indices.to_numpy()]


def word_hashes(text: str | None) -> np.ndarray:
    parts = (text or "").encode().lower().split()
    return _hashes(pa.array(parts, pa.large_binary()).cast(pa.large_string())) if parts else np.empty(0, np.uint64)


def units(texts: pa.StringArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """``text, hash, start, end, bands`` of the paragraphs and then, without bands, of the passages."""
    lines = pc.split_pattern(pc.ascii_lower(texts.fill_null("").cast(pa.large_string())), "\n")
    parts = pc.ascii_split_whitespace(lines.flatten())
    flat = parts.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    flat = flat.filter(pa.array(full))
    if not len(flat):
        return
    at = np.concatenate(([0], np.cumsum(full)))[parts.offsets.to_numpy()]  # words before each line
    to = at[lines.offsets.to_numpy()]  # words before each text
    words = _hashes(flat)
    sums = _sums(words)
    a, b = at[:-1], at[1:]
    of = np.repeat(np.arange(len(texts)), np.diff(lines.offsets.to_numpy()))
    whole = b - a >= LEAST
    if whole.any():
        a, b, of = a[whole], b[whole], of[whole]
        yield of, _run(sums, a, b), a - to[of], b - to[of], bands(signatures(sums, a, b))
    i = np.arange(max(len(words) - SHINGLE + 1, 0))
    anchors = _run(sums, i, i + SHINGLE)
    for lo in range(0, max(len(anchors) - PLACES + 1, 0), 1 << 23):
        # windows that cross two texts are taken too, and dropped with their passages or kept: a place more
        p = places(anchors[lo:lo + (1 << 23) + PLACES - 1]) + lo
        of = np.searchsorted(to, p, "right") - 1
        inside = p + SPAN <= to[of + 1]
        p, of = p[inside], of[inside]
        if len(p):
            yield of, _run(sums, p, p + SPAN), p - to[of], p - to[of] + SPAN, None


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column("text").fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
        cut = np.flatnonzero(np.concatenate(([True], size[1:] != size[:-1], [True]))).tolist() if len(size) else []
        for lo, hi in zip(cut[:-1], cut[1:]):
            part = batch.take(pa.array(np.arange(lo, hi)))
            for of, h, start, end, sig in units(part.column("text")):
                for k in range(0, len(of), 50_000):
                    s = slice(k, k + 50_000)
                    n = len(of[s])
                    rows = pa.nulls(n, pa.list_(pa.int64())) if sig is None else pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * n + 1, BANDS, np.int32)), pa.array(sig[s].ravel()))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(h[s].view(np.int64)), part.column("doc_id").take(pa.array(of[s])),
                        pa.array(start[s].astype(np.int32)), pa.array(end[s].astype(np.int32)), rows], ["h", "doc_id", "start", "end", "bands"])


def repeats(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, kind, start, end, keep_doc_id, keep_start, removed``: all units of a group of two or more.

    ``kind`` is ``P`` for a paragraph and ``W`` for a passage, ``start`` and ``end``
    count words of the text. A unit is removed unless it is the group's first by
    (doc_id, start), null ids first. A group of passages has two documents or
    more. Null, empty and short texts have no units; rows that repeat with one id
    are one row; empty tables give no rows; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = common.stage(rows.mapInArrow(common.trimmed(_units), _UNITS), "units")
    spans = every.where("bands is null").select("h", "doc_id", "start", "end")
    often = spans.groupBy("h").agg(F.min(F.coalesce("doc_id", F.lit(-1 << 62))).alias("a"), F.max(F.coalesce("doc_id", F.lit(-1 << 62))).alias("b")).where("a < b")
    met = common.stage(spans.join(often.select("h"), "h"), "passages")
    first = met.groupBy("h").agg(F.min(F.struct("doc_id", "start", "end")).alias("first"))
    w = met.join(first, "h").select("doc_id", F.lit("W").alias("kind"), "start", "end", "first")

    # equal paragraphs are one row from here on
    paras = every.where("bands is not null")
    one = common.stage(paras.groupBy("h").agg(F.first("bands").alias("bands"), F.min(F.struct("doc_id", "start", "end")).alias("first"), F.count(F.lit(1)).alias("n")), "paragraphs")
    paras = common.stage(paras.select("h", "doc_id", "start", "end"), "paragraph-places")
    common.unstage(every)  # the bands are most of it
    keys = one.select("h", F.explode("bands").alias("g"))
    # one shuffle of the keys, which are the most that is on disk at once
    pairs = keys.withColumn("u", F.min("h").over(Window.partitionBy("g"))).where("h <> u").select("g", "u", F.col("h").alias("v"))

    @F.pandas_udf("array<struct<h: long, s: array<long>>>")
    def sets(text: pd.Series, parts: pd.Series) -> pd.Series:
        out = []
        for t, ps in zip(text, parts):
            words = word_hashes(t)
            sums, got = _sums(words), []
            for p in ps:  # rows with one id may have other texts
                if p["end"] <= len(words) and int(_run(sums, np.array([p["start"]]), np.array([p["end"]])).view(np.int64)[0]) == p["h"]:
                    got.append({"h": p["h"], "s": shingle_set(words[p["start"]:p["end"]]).view(np.int64).tolist()})
            out.append(got)
        return pd.Series(out)

    def shingles(wanted: DataFrame) -> DataFrame:
        need = one.join(wanted.withColumnRenamed("node", "h"), "h", "left_semi").select("h", "first.*")
        need = common.stage(need.groupBy(F.coalesce("doc_id", F.lit(-1 << 62)).alias("i")).agg(F.collect_list(F.struct("h", "start", "end")).alias("parts")), "wanted")
        some = rows.withColumn("i", F.coalesce("doc_id", F.lit(-1 << 62))).join(common.small(need.select("i")), "i", "left_semi")
        return some.join(need, "i").select(F.inline(sets("text", "parts"))).withColumnRenamed("h", "node").dropDuplicates(["node"])

    comps = common.components(verified.links(pairs, shingles, similarity, "passage"), "passage-links")
    group = common.stage(one.join(comps, one.h == comps.node, "left").select("h", F.coalesce("component", "h").alias("c"), "first", "n"), "groups")
    firsts = group.groupBy("c").agg(F.min("first").alias("top"), F.sum("n").alias("m")).where("m > 1")
    p = paras.join(group.join(firsts, "c").select("h", F.col("top").alias("first")), "h").select("doc_id", F.lit("P").alias("kind"), "start", "end", "first")
    here = F.struct("doc_id", "start", "end")
    return w.unionByName(p).distinct().select(
        "doc_id", "kind", "start", "end", F.col("first.doc_id").alias("keep_doc_id"), F.col("first.start").alias("keep_start"), (~here.eqNullSafe(F.col("first"))).alias("removed"))
