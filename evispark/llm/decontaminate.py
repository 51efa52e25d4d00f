"""Benchmark decontamination by pigeonhole edit matching.

A test item may have changed by ``k`` edits, a share of its length. Cut into
``k + 1`` pieces, at least one piece is left as it was. An Aho-Corasick automaton
of all pieces finds these in one pass over a text; a window around each hit is
verified with Myers' bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.1
#: Items shorter than this must be found unchanged.
SHORT = 24
#: Characters of items in one automaton; more items make more passes.
BLOCK_CHARS = 4_000_000
_Q = 5


def normal(text: str | None) -> str:
    """Lower case, with white space squeezed to single spaces."""
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float = RATE) -> int:
    return int(length * rate) if length >= SHORT else 0


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any substring of ``text``, and its end."""
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, now, best = mask, 0, m, (m, 0)
    for at, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            now += 1
        elif mh & top:
            now -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if now < best[0]:
            best = (now, at + 1)
    return best


class Matcher:
    """Finds in texts the items ``(item_id, text)`` within their error budgets."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in sorted(set(items), key=lambda x: (x[0] is None, x)):
            text = normal(text)
            if not text:
                continue
            k = budget(len(text), rate)
            n = k + 1
            grams = {text[i:i + _Q] for i in range(len(text) - _Q + 1)}
            for j in range(n):
                a, b = len(text) * j // n, len(text) * (j + 1) // n
                pieces.setdefault(text[a:b], []).append((len(self.items), a))
            self.items.append((item_id, text, k, grams))
        self.automaton = ahocorasick.Automaton()
        for piece, of in pieces.items():
            self.automaton.add_word(piece, (len(piece), of))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """``(item_id, edits, end, budget)`` of each item in a text, at its least distance."""
        if not self.items:
            return []
        text = normal(text)
        seen: dict[int, set[int]] = {}
        for end, (size, of) in self.automaton.iter(text):
            for i, a in of:
                seen.setdefault(i, set()).add(end - size + 1 - a)
        out = []
        for i, starts in seen.items():
            item_id, item, k, grams = self.items[i]
            m, best, windows = len(item), None, []
            for s in sorted(starts):  # starts of one alignment differ by the budget at most
                if windows and s - windows[-1][1] <= k:
                    windows[-1][1] = s
                else:
                    windows.append([s, s])
            for first, last in windows:
                lo, hi = max(0, first - k), last + m + k
                part = text[lo:hi]
                # an edit changes at most _Q grams
                if k and len(grams) - len(grams.intersection([part[x:x + _Q] for x in range(len(part) - _Q + 1)])) > k * _Q:
                    continue
                edits, at = myers(item, part) if k else (0, part.find(item) + m) if item in part else (1, 0)
                if edits <= k and (best is None or edits < best[0]):
                    best = (edits, lo + at)
            if best:
                out.append((item_id, best[0], best[1], k))
        return out


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``doc_id, item_id, edits, budget, end`` for each item found in each row of ``docs``.

    ``end`` is in the text as :func:`normal` has it. Null and blank items match
    nothing, null and empty texts have no match, items that repeat are one, and
    documents that repeat have a row each; empty tables give no rows.

    The items go to the tasks in blocks of at most ``BLOCK_CHARS`` characters, one
    pass over ``docs`` for each block, so no task holds more than one block.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    chars = items.agg(F.sum(F.length("text") + 8)).first()[0] or 0
    blocks = int(chars // BLOCK_CHARS) + 1
    out = None
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = [(r.item_id, r.text) for r in part.collect()]

        def found(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(rows, rate)
            for batch in batches:
                got = [(d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")) for hit in matcher.find(t.as_py())]
                if got:
                    d, i, e, end, k = zip(*got)
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64()), pa.array(e, pa.int32()), pa.array(k, pa.int32()), pa.array(end, pa.int64())], ["doc_id", "item_id", "edits", "budget", "end"])

        one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(found, "doc_id long, item_id long, edits int, budget int, end long")
        out = one if out is None else out.unionByName(one)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found.

    Rows are judged one by one: the text travels with a flag, not through a join.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    chars = items.agg(F.sum(F.length("text") + 8)).first()[0] or 0
    blocks = int(chars // BLOCK_CHARS) + 1
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = [(r.item_id, r.text) for r in part.collect()]

        def clean(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(rows, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(t.as_py()) for t in batch.column("text")], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
