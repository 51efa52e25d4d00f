"""Phrase collocations by suffix sorting.

Every word starts a suffix of up to ``max_n`` words of its piece. Suffixes are counted
in their task, shuffled by (language, first word), sorted in reverse order, and one
pass with a stack of open prefixes counts all phrases of up to ``max_n`` words. The
parts of each phrase are joined to it afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.llm import common

#: Words whose suffixes a task counts together before it gives them away; bounds its memory and keeps three word numbers in 64 bits.
TOGETHER = 2_200_000
#: Tasks over which the suffixes of one first word are dealt, by their second word; also copies of a hot part's count in joins.
SALTS = 16
#: A part is hot if it has one in so many of all words; so there are at most ``max_n`` times as many.
HOT = 1000
#: Ends a piece; no byte of UTF-8.
STOP = b"\xff"
_TABLE = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Words of a text, lower-case in A-Z, with ``STOP`` where a piece ends."""
    return text.translate(_TABLE).replace(b"\n", b" " + STOP + b" ").split()


class _Counted:
    """Suffixes of one language, as numbers of words."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {STOP: 0}
        self.runs: list[np.ndarray] = []

    def add(self, found: list[bytes], own: int) -> None:
        """The first ``own`` words start suffixes, the others only continue them."""
        number = self.number
        run = np.fromiter((number.setdefault(w, len(number)) for w in found), np.int32, len(found))
        self.runs.append((run, own))

    def rows(self, lang: bytes, max_n: int) -> Iterator[list[pa.Array]]:
        size, columns = len(self.number), [[] for _ in range(max_n)]
        for run, own in self.runs:
            padded = np.concatenate((run, np.zeros(max_n, np.int32)))
            at = padded[:own]
            start = at > 0
            columns[0].append(at[start])
            for k in range(1, max_n):
                at = np.where(at > 0, padded[k:k + own], 0)
                columns[k].append(at[start])
        ids = [np.concatenate(c) for c in columns]
        self.runs, columns = [], []
        code = ids[0].astype(np.uint64)
        for k in ids[1:]:
            if int(code.max(initial=0)) >= (1 << 64) // size - 1:
                code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
            code *= np.uint64(size)
            code += k.astype(np.uint64)
        _, first, count = np.unique(code, return_index=True, return_counts=True)
        del code
        names = pa.array([b"" if w == STOP else w for w in self.number], pa.binary())
        for lo in range(0, len(first), 50_000):
            at = first[lo:lo + 50_000]
            out = [names.take(pa.array(c[at])) for c in ids]
            head = pc.binary_join_element_wise(pa.scalar(lang, pa.binary()), out[0], pa.scalar(b"\t", pa.binary()))
            yield [head, *out[1:], pa.array(count[lo:lo + 50_000].astype(np.int64))]


def _suffixes(batches: Iterator[pa.RecordBatch], max_n: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(k1, w2, .., c)`` from ``(lang, text)`` in bytes; k1 is language, tab and first word, absent words are empty."""
    names = ["k1", *[f"w{k}" for k in range(2, max_n + 1)], "c"]
    held: dict[bytes, _Counted] = {}
    total = 0

    def given() -> Iterator[pa.RecordBatch]:
        while held:
            lang, counted = held.popitem()
            for columns in counted.rows(lang, max_n):
                yield pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = words(text.as_py())
            for at in range(0, len(found), TOGETHER):
                part = found[at:at + TOGETHER + max_n - 1]
                own = min(TOGETHER, len(found) - at)
                if total + own > TOGETHER:
                    yield from given()
                    total = 0
                held.setdefault(lang, _Counted()).add(part, own)
                total += own
    yield from given()


def _counts(batches: Iterator[pa.RecordBatch], max_n: int, least: int) -> Iterator[pa.RecordBatch]:
    """Counts ``(k1, w2, .., len, c)`` of all prefixes of sorted suffixes.

    The stack has the open prefix of each length and its count so far. A batch closes the
    prefixes that change in it, all at once. Longer prefixes are whole here and go only if
    ``least`` reach; first words may be dealt over tasks and all go.
    """
    names = ["k1", *[f"w{k}" for k in range(2, max_n + 1)]]
    stack: list[list | None] = [None] * max_n  # [words, count]

    def row(level: int, top: list) -> tuple[list[pa.Array], np.ndarray]:
        return [pa.array([w], pa.binary()) for w in top[0]], np.array([top[1]])

    def closed(level: int, columns: list[pa.Array], count: np.ndarray) -> pa.RecordBatch | None:
        if level:
            on = np.flatnonzero(count >= least)
            columns, count = [c.take(pa.array(on)) for c in columns], count[on]
        if not len(count):
            return None
        blank = pa.array([b""] * len(count), pa.binary())
        full = [c if k <= level else blank for k, c in enumerate(columns)] + [blank] * (max_n - len(columns))
        return pa.RecordBatch.from_arrays([*full, pa.array(np.full(len(count), level + 1, np.int32)), pa.array(count.astype(np.int64))], [*names, "len", "c"])

    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        columns = [batch.column(n).combine_chunks() if isinstance(batch.column(n), pa.ChunkedArray) else batch.column(n) for n in names]
        count, changed = batch.column("c").to_numpy(), np.zeros(size, bool)
        for level in range(max_n):
            c = columns[level]
            differs = np.ones(size, bool)
            if size > 1:
                differs[1:] = pc.not_equal(c.slice(1), c.slice(0, size - 1)).to_numpy(zero_copy_only=False)
            top = stack[level]
            differs[0] = top is None or c[0].as_py() != top[0][level] or (level > 0 and changed[0])
            changed |= differs
            starts = np.flatnonzero(changed)
            at = starts if len(starts) and starts[0] == 0 else np.concatenate(([0], starts))
            sums = np.add.reduceat(count, at)
            if not changed[0]:
                top[1] += int(sums[0])
                at, sums = at[1:], sums[1:]
            if not len(at):
                continue
            if top is not None and (level == 0 or top[0][level]):
                if (out := closed(level, *row(level, top))) is not None:
                    yield out
            keep, kept = at[:-1], sums[:-1]
            if level:  # an absent word ends no phrase of this length
                there = pc.not_equal(c.take(pa.array(keep)), pa.scalar(b"", pa.binary())).to_numpy(zero_copy_only=False)
                keep, kept = keep[there], kept[there]
            if len(keep):
                if (out := closed(level, [x.take(pa.array(keep)) for x in columns], kept)) is not None:
                    yield out
            stack[level] = [[x[int(at[-1])].as_py() for x in columns], int(sums[-1])]
    for level, top in enumerate(stack):
        if top is not None and (level == 0 or top[0][level]):
            if (out := closed(level, *row(level, top))) is not None:
                yield out


def counts(docs: DataFrame, max_n: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Counts ``(lang, phrase, len, f)`` of phrases with ``f >= least``, and all words ``(lang, n)``.

    ``docs(lang, text)``; a null language is ``und``, a null text has no words. Words are
    runs without blank and tab, lower-case in A-Z, in pieces between ``. , ; : ! ?`` and
    line ends; a phrase does not cross pieces. Overlapping places count each.
    """
    texts = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("lang"), F.lit("und")).cast("binary").alias("lang"), F.col("text").cast("binary").alias("text"))
    rest = [f"w{k}" for k in range(2, max_n + 1)]
    schema = ", ".join(["k1 binary", *[f"{w} binary" for w in rest]])
    suffixes = texts.mapInArrow(common.trimmed(lambda it: _suffixes(it, max_n)), f"{schema}, c long")
    # words go in the order of their hashes, which one number decides for most pairs of rows; equal prefixes stay together
    one, two = F.xxhash64("k1"), F.xxhash64(rest[0]) if rest else F.lit(0).cast("long")
    dealt = suffixes.repartition("k1", F.pmod(two, F.lit(SALTS))).withColumn("h", F.shiftleft(one, 32).bitwiseOR(F.shiftrightunsigned(two, 32)))
    dealt = dealt.sortWithinPartitions(*[F.col(c).desc() for c in ["h", "k1", *rest]])
    found = common.stage(dealt.select("k1", *rest, "c").mapInArrow(common.trimmed(lambda it: _counts(it, max_n, least)), f"{schema}, len int, c long"), "phrase-counts")
    head = F.col("k1").cast("string")
    lang, first = F.substring_index(head, "\t", -1), F.substring_index(head, "\t", -1)
    lang = F.left(head, F.char_length(head) - F.char_length(first) - 1)
    single = common.stage(found.where("len = 1").groupBy("k1").agg(F.sum("c").alias("f")).select(lang.alias("lang"), first.alias("phrase"), F.lit(1).alias("len"), "f"), "phrase-words")
    longer = found.where("len > 1").select(lang.alias("lang"), F.array_join(F.slice(F.array(first, *[F.col(w).cast("string") for w in rest]), F.lit(1), F.col("len")), " ").alias("phrase"), "len", F.col("c").alias("f"))
    return single.where(F.col("f") >= least).union(longer), single.groupBy("lang").agg(F.sum("f").alias("n"))


def collocations(docs: DataFrame, max_n: int = 3, least: int = 10, covered: int = 50, top: int | None = 2000) -> DataFrame:
    """Ranked phrases of 2 to ``max_n`` words of each language of ``docs(lang, text)``.

    A phrase with a = f >= ``least`` is cut after k words into parts of counts l and r;
    its score is ``floor(1000000 a a / (l r))`` of the cut that scores least, the first of
    equal ones, exactly in decimals of 38 digits. Phrases that lie in a longer one of at
    least ``covered`` percent of their count are dropped. The first ``top`` of each
    language (None: all) by score and a descending and the phrase's bytes, as ``(lang,
    rank, phrase, a, l, r, n, score)``. See :func:`counts` for nulls and words; an empty
    table gives no rows; repeated rows count each; other columns are not read.
    """
    frequent, total = counts(docs.select("lang", "text"), max_n, least)
    frequent = common.stage(frequent, "phrases-frequent")
    candidates = frequent.where("len > 1").withColumn("w", F.split("phrase", " "))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("len") - 1)))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("len") - F.col("k")).alias("right"))
    # a hot part is in many phrases: its phrases are dealt, its count is copied
    every = total.agg(F.sum("n").alias("every"))
    hot = frequent.where(F.col("len") < max_n).join(F.broadcast(every)).where(F.col("f") * HOT >= F.col("every")).select("lang", F.col("phrase").alias("part"))
    hot = common.stage(hot, "phrases-hot")
    shared = frequent.where(F.col("len") < max_n).select("lang", F.col("phrase").alias("part"), "f")
    copies = shared.join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["lang", "part"], "left")
    copies = copies.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    for side, name in (("left", "l"), ("right", "r")):
        flagged = cuts.join(F.broadcast(hot.select("lang", F.col("part").alias(side), F.lit(True).alias("hot"))), ["lang", side], "left")
        salted = flagged.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
        cuts = salted.join(copies.select("lang", F.col("part").alias(side), "salt", F.col("f").alias(name)), ["lang", side, "salt"]).drop("salt")
    exact = F.expr("(cast(1000000 as decimal(7, 0)) * cast(a as decimal(15, 0)) * cast(a as decimal(15, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    scored = cuts.withColumn("score", exact).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("m"))
    subs = candidates.where("len > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("len") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("len") - F.col("size") + 1)))
    subs = subs.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(subs, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    flat = kept.select("lang", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), F.col("m.score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    ranked = flat.withColumn("rank", rank)
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
