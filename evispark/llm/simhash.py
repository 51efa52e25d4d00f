"""SimHash near-dedup by a binary trie self-join.

Fingerprints are 64 bits. Two fingerprints that differ in at most three bits
agree on at least one of four blocks of 16 bits, so each fingerprint enters four
tries, each with another block first. The block is the distribution key and the
top 16 levels of the trie; below it, node pairs are traversed together, the
differing bits are accumulated, and a pair is dropped when they exceed the
budget. Node pairs whose leaves are known to be one component are dropped too,
so a dense group of copies costs about its size and not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm import common, verified

BITS, BLOCK = 64, 16
#: Node pairs handled at once; bounds a task's memory.
CHUNK = 200_000
#: Leaf pairs of a node pair below which the leaves are compared directly.
DIRECT = 16
#: Leaf pairs of a node pair below which a crowded trie's leaves are compared as one matrix.
MATRIX = 1 << 16
#: Leaf pairs compared at once.
PIECE = 250_000
#: A sketch is this many fingerprints side by side; its tables take HALF * 2 bits each.
WIDE, TABLES, HALF = 9, 26, 11
#: Fingerprints of a sketch that are compared before all are; texts with nothing in common differ in more bits of them than like ones in all.
HEAD = 5
#: Bits of a table in which two sketches may differ, all in one half.
APART = 2


def hashes(text: str | None, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words; fewer words are one shingle."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([h(b" ".join(parts), seed)], np.uint64)
    flat = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    return np.array([h(flat[i:j], seed) for i, j in zip(starts, (ends[words - 1:] - 1).tolist())], np.uint64)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    h = hashes(text, words, seed)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 65536):
        part = h[k:k + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(h)) & (len(h) > 0)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, words: int = 3, seed: int = 42, text: str = "text") -> DataFrame:
    """``docs`` with ``fp`` long: the fingerprint's 64 bits as a signed number."""

    @F.pandas_udf("long")
    def fp(col: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words, seed) for t in col], np.uint64).view(np.int64))

    return docs.withColumn("fp", fp(F.col(text)))


def _settle(lab: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Unite the ends of the links in ``lab``, whose values are each node's root."""
    while True:
        a, b = lab[u], lab[v]
        open_ = a != b
        if not open_.any():
            return
        a, b, u, v = a[open_], b[open_], u[open_], v[open_]
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = lab[lab]
            if np.array_equal(up, lab):
                break
            lab[:] = up


def trie_links(groups: np.ndarray, values: np.ndarray, budget: int = 3, skip: int = BLOCK, depth: int = BITS, agree=None, matrix: int = 0) -> np.ndarray:
    """Root of each row after linking rows of one group within ``budget`` bits.

    ``groups`` and ``values`` (uint64) are sorted together. The ``skip`` highest
    bits of ``values`` are equal inside a group, and so are not traversed; below
    ``depth`` bits all are zero. ``agree(i, j)``, if given, must hold too. Where tries
    of few bits hold many rows, most leaf pairs of a node pair are visited one by one:
    node pairs of up to ``matrix`` leaf pairs are then compared at once instead.
    """
    n = len(values)
    lab = np.arange(n)
    if n < 2:
        return lab

    def link(i, j):
        ok = (lab[i] != lab[j]) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
        i, j = i[ok], j[ok]
        if agree is not None and len(i):
            ok = agree(i, j)
            i, j = i[ok], j[ok]
        _settle(lab, i, j)

    if matrix:
        low = values >> np.uint64(BITS - depth) & np.uint64((1 << depth - skip) - 1)
        low = low.astype(np.uint16 if depth - skip <= 16 else np.uint64)

    def crosswise(alo, ahi, blo, bhi):
        held, count = [], 0
        for a0, a1, b0, b1 in zip(alo.tolist(), ahi.tolist(), blo.tolist(), bhi.tolist()):
            close = np.bitwise_count(low[a0:a1, None] ^ low[b0:b1]) <= budget
            close &= lab[a0:a1, None] != lab[b0:b1]
            at = np.flatnonzero(close.ravel())
            if len(at):
                i, j = np.divmod(at, b1 - b0)
                if a0 == b0:
                    i, j = i[i < j], j[i < j]
                held.append((i + a0, j + b0))
                count += len(i)
            if count > PIECE:
                link(*map(np.concatenate, zip(*held)))
                held, count = [], 0
        if held:
            link(*map(np.concatenate, zip(*held)))

    near = np.flatnonzero(groups[1:] == groups[:-1])
    for k in range(0, len(near), PIECE):
        link(near[k:k + PIECE], near[k:k + PIECE] + 1)
    ones = {}

    def split(lo, hi, d):
        if d not in ones:
            bit = ((values >> np.uint64(BITS - 1 - d)) & np.uint64(1)).astype(np.int64)
            ones[d] = np.concatenate(([0], np.cumsum(bit)))
        return hi - (ones[d][hi] - ones[d][lo])

    cut = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1], [True])))
    lo, hi = cut[:-1], cut[1:]
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(skip, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        d, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > CHUNK:
            for k in range(0, len(alo), CHUNK):
                stack.append((d, *(x[k:k + CHUNK] for x in (alo, ahi, blo, bhi, err))))
            continue
        # a step count of label changes: one label on both sides needs no visit
        change = np.concatenate(([0], np.cumsum(lab[1:] != lab[:-1])))
        one = (change[ahi - 1] == change[alo]) & (change[bhi - 1] == change[blo]) & (lab[alo] == lab[blo])
        alo, ahi, blo, bhi, err = (x[~one] for x in (alo, ahi, blo, bhi, err))
        area = (ahi - alo) * (bhi - blo)
        square = (area > DIRECT) & (area <= matrix) & (d < depth)
        if square.any():
            crosswise(alo[square], ahi[square], blo[square], bhi[square])
            alo, ahi, blo, bhi, err, area = (x[~square] for x in (alo, ahi, blo, bhi, err, area))
        end = (area <= DIRECT) | (d >= depth)
        if end.any():
            # each left leaf is a row; rows against their first right leaf, then all
            rows, first, width = _spread(alo[end], ahi[end] - alo[end]), blo[end], (bhi - blo)[end]
            left, of = rows
            for k in range(0, len(left), PIECE):
                link(left[k:k + PIECE], first[of[k:k + PIECE]])
            for k0 in _pieces(width[of]):
                i, j0, w = left[k0], first[of[k0]], width[of[k0]]
                j, at = _spread(j0, w)
                for k in range(0, len(j), PIECE):
                    link(i[at[k:k + PIECE]], j[k:k + PIECE])
        go = ~end
        if not go.any():
            continue
        alo, ahi, blo, bhi, err = (x[go] for x in (alo, ahi, blo, bhi, err))
        am, bm = split(alo, ahi, d), split(blo, bhi, d)
        same = alo == blo
        far = ~same & (err < budget)
        cross = [(alo, am, bm, bhi, err + 1, (same & (budget > 0)) | far), (am, ahi, blo, bm, err + 1, far)]
        for a0, a1, b0, b1, e, on in (*cross, (am, ahi, bm, bhi, err, slice(None)), (alo, am, blo, bm, err, slice(None))):
            a0, a1, b0, b1, e = a0[on], a1[on], b0[on], b1[on], e[on]
            own = a0 == b0
            full = (a1 > a0) & (b1 > b0) & ~(own & (a1 - a0 < 2))
            if full.any():  # the last pushed is visited first: own subtrees before crossings
                stack.append((d + 1, a0[full], a1[full], b0[full], b1[full], e[full].astype(np.int8)))
    return lab


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges, and the range that each is of."""
    of = np.repeat(np.arange(len(size)), size)
    return start[of] + np.arange(len(of)) - (np.cumsum(size) - size)[of], of


def _pieces(size: np.ndarray) -> Iterator[np.ndarray]:
    at = np.cumsum(size) // (4 * PIECE)
    cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True]))) if len(at) else []
    for a, b in zip(cut[:-1], cut[1:]):
        yield np.arange(a, b)


def _forest(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    got = [(b.column("k").to_numpy(), b.column("fp").to_numpy(), b.column("node").to_numpy()) for b in batches if b.num_rows]
    if not got:
        return
    k, fp, node = (np.concatenate(x) for x in zip(*got))
    turn = (k >> BLOCK).astype(np.uint64) * np.uint64(BLOCK)
    v = fp.view(np.uint64)
    v = np.where(turn == 0, v, (v << turn) | (v >> ((np.uint64(BITS) - turn) % np.uint64(BITS))))
    order = np.lexsort((v, k))
    k, v, node = k[order], v[order], node[order]
    lab = trie_links(k, v, budget)
    on = lab != np.arange(len(lab))
    yield pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(node[lab[on]])], ["u", "v"])


def links(nodes: DataFrame, budget: int = 3) -> DataFrame:
    """Links ``(u, v)`` of a forest that has the components of ``nodes(fp, node)``.

    ``fp`` must be distinct and ``node`` not null. Each trie gives at most one
    link for each of its rows, whatever a group's size.
    """
    if budget > BITS // BLOCK - 1:
        raise ValueError("four blocks find at most three differing bits")
    keys = F.explode(F.array(*[
        F.shiftrightunsigned(F.col("fp"), BITS - BLOCK * (t + 1)).bitwiseAND(F.lit(0xFFFF)) + F.lit(t << BLOCK).cast("long") for t in range(4)]))
    dealt = nodes.select(keys.alias("k"), "fp", "node").repartition("k")
    return dealt.mapInArrow(common.trimmed(lambda it: _forest(it, budget)), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs(doc_id, text)``.

    Null and blank texts have fingerprint zero and are linked like any other;
    repeated rows keep one output row each; a row whose doc_id is null takes part
    with a null id and gets the component of its fingerprint, if that has one. An
    empty table gives no rows; other columns are ignored.
    """
    fps = common.stage(with_fingerprint(docs.select("doc_id", "text"), words, seed).select("doc_id", "fp"), "simhash")
    nodes = common.stage(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    comps = common.components(links(nodes.where("node is not null"), budget), "simhash-links")
    of = nodes.join(comps, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def bits_of(s: np.ndarray, words: int = WIDE) -> np.ndarray:
    """``words`` fingerprints of 64 bits over a set of hashes; zero for an empty one."""
    out = np.zeros(words, np.uint64)
    for w in range(words if len(s) else 0):
        g = s * np.uint64(0x9E3779B97F4A7C15 + 2 * w * 0x632BE59BD9B4E019 & (1 << 64) - 1 | 1)
        g ^= g >> np.uint64(29)
        g *= np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
        counts = np.zeros(64, np.int64)
        for k in range(0, len(g), 65536):
            counts += np.unpackbits(g[k:k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[w] = np.packbits(2 * counts > len(g), bitorder="little").view(np.uint64)[0]
    return out


def most_bits(similarity: float, bits: int) -> int:
    """Of ``bits``, those that differ, in the mean, at a Jaccard similarity, and four deviations."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(round(bits * p + 4 * np.sqrt(bits * p * (1 - p))))


def sketch(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """``WIDE`` fingerprints of 64 bits, over the set of the text's shingles."""
    return bits_of(np.unique(hashes(text, words, seed)))


def apart(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Bits in which each sketch differs from one."""
    return np.bitwise_count(sketches ^ one).sum(1, dtype=np.int64)


def _sketches(col: pa.Array) -> np.ndarray:
    """(rows, words) of a column of sketches, none of which is null."""
    first = np.frombuffer(col.buffers()[1], np.int32)[col.offset]
    return np.frombuffer(col.buffers()[2], np.uint8)[first:first + len(col) * WIDE * 8].view(np.uint64).reshape(-1, WIDE)


def _sketch_forest(batches: Iterator[pa.RecordBatch], budget: int, most: int) -> Iterator[pa.RecordBatch]:
    """Groups of candidates: each group's least node with all others."""
    got = [(b.column("k").to_numpy(), b.column("v").to_numpy(), b.column("node").to_numpy(),
            _sketches(b.column("sketch"))) for b in batches if b.num_rows]
    if not got:
        return
    k, v, node, full = (np.concatenate(x) for x in zip(*got))
    v = v.astype(np.uint64) << np.uint64(BITS - 2 * HALF)
    order = np.lexsort((v, k))
    k, v, node, full = k[order], v[order], node[order], full[order]
    head = np.ascontiguousarray(full[:, :HEAD])

    def agree(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        ok = apart(head[i], head[j]) <= most
        ok[ok] = apart(full[i[ok]], full[j[ok]]) <= most
        return ok

    lab = trie_links(k, v, budget, HALF, 2 * HALF, agree, MATRIX)
    least = node.copy()
    np.minimum.at(least, lab, node)
    least = least[lab]
    on = least != node
    group = (k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ least.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    yield pa.RecordBatch.from_arrays([pa.array(group[on].view(np.int64)), pa.array(least[on]), pa.array(node[on])], ["g", "u", "v"])


def _keys(sketches: pd.Series) -> pd.Series:
    full = np.frombuffer(b"".join(sketches), np.uint64).reshape(-1, WIDE)
    bits = np.unpackbits(full.view(np.uint8), axis=1, bitorder="little")[:, :TABLES * 2 * HALF].reshape(len(full), TABLES, 2, HALF)
    half = bits.astype(np.int64) @ (1 << np.arange(HALF))
    a, b = half[:, :, 0], half[:, :, 1]
    t = np.arange(TABLES)
    key = np.stack([(2 * t << HALF) + a, (2 * t + 1 << HALF) + b], 2).reshape(len(full), -1)
    val = np.stack([(a << HALF) + b, (b << HALF) + a], 2).reshape(len(full), -1)
    return pd.Series(list((key << 2 * HALF) + val))


def similar(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """``doc_id, tie, sketch, component`` of each row of ``docs``, by similarity of shingle sets.

    At a Jaccard similarity of 0.8 a seventh of all bits differ, too many for the
    four blocks of a fingerprint. A sketch of 576 bits gives 26 tries of 22 bits,
    joined with a budget of two bits, and a loose bound on the whole sketch. These
    give candidates only: a link holds by exact Jaccard of the shingle sets. A pair
    at the threshold is met by a trie with a probability of 0.999. Null and blank
    texts are one group; an empty table gives no rows; other columns are ignored.
    """

    @F.pandas_udf("binary")
    def sketched(col: pd.Series) -> pd.Series:
        return pd.Series([sketch(t, words).tobytes() for t in col])

    keys = F.pandas_udf(_keys, "array<long>")
    most = most_bits(similarity, WIDE * BITS)
    rows = common.stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), sketched("text").alias("sketch")), "sketch")
    # texts of one sketch are one node, named by a hash of it
    nodes = common.stage(rows.select(F.xxhash64("sketch").alias("node"), "sketch").distinct(), "sketch-nodes")
    dealt = nodes.select("node", "sketch", F.explode(keys("sketch")).alias("kv")).select(
        F.shiftrightunsigned("kv", 2 * HALF).alias("k"), F.col("kv").bitwiseAND(F.lit((1 << 2 * HALF) - 1)).alias("v"), "node", "sketch")
    first = dealt.repartition("k").mapInArrow(common.trimmed(lambda it: _sketch_forest(it, APART, most)), "g long, u long, v long")
    shingles = F.pandas_udf(lambda col: pd.Series([np.unique(hashes(t, words)).view(np.int64) for t in col]), "array<long>")
    one = rows.groupBy(F.xxhash64("sketch").alias("node")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("m"))
    one = one.select("node", F.coalesce("m.doc_id", F.lit(0)).alias("i"), F.col("m.tie").alias("t"))

    def sets(wanted: DataFrame) -> DataFrame:
        texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("i"), F.xxhash64("text").alias("t"), "text")
        texts = texts.join(one.join(wanted, "node", "left_semi"), ["i", "t"]).dropDuplicates(["node"])
        return texts.select("node", shingles("text").alias("s"))

    edges = verified.links(first, sets, similarity, "sketch")
    comps = common.components(edges, "sketch-links")
    of = nodes.join(comps, "node", "left").select("sketch", F.coalesce("component", "node").alias("component"))
    return rows.join(of, "sketch")


def keep_similar_one(docs: DataFrame, similarity: float = 0.8, words: int = 5) -> DataFrame:
    """``docs`` with one row of each group of :func:`similar`.

    It is the row of the smallest doc_id, of the smallest hash of the text if rows
    of that id differ, and one of those that repeat. A row without a doc_id stays
    only if no row of its group has one.
    """
    found = similar(docs, similarity, words)
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("b"))
    # names that no column of docs has
    i, n, t = (common.free_name(docs, x) for x in ("id_", "none_", "tie_"))
    one = best.select(F.coalesce("b.doc_id", F.lit(0)).alias(i), F.col("b.none").alias(n), F.col("b.tie").alias(t))
    every = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), n: F.col("doc_id").isNull(), t: F.xxhash64("text")})
    return every.join(one, [i, n, t], "left_semi").dropDuplicates([i, n, t]).select(*[F.col(f"`{c}`") for c in docs.columns])
