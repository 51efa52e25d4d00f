"""Exact removal of repeated substrings by column-wise sorting of aligned segments.

A byte is removed if a string of 200 bytes that covers it starts anywhere else.
Every such string holds an anchor: the least of its 101 strings of 100 bytes, by
hash. Equal strings have it at the same offset, so repeats are found among
segments that are aligned at equal anchors, with 100 bytes on either side.

The segments of a task are put in order column by column: each round inserts one
symbol of every segment, from the outermost to the one beside the anchor, and
keeps the order of the round before where symbols are equal, which is how the
collection's order and transform grow in the construction of Bauer, Cox and
Rosone. Common prefixes of neighbours in that order tell which segments agree how
far to the right; the same on the left sides. A string of 200 bytes repeats if two
segments agree in ``l`` bytes to the left and in ``100 - l`` to the right.

Inserting all suffixes of whole documents would take as many sequential passes over
the corpus as the longest document has bytes. Alignment at anchors leaves one
suffix a segment and a hundred rounds, whatever the length of the documents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm import common

LENGTH, GRAM = 200, 100
SIDE = LENGTH - GRAM
#: Segments of one anchor from which on its strings are counted by hash and not sorted in one task.
HOT = 200_000
#: Anchors that are treated as hot at most; above, the limit for them is doubled.
CROWDED = 1000
#: Texts up to which a list of those with repeated anchors is sent to the tasks that read.
LISTED = 1_000_000
_LOW = 20
_MASK = np.uint64((1 << _LOW) - 1)
_BLOCK = 1 << 19
_TABLE = np.random.default_rng(200).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_UP = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(_BLOCK + 2 * LENGTH, _P, np.uint64))))
_DOWN = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(_BLOCK + 2 * LENGTH, pow(_P, -1, 1 << 64), np.uint64))))


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of a text's anchors: of any ``LENGTH`` bytes, the last least string of ``GRAM`` bytes."""
    hs, ps = [], []
    whole = np.frombuffer(raw, np.uint8)
    for lo in range(0, max(1, len(raw) - LENGTH + 1), _BLOCK):
        part = whole[lo:lo + _BLOCK + LENGTH - 1]
        n = len(part)
        if n < LENGTH:
            continue
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_TABLE[part] * _UP[:n], out=total[1:])
        h = (total[GRAM:] - total[:-GRAM]) * _DOWN[:n - GRAM + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        least = (h & ~_MASK) | (_MASK - np.arange(len(h), dtype=np.uint64))
        wide = 1
        while 2 * wide <= SIDE + 1:
            least = np.minimum(least[:-wide], least[wide:])
            wide *= 2
        rest = SIDE + 1 - wide
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        at = (_MASK - (least & _MASK)).astype(np.int64)
        at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        hs.append(h[at])
        ps.append(at + lo)
    if not hs:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, p = np.concatenate(hs), np.concatenate(ps)
    p, first = np.unique(p, return_index=True)
    return h[first], p


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            got = [anchors((t.as_py() or "").encode()) for t in part.column("text")]
            of = pa.array(np.repeat(np.arange(len(got)), [len(p) for _, p in got]))
            if len(of):
                yield pa.RecordBatch.from_arrays([part.column("a").take(of), part.column("b").take(of), pa.array(np.concatenate([h for h, _ in got]).view(np.int64)),
                                                  pa.array(np.concatenate([p for _, p in got]))], ["a", "b", "h", "pos"])


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 250) -> Iterator[pa.RecordBatch]:
    """A few rows at once: what Python makes of nested columns is many times their size."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


_SEGMENTS = "h long, g long, a long, b long, pos long, left binary, right binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of texts around their anchors.

    Of equal segments all strings repeat, and two of them are enough for others to
    meet. So a task's third and later ones are a range at once:
    rows whose ``left`` is null, with the range's end as ``g``.
    """
    names = [x.split()[0] for x in _SEGMENTS.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.binary()] * 2
    seen: dict[bytes, int] = {}
    for batch in _parts(batches):
        out: list[tuple] = []
        for a, b, t, want in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text"), batch.column("want").to_pylist()):
            raw = t.as_py().encode()
            for x in want:
                p = x["pos"]
                lo, hi = max(0, p - SIDE), min(len(raw), p + LENGTH)
                name = hashlib.blake2b(b"%d|" % (p - lo) + raw[lo:hi], digest_size=12).digest()
                n = seen[name] = seen.get(name, 0) + 1
                if n > 2:
                    out.append((a, hi, a, b, lo, None, None))  # dealt by its text, not by the anchor
                    continue
                out.append((x["h"], zlib.crc32(raw[p:p + GRAM]), a, b, p, raw[lo:p], raw[p + GRAM:hi]))
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        if len(seen) > 500_000:
            seen.clear()


def _side(parts: list[bytes], group: np.ndarray, away: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of segments by group and by one side's bytes outward, common prefixes with the one before, each one's best, sizes."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.frombuffer(b"".join(x.rjust(SIDE, b"\0") if away else x.ljust(SIDE, b"\0") for x in parts), np.uint8).reshape(-1, SIDE)
    cols = np.ascontiguousarray((flat[:, ::-1] if away else flat).T)
    order = np.arange(len(parts))
    for j in range(SIDE - 1, -1, -1):
        order = order[np.argsort(cols[j][order], kind="stable")]
    order = order[np.argsort(group[order], kind="stable")]
    open_ = group[order[1:]] == group[order[:-1]]
    prefix = np.where(open_, 0, -1)
    for j in range(SIDE):
        c = cols[j][order]
        open_ = open_ & (c[1:] == c[:-1])
        if not open_.any():
            break
        prefix[open_] = j + 1
    prefix = np.concatenate(([-1], prefix))
    best = np.empty(len(order), np.int64)
    best[order] = np.maximum(prefix, np.concatenate((prefix[1:], [-1])))
    return order, prefix, best, size


def repeated(group: np.ndarray, left: list[bytes], right: list[bytes]) -> np.ndarray:
    """(segments, SIDE + 1): whether the string that starts ``l`` bytes before the anchor is in another segment of the group."""
    n = len(group)
    found = np.zeros((n, SIDE + 1), bool)
    lo, lp, lbest, lsize = _side(left, group, True)
    ro, rp, rbest, rsize = _side(right, group, False)
    for l in range(SIDE + 1):  # noqa: E741
        r = SIDE - l
        on = np.flatnonzero((lsize >= l) & (rsize >= r) & (lbest >= l) & (rbest >= r))
        if len(on) < 2:
            continue
        lc, rc = np.empty(n, np.int64), np.empty(n, np.int64)
        lc[lo], rc[ro] = np.cumsum(lp < l), np.cumsum(rp < r)
        key = lc[on] * (n + 1) + rc[on]
        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        found[on[count[at] > 1], l] = True
    return found


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = []
    for batch in batches:
        known = pc.is_null(batch.column("left"))
        done = batch.filter(known)
        if done.num_rows:
            yield pa.RecordBatch.from_arrays([done.column(c) for c in ("a", "b", "pos", "g")], ["a", "b", "lo", "hi"])
        held.append(batch.filter(pc.invert(known)))
    table = pa.Table.from_batches(held) if held else None
    if table is None or not table.num_rows:
        return
    h, g = table.column("h").to_numpy(), table.column("g").to_numpy()
    order = np.lexsort((g, h))
    new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])))
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new)
    many = np.flatnonzero(np.bincount(group)[group] > 1)
    if not len(many):
        return
    table = table.take(pa.array(many))
    found = repeated(group[many], table.column("left").to_pylist(), table.column("right").to_pylist())
    yield from _ranges(table.column("a").to_numpy(), table.column("b").to_numpy(), table.column("pos").to_numpy(), found)


def _ranges(a, b, pos, found) -> Iterator[pa.RecordBatch]:
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    yield pa.RecordBatch.from_arrays([pa.array(a[row]), pa.array(b[row]), pa.array(pos[row] - last + 1), pa.array(pos[row] - first + LENGTH)], ["a", "b", "lo", "hi"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each string of a segment by its digest."""
    for batch in batches:
        out = []
        for h, g, a, b, p, x, y in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if x is None:  # a range already
                out.append((h, -1, b"", a, b, p, g))
                continue
            for l in range(max(0, SIDE - len(y)), min(SIDE, len(x)) + 1):  # noqa: E741
                out.append((h, l, hashlib.blake2b(b"%d|" % g + x[len(x) - l:] + y[:SIDE - l], digest_size=16).digest(), a, b, p - l, p - l + LENGTH))
        if out:
            kinds = [pa.int64(), pa.int32(), pa.binary(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["h", "l", "d", "a", "b", "lo", "hi"])


_KEPT = "a long, b long, n_removed long, n_spans long, kept_sha256 string"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its ranges."""
    for batch in _parts(batches):
        rows = []
        for a, b, t, rs in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text"), batch.column("ranges").to_pylist()):
            raw, removed, spans, last, kept = t.as_py().encode(), 0, 0, 0, hashlib.sha256()
            merged: list[list[int]] = []
            for lo, hi in sorted((r["lo"], r["hi"]) for r in rs):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                else:
                    merged.append([lo, hi])
            for lo, hi in merged:
                kept.update(raw[last:lo])
                removed, spans, last = removed + hi - lo, spans + 1, hi
            kept.update(raw[last:])
            rows.append((a, b, removed, spans, kept.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], [x.split()[0] for x in _KEPT.split(", ")])


def dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs``.

    Null texts are empty; texts of fewer than ``LENGTH`` bytes lose nothing; rows
    that repeat are different places, so texts that are there twice and long
    enough lose all; ids may be null; an empty table gives no rows; other columns
    are ignored.

    Equal texts are searched once. Anchors that occur once, nine tenths of all, go
    no further than a count. The segments of an anchor with more than ``hot``
    places do not meet in a task: their strings are counted by digest, with sums
    before the shuffle.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id"), text.alias("text")).withColumn("a", F.xxhash64("text")).withColumn("b", F.crc32("text"))
    facts = common.stage(rows.select("doc_id", "a", "b", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "texts")
    often = facts.groupBy("a", "b").agg(F.count(F.lit(1)).alias("copies"))

    # of equal texts one is searched
    twins = common.stage(facts.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keep")).where("n > 1").select("a", "b", "keep"), "twins")
    once = rows.join(common.small(twins, LISTED), ["a", "b"], "left").where("keep is null or doc_id is null or doc_id = keep")
    found = common.stage(once.where(F.octet_length("text") >= LENGTH).select("a", "b", "text").mapInArrow(common.trimmed(_anchor_rows), "a long, b long, h long, pos long"), "anchors")
    spot = F.struct("a", "b", "pos")
    again = found.groupBy("h").agg(F.min(spot).alias("x"), F.max(spot).alias("y")).where("x <> y").select("h")
    want = found.join(again, "h").groupBy("a", "b").agg(F.collect_set(F.struct("pos", "h")).alias("want"))
    want = common.stage(want, "wanted")
    often_met = common.stage(want.select(F.explode("want.h").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot), "hot")
    while len(crowded := often_met.where(F.col("n") > hot).select("h").limit(CROWDED + 1).collect()) > CROWDED:
        hot *= 2
    crowd = F.array(*[F.lit(r.h) for r in crowded]).cast("array<long>")
    want = want.withColumn("want", F.transform("want", lambda x: F.struct(x["pos"].alias("pos"), x["h"].alias("h"), F.array_contains(crowd, x["h"]).alias("hot"))))
    listed = want.select("a", "b")
    some = rows.select("a", "b", "text")
    if listed.limit(LISTED + 1).count() <= LISTED:
        some = some.join(F.broadcast(listed), ["a", "b"], "left_semi")
    met = common.stage(some.dropDuplicates(["a", "b"]).join(want, ["a", "b"]), "repeating")

    calm = met.withColumn("want", F.filter("want", lambda x: ~x["hot"])).mapInArrow(common.trimmed(_segments), _SEGMENTS)
    ranges = calm.repartition("h").mapInArrow(common.trimmed(_decide), "a long, b long, lo long, hi long")
    hot_ones = met.withColumn("want", F.filter("want", lambda x: x["hot"])).where(F.size("want") > 0)
    strings = hot_ones.mapInArrow(common.trimmed(_segments), _SEGMENTS).mapInArrow(common.trimmed(_hashed), "h long, l int, d binary, a long, b long, lo long, hi long")
    here = F.struct("a", "b", "lo")
    twice = strings.where("l >= 0").groupBy("h", "l", "d").agg(F.min(here).alias("x"), F.max(here).alias("y")).where("x <> y").select("h", "l", "d")
    ranges = ranges.unionByName(strings.join(twice, ["h", "l", "d"]).select("a", "b", "lo", "hi")).unionByName(strings.where("l < 0").select("a", "b", "lo", "hi"))
    ranges = ranges.groupBy("a", "b").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))

    cut = met.select("a", "b", "text").join(ranges, ["a", "b"]).select("a", "b", "text", "ranges").mapInArrow(common.trimmed(_kept), _KEPT)
    of = common.stage(often.join(cut, ["a", "b"], "left"), "cuts")
    out = facts.join(of, ["a", "b"])
    all_ = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_bytes", F.when(all_, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(all_, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(all_, none).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
