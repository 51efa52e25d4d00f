"""Links between sets that hold by exact Jaccard, from groups of candidates.

The first links of a group connect all of its candidates. Each is verified on the
sets. A group whose nodes are then not all in one component of the links found so
far, in whichever group, is open: there each node outside of the largest component
is held against all nodes of other components, and a link for each component met is
kept. So no pair is passed over, and no pairs are listed: a group gives fewer links
than it has nodes. The sets of a large group are dealt into shards, and each two
shards meet in a task of their own, so a task holds two shards at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm import common

#: Hashes in a shard of a group, in the mean.
SHARD = 1_000_000


def joined(size: np.ndarray, flat: np.ndarray, lab: np.ndarray, side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links, as places, that join the parts ``lab`` of some sets as all links of ``similarity`` would.

    Sets lie after each other in ``flat``, none is empty. If there are two sides, links are between them.
    """
    _, flat = np.unique(flat, return_inverse=True)
    _, lab = np.unique(lab, return_inverse=True)
    start = np.cumsum(size) - size
    mark = np.zeros(int(flat.max()) + 1, np.int32)
    across = side.min() != side.max()
    largest, out = np.bincount(lab).argmax(), []
    for i in np.flatnonzero(lab != largest).tolist():
        if lab[i] == largest:
            continue
        on = (lab != lab[i]) & (size >= similarity * size[i]) & (size * similarity <= size[i])
        if across:
            on &= side != side[i]
        if not on.any():
            continue
        own = flat[start[i]:start[i] + size[i]]
        mark[own] = 1
        shared = np.add.reduceat(mark[flat], start)
        mark[own] = 0
        j = np.flatnonzero(on & (shared >= similarity * (size + size[i] - shared)))
        parts, first = np.unique(lab[j], return_index=True)
        for part, k in zip(parts.tolist(), j[first].tolist()):
            out.append((i, k))
        if len(parts):
            one = np.append(parts, lab[i])
            lab[np.isin(lab, one)] = largest if largest in one else one.min()
    return out


def _open_links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """``u, v`` from the nodes ``(key, node, lab, side, s)`` of open groups, which come in the order of ``key``."""
    held: list[pa.RecordBatch] = []

    def links_of(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(parts).combine_chunks()
        if t.num_rows < 2:
            return None
        node, sets = t.column("node").to_numpy(), t.column("s").combine_chunks()
        size = np.diff(sets.offsets.to_numpy()).astype(np.int64)
        got = joined(size, sets.flatten().to_numpy(), t.column("lab").to_numpy(), t.column("side").to_numpy(), similarity)
        if not got:
            return None
        u, v = (node[list(x)] for x in zip(*got))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    for batch in batches:
        key = batch.column("key").to_numpy()
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))).tolist() if len(key) else []
        for lo, hi in zip(cut[:-1], cut[1:]):
            if held and held[0].column("key")[0].as_py() != int(key[lo]):
                if (got := links_of(held)) is not None:
                    yield got
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held and (got := links_of(held)) is not None:
        yield got


def links(first: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float, what: str) -> DataFrame:
    """Links ``(u, v)`` whose components are those of all pairs of a group at ``similarity`` or more.

    ``first(g, u, v)`` has the first links of each group, u < v; ``sets`` gives
    ``(node, s)``, the set as an array of hashes, for a table of nodes. A node has one
    set. Empty sets are alike.
    """
    known = common.stage(first.distinct(), f"{what}-first")
    nodes = common.stage(known.select(F.col("u").alias("node")).union(known.select("v")).distinct(), f"{what}-nodes")
    of = common.stage(sets(nodes).select("node", F.when(F.size("s") > 0, F.col("s")).otherwise(F.array(F.lit(0).cast("long"))).alias("s")), f"{what}-sets")
    shared = F.size(F.array_intersect("a", "b"))
    both = known.select("u", "v").distinct().join(of.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(of.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    good = common.stage(both.where(shared >= F.lit(similarity) * (F.size("a") + F.size("b") - shared)).select("u", "v"), f"{what}-good")

    comps = common.components(good, f"{what}-parts").withColumnRenamed("component", "c")
    labels = nodes.join(comps, "node", "left").join(of.select("node", F.size("s").alias("n")), "node").select("node", F.coalesce("c", "node").alias("lab"), "n")
    members = known.select("g", F.col("u").alias("node")).union(known.select("g", "v")).distinct().join(labels, "node")
    # a group of one link that fails has no other pair
    parted = members.groupBy("g").agg(F.min("lab").alias("a"), F.max("lab").alias("b"), F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).where("a < b and c > 2")
    parted = common.stage(parted.select("g", F.ceil(F.col("n") / SHARD).cast("int").alias("shards")), f"{what}-open")
    if not parted.limit(1).count():
        return good
    own = F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")
    dealt = members.join(parted, "g").withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    dealt = dealt.select(F.xxhash64("g", F.least("side", "other"), F.greatest("side", "other")).alias("key"), "node", "lab", "side").join(of, "node")
    found = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(common.trimmed(lambda it: _open_links(it, similarity)), "u long, v long")
    return good.union(common.stage(found, f"{what}-more"))
