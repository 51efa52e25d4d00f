"""Approximate nearest neighbours by inner product: a forest of hash prefixes.

Each tree gives a vector a string of 64 random-hyperplane bits and holds the
vectors sorted by it. A query descends in every tree to its longest matching
prefix; then all trees ascend together, one bit at a time, until the vectors that
share the prefix are enough. These candidates are ranked by their exact product.
A vector is lengthened by one component so that all have one norm, which turns
the largest product into the smallest angle.

Vectors lie in blocks of bounded size, each with a forest of its own, and the
stated queries visit every block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.llm import common

TREES, BITS = 12, 64
#: Distinct vectors in a block, in the mean; and the share of a block that a query ranks at least.
BLOCK, SHARE = 8192, 0.12
_SEED = 20240229


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int = TREES, seed: int = _SEED):
        self.vectors = vectors
        norm2 = (vectors ** 2).sum(1)
        rest = np.sqrt(np.maximum(norm2.max(initial=0) - norm2, 0))
        rng = np.random.default_rng(seed)
        self.planes = rng.standard_normal((trees, vectors.shape[1] + 1, BITS))
        whole = np.concatenate([vectors, rest[:, None]], 1)
        self.order, self.labels = [], []
        for p in self.planes:
            label = self._label(whole @ p)
            order = np.argsort(label, kind="stable")
            self.order.append(order)
            self.labels.append(label[order])

    @staticmethod
    def _label(products: np.ndarray) -> np.ndarray:
        return np.packbits(products > 0, axis=1).view(">u8").ravel().astype(np.uint64)

    def candidates(self, queries: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each query the vectors of the longest common prefix that ``least`` places share over all trees."""
        q = len(queries)
        low = np.empty((BITS + 1, len(self.order), q), np.int32)
        high = np.empty_like(low)
        for t, p in enumerate(self.planes):
            label = self._label(queries @ p[:-1])
            for x in range(BITS + 1):
                mask = np.uint64(((1 << x) - 1) << (BITS - x) & (1 << BITS) - 1)
                low[x, t] = np.searchsorted(self.labels[t], label & mask, "left")
                high[x, t] = np.searchsorted(self.labels[t], label | ~mask, "right")
        held = (high - low).sum(1)
        # held falls with the prefix length: the longest with enough, or all
        level = np.maximum((held >= least).sum(0) - 1, 0)
        for i in range(q):
            x = level[i]
            yield np.unique(np.concatenate([o[low[x, t, i]:high[x, t, i]] for t, o in enumerate(self.order)]))


def _search(batches: Iterator[pa.RecordBatch], k: int, share: float, trees: int) -> Iterator[pa.RecordBatch]:
    block, ids, vectors, forest = None, [], [], None
    for batch in batches:
        shard, kind = batch.column("shard").to_pylist(), batch.column("kind").to_numpy()
        cut = [0] + [i for i in range(1, len(shard)) if shard[i] != shard[i - 1] or kind[i] != kind[i - 1]] + [len(shard)]
        for a, b in zip(cut[:-1], cut[1:]):
            if a == b:
                continue
            own = batch.column("ids")[a:b].to_pylist()
            vec = np.asarray(batch.column("vec")[a:b].flatten()).reshape(b - a, -1)
            if shard[a] != block:
                block, ids, vectors, forest = shard[a], [], [], None
            if kind[a] == 0:
                ids += own
                vectors.append(vec)
                continue
            if not ids:
                continue
            if forest is None:
                forest = Forest(np.concatenate(vectors), trees)
            for s in range(0, b - a, 256):
                yield from _rank(forest, ids, own[s:s + 256], vec[s:s + 256], k, share)


def _rank(forest: Forest, ids: list, own: list, vec: np.ndarray, k: int, share: float) -> Iterator[pa.RecordBatch]:
    least = int(max(8 * k, share * len(ids))) * len(forest.order)
    qs, vs, sc = [], [], []
    for (me,), v, c in zip(own, vec, forest.candidates(vec, least)):
        score = forest.vectors[c] @ v
        if len(c) > k + 1:  # ties at the last place stay, their ids decide
            edge = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            c, score = c[score >= edge], score[score >= edge]
        found = sorted((-x, i) for x, j in zip(score.tolist(), c.tolist()) for i in ids[j] if i != me)[:k]
        qs += [me] * len(found)
        vs += [i for _, i in found]
        sc += [-x for x, _ in found]
    yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), pa.array(vs, pa.int64()), pa.array(sc, pa.float64())], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float = SHARE, trees: int = TREES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query, both sides ``(vec_id, embedding)``.

    Null ids and vectors that are null, zero, or hold a null, NaN or infinity take
    no part; vectors of another length than the query's are no candidates. Rows
    that repeat count once. Equal vectors are indexed once with their ``k + 1``
    smallest ids, which is all that a result can need. Empty tables give no rows.
    """

    def usable(df):
        vec = F.transform("embedding", lambda x: x.cast("double"))
        df = df.select(F.col("vec_id").cast("long").alias("id"), vec.alias("vec"))
        bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return df.where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0)).distinct()

    # the limit on row numbers is applied before the shuffle too, so a common vector stays small
    first = Window.partitionBy("vec").orderBy("id")
    kept = usable(vectors).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    points = common.stage(kept.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann-points")
    blocks = max(1, -(-points.count() // BLOCK))
    name = lambda b: F.concat_ws("-", F.size("vec").cast("string"), b.cast("string"))
    point = points.select(name(F.pmod(F.xxhash64("vec"), F.lit(blocks))).alias("shard"), F.lit(0).alias("kind"), "ids", "vec")
    asked = usable(queries).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.select(name(F.col("b")).alias("shard"), F.lit(1).alias("kind"), F.array("id").alias("ids"), "vec")
    dealt = point.unionByName(asked).repartition(blocks, "shard").sortWithinPartitions("shard", "kind")
    found = dealt.mapInArrow(lambda it: _search(it, k, share, trees), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
