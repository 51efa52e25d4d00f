"""Embedding near-dedup by dual traversal of cover trees.

Rows are dealt to cells, each around one of a bounded number of pivots, and cells to
chunks. A chunk is a cover tree: nested levels whose radii halve, each node with its
own centre among its children and the covering radius that its members really have.
Two cells, and below them two trees, are traversed together. A pair of nodes is
dropped if its centres are further apart than the link distance and both radii; all
its members are linked if centres and radii together are within it; else both nodes
give way to their parts of half the radius. What remains are exact pairs. Links are
counted and joined where they are found and never listed.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm import common

#: Vectors of a chunk in the mean, and the largest number of pivots.
CHUNK, PIVOTS = 8192, 4096
#: Pairs of members below which two nodes are compared as one matrix.
DIRECT = 1 << 18
#: Doubles err by less; bounds in single precision are loosened by ROUGH in the cosine.
SAFE, ROUGH = 1e-7, 1e-5
#: Radius below which single precision does not tell near from far.
FINE = 0.02
#: Tasks over which the copies of one vector are dealt.
SALTS = 32
_FAR = 3.0


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths, in doubles; scaled first, so that no square overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def apart(cos: np.ndarray) -> np.ndarray:
    """Distance of unit vectors from their cosine."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))


class Tree:
    """Members in an order in which each node is a slice that its centre leads; nodes as arrays."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: np.ndarray, above: np.ndarray) -> None:
        self.x, self.weight, self.lo, self.hi, self.radius, self.above = x, weight, lo, hi, radius, above
        self.x32, self.upto = x.astype(np.float32), np.concatenate(([0], np.cumsum(weight)))

    def mass(self, node: int) -> int:
        return int(self.upto[self.hi[node]] - self.upto[self.lo[node]])

    def cut(self, node: int, radius: float) -> np.ndarray:
        """The largest nodes at or below ``node`` whose radius is at most ``radius``."""
        if self.radius[node] <= radius:
            return np.array([node])
        inside = (self.lo >= self.lo[node]) & (self.hi <= self.hi[node])
        return np.flatnonzero(inside & (self.radius <= radius) & (self.above > radius))


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the unit vectors ``x``, and each node's ``lo, hi``, covering radius and its parent's."""
    x32, order = x.astype(np.float32), np.arange(len(x))
    nodes: list[tuple[int, int, float, float]] = []
    todo = [(0, len(x), np.inf)]
    while todo:
        lo, hi, above = todo.pop()
        own = order[lo:hi]
        if hi - lo == 1:
            nodes.append((lo, hi, 0.0, above))
            continue
        radius = float(apart(x[own] @ x[own[0]]).max()) + SAFE
        nodes.append((lo, hi, radius, above))
        near = 2.0 ** np.floor(np.log2(radius))
        near = near / 2 if near >= radius - SAFE else near
        if near <= SAFE * 10:  # the same but for rounding
            todo += [(i, i + 1, radius) for i in range(lo, hi)]
            continue
        label, ranked = _net((x32 if near > FINE else x)[own], 1 - near * near / 2)
        ends = np.flatnonzero(np.diff(label[ranked])) + 1
        if not len(ends):
            todo += [(i, i + 1, radius) for i in range(lo, hi)]
            continue
        order[lo:hi] = own[ranked]
        todo += [(lo + int(a), lo + int(b), radius) for a, b in zip([0, *ends], [*ends, hi - lo])]
    lo, hi, radius, above = (np.array(c) for c in zip(*nodes))
    return order, lo, hi, radius, above


def _net(x: np.ndarray, cos: float) -> tuple[np.ndarray, np.ndarray]:
    """A label for each vector, by greedy centres with a cosine below ``cos``, and their order: by label, centre first. The first vector is a centre."""
    label, other = np.full(len(x), -1), np.ones(len(x), bool)
    rest, used = np.arange(len(x)), 0
    while len(rest):
        some = rest[:256]
        near, free, centres = x[some] @ x[some].T >= cos, np.ones(len(some), bool), []
        for i in range(len(some)):
            if free[i]:
                centres.append(i)
                free &= ~near[i]
                free[i] = False
        dots = x[rest] @ x[some[centres]].T
        best = dots.argmax(axis=1)
        best[centres] = np.arange(len(centres))  # ``some`` leads ``rest``
        within = dots[np.arange(len(rest)), best] >= cos
        within[:len(some)] = True
        label[rest[within]] = used + best[within]
        other[some[centres]] = False
        used, rest = used + len(centres), rest[~within]
    return label, np.lexsort((other, label))


class Pairs:
    """Dual traversal of two trees, or of one with itself; counts and joins links at ``cos`` or more."""

    def __init__(self, a: Tree, b: Tree, cos: float) -> None:
        self.a, self.b, self.cos, self.same = a, b, cos, a is b
        self.reach = float(apart(np.array(cos)))
        self.counts = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64) if not self.same else None
        self.shift = 0 if self.same else len(a.x)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def count(self, side: int, where, add) -> None:  # noqa: ANN001
        self.counts[0 if self.same else side][where] += add

    def all_linked(self, p: int, q: int) -> None:
        a, b = self.a, self.b
        self.count(0, slice(a.lo[p], a.hi[p]), b.mass(q))
        self.count(1, slice(b.lo[q], b.hi[q]), a.mass(p))
        for one, lo, hi in ((a.lo[p], b.lo[q] + self.shift, b.hi[q] + self.shift), (b.lo[q] + self.shift, a.lo[p], a.hi[p])):
            rows = np.arange(lo, hi)
            self.edges.append((np.full(len(rows), one), rows))

    def inner_linked(self, p: int) -> None:
        rows = np.arange(self.a.lo[p], self.a.hi[p])
        self.counts[0][rows] += self.a.mass(p) - self.a.weight[rows]
        self.edges.append((np.full(len(rows) - 1, rows[0]), rows[1:]))

    def matrix(self, rows: np.ndarray, cols: np.ndarray, inner: bool) -> None:
        """All pairs of some members, exactly; ``inner``: of one node with itself."""
        linked = self.a.x[rows] @ self.b.x[cols].T >= self.cos
        if inner:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return
        self.counts[0][rows] += linked @ self.b.weight[cols]
        if not inner:
            self.count(1, cols, self.a.weight[rows] @ linked)
        own, other = np.arange(len(rows)), np.full(len(cols), len(rows))
        while True:  # the smallest row that reaches each row and column
            new = np.minimum(other, np.where(linked, own[:, None], len(rows)).min(axis=0))
            mine = np.minimum(own, np.where(linked, new[None, :], len(rows)).min(axis=1))
            if (mine == own).all() and (new == other).all():
                break
            own, other = mine, new
        met = other < len(rows)
        self.edges.append((rows[own], rows))
        self.edges.append((rows[other[met]], cols[met] + self.shift))

    def nodes(self, ps: np.ndarray, qs: np.ndarray, ordered: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs of nodes that stay open; ``ordered``: only those of one list with p before q."""
        a, b, open_ = self.a, self.b, []
        for part in (qs[b.radius[qs] == 0], qs[b.radius[qs] > 0]):
            if not len(part):
                continue
            widest, right = float(b.radius[part].max()), b.x32[b.lo[part]]
            for at in range(0, len(ps), 256):
                own = ps[at:at + 256]
                far = np.minimum(self.reach + a.radius[own] + widest, 2.0)
                i, j = np.nonzero(a.x32[a.lo[own]] @ right.T >= (1 - far * far / 2 - ROUGH)[:, None].astype(np.float32))
                for k in range(0, len(i), 1 << 15):
                    p, q = own[i[k:k + (1 << 15)]], part[j[k:k + (1 << 15)]]
                    if ordered:
                        p, q = p[p < q], q[p < q]
                    cos = np.einsum("ij,ij->i", a.x[a.lo[p]], b.x[b.lo[q]])
                    gap, d = a.radius[p] + b.radius[q], apart(cos)
                    single = gap == 0
                    hit = single & (cos >= self.cos)
                    if hit.any():
                        u, v = a.lo[p[hit]], b.lo[q[hit]]
                        np.add.at(self.counts[0], u, b.weight[v])
                        np.add.at(self.counts[0 if self.same else 1], v, a.weight[u])
                        self.edges.append((u, v + self.shift))
                    for x, y in zip(*(s[~single & (d + gap <= self.reach - SAFE)].tolist() for s in (p, q))):
                        self.all_linked(x, y)
                    still = ~single & (d + gap > self.reach - SAFE) & (d <= self.reach + gap + SAFE)
                    if still.any():
                        open_.append((p[still], q[still]))
        return open_

    def run(self) -> None:
        a, b = self.a, self.b
        inner = [0] if self.same else []
        across = [] if self.same else self.nodes(np.array([0]), np.array([0]), False)
        radius = max(a.radius[0], b.radius[0], SAFE)
        # nodes that reach further than a link are hardly ever dropped: the first level below the roots has its reach
        radius = min(radius, 2 * self.reach) if self.reach > SAFE else radius
        while inner or across:
            radius, later, after = radius / 2, [], []
            for p in inner:
                if a.radius[p] == 0:
                    continue
                if 2 * a.radius[p] <= self.reach - SAFE:
                    self.inner_linked(p)
                    continue
                rows = np.arange(a.lo[p], a.hi[p])
                if len(rows) ** 2 <= DIRECT or radius < SAFE:
                    for at in range(0, len(rows), 512):
                        own = rows[at:at + 512]
                        self.matrix(own, own, True)
                        for on in range(at + 512, len(rows), 512):
                            self.matrix(own, rows[on:on + 512], False)
                    continue
                parts = a.cut(p, radius)
                later += self.nodes(parts, parts, True)
                after += parts[a.radius[parts] > 0].tolist()
            if across:
                ps, qs = (np.concatenate(c) for c in zip(*across))
                ranked = np.argsort(ps, kind="stable")
                ps, qs = ps[ranked], qs[ranked]
                cuts = np.flatnonzero(np.diff(ps)) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(ps)]):
                    p, own = int(ps[lo]), qs[lo:hi]
                    rows, size = np.arange(a.lo[p], a.hi[p]), int((b.hi[own] - b.lo[own]).sum())
                    if len(rows) * size <= DIRECT or radius < SAFE:
                        cols = np.concatenate([np.arange(b.lo[q], b.hi[q]) for q in own])
                        for at in range(0, len(rows), 512):
                            for on in range(0, len(cols), 512):
                                self.matrix(rows[at:at + 512], cols[on:on + 512], False)
                        continue
                    below = np.concatenate([b.cut(int(q), radius) for q in own])
                    later += self.nodes(a.cut(p, radius), below, False)
            inner, across = after, later

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of linked members, the second the smallest that the first is joined to here."""
        label = np.arange(len(self.a.x) + (0 if self.same else len(self.b.x)))
        if self.edges:
            u, v = (np.concatenate(c) for c in zip(*self.edges))
            while True:
                least = np.minimum(label[u], label[v])
                new = label.copy()
                np.minimum.at(new, u, least)
                np.minimum.at(new, v, least)
                np.minimum.at(new, label[u], least)
                np.minimum.at(new, label[v], least)
                new = new[new]
                if (new == label).all():
                    break
                label = new
        on = np.flatnonzero(label != np.arange(len(label)))
        return on, label[on]


def _vectors(column: pa.Array) -> np.ndarray:
    """A list column whose lists are equally long as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _pack(tables: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **tables)
    return out.getvalue()


def _tree(blob: bytes) -> tuple[np.ndarray, Tree]:
    with np.load(io.BytesIO(blob)) as t:
        return t["node"], Tree(unit(t["x"]), t["m"], t["lo"], t["hi"], t["radius"], t["above"])


def _chunk(table: pa.Table) -> pa.Table:
    """One row with the tree of a chunk ``(cell, chunk, node, m, embedding)``."""
    x = _vectors(table.column("embedding").combine_chunks())
    order, lo, hi, radius, above = build(unit(x))
    blob = _pack({"node": table.column("node").to_numpy()[order], "m": table.column("m").to_numpy()[order], "x": x[order], "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "radius": radius, "above": above})
    return pa.table({"cell": table.column("cell").slice(0, 1), "chunk": table.column("chunk").slice(0, 1), "tree": pa.array([blob], pa.binary())})


def _traversed(batches: Iterator[pa.RecordBatch], cos: float) -> Iterator[pa.RecordBatch]:
    """``u, v, c`` of pairs of trees, which follow each other: u has c more links, or u and v are joined."""
    def found(trees: list[bytes]) -> pa.RecordBatch | None:
        (own, a), *other = map(_tree, trees)
        b = other[0][1] if other else a
        pairs = Pairs(a, b, cos)
        pairs.run()
        every = np.concatenate((own, other[0][0])) if other else own
        counts = np.concatenate(pairs.counts) if other else pairs.counts[0]
        on = np.flatnonzero(counts)
        u, v = pairs.joined()
        if not len(on) and not len(u):
            return None
        c = pa.array(np.concatenate((counts[on], np.zeros(len(u), np.int64))))
        ends = pa.array(np.concatenate((every[on], every[v])), mask=np.arange(len(on) + len(u)) < len(on))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate((every[on], every[u]))), ends, c], ["u", "v", "c"])

    key, held = None, []
    for batch in batches:
        for a, b, tree in zip(*(batch.column(c) for c in ("a", "b", "tree"))):
            now = (a.as_py(), b.as_py())
            if now != key:
                if held and (out := found(held)) is not None:
                    yield out
                key, held = now, []
            held.append(tree.as_py())
    if held and (out := found(held)) is not None:
        yield out


def _assigned(batches: Iterator[pa.RecordBatch], pivots: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows with ``cell``, the nearest pivot of their dimension, and ``d``, its distance; without one the cell is below zero."""
    for batch in batches:
        lists = batch.column("embedding")
        size = np.diff(lists.offsets.to_numpy())
        cell, d = -size.astype(np.int64), np.full(len(size), _FAR)
        for n in np.unique(size):
            if int(n) in pivots:
                at = np.flatnonzero(size == n)
                number, centre = pivots[int(n)]
                dots = unit(_vectors(lists.take(pa.array(at)))) @ centre.T
                best = dots.argmax(axis=1)
                cell[at], d[at] = number[best], apart(dots[np.arange(len(at)), best]) + SAFE
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(d)], [*batch.schema.names, "cell", "d"])


def _met(batches: Iterator[pd.DataFrame], cells: pd.DataFrame, pivots: dict[int, tuple[np.ndarray, np.ndarray]], reach: float) -> Iterator[pd.DataFrame]:
    """Pairs of cells ``p <= q`` that are not dropped; ``all``: all their members are linked."""
    radius, where = dict(zip(cells["cell"], cells["radius"])), {int(c): (n, k) for n, (number, _) in pivots.items() for k, c in enumerate(number)}
    for batch in batches:
        rows = []
        for p in batch["cell"].tolist():
            if p not in where:
                rows.append((p, p, False))
                continue
            n, k = where[p]
            number, centre = pivots[n]
            there = np.array([int(q) in radius and q >= p for q in number])
            q, d = number[there], apart(centre[there] @ centre[k])
            gap = radius[p] + np.array([radius[int(x)] for x in q])
            every = np.where(q == p, gap, d + gap) <= reach - SAFE
            rows += [(p, int(x), bool(e)) for x, e, far in zip(q, every, d > reach + gap + SAFE) if not far]
        yield pd.DataFrame(rows, columns=["p", "q", "all"])


def links(distinct: DataFrame, cos: float, chunk: int = CHUNK, most: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """Links at ``cos`` or more of ``distinct(node, m, embedding)``: ``(node, c)``, the sum of m over those linked, and joined ``(u, v)``.

    At most ``most`` vectors, the first by a hash, are pivots; they decide who shares a
    cell and not which pairs are met.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    chosen = distinct.orderBy(F.xxhash64("node"), "node").limit(min(most, -(-n // chunk))).select("embedding").collect() if n else []
    pivots, at = {}, 0
    for size in sorted({len(r[0]) for r in chosen}):
        own = unit(np.array([r[0] for r in chosen if len(r[0]) == size]))
        pivots[size] = np.arange(at, at + len(own)), own
        at += len(own)
    reach = float(apart(np.array(cos)))
    kind = dict(distinct.dtypes)["embedding"]
    rows = common.stage(distinct.mapInArrow(lambda it: _assigned(it, pivots), f"node long, m long, embedding {kind}, cell long, d double"), "cover-cells")
    sizes = common.stage(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius"), F.min("node").alias("first"), F.sum("m").alias("mass")), "cover-sizes")
    own = sizes.where("cell >= 0").toPandas()  # as many as pivots
    met = common.stage(sizes.select("cell").mapInPandas(lambda it: _met(it, own, pivots, reach), "p long, q long, all boolean"), "cover-met")

    whole = met.where("all")
    sides = whole.select("p", "q").union(whole.where("p != q").select(F.col("q").alias("p"), F.col("p").alias("q")))
    joined = sides.join(sizes.select(F.col("cell").alias("q"), "first", "mass"), "q").groupBy(F.col("p").alias("cell")).agg(F.sum("mass").alias("mass"), F.min("first").alias("anchor"), F.max(F.col("p") == F.col("q")).alias("self"))
    joined = common.small(common.stage(joined, "cover-joined"), PIVOTS)
    by_cell = rows.select("cell", "node", "m").join(joined, "cell").select("node", (F.col("mass") - F.when(F.col("self"), F.col("m")).otherwise(0)).alias("c"), "anchor")
    first = sizes.select(F.col("cell").alias("p"), F.col("first").alias("u"))
    ends = whole.join(first, "p").join(first.select(F.col("p").alias("q"), F.col("u").alias("v")), "q").select("u", "v")

    parts = sizes.select("cell", F.ceil(F.col("n") / chunk).cast("int").alias("parts"))
    dealt = rows.join(common.small(parts), "cell").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    name = lambda cell, part: F.concat_ws("-", cell, part)
    todo = met.where("not all")
    used = todo.select(F.col("p").alias("cell")).union(todo.select("q")).distinct()
    dealt = dealt.withColumn("chunk", name(F.col("cell"), F.col("part"))).join(common.small(used), "cell", "left_semi").select("cell", "chunk", "node", "m", "embedding")
    trees = common.stage(dealt.groupBy("chunk").applyInArrow(_chunk, "cell long, chunk string, tree binary"), "cover-trees")
    names = common.stage(trees.select("cell", "chunk"), "cover-names")
    with common.setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "4"):  # a row is a tree
        pairs = todo.join(names.select(F.col("cell").alias("p"), F.col("chunk").alias("a")), "p").join(names.select(F.col("cell").alias("q"), F.col("chunk").alias("b")), "q").where("p != q or a <= b").select("a", "b")
        sides = pairs.select(F.col("a").alias("chunk"), "a", "b").union(pairs.where("a != b").select(F.col("b").alias("chunk"), "a", "b"))
        met_trees = trees.select("chunk", "tree").join(sides, "chunk").repartition("a", "b").sortWithinPartitions("a", "b", "chunk")
        found = common.stage(met_trees.select("a", "b", "tree").mapInArrow(common.trimmed(lambda it: _traversed(it, cos)), "u long, v long, c long"), "cover-found")
    common.unstage(trees)
    counts = by_cell.select("node", "c").union(found.where("v is null").select("u", "c")).groupBy("node").agg(F.sum("c").alias("c"))
    edges = by_cell.select(F.col("node").alias("u"), F.col("anchor").alias("v")).union(ends).union(found.where("v is not null").select("u", "v"))
    return counts, edges


def near_duplicates(vectors: DataFrame, cos: float = 0.95, chunk: int = CHUNK, most: int = PIVOTS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors(vec_id, embedding)``.

    Rows link at a cosine of ``cos`` (above 0) or more, in doubles. Equal vectors are one
    until their links are counted; each row counts, also where ids repeat. A vector that
    is null, empty, zero, or holds a null or non-finite component links with nothing, nor
    do vectors of different lengths or rows without an id, which have no component and are
    not kept. Other columns are not read; an empty table gives no rows.
    """
    rows = vectors.select("vec_id", "embedding")
    if dict(rows.dtypes)["embedding"] != "array<float>":
        rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    key = [F.xxhash64(F.lit(k), "embedding").alias(f"h{k}") for k in (1, 2)]
    keyed = rows.where(good).select("vec_id", "embedding", *key)
    groups = keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"), F.any_value("embedding").alias("embedding"))
    distinct = common.stage(groups.withColumn("node", F.monotonically_increasing_id()), "cover-distinct")
    counts, edges = links(distinct.select("node", "m", "embedding"), cos, chunk, most)
    comps = common.stage(common.components(edges, "cover-components"), "cover-parts")
    number = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS))
    every = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    least = comps.join(distinct.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id")).withColumn("salt", F.explode(every))
    comps = comps.withColumn("salt", number("node")).join(least, ["component", "salt"]).select("node", "component_id")
    known = distinct.select("h1", "h2", "node", "rep", "m").join(counts, "node", "left").join(comps, "node", "left")
    known = known.select("h1", "h2", (F.coalesce("c", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"), "rep", "m")
    # one copy for a vector that has none, else one for each task that its copies are dealt to
    known = common.stage(known.withColumn("salt", F.explode(F.when(F.col("m") == 1, F.array(number("rep"))).otherwise(every))).drop("rep", "m"), "cover-known")
    linked = rows.where(good).select("vec_id", *key, number("vec_id").alias("salt")).join(known, ["h1", "h2", "salt"])
    out = linked.select("vec_id", "n_links", "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
