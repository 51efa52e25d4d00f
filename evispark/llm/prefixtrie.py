"""Prefix trie of conversations, level by level.

A conversation is a path of turns; conversations that begin alike share nodes. A
node is named by a digest of its path, the exclusive or of a hash of (place, turn)
along it, so a conversation finds its next node from its own row and no task holds
all that pass through one node. Equal conversations are merged first. Per depth the
live conversations are then grouped by (parent node, next turn); the smallest
conversation names the node. A conversation that is alone in its node is no longer
live: what follows of it is a chain, whose nodes need no grouping. Rounds are
therefore as many as the longest prefix that different conversations share. Leaves
and savings then roll up from the last level to the root by joins of each level's
sums with its parents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.llm import common

NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Turns of a conversation in a block; of a very long one no task gets more in one group.
BLOCK = 1024
#: Conversation ids in a piece of the list whose digest is taken.
PIECE = 65536
#: Tasks over which the children of one parent are dealt.
SALTS = 32

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; the length of the role keeps role and text apart."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def ordered(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, t, n, part)``: turns dealt into ``part`` by ranges of (conversation, turn).

    ``t`` is the digest of role and text, ``n`` the text's code points. Written, since
    ``part`` must stay what it is.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    keyed = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", turn_digest(role, text).alias("t"), F.char_length(text).cast("long").alias("n"))
    dealt = keyed.withColumn("i", F.monotonically_increasing_id()).repartitionByRange("conv_id", "turn", "t", "i").drop("i")
    return common.stage(dealt.withColumn("part", F.spark_partition_id()), "trie-turns")


def rebuilt(conversations: DataFrame, every: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations ``(conv_id)`` and their turns ``(conv_id, d, t, n)``, d from 1.

    Conversation c has the first h turns of conversation ``c - c % every``, then its own
    turns after its first h; ``h = crc32(decimal c) % heads``. Turns are ordered by
    ``turn``, null first; turns that tie by their digest. Null role or text is empty.
    Rows without conv_id belong to no conversation. Repeated rows are turns each.
    """
    rows = ordered(conversations)
    counts = common.stage(rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("c")), "trie-parts")
    size = counts.groupBy("conv_id").agg(F.sum("c").alias("len"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = size.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("base"), head.alias("h"))
    base = size.select(F.col("conv_id").alias("base"), F.col("len").alias("base_len"))
    convs = common.stage(convs.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_len", F.lit(0)))).drop("base_len"), "trie-convs")
    before = F.coalesce(F.sum("c").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("before", before).join(convs, "conv_id").select("conv_id", "part", "before", "h", "taken")
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "t"))
    placed = rows.withColumn("r", place).join(starts, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("r")).alias("d"), "t", "n", "h", "taken")
    placed = common.stage(placed, "trie-placed")
    own = placed.where("d > h").select("conv_id", (F.col("d") - F.col("h") + F.col("taken")).alias("d"), "t", "n")
    first = placed.where(F.col("d") < heads).select(F.col("conv_id").alias("base"), "d", "t", "n")
    lent = first.join(convs.select("conv_id", "base", "h"), "base").where("d <= h").select("conv_id", "d", "t", "n")
    return convs.select("conv_id"), own.union(lent)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one path in ordered ``(p1, p2, len, conv_id)`` as ``(p1, p2, len, first, ids)``."""
    for batch in batches:
        out = []
        for key, run in groupby(zip(*(c.to_pylist() for c in batch.columns)), key=lambda x: x[:3]):
            ids = [x[3] for x in run]
            for at in range(0, len(ids), PIECE):
                out.append((*key, ids[at], ",".join(map(str, ids[at:at + PIECE]))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), [pa.int64()] * 4 + [pa.string()])], ["p1", "p2", "len", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each path's joined ids, from pieces in order; only the open digest is held."""
    last, digest = None, None

    def closed(done: list) -> pa.RecordBatch:
        keys, ends = [x[0] for x in done], [x[1] for x in done]
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int64()) for i in range(3)] + [pa.array(ends)], ["p1", "p2", "len", "ends"])

    for batch in batches:
        done = []
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "len", "ids"))):
            if key != last:
                if last is not None:
                    done.append((last, digest.hexdigest()))
                last, digest = key, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if done:
            yield closed(done)
    if last is not None:
        yield closed([(last, digest.hexdigest())])


def ends(whole: DataFrame) -> DataFrame:
    """``(p1, p2, len, ends)`` of ``whole(conv_id, p1, p2, len)``.

    Of many equal conversations each range of ids is joined in a task of its own; the
    digest, which must be taken in order, then streams over the pieces.
    """
    key = ["p1", "p2", "len"]
    pieces = whole.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(_pieces, "p1 long, p2 long, len long, first long, ids string")
    return pieces.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(_digests, "p1 long, p2 long, len long, ends string")


def _hashed(turns: DataFrame, what: str) -> DataFrame:
    """``(conv_id, d, k1, k2, n, after, folder)``, written in folders of depths 1, 2 to 3, 4 to 7 and so on, of which a level reads one.

    ``after`` sums n from d on. A conversation goes in blocks of turns, sums of blocks first.
    """
    spark = turns.sparkSession
    rows = turns.withColumn("block", F.floor((F.col("d") - 1) / BLOCK))
    after = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("conv_id", "block").agg(F.sum("n").alias("s")).withColumn("later", F.coalesce(F.sum("s").over(after), F.lit(0))).drop("s")
    within = Window.partitionBy("conv_id", "block").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("s", F.sum("n").over(within)).join(sums, ["conv_id", "block"])
    rows = rows.select("conv_id", "d", F.xxhash64(F.lit(1), "d", "t").alias("k1"), F.xxhash64(F.lit(2), "d", "t").alias("k2"), "n", (F.col("s") + F.col("later")).alias("after"))
    path = common.new_path(spark, what)
    with common.setting(spark, common.CLEANUP, "true"):
        rows.withColumn("folder", F.floor(F.log2(F.col("d").cast("double")) + 1e-9).cast("int")).write.partitionBy("folder").parquet(path)
    return spark.read.schema("conv_id long, d long, k1 long, k2 long, n long, after long, folder int").parquet(path)


def trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations ``ids(conv_id)`` with ``turns(conv_id, d, t, n)``.

    Conversation ids are longs without repeats; d counts from 1 without gaps, ``t`` tells
    turns apart, ``n`` is what repeating a turn costs. Conversations without turns end at
    the root. One row per node, columns ``NODE``: its smallest member, depth, the smallest
    member of its parent (null at the root), members, children, childless nodes at or below
    it, ``(members - 1) * n`` summed over the same, and the SHA-256 of the ids that end
    there, in order, joined by commas. No conversations, no nodes.
    """
    turns = _hashed(turns, "trie-levels")
    paths = turns.groupBy("conv_id").agg(F.bit_xor("k1").alias("p1"), F.bit_xor("k2").alias("p2"), F.count(F.lit(1)).alias("len"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    whole = ids.join(paths, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in ("p1", "p2", "len")])
    whole = common.stage(whole, "trie-paths")
    key = ["p1", "p2", "len"]
    kinds = whole.groupBy(*key).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("m"))
    kinds = common.stage(kinds.join(ends(whole), key), "trie-kinds")
    common.unstage(whole)
    top = kinds.agg(F.min("rep"), F.sum("m"), F.max("len")).first()
    if top[0] is None:
        return ids.sparkSession.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in NODE))

    # down: a level's nodes, c the different conversations in them
    root = "p1 long, p2 long, q1 long, q2 long, conv_id long, n_convs long, c long, n long, len long, after long"
    levels = [ids.sparkSession.createDataFrame([(0, 0, None, None, int(top[0]), int(top[1]), 2, 0, int(top[2]), 0)], root)]
    live = kinds.where("len > 0").select("rep", "m", "len", zero.alias("p1"), zero.alias("p2"))
    for depth in range(1, int(top[2]) + 1):
        here = turns.where((F.col("folder") == depth.bit_length() - 1) & (F.col("d") == depth)).select(F.col("conv_id").alias("rep"), "k1", "k2", "n", "after")
        step = live.join(here, "rep").select("rep", "m", "len", F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("p1").bitwiseXOR(F.col("k1")).alias("p1"), F.col("p2").bitwiseXOR(F.col("k2")).alias("p2"), "n", "after")
        step = common.stage(step, "trie-step")
        level = step.groupBy("p1", "p2", "q1", "q2").agg(F.min("rep").alias("conv_id"), F.sum("m").alias("n_convs"), F.count(F.lit(1)).alias("c"), F.max("n").alias("n"), F.max("len").alias("len"), F.max("after").alias("after"))
        levels.append(common.stage(level, "trie-nodes"))
        if not levels[-1].where("c > 1").limit(1).count():
            break
        alone = levels[-1].where("c = 1").select(F.col("conv_id").alias("rep"))
        live = step.join(alone, "rep", "left_anti").where(F.col("len") > depth).select("rep", "m", "len", "p1", "p2")

    # up: what lies below a node that several share; one that is alone knows it
    under, nodes, alone = None, [], None
    for depth in range(len(levels) - 1, -1, -1):
        level, single = levels[depth], F.col("c") == 1
        if under is None:
            summed = level.withColumns({"kids": zero, "leaves": one, "lower": zero})
        else:
            sums = under.groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("lower"))
            summed = level.join(sums.select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), "kids", "leaves", "lower"), ["p1", "p2"], "left")
        summed = summed.join(kinds.where(F.col("len") == depth).select("p1", "p2", "ends"), ["p1", "p2"], "left")
        if depth:
            above = levels[depth - 1].where("c > 1").select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
            above = above.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            summed = summed.withColumn("salt", F.pmod(F.xxhash64("p1"), F.lit(SALTS)).cast("int")).join(above, ["q1", "q2", "salt"])
        else:
            summed = summed.withColumn("parent_conv_id", F.lit(None).cast("long"))
        kids = F.when(single, (F.col("len") > depth).cast("long")).otherwise(F.coalesce("kids", zero))
        saved = (F.col("n_convs") - 1) * F.when(single, F.col("after")).otherwise(F.col("n")) + F.when(single, 0).otherwise(F.coalesce("lower", zero))
        done = summed.select("conv_id", F.lit(depth).cast("long").alias("depth"), "parent_conv_id", "n_convs", kids.alias("n_children"), F.when(single, one).otherwise(F.coalesce("leaves", one)).alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"), "q1", "q2")
        under = common.stage(done, "trie-level")
        nodes.append(under.select(*NODE))
        if depth:
            found = level.where("c = 1").where(F.col("len") > depth).select(F.col("conv_id").alias("rep"), F.lit(depth).cast("long").alias("d0"))
            alone = found if alone is None else alone.union(found)
    if alone is not None:  # chains of those that are alone, dealt in blocks of turns
        block = lambda d: F.floor((F.col(d) - 1) / BLOCK)
        spans = alone.join(kinds.select("rep", "m", "len", "ends"), "rep").withColumn("block", F.explode(F.sequence(block("d0"), block("len"))))
        rows = turns.select(F.col("conv_id").alias("rep"), "d", "after", block("d").alias("block")).join(spans, ["rep", "block"]).where("d > d0")
        last = F.col("d") == F.col("len")
        nodes.append(common.stage(rows.select(
            F.col("rep").alias("conv_id"), F.col("d").alias("depth"), F.col("rep").alias("parent_conv_id"), F.col("m").alias("n_convs"), F.when(last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"),
            ((F.col("m") - 1) * F.col("after")).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256")), "trie-tails"))
    out = nodes[0]
    for more in nodes[1:]:
        out = out.union(more)
    return out


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """:func:`trie` of the :func:`rebuilt` ``conversations(conv_id, turn, role, text)``; other columns are not read."""
    return trie(*rebuilt(conversations.select("conv_id", "turn", "role", "text")))
