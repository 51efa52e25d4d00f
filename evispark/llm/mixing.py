"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source's target over its size is the number of copies that its documents are
to have in the mean. Whole copies are certain. For the fraction, documents are
ranked by random odds over inclusion odds (Rosen, 1997), and taken in that order
until the source's words are nearest to its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.llm import common

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
BINS, BLOCKS = 65536, 256


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """A number in (0, 1) that depends on ``key`` alone, so reruns agree."""
    text = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8)
    return (F.conv(text, 16, 10).cast("double") + 0.5) / 4294967296.0


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``sources(source, source_size)`` with ``target`` double.

    Weights repeat over the sources in code point order, null last. A target is
    ``min(most * source_size, level * weight)`` with the level at which targets
    add up to all sizes; resharing what is above the limits ends there too. The
    windows are over one row for each source.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(every) - 1) % len(weights)
    w = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), rank + 1).cast("double"))
    w = w.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("w"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    under, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    w = w.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(under), F.lit(0.0))) / F.sum("w").over(rest))
    free = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", F.col("level").alias("at")))).over(whole)
    w = w.withColumn("at", free["at"])
    return w.select("source", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("w"))).alias("target"))


def _taken(docs: DataFrame, weights: tuple[int, ...], most: int, importance: str | None, whole_rows: bool) -> DataFrame:
    """The columns of :func:`mix` and, with ``whole_rows``, each row of ``docs`` as a struct ``row``.

    The row travels along as it is, so its columns may have any names. Its words and
    ties are read from it once; of a hot source no task gets all documents: sums by
    (source, bin of the rank) are combined before they are shuffled, and only the
    documents of the one bin in which the target is met are sorted.
    """
    cols = [F.col("doc_id"), F.col("source"), words(F.col("text")).alias("size")]
    weight = F.coalesce(F.col(importance).cast("double"), F.lit(0.0)) if importance else F.lit(1.0)
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole_rows else []
    sized = common.stage(docs.select(*cols, weight.alias("weight"), F.xxhash64(F.col("text")).alias("tie"), *row), "mix-sizes")
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("weight")).alias("mass"))
    per = common.stage(per, "mix-sources")
    goal = targets(per.select("source", "source_size"), weights, most)
    plan = common.stage(per.alias("p").join(goal.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source"))).select(
        F.col("p.source").alias("s"), F.col("p.source_size"), "mass", "target"), "mix-targets")
    plan = common.small(plan)

    expected = F.when(F.col("mass") > 0, F.least(F.col("target") * F.col("weight") / F.col("mass"), F.lit(float(most)))).otherwise(F.lit(0.0))
    ranked = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("e", expected)
    ranked = ranked.withColumn("whole", F.floor("e").cast("long")).withColumn("p", F.col("e") - F.floor("e"))
    u = uniform(F.col("doc_id"))
    odds = F.when(F.col("p") > 0, (u / (1.0 - u)) / (F.col("p") / (1.0 - F.col("p"))))
    ranked = ranked.withColumn("q", odds).withColumn("bin", F.floor(F.col("q") / (1.0 + F.col("q")) * BINS).cast("int"))

    # the target is met in one bin of all; first the block of bins, then the bin, so that no window has more than BLOCKS rows of a source
    sums = common.stage(ranked.groupBy("source", "bin").agg(
        F.sum("size").alias("n"), F.sum(F.col("size") * F.col("whole")).alias("sure"), F.first("target").alias("target")), "mix-bins")
    blocked = sums.withColumn("block", F.floor(F.col("bin") / BLOCKS).cast("int"))
    by_block = blocked.groupBy("source", "block").agg(F.sum("n").alias("n"), F.sum("sure").alias("sure"), F.first("target").alias("target"))
    found = _met(by_block.withColumn("need", F.col("target") - F.sum("sure").over(Window.partitionBy("source"))).withColumn("from", F.lit(0)), "block")
    found = common.small(common.stage(found, "mix-blocks"))
    inner = blocked.join(found, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("cut"))).select("source", "bin", "n", "need", F.col("before").alias("from"))
    met = common.small(common.stage(_met(inner, "bin"), "mix-cuts"))

    cut = ranked.join(met, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    sure = F.col("q").isNotNull() & (F.col("cut").isNull() | (F.col("bin") < F.col("cut")))
    edge = F.coalesce(F.col("bin") == F.col("cut"), F.lit(False))
    inside = Window.partitionBy("source").orderBy("q", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    near = F.col("before") + F.sum("size").over(inside) - F.col("size") / 2.0 <= F.col("need")
    rest = cut.where(~edge).withColumn("extra", sure.cast("long"))
    last = cut.where(edge).withColumn("extra", near.cast("long"))
    copies = F.when(F.col("size") > 0, F.least(F.col("whole") + F.col("extra"), F.lit(most))).otherwise(F.lit(0)).cast("long")
    return rest.unionByName(last).withColumn("copies", copies)


def _met(sums: DataFrame, by: str) -> DataFrame:
    """``s, cut, need, before``: where a source's running words, ``from`` on, pass what it needs, and the words before that."""
    along = Window.partitionBy("source").orderBy(F.col(by).asc_nulls_last())
    over = sums.withColumn("upto", F.col("from") + F.sum("n").over(along)).where(F.col(by).isNotNull() & (F.col("upto") > F.col("need")))
    first = over.groupBy("source").agg(F.min(F.struct(by, "need", (F.col("upto") - F.col("n")).alias("before"))).alias("m"))
    return first.select(F.col("source").alias("s"), F.col(f"m.{by}").alias("cut"), "m.need", "m.before")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, importance: str | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` for each row of ``docs``.

    ``importance`` names a non-negative column by which a source's documents
    share its copies; without it all have the same expectation. Null texts have
    size 0 and, like empty ones, take no words; a null source is a source; rows
    that repeat are ranked one by one; an empty table gives no rows; other columns
    are ignored, whatever their names.
    """
    out = _taken(docs, weights, most, importance, False)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, importance: str | None = None) -> DataFrame:
    """``docs`` as the mix has them: each row as often as :func:`mix` takes it, with its own columns.

    Rows that repeat are counted one by one, so words taken are those of :func:`mix`.
    """
    got = _taken(docs, weights, most, importance, True).where("copies > 0").select("row", "copies")
    return got.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
