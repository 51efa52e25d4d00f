"""Sentence index, value scan, keyword search and the place of a sentence in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import text as X

PER_TYPE, MIN_SCORE, BEST = 40, 0.30, 2


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, pos, sentence`` of each text."""
    return docs.select(key, F.posexplode(X.sentences(F.col(text))).alias("pos", "sentence"))


def index_with_offsets(sections: DataFrame, keys: tuple[str, ...] = ("doc_id", "section"), text: str = "text") -> DataFrame:
    """``*keys, pos, sentence, start, end`` of sections; ``pos`` counts the sentences that stand in the section verbatim.

    A repeated sentence gets its next place: places are searched onward from the
    sentence before, in one fold over a section's sentences.
    """
    return sections.select(*keys, F.posexplode(X.with_places(F.col(text), X.sentences(F.col(text)))).alias("pos", "x")).select(*keys, "pos", "x.*")


def index_stats(index: DataFrame, section: str = "section") -> DataFrame:
    """``sentences, sections`` of an index."""
    return index.agg(F.count(F.lit(1)).alias("sentences"), F.countDistinct(F.coalesce(section, F.lit(""))).alias("sections"))


def term_spans(text, query: str):
    """Array of ``(start, end)``, merged: where a query's words stand in a text, whatever the case."""
    low = F.lower(text)

    def of(word: str):
        parts, size = F.split(low, r"\Q" + word + r"\E"), len(word)
        before = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.length(x))
        at = F.aggregate(before, F.array().cast("array<int>"), lambda acc, n: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)) + size, F.lit(0)) + n))
        return F.transform(at, lambda i: F.struct(i.alias("start"), (i + size).cast("int").alias("end")))

    return merge_spans(F.concat(F.array().cast("array<struct<start:int,end:int>>"), *map(of, dict.fromkeys(query.lower().split()))))


def value_spans(text):
    """Array of ``(start, end)``, merged: where values of the six kinds stand in a text."""
    out = F.array().cast("array<struct<start:int,end:int>>")
    for k, p in X.VALUE_PATTERNS.items():
        found = F.regexp_extract_all(text, F.lit(X.ascii_bounds(p)), F.lit(0))
        placed = X.with_places(text, found)
        if k == "百分比":
            placed = F.filter(placed, lambda x: x["sentence"].endswith("%"))
        out = F.concat(out, F.transform(placed, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    return merge_spans(out)


def highlight_query(text, query: str, css: str = "loc-kw"):
    """A sentence as HTML with the query's words marked."""
    return X.tagged(text, term_spans(text, query), css)


def highlight_values(text, css: str = "loc-val"):
    """A sentence as HTML with its values marked."""
    return X.tagged(text, value_spans(text), css)


def values(docs: DataFrame, key: str = "doc_id", text: str = "text", per_type: int = PER_TYPE) -> DataFrame:
    """``key, kind, value, pos``: values of six kinds, each once a text at its first place, at most ``per_type`` of a kind."""
    hits = index(docs, key, text).select(key, "pos", F.explode(X.values(F.col("sentence"))).alias("v")).select(key, "pos", "v.*")
    first = Window.partitionBy(key, "kind", "norm").orderBy("pos", "ord")
    one = hits.withColumn("norm", X.norm_value(F.col("value"))).withColumn("n", F.row_number().over(first)).where("n = 1")
    cap = Window.partitionBy(key, "kind").orderBy("pos", "ord")
    return one.withColumn("n", F.row_number().over(cap)).where(F.col("n") <= per_type).select(key, "kind", "value", "pos")


def search(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", limit: int = 80) -> DataFrame:
    """``key, pos, count`` of sentences that have all words of the query, whatever the case; the first ``limit`` of a text."""
    words = list(dict.fromkeys(query.lower().split()))
    rows = index(docs, key, text).withColumn("low", F.lower("sentence"))
    for w in words:
        rows = rows.where(F.contains("low", F.lit(w)))
    found = [(F.length("low") - F.length(F.replace(F.col("low"), F.lit(w), F.lit("")))) / len(w) for w in words]
    rows = rows.withColumn("count", sum(found[1:], found[0]).cast("int"))
    by = Window.partitionBy(key).orderBy("pos")
    return rows.withColumn("n", F.row_number().over(by)).where(F.col("n") <= limit).select(key, "pos", "count")


#: Letters of the grams by which a query and a sentence that holds it meet, and the query's least length.
GRAM, LONG = 8, 40
#: Characters with which a gram that is a key begins: rare enough letters, digits, all ideographs.
KEYED = "bgkpvwxyz0-9一-鿿"
#: Rows up to which queries are sent to all tasks.
BROADCAST_ROWS = 50_000
#: Hashes of keys, with their queries' ids or without, up to which they are sent to all tasks; above, keys of sentences are shuffled to them.
KEY_ROWS = 2_000_000


def _sent(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint where a count shows that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _having(dealt: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows whose key is one of those wanted, by hashes sent to all tasks where a count shows that they are few."""
    if "h" in dealt.columns:
        return dealt.join(_sent(wanted.select("h").distinct(), KEY_ROWS), "h", "left_semi")
    hashed = F.xxhash64("kind", "f")
    return _having(dealt.withColumn("h", hashed), wanted.select(hashed.alias("h"))).drop("h")


def _grams(c, n: int):
    """All runs of ``n`` characters: the places at which one can be read ahead."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _keys(c):
    """Content-defined grams of a text: the same wherever they stand."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=([{KEYED}].{{{GRAM - 1}}}))"), F.lit(1)))


def _marked_grams(c):
    """Grams of a text in any script whose hash chooses them: one in eight, the same wherever they stand."""
    return F.filter(_grams(c, GRAM), lambda g: F.pmod(F.xxhash64(g), F.lit(8)) == 0)


def locate(queries: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", best: int = BEST) -> DataFrame:
    """``query_id, key, pos, score``: where the sentences ``(query_id, sentence)`` stand in texts, over all texts.

    Equal after normalising scores 1, containing 0.95. Then numbers (3) and Latin
    words (2) that both have, over all of the query's; sentences with more than
    three numbers of which less than half agree count three quarters.

    No pairs are compared but those that share a key; sentences stay in their tasks, or, where
    the keys are too many to be sent there, only keys and ids meet and pairs fetch both sides once. A
    sentence gives as keys itself, its first letters, its content-defined grams and
    its features; a query gives itself, all grams that a sentence inside it may begin
    with, one of its content-defined grams, and its features but the most common
    ones. It may leave those out as long as they weigh less than the least score
    together: a sentence that reaches the score has one of the others. Long queries
    without a content-defined gram, as in other scripts, give their first gram that a hash
    chooses, and sentences all such; the few without one are found by their first letters.
    """
    q = queries.select("query_id", F.col("sentence").alias("q")).withColumns({"qn": X.norm_text(F.col("q")), "qnum": X.numbers(F.col("q")), "qterm": X.latin_terms(F.col("q"))}).where("qn <> ''").drop("q")
    s = index(docs, key, text).select(key, "pos", X.norm_text(F.col("sentence")).alias("sn"), X.numbers(F.col("sentence")).alias("snum"), X.latin_terms(F.col("sentence")).alias("sterm"))

    def named(kind: str, c):
        return F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("f")))

    none = F.array().cast("array<string>")
    starts = F.flatten(F.array(*[_grams(F.col("qn"), n) for n in range(1, GRAM + 1)]))
    one = q.withColumn("keys", F.when(F.length("qn") > LONG, F.slice(_keys(F.col("qn")), 1, 1)).otherwise(none))
    fixed = one.select("query_id", F.explode(F.concat(named("whole", F.array("qn")), named("start", starts), named("gram", F.col("keys")))).alias("x")).select("query_id", "x.kind", "x.f")
    qf = q.select("query_id", F.explode(F.concat(named("number", F.col("qnum")), named("term", F.col("qterm")))).alias("x")).select("query_id", "x.kind", "x.f")
    qf = qf.withColumn("w", F.when(F.col("kind") == "number", 3).otherwise(2))
    df = qf.groupBy("kind", "f").agg(F.count(F.lit(1)).alias("df"))
    whole = Window.partitionBy("query_id")
    sum_out = F.sum("w").over(whole.orderBy(F.desc("df"), F.length("f"), "kind", "f").rowsBetween(Window.unboundedPreceding, 0))
    rare = qf.join(df, ["kind", "f"]).withColumn("out", sum_out).withColumn("all", F.sum("w").over(whole)).where(F.col("out") > MIN_SCORE * F.col("all") - 1e-9)
    hashed = F.xxhash64("kind", "f")
    # hashes that are equal by chance only make a pair more to be judged
    wanted = fixed.unionByName(rare.select("query_id", "kind", "f")).select(hashed.alias("h"), "query_id").distinct()
    few = wanted.limit(KEY_ROWS + 1).count() <= KEY_ROWS
    grams = F.when(F.length("sn") > LONG, _keys(F.col("sn"))).otherwise(none)
    full = F.col("sn") != ""
    first = F.when(full, F.array("sn")).otherwise(none), F.when(full, F.array(F.substring("sn", 1, GRAM))).otherwise(none)
    keys = F.concat(named("whole", first[0]), named("start", first[1]), named("gram", grams), named("number", F.col("snum")), named("term", F.col("sterm")))
    h = F.transform(keys, lambda x: F.xxhash64(x["kind"], x["f"]))
    if few:  # sentences meet queries where they are
        met = s.withColumn("h", F.explode(h)).join(F.broadcast(wanted), "h").drop("h").join(_sent(q), "query_id")
    else:  # keys and ids alone are shuffled, and each side is fetched once for a pair
        dealt = _having(s.select(key, "pos", F.explode(h).alias("h")), wanted)
        pairs = dealt.join(wanted, "h").select("query_id", F.col(key).alias("_k"), F.col("pos").alias("_p")).distinct()
        met = s.join(pairs, (F.col("pos") == F.col("_p")) & F.col(key).eqNullSafe(F.col("_k"))).drop("_k", "_p").join(_sent(q), "query_id")
    lone = one.where((F.length("qn") > LONG) & (F.size("keys") == 0)).drop("keys")
    if lone.limit(1).count():
        long = s.where(F.length("sn") > LONG)
        lone = lone.withColumn("mark", F.get(_marked_grams(F.col("qn")), F.lit(0)))
        met = met.unionByName(long.withColumn("mark", F.explode(_marked_grams(F.col("sn")))).join(_sent(lone.where("mark is not null")), "mark").drop("mark"))
        bare = lone.where("mark is null").withColumn("mark", F.substring("qn", 1, GRAM))
        if bare.limit(1).count():
            met = met.unionByName(long.withColumn("mark", F.explode(_grams(F.col("sn"), GRAM))).join(_sent(bare), "mark").drop("mark"))

    same, nums = F.size(F.array_intersect("snum", "qnum")), F.size("snum")
    of = F.size("qnum") * 3 + F.size("qterm") * 2
    raw = F.coalesce(F.try_divide(same * 3 + F.size(F.array_intersect("sterm", "qterm")) * 2, of), F.lit(0.0)) * F.when((nums > 3) & (same < nums * 0.5), 0.75).otherwise(1.0)
    inside = full & (F.contains("qn", F.col("sn")) | ((F.length("qn") > LONG) & F.contains("sn", F.col("qn"))))
    tier = F.when(F.col("sn") == F.col("qn"), 1).when(inside, 2).otherwise(3)
    place = ["query_id", key, "pos"]
    hits = met.select(*place, tier.alias("tier"), raw.alias("raw")).where((F.col("tier") < 3) | (F.col("raw") >= MIN_SCORE))
    score = F.when(F.col("tier") == 1, 1.0).when(F.col("tier") == 2, 0.95).otherwise(F.col("raw"))
    hits = hits.groupBy(*place).agg(F.first("tier").alias("tier"), F.first(score).alias("raw"))
    per = Window.partitionBy("query_id").orderBy("tier", F.desc("raw"), key, "pos")
    top = hits.withColumn("n", F.row_number().over(per)).where(F.col("n") <= best)
    return top.withColumn("t", F.min("tier").over(whole)).where("tier = t").select(*place, F.bround("raw", 2).alias("score"))


def merge_spans(spans):
    """Array of ``(start, end)``: sorted, those that overlap or touch made one."""
    def step(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return (F.when(F.size(acc) == 0, F.array(s)).when(s["start"] <= last["end"], F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wider)))
                .otherwise(F.array_append(acc, s)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:int,end:int>>"), step)
