"""Operators that go in rounds, by keys or by blocks, against plain loops, and their plans."""

import random
import re

from pyspark.sql import functions as F

from evispark.functions import lexicon, text
from evispark.operators import bias, compare, locate, numbering, vocab


def fold(rows):
    """Kept articles by one pass in order."""
    pmids, titles, out = set(), set(), {}
    for o, p, t, *_ in sorted(rows, key=lambda r: r[0]):
        p, t = (p or "").strip(), (t or "").strip()
        bad = (p and p in pmids) or (t and t in titles)
        out[o] = not bad
        if not bad:
            pmids.add(p)
            titles.add(t)
    return out


def test_kept_equals_the_fold(spark):
    r = random.Random(1)
    chain = [(i, f"p{(i + 1) // 2}", f"t{i // 2}x") for i in range(40)]
    mixed = [(100 + i, r.choice(["", None, *[f"a{k}" for k in range(30)]]), r.choice(["", None, *[f"b{k}" for k in range(30)]])) for i in range(300)]
    hot = [(1000 + i, f"h{i % 90}", "same") for i in range(200)] + [(2000 + i, "", "") for i in range(5)]
    rows = chain + mixed + hot
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "ord int, pmid string, title string").repartition(5)
    want = fold(rows)
    got = {x.ord: x.kept for x in compare.kept(df).collect()}
    assert got == want and sum(not v for v in want.values()) > 100
    assert compare.duplicates(df).first()[0] == sum(not v for v in want.values())
    assert compare.duplicates(df.limit(0)).first()[0] == 0


def test_kept_by_review(spark):
    rows = [(i, f"p{i % 4}", "", f"r{i % 2}") for i in range(20)]
    df = spark.createDataFrame(rows, "ord int, pmid string, title string, review string")
    assert {(x.review, x.n) for x in compare.duplicates(df, review="review").collect()} == {("r0", 8), ("r1", 8)}


def plan(df):
    return df._jdf.queryExecution().toString()


def test_numbering_without_one_task(spark):
    df = spark.range(0, 300_000, 3).withColumn("k", F.col("id") - 1000).unionByName(spark.sql("select 1L as id, cast(null as bigint) as k"))
    got = numbering.numbered(df, "k", "n", 1000)
    assert got.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()[:] == (1, 100_001, 100_001)
    assert got.where("k is null").first().n == 1 and got.where("n <> 1 and n <> (k + 1000) / 3 + 2").count() == 0
    assert got._jdf.queryExecution().executedPlan().toString().count("SinglePartition") == 1  # over blocks' counts


def contains(term, doc):
    term, at = term.lower(), -1
    while (at := doc.find(term, at + 1)) >= 0:
        after = doc[at + len(term):at + len(term) + 1]
        if not (term[-1].isalpha() and after.isalpha()):
            return True
    return False


def test_terms_equal_a_search(spark):
    r = random.Random(3)
    parts = ["heart", "art", "performance", "status", "statu", "a", "10%", "il-6", "心力", "衰竭", "心力衰竭", "(", "é", "x2", "in", "inin", "p\\E"]
    docs = [(str(i), " ".join(r.choice(parts) + r.choice(["", "", "s", ".", "-"]) for _ in range(r.randint(0, 7))) + r.choice(["", "\n"]), r.choice([None, "In the end", "心力衰竭的"])) for i in range(300)]
    terms = [*parts, "performance statu", "performance status", "Heart Art", "status.", "art heart", " ", "", "10", "%", "6 a", "art-", "(", "zzz"]
    p = spark.createDataFrame(docs, "row_key string, title string, conclusion string").repartition(3)
    got = {(x.term, x.row_key) for x in compare.term_documents(p, spark.createDataFrame([(x,) for x in terms], "term string")).select("term", "row_key").collect()}
    want = {(t, k) for t in terms if t.strip() for k, a, b in docs if contains(t, f"{a or ''} {b or ''}".lower())}
    assert got == want


def test_many_terms_need_no_nested_loop(spark):
    p = spark.createDataFrame([("1", "alpha beta w77 gamma", None)], "row_key string, title string, conclusion string")
    terms = spark.range(100_000).select(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" gamma")).alias("term"))
    df = compare.term_documents(p, terms)
    assert [x.term for x in df.select("term").collect()] == ["w77 gamma"]
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_nearest_equals_all_pairs(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abé") for _ in range(n))
    names = sorted({word(n) for n in [*range(1, 30), *range(14, 22), 40, 41, 60] for _ in range(6)})

    def changed(w, k):
        for _ in range(k):
            i = r.randrange(len(w) + 1)
            w = r.choice([w[:i] + r.choice("abé") + w[i:], w[:i] + w[i + 1:], w[:i] + r.choice("abé") + w[i + 1:]])
        return w

    terms = sorted({changed(w, k) for w in names for k in (0, 1, 2, 3)})
    weight = {n: len(n) % 3 for n in names}
    got = {x.term: (x.name, x.edits) for x in vocab.nearest(spark.createDataFrame([(t,) for t in [*terms, None]], "term string"), spark.createDataFrame([*weight.items(), (None, 1), ("", 9)], "name string, weight int")).collect()}
    want = {}
    for t in terms:
        near = [(d, -weight[n], n) for n in names if t and abs(len(n) - len(t)) <= 2 and (d := edits(t, n)) <= 2]
        if near:
            d, _, n = min(near)
            want[t] = (n, d)
    assert got == want and len(got) > 300


def test_suggestions_and_journals(spark):
    names = spark.createDataFrame([("aspirin", 9), ("heart", 5)], "name string, weight int")
    got = {tuple(x) for x in vocab.suggest(spark.createDataFrame([("Asprin",), ("ASPIRIN",), ("hart",), ("nothing",), (None,)], "term string"), names).collect()}
    assert got == {("Asprin", "aspirin"), ("hart", "heart")}
    catalogue = spark.createDataFrame([("The Journal of Immunology.", "J Immunol", 1), ("Spine", "Spine", 2), ("Spine & Back", None, 3)], "title string, abbreviation string, ord int")
    got = {tuple(x) for x in vocab.resolve_nearest(spark.createDataFrame([("Journal of Imunology",), ("spine",), ("Unknown", )], "name string"), catalogue).collect()}
    assert got == {("Journal of Imunology", "J Immunol"), ("spine", "Spine"), ("Unknown", "Unknown")}


def test_keywords_go_on_until_there_are_enough(spark):
    """Over twenty times as many heavy phrases as asked for share a word; lighter words are reached."""
    from evispark.operators import keywords

    rows = [(1, " ".join(f"common{chr(97 + i // 26)}{chr(97 + i % 26)} heart ." for i in range(400) for _ in range(2))), (2, "liver stands here"), (3, " "), (4, None), (5, "12 34")]
    got = keywords.keywords(spark.createDataFrame(rows, "unit int, text string"), 5).orderBy("rank").collect()
    assert len(got) == 5 and len({r.term for r in got}) == 5
    w = {r.term: r for r in keywords.token_weights(spark.createDataFrame(rows, "unit int, text string")).collect()}
    import math
    assert abs(w["liver"].weight - (0.35 + math.log(1 + 2 / 2))) < 1e-9  # two units have tokens


def test_sentences_of_other_scripts_are_located_by_keys(spark):
    from evispark.operators import locate

    r = random.Random(8)
    word = lambda: "".join(r.choice("абвгдежзиклмнопрст") for _ in range(r.randint(3, 9)))
    sentences = [" ".join(word() for _ in range(14)) + "." for _ in range(60)]
    docs = [(i, " ".join(s.capitalize() for s in sentences[i * 3:i * 3 + 3])) for i in range(20)]
    part = sentences[10].rstrip(".").split(" ", 2)[2]  # stands inside a longer sentence
    q = spark.createDataFrame([(1, sentences[7].capitalize()), (2, part), (3, " ".join(word() for _ in range(12)))], "query_id int, sentence string")
    got = locate.locate(q, spark.createDataFrame(docs, "doc_id int, text string"))
    assert {(x.query_id, x.doc_id, x.score) for x in got.collect()} == {(1, 2, 1.0), (2, 3, 0.95)}
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_concepts_cover_words_as_a_plain_loop_does(spark):
    r = random.Random(12)
    vocab_words = ["aspirin", "heart", "attack", "liver", "failure", "chronic", "renal", "drug"]
    known = {" ".join(r.choice(vocab_words) for _ in range(r.randint(1, 3))): f"H{i}" for i in range(30)}
    rows = [(i, " ".join(r.choice(vocab_words) for _ in range(r.randint(1, 6)))) for i in range(60)]

    def cover(words):
        taken, looked = [], 0
        for n in range(len(words), 0, -1):
            for i in range(len(words) - n + 1):
                if looked < vocab.LOOKUPS and not any(a < i + n and i < a + m for a, m, *_ in taken):
                    looked += 1
                    text = " ".join(words[i:i + n])
                    if text in known:
                        taken.append((i, n, text, known[text]))
        free = [(i, 1, w, None) for i, w in enumerate(words) if not any(a <= i < a + m for a, m, *_ in taken)]
        return [(t, h) for _, _, t, h in sorted(taken + free)]

    k = spark.createDataFrame(rows, "id int, keyword string")
    got = {}
    for x in vocab.split_concepts(k, spark.createDataFrame(list(known.items()), "term string, heading string")).orderBy("id", "ord").collect():
        got.setdefault(x.id, []).append((x.text, x.heading))
    want = {}
    for i, words in k.select("id", vocab.query_words(F.col("keyword"))).collect():
        want[i] = cover(list(words))
    assert got == {i: w for i, w in want.items() if w} and any(h for w in want.values() for _, h in w)


def test_keywords_choice_as_a_plain_loop_does(spark):
    from evispark.operators import keywords

    r = random.Random(6)
    words = ["heart", "liver", "renal", "aspirin", "statin", "kidney", "bleeding", "stroke"]
    rows = [(i, " ".join(r.choice(words) for _ in range(12))) for i in range(40)]
    df = spark.createDataFrame(rows, "unit int, text string")
    every = keywords.token_weights(df).unionByName(keywords.phrase_weights(df)).collect()
    picked, cover = [], []
    for x in sorted(every, key=lambda x: (-x.weight, x.term)):
        parts = x.term.split(" ")
        if len(picked) >= 6:
            break
        if len(parts) > 1:
            if not any(w in parts for w, _ in cover):
                picked = [p for p in picked if not (p.term in parts and p.tf <= x.tf * 1.2)] + [x]
                cover += [(w, x.tf) for w in parts]
        elif not any(w == x.term and x.tf <= n * 1.2 for w, n in cover):
            picked.append(x)
    assert [x.term for x in keywords.keywords(df, 6).orderBy("rank").collect()] == [x.term for x in picked]


def test_bias_overview_reads_profiles_once(spark):
    rows = [(["a", "b"], 1), (["a"], 0), ([], 0)]
    p = spark.createDataFrame(rows, "names array<string>, focus int").select(F.transform("names", lambda n: F.struct(n.alias("label"))).alias("flags"), "focus")
    df = bias.overview(p)
    assert sorted(r[:] for r in df.select("label", "n", "docs_with_focus").collect()) == [("a", 2, 1), ("b", 1, 1)]
    assert [r.docs_with_focus for r in bias.overview(p.where("focus = 0")).collect()] == [0]
    assert df._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1


def test_cues_are_looked_for_plainly_first(spark):
    texts = ["", None, "no cue", "a double-blind trial", "died", "studied, xdied", "the vs other", "avs b", "中died"]
    df = spark.createDataFrame([(x,) for x in texts], "low string")
    cues = ["double-blind", "died", " vs ", "ITT"]
    out = df.select("low", text.first_hit(F.col("low"), cues).alias("hit"), F.trim(F.regexp_extract("low", text.cue_pattern(cues), 0)).alias("want"))
    assert [r.hit for r in out.collect()] == [r.want for r in out.collect()] == ["", None, "", "double-blind", "died", "", "vs", "", "died"]
    assert "contains(" in plan(df.select(text.first_hit(F.col("low"), cues))).lower()


def test_patterns_of_a_profile_run_once_a_text(spark):
    """What a pattern finds is worked out once, however often it is named; articles are counted without their design."""
    from evispark.operators import extract
    from evispark.plans import fixtures

    articles = fixtures.frame(spark, fixtures.ARTICLES, fixtures.ARTICLE_COLUMNS)
    a = extract.with_sections(articles)
    text = a.select(extract.population().alias("p"), extract.primary_outcome().alias("o"), extract.intervention().alias("i"))._jdf.queryExecution().optimizedPlan().toString()
    # in sections and in the whole text
    assert [text.count(p) for p in (*extract.POPULATIONS, extract.PRIMARY, extract.OUTCOME_HINT, extract.INTERVENTION)] == [2, 2, 2, 2, 1, 1, 1]
    counted = extract.profile(articles).groupBy().count()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in counted and "\u547d\u4e2d" not in counted


def test_locate_shuffles_only_rows_with_a_wanted_key(spark):
    dealt = spark.range(1000).selectExpr("'term' as kind", "cast(id as string) as f", "id as pos")
    wanted = spark.range(995, 1200).selectExpr("'term' as kind", "cast(id as string) as f", "1 as query_id")
    df = locate._having(dealt, wanted)
    assert df.columns == dealt.columns and sorted(r.pos for r in df.collect()) == [995, 996, 997, 998, 999]
    assert "BroadcastHashJoin" in plan(df) and "LeftSemi" in plan(df)


def test_locate_shuffles_no_sentences_to_their_keys(spark, monkeypatch):
    """Queries with more keys than rows that are sent meet sentences where they are; beyond that ids meet first."""
    long = "Blood pressure was 120.5 in the treated group and 131.2 in others."
    q = spark.createDataFrame([(1, long), (2, "Kidney function gradually worsened everywhere."), (3, "Nothing like this 77.")], "query_id int, sentence string")
    docs = spark.createDataFrame([(10, f"Before it all. {long} After it all."), (None, f"In short words {long}"), (30, "Kidney function gradually worsened somewhere. No more words."), (40, None), (50, "")], "doc_id int, text string")
    monkeypatch.setattr(locate, "BROADCAST_ROWS", 3)
    near = locate.locate(q, docs)
    there = [x for x in plan(near).splitlines() if "BroadcastHashJoin [h#" in x and "Inner" in x]
    got = sorted(map(str, near.collect()))
    assert [(r.query_id, r.doc_id, r.pos, r.score) for r in near.orderBy("query_id", F.asc_nulls_last("doc_id")).collect()] == [(1, 10, 1, 1.0), (2, 30, 0, 0.8)]
    monkeypatch.setattr(locate, "KEY_ROWS", 3)
    assert sorted(map(str, locate.locate(q, docs).collect())) == got
    nulls = docs.where("doc_id is null")
    assert [tuple(r) for r in locate.locate(q, nulls).collect()] == [(1, None, 0, 0.95)]
    assert there


def test_keyword_counts_are_dealt_by_bytes_of_text(spark, monkeypatch):
    """A task's counts grow with its texts; grams of a unit in several rows are that unit's."""
    from evispark.operators import keywords

    rows = [(i % 30 if i % 7 else None, r) for i, r in enumerate(["总生存期与总生存期", "heart failure in liver", None, "", "心力衰竭 heart failure 心力", "研究研究总生存期的心力衰竭ab心"] * 10)]
    df = spark.createDataFrame(rows, "unit int, text string").coalesce(1)
    grams = {}
    for u, x in rows:
        for run in re.findall("[一-鿿]{2,}", x or ""):
            for n in (2, 3, 4):
                for i in range(len(run) - n + 1):
                    grams.setdefault(run[i:i + n], []).append(u)
    grams = {g: (len(u), len(set(u))) for g, u in grams.items() if len(u) > 1 and not set(g) & set(lexicon.ZH_STOP) and g not in lexicon.ZH_WORD_STOP}
    want = {(g, *c) for g, c in grams.items() if not any(len(w) == len(g) + 1 and g in (w[1:], w[:-1]) and c[0] <= d[0] for w, d in grams.items())}
    few = sorted(map(tuple, keywords.keywords(df, 5).collect()))
    monkeypatch.setattr(keywords, "DEALT", 40)
    got = keywords.chinese_grams(df)
    assert {tuple(x) for x in got.collect()} == want and want
    assert sorted(map(tuple, keywords.keywords(df, 5).collect())) == few
    tasks = -(-sum(len((x or "").encode()) for _, x in rows) // 40)
    assert tasks > 20 and all("hashpartitioning(unit#" in plan(x) and f", {tasks})" in plan(x) for x in (got, keywords.token_weights(df), keywords.phrase_weights(df)))
