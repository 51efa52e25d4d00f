"""Counters and records around the workbench: hosts, feedback, surveys, use, favourites, histories, replies of services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import text as X
from evispark.sources import staging

# --- fixed values: a host's dependency and the least seconds between two requests to it
HOSTS = [
    ("eutils.ncbi.nlm.nih.gov", "pubmed", 0.36), ("www.ncbi.nlm.nih.gov", "pubmed", 0.36), ("pmc.ncbi.nlm.nih.gov", "pubmed", 0.36), ("www.ebi.ac.uk", "epmc", 0.34), ("europepmc.org", "epmc", 0.34),
    ("api.unpaywall.org", "unpaywall", 1.0), ("tmt.tencentcloudapi.com", "translate", 0.0), ("api.mymemory.translated.net", "translate", 0.20)]
OTHER_DEPENDENCY, WITH_KEY, KEYED_HOST = "llm", 0.10, "eutils.ncbi.nlm.nih.gov"
FEEDBACK_KINDS = ["bug", "feature", "question", "other"]
#: Fixed limits: characters of a feedback and its diagnostics, entries of a day that stay, of a survey's answers and its entries, of a history, favourites shown.
FEEDBACK, DIAGNOSTICS, FEEDBACK_KEPT, ANSWER, IMPROVE, CONTACT, SURVEYS_KEPT, HISTORY, HISTORY_SHOWN = 4000, 6000, 200, 200, 2000, 300, 100, 200, 50
#: Cuts of days that may be broadcast; one is a few numbers wide.
CUTS = 100_000
#: Fixed limits of tables in PDFs: pages looked at, tables kept.
TABLE_PAGES, TABLES = 60, 40


def dependency_of(url: Column, stated: Column | None = None) -> Column:
    """The dependency that a request belongs to: as stated, else its host's, else ``OTHER_DEPENDENCY``."""
    table = F.create_map(*[F.lit(x) for host, dep, _ in HOSTS for x in (host, dep)])
    own = F.coalesce(F.try_element_at(table, X.host_of(url)), F.lit(OTHER_DEPENDENCY))
    return own if stated is None else F.coalesce(F.nullif(stated, F.lit("")), own)


def host_delay(url: Column, keyed: bool = False, overrides: dict[str, float] | None = None) -> Column:
    """Least seconds between requests to a URL's host; with a key, or as overridden, where that holds; else none."""
    delays = {host: s for host, _, s in HOSTS} | ({KEYED_HOST: WITH_KEY} if keyed else {}) | {h: max(0.0, float(s)) for h, s in (overrides or {}).items()}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in delays.items() for x in kv]), X.host_of(url)), F.lit(0.0))


def model_ids(replies: DataFrame) -> DataFrame:
    """``id, models`` of JSON ``replies(id, json)`` that list models: distinct names, sorted; empty where there are none."""
    names = F.from_json("json", "data array<struct<id string>>")["data"]
    clean = F.filter(F.transform(names, lambda m: F.trim(F.coalesce(m["id"], F.lit("")))), lambda x: x != "")
    return replies.select("id", F.coalesce(F.array_sort(F.array_distinct(clean)), F.array().cast("array<string>")).alias("models"))


def chat_replies(replies: DataFrame) -> DataFrame:
    """``id, content, finish, cut`` of chat ``replies(id, json)``: the first choice's answer without its reasoning, why it ended, and whether it was cut off."""
    first = F.get(F.from_json("json", "choices array<struct<message:struct<content:string>,finish_reason:string>>")["choices"], F.lit(0))
    finish = F.trim(F.coalesce(first["finish_reason"], F.lit("")))
    return replies.select("id", F.trim(F.coalesce(first["message"]["content"], F.lit(""))).alias("content"), finish.alias("finish"), (finish == "length").alias("cut"))


def language_pair(pair: Column) -> Column:
    """``source, target`` of a pair such as ``en|zh-CN``; blank parts are English and none."""
    p = F.coalesce(F.nullif(pair, F.lit("")), F.lit("en|zh-CN"))
    source, target = F.split_part(p, F.lit("|"), F.lit(1)), F.when(F.contains(p, F.lit("|")), F.regexp_extract(p, r"^[^|]*\|(.*)$", 1)).otherwise("")
    return F.struct(F.coalesce(F.nullif(source, F.lit("")), F.lit("en")).alias("source"), F.when(target == "zh-CN", "zh").otherwise(target).alias("target"))


def candidates(records: DataFrame, most: int = 8) -> DataFrame:
    """Vocabulary records ``(term, ord, ui, terms, type, mapped_to, scope_note, trees)`` as :mod:`evispark.operators.vocab` takes them.

    The first ``most`` of a term with a name; the first name is the heading, blank ones go, and so do tree numbers that begin with ``@``.
    """
    none = F.array().cast("array<string>")
    names = F.filter(F.transform(F.coalesce("terms", none), lambda t: F.trim(F.coalesce(t, F.lit("")))), lambda t: t != "")
    trees = F.filter(F.coalesce("trees", none), lambda n: (F.coalesce(n, F.lit("")) != "") & ~n.startswith("@"))
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    first = records.withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy("ord"))).where(F.col("n") <= most)
    return first.withColumn("entry_terms", names).where(F.size("entry_terms") > 0).select(
        "term", "ord", "ui", X.squeeze(F.get("entry_terms", F.lit(0))).alias("heading"), "entry_terms", F.coalesce(F.nullif(F.trim("type"), F.lit("")), F.lit("descriptor")).alias("type"),
        text("mapped_to").alias("mapped_to"), text("scope_note").alias("scope_note"), trees.alias("tree_numbers"))


def _latest_of_days(rows: DataFrame, keep: int) -> DataFrame:
    """The latest ``keep`` of ``rows(scope, ts, seq, ...)`` of each scope and day; rows of equal time and place go by their other columns.

    Texts are neither sorted nor shuffled: times and places alone tell where a day that has more is cut, and those cuts meet the rows.
    """
    last = F.struct("ts", "seq")
    day = Window.partitionBy("scope", F.to_date("ts")).orderBy(F.desc("ts"), F.desc("seq"))
    first_out = rows.select("scope", "ts", "seq", F.row_number().over(day).alias("_n"), F.rank().over(day).alias("_k")).where(F.col("_n") == keep + 1)
    cuts, _ = staging.written(first_out.select(F.col("scope").alias("_scope"), F.to_date("ts").alias("_day"), last.alias("_cut"), (F.col("_n") - F.col("_k")).alias("_fit")), "day-cuts")
    n, tied = cuts.agg(F.count(F.lit(1)), F.coalesce(F.max("_fit"), F.lit(0))).first()
    if not n:
        return rows
    met = lambda c: rows.join(F.broadcast(c) if n <= CUTS else c.hint("shuffle_hash"), F.col("scope").eqNullSafe(F.col("_scope")) & F.to_date("ts").eqNullSafe(F.col("_day")), "left")
    kept = met(cuts).where(F.col("_cut").isNull() | (last > F.col("_cut"))).select(*rows.columns)
    if not tied:
        return kept
    rest = Window.partitionBy("scope", "_day").orderBy(*[c for c in rows.columns if c not in ("scope", "ts", "seq")])
    more = met(cuts.where("_fit > 0")).where(last == F.col("_cut")).withColumn("_n", F.row_number().over(rest)).where("_n <= _fit")
    return kept.unionByName(more.select(*rows.columns))


def feedback(entries: DataFrame) -> DataFrame:
    """Kept entries of ``entries(scope, ts, seq, kind, content, diagnostics)``: blank ones go, unknown kinds are ``other``, texts end at their limits, a scope's day keeps its latest ``FEEDBACK_KEPT``."""
    c = F.trim(F.coalesce("content", F.lit("")))
    e = entries.where(c != "").select("scope", "ts", "seq", F.when(F.col("kind").isin(*FEEDBACK_KINDS), F.col("kind")).otherwise("other").alias("kind"), F.left(c, F.lit(FEEDBACK)).alias("content"), F.left(F.coalesce("diagnostics", F.lit("")), F.lit(DIAGNOSTICS)).alias("diagnostics"))
    return _latest_of_days(e, FEEDBACK_KEPT)


def feedback_count(kept: DataFrame) -> DataFrame:
    """``scope, n`` over all days."""
    return kept.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))


def surveys(answers: DataFrame) -> DataFrame:
    """Survey ``answers(scope, ts, seq, usage_count, freq, useful, satisfaction, recommend, improve, contact)`` without addresses and numbers, at their limits, a scope's latest ``SURVEYS_KEPT`` of a day."""
    short = lambda c, n: F.left(X.sanitize(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(n)).alias(c)
    a = answers.select("scope", "ts", "seq", F.coalesce("usage_count", F.lit(0)).alias("usage_count"), *[short(c, ANSWER) for c in ("freq", "useful", "satisfaction", "recommend")], short("improve", IMPROVE), short("contact", CONTACT))
    return _latest_of_days(a, SURVEYS_KEPT)


def usage(actions: DataFrame) -> DataFrame:
    """``scope, count, prompts, muted, survey_done, first_use, last_use`` of ``actions(scope, ts, action)``: ``use``, ``prompt``, ``mute`` and ``survey``."""
    a = F.col("action")
    return actions.groupBy("scope").agg(F.count_if(a == "use").alias("count"), F.count_if(a == "prompt").alias("prompts"), F.coalesce(F.max(a == "mute"), F.lit(False)).alias("muted"), F.coalesce(F.max(a == "survey"), F.lit(False)).alias("survey_done"),
                                        F.min("ts").alias("first_use"), F.max(F.when(a == "use", F.col("ts"))).alias("last_use"))


def history(searches: DataFrame, shown: int = HISTORY_SHOWN) -> DataFrame:
    """The latest ``shown`` searches ``(scope, ts, seq, query, n_results)`` of each scope with their ``place``; a scope keeps ``HISTORY``."""
    w = Window.partitionBy("scope").orderBy(F.desc("ts"), F.desc("seq"))
    return searches.withColumn("place", F.row_number().over(w)).where(F.col("place") <= min(shown, HISTORY))


def latest_state(states: DataFrame) -> DataFrame:
    """``scope, name, state``: what was written last under a name; a null state clears it."""
    return states.groupBy("scope", "name").agg(F.max_by("state", F.struct("ts", "seq")).alias("state")).where("state is not null")


def scope_path(scope: Column, name: Column) -> Column:
    """Where a scope's table lies: that of the machine's own user beside those of others; a scope that is no token is the own one."""
    ok = X.valid_token(scope) & (scope != "local")
    return F.when(F.coalesce(ok, F.lit(False)), F.concat(F.lit("users/"), F.trim(scope), F.lit("/"), name)).otherwise(name)


def pdf_tables(tables: DataFrame) -> DataFrame:
    """``doc_id, page, index, rows`` of found ``tables(doc_id, page, index, rows array<array<string>>)`` that are tables.

    Pages up to ``TABLE_PAGES``, the first ``TABLES`` of a document; cells trimmed, rows without any text left out; two rows and two columns at least.
    """
    clean = F.transform("rows", lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[ \t 　]+", " "))))
    full = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    t = tables.where((F.col("page") <= TABLE_PAGES) & F.col("rows").isNotNull()).withColumn("rows", full)
    t = t.where((F.size("rows") >= 2) & (F.array_max(F.transform("rows", F.size)) >= 2))
    return t.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "index"))).where(F.col("_n") <= TABLES).drop("_n")
