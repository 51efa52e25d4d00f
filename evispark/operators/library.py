"""Folders, tags, notes, favourites and history as tables; every change is a new table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evispark.functions import lexicon as L
from evispark.functions import text as X



def none() -> Column:
    return F.array().cast("array<string>")


def normalise(meta: DataFrame, folders: DataFrame) -> DataFrame:
    """Entries with known folders, normal tags and short notes; empty entries are removed."""
    known = folders.select(F.col("id").alias("folder")).distinct()
    tags = F.slice(X.distinct_ci(F.filter(F.transform(F.coalesce("tags", none()), X.norm_tag), lambda t: t != "")), 1, L.LIBRARY["tags"])
    m = meta.join(known.withColumn("ok", F.lit(True)), "folder", "left")
    m = m.select("pmid", F.when(F.col("ok"), F.col("folder")).otherwise("").alias("folder"), tags.alias("tags"), F.substring(F.coalesce("note", F.lit("")), 1, L.LIBRARY["note"]).alias("note"), "note_updated")
    return m.where((F.col("folder") != "") | (F.size("tags") > 0) | (F.trim("note") != ""))


def folder_counts(folders: DataFrame, meta: DataFrame) -> DataFrame:
    """``id, name, n`` of every folder, empty ones too."""
    n = meta.groupBy(F.col("folder").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return folders.join(n, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"))


def all_tags(meta: DataFrame) -> DataFrame:
    """``tag, n``: tags whatever the case, in the first entry's spelling."""
    t = meta.select("pmid", F.posexplode("tags").alias("pos", "tag"))
    return t.groupBy(F.lower("tag").alias("k")).agg(F.min_by("tag", F.struct("pmid", "pos")).alias("tag"), F.count(F.lit(1)).alias("n")).select("tag", "n")


def add_tags(tags: Column, more: Column) -> Column:
    return F.slice(X.distinct_ci(F.concat(F.coalesce(tags, none()), more)), 1, L.LIBRARY["tags"])


def remove_tags(tags: Column, gone: Column) -> Column:
    low = F.transform(gone, lambda x: F.lower(x))
    return F.filter(tags, lambda t: ~F.array_contains(low, F.lower(t)))


def rename_tag(meta: DataFrame, old: str, new: str) -> DataFrame:
    """A tag renamed or merged; a blank new name deletes it."""
    to = F.transform("tags", lambda t: F.when(F.lower(t) == old.lower(), F.lit(new)).otherwise(t))
    return meta.withColumn("tags", X.distinct_ci(F.filter(to, lambda t: t != "")))


def upsert(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes ``(pmid, folder, tags, note)`` over entries; a null leaves what is there."""
    c = changes.select("pmid", *[F.col(x).alias("new_" + x) for x in ("folder", "tags", "note")])
    j = meta.join(c, "pmid", "full_outer")
    return j.select("pmid", F.coalesce("new_folder", "folder", F.lit("")).alias("folder"), F.coalesce("new_tags", "tags", none()).alias("tags"), F.coalesce("new_note", "note", F.lit("")).alias("note"), "note_updated")


def add_folders(folders: DataFrame, names: DataFrame) -> DataFrame:
    """New folders of ``names(id, name, created_at)`` whose names are not there, whatever the case."""
    n = names.withColumn("name", X.folder_name(F.col("name"))).where("name <> ''").withColumn("k", F.lower("name"))
    one = n.withColumn("_n", F.row_number().over(Window.partitionBy("k").orderBy("created_at", "id"))).where("_n = 1").drop("_n")
    return folders.unionByName(one.join(folders.select(F.lower("name").alias("k")), "k", "left_anti").select("id", "name", "created_at"))


def delete_folder(meta: DataFrame, folder: str) -> DataFrame:
    """Entries of a folder without it; their tags and notes stay."""
    return meta.withColumn("folder", F.when(F.col("folder") == folder, "").otherwise(F.col("folder")))


def prune(meta: DataFrame, valid: DataFrame) -> DataFrame:
    return meta.join(valid.select("pmid").distinct(), "pmid", "left_semi")


def filtered(articles: DataFrame, meta: DataFrame, folders: DataFrame, folder: str | None = None, tags: list[str] | None = None, words: str = "") -> DataFrame:
    """``pmid`` of articles in a folder, with all tags, and with the words somewhere in title, authors, tags, note or folder name."""
    j = articles.join(meta, "pmid", "left").join(folders.select(F.col("id").alias("folder"), F.col("name").alias("folder_name")), "folder", "left")
    low = F.transform(F.coalesce("tags", none()), lambda t: F.lower(t))
    conds = [F.lit(True)]
    if folder is not None:
        conds.append(F.coalesce("folder", F.lit("")) == folder)
    conds += [F.array_contains(low, t.lower()) for t in tags or []]
    blob = F.lower(F.concat_ws(" ", "title", F.array_join(F.coalesce("authors", none()), " "), F.array_join(F.coalesce("tags", none()), " "), "note", "folder_name"))
    conds += [F.contains(blob, F.lit(w)) for w in words.lower().split()]
    return j.where(reduce(lambda a, b: a & b, conds)).select("pmid")


def merge(folders: DataFrame, meta: DataFrame, in_folders: DataFrame, in_meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Import: folders meet by name whatever the case, tags are united, a folder or note that is not blank wins."""
    new = in_folders.withColumn("k", F.lower("name")).join(folders.select(F.lower("name").alias("k"), F.col("id").alias("own")), "k", "left")
    ids = new.select(F.col("id").alias("in_id"), F.coalesce("own", "id").alias("to"))
    out = folders.unionByName(new.where("own is null").select("id", "name", "created_at"))
    m = in_meta.join(ids, in_meta.folder == ids.in_id, "left").select("pmid", F.coalesce("to", F.lit("")).alias("b_folder"), F.col("tags").alias("b_tags"), F.col("note").alias("b_note"))
    j = meta.join(m, "pmid", "full_outer")
    pick = lambda a, b: F.when(F.coalesce(F.trim(b), F.lit("")) != "", F.col(b)).otherwise(F.coalesce(a, F.lit("")))
    return out, j.select("pmid", pick("folder", "b_folder").alias("folder"), add_tags(F.col("tags"), F.coalesce("b_tags", none())).alias("tags"), pick("note", "b_note").alias("note"))


def newest(rows: DataFrame, keep: int, by: str = "time", scope: str | None = None) -> DataFrame:
    """The newest ``keep`` rows, of each scope if named."""
    if scope is None:
        return rows.orderBy(F.desc(by)).limit(keep)
    w = Window.partitionBy(scope).orderBy(F.desc(by))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def add_favourites(favourites: DataFrame, articles: DataFrame) -> DataFrame:
    """New ones without their full text, none twice."""
    new = articles.drop("fulltext_sections").dropDuplicates(["pmid"]).join(favourites.select("pmid"), "pmid", "left_anti")
    return new.unionByName(favourites, allowMissingColumns=True)


def promote(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of another scope whose keys the target does not have."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti"))


def rename_folders(folders: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folders after ``changes(id, name)``, one for a folder, and ``id, reason`` of those refused.

    A name that is blank, belongs to another folder whatever the case, or is asked for by an
    earlier change (by id) is refused, and so is a folder that is not there.
    """
    asked = changes.select("id", X.folder_name(F.col("name")).alias("new")).withColumn("k", F.lower("new"))
    known = folders.select("id", F.lit(True).alias("there"))
    taken = folders.select(F.lower("name").alias("k"), F.col("id").alias("owner"))
    first = F.row_number().over(Window.partitionBy("k").orderBy("id"))
    j = asked.withColumn("nth", first).join(known, "id", "left").join(taken.groupBy("k").agg(F.collect_set("owner").alias("owners")), "k", "left")
    other = F.size(F.array_except(F.coalesce("owners", none()), F.array("id"))) > 0
    reason = F.when(F.col("new") == "", "blank").when(F.col("there").isNull(), "gone").when(other | (F.col("nth") > 1), "taken").otherwise("")
    j = j.withColumn("reason", reason)
    done = folders.join(j.where("reason = ''").select("id", "new"), "id", "left").select("id", F.coalesce("new", "name").alias("name"), "created_at")
    return done, j.where("reason <> ''").select("id", "reason")
