"""Readers: article XML, full-text XML, JSON and CSV tables, page text, query caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions import text as X
from evispark.sources import xmlrecords

def articles_xml(spark: SparkSession, path: str) -> DataFrame:
    """Articles of an XML export, see :func:`evispark.sources.xmlrecords.articles`; book records have another tag and are left out."""
    return xmlrecords.articles(xmlrecords.records(spark, path, "PubmedArticle")).select("article.*")


def fulltext_xml(spark: SparkSession, path: str) -> DataFrame:
    """``sections`` and ``error`` of each ``article`` of the files, see :func:`evispark.sources.xmlrecords.fulltexts`."""
    return xmlrecords.fulltexts(xmlrecords.records(spark, path, "article")).select("fulltext.*")


def figures_xml(spark: SparkSession, path: str) -> DataFrame:
    """``label, caption, file, fig_id`` of the figures of each ``article`` of the files."""
    return xmlrecords.figure_rows(xmlrecords.records(spark, path, "article")).select(F.inline("figures.figures"))


def tolerant_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON file, a record a line; broken records are left out as they are read."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def funnel_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Named columns of a CSV with a header, missing ones and nulls as ''."""
    df = spark.read.csv(path, header=True, encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def first_of(*sources: tuple[str, DataFrame]) -> DataFrame:
    """Of named sources ``(key, value)`` the first one's value for each key, with its name."""
    rows = None
    for i, (name, df) in enumerate(sources):
        one = df.where("value is not null").select("key", F.struct(F.lit(i).alias("rank"), "value", F.lit(name).alias("source")).alias("s"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("key").agg(F.min("s").alias("s")).select("key", "s.value", "s.source")


def uncached(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(cache.select(*keys), keys, "left_anti")


def pdf_links(pmcid: Column, doi: Column, url: Column) -> Column:
    """Links of an article: archive PDF, DOI, page."""
    return F.filter(F.array(F.when(X.filled(pmcid), F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/"), pmcid, F.lit("/pdf/"))), F.when(X.filled(doi), F.concat(F.lit("https://doi.org/"), doi)), F.when(X.filled(url), url)), lambda x: x.isNotNull())


def open_access(locations: Column, most: int = 4) -> Column:
    """Distinct URLs of locations in order, at most four."""
    return F.slice(F.array_distinct(F.filter(locations, lambda u: X.filled(u))), 1, most)


def match_figures(figures: DataFrame, files: DataFrame) -> DataFrame:
    """``fig, file``: a name equal, then equal without case and signs, then containing four characters or more."""
    norm = lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, r"\.[A-Za-z0-9]{2,5}$", "")), "[^a-z0-9]", "")
    f, g = figures.withColumn("a", norm(F.col("href"))), files.withColumn("b", norm(F.col("file")))
    equal = f.join(g, (f.doc_id == g.doc_id) & (f.a == g.b)).select(f.doc_id, "fig", "file", F.when(F.regexp_replace("file", r"\.[A-Za-z0-9]{2,5}$", "") == F.regexp_replace("href", r"\.[A-Za-z0-9]{2,5}$", ""), 0).otherwise(1).alias("tier"))
    inside = f.join(g, (f.doc_id == g.doc_id) & (F.length("a") >= 4) & (F.length("b") >= 4) & (F.contains("a", F.col("b")) | F.contains("b", F.col("a")))).select(f.doc_id, "fig", "file", F.lit(2).alias("tier"))
    return equal.unionByName(inside).groupBy("doc_id", "fig").agg(F.min_by("file", F.struct("tier", "file")).alias("file"))
