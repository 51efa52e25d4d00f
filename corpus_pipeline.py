"""Corpus pipeline: quality, near-dedup, decontamination, mixing, token ids.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; a stage's rows are written as
Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evispark.llm import common, decontaminate, mixing, quality, simhash, tokenstore


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are scored as any other; rows that repeat stay or go together; columns stay as they are."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity 0.8. Texts without words are alike; of rows that repeat one stays; an empty table stays empty."""
    return simhash.keep_similar_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null texts hold none and stay; null and blank items are in no text; without items all stay."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each copy a row. Null texts have no words; null is a source too; ties go by the id."""
    return mixing.apply_mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from a content-addressed store, a row for each row. Null and empty texts are the end's id alone; an empty table gives no rows."""
    return tokenstore.encode_table(docs, tokenstore.tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources", mix_stage),
    ("token ids", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = common.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.unstage(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier, the sketches and the tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None
