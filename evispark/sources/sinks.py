"""Sinks: CSV with a mark, Markdown tables, joined text, JSON backup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.operators.compare import md_cell
from evispark.sources import onefile


def joined(rows: DataFrame, order: str = "ord", text: str = "text", between: str = "\n\n", last: str = "\n") -> str:
    """One text of ordered entries. It is made for one export: the rows of one user's selection."""
    parts = [r[0] for r in rows.orderBy(order).select(text).toLocalIterator()]
    return between.join(parts) + last if parts else ""


def markdown(df: DataFrame, order: str) -> DataFrame:
    """``ord, line`` of a Markdown table's body."""
    return df.select(F.col(order).alias("ord"), F.concat(F.lit("| "), F.concat_ws(" | ", *[md_cell(F.col(c)) for c in df.columns]), F.lit(" |")).alias("line"))


def markdown_text(df: DataFrame, order: str) -> str:
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns) + "\n"
    return head + joined(markdown(df, order), "ord", "line", "\n")


def csv(df: DataFrame, path: str) -> None:
    """CSV files with a header; spreadsheet programs want the byte order mark, which the first column's name carries."""
    df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0]).write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


def table(df: DataFrame, path: str, partition: str | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def backup(folders: DataFrame, meta: DataFrame) -> DataFrame:
    """``kind, json``: a line for each folder and entry."""
    f = folders.select(F.lit("folder").alias("kind"), F.to_json(F.struct(*folders.columns)).alias("json"))
    return f.unionByName(meta.select(F.lit("meta").alias("kind"), F.to_json(F.struct(*meta.columns)).alias("json")))


def export_csv(df: DataFrame, path: str, order: str) -> None:
    """One CSV for a spreadsheet, in ``order``: a byte order mark, a header, CR LF; in place of the old file only when it is whole."""
    onefile.write(df.orderBy(order), path, "csv")


def export_text(rows: DataFrame, path: str, order: str = "ord", text: str = "text", between: str = "\n") -> None:
    """Ordered entries as one text file, which does not pass through the driver's memory."""
    onefile.write(rows.orderBy(order).select(text), path, "text", between=between)


def export_zip(files: DataFrame, path: str) -> None:
    """``files(name, content)`` as one ZIP."""
    onefile.write(files.select("name", "content"), path, "zip")


def keep_state(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines in one file that is replaced whole, for states that few rows have."""
    onefile.write(rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("line")), path, "text")
