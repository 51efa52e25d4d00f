"""Tables written once in the folder that ``spark.checkpoint.dir`` names, which all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, as in tests on one machine, one under the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/evispark-stages"
    return found.rstrip("/")


def written(df: DataFrame, what: str, partition: str | None = None) -> tuple[DataFrame, str]:
    """``df`` written as Parquet and read back, and its path. A lost executor costs a read, not the work before it."""
    spark, path = df.sparkSession, f"{folder(df.sparkSession)}/{what}-{uuid.uuid4().hex[:12]}"
    writer = df.write
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
