"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store import dropped, own_folder, remove, shared_folder, stored

__all__ = ["cut", "documents", "dropped", "id_text", "own_folder", "remove", "shared_folder", "stored", "table", "text_or_empty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no other column's name can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def cut(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut by files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))
