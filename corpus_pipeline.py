"""The training-text pipeline: each stage is one operator of allelith.llm, written as Parquet and read by the next.

toxicity drops documents whose predicted severity reaches the rejection cut; line_dedup deletes later copies of line runs of
fifty words or more (and documents of which nothing is left); near_duplicates keeps one document of each group of
Jaccard-linked texts; decontamination drops documents that hold a window of a benchmark item; tokens encodes what is left.

Defined cases, stage by stage as in the operators' own docstrings: null and empty texts pass all stages (no words, no lines, no
shingles, no windows) and end with no tokens; of repeated rows line_dedup treats those of one id and text as one document
and near_duplicates keeps one, where they have shingles; rows without id take part as nodes of their own and give way to any
id; ties go to the smaller id; a score at the cut is rejected; very long texts are taken whole; an empty table stays empty;
columns beyond those of documents are kept as they are by all but the last stage, whatever their names, as operators add none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from allelith.llm.common import own_folder, remove, table
from allelith.llm.decontamination import keep_uncontaminated
from allelith.llm.linededup import keep_first_lines
from allelith.llm.sentencepieces import encode_decode
from allelith.llm.setjoin import keep_one
from allelith.llm.toxicity import keep_clean

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_decode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The toxicity and codec stages have no SQL form; the tests hold run() against brute-force stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again, and goes once the next is written."""
    docs, folder, before = table(spark, sf_dir, "documents"), own_folder(spark, "pipeline"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
