"""The queries of this subpackage, each an operator with production parameters over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .common import documents, table
from .decontamination import contaminated
from .fingerprints import fingerprints
from .linededup import line_dedup
from .pii import find_pii
from .quality import quality
from .secrets import find_secrets
from .sentencepieces import encode_decode
from .setjoin import jaccard_components
from .sharding import uniform_shards
from .toxicity import toxicity


def op1_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))


def op2_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uniform_shards(documents(spark, sf_dir), n_shards=8)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))


def op3_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir))


def op5_benchmark_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op6_toxic_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op8_packed_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_runs": op1_line_runs,
    "op2_uniform_shards": op2_uniform_shards,
    "op3_quality_machine": op3_quality_machine,
    "op4_piece_codec": op4_piece_codec,
    "op5_benchmark_regions": op5_benchmark_regions,
    "op6_toxic_severity": op6_toxic_severity,
    "op7_jaccard_components": op7_jaccard_components,
    "op8_packed_minhash": op8_packed_minhash,
    "op9_pii_spans": op9_pii_spans,
    "op10_secret_scan": op10_secret_scan,
}
ORACLE_SQL: dict[str, str] = {"op1_line_runs": sql.LINE_RUNS, "op7_jaccard_components": sql.JACCARD_COMPONENTS}
