"""Counting reads that keep arriving: an extension, the batch operators need no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kmers
from ..plans.relation import expand


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(read_id, seq) from Parquet files as they come in."""
    return spark.readStream.schema("read_id bigint, seq string").parquet(folder)


def node_counts(reads: DataFrame, index: DataFrame, k: int = 11) -> DataFrame:
    """n by node over all reads so far, for output mode complete: the index is static, the state one sum a node."""
    windows = reads.sparkSession.sql(expand(kmers.kmers(k).text, "spark"), reads=reads)
    return windows.join(index, "kmer").groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
