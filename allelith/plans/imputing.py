"""A hook for an external imputer: a command line run once for each region of a genome, on the executors."""

from __future__ import annotations

import shlex
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph
from ..sources import genomics as io
from . import vcf_filters

SCHEMA = "chrom string, chunk bigint, command string, status int, said string"


def regions(vcf: DataFrame, header: list[str] | None = None) -> DataFrame:
    """(chrom, chunk, n, first, last): the regions that variants fall into; with a header, of contigs that it lists alone."""
    chunks = graph.region_chunks(vcf_filters.as_spans(vcf))
    return chunks.where(F.col("chrom").isin(io.contigs_of(header))) if header and io.contigs_of(header) else chunks


def run_regions(chunks: DataFrame, command: str, timeout: int = 3600) -> DataFrame:
    """Runs `command` for each region, with {chrom}, {first}, {last} (1-based, both included) and {chunk} filled in, without a shell. Files
    that it names must be where all executors see them; it must write anew what it wrote before, as a lost task runs again.
    One row for each region: its command, exit status and the end of what it said."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples():
                words = [w.format(chrom=r.chrom, chunk=r.chunk, first=r.first + 1, last=r.last) for w in shlex.split(command)]
                try:
                    done = subprocess.run(words, capture_output=True, text=True, timeout=timeout, check=False)
                    status, said = done.returncode, (done.stdout + done.stderr)[-2000:]
                except (OSError, subprocess.TimeoutExpired) as e:
                    status, said = -1, str(e)[-2000:]
                rows.append((r.chrom, r.chunk, shlex.join(words), status, said))
            yield pd.DataFrame(rows, columns=["chrom", "chunk", "command", "status", "said"]).astype({"chunk": "int64", "status": "int32"})

    # a region is a task's work
    return chunks.select("chrom", "chunk", "first", "last").repartition("chrom", "chunk").mapInPandas(run, SCHEMA)
