"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt to P virtual source partitions by a hash of doc_id. Shards are cut into blocks of known
size ("cells"). The counts that go from each source partition to each cell are drawn from the multivariate
hypergeometric law, which is how a uniform permutation of all rows would spread them. Each source partition
is permuted locally (an order by a keyed hash) and dealt out by its row of the matrix; each cell is permuted
again, and a row's slot is its cell's offset plus its place there. No step needs all rows of a shard in one task.

Defined cases: a null text has size 1 and the checksum of no bytes; repeated rows are rows of their own and
get slots of their own; ties of the hash are broken by doc_id, checksum and size; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The matrix has at most MAX_CELLS squared entries (8 MB), which bounds what is broadcast at any input size.
MAX_CELLS = 1024
NUMPY_LIMIT = 10**9


def _large_hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """One draw by ratio of uniforms (Stadlober 1990), for populations beyond what numpy takes."""
    total = good + bad
    few, many, take = min(good, bad), max(good, bad), min(sample, total - sample)
    p = few / total
    mean = take * p + 0.5
    var = (total - take) * take * p * (1 - p) / (total - 1)
    width = 1.7155277699214135 * math.sqrt(var + 0.5) + 0.8989161620588988
    mode = (take + 1) * (few + 1) // (total + 2)

    def weight(k: int) -> float:
        return -(math.lgamma(k + 1) + math.lgamma(few - k + 1) + math.lgamma(take - k + 1) + math.lgamma(many - take + k + 1))

    top, last = weight(mode), min(few, take)
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        x = mean + width * (v - 0.5) / u
        if not 0 <= x < last + 1 or many - take + (k := math.floor(x)) < 0:
            continue
        if 2 * math.log(u) <= weight(k) - top:
            break
    if good > bad:
        k = take - k
    return good - k if take < sample else k


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    if sample == 0 or good == 0:
        return 0
    if bad == 0:
        return sample
    if sample == good + bad:
        return good
    return int(rng.hypergeometric(good, bad, sample)) if good + bad < NUMPY_LIMIT else _large_hypergeometric(rng, good, bad, sample)


def communication_matrix(sources: list[int], cells: list[int], seed: int) -> list[list[int]]:
    """matrix[p][c]: rows that source partition p sends to cell c; row sums are sources, column sums are cells."""
    assert sum(sources) == sum(cells)
    rng, left, matrix = np.random.Generator(np.random.PCG64(seed)), list(cells), []
    for n in sources:
        row, rest = [], sum(left)
        for c, room in enumerate(left):
            got = hypergeometric(rng, room, rest - room, n)
            row.append(got)
            rest, n, left[c] = rest - room, n - got, room - got
        matrix.append(row)
    return matrix


def even(total: int, parts: int) -> list[int]:
    """Sizes at most one apart."""
    return [total // parts + (i < total % parts) for i in range(parts)]


def uniform_shards(docs: DataFrame, n_shards: int = 8, seed: int = 20240501, rows_per_cell: int = 2048) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; shard sizes differ by one at most."""
    total = docs.count()
    blocks = max(1, min(math.ceil(total / rows_per_cell / n_shards), MAX_CELLS // n_shards))
    n_cells = blocks * n_shards
    source = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), F.lit(n_cells)).cast("int")
    # at most MAX_CELLS counts
    counts = {r["p"]: r["n"] for r in docs.groupBy(source.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    shard_sizes = even(total, n_shards)
    cells = [x for m in shard_sizes for x in even(m, blocks)]
    offsets = [sum(cells[c // blocks * blocks : c]) for c in range(n_cells)]
    matrix = communication_matrix([counts.get(p, 0) for p in range(n_cells)], cells, seed)
    ends = ";".join(",".join(str(x) for x in np.cumsum(row)) for row in matrix)
    deal = docs.sparkSession.range(1).select(F.posexplode(F.split(F.lit(ends), ";")).alias("p", "row")).select("p", F.split("row", ",").cast("array<long>").alias("ends"))
    raw = F.col("text").cast("string").cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        source.alias("p"),
    )
    tie = ("doc_id", "text_crc32", "size")
    first = Window.partitionBy("p").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), *tie)
    sent = (
        rows.withColumn("nth", F.row_number().over(first) - 1)
        .join(F.broadcast(deal), "p")
        .withColumn("cell", F.size(F.filter("ends", lambda e: e <= F.col("nth"))))
    )
    again = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id"), *tie)
    return sent.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.floor(F.col("cell") / blocks).cast("int").alias("shard"),
        (F.element_at(F.lit(offsets).cast("array<long>"), F.col("cell") + 1) + F.row_number().over(again) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
