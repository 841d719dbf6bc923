import zlib

import numpy as np

from allelith.llm import sharding as S


def test_matrix_has_exact_margins_and_the_right_mean():
    cells = S.even(103, 8)
    got = np.array([S.communication_matrix([50, 0, 53], cells, seed) for seed in range(400)])
    assert (got.sum(axis=1) == cells).all() and (got.sum(axis=2) == [50, 0, 53]).all()
    assert abs(got[:, 0, 0].mean() - 50 * cells[0] / 103) < 0.35


def test_large_draws_follow_the_law():
    rng = np.random.default_rng(1)
    x = np.array([S._large_hypergeometric(rng, 600, 400, 300) for _ in range(4000)])
    y = rng.hypergeometric(600, 400, 300, 4000)
    assert abs(x.mean() - y.mean()) < 0.6 and abs(x.std() - y.std()) < 0.4
    big = [S.hypergeometric(rng, 3 * 10**10, 7 * 10**10, 10**9) for _ in range(50)]
    assert abs(np.mean(big) / 3e8 - 1) < 1e-3


def test_shards_are_exact_and_slots_gapless(make):
    rows = [(i, f"text {i % 7} é") for i in range(500)] + [(3, None), (None, "x"), (5, ""), (5, ""), (None, None)]
    got = S.uniform_shards(make(rows), rows_per_cell=16).collect()
    assert len(got) == len(rows)
    sizes = sorted(sum(r.shard == s for r in got) for s in range(8))
    assert sizes[-1] - sizes[0] <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    want = sorted((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == want
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, S.uniform_shards(make(rows), rows_per_cell=16).collect()), key=str)
    assert S.uniform_shards(make([])).count() == 0


def test_shards_equal_a_permutation_rebuilt_by_hand(make, spark):
    """Deal rows to sources, order each by a keyed hash, deal it out by its row of the matrix, order each cell again."""
    from pyspark.sql import functions as F

    seed, shards, per_cell = 20240501, 8, 16
    rows = [(7 * i - 40, f"text {i % 9} é") for i in range(300)] + [(3, None), (3, None), (9, ""), (9, "x")]
    total = len(rows)
    blocks = -(-total // (per_cell * shards))
    n_cells = blocks * shards
    ids = spark.createDataFrame([(i,) for i in sorted({i for i, _ in rows})], "i long")
    keys = {r.i: (r.p % n_cells, r.a, r.b) for r in ids.select("i", F.xxhash64(F.lit(seed), "i").alias("p"), F.xxhash64(F.lit(seed + 1), "i").alias("a"), F.xxhash64(F.lit(seed + 2), "i").alias("b")).collect()}
    tie = lambda r: (r[0], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1)
    sources = [sorted((r for r in rows if keys[r[0]][0] == p), key=lambda r: (keys[r[0]][1], *tie(r))) for p in range(n_cells)]
    sizes = [x for m in S.even(total, shards) for x in S.even(m, blocks)]
    matrix = S.communication_matrix([len(s) for s in sources], sizes, seed)
    cells = [[] for _ in sizes]
    for source, row in zip(sources, matrix, strict=True):
        at = 0
        for c, n in enumerate(row):
            cells[c] += source[at : at + n]
            at += n
    want, slot = [], 0
    for c, cell in enumerate(cells):
        slot = 0 if c % blocks == 0 else slot
        for r in sorted(cell, key=lambda r: (keys[r[0]][2], *tie(r))):
            want.append((*tie(r), c // blocks, slot))
            slot += 1
    got = [(r.doc_id, r.text_crc32, r["size"], r.shard, r.slot) for r in S.uniform_shards(make(rows), shards, seed, per_cell).collect()]
    assert sorted(got) == sorted(want)
