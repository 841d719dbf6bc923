import random

import duckdb
import pytest
from pyspark.sql import functions as F

from allelith.llm import linededup as L
from allelith.llm import sql
from allelith.llm.common import documents


def th(spark, rows):
    return {t: h for t, h in spark.createDataFrame([(t,) for t in {t for _, t in rows}], "t string").select("t", F.xxhash64("t")).collect()}


def brute(rows, hashes, least):
    """Every run of every length, looked up among all earlier places."""
    docs = sorted({(i is not None, i or 0, hashes[t], t) for i, t in rows}, key=lambda d: d[:3])
    seen, out = {}, {}
    for has, i, _, t in docs:
        every = [] if t is None else t.split("\n")
        at = [p for p, x in enumerate(every) if x.strip(" ")]
        gone, words = set(), [len(every[p].strip(" ")) - len(every[p].strip(" ").replace(" ", "")) + 1 for p in at]
        mine = []
        for s in range(len(at)):
            for e in range(s, len(at)):
                if sum(words[s : e + 1]) >= least:
                    name = tuple(every[p] for p in at[s : e + 1])
                    if name in seen or name in {m for m, b in mine if b < s}:
                        gone |= set(range(s, e + 1))
                    mine.append((name, s))
        seen |= dict.fromkeys(m for m, _ in mine)
        drop, runs = set(), 0
        for k in sorted(gone):
            if k - 1 in gone:
                drop |= set(range(at[k - 1], at[k] + 1))
            else:
                runs += 1
                drop.add(at[k])
        text = None if t is None else "\n".join(x for p, x in enumerate(every) if p not in drop)
        out[i if has else None, t] = (len(at), runs, len(gone), text)
    return out


def cases(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdef") * rng.randint(1, 3) for _ in range(rng.randint(1, 6))) for _ in range(9)]
    rows = [(1, None), (2, ""), (2, "\n \n"), (None, pool[0] + "\n" + pool[1] + "\n" + pool[2]), (3, "a\n" * 40), (3, "a\n" * 40), (4, "\n".join(pool) + "\n\n"), (5, "\n".join(pool))]
    for i in range(6, 40):
        rows.append((rng.randint(6, 30), "\n".join(rng.choice(pool) if rng.random() < 0.7 else rng.choice(["", " ", f"one {i} {rng.random()}"]) for _ in range(rng.randint(0, 14)))))
    return rows


@pytest.mark.parametrize("seed,least", [(0, 6), (1, 10), (2, 1), (3, 17)])
def test_equals_brute_force(spark, make, seed, least):
    rows = cases(seed)
    want = brute(rows, th(spark, rows), least)
    docs = make(rows)
    got = L.dedup_lines(docs.withColumn("old", F.col("text")), least).collect()
    assert len(got) == len(rows) and sum(r["__n_deleted"] for r in got) > 0
    for r in got:
        assert (r["__n_runs"], r["__n_deleted"], r.text) == want[r.doc_id, r.old][1:], r
    kept = L.keep_first_lines(docs, least)
    assert kept.columns == docs.columns
    assert kept.count() == sum(want[i, t][2] == 0 or want[i, t][3].strip(" \n") != "" for i, t in rows)


def test_ranks_are_those_of_a_suffix_array(spark, make):
    at, depth = L.suffixes(make([(1, "a\nb\na\nb\na"), (2, "b\na\nx\na\nb")]), 4)
    assert depth == 4
    rows = at.orderBy("doc_id", "i").collect()
    ids = {(r.doc_id, r.i): r.r1 for r in rows}
    for d in (1, 2, 4):
        tup = {k: tuple(ids.get((k[0], k[1] + j)) for j in range(d)) for k in ids}
        tup = {k: v for k, v in tup.items() if None not in v}
        for r in rows:
            assert (r[f"r{d}"] is not None) == ((r.doc_id, r.i) in tup)
        order = sorted(tup, key=tup.get)
        ranks = {(r.doc_id, r.i): r[f"r{d}"] for r in rows if r[f"r{d}"] is not None}
        assert [ranks[k] for k in order] == sorted(ranks.values())
        assert all((ranks[a] == ranks[b]) == (tup[a] == tup[b]) for a in tup for b in tup)


def test_empty_table(make):
    assert L.line_dedup(make([])).count() == 0 and L.keep_first_lines(make([])).count() == 0


def test_documents_equal_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as from '{sf}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(sql.LINE_RUNS).fetchall()}
    got = {r.doc_id: (r.n_lines, r.n_runs, r.n_deleted, r.text) for r in L.line_dedup(documents(spark, sf)).collect()}
    assert got == want and sum(v[2] for v in want.values()) > 0
