import random
import re

import pytest

from allelith.llm import setjoin as J
from allelith.llm.common import documents


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} - {()})


def brute(rows):
    """Components by comparing all pairs; rows that share an id are one node."""
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, set()).add(shingles(t))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    by = {}
    for i in ids:
        for s in sets[i]:
            for x in s:
                by.setdefault(x, []).append(i)
    near = {(a, b) for v in by.values() for k, a in enumerate(v) for b in v[k + 1 :] if a < b}
    for a, b in near:
        if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: find(i) for i in ids}


def family(rng, n, size, word):
    base = [word() for _ in range(size)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, max(1, size // 25))):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 1)] = [word()] * rng.randint(0, 2)
        yield " ".join(w)


def cases(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(30))
    texts = [None, "", " \t\n", "a b", "A B", "a b c", "one two three four five", "One two\nthree\x0bfour five "]
    for n, size in ((25, 60), (12, 61), (8, 150), (5, 9), (9, 25)):
        fam = list(family(rng, n, size, word))
        texts += fam + [f"{passage} {t}" for t in fam[:4]] + fam[:2]
    chain = [word() for _ in range(80)]
    for _ in range(14):
        texts.append(" ".join(chain))
        chain = chain[2:] + [word(), word()]
    texts += [f"{passage} {' '.join(word() for _ in range(rng.randint(0, 30)))}" for _ in range(25)]
    rng.shuffle(texts)
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    return rows + [rows[5], (rows[6][0], rows[40][1]), (rows[7][0], ""), (None, texts[3]), (None, "nowhere else at all to be found")]


def compare(rows, got):
    want = brute(rows)
    assert sorted((str(i), len(shingles(t))) for i, t in rows) == sorted((str(r.doc_id), r.n_shingles) for r in got)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    return want


@pytest.mark.parametrize("seed,how", [(0, {}), (1, {"hot_from": 2, "hot": 60}), (2, {"hot": 0, "family": 5}), (3, {"family": 2})])
def test_equals_all_pairs(make, monkeypatch, seed, how):
    rows = cases(seed)
    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "COLUMNS", 64)
    conf = make([]).sparkSession.conf
    before = conf.get("spark.sql.autoBroadcastJoinThreshold")
    if seed == 2:  # sets to verify are then found by a shuffle
        conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = compare(rows, J.jaccard_components(make(rows), **how).collect())
    finally:
        conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(set(want.values())) < len(want) - 50
    if not seed:
        kept = J.keep_one(make(rows))
        assert kept.columns == make(rows).columns
        ids = [r.doc_id for r in kept.collect() if r.doc_id is not None and shingles(r.text)]
        assert sorted(ids) == sorted({i for i, t in rows if i is not None and shingles(t) and want[i] == i})
        assert sum(not shingles(r.text) for r in kept.collect()) >= 3


def test_empty_tables(make):
    assert J.jaccard_components(make([])).count() == 0 and J.keep_one(make([])).count() == 0
    assert [tuple(r) for r in J.jaccard_components(make([(4, None)])).collect()] == [(4, 0, 4)]


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    compare(rows, J.jaccard_components(documents(spark, sf)).collect())


def test_rows_without_id_or_with_a_shared_one(make):
    words = [f"w{k}" for k in range(40)]
    near, other, third = " ".join(words), " ".join(reversed(words)), " ".join(sorted(words))
    rows = [(None, f"{near} end"), (None, near), (8, near), (None, other), (None, f"{other} end"), (None, other), (None, ""), (None, None), (None, "")]
    rows += [(3, third), (3, f"{third} end"), (3, "quite another text of seven words here"), (3, ""), (3, ""), (4, third), (3, third)]
    got = [(r.doc_id, r.text) for r in J.keep_one(make(rows)).collect()]
    assert sorted(i or 0 for i, _ in got) == [0, 0, 0, 0, 3, 3, 3, 3, 8] and (8, near) in got
    assert len({t for i, t in got if i is None and t} & {other, f"{other} end"}) == 1
    assert len({t for i, t in got if i == 3} & {third, f"{third} end"}) == 1 and (3, "quite another text of seven words here") in got
