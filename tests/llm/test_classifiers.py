import math
import re
import zlib

import numpy as np
import pytest

from allelith.llm import quality as Q
from allelith.llm import toxicity as T
from allelith.llm.common import documents, table

LABELS = "doc_id long, quality int, toxic int"


def held_out(rows, label):
    return [(r, label[r.doc_id]) for r in rows if r.doc_id in label]


def test_toxicity_on_rows_it_did_not_see(spark, sf01):
    labels = table(spark, sf01, "labels")
    y = {r.doc_id: r.toxic for r in labels.collect()}
    seen = labels.where("doc_id % 3 <> 0")
    got = T.toxicity(documents(spark, sf01), seen).collect()
    assert len(got) == documents(spark, sf01).count()
    unseen = [(r, t) for r, t in held_out(got, y) if r.doc_id % 3 == 0]
    assert np.mean([r.toxic == t for r, t in unseen]) > 0.93
    assert all(0 <= r.severity <= T.GRADES - 1 for r in got)
    assert np.mean([r.severity for r, t in unseen if t]) > 1 > np.mean([r.severity for r, t in unseen if not t])


def test_quality_on_held_out_rows(spark, sf01):
    y = {r.doc_id: r.quality for r in table(spark, sf01, "labels").collect()}
    got = Q.quality(documents(spark, sf01), table(spark, sf01, "labels")).collect()
    unseen = [(r, t) for r, t in held_out(got, y) if r.held_out]
    assert len(unseen) > 50 and np.mean([r.predicted == t for r, t in unseen]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_pairs_by_squares_equal_pairs_one_by_one():
    rng = np.random.default_rng(0)
    m = Q.Machine(0.3, rng.normal(size=9), rng.normal(size=(9, Q.RANK)), np.zeros((0, 0)))
    cols, x = np.array([1, 4, 5, 8]), rng.normal(size=4)
    pairs = sum(m.v[a] @ m.v[b] * x[i] * x[j] for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j)
    assert np.isclose(m.logit(cols, x), 0.3 + m.w[cols] @ x + pairs)


def test_ordinal_cuts_are_ordered_and_shared_weights_rank_grades():
    rng = np.random.default_rng(2)
    lists, toxic = [], []
    for i in range(900):
        bad = i % 3 == 0
        lists.append(np.unique(np.concatenate([rng.integers(50, 400, 30), rng.integers(0, 10, 1 + i % 4) if bad else []]).astype(np.int64)))
        toxic.append(int(bad))
    m = T.fit(lists, np.array(toxic), np.arange(900) % 5 == 0)
    assert list(m.cuts) == sorted(m.cuts)
    z = np.array([sum(m.weights.get(int(b), 0) for b in x) for x in lists])
    assert ((m.above(z)[:, 0] >= m.reject_at) == np.array(toxic)).mean() > 0.99
    assert np.isclose(m.above(z).sum(axis=1), (m.above(z) * 1).sum(axis=1)).all() and (np.diff(m.above(z), axis=1) <= 0).all()


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (2, ""), (None, "x y"), (3, "a " * 30_000)]])
def test_odd_rows(spark, make, rows):
    for labels in ([], [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, None), (None, 1, 1)]):
        lab = spark.createDataFrame(labels, LABELS)
        assert T.toxicity(make(rows), lab).count() == len(rows)
        got = Q.quality(make(rows), lab).collect()
        assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, _ in rows)
        kept = T.keep_clean(make(rows), lab)
        assert kept.columns == make(rows).columns and kept.count() <= len(rows)


def test_severities_equal_the_sum_over_thresholds(spark, sf):
    """Each text's features one by one, the chance of every grade, and the mean grade."""
    docs, model = documents(spark, sf), T.fit_toxicity(documents(spark, sf), table(spark, sf, "labels"))
    got = {r.doc_id: r for r in T.score_toxicity(docs, model).collect()}
    for r in docs.collect():
        count = {}
        for w in re.findall(r"\w+", (r.text or "").lower()):
            for part in [w] + ["^" + w[:k] for k in (4, 5) if len(w) > k]:
                count[part] = count.get(part, 0) + 1
        held = {zlib.crc32(f"{p} {k}".encode()) % T.DIMS for p, n in count.items() for k in (1, 2, 3) if n >= k}
        z = sum(model.weights.get(b, 0.0) for b in held)
        upto = [1 / (1 + math.exp(-max(-35, min(35, c - z)))) for c in model.cuts] + [1.0]
        chance = [b - a for a, b in zip([0.0, *upto[:-1]], upto, strict=True)]
        assert math.isclose(got[r.doc_id].severity, sum(k * p for k, p in enumerate(chance)), abs_tol=1e-6)
        assert got[r.doc_id].toxic == (1 - upto[0] >= model.reject_at) and min(chance) > -1e-9


def test_scores_equal_all_pairs_of_features(spark, sf):
    docs, model = documents(spark, sf), Q.fit_quality(documents(spark, sf), table(spark, sf, "labels"))
    got = {r.doc_id: r for r in Q.score_quality(docs, model).collect()}
    buckets = Q.Buckets(Q.DIMS)
    for r in sorted(docs.collect(), key=lambda r: r.doc_id)[:40]:
        cols, vals, stats = Q.features(r.text or "", buckets)
        x = dict(zip(cols, vals, strict=True)) | {int(c): Q.BIN_SCALE for c in Q.binned(np.array(stats), model.edges)}
        z = model.w0 + sum(model.w[c] * v for c, v in x.items())
        names = list(x)
        for a, i in enumerate(names):
            if a + 1 < len(names):
                z += float((model.v[names[a + 1 :]] @ model.v[i]) @ np.array([x[j] for j in names[a + 1 :]])) * x[i]
        assert math.isclose(got[r.doc_id].score, 1 / (1 + math.exp(-(z + model.shift))), abs_tol=1e-6)


def test_the_machines_gradient_is_that_of_its_loss():
    """One step of the fit on one row moves each parameter against the slope of the loss, as found by small differences."""
    rng = np.random.default_rng(4)
    cols, vals, y = np.array([0, 2, 3]), rng.normal(size=3), np.array([1.0, 0.0])
    xs = [(cols, vals), (np.array([1, 2]), rng.normal(size=2))]
    start = Q.fit(xs, y, 4, epochs=0)
    after = Q.fit(xs, y, 4, epochs=1, l2=0.0)
    loss = lambda m: sum(math.log1p(math.exp(-z)) if t else math.log1p(math.exp(z)) for (c, v), t in zip(xs, y, strict=True) for z in [m.logit(c, v)]) / 2
    for name in ("w", "v"):
        p = getattr(start, name)
        for at in np.ndindex(p.shape):
            p[at] += 1e-5
            up = loss(start)
            p[at] -= 2e-5
            slope = (up - loss(start)) / 2e-5
            p[at] += 1e-5
            if abs(slope) > 1e-4:
                assert np.sign(getattr(after, name)[at] - p[at]) == -np.sign(slope), (name, at)
