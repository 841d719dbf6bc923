"""The pipeline against its stages done the plain way, one after the other."""

import random

import corpus_pipeline as P
from pyspark.sql import functions as F

from allelith.llm import decontamination as D
from allelith.llm import linededup as L
from allelith.llm import sentencepieces as S
from allelith.llm import toxicity as T
from allelith.llm.common import documents, table

from .test_decontamination import nearest
from .test_setjoin import brute as components
from .test_setjoin import shingles


def test_stages_equal_plain_ones(spark, sf):
    docs = documents(spark, sf)
    rows = {r.doc_id: r.text for r in docs.collect()}
    rejected = {r.doc_id for r in T.toxicity(docs, table(spark, sf, "labels")).where("toxic = 1").collect()}
    rows = {i: t for i, t in rows.items() if i not in rejected}
    # an equal document is a run of lines that all occurred before
    kept = docs.where(F.col("doc_id").isin(*rows))
    left = {r.doc_id: r for r in L.line_dedup(kept).collect()}
    rows = {i: r.text for i, r in left.items() if not r.n_deleted or r.text.strip(" \n")}
    comp = components(list(rows.items()))
    rows = {i: t for i, t in rows.items() if comp[i] == i or not shingles(t)}
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    held = {i for i, t in rows.items() if holds(D.normal(t or ""), items)}
    codec = S.Codec(S.model_bytes())
    got = {r.doc_id: r for r in P.run(spark, sf).collect()}
    assert set(got) == set(rows) - held and len(held) > 0
    for i, r in got.items():
        assert r.ids == codec.encode(rows[i] or "").tolist() and codec.decode(r.ids) == (rows[i] or "")


def holds(text, items):
    """Whether a text holds a window of an item, by the edit table; windows that share fewer q-grams with it than any region
    within their edits would are passed over, as the lemma allows."""
    grams = {text[i : i + D.Q] for i in range(len(text) - D.Q + 1)}
    flags = {}
    for w in D.windows(items):
        if len(w.text) < D.LEAST:
            raise AssertionError("short items need another yardstick")
        if w.item not in flags:
            item = D.normal(dict(items)[w.item])
            flags[w.item] = [item[i : i + D.Q] in grams for i in range(len(item) - D.Q + 1)]
        shared = [w.start + i for i in range(len(w.text) - D.Q + 1) if flags[w.item][w.start + i]]
        if len(shared) < w.least:
            continue
        if w.text in text or any(nearest(w.text, text[max(0, at - len(w.text) - w.edits) : at + 2 * len(w.text) + w.edits]) <= w.edits for at in places(text, dict(items)[w.item], shared)):
            return True
    return False


def places(text, item, shared):
    """Where in the text one of these q-grams of the item is found, each stretch of them once."""
    item, out = D.normal(item), []
    for s in shared:
        at = text.find(item[s : s + D.Q])
        while at >= 0:
            if not any(abs(at - o) < 20 for o in out):
                out.append(at)
            at = text.find(item[s : s + D.Q], at + 1)
    return out


def edited(rng, words, n):
    """A copy with n words changed, which has so many shingles less in common at most five times over."""
    words = list(words)
    for k in rng.sample(range(len(words)), n):
        words[k] = f"changed{k}"
    return words


def test_near_copies_on_the_stages_own_input(spark, make, sf01):
    """Recall of planted near copies in what line dedup leaves: of pairs at a similarity of 0.8 and more, by the definition, all."""
    rng = random.Random(8)
    texts = sorted((r.doc_id, r.text) for r in documents(spark, sf01).collect() if r.text and 60 <= len(r.text.split()) <= 600)[:80]
    rows, pairs = [], []
    for k, (_, t) in enumerate(texts):
        # other line breaks, so that line dedup takes none of the copy away
        copy = " ".join(edited(rng, t.split(), rng.randint(0, max(1, len(t.split()) // 40))))
        rows += [(2 * k, t), (2 * k + 1, copy)]
        pairs.append((2 * k, 2 * k + 1))
    left = {r.doc_id: r.text for r in L.keep_first_lines(make(rows)).collect()}
    a = {i: shingles(t) for i, t in left.items()}
    linked = [(i, j) for i, j in pairs if i in a and j in a and 100 * len(a[i] & a[j]) >= 80 * len(a[i] | a[j])]
    kept = {r.doc_id for r in P.near_duplicates(spark, make(sorted(left.items())), "").collect()}
    assert len(linked) > 30 and all(len({i, j} & kept) < 2 for i, j in linked)
    clean = [i for i, j in pairs if (i, j) not in linked and i in left]
    comp = components(sorted(left.items()))
    assert kept == {i for i in left if comp[i] == i or not a[i]} and all(i in kept for i in clean if comp[i] == i)


def test_stages_keep_the_columns_and_odd_rows(spark, make, sf):
    rows = [(1, None), (2, ""), (3, "x"), (None, "y z"), (4, "x"), (5, "word " * 30_000)]
    for name, stage in P.STAGES[:-1]:
        for some in (rows, []):
            got = stage(spark, make(some), sf)
            assert got.columns == make(some).columns, name
            n = got.count()
            assert n == 0 if not some else n >= 4
    assert P.STAGES[-1][1](spark, make(rows), sf).count() == len(rows)
