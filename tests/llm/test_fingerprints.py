import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from allelith.llm import fingerprints as P
from allelith.llm.common import documents


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return 1.0 if not a | b else len(a & b) / len(a | b)


def check(rows, got, hashes):
    order = sorted(rows, key=lambda r: (-r[0] if r[0] is not None else 1 << 62, hashes[r[1]]))
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        n = len(t)
        edited = t[: n - n // 2] + nxt[: n // 2]
        want.append((str(i), n, hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(want) == sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got)
    return order


def hashed(spark, texts):
    return {t: h for t, h in spark.createDataFrame([(t,) for t in set(texts)], "t string").select("t", F.xxhash64("t")).collect()}


def test_cases(spark, make, monkeypatch):
    monkeypatch.setattr(P, "RANGE_ROWS", 4)
    monkeypatch.setattr(P, "GROUP", 3)
    rng = random.Random(3)
    rows = [(i * 7 - 100, " ".join(rng.choice("aé b c世 d") * rng.randint(1, 4) for _ in range(rng.randint(0, 60)))) for i in range(70)]
    rows += [(-100, "same id"), (-100, "same id"), (None, "x"), (None, ""), (400, "a b c d e f " * 4000), (400, "tie"), (12, " \t\n")]
    got = P.fingerprints(make(rows + [(13, None)])).collect()
    rows += [(13, "")]
    check(rows, got, hashed(spark, [t for _, t in rows]))
    assert all(len(r.fingerprint) in (0, P.BINS // 4 * 4) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert P.fingerprints(make([])).count() == 0
    one = P.fingerprints(make([(1, "abcd efgh")])).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcd abcd").hexdigest()


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect()]
    got = P.fingerprints(documents(spark, sf)).collect()
    order = check(rows, got, hashed(spark, [t for _, t in rows]))
    by, text = {r.doc_id: r for r in got}, dict(rows)
    same = {}
    for i, t in rows:
        assert same.setdefault(t, by[i].fingerprint) == by[i].fingerprint
    errors = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        errors.append(by[i].near_next - jaccard(t, nxt))
        errors.append(by[i].near_edited - jaccard(t, t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]))
    assert np.sqrt(np.mean(np.square(errors))) < 0.05 and abs(np.mean(errors)) < 0.02


def test_likeness_is_unbiased_also_for_few_shingles(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(300):
        w = [str(rng.random()) for _ in range(26)]
        v = w[: rng.randint(6, 26)] + [str(rng.random()) for _ in range(rng.randint(0, 9))]
        rows.append((" ".join(w), " ".join(v)))
    got = spark.createDataFrame(rows, "a string, b string").select(P.likeness(P.fingerprint(F.col("a")), P.fingerprint(F.col("b"))).alias("x")).collect()
    errors = np.array([g.x - jaccard(*r) for g, r in zip(got, rows, strict=True)])
    assert abs(errors.mean()) < 0.03 and errors.std() < 0.12


def mixed(*values, seed=42):
    """The engine's 64-bit hash of several values in turn."""
    for kind, v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if kind == "s" else v.to_bytes(8 if kind == "l" else 4, "little", signed=True), seed)
        seed = seed  # the next value's seed
    return seed - (1 << 64) if seed >> 63 else seed


def by_hand(text):
    """The fingerprint by its definition, a shingle and a bin at a time."""
    words = [mixed(("s", w)) for w in re.findall(r"[^\x20\x09-\x0D]+", text.lower())]
    hashes = [mixed(*(("l", x) for x in words[i : i + 5])) for i in range(len(words) - 4)] if len(words) >= 5 else [mixed(*(("l", x) for x in words))] if words else []
    if not hashes:
        return ""
    least = {}
    for h in hashes:
        b = (h >> 57) + 64
        least[b] = min(h, least.get(b, h))
    digits = []
    for b in range(P.BINS):
        probes = [b, *(mixed(("i", b), ("i", k)) % P.BINS for k in range(P.PROBES))]
        near = min(least, key=lambda x: (mixed(("i", b), ("i", x), ("i", -1)), x))
        digits.append(mixed(("l", least[next((p for p in probes if p in least), near)]), ("i", b)) & 15)
    return "".join(f"{d:X}" for d in digits)


def test_fingerprints_equal_those_made_by_hand(spark, make, sf):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf).collect() if r.text and r.text.isascii()][:60]
    rows += [(10_000 + n, " ".join(f"w{k}" for k in range(n))) for n in (0, 1, 4, 5, 6, 40, 900)]
    got = {r.doc_id: r.fingerprint for r in P.fingerprints(make(rows)).collect()}
    for i, t in rows:
        assert got[i] == by_hand(t), (i, t[:60])
