import random

import pyarrow as pa

from allelith.llm import decontamination as D
from allelith.llm.common import documents, table


def nearest(p, t):
    """Fewest edits between p and any region of t, by the whole table."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(docs, items):
    out = {}
    for i, t in dict.fromkeys(docs):
        for w in D.windows(items):
            e = nearest(w.text, D.normal(t or ""))
            if e <= w.edits:
                n, least = out.get((i, w.item), (0, 99))
                out[i, w.item] = (n + 1, min(least, e))
    return out


def edited(rng, s, n):
    for _ in range(n):
        k = rng.randrange(len(s))
        s = rng.choice([s[:k] + s[k + 1 :], s[:k] + rng.choice("abcé ") + s[k:], s[:k] + "x" + s[k + 1 :]])
    return s


def test_regions_equal_brute_force(spark, make):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(1, text(12)), (2, text(30)), (3, text(60)), (4, "short"), (5, None), (2, "é" * 30 + text(10)), (7, "z" * 120)]
    real = [(i, t) for i, t in items if t]
    docs = [(0, None), (1, ""), (2, text(50))]
    for k in range(3, 40):
        i, t = rng.choice(real)
        docs.append((k, f"{text(rng.randint(0, 20))} {edited(rng, t.upper() if k % 3 else t, rng.randint(0, 14))}\n{text(rng.randint(0, 20))}"))
    docs += [(40, items[1][1][20:125]), (41, items[2][1][:99]), (41, items[2][1][:99]), (42, "z" * 5000), (43, f"é {items[1][1]}")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated(make(docs), bench).collect()
    want = brute(docs, real)
    assert {(r.doc_id, r.item_id): (r.n_windows, r.edits) for r in got} == want and len(want) > 20
    assert sum(r.doc_id == 41 for r in got) == 2 * ((41, 3) in want)
    r = next(r for r in got if (r.doc_id, r.item_id) == (43, 2))
    assert (r.start, r.end) == (2, 2 + len(items[1][1]))
    kept = D.keep_uncontaminated(make(docs), bench)
    assert kept.columns == make(docs).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in {k[0] for k in want})
    # in slices, one after the other
    assert sorted(map(str, D.contaminated(make(docs), bench, 200).collect())) == sorted(map(str, got))
    assert sorted(r.doc_id for r in D.keep_uncontaminated(make(docs), bench, 200).collect()) == sorted(r.doc_id for r in kept.collect())
    assert D.contaminated(make([]), bench).count() == 0 and D.contaminated(make(docs), bench.limit(0)).count() == 0
    assert [len(x) for x in D.slices(bench, 200)] != [6] and sum(len(x) for x in D.slices(bench, 200)) == 6


def test_chunks_and_rows_meet_no_seams():
    item = [(1, "the quick brown fox jumps over the lazy dog and runs away from the angry bear")]
    index, old = D.Index(D.windows(item)), D.CHUNK
    texts = pa.array(["x" * 30 + item[0][1], None, item[0][1][:60], item[0][1][60:]])
    want = list(D.search(texts, index))
    D.CHUNK = 16
    try:
        assert list(D.search(texts, index)) == want and [w[0] for w in want] == [0]
        assert list(D.search(texts.slice(1), index)) == []
    finally:
        D.CHUNK = old


def test_documents_with_whole_items(spark, sf01):
    items = {r.item_id: r.text for r in table(spark, sf01, "benchmark").collect()}
    whole = {(r.doc_id, i) for r in documents(spark, sf01).collect() for i, t in items.items() if t in r.text}
    got = {(r.doc_id, r.item_id) for r in D.contaminated(documents(spark, sf01), table(spark, sf01, "benchmark")).collect()}
    assert whole and whole <= got and len(got) < 1.1 * len(whole) + 3


def test_passages_of_one_window_are_found_at_any_offset():
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 8))) for _ in range(n))
    items = [(i, text(rng.randint(30, 60))) for i in range(8)]
    index, rows = D.Index(D.windows(items)), []
    for k in range(160):
        i = rng.randrange(8)
        b = D.normal(items[i][1])
        at = rng.randrange(len(b) - D.WINDOW + 1)
        cut = bytearray(b[at : at + D.WINDOW])
        for _ in range(k % 3 * 4):  # as many edits as a window may hold, at most
            cut[rng.randrange(len(cut))] = ord("x")
        rows.append(f"{text(5)} ".encode() + bytes(cut) + f" {text(5)}".encode())
    raw = pa.array(rows, pa.binary())
    texts = pa.Array.from_buffers(pa.string(), len(raw), raw.buffers())  # cuts within a letter too
    assert {d for d, *_ in D.search(texts, index)} == set(range(len(rows)))


def test_short_items_are_found_verbatim(spark, make):
    bench = spark.createDataFrame([(1, "What is  2+2?"), (2, "Où est Zoé"), (3, " a\n"), (4, " \n"), (5, ""), (6, "Où est Zoé"), (7, "x" * (D.LEAST - 1))], "item_id long, text string")
    docs = [
        (1, "so: WHAT is  2+2? yes"), (2, "what is 2+2?"), (3, "what is  2+2"), (4, "“Où est Zoé”"), (5, "Où est Zoéé"), (6, "éOù est Zoé"), (7, "Où est Zoé"), (8, "such b-a-b"),
        (9, "bad cat"), (10, "Où est Zoe"), (11, "x" * D.LEAST), (12, "_" + "x" * (D.LEAST - 1)), (13, None), (14, ""), (15, "a"), (16, "Où est"), (17, " Zoé"),
    ]
    want = {(1, 1, 4, 17), (4, 2, 1, 11), (4, 6, 1, 11), (7, 2, 0, 10), (7, 6, 0, 10), (8, 3, 7, 8), (12, 7, 1, D.LEAST), (15, 3, 0, 1)}
    got = D.contaminated(make(docs).coalesce(1), bench).collect()
    assert {(r.doc_id, r.item_id, r.start, r.end) for r in got} == want and {(r.n_windows, r.edits) for r in got} == {(1, 0)}
    assert sorted(r.doc_id for r in D.keep_uncontaminated(make(docs), bench).collect()) == sorted({i for i, _ in docs} - {w[0] for w in want})


def test_short_items_meet_no_chunk_seams(monkeypatch):
    index, rows = D.Index(D.windows([(1, "big dog")])), ["a big dog", "big", " dog", "a big dogs", "the big dog big dog"]
    want = [(0, 2, 9), (4, 4, 19)]
    for chunk in (1, 2, 3, 16, 1 << 20):
        monkeypatch.setattr(D, "CHUNK", chunk)
        D.powers.cache_clear()
        assert [(d, r[0][0], r[-1][1]) for d, x, n, r in D.search(pa.array(rows), index)] == want, chunk


def test_every_region_is_returned(spark, make):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 8))) for _ in range(n))
    item, far = text(50), text(60)
    part, other = item[40:200], edited(rng, item[90:250], 3)
    bench = spark.createDataFrame([(1, item), (2, "short one")], "item_id long, text string")
    parts = [text(20), part, f" {text(1)}", part, far, item, f"{text(4)} ", item, text(9), other, "é short one", " and Short one"]
    body, at = "", []
    for p in parts:
        at.append(len(body))
        body += p
    rows = {r.item_id: r for r in D.contaminated(make([(5, body), (6, text(90)), (7, "z " + part)]), bench).where("doc_id = 5").collect()}
    got, want = [(r.start, r.end, r.edits) for r in rows[1].regions], [(at[k], at[k] + len(parts[k])) for k in (1, 3, 5, 7, 9)]
    assert len(got) == 5 and got[2:4] == [(*w, 0) for w in want[2:4]]
    assert all(abs(s - a) < 17 and abs(z - b) < 17 for (s, z, _), (a, b) in zip(got, want, strict=True))
    assert [e for *_, e in got[:4]] == [0] * 4 and got[4][2] <= 6 and all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))
    assert (rows[1].start, rows[1].end, rows[1].edits) == got[0]
    assert [(r.start, r.end, r.edits) for r in rows[2].regions] == [(at[10] + 2, at[11], 0), (at[11] + 5, len(body), 0)]
