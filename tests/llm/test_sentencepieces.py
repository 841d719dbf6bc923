import hashlib
import random

import sentencepiece

from allelith.llm import sentencepieces as S
from allelith.llm.common import documents

CODEC = S.Codec(S.model_bytes())


def whole(text):
    """The best path of the whole marked text at once, with all back pointers."""
    if not text:
        return []
    v, t = CODEC.v, S.MARK + text.replace(" ", S.MARK)
    best = [(0.0, 0, -1)] + [None] * len(t)
    for a in range(len(t)):
        ends = [e for e in range(a + 1, min(len(t), a + v.longest) + 1) if t[a:e] in v.pieces]
        for e, (score, i) in [(e, v.pieces[t[a:e]]) for e in ends] + ([] if a + 1 in ends else [(a + 1, (v.unknown, -1))]):
            if best[e] is None or best[a][0] + score > best[e][0]:
                best[e] = (best[a][0] + score, a, i)
    out, e = [], len(t)
    while e:
        _, a, i = best[e]
        out.append([i] if i >= 0 else v.fallback(t[a:e]))
        e = a
    return [i for part in reversed(out) for i in part]


def test_streaming_equals_whole_search():
    rng = random.Random(1)
    for n in (0, 1, 5, 40, 300, 3000):
        for alphabet in ("abc e", "the ing of\n", "aé世😀 \t", "aaaa", "- ="):
            t = "".join(rng.choice(alphabet) for _ in range(n))
            assert CODEC.encode(t).tolist() == whole(t), (n, alphabet)
            marked = S.MARK + t.replace(" ", S.MARK)
            assert [i for ids, _, _ in S.search(marked, CODEC.v) for i in ids] == (whole(t) or [i for ids, _, _ in S.search(S.MARK, CODEC.v) for i in ids])
            assert CODEC.decode(CODEC.encode(t).tolist()) == t


def test_window_stays_small():
    parts = list(S.search("abcdefgh" * 4000, CODEC.v))
    assert len(parts) > 100 and max(len(ids) for ids, _, _ in parts) < 400
    assert [end for _, end, _ in parts] == sorted({end for _, end, _ in parts}) and parts[-1][1] == 32_000
    assert max(held for _, _, held in parts) <= 16 * CODEC.v.longest


def test_documents_are_committed_where_paths_meet(spark, sf):
    """Over real texts: the search over whole texts, with no memory, commits at each place that memory relies on, gives its
    ids, and never holds back more than a few of the longest piece's lengths."""
    rows = {r.doc_id: r.text for r in documents(spark, sf).collect()}
    got = {r.doc_id: r for r in S.encode_decode(documents(spark, sf)).collect()}
    commits = chars = 0
    for i, text in rows.items():
        marked = S.MARK + (text or "").replace(" ", S.MARK)
        found = list(S.search(marked, CODEC.v)) if text else []
        assert [x for ids, _, _ in found for x in ids] == got[i].ids
        ends, at = {end for _, end, _ in found}, 0
        for stretch in CODEC.v.stretch.findall(marked) if text else ():
            at += len(stretch)
            assert at in ends
        assert got[i].n_commits == len(found) and got[i].peak_window == max((held for _, _, held in found), default=0)
        commits, chars = commits + len(found), chars + len(marked)
    assert commits > chars / 20 and max(r.peak_window for r in got.values()) <= 16 * CODEC.v.longest


def test_memory_gives_what_the_search_gives():
    memory = S.Memory(CODEC.v, 40)
    words = ["\u2581" + w for w in ("streaming", "a", "Viterbi", "x" * 100, "streaming", "boundary", "a")]
    for w in words * 3:
        found = list(S.search(w, CODEC.v))
        assert S.ids_of([memory[w]]).tolist() == [i for ids, _, _ in found for i in ids]
        assert memory[w][1:] == (len(found), max(held for _, _, held in found))
        assert memory.chars == sum(map(len, memory)) <= 20 and sum(map(len, memory.older)) <= 20


def test_agrees_with_the_library_search_over_the_same_pieces(spark, sf):
    # the file's own type merges pairs; switched to the unigram type, the library runs its Viterbi search over the same scores
    proto = S.model_bytes()
    assert proto.count(b"\x18\x02 \x80\xfa\x01") == 1
    lib = sentencepiece.SentencePieceProcessor(model_proto=proto.replace(b"\x18\x02 \x80\xfa\x01", b"\x18\x01 \x80\xfa\x01"))
    score = lambda ids: sum(lib.get_score(i) for i in ids)
    seen = 0
    for word in sorted({w for r in documents(spark, sf).limit(60).collect() for w in r.text.split()})[:600]:
        if len(word) <= 9:
            # the first of several best paths is the lattice's own best
            assert score(lib.nbest_encode(word, nbest_size=2)[0]) == score(CODEC.encode(word).tolist()), word
            seen += 1
    assert seen > 100
    full = sentencepiece.SentencePieceProcessor(model_proto=proto)
    assert full.decode(CODEC.encode("Hé\n  lo 世😀").tolist()) == "Hé\n  lo 世😀"


def test_rows(make):
    rows = [(1, None), (2, ""), (3, " a  b\n"), (3, " a  b\n"), (None, "x"), (4, "w " * 20_000), (5, "q" * 30_000), (6, f"a{S.MARK}b")]
    got = S.encode_decode(make(rows)).collect()
    assert len(got) == len(rows)
    for (i, t), r in zip(rows, got, strict=True):
        assert r.doc_id == i and r.n_tokens == len(r.ids) and r.ids == CODEC.encode(t or "").tolist()
        assert r.round_trip == (i != 6)
        if i != 6:
            assert r.text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    back = {(r.doc_id, r.text) for r in S.decode(S.encode_decode(make(rows))).collect()}
    assert (3, " a  b\n") in back and (6, "a b") in back
    assert S.encode_decode(make([])).count() == 0
