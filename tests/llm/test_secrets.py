import hashlib
import re
import zlib

from allelith.llm import secrets as S
from allelith.llm.common import documents

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans, key=lambda s: (s[1], S.BASE_KINDS.index(s[0])))


GOOD = "ghp_" + "a1B2c3D4e5" * 3
GOOD += S.base62(zlib.crc32(GOOD[4:].encode()), 6)
CASES = [
    None, "", "password=secret=token=abcdef", "PassWord : 'hunter22' api_key=\"abc\" apikey = xyzxyz", "tokentoken=123456",
    "ſecret=abcdef toKen=abcdef İ password=abcdefg", "AKIAAKIA" + "A" * 20, "akia" + "A" * 20, "f" * 23 + " " + "0" * 24, "x" * 50_000 + " token=" + "a" * 50_000,
    f"é {GOOD} {GOOD[:-1]}x", "password=" * 2000, "secret" * 3000 + "=abcdef",
]


def test_cases_equal_brute_force(make):
    rows = list(enumerate(CASES)) + [(2, CASES[2]), (None, "token=abcdef")]
    got = S.find_secrets(make(rows)).collect()
    assert len(got) == len(rows)
    for (i, t), r in zip(rows, got, strict=True):
        base = brute(t)
        assert (r.doc_id, r.n_assign, r.n_access, r.n_hex) == (i, *(sum(s[0] == k for s in base) for k in S.BASE_KINDS)), t[:80]
        assert r.base_sha256 == hashlib.sha256(S.listed(base).encode()).hexdigest()
        assert {S.listed([s]) for s in base} <= set(r.spans.split(","))
    assert got[10].n_token == 1
    assert S.find_secrets(make([])).count() == 0


def test_documents_equal_brute_force(spark, sf01):
    rows = {r.doc_id: r.text for r in documents(spark, sf01).collect()}
    got = S.find_secrets(documents(spark, sf01)).collect()
    assert len(got) == len(rows)
    assert all(r.base_sha256 == hashlib.sha256(S.listed(brute(rows[r.doc_id])).encode()).hexdigest() for r in got)
    assert sum(r.n_assign for r in got) > 0
