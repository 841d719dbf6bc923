"""Secret scan: an Aho-Corasick automaton finds keywords, anchored expressions run only where one hit, checksums confirm.

Base kinds (assign, access, hex) follow their given expressions: leftmost non-overlapping matches per kind, matches
that fail a length rule are dropped without retry. The method adds provider tokens whose last characters are a
checksum of the rest, so a string that only looks like a token is not reported. Offsets are code points.

Defined cases: a null text counts as empty; an empty text has no spans; repeated rows each give a row.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from .common import id_text

#: Kinds in the order in which spans with one start are listed.
BASE_KINDS = ("assign", "access", "hex")
TOKEN_KINDS = ("token",)
#: Keywords of an assignment, lower case.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Prefixes of tokens that end in six base-62 digits of the CRC-32 of the thirty before them.
TOKEN_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_token long"


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out.rjust(width, "0")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("token", TOKEN_PREFIXES)):
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def scan(text: str, keywords: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every base and added span, by start, then kind."""
    # ASCII letters alone are lowered, so that positions stay those of the text
    low = text.lower() if text.isascii() else text.encode().lower().decode()
    spans, over = [], dict.fromkeys(("assign", "access", "token"), 0)
    starts = sorted({(end - n + 1, kind) for end, (kind, n) in keywords.iter(low)})
    for at, kind in starts:
        if at < over[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                over[kind] = m.end()
                if m.end() - m.start(1) >= 6:
                    spans.append((kind, at, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                over[kind] = m.end()
                if m.end() - at >= 20:
                    spans.append((kind, at, m.end()))
        elif (m := TOKEN.match(text, at)) and base62(zlib.crc32(m[1].encode()), 6) == m[2]:
            over[kind] = m.end()
            spans.append((kind, at, m.end()))
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    order = {k: i for i, k in enumerate(BASE_KINDS + TOKEN_KINDS)}
    return sorted(spans, key=lambda s: (s[1], order[s[0]]))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row for each document; spans lists base and checksum-confirmed spans, base_sha256 the base ones alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keywords = automaton()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                spans = scan(text, keywords) if text else []
                n = [sum(s[0] == k for s in spans) for k in BASE_KINDS + TOKEN_KINDS]
                base = [s for s in spans if s[0] in BASE_KINDS]
                out.append((doc_id, *n[:3], hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), n[3]))
            yield pd.DataFrame(out, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_token"]).astype({"doc_id": "Int64"})

    return id_text(docs).mapInPandas(run, SCHEMA)
