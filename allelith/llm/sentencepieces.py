"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The best segmentation is the one with the largest sum of piece scores; ties go to the earlier start of the last piece
that differs. There is one search, `search`, for all text. It reads the text once and keeps scores and back pointers from
the last committed boundary to the farthest end of a piece begun so far, which is the longest piece's length ahead at
most. Once all paths that can still win run through one boundary, the ids before it are committed and everything up to
it is dropped: at once if no piece reaches beyond the place read, else after walking the open ends back until they meet.
Paths that never meet (one letter repeated) keep their back pointers, and no more than that, until they do.

The search restarts with a clean state at each place where nothing reaches beyond. No piece of the vocabulary spans the
place before a run of word marks, or holds a character of `apart`, so such places are sure to be met there, whatever
follows; what the search committed from one of them to the next is remembered per worker, by the text between them and up
to MEMO_CHARS characters of it. `n_commits` and `peak_window` report of each text how often paths met and the most
characters that were ever held back.

A character that no piece matches becomes its UTF-8 bytes, each a byte piece. A blank is written as a word mark, and
one mark is put before the text, as the vocabulary file asks for; decoding undoes both.

The vocabulary file is read on the driver and sent along (it is of fixed size). Defined cases: null and empty texts
have no ids, no commits and decode to the empty text; a text that holds the word mark itself decodes to a blank there, as
the format has it (round_trip is then false); repeated rows each give a row; of other columns only doc_id and text are
read, so that names can't clash.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Remembered stretches hold so many characters at most.
MEMO_CHARS = 10_000_000
SCHEMA = "doc_id long, n_tokens int, ids array<int>, text_sha256 string, round_trip boolean, n_commits int, peak_window int"


FIRST, SECOND, THIRD = itemgetter(0), itemgetter(1), itemgetter(2)


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = m.get_piece_size()
        plain = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        names = {i: m.id_to_piece(i) for i in range(n)}
        self.pieces = {names[i]: (float(m.get_score(i)), i) for i in plain}
        self.unknown = min(x[0] for x in self.pieces.values()) - 10.0
        self.bytes_ = {int(names[i][3:5], 16): i for i in range(n) if m.is_byte(i)}
        self.unk_id = m.unk_id()
        self.surface = [b""] * n
        for i in plain:
            self.surface[i] = names[i].replace(MARK, " ").encode()
        for b, i in self.bytes_.items():
            self.surface[i] = bytes([b])
        self.longest = max(map(len, self.pieces))
        # character -> (the same for what may follow, score of the piece that ends here or None, its id)
        self.tree: dict[str, tuple[dict, float | None, int]] = {}
        for p, (score, i) in self.pieces.items():
            node = self.tree
            for c in p[:-1]:
                if c not in node:
                    node[c] = ({}, None, -1)
                node = node[c][0]
            node[p[-1]] = (node[p[-1]][0] if p[-1] in node else {}, score, i)
        alphabet = set("".join(self.pieces))
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("pieces of this vocabulary span word boundaries")
        apart = "".join(re.escape(c) for c in map(chr, range(128)) if c not in alphabet and c != MARK)
        self.stretch = re.compile(f"{MARK}+[^{MARK}{apart}]*|[^{MARK}{apart}]+" + (f"|[{apart}]" if apart else ""))

    def fallback(self, c: str) -> list[int]:
        return [self.bytes_.get(b, self.unk_id) for b in c.encode("utf-8", "surrogatepass")]


def search(text: str, v: Vocabulary) -> Iterator[tuple[list[int], int, int]]:
    """(ids, end, held) of each commit: the ids up to the boundary `end` at which all paths that can still win have met, and the
    most characters held back for it."""
    n, longest, tree, unknown, worst = len(text), v.longest, v.tree, v.unknown, float("-inf")
    done = 0
    while done < n:
        # by place from the committed boundary `done` on: best score, start of the last piece, its id or -1 for a character of its own
        size = min(n - done, 4 * longest)
        score, back, piece = [worst] * (size + 1), [0] * (size + 1), [-1] * (size + 1)
        score[0], at, reach, held = 0.0, 0, 0, 0
        while True:
            if at + longest > size and done + size < n:
                # the ends of paths that are open are walked back until they meet; what is before is committed and dropped
                heads = {p for p in range(at, reach + 1) if score[p] > worst}
                held = max(held, reach)
                while len(heads) > 1:
                    last = max(heads)
                    heads.remove(last)
                    heads.add(back[last])
                if meet := heads.pop():
                    yield path(text, v, done, back, piece, meet), done + meet, held
                    done, at, reach, held, base = done + meet, at - meet, reach - meet, 0, score[meet]
                    score, back, piece = [x - base for x in score[meet : meet + reach + 1]], [max(0, x - meet) for x in back[meet : meet + reach + 1]], piece[meet : meet + reach + 1]
                # paths that stay apart are looked at ever more rarely, so that the walks stay linear in all
                size = min(n - done, at + max(4 * longest, at))
                more = size + 1 - len(score)
                score, back, piece = score + [worst] * more, back + [0] * more, piece + [-1] * more
            here, end, node, first = score[at], at, tree, at + 1
            for c in text[done + at : done + at + longest]:
                if (got := node.get(c)) is None:
                    break
                node, gain, i = got
                end += 1
                if gain is not None:
                    gain += here
                    if end == first:
                        first = 0
                    if gain > score[end]:
                        score[end], back[end], piece[end] = gain, at, i
                    if end > reach:
                        reach = end
            at += 1
            if first:
                if here + unknown > score[at]:
                    score[at], back[at], piece[at] = here + unknown, at - 1, -1
                if at > reach:
                    reach = at
            if reach == at:
                # nothing reaches beyond this place
                yield path(text, v, done, back, piece, at), done + at, max(held, at)
                done += at
                break


def path(text: str, v: Vocabulary, done: int, back: list[int], piece: list[int], end: int) -> list[int]:
    """The ids of the best path from the boundary `done` to `end` places after it."""
    out: list[int] = []
    while end:
        if piece[end] >= 0:
            out.append(piece[end])
        else:
            out += reversed(v.fallback(text[done + back[end] : done + end]))
        end = back[end]
    out.reverse()
    return out


class Memory(dict):
    """stretch -> (its ids as bytes, how often paths met in it, the most characters held back), as the search found them. Of what
    wasn't asked for since memory was last half full, nothing is kept."""

    def __init__(self, v: Vocabulary, most: int = MEMO_CHARS) -> None:
        self.v, self.half, self.chars, self.older = v, most // 2, 0, {}

    def __missing__(self, stretch: str) -> tuple[bytes, int, int]:
        if (got := self.older.get(stretch)) is None:
            ids, commits, peak, end = [], 0, 0, 0
            for some, end, held in search(stretch, self.v):  # noqa: B007
                ids += some
                commits, peak = commits + 1, max(peak, held)
            if end != len(stretch):
                raise AssertionError("paths must meet where no piece reaches beyond")
            got = array("i", ids).tobytes(), commits, peak
        if (n := len(stretch)) <= self.half:
            if self.chars + n > self.half:
                self.older, self.chars = dict(self), 0
                self.clear()
            self[stretch], self.chars = got, self.chars + n
        return got


def ids_of(found: list[tuple[bytes, int, int]]) -> np.ndarray:
    return np.frombuffer(b"".join(map(FIRST, found)), np.int32)


class Codec:
    def __init__(self, model: bytes) -> None:
        self.v = Vocabulary(model)
        self.known = Memory(self.v)

    def stretches(self, text: str) -> list[tuple[bytes, int, int]]:
        """What the search committed, from each place that nothing reaches beyond to the next."""
        return list(map(self.known.__getitem__, self.v.stretch.findall(MARK + text.replace(" ", MARK)))) if text else []

    def encode(self, text: str) -> np.ndarray:
        return ids_of(self.stretches(text))

    def decode(self, ids) -> str:
        text = b"".join(map(self.v.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_decode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """ids of every whole text, and whether they decode to that text; text_sha256 is the decoded text's; n_commits and
    peak_window tell how often the search's paths met and the most characters it held back."""
    model = model_bytes(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model)
        for batch in batches:
            for part in range(0, batch.num_rows, 512):
                some = batch.slice(part, 512)
                texts = some.column("text").to_pylist()
                found = [codec.stretches(t or "") for t in texts]
                ids = list(map(ids_of, found))
                back = [codec.decode(x.tolist()) for x in ids]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("doc_id"),
                        pa.array(np.diff(offsets), pa.int32()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))),
                        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back]),
                        pa.array([t == (s or "") for t, s in zip(back, texts, strict=True)]),
                        pa.array([sum(map(SECOND, x)) for x in found], pa.int32()),
                        pa.array([max(map(THIRD, x), default=0) for x in found], pa.int32()),
                    ],
                    ["doc_id", "n_tokens", "ids", "text_sha256", "round_trip", "n_commits", "peak_window"],
                )

    return id_text(docs).mapInArrow(run, SCHEMA)


def decode(tokens: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""
    model = model_bytes(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(model)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [codec.decode(x) if x is not None else None for x in b["ids"]]})

    return tokens.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")
