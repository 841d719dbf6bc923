"""Benchmark decontamination by q-gram lemma filtering over overlapping diagonal bands, verified by banded alignment.

Items and texts are compared as UTF-8 bytes with A-Z lowered and white space as blanks. Each stretch of WINDOW bytes of an
item, from whatever byte on, is a window (the whole item if it is shorter). A text holds a window if some region of
it lies within `edits` = floor(RATE * length) insertions, deletions and substitutions of bytes. The q-gram lemma: such a
region shares at least length - q + 1 - q * edits q-grams with the window, all on diagonals within `edits` of each
other. Hits are therefore counted per item in bands of 2 * edits + 2 diagonals that overlap by half, over a stretch that
slides along the item; windows that reach the bound in a band are aligned with the band's bytes, many at once. Windows
are never written out: the index holds each q-gram of an item once.

Texts are scanned where they are read, with no shuffle. Items are taken to the executors in slices of SLICE_BYTES at
most, one pass over the texts for each slice, so that nothing of unbounded size is ever broadcast. Where there are several,
what a slice found is written out before the next is taken, so that the driver holds one slice at a time.

Items under LEAST bytes, which with edits could not be told from chance, are looked for without any, their outer blanks
apart, where no letter or digit adjoins one of theirs; each has one window. Their hashes are met by those of a text's
stretches of the same lengths, and bytes decide.

Defined cases: null and empty texts hold nothing; null items and those of white space alone are not searched for; equal items each get rows; repeated documents each get rows; offsets are code points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import LOWER, buffers
from .common import id_text, stored

Q = 10
WINDOW = 100
RATE = 0.08
LEAST = 40
SLICE_BYTES = 8 << 20
CHUNK = 1 << 20
BITS = 22
ROWS = 512
ASCII_WORD = np.array([chr(i).isalnum() and i < 128 for i in range(256)])
SCHEMA = "doc_id long, item_id long, n_windows int, edits int, start int, end int, regions array<struct<start:int,end:int,edits:int>>"
REGION = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())])


def normal(text: str) -> bytes:
    return LOWER[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)].tobytes()


def grams(a: np.ndarray) -> np.ndarray:
    """A 32-bit polynomial hash of the Q bytes from each position on, built by doubling."""
    p = [np.uint32(pow(0x9E3779B1, k, 1 << 32)) for k in (1, 2, 4)]
    h1 = a.astype(np.uint32) + np.uint32(1)
    h2 = h1[:-1] * p[0] + h1[1:]
    h4 = h2[:-2] * p[1] + h2[2:]
    h8 = h4[:-4] * p[2] + h4[4:]
    out = h8[: len(a) - Q + 1] * p[1] + h2[8 : 8 + len(a) - Q + 1]
    out ^= out >> np.uint32(15)
    return out * np.uint32(0x85EBCA6B)


@cache
def powers(n: int, inverse: bool = False) -> np.ndarray:
    base = 0x9E3779B97F4A7C15
    run = np.full(n, pow(base, -1, 1 << 64) if inverse else base, np.uint64)
    run[0] = 1
    return np.cumprod(run, dtype=np.uint64)


def prefixes(a: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the first 0, 1, ... bytes, by growing powers."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * powers(CHUNK + LEAST + 1)[: len(a)], dtype=np.uint64)])


@dataclass
class Window:
    item: int
    start: int
    text: bytes
    edits: int
    least: int


class Windows:
    """The windows of items, made as they are asked for; ids and texts hold what they are made from, then short ones."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        made = [(i, normal(t)) for i, t in items]
        kept = [x for x in made if len(x[1]) >= LEAST]
        less = [(i, b.strip(b" ")) for i, b in made if len(b) < LEAST and b.strip(b" ")]
        self.ids, self.texts, self.short = [i for i, _ in kept + less], [b for _, b in kept], [b for _, b in less]

    def __iter__(self) -> Iterator[Window]:
        for item, b in zip(self.ids, self.texts, strict=False):
            w, e, least = bounds(len(b))
            for s in range(len(b) - w + 1):
                yield Window(item, s, b[s : s + w], e, least)
        for item, b in zip(self.ids[len(self.texts) :], self.short, strict=True):
            yield Window(item, 0, b, 0, 1)


def bounds(n: int) -> tuple[int, int, int]:
    """Length, edits and least shared q-grams of the windows of an item of n bytes."""
    w = min(WINDOW, n)
    e = int(RATE * w)
    return w, e, max(1, w - Q + 1 - Q * e)


def windows(items: list[tuple[int, str]]) -> Windows:
    return Windows(items)


class Index:
    """q-grams of items: a bitmap for a first look, then sorted hashes with their items and places."""

    def __init__(self, found: Windows) -> None:
        self.ids, self.texts = found.ids, found.texts
        h = [grams(np.frombuffer(b, np.uint8)) for b in self.texts]
        hashes = np.concatenate(h) if h else np.zeros(0, np.uint32)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item = np.repeat(np.arange(len(h)), [len(x) for x in h])[order]
        self.place = (np.concatenate([np.arange(len(x)) for x in h]) if h else np.zeros(0, np.int64))[order]
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[self.hashes >> np.uint32(32 - BITS)] = True
        self.width, self.edits, self.least = np.array([bounds(len(b)) for b in self.texts], np.int64).reshape(-1, 3).T
        # places of short items by length and text, and by length the sorted hashes of those texts
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for i, b in enumerate(found.short, len(self.texts)):
            self.short.setdefault(len(b), {}).setdefault(b, []).append(i)
        self.exact = {n: np.unique([prefixes(np.frombuffer(b, np.uint8))[-1] for b in by]) for n, by in self.short.items()}

    def hits(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose q-gram may be an item's, and its hash."""
        h = grams(a)
        at = np.flatnonzero(self.bitmap[h >> np.uint32(32 - BITS)])
        return at, h[at]


def nearest(patterns: np.ndarray, texts: np.ndarray, free: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end) of the region of each row of texts nearest to its row of patterns, the first such end; regions begin
    anywhere, or if not free at the row's first byte. Values over 255 in texts stand for no byte."""
    steps = np.arange(texts.shape[1] + 1, dtype=np.int16)
    row = np.tile(steps * np.int16(not free), (len(texts), 1))
    for i in range(patterns.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        np.minimum(row[:, :-1] + (texts != patterns[:, i : i + 1]), row[:, 1:] + 1, out=new[:, 1:])
        new -= steps
        row = np.minimum.accumulate(new, axis=1) + steps
    end = row.argmin(axis=1)
    return row[np.arange(len(row)), end], end


def aligned(item: bytes, text: np.ndarray, at: np.ndarray, diagonal: int, width: int, edits: int) -> Iterator[tuple[int, int, int, int]]:
    """(window, edits, start, end) of the windows from the places `at` on that text holds in the band from a diagonal on."""
    body, left = text.tobytes(), []
    for s in at.tolist():
        a = diagonal + s - edits
        k = body.find(item[s : s + width], max(0, a), max(0, a + width + 4 * edits + 2))
        if k >= 0:
            yield s, 0, k, k + width
        else:
            left.append(s)
    item_ = np.frombuffer(item, np.uint8).astype(np.int16)
    for i in range(0, len(left), ROWS):
        s = np.array(left[i : i + ROWS], np.int64)[:, None]
        pattern = item_[s + np.arange(width)]
        a = diagonal + s - edits
        e, end = nearest(pattern, some(text, a + np.arange(width + 4 * edits + 2)))
        ok = e <= edits
        if ok.any():
            s, e, end = s[ok, 0], e[ok], (a[:, 0] + end)[ok]
            back = some(text, end[:, None] - 1 - np.arange(width + edits))
            _, long = nearest(pattern[ok, ::-1], back, free=False)
            yield from zip(s.tolist(), e.tolist(), (end - long).tolist(), end.tolist(), strict=True)


def some(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """text's bytes at these places, 256 outside of it."""
    return np.where((at >= 0) & (at < len(text)), text[np.clip(at, 0, len(text) - 1)].astype(np.int16), np.int16(256))


def code_points(b: bytes) -> np.ndarray:
    """Code points that begin in the first 0, 1, ... bytes."""
    return np.append(0, np.cumsum((np.frombuffer(b, np.uint8) & 0xC0) != 0x80))


def word(around: bytes, at: int) -> bool:
    """Whether the character that ends (at = -1) or begins (at = 0) these bytes is a letter or a digit."""
    text = around.decode("utf-8", "ignore")
    return bool(text) and text[at].isalnum()


def verbatim(raw: np.ndarray, offsets: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, int]]:
    """(row, item's place in the index, start, end) of the short items that texts hold."""
    for s in range(0, len(raw), CHUNK):
        base = max(0, s - 1)
        b = LOWER[raw[base : s + CHUNK + LEAST]]
        plain, hashes = ASCII_WORD[b], prefixes(b)
        # an item may begin and end here: no letter adjoins another, as far as single bytes tell
        edge = np.ones(len(b) + 1, bool)
        edge[1:-1] = ~(plain[1:] & plain[:-1])
        seam = offsets[np.searchsorted(offsets, base) : np.searchsorted(offsets, base + len(b), "right")] - base
        edge[seam] = True
        starts = np.flatnonzero(edge[: s - base + CHUNK])
        starts = starts[starts >= s - base]
        for n, wanted in index.exact.items():
            at = starts[starts + n <= len(b)]
            at = at[edge[at + n]]
            h = (hashes[at + n] - hashes[at]) * powers(CHUNK + LEAST + 1, True)[at]
            for k in at[wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h].tolist():
                held, p = b[k : k + n].tobytes(), base + k
                d = int(np.searchsorted(offsets, p, "right")) - 1
                first, last = int(offsets[d]), int(offsets[d + 1])
                if p + n > last or held not in index.short[n]:
                    continue
                if not (word(held, 0) and word(raw[max(first, p - 4) : p].tobytes(), -1)) and not (word(held, -1) and word(raw[p + n : min(last, p + n + 4)].tobytes(), 0)):
                    for x in index.short[n][held]:
                        yield d, x, p - first, p - first + n


def disjoint(places: list[tuple[int, int, int]], slack: int = 0) -> list[tuple[int, int, int]]:
    """(start, end, edits) of places joined where they overlap by more than slack, in order; edits: the fewest. Smaller
    overlaps, of copies side by side whose windows reach into each other by their edits, are halved."""
    out: list[tuple[int, int, int]] = []
    for s, z, e in sorted(places):
        if out and s + slack < out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]), min(e, out[-1][2]))
        else:
            out.append((s, z, e))
    for k in range(1, len(out)):
        (a, b, e), (s, z, f) = out[k - 1 : k + 1]
        if s < b:
            out[k - 1 : k + 1] = [(a, (s + b) // 2, e), ((s + b) // 2, z, f)]
    return out


def search(texts: pa.Array, index: Index) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
    """(row, item's place in the index, windows, regions) for each item of which a text holds a window; regions: the disjoint
    (start, end, edits) in bytes of the text."""
    raw, offsets = buffers(texts)
    places: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for d, x, s, z in verbatim(raw, offsets, index) if index.exact else ():
        places.setdefault((d, x), []).append((s, z, 0))
    for (d, x), hits in places.items():
        yield d, x, 1, disjoint(hits)
    yield from similar(raw, offsets, index)


def similar(raw: np.ndarray, offsets: np.ndarray, index: Index) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
    """What search gives for the items of LEAST bytes and more."""
    if not len(index.hashes):
        return
    found = []
    for s in range(0, max(0, len(raw) - Q + 1), CHUNK):
        at, h = index.hits(LOWER[raw[s : s + CHUNK + Q - 1]])
        found.append((at + s, h))
    if not found:
        return
    at, h = (np.concatenate(x) for x in zip(*found, strict=True))
    doc = np.searchsorted(offsets, at, "right") - 1
    keep = at + Q <= offsets[doc + 1]
    at, h, doc = at[keep], h[keep], doc[keep]
    low, high = np.searchsorted(index.hashes, h, "left"), np.searchsorted(index.hashes, h, "right")
    n = high - low
    keep = n > 0
    at, doc, low, n = at[keep], doc[keep], low[keep], n[keep]
    if not len(n):
        return
    # one entry for each hit and item
    entry = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    pos, row = np.repeat(at, n), np.repeat(doc, n)
    item, place = index.item[entry], index.place[entry]
    pair = row * len(index.ids) + item
    _, back, total = np.unique(pair, return_inverse=True, return_counts=True)
    keep = total[back] >= index.least[item]
    pair, pos, place, item = pair[keep], pos[keep], place[keep], item[keep]
    if not len(pair):
        return
    band = (pos - place - offsets[pair // len(index.ids)]) // (index.edits[item] + 1)
    # places of a pair's band, each once and in order
    pair, band, place = np.concatenate([pair, pair]), np.concatenate([band, band - 1]), np.concatenate([place, place])
    order = np.lexsort((place, band, pair))
    pair, band, place = pair[order], band[order], place[order]
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])
    once = new.copy()
    once[1:] |= place[1:] != place[:-1]
    pair, band, place, new = pair[once], band[once], place[once], new[once]
    item, group = pair % len(index.ids), np.cumsum(new) - 1
    # a band is looked at if enough of its places lie within one window
    last = np.arange(len(pair)) + index.least[item] - 1
    inside = np.minimum(last, len(pair) - 1)
    dense = (last < len(pair)) & (group[inside] == group) & (place[inside] - place <= index.width[item] - Q)
    starts = np.append(np.flatnonzero(new), len(pair))
    held: dict[int, list[tuple[int, int, int, int]]] = {}
    for g in np.unique(group[dense]).tolist():
        a, z = int(starts[g]), int(starts[g + 1])
        d, x = divmod(int(pair[a]), len(index.ids))
        text, w, e = index.texts[x], int(index.width[x]), int(index.edits[x])
        # windows that hold any of the places, by how many
        first, most = max(0, int(place[a]) - (w - Q)), min(int(place[z - 1]), len(text) - w)
        here = np.zeros(most - first + w - Q + 2, np.int64)
        here[place[a:z] - first + 1] = 1
        here = np.cumsum(here)
        at = first + np.flatnonzero(here[w - Q + 1 :] - here[: most - first + 1] >= index.least[x])
        # the band's bytes
        diagonal = int(band[a]) * (e + 1)
        begin = max(0, diagonal + int(at[0]) - e)
        body = LOWER[raw[offsets[d] + begin : min(offsets[d + 1], offsets[d] + diagonal + int(at[-1]) + w + 3 * e + 2)]]
        found = aligned(text, body, at, diagonal - begin, w, e)
        held.setdefault(int(pair[a]), []).extend((s, k, i + begin, j + begin) for s, k, i, j in found)
    for p, hits in held.items():
        if hits:
            yield p // len(index.ids), p % len(index.ids), len({h[0] for h in hits}), disjoint([(i, j, e) for _, e, i, j in hits], int(index.width[p % len(index.ids)]) // 2)


def slice_count(benchmark: DataFrame, most: int = SLICE_BYTES) -> int:
    return (benchmark.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) // most + 1


def slices(benchmark: DataFrame, most: int = SLICE_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of about `most` bytes, by ranges of a hash; each is taken to the driver alone."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n = slice_count(benchmark, most)
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0], r[1]))


def contaminated(docs: DataFrame, benchmark: DataFrame, most: int = SLICE_BYTES) -> DataFrame:
    """One row for each document and item of which it holds a window: how many windows, the fewest edits, the first of the
    regions with so few, and all regions: the places of its windows, joined where they overlap. A region may
    reach over its passage by what its windows' edits allow."""
    docs = id_text(docs)
    if slice_count(benchmark, most) == 1:
        return docs.mapInArrow(finder(next(slices(benchmark, most))), SCHEMA)
    return reduce(DataFrame.unionByName, (stored(docs.mapInArrow(finder(items), SCHEMA)) for items in slices(benchmark, most)))


def finder(items: list[tuple[int, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What makes rows of SCHEMA from batches of (doc_id, text)."""
    found = windows(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(found)
        for batch in batches:
            texts, ids, made = batch.column("text"), batch.column("doc_id"), []
            for d, x, n, places in sorted(search(texts, index), key=lambda r: r[:2]):
                at = code_points(texts[d].as_py().encode())
                regions = [{"start": int(at[s]), "end": int(at[z]), "edits": e} for s, z, e in places]
                best = min(regions, key=lambda r: r["edits"])
                made.append((ids[d].as_py(), index.ids[x], n, best["edits"], best["start"], best["end"], regions))
            cols = list(zip(*made, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.list_(REGION)], strict=True)], ["doc_id", "item_id", "n_windows", "edits", "start", "end", "regions"])

    return run


def freedom(items: list[tuple[int, str]]):
    """A function of a text column: whether the text holds no window of any of the items."""
    found = windows(items)

    @F.pandas_udf("boolean")
    def free(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(found)
        for text in texts:
            keep = np.ones(len(text), bool)
            for d, *_ in search(pa.array(text, pa.large_string(), from_pandas=True), index):
                keep[d] = False
            yield pd.Series(keep)

    return free


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, most: int = SLICE_BYTES) -> DataFrame:
    """The rows of docs that hold no window of any item, all columns as they were. With one slice of items texts stay where they
    are read; with several, the hashes of texts found in each are written and their rows left out at the end."""
    text = F.col("text").cast("string")
    if slice_count(benchmark, most) == 1:
        return docs.where(freedom(next(slices(benchmark, most)))(text))
    key = [F.xxhash64(text).alias("__a"), F.xxhash64(F.lit(1), text).alias("__b")]
    gone = reduce(DataFrame.unionByName, (stored(docs.where(~freedom(items)(text)).select(*key)) for items in slices(benchmark, most))).distinct()
    return docs.join(gone, (key[0] == F.col("__a")) & (key[1] == F.col("__b")), "left_anti")
