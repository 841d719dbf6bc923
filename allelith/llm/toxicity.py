"""Toxicity as an ordered severity: a cumulative-link (proportional odds) model over sparse word features.

P(grade <= k) = sigmoid(cut_k - w.x) with one weight vector for all cuts; w is kept sparse by an L1 penalty, x marks
which words and beginnings of words a text holds once, twice and three times at least. Labels only say toxic or not, so the grades above 0 are made from them: toxic rows are
ranked by the summed log-odds of their words, and the tertiles of that rank are grades 1 to 3. A text's severity is
its expected grade; it is rejected where P(grade > 0) reaches the cut that did best on rows kept out of the fit.

Fitted on `sample_rows` labelled rows at most; every document is scored. Defined cases: a null or empty text has no
words and is scored from the cuts alone; without both classes among the labels every severity is 0 and nothing is
rejected; repeated rows each give a row; a score at the cut is rejected; of cuts that do equally well the one nearest to a
half is taken, then the smaller; a document labelled twice keeps its larger label; labels without id or value are left
out; of documents only doc_id and text are read, so that names can't clash.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, stored
from .wordfeatures import WORD, collected, csr, labelled_sample

DIMS = 1 << 18
GRADES = 4
PREFIXES = (4, 5)
LEVELS = 3
SAMPLE_ROWS = 20_000
L1 = 1e-3
STEPS = 300
RATE = 0.5
#: A feature takes part if so many rows hold it and its shares among toxic and other rows differ by so many standard errors.
LEAST_ROWS, LEAST_Z = 3, 3.0


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Ordinal:
    weights: dict[int, float]
    cuts: tuple[float, ...]
    reject_at: float

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k but the last."""
        return 1 - sigmoid(np.array(self.cuts)[None, :] - np.asarray(z, float)[:, None])


def grades(rows: np.ndarray, cols: np.ndarray, toxic: np.ndarray, dims: int) -> np.ndarray:
    """0 for rows that aren't toxic; tertiles of the summed log-odds of their words for those that are."""
    n1, n0 = toxic.sum(), len(toxic) - toxic.sum()
    is_toxic = toxic[rows] == 1
    c1 = np.bincount(cols[is_toxic], minlength=dims)
    c0 = np.bincount(cols[~is_toxic], minlength=dims)
    odds = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
    odds[(c1 < 3) | (odds < 1)] = 0
    mass = np.bincount(rows, odds[cols], minlength=len(toxic))
    at = np.quantile(mass[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + np.searchsorted(at, mass, side="right"), 0)


def fit(lists: list[np.ndarray], toxic: np.ndarray, held: np.ndarray) -> Ordinal:
    """lists: each row's buckets. held marks rows that only choose the cut for rejection."""
    toxic, held = np.asarray(toxic, np.int64), np.asarray(held, bool)
    kept = [x for x, h in zip(lists, held, strict=True) if not h]
    y0 = toxic[~held]
    if not 0 < y0.sum() < len(y0):
        return Ordinal({}, (35.0,) * (GRADES - 1), 2.0)
    rows, cols = csr(kept)
    names, cols = np.unique(cols, return_inverse=True)
    y = grades(rows, cols, y0, len(names))
    n, n1 = len(y), y0.sum()
    all_, bad = np.bincount(cols, minlength=len(names)), np.bincount(cols[y0[rows] == 1], minlength=len(names))
    mean = all_ / n
    z = np.abs(bad / n1 - (all_ - bad) / (n - n1)) / np.sqrt(mean * (1 - mean) * (1 / n1 + 1 / (n - n1)) + 1e-12)
    chosen = (all_ >= LEAST_ROWS) & (z >= LEAST_Z)
    place = np.cumsum(chosen) - 1
    rows, cols, names = rows[chosen[cols]], place[cols[chosen[cols]]], names[chosen]
    share = np.array([(y <= k).mean() for k in range(GRADES - 1)]).clip(0.01, 0.99)
    cuts = np.maximum.accumulate(np.log(share / (1 - share))) + 0.05 * np.arange(GRADES - 1)
    w, pace, cut_pace = np.zeros(len(names)), np.zeros(len(names)), np.zeros(GRADES - 1)
    for _ in range(STEPS):
        z = np.bincount(rows, w[cols], minlength=n)
        padded = np.concatenate([[-np.inf], cuts, [np.inf]])
        high, low = sigmoid(padded[y + 1] - z), sigmoid(padded[y] - z)
        high, low = np.where(y == GRADES - 1, 1.0, high), np.where(y == 0, 0.0, low)
        p = np.maximum(high - low, 1e-9)
        g = np.bincount(cols, (1 - high - low)[rows], minlength=len(names)) / n
        dc = np.array([(-(high * (1 - high) / p)[y == k].sum() + (low * (1 - low) / p)[y == k + 1].sum()) / n for k in range(GRADES - 1)])
        pace, cut_pace = 0.9 * pace - RATE * g, 0.9 * cut_pace - RATE * dc
        w = w + pace
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * L1, 0)
        cuts = np.maximum.accumulate(cuts + cut_pace) + 1e-6 * np.arange(GRADES - 1)
    model = Ordinal({int(names[i]): float(w[i]) for i in np.flatnonzero(w)}, tuple(map(float, cuts)), 0.5)
    p = model.above(np.array([sum(model.weights.get(int(b), 0.0) for b in x) for x, h in zip(lists, held, strict=True) if h]).reshape(-1))[:, 0]
    t = toxic[held]
    if 0 < t.sum() < len(t):
        at = np.unique(np.concatenate([[0.5], np.quantile(p, np.linspace(0, 1, 201)).clip(0.3, 0.7)]))
        right = [((p >= a) == t).mean() for a in at]
        best = at[np.isclose(right, max(right))]
        model.reject_at = float(best[np.abs(best - 0.5).argmin()])
    return model


def parts(word: str) -> tuple[str, ...]:
    """A word and its beginnings, which catch endings the sample doesn't hold."""
    return (word, *(f"^{word[:k]}" for k in PREFIXES if len(word) > k))


def levels(part: str) -> list[int]:
    """The buckets of a part that occurs, occurs twice at least, and so on."""
    return [zlib.crc32(f"{part} {k}".encode("utf-8", "surrogatepass")) % DIMS for k in range(1, LEVELS + 1)]


def distinct_buckets(text: str) -> np.ndarray:
    count: Counter = Counter()
    for w, n in Counter(WORD.findall(text.lower())).items():
        for p in parts(w):
            count[p] += n
    return np.array(sorted({b for p, n in count.items() for b in levels(p)[:n]}), np.int64)


class Scorer:
    """The summed weights of a text's features; remembers, for the words seen most lately, their parts of non-zero weight."""

    def __init__(self, weights: dict[int, float], most: int = 300_000) -> None:
        self.weights, self.most, self.known = weights, most, {}

    def __call__(self, text: str | None) -> float:
        if not text:
            return 0.0
        if len(self.known) > self.most:
            self.known.clear()
        count, known, weights = {}, self.known, self.weights
        for w, n in Counter(WORD.findall(text.lower())).items():
            if (hits := known.get(w)) is None:
                hits = known[w] = tuple(p for p in parts(w) if any(b in weights for b in levels(p)))
            for p in hits:
                count[p] = count.get(p, 0) + n
        return sum(weights.get(b, 0.0) for b in sorted({b for p, n in count.items() for b in levels(p)[:n]}))


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Ordinal:
    """Which features take part is decided where the sample's features are; the driver gets those alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.iloc[i : i + 256]
                yield pd.DataFrame({"doc_id": part["doc_id"], "y": part["y"], "x": [distinct_buckets(t or "").astype(np.int32) for t in part["text"]]})

    found = stored(labelled_sample(docs, labels, "toxic", sample_rows).mapInPandas(run, "doc_id long, y int, x array<int>"))
    found = found.withColumn("held", F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(4)) == 0)
    totals = {r.y: r.n for r in found.where("not held").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not (n0 and n1):
        return fit([], np.zeros(0), np.zeros(0))
    mean = F.col("n") / (n0 + n1)
    chosen = (
        found.where("not held").select("y", F.explode("x").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad"))
        .where((F.col("n") >= LEAST_ROWS) & (F.abs(F.col("bad") / n1 - (F.col("n") - F.col("bad")) / n0) >= LEAST_Z * F.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0))))
    )
    # at most DIMS buckets, whatever the sample
    names = np.array(sorted(r.b for r in chosen.select("b").collect()), np.int32)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(x=[np.intersect1d(x, names, assume_unique=True) for x in b["x"]])

    got = collected(found.select("doc_id", "y", "held", "x").mapInPandas(keep, "doc_id long, y int, held boolean, x array<int>"))
    return fit([np.asarray(x, np.int64) for x in got["x"]], got["y"].to_numpy(np.int64), got["held"].to_numpy(bool))


def hash_of(i: int) -> int:
    return (int(i) * 0x9E3779B97F4A7C15 % (1 << 64)) >> 33


def score_toxicity(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, severity (expected grade), grade, p_toxic, toxic (1: rejected) of every row, in the rows' order within partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = Scorer(model.weights)
        for b in batches:
            z = [score(t) for t in b["text"]]
            above = model.above(np.array(z, float))
            yield pd.DataFrame(
                {"doc_id": b["doc_id"].astype("Int64"), "severity": above.sum(axis=1), "grade": (above >= 0.5).sum(axis=1).astype("int32"), "p_toxic": above[:, 0], "toxic": (above[:, 0] >= model.reject_at).astype("int32")}
            )

    return id_text(docs).mapInPandas(run, "doc_id long, severity double, grade int, p_toxic double, toxic int")


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    return score_toxicity(docs, fit_toxicity(docs, labels, sample_rows))


def keep_clean(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that aren't rejected, all columns as they were. No shuffle: texts are scored where they are read."""
    model = fit_toxicity(docs, labels, sample_rows)
    weights, cuts, at = model.weights, model.cuts, model.reject_at

    @F.pandas_udf("boolean")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = Scorer(weights)
        for text in texts:
            z = [score(t) for t in text]
            yield pd.Series(Ordinal(weights, cuts, at).above(np.array(z, float))[:, 0] < at)

    return docs.where(clean(F.col("text").cast("string")))
