"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]): all pairwise interactions in time
linear in a text's features. Words are hashed with length-normalised weights; each statistic of form and each piece of
metadata (length in characters, words and lines) is a one-hot bin of its training quantiles. The label, lang, source
and doc_id are never features.

Fitted on `sample_rows` rows at most whose crc32(doc_id) mod 4 isn't 2; the logit is shifted so that the cut that did
best on a quarter of them, which the fit did not see, is a score of 0.7. Every document is scored.

Defined cases: null and empty texts have no words and the statistics of an empty text; without both classes among the
labels the score is their rate; a null doc_id is scored, held_out null; repeated rows each give a row; a score of 0.7
itself is predicted 1; a document labelled twice keeps its larger label; of documents only doc_id and text are read, so
that names can't clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text
from .toxicity import hash_of, sigmoid
from .wordfeatures import Buckets, collected, labelled_sample, structure, words

DIMS = 1 << 14
RANK = 8
BINS = 12
#: Scales of a bin's feature and of the unit length that a text's words share.
BIN_SCALE, WORD_SCALE = 0.7, 0.5
SAMPLE_ROWS = 12_000
CUT = 0.7


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray
    edges: np.ndarray  # statistic x inner edge
    shift: float = 0.0

    def logit(self, cols: np.ndarray, vals: np.ndarray) -> float:
        v = self.v[cols] * vals[:, None]
        s = v.sum(axis=0)
        return float(self.w0 + self.w[cols] @ vals + 0.5 * (s @ s - (v * v).sum()))


def features(text: str, buckets: Buckets) -> tuple[list[int], list[float], list[float]]:
    """Word columns, their values, and raw statistics."""
    count = words(text)
    by: dict[int, float] = {}
    for w, n in count.items():
        b = buckets(w)
        by[b] = by.get(b, 0.0) + 1.0 + math.log(n)
    norm = math.sqrt(sum(x * x for x in by.values())) / WORD_SCALE or 1.0
    return list(by), [x / norm for x in by.values()], structure(text, count)


def binned(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The column of each statistic's bin, after the words' columns."""
    return DIMS + np.arange(len(edges)) * BINS + np.array([np.searchsorted(e, x, side="right") for e, x in zip(edges, stats, strict=True)])


def bin_edges(stats: np.ndarray) -> np.ndarray:
    """For each statistic BINS - 1 edges: even shares of the rows, and even steps where most rows share a value."""
    shares = np.quantile(stats, np.linspace(0, 1, BINS // 2 + 2)[1:-1], axis=0)
    low, high = np.quantile(stats, [0.01, 0.99], axis=0)
    steps = low + (high - low) * np.linspace(0, 1, BINS - len(shares) + 1)[1:-1, None]
    return np.sort(np.concatenate([shares, steps]), axis=0).T


def fit(xs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, seed: int = 5, epochs: int = 6, rate: float = 0.1, l2: float = 1e-5, batch: int = 256) -> Machine:
    rng = np.random.default_rng(seed)
    mean = (y.sum() + 0.5) / (len(y) + 1.0)
    m = Machine(float(np.log(mean / (1 - mean))), np.zeros(size), rng.normal(0, 0.02, (size, RANK)), np.zeros((0, 0)))
    if not 0 < y.sum() < len(y):
        m.v[:] = 0
        return m
    gw, gv, g0 = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(xs))
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            sizes = np.array([len(xs[i][0]) for i in ids])
            cols, vals = np.concatenate([xs[i][0] for i in ids]), np.concatenate([xs[i][1] for i in ids])
            row = np.repeat(np.arange(len(ids)), sizes)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            vx = m.v[cols] * vals[:, None]
            s = np.add.reduceat(vx, starts, axis=0)
            z = m.w0 + np.bincount(row, m.w[cols] * vals, minlength=len(ids)) + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts))
            d = (sigmoid(z) - y[ids]) / len(ids)
            used, place = np.unique(cols, return_inverse=True)
            dx = d[row] * vals
            dw = np.bincount(place, dx, minlength=len(used)) + l2 * m.w[used]
            dv = np.zeros((len(used), RANK))
            np.add.at(dv, place, dx[:, None] * (s[row] - vx))
            dv += l2 * m.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            g0 += d.sum() ** 2
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            m.v[used] -= rate * dv / np.sqrt(gv[used])
            m.w0 -= rate * d.sum() / np.sqrt(g0)
    return m


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = Buckets(DIMS)
        for b in batches:
            got = [features(t or "", buckets) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "c": [g[0] for g in got], "x": [g[1] for g in got], "s": [g[2] for g in got]})

    learn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2
    got = collected(labelled_sample(docs, labels, "quality", sample_rows, learn).mapInPandas(run, "doc_id long, y int, c array<int>, x array<double>, s array<double>"))
    n_stats = len(structure("", words("")))
    stats = np.array(got["s"].tolist(), float).reshape(len(got), n_stats)
    edges = bin_edges(stats) if len(got) else np.zeros((n_stats, BINS - 1))
    y, held = got["y"].to_numpy(float), np.array([hash_of(i) % 4 == 0 for i in got["doc_id"]], bool)
    xs = [(np.concatenate([np.asarray(c, np.int64), binned(s, edges)]), np.concatenate([np.asarray(x, float), np.full(n_stats, BIN_SCALE)])) for c, x, s in zip(got["c"], got["x"], stats, strict=True)]
    model = fit([x for x, h in zip(xs, held, strict=True) if not h], y[~held], DIMS + n_stats * BINS)
    model.edges = edges
    z, t = np.array([model.logit(*x) for x, h in zip(xs, held, strict=True) if h]), y[held]
    if 0 < t.sum() < len(t):
        at = np.quantile(z, np.linspace(0, 1, 401))
        right = np.array([((z >= a) == (t == 1)).mean() for a in at])
        best = at[np.isclose(right, right.max())]
        model.shift = math.log(CUT / (1 - CUT)) - float(np.median(best))
    return model


def score_quality(docs: DataFrame, model: Machine) -> DataFrame:
    n_stats = len(model.edges)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets = Buckets(DIMS)
        for b in batches:
            z = np.empty(len(b))
            for i, t in enumerate(b["text"]):
                c, x, s = features(t or "", buckets)
                z[i] = model.logit(np.concatenate([np.array(c, np.int64), binned(s, model.edges)]), np.concatenate([np.array(x, float), np.full(n_stats, BIN_SCALE)]))
            score = sigmoid(z + model.shift)
            held = [None if pd.isna(i) else zlib.crc32(str(int(i)).encode()) % 4 == 2 for i in b["doc_id"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "held_out": held, "score": score, "predicted": (score >= CUT).astype("int32")})

    return id_text(docs).mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    return score_quality(docs, fit_quality(docs, labels, sample_rows))
