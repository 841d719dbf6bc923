"""Hashed words and structure statistics of a text, and the bounded sample of labelled rows the classifiers fit on."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

WORD = re.compile(r"\w+")
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "bang", "bar", "symbol", "other")


def _table() -> np.ndarray:
    out = np.full(256, CLASSES.index("symbol"), np.uint8)
    for i in range(256):
        c = chr(i)
        kind = (
            "newline" if c == "\n" else "space" if c.isspace() else "digit" if c.isdigit() else "lower" if c.islower() else "upper" if c.isupper()
            else "stop" if c in ".,;:?'\"-()" else "bang" if c == "!" else "bar" if c == "|" else "other" if i < 32 else "symbol"
        )
        out[i] = CLASSES.index(kind)
    return out


TABLE = _table()


class Buckets:
    """word -> crc32 modulo dims, remembered for the words seen most lately."""

    def __init__(self, dims: int, most: int = 300_000) -> None:
        self.dims, self.most, self.known = dims, most, {}

    def __call__(self, word: str) -> int:
        if (b := self.known.get(word)) is None:
            if len(self.known) >= self.most:
                self.known.clear()
            b = self.known[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.dims
        return b


def words(text: str) -> Counter:
    return Counter(WORD.findall(text.lower()))


def structure(text: str, count: Counter) -> list[float]:
    """Statistics of a text's form; all are 0 for an empty text."""
    n, total = len(text), sum(count.values())
    kinds = np.bincount(TABLE[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)], minlength=len(CLASSES)) if n else np.zeros(len(CLASSES))
    lines = [x for x in text.split("\n") if x.strip()]
    letters = kinds[0] + kinds[1]
    return [
        float(np.log1p(n)), float(np.log1p(total)), letters / max(1, total), kinds[1] / max(1, letters), *(kinds[2:] / max(1, n)),
        total / max(1, len(lines)), len(count) / max(1, total), 1 - len(set(lines)) / max(1, len(lines)), max(count.values(), default=0) / max(1, total),
    ]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, where=None, seed: int = 7) -> DataFrame:
    """(doc_id, text, y) of `rows` labelled documents at most, the ones of smallest hash; a document labelled twice keeps its largest label."""
    few = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    if where is not None:
        few = few.where(where)
    few = few.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)
    # bounded by `rows`
    return id_text(docs).join(F.broadcast(few), "doc_id")


def csr(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and columns of a matrix given as each row's columns."""
    sizes = np.array([len(x) for x in lists], np.int64)
    cols = np.concatenate(lists).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(lists)), sizes), cols


def collected(df: DataFrame, key: str = "doc_id") -> pd.DataFrame:
    """A bounded sample on the driver, in an order that doesn't depend on the run."""
    return df.toPandas().sort_values(key, kind="stable").reset_index(drop=True)
