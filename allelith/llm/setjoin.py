"""Exact Jaccard join of five-word shingle sets, with set-relation skipping.

Texts with equal sets form a class and its smallest id stands for it. Sets are ordered by a global order of shingles
(by hash, shingles that many prefixes hold last) and indexed by their prefixes: two sets with a Jaccard similarity of
0.8 share at least l shingles within the first n - ceil(0.8 n) + l, for l = min(l(n), l(n')), l(n) = 1 + n // 20.

Index level: a list (the sets whose prefix holds a shingle) first gives its leader, the set of smallest id, paired with
its other members only. Links found so join sets into components; a list within one component is skipped as a block,
and of the others only blocks of different components meet, sets out of size or position range skipped. A list of a hot
shingle need not bring together sets whose hot shingles are too few for the overlap: their link shares another shingle,
which comes before all hot ones and so within both prefixes.
Answer level: for two members a, b of a list with leader m, the overlaps with m that were computed before bound theirs,
    |a & m| + |b & m| - |m|  <=  |a & b|  <=  min(|a & m|, |b & m|) + min(|a - m|, |b - m|),
so a's answer follows from m's without touching the sets where either bound decides. The sets compared with a leader of
many are compared among themselves in blocks, of which only a spanning forest of links comes back. What is left is verified on whole
sets. Every link between two sets is either verified, derived, or runs within one component, so components are exact.

Shingles are 64-bit hashes. The HOT most frequent ones are ordered last, a matter of speed alone. As they are the most
frequent, any other shingle counted is in one HOT-th of all prefix entries at most, less than a task's share, so its list may be taken whole by
a window; the lists of hot ones are joined with their heads instead, which splits. Sets to verify are made after a semi-join of
the texts with a written table of ids, which the planner sends to the texts if its files are small, else by a shuffle.

Defined cases: a null or empty text and one of white space have no shingles and are linked with nothing; fewer than five
words are one shingle; rows that share an id are one node; a row without id takes its class's component, or null.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytetext import LOWER, buffers
from .common import cut, dropped, id_text, own_folder, stored

SHINGLE = 5
HOT, HOT_FROM = 200_000, 12
SLICE = 256
EDGES_A_PART = 200_000
#: Leaders compared with so many sets have those compared among themselves in blocks.
FAMILY, BLOCK, COLUMNS = 64, 256, 4096
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct hashes of texts' shingles, made from the bytes of many texts at once.

    A word's hash is the sum of TABLE[byte] * BASE ** place, places counted from its start, scrambled with its length."""

    CHUNK = 1 << 18

    def __init__(self, seed: int = 91) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 64, 256, np.uint64)[LOWER]
        self.base = int(rng.integers(0, 1 << 62)) * 4 + 3
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, self.CHUNK + 1)
            for name, x in (("powers", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                run = np.full(n, x, np.uint64)
                run[0] = 1
                setattr(self, name, np.cumprod(run, dtype=np.uint64))

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        raw, offsets = buffers(texts)
        out, at, n = [], 0, len(offsets) - 1
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + self.CHUNK, "right")) - 1)
            out += self._chunk(raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            at = end
        return out

    def _chunk(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        n = len(raw)
        self._grow(n + 1)
        inside = LOWER[raw] != 32
        begin, last = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        seams = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)]
        begin[seams] = inside[seams]
        last[seams - 1] = inside[seams - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
        upto = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[raw] * self.powers[:n], out=upto[1:])
        words = scramble((upto[ends] - upto[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        low, high = np.searchsorted(starts, offsets[:-1]), np.searchsorted(starts, offsets[1:])
        every = self._runs(words, SHINGLE) if len(words) >= SHINGLE else words[:0]
        return [
            np.unique(every[a : b - SHINGLE + 1]) if b - a >= SHINGLE else self._runs(words[a:b], b - a) if b > a else words[:0]
            for a, b in zip(low.tolist(), high.tolist(), strict=True)
        ]

    @staticmethod
    def _runs(w: np.ndarray, n: int) -> np.ndarray:
        """A hash of each run of n words."""
        m = len(w) - n + 1
        acc = w[:m] + np.uint64(n)
        for k in range(1, n):
            acc = scramble(acc + MIX[0]) + w[k : m + k]
        return scramble(acc + MIX[0])


def least_shared(n):
    return 1 + n // 20


def prefix_length(n: int) -> int:
    return min(n, n - (4 * n + 4) // 5 + least_shared(n))


def forget(spark: SparkSession) -> None:
    """Lets the driver drop shuffle files of steps that are done."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Order:
    """Global order of shingles: by hash, those in `hot` last and there by how often they were counted."""

    def __init__(self, hot: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(hot, kind="stable")
        self.hot, self.rank = hot[order], counts[order]

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, int]:
        """x in order, and how many of it aren't hot."""
        if not len(self.hot):
            return x, len(x)
        # hot shingles are known by the upper half of their hash
        top = (x >> np.uint64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(self.hot, top), len(self.hot) - 1)
        is_hot = self.hot[at] == top
        if not is_hot.any():
            return x, len(x)
        last = x[is_hot]
        return np.concatenate([x[~is_hot], last[np.lexsort((last, self.rank[at[is_hot]]))]]), len(x) - len(last)


def hot_shingles(docs: DataFrame, most: int, least: int, rounds: int = 3) -> Order:
    """The order with the shingles last that many prefixes hold: `most` of them at most, each in `least` prefixes at least.
    Prefixes (with half as much again) are counted by plain hash first; what replaces the shingles found is counted next."""
    order = Order(np.zeros(0, np.uint32), np.zeros(0, np.int64))
    for _ in range(rounds if most else 0):
        last = order

        def run(batches: Iterator[pa.RecordBatch], last=last) -> Iterator[pa.RecordBatch]:
            made = Shingles()
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    parts = [np.zeros(0, np.uint64)]
                    for x in made(batch.column("text").slice(at, SLICE)):
                        p = prefix_length(len(x))
                        p = min(len(x), p + p // 2 + 4)
                        if not len(last.hot):
                            parts.append(x[:p])
                        elif p:
                            y, cold = last(x)
                            y = y[: min(p, cold)]
                            parts.append(y[y > x[p - 1]])
                    h, c = np.unique((np.concatenate(parts) >> np.uint64(32)).astype(np.uint32), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int32)), pa.array(c.astype(np.int32))], ["h", "c"])

        counted = docs.mapInArrow(run, "h int, c int").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
        rows = counted.orderBy(F.col("c").desc(), "h").limit(most - len(order.hot)).collect()
        forget(docs.sparkSession)
        if not rows:
            break
        hot = np.concatenate([order.hot, np.array([r.h for r in rows], np.int32).view(np.uint32)])
        order = Order(hot, np.concatenate([order.rank, np.array([r.c for r in rows], np.int64)]))
    return order


def summaries(docs: DataFrame, order: Order) -> DataFrame:
    """(doc_id, n, a, b, cold, prefix): size, 128-bit fingerprint and ordered prefix of each row's set; the first `cold`
    shingles of the order aren't hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingles()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = made(part.column("text"))
                n = np.array([len(x) for x in sets], np.int64)
                a = np.array([int(scramble(x).sum(dtype=np.uint64)) if len(x) else 0 for x in sets], np.uint64).view(np.int64)
                b = np.array([int(scramble(x ^ MIX[0]).sum(dtype=np.uint64)) if len(x) else 0 for x in sets], np.uint64).view(np.int64)
                ordered = [order(x) for x in sets]
                tokens = [x[: prefix_length(len(x))] for x, _ in ordered]
                cold = np.array([c for _, c in ordered], np.int64)
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
                values = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(a), pa.array(b), pa.array(cold), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "n", "a", "b", "cold", "prefix"]
                )

    return docs.mapInArrow(run, "doc_id long, n long, a long, b long, cold long, prefix array<long>")


def whole_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, x): whole sets of the rows whose id is in ids (one column, distinct)."""
    spark, folder = docs.sparkSession, own_folder(docs.sparkSession, "ids")
    # read again, the table's size is known to the planner
    ids.toDF("__id").write.parquet(folder)
    docs = docs.join(spark.read.parquet(folder), F.col("doc_id") == F.col("__id"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Shingles()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                sets = made(part.column("text"))
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], ["id", "x"]
                )

    return docs.mapInArrow(run, "id long, x array<long>").where(F.size("x") > 0)


def sets_for(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, x) of every member of pairs (u, v)."""
    return stored(whole_sets(docs, pairs.select("u").union(pairs.select("v")).distinct()))


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (u, v) that both have sets, with n_u, n_v and their overlap o."""
    left = pairs.join(sets.select(F.col("id").alias("u"), F.col("x").alias("xu")), "u")
    both = left.join(sets.select(F.col("id").alias("v"), F.col("x").alias("xv")), "v")
    return stored(both.select("u", "v", F.size("xu").cast("long").alias("n_u"), F.size("xv").cast("long").alias("n_v"), F.size(F.array_intersect("xu", "xv")).cast("long").alias("o")))


def linked(o: Column, n: Column, m: Column) -> Column:
    """100 o >= 80 (n + m - o)."""
    return 9 * o >= 4 * (n + m)


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id of each id's component, by least labels with pointer jumping."""
    edges = edges.where("u <> v")
    both = stored(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    # a small graph is kept in few partitions
    parts = both.count() // EDGES_A_PART + 1
    both = both.coalesce(parts)
    label = stored(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("v")).select("id", F.least("id", "v").alias("comp")).coalesce(parts))
    while True:
        near = both.join(label.select(F.col("id").alias("v"), "comp"), "v").groupBy(F.col("u").alias("id")).agg(F.min("comp").alias("near"))
        low = stored(label.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")).coalesce(parts))
        jump = low.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        label = stored(low.join(jump, "comp", "left").select("id", "old", F.least("comp", F.coalesce("next", "comp")).alias("comp")).coalesce(parts))
        if label.where("comp <> old").isEmpty():
            return label.select("id", "comp")
        label = label.select("id", "comp")


def spanning(ids: np.ndarray, left: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what links join between members marked left and the others, or among all if all are marked.
    Overlaps come from products of membership matrices, a slice of the shingles that two members have at a time."""
    values, place, total = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(total > 1) - 1
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    keep = total[place] > 1
    row, col = row[keep], column[place[keep]]
    a, b = (np.flatnonzero(left), np.flatnonzero(~left)) if not left.all() else (np.arange(len(sets)),) * 2
    shared = np.zeros((len(a), len(b)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for start in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        lo, hi = np.searchsorted(col, [start, start + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[lo:hi], col[lo:hi] - start] = 1
        shared += part[a] @ part[b].T
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(9 * shared >= 4 * (sizes[a][:, None] + sizes[b][None, :])), strict=True):
        p, q = find(int(a[i])), find(int(b[j]))
        if p != q:
            root[q] = p
            out.append((int(ids[a[i]]), int(ids[b[j]])))
    return out


def family_links(tested: DataFrame, big: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): edges that join what links join among the sets compared with one leader, for leaders of many. Members are dealt
    to blocks of about BLOCK; two blocks meet in one task, which gives back a spanning forest, never their pairs."""
    members = tested.join(big, "u").select(F.col("u").alias("m"), F.col("v").alias("id"), F.ceil(F.col("c") / BLOCK).alias("blocks"))
    members = members.withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks"))).join(sets, "id")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    met = members.withColumn("other", other).select("m", F.least("b", "other").alias("p"), F.greatest("b", "other").alias("q"), (F.col("b") <= F.col("other")).alias("low"), "id", "x")

    def run(key: tuple, part):
        sets = [np.asarray(x, np.int64) for x in part["x"]]
        left = np.ones(len(part), bool) if key[1] == key[2] else part["low"].to_numpy(bool)
        edges = spanning(part["id"].to_numpy(np.int64), left, sets, np.array([len(x) for x in sets], np.int64)) if len(part) > 1 else []
        return part.iloc[:0].reindex(columns=["u", "v"]).astype("int64") if not edges else type(part)(edges, columns=["u", "v"])

    return met.groupBy("m", "p", "q").applyInPandas(run, "u long, v long")


def shared_lists(classes: DataFrame) -> DataFrame:
    """(h, id, n, hot, pos, m): the index's lists of two members or more, m the smallest id of each; hot is how many of a
    member's shingles are hot.

    Lists of hot shingles may hold any share of all sets: their heads are summed before the shuffle and joined back, which
    splits. All other lists are short, so a window over them needs their rows to move once only."""
    cold = F.slice("prefix", F.lit(1), F.least(F.col("cold"), F.size("prefix")).cast("int"))
    hot = F.when(F.col("cold") < F.size("prefix"), F.slice("prefix", F.col("cold").cast("int") + 1, F.size("prefix"))).otherwise(F.array().cast("array<bigint>"))
    many = (F.col("n") - F.col("cold")).alias("hot")
    short = classes.select("id", "n", many, F.posexplode(cold).alias("pos", "h"))
    whole = Window.partitionBy("h")
    short = short.withColumns({"m": F.min("id").over(whole), "hi": F.max("id").over(whole)}).where("m < hi").select("h", "id", "n", "hot", "pos", "m")
    long_ = classes.select("id", "n", "cold", F.posexplode(hot).alias("pos", "h")).select("h", "id", "n", many, (F.col("pos") + F.col("cold")).cast("int").alias("pos"))
    heads = long_.groupBy("h").agg(F.min("id").alias("m"), F.max("id").alias("hi")).where("m < hi").select("h", "m")
    return short.unionByName(long_.join(heads, "h").select("h", "id", "n", "hot", "pos", "m"))


def cross_pairs(lists: DataFrame) -> DataFrame:
    """(u, v, sure) of members of one list and different components that the index alone can't rule out; u < v.
    lists: (h, id, n, hot, pos, comp, n_m, o, answered): o is the overlap with the list's leader of size n_m, null where not
    computed; two answered members of a list have been compared."""
    # a block is one component's part of a list; what holds for its extremes holds for its members
    extremes = {
        "least_n": F.min("n"), "most_n": F.max("n"), "pos": F.max("pos"), "rest": F.max(F.col("n") - F.col("pos")),
        "hot": F.max("hot"), "open": F.max(~F.col("answered")), "is_hot": F.max(F.col("pos") >= F.col("n") - F.col("hot")), "shared": F.max(F.coalesce("o", "n")), "own": F.max(F.col("n") - F.coalesce("o", F.lit(0))),
    }
    blocks = stored(lists.groupBy("h", "comp").agg(*(v.alias(k) for k, v in extremes.items())))
    one, two = blocks.alias("a"), blocks.alias("b")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    least = 4 * (a("least_n") + b("least_n"))
    may = (a("comp") < b("comp")) & (5 * a("most_n") >= 4 * b("least_n")) & (5 * b("most_n") >= 4 * a("least_n"))
    may = may & (9 * (F.least(a("pos"), b("pos")) + F.least(a("rest"), b("rest"))) >= least) & (9 * (F.least(a("shared"), b("shared")) + F.least(a("own"), b("own"))) >= least)
    may = may & (a("open") | b("open")) & (~a("is_hot") | (9 * F.least(a("hot"), b("hot")) >= least))
    met = one.join(two, (a("h") == b("h")) & may).select("a.h", "a.comp", b("comp").alias("comp2"))
    x = lists.select("h", "comp", *(F.col(c).alias(f"{c}1") for c in ("id", "n", "hot", "pos", "o", "n_m", "answered")))
    y = lists.select("h", F.col("comp").alias("comp2"), *(F.col(c).alias(f"{c}2") for c in ("id", "n", "hot", "pos", "o", "answered")))
    n1, n2, p1, p2, o1, o2 = (F.col(c) for c in ("n1", "n2", "pos1", "pos2", "o1", "o2"))
    need, hot = 4 * (n1 + n2), F.least("hot1", "hot2")
    is_hot = F.col("pos1") >= n1 - F.col("hot1")
    in_size = (5 * F.least(n1, n2) >= 4 * F.greatest(n1, n2)) & (9 * (F.least(p1, p2) + F.least(n1 - p1, n2 - p2)) >= need)
    most = F.least(o1, o2) + F.least(n1 - o1, n2 - o2)
    pairs = met.join(x, ["h", "comp"]).join(y, ["h", "comp2"]).where("not (answered1 and answered2)").where(in_size & F.coalesce(9 * most >= need, F.lit(True)) & (~is_hot | (9 * hot >= need)))
    # how many of the lists kept a link must share: where the hot shingles can't reach the overlap, so many others
    enough = 1 + F.floor(F.least(n1, n2) / 20)
    short_of = F.floor((need + 8) / 9) - hot
    enough = F.when(short_of > 0, F.least(enough, short_of)).otherwise(enough)
    found = pairs.groupBy(F.least("id1", "id2").alias("u"), F.greatest("id1", "id2").alias("v")).agg(
        F.count(F.lit(1)).alias("k"), F.max(F.coalesce(9 * (o1 + o2 - F.col("n_m1")) >= need, F.lit(False))).alias("sure"), F.min(enough).alias("enough")
    )
    # a pair's lists are all here, but for those in which a bound decided against it; there the pair is no link at all
    return found.where(F.col("sure") | (F.col("k") >= F.col("enough"))).select("u", "v", "sure")


def jaccard_components(docs: DataFrame, hot: int = HOT, hot_from: int = HOT_FROM, family: int = FAMILY) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id."""
    spark, docs = docs.sparkSession, id_text(docs)
    order = hot_shingles(docs, hot, hot_from)
    found = stored(summaries(docs, order))
    indexed = stored(found.where("n > 0 and doc_id is not null").groupBy("n", "a", "b").agg(F.min("doc_id").alias("id"), F.first("cold").alias("cold"), F.first("prefix").alias("prefix")))
    made = stored(found.select("doc_id", "n", "a", "b"))
    dropped(found)
    forget(spark)
    lists = stored(shared_lists(indexed))
    classes = stored(indexed.select("n", "a", "b", "id"))
    dropped(indexed)
    forget(spark)

    stars = lists.where("id <> m").groupBy(F.col("m").alias("u"), F.col("id").alias("v")).agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("n"))
    pairs = stored(stars.where("3 * k >= 1 + floor(n / 20)").select("u", "v"))
    sets = sets_for(pairs, docs)
    tested = overlaps(pairs, sets)
    links = tested.where(linked(F.col("o"), F.col("n_u"), F.col("n_v"))).select("u", "v")
    big = stored(tested.groupBy("u").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= family))
    links = stored(links.union(family_links(tested, big, sets)))
    comps = components(links)
    dropped(sets, pairs)
    forget(spark)

    placed = lists.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    mixed = placed.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("h")
    known = tested.join(big.select("u", F.lit(True).alias("answered")), "u", "left").select(F.col("u").alias("m"), F.col("v").alias("id"), "o", F.col("n_u").alias("n_m"), F.coalesce("answered", F.lit(False)).alias("answered"))
    left = stored(placed.join(mixed, "h").join(known, ["m", "id"], "left").withColumn("answered", F.coalesce("answered", F.lit(False))))
    dropped(lists)
    forget(spark)
    pairs = stored(cross_pairs(left).join(tested.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["u", "v"], "left_anti"))
    forget(spark)
    unsure = pairs.where("not sure").select("u", "v")
    more = overlaps(unsure, sets_for(unsure, docs))
    rest = more.where(linked(F.col("o"), F.col("n_u"), F.col("n_v"))).select("u", "v").union(pairs.where("sure").select("u", "v"))

    own = made.select("doc_id", "n", "a", "b").join(classes.select("n", "a", "b", "id"), ["n", "a", "b"], "left").select("doc_id", "n", F.coalesce("id", "doc_id").alias("id"))
    # rows that share an id are one node
    twice = own.where("doc_id is not null").groupBy("doc_id").agg(F.min("id").alias("u"), F.max("id").alias("hi")).where("u < hi")
    same = own.join(twice.select("doc_id", "u"), "doc_id").select("u", F.col("id").alias("v"))
    final = components(reduce(DataFrame.union, [links, rest, same]))
    forget(spark)
    return own.join(final, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "id").alias("component_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs whose id is its component's smallest, once each; documents without shingles all stay. Rows without id
    are nodes too, one for each text, and give way to any id (ids under 2 ** 62). Of rows that share an id that stays, one
    of each group of texts stays, linked directly or through others of that id."""
    docs, text = docs.withColumn("__id", F.col("doc_id").cast("long")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    if not docs.where("__id is null").isEmpty():
        most = max(0, docs.agg(F.max("__id")).first()[0] or 0)
        docs = docs.withColumn("__id", F.coalesce("__id", F.lit(most + 1) + F.pmod(F.xxhash64(text), F.lit((1 << 63) - 1 - most))))
    kept, again = _smallest(docs, how)
    if again.isEmpty():
        return kept.drop("__id")
    same = F.col("__id") == F.col("__again")
    once = kept.join(again, same, "left_anti")
    # each text of a shared id by itself
    several, again = _smallest(cut(kept.join(again, same, "left_semi").withColumn("__id", F.xxhash64("__id", text))), how)
    one = several.join(again, same, "left_semi").dropDuplicates(["__id"])
    return reduce(DataFrame.unionByName, [once, several.join(again, same, "left_anti"), one]).drop("__id")


def _smallest(docs: DataFrame, how: dict) -> tuple[DataFrame, DataFrame]:
    """Rows of docs whose __id is its component's smallest, and the ids (__again) of more than one row with shingles."""
    found = stored(jaccard_components(docs.select(F.col("__id").alias("doc_id"), "text"), **how))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    again = stored(found.where("n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("doc_id").alias("__again")))
    return docs.join(gone, F.col("__id") == F.col("__gone"), "left_anti"), again
