"""One-permutation MinHash fingerprints in DataFrame expressions alone.

A text's words (lower case, split at white space) give hashes of five-word shingles, or of the whole sequence where there
are fewer. One hash per shingle: its top bits name one of BINS bins, the smallest hash of each bin is kept. An empty bin
b borrows from a bin chosen by hashing, so that borrowing is independent from bin to bin: PROBES draws h(b, k) are tried
until one hits a bin that isn't empty, then the bin x that minimises h(b, x) is taken. Each bin stores the low four bits
of a hash of (value, bin), packed sixteen to a long. Two unrelated bins agree with chance 1/16, so the share m of equal
bins is corrected to (m - 1/16) / (1 - 1/16), at least 0.

The next document comes from neighbours inside ranges of doc_id, cut at quantiles; the row at a cut is dealt to both its
ranges, so no table-wide order is needed and texts move once.

Defined cases: a null text counts as empty; texts without words have the empty fingerprint, like 1 to each other and 0 to
any other; rows of one doc_id are ordered by their text's hash, null ids are lowest; a lone document's next is itself;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty

BINS = 128
BIN_BITS = 7
PACK = 16
PROBES = 4
SHINGLE = 5
#: Rows of a range of doc_id, and the most ranges.
RANGE_ROWS, MOST_RANGES = 512, 65_536
GROUP = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text: Column) -> Column:
    """Hashes of a text's shingles; none if it has no words."""
    words = F.transform(F.filter(F.split(F.lower(text), r"[\x20\t-\r]+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def of(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(SHINGLE)) - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))
        return F.when(n >= SHINGLE, many).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return let(words, of)


def bin_of(h: Column) -> Column:
    """0 to BINS - 1, in the order of the hashes themselves."""
    return F.shiftright(h, 64 - BIN_BITS).cast("int") + BINS // 2


def smallest(hashes: Column) -> Column:
    """The smallest hash of each bin that has one."""
    return let(F.sort_array(hashes), lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))))


def digits(values: Column, bins: Column) -> Column:
    """BINS numbers below 16 from the bins that aren't empty: their values and, in the same order, their places."""
    none = lambda n: F.array_repeat(F.lit(None).cast("int"), n)
    low = lambda value, b: F.xxhash64(value, b).bitwiseAND(15)
    # for each bin, where its value is, or null
    places = F.concat(none(F.get(bins, F.lit(0))), F.flatten(F.transform(bins, lambda x, j: F.concat(F.array(j), none(F.coalesce(F.get(bins, j + 1), F.lit(BINS)) - x - 1)))))

    def filled(at: Column) -> Column:
        def source(b: Column) -> Column:
            probes = [F.get(at, F.pmod(F.xxhash64(b, F.lit(k)), F.lit(BINS)).cast("int")) for k in range(PROBES)]
            nearest = F.array_min(F.transform(bins, lambda x, j: F.struct(F.xxhash64(b, x, F.lit(-1)).alias("h"), j.alias("j"))))["j"]
            return F.coalesce(F.get(at, b), *probes, nearest)

        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: low(F.get(values, source(b)), b))

    return F.when(F.size(values) == BINS, F.transform(values, low)).otherwise(let(places, filled))


def packed(d: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(BINS // PACK - 1)),
        lambda j: F.aggregate(F.slice(d, j * PACK + 1, F.lit(PACK)), F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, 4).bitwiseOR(x)),
    )


def fingerprint(text: Column) -> Column:
    """array<bigint> of BINS / PACK longs, empty for a text without words."""
    of_values = lambda v: F.when(F.size(v) > 0, let(let(F.transform(v, bin_of), lambda b: digits(v, b)), packed)).otherwise(F.array().cast("array<bigint>"))
    return let(smallest(shingles(text)), of_values)


def hexed(f: Column) -> Column:
    return F.array_join(F.transform(f, lambda x: F.lpad(F.hex(x), PACK, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1."""

    def differ(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(0x1111111111111111))

    apart = F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda s, x: s + x)
    share = 1 - apart / F.lit(float(BINS))
    both = F.greatest(F.lit(0.0), (share - 1 / 16) / (1 - 1 / 16))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both).when(F.size(a) == F.size(b), 1.0).otherwise(0.0)


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """docs (doc_id, text, ...) with next_<c> of each carried column: that of the next document in descending doc_id, after
    the last the first."""
    total, low, high = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    n = max(1, min(MOST_RANGES, total // RANGE_ROWS))
    cuts: list[int] = []
    if n > 1 and low is not None:
        got = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 4 * n))).first()[0]
        cuts = sorted({c for c in got if c < high})
    # constants of the plan: written as one string, so that the plan stays small
    array = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>") if xs else F.array().cast("array<bigint>")
    every, coarse = array(cuts), array(cuts[GROUP - 1 :: GROUP])
    i = F.col("doc_id")
    below = lambda a: F.size(F.filter(a, lambda s: s < i))
    group = below(coarse)
    home = F.coalesce(let(group, lambda g: g * GROUP + below(F.slice(every, g * GROUP + 1, F.lit(GROUP)))), F.lit(0))
    at = lambda b, kind: F.struct(b.cast("int").alias("b"), F.lit(kind).alias("kind"))
    dealt = let(home, lambda b: F.array_compact(F.array(at(b, 0), F.when(F.get(every, b) == i, at(b + 1, 1)), F.when(i.eqNullSafe(F.lit(high).cast("bigint")), at(F.lit(0), 2)))))
    rows = docs.withColumn("__to", F.explode_outer(dealt)).select("*", "__to.b", "__to.kind").drop("__to")
    order = Window.partitionBy("b").orderBy(F.col("kind") == 2, F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "kind")
    return rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).where("kind = 0").drop("b", "kind")


def fingerprints(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    docs = with_next(docs.withColumn("f", fingerprint(F.col("text"))), ["text", "f"])
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring("next_text", F.lit(1), half))
    docs = docs.withColumn("edited", edited).withColumn("g", fingerprint(F.col("edited")))
    return docs.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        hexed(F.col("f")).alias("fingerprint"),
        hexed(F.col("g")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("g")).alias("near_edited"),
        likeness(F.col("f"), F.col("next_f")).alias("near_next"),
    )
