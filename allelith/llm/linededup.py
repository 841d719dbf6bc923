"""Line dedup: a suffix array over sequences of line ids by distributed prefix doubling.

A document is the sequence of its lines that aren't blank. Repeated lines get ids in the order of their fingerprints;
lines that occur once end every match, so suffixes are kept for repeated lines alone. A suffix's rank at depth h is one
plus the number of suffixes that are smaller by their first h lines: depth 2h follows from the ranks of a suffix and of
the one h lines on, by counting pairs of ranks (a partial sum inside each old rank's pairs). Suffixes of one rank are an
interval of the suffix array whose longest common prefix reaches the depth. Intervals at the depth of `min_words` words
decide: a run of lines with `min_words` words or more that occurs before (by document id, then place) is a later copy,
and its lines are deleted. Depths above the lines that such a run needs are never built, as every longer repeated run
is a union of these.

The runs looked up are, for each line, the shortest run of min_words words that begins there and the shortest that ends
there: a line lies in a later copy of that many words or more if and only if one of those around it is a later copy.

No step needs all rows of a common line or run together: counts are summed before they move; a rank's successors, which
may be any number of lines, are numbered in RANGES ranges of their ranks; later copies are what is left of all runs once
the first of each is taken out, by its own place, which no two runs share. The joins that bring ranks to suffixes have one row
a key on one side, so that adaptive execution can split the other.

Defined cases: null and empty texts have no lines and stay as they are; a document whose lines are all deleted has an
empty text left; words are the blank-separated parts of a line; of documents with one id and different texts the one of
smaller text hash comes first; rows that repeat id and text are one document, treated alike, and never copies of each
other; a null id comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

MIN_WORDS = 50
#: The first ranks are counted in ranges of the fingerprint, whose offsets are a table of this many rows.
RANGES = 4096
KEY = ("doc_id", "th")


def _text(c: str = "text") -> Column:
    return F.col(c).cast("string")


def lines(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, th, i, p, w, h1, h2): the i-th line that isn't blank, at place p of all lines, with its words (min_words
    at most, as more don't matter) and 128-bit fingerprint."""
    trimmed = F.trim(F.col("l.x"))
    words = F.octet_length(trimmed) - F.octet_length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1
    split = F.filter(F.transform(F.split(F.col("text"), "\n", -1), lambda x, p: F.struct(p.alias("p"), x.alias("x"))), lambda l: F.trim(l["x"]) != "")
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text().alias("text"))
        .select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(split).alias("i", "l"))
        .select(*KEY, "i", F.col("l.p").alias("p"), F.least(words, F.lit(min_words)).cast("int").alias("w"), F.xxhash64(F.col("l.x")).alias("h1"), F.xxhash64(F.lit(1), F.col("l.x")).alias("h2"))
    )


def _same(a: str, b: str, cols) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return cond


def first_ranks(found: DataFrame) -> DataFrame:
    """(h1, h2, r) of every line that occurs more than once: r is one plus the occurrences of smaller fingerprints."""
    counted = stored(found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").withColumn("range", F.shiftright("h1", 52) + RANGES // 2))
    # RANGES rows at most
    offsets = counted.groupBy("range").agg(F.sum("c").alias("c")).select("range", (F.sum("c").over(Window.orderBy("range")) - F.col("c")).alias("before"))
    inside = Window.partitionBy("range").orderBy("h1", "h2")
    return counted.withColumn("upto", F.sum("c").over(inside)).join(F.broadcast(offsets), "range").select("h1", "h2", (F.col("before") + F.col("upto") - F.col("c") + 1).alias("r"))


def doubled(at: DataFrame, depth: int, top: int) -> DataFrame:
    """at with column r{2 * depth}: ranks by twice as many lines, null where the stretch of repeated lines ends before. top:
    the largest rank."""
    r, new = f"r{depth}", f"r{2 * depth}"
    along = Window.partitionBy("doc_id", "th").orderBy("i")
    at = at.withColumn("n", F.when(F.lead("i", depth).over(along) == F.col("i") + depth, F.lead(r, depth).over(along)))
    pairs = at.where("n is not null").groupBy(r, "n").agg(F.count(F.lit(1)).alias("c")).withColumn("range", F.floor(F.col("n") / (top // RANGES + 1)))
    # of the suffixes of one rank, those whose stretch ends come first; RANGES rows a rank at most
    offsets = pairs.groupBy(r, "range").agg(F.sum("c").alias("c")).select(r, "range", (F.sum("c").over(Window.partitionBy(r).orderBy("range")) - F.col("c")).alias("before"))
    inside = Window.partitionBy(r, "range").orderBy("n")
    ranks = pairs.withColumn("upto", F.sum("c").over(inside)).join(offsets, [r, "range"]).select(r, "n", (F.col(r) + F.col("before") + F.col("upto") - F.col("c")).alias(new))
    a, b = at.alias("a"), ranks.alias("b")
    return stored(a.join(b, (F.col(f"a.{r}") == F.col(f"b.{r}")) & (F.col("a.n") == F.col("b.n")), "left").select("a.*", f"b.{new}").drop("n"))


def suffixes(docs: DataFrame, min_words: int = MIN_WORDS) -> tuple[DataFrame, int]:
    """(doc_id, th, i, p, w, s, r1, r2, r4, ...) of every repeated line, s its stretch of repeated lines, and the largest
    depth built: the most lines that a shortest run of min_words words takes, rounded down to a power of two."""
    found = lines(docs, min_words)
    ranks = first_ranks(found)
    at = found.join(ranks, ["h1", "h2"]).drop("h1", "h2").dropDuplicates([*KEY, "i"]).withColumnRenamed("r", "r1")
    along = Window.partitionBy(*KEY).orderBy("i")
    stretch = Window.partitionBy(*KEY, "s").orderBy("i")
    at = at.withColumn("s", F.col("i") - F.row_number().over(along)).withColumn("upto", F.sum("w").over(stretch)).withColumn("before", F.col("upto") - F.col("w"))
    ahead = Window.partitionBy(*KEY, "s").orderBy("before").rangeBetween(0, min_words - 1)
    back = Window.partitionBy(*KEY, "s").orderBy("upto").rangeBetween(-(min_words - 1), 0)
    at = at.withColumn("fore", F.when(F.max("upto").over(ahead) - F.col("before") >= min_words, F.max("i").over(ahead) - F.col("i") + 1))
    at = at.withColumn("hind", F.when(F.col("upto") - F.min("before").over(back) >= min_words, F.col("i") - F.min("i").over(back) + 1))
    at = stored(at.select(*KEY, "i", "p", "s", "r1", "fore", "hind"))
    most, top = (x or 1 for x in at.agg(F.max(F.greatest("fore", "hind")), F.max("r1")).first())
    depth = 1
    while 2 * depth <= most:
        at, depth = doubled(at, depth, top), 2 * depth
    return at, depth


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, runs): for each document with deleted lines, its maximal runs of them as (a, b), places of all lines."""
    at, depth = suffixes(docs, min_words)
    starts = at.select(*KEY, "i", "fore", "hind").select(
        *KEY, F.explode(F.array(F.struct(F.col("i").alias("i"), F.col("fore").alias("n")), F.struct((F.col("i") - F.col("hind") + 1).alias("i"), F.col("hind").alias("n")))).alias("x")
    )
    runs = starts.select(*KEY, "x.*").where("n is not null").dropDuplicates([*KEY, "i", "n"])
    # the rank at the largest depth within a run's lines, at its start and at its end: equal for equal runs alone
    level = F.lit(0)
    for k in range(1, depth.bit_length()):
        level = F.when(F.col("n") >= 1 << k, F.lit(k)).otherwise(level)
    runs = runs.withColumn("k", level)
    pick = lambda t: F.get(F.array(*(F.col(f"{t}.r{1 << k}") for k in range(depth.bit_length()))), F.col("x.k"))
    x, a, b = runs.alias("x"), at.alias("a"), at.alias("b")
    named = (
        x.join(a, _same("x", "a", KEY) & (F.col("x.i") == F.col("a.i")))
        .join(b, _same("x", "b", KEY) & (F.col("x.i") + F.col("x.n") - F.expr("shiftleft(1, x.k)") == F.col("b.i")))
        .select(*(f"x.{c}" for c in (*KEY, "i", "n")), pick("a").alias("u"), pick("b").alias("v"))
    )
    named = stored(named)
    first = named.groupBy("n", "u", "v").agg(F.min(F.struct(*KEY, "i")).alias("f")).select("n", "f.*")
    f, x = first.alias("f"), named.alias("x")
    copies = x.join(f, _same("x", "f", (*KEY, "i", "n")), "left_anti")
    gone = copies.select(*KEY, F.explode(F.sequence("i", F.col("i") + F.col("n") - 1)).alias("i")).dropDuplicates([*KEY, "i"])
    g, a = gone.alias("g"), at.alias("a")
    gone = g.join(a, _same("g", "a", (*KEY, "i"))).select(*(f"g.{c}" for c in (*KEY, "i")), "a.p")
    island = gone.withColumn("s", F.col("i") - F.row_number().over(Window.partitionBy(*KEY).orderBy("i")))
    spans = island.groupBy(*KEY, "s").agg(F.min("p").alias("a"), F.max("p").alias("b"), F.count(F.lit(1)).alias("n"))
    return spans.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("a", "b", "n"))).alias("runs"))


def without(text: Column, runs: Column) -> Column:
    """text without its lines a to b of each run, blank lines between them included."""

    def kept(all_lines: Column, j: Column) -> Column:
        start = F.coalesce(F.get(runs, j - 1)["b"] + 1, F.lit(0))
        end = F.coalesce(F.get(runs, j)["a"], F.size(all_lines))
        return F.slice(all_lines, start + 1, F.greatest(end - start, F.lit(0)))

    bound = F.transform(F.array(F.split(text, "\n", -1)), lambda x: F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), lambda j: kept(x, j))), "\n"))
    return F.element_at(bound, 1)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, prefix: str = "") -> DataFrame:
    """docs with text as left by the deletions, and n_runs, n_deleted (lines that aren't blank): all rows, all columns."""
    names = docs.columns
    keyed = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__th": F.xxhash64(_text())})
    gone = later_copies(docs, min_words).select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), F.col("runs").alias("__runs"))
    joined = keyed.join(gone, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__t")), "left")
    text = F.when(F.col("__runs").isNull(), _text()).otherwise(without(_text(), F.col("__runs")))
    return joined.select(
        *(text.alias(c) if c == "text" else F.col(c) for c in names),
        F.coalesce(F.size("__runs"), F.lit(0)).alias("__n_runs"),
        F.coalesce(F.aggregate("__runs", F.lit(0).cast("long"), lambda s, r: s + r["n"]), F.lit(0)).alias("__n_deleted"),
    )


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each document: doc_id, n_lines, n_runs, n_deleted, text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text().alias("text"))
    got = dedup_lines(docs.withColumn("n_lines", F.coalesce(F.size(F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")), F.lit(0))), min_words)
    return got.select("doc_id", "n_lines", F.col("__n_runs").alias("n_runs"), F.col("__n_deleted").cast("long").alias("n_deleted"), "text")


def keep_first_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs with later copies' lines deleted; documents of which nothing is left go, n_chars follows the text."""
    got = dedup_lines(docs, min_words)
    got = got.where((F.col("__n_deleted") == 0) | (F.trim(F.regexp_replace("text", "\n", "")) != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        got = got.withColumn("n_chars", F.when(F.col("__n_deleted") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return got.select(*docs.columns)
