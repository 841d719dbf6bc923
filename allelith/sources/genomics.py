"""Readers and writers of VCF, FASTA and FASTQ text and of index directories.

Positions in files are 1-based, in tables 0-based. Compressed files are read by Spark itself; everything is a DataFrame,
columns that a query doesn't use are pruned.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VCF_FIELDS = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")
#: Header lines added before the column line.
FORMAT_LINES = (
    '##FILTER=<ID=PASS,Description="All filters passed">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=GL,Number=G,Type=Float,Description="Genotype likelihood">',
    '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotype quality">',
)
CHUNK = 1 << 16


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Chrom, pos, id, ref, alt, qual, filter, info, format, samples (genotype columns), line (the raw row).

    Lines of one file keep their order in `file_row`."""
    lines = spark.read.text(path).withColumn("file_row", F.monotonically_increasing_id()).where("value not like '#%' and trim(value) <> ''")
    f = F.split("value", "\t")
    cols = [F.get(f, i).alias(c) if c != "pos" else (F.get(f, i).try_cast("bigint") - 1).alias("pos") for i, c in enumerate(VCF_FIELDS)]
    return lines.select("file_row", *cols, F.slice(f, 10, F.greatest(F.size(f) - 9, F.lit(0))).alias("samples"), F.col("value").alias("line"))


def vcf_header(spark: SparkSession, path: str) -> list[str]:
    """Header lines in order; a header's size doesn't grow with the rows."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where("value like '#%'").orderBy("at")
    return [r.value for r in lines.select("value").collect()]


def contigs_of(header: list[str]) -> list[str]:
    """S5."""
    return [line.split("ID=")[1].split(",")[0].split(">")[0] for line in header if line.startswith("##contig") and "ID=" in line]


def haplotypes(vcf: DataFrame) -> DataFrame:
    """(variant_id, hap_id, allele) of alleles that aren't 0; a missing allele is null. Genotypes are diploid: individual i
    has haplotypes 2i and 2i + 1; a third allele is an error, and the one allele of a haploid genotype goes to 2i."""
    calls = vcf.select(F.col("file_row").alias("variant_id"), F.posexplode("samples").alias("sample", "call"))
    parts = calls.select("variant_id", "sample", F.posexplode(F.split(F.split_part("call", F.lit(":"), F.lit(1)), r"[|/]")).alias("hap", "a"))
    allele = F.col("a").try_cast("int")
    hap = F.when(F.col("hap") < 2, F.col("hap")).otherwise(F.raise_error(F.concat(F.lit("more than two alleles in row "), F.col("variant_id").cast("string"))))
    return parts.select("variant_id", (2 * F.col("sample") + hap).cast("bigint").alias("hap_id"), allele.alias("allele")).where("allele is null or allele <> 0")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(chrom, seq), a row for each record: for reads and other short sequences; genomes are read by `read_genome`."""
    records = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    head = F.split_part("value", F.lit("\n"), F.lit(1))
    return records.select(F.split_part(head, F.lit(" "), F.lit(1)).alias("chrom"), F.regexp_replace(F.substring("value", F.char_length(head) + 1, F.char_length("value")), r"\s", "").alias("seq"))


def read_genome(spark: SparkSession, path: str | list[str], chunk: int = CHUNK) -> DataFrame:
    """(chrom, ck, seq): the bases ck * chunk up to (ck + 1) * chunk of a contig.

    No row or task holds a contig: lines are placed by sums within their split of the file, what a split begins in the middle of by sums
    over the splits before it (a row for each split), and gathered by chunk."""
    # a split is read by one task, in order
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("at"))
    head, own = F.col("value").startswith(">"), Window.partitionBy("f", "b").orderBy("at")
    lines = lines.withColumn("seq", F.when(head, "").otherwise(F.regexp_replace("value", r"\s", "")))
    lines = lines.withColumn("s", F.sum(F.char_length("seq")).over(own) - F.char_length("seq"))
    lines = lines.withColumn("own", F.last(F.when(head, F.struct(F.split_part(F.substring("value", 2, 1 << 20), F.lit(" "), F.lit(1)).alias("name"), "s")), ignorenulls=True).over(own))
    splits = lines.groupBy("f", "b").agg(F.sum(F.char_length("seq")).alias("n"), F.max_by("own", "at").alias("own"))
    # bases of the file before each split, and the last head before it with its place among the file's bases
    before = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0)))
    splits = splits.withColumn("came", F.last(F.when(F.col("own").isNotNull(), F.struct(F.col("own.name").alias("name"), (F.col("skip") + F.col("own.s")).alias("s"))), ignorenulls=True).over(before))
    placed = lines.where(F.char_length("seq") > 0).join(splits.select("f", "b", "skip", "came"), ["f", "b"])
    from_own = F.col("own").isNotNull()
    placed = placed.select(F.when(from_own, F.col("own.name")).otherwise(F.col("came.name")).alias("chrom"), F.when(from_own, F.col("s") - F.col("own.s")).otherwise(F.col("skip") + F.col("s") - F.col("came.s")).alias("s"), "seq")
    placed = placed.where("chrom is not null")
    last = F.floor((F.col("s") + F.char_length("seq") - 1) / chunk)
    cut = placed.select("chrom", "s", "seq", F.explode(F.sequence(F.floor(F.col("s") / chunk), last)).alias("ck"))
    start = F.greatest(F.col("ck") * chunk, F.col("s"))
    end = F.least((F.col("ck") + 1) * chunk, F.col("s") + F.char_length("seq"))
    pieces = cut.select("chrom", "ck", start.alias("s"), F.substring("seq", (start - F.col("s") + 1).cast("int"), (end - start).cast("int")).alias("seq"))
    return pieces.groupBy("chrom", "ck").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "seq"))), lambda x: x["seq"]), "").alias("seq"))


def genome_chunks(contigs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(chrom, ck, seq) of contigs that are rows already."""
    at = contigs.where("length(seq) > 0").select("chrom", "seq", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.char_length("seq") - 1) / chunk))).alias("ck"))
    return at.select("chrom", "ck", F.substring("seq", (F.col("ck") * chunk + 1).cast("int"), F.lit(chunk)).alias("seq"))


def read_reads(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(read_id, seq) of FASTQ or FASTA reads, lower case; one format for all files.

    FASTQ is cut where a line begins with @. That is a record's head, or a quality line that begins so: the piece before it then
    still holds the record's id and sequence, and the piece it begins has no line with + as its third, so it is dropped. Pieces
    need no order, so files may be many and split anywhere, and nothing is shuffled."""
    first = path if isinstance(path, str) else path[0]
    if any(first.removesuffix(".gz").endswith(e) for e in (".fa", ".fasta")):
        return read_fasta(spark, path).select(F.col("chrom").alias("read_id"), F.lower("seq").alias("seq"))
    line = F.split(F.regexp_replace("value", "\r", ""), "\n")
    records = spark.read.option("lineSep", "\n@").text(path).select(line.alias("l")).where(F.coalesce(F.get("l", F.lit(2)).startswith("+"), F.lit(False)))
    # the mark of a file's first record isn't part of a separator
    return records.select(F.regexp_replace(F.get("l", F.lit(0)), "^@", "").alias("read_id"), F.lower(F.get("l", F.lit(1))).alias("seq"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """BED rows as (chrom, s, e), half-open."""
    f = F.split("value", r"\s+")
    return spark.read.text(path).where("value not like '#%' and trim(value) <> ''").select(F.get(f, 0).alias("chrom"), F.get(f, 1).cast("bigint").alias("s"), F.get(f, 2).cast("bigint").alias("e"))


def read_imputer_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Id, chromosome, input region, output region."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(*(F.get(f, i).alias(c) for i, c in enumerate(("id", "chrom", "input_region", "output_region"))))


def header_with_sample(header: list[str], sample: str, likelihoods: bool = True) -> list[str]:
    """With likelihoods, format lines before the last two lines; the column line cut to nine columns and the sample."""
    columns = "\t".join([*[*header[-1].split("\t"), "FORMAT"][:9], sample])
    top = header[:-1]
    return [*top[:-1], *FORMAT_LINES, *top[-1:], columns] if likelihoods else [*top, columns]


def vcf_lines(calls: DataFrame, likelihoods: bool = False, ignore_hom_ref: bool = False) -> DataFrame:
    """(chrom, pos, line) from chrom, pos, ref, alt, gt and, if asked for, g0, g1, g2, gq. Likelihoods are left
    out if any row has more than one alternative."""
    if ignore_hom_ref:
        calls = calls.where("gt <> '0/0'")
    if likelihoods and not calls.where("alt like '%,%'").isEmpty():
        likelihoods = False
    number = lambda c: F.when(F.col(c) == 0, "-0.00000000001").otherwise(F.format_string("%.6f", F.col(c).cast("double")))
    value: Column = F.concat_ws(":", "gt", F.concat_ws(",", number("g0"), number("g1"), number("g2")), F.col("gq").cast("string")) if likelihoods else F.col("gt")
    fields = [F.col("chrom"), (F.col("pos") + 1).cast("string"), F.concat(F.lit("variant"), F.col("variant_id").cast("string")), F.col("ref"), F.col("alt"), *[F.lit(".")] * 3, F.lit("GT:GL:GQ" if likelihoods else "GT"), value]
    return calls.select("chrom", "pos", "variant_id", F.concat_ws("\t", *fields).alias("line"))


def write_vcf(calls: DataFrame, path: str, header: list[str], **how) -> None:
    """Part files in genome order: sorted by range, so no task holds all rows; the header is the first part."""
    spark = calls.sparkSession
    top = spark.createDataFrame([(line,) for line in header], "line string").coalesce(1)
    body = vcf_lines(calls, **how).orderBy("chrom", "pos", "variant_id").select("line")
    top.write.mode("overwrite").text(f"{path}/header")
    body.write.mode("overwrite").text(f"{path}/rows")


def write_fastq(reads: DataFrame, path: str) -> None:
    """Four lines a record, one quality throughout."""
    reads.select(F.concat_ws("\n", F.concat(F.lit("@"), F.col("read_id").cast("string")), "seq", F.lit("+"), F.expr("repeat('I', length(seq))")).alias("value")).write.mode("overwrite").text(path)


def save_bundle(tables: dict[str, DataFrame], path: str, **meta) -> None:
    """An index is a directory of Parquet tables and their list."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps({"tables": sorted(tables), **meta}),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/_meta")


def load_bundle(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    meta = json.loads("".join(r.value for r in spark.read.text(f"{path}/_meta").collect()))
    return {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}, meta
