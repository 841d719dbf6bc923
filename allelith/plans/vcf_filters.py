"""Filters over VCF rows as read by sources.genomics.read_vcf; each keeps rows as they are, raw line included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import accuracy, intervals, variants


def as_spans(vcf: DataFrame) -> DataFrame:
    """variant_id, chrom, pos, allele lengths (the longest alternative's of a comma list) and whether an allele holds an N."""
    longest = F.array_max(F.transform(F.split("alt", ","), lambda a: F.char_length(a)))
    lost = F.col("ref").ilike("%n%") | F.col("alt").ilike("%n%")
    return vcf.select(F.col("file_row").alias("variant_id"), "chrom", "pos", F.char_length("ref").cast("bigint").alias("len_ref"), longest.cast("bigint").alias("len_alt"), lost.alias("has_n"))


def as_variants(vcf: DataFrame) -> DataFrame:
    """variant_id, chrom, pos, ref, alt and the largest AF of INFO."""
    af = F.array_max(F.transform(F.split(F.regexp_extract("info", "(^|;)AF=([^;]+)", 2), ","), lambda x: x.try_cast("double")))
    return vcf.select(F.col("file_row").alias("variant_id"), "chrom", "pos", "ref", "alt", af.alias("af"))


def _keep(vcf: DataFrame, ids: DataFrame) -> DataFrame:
    return vcf.join(ids.select(F.col("variant_id").alias("file_row")), "file_row", "left_semi")


def by_type_and_size(vcf: DataFrame, skip_snps: bool = False, min_indel: int = 0) -> DataFrame:
    return _keep(vcf, variants.filter_variants(skip_snps, min_indel)(as_spans(vcf)))


def without_overlapping_indels(vcf: DataFrame) -> DataFrame:
    return _keep(vcf, intervals.overlapping_indels()(as_spans(vcf)))


def without_covered_by_sv(vcf: DataFrame, limit: int = 50) -> DataFrame:
    return _keep(vcf, intervals.covered_by_sv(limit)(as_spans(vcf)).where("not covered"))


def without_deep_overlaps(vcf: DataFrame, most: int = 3) -> DataFrame:
    """Rows no base of which is under more rows than the limit."""
    return _keep(vcf, intervals.max_depth(most)(intervals.stabbing_count()(as_spans(vcf))))


def without_rare_alleles(vcf: DataFrame, min_af: float = 0.1, only_deletions: bool = False) -> DataFrame:
    """A row without a frequency counts as of frequency 0."""
    return _keep(vcf, intervals.best_per_place(min_af)(as_variants(vcf)).where("not dropped_deletion" if only_deletions else "not dropped"))


def cleaned_svs(vcf: DataFrame, genome: DataFrame, size: int) -> DataFrame:
    """genome: in chunks of `size` bases."""
    called = F.size(F.filter("samples", lambda s: ~F.split_part(s, F.lit(":"), F.lit(1)).rlike(r"^[./|]*$")))
    end = F.regexp_extract("info", "(^|;)END=([0-9]+)", 2).try_cast("bigint")
    return variants.clean_svs(size)(vcf.select(F.col("file_row").alias("variant_id"), "chrom", "pos", "ref", "alt", end.alias("e"), F.when(F.size("samples") > 0, called).otherwise(1).alias("n_called")), genome)


def diploid(vcf: DataFrame) -> DataFrame:
    """Haploid genotypes doubled; any genotype but 0, 1 and . is an error."""
    two = lambda s: F.when(s == "0", "0|0").when(s == "1", "1|1").when(s == ".", ".|.").otherwise(F.raise_error(F.concat(F.lit("not a haploid genotype: "), s)))
    return vcf.withColumn("samples", F.transform("samples", two))


def line(vcf: DataFrame) -> DataFrame:
    """Rows as VCF lines from their fields."""
    fields = ["chrom", (F.col("pos") + 1).cast("string"), "id", "ref", "alt", "qual", "filter", "info", "format"]
    return vcf.select("file_row", F.concat_ws("\t", *fields, F.array_join("samples", "\t")).alias("line"))


def score(truth: DataFrame, sample: DataFrame, kind: str = "all", column: int = 0, split: bool = False) -> DataFrame:
    """Recall, precision, F1 and concordances of a sample's calls, both VCF rows; `column` is the genotype column of both.

    Alternatives are compared in sorted order, whatever order either file lists them in (J12). With split, a row of several is one
    row for each. `kind` limits both to a type of variant (P10). Raises if the sample has a variant that the truth doesn't have."""
    t, s = keyed(truth, truth, column, split), keyed(sample, truth, column, split)
    if not (unknown := accuracy.unknown_calls(t, s)).isEmpty():
        near = accuracy.closest_keys(unknown, t).limit(5).collect()
        raise ValueError(f"variants that the truth doesn't have: {[r.k for r in unknown.limit(5).collect()]}; at their places it has {[r.near for r in near]}")
    t, s = variants.limit_types(kind)(t), variants.limit_types(kind)(s)
    return accuracy.metrics(accuracy.confusion(accuracy.paired(t, s)))


def keyed(vcf: DataFrame, reference: DataFrame, column: int = 0, split: bool = False) -> DataFrame:
    """(k, type, gt): a row's key, type and genotype, alternatives as the reference lists them."""

    def calls(rows: DataFrame) -> DataFrame:
        longest = F.greatest(F.char_length("ref"), F.array_max(F.transform(F.split("alt", ","), lambda a: F.char_length(a))))
        kind = F.when(longest >= 50, "sv").when(longest > 1, "indel").otherwise("snp")
        return rows.select(F.col("file_row").alias("row_id"), "chrom", "pos", "ref", F.col("alt").alias("alts"), kind.alias("type"), F.get("samples", F.lit(column)).alias("gt"))

    found = accuracy.split_calls(calls(vcf)) if split else accuracy.by_sorted_alts(calls(vcf), calls(reference))
    return found.select("k", "type", "gt")


def score_by_type(truth: DataFrame, sample: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """A10: recall and precision by type; with regions (chrom, s, e), calls that the truth doesn't have count inside them alone."""
    t, s = keyed(truth, truth), keyed(sample, truth)
    inside = as_spans(sample)
    if regions is not None:
        inside = inside.join(intervals.regions_hit(inside, regions), "variant_id", "left_semi")
    places = sample.join(inside.select(F.col("variant_id").alias("file_row")), "file_row", "left_semi")
    return accuracy.rates_in_regions(t, s, keyed(places, truth).select("k"))
