"""python -m allelith.cli COMMAND ...: the pipelines and filters over files, and any registered query over tables."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import simulate
from .operators import accuracy, count_model, graph, haplotypes, likelihood
from .plans import genotyping, imputing, vcf_filters
from .plans.registry import R
from .session import session
from .sources import genomics as io
from .store import stored


def _write(spark: SparkSession, source: str, rows: DataFrame, out: str) -> None:
    header = spark.createDataFrame([(h,) for h in io.vcf_header(spark, source)], "line string").coalesce(1)
    header.write.mode("overwrite").text(f"{out}/header")
    rows.orderBy("file_row").select("line").write.mode("overwrite").text(f"{out}/rows")


def _filtered(keep):
    def run(spark: SparkSession, a: argparse.Namespace) -> None:
        _write(spark, a.vcf, keep(spark, io.read_vcf(spark, a.vcf), a), a.out)

    return run


def _index(spark: SparkSession, a: argparse.Namespace) -> None:
    genotyping.build_index(spark, a.reference, a.vcf, a.out, genotyping.Config(k=a.k, modulo=a.modulo, max_paths=a.max_paths, min_af_deletions=a.min_af_deletions, helpers=not a.no_helper_model))


def _genotype(spark: SparkSession, a: argparse.Namespace) -> None:
    cfg = genotyping.Config(
        coverage=a.coverage, min_quality=a.min_quality, ignore_hom_ref=a.ignore_hom_ref, sample=a.sample, helpers=not a.ignore_helper_model, impute_svs=a.only_impute_svs, for_imputer=a.for_imputer
    )
    genotyping.genotype(spark, a.index, a.reads, a.out, cfg, a.debug)


def _accuracy(spark: SparkSession, a: argparse.Namespace) -> None:
    truth, sample = io.read_vcf(spark, a.truth), io.read_vcf(spark, a.sample)
    vcf_filters.score(truth, sample, a.limit_to, a.column, a.split).show(truncate=False)
    vcf_filters.score_by_type(truth, sample, io.read_regions(spark, a.regions) if a.regions else None).show(truncate=False)


def _clean_svs(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = vcf_filters.cleaned_svs(io.read_vcf(spark, a.vcf), io.read_genome(spark, a.reference), io.CHUNK).select(F.col("variant_id").alias("file_row"), "ref", "alt")
    _write(spark, a.vcf, vcf_filters.line(io.read_vcf(spark, a.vcf).drop("ref", "alt").join(rows, "file_row")), a.out)


def _haplotypes(spark: SparkSession, a: argparse.Namespace) -> None:
    io.haplotypes(io.read_vcf(spark, a.vcf)).write.mode("overwrite").parquet(a.out)


def _helpers(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = io.read_vcf(spark, a.vcf)
    genotypes = haplotypes.genotype_matrix(io.haplotypes(rows)).select("variant_id", "individual", "g")
    people = rows.select(F.max(F.size("samples"))).first()[0] or 0
    every = rows.select(F.col("file_row").alias("variant_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(people, 1) - 1).cast("bigint"))).alias("individual"))
    genotypes = stored(every.join(genotypes, ["variant_id", "individual"], "left").na.fill(0, ["g"]))
    helpers = stored(likelihood.first_if_none(stored(likelihood.best_helper(a.window)(genotypes))))
    io.save_bundle({"helpers": helpers, "prior": likelihood.combo_prior(stored(likelihood.combo_matrix(genotypes, helpers)))}, a.out)


def _count_model(spark: SparkSession, a: argparse.Namespace) -> None:
    tables, _ = io.load_bundle(spark, a.index)
    count_model.hist(a.max_count)(tables["copies"], tables["population_counts"]).write.mode("overwrite").parquet(a.out)


def _refine(spark: SparkSession, a: argparse.Namespace) -> None:
    model = spark.read.parquet(a.model)
    (count_model.with_prior(a.prior, a.max_count) if a.prior else count_model.refine(a.max_count))(model).write.mode("overwrite").parquet(a.out)


def _sparse_model(spark: SparkSession, a: argparse.Namespace) -> None:
    count_model.log_frequencies(spark.read.parquet(a.model)).write.mode("overwrite").parquet(a.out)


def _tricky(spark: SparkSession, a: argparse.Namespace) -> None:
    tables, _ = io.load_bundle(spark, a.index)
    found = count_model.tricky_variants(a.least)(tables["pairs"], tables["index"], tables["orig_model"])
    found.withColumn("tricky", F.expr("unsigned or sharing or unseen")).write.mode("overwrite").parquet(a.out)


def _nonunique(spark: SparkSession, a: argparse.Namespace) -> None:
    tables, _ = io.load_bundle(spark, a.index)
    graph.nonunique_kmers(tables["pairs"], tables["index"], tables["kmer_counts"]).write.mode("overwrite").parquet(a.out)


def _bundle(spark: SparkSession, a: argparse.Namespace) -> None:
    """name=folder of each table; a bundle to start from keeps its other tables."""
    tables, meta = io.load_bundle(spark, a.start) if a.start else ({}, {})
    tables |= {name: spark.read.parquet(folder) for name, _, folder in (t.partition("=") for t in a.table)}
    io.save_bundle(tables, a.out, **{k: v for k, v in meta.items() if k != "tables"})


def _simulate(spark: SparkSession, a: argparse.Namespace) -> None:
    contigs = io.read_fasta(spark, a.reference).select("chrom", F.lower("seq").alias("seq"))
    names = contigs.select("chrom", (F.row_number().over(Window.orderBy("chrom")) - 1).cast("bigint").alias("ix"))  # few rows without their sequences
    first = contigs.join(names, "chrom").withColumn("path_id", F.lit(0).cast("bigint"))
    second = io.read_fasta(spark, a.second).select("chrom", F.lower("seq").alias("seq")) if a.second else contigs
    both = first.unionByName(second.join(names, "chrom").withColumn("path_id", F.lit(1).cast("bigint")))
    io.write_fastq(simulate.reads(a.coverage, a.length, a.error, a.seed, a.insert)(both), a.out)


def _test(spark: SparkSession, a: argparse.Namespace) -> None:
    """Simulated genotypes, called from simulated counts with and without helpers."""
    found = stored(simulate.genotypes(a.individuals, a.coverage, a.seed)(spark.range(a.variants).withColumnRenamed("id", "variant_id")))
    known, asked = stored(found.where("individual > 0").select("variant_id", "individual", "g")), found.where("individual = 0")
    counts = asked.selectExpr("2 * variant_id as node_id", f"greatest(0, 2 * {a.coverage} - n) as n").union(asked.selectExpr("2 * variant_id + 1", "n"))
    loglik = stored(likelihood.naive_loglik(2.0 * a.coverage)(counts).select("variant_id", "l0", "l1", "l2"))
    helpers = stored(likelihood.first_if_none(stored(likelihood.best_helper()(known))))
    helped = likelihood.helper_posterior(likelihood.combo_prior(stored(likelihood.combo_matrix(known, helpers))), helpers, loglik).toDF("variant_id", "l0", "l1", "l2")
    name = lambda c: F.when(F.col(c) == 0, "0/0").when(F.col(c) == 1, "0/1").otherwise("1/1")
    truth = asked.select(F.col("variant_id").alias("k"), F.lit("snp").alias("type"), name("g").alias("gt"))
    for what, calls in (("counts alone", loglik), ("with helpers", helped)):
        called = likelihood.argmax_genotype(calls).select(F.col("variant_id").alias("k"), name("g").alias("gt"))
        print(what, accuracy.metrics(accuracy.confusion(accuracy.paired(truth, called))).first().asDict())


def _impute(spark: SparkSession, a: argparse.Namespace) -> None:
    ran = stored(imputing.run_regions(imputing.regions(io.read_vcf(spark, a.vcf), io.vcf_header(spark, a.vcf)), a.command))
    ran.write.mode("overwrite").parquet(a.out)
    if failed := ran.where("status <> 0").limit(3).collect():
        raise RuntimeError(f"regions failed, the first: {[(r.command, r.said) for r in failed]}")


def _naive(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = io.read_vcf(spark, a.vcf).select(F.col("file_row").alias("variant_id"), "chrom", "pos", "ref", "alt", F.lit("0/0").alias("gt"))
    even = likelihood.gl_gq(rows.select("variant_id", "chrom", "pos", *(F.lit(0.0).alias(f"l{g}") for g in range(3))))
    io.write_vcf(rows.join(even, "variant_id"), a.out, io.header_with_sample(io.vcf_header(spark, a.vcf), a.sample), likelihoods=True)


def _regions(spark: SparkSession, a: argparse.Namespace) -> None:
    imputing.regions(io.read_vcf(spark, a.vcf), io.vcf_header(spark, a.vcf)).write.mode("overwrite").parquet(a.out)


def _debug(spark: SparkSession, a: argparse.Namespace) -> None:
    """The saved report of some variants, or of all."""
    found = spark.read.parquet(a.report)
    (found.where(F.col("variant_id").isin(a.variants)) if a.variants else found).orderBy("variant_id").show(a.rows, truncate=False)


def _analyse(spark: SparkSession, a: argparse.Namespace) -> None:
    tables, _ = io.load_bundle(spark, a.index)
    found = genotyping.kmer_report(tables, tables["kmer_counts"])
    found.write.mode("overwrite").parquet(a.out)
    found.agg(F.sum(F.col("good").cast("int")).alias("good"), F.sum(F.col("supergood").cast("int")).alias("supergood"), F.count(F.lit(1)).alias("variants")).show()
    if a.truth:
        vcf_filters.score_by_type(io.read_vcf(spark, a.truth), io.read_vcf(spark, a.sample), io.read_regions(spark, a.regions) if a.regions else None).show(truncate=False)


def _free(spark: SparkSession, a: argparse.Namespace) -> None:
    spark.catalog.clearCache()


def _query(spark: SparkSession, a: argparse.Namespace) -> None:
    R.queries()[a.name](spark, a.tables).write.mode("overwrite").parquet(a.out)


def _number(kind: type, default) -> dict:
    return {"type": kind, "default": default}


FLAG, VCF_OUT, SAMPLE = {"action": "store_true"}, (("vcf", {}), ("out", {})), ("--sample", {"default": "sample"})
KINDS = {"choices": ["all", "snps", "indels", "snps_indels", "svs"], "default": "all"}
COMMANDS = {
    "index": (_index, (("reference", {}), *VCF_OUT, ("--k", _number(int, 31)), ("--modulo", _number(int, 200_000_033)), ("--max-paths", _number(int, 100)), ("--min-af-deletions", _number(float, 0.1)), ("--no-helper-model", FLAG))),
    "genotype": (
        _genotype,
        (
            ("index", {}), ("reads", {}), ("out", {}), ("--coverage", _number(float, 15.0)), ("--min-quality", _number(float, 0.0)), ("--ignore-hom-ref", FLAG), SAMPLE, ("--ignore-helper-model", FLAG),
            ("--only-impute-svs", FLAG), ("--for-imputer", FLAG), ("--debug", FLAG),
        ),
    ),
    "genotype_accuracy": (_accuracy, (("truth", {}), ("sample", {}), ("--limit-to", KINDS), ("--column", _number(int, 0)), ("--split", FLAG), ("--regions", {}))),
    "filter_variants": (_filtered(lambda s, v, a: vcf_filters.by_type_and_size(v, a.skip_snps, a.min_indel)), (*VCF_OUT, ("--skip-snps", FLAG), ("--min-indel", _number(int, 0)))),
    "remove_overlapping_indels": (_filtered(lambda s, v, a: vcf_filters.without_overlapping_indels(v)), VCF_OUT),
    "filter_snps_indels_covered_by_svs": (_filtered(lambda s, v, a: vcf_filters.without_covered_by_sv(v, a.sv_size_limit)), (*VCF_OUT, ("--sv-size-limit", _number(int, 50)))),
    "filter_deep_overlaps": (_filtered(lambda s, v, a: vcf_filters.without_deep_overlaps(v, a.most)), (*VCF_OUT, ("--most", _number(int, 3)))),
    "filter_low_freq_alleles": (_filtered(lambda s, v, a: vcf_filters.without_rare_alleles(v, a.min_af, a.only_deletions)), (*VCF_OUT, ("--min-af", _number(float, 0.1)), ("--only-deletions", FLAG))),
    "preprocess_sv_vcf": (_clean_svs, (("reference", {}), *VCF_OUT)),
    "convert_haploid_vcf": (_filtered(lambda s, v, a: vcf_filters.line(vcf_filters.diploid(v))), VCF_OUT),
    "convert_purebread_vcf": (_filtered(lambda s, v, a: vcf_filters.line(vcf_filters.diploid(v))), VCF_OUT),
    "make_sparse_haplotype_matrix": (_haplotypes, VCF_OUT),
    "create_helper_model": (_helpers, (*VCF_OUT, ("--window", _number(int, 100)))),
    "sample_node_counts_from_population": (_count_model, (("index", {}), ("out", {}), ("--max-count", _number(int, 20)))),
    "refine_sampling_model": (_refine, (("model", {}), ("out", {}), ("--max-count", _number(int, 20)), ("--prior", _number(float, 0.0)))),
    "make_sparse_count_model": (_sparse_model, (("model", {}), ("out", {}))),
    "find_tricky_variants": (_tricky, (("index", {}), ("out", {}), ("--least", _number(int, 1)))),
    "find_variants_with_nonunique_kmers": (_nonunique, (("index", {}), ("out", {}))),
    "make_index_bundle": (_bundle, (("out", {}), ("table", {"nargs": "*"}), ("--start", {}))),
    "simulate_reads": (
        _simulate,
        (("reference", {}), ("out", {}), ("--second", {}), ("--coverage", _number(float, 15.0)), ("--length", _number(int, 150)), ("--error", _number(float, 0.001)), ("--seed", _number(int, 1)), ("--insert", _number(int, 0))),
    ),
    "test": (_test, (("--variants", _number(int, 500)), ("--individuals", _number(int, 40)), ("--coverage", _number(int, 7)), ("--seed", _number(int, 1)))),
    "naive_genotyper": (_naive, (*VCF_OUT, SAMPLE)),
    "glimpse_index": (_regions, VCF_OUT),
    "glimpse": (_impute, (*VCF_OUT, ("--command", {"required": True}))),
    "debug": (_debug, (("report", {}), ("--variants", {"type": int, "nargs": "*"}), ("--rows", _number(int, 100)))),
    "analyse_variants": (_analyse, (("index", {}), ("out", {}), ("--truth", {}), ("--sample", {}), ("--regions", {}))),
    "free_memory": (_free, ()),
    "query": (_query, (("name", {"choices": sorted(R)}), ("tables", {}), ("out", {}))),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="allelith", description=__doc__)
    commands = parser.add_subparsers(required=True)
    for name, (run, args) in COMMANDS.items():
        p = commands.add_parser(name)
        for flag, how in args:
            p.add_argument(flag, **how)
        p.set_defaults(run=run)
    a = parser.parse_args(argv)
    a.run(spark or session(), a)


if __name__ == "__main__":
    main()
