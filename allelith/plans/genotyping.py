"""The two pipelines: an index from a reference and a population, and genotypes of one individual from reads.

Each step is one operator; what more than one step reads is written to the shared folder once. Nothing is collected but the
VCF's header and the number of its samples.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import accuracy, count_model, graph, haplotypes, intervals, kmers, likelihood, variants
from ..sources import genomics as io
from ..store import stored
from . import vcf_filters


@dataclass(frozen=True)
class Config:
    """D32."""

    k: int = 31
    coverage: float = 15.0
    min_quality: float = 0.0
    ignore_hom_ref: bool = False
    sample: str = "sample"
    modulo: int = 200_000_033
    max_paths: int = 100
    sv_limit: int = 50
    min_af_deletions: float = 0.1
    max_count: int = 20
    scorer_haplotypes: int = 8
    window: int = 4
    helper_window: int = 100
    helpers: bool = True
    #: Structural variants get even odds, for an imputer to decide.
    impute_svs: bool = False
    #: Calls are for an imputer: no helpers, counts scaled to this coverage.
    imputer_coverage: float = 3.0
    for_imputer: bool = False


def checked(rows: DataFrame) -> DataFrame:
    """Rows, or an error that names the first fault; an index needs spelled-out alternatives, one a row, and their frequencies."""
    faults = variants.input_validation(vcf_filters.as_variants(rows)).where("not ok").limit(5).collect()
    if faults:
        raise ValueError(f"rows that an index can't be built from: {[(r.variant_id, r.reason) for r in faults]}")
    return rows


def build_index(spark: SparkSession, reference: str, vcf: str, path: str, cfg: Config | None = None) -> None:
    """Sites and paths of all variants of a VCF, their signatures and index, the population's count model and helpers."""
    cfg, size = cfg or Config(), io.CHUNK
    genome = stored(io.read_genome(spark, reference, size).withColumn("seq", F.translate(F.lower("seq"), "n", "a")), "genome")
    rows = checked(stored(io.read_vcf(spark, vcf), "vcf"))
    rows = vcf_filters.without_covered_by_sv(rows, cfg.sv_limit)
    # rows are numbered in the order of their places
    named = vcf_filters.as_variants(rows).withColumns({"own_ref": F.col("ref"), "own_alt": F.col("alt"), "ref": F.translate(F.lower("ref"), "n", "a"), "alt": F.translate(F.lower("alt"), "n", "a")})
    numbers = stored(intervals.numbered()(named).withColumnRenamed("variant_id", "file_row"), "numbers")
    named = stored(named.withColumnRenamed("variant_id", "file_row").join(numbers, "file_row").withColumnRenamed("nth", "variant_id"), "variants")
    spans = named.select("variant_id", "chrom", "pos", F.char_length("ref").cast("bigint").alias("len_ref"), F.char_length("alt").cast("bigint").alias("len_alt"), F.coalesce("af", F.lit(0.0)).alias("af"))
    cleared = intervals.low_af_deletions(cfg.min_af_deletions)(spans)
    padded = stored(intervals.merge_pad(size)(intervals.cleared_alleles(named.drop("own_ref", "own_alt"), cleared), genome), "padded")
    padded = padded.join(intervals.max_alleles_per_place(cfg.max_paths - 1)(padded).select("variant_id"), "variant_id", "left_semi")
    alleles = stored(intervals.group_sites()(padded), "alleles")
    sites = stored(intervals.sites(alleles), "sites")
    segments = stored(intervals.segments(size)(sites, intervals.contig_ends(size)(genome), intervals.padded_genome(cfg.k, size)(genome, sites)), "segments")

    # the population: haplotypes of sites, genotypes of variants
    people = rows.select(F.max(F.size("samples"))).first()[0] or 0
    carried = io.haplotypes(rows).withColumnRenamed("variant_id", "file_row").join(numbers, "file_row").select(F.col("nth").alias("variant_id"), "hap_id", "allele")
    carried = stored(carried.join(padded.select("variant_id"), "variant_id", "left_semi"), "carried")
    at_sites = stored(haplotypes.combined_alleles(carried, alleles), "haplotypes")
    everyone = spark.range(2 * people).withColumnRenamed("id", "hap_id")

    # paths, and all that is along them
    dense = graph.haplotype_paths(cfg.max_paths)(at_sites, sites, everyone)
    paths = graph.permuted_paths(dense, graph.path_matrix(3)(sites)) if people else graph.path_matrix(3)(sites)
    paths = stored(paths, "paths")
    paths = stored(graph.repair_paths(paths, graph.missing_alleles(sites, paths)), "paths")
    paths = stored(graph.append_paths(paths, graph.missing_alleles(sites, paths)), "paths")

    def walked(chosen: DataFrame) -> DataFrame:
        pieces = stored(graph.haplotype_pieces(size)(alleles, chosen, segments), "pieces")
        return stored(graph.with_context(cfg.k)(pieces, graph.haplotype_sequence(pieces)), "context")

    modulo = cfg.modulo * 40 + 11
    drawn = graph.site_kmers(cfg.k)(walked(graph.scorer_haplotypes(cfg.scorer_haplotypes)(at_sites, everyone, sites)))
    counter = stored(kmers.approx_counter(modulo)(kmers.both_ways(cfg.k)(drawn)), "scorer")
    context = walked(paths)
    windows = stored(graph.window_kmers(cfg.k)(graph.flanked(cfg.k)(context)), "windows")
    chosen = stored(graph.signature_select(modulo)(windows, counter), "signatures")
    chosen = stored(graph.signature_sv(modulo)(windows, counter, chosen), "signatures")
    index = stored(graph.kmer_index(cfg.k)(graph.signature_frequent(modulo)(chosen, counter)), "index")
    nodes, pairs = stored(graph.graph_nodes(alleles), "nodes"), stored(graph.variant_nodes(alleles), "pairs")

    # counts that each number of copies comes with
    along = stored(graph.site_kmers(cfg.k)(context), "kmers")
    every = graph.haplotype_paths(2 * people)(at_sites, sites, everyone) if people else dense
    taken = graph.haplotype_to_path(cfg.window)(stored(every, "dense"), paths)
    counted = stored(count_model.path_counts(taken, count_model.stretch_counts(along, index)), "counted")
    copies = stored(count_model.node_copies(max(people, 1))(nodes, at_sites), "copies")
    model = stored(count_model.hist(cfg.max_count)(copies, counted), "model")
    tricky = count_model.either_tricky(count_model.tricky()(model, nodes.select(F.col("node_id").alias("variant_id"))).select("node_id", "tricky"), graph.unsupported_alleles(nodes, index))
    tables = {
        "variants": named.join(padded.select("variant_id"), "variant_id", "left_semi").select("variant_id", "chrom", "pos", F.col("own_ref").alias("ref"), F.col("own_alt").alias("alt"), "af"), "index": index, "nodes": nodes, "pairs": pairs, "alleles": alleles,
        "model": count_model.refine(cfg.max_count)(model), "orig_model": model, "tricky": tricky, "copies": copies, "population_counts": counted,
        "kmer_counts": kmers.kmer_count(along.join(index.select("kmer").distinct(), "kmer", "left_semi")),
    }
    if cfg.helpers and people:
        genotypes = stored(_genotypes(padded.select("variant_id"), carried, people), "genotypes")
        helpers = stored(likelihood.first_if_none(stored(likelihood.best_helper(cfg.helper_window)(genotypes), "helpers")), "helpers")
        tables |= {"helpers": helpers, "prior": likelihood.combo_prior(stored(likelihood.combo_matrix(genotypes, helpers), "combo")), "freq": haplotypes.allele_freq_summary(genotypes)}
    io.save_bundle(tables, path, k=cfg.k, people=people, header=io.vcf_header(spark, vcf))


def _genotypes(ids: DataFrame, carried: DataFrame, people: int) -> DataFrame:
    """(variant_id, individual, g), dense; a genotype with a missing allele is no row."""
    every = ids.select("variant_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(people - 1).cast("bigint"))).alias("individual"))
    seen = carried.groupBy("variant_id", F.floor(F.col("hap_id") / 2).alias("individual")).agg(F.sum(F.coalesce(F.col("allele"), F.lit(0))).alias("g"), F.max(F.col("allele").isNull()).alias("lost"))
    return every.join(seen, ["variant_id", "individual"], "left").where("not coalesce(lost, false)").select("variant_id", "individual", F.coalesce("g", F.lit(0)).cast("bigint").alias("g"))


def node_counts(tables: dict[str, DataFrame], reads: DataFrame, cfg: Config) -> DataFrame:
    counts = kmers.node_counts(kmers.kmer_count(kmers.kmers(cfg.k)(reads)), tables["index"], tables["nodes"].select("node_id"))
    return likelihood.coverage_downscale(cfg.coverage, cfg.imputer_coverage)(counts) if cfg.for_imputer and cfg.coverage > cfg.imputer_coverage else counts


def call(tables: dict[str, DataFrame], counts: DataFrame, cfg: Config) -> DataFrame:
    """variant_id, chrom, pos, ref, alt, g, gt, and normalised log-likelihoods l0, l1, l2, from the nodes' counts."""
    coverage = min(cfg.coverage, cfg.imputer_coverage) if cfg.for_imputer else cfg.coverage
    per_node = likelihood.mixture_loglik(coverage)(tables["model"], counts)
    loglik = stored(likelihood.genotype_loglik(tables["pairs"], per_node, tables["tricky"]), "loglik")
    if "helpers" in tables and cfg.helpers and not cfg.for_imputer:
        posterior = likelihood.helper_posterior(tables["prior"], tables["helpers"], loglik).toDF("variant_id", "l0", "l1", "l2")
    else:
        posterior = loglik
    sized = variants.variant_types()(tables["variants"].select("variant_id", F.char_length("ref").cast("bigint").alias("len_ref"), F.char_length("alt").cast("bigint").alias("len_alt")))
    if cfg.impute_svs:
        posterior = likelihood.sv_uniform(posterior, sized).drop("tricky")
    calls = stored(tables["variants"].select("variant_id", "chrom", "pos", "ref", "alt").join(posterior, "variant_id"), "calls")
    resolved = likelihood.multiallelic_resolve(calls)
    sure = likelihood.min_quality(cfg.min_quality)(calls).select("variant_id", F.col("g").alias("best"))
    g = F.when(F.col("best") == 0, 0).otherwise(F.col("g"))
    gt = F.when(F.col("g") == 0, "0/0").when(F.col("g") == 1, "0/1").otherwise("1/1")
    return calls.join(resolved, "variant_id").join(sure, "variant_id").withColumn("g", g).withColumn("gt", gt).drop("best")


def genotype(spark: SparkSession, index: str, reads: str, out: str, cfg: Config | None = None, debug: bool = False) -> DataFrame:
    """Writes a single-sample VCF, the nodes' counts beside it and, with debug, all that calls rest on (S15); returns the calls."""
    cfg = cfg or Config()
    tables, meta = io.load_bundle(spark, index)
    cfg = replace(cfg, k=meta["k"])
    counts = stored(node_counts(tables, io.read_reads(spark, reads), cfg), "counts")
    calls = stored(call(tables, counts, cfg), "called")
    quality = likelihood.gl_gq(calls.select("variant_id", "chrom", "pos", "l0", "l1", "l2"))
    io.write_vcf(calls.join(quality, "variant_id"), out, io.header_with_sample(meta["header"], cfg.sample), likelihoods=True, ignore_hom_ref=cfg.ignore_hom_ref)
    counts.write.mode("overwrite").parquet(f"{out}.node_counts")
    if debug:
        report(tables, counts, calls).write.mode("overwrite").parquet(f"{out}.debug")
    return calls


def report(tables: dict[str, DataFrame], counts: DataFrame, calls: DataFrame) -> DataFrame:
    """What each call rests on."""
    helpers = tables["helpers"] if "helpers" in tables else tables["variants"].select("variant_id", F.lit(None).cast("bigint").alias("helper_id"))
    return accuracy.debug_report(tables["pairs"], counts, count_model.expected(tables["model"]), tables["tricky"], helpers, calls.select("variant_id", "g"))


def kmer_report(tables: dict[str, DataFrame], counts: DataFrame) -> DataFrame:
    """How often each variant's k-mers occur in a population's counts."""
    return graph.kmer_report(tables["pairs"], tables["index"], counts)
