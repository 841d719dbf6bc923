"""Every query by name, its operators bound to the relations derived from the driver's tables.

The graph's queries run the whole chain from variants to count model on small spans: K is 11, chunks of the genome 64 bases, so
that all that is done at the borders of chunks and bins is done here too. Relations that several others read are marked `once`.
"""

from __future__ import annotations

from ..functions import simulate
from ..operators import accuracy as A
from ..operators import count_model as C
from ..operators import graph as G
from ..operators import haplotypes as H
from ..operators import intervals as I
from ..operators import kmers as K
from ..operators import likelihood as L
from ..operators import variants as V
from ..sources import bridge as B
from . import oracle
from .relation import Op, Registry

R = Registry()
KMER, CHUNK, BIN, PEOPLE = 11, 64, 128, 6

# k-mers and sketches over all reads
read_kmers = K.kmers(KMER).over(reads=B.reads)
counts = R.add("kmer_count", K.kmer_count.over(kmers=read_kmers).once())
R.add("kmer_text", K.kmer_text(KMER).over(counts=counts))
backward = K.kmer_count.over(kmers=K.kmers(KMER).over(reads=K.reverse_complement.over(reads=B.reads)))
R.add("kmer_revcomp", backward)
R.add("kmer_both_strands", K.both_strands.over(forward=counts, backward=backward))
counter = R.add("approx_kmer_counter", K.approx_counter().over(kmers=read_kmers).once())
R.add("min_count_sketch", K.min_count_sketch().over(kmers=read_kmers))

# variants and intervals
genome = I.genome(CHUNK).over(contigs=B.contigs).once()
R.add("input_validation", V.input_validation.over(variants=B.raw_variants))
R.add("without_symbolic", V.without_symbolic.over(variants=B.raw_variants))
merged = R.add("interval_merge_pad", I.merge_pad(CHUNK, BIN).over(variants=B.variants, genome=genome).once())
R.add("variant_numbering", I.numbered(BIN).over(variants=B.variants))
R.add("distance_to_edge", I.distance_to_edge.over(variants=B.variants, merged=merged))
R.add("group_multiallelic_sites", I.group_sites(BIN).over(variants=merged))
stripped = R.add("strip_anchor", V.strip_anchor.over(variants=B.variants))
R.add("same_start_conflicts", I.same_start_conflicts.over(variants=stripped))
R.add("max_alleles_per_place", I.max_alleles_per_place().over(variants=merged))
R.add("too_many_alleles", I.too_many_alleles().over(variants=merged, sources=Op("sources", "variants", "select variant_id, variant_id - variant_id % 2 as source_id from {variants}", variants=merged)))
depths = R.add("overlap_depth", I.stabbing_count().over(spans=B.spans))
R.add("max_depth_filter", I.max_depth().over(depths=depths))
R.add("covered_by_sv", I.covered_by_sv().over(spans=B.spans))
R.add("overlapping_indels", I.overlapping_indels().over(spans=B.spans))
R.add("low_af_deletions", I.low_af_deletions().over(spans=B.spans))
R.add("cleared_alleles", I.cleared_alleles.over(variants=B.variants, cleared=Op("cleared", "variants", "select variant_id, af < 0.3 and length(ref) > 4 as cleared from {variants}", variants=B.variants)))
R.add("af_best_per_position", I.best_per_place().over(variants=B.raw_variants))
regions = Op("regions", "orders", "select case o_orderstatus when 'F' then 'A' when 'O' then 'N' else 'R' end as chrom, o_custkey * 100 as s, o_custkey * 100 + 50 as e from {orders}")
R.add("regions_hit", I.regions_hit.over(spans=B.spans, regions=regions))
R.add("near_neighbour", I.near_neighbour().over(spans=B.spans))
R.add("filter_variants", V.filter_variants().over(spans=B.spans))
typed = R.add("variant_types", V.variant_types().over(spans=B.spans))
R.add("limit_types", V.limit_types("snps_indels").over(typed=typed))
R.add("in_multiallelic", V.in_multiallelic.over(variants=B.variants))
multi = R.add("multiallelic_rows", V.multi.over(variants=B.variants))
R.add("split_multiallelic", V.split_multiallelic.over(multi=multi))
R.add("max_alleles_filter", V.max_alleles(2).over(multi=multi))
R.add("alt_order", A.alt_order.over(multi=multi))
R.add("pad_anchor", V.pad_anchor(CHUNK).over(variants=stripped, genome=genome))
R.add("replace_ns", V.replace_ns.over(variants=B.variants))
records = Op(
    "records",
    "variants",
    """select variant_id, chrom, pos, ref, case when variant_id % 9 = 0 then '<CN0>' when variant_id % 11 = 0 then '<INS>' else alt end as alt, case when variant_id % 18 = 9 then null else pos + length(ref) end as e,
         variant_id % 5 as n_called, concat('AC=1;AF=', cast(variant_id % 10 as string), 'e-1,0.2;END=', cast(pos as string)) as info from {variants}""",
    variants=B.variants,
)
R.add("clean_svs", V.clean_svs(CHUNK).over(records=records, genome=genome))
R.add("info_fields", V.allele_frequency.over(records=records))
R.add("region_chunks", G.region_chunks.over(spans=B.spans))

# the graph: sites, haplotypes, paths
padded = I.merge_pad(CHUNK, BIN).over(variants=B.few_variants, genome=genome).once()
few = Op("few", "variants allowed", "select v.* from {variants} v where v.variant_id in (select variant_id from {allowed})", variants=padded, allowed=I.max_alleles_per_place().over(variants=padded))
alleles = R.add("site_alleles", I.group_sites(BIN).over(variants=few).once())
sites = R.add("sites", I.sites.over(alleles=alleles).once())
segments = R.add("segments", I.segments(CHUNK, BIN).over(sites=sites, ends=I.contig_ends(CHUNK).over(genome=genome), genome=I.padded_genome(KMER, CHUNK).over(genome=genome, sites=sites)).once())
site_haplotypes = R.add("combined_alleles", H.combined_alleles.over(haplotypes=B.carried, alleles=alleles).once())
carriers = H.carriers.over(haplotypes=site_haplotypes)
R.add("path_matrix", G.path_matrix().over(sites=sites))
R.add("path_matrix_shifted", G.path_matrix_shifted().over(sites=sites))
R.add("path_matrix_columns", G.path_matrix_columns().over(sites=sites))
few_paths = G.path_matrix(1).over(sites=sites)
missing = R.add("missing_alleles", G.missing_alleles.over(sites=sites, paths=few_paths))
R.add("path_append", G.append_paths.over(paths=few_paths, missing=missing))
R.add("path_repair", G.repair_paths.over(paths=G.path_matrix().over(sites=sites), missing=G.missing_alleles.over(sites=sites, paths=G.path_matrix().over(sites=sites))))
dense = R.add("haplotype_paths", G.haplotype_paths(100).over(haplotypes=site_haplotypes, sites=sites, carriers=carriers).once())
permuted = R.add("permuted_paths", G.permuted_paths.over(paths=dense, permuted=G.path_matrix(2).over(sites=sites)))
repaired = G.repair_paths.over(paths=permuted, missing=G.missing_alleles.over(sites=sites, paths=permuted)).once()
paths = R.add("graph_paths", G.append_paths.over(paths=repaired, missing=G.missing_alleles.over(sites=sites, paths=repaired)).once())
R.add("supported_alleles", G.supported_alleles.over(sites=sites, paths=paths))
taken = R.add("haplotype_to_path", G.haplotype_to_path(5, 64).over(haplotypes=dense, paths=paths).once())
# three paths of every two sites agree with a haplotype now and then only
R.add("haplotype_to_few_paths", G.haplotype_to_path(5, 64).over(haplotypes=dense, paths=G.path_matrix_shifted(1).over(sites=sites)))


def walked(chosen: Op) -> tuple[Op, Op]:
    """The sequences of paths by chunk, and their parts with what is around them."""
    pieces = G.haplotype_pieces(CHUNK).over(alleles=alleles, chosen=chosen, segments=segments).once()
    sequences = G.haplotype_sequence.over(pieces=pieces)
    return sequences, G.with_context(KMER).over(pieces=pieces, sequences=sequences).once()


# k-mers of paths, signatures, index
sequences, context = walked(paths)
R.add("haplotype_sequence", sequences)
R.add("path_context", context)
R.add("path_chunks", G.path_chunks(3, KMER).over(context=context))
path_kmers = R.add("path_kmers", G.site_kmers(KMER).over(context=context).once())
scored = walked(G.scorer_haplotypes(3).over(haplotypes=site_haplotypes, carriers=carriers, sites=sites))[1]
scorer = R.add("haplotype_scorer", K.approx_counter().over(kmers=K.both_ways(KMER).over(kmers=G.site_kmers(KMER).over(context=scored))).once())
R.add("path_scorer", K.approx_counter().over(kmers=path_kmers))
flanked = G.flanked(KMER).over(context=context)
windows = R.add("window_kmers", G.window_kmers(KMER).over(flanked=flanked).once())
R.add("window_kmers_everywhere", G.window_kmers(KMER, 3).over(flanked=G.flanked(KMER, 1, False).over(context=context)))
fixed = R.add("window_kmers_fixed", G.window_kmers(KMER).over(flanked=G.flanked_fixed(KMER).over(context=context)))
R.add("legacy_pairs", G.legacy_pairs().over(windows=fixed, counter=scorer))
R.add("legacy_sums", G.legacy_sums().over(windows=fixed, counter=scorer))
first_chosen = R.add("signature_select", G.signature_select().over(windows=windows, counter=scorer).once())
chosen_kmers = R.add("signature_sv", G.signature_sv(least=12).over(windows=windows, counter=scorer, chosen=first_chosen).once())
signatures = R.add("signature_frequent", G.signature_frequent(most=60).over(signatures=chosen_kmers, counter=scorer).once())
R.add("first_per_window", G.first_per_window.over(windows=windows))
R.add("signature_arrays", G.signature_arrays.over(signatures=signatures))
R.add("signature_overlap", G.signature_overlap.over(signatures=first_chosen))
R.add("shared_kmers", K.shared_kmers.over(signatures=first_chosen))
R.add("shared_anywhere", K.shared_anywhere.over(signatures=first_chosen))
index = R.add("kmer_index_build", G.kmer_index(KMER).over(signatures=signatures).once())
R.add("modulo_filter_semi", K.modulo_filter().over(counts=counts, index=index))
R.add("prune_kmers", K.has_kmer.over(counts=counts, index=index))
R.add("unique_kmers", K.unique_kmers.over(counts=counts, index=index))
nodes = G.graph_nodes.over(alleles=alleles)
variant_nodes = R.add("variant_nodes", G.variant_nodes.over(alleles=alleles))
node_counts = R.add("node_counts", K.node_counts.over(counts=counts, index=index, nodes=nodes).once())
R.add("node_kmers", G.node_kmers.over(index=index))
unsupported = R.add("unsupported_alleles", G.unsupported_alleles.over(nodes=nodes, index=index))
R.add("clashing_kmers", G.clashing_kmers.over(index=index))
R.add("kmer_report", G.kmer_report.over(nodes=variant_nodes, index=index, counts=K.kmer_count.over(kmers=path_kmers)))
R.add("nonunique_kmers", G.nonunique_kmers.over(nodes=variant_nodes, index=index, counts=K.kmer_count.over(kmers=path_kmers)))

# count model from the population's haplotypes
stretches = R.add("stretch_counts", C.stretch_counts.over(kmers=path_kmers, index=index).once())
R.add("haplotype_kmers", C.haplotype_kmers.over(taken=taken, kmers=path_kmers))
path_counts = R.add("path_counts", C.path_counts.over(taken=taken, stretches=stretches))
own_kmers = G.site_kmers(KMER).over(context=walked(dense)[1])
R.add("whole_counts", C.whole_counts.over(kmers=own_kmers, index=index))
copies = R.add("node_copies", C.node_copies(PEOPLE).over(nodes=nodes, haplotypes=site_haplotypes))
population_model = R.add("path_count_model", C.hist(20).over(genotypes=copies, observed=path_counts).once())
population_refined = R.add("path_count_model_refined", C.refine(20).over(model=population_model).once())
model_tricky = Op("model_tricky", "a", "select node_id, tricky from {a}", a=C.tricky().over(model=population_model, nodes=Op("node_names", "nodes", "select node_id as variant_id from {nodes}", nodes=nodes)))
node_tricky = R.add("either_tricky", C.either_tricky.over(a=model_tricky, b=unsupported).once())
R.add("tricky_variants", C.tricky_variants().over(nodes=variant_nodes, index=index, model=population_model))

# genotyping the reads on the graph
paired = L.paired_counts.over(nodes=variant_nodes, node_counts=node_counts)
R.add("genotype_loglik_naive", L.naive_loglik().over(node_counts=paired))
node_loglik = L.mixture_loglik().over(count_model=population_refined, node_counts=node_counts)
graph_loglik = R.add("genotype_loglik_mixture", L.genotype_loglik.over(nodes=variant_nodes, nodelik=node_loglik, tricky=node_tricky).once())
people = Op(
    "people",
    "carried variants",
    f"""select v.variant_id, v.individual, cast(coalesce(c.g, 0) as bigint) as g from (select variant_id, @each(0; {PEOPLE - 1}) as individual from {{variants}}) v
    left join (select variant_id, cast(floor(hap_id / 2) as bigint) as individual, count(*) as g from {{carried}} group by variant_id, cast(floor(hap_id / 2) as bigint)) c on c.variant_id = v.variant_id and c.individual = v.individual""",
    carried=B.carried,
    variants=few,
)
graph_helpers = R.add("graph_helpers", L.first_if_none.over(helpers=L.best_helper().over(genotypes=people).once()).once())
graph_prior = L.combo_prior.over(combo=L.combo_matrix.over(genotypes=people, helpers=graph_helpers).once())
graph_posterior = R.add("genotype_posterior_graph", L.helper_posterior.over(prior=graph_prior, helpers=graph_helpers, loglik=graph_loglik).once())
graph_calls = Op("graph_calls", "posterior variants", "select v.variant_id, v.chrom, v.pos, p.p0 as l0, p.p1 as l1, p.p2 as l2 from {posterior} p join {variants} v on v.variant_id = p.variant_id", posterior=graph_posterior, variants=few)
graph_called = R.add("genotype_graph", L.multiallelic_resolve.over(calls=graph_calls))
R.add(
    "debug_report",
    A.debug_report.over(nodes=variant_nodes, node_counts=node_counts, expectations=C.expected.over(model=population_refined), tricky=node_tricky, helpers=graph_helpers, calls=graph_called),
)
R.add("coverage_downscale", L.coverage_downscale().over(node_counts=node_counts))
R.add("uniform_genotyper", L.uniform_genotyper.over(snps=B.snps))
called = R.add("argmax_genotype", L.argmax_genotype.over(calls=B.calls))
R.add("ignore_hom_ref", L.ignore_hom_ref.over(called=called))
R.add("min_quality_filter", L.min_quality().over(calls=B.calls))
R.add("vcf_gl_gq", L.gl_gq.over(calls=B.calls))
R.add("multiallelic_resolve", L.multiallelic_resolve.over(calls=B.calls))
R.add("vcf_gt_string", L.site_gt.over(calls=B.calls))
R.add("sv_uniform_probs", L.sv_uniform.over(calls=B.calls, typed=typed))

# helper model
genotypes = R.add("genotypes_dense", B.genotypes.once())
freq = R.add("allele_freq_summary", H.allele_freq_summary.over(genotypes=genotypes))
helpers = R.add("best_helper", L.best_helper().over(genotypes=genotypes).once())
combo = R.add("combo_matrix", L.combo_matrix.over(genotypes=genotypes, helpers=helpers).once())
prior = R.add("combo_prior", L.combo_prior.over(combo=combo).once())
loglik = L.variant_loglik.over(genotypes=genotypes)
R.add("genotype_posterior_helper", L.helper_posterior.over(prior=prior, helpers=helpers, loglik=loglik))
R.add("prior_only_model", L.prior_only.over(calls=loglik, freq=freq))
R.add("binomial_helper_weight", L.binomial_helper_weight.over(genotypes=genotypes))
expectations = Op(
    "expectations",
    "freq",
    "select variant_id, variant_id % 3 / 2e0 as e_ref, variant_id % 5 / 4e0 as e_alt, (f_hr + 1e-2) / 1.03e0 as f_hr, (f_het + 1e-2) / 1.03e0 as f_het, (f_ha + 1e-2) / 1.03e0 as f_ha from {freq}",
    freq=freq,
)
weights = R.add("helper_weights", L.helper_weights().over(expectations=expectations).once())
R.add("best_helper_weighted", L.best_helper(20, 0.4).over(genotypes=genotypes, weights=weights))

# count model operators on counts of rows
model = R.add("count_model_hist", C.hist().over(genotypes=genotypes, observed=C.observed).once())
R.add("count_model_expected", C.expected.over(model=model))
refined = R.add("count_model_refine", C.refine().over(model=model))
R.add("count_model_prior", C.with_prior().over(model=model))
R.add("count_model_naive", C.naive_model.over(nodes=nodes))
R.add("count_model_limited", C.limited().over(model=model))
R.add("count_model_sparse", C.log_frequencies.over(model=model))
R.add("count_model_merge", C.merged_models.over(model=model, other=C.hist().over(genotypes=genotypes, observed=B.other_observed)))
R.add("perfect_model", C.perfect.over(model=model))
R.add("tricky_alleles", C.tricky().over(model=model, nodes=genotypes))
seen = Op("seen", "observed", "select variant_id as node_id, sum(n) as n from {observed} group by variant_id", observed=C.observed)
R.add("count_model_loglik", L.mixture_loglik().over(count_model=refined, node_counts=Op("seen_int", "seen", "select node_id, cast(n as bigint) as n from {seen}", seen=seen)))

# haplotypes and accuracy
R.add("haplotypes_long", B.haplotypes)
biallelic = R.add("to_biallelic", H.to_biallelic.over(haplotypes=B.haplotypes, n_alleles=H.n_alleles.over(haplotypes=B.haplotypes)))
R.add("to_multiallelic", H.to_multiallelic.over(biallelic=biallelic))
R.add("genotype_matrix", H.genotype_matrix.over(haplotypes=B.haplotypes))
R.add("distinct_alleles", H.distinct_alleles.over(haplotypes=B.haplotypes))
R.add("normalize_gt", H.normalize_gt.over(calls=B.truth))
R.add("diploid_from_haploid", H.diploid_from_haploid.over(calls=H.haploid))
R.add("gt_string", H.gt_string.over(genotypes=genotypes))
paired_calls = R.add("paired_calls", A.paired.over(truth=B.truth, sample=B.sample).once())
R.add("unknown_calls", A.unknown_calls.over(truth=B.truth, sample=B.strange_sample))
confusion = R.add("genotype_confusion", A.confusion.over(paired=paired_calls))
R.add("genotype_accuracy", A.metrics.over(confusion=confusion))
by_type = R.add("accuracy_by_type", A.confusion_by_type.over(paired=paired_calls))
R.add("rates_by_type", A.rates_by_type.over(by_type=by_type))
typed_sample = Op("typed_sample", "sample", "select k, gt, case k % 3 when 0 then 'sv' when 1 then 'indel' else 'snp' end as type from {sample}", sample=B.strange_sample)
R.add("rates_in_regions", A.rates_in_regions.over(truth=B.truth, sample=typed_sample, inside=Op("inside", "sample", "select k from {sample} where k % 4 > 0", sample=B.strange_sample)))
sorted_truth = R.add("by_sorted_alts", A.by_sorted_alts.over(calls=B.alt_truth, reference=B.alt_truth))
R.add("genotype_accuracy_sorted", A.metrics.over(confusion=A.confusion.over(paired=A.paired.over(truth=sorted_truth, sample=A.by_sorted_alts.over(calls=B.alt_sample, reference=B.alt_truth)))))
split_truth = R.add("split_calls", A.split_calls.over(calls=B.alt_truth))
R.add("closest_keys", A.closest_keys.over(unknown=Op("unknown_keys", "sample", "select k from {sample}", sample=A.split_calls.over(calls=B.alt_sample)), truth=split_truth))

# simulators
two_haplotypes = Op(
    "two_haplotypes",
    "contigs snps",
    """select h.path_id, c.chrom, c.ix, case when h.path_id = 0 then c.seq else coalesce(a.seq, c.seq) end as seq from (select chrom, @each(0; 1) as path_id from {contigs}) h join {contigs} c on c.chrom = h.chrom
       left join (select chrom, @joined(part; pos) as seq from (
         select s.chrom, s.pos, concat(s.alt, substr(c.seq, cast(s.pos + 2 as int), 36)) as part from {snps} s join {contigs} c on c.chrom = s.chrom
         union all select chrom, -1 as pos, substr(seq, 1, 20) as part from {contigs} where length(seq) >= 31) x group by chrom) a on a.chrom = c.chrom""",
    contigs=B.contigs,
    snps=B.snps,
)
R.add("read_simulation", simulate.reads(coverage=6.0, error=0.01, insert=120).over(sequences=two_haplotypes))
R.add("data_simulation", simulate.genotypes().over(variants=B.haplotypes))

R.by_hand |= oracle.headline(R)
