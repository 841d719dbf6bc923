"""Operators on small literal inputs with known answers."""

import math

import pytest

from allelith.operators import accuracy, count_model, graph, haplotypes, intervals, kmers, likelihood, variants


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_sketch_counts(spark):
    keys = spark.createDataFrame([(k,) for k in (1, 2, 1, 4, 5, 4)], "kmer bigint")
    assert rows(kmers.min_count_sketch((13, 9, 21, 41))(keys), "kmer", "est") == [(1, 2), (2, 1), (4, 2), (5, 1)]
    keys = spark.createDataFrame([(k,) for k in (1, 1, 16, 4, 3)], "kmer bigint")
    assert rows(kmers.approx_counter(100)(keys), "bucket", "n") == [(1, 2), (3, 1), (4, 1), (16, 1)]
    assert rows(kmers.approx_counter(100, 1)(keys), "bucket", "n")[0] == (1, 1)


def test_kmers_are_exact_over_pieces_and_skip_other_letters(spark):
    seq = "acgtnacgtta" + "gattaca" * 40
    got = rows(kmers.kmers(5)(spark.createDataFrame([(1, seq), (2, "acg"), (3, "")], "read_id bigint, seq string")), "read_id", "pos", "kmer")
    code = lambda s: sum("acgt".index(c) * 4 ** (len(s) - 1 - i) for i, c in enumerate(s))
    assert got == [(1, i, code(seq[i : i + 5])) for i in range(len(seq) - 4) if "n" not in seq[i : i + 5]]
    with pytest.raises(ValueError):
        kmers.kmers(32)


def test_merge_pads_to_common_spans(spark):
    contigs = spark.createDataFrame([("1", "CACCCCCCCCACTGCCCC")], "chrom string, seq string")
    made = spark.createDataFrame([(0, "1", 9, "CAC", "C"), (1, "1", 10, "A", "G"), (2, "1", 12, "", "TT"), (3, "1", 10, "", "A"), (4, "1", 13, "G", "T"), (5, "1", 9, "", "C")], "variant_id bigint, chrom string, pos bigint, ref string, alt string")
    got = {r.variant_id: (r.pos, r.ref, r.alt) for r in intervals.merge_pad(8, 4)(made, intervals.genome(8)(contigs)).collect()}
    assert got == {0: (9, "CAC", "C"), 1: (9, "CAC", "CGC"), 2: (12, "", "TT"), 3: (9, "CAC", "CAAC"), 4: (13, "G", "T"), 5: (9, "", "C")}


def test_covered_by_sv(spark):
    df = spark.createDataFrame([(0, "1", 5, 1, 1), (1, "1", 10, 60, 1), (2, "1", 20, 1, 1), (3, "1", 65, 10, 1), (4, "1", 72, 1, 1), (5, "2", 20, 1, 1)], "variant_id bigint, chrom string, pos bigint, len_ref bigint, len_alt bigint")
    assert [c for _, c in rows(intervals.covered_by_sv()(df), "variant_id", "covered")] == [False, False, True, True, False, False]


def test_best_of_a_place(spark):
    df = spark.createDataFrame([(0, "1", 5, "A", 0.01), (1, "1", 5, "A", 0.02), (2, "1", 6, "AT", 0.01), (3, "1", 7, "A", 0.5)], "variant_id bigint, chrom string, pos bigint, ref string, af double")
    assert [d for _, d in rows(intervals.best_per_place()(df), "variant_id", "dropped")] == [True, False, False, False]


def test_anchors(spark):
    df = spark.createDataFrame([(0, "1", 3, "AT", "A"), (1, "1", 3, "A", "G")], "variant_id bigint, chrom string, pos bigint, ref string, alt string")
    stripped = variants.strip_anchor(df)
    assert rows(stripped, "variant_id", "pos", "ref", "alt") == [(0, 4, "T", ""), (1, 3, "A", "G")]
    contigs = spark.createDataFrame([("1", "CCCATCC")], "chrom string, seq string")
    assert rows(variants.pad_anchor(2)(stripped, intervals.genome(2)(contigs)), "variant_id", "pos", "ref", "alt") == [(0, 3, "AT", "A"), (1, 3, "A", "G")]


def test_genotype_strings(spark):
    df = spark.createDataFrame([(1, "5|1"), (2, "."), (3, "0/1:0.5"), (4, "1|0")], "k bigint, gt string")
    assert rows(haplotypes.normalize_gt(df), "k", "gt") == [(1, "1/5"), (2, "./."), (3, "0/1"), (4, "0/1")]


def test_site_strings(spark):
    top = {0: (0.0, -9.0, -9.0), 1: (-9.0, 0.0, -9.0), 2: (-9.0, -9.0, 0.0)}
    calls = [(1, [0]), (2, [2, 0]), (3, [1]), (4, [0, 1]), (5, [0, 2])]
    df = spark.createDataFrame([(10 * p + i, "1", p, *top[g]) for p, gs in calls for i, g in enumerate(gs)], "variant_id bigint, chrom string, pos bigint, l0 double, l1 double, l2 double")
    assert rows(likelihood.site_gt(df), "site", "gt") == [(1, "0/0"), (2, "1/1"), (3, "0/1"), (4, "0/2"), (5, "2/2")]


def test_resolution_of_sites(spark):
    df = spark.createDataFrame([(0, "1", 5, -1.0, -0.1, -9.0), (1, "1", 5, -1.0, -0.2, -9.0), (2, "1", 6, -1.0, -0.2, -9.0)], "variant_id bigint, chrom string, pos bigint, l0 double, l1 double, l2 double")
    assert rows(likelihood.multiallelic_resolve(df), "variant_id", "g") == [(0, 1), (1, 0), (2, 1)]


def test_confusion(spark):
    truth = spark.createDataFrame([(1, "snp", "0/0"), (2, "snp", "0/1"), (10, "sv", "0/1")], "k bigint, type string, gt string")
    sample = spark.createDataFrame([(1, "1/0"), (2, "0/1"), (10, "0/0")], "k bigint, gt string")
    paired = accuracy.paired(truth, sample)
    r = accuracy.confusion(paired).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 1, 0)
    m = accuracy.metrics(accuracy.confusion(paired)).first()
    assert (m.recall, m.precision, m.f1) == (0.5, 0.5, 0.5)
    assert accuracy.unknown_calls(truth, sample).count() == 0


def test_paths(spark):
    sites = spark.createDataFrame([(i, 2) for i in range(4)], "site_id bigint, n_alleles bigint")
    got = rows(graph.path_matrix(3)(sites), "path_id", "site_id", "allele")
    assert [a for p, s, a in got if p == 5] == [1, 0, 1, 1]
    three = spark.createDataFrame([(0, 3), (1, 2)], "site_id bigint, n_alleles bigint")
    two = graph.path_matrix(1)(three)
    gone = graph.missing_alleles(three, two)
    assert rows(gone, "site_id", "allele") == [(0, 2)]
    assert graph.missing_alleles(three, graph.append_paths(two, gone)).count() == 0
    four = graph.path_matrix(2)(three).where("path_id <> 2")
    assert graph.missing_alleles(three, graph.repair_paths(four.withColumn("allele", four.allele % 2), graph.missing_alleles(three, four.withColumn("allele", four.allele % 2)))).count() == 0


def test_interpolated_counts(spark):
    df = spark.createDataFrame([(0, 0, 0, 5), (0, 1, 1, 4), (1, 0, 0, 3), (1, 2, 4, 2)], "node_id bigint, copies bigint, cnt bigint, n bigint")
    got = rows(count_model.refine(10)(df), "node_id", "copies", "cnt", "n")
    assert (0, 2, 2, 1) in got and (1, 1, 2, 1) in got and len(got) == 6


def test_likelihood_prefers_the_copies_seen(spark):
    df = spark.createDataFrame([(0, 12), (1, 0), (2, 6), (3, 7), (4, 0), (5, 11)], "node_id bigint, n bigint")
    got = likelihood.naive_loglik(15.0)(df).orderBy("variant_id").collect()
    assert [r.g for r in got] == [0, 1, 2]
    lam = 15 / 2 * 0.85
    want = sum(n * math.log((c + 0.01) * lam) - (c + 0.01) * lam - math.lgamma(n + 1) for n, c in ((12, 2), (0, 0)))
    assert abs(got[0].l0 - want) < 1e-5


def test_helper_pulls_a_variant_towards_its_genotype(spark):
    prior = spark.createDataFrame([(1, h, m, 0.9 if h == m else 0.05) for h in range(3) for m in range(3)] + [(2, h, m, 1 / 9) for h in range(3) for m in range(3)], "variant_id bigint, gh bigint, gm bigint, p double")
    helpers = spark.createDataFrame([(1, 2), (2, 1)], "variant_id bigint, helper_id bigint")
    loglik = spark.createDataFrame([(1, -1.0, -1.0, -1.0), (2, -20.0, -20.0, -0.1)], "variant_id bigint, l0 double, l1 double, l2 double")
    r = likelihood.helper_posterior(prior, helpers, loglik).where("variant_id = 1").first()
    assert r.p2 > -0.2 and abs(sum(math.exp(x) for x in (r.p0, r.p1, r.p2)) - 1) < 1e-3
