"""Known answers for the domain's operators, written out as values."""

import math

import pytest

from allelith.operators import accuracy, count_model, graph, haplotypes, intervals, kmers, likelihood, variants
from allelith.plans import vcf_filters as V

VARIANT = "variant_id bigint, chrom string, pos bigint, ref string, alt string"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


HOLE = "ATAAAGAACGGAAGGGGTTTAATAGTTGTATGC"
MERGES = [
    ("A" * 16, [(5, "", "ACGT"), (5, "AA", "TT")], [(5, "", "ACGT"), (5, "AA", "TT")]),
    ("TGCA" * 4, [(4, "TGCAT", ""), (6, "C", "G"), (7, "A", "T"), (8, "T", "C")], [(4, "TGCAT", ""), (4, "TGCAT", "TGGAT"), (4, "TGCAT", "TGCTT"), (4, "TGCAT", "TGCAC")]),
    ("AAAAAGGGGGGAAAA", [(5, "GGGGGG", ""), (7, "G", "T")], [(5, "GGGGGG", ""), (5, "GGGGGG", "GGTGGG")]),
    (f"AAAA{HOLE}CCC", [(4, HOLE, ""), (12, "C", "G"), (14, "", "CCGAGAT")], [(4, HOLE, ""), (4, HOLE, "ATAAAGAAGGGAAGGGGTTTAATAGTTGTATGC"), (4, HOLE, "ATAAAGAACGCCGAGATGAAGGGGTTTAATAGTTGTATGC")]),
    (
        "A" * 50,
        [(4, "AAAAA", ""), (6, "AAAAA", ""), (7, "", "CCCCCCC"), (8, "AAAAA", ""), (14, "AAAAA", ""), (16, "AAAAA", ""), (18, "AAAAA", "")],
        [(4, "A" * 9, "AAAA"), (4, "A" * 9, "AAAA"), (4, "A" * 9, "AAACCCCCCCAAAAAA"), (4, "A" * 9, "AAAA"), (14, "A" * 9, "AAAA"), (14, "A" * 9, "AAAA"), (14, "A" * 9, "AAAA")],
    ),
    ("A" * 10, [(4, "A", "C"), (5, "A", "T")], [(4, "A", "C"), (5, "A", "T")]),
]


@pytest.mark.parametrize("case", range(len(MERGES)))
@pytest.mark.parametrize("size,bin", [(7, 3), (1 << 16, 1 << 16)])
def test_merged_spans(spark, case, size, bin):
    seq, given, want = MERGES[case]
    made = spark.createDataFrame([(i, "1", *v) for i, v in enumerate(given)], VARIANT)
    contigs = spark.createDataFrame([("1", seq)], "chrom string, seq string")
    got = rows(intervals.merge_pad(size, bin)(made, intervals.genome(size)(contigs)), "variant_id", "pos", "ref", "alt")
    assert [r[1:] for r in got] == want


def test_covered_at_another_limit(spark):
    spans = [(0, 1, 1, 1), (1, 2, 1, 1), (2, 2, 8, 1), (3, 5, 1, 1), (4, 9, 2, 1), (5, 8, 2, 1)]
    df = spark.createDataFrame([(i, "chr1", p, r, a) for i, p, r, a in spans], "variant_id bigint, chrom string, pos bigint, len_ref bigint, len_alt bigint")
    for bin in (4, 1024):
        assert [c for _, c in rows(intervals.covered_by_sv(3, bin, bin)(df), "variant_id", "covered")] == [False, False, False, True, False, True]


def test_rare_alleles_at_a_limit(spark):
    given = [(1, 0.001), (3, 0.01), (3, 0.1), (4, 0.1), (5, 0.001), (5, 0.002), (5, 0.003)]
    df = spark.createDataFrame([(i, "chr1", p, "A", "T", af) for i, (p, af) in enumerate(given)], VARIANT + ", af double")
    assert [d for _, d in rows(intervals.best_per_place(0.05)(df), "variant_id", "dropped")] == [False, True, False, False, True, True, False]
    # a frequency at the limit stays, one that isn't known counts as none
    df = spark.createDataFrame([(0, "1", 1, "AT", "T", 0.7), (1, "1", 1, "A", "T", 0.9), (2, "1", 1, "A", "G", None), (3, "1", 2, "AT", "A", None)], VARIANT + ", af double")
    assert rows(intervals.best_per_place(0.7)(df), "variant_id", "dropped", "dropped_deletion") == [(0, False, False), (1, False, False), (2, True, False), (3, False, True)]


def test_deepest_overlap_and_its_filter(spark):
    df = spark.createDataFrame([(0, "1", 6, 4), (1, "1", 8, 1), (2, "1", 20, 1), (3, "1", 21, 3), (4, "2", 8, 1)], "variant_id bigint, chrom string, pos bigint, len_ref bigint")
    for scan in (2, 1 << 16):
        depth = intervals.stabbing_count(4, scan)(df)
        assert rows(depth, "variant_id", "most") == [(0, 2), (1, 2), (2, 1), (3, 1), (4, 1)]
        assert rows(intervals.max_depth(1)(depth), "variant_id") == [(2,), (3,), (4,)]


def test_originals_with_too_many_alleles(spark):
    given = [(0, "chr1", 4, "A", "T"), (1, "chr1", 6, "ATG", "T"), (2, "chr1", 6, "ATG", "G"), (3, "chr1", 6, "ATG", "C"), (4, "chr2", 8, "A", "C"), (5, "chr2", 8, "A", "G")]
    sources = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 1), (4, 2), (5, 2)], "variant_id bigint, source_id bigint")
    assert rows(intervals.too_many_alleles(2)(spark.createDataFrame(given, VARIANT), sources), "source_id", "dropped") == [(0, False), (1, True), (2, False)]


def test_indels_that_touch_and_rows_with_n(spark):
    given = [(0, 5, 3, 1, False), (1, 8, 1, 3, False), (2, 30, 1, 1, False), (3, 29, 2, 1, False), (4, 40, 2, 1, True), (5, 41, 2, 1, False)]
    df = spark.createDataFrame([(i, "1", p, r, a, n) for i, p, r, a, n in given], "variant_id bigint, chrom string, pos bigint, len_ref bigint, len_alt bigint, has_n boolean")
    assert rows(intervals.overlapping_indels()(df), "variant_id") == [(0,), (2,), (5,)]


def test_signatures_once_each_in_order(spark):
    given = {(0, 0): [3, 1, 2, 1, 123, 123123], (0, 1): [3, 1, 1, 1, 1, 3], (0, 2): [50, 60, 4, 3, 2, 50], (1, 0): [1, 1], (1, 1): [3], (1, 2): [10, 11, 10]}
    windows = spark.createDataFrame([(s, a, p, 0, k) for (s, a), ks in given.items() for p, k in enumerate(ks)], "site_id bigint, allele int, path_id bigint, window_ix bigint, kmer bigint")
    counter = spark.createDataFrame([], "bucket bigint, n bigint")
    got = rows(graph.signature_arrays(graph.signature_select()(windows, counter)), "site_id", "allele", "kmers")
    assert got == [(0, 0, "1,2,3,123,123123"), (0, 1, "1,3"), (0, 2, "2,3,4,50,60"), (1, 0, "1"), (1, 1, "3"), (1, 2, "10,11")]


def test_windows_of_large_alleles_chosen_anew(spark):
    windows = spark.createDataFrame([(0, a, p, w, 10 * a + w) for a in range(2) for p in range(2) for w in range(12)], "site_id bigint, allele int, path_id bigint, window_ix bigint, kmer bigint")
    counter = spark.createDataFrame([], "bucket bigint, n bigint")
    shared = spark.createDataFrame([(0, 0, 11), (0, 1, 11)], "site_id bigint, allele int, kmer bigint")
    # the last window has 0.1 more, but its k-mer is the other allele's too
    assert rows(graph.signature_sv(least=11)(windows, counter, shared), "allele", "kmer") == [(0, 0), (1, 21)]
    assert rows(graph.signature_sv(least=50)(windows, counter, shared), "allele", "kmer") == [(0, 11), (1, 11)]
    apart = spark.createDataFrame([(0, 0, 3), (0, 1, 14)], "site_id bigint, allele int, kmer bigint")
    assert rows(graph.signature_sv(least=11)(windows, counter, apart), "allele", "kmer") == [(0, 3), (1, 14)]


def test_calls_of_a_place(spark):
    def resolved(*probs, places=None):
        given = [(i, "1", (places or [0] * len(probs))[i], *(math.log(x) for x in p)) for i, p in enumerate(probs)]
        return [g for _, g in rows(likelihood.multiallelic_resolve(spark.createDataFrame(given, "variant_id bigint, chrom string, pos bigint, l0 double, l1 double, l2 double")), "variant_id", "g")]

    assert resolved((0.98, 0.01, 0.01), (0.3, 0.3, 0.4), (0.05, 0.05, 0.9), (0.01, 0.01, 0.98), places=[0, 1, 1, 1]) == [0, 0, 0, 2]
    assert resolved((0.99, 0.01, 0.01), (0.3, 0.4, 0.3), (0.01, 0.98, 0.01), (0.3, 0.4, 0.3)) == [0, 0, 1, 0]
    # the likeliest alternative is that of a row called 0/0: then all are
    assert resolved((0.5, 0.49, 0.01), (0.3, 0.4, 0.3), (0.3, 0.4, 0.3), (0.3, 0.4, 0.3)) == [0, 0, 0, 0]


def test_likelihoods_that_are_no_numbers(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, "1", 5, -1.0, nan, -2.0), (1, "1", 5, -9.0, -0.1, -9.0), (2, "1", 6, None, -1.0, -1.0)], "variant_id bigint, chrom string, pos bigint, l0 double, l1 double, l2 double")
    assert rows(likelihood.gl_gq(df), "variant_id", "g0", "g1", "g2")[0] == (0, -0.1, -0.1, -0.1)
    assert rows(likelihood.gl_gq(df), "variant_id", "g0")[2] == (2, -0.1)
    assert rows(likelihood.multiallelic_resolve(df), "variant_id", "g") == [(0, 0), (1, 1), (2, 0)]


PI = [[0.4, 0.2, 0.0], [0.2, 0.1, 0.0], [0.1, 0.0, 0.0]]


def test_helpers_posterior_in_closed_form(spark):
    """By hand: the sum over the helper's genotypes of the pair's probability times both likelihoods, over its sum."""
    loglik = [[0.1, 0.2, 0.3], [0.8, 0.1, 0.1], [0.3, 0.4, 0.3]]
    turned = [list(c) for c in zip(*PI, strict=True)]
    prior = [(v, h, m, p * (2 if v == 2 else 1)) for v, t in enumerate((PI, turned, PI)) for h, r in enumerate(t) for m, p in enumerate(r)]
    helpers = {0: 1, 1: 0, 2: 0}
    want = {}
    for v in range(3):
        cell = {(h, m): p for w, h, m, p in prior if w == v}
        x = [loglik[v][m] * sum(cell[h, m] * loglik[helpers[v]][h] for h in range(3)) for m in range(3)]
        want[v] = [a / sum(x) for a in x]
    got = likelihood.helper_posterior(
        spark.createDataFrame(prior, "variant_id bigint, gh bigint, gm bigint, p double"), spark.createDataFrame(list(helpers.items()), "variant_id bigint, helper_id bigint"),
        spark.createDataFrame([(v, *(math.log(x) for x in r)) for v, r in enumerate(loglik)], "variant_id bigint, l0 double, l1 double, l2 double"),
    ).collect()
    for r in got:
        assert all(abs(math.exp(a) - b) < 0.002 for a, b in zip((r.p0, r.p1, r.p2), want[r.variant_id], strict=True))
    assert abs(want[0][0] - 0.1 * (0.4 * 0.8 + 0.2 * 0.1 + 0.1 * 0.1) / (0.1 * 0.35 + 0.2 * (0.2 * 0.8 + 0.1 * 0.1))) < 1e-9


FILLED = [
    ([[0, 1], [0, 0, 1], []], 2, 3), ([[1, 1, 1], [], [0, 0, 4, 10, 4]], 1, 2), ([[], [0, 1, 1, 1], [0, 0, 4, 10, 4]], 0, 1), ([[41, 1], [0, 1], []], 2, 2), ([[0, 0, 5], [0, 1], []], 2, 0),
]


@pytest.mark.parametrize("case", range(len(FILLED)))
def test_counts_that_no_one_had(spark, case):
    model, copies, count = FILLED[case]
    given = [(7, c, i, n) for c, counts in enumerate(model) for i, n in enumerate(counts) if n]
    got = rows(count_model.refine(6)(spark.createDataFrame(given, "node_id bigint, copies bigint, cnt bigint, n bigint")), "copies", "cnt", "n")
    assert (copies, count, 1) in got and len(got) == len(given) + 1


def test_older_filling(spark):
    given = [(1, 0, 0, 4), (1, 1, 1, 2), (1, 1, 2, 2)]
    got = rows(count_model.with_prior(0.5, 6)(spark.createDataFrame(given, "node_id bigint, copies bigint, cnt bigint, n bigint")), "copies", "cnt", "n")
    # the mean of one copy is 1.5, 2 when rounded to even
    assert got == [(0, 0, 4.0), (0, 1, 0.5), (1, 1, 2.5), (1, 2, 2.0), (2, 2, 0.5)]


def calls(spark, given):
    return spark.createDataFrame([(i, c, p, r, ",".join(a), "snp", g) for i, (c, p, r, a, g) in enumerate(given)], "row_id bigint, chrom string, pos bigint, ref string, alts string, type string, gt string")


def test_alternatives_in_the_references_order(spark):
    reference = calls(spark, [("chr1", 10, "A", ["T", "C", "G"], "0|1"), ("chr2", 4, "A", ["ACTACTACACT", "AAAA", "T"], "0|0")])
    assert rows(accuracy.by_sorted_alts(reference, reference), "k", "gt") == [("chr1-10-A-C,G,T", "0/3"), ("chr2-4-A-AAAA,ACTACTACACT,T", "0/0")]
    sample = calls(spark, [("chr1", 10, "A", ["C", "G"], "0/1"), ("chr2", 4, "A", ["T"], "1/0")])
    assert rows(accuracy.by_sorted_alts(sample, reference), "k", "gt") == [("chr1-10-A-C,G,T", "0/1"), ("chr2-4-A-AAAA,ACTACTACACT,T", "0/3")]
    for gt, want in (("./1", "./1"), ("./2", "./2"), (".", "./.")):
        assert rows(accuracy.by_sorted_alts(calls(spark, [("chr1", 10, "A", ["C", "G"], gt)]), reference), "gt") == [(want,)]
    assert rows(accuracy.by_sorted_alts(calls(spark, [("chr1", 10, "A", ["TT"], "0/1")]), reference), "k", "gt") == [("chr1-10-A-TT", "0/1")]
    # rows of one alternative each stay apart
    apart = calls(spark, [("chr1", 10, "A", ["T"], "0/1"), ("chr1", 10, "A", ["C"], "1/1")])
    assert rows(accuracy.by_sorted_alts(apart, apart), "k", "gt") == [("chr1-10-A-C", "1/1"), ("chr1-10-A-T", "0/1")]


def test_one_call_for_each_alternative(spark):
    given = [("chr1", 6, "A", ["T"], "0|1"), ("chr1", 10, "A", ["T", "C", "G"], "1|3"), ("chr1", 15, "A", ["ATT", "ATTTT"], "0|2"), ("chr1", 20, "C", ["CTA"], "1|1"), ("chr1", 30, "A", ["T"], ".|1")]
    got = dict(rows(accuracy.split_calls(calls(spark, given)), "k", "gt"))
    assert got == {
        "chr1-6-A-T": "0/1", "chr1-10-A-T": "0/1", "chr1-10-A-C": "0/0", "chr1-10-A-G": "0/1", "chr1-15-A-ATT": "0/0", "chr1-15-A-ATTTT": "0/1", "chr1-20-C-CTA": "1/1", "chr1-30-A-T": "./.",
    }


def test_types(spark):
    df = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (2, 1, 2), (3, 1, 50), (4, 50, 1), (5, 51, 1)], "variant_id bigint, len_ref bigint, len_alt bigint")
    got = variants.variant_types()(df)
    assert [t for _, t in rows(got, "variant_id", "type")] == ["snp", "indel", "indel", "sv", "sv", "sv"]
    assert rows(got, "is_sv_a", "is_sv_b", "is_sv_c")[-3:] == [(False, False, True), (False, True, True), (True, True, True)]


def test_missing_alleles_as_numbers(spark):
    df = spark.createDataFrame([(0, "0/1"), (1, "./1"), (2, "0|0:9"), (3, "0/.")], "k bigint, gt string")
    assert sorted((r.k, r.a1, r.a2) for r in haplotypes.normalize_gt(df).collect()) == [(0, 0, 1), (1, None, 1), (2, 0, 0), (3, 0, None)]


def test_all_combinations_are_paths(spark):
    sites = spark.createDataFrame([(i, 2) for i in range(4)], "site_id bigint, n_alleles bigint")
    got = {}
    for p, s, a in rows(graph.path_matrix(2)(sites), "path_id", "site_id", "allele"):
        got.setdefault(p, []).append(a)
    assert got == {0: [0, 0, 0, 0], 1: [0, 1, 0, 1], 2: [1, 0, 1, 0], 3: [1, 1, 1, 1]}
    wide = spark.createDataFrame([(0, 3), (1, 2)], "site_id bigint, n_alleles bigint")
    first = {}
    for p, s, a in rows(graph.path_matrix_columns(2)(wide), "path_id", "site_id", "allele"):
        first.setdefault(p, []).append(a)
    # columns 0 to 2 are the first site's, 3 and 4 the second's; bits 00, 01, 10, 11 over and over
    assert first == {0: [2, 1], 1: [1, 0], 2: [0, 1], 3: [0, 0]}


def longest(haps, paths, window):
    n = len(haps[0])
    out = {}
    for h, hap in enumerate(haps):
        for s in range(n):
            best = max((next((w for w in range(min(window, n - s)) if hap[s + w] != path[s + w]), min(window, n - s)), p) for p, path in enumerate(paths))
            if best[0]:
                out[h, s] = best
    return out


@pytest.mark.parametrize("bin", [3, 4096])
def test_paths_that_agree_longest(spark, bin):
    import random

    rng = random.Random(bin)
    haps, paths = ([[rng.randint(0, 2) for _ in range(23)] for _ in range(n)] for n in (6, 5))
    table = lambda m: spark.createDataFrame([(i, 10 * s + 3, a) for i, r in enumerate(m) for s, a in enumerate(r)], "path_id bigint, site_id bigint, allele bigint")
    got = {(r.hap_id, (r.site_id - 3) // 10): (r.len, r.path_id) for r in graph.haplotype_to_path(4, bin)(table(haps), table(paths)).collect()}
    assert got == longest(haps, paths, 4)


def best_helpers(g, window):
    n, out = len(g), {}
    for v in range(n):
        found = []
        for h in range(n):
            if 4 <= abs(h - v) < min(window, n):
                same = [1 + sum(a == b == x for a, b in zip(g[v], g[h], strict=True)) for x in range(3)]
                found.append((same[0] * same[1] * same[2], h > v, abs(h - v) if h > v else -abs(h - v), h))
        out[v] = max(found)[3] if found else None
    return out


@pytest.mark.parametrize("people", [5, 130])
def test_best_helpers(spark, people):
    import random

    rng = random.Random(people)
    g = [[rng.randint(0, 2) for _ in range(people)] for _ in range(40)]
    df = spark.createDataFrame([(v, i, x) for v, r in enumerate(g) for i, x in enumerate(r)], "variant_id bigint, individual bigint, g bigint")
    for window in (12, 100):
        assert dict(rows(likelihood.best_helper(window, bin=8)(df), "variant_id", "helper_id")) == best_helpers(g, window)
    few = likelihood.best_helper(100)(df.where("variant_id < 4"))
    assert rows(likelihood.first_if_none(few), "variant_id", "helper_id") == [(v, 0) for v in range(4)]


def test_scaled_counts_and_bases(spark):
    df = spark.createDataFrame([(0, 5), (1, 12), (2, 13), (3, 0)], "node_id bigint, n bigint")
    assert [n for _, n in rows(likelihood.coverage_downscale(15.0, 3.0)(df), "node_id", "n")] == [1, 2, 3, 0]
    code = lambda s: sum("acgt".index(c) * 4 ** (len(s) - 1 - i) for i, c in enumerate(s))
    made = spark.createDataFrame([(code("acgttgcaagc"), 1)], "kmer bigint, n bigint")
    assert kmers.kmer_text(11)(made).first().bases == "acgttgcaagc"
    for k in (1, 11, 30, 31):
        seq = "gattacagattacaacgtnacgtgcatgcatcgatcgacttacgatcgatcgatcagctagcatcgacgatcgatcagcatcagcatcagcgactacgacgatcga"
        got = rows(kmers.kmers(k)(spark.createDataFrame([(1, seq)], "read_id bigint, seq string")), "pos", "kmer")
        assert got == [(i, code(seq[i : i + k])) for i in range(len(seq) - k + 1) if "n" not in seq[i : i + k]]


def test_rates_within_regions(spark):
    truth = spark.createDataFrame([("a", "snp", "0/1"), ("b", "snp", "0/1"), ("c", "snp", "1/1"), ("d", "sv", "0/1")], "k string, type string, gt string")
    sample = spark.createDataFrame([("a", "snp", "1|0"), ("b", "snp", "0/0"), ("c", "snp", "0/1"), ("x", "snp", "0/1"), ("y", "snp", "1/1"), ("z", "sv", "0/0")], "k string, type string, gt string")
    inside = spark.createDataFrame([("a",), ("x",), ("z",)], "k string")
    assert rows(accuracy.rates_in_regions(truth, sample, inside), "type", "n_truth", "tp", "fn", "fp", "recall", "precision") == [("snp", 3, 1, 1, 1, 0.5, 0.5), ("sv", 1, 0, 1, 0, 0.0, 0.0)]


def test_filters_read_spans(spark):
    vcf = spark.createDataFrame([(0, "1", 5, "AN", "A,ATT"), (1, "1", 9, "A", "C")], "file_row bigint, chrom string, pos bigint, ref string, alt string")
    assert rows(V.as_spans(vcf), "variant_id", "len_ref", "len_alt", "has_n") == [(0, 2, 3, True), (1, 1, 1, False)]
