"""A population simulated, indexed and genotyped end to end."""

import random

import pytest

from allelith.cli import main
from allelith.plans import genotyping as P
from allelith.plans import vcf_filters as V
from allelith.sources import genomics as io

K, PEOPLE = 15, 16


def written(path, rows, people, gts):
    names = "\t".join(f"p{i}" for i in range(people))
    head = f"##fileformat=VCFv4.2\n##contig=<ID=c1>\n##contig=<ID=c2>\n##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{names}\n"
    path.write_text(head + "".join(f"{c}\t{p + 1}\t.\t{r}\t{a}\t.\t.\tAF=0.3\tGT\t" + "\t".join(g) + "\n" for (c, p, r, a), g in zip(rows, gts, strict=True)))
    return str(path)


def simulated(tmp_path, seed=5):
    """Contigs, variants of all kinds (two alternatives at some places, deletions over other variants, one long insertion), founders'
    haplotypes, people made of them, and reads of one more."""
    rng = random.Random(seed)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    genome = {"c1": base(4000), "c2": base(2500)}
    variants = []
    for c, seq in genome.items():
        p = 60
        while p < len(seq) - 120:
            kind = rng.randrange(8)
            ref = seq[p]
            if kind < 4:
                alts = rng.sample([b for b in "ACGT" if b != ref], 1 if kind else 2)
                variants += [(c, p, ref, a) for a in sorted(alts)]
            elif kind < 6:
                variants.append((c, p, seq[p : p + rng.randint(2, 9)], ref))
                if kind == 5 and rng.random() < 0.3:
                    q = p + 1
                    variants.append((c, q, seq[q], rng.choice([b for b in "ACGT" if b != seq[q]])))
            else:
                variants.append((c, p, ref, ref + base(70 if len(variants) == 20 else rng.randint(1, 8))))
            p += rng.randint(25, 60)
    founders = [[0] * len(variants) for _ in range(4)]
    for i, (c, p, r, a) in enumerate(variants):
        for f in founders:
            # no haplotype carries two variants that overlap
            clash = any(f[j] and variants[j][0] == c and variants[j][1] + len(variants[j][2]) > p for j in range(max(0, i - 3), i))
            f[i] = int(not clash and rng.random() < 0.35)

    def mosaic():
        hap, at = [], 0
        while at < len(variants):
            n = rng.randint(15, 40)
            hap += rng.choice(founders)[at : at + n]
            at += n
        for i, (c, p, _, _) in enumerate(variants):  # seams may bring overlapping variants together
            if hap[i] and any(hap[j] and variants[j][0] == c and variants[j][1] + len(variants[j][2]) > p for j in range(max(0, i - 3), i)):
                hap[i] = 0
        return hap

    haps = [mosaic() for _ in range(2 * PEOPLE + 2)]
    # a population's file lists what someone in it carries
    kept = [v for v in range(len(variants)) if any(h[v] for h in haps[:-2])]
    variants, haps = [variants[v] for v in kept], [[h[v] for v in kept] for h in haps]
    (tmp_path / "ref.fa").write_text("".join(f">{c} x\n" + "".join(f"{s[j : j + 60]}\n" for j in range(0, len(s), 60)) for c, s in genome.items()))
    vcf = written(tmp_path / "pop.vcf", variants, PEOPLE, [[f"{haps[2 * i][v]}|{haps[2 * i + 1][v]}" for i in range(PEOPLE)] for v in range(len(variants))])
    own = haps[-2:]
    truth = written(tmp_path / "truth.vcf", variants, 1, [[f"{own[0][v]}|{own[1][v]}"] for v in range(len(variants))])
    reads = []
    for hap in own:
        for c, s in genome.items():
            for i in reversed(range(len(variants))):
                if hap[i] and variants[i][0] == c:
                    _, p, r, a = variants[i]
                    s = s[:p] + a + s[p + len(r) :]
            for _ in range(int(len(s) * 7.5 / 100)):
                at = rng.randrange(len(s) - 99)
                read = "".join(rng.choice("ACGT") if rng.random() < 0.002 else b for b in s[at : at + 100])
                reads.append(read if rng.random() < 0.5 else read.translate(str.maketrans("ACGT", "TGCA"))[::-1])
    (tmp_path / "reads.fq").write_text("".join(f"@r{i}\n{s}\n+\n{'I' * 100}\n" for i, s in enumerate(reads)))
    return vcf, truth


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("population")
    vcf, truth = simulated(folder)
    P.build_index(spark, f"{folder}/ref.fa", vcf, f"{folder}/idx", P.Config(k=K, modulo=20_011))
    return folder, vcf, truth


def test_a_simulated_individual_is_genotyped(spark, made):
    folder, vcf, truth = made
    P.genotype(spark, f"{folder}/idx", f"{folder}/reads.fq", f"{folder}/out", P.Config(coverage=15.0), debug=True)
    sample = io.read_vcf(spark, f"{folder}/out/rows")
    got = V.score(io.read_vcf(spark, truth), sample).first()
    assert got.f1 >= 0.959, got
    by_type = {r.type: r.recall for r in V.score_by_type(io.read_vcf(spark, truth), sample).collect()}
    assert by_type["snp"] > 0.9 and by_type["indel"] > 0.85, by_type
    assert V.score(io.read_vcf(spark, truth), sample, "indels").first().f1 > 0.85
    tables, _ = io.load_bundle(spark, f"{folder}/idx")
    report = spark.read.parquet(f"{folder}/out.debug")
    assert report.count() == tables["variants"].count() and report.where("helper_id is null").count() == 0
    assert spark.read.parquet(f"{folder}/out.node_counts").where("n > 0").count() > 50


def test_every_allele_has_a_path_and_nodes(spark, made):
    tables, meta = io.load_bundle(spark, f"{made[0]}/idx")
    assert meta["people"] == PEOPLE and tables["nodes"].select("node_id").distinct().count() == tables["alleles"].count()
    assert tables["alleles"].where("allele > 1").count() > 0
    # paths carry each haplotype, so that the model knows what each number of copies comes with
    carried = tables["copies"].where("g > 0").join(tables["index"].select("node_id").distinct(), tables["copies"].variant_id == tables["index"].node_id, "left_semi")
    seen = carried.join(tables["population_counts"], ["variant_id", "individual"], "left_semi").count()
    assert seen >= 0.97 * carried.count()


def test_commands_over_an_index(spark, made, tmp_path, capsys):
    folder, vcf, truth = made
    out = lambda name: str(tmp_path / name)
    main(["sample_node_counts_from_population", f"{folder}/idx", out("model")], spark)
    main(["refine_sampling_model", out("model"), out("refined")], spark)
    main(["refine_sampling_model", out("model"), out("prior"), "--prior", "0.1"], spark)
    main(["make_sparse_count_model", out("refined"), out("sparse")], spark)
    assert spark.read.parquet(out("refined")).count() >= spark.read.parquet(out("model")).count()
    assert spark.read.parquet(out("sparse")).where("lf > 0").count() == 0
    main(["find_tricky_variants", f"{folder}/idx", out("tricky")], spark)
    main(["find_variants_with_nonunique_kmers", f"{folder}/idx", out("nonunique")], spark)
    n = spark.read.parquet(out("tricky")).count()
    assert n == spark.read.parquet(out("nonunique")).count() > 50
    main(["create_helper_model", vcf, out("helpers")], spark)
    tables, _ = io.load_bundle(spark, out("helpers"))
    assert tables["prior"].count() == 9 * tables["helpers"].count()
    main(["make_index_bundle", out("bundle"), f"model={out('refined')}", "--start", f"{folder}/idx"], spark)
    assert io.load_bundle(spark, out("bundle"))[1]["k"] == K
    main(["analyse_variants", f"{folder}/idx", out("report"), "--truth", truth, "--sample", truth], spark)
    assert spark.read.parquet(out("report")).count() == n
    main(["genotype", f"{folder}/idx", f"{folder}/reads.fq", out("g"), "--for-imputer", "--only-impute-svs", "--ignore-hom-ref", "--debug"], spark)
    assert all("0/0:" not in r.value for r in spark.read.text(f"{out('g')}/rows").collect())
    main(["debug", f"{out('g')}.debug", "--rows", "3"], spark)
    main(["genotype_accuracy", truth, truth, "--split", "--limit-to", "snps"], spark)
    main(["naive_genotyper", vcf, out("naive")], spark)
    assert "0/0:-0.477121,-0.477121,-0.477121:" in spark.read.text(f"{out('naive')}/rows").first().value
    main(["simulate_reads", f"{folder}/ref.fa", out("fq"), "--coverage", "2", "--insert", "300"], spark)
    assert io.read_reads(spark, out("fq")).count() > 50
    main(["glimpse_index", vcf, out("regions")], spark)
    main(["glimpse", vcf, out("ran"), "--command", "echo {chrom}:{first}-{last}"], spark)
    assert sorted(r.said.split(":")[0] for r in spark.read.parquet(out("ran")).collect()) == ["c1", "c2"]
    with pytest.raises(RuntimeError, match="regions failed"):
        main(["glimpse", vcf, out("ran"), "--command", "false"], spark)
    main(["test", "--variants", "150", "--individuals", "20"], spark)
    main(["free_memory"], spark)
    assert "with helpers" in capsys.readouterr().out


def test_faulty_input_is_refused(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">1\nACGTACGT\n")
    for alt, info in (("C,G", "AF=0.1"), ("<DEL>", "AF=0.1"), ("C", "AC=1")):
        (tmp_path / "v.vcf").write_text(f"##a\n#CHROM\tPOS\n1\t2\t.\tC\t{alt}\t.\t.\t{info}\tGT\t0|1\n")
        with pytest.raises(ValueError, match="can't be built from"):
            P.build_index(spark, f"{tmp_path}/r.fa", f"{tmp_path}/v.vcf", f"{tmp_path}/i")
