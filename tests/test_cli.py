import pytest

from allelith.cli import main
from allelith.plans import vcf_filters as V
from allelith.sources import genomics as io

HEAD = "##fileformat=VCFv4.2\n##contig=<ID=1>\n##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS\n"


def vcf(path, rows):
    path.write_text(HEAD + "".join(f"{c}\t{p}\t.\t{r}\t{a}\t.\tPASS\t{i}\tGT\t{g}\n" for c, p, r, a, i, g in rows))
    return str(path)


def kept(spark, out):
    return [tuple(r.value.split("\t")[i] for i in (1, 3, 4)) for r in spark.read.text(f"{out}/rows").collect()]


def test_filters(spark, tmp_path):
    rows = [("1", 5, "A", "C", "AF=0.01", "0|1"), ("1", 5, "A", "G", "AF=0.3", "0|1"), ("1", 10, "A" * 60, "A", "AF=0.5", "1|1"), ("1", 20, "AT", "A", "AF=0.05", "0|0"), ("2", 20, "AT", "A", "AF=0.05", "0|0"), ("2", 21, "C", "G", "AF=0.5", ".|.")]
    src = vcf(tmp_path / "a.vcf", rows)
    for command, extra, want in (
        ("filter_variants", ["--skip-snps", "--min-indel", "1"], [2, 3, 4]),
        ("filter_snps_indels_covered_by_svs", [], [0, 1, 2, 4, 5]),
        ("remove_overlapping_indels", [], [0, 1, 2, 5]),
        ("filter_low_freq_alleles", [], [1, 2, 3, 4, 5]),
        ("filter_low_freq_alleles", ["--only-deletions"], [0, 1, 2, 5]),
    ):
        main([command, src, str(tmp_path / "out"), *extra], spark)
        assert kept(spark, tmp_path / "out") == [(str(rows[i][1]), rows[i][2], rows[i][3]) for i in want], command


def test_accuracy_and_validation(spark, tmp_path):
    truth = io.read_vcf(spark, vcf(tmp_path / "t.vcf", [("1", 1, "A", "C", ".", "0|0"), ("1", 2, "A", "C", ".", "0|1"), ("1", 10, "A", "C", ".", "0|1")]))
    sample = io.read_vcf(spark, vcf(tmp_path / "s.vcf", [("1", 1, "A", "C", ".", "1/0"), ("1", 2, "A", "C", ".", "0/1"), ("1", 10, "A", "C", ".", "0/0")]))
    assert V.score(truth, sample).first().f1 == 0.5
    with pytest.raises(ValueError):
        V.score(sample, io.read_vcf(spark, vcf(tmp_path / "u.vcf", [("1", 3, "A", "C", ".", "0|0")])))


def test_haploid_and_svs(spark, tmp_path):
    src = vcf(tmp_path / "h.vcf", [("1", 1, "A", "C", ".", "1"), ("1", 2, "C", "G", ".", ".")])
    main(["convert_haploid_vcf", src, str(tmp_path / "h")], spark)
    assert [r.value.split("\t")[-1] for r in spark.read.text(f"{tmp_path}/h/rows").collect()] == ["1|1", ".|."]
    (tmp_path / "r.fa").write_text(">1\nACGTACGTNN\n")
    src = vcf(tmp_path / "v.vcf", [("1", 2, "C", "<CN0>", "END=5", "0|1"), ("1", 3, "G", "<INS>", ".", "0|1"), ("1", 3, "G", "GA", ".", ".|."), ("1", 4, "C", "A", ".", "0|1"), ("1", 4, "T", "A", ".", "0|1"), ("1", 8, "T", "<CN0>", "END=10", "0|1")])
    main(["preprocess_sv_vcf", str(tmp_path / "r.fa"), src, str(tmp_path / "v")], spark)
    assert kept(spark, tmp_path / "v") == [("2", "CGTA", "C"), ("4", "T", "A")]
