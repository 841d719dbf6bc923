import random

import pytest

from allelith.plans import genotyping as P
from allelith.sources import genomics as io
from allelith.functions import simulate
from allelith.streaming import reads as S

SEQ = "ACGTTGCAAGCTAGGATCCATTAGCATCGATCGGCTAAATCGGATTCCGATAGGCTTAACGATCGCATAGCCTAGGATTTCAGAGCTC"
VCF = """##fileformat=VCFv4.2
##contig=<ID=chr1,length=90>
##x
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb
chr1\t31\t.\t{r1}\t{a1}\t.\tPASS\tAF=0.5\tGT\t0|1\t1|1
chr1\t61\t.\t{r2}\t{a2}\t.\tPASS\tAF=0.5\tGT\t0|0\t.|1
"""


def files(tmp_path):
    swap = dict(zip("ACGT", "CGTA", strict=True))
    (tmp_path / "ref.fa").write_text(f">chr1 something\n{SEQ[:50]}\n{SEQ[50:]}\n>chr2\nACGTN\n")
    (tmp_path / "pop.vcf").write_text(VCF.format(r1=SEQ[30], a1=swap[SEQ[30]], r2=SEQ[60], a2=swap[SEQ[60]]))
    alt = SEQ[:30] + swap[SEQ[30]] + SEQ[31:]
    (tmp_path / "reads.fq").write_text("".join(f"@r{i}\n{s}\n+\n{'@' * len(s)}\n" for i, s in enumerate([SEQ[10:80], alt[5:75], SEQ[5:85], alt[10:80]] * 4)))


def test_readers(spark, tmp_path):
    files(tmp_path)
    assert {r.chrom: r.seq for r in io.read_fasta(spark, f"{tmp_path}/ref.fa").collect()} == {"chr1": SEQ, "chr2": "ACGTN"}
    vcf = io.read_vcf(spark, f"{tmp_path}/pop.vcf")
    assert [(r.chrom, r.pos, r.ref) for r in vcf.orderBy("file_row").collect()] == [("chr1", 30, SEQ[30]), ("chr1", 60, SEQ[60])]
    header = io.vcf_header(spark, f"{tmp_path}/pop.vcf")
    assert io.contigs_of(header) == ["chr1"] and len(header) == 4
    haps = sorted((r.variant_id, r.hap_id, r.allele) for r in io.haplotypes(vcf).collect())
    first, second = sorted({h[0] for h in haps})
    assert haps == [(first, 1, 1), (first, 2, 1), (first, 3, 1), (second, 2, None), (second, 3, 1)] or [h[1:] for h in haps] == [(1, 1), (2, 1), (3, 1), (2, None), (3, 1)]
    reads = io.read_reads(spark, f"{tmp_path}/reads.fq").collect()
    assert len(reads) == 16 and {r.read_id for r in reads} == {f"r{i}" for i in range(16)} and all(set(r.seq) <= set("acgt") for r in reads)
    parts = io.genome_chunks(io.read_fasta(spark, f"{tmp_path}/ref.fa"), 20).where("chrom = 'chr1'").orderBy("ck").collect()
    assert [p.seq for p in parts] == [SEQ[i : i + 20] for i in range(0, len(SEQ), 20)]


def small_splits(spark, size):
    """Files split every so many bytes, whatever their number."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


@pytest.fixture
def splits(spark):
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: small_splits(spark, size)
    for c, v in before.items():
        spark.conf.set(c, v)


def test_reads_of_many_files_in_small_splits(spark, tmp_path, splits):
    rng, want = random.Random(3), {}
    for f, n in (("a", 120), ("b", 64), ("c", 1)):
        text = ""
        for i in range(n):
            seq = "".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 90)))
            # quality lines that begin with the mark of a record, or with a plus
            quality = rng.choice("@+I") + "".join(rng.choice("@+I#") for _ in range(len(seq) - 1))
            want[f"{f}{i} x/1"] = seq.lower()
            text += f"@{f}{i} x/1\n{seq}\n+{f}{i}\n{quality}\n"
        (tmp_path / f"{f}.fq").write_text(text)
    paths = [f"{tmp_path}/{f}.fq" for f in "abc"]
    for size in (3000, 700, 128 << 20):
        splits(size)
        got = [(r.read_id, r.seq) for r in io.read_reads(spark, paths).collect()]
        assert len(got) == len(want) and dict(got) == want, size


def test_genome_of_many_files_in_small_splits(spark, tmp_path, splits):
    rng, want = random.Random(4), {}
    for f, contigs in (("a", 3), ("b", 1), ("c", 5)):
        text = ""
        for i in range(contigs):
            seq = "".join(rng.choice("ACGTn") for _ in range(rng.randint(0, 900)))
            want[f"{f}{i}"] = seq
            width = rng.randint(7, 80)
            text += f">{f}{i} some words\n" + "".join(f"{seq[j : j + width]}\n" for j in range(0, len(seq), width))
        (tmp_path / f"{f}.fa").write_text(text)
    for size, chunk in ((150, 64), (400, 33), (128 << 20, 1 << 16)):
        splits(size)
        got = {}
        for r in io.read_genome(spark, [f"{tmp_path}/{f}.fa" for f in "abc"], chunk).orderBy("chrom", "ck").collect():
            assert r.ck == -(-len(got.get(r.chrom, "")) // chunk) and len(r.seq) <= chunk
            got[r.chrom] = got.get(r.chrom, "") + r.seq
        assert got == {c: s for c, s in want.items() if s}, size


def test_likelihoods_are_written_plainly(spark):
    calls = spark.createDataFrame([(1, "1", 4, "A", "C", "0/1", -1234.5, 0.0, -0.25, 17)], "variant_id bigint, chrom string, pos bigint, ref string, alt string, gt string, g0 double, g1 double, g2 double, gq bigint")
    line = io.vcf_lines(calls, likelihoods=True).first().line
    assert line.split("\t") == ["1", "5", "variant1", "A", "C", ".", ".", ".", "GT:GL:GQ", "0/1:-1234.500000,-0.00000000001,-0.250000:17"]
    assert io.vcf_lines(calls).first().line.split("\t")[-2:] == ["GT", "0/1"]
    head = ["##a", "##b", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
    assert io.header_with_sample(head, "me")[-1].split("\t")[-2:] == ["FORMAT", "me"] and len(io.header_with_sample(head, "me")) == 3 + len(io.FORMAT_LINES) and io.header_with_sample(head, "me", False)[:-1] == head[:-1]


def test_a_third_allele_is_an_error(spark, tmp_path):
    (tmp_path / "t.vcf").write_text("#CHROM\n1\t5\t.\tA\tC\t.\t.\t.\tGT\t0/1/1\n")
    with pytest.raises(Exception, match="more than two alleles"):
        io.haplotypes(io.read_vcf(spark, f"{tmp_path}/t.vcf")).collect()


def test_regions_and_chunk_files(spark, tmp_path):
    (tmp_path / "r.bed").write_text("# head\nchr1\t5\t10\nchr2\t0\t3\n")
    assert [tuple(r) for r in io.read_regions(spark, f"{tmp_path}/r.bed").collect()] == [("chr1", 5, 10), ("chr2", 0, 3)]
    (tmp_path / "c.txt").write_text("0 chr1 chr1:1-100 chr1:1-80\n")
    assert [tuple(r) for r in io.read_imputer_chunks(spark, f"{tmp_path}/c.txt").collect()] == [("0", "chr1", "chr1:1-100", "chr1:1-80")]


def test_index_and_genotype(spark, tmp_path):
    files(tmp_path)
    P.build_index(spark, f"{tmp_path}/ref.fa", f"{tmp_path}/pop.vcf", f"{tmp_path}/idx", P.Config(k=11))
    calls = P.genotype(spark, f"{tmp_path}/idx", f"{tmp_path}/reads.fq", f"{tmp_path}/out", P.Config(coverage=16.0))
    assert {r.pos: r.gt for r in calls.collect()} == {30: "0/1", 60: "0/0"}
    lines = [r.value for r in spark.read.text(f"{tmp_path}/out/rows").collect()]
    assert len(lines) == 2 and lines[0].split("\t")[8] == "GT:GL:GQ" and lines[0].split("\t")[1] == "31"
    head = [r.value for r in spark.read.text(f"{tmp_path}/out/header").collect()]
    assert head[-1].split("\t")[-1] == "sample" and any("ID=GQ" in x for x in head)


def test_simulated_reads_come_from_the_haplotypes(spark):
    seq = "acgttgcaagctaggatcc" * 20
    both = spark.createDataFrame([(0, "1", 0, seq), (1, "1", 0, seq.replace("gg", "gc"))], "path_id bigint, chrom string, ix bigint, seq string")
    sides = [s for q in (seq, seq.replace("gg", "gc")) for s in (q, q.translate(str.maketrans("acgt", "tgca"))[::-1])]
    got = simulate.reads(coverage=6.0, length=30, error=0.0)(both).collect()
    assert len(got) == 2 * int(len(seq) * 3 / 30) and all(any(r.seq in s for s in sides) for r in got) and len({r.start for r in got}) > 20
    assert 0.25 < sum(r.seq in sides[0] or r.seq in sides[2] for r in got) / len(got) < 0.75
    pairs = {}
    for r in simulate.reads(coverage=6.0, length=30, error=0.0, insert=100)(both).collect():
        pairs.setdefault(r.read_id.split("/")[0], []).append(r)
    assert all(len(p) == 2 and abs(p[0].start - p[1].start) == 70 for p in pairs.values())
    wrong = simulate.reads(coverage=6.0, length=30, error=0.05)(both).collect()
    changed = sum(a != b for r, w in zip(sorted(got, key=lambda r: r.read_id), sorted(wrong, key=lambda r: r.read_id), strict=True) for a, b in zip(r.seq, w.seq, strict=True))
    assert 0.03 < changed / (30 * len(got)) < 0.07


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    rows = [(i, "acgttgcaagctaggatccattag"[i % 5 :]) for i in range(20)]
    spark.createDataFrame(rows, "read_id bigint, seq string").repartition(3).write.parquet(f"{tmp_path}/reads")
    index = spark.createDataFrame([(int("".join(str("acgt".index(c)) for c in "acgttgcaagc"), 4), 7), (int("".join(str("acgt".index(c)) for c in "gcaagctagga"), 4), 8)], "kmer bigint, node_id bigint")
    q = S.node_counts(S.read_stream(spark, f"{tmp_path}/reads"), index).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {r.node_id: r.n for r in spark.table("counts").collect()} == {7: 4, 8: 20}
