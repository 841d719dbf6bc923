"""Genomic relations derived from the driver's tables, so that every operator also runs at any scale factor.

reads come from whole documents, contigs from benchmark items; letters other than a, c, g, t are mapped onto them.
"""

from __future__ import annotations

from ..plans.relation import Op

_DNA = "@strip(translate(lower({0}), 'bdefhijklmnopqrsuvwxyz', 'acgtacgtacgtacgtacgtac'); [^acgt])"

reads = Op("reads", "documents", "select doc_id as read_id, " + _DNA.replace("{0}", "text") + " as seq from {documents} where text is not null")
contigs = Op(
    "contigs",
    "benchmark",
    """select cast(b.item_id as string) as chrom, o.ix, """
    + _DNA.replace("{0}", "b.text")
    + """ as seq from {benchmark} b join (select item_id, row_number() over (order by item_id) - 1 as ix from {benchmark}) o on o.item_id = b.item_id""",
    "The ids of few rows are numbered in one task; the texts are not.",
)
#: One substitution every 37 bases from base 20 on, ten bases clear of either end.
snps = Op(
    "snps",
    "contigs",
    """select ix * 1000 + k as variant_id, chrom, 20 + 37 * k as pos, substr(seq, cast(21 + 37 * k as int), 1) as ref,
         translate(substr(seq, cast(21 + 37 * k as int), 1), 'acgt', 'cgta') as alt
       from (select *, @each(0; cast(floor((length(seq) - 31) / 37) as bigint)) as k from {contigs} where length(seq) >= 31) t""",
    contigs=contigs,
)
#: Substitutions, deletions, insertions and longer replacements at places given by the part's key.
variants = Op(
    "variants",
    "part contigs benchmark",
    """select p_partkey as variant_id, chrom, pos, ref,
         case kind when 0 then translate(ref, 'acgt', 'cgta') when 1 then substr(ref, 1, 1)
           when 2 then concat(ref, @times('ac'; 1 + p_size % 40)) else concat(reverse(ref), 'g') end as alt,
         cast((p_partkey * 37) % 100 as double) / 100 as af
       from (
         select p.p_partkey, p.p_size, c.chrom, p.p_partkey % 4 as kind, (p.p_partkey * 13) % (length(c.seq) - 14) as pos,
           substr(c.seq, cast(1 + (p.p_partkey * 13) % (length(c.seq) - 14) as int),
             cast(case p.p_partkey % 4 when 0 then 1 when 1 then 2 + p.p_size % 11 when 2 then 1 else 2 + p.p_size % 5 end as int)) as ref
         from (select p_partkey, p_size, p_partkey % (select count(*) from {benchmark}) as ix from {part}) p join {contigs} c on c.ix = p.ix
       ) t""",
    contigs=contigs,
)
#: Large and small variants on one axis per brand, for interval operators.
spans = Op(
    "spans",
    "lineitem",
    """select l_orderkey * 10 + l_linenumber as variant_id, l_returnflag as chrom, (l_partkey * 97 + l_suppkey) % 1000000 as pos,
         cast(case when l_quantity >= 49 then 51 + l_linenumber * 7 when l_linenumber % 3 = 0 then 1 + cast(l_quantity as int) % 9 else 1 end as bigint) as len_ref,
         cast(case when l_linenumber % 4 = 1 then 1 + cast(l_quantity as int) % 30 else 1 end as bigint) as len_alt, l_discount * 10 as af, l_linenumber = 7 and l_quantity > 40 as has_n
       from {lineitem}""",
)
haplotypes = Op(
    "haplotypes",
    "lineitem",
    "select l_partkey as variant_id, l_suppkey % 20 as hap_id, max(l_linenumber % 3) as allele from {lineitem} group by l_partkey, l_suppkey % 20 having max(l_linenumber % 3) > 0",
    "Sparse: an absent row is allele 0.",
)
genotypes = Op(
    "genotypes",
    "haplotypes",
    """select v.variant_id, v.individual, cast(coalesce(sum(case when h.allele = 1 then 1 else 0 end), 0) as bigint) as g
       from (select variant_id, @each(0; 9) as individual from (select distinct variant_id from {haplotypes}) d) v
       left join {haplotypes} h on h.variant_id = v.variant_id and cast(floor(h.hap_id / 2) as bigint) = v.individual
       group by v.variant_id, v.individual""",
    "Ten individuals, dense.",
    haplotypes=haplotypes,
)
#: What an index can be built from and what it can't.
raw_variants = Op(
    "raw_variants",
    "variants",
    """select variant_id, chrom, pos, ref, case when variant_id % 13 = 0 then concat(alt, ',a') when variant_id % 17 = 0 then '<INS>' when variant_id % 23 = 0 then '*' else alt end as alt,
         case when variant_id % 19 = 0 then null else af end as af from {variants}""",
    variants=variants,
)
#: A third of the variants, so that spans of merged ones stay short, and twelve haplotypes that carry them.
few_variants = Op("few_variants", "variants", "select variant_id, chrom, pos, ref, alt, af from {variants} where variant_id % 3 = 0", variants=variants)
carried = Op(
    "carried",
    "variants",
    "select variant_id, hap_id, 1 as allele from (select variant_id, @each(0; 11) as hap_id from {variants}) v where (variant_id * 7 + hap_id * 5 + cast(floor(variant_id / 9) as bigint)) % 4 = 0",
    variants=few_variants,
)
#: The same counts in another population.
other_observed = Op("other_observed", "lineitem", "select l_partkey as variant_id, l_orderkey % 10 as individual, count(*) as n from {lineitem} where l_suppkey % 2 = 1 group by l_partkey, l_orderkey % 10")
truth = Op(
    "truth",
    "lineitem",
    """select l_orderkey * 10 + l_linenumber as k, case when l_quantity > 40 then 'sv' when l_quantity > 20 then 'indel' else 'snp' end as type,
         case when l_linenumber = 6 then '.' when l_returnflag = 'A' then '0|0' when l_returnflag = 'N' then '1|0' when l_linestatus = 'F' then '1|1' else '1|2' end as gt
       from {lineitem}""",
)
sample = Op(
    "sample",
    "lineitem",
    """select l_orderkey * 10 + l_linenumber as k,
         case when l_linenumber = 5 then './.' when l_suppkey % 5 = 0 then '0/0:9' when l_returnflag = 'N' then '0/1:7' when l_returnflag = 'R' then '1/1' else '0/0' end as gt
       from {lineitem} where l_orderkey % 7 <> 0""",
)
#: Calls of which some are of variants that the truth doesn't have.
strange_sample = Op("strange_sample", "sample", "select case when k % 10 = 6 then k + 3 else k end as k, gt from {sample}", sample=sample)
#: Calls with several alternatives, listed in one order by the truth and in another by the sample.
alt_truth = Op(
    "alt_truth",
    "orders",
    """select o_orderkey as row_id, 'c' as chrom, o_orderkey as pos, 'a' as ref, 'c,g,t' as alts, 'snp' as type, case o_custkey % 5 when 0 then '0|0' when 1 then '0|2' when 2 then '3|1' when 3 then '.' else '2|2' end as gt from {orders}""",
)
alt_sample = Op(
    "alt_sample",
    "orders",
    """select o_orderkey as row_id, 'c' as chrom, o_orderkey as pos, 'a' as ref, case when o_custkey % 7 < 5 then 't,c,g' else 'g,t' end as alts, 'snp' as type, case o_custkey % 7 when 0 then '0/0' when 1 then '0/3' when 2 then '2/1:9' when 3 then './.' when 4 then '3/3' when 5 then '1/1' else '0/2' end as gt from {orders} where o_orderkey % 3 > 0""",
)
#: Genotype calls with three log-likelihoods.
calls = Op(
    "calls",
    "lineitem",
    """select l_orderkey * 10 + l_linenumber as variant_id, l_returnflag as chrom, l_orderkey as pos,
         -l_quantity / 5 as l0, -(l_linenumber + l_discount * 10) as l1, -(l_tax * 100 + l_suppkey % 3) as l2
       from {lineitem}""",
)
