"""Haplotypes and genotypes: sparse long tables, one row for each carried allele."""

from __future__ import annotations

from ..plans.relation import Op

to_biallelic = Op(
    "to_biallelic",
    "haplotypes n_alleles",
    """select h.variant_id, a.alt_ix, h.hap_id, case when h.allele is null then null when h.allele = a.alt_ix then 1 else 0 end as allele
       from {haplotypes} h join (select variant_id, @each(1; n_alts) as alt_ix from {n_alleles}) a on a.variant_id = h.variant_id
       where h.allele is null or h.allele = a.alt_ix""",
    "F18: a carried allele is 1 in its own row; a missing one (null) is missing in all rows; others are absent, which is 0.",
)
to_multiallelic = Op(
    "to_multiallelic", "biallelic", "select variant_id, hap_id, max(alt_ix) as allele from {biallelic} where allele = 1 group by variant_id, hap_id", "F18: the last alternative that a haplotype carries."
)
n_alleles = Op("n_alleles", "haplotypes", "select variant_id, cast(max(allele) as bigint) as n_alts from {haplotypes} group by variant_id", "A16.")
distinct_alleles = Op("distinct_alleles", "haplotypes", "select variant_id, count(distinct allele) as n from {haplotypes} group by variant_id", "A16: distinct alleles at each variant.")
genotype_matrix = Op(
    "genotype_matrix",
    "haplotypes",
    """select variant_id, cast(floor(hap_id / 2) as bigint) as individual, cast(sum(case when allele = 1 then 1 else 0 end) as bigint) as g, cast(sum(allele) as bigint) as allele_sum
       from {haplotypes} group by variant_id, cast(floor(hap_id / 2) as bigint)""",
    "D11: individual i has haplotypes 2i and 2i + 1; absent rows are 0/0.",
)
allele_freq_summary = Op(
    "allele_freq_summary",
    "genotypes",
    """select variant_id, round(avg(case when g = 0 then 1e0 else 0e0 end), 6) as f_hr, round(avg(case when g = 1 then 1e0 else 0e0 end), 6) as f_het, round(avg(case when g = 2 then 1e0 else 0e0 end), 6) as f_ha
       from {genotypes} group by variant_id""",
    "A7.",
)
normalize_gt = Op(
    "normalize_gt",
    "calls",
    """select k, case when gt = '.' then './.' else @text(@sorted(@split(replace(split_part(gt, ':', 1), '|', '/'); /)); /) end as gt,
         try_cast(split_part(replace(split_part(gt, ':', 1), '|', '/'), '/', 1) as int) as a1,
         try_cast(split_part(replace(split_part(gt, ':', 1), '|', '/'), '/', 2) as int) as a2 from {calls}""",
    "F5, F6: phase and fields dropped, alleles in string order; both as numbers, as they stand in the row, a missing one null.",
)
diploid_from_haploid = Op(
    "diploid_from_haploid", "calls", "select k, case gt when '0' then '0|0' when '1' then '1|1' when '.' then '.|.' end as gt from {calls}", "F11: any other genotype gives null, which the reader refuses."
)
combined_alleles = Op(
    "combined_alleles",
    "haplotypes alleles",
    """select a.site_id as variant_id, h.hap_id, max(cast(a.allele as bigint)) as allele from {haplotypes} h join {alleles} a on a.variant_id = h.variant_id where h.allele > 0 group by a.site_id, h.hap_id""",
    "F18: haplotypes of biallelic variants as haplotypes of the sites that they are alleles of; of several carried alleles the last.",
)
carriers = Op("carriers", "haplotypes", "select distinct hap_id from {haplotypes}")
haploid = Op("haploid", "lineitem", "select l_orderkey * 10 + l_linenumber as k, case l_linestatus when 'F' then '0' else case when l_linenumber = 4 then '.' else '1' end end as gt from {lineitem}")
gt_string = Op("gt_string", "genotypes", "select variant_id, individual, case g when 0 then '0/0' when 1 then '0/1' else '1/1' end as gt from {genotypes}", "F7.")
