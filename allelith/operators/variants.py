"""Row-wise variant operators: validation, filters, types, anchors, allele splits."""

from __future__ import annotations

from ..plans.relation import Op
from .intervals import fetched

input_validation = Op(
    "input_validation",
    "variants",
    """select variant_id, reason is null as ok, reason from (
         select variant_id, case when alt like '%,%' then 'multi-allelic' when alt like '%<%' or alt like '%*%' then 'symbolic' when af is null then 'no frequency' end as reason from {variants}
       ) t""",
    "P1, P5: what an index can't be built from.",
)
without_symbolic = Op("without_symbolic", "variants", "select * from {variants} where alt not like '%*%' and alt not like '%<%'", "P5: spelled-out alleles only.")
in_multiallelic = Op(
    "in_multiallelic",
    "variants",
    "select variant_id, count(*) over (partition by chrom, pos) > 1 as in_group, count(*) over (partition by chrom, pos) = 1 as may_help from {variants}",
    "P17: variants that share their place with others, and those that may serve as helpers since they don't.",
)


def variant_types(limit: int = 50) -> Op:
    """The three definitions of a structural variant differ at the limit and are kept apart."""
    return Op(
        "variant_types",
        "spans",
        f"""select variant_id, case when len_ref >= {limit} or len_alt >= {limit} then 'sv' when len_ref = 1 and len_alt = 1 then 'snp' else 'indel' end as type,
         len_ref > {limit} or len_alt > {limit} as is_sv_a, len_ref > {limit} or len_alt >= {limit} as is_sv_b, len_ref >= {limit} or len_alt >= {limit} as is_sv_c from {{spans}}""",
    )


def limit_types(kind: str) -> Op:
    """P10: all, snps, indels, snps_indels or svs."""
    types = {"all": "'sv', 'snp', 'indel'", "snps": "'snp'", "indels": "'indel'", "snps_indels": "'snp', 'indel'", "svs": "'sv'"}[kind]
    return Op(f"limit_{kind}", "typed", f"select * from {{typed}} where type in ({types})", typed=variant_types())


def filter_variants(skip_snps: bool = True, min_indel: int = 4) -> Op:
    """Drops substitutions on request, and insertions and deletions shorter than min_indel."""
    keep = "false" if skip_snps else "true"
    return Op("filter_variants", "spans", f"select variant_id from {{spans}} where case when len_ref = 1 and len_alt = 1 then {keep} else greatest(len_ref, len_alt) - 1 >= {min_indel} end")


def max_alleles(most: int = 3) -> Op:
    """Rows with at most so many alleles, the reference included."""
    return Op("max_alleles", "multi", f"select chrom, pos, alts from {{multi}} where @size(@split(alts; ,)) + 1 <= {most}")


multi = Op(
    "multi",
    "variants",
    "select chrom, pos, ref, min(variant_id) as variant_id, @text(@list(alt); ,) as alts from {variants} group by chrom, pos, ref",
    "One row for each site, its alternatives in a comma list.",
)
split_multiallelic = Op(
    "split_multiallelic",
    "multi",
    "select variant_id, cast(ix + 1 as bigint) as alt_ix, chrom, pos, ref, alt from (select variant_id, chrom, pos, ref, @poseach(@split(alts; ,); ix; alt) from {multi}) t",
    "F17: one row for each alternative allele.",
)
strip_anchor = Op(
    "strip_anchor",
    "variants",
    """select variant_id, chrom, case when n > 1 then pos + 1 else pos end as pos, case when n > 1 then substr(ref, 2) else ref end as ref, case when n > 1 then substr(alt, 2) else alt end as alt
       from (select *, greatest(length(ref), length(alt)) as n from {variants}) t""",
    "F16: drops the first base of any row with an allele longer than one base.",
)


def pad_anchor(size: int = 1 << 16) -> Op:
    """F16: gives rows with an empty allele the base before them; one at a contig's first base, which has none, goes."""
    return Op(
        "pad_anchor",
        "variants genome",
        f"""with place as (select variant_id as id, chrom, pos - 1 as s, pos as e from {{variants}} where (ref = '' or alt = '') and pos > 0),
        base as ({fetched("place", "{genome}", size)})
        select v.variant_id, v.chrom, case when b.seq is null then v.pos else v.pos - 1 end as pos, concat(coalesce(b.seq, ''), v.ref) as ref, concat(coalesce(b.seq, ''), v.alt) as alt
        from {{variants}} v left join base b on b.id = v.variant_id where v.pos > 0 or (v.ref <> '' and v.alt <> '')""",
    )


replace_ns = Op("replace_ns", "variants", "select variant_id, translate(ref, 'Nn', 'Aa') as ref, translate(alt, 'Nn', 'Aa') as alt from {variants}", "P14.")


def clean_svs(size: int = 1 << 16) -> Op:
    """Keeps spelled-out alleles and re-sequences whole deletions from the reference; drops rows that disagree with it or that
    nobody was called for."""
    return Op(
        "clean_svs",
        "records genome",
        f"""with whole as (select *, alt = '<CN0>' as gone from {{records}} where n_called > 0
          and (alt = '<CN0>' and e is not null or (ref not like '%<%' and alt not like '%<%' and alt not like '%>%' and lower(concat(ref, alt)) not like '%n%'))),
        place as (select variant_id as id, chrom, pos as s, case when gone then greatest(e, pos + 1) else pos + 1 end as e from whole),
        found as ({fetched("place", "{genome}", size)})
        select r.variant_id, r.chrom, r.pos, case when r.gone then f.seq else r.ref end as ref, case when r.gone then substr(f.seq, 1, 1) else r.alt end as alt
        from whole r join found f on f.id = r.variant_id
        where lower(substr(r.ref, 1, 1)) = lower(substr(f.seq, 1, 1)) and ((not r.gone) or lower(f.seq) not like '%n%')""",
    )


allele_frequency = Op(
    "allele_frequency",
    "records",
    "select variant_id, try_cast(@extract(info; (^|;)AF=([^;,]+); 2) as double) as af, try_cast(@extract(info; (^|;)END=([0-9]+); 2) as bigint) as e from {records}",
    "A21, F9: fields of INFO.",
)
