"""Simulated reads and genotypes: the same seed gives the same rows on any cluster, and in any engine, as chance comes from
integer arithmetic on a row's keys alone."""

from __future__ import annotations

from ..plans.relation import Op


def chance(seed: int, *keys: str) -> str:
    """SQL of a number from 0 to 2**32 - 1 from keys that are small whole numbers, none negative."""
    x = str(seed * 7919 + 17)
    for k in keys:
        x = f"(({x} + ({k})) % 2147483648 * 2654435761 % 4294967296)"
        x = f"(({x} % 65536) * 65536 + cast(floor({x} / 65536) as bigint)) % 4294967296"
    return f"(({x}) % 2147483648 * 1597334677 % 4294967296)"


def below(p: float, seed: int, *keys: str) -> str:
    """SQL of an event of probability p."""
    return f"({chance(seed, *keys)} < {int(p * 2**32)})"


def reads(coverage: float = 2.0, length: int = 50, error: float = 0.001, seed: int = 1, insert: int = 0) -> Op:
    """G1: reads of the two haplotypes of each contig (path_id, chrom, ix, seq), each at half the coverage: uniform starts, single
    base errors, half of the reads from the other strand. With an insert size each read has a mate on the other strand, `insert`
    bases from its start to the mate's end. A haplotype shorter than a fragment has no reads."""
    span = max(length, insert)
    n_reads = coverage / 2 / length / (2 if insert else 1)

    def read(mate: int, begin: str) -> str:
        other = "case when c.other then 0 else 1 end" if mate else "case when c.other then 1 else 0 end"
        return f"""select c.path_id, c.chrom, c.ix, c.i, {mate} as mate, {begin} as start, {other} as back, substr(c.seq, cast({begin} + 1 as int), {length}) as bases from c"""

    both = read(0, "c.start") + (f" union all {read(1, f'c.start + {span - length}')}" if insert else "")
    wrong = below(error * 4 / 3, seed + 1, "ix", "path_id", "i", "mate", "J")
    swap = f"substr('acgt', cast(1 + {chance(seed + 2, 'ix', 'path_id', 'i', 'mate', 'J')} % 4 as int), 1)"
    return Op(
        "read_simulation",
        "sequences",
        f"""with many as (select path_id, chrom, ix, seq, @each(0; cast(floor(length(seq) * {n_reads!r}) as bigint)) as i from {{sequences}} where length(seq) >= {span}),
        c as (
          select path_id, chrom, ix, seq, i, {chance(seed, "ix", "path_id", "i")} % (length(seq) - {span - 1}) as start, {below(0.5, seed + 3, "ix", "path_id", "i")} as other
          from many where i < cast(floor(length(seq) * {n_reads!r}) as bigint)
        ), r as ({both}),
        e as (select path_id, chrom, i, mate, start, back, @mapped(bases; case when {wrong} then {swap} else b end) as bases from r)
        select concat(chrom, '_', cast(path_id as string), '_', cast(i as string), '/', cast(mate + 1 as string)) as read_id, chrom, path_id, cast(start as bigint) as start,
          case when back = 1 then reverse(translate(bases, 'acgt', 'tgca')) else bases end as seq from e""",
    )


def genotypes(individuals: int = 10, coverage: int = 7, seed: int = 1) -> Op:
    """(variant_id, individual, g, n): genotypes with runs of five variants that agree but for a fifth of the rows, and counts of
    the alternative's node: coverage times its copies, with noise, and twice that for one variant in eight, which occurs twice."""
    g = f"case when {below(0.2, seed, 'individual', 'variant_id')} then {chance(seed + 1, 'individual', 'variant_id')} % 3 else {chance(seed + 2, 'individual', 'cast(floor(variant_id / 5) as bigint)')} % 3 end"
    return Op(
        "data_simulation",
        "variants",
        f"""select variant_id, individual, g, cast(greatest(0, (g * {coverage} + {chance(seed + 3, 'individual', 'variant_id')} % {coverage} - {coverage // 2}) * case when variant_id % 8 = 0 then 2 else 1 end) as bigint) as n
        from (select variant_id, individual, {g} as g from (select variant_id, @each(0; {individuals - 1}) as individual from (select distinct variant_id from {{variants}}) a) b) c""",
    )
