"""Interval operators on variants: merging and padding, grouping, covering, overlaps, counts.

Scans along a contig are made in bins of positions: within a bin by a window, from bin to bin by a window over one row for each bin."""

from __future__ import annotations

from ..plans.relation import Op

#: Bases of a bin of the scans below: a contig is worked on by bins, of which only one number each goes through one task.
BIN = 1 << 16


def fetched(places: str, genome: str, size: int) -> str:
    """SQL of (id, seq): the bases s up to e of contigs that are given in chunks of `size` bases (chrom, ck, seq)."""
    at, end = f"greatest(p.s, p.ck * {size})", f"least(p.e, (p.ck + 1) * {size})"
    return f"""select p.id, @joined(substr(g.seq, cast({at} - p.ck * {size} + 1 as int), cast({end} - {at} as int)); p.ck) as seq
        from (select id, chrom, s, e, @each(cast(floor(s / {size}) as bigint); cast(floor((e - 1) / {size}) as bigint)) as ck from {places} where e > s) p
        join {genome} g on g.chrom = p.chrom and g.ck = p.ck group by p.id"""


def merge_pad(size: int = 1 << 16, bin: int = BIN) -> Op:
    """Variants whose reference spans share a base become alleles over their common span. Insertions (empty ref)
    neither make nor extend a span; inside one they are padded, at its first base they stay.

    A span begins where a variant begins behind all ends before it. The running maximum of ends is taken within bins, and over one number
    for each bin before; so is the count of spans, which tells each variant the span it is in without a join on ranges."""
    order = "partition by chrom, bin order by pos, case when n > 0 then 1 else 0 end, e desc, variant_id"
    earlier = "rows between unbounded preceding and 1 preceding"
    at, end = f"greatest(p.s, p.ck * {size})", f"least(p.e, (p.ck + 1) * {size})"
    bases = f"substr(g.seq, cast({at} - p.ck * {size} + 1 as int), cast({end} - {at} as int))"
    return Op(
        "merge_pad",
        "variants genome",
        f"""with base as (
          select variant_id, chrom, pos, ref, alt, length(ref) as n, pos + length(ref) - 1 as e, cast(floor(pos / {bin}) as bigint) as bin from {{variants}}
        ), reach as (
          select chrom, bin, max(m) over (partition by chrom order by bin {earlier}) as upto from (select chrom, bin, max(case when n > 0 then e end) as m from base group by chrom, bin) a
        ), ahead as (
          select b.*, greatest(coalesce(b.inside, r.upto), coalesce(r.upto, b.inside)) as before
          from (select *, max(case when n > 0 then e end) over ({order} {earlier}) as inside from base) b join reach r on r.chrom = b.chrom and r.bin = b.bin
        ), begun as (select *, case when n > 0 and (before is null or pos > before) then 1 else 0 end as new from ahead),
        many as (select chrom, bin, coalesce(sum(m) over (partition by chrom order by bin {earlier}), 0) as upto from (select chrom, bin, sum(new) as m from begun group by chrom, bin) a),
        counted as (
          select b.variant_id, b.chrom, b.pos, b.ref, b.alt, b.n, b.e, case when b.n > 0 or b.pos <= b.before then m.upto + b.k end as k
          from (select *, sum(new) over ({order} rows between unbounded preceding and current row) as k from begun) b join many m on m.chrom = b.chrom and m.bin = b.bin
        ), placed as (
          select variant_id, chrom, pos, ref, alt, n, case when k is not null then min(case when n > 0 then pos end) over (partition by chrom, home) end as s, case when k is not null then max(case when n > 0 then e end) over (partition by chrom, home) end as e
          from (select *, coalesce(k, -1 - variant_id) as home from counted) a
        ), side as (
          select variant_id, chrom, side, case when side = 0 then s else pos + n end as s, case when side = 0 then pos else e + 1 end as e
          from (select variant_id, chrom, pos, n, s, e, @each(0; 1) as side from placed where s < pos or pos + n <= e) a
        ), part as (
          select p.variant_id, @joined(case when p.side = 0 then {bases} else '' end; p.ck) as l, @joined(case when p.side = 1 then {bases} else '' end; p.ck) as r
          from (select variant_id, chrom, side, s, e, @each(cast(floor(s / {size}) as bigint); cast(floor((e - 1) / {size}) as bigint)) as ck from side where e > s) p
          join {{genome}} g on g.chrom = p.chrom and g.ck = p.ck group by p.variant_id
        )
        select v.variant_id, v.chrom, coalesce(v.s, v.pos) as pos, concat(coalesce(f.l, ''), v.ref, coalesce(f.r, '')) as ref, concat(coalesce(f.l, ''), v.alt, coalesce(f.r, '')) as alt
        from placed v left join part f on f.variant_id = v.variant_id""",
    )


def numbered(bin: int = BIN) -> Op:
    """(variant_id, nth) in the order of chrom, pos, variant_id, from 0: counted by bins, numbered within them."""
    return Op(
        "numbered",
        "variants",
        f"""with v as (select variant_id, chrom, pos, cast(floor(pos / {bin}) as bigint) as bin from {{variants}}),
        many as (select chrom, bin, coalesce(sum(m) over (order by chrom, bin rows between unbounded preceding and 1 preceding), 0) as upto from (select chrom, bin, count(*) as m from v group by chrom, bin) a)
        select v.variant_id, cast(m.upto + row_number() over (partition by v.chrom, v.bin order by v.pos, v.variant_id) - 1 as bigint) as nth from v join many m on m.chrom = v.chrom and m.bin = v.bin""",
    )


def group_sites(bin: int = BIN) -> Op:
    """Variants with one place and reference are a site; allele 0 is the reference. Sites are numbered from 0 in the order
    of chrom and pos, by bins."""
    return Op(
        "group_sites",
        "variants",
        f"""with d as (select chrom, pos, ref, cast(floor(pos / {bin}) as bigint) as bin, min(variant_id) as variant_id from {{variants}} group by chrom, pos, ref),
        many as (select chrom, bin, coalesce(sum(m) over (order by chrom, bin rows between unbounded preceding and 1 preceding), 0) as upto from (select chrom, bin, count(*) as m from d group by chrom, bin) a),
        site as (select d.chrom, d.pos, d.ref, cast(m.upto + row_number() over (partition by d.chrom, d.bin order by d.pos, d.ref) - 1 as bigint) as site_id from d join many m on m.chrom = d.chrom and m.bin = d.bin)
        select site_id, 0 as allele, cast(null as bigint) as variant_id, chrom, pos, ref as seq from site
        union all
        select s.site_id, cast(row_number() over (partition by v.chrom, v.pos, v.ref order by v.variant_id) as int) as allele, v.variant_id, v.chrom, v.pos, v.alt as seq
        from {{variants}} v join site s on s.chrom = v.chrom and s.pos = v.pos and s.ref = v.ref""",
    )


sites = Op(
    "sites",
    "alleles",
    """select site_id, chrom, pos, cast(max(case when allele = 0 then length(seq) end) as bigint) as n_ref, cast(max(allele) + 1 as bigint) as n_alleles from {alleles} group by site_id, chrom, pos""",
    "One row for each site, from the rows of its alleles.",
)
same_start_conflicts = Op(
    "same_start_conflicts", "variants", "select chrom, pos, count(distinct length(ref)) as n_spans from {variants} group by chrom, pos having count(distinct length(ref)) > 1",
    "W2: places whose variants end differently; merged variants have none but where an insertion without anchor stands at a span's first base.",
)


def max_alleles_per_place(most: int = 6) -> Op:
    """Variants of places with no more rows than the limit."""
    return Op("max_alleles_per_place", "variants", f"select variant_id, n from (select variant_id, count(*) over (partition by chrom, pos) as n from {{variants}}) t where n <= {most}")


def too_many_alleles(most: int = 6) -> Op:
    """By original variant, whether any of the biallelic rows made from it stands at a place with more rows than the limit."""
    return Op(
        "too_many_alleles",
        "variants sources",
        f"""select s.source_id, @any(c.n > {most}) as dropped from {{variants}} v join (select chrom, pos, count(*) as n from {{variants}} group by chrom, pos) c on c.chrom = v.chrom and c.pos = v.pos
        join {{sources}} s on s.variant_id = v.variant_id group by s.source_id""",
    )


def stabbing_count(bin: int = 256, scan: int = BIN) -> Op:
    """Most variants over any base of a variant's span, by a sweep of starts and ends and an equi-join on bins."""
    return Op(
        "stabbing_count",
        "spans",
        f"""with edge as (
          select chrom, p, cast(floor(p / {scan}) as bigint) as part, sum(d) as d from (select chrom, pos as p, 1 as d from {{spans}} union all select chrom, pos + len_ref as p, -1 as d from {{spans}}) t group by chrom, p
        ), carry as (
          select chrom, part, coalesce(sum(m) over (partition by chrom order by part rows between unbounded preceding and 1 preceding), 0) as upto, lead(first) over (partition by chrom order by part) as next_first
          from (select chrom, part, sum(d) as m, min(p) as first from edge group by chrom, part) a
        ), depth as (
          select e.chrom, e.p, cast(c.upto + e.d as bigint) as depth, coalesce(e.q, c.next_first, e.p) as q
          from (select chrom, part, p, sum(d) over (partition by chrom, part order by p) as d, lead(p) over (partition by chrom, part order by p) as q from edge) e join carry c on c.chrom = e.chrom and c.part = e.part
        ), binned as (
          select chrom, p, q, depth, @each(cast(floor(p / {bin}) as bigint); cast(floor(greatest(q - 1, p) / {bin}) as bigint)) as bin from depth where depth > 0
        )
        select v.variant_id, max(d.depth) as most from (
          select variant_id, chrom, pos, pos + len_ref as e, @each(cast(floor(pos / {bin}) as bigint); cast(floor((pos + greatest(len_ref, 1) - 1) / {bin}) as bigint)) as bin from {{spans}}
        ) v join binned d on d.chrom = v.chrom and d.bin = v.bin and d.p < v.e and d.q > v.pos group by v.variant_id""",
    )


def max_depth(most: int = 3) -> Op:
    """J8, the filter: variants no base of which is under more variants than the limit."""
    return Op("max_depth", "depths", f"select variant_id from {{depths}} where most <= {most}", depths=stabbing_count())


def covered_by_sv(limit: int = 50, bin: int = 1024, scan: int = BIN) -> Op:
    """Small variants whose first or last base lies inside a structural variant (an allele longer than the limit). Structural
    variants that touch are one span (ends by a running maximum, bins as in merge_pad); probes meet spans in bins."""
    big, small = f"(len_ref > {limit} or len_alt > {limit})", "pos + case when len_ref > 1 or len_alt > 1 then 1 else 0 end"
    order, earlier = "partition by chrom, part order by s, e", "rows between unbounded preceding and 1 preceding"
    return Op(
        "covered_by_sv",
        "spans",
        f"""with sv as (select chrom, {small} as s, {small} + len_ref - 1 as e, cast(floor(({small}) / {scan}) as bigint) as part from {{spans}} where {big}),
        reach as (select chrom, part, max(m) over (partition by chrom order by part {earlier}) as upto from (select chrom, part, max(e) as m from sv group by chrom, part) a),
        begun as (
          select v.chrom, v.part, v.s, v.e, case when s > coalesce(greatest(coalesce(v.inside, r.upto), coalesce(r.upto, v.inside)), -1) then 1 else 0 end as new
          from (select *, max(e) over ({order} {earlier}) as inside from sv) v join reach r on r.chrom = v.chrom and r.part = v.part
        ), many as (select chrom, part, coalesce(sum(m) over (partition by chrom order by part {earlier}), 0) as upto from (select chrom, part, sum(new) as m from begun group by chrom, part) a),
        merged as (
          select chrom, min(s) as s, max(e) as e from (
            select v.chrom, v.s, v.e, m.upto + v.k as k from (select *, sum(new) over ({order} rows between unbounded preceding and current row) as k from begun) v join many m on m.chrom = v.chrom and m.part = v.part
          ) a group by chrom, k
        ), binned as (select chrom, s, e, @each(cast(floor(s / {bin}) as bigint); cast(floor(e / {bin}) as bigint)) as bin from merged),
        probe as (
          select variant_id, chrom, @unnest(@array({small}, {small} + len_ref - 1)) as x from {{spans}} where not {big}
        ), hit as (select distinct p.variant_id from probe p join binned b on b.chrom = p.chrom and b.bin = cast(floor(p.x / {bin}) as bigint) and p.x >= b.s and p.x < b.e)
        select v.variant_id, h.variant_id is not null as covered from {{spans}} v left join hit h on h.variant_id = v.variant_id""",
    )


def overlapping_indels(bin: int = 128) -> Op:
    """Drops an indel whose span, both ends included, touches a substitution or any earlier indel, kept or not, and every row
    with an N in an allele, which then touches nothing. Rows are in the order of variant_id; spans of other contigs don't count.
    A substitution is one base for one."""
    return Op(
        "overlapping_indels",
        "spans",
        f"""with row as (select variant_id, chrom, pos, pos + len_ref as e, len_ref > 1 or len_alt > 1 as is_indel from {{spans}} where not has_n),
        binned as (select variant_id, chrom, pos, case when is_indel then e else pos end as e, is_indel, @each(cast(floor(pos / {bin}) as bigint); cast(floor(case when is_indel then e else pos end / {bin}) as bigint)) as bin from row),
        gone as (
          select distinct a.variant_id from binned a join binned b on a.chrom = b.chrom and a.bin = b.bin and a.is_indel and a.pos <= b.e and b.pos <= a.e
          where (not b.is_indel) or b.variant_id < a.variant_id
        )
        select variant_id from row r where not exists (select 1 from gone g where g.variant_id = r.variant_id)""",
    )


def low_af_deletions(least_af: float = 0.2, least_size: int = 20, large: int = 10, bin: int = 256) -> Op:
    """Rare long deletions over a base where more large variants start than end, by more than one, keep their first base
    only; the alleles come out as they are to be used."""
    return Op(
        "low_af_deletions",
        "spans",
        f"""with large as (select variant_id, chrom, pos, len_ref, len_alt, af from {{spans}} where len_ref > {large} or len_alt > {large}),
        edge as (select chrom, p, sum(d) as d from (select chrom, pos as p, 1 as d from large union all select chrom, pos + len_ref as p, -1 as d from large) t group by chrom, p having sum(d) > 1),
        hit as (
          select distinct v.variant_id from (select variant_id, chrom, pos, pos + len_ref as e, @each(cast(floor(pos / {bin}) as bigint); cast(floor((pos + len_ref - 1) / {bin}) as bigint)) as bin from large where af < {least_af} and len_ref >= {least_size}) v
          join edge x on x.chrom = v.chrom and cast(floor(x.p / {bin}) as bigint) = v.bin and x.p >= v.pos and x.p < v.e
        )
        select s.variant_id, s.af < {least_af} and s.len_ref >= {least_size} as is_low_af, h.variant_id is not null as cleared,
          case when h.variant_id is not null then 1 else s.len_ref end as len_ref, case when h.variant_id is not null then 1 else s.len_alt end as len_alt
        from {{spans}} s left join hit h on h.variant_id = s.variant_id""",
    )


cleared_alleles = Op(
    "cleared_alleles",
    "variants cleared",
    "select v.variant_id, v.chrom, v.pos, case when c.cleared then substr(v.ref, 1, 1) else v.ref end as ref, case when c.cleared then substr(v.alt, 1, 1) else v.alt end as alt from {variants} v join {cleared} c on c.variant_id = v.variant_id",
    "P15: variants that low_af_deletions clears keep the first base of both alleles; the row and its place stay.",
)


def best_per_place(least_af: float = 0.1) -> Op:
    """Variants rarer than the limit go unless they are the first most frequent of their place; the other form drops rare deletions
    only. A variant whose frequency isn't known counts as of frequency 0."""
    return Op(
        "best_per_place",
        "variants",
        f"""select variant_id, f < {least_af!r} and nth > 1 as dropped, f < {least_af!r} and length(ref) > 1 as dropped_deletion
        from (select *, row_number() over (partition by chrom, pos order by f desc, variant_id) as nth from (select *, coalesce(af, 0e0) as f from {{variants}}) a) t""",
    )


distance_to_edge = Op(
    "distance_to_edge",
    "variants merged",
    "select v.variant_id, v.pos - m.pos as before, m.pos + length(m.ref) - (v.pos + length(v.ref)) as after from {variants} v join {merged} m on m.variant_id = v.variant_id",
    "W5: bases between a variant and the ends of its merged span.",
)


def segments(size: int = 1 << 16, bin: int = BIN) -> Op:
    """The reference between sites (chrom, pos, n_ref), in pieces (chrom, ord, begins, seq) that end with a chunk of the genome: `ord`
    sites stand before a piece, which begins at `begins`. Sites don't overlap. `ends` holds each contig's length; a contig without sites is
    one segment."""
    earlier = "rows between unbounded preceding and 1 preceding"
    return Op(
        "segments",
        "sites ends genome",
        f"""with span as (select chrom, pos, pos + max(n_ref) as e, cast(floor(pos / {bin}) as bigint) as bin from {{sites}} group by chrom, pos),
        carry as (
          select chrom, bin, coalesce(sum(m) over (partition by chrom order by bin {earlier}), 0) as upto, coalesce(max(e) over (partition by chrom order by bin {earlier}), 0) as came
          from (select chrom, bin, count(*) as m, max(e) as e from span group by chrom, bin) a
        ), cut as (
          select s.chrom, cast(c.upto + s.nth as bigint) as ord, coalesce(s.before, c.came) as s, s.pos as e
          from (select chrom, bin, pos, lag(e) over (partition by chrom, bin order by pos) as before, row_number() over (partition by chrom, bin order by pos) - 1 as nth from span) s join carry c on c.chrom = s.chrom and c.bin = s.bin
          union all
          select n.chrom, coalesce(l.ord, 0) as ord, coalesce(l.s, 0) as s, n.length as e from {{ends}} n left join (select chrom, count(*) as ord, max(e) as s from span group by chrom) l on l.chrom = n.chrom
        ), piece as (select chrom, ord, s, e, @each(cast(floor(s / {size}) as bigint); cast(floor((e - 1) / {size}) as bigint)) as ck from cut where e > s)
        select p.chrom, p.ord, greatest(p.s, p.ck * {size}) as begins, substr(g.seq, cast(greatest(p.s, p.ck * {size}) - p.ck * {size} + 1 as int), cast(least(p.e, (p.ck + 1) * {size}) - greatest(p.s, p.ck * {size}) as int)) as seq
        from piece p join {{genome}} g on g.chrom = p.chrom and g.ck = p.ck""",
    )


def contig_ends(size: int = 1 << 16) -> Op:
    """(chrom, length) of contigs in chunks."""
    return Op("contig_ends", "genome", f"select chrom, max(ck * {size} + length(seq)) as length from {{genome}} group by chrom")


def genome(size: int = 1 << 16) -> Op:
    """(chrom, ck, seq): contigs in chunks of `size` bases."""
    return Op("genome", "contigs", f"select chrom, ck, substr(seq, cast(ck * {size} + 1 as int), {size}) as seq from (select chrom, seq, @each(0; cast(floor((length(seq) - 1) / {size}) as bigint)) as ck from {{contigs}} where length(seq) > 0) a")


def padded_genome(k: int = 31, size: int = 1 << 16) -> Op:
    """K2: the genome with k times a after the end of each contig whose last site stands less than k bases before it."""
    return Op(
        "padded_genome",
        "genome sites",
        f"""with ends as (select chrom, max(ck * {size} + length(seq)) as n from {{genome}} group by chrom),
        short as (select e.chrom, e.n from ends e join (select chrom, max(pos + n_ref) as e from {{sites}} group by chrom) s on s.chrom = e.chrom where e.n - s.e < {k}),
        more as (select chrom, n, @each(cast(floor(n / {size}) as bigint); cast(floor((n + {k} - 1) / {size}) as bigint)) as ck from short),
        tail as (select chrom, ck, @times('a'; least(n + {k}, (ck + 1) * {size}) - greatest(n, ck * {size})) as seq from more)
        select g.chrom, g.ck, concat(g.seq, coalesce(t.seq, '')) as seq from {{genome}} g left join tail t on t.chrom = g.chrom and t.ck = g.ck
        union all select t.chrom, t.ck, t.seq from tail t where not exists (select 1 from {{genome}} g where g.chrom = t.chrom and g.ck = t.ck)""",
    )


regions_hit = Op(
    "regions_hit",
    "spans regions",
    """select distinct v.variant_id from {spans} v join (
         select chrom, s, e, @each(cast(floor(s / 1024) as bigint); cast(floor((e - 1) / 1024) as bigint)) as bin from {regions}
       ) r on r.chrom = v.chrom and r.bin = cast(floor(v.pos / 1024) as bigint) and v.pos >= r.s and v.pos < r.e""",
    "J9: variants that begin inside a region (half-open).",
)


def near_neighbour(reach: int = 31, bin: int = 4096) -> Op:
    """Whether another variant lies within so many bases on either side. A bin also sees what lies within reach of it."""
    return Op(
        "near_neighbour",
        "spans",
        f"""with dealt as (
          select variant_id, chrom, pos, cast(floor(pos / {bin}) as bigint) as home, @each(cast(floor((pos - {reach}) / {bin}) as bigint); cast(floor((pos + {reach}) / {bin}) as bigint)) as bin from {{spans}}
        )
        select variant_id, near_left, near_right from (
          select variant_id, home, bin, coalesce(pos - lag(pos) over (partition by chrom, bin order by pos, variant_id) <= {reach}, false) as near_left,
            coalesce(lead(pos) over (partition by chrom, bin order by pos, variant_id) - pos <= {reach}, false) as near_right from dealt
        ) t where home = bin""",
    )
