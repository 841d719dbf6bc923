"""The variant graph: a chain of sites between reference segments, paths through it, its k-mers and signatures."""

from __future__ import annotations

from ..plans.relation import Op
from .kmers import windows


def path_matrix(bits: int = 3) -> Op:
    """K4, K5: 2 ** bits paths; a site with two alleles takes a bit of the path's number, one with more the number modulo them."""
    return Op(
        "path_matrix",
        "sites",
        f"""select path_id, site_id, case when n_alleles > 2 then path_id % n_alleles else cast(@bit(path_id; {bits - 1} - site_id % {bits}) as bigint) end as allele
            from (select site_id, n_alleles, @each(0; {2**bits - 1}) as path_id from {{sites}}) t""",
    )


def path_matrix_shifted(bits: int = 3) -> Op:
    """K6: alleles rotate with the site."""
    return Op("path_matrix_shifted", "sites", f"select path_id, site_id, (path_id + site_id % {2**bits}) % n_alleles as allele from (select site_id, n_alleles, @each(0; {2**bits - 1}) as path_id from {{sites}}) t")


def path_matrix_columns(bits: int = 3) -> Op:
    """K6, the first form: a site of n alleles takes n neighbouring columns of the matrix of bits; its allele is the first column's bit
    that is set, the last allele if none is. Columns are counted by bins of sites."""
    return Op(
        "path_matrix_columns",
        "sites",
        f"""with many as (select bin, coalesce(sum(m) over (order by bin rows between unbounded preceding and 1 preceding), 0) as upto from (select cast(floor(site_id / 4096) as bigint) as bin, sum(n_alleles) as m from {{sites}} group by cast(floor(site_id / 4096) as bigint)) a),
        col as (select s.site_id, s.n_alleles, m.upto + s.k as c from (
            select site_id, n_alleles, cast(floor(site_id / 4096) as bigint) as bin, sum(n_alleles) over (partition by cast(floor(site_id / 4096) as bigint) order by site_id) - n_alleles as k from {{sites}}) s join many m on m.bin = s.bin),
        bit as (select site_id, n_alleles, path_id, j, @bit(path_id; {bits - 1} - (c + j) % {bits}) as b from (select site_id, n_alleles, c, path_id, @each(0; n_alleles - 1) as j from (select site_id, n_alleles, c, @each(0; {2**bits - 1}) as path_id from col) x) y)
        select path_id, site_id, cast(coalesce(min(case when b = 1 then j end), max(n_alleles) - 1) as bigint) as allele from bit group by path_id, site_id""",
    )


def haplotype_paths(most: int = 100) -> Op:
    """The first haplotypes as paths, dense: absent rows are the reference. `carriers` lists the haplotypes."""
    return Op(
        "haplotype_paths",
        "haplotypes sites carriers",
        f"""select v.hap_id as path_id, v.site_id, coalesce(h.allele, 0) as allele
        from (select s.site_id, s.hap_id from (select site_id, @each(0; {most - 1}) as hap_id from {{sites}}) s where s.hap_id in (select hap_id from {{carriers}})) v
        left join {{haplotypes}} h on h.variant_id = v.site_id and h.hap_id = v.hap_id""",
    )


permuted_paths = Op(
    "permuted_paths",
    "paths permuted",
    "select path_id, site_id, allele from {paths} union all select path_id + (select max(path_id) + 1 from {paths}) as path_id, site_id, allele from {permuted}",
    "K7: the paths of haplotypes and, numbered after them, those of a matrix of combinations.",
)


def scorer_haplotypes(n: int = 8, seed: int = 1) -> Op:
    """The alleles of n haplotypes of smallest hash, of the reference (path -1) and of a haplotype with allele 1 everywhere
    (path -2), dense."""
    return Op(
        "scorer_haplotypes",
        "haplotypes carriers sites",
        f"""with drawn as (select hap_id from {{carriers}} order by (hap_id + {seed}) * 2654435761 % 4294967296, hap_id limit {n}),
        every as (select site_id, @unnest(ids) as hap_id from (select site_id, (select @list(hap_id) from drawn) as ids from {{sites}}) a)
        select e.hap_id as path_id, e.site_id, coalesce(h.allele, 0) as allele from every e left join {{haplotypes}} h on h.variant_id = e.site_id and h.hap_id = e.hap_id
        union all select -1 as path_id, site_id, 0 as allele from {{sites}} union all select -2 as path_id, site_id, 1 as allele from {{sites}}""",
    )


missing_alleles = Op(
    "missing_alleles",
    "sites paths",
    "select a.site_id, a.allele from (select site_id, @each(0; n_alleles - 1) as allele from {sites}) a where not exists (select 1 from {paths} p where p.site_id = a.site_id and p.allele = a.allele)",
    "K10: alleles that no path takes; must be none after the repair.",
)
supported_alleles = Op(
    "supported_alleles",
    "sites paths",
    "select s.site_id, s.n_alleles, coalesce(p.n, 0) as n_taken, coalesce(p.n, 0) = s.n_alleles as ok from {sites} s left join (select site_id, count(distinct allele) as n from {paths} group by site_id) p on p.site_id = s.site_id",
    "K10: whether paths take every allele of a site.",
)
repair_paths = Op(
    "repair_paths",
    "paths missing",
    """with spare as (
         select site_id, allele, path_id, row_number() over (partition by site_id order by n desc, allele, path_id) as nth from (
           select site_id, allele, path_id, count(*) over (partition by site_id, allele) as n, row_number() over (partition by site_id, allele order by path_id) as k from {paths}) t where k < n
       ), need as (select site_id, allele, row_number() over (partition by site_id order by allele) as nth from {missing}),
       changed as (select s.site_id, s.path_id, m.allele from need m join spare s on s.site_id = m.site_id and s.nth = m.nth)
       select p.path_id, p.site_id, coalesce(c.allele, p.allele) as allele from {paths} p left join changed c on c.site_id = p.site_id and c.path_id = p.path_id""",
    "K8: paths that share the commonest alleles are recoded to alleles that no path takes.",
)
append_paths = Op(
    "append_paths",
    "paths missing",
    """with extra as (select site_id, allele, row_number() over (partition by site_id order by allele) as nth from {missing}),
       every as (select site_id, (select max(path_id) from {paths}) as last, (select coalesce(max(nth), 0) from extra) as n from (select distinct site_id from {paths}) s)
       select path_id, site_id, allele from {paths}
       union all select v.last + v.nth as path_id, v.site_id, coalesce(e.allele, m.most, 0) as allele
       from (select site_id, last, @each(1; n) as nth from every where n > 0) v left join (select site_id, max(allele) as most from extra group by site_id) m on m.site_id = v.site_id
       left join extra e on e.site_id = v.site_id and e.nth = v.nth""",
    """K9: further paths that take what is still missing. A site that misses fewer alleles than others repeats its last one there, one
    that misses none takes the reference.""",
)


def site_codes(source: str, key: str, window: int, bin: int) -> str:
    """SQL of (key, site_id, code): the alleles of {source} at a site and the window - 1 next ones, three digits each. Windows are
    made in bins of sites that also see the next ones of the following bin."""
    return f"""select {key}, site_id, @framed_code(lpad(cast(allele as string), 3, '0'); partition by {key}, bin order by ix rows between current row and {window - 1} following) as code, ix, home, bin
        from (select h.{key}, h.site_id, h.allele, o.ix, cast(floor(o.ix / {bin}) as bigint) as home, @each(cast(floor(greatest(o.ix - {window - 1}, 0) / {bin}) as bigint); cast(floor(o.ix / {bin}) as bigint)) as bin
              from {source} h join ordinal o on o.site_id = h.site_id) t"""


def haplotype_to_path(window: int = 5, bin: int = 4096) -> Op:
    """For each haplotype and site the path that agrees longest from there on (window sites at most), the largest of equals.

    The alleles of a window are one text; beginnings of the haplotypes' texts, each once a site, meet those of the paths' texts by
    equality, so no haplotype is paired with all paths, and no window runs along a genome."""
    return Op(
        "haplotype_to_path",
        "haplotypes paths",
        f"""with listed as (select distinct site_id, cast(floor(site_id / {bin}) as bigint) as part from {{paths}}),
        many as (select part, coalesce(sum(m) over (order by part rows between unbounded preceding and 1 preceding), 0) as upto from (select part, count(*) as m from listed group by part) a),
        ordinal as (select l.site_id, m.upto + row_number() over (partition by l.part order by l.site_id) - 1 as ix from listed l join many m on m.part = l.part),
        own as (select path_id as hap_id, site_id, code from ({site_codes("{haplotypes}", "path_id", window, bin)}) a where home = bin),
        line as (select path_id, site_id, code from ({site_codes("{paths}", "path_id", window, bin)}) a where home = bin),
        ahead as (select site_id, w, substr(code, 1, cast(3 * w as int)) as head, max(path_id) as path_id from (select path_id, site_id, code, @each(1; cast(length(code) / 3 as int)) as w from line) a group by site_id, w, substr(code, 1, cast(3 * w as int))),
        wanted as (select site_id, code, w, substr(code, 1, cast(3 * w as int)) as head from (select site_id, code, @each(1; cast(length(code) / 3 as int)) as w from (select distinct site_id, code from own) a) b),
        found as (
          select site_id, code, path_id, w from (
            select q.site_id, q.code, q.w, l.path_id, row_number() over (partition by q.site_id, q.code order by q.w desc) as nth from wanted q join ahead l on l.site_id = q.site_id and l.w = q.w and l.head = q.head) a where nth = 1
        )
        select o.hap_id, o.site_id, f.path_id, cast(f.w as int) as len from own o join found f on f.site_id = o.site_id and f.code = o.code""",
    )


def haplotype_pieces(size: int = 1 << 16) -> Op:
    """The parts of paths in order (chrom, ck, begins, kind): alleles (kind 0) and the pieces of reference between them (kind 1), each
    with the site whose stretch it is in, which is the first one's before it. ck: the chunk of the genome a part begins in."""
    return Op(
        "haplotype_pieces",
        "alleles chosen segments",
        f"""with first as (select chrom, min(site_id) as f from {{alleles}} group by chrom),
        taken as (select c.path_id, a.chrom, a.site_id, c.allele, a.pos as begins, 0 as kind, a.seq from {{chosen}} c join {{alleles}} a on a.site_id = c.site_id and a.allele = c.allele)
        select path_id, chrom, site_id, allele, begins, kind, cast(floor(begins / {size}) as bigint) as ck, seq from taken
        union all
        select p.path_id, g.chrom, f.f + greatest(g.ord, 1) - 1 as site_id, -1 as allele, g.begins, 1 as kind, cast(floor(g.begins / {size}) as bigint) as ck, g.seq
        from (select distinct path_id, chrom from taken) p join {{segments}} g on g.chrom = p.chrom join first f on f.chrom = p.chrom""",
    )


haplotype_sequence = Op(
    "haplotype_sequence",
    "pieces",
    "select path_id, chrom, ck, @joined(seq; begins * 2 + kind) as seq from {pieces} group by path_id, chrom, ck",
    "K1, F20: segments and chosen alleles in turn, a row for each chunk of the genome; in the order of ck they are the haplotype.",
)


def with_context(k: int = 11) -> Op:
    """Each part with the k - 1 bases before and after it on its path. Within a chunk from the parts around it, beyond it from
    the chunks around. Every allele keeps its anchor base, so that k - 1 parts hold as many bases."""
    n = k - 1
    near, far = "partition by path_id, chrom, ck order by begins, kind", "partition by path_id, chrom order by ck"
    after, before = f"rows between 1 following and {n} following", f"rows between {n} preceding and 1 preceding"
    return Op(
        "with_context",
        "pieces sequences",
        f"""with around as (
          select path_id, chrom, ck, @framed(substr(seq, 1, {n}); {far} {after}) as next, @framed(right(seq, {n}); {far} {before}) as last from {{sequences}}
        )
        select p.path_id, p.chrom, p.ck, p.site_id, p.allele, p.begins, p.kind, p.seq, right(concat(a.last, p.l), {n}) as before, substr(concat(p.r, a.next), 1, {n}) as after
        from (select *, @framed(substr(seq, 1, {n}); {near} {after}) as r, @framed(right(seq, {n}); {near} {before}) as l from {{pieces}} where seq <> '') p
        join around a on a.path_id = p.path_id and a.chrom = p.chrom and a.ck = p.ck""",
    )


def site_kmers(k: int = 11) -> Op:
    """Every k-mer of every path, with the site in whose stretch (its allele, or the reference after it) it begins."""
    return Op("site_kmers", "context", f"""select path_id, site_id, kmer from ({windows(k, "(select path_id, site_id, concat(seq, after) as seq, length(seq) as n from {context}) y", "path_id, site_id, n")}) z where pos < n""")


def path_chunks(per: int = 100, k: int = 11) -> Op:
    """Paths in chunks of `per` sites, with the k - 1 bases before and after."""
    return Op(
        "path_chunks",
        "context",
        f"""select path_id, chrom, cast(floor(site_id / {per}) as bigint) as chunk, concat(@joined(case when nth = 1 then before else '' end; begins * 2 + kind), @joined(seq; begins * 2 + kind), @joined(case when back = 1 then after else '' end; begins * 2 + kind)) as seq
        from (select *, row_number() over (partition by path_id, chrom, floor(site_id / {per}) order by begins, kind) as nth, row_number() over (partition by path_id, chrom, floor(site_id / {per}) order by begins desc, kind desc) as back from {{context}}) t
        group by path_id, chrom, cast(floor(site_id / {per}) as bigint)""",
    )


def flanked(k: int = 11, overlap: int = 2, only_inside: bool = True) -> Op:
    """Each allele on each path with the bases that its windows need: k - overlap before it, k - 1 after; with only_inside, an
    allele longer than k stands alone."""
    long = f"length(seq) > {k}" if only_inside else "false"
    return Op("flanked", "context", f"select site_id, allele, path_id, case when {long} then seq else concat(right(before, {k - overlap}), seq, after) end as seq from {{context}} where kind = 0")


def flanked_fixed(k: int = 11) -> Op:
    """Windows of one number for all alleles, k - 1 - k // 2: as many bases before an allele's start, k - 1 from there on."""
    return Op("flanked_fixed", "context", f"select site_id, allele, path_id, concat(right(before, {k - 1 - k // 2}), substr(concat(seq, after), 1, {k - 1})) as seq from {{context}} where kind = 0")


def window_kmers(k: int = 11, spacing: int = 0) -> Op:
    """The windows of flanked alleles, with spacing over 1 only every so manieth, numbered anew."""
    every = windows(k, "{flanked}", "site_id, allele, path_id", "window_ix")
    if spacing > 1:
        every = f"select site_id, allele, path_id, cast(floor(window_ix / {spacing}) as bigint) as window_ix, kmer from ({every}) w where window_ix % {spacing} = 0"
    return Op("window_kmers", "flanked", every)


def signature_select(modulo: int = 20011) -> Op:
    """Per allele the window whose k-mers are rarest, summed over paths; the last window gets 0.1 more, the
    first of equals wins; its distinct k-mers are the signature."""
    return Op(
        "signature_select",
        "windows counter",
        f"""with scored as (select w.site_id, w.allele, w.window_ix, w.kmer, -coalesce(c.n, 0) as s from {{windows}} w left join {{counter}} c on c.bucket = w.kmer % {modulo}),
        total as (select site_id, allele, window_ix, cast(sum(s) as double) as s, max(window_ix) over (partition by site_id, allele) as last from scored group by site_id, allele, window_ix),
        best as (select site_id, allele, window_ix from (
          select *, row_number() over (partition by site_id, allele order by s + case when window_ix = last then 0.1 else 0 end desc, window_ix) as nth from total) t where nth = 1)
        select distinct w.site_id, w.allele, w.kmer from scored w join best b on b.site_id = w.site_id and b.allele = w.allele and b.window_ix = w.window_ix""",
    )


def signature_sv(modulo: int = 20011, least: int = 50, positions: int = 100) -> Op:
    """Sites with more than `least` windows on some allele's path whose chosen k-mers are shared by alleles choose anew: windows at
    every max(1, n // positions)-th place, the score less three times the largest count of one of its k-mers among all k-mers of
    the site; the first best window's distinct k-mers. All other sites keep what was chosen."""
    return Op(
        "signature_sv",
        "windows counter chosen",
        f"""with large as (select site_id from {{windows}} group by site_id having max(window_ix) + 1 > {least}),
        again as (select c.site_id from {{chosen}} c join large l on l.site_id = c.site_id group by c.site_id having count(*) > count(distinct c.kmer)),
        own as (select w.site_id, w.allele, w.path_id, w.window_ix, w.kmer from {{windows}} w join again a on a.site_id = w.site_id),
        local as (select site_id, kmer % 1000001 as b, count(*) as n from own group by site_id, kmer % 1000001),
        scored as (select w.site_id, w.allele, w.window_ix, w.kmer, -coalesce(c.n, 0) as s, l.n as here from own w join local l on l.site_id = w.site_id and l.b = w.kmer % 1000001
          left join {{counter}} c on c.bucket = w.kmer % {modulo}),
        total as (select site_id, allele, window_ix, cast(sum(s) as double) - 3 * max(here) as s, max(window_ix) over (partition by site_id, allele) as last from scored group by site_id, allele, window_ix),
        best as (select site_id, allele, window_ix from (
          select *, row_number() over (partition by site_id, allele order by s + case when window_ix = last then 0.1 else 0 end desc, window_ix) as nth from total
          where window_ix % greatest(1, cast(floor((last + 1) / {positions}) as bigint)) = 0) t where nth = 1)
        select distinct w.site_id, w.allele, w.kmer from own w join best b on b.site_id = w.site_id and b.allele = w.allele and b.window_ix = w.window_ix
        union all select c.site_id, c.allele, c.kmer from {{chosen}} c where not exists (select 1 from again a where a.site_id = c.site_id)""",
    )


def legacy_pairs(modulo: int = 20011, penalty: int = 1000) -> Op:
    """K16, the second finder: of a biallelic site's windows the one whose distinct reference and alternative k-mers are rarest in sum,
    `penalty` worse where the alleles share one; the first of equals."""
    return Op(
        "legacy_pairs",
        "windows counter",
        f"""with d as (select distinct site_id, window_ix, allele, kmer from {{windows}} where allele < 2),
        clash as (select site_id, window_ix, max(m) as m from (select site_id, window_ix, kmer, count(*) as m from d group by site_id, window_ix, kmer) a group by site_id, window_ix),
        total as (select d.site_id, d.window_ix, cast(sum(-coalesce(c.n, 0)) as bigint) as s from d left join {{counter}} c on c.bucket = d.kmer % {modulo} group by d.site_id, d.window_ix),
        best as (select site_id, window_ix from (
          select t.site_id, t.window_ix, row_number() over (partition by t.site_id order by t.s - case when x.m > 1 then {penalty} else 0 end desc, t.window_ix) as nth from total t join clash x on x.site_id = t.site_id and x.window_ix = t.window_ix) a where nth = 1)
        select d.site_id, d.allele, d.kmer from d join best b on b.site_id = d.site_id and b.window_ix = d.window_ix""",
    )


def legacy_sums(modulo: int = 20011) -> Op:
    """K16, the third finder: the window whose k-mers on all paths are rarest in sum; a site whose alleles share one of them has none."""
    return Op(
        "legacy_sums",
        "windows counter",
        f"""with total as (select w.site_id, w.window_ix, cast(sum(-coalesce(c.n, 0)) as bigint) as s from {{windows}} w left join {{counter}} c on c.bucket = w.kmer % {modulo} where w.allele < 2 group by w.site_id, w.window_ix),
        best as (select site_id, window_ix from (select *, row_number() over (partition by site_id order by s desc, window_ix) as nth from total) a where nth = 1),
        d as (select distinct w.site_id, w.allele, w.kmer from {{windows}} w join best b on b.site_id = w.site_id and b.window_ix = w.window_ix where w.allele < 2),
        clash as (select distinct site_id from (select site_id, kmer from d group by site_id, kmer having count(*) > 1) a)
        select site_id, allele, kmer from d where not exists (select 1 from clash c where c.site_id = d.site_id)""",
    )


def signature_frequent(modulo: int = 20011, most: int = 254) -> Op:
    """Signature k-mers that aren't saturated in the counter."""
    return Op("signature_frequent", "signatures counter", f"select s.site_id, s.allele, s.kmer from {{signatures}} s left join {{counter}} c on c.bucket = s.kmer % {modulo} where coalesce(c.n, 0) <= {most}")


first_per_window = Op(
    "first_per_window", "windows", "select site_id, allele, path_id, window_ix, kmer from (select *, row_number() over (partition by site_id, allele, window_ix, kmer order by path_id) as nth from {windows}) t where nth = 1",
    "A14: a k-mer that several paths have in one window stays with the first.",
)
signature_arrays = Op("signature_arrays", "signatures", "select site_id, allele, @numbers(@list(kmer)) as kmers, count(*) as n from {signatures} group by site_id, allele", "O4, D17: each allele's k-mers as one row, as numbers in order.")
signature_overlap = Op(
    "signature_overlap", "signatures",
    """select round(cast(sum(case when b.kmer is not null then 1 else 0 end) as double) / count(*), 6) as overlap from (select kmer from {signatures} where allele = 0) a
       left join (select distinct kmer from {signatures} where allele = 1) b on b.kmer = a.kmer""",
    "A15: the share of reference k-mers that some alternative has too.",
)


#: Nodes of a site are numbered from NODES * site on, the reference first; sites with more alleles are filtered before.
NODES = 256


def kmer_index(k: int = 11) -> Op:
    """K-mers of both strands with the node of their allele."""
    back = " + ".join(f"(3 - cast(floor(kmer / {4**j}) as bigint) % 4) * {4 ** (k - 1 - j)}" for j in range(k))
    return Op("kmer_index", "signatures", f"select kmer, {NODES} * site_id + allele as node_id from {{signatures}} union select {back} as kmer, {NODES} * site_id + allele as node_id from {{signatures}}")


graph_nodes = Op("graph_nodes", "alleles", f"select {NODES} * site_id + allele as node_id, site_id, allele, variant_id from {{alleles}}", "D6, J3: a node for each allele of each site.")
variant_nodes = Op(
    "variant_nodes", "alleles", f"select variant_id, site_id, {NODES} * site_id as ref_node, {NODES} * site_id + allele as alt_node from {{alleles}} where allele > 0", "J3: the two nodes of each biallelic variant."
)
unsupported_alleles = Op(
    "unsupported_alleles",
    "nodes index",
    "select n.node_id, i.node_id is null as tricky from {nodes} n left join (select distinct node_id from {index}) i on i.node_id = n.node_id",
    "A11a: alleles without signature k-mers.",
)
clashing_kmers = Op(
    "clashing_kmers", "index", "select kmer, count(distinct node_id) as n_nodes from {index} group by kmer having count(distinct node_id) > 1", "A11c: k-mers of more than one node."
)
node_kmers = Op("node_kmers", "index", "select node_id, count(distinct kmer) as n_kmers, min(kmer) as least from {index} group by node_id", "A12: the k-mers of each node.")
kmer_report = Op(
    "kmer_report",
    "nodes index counts",
    f"""select v.variant_id, v.n_kmers, v.most, v.most <= 1 as good, v.most <= 1 and v.n_kmers = 2 as supergood from (
         select n.variant_id, count(i.kmer) as n_kmers, cast(coalesce(max(c.n), 0) as bigint) as most from (
           select variant_id, @unnest(@array(ref_node, alt_node)) as node_id from {{nodes}}) n
         left join {{index}} i on i.node_id = n.node_id left join {{counts}} c on c.kmer = i.kmer group by n.variant_id) v""",
    "A12: how often the k-mers of a variant occur, and whether each occurs once at most.",
)
nonunique_kmers = Op(
    "nonunique_kmers",
    "nodes index counts",
    """with k as (select v.variant_id, v.side, i.kmer, coalesce(c.n, 0) - 1 as more from (
         select variant_id, 0 as side, ref_node as node_id from {nodes} union all select variant_id, 1 as side, alt_node as node_id from {nodes}) v
         join {index} i on i.node_id = v.node_id left join {counts} c on c.kmer = i.kmer),
       side as (select variant_id, side, @all(more > 0) as every from k group by variant_id, side),
       shared as (select distinct variant_id from (select variant_id, kmer from k group by variant_id, kmer having count(distinct side) > 1) a)
       select n.variant_id, count(s.side) < 2 or coalesce(@any(s.every), false) or max(case when x.variant_id is null then 0 else 1 end) = 1 as tricky
       from {nodes} n left join side s on s.variant_id = n.variant_id left join shared x on x.variant_id = n.variant_id group by n.variant_id""",
    "A11c: variants one of whose alleles has only k-mers that occur elsewhere too, or none, or whose alleles share one.",
)
region_chunks = Op(
    "region_chunks", "spans", "select chrom, cast(floor(pos / 100000) as bigint) as chunk, count(*) as n, min(pos) as first, max(pos + len_ref) as last from {spans} group by chrom, cast(floor(pos / 100000) as bigint)",
    "X1: the regions that an external imputer would be run on.",
)
