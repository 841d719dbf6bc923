"""Count models: how often a node's k-mers occur in individuals that carry it none, once or twice."""

from __future__ import annotations

from ..plans.relation import Op


def hist(most: int = 10) -> Op:
    """Individuals by node, copies carried and count seen; zero copies and zero counts included, counts from `most` on left out."""
    return Op(
        "count_model_hist",
        "genotypes observed",
        f"""select node_id, copies, cnt, count(*) as n from (
          select g.variant_id as node_id, g.g as copies, coalesce(o.n, 0) as cnt from {{genotypes}} g left join {{observed}} o on o.variant_id = g.variant_id and o.individual = g.individual) t
          where cnt < {most} group by node_id, copies, cnt""",
    )


observed = Op("observed", "lineitem", "select l_partkey as variant_id, l_suppkey % 10 as individual, count(*) as n from {lineitem} group by l_partkey, l_suppkey % 10", "Counts by variant and individual.")

haplotype_kmers = Op(
    "haplotype_kmers",
    "taken kmers",
    "select t.hap_id, k.kmer, count(*) as n from {taken} t join {kmers} k on k.site_id = t.site_id and k.path_id = t.path_id group by t.hap_id, k.kmer",
    "K20: a haplotype's k-mers put together from those of the path it agrees with at each site; a contig's first segment is in its first site's stretch.",
)
stretch_counts = Op(
    "stretch_counts",
    "kmers index",
    "select k.path_id, k.site_id, i.node_id, count(*) as n from {kmers} k join {index} i on i.kmer = k.kmer group by k.path_id, k.site_id, i.node_id",
    "K21: how often nodes are met in each path's stretch of each site, which doesn't depend on the haplotypes.",
)
path_counts = Op(
    "path_counts",
    "taken stretches",
    """select s.node_id as variant_id, cast(floor(t.hap_id / 2) as bigint) as individual, cast(sum(s.n) as bigint) as n from {taken} t
       join {stretches} s on s.site_id = t.site_id and s.path_id = t.path_id group by s.node_id, cast(floor(t.hap_id / 2) as bigint)""",
    "K20, K21: counts of nodes in each individual, summed over the stretches its two haplotypes are made of; no k-mer is looked up twice.",
)
whole_counts = Op(
    "whole_counts",
    "kmers index",
    """select i.node_id as variant_id, cast(floor(h.path_id / 2) as bigint) as individual, count(*) as n from {kmers} h join {index} i on i.kmer = h.kmer group by i.node_id, cast(floor(h.path_id / 2) as bigint)""",
    "K21, K22: the same counts from the k-mers of the haplotypes' own sequences.",
)


def node_copies(individuals: int = 10) -> Op:
    """Copies of each node in each individual, none included: nodes times individuals is what a count model is made of."""
    return Op(
        "node_copies",
        "nodes haplotypes",
        f"""with carried as (select variant_id as site_id, allele, cast(floor(hap_id / 2) as bigint) as individual, count(*) as c from {{haplotypes}} where allele > 0 group by variant_id, allele, cast(floor(hap_id / 2) as bigint)),
        other as (select site_id, individual, cast(sum(c) as bigint) as c from carried group by site_id, individual)
        select n.node_id as variant_id, n.individual, cast(case when n.allele > 0 then coalesce(c.c, 0) else 2 - coalesce(o.c, 0) end as bigint) as g
        from (select node_id, site_id, allele, @each(0; {individuals - 1}) as individual from {{nodes}}) n
        left join carried c on c.site_id = n.site_id and c.allele = n.allele and c.individual = n.individual left join other o on o.site_id = n.site_id and o.individual = n.individual""",
    )


expected = Op("expected", "model", "select node_id, copies, round(cast(sum(cnt * n) as double) / sum(n), 6) as e from {model} group by node_id, copies", "A18, A19: the mean count.")


def refine(most: int = 10) -> Op:
    """M2: a number of copies never seen gets one individual at the count interpolated from the others' means (no mean is 0), at
    least 0 and below `most`, halves to even."""
    return Op(
        "count_model_refine",
        "model",
        f"""with m as (select node_id, copies, cast(sum(cnt * n) as double) / sum(n) as e from {{model}} group by node_id, copies),
        w as (select node_id, coalesce(max(case when copies = 0 then e end), 0) as e0, coalesce(max(case when copies = 1 then e end), 0) as e1, coalesce(max(case when copies = 2 then e end), 0) as e2,
          max(case when copies = 0 then 1 else 0 end) as h0, max(case when copies = 1 then 1 else 0 end) as h1, max(case when copies = 2 then 1 else 0 end) as h2 from m group by node_id),
        made as (
          select node_id, 2 as copies, e1 + (e1 - e0) as x from w where h2 = 0 union all select node_id, 1 as copies, e0 + (e2 - e0) / 2 as x from w where h1 = 0
          union all select node_id, 0 as copies, e1 - (e2 - e1) as x from w where h0 = 0)
        select node_id, cast(copies as bigint) as copies, cnt, n from {{model}}
        union all select node_id, cast(copies as bigint) as copies, cast(greatest(0, least(@rint(x), {most - 1})) as bigint) as cnt, cast(1 as bigint) as n from made""",
    )


def with_prior(prior: float = 1.0, most: int = 10) -> Op:
    """M2b, the older filling: every number of copies gets `prior` individuals more, at the count one below the mean of one copy, one above that of none, and
    two above that of none; means of no data are 0, halves go to even."""
    return Op(
        "with_prior",
        "model",
        f"""with m as (select node_id, copies, cast(sum(cnt * n) as double) / sum(n) as e from {{model}} group by node_id, copies),
        w as (select node_id, @rint(coalesce(max(case when copies = 0 then e end), 0)) as e0, @rint(coalesce(max(case when copies = 1 then e end), 0)) as e1 from m group by node_id),
        made as (
          select node_id, 0 as copies, greatest(0, e1 - 1) as x from w union all select node_id, 1 as copies, least({most - 1}, e0 + 1) as x from w
          union all select node_id, 2 as copies, least({most - 1}, e0 + 2) as x from w)
        select node_id, copies, cnt, sum(n) as n from (
          select node_id, cast(copies as bigint) as copies, cnt, cast(n as double) as n from {{model}}
          union all select node_id, cast(copies as bigint) as copies, cast(x as bigint) as cnt, cast({prior!r} as double) as n from made) t group by node_id, copies, cnt""",
    )


naive_model = Op(
    "naive_model",
    "nodes",
    "select node_id, copies, copies as cnt, cast(1 as bigint) as n from (select node_id, @each(0; 2) as copies from {nodes}) t",
    "M16: the model that expects as many counts as copies.",
)


def limited(most: int = 3) -> Op:
    """The model's counts below a limit only."""
    return Op("limited", "model", f"select node_id, copies, cnt, n from {{model}} where cnt < {most}")


def tricky(least: int = 7) -> Op:
    """Nodes with mass at high counts, without data, or with two of the three numbers of copies unseen."""
    return Op(
        "tricky_alleles",
        "model nodes",
        f"""select v.node_id, coalesce(m.high, 0) > 0 as has_duplicates, coalesce(m.n, 0) < 2 as has_no_data, coalesce(m.high, 0) > 0 or coalesce(m.k, 0) <= 1 as tricky
        from (select distinct variant_id as node_id from {{nodes}}) v left join (select node_id, sum(case when cnt >= {least} then n else 0 end) as high, sum(n) as n, count(distinct copies) as k from {{model}} group by node_id) m on m.node_id = v.node_id""",
    )


either_tricky = Op("either_tricky", "a b", "select a.node_id, a.tricky or coalesce(b.tricky, false) as tricky from {a} a left join {b} b on b.node_id = a.node_id", "P16: tricky for either reason.")


def tricky_variants(least: int = 3) -> Op:
    """A11c, A11d: variants an allele of which has no signature, whose alleles share a k-mer, or an allele of which the model has seen in
    fewer individuals than `least` with some number of copies."""
    return Op(
        "tricky_variants",
        "nodes index model",
        f"""with k as (select v.variant_id, v.side, i.kmer from (
            select variant_id, 0 as side, ref_node as node_id from {{nodes}} union all select variant_id, 1 as side, alt_node as node_id from {{nodes}}) v join {{index}} i on i.node_id = v.node_id),
        signed as (select variant_id, count(distinct side) as sides from k group by variant_id),
        shared as (select distinct variant_id from (select variant_id, kmer from k group by variant_id, kmer having count(distinct side) > 1) a),
        seen as (select node_id, count(*) as classes from (select node_id, copies from {{model}} group by node_id, copies having sum(n) >= {least}) a group by node_id)
        select n.variant_id, coalesce(s.sides, 0) < 2 as unsigned, h.variant_id is not null as sharing, coalesce(r.classes, 0) < 3 or coalesce(a.classes, 0) < 3 as unseen
        from {{nodes}} n left join signed s on s.variant_id = n.variant_id left join shared h on h.variant_id = n.variant_id
        left join seen r on r.node_id = n.ref_node left join seen a on a.node_id = n.alt_node""",
    )


perfect = Op(
    "perfect_model",
    "model",
    "select node_id, @all(cnt = copies) as perfect, max(k) <= 1 as one_count from (select node_id, copies, cnt, count(*) over (partition by node_id, copies) as k from {model}) t group by node_id",
    "P18: whether every individual's count equals its copies.",
)
log_frequencies = Op("log_frequencies", "model", "select node_id, copies, cnt, round(ln(cast(n as double) / sum(n) over (partition by node_id, copies)), 6) as lf from {model} where n > 0", "M3, D23.")
merged_models = Op("merged_models", "model other", "select node_id, copies, cnt, cast(sum(n) as bigint) as n from (select node_id, copies, cnt, cast(n as bigint) as n from {model} union all select node_id, copies, cnt, cast(n as bigint) as n from {other}) t group by node_id, copies, cnt", "A20: models of two populations as one.")
