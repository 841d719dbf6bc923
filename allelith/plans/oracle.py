"""SQL for the headline queries, written by hand for a single-node engine and in other ways than the operators' own: bases one
by one instead of packed pieces, whole sequences instead of chunks, pairs instead of bins, reachability instead of scans,
probabilities instead of their logarithms. Only the relations that stand for files (reads, contigs, calls, ...) are shared.
"""

from __future__ import annotations

from ..sources import bridge as B
from .relation import Op, Registry

K = 11


def rel(op: Op) -> str:
    return f"({op.sql()})"


def _read_kmers() -> str:
    ahead = " + ".join(f"lead(d, {j}) over w * {4 ** (K - 1 - j)}" for j in range(1, K))
    return f"""base as (select read_id, unnest(string_split(seq, '')) as c, generate_subscripts(string_split(seq, ''), 1) as i from {rel(B.reads)} r where seq <> ''),
    code as (select read_id, i, cast(strpos('acgt', c) - 1 as bigint) as d from base),
    found as (select d * {4 ** (K - 1)} + {ahead} as kmer from code window w as (partition by read_id order by i))"""


def number(x: str) -> str:
    """The k-mer of a text of K bases."""
    return "cast(" + " + ".join(f"(strpos('acgt', substr({x}, {j + 1}, 1)) - 1) * {4 ** (K - 1 - j)}" for j in range(K)) + " as bigint)"


def letters(x: str) -> str:
    return "concat(" + ", ".join(f"substr('acgt', cast({x} // {4 ** (K - 1 - j)} % 4 + 1 as int), 1)" for j in range(K)) + ")"


def headline(r: Registry) -> dict[str, str]:
    log = lambda n, copies: f"{n} * ln({(copies + 0.01) * 0.85!r}) - {(copies + 0.01) * 0.85!r} - lgamma({n} + 1)"
    pair = ", ".join(f"round({log('r.n', 2 - g)} + {log('a.n', g)}, 6) as l{g}" for g in range(3))
    return {
        "kmer_count": f"with {_read_kmers()} select kmer, count(*) as n from found where kmer is not null group by kmer",
        "approx_kmer_counter": f"with {_read_kmers()} select kmer % 20011 as bucket, least(255, count(*)) as n from found where kmer is not null group by 1",
        "node_counts": f"""with {_read_kmers()}, node as (select site_id * 256 + allele as node_id from {rel(r["site_alleles"])}), hit as (select i.node_id from found f join {rel(r["kmer_index_build"])} i on i.kmer = f.kmer)
            select n.node_id, count(h.node_id) as n from node n left join hit h on h.node_id = n.node_id group by n.node_id""",
        "genotype_loglik_naive": f"""with c as (select node_id, cast(n as double) as n from {rel(r["node_counts"])}), l as (
              select v.variant_id, {pair} from {rel(r["variant_nodes"])} v join c r on r.node_id = v.ref_node join c a on a.node_id = v.alt_node)
            select variant_id, l0, l1, l2, case when l0 >= l1 and l0 >= l2 then 0 when l1 >= l2 then 1 else 2 end as g from l""",
        "window_kmers": f"""with whole as (select path_id, chrom, string_agg(seq, '' order by ck) as seq from {rel(r["haplotype_sequence"])} group by path_id, chrom),
            taken as (select p.path_id, p.site_id, a.allele, a.chrom, a.pos, length(a.seq) as n, length(f.seq) as n_ref from {rel(r["graph_paths"])} p
              join {rel(r["site_alleles"])} a on a.site_id = p.site_id and a.allele = p.allele join {rel(r["site_alleles"])} f on f.site_id = p.site_id and f.allele = 0),
            placed as (select *, pos + coalesce(sum(n - n_ref) over (partition by path_id, chrom order by pos rows between unbounded preceding and 1 preceding), 0) as at from taken),
            cut as (select t.site_id, t.allele, t.path_id, case when t.n > {K} then substr(w.seq, cast(t.at + 1 as int), cast(t.n as int))
                else substr(w.seq, cast(greatest(t.at - {K - 2}, 0) + 1 as int), cast(t.at + t.n + {K - 1} - greatest(t.at - {K - 2}, 0) as int)) end as seq
              from placed t join whole w on w.path_id = t.path_id and w.chrom = t.chrom),
            each as (select site_id, allele, path_id, seq, unnest(generate_series(0, length(seq) - {K})) as window_ix from cut where length(seq) >= {K}),
            part as (select site_id, allele, path_id, window_ix, substr(seq, cast(window_ix + 1 as int), {K}) as x from each)
            select site_id, cast(allele as bigint) as allele, path_id, window_ix, {number("x")} as kmer from part""",
        "signature_select": f"""with c as (select bucket, n from {rel(r["haplotype_scorer"])}), w as (select * from {rel(r["window_kmers"])}),
            s as (select w.site_id, w.allele, w.window_ix, -sum(coalesce(c.n, 0)) as s from w left join c on c.bucket = w.kmer % 20011 group by all),
            ends as (select site_id, allele, max(window_ix) as z from w group by all),
            best as (select s.site_id, s.allele, arg_max(s.window_ix, 1000 * (10 * s.s + case when s.window_ix = e.z then 1 else 0 end) - s.window_ix / 1e6) as window_ix from s join ends e using (site_id, allele) group by all)
            select distinct w.site_id, w.allele, w.kmer from w join best using (site_id, allele, window_ix)""",
        "kmer_index_build": f"""with s as (select site_id * 256 + allele as node_id, {letters("kmer")} as x from {rel(r["signature_frequent"])}), sides as (
              select node_id, x from s union select node_id, reverse(translate(x, 'acgt', 'tgca')) as x from s) select {number("x")} as kmer, node_id from sides""",
        "haplotype_to_path": f"""with h as (select path_id as hap_id, site_id, allele, row_number() over (partition by path_id order by site_id) as ix from {rel(r["haplotype_paths"])}),
            met as (select h.hap_id, h.site_id, h.ix, p.path_id, h.allele <> p.allele as off from h join {rel(r["graph_paths"])} p using (site_id)),
            run as (select a.hap_id, a.site_id, a.path_id, least(5, coalesce(min(b.ix) filter (b.off), max(b.ix) + 1) - a.ix) as len
              from met a join met b on b.hap_id = a.hap_id and b.path_id = a.path_id and b.ix between a.ix and a.ix + 4 group by a.hap_id, a.site_id, a.ix, a.path_id)
            select hap_id, site_id, arg_max(path_id, 1000 * len + path_id) as path_id, cast(max(len) as int) as len from run group by hap_id, site_id having max(len) > 0""",
        "count_model_hist": """with h as (select l_partkey as v, l_suppkey % 20 as hap, max(l_linenumber % 3) as a from lineitem group by all),
            v as (select distinct v from h where a > 0), every as (select v.v, i.i from v, range(10) i(i)),
            g as (select v, hap // 2 as i, count(*) filter (a = 1) as g from h group by all), o as (select l_partkey as v, l_suppkey % 10 as i, count(*) as n from lineitem group by all)
            select e.v as node_id, coalesce(g.g, 0) as copies, coalesce(o.n, 0) as cnt, count(*) as n from every e left join g using (v, i) left join o using (v, i) where coalesce(o.n, 0) < 10 group by all""",
        "best_helper": f"""with g as (select variant_id, individual, g from {rel(B.genotypes)}), o as (select variant_id, row_number() over (order by variant_id) as ix from (select distinct variant_id from g)),
            m as (select o.variant_id, o.ix, list(g.g order by g.individual) as gs from o join g using (variant_id) group by all),
            p as (select a.variant_id, b.variant_id as h, b.ix - a.ix as d, list_zip(a.gs, b.gs) as z from m a join m b on abs(b.ix - a.ix) between 4 and 99),
            s as (select variant_id, h, d, (1 + len(list_filter(z, lambda x: x[1] = 0 and x[2] = 0))) * (1 + len(list_filter(z, lambda x: x[1] = 1 and x[2] = 1))) * (1 + len(list_filter(z, lambda x: x[1] = 2 and x[2] = 2))) as s from p)
            select o.variant_id, b.helper_id from o left join (select variant_id, arg_max(h, s * 1000 + case when d > 0 then 500 + d else d end) as helper_id from s group by variant_id) b using (variant_id)""",
        "genotype_posterior_helper": f"""with c as (select variant_id, gh, gm, (p + 0.000001) / sum(p + 0.000001) over (partition by variant_id) as p from {rel(r["combo_prior"])}),
            v as (select distinct variant_id from c), l as (select variant_id, unnest([0, 1, 2]) as g, exp(unnest([-(variant_id % 7) / 2e0, -(variant_id % 5) / 3e0, -(variant_id % 11) / 4e0])) as l from v),
            x as (select c.variant_id, c.gm, sum(c.p * b.l * a.l) as x from c join {rel(r["best_helper"])} h using (variant_id) join l b on b.variant_id = h.helper_id and b.g = c.gh join l a on a.variant_id = c.variant_id and a.g = c.gm group by all)
            select variant_id, round(ln(sum(x) filter (gm = 0) / sum(x)), 5) as p0, round(ln(sum(x) filter (gm = 1) / sum(x)), 5) as p1, round(ln(sum(x) filter (gm = 2) / sum(x)), 5) as p2 from x group by variant_id""",
        "interval_merge_pad": f"""with recursive v as (select * from {rel(B.variants)}), s as (select variant_id, chrom, pos as a, pos + length(ref) - 1 as z from v where ref <> ''),
            edge as (select x.variant_id as u, y.variant_id as w from s x join s y on x.chrom = y.chrom and x.a <= y.z and y.a <= x.z), reach as (select u, w from edge union select r.u, e.w from reach r join edge e on e.u = r.w),
            island as (select r.u as variant_id, min(s.a) as a, max(s.z) as z from reach r join s on s.variant_id = r.w group by r.u),
            home as (select variant_id, a, z from island union all select i.variant_id, min(t.a) as a, max(t.z) as z from v i join (select distinct s.chrom, n.a, n.z from island n join s using (variant_id)) t
              on i.ref = '' and t.chrom = i.chrom and i.pos > t.a and i.pos <= t.z group by i.variant_id)
            select v.variant_id, v.chrom, coalesce(h.a, v.pos) as pos,
              case when h.a is null then v.ref else substr(c.seq, cast(h.a + 1 as int), cast(h.z - h.a + 1 as int)) end as ref,
              case when h.a is null then v.alt else concat(substr(c.seq, cast(h.a + 1 as int), cast(v.pos - h.a as int)), v.alt, substr(c.seq, cast(v.pos + length(v.ref) + 1 as int), cast(h.z - v.pos - length(v.ref) + 1 as int))) end as alt
            from v join {rel(B.contigs)} c using (chrom) left join home h on h.variant_id = v.variant_id""",
        "covered_by_sv": f"""with v as (select *, pos + (len_ref > 1 or len_alt > 1)::int as s, pos + (len_ref > 1 or len_alt > 1)::int + len_ref - 1 as e, len_ref > 50 or len_alt > 50 as sv from {rel(B.spans)}),
            hit as (select distinct a.variant_id from v a join v b on b.chrom = a.chrom and b.sv and not a.sv and a.s >= b.s and a.s < b.e union select distinct a.variant_id from v a join v b on b.chrom = a.chrom and b.sv and not a.sv and a.e >= b.s and a.e < b.e)
            select variant_id, variant_id in (select variant_id from hit) as covered from v""",
        "overlapping_indels": f"""with v as (select variant_id, chrom, pos, pos + case when len_ref > 1 or len_alt > 1 then len_ref else 0 end as e, len_ref > 1 or len_alt > 1 as indel from {rel(B.spans)} where not has_n),
            base as (select variant_id, chrom, indel, unnest(generate_series(pos, e)) as p from v),
            first as (select chrom, p, min(variant_id) filter (indel) as i, bool_or(not indel) as s from base group by all),
            gone as (select distinct b.variant_id from base b join first f using (chrom, p) where b.indel and (f.s or f.i < b.variant_id))
            select variant_id from v where variant_id not in (select variant_id from gone)""",
        "overlap_depth": f"""with base as (select variant_id, chrom, unnest(generate_series(pos, pos + len_ref - 1)) as p from {rel(B.spans)}), n as (select chrom, p, count(*) as n from base group by all)
            select variant_id, max(n) as most from base join n using (chrom, p) group by variant_id""",
        "genotype_accuracy": f"""with t as (select k, case when gt = '.' then './.' else array_to_string(list_sort(string_split(replace(gt, '|', '/'), '/')), '/') end as t from {rel(B.truth)}),
            s as (select k, array_to_string(list_sort(string_split(replace(string_split(gt, ':')[1], '|', '/'), '/')), '/') as g from {rel(B.sample)}),
            p as (select t, coalesce(g, '0/0') as g, t like '%.%' as lost from t left join s using (k)),
            n as (select count(*) filter (not lost and t = g and g <> '0/0') as tp, count(*) filter (not lost and t = '0/0' and g <> '0/0') as fp, count(*) filter (not lost and t <> '0/0' and g <> t) as fn,
              count(*) filter (t = '0/0') as hr, count(*) filter (t = '0/0' and g = t) as hr1, count(*) filter (not lost and t like '0/%' and t <> '0/0') as het, count(*) filter (not lost and t like '0/%' and t <> '0/0' and g = t) as het1,
              count(*) filter (not lost and t not like '0/%') as ha, count(*) filter (not lost and t not like '0/%' and g = t) as ha1 from p),
            q as (select coalesce(round(tp / nullif(tp + fn, 0), 6), 0) as recall, coalesce(round(tp / nullif(tp + fp, 0), 6), 0) as precision, coalesce(round(hr1 / nullif(hr, 0), 6), 0) as c_hr,
              coalesce(round(het1 / nullif(het, 0), 6), 0) as c_het, coalesce(round(ha1 / nullif(ha, 0), 6), 0) as c_ha from n)
            select recall, precision, coalesce(round(2 * recall * precision / nullif(recall + precision, 0), 6), 0) as f1, c_hr, c_het, c_ha, round((c_hr + c_het + c_ha) / 3, 6) as weighted_concordance from q""",
        "multiallelic_resolve": f"""with p as (select variant_id, chrom, pos, exp(l0) / (exp(l0) + exp(l1) + exp(l2)) as p0, exp(l1) / (exp(l0) + exp(l1) + exp(l2)) as p1, exp(l2) / (exp(l0) + exp(l1) + exp(l2)) as p2 from {rel(B.calls)}),
            c as (select *, row_number() over (order by variant_id, g) as nth from (select *, round(ln(greatest(p1, p2)), 9) as alt, case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end as g from p) q),
            first as (select chrom, pos, count(*) as n, max(alt) as alt from c group by all), best as (select c.chrom, c.pos, min(c.nth) as nth from c join first f on f.chrom = c.chrom and f.pos = c.pos and f.alt = c.alt group by all)
            select c.variant_id, case when f.n = 1 or b.nth = c.nth then c.g else 0 end as g from c join first f using (chrom, pos) join best b using (chrom, pos)""",
    }
