"""Genotype likelihoods from node counts, helper variants and calls.

Log-probabilities are natural logarithms. The internal genotype g is the number of alternative copies; strings are made
at the sink. A sum of logarithms' exponentials takes out the largest first.
"""

from __future__ import annotations

from ..plans.relation import Op

ERROR = 0.01


def naive_loglik(coverage: float = 2.0) -> Op:
    """M4, M5, O1, 9: Poisson log-likelihoods of both nodes' counts under g = 0, 1, 2 copies of the alternative, and the
    first largest; the rate of c copies is (c + ERROR) * coverage / 2 * 0.85."""
    lam = coverage / 2 * 0.85

    def term(n: str, copies: int) -> str:
        return f"({n} * ln({(copies + ERROR) * lam!r}) - {(copies + ERROR) * lam!r} - @lnfact({n}))"

    cols = ", ".join(f"round({term('r.n', 2 - g)} + {term('a.n', g)}, 6) as l{g}" for g in range(3))
    return Op(
        "naive_loglik",
        "node_counts",
        f"""select variant_id, l0, l1, l2, case when l0 >= l1 and l0 >= l2 then 0 when l1 >= l2 then 1 else 2 end as g from (
          select r.node_id / 2 as v, cast(floor(r.node_id / 2) as bigint) as variant_id, {cols}
          from {{node_counts}} r join {{node_counts}} a on a.node_id = r.node_id + 1 where r.node_id % 2 = 0) t""",
    )




paired_counts = Op(
    "paired_counts",
    "nodes node_counts",
    "select 2 * v.variant_id as node_id, c.n from {nodes} v join {node_counts} c on c.node_id = v.ref_node union all select 2 * v.variant_id + 1 as node_id, c.n from {nodes} v join {node_counts} c on c.node_id = v.alt_node",
    "J3: counts of a biallelic variant's nodes, the reference's at 2 * variant, the alternative's after it.",
)


def mixture_loglik(coverage: float = 2.0) -> Op:
    """The log-likelihood of a node's count under each number of copies: Poisson with the rate of (expected count + ERROR) *
    coverage / 2 * 0.85, expected counts mixed as the population had them."""
    lam = coverage / 2 * 0.85
    return Op(
        "mixture_loglik",
        "count_model node_counts",
        f"""with weight as (select node_id, copies, cnt, n / sum(n) over (partition by node_id, copies) as w from (select node_id, copies, cnt, cast(n as double) as n from {{count_model}} where n > 0) x),
        term as (
          select m.node_id, m.copies, ln(m.w) + o.n * ln((m.cnt + {ERROR}) * {lam!r}) - (m.cnt + {ERROR}) * {lam!r} - @lnfact(o.n) as t
          from weight m join {{node_counts}} o on o.node_id = m.node_id
        ), top as (select node_id, copies, t, max(t) over (partition by node_id, copies) as m from term)
        select node_id, copies, round(max(m) + ln(sum(exp(t - m))), 6) as loglik from top group by node_id, copies""",
    )


genotype_loglik = Op(
    "genotype_loglik",
    "nodes nodelik tricky",
    """with l as (select l.node_id, l.copies, case when coalesce(t.tricky, false) then ln(1e0 / 3) else l.loglik end as x from {nodelik} l left join {tricky} t on t.node_id = l.node_id)
       select v.variant_id, round(max(case when r.copies = 2 and a.copies = 0 then r.x + a.x end), 6) as l0, round(max(case when r.copies = 1 and a.copies = 1 then r.x + a.x end), 6) as l1,
         round(max(case when r.copies = 0 and a.copies = 2 then r.x + a.x end), 6) as l2
       from {nodes} v join l r on r.node_id = v.ref_node join l a on a.node_id = v.alt_node and a.copies = 2 - r.copies group by v.variant_id""",
    "M5, M12: both alleles' counts under each genotype; an allele that is tricky is as likely under all.",
)


def coverage_downscale(coverage: float = 15.0, base: float = 3.0) -> Op:
    """counts at a coverage scaled to a lower one, halves to even."""
    return Op("coverage_downscale", "node_counts", f"select node_id, cast(@rint(n / {coverage / base!r}) as bigint) as n from {{node_counts}}")


argmax_genotype = Op("argmax_genotype", "calls", "select variant_id, case when l0 >= l1 and l0 >= l2 then 0 when l1 >= l2 then 1 else 2 end as g from {calls}", "O1: the first largest.")
#: Rows without a number among their likelihoods have even odds.
_NORMAL = """select variant_id, chrom, pos, lost, l0 - z as l0, l1 - z as l1, l2 - z as l2 from (
      select *, m + ln(exp(l0 - m) + exp(l1 - m) + exp(l2 - m)) as z from (select variant_id, chrom, pos, lost, l0, l1, l2, greatest(l0, l1, l2) as m from (
        select variant_id, chrom, pos, lost, case when lost then ln(1e0 / 3) else l0 end as l0, case when lost then ln(1e0 / 3) else l1 end as l1, case when lost then ln(1e0 / 3) else l2 end as l2 from (
          select variant_id, chrom, pos, l0, l1, l2, l0 is null or l1 is null or l2 is null or isnan(l0) or isnan(l1) or isnan(l2) as lost from {calls}) q) p) a) b"""


def min_quality(least: float = 0.6) -> Op:
    """Calls under the quality are 0/0."""
    return Op(
        "min_quality",
        "calls",
        f"""select variant_id, case when exp(greatest(l0, l1, l2)) < {least!r} then 0 when l0 >= l1 and l0 >= l2 then 0 when l1 >= l2 then 1 else 2 end as g from ({_NORMAL}) c""",
    )


gl_gq = Op(
    "gl_gq",
    "calls",
    f"""select variant_id, round(g0, 6) as g0, round(g1, 6) as g1, round(g2, 6) as g2,
         cast(-case when two < 0 then ceil(two) else floor(two) end as bigint) as gq
       from (select *, round(ln(exp(least(g0, g1, g2)) + exp(g0 + g1 + g2 - least(g0, g1, g2) - greatest(g0, g1, g2))), 6) as two from (
         select variant_id, case when lost then -1e-1 else least(l0 / ln(10), 0) end as g0, case when lost then -1e-1 else least(l1 / ln(10), 0) end as g1, case when lost then -1e-1 else least(l2 / ln(10), 0) end as g2 from ({_NORMAL}) c) d) e""",
    "M14, F14, O2: log10 likelihoods at most 0, -0.1 each where one isn't a number, and the truncated natural log-sum of the two smallest, its sign turned.",
)
uniform_genotyper = Op("uniform_genotyper", "snps", "select variant_id, round(ln(1e0 / 3), 6) as l0, round(ln(1e0 / 3), 6) as l1, round(ln(1e0 / 3), 6) as l2, 0 as g from {snps}", "M10.")
prior_only = Op(
    "prior_only",
    "calls freq",
    """select variant_id, round(p0 - z, 6) as l0, round(p1 - z, 6) as l1, round(p2 - z, 6) as l2 from (
         select variant_id, p0, p1, p2, greatest(p0, p1, p2) + ln(exp(p0 - greatest(p0, p1, p2)) + exp(p1 - greatest(p0, p1, p2)) + exp(p2 - greatest(p0, p1, p2))) as z from (
           select c.variant_id, l0 + ln(f_hr + 1e-3) as p0, l1 + ln(f_het + 1e-3) as p1, l2 + ln(f_ha + 1e-3) as p2 from {calls} c join {freq} f on f.variant_id = c.variant_id) a) b""",
    "M9: likelihoods times genotype frequencies, normalised.",
)
multiallelic_resolve = Op(
    "multiallelic_resolve",
    "calls",
    f"""select variant_id, case when n = 1 or nth = 1 then g else 0 end as g from (
         select variant_id, g, count(*) over (partition by chrom, pos) as n, row_number() over (partition by chrom, pos order by greatest(l1, l2) desc, variant_id, g) as nth from (
           select variant_id, chrom, pos, round(l1, 9) as l1, round(l2, 9) as l2, case when l0 >= l1 and l0 >= l2 then 0 when l1 >= l2 then 1 else 2 end as g from ({_NORMAL}) c) d) e""",
    "M13: of a place's rows, the one with the likeliest alternative genotype keeps its call, the others become 0/0.",
)
site_gt = Op(
    "site_gt",
    "calls",
    """select pos as site, case when hom is not null then concat(cast(hom as string), '/', cast(hom as string)) when het is not null then concat('0/', cast(het as string)) else '0/0' end as gt from (
         select chrom, pos, min(case when g = 2 then ix end) as hom, min(case when g = 1 then ix end) as het from (
           select chrom, pos, row_number() over (partition by chrom, pos order by variant_id, l0, l1, l2) as ix, case when l0 >= l1 and l0 >= l2 then 0 when l1 >= l2 then 1 else 2 end as g from {calls}) a group by chrom, pos) b""",
    "F8: a site's genotype string from its rows: the first with both copies, else the first with one.",
)
sv_uniform = Op(
    "sv_uniform",
    "calls typed",
    """select c.variant_id, t.is_sv_b as tricky, round(case when t.is_sv_b then ln(1e0 / 3) else l0 end, 6) as l0, round(case when t.is_sv_b then ln(1e0 / 3) else l1 end, 6) as l1, round(case when t.is_sv_b then ln(1e0 / 3) else l2 end, 6) as l2
       from {calls} c join {typed} t on t.variant_id = c.variant_id""",
    "P13, M12: structural variants get even odds.",
)
ignore_hom_ref = Op("ignore_hom_ref", "called", "select * from {called} where g <> 0", "P12.")
combo_matrix = Op(
    "combo_matrix",
    "genotypes helpers",
    """select p.variant_id, h.g as gh, m.g as gm, count(*) as n from {helpers} p
       join {genotypes} m on m.variant_id = p.variant_id join {genotypes} h on h.variant_id = p.helper_id and h.individual = m.individual group by p.variant_id, h.g, m.g""",
    "A8: how often each pair of genotypes of a variant and its helper occurs.",
)


def best_helper(window: int = 100, weight: float = 0.0, bin: int = 4096) -> Op:
    """The variant 4 to window - 1 rows away whose genotypes agree best; later rows and, among them, farther ones win ties, of
    earlier ones the nearer. A variant without candidates has helper null.

    Rows are numbered in the variants' order, by bins of ids. Each variant's genotypes are three bit sets of individuals, so that a
    pair is compared by counting bits in words of 62 individuals; pairs meet in bins of `window` rows, so no pair farther apart is made.
    With a weight (M7), that many times the helper's own weight is added to the score: `weights` then holds (variant_id, w)."""
    best = f"select variant_id, @argmax(helper_id; (n0 + 1) * (n1 + 1) * (n2 + 1) * {4 * window} + case when hx > ix then {window} + hx - ix else {window} - (ix - hx) end) as helper_id from same group by variant_id"
    if weight:
        best = f"""select variant_id, helper_id from (
            select s.variant_id, s.helper_id, row_number() over (partition by s.variant_id order by round(ln((n0 + 1) * (n1 + 1) * (n2 + 1)) + {weight} * v.w, 9) desc, case when hx > ix then 0 else 1 end, hx desc) as nth
            from same s join {{weights}} v on v.variant_id = s.helper_id) t where nth = 1"""
    return Op(
        "best_helper",
        "genotypes" + (" weights" if weight else ""),
        f"""with listed as (select distinct variant_id, cast(floor(variant_id / {bin}) as bigint) as part from {{genotypes}}),
        many as (select part, coalesce(sum(m) over (order by part rows between unbounded preceding and 1 preceding), 0) as upto from (select part, count(*) as m from listed group by part) a),
        numbered as (select l.variant_id, cast(m.upto + row_number() over (partition by l.part order by l.variant_id) - 1 as bigint) as ix from listed l join many m on m.part = l.part),
        word as (
          select variant_id, cast(floor(individual / 62) as bigint) as w, cast(sum(case when g = 0 then @power(individual) else 0 end) as bigint) as b0, cast(sum(case when g = 1 then @power(individual) else 0 end) as bigint) as b1,
            cast(sum(case when g = 2 then @power(individual) else 0 end) as bigint) as b2 from {{genotypes}} group by variant_id, cast(floor(individual / 62) as bigint)
        ), g as (select n.ix, n.variant_id, x.w, x.b0, x.b1, x.b2, cast(floor(n.ix / {window}) as bigint) as bin from word x join numbered n on n.variant_id = x.variant_id),
        near as (select ix, variant_id, w, b0, b1, b2, @each(greatest(bin - 1, 0); bin + 1) as bin from g),
        same as (
          select a.ix, a.variant_id, b.ix as hx, b.variant_id as helper_id, cast(sum(bit_count(a.b0 & b.b0)) as bigint) as n0, cast(sum(bit_count(a.b1 & b.b1)) as bigint) as n1, cast(sum(bit_count(a.b2 & b.b2)) as bigint) as n2
          from near a join g b on b.bin = a.bin and b.w = a.w and abs(a.ix - b.ix) between 4 and {window - 1} group by a.ix, a.variant_id, b.ix, b.variant_id
        ), best as ({best})
        select n.variant_id, b.helper_id from numbered n left join best b on b.variant_id = n.variant_id""",
    )


first_if_none = Op(
    "first_if_none", "helpers", "select variant_id, coalesce(helper_id, (select min(variant_id) from {helpers})) as helper_id from {helpers}", "W7: a variant without candidates is helped by the first of all."
)


def helper_weights(trials: int = 10, error: float = 0.5) -> Op:
    """The log of how surely a variant is called from `trials` counts: over all splits of them between its nodes, the probability of the
    counts under the genotype that they speak for. Counts on the reference are binomial, its share by the means expected on both
    nodes; genotypes have their frequencies."""
    p = f"(2 * e_ref + 2 - g + {error}) / (2 + 2 * e_ref + 2 * e_alt + {2 * error})"
    return Op(
        "helper_weights",
        "expectations",
        f"""with every as (select variant_id, e_ref, e_alt, f_hr, f_het, f_ha, g, @each(0; {trials}) as k from (select variant_id, e_ref, e_alt, f_hr, f_het, f_ha, @each(0; 2) as g from {{expectations}}) a),
        l as (select variant_id, k, g, @lnfact({trials}) - @lnfact(k) - @lnfact({trials} - k) + k * ln({p}) + ({trials} - k) * ln(1 - {p}) + ln(case g when 0 then f_hr when 1 then f_het else f_ha end) as x from every),
        won as (select variant_id, k, x, row_number() over (partition by variant_id, k order by round(x, 9) desc, g) as nth from l)
        select variant_id, round(ln(sum(exp(x))), 6) as w from won where nth = 1 group by variant_id""",
    )


combo_prior = Op(
    "combo_prior",
    "combo",
    """with cell as (select variant_id, gh, gm, cast(n as double) as n from {combo}),
    grid as (select v.variant_id, v.gh, v.gm, coalesce(c.n, 0) as n from (select variant_id, gh, @each(0; 2) as gm from (select variant_id, @each(0; 2) as gh from (select distinct variant_id from cell) a) b) v
      left join cell c on c.variant_id = v.variant_id and c.gh = v.gh and c.gm = v.gm),
    pooled as (select gh, gm, 150 * (sum(n) + 1) / sum(sum(n) + 1) over (partition by gh) as p from grid group by gh, gm),
    mean as (select gh, m / sum(m) over () as m from (select gh, (sum(n) + 1) / count(distinct variant_id) as m from grid group by gh) a),
    helper as (select variant_id, gh, h / sum(h) over (partition by variant_id) as h from (select g.variant_id, g.gh, max(5 * m.m) + sum(g.n) as h from grid g join mean m on m.gh = g.gh group by g.variant_id, g.gh) a)
    select g.variant_id, g.gh, g.gm, round((g.n + p.p) / sum(g.n + p.p) over (partition by g.variant_id, g.gh) * h.h, 6) as p
    from grid g join pooled p on p.gh = g.gh and p.gm = g.gm join helper h on h.variant_id = g.variant_id and h.gh = g.gh""",
    "M6: counts of genotype pairs with pooled and population priors; few rows per variant, pooled over all by partial sums.",
)
helper_posterior = Op(
    "helper_posterior",
    "prior helpers loglik",
    """with cell as (select variant_id, gh, gm, ln((p + 0.000001) / sum(p + 0.000001) over (partition by variant_id)) as lp from {prior}),
    own as (select variant_id, @each(0; 2) as g, l0, l1, l2 from {loglik}),
    l as (select variant_id, g, case g when 0 then l0 when 1 then l1 else l2 end as l from own),
    term as (select c.variant_id, c.gm, c.lp + h.l as t from cell c join {helpers} p on p.variant_id = c.variant_id join l h on h.variant_id = p.helper_id and h.g = c.gh),
    summed as (select variant_id, gm, max(m) + ln(sum(exp(t - m))) as s from (select *, max(t) over (partition by variant_id, gm) as m from term) a group by variant_id, gm),
    joint as (select s.variant_id, s.gm, s.s + l.l as x from summed s join l on l.variant_id = s.variant_id and l.g = s.gm),
    normal as (select variant_id, gm, x - (m + ln(sum(exp(x - m)) over (partition by variant_id))) as x from (select *, max(x) over (partition by variant_id) as m from joint) a)
    select variant_id, round(max(case when gm = 0 then x end), 5) as p0, round(max(case when gm = 1 then x end), 5) as p1, round(max(case when gm = 2 then x end), 5) as p2 from normal group by variant_id""",
    "M8: each genotype's log-posterior, the helper's genotype summed out.",
)
#: Likelihoods on the variants that genotypes are known for.
variant_loglik = Op("variant_loglik", "genotypes", "select variant_id, -(variant_id % 7) / 2e0 as l0, -(variant_id % 5) / 3e0 as l1, -(variant_id % 11) / 4e0 as l2 from (select distinct variant_id from {genotypes}) d")
binomial_helper_weight = Op(
    "binomial_helper_weight",
    "genotypes",
    """select variant_id, individual, g, round(@lnfact(10) - @lnfact(n) - @lnfact(10 - n) + n * ln(p) + (10 - n) * ln(1 - p), 6) as logp from (
         select variant_id, individual, g, (variant_id + individual) % 11 as n, (g + 1e-1) / 2.2e0 as p from {genotypes}) t""",
    "M7, F13: binomial log-probability of a duplicated node's count under a genotype.",
)
