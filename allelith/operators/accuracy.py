"""Calls against a truth set: normalising join, confusion counts, metrics."""

from __future__ import annotations

from ..plans.relation import Op

_G = "case when {0} = '.' then './.' else @text(@sorted(@split(replace(split_part({0}, ':', 1), '|', '/'); /)); /) end"
paired = Op(
    "paired",
    "truth sample",
    f"select t.k, t.type, {_G.replace('{0}', 't.gt')} as t, coalesce({_G.replace('{0}', 's.gt')}, '0/0') as g from {{truth}} t left join {{sample}} s on s.k = t.k",
    "J11: every truth row with its call, 0/0 where there is none.",
)
unknown_calls = Op("unknown_calls", "truth sample", "select s.k from {sample} s where not exists (select 1 from {truth} t where t.k = s.k)", "J10: calls of variants that the truth doesn't have; must be none.")
_COUNTS = """cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, cast(sum(tn) as bigint) as tn,
  cast(sum(hr) as bigint) as n_hr, cast(sum(hr * ok) as bigint) as ok_hr, cast(sum(het) as bigint) as n_het, cast(sum(het * ok) as bigint) as ok_het,
  cast(sum(ha) as bigint) as n_ha, cast(sum(ha * ok) as bigint) as ok_ha, cast(sum(miss) as bigint) as n_missing, cast(sum(miss * g_missing) as bigint) as ok_missing, cast(sum((1 - miss) * (1 - g_missing)) as bigint) as n_called"""
_MARKED = """select type, miss, hr, het, ha, g_missing, case when t = g then 1 else 0 end as ok,
    case when miss = 0 and t = g and g <> '0/0' then 1 else 0 end as tp, case when miss = 0 and t = '0/0' and g <> '0/0' then 1 else 0 end as fp,
    case when miss = 0 and t <> '0/0' and g <> t then 1 else 0 end as fn, case when miss = 0 and t = '0/0' and g = '0/0' then 1 else 0 end as tn
  from (select *, case when t like '%.%' then 1 else 0 end as miss, case when t = '0/0' then 1 else 0 end as hr, case when t like '0/%' and t <> '0/0' and t not like '%.%' then 1 else 0 end as het,
      case when t not like '0/%' and t not like '%.%' then 1 else 0 end as ha, case when g like '%.%' then 1 else 0 end as g_missing from {paired}) a"""
confusion = Op("confusion", "paired", f"select {_COUNTS} from ({_MARKED}) b", "A9: counts in one pass.")
confusion_by_type = Op("confusion_by_type", "paired", f"select type, {_COUNTS} from ({_MARKED}) b group by type", "A10, A12.")
_RATE = lambda a, b: f"case when {b} = 0 then 0.0 else round(cast({a} as double) / ({b}), 6) end"
metrics = Op(
    "metrics",
    "confusion",
    f"""select recall, precision, case when recall + precision = 0 then 0.0 else round(2 * recall * precision / (recall + precision), 6) end as f1, c_hr, c_het, c_ha, round((c_hr + c_het + c_ha) / 3, 6) as weighted_concordance
    from (select {_RATE('tp', 'tp + fn')} as recall, {_RATE('tp', 'tp + fp')} as precision, {_RATE('ok_hr', 'n_hr')} as c_hr, {_RATE('ok_het', 'n_het')} as c_het, {_RATE('ok_ha', 'n_ha')} as c_ha from {{confusion}}) t""",
    "A9: a rate without rows is 0.",
)
rates_by_type = Op(
    "rates_by_type",
    "by_type",
    f"select type, tp, fp, fn, tn, {_RATE('tp', 'tp + fn')} as recall, {_RATE('tp', 'tp + fp')} as precision, {_RATE('ok_het', 'n_het')} as c_het, {_RATE('ok_ha', 'n_ha')} as c_ha from {{by_type}}",
    "A10, A12: recall and precision of each type of variant.",
)
rates_in_regions = Op(
    "rates_in_regions",
    "truth sample inside",
    f"""with t as (select t.type, {_G.replace("{0}", "t.gt")} as t, case when s.gt is not null then {_G.replace("{0}", "s.gt")} end as g from {{truth}} t left join {{sample}} s on s.k = t.k
      where {_G.replace("{0}", "t.gt")} <> '0/0'),
    hit as (select type, count(*) as n_truth, cast(sum(case when g = t then 1 else 0 end) as bigint) as tp, cast(sum(case when coalesce(g, '0/0') = '0/0' then 1 else 0 end) as bigint) as fn from t group by type),
    extra as (
      select s.type, count(*) as fp from {{sample}} s join {{inside}} i on i.k = s.k
      where {_G.replace("{0}", "s.gt")} <> '0/0' and not exists (select 1 from {{truth}} t where t.k = s.k) group by s.type
    )
    select type, n_truth, tp, fn, fp, {_RATE('tp', 'tp + fn')} as recall, {_RATE('tp', 'tp + fp')} as precision
    from (select h.type, h.n_truth, h.tp, h.fn, coalesce(e.fp, 0) as fp from hit h left join extra e on e.type = h.type) a""",
    """A10, S16: by type, of what the truth has (rows of 0/0 aren't), calls that equal it; what has no call or is called 0/0; and, inside
    the regions that the truth speaks for, calls of what the truth doesn't list.""",
)
alt_order = Op(
    "alt_order",
    "multi",
    """select variant_id, cast(ix + 1 as bigint) as old_ix, @place(@sorted(@split(alts; ,)); alt) as new_ix from (select variant_id, alts, @poseach(@split(alts; ,); ix; alt) from {multi}) t""",
    "O3: the place of each alternative in sorted order.",
)
by_sorted_alts = Op(
    "by_sorted_alts",
    "calls reference",
    """with allele as (select row_id, chrom, pos, ref, alts, type, @poseach(@split(replace(split_part(gt, ':', 1), '|', '/'); /); j; a) from {calls}),
    listed as (select row_id, alts from (
      select c.row_id, r.alts, row_number() over (partition by c.row_id order by length(r.alts), r.alts) as nth
      from {calls} c join {reference} r on r.chrom = c.chrom and r.pos = c.pos and r.ref = c.ref and @within(@split(c.alts; ,); @split(r.alts; ,))) x where nth = 1),
    named as (select s.row_id, s.chrom, s.pos, s.ref, s.type, s.j, s.a, @sorted(@split(coalesce(r.alts, s.alts); ,)) as alts, case when try_cast(s.a as int) > 0 then @at(@split(s.alts; ,); try_cast(s.a as int)) end as alt
      from allele s left join listed r on r.row_id = s.row_id),
    placed as (select row_id, chrom, pos, ref, alts, type, case when alt is not null then cast(@place(alts; alt) as string) else a end as a from named)
    select row_id, concat(chrom, '-', cast(pos as string), '-', ref, '-', @text(alts; ,)) as k, min(type) as type, case when count(*) = 1 and min(a) = '.' then './.' else @text(@list(a); /) end as gt
    from placed group by row_id, chrom, pos, ref, alts""",
    """J12, F10: calls keyed by place and alternatives in sorted order, their alleles numbered by that order. Alternatives are those of the
    shortest row of the reference file there that lists all of the call's, so that files agree that list them otherwise, or fewer of
    them; without such a row the call's own.""",
)
split_calls = Op(
    "split_calls",
    "calls",
    """select row_id, cast(ix + 1 as bigint) as alt_ix, concat(chrom, '-', cast(pos as string), '-', ref, '-', alt) as k, type,
         case when l = '.' or r = '.' then './.' when l = own and r = own then '1/1' when l = own or r = own then '0/1' else '0/0' end as gt
       from (select row_id, chrom, pos, ref, type, ix, alt, cast(ix + 1 as string) as own, l, r from (
         select row_id, chrom, pos, ref, type, split_part(replace(split_part(gt, ':', 1), '|', '/'), '/', 1) as l, split_part(replace(split_part(gt, ':', 1), '|', '/'), '/', 2) as r, @poseach(@split(alts; ,); ix; alt) from {calls}) x) y""",
    "Calls of several alternatives as one for each: 1/1, 0/1 or 0/0 by how often it is carried, ./. if an allele is missing.",
)
closest_keys = Op(
    "closest_keys",
    "unknown truth",
    """select u.k, t.k as near from {unknown} u join {truth} t on split_part(t.k, '-', 1) = split_part(u.k, '-', 1) and split_part(t.k, '-', 2) = split_part(u.k, '-', 2)""",
    "J15: truth variants at the place of one that the truth doesn't have.",
)
debug_report = Op(
    "debug_report",
    "nodes node_counts expectations tricky helpers calls",
    """select v.variant_id, v.ref_node, v.alt_node, r.n as n_ref, a.n as n_alt, x.e1 as e_ref, y.e1 as e_alt, coalesce(t.tricky, false) as ref_tricky, coalesce(u.tricky, false) as alt_tricky, h.helper_id, c.g
       from {nodes} v join {node_counts} r on r.node_id = v.ref_node join {node_counts} a on a.node_id = v.alt_node
       left join (select node_id, max(case when copies = 1 then e end) as e1 from {expectations} group by node_id) x on x.node_id = v.ref_node
       left join (select node_id, max(case when copies = 1 then e end) as e1 from {expectations} group by node_id) y on y.node_id = v.alt_node
       left join {tricky} t on t.node_id = v.ref_node left join {tricky} u on u.node_id = v.alt_node
       left join {helpers} h on h.variant_id = v.variant_id left join {calls} c on c.variant_id = v.variant_id""",
    "A12: what a call rests on, a row for each variant.",
)
