"""What operators of this subpackage return, as SQL over the tables."""

LINE_RUNS = """
with every as (
  select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) - 1 as p
  from documents where text is not null
), line as (
  select doc_id, p, x, row_number() over (partition by doc_id order by p) - 1 as i,
    least(length(trim(x)) - length(replace(trim(x), ' ', '')) + 1, 50) as w
  from every where trim(x) <> ''
), summed as (
  select *, sum(w) over (partition by doc_id order by i) as upto, sum(w) over (partition by doc_id order by i) - w as before from line
), ends as (
  select doc_id, i, before, upto,
    max(i) over ahead as e, max(upto) over ahead as e_upto, min(i) over back as b, min(before) over back as b_before
  from summed
  window ahead as (partition by doc_id order by before range between current row and 49 following),
    back as (partition by doc_id order by upto range between 49 preceding and current row)
), run as (
  select doc_id, i as s, e from ends where e_upto - before >= 50
  union select doc_id, b as s, i as e from ends where upto - b_before >= 50
), whole as (
  select doc_id, array_agg(x order by i) as xs from line group by doc_id
), named as (
  select run.doc_id, s, e, array_to_string(list_slice(xs, s + 1, e + 1), chr(10)) as name from run join whole using (doc_id)
), copy as (
  select doc_id, s, e from (select *, row_number() over (partition by name order by doc_id, s) as nth from named) where nth > 1
), gone as (
  select distinct doc_id, unnest(generate_series(s, e)) as i from copy
), island as (
  select g.doc_id, l.p, g.i - row_number() over (partition by g.doc_id order by g.i) as k from gone g join line l on l.doc_id = g.doc_id and l.i = g.i
), span as (
  select doc_id, min(p) as a, max(p) as b, count(*) as n from island group by doc_id, k
), left_over as (
  select e.doc_id, string_agg(x, chr(10) order by p) as text from every e
  where not exists (select 1 from span s where s.doc_id = e.doc_id and e.p between s.a and s.b) group by e.doc_id
)
select d.doc_id, coalesce(l.n, 0)::int as n_lines, coalesce(s.k, 0)::int as n_runs, coalesce(s.n, 0)::bigint as n_deleted,
  case when d.text is null then null else coalesce(o.text, '') end as text
from documents d
left join (select doc_id, count(*) as n from line group by doc_id) l using (doc_id)
left join (select doc_id, count(*) as k, sum(n) as n from span group by doc_id) s using (doc_id)
left join left_over o using (doc_id)
"""

JACCARD_COMPONENTS = r"""
with recursive word as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingle as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(w) >= 5 then list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from word) t
), size as (
  select doc_id, count(*) as n from shingle group by doc_id
), shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as o from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
), link as (
  select x, y from shared join size p on p.doc_id = x join size q on q.doc_id = y where 100 * o >= 80 * (p.n + q.n - o)
), edge as (
  select x, y from link union all select y as x, x as y from link
), reach as (
  select doc_id as a, doc_id as b from documents union select r.a, e.y as b from reach r join edge e on e.x = r.b
)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, c.component_id
from documents d left join size s on s.doc_id = d.doc_id join (select a, min(b) as component_id from reach group by a) c on c.a = d.doc_id
"""
