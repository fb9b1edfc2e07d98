"""SQL twins of the queries that SQL can express."""
from __future__ import annotations

from .groups import MISSING

_MISSING = ", ".join(f"'{m}'" for m in MISSING)
_COMPANY = f"""n as (select posting_id, batch, lower(regexp_replace(company_id, '[ \\t\\n\\x0B\\f\\r ]+', '', 'g')) as t from train where posting_id is not null),
c as (select posting_id, batch, case when t in ({_MISSING}) then null
when regexp_full_match(t, '(?:[a-z_.:/#-]*[:#/_-])?([0-9][0-9,]*)(?:\\.0*)?') then nullif(try_cast(replace(regexp_extract(t, '^(?:[a-z_.:/#-]*[:#/_-])?([0-9][0-9,]*)(?:\\.0*)?$', 1), ',', '') as bigint), 0)
when regexp_full_match(t, '[0-9]+(?:\\.[0-9]+)?e[+]?[0-9]{{1,2}}') then cast(round(cast(t as double)) as bigint) end as company from n)"""

P2_FOUND = f"""with recursive {_COMPANY},
e as (select distinct a.company as x, b.company as y from c a join c b using (posting_id) where a.company is not null and b.company is not null),
r as (select x, y from e union select r.x, e.y from r join e on r.y = e.x), g as (select x as company, min(y) as head from r group by 1),
p as (select distinct posting_id, head from c join g using (company)), k as (select head from p group by 1 having count(*) > 1)
select posting_id, head as group_company from p join k using (head)"""

_STRATUM = """case when contains(lower(stratum), 'salary') and contains(lower(stratum), 'deadline') then 'salary+deadline' when contains(lower(stratum), 'salary') then 'salary'
when contains(lower(stratum), 'deadline') then 'deadline' when trim(lower(stratum)) = 'plain' then 'plain' end"""
_P3 = f"""with p as (select source, posting_id, min({_STRATUM}) as stratum from raw_postings where posting_id is not null and source is not null group by 1, 2),
d as (select source, count(*) as n from p group by 1), a as (select source, stratum, count(*) as n from p where stratum is not null group by 1, 2),
t as (select source, sample_share, min_rows, unnest([struct_pack(stratum := 'salary', share := strata.salary), struct_pack(stratum := 'deadline', share := strata.deadline),
struct_pack(stratum := 'salary+deadline', share := strata.salary_deadline), struct_pack(stratum := 'plain', share := strata.plain)]) as s from corpus_facts),
r as (select t.source, t.s.stratum as stratum, coalesce(a.n, 0) as available, greatest(min_rows, t.s.share * sample_share * coalesce(d.n, 0)) as needed
from t left join d on d.source = t.source left join a on a.source = t.source and a.stratum = t.s.stratum)"""
P3_FOUND = _P3 + " select source, stratum from r where available < needed"
P3_REPORT = _P3 + """ select source, stratum, available, cast(least(ceil(needed - 1e-9), available) as bigint) as n_sample, round(needed, 6) as needed, available < needed as unmet from r"""

_RUNS = """{0}w as (select posting_id, source_text, regexp_extract_all(lower(source_text), '[a-z0-9]+') as w from {1} where source_text is not null and posting_id is not null),
{0}k as (select posting_id, source_text, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as runs from {0}w where len(w) >= 5),
{0}t as (select row_number() over () as id, source_text, any_value(runs) as runs from {0}k group by source_text), {0}r as (select id, unnest(runs) as run from {0}t)"""
P4_FOUND = f"""with {_RUNS.format('tr_', 'train')}, {_RUNS.format('ho_', 'heldout')},
m as (select tr_r.id as x, ho_r.id as y, count(*) as n from tr_r join ho_r using (run) group by all),
l as (select tr_t.source_text as s, ho_t.source_text as t from m join tr_t on tr_t.id = x join ho_t on ho_t.id = y where n / (len(tr_t.runs) + len(ho_t.runs) - n) >= 0.6)
select distinct least(a.posting_id, b.posting_id) as posting_id_a, greatest(a.posting_id, b.posting_id) as posting_id_b
from l join tr_k a on a.source_text = l.s join ho_k b on b.source_text = l.t"""

P6_SAMPLE = "select distinct posting_id from train where posting_id is not null and cast(('0x' || substr(md5(posting_id), 1, 13)) as bigint) / pow(16, 13) < 0.1"

P6_DELIVERIES = """select posting_id, max(case when is_gold then 2.0 else 1.0 end)::double as weight from train where posting_id is not null group by posting_id
having cast(('0x' || substr(md5(posting_id), 1, 13)) as bigint) / pow(16, 13) < max(case when is_gold then 2.0 else 1.0 end)::double * 0.1"""

_PAIRS = P4_FOUND[: P4_FOUND.index("select distinct least(")]
P4_REPORT = f"""{_PAIRS.replace('select tr_t.source_text as s, ho_t.source_text as t from', 'select tr_t.source_text as s, ho_t.source_text as t, n / (len(tr_t.runs) + len(ho_t.runs) - n) as sim from')}, 
f as (select b.posting_id, count(distinct a.posting_id) as n_pairs, max(sim) as best from l join tr_k a on a.source_text = l.s join ho_k b on b.source_text = l.t group by 1),
h as (select distinct posting_id, split, source from heldout where posting_id is not null)
select split, source, count(*) as n_records, count(n_pairs) as n_leaked, cast(coalesce(sum(n_pairs), 0) as bigint) as n_pairs, cast(count(*) filter (best >= 1.0) as bigint) as n_same
from h left join f using (posting_id) group by split, source"""

ORACLES = {"p2_found": P2_FOUND, "p3_found": P3_FOUND, "p3_report": P3_REPORT, "p4_found": P4_FOUND, "p4_report": P4_REPORT, "p6_sample": P6_SAMPLE, "p6_deliveries": P6_DELIVERIES}
