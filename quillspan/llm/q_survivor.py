"""p1: best representative of each duplicate group."""

from quillspan.llm import survivor
from quillspan.session import table


def _run(spark, sf, strict):
    return survivor.survivors(table(spark, sf, "candidates"), table(spark, sf, "engines"), strict=strict)


QUERIES = {
    "p1_found": lambda s, d: _run(s, d, True).select("group_candidate_id", "field", "candidate_id"),
    "p1_values": lambda s, d: _run(s, d, True),
    "p1_majority": lambda s, d: _run(s, d, False),
}

_SQL = r"""
with c as (select *, list_sort(list_distinct(list_transform(line_ids, lambda x: regexp_replace(regexp_replace(
    lower(trim(x)), '[-_. ]+', '_', 'g'), '(^|[^0-9])0+([0-9])', '\1\2', 'g')))) k from candidates),
e as (select lower(trim(engine)) en, min(trust_rank) tr from engines group by 1),
g as (select packet_id, page_no, k, min(candidate_id) gid from c where len(k) = 3 group by 1, 2, 3 having count(*) > 1),
m as (select c.*, gid from c join g using (packet_id, page_no, k)),
v as (
  select gid, 'score' field, candidate_id, engine, run_at, cast(score as varchar) "value" from m where score between 0 and 1
  union all select gid, 'form', candidate_id, engine, run_at, lower(trim(form)) from m
    where lower(trim(form)) in ('5-7-5', '5-7-5 (approximate)', 'free-form 3-line')
  union all select gid, 'validation', candidate_id, engine, run_at, lower(trim(validation)) from m
    where regexp_full_match(lower(trim(validation)), 'exact|approximate \(off by [0-9]+\)|not 5-7-5 \(short modern form\)')),
r as (select *, row_number() over (partition by gid, field
    order by coalesce(tr, 99999), run_at desc nulls last, candidate_id) rn from v left join e on en = lower(trim(engine)))
"""

ORACLE = {
    "p1_found": _SQL + "select gid group_candidate_id, field, candidate_id from r where rn = 1",
    "p1_values": _SQL + 'select gid group_candidate_id, field, candidate_id, "value" from r where rn = 1',
}
