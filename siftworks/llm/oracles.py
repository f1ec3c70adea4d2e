"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .names import FILLER_DATES, SOURCE_PRIORITY, STAND_INS


def _in(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_PRIORITY = "case source " + " ".join(f"when '{k}' then {v}" for k, v in SOURCE_PRIORITY.items()) + " else 99 end"

P1_FOUND = rf"""
with recursive base as (
  select id, name, source, source_id, from_date, loaded_at,
    regexp_replace(upper(case when source = 'gleif' then source_id else record['lei'] end), '[^A-Z0-9]', '', 'g') as raw
  from organizations),
keyed as (
  select id, 's|' || source || '|' || source_id as k from base where source <> '' and source_id <> ''
  union
  select id, 'l|' || right(raw, 20) from base where length(raw) = 20 or (length(raw) = 23 and raw like 'LEI%')),
heads as (select k, min(id) as head from keyed group by k having count(*) > 1),
edge as (
  select distinct head as a, id as b from keyed join heads using (k) where head <> id),
both_ways as (select a, b from edge union select b, a from edge),
reach as (
  select a as id, a as seen from both_ways
  union
  select r.id, e.b from reach r join both_ways e on e.a = r.seen),
grp as (select id, min(seen) as group_id from reach group by id),
m as (
  select g.group_id, b.*, {_PRIORITY} as trust,
    regexp_replace(regexp_replace(lower(trim(name)), '^[\s\pP\pS]+', ''), '[\s\pP\pS]+$', '') as bare,
    upper(trim(name)) as up
  from grp g join base b using (id)),
ok as (
  select *,
    name is not null and bare not in ({_in(STAND_INS)}) and up <> upper(trim(coalesce(source_id, ''))) and regexp_matches(name, '\pL.*\pL')
      and not (regexp_matches(up, '^([A-Z]{{2,8}}[-:#/ ]{{1,2}})?[A-Z0-9][A-Z0-9-]{{4,}}$') and regexp_matches(regexp_replace(up, '^[A-Z]{{2,8}}[-:#/ ]{{1,2}}', ''), '[0-9]')
        and not regexp_matches(trim(name), '\p{{Ll}}{{2}}')) as name_ok,
    coalesce(regexp_matches(from_date, '^\d{{4}}-\d{{2}}-\d{{2}}$') and try_cast(from_date as date) is not null
      and from_date not in ({_in(FILLER_DATES)}) and substr(from_date, 1, 4) not in ('0000', '9999'), false) as date_ok
  from m),
pick as (
  select group_id,
    first(name order by trust, loaded_at desc nulls last, id) filter (where name_ok) as best_name,
    first(from_date order by trust, loaded_at desc nulls last, id) filter (where date_ok) as best_date
  from ok group by group_id)
select p.group_id,
  coalesce(min(o.id) filter (where o.name_ok and o.name = p.best_name), 0)::bigint as name_row_id,
  coalesce(min(o.id) filter (where o.date_ok and o.from_date = p.best_date), 0)::bigint as from_date_row_id
from pick p join ok o using (group_id) group by p.group_id
"""

P6_FOUND = """
with recursive pair as (
  select least(left_id, right_id) as a, greatest(left_id, right_id) as b from role_matches
  where is_match and left_id <> right_id and left_id in (select id from role_records) and right_id in (select id from role_records)),
link as (select a, b from pair union select b, a from pair),
reach as (
  select a as id, a as seen from link
  union
  select r.id, l.b from reach r join link l on l.a = r.seen),
canon as (select id, min(seen) as canon_id from reach group by id)
select id, canon_id, count(*) over (partition by canon_id) as canon_size from canon
"""

P9_FOUND = r"""
select doc_id from documents
where length(regexp_replace(text, '[\pL\pN_]+|[^\pL\pN_\s\x1c-\x1f\x85\pZ]', chr(1), 'g'))
    - length(regexp_replace(regexp_replace(text, '[\pL\pN_]+|[^\pL\pN_\s\x1c-\x1f\x85\pZ]', chr(1), 'g'), chr(1), '', 'g'))
  > (select max_tokens from token_limits where task = 'split')
"""

ORACLES = {"p1_found": P1_FOUND, "p6_found": P6_FOUND, "p9_found": P9_FOUND}
