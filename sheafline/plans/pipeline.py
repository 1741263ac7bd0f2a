"""Queries of the general pipeline problems (p5, p7) and their SQL."""

from __future__ import annotations

from sheafline.operators import incremental, profile
from sheafline.session import load


def p5_found(spark, sf_dir):
    """Paths to add, update or delete in the next index run."""
    return incremental.changes(load(spark, sf_dir, "files"), load(spark, sf_dir, "run_log"), load(spark, sf_dir, "scan_queue"))


def p7_found(spark, sf_dir):
    """Issues of the recorded ticket profiles and of each load against the one before."""
    return profile.ticket_issues(spark, sf_dir)


def p7_profile(spark, sf_dir):
    """The true profile of every load and column of tickets."""
    p = profile.table_profile(spark, f"{sf_dir}/tickets.parquet", "table_name", profile.TICKET_COLUMNS, profile.TICKET_PATTERNS)[0]
    return p.selectExpr("load as table_name", "column as column_name", "n_rows", "n_filled", "n_distinct", "n_bad")


def p7_chunks(spark, sf_dir):
    """How many column chunks of tickets the footers answer, and how many are read."""
    foot = profile.plan(profile.footers(spark, f"{sf_dir}/tickets.parquet", "table_name", profile.TICKET_COLUMNS), [*profile.TICKET_COUNTED, *profile.TICKET_PATTERNS])
    return profile.chunk_report(foot)


QUERIES = {"p5_found": p5_found, "p7_found": p7_found, "p7_profile": p7_profile, "p7_chunks": p7_chunks}

_HASH = "nullif(regexp_replace(lower(trim(hash)), '^(sha-?256|sha-?1|md5)\\s*[:=]\\s*', ''), '')"
_LONG = """
long as (
  select table_name, 'ticket_id' as c, ticket_id as v, null::double as x from tickets
  union all select table_name, 'closed_date', closed_date, null from tickets
  union all select table_name, 'region', region, null from tickets
  union all select table_name, 'product_code', product_code, null from tickets
  union all select table_name, 'dealer', dealer, null from tickets
  union all select table_name, 'status', status, null from tickets
  union all select table_name, 'hours', hours::varchar, hours from tickets
  union all select table_name, 'amount', amount::varchar, amount from tickets
  union all select table_name, 'units', units::varchar, units::double from tickets
  union all select table_name, 'note', note, null from tickets),
t as (select *, (v is not null and regexp_replace(v, '^\\s+|\\s+$', '', 'g') <> '') as ok from long),
prof as (
  select table_name, c, count(*) as n_rows, count(*) filter (ok) as n_filled, count(distinct v) filter (ok) as n_distinct,
    min(v) filter (ok) as lo, max(v) filter (ok) as hi, min(x) filter (ok) as lox, max(x) filter (ok) as hix, median(x) filter (ok) as med,
    count(*) filter (ok and ((c = 'ticket_id' and not regexp_full_match(v, '[A-Z]{3}-[0-9]{8}'))
      or (c = 'closed_date' and not regexp_full_match(v, '[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])'))
      or (c = 'product_code' and not regexp_full_match(v, '[0-9]{7}')))) as n_bad
  from t group by 1, 2)
"""

ORACLES = {
    "p5_found": f"""
with seen as (
  select path, size, mtime, {_HASH} as h from (
    select *, row_number() over (partition by path order by seen_at desc, size desc, mtime desc, hash desc nulls last) as rn from scan_queue where path is not null) where rn = 1),
ev as (
  select path, size, mtime, {_HASH} as h, indexed_at::double as tm, status = 'ok' as ok, true as is_row from files where path is not null
  union all
  select path, size, mtime, {_HASH}, epoch_us(logged_at) / 1e6, outcome = 'committed', false from run_log where path is not null),
done as (select * from (select *, row_number() over (partition by path order by tm desc, size desc, mtime desc, h desc nulls last) as rn from ev where ok) where rn = 1),
fail as (select * from (select *, row_number() over (partition by path order by tm desc) as rn from ev where is_row and not ok) where rn = 1),
has_row as (select distinct path from ev where is_row),
known as (select path from has_row union select path from done),
named as (
  select s.path, s.size, s.mtime, coalesce(s.h, min(e.h)) as h
  from seen s left join ev e on e.path = s.path and e.size = s.size and abs(e.mtime - s.mtime) < 1e-6 and e.h is not null
  group by s.path, s.size, s.mtime, s.h)
select path, action from (
  select coalesce(n.path, k.path) as path,
    case when n.path is null then 'delete'
         when k.path is null then 'add'
         when f.path is not null and (d.path is null or coalesce(f.tm, 'inf'::double) >= d.tm)
           then case when f.size = n.size and abs(f.mtime - n.mtime) < 1e-6 then null else 'update' end
         when coalesce((d.size = n.size and abs(d.mtime - n.mtime) < 1e-6), false) or coalesce(d.h = n.h, false) then null
         else 'update' end as action
  from named n full outer join known k on k.path = n.path
  left join done d on d.path = k.path left join fail f on f.path = k.path) where action is not null
""",
    "p7_profile": f"with {_LONG} select table_name, c as column_name, n_rows, n_filled, n_distinct, n_bad from prof",
    "p7_found": f"""
with {_LONG},
cat as (select distinct table_name, name as c, role, n_filled, n_distinct, nullif(trim(lo), '') as lo, nullif(trim(hi), '') as hi from catalog_columns),
held as (
  select p.table_name, p.c,
    bool_or(coalesce(k.n_filled = p.n_filled, false)) as a, bool_or(coalesce(k.n_distinct = p.n_distinct, false)) as b,
    bool_or(case when coalesce(k.role, '') not in ('number', 'date') then true when k.role = 'number' then try_cast(k.lo as double) is not distinct from p.lox else k.lo is not distinct from p.lo end) as d,
    bool_or(case when coalesce(k.role, '') not in ('number', 'date') then true when k.role = 'number' then try_cast(k.hi as double) is not distinct from p.hix else k.hi is not distinct from p.hi end) as e
  from prof p left join cat k on k.table_name = p.table_name and k.c = p.c group by 1, 2),
prev as (select name as table_name, lag(name) over (partition by series order by load_no, name) as p from (select distinct name, series, load_no from catalog_tables)),
pair as (select table_name, p from prev where p is not null),
sh as (select table_name, c, v, count(*) * 1.0 / sum(count(*)) over (partition by table_name, c) as q from t where ok and c in ('region', 'status') group by 1, 2, 3),
tv as (
  select table_name, c, sum(abs(dq)) / 2 as d from (
    select table_name, c, v, sum(q) as dq from (
      select s.table_name, s.c, s.v, s.q from sh s join pair on pair.table_name = s.table_name
      union all select pair.table_name, s.c, s.v, -s.q from sh s join pair on pair.p = s.table_name) group by 1, 2, 3) group by 1, 2)
select table_name, c as column_name, 'n_filled' as issue from held where not a
union all select table_name, c, 'n_distinct' from held where not b
union all select table_name, c, 'lo' from held where not d
union all select table_name, c, 'hi' from held where not e
union all select table_name, c, 'pattern' from prof where n_bad > 0
union all select a.table_name, a.c, 'null_rate' from prof a join pair on pair.table_name = a.table_name join prof b on b.table_name = pair.p and b.c = a.c
  where (1 - a.n_filled * 1.0 / a.n_rows) - (1 - b.n_filled * 1.0 / b.n_rows) >= 0.20 - 1e-12
union all select a.table_name, a.c, 'shift' from prof a join pair on pair.table_name = a.table_name join prof b on b.table_name = pair.p and b.c = a.c
  where a.c in ('hours', 'amount') and b.med > 0 and (a.med >= 2 * b.med or a.med <= b.med / 2)
union all select v.table_name, v.c, 'shift' from tv v join pair on pair.table_name = v.table_name
  where d >= 0.30 - 1e-12 and exists (select 1 from sh where sh.table_name = v.table_name and sh.c = v.c) and exists (select 1 from sh where sh.table_name = pair.p and sh.c = v.c)
""",
}
