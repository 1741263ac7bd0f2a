"""Quality and insight queries with their SQL.

Where the tables hold no defect of a kind, a fixed expression plants it alike in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.operators import insight, quality
from sheafline.operators.quality import Rule
from sheafline.session import load

PLANTED_OUTLIER = "CASE WHEN l_orderkey % 5000 = 7 THEN l_extendedprice * 1e6 ELSE l_extendedprice END"
PLANTED_SENTINEL = "CASE WHEN l_linenumber % 2 = 0 THEN 0e0 ELSE l_quantity END"
PLANTED_BAD = "CASE WHEN (o_orderpriority = '1-URGENT' AND o_orderkey % 4 = 0) OR o_orderkey % 60 = 0 THEN 'Rejected' ELSE 'Approved' END"

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query("select 'null' as \"check\", c as \"column\", case when p < 1 then 'low' when p < 25 then 'medium' else 'high' end as severity, m as n, round(p, 4) as share, null::varchar as detail from (select c, m, 100.0 * m / t as p from (select unnest(['ticket_id','closed_date','region','dealer','status','hours','amount','units','note']) as c, unnest([count(*) - count(ticket_id), count(*) - count(closed_date), count(*) - count(region), count(*) - count(dealer), count(*) - count(status), count(*) - count(hours), count(*) - count(amount), count(*) - count(units), count(*) - count(note)]) as m, count(*) as t from tickets)) where m > 0")
def dq_nulls(spark, sf):
    return quality.nulls(load(spark, sf, "tickets"), ["ticket_id", "closed_date", "region", "dealer", "status", "hours", "amount", "units", "note"])


@query("select 'constant' as \"check\", 'c' as \"column\", 'low' as severity, count(*) as n, 100.0::double as share, 'x' as detail from orders having count(*) >= 10")
def dq_constant(spark, sf):
    return quality.constant(load(spark, sf, "orders").select(F.lit("x").alias("c")), "c")


@query(f"with v as (select {PLANTED_OUTLIER} as v from lineitem), r as (select v, row_number() over (order by v) as k, count(*) over () as n, max(v) over () as hi from v), a as (select v as p, n, hi from r where k = greatest(1, floor(n * 0.99))) select 'outlier' as \"check\", 'v' as \"column\", case when hi / p > 10000 then 'high' else 'medium' end as severity, k as n, round(100.0 * k / nn, 4) as share, round(p, 4)::varchar as detail from (select hi, p, n as nn, (select count(*) from v where v > 100 * p) as k from a) where nn >= 20 and p > 0 and hi > 100 * p")
def dq_outlier(spark, sf):
    return quality.outlier(load(spark, sf, "lineitem").selectExpr(f"{PLANTED_OUTLIER} as v"), "v")


@query("select 'negative' as \"check\", 'c_acctbal' as \"column\", 'medium' as severity, k as n, round(100.0 * k / n, 4) as share, round(lo, 4)::varchar as detail from (select count(c_acctbal) as n, count(*) filter (c_acctbal < 0) as k, min(c_acctbal) as lo from customer) where k > 0")
def dq_negative(spark, sf):
    return quality.negative(load(spark, sf, "customer"), "c_acctbal")


@query(f"with v as (select {PLANTED_SENTINEL} as v from lineitem), g as (select v, count(*) as c from v group by 1), t as (select sum(c) as n, count(*) as d from g), top as (select * from g order by c desc, v limit 1) select 'sentinel' as \"check\", 'v' as \"column\", 'medium' as severity, c as n, round(100.0 * c / n, 4) as share, v::varchar as detail from top, t where v in (0, -1, 9, 99, 999, 9999, 99999, 999999) and 100.0 * c / n > 20 and d > 2")
def dq_sentinel(spark, sf):
    return quality.sentinel(load(spark, sf, "lineitem").selectExpr(f"{PLANTED_SENTINEL} as v"), "v")


@query("select 'future_date' as \"check\", 'o_orderdate' as \"column\", 'high' as severity, k as n, round(100.0 * k / n, 4) as share, strftime(hi, '%Y-%m-%d') as detail from (select count(o_orderdate) as n, count(*) filter (o_orderdate >= date '2001-01-02') as k, max(o_orderdate) as hi from orders) where k > 0")
def dq_future_date(spark, sf):
    return quality.future_date(load(spark, sf, "orders"), "o_orderdate", "2001-01-01")


@query("select 'date_spread' as \"check\", 'o_orderdate' as \"column\", 'medium' as severity, n, m::double as share, src as detail from (select o_orderstatus as src, count(o_orderdate) as n, (year(max(o_orderdate)) - year(min(o_orderdate))) * 12 + month(max(o_orderdate)) - month(min(o_orderdate)) as m from orders group by 1) where m > 6")
def dq_date_spread(spark, sf):
    return quality.date_spread(load(spark, sf, "orders"), "o_orderdate", "o_orderstatus")


_KEY = "array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(replace(lower({0}), '&', ' and '), '[^a-z0-9]+'), lambda x: x not in ('', 'pvt', 'private', 'ltd', 'limited', 'llp', 'inc', 'co', 'company', 'and', 'the', 'of', 'services', 'service')))), ' ')"


@query(f"with g as (select dealer as label, count(*) as c from tickets where dealer is not null and trim(dealer) <> '' group by 1), d as (select count(*) as d from g), t as (select * from g order by c desc, label limit 200), k as (select label, c, {_KEY.format('label')} as key from t, d where d between 2 and 400) select label, same_as, c as n from (select label, c, key, first_value(label) over (partition by key order by c desc, label) as same_as from k where key <> '') where label <> same_as")
def dq_near_duplicate(spark, sf):
    return quality.near_labels(load(spark, sf, "tickets"), "dealer")


@query("select 'duplicate_id' as \"check\", 'text' as \"column\", 'high' as severity, k as n, round(100.0 * k / d, 4) as share, d::varchar as detail from (select sum(c) as n, count(*) as d, count(*) filter (c > 1) as k from (select text, count(*) as c from documents where text is not null group by 1)) where d >= 0.9 * n and k > 0")
def dq_duplicate_id(spark, sf):
    return quality.duplicate_values(load(spark, sf, "documents"), "text")


_SCAN = "(select try_strptime(trim(closed_date), '%Y-%m-%d') as day, * exclude (_row, table_name) from tickets)"
_SCANNED = ("ticket_id", "region", "product_code", "dealer", "status", "hours", "amount", "units", "note", "day")
_DAY = "strftime({0}, '%Y-%m-%d')"


def _scan_sql() -> str:
    null_ = [f"select '{c}' as c, count(*) - count({c}) as m, count(*) as t from t" for c in _SCANNED]
    out = [f"select 'null' as \"check\", c as \"column\", case when 100.0 * m / t < 1 then 'low' when 100.0 * m / t < 25 then 'medium' else 'high' end as severity, m as n, round(100.0 * m / t, 4) as share, null::varchar as detail from ({' union all '.join(null_)}) where m > 0"]
    for c in _SCANNED:
        out.append(f"select 'constant', '{c}', 'low', count({c}), 100.0, min({c})::varchar from t having count(*) >= 10 and count({c}) > 0 and min({c}) = max({c})")
    for c in ("hours", "amount", "units"):
        out.append(f"select 'outlier', '{c}', case when hi / p > 10000 then 'high' else 'medium' end, k, round(100.0 * k / n, 4), round(p, 4)::varchar from (select p, hi, n, (select count(*) from t where {c} > 100 * p) as k from (select v as p, n, hi from (select {c}::double as v, row_number() over (order by {c}) as r, count(*) over () as n, (max({c}) over ())::double as hi from t where {c} is not null) where r = greatest(1, floor(n * 0.99)))) where n >= 20 and p > 0 and hi > 100 * p")
        out.append(f"select 'negative', '{c}', 'medium', k, round(100.0 * k / n, 4), round(lo, 4)::varchar from (select count({c}) as n, count(*) filter ({c} < 0) as k, min({c}) as lo from t) where k > 0")
        out.append(f"select 'sentinel', '{c}', 'medium', c, round(100.0 * c / n, 4), v::varchar from (select v, c, sum(c) over () as n, count(*) over () as d, row_number() over (order by c desc, v) as r from (select {c}::double as v, count(*) as c from t where {c} is not null group by 1)) where r = 1 and v in (0, -1, 9, 99, 999, 9999, 99999, 999999) and 100.0 * c / n > 20 and d > 2")
    out.append(f"select 'future_date', 'day', 'high', k, round(100.0 * k / n, 4), {_DAY.format('hi')} from (select count(day) as n, count(*) filter (day >= date '2026-01-01') as k, max(day) as hi from t) where k > 0")
    out.append("select 'date_spread', 'day', 'medium', n, m::double, src from (select _source_file as src, count(day) as n, (year(max(day)) - year(min(day))) * 12 + month(max(day)) - month(min(day)) as m from t group by 1) where m > 6")
    out.append(f"select 'near_duplicate', 'dealer', 'medium', k, round(100.0 * k / d, 4), d::varchar from (select count(*) filter (label <> same_as and key <> '') as k, count(*) as d from (select label, key, first_value(label) over (partition by key order by c desc, label) as same_as from (select label, c, {_KEY.format('label')} as key from (select dealer as label, count(*) as c from t where dealer is not null and trim(dealer) <> '' group by 1)))) where k > 0")
    out.append("select 'duplicate_id', 'ticket_id', 'high', k, round(100.0 * k / d, 4), d::varchar from (select sum(c) as n, count(*) as d, count(*) filter (c > 1) as k from (select ticket_id, count(*) as c from t where ticket_id is not null group by 1)) where d >= 0.9 * n and k > 0")
    rank = "case severity when 'high' then 0 when 'medium' then 1 else 2 end"
    return f"with t as {_SCAN} select * from ({' union all '.join(out)}) order by {rank}, \"column\", \"check\" limit 100000"


@query(_scan_sql())
def dq_scan(spark, sf):
    """All nine checks over tickets; no finding is left out."""
    t = load(spark, sf, "tickets").select("_source_file", F.to_date(F.try_to_timestamp(F.trim("closed_date"), F.lit("yyyy-MM-dd"))).alias("day"), *[c for c in _SCANNED if c != "day"])
    return quality.scan(t, ["hours", "amount", "units"], ["day"], list(_SCANNED), "2025-12-31", 100_000, ["dealer"], ["ticket_id"], "_source_file")


RULES = [Rule("trim", "seg"), Rule("blank_to_null", "seg"), Rule("map_value", "seg", "BUILDING", "HOUSING"), Rule("null_sentinel", "bal", 0.0), Rule("null_outlier", "bal", 9000.0)]
_RAW = "select c_custkey, case when c_custkey % 7 = 0 then '  ' else concat('  ', c_mktsegment, ' ') end as seg, case when c_custkey % 5 = 0 then 0e0 else c_acctbal end as bal from customer"
_CLEANED = f"select c_custkey, case when s = 'BUILDING' then 'HOUSING' else s end as seg, case when b > 9000 then null else b end as bal from (select c_custkey, nullif(trim(regexp_replace(seg, ' +', ' ', 'g')), '') as s, nullif(bal, 0) as b from ({_RAW}))"


def _raw(spark, sf):
    load(spark, sf, "customer").createOrReplaceTempView("customer")
    return spark.sql(_RAW)


@query(_CLEANED)
def clean_apply(spark, sf):
    return quality.clean(_raw(spark, sf), RULES)


@query(f"with r as (select * from ({_RAW})), c as (select * from ({_CLEANED})) select 'seg' as \"column\", count(*) filter (r.seg is distinct from c.seg) as changed, count(distinct r.seg) as distinct_before, count(distinct c.seg) as distinct_after from r join c using (c_custkey) union all select 'bal', count(*) filter (r.bal is distinct from c.bal), count(distinct r.bal), count(distinct c.bal) from r join c using (c_custkey)")
def clean_impact(spark, sf):
    return quality.clean_impact(_raw(spark, sf), RULES)


@query("with m as (select strftime(o_orderdate, '%Y-%m') as month, count(*)::double as records, round(sum(o_totalprice), 2) as total from orders group by 1), k as (select *, row_number() over (order by month desc) as k from m), p as (select a.month, unnest(['records', 'total']) as measure, unnest([a.records, a.total]) as value, unnest([b.records, b.total]) as before from k a, k b where a.k = 2 and b.k = 3) select measure, month, round(value, 2) as value, round(before, 2) as before, round(100 * (value - before) / abs(before), 2) as pct from p")
def trend_monthly(spark, sf):
    return insight.trend(load(spark, sf, "orders"), "o_orderdate", {"total": "sum(o_totalprice)"})


@query("with g as (select strftime(o_orderdate, '%Y-%m') as month, o_orderpriority as segment, count(*)::double as v from orders group by 1, 2), k as (select month, row_number() over (order by month desc) as k from (select distinct month from g)), s as (select segment, coalesce(sum(v) filter (k = 2), 0) as now, coalesce(sum(v) filter (k = 3), 0) as before from g join k using (month) where k in (2, 3) group by 1) select segment, round(now, 2) as now, round(before, 2) as before, round(100 * (now - before) / before, 2) as pct, case when abs(100 * (now - before) / before) >= 40 then 'medium' else 'low' end as severity from s where not (now < 30 and before < 30) and before <> 0 and abs(100 * (now - before) / before) >= 20")
def movement(spark, sf):
    return insight.movement(load(spark, sf, "orders"), "o_orderdate", "o_orderpriority")


@query(f"with s as (select o_orderpriority as segment, count(*) as n, count(*) filter ({PLANTED_BAD} = 'Rejected') as k from orders group by 1 having count(*) >= 30), t as (select *, sum(k) over () * 1.0 / sum(n) over () as p, k * 1.0 / n as rate from s), top as (select * from t order by rate desc, segment limit 1), z as (select *, (k - n * p) / sqrt(n * p * (1 - p)) as z, k - n * p as excess from top) select segment, n, k, round(100 * rate, 4) as rate, round(100 * p, 4) as overall, round(z, 4) as z, case when rate > 4 * p then 'high' else 'medium' end as severity from z where rate >= 2 * p and z >= 3 and excess >= 5")
def outlier_rate(spark, sf):
    return insight.outlier_rate(load(spark, sf, "orders"), "o_orderpriority", F.expr(PLANTED_BAD) == "Rejected")


@query("select count(*) as records, round(sum(o_totalprice), 2) as measure, strftime(min(o_orderdate), '%Y-%m-%d') as first_day, strftime(max(o_orderdate), '%Y-%m-%d') as last_day from orders")
def perf_headline(spark, sf):
    return insight.headline(load(spark, sf, "orders"), "sum(o_totalprice)", "o_orderdate")


@query("with s as (select o_orderpriority as segment, count(*) as records, sum(o_totalprice) as m from orders group by 1 having count(*) >= 30) select row_number() over (order by m desc, segment) as place, segment, records, round(m, 2) as measure, round(100 * m / sum(m) over (), 4) as share from s order by 1 limit 8")
def perf_ranking(spark, sf):
    return insight.ranking(load(spark, sf, "orders"), "o_orderpriority", "sum(o_totalprice)")


@query("with s as (select o_orderpriority as segment, sum(o_totalprice) as m from orders group by 1 having count(*) >= 30), r as (select *, row_number() over (order by m desc, segment) as r from s), k as (select count(*) as segments, sum(m) as t, sum(m) filter (r <= 5) as m from r) select segments, round(m, 2) as top_measure, round(100 * m / t, 4) as share, case when 100 * m / t >= 75 then 'medium' else 'low' end as severity from k where segments >= 5 and 100 * m / t >= 50")
def perf_concentration(spark, sf):
    return insight.concentration(load(spark, sf, "orders"), "o_orderpriority", "sum(o_totalprice)")


@query("with m as (select strftime(o_orderdate, '%Y-%m') as month, sum(o_totalprice) as v from orders group by 1), k as (select month, v, lead(v) over (order by month desc) as before, row_number() over (order by month desc) as k from m) select month, round(v, 2) as value, round(before, 2) as before, round(100 * (v - before) / abs(before), 2) as pct, case when v < before then 'wrong' else 'right' end as way, case when v < before and abs(100 * (v - before) / abs(before)) > 15 then 'medium' else 'low' end as severity from k where k = 2 and before is not null and before <> 0")
def perf_momentum(spark, sf):
    return insight.momentum(load(spark, sf, "orders"), "o_orderdate", "sum(o_totalprice)")


@query("with s as (select n_name as segment, count(*) as records, sum(c_acctbal) / count(*) as rate from customer join nation on c_nationkey = n_nationkey group by 1 having count(*) >= 30), r as (select *, row_number() over (order by rate desc, segment) as r, count(*) over () as n, sum(abs(rate)) over () as rates from s), b as (select r.*, (select rate from r x where x.r = ceil(x.n / 4.0)) as benchmark from r where n >= 4), l as (select *, (benchmark - rate) * records as gain from b where benchmark > rate and 100 * (benchmark - rate) / abs(benchmark) >= 8), p as (select *, 100 * sum(gain) over () / rates as lift from l) select segment, records, round(rate, 4) as rate, round(benchmark, 4) as benchmark, round(100 * (benchmark - rate) / abs(benchmark), 4) as behind_pct, round(gain, 2) as gain, round(lift, 2) as lift, case when lift >= 15 then 'high' when lift >= 5 then 'medium' else 'low' end as severity from p")
def gap_benchmark(spark, sf):
    d = load(spark, sf, "customer").join(load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return insight.benchmark(d, "n_name", "sum(c_acctbal)")


@query("with a as (select count(*) as n, count(*) filter (note is null or trim(note) = '') as note, count(*) filter (region is null or trim(region) = '') as region, count(*) filter (dealer is null or trim(dealer) = '') as dealer from tickets), x as (select unnest(['region', 'dealer', 'note']) as c, unnest([region, dealer, note]) as b, n from a) select c as \"column\", b as blank, round(100.0 * b / n, 4) as pct, case when 100.0 * b / n >= 50 then 'high' else 'medium' end as severity from x where 100.0 * b / n >= 20 and 100.0 * b / n < 100 limit 3")
def gap_coverage(spark, sf):
    return insight.coverage(load(spark, sf, "tickets"), ["region", "dealer", "note"])
