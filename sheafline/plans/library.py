"""Queries of loading, cleaning rules, joins on order and formats, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sheafline.functions import text as t
from sheafline.operators import joins, quality
from sheafline.plans.analytics import _KEY
from sheafline.session import checkpoint_dir, load
from sheafline.sources import sheets

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _csv(df, spark) -> str:
    """One CSV file of `df` in the shared folder."""
    at = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    df.coalesce(1).write.option("header", "true").csv(at)
    return spark.read.format("binaryFile").load(at).select("path").first()[0]


@query("select row_number() over (order by o_orderkey) + 1 as _row, 'ORD-' || o_orderkey as order_ref, strftime(o_orderdate, '%Y-%m-%d') as order_date, o_orderpriority as priority, lpad(o_custkey::varchar, 8, '0') as customer_code, round(o_totalprice, 2) as total, o_custkey as days from orders")
def sheet_csv(spark, sf):
    """A sheet written as CSV and loaded again: header, types and row numbers."""
    d = load(spark, sf, "orders").orderBy("o_orderkey").selectExpr("concat('ORD-', o_orderkey) as `Order Ref`", "date_format(o_orderdate, 'dd/MM/yyyy') as `Order Date`", "o_orderpriority as Priority", "lpad(o_custkey, 8, '0') as `Customer Code`", "format_number(round(o_totalprice, 2), '#.00') as Total", "o_custkey as Days")
    df, _ = sheets.read_csv(spark, _csv(d, spark))
    return df.drop("_source_file")


_TEXTS = ("region", "dealer", "status", "note")


def _propose_sql() -> str:
    squeeze = "trim(regexp_replace({0}, ' +', ' ', 'g'))"
    out = [f"select 'trim' as kind, '{c}' as \"column\", null::varchar as value, null::varchar as \"to\" from tickets having count(*) filter ({squeeze.format(c)} <> {c}) > 0" for c in _TEXTS]
    out += [f"select 'blank_to_null', '{c}', null, null from tickets having count(*) filter (trim({c}) = '') > 0" for c in _TEXTS]
    for c in _TEXTS:
        out.append(f"select 'map_value', '{c}', label, same_as from (select label, key, first_value(label) over (partition by key order by n desc, label) as same_as from (select label, n, {_KEY.format('label')} as key from (select {squeeze.format(c)} as label, count(*) as n from tickets where {c} is not null and trim({c}) <> '' group by 1)) where key <> '') where label <> same_as")
    return " union all ".join(out)


@query(_propose_sql())
def clean_propose(spark, sf):
    """Cleaning rules for the texts of tickets."""
    rules = quality.propose(load(spark, sf, "tickets"), list(_TEXTS))
    return spark.createDataFrame([(r.kind, r.column, r.value, r.to) for r in rules], "kind string, column string, value string, to string")


@query("with p as (select * from events where event_type = 'purchase'), v as (select user_id, ts, max(event_id) as event_id from events where event_type <> 'purchase' group by 1, 2) select p.event_id, v.event_id as before from p asof left join v on p.user_id = v.user_id and p.ts >= v.ts")
def join_asof(spark, sf):
    """Each purchase with the last other event of its user."""
    e = load(spark, sf, "events")
    v = e.where("event_type <> 'purchase'").select("user_id", "ts", F.col("event_id").alias("before"))
    return joins.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), v, "ts", "user_id", "before").select("event_id", "before")


@query("with r as (select run_id, started_at, coalesce(finished_at, started_at + interval 2 hour) as finished_at from index_runs) select run_id, count(*) as n, count(distinct path) as paths from (select logged_at, path from run_log) l join r on l.logged_at >= r.started_at and l.logged_at < r.finished_at group by 1")
def join_interval(spark, sf):
    """Notes of the run log in the time of each run."""
    r = load(spark, sf, "index_runs").selectExpr("run_id", "started_at", "coalesce(finished_at, started_at + interval 2 hours) as finished_at")
    j = joins.within(load(spark, sf, "run_log").select("logged_at", "path"), r, "logged_at", "started_at", "finished_at", 3600.0)
    return j.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("paths"))


@query("select id, case when size < 1024 then format('{:,.0f} B', size::double) when size < 1048576 then format('{:,.1f} KB', size / 1024.0::double) when size < 1073741824 then format('{:,.1f} MB', size / 1048576.0::double) else format('{:,.1f} GB', size / 1073741824.0::double) end as shown from files where size is not null")
def human_bytes(spark, sf):
    return load(spark, sf, "files").where("size is not null").select("id", t.human_bytes(F.col("size")).alias("shown"))


@query("with s as (select event_id, value * 40 as s from events), r as (select event_id, s, round_even(s, 0)::bigint as n from s) select event_id, case when s is null then 'estimating' when s < 1 then 'less than a second' when s < 60 then n || 's' when s < 3600 then (n // 60) || 'm ' || lpad((n % 60)::varchar, 2, '0') || 's' else (n // 3600) || 'h ' || lpad((n % 3600 // 60)::varchar, 2, '0') || 'm' end as shown from r")
def human_time(spark, sf):
    return load(spark, sf, "events").select("event_id", t.human_time(F.col("value") * 40).alias("shown"))


@query("select table_name, _row, case when length(trim(closed_date)) between 8 and 26 then try_strptime(trim(closed_date), ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%Y-%m-%d', '%d/%m/%Y %H:%M:%S', '%d/%m/%Y', '%m/%d/%Y', '%d-%m-%Y', '%d-%b-%Y', '%Y/%m/%d']) end as d from tickets")
def date_forms(spark, sf):
    """Every date of tickets in any accepted form."""
    return load(spark, sf, "tickets").select("table_name", "_row", t.date_text(F.col("closed_date")).alias("d"))
