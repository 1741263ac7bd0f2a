"""Joins, sets, windows, grouping sets, recursion, JSON and time windows through the SQL guard.

Most are one text that both engines run.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline import catalog
from sheafline.guard import guarded
from sheafline.operators import ann, locate, present, store
from sheafline.session import load
from sheafline.sources import sheets
from sheafline.streaming import ingest

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "files", "chunks", "tickets", "catalog_tables", "catalog_columns", "scan_queue", "run_log", "index_runs", "vectors")
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _views(spark, sf, names) -> None:
    for n in names:
        load(spark, sf, n).createOrReplaceTempView(n)


def shared(name: str, tables: str, sql: str, duck: str | None = None) -> None:
    """A query whose text both engines run (or its DuckDB form)."""

    def run(spark, sf):
        _views(spark, sf, tables.split())
        return guarded(spark, sql)

    run.__name__, run.__doc__ = name, f"Guarded SQL: {name.replace('_', ' ')}."
    QUERIES[name], ORACLES[name] = run, duck or sql


shared("join_inner", "orders customer", "select c_mktsegment, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey group by c_mktsegment")
shared("join_left_count", "customer orders", "select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by c_custkey")
shared("join_anti", "files scan_queue", "select f.id from files f left join scan_queue s on s.path = f.path where s.path is null")
shared("join_semi", "customer orders", "select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000)")
shared("join_full", "supplier customer", "select coalesce(s_nationkey, c_nationkey) as k, count(s_suppkey) as s, count(c_custkey) as c from supplier full outer join customer on s_suppkey = c_custkey group by 1")
shared("join_null_safe", "files", "select count(*) as n from files a join files b on a.id = b.id and a.error is not distinct from b.error")
shared("join_range", "chunks", "select a.file_id, a.ord, count(*) as n from chunks a join chunks b on b.file_id = a.file_id and b.ord between a.ord - 1 and a.ord + 1 group by 1, 2")
shared("join_cross", "region nation", "select r_name, count(*) as n from region cross join nation group by r_name")
shared("join_theta", "region nation", "select r_name, count(*) as n from region join nation on r_regionkey < n_regionkey group by r_name")
shared("agg_multi", "lineitem", "select l_returnflag, l_linestatus, count(*) as n, count(distinct l_suppkey) as suppliers, round(sum(l_quantity), 2) as qty, round(avg(l_discount), 6) as disc, min(l_shipdate) as lo, max(l_shipdate) as hi from lineitem group by 1, 2")
shared("agg_conditional", "lineitem", "select l_linestatus, round(sum(case when l_returnflag = 'R' then 1e0 else 0e0 end) / count(*), 6) as rate from lineitem group by l_linestatus")
shared("agg_having_alias", "orders", "select o_orderpriority as p, count(*) as records from orders group by 1 having records >= 30")
shared("agg_mode", "part", "select p_brand, count(*) as n from part group by p_brand order by n desc, p_brand limit 3")
shared("agg_grouping_sets", "orders", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
shared("agg_rollup", "lineitem", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as qty from lineitem group by rollup (l_returnflag, l_linestatus)")
shared("agg_cube", "lineitem", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
shared("agg_duplicate_groups", "documents", "select count(*) as n from (select text from documents where text is not null group by text having count(*) > 1) t")
shared("set_union_all", "customer supplier", "select c_nationkey as k from customer union all select s_nationkey from supplier")
shared("set_union", "customer supplier", "select c_nationkey as k from customer union select s_nationkey from supplier")
shared("set_intersect", "customer supplier", "select c_nationkey as k from customer intersect select s_nationkey from supplier")
shared("set_except", "orders", "select o_custkey as k from orders where o_orderstatus = 'F' except select o_custkey from orders where o_orderstatus = 'P'")
shared("window_rank", "orders", "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r, dense_rank() over (partition by o_custkey order by o_orderstatus) as d from orders")
shared("window_running", "orders", "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and current row), 2) as running from orders")
shared("window_lag", "events", "select event_id, lag(value) over (partition by user_id order by ts, event_id) as before from events")
shared("window_islands", "chunks", "select file_id, min(ord) as first_ord, max(ord) as last_ord from (select file_id, ord, ord - row_number() over (partition by file_id order by ord) as g from (select distinct file_id, ord from chunks) x) y group by file_id, g")
shared("window_sessions", "events", "select user_id, s, count(*) as n from (select user_id, sum(new) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as s from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) > interval '30' minute then 1 else 0 end as new from events) a) b group by 1, 2")
shared("top_k_per_group", "part", "select p_brand, p_partkey from (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as r from part) x where r <= 3")
shared("recursive_cte", "region", "with recursive t(n) as (select 1 union all select n + 1 from t where n < 50) select sum(n) as s from t")
shared("predicates", "documents", "select doc_id from documents where (lang in ('en', 'de') or lang is null) and n_chars between 100 and 900 and source ilike '%m%' and title is not null")
shared("case_arithmetic", "lineitem", "select l_orderkey, l_linenumber, case when l_quantity > 25 then 'large' else 'small' end as size, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) as charge from lineitem")
shared("month_groups", "orders", "select substr(cast(o_orderdate as string), 1, 7) as month, count(*) as n from orders group by 1", "select substr(cast(o_orderdate as varchar), 1, 7) as month, count(*) as n from orders group by 1")
shared("json_extract", "events", "select event_type, sum(cast(get_json_object(props, '$.k') as int)) as k from events group by event_type", "select event_type, sum(cast(json_extract_string(props, '$.k') as int))::bigint as k from events group by event_type")
shared("pivot", "orders", "select * from (select o_orderstatus, o_orderpriority, o_orderkey from orders) pivot (count(o_orderkey) for o_orderstatus in ('F' as f, 'O' as o, 'P' as p))", "select o_orderpriority, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p from orders group by 1")
shared("hashes", "documents", "select doc_id, sha2(text, 256) as h256, sha1(text) as h1 from documents where text is not null", "select doc_id, sha256(text) as h256, sha1(text) as h1 from documents where text is not null")


shared("distinct_ordered", "part", "select distinct p_type from part order by p_type limit 40")
shared("subquery_derived", "orders", "select m, count(*) as customers from (select o_custkey, count(*) as m from orders group by o_custkey) x group by m")


@query("select k, v from (select k, v, row_number() over (partition by k order by src desc) as r from (select 'n_files' as k, (select count(*) from files)::varchar as v, 1 as src union all select 'n_files', '0', 0 union all select 'kept', 'yes', 0)) where r = 1")
def meta_upsert(spark, sf):
    old = spark.createDataFrame([("n_files", "0"), ("kept", "yes")], "k string, v string")
    new = load(spark, sf, "files").agg(F.count(F.lit(1)).cast("string").alias("v")).select(F.lit("n_files").alias("k"), "v")
    return store.upsert(old, new, "k")


@query("select least(a.lo, b.lo) as lo, greatest(a.hi, b.hi) as hi from (select strftime(min(o_orderdate), '%Y-%m-%d') as lo, strftime(max(o_orderdate), '%Y-%m-%d') as hi from orders) a, (select strftime(min(l_shipdate), '%Y-%m-%d') as lo, strftime(max(l_shipdate), '%Y-%m-%d') as hi from lineitem) b")
def filter_bounds(spark, sf):
    lo, hi = present.date_bounds({"orders": (load(spark, sf, "orders"), "o_orderdate"), "lineitem": (load(spark, sf, "lineitem"), "l_shipdate")})
    return spark.createDataFrame([(lo, hi)], "lo string, hi string")


@query("select doc_id from documents order by md5(doc_id || '-7'), doc_id limit 100")
def random_sample(spark, sf):
    """A hundred rows in the order of a seeded hash: the same ones in every run."""
    return load(spark, sf, "documents").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-7"))), "doc_id").limit(100).select("doc_id")


@query("select user_id, time_bucket(interval '1 hour', ts) as start, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def window_tumbling(spark, sf):
    return ingest.windowed(load(spark, sf, "events"), "ts", "1 hour", keys=("user_id",), value="value").select("user_id", "start", "n", F.round("total", 4).alias("total"))


@query("select s as start, count(*) as n from (select unnest([time_bucket(interval '1 hour', ts), time_bucket(interval '1 hour', ts) - interval '1 hour']) as s from events) group by 1")
def window_sliding(spark, sf):
    return ingest.windowed(load(spark, sf, "events"), "ts", "2 hours", "1 hour").select("start", "n")


@query("select min(o_orderkey) as lo, count(*) as n, round(sum(o_totalprice), 2) as total from orders where o_orderdate >= date '1997-01-01' and o_orderdate < date '1998-01-01'")
def date_range_filter(spark, sf):
    s = present.range_session(spark, {"orders": (load(spark, sf, "orders"), "o_orderdate")}, "1997-01-01", "1997-12-31")
    return guarded(s, "select min(o_orderkey) as lo, count(*) as n, round(sum(o_totalprice), 2) as total from orders")


@query("with s as (select p_brand, round(sum(p_retailprice), 2) as s from part group by 1), k as (select * from s order by abs(s) desc, p_brand limit 15) select p_brand, s, row_number() over (order by p_brand) as place from k order by place")
def chart_cap_categories(spark, sf):
    return present.cap_categories(load(spark, sf, "part").groupBy("p_brand").agg(F.round(F.sum("p_retailprice"), 2).alias("s")), "p_brand", "s")


@query("with o as (select d, c, row_number() over (order by d) - 1 as i, count(*) over () as n from (select cast(o_orderdate as date) as d, count(*) as c from orders group by 1)) select d, c from o where n <= 100 or i = 0 or i = n - 1 or floor(i * 100.0 / n) <> floor((i - 1) * 100.0 / n)")
def chart_downsample(spark, sf):
    return present.downsample(load(spark, sf, "orders").groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("c")), "d", 100)


@query("select f.path, f.size from files f where f.path not in (select path from scan_queue where path is not null)")
def vanished_files(spark, sf):
    return store.vanished(load(spark, sf, "files"), load(spark, sf, "scan_queue")).select("path", "size")


@query("select ext, count(*) as files, sum(size)::bigint as bytes from scan_queue group by 1")
def stage_scan(spark, sf):
    from sheafline.sources.files import stage_summary

    return stage_summary(load(spark, sf, "scan_queue"))


@query("select path from scan_queue where path > '/data/library/m' order by path limit 1000")
def queue_pages(spark, sf):
    return store.page(load(spark, sf, "scan_queue"), "/data/library/m").select("path")


@query("select id, file_id, case when file_id % 10 = 3 then 'new' else text end as text from chunks")
def sink_upsert(spark, sf):
    c = load(spark, sf, "chunks").select("id", "file_id", "text")
    return store.upsert(c, c.where("file_id % 10 = 3").withColumn("text", F.lit("new")), "file_id")


@query("select id from chunks where file_id not in (select id from files where status = 'error')")
def delete_tombstone(spark, sf):
    dead = load(spark, sf, "files").where("status = 'error'").select(F.col("id").alias("file_id"))
    return store.delete(load(spark, sf, "chunks"), dead, "file_id").select("id")


@query("with live as (select distinct vec_row from chunks where vec_row >= 0), v as (select vec_row, row_number() over (order by vec_row) - 1 as new_row from vectors where vec_row in (select vec_row from live)) select c.id, coalesce(v.new_row, -1) as vec_row from chunks c left join v on v.vec_row = c.vec_row")
def compact_vectors(spark, sf):
    return store.compact(load(spark, sf, "vectors"), load(spark, sf, "chunks"))[1].select("id", "vec_row")


@query("with v as (select unnest(['o_orderstatus', 'o_orderpriority', 'o_custkey', 'o_totalprice']) as \"column\", unnest([o_orderstatus, o_orderpriority, o_custkey::varchar, o_totalprice::varchar]) as v from orders) select \"column\", count(*) as n_rows, count(v) as n_filled, count(distinct v) as n_distinct from v group by 1")
def profile_columns(spark, sf):
    return catalog.profile_columns(load(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey", "o_totalprice"]).select("column", "n_rows", "n_filled", "n_distinct")


@query("select c_nationkey as k, 'customer' as src, c_acctbal as bal from customer union all select s_nationkey, 'supplier', s_acctbal from supplier")
def union_view(spark, sf):
    cat = catalog.Catalog(spark)
    a = load(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("src"), F.col("c_acctbal").alias("bal"))
    b = load(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("supplier").alias("src"), F.col("s_acctbal").alias("bal"))
    cat.register("party_customer", a)
    cat.register("party_supplier", b)
    return cat.frame(cat.build_unions()[0])


@query("select source_file, substr(sha1(array_to_string(list(lower(trim(label)) order by ord), '|')), 1, 16) as shape from catalog_tables t join (select distinct table_name, ord, label from catalog_columns) c on c.table_name = t.name group by t.name, source_file")
def fingerprint_schema(spark, sf):
    c = load(spark, sf, "catalog_columns").select("table_name", "ord", "label").distinct()
    j = load(spark, sf, "catalog_tables").join(c, F.col("name") == F.col("table_name"))
    g = j.groupBy("name", "source_file").agg(F.sort_array(F.collect_list(F.struct("ord", F.lower(F.trim("label")).alias("l")))).alias("x"))
    return g.select("source_file", F.substring(F.sha1(F.array_join(F.transform("x", lambda e: e["l"]), "|")), 1, 16).alias("shape"))


@query("select file_id, first_row, last_row, n from (select file_id, ord // 5 as b, min(ord) + 1 as first_row, max(ord) + 1 as last_row, count(*) as n from (select distinct file_id, ord from chunks) group by 1, 2)")
def sheet_blocks(spark, sf):
    c = load(spark, sf, "chunks").select("file_id", "ord").distinct()
    return c.groupBy("file_id", F.floor(F.col("ord") / 5).alias("b")).agg((F.min("ord") + 1).alias("first_row"), (F.max("ord") + 1).alias("last_row"), F.count(F.lit(1)).alias("n")).drop("b")


@query("with t as (select table_name, (_row - 1) // 40 as b, _row, array_to_string(list_filter(['Region: ' || nullif(trim(region), ''), 'Dealer: ' || nullif(trim(dealer), ''), 'Status: ' || nullif(trim(status), '')], lambda x: x is not null), ' | ') as t from tickets) select table_name, min(_row) as first_row, max(_row) as last_row, string_agg(t, chr(10) order by _row, t) as text from t group by table_name, b")
def sheet_text(spark, sf):
    return sheets.sheet_text(load(spark, sf, "tickets"), [("Region", "region"), ("Dealer", "dealer"), ("Status", "status")], keys=("table_name",))


@query("with u as (select vec_id, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as n from embeddings), s as (select a.vec_id as qid, b.vec_id as id, list_dot_product(a.v, b.v) / a.n / b.n as score from u a, u b where a.vec_id % 50 = 0) select qid, id, round(score, 6) as score from (select *, row_number() over (partition by qid order by round(score, 9) desc, id) as k from s) where k <= 10")
def ann_search(spark, sf):
    """The ten nearest of every fiftieth vector; exact below 200,000 vectors, as in these tables."""
    v = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = v.where("id % 50 = 0").select(F.col("id").alias("qid"), "vec")
    return ann.find(v, q, 10).select("qid", "id", F.round("score", 6).alias("score"))


@query()
def locate_file(spark, sf):
    f = load(spark, sf, "files").where("trim(name) <> ''").select("id", "name")
    q = f.where("id % 50 = 0").select(F.col("id").alias("qid"), F.concat(F.lit("where is the file "), F.regexp_replace("name", r"\.\w+$", "")).alias("question"))
    return locate.locate(f, q)


@query()
def chunk_documents(spark, sf):
    from sheafline.operators.chunking import chunk_documents as cut

    d = load(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.lit(0).alias("block"), "text", F.lit("").alias("loc"), F.coalesce("title", F.lit("")).alias("heading"))
    return cut(d, size=400, overlap=60).select("path", "ord", F.length("text").alias("n"))
