"""Retrieval queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.functions import text as t
from sheafline.operators import retrieval as r
from sheafline.session import load

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_W = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"
_P = f"p as (select doc_id as doc, len(w) as dl, unnest(w) as term from (select doc_id, {_W.format('text')} as w from documents)), tf as (select term, doc, dl, count(*) as tf from p group by all), st as (select count(*) as n, avg(len({_W.format('text')})::double) as avgdl from documents), df as (select term, count(*) as df from tf group by 1), idf as (select term, case when ln((n - df + 0.5) / (df + 0.5)) > 0 then ln((n - df + 0.5) / (df + 0.5)) else 1e-6 end as idf, avgdl from df, st)"
_TOP = "select qid, doc, score, rank from (select *, row_number() over (partition by qid order by score desc, doc) as rank from s) where rank <= {k}"


def _bm(qs: str, scope: str = "") -> str:
    return f"{_P}, q as ({qs}), qt as (select qid, term, count(*) as qf from q group by 1, 2), s as (select qid, doc, round(sum(qf * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) as score from tf join idf using (term) join qt using (term) {scope} group by 1, 2)"


_Q3 = "select 1 as qid, unnest(['pump', 'housing', 'warning', 'warning']) as term union all select 2, unnest(['garantie', 'warnung']) union all select 3, unnest(['válvula', 'entrada'])"


def _queries(spark):
    return spark.createDataFrame([(1, ["pump", "housing", "warning", "warning"]), (2, ["garantie", "warnung"]), (3, ["válvula", "entrada"])], "qid int, terms array<string>")


@query(f"with {_P} select term, count(*) as docs, sum(tf)::bigint as n from tf group by 1")
def postings(spark, sf):
    return r.postings(load(spark, sf, "documents")).groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("n"))


@query(f"with {_bm(_Q3)} {_TOP.format(k=40)}")
def search_bm25(spark, sf):
    return r.bm25(load(spark, sf, "documents"), _queries(spark))


@query(f"with {_bm(_Q3, 'join (select doc_id from documents where folder like ' + repr('training%') + ') f on f.doc_id = doc')} {_TOP.format(k=10)}")
def search_bm25_scoped(spark, sf):
    d = load(spark, sf, "documents")
    return r.bm25(d, _queries(spark), k=10, scope=d.where("folder like 'training%'").select("doc_id"))


_IQ = f"select item_id as qid, unnest({_W.format('text')}) as term from eval_items"


@query(f"with {_bm(_IQ)} {_TOP.format(k=5)}")
def search_bm25_batch(spark, sf):
    q = load(spark, sf, "eval_items").select(F.col("item_id").alias("qid"), t.words(F.col("text")).alias("terms"))
    return r.bm25(r.invert(load(spark, sf, "documents")), q, k=5)


_DOT = "list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])) / sqrt(list_dot_product(b.embedding::double[], b.embedding::double[]))"


def _vectors(spark, sf):
    v = load(spark, sf, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec"))
    return v, v.where("doc % 50 = 0").select(F.col("doc").alias("qid"), "vec")


@query(f"select qid, doc, rank from (select *, row_number() over (partition by qid order by score desc, doc) as rank from (select a.vec_id as qid, b.vec_id as doc, round({_DOT}, 9) as score from embeddings a, embeddings b where a.vec_id % 50 = 0)) where rank <= 10")
def search_dense(spark, sf):
    v, q = _vectors(spark, sf)
    return r.dense(v, q, k=10).drop("score")


_HY = f"with {_bm('select (item_id - 1000) * 50 as qid, unnest(' + _W.format('text') + ') as term from eval_items')}, kw as ({_TOP.format(k=40)}), dn as (select qid, doc, rank from (select *, row_number() over (partition by qid order by sc desc, doc) as rank from (select a.vec_id as qid, b.vec_id as doc, round({_DOT}, 9) as sc from embeddings a, embeddings b where a.vec_id % 50 = 0)) where rank <= 40), f as (select qid, doc, round(sum(1.0::double / (60 + rank)), 9) as score from (select qid, doc, rank from kw union all select qid, doc, rank from dn) group by 1, 2) select qid, doc, score, rank from (select *, row_number() over (partition by qid order by score desc, doc) as rank from f) where rank <= 5"


@query(_HY)
def hybrid_search(spark, sf):
    q = load(spark, sf, "eval_items").select(((F.col("item_id") - 1000) * 50).alias("qid"), t.words(F.col("text")).alias("terms"))
    v, vq = _vectors(spark, sf)
    return r.hybrid(r.bm25(load(spark, sf, "documents"), q), r.dense(v, vq))


def _hits(spark, sf):
    c = load(spark, sf, "chunks").where("text is not null").select("id", "file_id", F.col("ord").cast("long").alias("ord"), "text", "loc")
    return c, c.where("id % 50 = 0").select(F.col("id").alias("qid"), "file_id", "ord", (F.lit(1.0) / (F.col("id") + 1)).alias("score")).dropDuplicates(["qid", "file_id", "ord"])


@query("with c as (select id, file_id, ord::bigint as ord, text from chunks where text is not null), h as (select id as qid, file_id, ord, 1.0 / (id + 1) as score from c where id % 50 = 0), w as (select distinct qid, file_id, ord + d as ord from h, (select unnest([-1, 0, 1]) as d)), j as (select w.qid, w.file_id, w.ord, c.text, h.score from w join c using (file_id, ord) left join h using (qid, file_id, ord)), i as (select *, ord - row_number() over (partition by qid, file_id order by ord) as run from j) select qid, file_id, min(ord) as first_ord, max(ord) as last_ord, sum(length(text))::bigint + count(*) - 1 as n from i group by qid, file_id, run having max(score) is not null")
def neighbour_merge(spark, sf):
    c, h = _hits(spark, sf)
    return r.neighbours(h, c).select("qid", "file_id", "first_ord", "last_ord", F.length("text").cast("long").alias("n"))


@query("with p as (select item_id // 10 as qid, item_id as id, (item_id * 7919) % 1000 / 1000.0 as score, text from eval_items), w as (select qid, id, row_number() over x as number, sum(length(text)) over (x rows unbounded preceding) - length(text) as before, length(text) as n from p window x as (partition by qid order by score desc, id)) select qid, number, id, least(n, 1200 - before)::bigint as used, n > 1200 - before as cut from w where 1200 - before >= n or 1200 - before >= 100")
def build_context(spark, sf):
    p = load(spark, sf, "eval_items").select(F.floor(F.col("item_id") / 10).alias("qid"), F.col("item_id").alias("id"), ((F.col("item_id") * 7919) % 1000 / 1000.0).alias("score"), "text")
    return r.context(p, 1200, 100)


@query("with p as (select doc_id % 500 as id, doc_id % 3 as part, doc_id % 50 as qid, row_number() over (partition by doc_id % 50, doc_id % 3 order by doc_id) as rank from documents), o as (select *, row_number() over (partition by qid, id order by rank, part) as k from p) select qid, id, part, rank, row_number() over (partition by qid order by rank, part, id) as place from o where k = 1")
def decompose_retrieve(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy(F.col("doc_id") % 50, F.col("doc_id") % 3).orderBy("doc_id")
    return r.interleave(load(spark, sf, "documents").select((F.col("doc_id") % 500).alias("id"), (F.col("doc_id") % 3).alias("part"), (F.col("doc_id") % 50).alias("qid"), F.row_number().over(w).alias("rank")))


_TALK = "select doc_id // 4 as conv_id, doc_id % 4 as turn, 'user' as role, case doc_id % 4 when 0 then text when 1 then 'and what about the north site?' when 2 then 'ok' else 'by month' end as text from documents"


@query(f"with c as ({_TALK}), b as (select *, lag(text) over (partition by conv_id order by turn) as before, trim(text) as q from c) select conv_id, turn, case when before is not null and q <> '' and q <> 'ok' and (regexp_matches(q, '(?i)\\b(it|its|this|that|these|those|they|them|their|there|the same|above|instead|as well|too|also|which one|what about|how about)\\b') or len(regexp_split_to_array(q, '\\s+')) <= 4) then concat_ws(' ', before, text) else text end as query from b")
def expand_query(spark, sf):
    d = load(spark, sf, "documents").select(F.floor(F.col("doc_id") / 4).alias("conv_id"), (F.col("doc_id") % 4).alias("turn"), F.lit("user").alias("role"), F.expr("case doc_id % 4 when 0 then text when 1 then 'and what about the north site?' when 2 then 'ok' else 'by month' end").alias("text"))
    return r.fold_history(d)


@query("with g(term, alternative) as (values ('pump', 'compressor'), ('pump', 'blower'), ('warranty', 'guarantee')), q as (select item_id as qid, text as question from eval_items), v as (select distinct qid, lower(regexp_replace(question, '(?i)\\b' || term || 's?\\b', alternative, 'g')) as variant, lower(question) as base from q, g where regexp_matches(question, '(?i)\\b' || term || 's?\\b')) select qid, variant from (select qid, variant, row_number() over (partition by qid order by variant) as k from v where variant <> base) where k <= 3")
def glossary_synonyms(spark, sf):
    g = spark.createDataFrame([("pump", "compressor"), ("pump", "blower"), ("warranty", "guarantee")], "term string, alternative string")
    return r.synonyms(load(spark, sf, "eval_items").selectExpr("item_id as qid", "text as question"), g)


@query("with x as (select id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x00\\xa0]', ' ', 'g'), '[ \\t\\x0b\\f\\r]+', ' ', 'g'), '(?m)^ | $', '', 'g'), '\\n{3,}', E'\\n\\n', 'g'), E' \\n') as c from chunks) select id, c from x")
def clean_text(spark, sf):
    return load(spark, sf, "chunks").select("id", t.clean_text(F.coalesce("text", F.lit(""))).alias("c"))


@query("select id, array_to_string(list_filter(['name: ' || nullif(trim(name), ''), 'ext: ' || nullif(trim(ext), ''), 'error: ' || nullif(trim(error), '')], lambda x: x is not null), ' | ') as row_text from files")
def table_to_text(spark, sf):
    return load(spark, sf, "files").select("id", t.row_text([("name", F.col("name")), ("ext", F.col("ext")), ("error", F.col("error"))]).alias("row_text"))


@query("select ext, count(*) as files, sum(size)::bigint as bytes, count(*) filter (status = 'error') as errors, sum(n_chunks)::bigint as chunks from files group by 1 order by files desc, ext limit 20")
def file_stats(spark, sf):
    g = load(spark, sf, "files").groupBy("ext").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.count_if(F.col("status") == "error").alias("errors"), F.sum("n_chunks").alias("chunks"))
    return g.orderBy(F.desc("files"), "ext").limit(20)


@query("select doc_id, regexp_matches(trim(text), '(?i)^\\s*(hi+|hello|thanks?|ok(ay)?)\\b[\\s!.?,]*$') as small from documents where text is not null")
def intent(spark, sf):
    return load(spark, sf, "documents").where("text is not null").select("doc_id", t.is_small_talk(F.col("text")).alias("small"))


@query("select id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[\\x00\\xa0]', ' ', 'g'), '[ \\t\\x0b\\f\\r]+', ' ', 'g'), '(?m)^ | $', '', 'g'), '\\n{3,}', E'\\n\\n', 'g'), E' \\n') as c from chunks where text is not null")
def xml_strip(spark, sf):
    return load(spark, sf, "chunks").where("text is not null").select("id", t.strip_xml(F.col("text")).alias("c"))


@query("select item_id, array_to_string(list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^\\p{L}\\p{N}_\\s]', ' ', 'g')), '\\s+'), lambda w: length(w) > 1)[1:32], ' ') as terms from eval_items")
def query_terms(spark, sf):
    return load(spark, sf, "eval_items").select("item_id", F.array_join(t.query_terms(F.col("text")), " ").alias("terms"))


@query("select id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as s from files where name is not null")
def slugs(spark, sf):
    return load(spark, sf, "files").where("name is not null").select("id", t.slug(F.col("name")).alias("s"))


@query("select doc_id, regexp_replace(case when doc_id % 3 = 0 then '<|im_start|>' || text || ' [INST]' else text end, '(?im)<\\|[^|>\\n]{0,48}\\|>|<</?SYS>>|\\[/?INST\\]|</?s>|^\\s*###\\s*(?:system|instruction|assistant|user)\\s*:', ' ', 'g') as s from documents where text is not null")
def harden(spark, sf):
    d = load(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", t.harden(F.expr("case when doc_id % 3 = 0 then concat('<|im_start|>', text, ' [INST]') else text end")).alias("s"))


@query("select c.id, concat_ws(' | ', 'file: ' || nullif(trim(f.name), ''), 'folder: ' || split_part(f.rel_path, '/', 1), 'section: ' || nullif(trim(c.heading), ''), 'at: ' || nullif(trim(c.loc), '')) || chr(10) || c.text as e from chunks c join files f on f.id = c.file_id where c.text is not null")
def embed_text(spark, sf):
    f = load(spark, sf, "files").select(F.col("id").alias("file_id"), F.trim("name").alias("name"), F.substring_index("rel_path", "/", 1).alias("folder"))
    c = load(spark, sf, "chunks").where("text is not null").join(f, "file_id")
    return c.select("id", r.embed_text(F.col("name"), F.col("folder"), F.trim("heading"), F.trim("loc"), F.col("text")).alias("e"))


@query("select table_name, _row, coalesce(try_strptime(trim(closed_date), '%Y-%m-%d'), try_strptime(trim(closed_date), '%d/%m/%Y')) as d, case when regexp_full_match(trim(product_code), '[-+]?\\d{1,3}(,\\d{3})*(\\.\\d+)?|[-+]?\\d*\\.?\\d+') then replace(trim(product_code), ',', '')::double end as n from tickets where length(trim(closed_date)) = 10 and (closed_date like '%-%-%' or closed_date like '%/%/%')")
def parse_cells(spark, sf):
    d = load(spark, sf, "tickets").where("length(trim(closed_date)) = 10 and (closed_date like '%-%-%' or closed_date like '%/%/%')")
    return d.select("table_name", "_row", t.date_text(F.col("closed_date")).alias("d"), t.number_text(F.col("product_code")).alias("n"))
