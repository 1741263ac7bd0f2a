"""p3: near-duplicate chunks and equal files."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.llm import near
from sheafline.session import load

#: The data's own definition: three-word shingles and a similarity of 0.7.
SHINGLE, THRESHOLD = 3, 0.7


def _near(spark, sf_dir):
    return near.near_duplicates(load(spark, sf_dir, "chunks").selectExpr("id", "file_id as grp", "text"), THRESHOLD, SHINGLE)


def p3_found(spark, sf_dir):
    """Pairs of like chunks of two files, and pairs of equal files."""
    chunks = near.record_pairs(*_near(spark, sf_dir)).select(F.lit("chunk").alias("kind"), "id_a", "id_b")
    files = near.equal_files(load(spark, sf_dir, "files")).select(F.lit("file").alias("kind"), "id_a", "id_b")
    return chunks.unionByName(files)


def p3_links(spark, sf_dir):
    """Every chunk with its class of equal texts and its number of links to other classes."""
    return near.record_links(*_near(spark, sf_dir)).withColumnRenamed("id", "chunk_id")


def p3_files(spark, sf_dir):
    """Every file with its class of equal hashes."""
    return near.file_classes(load(spark, sf_dir, "files")).withColumnRenamed("id", "file_id")


QUERIES = {"p3_found": p3_found, "p3_links": p3_links, "p3_files": p3_files}
ORACLES = {
    "p3_links": """
with w as (select id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from chunks where text is not null),
s as (select distinct id, array_to_string(w[k : k + 2], ' ') as s from (select id, w, unnest(range(1, len(w) - 1)) as k from w where len(w) >= 3)),
c as (select id, md5(string_agg(s, '|' order by s)) as c, count(*) as n from s group by 1),
r as (select c, min(id) as class_id, count(*) as copies, any_value(n) as n from c group by 1),
rs as (select c, s from r join s on s.id = class_id),
j as (select a.c as a, b.c as b, count(*) as k from rs a join rs b on a.s = b.s and a.c < b.c group by 1, 2),
l as (select a, b from j join r x on x.c = a join r y on y.c = b where k >= 0.7 * (x.n + y.n - k) - 1e-9),
d as (select c, count(*) as links from (select a as c from l union all select b from l) group by 1)
select id as chunk_id, class_id, copies, coalesce(links, 0) as links from c join r using (c) left join d using (c)
""",
    "p3_files": """
with f as (select distinct id, regexp_replace(lower(trim(hash)), '^(sha-?256|sha-?1|md5)\\s*[:=]\\s*', '') as h from files where hash is not null)
select id as file_id, min(id) over (partition by h) as class_id, count(*) over (partition by h) as copies from f where h <> ''
""",
    "p3_found": """
with w as (select id, file_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from chunks where text is not null),
s as (select distinct id, file_id, array_to_string(w[k : k + 2], ' ') as s from (select id, file_id, w, unnest(range(1, len(w) - 1)) as k from w where len(w) >= 3)),
n as (select id, count(*) as n from s group by 1),
j as (select a.id as a, b.id as b, count(*) as c from s a join s b on a.s = b.s and a.id < b.id and a.file_id is distinct from b.file_id group by 1, 2),
f as (select id, regexp_replace(lower(trim(hash)), '^(sha-?256|sha-?1|md5)\\s*[:=]\\s*', '') as h from files where hash is not null)
select 'chunk' as kind, a as id_a, b as id_b from j join n x on x.id = a join n y on y.id = b where c >= 0.7 * (x.n + y.n - c) - 1e-9
union all select 'file', x.id, y.id from f x join f y on x.h = y.h and x.id < y.id where x.h <> ''
"""
}
