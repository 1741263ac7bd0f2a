"""p1: most similar live vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.llm import knn
from sheafline.llm.library import bounded
from sheafline.session import cut, load, tidy

K, COSINE = 10, 0.92


def live_vectors(spark, sf_dir):
    """(id, vec) of the vectors that a chunk points to and that have a direction."""
    used = load(spark, sf_dir, "chunks").where("vec_row >= 0").select(F.col("vec_row").alias("id"))
    v = load(spark, sf_dir, "vectors").select(F.col("vec_row").alias("id"), "vec")
    # Read several times: for the fit, the sizes of the parts and the search.  Beyond a million ids the join moves the vectors.
    with tidy(spark):
        return cut(knn.usable(v.join(bounded(used), "id", "left_semi")))


def p1_found(spark, sf_dir):
    """Pairs of cosine 0.92 and more where one is among the ten most similar of the other."""
    v = live_vectors(spark, sf_dir)
    model = knn.fit(v, v.count(), COSINE)
    s = knn.similar(v, model, K, min_cosine=COSINE)
    return s.select(F.least("id", "other").alias("row_a"), F.greatest("id", "other").alias("row_b")).distinct()


def p1_search(spark, sf_dir):
    """The ten most similar of all live vectors for every fiftieth vector, at a recall of 0.95 on the sample."""
    v = live_vectors(spark, sf_dir)
    model = knn.fit(v, v.count(), None, 0.95)
    return knn.similar(v, model, K, queries=v.where("id % 50 = 0")).select(F.col("id").alias("vec_row"), F.col("other").alias("similar"), F.round("cosine", 6).alias("cosine"))


QUERIES = {"p1_found": p1_found, "p1_search": p1_search}
ORACLES = {
    # Every pair; the index may miss one in thousands, so the SQL is also a measure of its recall.
    "p1_found": """
with l as (select distinct v.vec_row as r, v.vec::double[64] as v from vectors v join chunks c on c.vec_row = v.vec_row where v.vec is not null),
u as (select r, v, sqrt(array_inner_product(v, v)) as n from l),
p as (select a.r as a, b.r as b, array_inner_product(a.v, b.v) / a.n / b.n as c from u a, u b where a.r <> b.r and a.n > 0 and b.n > 0),
t as (select a, b, c, row_number() over (partition by a order by c desc, b) as k from p)
select distinct least(a, b) as row_a, greatest(a, b) as row_b from t where k <= 10 and c >= 0.92
"""
}
