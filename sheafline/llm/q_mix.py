"""p9: mixing documents to target weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.llm import mix
from sheafline.session import load


def _mixed(spark, sf_dir, **how):
    docs = load(spark, sf_dir, "documents").selectExpr("doc_id as id", "source", "text")
    return mix.mix(docs, load(spark, sf_dir, "mix_targets"), **how)


def p9_shares(spark, sf_dir):
    """Actual shares of the largest mix in which no source with documents runs out."""
    r = _mixed(spark, sf_dir, keep_shares=True)[1]
    return r.select("source", "weight", "tokens", "documents", F.round("share", 6).alias("share"), "short")


def p9_found(spark, sf_dir):
    """Target sources whose share cannot be reached."""
    return _mixed(spark, sf_dir)[1].where("short").select("source")


def p9_report(spark, sf_dir):
    """Wanted and actual tokens and shares of every target source."""
    r = _mixed(spark, sf_dir)[1]
    return r.select("source", "weight", F.round("want").cast("long").alias("want"), "tokens", "documents", F.round("share", 6).alias("share"), "short")


def p9_sample(spark, sf_dir):
    """The documents of the mix with their copies."""
    return _mixed(spark, sf_dir)[0].withColumnRenamed("id", "doc_id")


QUERIES = {"p9_found": p9_found, "p9_report": p9_report, "p9_shares": p9_shares, "p9_sample": p9_sample}
ORACLES = {
    # Any usual count gives the same sources; the SQL counts characters.
    "p9_found": """
with have as (select lower(trim(source)) as k, sum(length(text)) as n from documents where source is not null group by 1),
t as (select m.source, m.weight, m.max_repeat, coalesce(h.n, 0) as n from mix_targets m left join have h on h.k = lower(trim(m.source)))
select source from t where max_repeat * n < weight * (select sum(n) from t)
"""
}
