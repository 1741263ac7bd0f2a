"""p8: evaluation items in documents."""

from __future__ import annotations

from sheafline.llm import leak
from sheafline.session import load


def _found(spark, sf_dir):
    return leak.find_leaks(load(spark, sf_dir, "documents").selectExpr("doc_id as id", "text"), load(spark, sf_dir, "eval_items"))


def p8_found(spark, sf_dir):
    """Documents with at least 12 consecutive words of an item."""
    return leak.leaked(_found(spark, sf_dir)).select("doc_id", "item_id").distinct()


def p8_similar(spark, sf_dir):
    """Documents that hold at least 0.8 of an item's weighted shingles."""
    return _found(spark, sf_dir).where("share >= 0.8").selectExpr("doc_id", "item_id", "run", "round(share, 4) as similarity")


_WORDS = "regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}]+')"
QUERIES = {"p8_found": p8_found, "p8_similar": p8_similar}
ORACLES = {
    "p8_found": f"""
with d as (select doc_id, {_WORDS} as w from documents where text is not null),
i as (select item_id, {_WORDS} as w from eval_items where text is not null),
dw as (select distinct doc_id, array_to_string(w[k : k + 11], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d where len(w) >= 12)),
iw as (select distinct item_id, array_to_string(w[k : k + 11], ' ') as s from (select item_id, w, unnest(range(1, len(w) - 10)) as k from i where len(w) >= 12))
select distinct doc_id, item_id from dw join iw using (s)
"""
}
