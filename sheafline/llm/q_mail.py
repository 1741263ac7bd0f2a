"""p6: quoted history, signatures and disclaimers in mail chunks."""

from __future__ import annotations

from sheafline.llm import mail
from sheafline.llm.library import chunks_of

MAIL_EXT = (".eml", ".msg")


def mails(spark, sf_dir):
    return chunks_of(spark, sf_dir, MAIL_EXT)[0]


def p6_authored(spark, sf_dir):
    """What the sender newly wrote, for every mail chunk."""
    return mail.reduce_mails(mails(spark, sf_dir)).selectExpr("id as chunk_id", "authored")


def p6_found(spark, sf_dir):
    """Pieces of mail chunks that their sender did not newly write."""
    r = mail.reduce_mails(mails(spark, sf_dir))
    return r.selectExpr("id as chunk_id", "stack(3, 'quote', quote, 'signature', signature, 'disclaimer', disclaimer) as (piece, has)").where("has").select("chunk_id", "piece")


QUERIES = {"p6_found": p6_found, "p6_authored": p6_authored}
ORACLES: dict[str, str] = {}
