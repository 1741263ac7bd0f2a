"""p10: personal information in documents."""

from __future__ import annotations

from sheafline.llm import pii
from sheafline.session import load

#: A demonstration key; real runs pass their own.
KEY = b"sheafline demonstration key"


def _docs(spark, sf_dir):
    return load(spark, sf_dir, "documents").selectExpr("doc_id as id", "text")


def p10_found(spark, sf_dir):
    """Every distinct piece of personal information of every document."""
    return pii.find_pii(_docs(spark, sf_dir), load(spark, sf_dir, "name_list"), key=KEY).withColumnRenamed("id", "doc_id")


def p10_redacted(spark, sf_dir):
    """Every document with placeholders."""
    return pii.redact(_docs(spark, sf_dir), KEY, load(spark, sf_dir, "name_list")).withColumnRenamed("id", "doc_id")


QUERIES = {"p10_found": p10_found, "p10_redacted": p10_redacted}
ORACLES: dict[str, str] = {}
