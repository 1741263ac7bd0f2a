"""p2: markup residue in chunk texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.llm import markup
from sheafline.session import load


def _cleaned(spark, sf_dir):
    # The host of a chunk is the top folder of its file.
    hosts = load(spark, sf_dir, "files").select(F.col("id").alias("file_id"), F.substring_index("rel_path", "/", 1).alias("host"))
    return markup.clean_markup(load(spark, sf_dir, "chunks").select("id", "file_id", "text"), hosts)


def p2_clean(spark, sf_dir):
    """Clean text of every chunk."""
    return _cleaned(spark, sf_dir)


def p2_found(spark, sf_dir):
    """Chunks with any piece of markup."""
    n = sum((F.col(f"n_{k}") for k in markup.KINDS), F.lit(0))
    return _cleaned(spark, sf_dir).where(n > 0).select(F.col("id").alias("chunk_id"))


QUERIES = {"p2_found": p2_found, "p2_clean": p2_clean}
ORACLES: dict[str, str] = {}
