"""p4: noise of scanned pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafline.llm import scan
from sheafline.llm.library import chunks_of

SCAN_EXT = (".pdf", ".png", ".tif", ".tiff", ".jpg", ".jpeg", ".bmp")


def _pages(spark, sf_dir):
    pages, rest = chunks_of(spark, sf_dir, SCAN_EXT)
    return pages, rest.select("text")


def p4_found(spark, sf_dir):
    """Defects of scanned chunks."""
    return scan.findings(*_pages(spark, sf_dir)).select(F.col("id").alias("chunk_id"), "defect").distinct()


def p4_repaired(spark, sf_dir):
    """Scanned chunks as continuous paragraphs."""
    return scan.repair(*_pages(spark, sf_dir)).withColumnRenamed("id", "chunk_id")


QUERIES = {"p4_found": p4_found, "p4_repaired": p4_repaired}
ORACLES: dict[str, str] = {}
