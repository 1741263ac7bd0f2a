"""Tables of the library with the sides that may be broadcast checked first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.session import load

#: Ids up to this many (8 bytes each) may go to every executor; beyond it they are shuffled.
MAX_IDS = 1_000_000


def bounded(ids: DataFrame, limit: int = MAX_IDS) -> DataFrame:
    """`ids` with a broadcast hint if it has at most `limit` rows, which are counted here."""
    return F.broadcast(ids) if ids.limit(limit + 1).count() <= limit else ids


def files_of(spark, sf_dir: str, exts: Sequence[str]) -> DataFrame:
    """(file_id) of the files with one of the extensions; a size-checked side."""
    return bounded(load(spark, sf_dir, "files").where(F.lower(F.trim("ext")).isin(*exts)).select(F.col("id").alias("file_id")))


def chunks_of(spark, sf_dir: str, exts: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Chunks (id, file_id, ord, page, text) of files with one of the extensions, and all other chunks."""
    f = files_of(spark, sf_dir, exts)
    c = load(spark, sf_dir, "chunks").select("id", "file_id", "ord", F.expr(r"try_cast(regexp_extract(loc, '(?i)^\\s*(?:page|seite|página)\\s+([0-9]{1,6})', 1) as long)").alias("page"), "text")
    return c.join(f, "file_id", "left_semi"), c.join(f, "file_id", "left_anti")
