"""The index as tables: keyed replace, tombstones, compaction, staged scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEAD_SHARE = 0.25


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with all rows of each key in `rows` replaced by those in `rows`."""
    keys = rows.select(key).distinct()
    return table.join(keys, key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def vanished(files: DataFrame, scan: DataFrame) -> DataFrame:
    """Files on record that the walk did not see."""
    return files.join(scan.select("path").distinct(), "path", "left_anti")


def page(scan: DataFrame, after: str, size: int = 1000) -> DataFrame:
    """The next page of a staged scan by key."""
    return scan.where(F.col("path") > after).orderBy("path").limit(size)


def needs_compaction(live: int, total: int) -> bool:
    return total > 0 and (total - live) >= DEAD_SHARE * total


def compact(vectors: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors, chunks) with left-over vectors dropped and rows numbered anew in vec_row order.

    Numbers are dense over the whole table without a single-task sort: rows are ranged by
    vec_row, counted per range, and numbered inside their range.
    """
    live = chunks.where("vec_row >= 0").select("vec_row").distinct()
    v = vectors.join(live, "vec_row", "left_semi")
    # A range is a block of old numbers, so ranges never split a number.
    b = F.floor(F.col("vec_row") / 4096)
    per = v.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    start = per.select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("start"))  # one row per 4,096 vectors
    num = v.withColumn("b", b).join(start, "b").withColumn("new_row", F.col("start") + F.row_number().over(Window.partitionBy("b").orderBy("vec_row")) - 1)
    rows = num.select("vec_row", "new_row")
    c = chunks.join(rows, "vec_row", "left").withColumn("vec_row", F.coalesce("new_row", F.lit(-1).cast("long"))).select(*chunks.columns)
    return num.select(F.col("new_row").alias("vec_row"), *[x for x in vectors.columns if x != "vec_row"]), c


def ewma(values, alpha: float = 0.3):
    """Exponentially weighted mean of an ordered array column."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x).otherwise(s * (1 - alpha) + x * alpha))


def clustered(df: DataFrame, columns: list[str], parts: int | None = None) -> DataFrame:
    """Rows ranged and sorted by what is looked up, so that file statistics skip most row groups
    on a later filter; this takes the place of secondary indexes."""
    ranged = df.repartitionByRange(parts, *columns) if parts else df.repartitionByRange(*columns)
    return ranged.sortWithinPartitions(*columns)
