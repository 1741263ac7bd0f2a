"""Joins on order: the latest row before, and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on: str, by: str, value: str, width: float = 86_400.0) -> DataFrame:
    """left + `value` of the latest row of right (by, on, value) with the same key, not after `on`.

    `on` is a timestamp on both sides.  Rows meet in buckets of `width` seconds of a key; what a
    bucket inherits from earlier ones is carried by a table of one row per key and bucket, so a key
    with most of the rows is spread over its buckets.  Of rows of right at one moment the greatest
    value holds; without an earlier row, or with a null key or moment, the value is null.
    """
    b = F.floor(F.unix_micros(F.col(on).cast("timestamp")) / (width * 1e6)).alias("_b")
    last = F.struct(F.col(on).alias("t"), F.col(value).alias("v"))
    r = right.where(F.col(on).isNotNull() & F.col(by).isNotNull()).select(F.col(by).alias("_k"), b, last.alias("_r"))
    cols = left.columns
    marked = left.withColumn("_id", F.monotonically_increasing_id())
    ok = F.col(on).isNotNull() & F.col(by).isNotNull()
    lb = marked.where(ok).select("*", F.col(by).alias("_k"), b)

    both = lb.select("_k", "_b", F.col(on).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), *cols).unionByName(r.select("_k", "_b", F.col("_r.t").alias("_t"), F.lit(0).alias("_side"), "_r"), allowMissingColumns=True)
    w = Window.partitionBy("_k", "_b").orderBy("_t", "_side", F.col("_r.v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_in", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")

    per = r.groupBy("_k", "_b").agg(F.max("_r").alias("_r"))
    asked = lb.select("_k", "_b").distinct()
    edge = per.unionByName(asked.join(per, ["_k", "_b"], "left_anti").withColumn("_r", F.lit(None).cast(per.schema["_r"].dataType)))
    before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = edge.select("_k", "_b", F.last("_r", ignorenulls=True).over(before).alias("_c"))
    got = inside.join(carried, ["_k", "_b"]).select(*cols, F.coalesce("_in", "_c")["v"].alias(value))
    rest = left.where(~ok | ok.isNull()).select(*cols, F.lit(None).cast(right.schema[value].dataType).alias(value))
    return got.unionByName(rest)


def within(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: float = 86_400.0) -> DataFrame:
    """Every point joined with every span that holds it: start <= at < end, all timestamps.

    A span stands in each bucket of `width` seconds that it touches, and a point meets the spans
    of its bucket only.  Choose a width near that of the spans.  Nulls and empty spans meet nothing.
    """
    bucket = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (width * 1e6))
    p = points.withColumn("_b", bucket(F.col(at)))
    s = spans.where(F.col(start) < F.col(end)).withColumn("_b", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end) - F.expr("interval 1 microsecond")))))
    return p.join(s, "_b").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")
