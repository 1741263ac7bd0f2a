"""Exact order statistics without sorting all rows of a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.session import cut

AROUND_MEDIAN = (0.1, 0.25, 0.4, 0.45, 0.48, 0.49, 0.495, 0.499, 0.501, 0.505, 0.51, 0.52, 0.55, 0.6, 0.75, 0.9)
AROUND_P99 = (0.5, 0.75, 0.9, 0.95, 0.97, 0.98, 0.985, 0.988, 0.989, 0.991, 0.992, 0.995)


#: Rows of a group that one task sorts; larger groups are cut into ranges first.
SORTED_AT_ONCE = 100_000


def value_at_rank(rows: DataFrame, ranks: dict[str, Column], keys: Sequence[str] = (), near: Sequence[float] = AROUND_MEDIAN, at_once: int = SORTED_AT_ONCE, once: bool = False) -> DataFrame:
    """keys + (n, hi, which, at): the value at 1-based ranks of values `v` that occur `c` times.

    ranks are expressions of the group's total `n`.  Groups of at most `at_once` rows are sorted.
    Of larger ones approximate quantiles near the ranks make a few ranges; exact counts of the
    ranges tell in which one a rank lies, and only the values of that range are sorted.  However
    rough the quantiles, the result is exact.  Null values have no rank.  once: each value comes
    once in its group, so that repeats need not be put together.
    """
    keys = list(keys)
    rows = rows.select(*keys, "v", "c").where("v is not null")
    wanted = F.explode(F.array(*[F.struct(F.lit(w).alias("which"), r.cast("long").alias("r")) for w, r in ranks.items()])).alias("x")
    reached = (F.col("_end") >= F.col("x.r")) & (F.col("_end") - F.col("_c") < F.col("x.r"))
    size = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), F.max("v").alias("hi"), F.sum("c").alias("n")).where("n is not null"))
    sized = rows.join(size, keys) if keys else rows.crossJoin(F.broadcast(size))  # without keys `size` is one row

    few = sized.where(F.col("_k") <= at_once)
    few = few.withColumnRenamed("c", "_c") if once else few.groupBy(*keys, "n", "hi", "v").agg(F.sum("c").alias("_c"))
    few = few.withColumn("_end", F.sum("_c").over(Window.partitionBy(*keys).orderBy("v")))
    few = few.select("*", wanted).where(reached).select(*keys, "n", "hi", "x.which", F.col("v").alias("at"))

    if not size.where(F.col("_k") > at_once).limit(1).count():
        return few
    many = sized.where(F.col("_k") > at_once)
    a = many.groupBy(*keys).agg(F.percentile_approx("v", list(near), 10_000).alias("cuts"))
    cut_ = many.join(a, keys) if keys else many.crossJoin(F.broadcast(a))  # one row again
    above = sum((F.when(F.col("v") > F.col("cuts")[i], 1).otherwise(0) for i in range(len(near))), F.lit(0))
    cut_ = cut_.select(*keys, "v", "c", "n", "hi", above.alias("_range"))
    # At most len(near) + 1 rows of a group.
    s = cut_.groupBy(*keys, "_range").agg(F.sum("c").alias("_c"), F.max("n").alias("n"), F.max("hi").alias("hi"))
    s = s.withColumn("_end", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_range")))
    s = s.select("*", wanted).where(reached).select(*keys, "_range", "n", "hi", "x.which", "x.r", (F.col("_end") - F.col("_c")).alias("before"))
    m = cut_.select(*keys, "_range", "v", "c").join(s, [*keys, "_range"])
    m = m.groupBy(*keys, "n", "hi", "which", "r", "before", "v").agg(F.sum("c").alias("c"))
    m = m.withColumn("_end", F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "which").orderBy("v")))
    m = m.where((F.col("_end") >= F.col("r")) & (F.col("_end") - F.col("c") < F.col("r"))).select(*keys, "n", "hi", "which", F.col("v").alias("at"))
    return few.unionByName(m)
