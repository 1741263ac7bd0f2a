"""Trends, movements, outlier rates, rankings, concentration, momentum and benchmark gaps.

Segments of fewer than MIN_ROWS records are left out.  All take expressions, so a declared
measure ("sum(o_totalprice)") can be passed as text and is parsed by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_ROWS = 30


def _month(c: str) -> Column:
    return F.date_format(c, "yyyy-MM")


def monthly(df: DataFrame, date: str, measures: dict[str, str]) -> DataFrame:
    """(month, records, measures...): one row per month that has records."""
    return df.where(F.col(date).isNotNull()).groupBy(_month(date).alias("month")).agg(F.count(F.lit(1)).alias("records"), *[F.round(F.expr(e), 2).alias(n) for n, e in measures.items()])


def trend(df: DataFrame, date: str, measures: dict[str, str]) -> DataFrame:
    """The last complete month against the one before: (measure, month, value, before, pct).

    The last month on record counts as unfinished; "before" is the month before in the data,
    adjacent or not.  Needs three months.
    """
    m = monthly(df, date, measures)
    w = Window.orderBy(F.desc("month"))  # one row per month
    r = m.withColumn("k", F.row_number().over(w)).where("k in (2, 3)")
    cols = ["records", *measures]
    one = r.agg(F.count(F.lit(1)).alias("got"), F.max(F.when(F.col("k") == 2, F.col("month"))).alias("month"), *[F.max(F.when(F.col("k") == k, F.col(c).cast("double"))).alias(f"{c}_{k}") for c in cols for k in (2, 3)])
    x = one.where("got = 2").select("month", F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(f"{c}_2").alias("value"), F.col(f"{c}_3").alias("before")) for c in cols])).alias("x")).select("month", "x.*")
    return x.select("measure", "month", F.round("value", 2).alias("value"), F.round("before", 2).alias("before"), F.round(F.when(F.col("before") != 0, 100 * (F.col("value") - F.col("before")) / F.abs(F.col("before"))), 2).alias("pct"))


def movement(df: DataFrame, date: str, dimension: str, value: str | None = None, least: float = 20.0) -> DataFrame:
    """(segment, now, before, pct, severity): segments that moved by `least` percent and more
    between the last two complete months.  Periods under MIN_ROWS in both are left out."""
    base = df.where(F.col(date).isNotNull()).select(_month(date).alias("month"), F.col(dimension).cast("string").alias("segment"), (F.lit(1) if value is None else F.col(value)).cast("double").alias("v"))
    g = base.groupBy("month", "segment").agg(F.sum("v").alias("v"))
    months = g.select("month").distinct().withColumn("k", F.row_number().over(Window.orderBy(F.desc("month")))).where("k in (2, 3)")
    j = g.join(F.broadcast(months), "month")  # two rows
    s = j.groupBy("segment").agg(F.sum(F.when(F.col("k") == 2, F.col("v")).otherwise(0.0)).alias("now"), F.sum(F.when(F.col("k") == 3, F.col("v")).otherwise(0.0)).alias("before"))
    s = s.where(F.col("segment").isNotNull() & ~((F.col("now") < MIN_ROWS) & (F.col("before") < MIN_ROWS)) & (F.col("before") != 0)).withColumn("pct", 100 * (F.col("now") - F.col("before")) / F.abs(F.col("before")))
    return s.where(F.abs("pct") >= least).select("segment", F.round("now", 2).alias("now"), F.round("before", 2).alias("before"), F.round("pct", 2).alias("pct"), F.when(F.abs("pct") >= 40, "medium").otherwise("low").alias("severity"))


def outlier_rate(df: DataFrame, dimension: str, bad: Column) -> DataFrame:
    """The segment whose rate of bad records stands out: twice the overall rate, z of 3 and more
    (binomial), and five bad records more than expected."""
    s = df.groupBy(F.col(dimension).cast("string").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("k")).where((F.col("n") >= MIN_ROWS) & F.col("segment").isNotNull())
    tot = s.agg(F.sum("n").alias("tn"), F.sum("k").alias("tk"))
    s = s.crossJoin(F.broadcast(tot)).withColumn("p", F.col("tk") / F.col("tn")).withColumn("rate", F.col("k") / F.col("n"))
    s = s.withColumn("excess", F.col("k") - F.col("n") * F.col("p")).withColumn("z", F.when((F.col("p") > 0) & (F.col("p") < 1), (F.col("k") - F.col("n") * F.col("p")) / F.sqrt(F.col("n") * F.col("p") * (1 - F.col("p")))))
    top = s.orderBy(F.desc("rate"), "segment").limit(1)
    top = top.where((F.col("rate") >= 2 * F.col("p")) & (F.col("z") >= 3) & (F.col("excess") >= 5))
    return top.select("segment", "n", "k", F.round(100 * F.col("rate"), 4).alias("rate"), F.round(100 * F.col("p"), 4).alias("overall"), F.round("z", 4).alias("z"), F.when(F.col("rate") > 4 * F.col("p"), "high").otherwise("medium").alias("severity"))


def headline(df: DataFrame, measure: str, date: str | None = None) -> DataFrame:
    extra = [F.date_format(F.min(date), "yyyy-MM-dd").alias("first_day"), F.date_format(F.max(date), "yyyy-MM-dd").alias("last_day")] if date else []
    return df.agg(F.count(F.lit(1)).alias("records"), F.round(F.expr(measure), 2).alias("measure"), *extra)


def segments(df: DataFrame, dimension: str, measure: str) -> DataFrame:
    """(segment, records, measure) of segments that are filled and large enough."""
    return df.where(F.col(dimension).isNotNull() & (F.trim(F.col(dimension).cast("string")) != "")).groupBy(F.col(dimension).cast("string").alias("segment")).agg(F.count(F.lit(1)).alias("records"), F.expr(measure).cast("double").alias("measure")).where(F.col("records") >= MIN_ROWS)


def ranking(df: DataFrame, dimension: str, measure: str, higher_is_better: bool = True, most: int = 8) -> DataFrame:
    """(place, segment, records, measure, share): the best `most` segments."""
    s = segments(df, dimension, measure)
    tot = s.agg(F.sum("measure").alias("t"))
    order = [F.desc("measure") if higher_is_better else F.asc("measure"), F.asc("segment")]
    top = s.crossJoin(F.broadcast(tot)).orderBy(*order).limit(most)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("place"), "segment", "records", F.round("measure", 2).alias("measure"), F.round(F.when(F.col("t") != 0, 100 * F.col("measure") / F.col("t")), 4).alias("share"))


def concentration(df: DataFrame, dimension: str, measure: str, top: int = 5, least: float = 50.0) -> DataFrame:
    """The share of the first `top` of at least as many segments, if it is `least` percent or more."""
    s = segments(df, dimension, measure)
    k = s.withColumn("r", F.row_number().over(Window.orderBy(F.desc("measure"), "segment"))).agg(F.count(F.lit(1)).alias("segments"), F.sum("measure").alias("t"), F.sum(F.when(F.col("r") <= top, F.col("measure"))).alias("m"))
    k = k.where((F.col("segments") >= top) & (F.col("t") > 0)).withColumn("share", 100 * F.col("m") / F.col("t")).where(F.col("share") >= least)
    return k.select("segments", F.round("m", 2).alias("top_measure"), F.round("share", 4).alias("share"), F.when(F.col("share") >= 75, "medium").otherwise("low").alias("severity"))


def momentum(df: DataFrame, date: str, measure: str, higher_is_better: bool = True) -> DataFrame:
    """The last two complete months of a measure: right or wrong way."""
    m = df.where(F.col(date).isNotNull()).groupBy(_month(date).alias("month")).agg(F.expr(measure).cast("double").alias("v"))
    w = Window.orderBy(F.desc("month"))
    r = m.select("month", "v", F.lead("v").over(w).alias("before"), F.row_number().over(w).alias("k")).where("k = 2 and before is not null and before <> 0")
    pct = 100 * (F.col("v") - F.col("before")) / F.abs(F.col("before"))
    wrong = (pct < 0) if higher_is_better else (pct > 0)
    return r.select("month", F.round("v", 2).alias("value"), F.round("before", 2).alias("before"), F.round(pct, 2).alias("pct"), F.when(wrong, "wrong").otherwise("right").alias("way"), F.when(wrong & (F.abs(pct) > 15), "medium").otherwise("low").alias("severity"))


def benchmark(df: DataFrame, dimension: str, measure: str, higher_is_better: bool = True, per_record: bool = True, least: float = 8.0) -> DataFrame:
    """(segment, records, rate, benchmark, behind_pct, gain, lift, severity) of segments behind.

    A rate is the measure per record (an average is one already).  The benchmark is the element
    at ceil(n / 4) of the segments, best first, not weighted by volume.  The lift divides the
    gain of all laggards by the sum of rates, as the rule has it; `gain` shows the plain number.
    """
    s = segments(df, dimension, measure).withColumn("rate", F.col("measure") / F.col("records") if per_record else F.col("measure"))
    order = F.desc("rate") if higher_is_better else F.asc("rate")
    w = Window.orderBy(order, "segment")
    s = s.select("segment", "records", "rate", F.row_number().over(w).alias("r"))
    tot = s.agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("rate")).alias("rates"), F.max(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))).alias("z")).drop("z")
    mark = s.crossJoin(F.broadcast(tot)).where((F.col("n") >= 4) & (F.col("r") == F.ceil(F.col("n") / 4))).select(F.col("rate").alias("benchmark"), "rates")
    j = s.crossJoin(F.broadcast(mark))
    behind = (F.col("benchmark") - F.col("rate")) if higher_is_better else (F.col("rate") - F.col("benchmark"))
    j = j.withColumn("behind", behind).withColumn("pct", F.when(F.col("benchmark") != 0, 100 * F.col("behind") / F.abs(F.col("benchmark"))))
    lag = j.where((F.col("behind") > 0) & (F.col("pct") >= least)).withColumn("gain", F.col("behind") * F.col("records"))
    prize = lag.agg(F.sum("gain").alias("prize"))
    lag = lag.crossJoin(F.broadcast(prize)).withColumn("lift", F.when(F.col("rates") > 0, 100 * F.col("prize") / F.col("rates")))
    sev = F.when(F.col("lift") >= 15, "high").when(F.col("lift") >= 5, "medium").otherwise("low")
    return lag.select("segment", "records", F.round("rate", 4).alias("rate"), F.round("benchmark", 4).alias("benchmark"), F.round("pct", 4).alias("behind_pct"), F.round("gain", 2).alias("gain"), F.round("lift", 2).alias("lift"), sev.alias("severity"))


def coverage(df: DataFrame, columns: list[str], low: float = 20.0, most: int = 3) -> DataFrame:
    """(column, blank, pct, severity): columns that are blank in 20 % and more of the rows, not in all."""
    b = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    a = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(b(c)).alias(c) for c in columns])
    x = a.select("n", F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column"), F.col(c).alias("blank")) for i, c in enumerate(columns)])).alias("x")).select("n", "x.*").withColumn("pct", 100 * F.col("blank") / F.col("n")).where(f"pct >= {low} and pct < 100")
    return x.orderBy("ord").limit(most).select("column", "blank", F.round("pct", 4).alias("pct"), F.when(F.col("pct") >= 50, "high").otherwise("medium").alias("severity"))
