"""Data-quality findings and cleaning as views over unchanged data.

Findings share one shape: (check, column, severity, n, share, detail).  Every check is one
aggregation over the table; the caller may union them.  Empty tables give no findings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafline.functions.text import label_key, months_between_dates
from sheafline.operators.ranks import AROUND_P99, value_at_rank

# Numbers that stand for "unknown" when one of them is most frequent.
SENTINELS = (0, -1, 9, 99, 999, 9999, 99999, 999999)
RANK = {"high": 0, "medium": 1, "low": 2}
FINDING = ("check", "column", "severity", "n", "share", "detail")


def _finding(df: DataFrame, check: str, column: str, severity: Column, n: Column, share: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(column).alias("column"), severity.alias("severity"), n.cast("long").alias("n"), F.round(share.cast("double"), 4).alias("share"), detail.cast("string").alias("detail"))


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values: under 1 % low, under 25 % medium, else high.  One pass for all columns."""
    a = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns])
    s = a.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in columns])).alias("x")).select("_n", "x.*")
    s = s.withColumn("miss", F.col("_n") - F.col("filled")).where("miss > 0").withColumn("p", 100 * F.col("miss") / F.col("_n"))
    sev = F.when(F.col("p") < 1, "low").when(F.col("p") < 25, "medium").otherwise("high")
    return s.select(F.lit("null").alias("check"), "column", sev.alias("severity"), F.col("miss").cast("long").alias("n"), F.round("p", 4).alias("share"), F.lit(None).cast("string").alias("detail"))


def constant(df: DataFrame, *columns: str) -> DataFrame:
    """Columns of one value only, over ten rows and more; one pass for all columns."""
    per = lambda c: F.struct(F.lit(c).alias("column"), F.count(c).alias("filled"), F.min(c).cast("string").alias("lo"), (F.min(c) == F.max(c)).alias("one"))
    a = df.agg(F.count(F.lit(1)).alias("_n"), F.array(*[per(c) for c in columns]).alias("x")).select("_n", F.explode("x").alias("x")).select("_n", "x.*")
    a = a.where("_n >= 10 and filled > 0 and one")
    return a.select(F.lit("constant").alias("check"), "column", F.lit("low").alias("severity"), F.col("filled").cast("long").alias("n"), F.lit(100.0).alias("share"), F.col("lo").alias("detail"))


def p99(df: DataFrame, column: str) -> DataFrame:
    """(at, hi, n): the value at rank floor(0.99 n), at least the first; exact."""
    v = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"), F.lit(1).cast("long").alias("c"))
    return value_at_rank(v, {"p99": F.greatest(F.lit(1), F.floor(F.col("n") * 0.99))}, near=AROUND_P99).select("at", "hi", "n")


def outlier(df: DataFrame, column: str) -> DataFrame:
    """Twenty rows and more whose greatest value is over 100 times the 99th percentile."""
    a = p99(df, column).where("n >= 20 and at > 0 and hi > 100 * at")
    big = df.select(F.col(column).cast("double").alias("v")).crossJoin(F.broadcast(a)).where("v > 100 * at")  # `a` is one row
    g = big.groupBy("at", "hi", "n").agg(F.count(F.lit(1)).alias("k"))
    return _finding(g, "outlier", column, F.when(F.col("hi") / F.col("at") > 10000, "high").otherwise("medium"), F.col("k"), 100 * F.col("k") / F.col("n"), F.round(F.col("at"), 4))


def negative(df: DataFrame, column: str) -> DataFrame:
    a = df.agg(F.count(column).alias("n"), F.count_if(F.col(column) < 0).alias("k"), F.min(column).alias("lo"))
    return _finding(a.where("k > 0"), "negative", column, F.lit("medium"), F.col("k"), 100 * F.col("k") / F.col("n"), F.round(F.col("lo"), 4))


def sentinel(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value (ties: the least) stands for "unknown" and holds over 20 %."""
    v = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    a = v.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d"), F.max(F.struct("c", (-F.col("v")).alias("neg"))).alias("t"))
    a = a.select("n", "d", F.col("t.c").alias("c"), (-F.col("t.neg") + 0.0).alias("v"))
    a = a.where(F.col("v").isin(*[float(s) for s in SENTINELS]) & (100 * F.col("c") / F.col("n") > 20) & (F.col("d") > 2))
    return _finding(a, "sentinel", column, F.lit("medium"), F.col("c"), 100 * F.col("c") / F.col("n"), F.col("v"))


def future_date(df: DataFrame, column: str, as_of: str) -> DataFrame:
    """Dates after the day `as_of` (a literal, so that runs can be repeated)."""
    a = df.agg(F.count(column).alias("n"), F.count_if(F.col(column) >= F.date_add(F.lit(as_of).cast("date"), 1)).alias("k"), F.max(column).alias("hi"))
    return _finding(a.where("k > 0"), "future_date", column, F.lit("high"), F.col("k"), 100 * F.col("k") / F.col("n"), F.date_format("hi", "yyyy-MM-dd"))


def date_spread(df: DataFrame, column: str, source: str, months: int = 6) -> DataFrame:
    """Per source, dates that span more than `months` calendar months."""
    g = df.groupBy(F.col(source).cast("string").alias("src")).agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("n"))
    g = g.withColumn("m", months_between_dates(F.col("lo"), F.col("hi"))).where(F.col("m") > months)
    return g.select(F.lit("date_spread").alias("check"), F.lit(column).alias("column"), F.lit("medium").alias("severity"), F.col("n").cast("long").alias("n"), F.col("m").cast("double").alias("share"), F.col("src").alias("detail"))


def near_labels(df: DataFrame, column: str) -> DataFrame:
    """(label, same_as, n): spellings of one label, over all labels whatever their number.

    Each label is paired with the most frequent one of the same key (ties: the least label).
    """
    v = df.where(~blank(F.col(column))).groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("c"))
    v = v.withColumn("key", label_key(F.col("label")))
    w = Window.partitionBy("key").orderBy(F.desc("c"), "label")
    return v.where("key <> ''").withColumn("same_as", F.first("label").over(w)).where("label <> same_as").select("label", "same_as", F.col("c").alias("n"))


def duplicate_values(df: DataFrame, column: str, ratio: float = 0.9) -> DataFrame:
    """An id-like column (distinct at least `ratio` of the rows) with repeated values."""
    g = df.groupBy(column).agg(F.count(F.lit(1)).alias("c")).where(F.col(column).isNotNull())
    a = g.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("d"), F.count_if(F.col("c") > 1).alias("k")).where((F.col("d") >= ratio * F.col("n")) & (F.col("k") > 0))
    return _finding(a, "duplicate_id", column, F.lit("high"), F.col("k"), 100 * F.col("k") / F.col("d"), F.col("d"))


def near_label_finding(df: DataFrame, column: str) -> DataFrame:
    """One finding for all spellings of labels of a column: n spellings of share percent of the labels."""
    n = df.where(~blank(F.col(column))).agg(F.countDistinct(column).alias("d"))
    g = near_labels(df, column).agg(F.count(F.lit(1)).alias("k")).where("k > 0").crossJoin(F.broadcast(n))  # one row each
    return _finding(g, "near_duplicate", column, F.lit("medium"), F.col("k"), 100 * F.col("k") / F.col("d"), F.col("d"))


def scan(df: DataFrame, numbers: list[str] = (), dates: list[str] = (), columns: list[str] | None = None, as_of: str | None = None, most: int = 60, labels: list[str] = (), ids: list[str] = (), source: str | None = None) -> DataFrame:
    """All checks of a table, by severity and column, the first `most` (a report).

    labels: categories whose spellings are compared; ids: columns that should not repeat; source:
    the column by which the spread of dates is measured.  A check without its columns is left out.
    """
    out = nulls(df, columns or df.columns).unionByName(constant(df, *(columns or df.columns)))
    for c in labels:
        out = out.unionByName(near_label_finding(df, c))
    for c in ids:
        out = out.unionByName(duplicate_values(df, c))
    for c in dates if source else ():
        out = out.unionByName(date_spread(df, c, source))
    for c in numbers:
        for f in (outlier, negative, sentinel):
            out = out.unionByName(f(df, c))
    for c in dates if as_of else ():
        out = out.unionByName(future_date(df, c, as_of))
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return out.orderBy(rank, "column", "check").limit(most)


# --- cleaning ---------------------------------------------------------------------------
ORDER = ("trim", "blank_to_null", "map_value", "null_sentinel", "null_outlier", "null_future")


@dataclass(frozen=True)
class Rule:
    """kind: of ORDER; column; value: what to compare with; to: the replacement of map_value."""

    kind: str
    column: str
    value: object = None
    to: object = None


def clean_columns(df: DataFrame, rules: list[Rule]) -> dict[str, Column]:
    """One expression per column, rules folded in a fixed order from the innermost."""
    out: dict[str, Column] = {}
    for r in sorted(rules, key=lambda r: ORDER.index(r.kind)):
        c = out.get(r.column, F.col(r.column))
        if r.kind == "trim":
            c = F.trim(F.regexp_replace(c, " +", " "))
        elif r.kind == "blank_to_null":
            c = F.when(F.trim(c) != "", c)
        elif r.kind == "map_value":
            c = F.when(c == F.lit(r.value), F.lit(r.to)).otherwise(c)
        elif r.kind == "null_sentinel":
            c = F.when(~(c == F.lit(r.value)) | c.isNull(), c)
        elif r.kind == "null_outlier":
            c = F.when(~(c > F.lit(r.value)) | c.isNull(), c)
        else:
            c = F.when(~(c >= F.date_add(F.lit(r.value).cast("date"), 1)) | c.isNull(), c)
        out[r.column] = c
    return out


def clean(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """The table with cleaned columns; the data itself stays as it is."""
    return df.withColumns(clean_columns(df, rules))


def clean_impact(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(column, changed, distinct_before, distinct_after): both forms are evaluated on one row,
    so no join of raw and clean rows is needed."""
    both = clean_columns(df, rules)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("raw"), e.cast("string").alias("new")) for c, e in both.items()])
    x = df.select(F.explode(pairs).alias("x")).select("x.*")
    # Distinct pairs first: the later aggregate works on values, not on rows.
    v = x.groupBy("column", "raw", "new").agg(F.count(F.lit(1)).alias("c"))
    return v.groupBy("column").agg(F.sum(F.when(~F.col("raw").eqNullSafe(F.col("new")), F.col("c")).otherwise(0)).alias("changed"), F.countDistinct("raw").alias("distinct_before"), F.countDistinct("new").alias("distinct_after"))


def propose(df: DataFrame, texts: list[str] = (), numbers: list[str] = (), dates: list[str] = (), as_of: str | None = None) -> list[Rule]:
    """Rules that would change something; what is looked at are aggregates, not rows."""
    rules: list[Rule] = []
    if texts:
        a = df.agg(*[F.count_if(F.trim(F.regexp_replace(c, " +", " ")) != F.col(c)).alias(f"t_{c}") for c in texts], *[F.count_if(F.trim(F.col(c)) == "").alias(f"b_{c}") for c in texts]).first()
        rules += [Rule("trim", c) for c in texts if a[f"t_{c}"]]
        rules += [Rule("blank_to_null", c) for c in texts if a[f"b_{c}"]]
        for c in texts:
            rules += [Rule("map_value", c, r.label, r.same_as) for r in near_labels(df.withColumn(c, F.trim(F.regexp_replace(c, " +", " "))), c).collect()]
    for c in numbers:
        s = sentinel(df, c).first()
        if s:
            rules.append(Rule("null_sentinel", c, float(s.detail)))
        o = outlier(df, c).first()
        if o:
            rules.append(Rule("null_outlier", c, 100 * float(o.detail)))
    for c in dates if as_of else ():
        if future_date(df, c, as_of).first():
            rules.append(Rule("null_future", c, as_of))
    return rules
