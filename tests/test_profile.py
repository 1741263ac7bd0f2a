"""p7: profiles from footers and dictionaries against a plain count."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sheafline.operators import profile as p

COLS = ("a", "b")


@pytest.fixture()
def table(tmp_path):
    t = pa.table({"load": ["x"] * 6 + ["y"] * 4, "a": ["1", " ", None, "2", "2", "bad"] + ["9"] * 4, "b": [1.0, 2.0, None, 4.0, 4.0, -0.5] + [None] * 4, "n": list(range(10))})
    pq.write_table(t, tmp_path / "one.parquet", row_group_size=6)
    pq.write_table(t.slice(0, 3), tmp_path / "two.parquet", use_dictionary=False)
    return str(tmp_path)


def test_profile(spark, table):
    foot = p.footers(spark, table, "load", COLS)
    got = {(r.load, r.column): r for r in p.profile(p.value_counts(foot, "load"), {"a": r"\A\d\z"}).collect()}
    r = got["x", "a"]
    assert (r.n_rows, r.n_filled, r.n_distinct, r.lo, r.hi, r.n_bad) == (9, 5, 3, "1", "bad", 1)
    r = got["x", "b"]
    assert (r.n_rows, r.n_filled, r.n_distinct, r.lo_num, r.hi_num) == (9, 7, 4, -0.5, 4.0)
    r = got["y", "b"]
    assert (r.n_filled, r.n_distinct, r.lo, r.hi_num) == (0, 0, None, None)


def test_footers_tell_what_they_hold(spark, table):
    foot = p.footers(spark, table, "load", COLS)
    rng = {(r.load, r.column): r for r in p.footer_ranges(foot).collect()}
    assert rng["x", "b"].sufficient and (rng["x", "b"].n_filled, rng["x", "b"].lo_num, rng["x", "b"].hi_num) == (7, -0.5, 4.0)
    assert not rng["x", "a"].sufficient  # a text's bounds may be cut and blanks are not nulls


def test_empty_table(spark, tmp_path):
    pq.write_table(pa.table({"load": pa.array([], pa.string()), "a": pa.array([], pa.string()), "b": pa.array([], pa.float64())}), tmp_path / "e.parquet")
    foot = p.footers(spark, str(tmp_path), "load", COLS)
    assert p.value_counts(foot, "load").count() == 0


@pytest.mark.parametrize("values", [[1.0], [1.0, 3.0], [5.0] * 9, list(map(float, range(1001))), [1.0] * 600 + [2.0] * 400, [0.0, 0.0, 7.0, 9.0]])
def test_exact_median(spark, values):
    import statistics

    df = spark.createDataFrame([("g", v) for v in values] + [("h", None)], "k string, num double").groupBy("k", "num").count().withColumnRenamed("count", "n")
    assert [(r.k, r.median) for r in p.exact_median(df, ["k"]).collect()] == [("g", statistics.median(values))]


def test_ranks_of_groups_larger_than_a_sort(spark):
    from pyspark.sql import functions as F

    from sheafline.operators.ranks import value_at_rank

    r = spark.range(3000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 1013).cast("double").alias("v"), (F.col("id") % 4 + 1).alias("c"))
    ranks = {"low": F.lit(1), "mid": F.floor((F.col("n") + 1) / 2), "high": F.col("n")}
    for keys in (["k"], []):
        got = [sorted(map(tuple, value_at_rank(r, ranks, keys, at_once=n).collect())) for n in (100, 100_000)]
        assert got[0] == got[1] and len(got[0]) == 3 * (3 if keys else 1)


def test_issues_against_the_load_before(spark):
    rows = [("l1", c, "A", None, 8) for c in ("region",)] + [("l1", "region", "B", None, 2), ("l2", "region", "A", None, 4), ("l2", "region", "B", None, 5), ("l2", "region", None, None, 3)]
    rows += [("l1", "hours", "10.0", 10.0, 10), ("l2", "hours", "20.0", 20.0, 12)]
    counts = spark.createDataFrame(rows, p.COUNTS)
    cat = spark.createDataFrame([("l1", "region", "category", 10, 2, "", ""), ("l1", "region", "category", 10, 2, "", ""), ("l2", "region", "category", 9, 2, "", ""), ("l1", "hours", "number", 10, 1, "10", "10"), ("l2", "hours", "number", 12, 1, "20", "21")], "table_name string, name string, role string, n_filled long, n_distinct long, lo string, hi string")
    loads = spark.createDataFrame([("l2", "s", 2), ("l1", "s", 1)], "name string, series string, load_no long")
    got = sorted(map(tuple, p.issues(p.profile(counts), counts, cat, loads).collect()))
    assert got == [("l2", "hours", "hi"), ("l2", "hours", "shift"), ("l2", "region", "null_rate"), ("l2", "region", "shift")]


@pytest.fixture()
def by_load(tmp_path):
    """A row group per load, of which some columns need no reading."""
    nan = float("nan")
    t = pa.table({"load": ["x"] * 5 + ["y"] * 5, "a": ["1", " ", None, "2", "2"] + [None] * 5, "b": [1.0, 2.0, None, 4.0, 4.0] + [7.0, nan, 7.0, None, 1.5], "c": [3] * 5 + [1, 2, None, 2, 9], "d": [None] * 5 + [5] * 5})
    pq.write_table(t, tmp_path / "one.parquet", row_group_size=5)
    return str(tmp_path)


def test_footers_and_dictionaries_replace_the_scan(spark, by_load):
    cols = ("a", "b", "c", "d")
    scanned = p.profile(p.value_counts(p.footers(spark, by_load, "load", cols), "load"))
    got, _, foot = p.table_profile(spark, by_load, "load", cols)
    key = lambda df: sorted(map(str, df.select("load", "column", "n_rows", "n_filled", "n_distinct", "lo_num", "hi_num", "n_bad").collect()))
    assert key(got) == key(scanned)
    way = {(r.load, r.column): r.way for r in foot.collect()}
    assert way == {("x", "a"): "scan", ("y", "a"): "footer", ("x", "b"): "dictionary", ("y", "b"): "dictionary", ("x", "c"): "footer", ("y", "c"): "dictionary", ("x", "d"): "footer", ("y", "d"): "footer"}
    assert {(r.column, r.way): r.chunks for r in p.chunk_report(foot).collect()}["d", "footer"] == 2
    # Columns whose values are compared are counted, whatever their footers hold.
    assert {r.way for r in p.plan(foot.drop("way"), ["b"]).where("column = 'b'").collect()} == {"scan"}


def test_rates_and_ranges_come_from_the_footer(spark, by_load):
    from pyspark.sql import functions as F

    foot = p.plan(p.footers(spark, by_load, "load", ("c",)))
    other = foot.withColumn("nulls", F.when(F.col("way") == "dictionary", F.lit(4)).otherwise(F.col("nulls"))).withColumn("lo", F.when(F.col("way") == "dictionary", F.lit("-8")).otherwise(F.col("lo")))
    r = {x.load: x for x in p.profile(p.value_counts(other, "load"), None, other).collect()}["y"]
    assert (r.n_filled, r.lo_num, r.n_distinct) == (1, -8.0, 3)
