"""Column-level data quality profile from columnar files.

The footers of the files are read first, as a Spark job with a row per (file, row group, column).
Each column chunk then takes the cheapest way that is exact (`plan`):

* `footer`: all values null, or one repeated integer, in a row group of one load: nothing is read;
* `dictionary`: exact statistics (null count, and extrema of a numeric type) in a row group of one
  load, and no one asks for counts: rates and ranges come from the footer, and the dictionary's
  entries are the distinct candidates;
* `scan`: all else, column by column, one row group at a time, so a task never holds more than a
  row group.  Values are counted where they lie, by dictionary code where the chunk has one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.operators.ranks import value_at_rank
from sheafline.session import cut, load

COUNTS = "load string, column string, value string, num double, n long"
#: With `edge`: whether a value is the least or greatest filled one of its load in some row group.
MARKED = COUNTS + ", edge boolean"


def footers(spark: SparkSession, path: str, load_col: str, columns: Sequence[str]) -> DataFrame:
    """(file, row_group, column, rows, load, nulls, lo, hi, exact, dictionary) from the footers.

    `load` is the single load the row group belongs to, else null; `exact` says that nulls, lo
    and hi may be used as they stand (statistics present, numeric type, no NaN possible or seen).
    An empty table gives no rows.
    """
    columns = list(columns)
    schema = pa.schema([("file", pa.string()), ("row_group", pa.int32()), ("column", pa.string()), ("rows", pa.int64()), ("load", pa.string()), ("nulls", pa.int64()), ("lo", pa.string()), ("hi", pa.string()), ("exact", pa.bool_()), ("floating", pa.bool_()), ("dictionary", pa.bool_())])

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in it:
            for uri in batch.column(0).to_pylist():
                with _opened(uri) as src:
                    md = pq.ParquetFile(src).metadata
                names = {md.schema.column(i).path: i for i in range(md.num_columns)}
                out = []
                for g in range(md.num_row_groups):
                    rg = md.row_group(g)
                    one = None
                    # Bounds of texts may be cut short: two equal bounds name the load only if they are short enough to be whole.
                    if load_col in names and (s := rg.column(names[load_col]).statistics) is not None and s.has_min_max and s.null_count == 0 and s.min == s.max and len(str(s.min)) < SHORT:
                        one = str(s.min)
                    for c in columns:
                        if c not in names:
                            continue
                        ch = rg.column(names[c])
                        s = ch.statistics
                        numeric = ch.physical_type in ("INT32", "INT64", "DOUBLE", "FLOAT") and md.schema.column(names[c]).logical_type.type in NUMBERS
                        whole = s is not None and s.has_null_count
                        has = whole and s.has_min_max and numeric
                        exact = whole and (has or s.null_count == rg.num_rows)
                        out.append((uri, g, c, rg.num_rows, one, s.null_count if whole else None, str(s.min) if has else None, str(s.max) if has else None, bool(exact), ch.physical_type in ("DOUBLE", "FLOAT"), "RLE_DICTIONARY" in ch.encodings or "PLAIN_DICTIONARY" in ch.encodings))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    # The names of the files stay in Spark; their bytes are not touched.
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return names.mapInArrow(read, FOOTER)


FOOTER = "file string, row_group int, column string, rows long, load string, nulls long, lo string, hi string, exact boolean, floating boolean, dictionary boolean"
#: Writers cut bounds of texts at 64 bytes or more.
SHORT = 32
NUMBERS = ("INT", "NONE")


def _opened(uri: str):
    from urllib.parse import unquote, urlparse

    from pyarrow import fs

    u = urlparse(uri)
    if u.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(u.path))
    f, p = fs.FileSystem.from_uri(uri)
    return f.open_input_file(p)


def plan(foot: DataFrame, counted: Sequence[str] = ()) -> DataFrame:
    """`foot` with `way`: footer, dictionary or scan.  counted: columns whose values must be counted."""
    alone = F.col("load").isNotNull() & F.col("exact")
    constant = (F.col("nulls") == F.col("rows")) | ((F.col("nulls") == 0) & (F.col("lo") == F.col("hi")) & ~F.col("floating"))
    way = F.when(alone & constant, "footer").when(alone & F.col("dictionary") & ~F.col("column").isin(list(counted)), "dictionary").otherwise("scan")
    return foot.withColumn("way", way)


_COUNTS = pa.schema([("load", pa.string()), ("column", pa.string()), ("value", pa.string()), ("num", pa.float64()), ("n", pa.int64()), ("edge", pa.bool_())])


def value_counts(foot: DataFrame, load_col: str, parts: int | None = None) -> DataFrame:
    """(load, column, value, num, n, edge): the values of the chunks in `foot` (of `plan`, or of
    `footers`, which scans all), counted per row group.

    edge marks the least and the greatest filled text of a load in any row group, so that the
    extrema of a column are found among a few rows.  Value is the text of a value as it stands (null for null), num its number for numeric
    columns.  n is 0 for the candidates of a dictionary.  A row group is the unit of work and of
    memory.
    """
    if "way" not in foot.columns:
        foot = foot.withColumn("way", F.lit("scan"))

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        def batch(load: pa.Array, column: str, v: pa.Array, n: pa.Array) -> pa.RecordBatch:
            v = v.dictionary_decode() if pa.types.is_dictionary(v.type) else v
            number = pa.types.is_floating(v.type) or pa.types.is_integer(v.type)
            num = pc.cast(v, pa.float64()) if number else pa.nulls(len(v), pa.float64())
            load = load.dictionary_decode() if pa.types.is_dictionary(load.type) else load
            load, v = load.cast(pa.string()), pc.cast(v, pa.string())
            full = pc.fill_null(pc.not_equal(pc.ascii_trim_whitespace(v), ""), False)
            ends = pa.table({"load": load, "v": pc.if_else(full, v, None)}).group_by("load").aggregate([("v", "min"), ("v", "max")])
            place = pc.index_in(load, ends["load"].combine_chunks())
            edge = pc.or_(*(pc.fill_null(pc.equal(v, ends[c].combine_chunks().take(place)), False) for c in ("v_min", "v_max")))
            return pa.RecordBatch.from_arrays([load, pa.array([column] * len(v), pa.string()), v, num, n.cast(pa.int64()), edge], schema=_COUNTS)

        # Rows come sorted by row group; what belongs to one is gathered across batches.
        last, todo = None, []

        def work(key, todo) -> Iterator[pa.RecordBatch]:
            uri, g = key
            with _opened(uri) as src:
                pf = pq.ParquetFile(src, read_dictionary=[*[t["column"] for t in todo if t["dictionary"]], load_col])
                keys = None
                for t in todo:
                    c = t["column"]
                    v = pf.read_row_group(g, columns=[c]).column(0).combine_chunks()
                    v = pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v
                    if t["way"] == "dictionary":
                        u = v.unique().drop_null()  # an entry that no row uses is no value
                        yield batch(pa.array([t["load"]] * len(u), pa.string()), c, u, pa.array([0] * len(u), pa.int64()))
                        continue
                    if keys is None:
                        keys = pf.read_row_group(g, columns=[load_col]).column(0).combine_chunks()
                        keys = pa.concat_arrays(keys.chunks) if isinstance(keys, pa.ChunkedArray) else keys
                        keys = keys if pa.types.is_dictionary(keys.type) else pc.cast(keys, pa.string())
                    got = pa.table({"load": keys, "v": v}).group_by(["load", "v"]).aggregate([([], "count_all")]).combine_chunks()
                    for b in got.to_batches():
                        yield batch(b.column("load"), c, b.column("v"), b.column("count_all"))

        for b in it:
            for t in b.to_pylist():
                key = (t["file"], t["row_group"])
                if key != last and todo:
                    yield from work(last, todo)
                    todo = []
                last = key
                todo.append(t)
        if todo:
            yield from work(last, todo)

    n = parts or max(1, foot.sparkSession.sparkContext.defaultParallelism)
    todo = foot.where("way <> 'footer'").select("file", "row_group", "column", "load", "dictionary", "way")
    counts = todo.repartition(n, "file", "row_group").sortWithinPartitions("file", "row_group").mapInArrow(read, MARKED)
    told = foot.where("way = 'footer'").select("load", "column", F.col("lo").alias("value"), F.col("lo").cast("double").alias("num"), F.col("rows").alias("n"), F.lit(True).alias("edge"))
    return counts.unionByName(told).groupBy("load", "column", "value", "num").agg(F.sum("n").alias("n"), F.max("edge").alias("edge"))


def exact_median(counts: DataFrame, keys: Sequence[str], value: str = "num", n: str = "n") -> DataFrame:
    """keys + (median) of counted values: exact, also for a group that holds most of the rows
    (`ranks.value_at_rank`).  Groups without values are left out."""
    keys = list(keys)
    c = counts.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).alias("v"), F.col(n).alias("c"))
    # Counted values are told once per group.
    mid = value_at_rank(c, {"low": F.floor((F.col("n") + 1) / 2), "high": F.floor(F.col("n") / 2) + 1}, keys, once=True)
    return mid.groupBy(*keys).agg((F.sum("at") / 2).alias("median"))


def filled(c: Column) -> Column:
    """Not null and not only blanks."""
    return c.isNotNull() & (F.length(F.regexp_replace(c, r"^\s+|\s+$", "")) > 0)


def profile(counts: DataFrame, patterns: dict[str, str] | None = None, foot: DataFrame | None = None) -> DataFrame:
    """Per (load, column): n_rows, n_filled, n_distinct, lo, hi (text), lo_num, hi_num, n_bad.

    foot: the footers after `plan`, whose dictionary chunks gave `counts` candidates only; their
    rates and ranges come from here.  Distinct and extrema are of filled values as they stand.
    n_bad counts filled values that do not have the column's form (null pattern: none).  Columns
    without a filled value have null extrema and a distinct count of 0.
    """
    ok = filled(F.col("value"))
    bad = F.lit(False)
    for c, rx in (patterns or {}).items():
        bad = bad | ((F.col("column") == c) & ok & ~F.col("value").rlike(rx))
    got = counts.groupBy("load", "column").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(ok, F.col("n")).otherwise(0)).alias("n_filled"),
        F.sum(F.when(ok, 1).otherwise(0)).cast("long").alias("n_distinct"),
        F.min(F.when(ok, F.col("num"))).alias("lo_num"),
        F.max(F.when(ok, F.col("num"))).alias("hi_num"),
        F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("n_bad"),
    )
    # Texts are compared apart: an aggregate of texts would sort all rows.
    edges = counts.where("edge") if "edge" in counts.columns else counts
    ends = edges.where(ok).groupBy("load", "column").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    got = got.join(ends, ["load", "column"], "left").select("load", "column", "n_rows", "n_filled", "n_distinct", "lo", "hi", "lo_num", "hi_num", "n_bad")
    if foot is None:
        return got
    text, zero = F.lit(None).cast("string"), F.lit(0).cast("long")
    known = footer_ranges(foot.where("way = 'dictionary'")).select("load", "column", "n_rows", "n_filled", zero.alias("n_distinct"), text.alias("lo"), text.alias("hi"), "lo_num", "hi_num", zero.alias("n_bad"))
    sums, least, most = ("n_rows", "n_filled", "n_distinct", "n_bad"), ("lo", "lo_num"), ("hi", "hi_num")
    whole = got.unionByName(known).groupBy("load", "column").agg(*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most])
    return whole.select(*got.columns)


def footer_ranges(foot: DataFrame) -> DataFrame:
    """(load, column, n_rows, n_filled, lo_num, hi_num, sufficient) from footers alone.

    `sufficient` is false where any chunk of the load lacks exact statistics or shares its row
    group with another load; such loads have to be scanned.  The extrema of a footer leave NaN
    out; `profile` has them from the dictionary.
    """
    return foot.groupBy("load", "column").agg(
        F.sum("rows").alias("n_rows"),
        F.sum(F.col("rows") - F.col("nulls")).alias("n_filled"),
        F.min(F.col("lo").cast("double")).alias("lo_num"),
        F.max(F.col("hi").cast("double")).alias("hi_num"),
        (F.min("exact") & F.col("load").isNotNull()).alias("sufficient"),
    )


#: Fixed forms of the ticket columns.
TICKET_PATTERNS = {"ticket_id": r"\A[A-Z]{3}-[0-9]{8}\z", "closed_date": r"\A[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])\z", "product_code": r"\A[0-9]{7}\z"}
TICKET_COLUMNS = ("ticket_id", "closed_date", "region", "product_code", "dealer", "status", "hours", "amount", "units", "note")
NULL_RATE_STEP, SHIFT_RATIO, SHIFT_SHARE = 0.20, 2.0, 0.30


def issues(prof: DataFrame, counts: DataFrame, catalog: DataFrame, loads: DataFrame) -> DataFrame:
    """(table_name, column_name, issue) against the recorded profile and the load before.

    prof, counts: of `profile` and `value_counts`.  catalog: catalog_columns; repeated records
    count once, a column with several different records holds a value if any of them does, and
    a missing record holds none.  loads: (name, series, load_no); the load before is the one with the next lower load_no
    of the same series, and the first load of a series has none.
    """
    from pyspark.sql import Window

    cat = catalog.select(F.col("table_name").alias("load"), F.col("name").alias("column"), "role", F.col("n_filled").alias("c_filled"), F.col("n_distinct").alias("c_distinct"), F.nullif(F.trim("lo"), F.lit("")).alias("c_lo"), F.nullif(F.trim("hi"), F.lit("")).alias("c_hi")).distinct()
    num = F.col("role") == "number"

    def edge(got: str, text: str, number: str) -> Column:
        by = F.when(num, F.expr(f"try_cast({got} as double)").eqNullSafe(F.col(number))).otherwise(F.col(got).eqNullSafe(F.col(text)))
        return by | ~F.coalesce(F.col("role").isin("number", "date"), F.lit(False))

    j = prof.join(cat, ["load", "column"], "left")
    held = j.groupBy("load", "column").agg(
        F.max(F.coalesce(F.col("c_filled") == F.col("n_filled"), F.lit(False))).alias("n_filled"),
        F.max(F.coalesce(F.col("c_distinct") == F.col("n_distinct"), F.lit(False))).alias("n_distinct"),
        F.max(edge("c_lo", "lo", "lo_num")).alias("lo"),
        F.max(edge("c_hi", "hi", "hi_num")).alias("hi"),
        F.max(F.col("n_bad") == 0).alias("pattern"),
    )
    wrong = held.select("load", "column", F.expr("stack(5, 'n_filled', n_filled, 'n_distinct', n_distinct, 'lo', lo, 'hi', hi, 'pattern', pattern) as (issue, fine)")).where(~F.col("fine")).drop("fine")

    w = Window.partitionBy("series").orderBy("load_no", "load")
    before = loads.select(F.col("name").alias("load"), "series", "load_no").distinct().select("load", F.lag("load").over(w).alias("prev"))  # one row per load: the catalogue is small
    before = before.where(F.col("prev").isNotNull())

    rate = prof.select("load", "column", (1 - F.col("n_filled") / F.col("n_rows")).alias("r"))
    step = rate.join(before, "load").join(rate.select(F.col("load").alias("prev"), "column", F.col("r").alias("r0")), ["prev", "column"]).where(F.col("r") - F.col("r0") >= NULL_RATE_STEP - 1e-12).select("load", "column", F.lit("null_rate").alias("issue"))

    med = exact_median(counts.where(F.col("column").isin("hours", "amount")).select("load", "column", "num", "n"), ["load", "column"])
    moved = med.join(before, "load").join(med.select(F.col("load").alias("prev"), "column", F.col("median").alias("m0")), ["prev", "column"]).where(F.col("m0") > 0).where((F.col("median") >= SHIFT_RATIO * F.col("m0")) | (F.col("median") <= F.col("m0") / SHIFT_RATIO)).select("load", "column", F.lit("shift").alias("issue"))

    # A few values a load; they are compared several times.
    vals = cut(counts.where(F.col("column").isin("region", "status") & filled(F.col("value"))).select("load", "column", "value", "n"))
    share = vals.join(vals.groupBy("load", "column").agg(F.sum("n").alias("t")), ["load", "column"]).select("load", "column", "value", (F.col("n") / F.col("t")).alias("p"))
    both = share.join(before, "load").select("load", "column", "value", F.col("p"), F.lit(0.0).alias("q")).unionByName(share.withColumnRenamed("load", "prev").join(before, "prev").select("load", "column", "value", F.lit(0.0).alias("p"), F.col("p").alias("q")))
    drift = both.groupBy("load", "column", "value").agg(F.abs(F.sum("p") - F.sum("q")).alias("d")).groupBy("load", "column").agg((F.sum("d") / 2).alias("d"), F.count(F.lit(1)).alias("k")).where(F.col("d") >= SHIFT_SHARE - 1e-12)
    has_both = share.select("load", "column").distinct().join(before, "load").join(share.select(F.col("load").alias("prev"), "column").distinct(), ["prev", "column"]).select("load", "column")
    drift = drift.join(has_both, ["load", "column"], "left_semi").select("load", "column", F.lit("shift").alias("issue"))

    return wrong.unionByName(step).unionByName(moved).unionByName(drift).select(F.col("load").alias("table_name"), F.col("column").alias("column_name"), "issue")


#: Columns of tickets whose values must be counted: medians and shares against the load before.
TICKET_COUNTED = ("hours", "amount", "region", "status")


def table_profile(spark: SparkSession, path: str, load_col: str, columns: Sequence[str], patterns: dict[str, str] | None = None, counted: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profile, counts of the columns in `counted`, footers with their way) of the loads of a
    Parquet table.  Columns with a pattern are counted, so that every malformed value is told.  Missing columns
    give no rows, an empty table gives none at all.
    """
    foot = cut(plan(footers(spark, path, load_col, columns), [*counted, *(patterns or {})]))
    # Columns whose values are compared later lie apart, as they are read several times.
    kept = F.col("column").isin(list(counted))
    counts = cut(value_counts(foot.where(kept), load_col))
    rest = cut(value_counts(foot.where(~kept), load_col))
    return profile(counts, patterns, foot.where(kept)).unionByName(profile(rest, patterns, foot.where(~kept))), counts, foot


def ticket_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole check of `tickets` against the catalogue (TESTDATA p7_found)."""
    prof, counts, _ = table_profile(spark, f"{sf_dir}/tickets.parquet", "table_name", TICKET_COLUMNS, TICKET_PATTERNS, TICKET_COUNTED)
    # A row per load and column; the checks read it several times.
    return issues(cut(prof), counts, load(spark, sf_dir, "catalog_columns"), load(spark, sf_dir, "catalog_tables"))


def chunk_report(foot: DataFrame) -> DataFrame:
    """(column, way, chunks, rows): how many chunks the footer answers, and how many are read."""
    return foot.groupBy("column", "way").agg(F.count(F.lit(1)).alias("chunks"), F.sum("rows").alias("rows"))


SCHEMA = T.StructType([T.StructField("table_name", T.StringType()), T.StructField("column_name", T.StringType()), T.StructField("issue", T.StringType())])
