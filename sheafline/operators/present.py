"""Date range under a query, charts of its result, and saved panels."""

from __future__ import annotations

import datetime
import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafline.guard import Result, run_sql, validate

ISO = re.compile(r"\d{4}-\d{2}-\d{2}(?:[ T].*)?\Z")
MOST_BARS, MOST_SERIES, MOST_CELLS, MOST_POINTS = 15, 8, 400, 400
PANELS, PANEL_ROWS, PANEL_SECONDS = 24, 500, 15.0


def date_bounds(frames: dict[str, tuple[DataFrame, str]]) -> tuple[str | None, str | None]:
    """The first and last day over all date columns."""
    lo, hi = [], []
    for df, c in frames.values():
        r = df.agg(F.date_format(F.min(F.col(c).cast("timestamp")), "yyyy-MM-dd").alias("a"), F.date_format(F.max(F.col(c).cast("timestamp")), "yyyy-MM-dd").alias("b")).first()
        if r.a:
            lo.append(r.a), hi.append(r.b)
    return (min(lo), max(hi)) if lo else (None, None)


def describe_range(lo: str | None, hi: str | None) -> str:
    if lo and hi:
        return f"from {lo} to {hi}"
    return f"from {lo}" if lo else f"up to {hi}" if hi else "all dates"


def in_range(df: DataFrame, column: str, lo: str | None, hi: str | None) -> DataFrame:
    """Rows whose date lies in the days lo to hi, both inside; without bounds all rows."""
    for v in (lo, hi):
        if v and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", v):
            raise ValueError("a day has the form YYYY-MM-DD")
    c = F.col(column)
    if lo:
        df = df.where(c >= F.lit(lo).cast("date"))
    if hi:
        df = df.where(c < F.date_add(F.lit(hi).cast("date"), 1))
    return df


def range_session(spark: SparkSession, frames: dict[str, tuple[DataFrame, str | None]], lo: str | None, hi: str | None) -> SparkSession:
    """A session of its own in which the tables are views over the range only.

    The filter stands below whatever a query does and reaches the scan; views of the caller's
    session are untouched.
    """
    s = spark.newSession()
    for name, (df, c) in frames.items():
        v = in_range(df, c, lo, hi) if c else df
        path = f"_src_{name}"
        v.createOrReplaceGlobalTempView(path)
        s.table(f"global_temp.{path}").createOrReplaceTempView(name)
    return s


@dataclass
class Chart:
    kind: str
    x: str = ""
    y: list[str] = field(default_factory=list)
    labels: list = field(default_factory=list)
    series: dict[str, list] = field(default_factory=dict)
    notes: list[str] = field(default_factory=list)
    title: str = ""
    options: list[str] = field(default_factory=list)


def _kind(values: list) -> str:
    got = [v for v in values if v is not None]
    if got and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in got):
        return "number"
    if got and all(isinstance(v, (datetime.date, datetime.datetime)) or (isinstance(v, str) and ISO.match(v)) for v in got):
        return "date"
    return "category"


def thin(n: int, most: int = MOST_POINTS) -> list[int]:
    """Evenly spread positions of n points, the last one among them."""
    if n <= most:
        return list(range(n))
    got = sorted({int(i * n / most) for i in range(most)} | {n - 1})
    return got


def infer_chart(result: Result, roles: dict[str, str] | None = None) -> Chart:
    """The honest chart of a result; a table where none fits.  Ids are never an axis."""
    cols, rows, roles = result.columns, result.rows, roles or {}
    if not rows:
        return Chart("table", notes=["no rows"])
    vals = {c: [r[i] for r in rows] for i, c in enumerate(cols)}
    kinds = {c: "id" if roles.get(c) == "id" else _kind(v) for c, v in vals.items()}
    nums, dates, cats = ([c for c in cols if kinds[c] == k] for k in ("number", "date", "category"))
    title = f"{', '.join(nums[:2])} by {(dates or cats or [''])[0]}" if nums and (dates or cats) else ", ".join(cols)
    if len(rows) == 1:
        if len(cols) == 1 and nums:
            return Chart("stat", y=nums, series={nums[0]: vals[nums[0]]}, title=cols[0])
        if len(nums) == len(cols):
            return Chart("stats", y=nums, series={c: vals[c] for c in nums}, title=title)
    if dates and nums:
        d = dates[0]
        order = sorted((i for i in range(len(rows)) if vals[d][i] is not None), key=lambda i: str(vals[d][i]))
        notes = ["rows without a date are left out"] if len(order) < len(rows) else []
        keep = thin(len(order))
        if len(keep) < len(order):
            notes.append(f"{len(keep)} of {len(order)} points are shown")
        at = [order[k] for k in keep]
        return Chart("line", d, nums, [str(vals[d][i]) for i in at], {c: [vals[c][i] for i in at] for c in nums}, notes, title, ["line", "bar", "table"])
    if len(cats) == 2 and nums:
        a, b = cats
        series, labels = list(dict.fromkeys(vals[b])), list(dict.fromkeys(vals[a]))
        if len(series) <= MOST_SERIES and len(series) * len(labels) <= MOST_CELLS:
            cell = {(x, y): v for x, y, v in zip(vals[a], vals[b], vals[nums[0]])}
            return Chart("grouped_bar", a, [nums[0]], labels, {str(s): [cell.get((x, s), 0) for x in labels] for s in series}, [], title, ["grouped_bar", "table"])
    if cats and nums:
        c = cats[0]
        at = list(range(len(rows)))
        notes = []
        if len(at) > MOST_BARS:
            at = sorted(sorted(at, key=lambda i: (-abs(vals[nums[0]][i] or 0), i))[:MOST_BARS])
            notes.append(f"the {MOST_BARS} largest of {len(rows)} are shown")
        if len(nums) == 1:
            at.sort(key=lambda i: -(vals[nums[0]][i] or 0))
        wide = len(at) > 8 or any(len(str(vals[c][i])) > 16 for i in at)
        return Chart("hbar" if wide else "bar", c, nums, [vals[c][i] for i in at], {y: [vals[y][i] for i in at] for y in nums}, notes, title, ["bar", "hbar", "table"])
    if len(nums) >= 2:
        keep = thin(len(rows))
        return Chart("scatter", nums[0], [nums[1]], [vals[nums[0]][i] for i in keep], {nums[1]: [vals[nums[1]][i] for i in keep]}, [], title, ["scatter", "table"])
    return Chart("table", title=title)


def cap_categories(df: DataFrame, label: str, value: str, most: int = MOST_BARS, order: str | None = None) -> DataFrame:
    """df + place: the `most` largest by absolute value, in the order they had (by `order`, else
    by label); there is no row for the rest."""
    kept = df.orderBy(F.desc(F.abs(F.col(value))), label).limit(most)
    # At most `most` rows are left.
    return kept.withColumn("place", F.row_number().over(Window.orderBy(order or label))).orderBy("place")


def downsample(df: DataFrame, order: str, most: int = MOST_POINTS) -> DataFrame:
    """Evenly spread rows of an ordered result and its last one."""
    w = Window.orderBy(order)
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    x = df.withColumn("_i", F.row_number().over(w) - 1).crossJoin(F.broadcast(n))
    step = F.floor(F.col("_i") * most / F.col("_n"))
    before = F.floor((F.col("_i") - 1) * most / F.col("_n"))
    return x.where((F.col("_n") <= most) | (F.col("_i") == 0) | (step != before) | (F.col("_i") == F.col("_n") - 1)).drop("_i", "_n")


@dataclass
class Panel:
    name: str
    sql: str
    kind: str = ""


class Dashboards:
    """Saved panels, checked when saved and when run."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.boards: dict[str, list[Panel]] = {}

    def create(self, board: str) -> None:
        self.boards.setdefault(board, [])

    def add(self, board: str, panel: Panel) -> None:
        panels = self.boards[board]
        if len(panels) >= PANELS:
            raise ValueError(f"a dashboard holds at most {PANELS} panels")
        panel.sql = validate(self.spark, panel.sql)
        panels.append(panel)

    def remove(self, board: str, name: str) -> None:
        self.boards[board] = [p for p in self.boards[board] if p.name != name]

    def delete(self, board: str) -> None:
        self.boards.pop(board, None)

    def counts(self) -> dict[str, int]:
        return {b: len(p) for b, p in self.boards.items()}

    def dump(self) -> str:
        return json.dumps({b: [asdict(p) for p in ps] for b, ps in self.boards.items()})

    def load(self, text: str) -> None:
        self.boards = {b: [Panel(**p) for p in ps] for b, ps in json.loads(text).items()}

    def run(self, board: str, frames: dict[str, tuple[DataFrame, str | None]] | None = None, lo: str | None = None, hi: str | None = None, roles: dict[str, str] | None = None) -> list[dict]:
        s = range_session(self.spark, frames, lo, hi) if frames else self.spark
        out = []
        for p in self.boards[board]:
            r = run_sql(s, p.sql, PANEL_ROWS, PANEL_SECONDS)
            out.append({"name": p.name, "result": r, "chart": infer_chart(r, roles) if r.ok else None, "notes": [describe_range(lo, hi)] if frames and (lo or hi) else []})
        return out


def export_csv(df: DataFrame, path: str) -> None:
    """A result as CSV files with a header."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def export_html(result: Result) -> str:
    """A small result as an HTML table."""
    from html import escape

    cell = lambda tag, v: f"<{tag}>{escape('' if v is None else str(v))}</{tag}>"
    head = "".join(cell("th", c) for c in result.columns)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in result.rows) + "</table>"


def packaged(sql: str, result, catalog, missing: str = "") -> dict:
    """The answer of a query with what it rests on: tables, rows looked at, id columns to be kept
    as they stand, a table in text, and what could not be answered.

    catalog: the session's Catalog; a name counts where it stands in the query as a word.
    """
    used = [n for n in catalog.tables if re.search(rf"(?<!\w){re.escape(n)}(?!\w)", sql, re.I)]
    # A union view over tables of its own is not counted twice.
    base = [n for n in used if catalog.tables[n].kind == "table"] or used
    scanned = sum(catalog.tables[n].n_rows for n in base)
    ids = sorted({c.name for n in used for c in catalog.tables[n].columns if c.role == "id" and c.name in result.columns})
    return {"tables": used, "scanned": scanned, "id_columns": ids, "text": result.to_markdown() if result.rows else "The query ran and matched no rows.", "rows": len(result.rows), "truncated": result.truncated, "missing": missing, "sql": sql}
