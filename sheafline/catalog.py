"""Catalogue of loaded tables: profiles, roles, unions of equal shapes, and what a schema shows."""

from __future__ import annotations

import os
import re
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafline.sources.sheets import ENUM_MAX, fingerprint

LINEAGE = ("_row", "_source_file")
HINT_LENGTH = 520


@dataclass
class ColumnInfo:
    name: str
    label: str
    type: str
    role: str
    n_filled: int = 0
    n_distinct: int = 0
    lo: str = ""
    hi: str = ""
    values: list[str] = field(default_factory=list)


@dataclass
class TableInfo:
    name: str
    kind: str
    source: str
    columns: list[ColumnInfo]
    n_rows: int = 0
    members: list[str] = field(default_factory=list)
    shape: str = ""


def _type(t: T.DataType) -> str:
    return "INTEGER" if isinstance(t, T.IntegralType) else "REAL" if isinstance(t, (T.FractionalType, T.DecimalType)) else "TEXT"


def profile_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_rows, n_filled, n_distinct, lo, hi): texts of extrema, exact counts.

    Values are counted first (partial sums before the shuffle) and the counts aggregated, so no
    row is expanded once per distinct count.
    """
    cols = columns or [c for c in df.columns if c not in LINEAGE]
    v = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v"), (F.col(c).cast("double") if not isinstance(df.schema[c].dataType, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)) else F.lit(None).cast("double")).alias("x")) for c in cols])).alias("e")).select("e.*")
    g = v.groupBy("column", "v", "x").agg(F.count(F.lit(1)).alias("n"))
    a = g.groupBy("column").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("n_filled"), F.count("v").alias("n_distinct"), F.min(F.when(F.col("x").isNotNull(), F.struct("x", "v"))).alias("ln"), F.max(F.when(F.col("x").isNotNull(), F.struct("x", "v"))).alias("hn"), F.min("v").alias("lt"), F.max("v").alias("ht"))
    return a.select("column", "n_rows", "n_filled", "n_distinct", F.coalesce("ln.v", "lt").alias("lo"), F.coalesce("hn.v", "ht").alias("hi"))


def role_of(field_: T.StructField) -> str:
    role = (field_.metadata or {}).get("role")
    if role:
        return role
    if isinstance(field_.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if re.search(r"(^|_)(id|key|no|code)$", field_.name, re.I) or field_.name.endswith(("key", "_id")):
        return "id"
    return "number" if isinstance(field_.dataType, T.NumericType) else "text"


class Catalog:
    """Tables of a session by name; data stays in Spark, only profiles are kept here."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, TableInfo] = {}
        self._frames: dict[str, DataFrame] = {}

    def register(self, name: str, df: DataFrame, source: str = "", kind: str = "table", members: list[str] | None = None, roles: dict[str, str] | None = None) -> TableInfo:
        """Profiles a table and makes it a view; one of the same name is replaced."""
        prof = {r.column: r for r in profile_columns(df).collect()} if [c for c in df.columns if c not in LINEAGE] else {}
        cols = []
        for f in df.schema:
            if f.name in LINEAGE:
                continue
            p = prof.get(f.name)
            role = (roles or {}).get(f.name) or role_of(f)
            nd = int(p.n_distinct) if p else 0
            if role == "category" and nd > ENUM_MAX:
                role = "text"
            elif role == "text" and 1 <= nd <= ENUM_MAX:
                role = "category"
            values: list[str] = []
            cols.append(ColumnInfo(f.name, (f.metadata or {}).get("label", f.name), _type(f.dataType), role, int(p.n_filled) if p else 0, nd, (p.lo or "") if p and role in ("number", "date") else "", (p.hi or "") if p and role in ("number", "date") else "", values))
        few = {c.name: c for c in cols if c.role == "category"}
        if few:
            # The values of all categories in one pass: at most ENUM_MAX each.
            pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in few])).alias("e")).select("e.*").where("v is not null and trim(v) <> ''").distinct()
            for r in pairs.orderBy("c", "v").collect():
                if len(few[r.c].values) < ENUM_MAX:
                    few[r.c].values.append(r.v)
        n = int(next(iter(prof.values())).n_rows) if prof else 0
        info = TableInfo(name, kind, source, cols, n, list(members or []), fingerprint([c.label for c in cols]))
        self.tables[name], self._frames[name] = info, df
        df.createOrReplaceTempView(name)
        return info

    def frame(self, name: str) -> DataFrame:
        return self._frames[name]

    def drop(self, name: str) -> None:
        self.tables.pop(name, None)
        self._frames.pop(name, None)
        self.spark.catalog.dropTempView(name)

    def for_source(self, source: str) -> list[str]:
        return sorted(n for n, t in self.tables.items() if t.source == source)

    def replace_source(self, source: str, frames: dict[str, DataFrame]) -> list[str]:
        """All tables of a file are replaced by those of its new reading."""
        for n in self.for_source(source):
            self.drop(n)
        return [self.register(n, df, source).name for n, df in frames.items()]

    def build_unions(self) -> list[str]:
        """A view over each two or more tables of one shape; only union views are rebuilt."""
        for n in [n for n, t in self.tables.items() if t.kind == "union"]:
            self.drop(n)
        groups: dict[str, list[str]] = defaultdict(list)
        for n, t in self.tables.items():
            if t.kind == "table":
                groups[t.shape].append(n)
        made = []
        for names in groups.values():
            if len(names) < 2:
                continue
            names.sort()
            stem = re.sub(r"_+$", "", os.path.commonprefix(names)) or "combined"
            name = f"{stem}_all"
            if name in self.tables:
                name += "_union"
            df = self._frames[names[0]]
            for n in names[1:]:
                df = df.unionByName(self._frames[n])
            self.register(name, df, "", "union", names, {c.name: c.role for c in self.tables[names[0]].columns})
            made.append(name)
        return made

    def date_columns(self) -> dict[str, str]:
        """The first date column of every table that has one."""
        return {n: next(c.name for c in t.columns if c.role == "date") for n, t in self.tables.items() if any(c.role == "date" for c in t.columns)}

    def roles(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for t in self.tables.values():
            for c in t.columns:
                out.setdefault(c.name, c.role)
        return out

    def render(self) -> str:
        """The schema as text: cleaned views first, members of a union left to it, value hints."""
        hidden = {m for t in self.tables.values() if t.kind == "union" for m in t.members}
        hidden |= {n.removesuffix("_clean") for n in self.tables if n.endswith("_clean")}
        lines = []
        for n in sorted((n for n in self.tables if n not in hidden), key=lambda n: (not n.endswith("_clean"), n)):
            t = self.tables[n]
            lines.append(f"{n} ({t.n_rows} rows)" + (f", over {len(t.members)} tables" if t.members else ""))
            for c in t.columns:
                hint, used = [], 0
                for v in c.values:
                    used += len(v) + 2
                    if used > HINT_LENGTH and hint:
                        hint.append("…")
                        break
                    hint.append(v)
                span = f" {c.lo} .. {c.hi}" if c.lo or c.hi else ""
                lines.append(f"  {c.name} {c.type} [{c.role}]{span}" + (f": {', '.join(hint)}" if hint else ""))
        return "\n".join(lines)
