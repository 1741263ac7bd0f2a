"""The facade: tables, search, index, quality, cleaning, insight and dashboards of one session."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession

from sheafline.catalog import Catalog
from sheafline.guard import Result, run_sql
from sheafline.operators import ann, deep, explore, incremental, insight, present, quality, retrieval
from sheafline.sources import files, sheets


class Engine:
    """Engine(spark).tables.import_file(path), .sql(query), .search.bm25(...), .clean.propose(...)"""

    def __init__(self, spark: SparkSession):
        self.spark, self.catalog = spark, Catalog(spark)
        self.tables = SimpleNamespace(import_file=self.import_file, profile=lambda n: self.catalog.tables[n], unions=self.catalog.build_unions, schema=self.catalog.render)
        self.search = SimpleNamespace(bm25=retrieval.bm25, dense=retrieval.dense, hybrid=deep.search, deep=deep.deep_search)
        self.ann = SimpleNamespace(build=ann.build, search=ann.search, write=ann.write_index, read=ann.read_index)
        self.quality = SimpleNamespace(scan=quality.scan)
        self.clean = SimpleNamespace(propose=quality.propose, apply=self.apply_rules, impact=quality.clean_impact)
        self.insight = SimpleNamespace(trend=insight.trend, movement=insight.movement, rates=insight.outlier_rate, ranking=insight.ranking, momentum=insight.momentum, gaps=lambda n, **kw: explore.gaps(self.catalog, n, **kw), evidence=lambda n, **kw: explore.evidence(self.catalog, n, **kw))
        self.dash = present.Dashboards(spark)
        self.index = SimpleNamespace(walk=lambda root: files.walk(spark, root), changes=incremental.changes, store=lambda root, **kw: incremental.MerkleStore(spark, root, **kw))

    def import_file(self, path: str) -> list[str]:
        """Loads a CSV file or every table of a workbook; tables of the same file are replaced."""
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        got = sheets.read_xlsx(self.spark, path) if path.lower().endswith(".xlsx") else [sheets.read_csv(self.spark, path)]
        names = sheets.identifiers([stem if len(got) == 1 else f"{stem}_{p.sheet}" for _, p in got], "table")
        return self.catalog.replace_source(path, {n: df for n, (df, _) in zip(names, got)})

    def sql(self, query: str, limit: int = 200, timeout: float = 20.0) -> Result:
        return run_sql(self.spark, query, limit, timeout)

    def chart(self, query: str, **kw) -> present.Chart:
        return present.infer_chart(self.sql(query, **kw), self.catalog.roles())

    def apply_rules(self, name: str, rules: list[quality.Rule]) -> DataFrame:
        """Registers the cleaned view of a table beside it."""
        df = quality.clean(self.catalog.frame(name), rules)
        self.catalog.register(f"{name}_clean", df, kind="view")
        return df
