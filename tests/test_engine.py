"""The facade end to end, semantics, pictures, progress, deep retrieval helpers."""

import random

from pyspark.sql import functions as F

from sheafline import semantics
from sheafline.engine import Engine
from sheafline.operators import deep, explore
from sheafline.sources import ocr
from sheafline.streaming.progress import Meter

YAML = """
domain: service
tables:
  tickets:
    grain: one row per ticket
    outcomes: [{column: status, good: [Approved], bad: [Rejected]}]
    metrics: [{name: mean_amount, sql: avg(amount), direction: lower is better}]
    glossary: [{term: BD, means: breakdown, also: [stoppage]}]
  broken: {metrics: [{name: x}]}
"""


def test_semantics(spark):
    t, problems = semantics.parse(YAML)
    assert list(t) == ["tickets"] and len(problems) == 1 and t["tickets"].metrics[0].higher_is_better is False
    assert semantics.status(t, ["tickets", "x"]) == {"described": ["tickets"], "missing_tables": [], "undescribed": ["x"]}
    assert ("bd", "breakdown") in {(r.term, r.alternative) for r in semantics.glossary_frame(spark, t).collect()}
    assert semantics.parse("a: [")[1]
    merged = semantics.merge_text("# mine\ntables:\n  a:\n    grain: x\n  b:\n    grain: y\n", "a", "grain: z")
    assert merged.startswith("# mine") and "grain: z" in merged and "grain: y" in merged and "grain: x" not in merged
    assert "  c:\n    grain: n" in semantics.merge_text(merged, "c", "grain: n")


def test_engine(spark, tmp_path):
    r = random.Random(5)
    rows = ["Ticket ID,Closed Date,Region,Status,Amount"]
    for i in range(240):
        region = ("North", "South", "East", "West")[i % 4]
        rows.append(f"T{i:04d},2025-{1 + i % 6:02d}-{1 + i % 27:02d},{region},{'Rejected' if region == 'South' and i % 8 < 6 else 'Approved'},{(50 if region == 'West' else 100) + r.random():.2f}")
    (tmp_path / "tickets.csv").write_text("\n".join(rows))
    e = Engine(spark)
    assert e.tables.import_file(str(tmp_path / "tickets.csv")) == ["tickets"]
    assert e.tables.import_file(str(tmp_path / "tickets.csv")) == ["tickets"]
    assert e.sql("select count(*) as n from tickets").rows == [[240]]
    assert e.chart("select region, sum(amount) as s from tickets group by region").kind == "bar"
    g = e.insight.gaps("tickets")
    assert g and g[0]["dimension"] == "region" and [x["segment"] for x in g[0]["laggards"]] == ["West"]
    ev = e.insight.evidence("tickets")
    assert any(s["kind"] == "outlier_rate" and s["segment"] == "South" for s in ev["signals"]) and ev["ranking"]
    assert explore.worst_value(next(c for c in e.catalog.tables["tickets"].columns if c.name == "status")) == "Rejected"
    e.clean.apply("tickets", [])
    assert "tickets_clean" in e.catalog.tables and e.tables.schema().startswith("tickets_clean")


def test_pictures():
    box = lambda x, y, t: ([(x, y), (x + 10, y), (x + 10, y + 10), (x, y + 10)], t)
    assert ocr.layout([box(50, 3, "7,50"), box(0, 0, "Total:"), box(0, 20, "Thanks")]) == "Total: 7,50\nThanks"
    assert ocr.layout([]) == "" and ocr.denoise("--- ** !! ..") == "" and ocr.denoise("a  real   line") == "a real line"
    assert ocr.scaled(50, 500) is None and ocr.scaled(4000, 4000) == (2000, 2000)
    p = ocr.PictureReader(lambda b: [box(0, 0, "some words here")])
    assert p.read(b"x") == "some words here" and p.read(b"x") == ""


def test_meter():
    now = [0.0]
    m = Meter(lambda: now[0])
    m.announce(".pdf", 10, 1000)
    assert m.snapshot()["eta"] is None
    for _ in range(10):
        now[0] += 1
        m.complete(".pdf", 100, 1.0)
        s = m.snapshot()
    assert s["eta"] == 0.0 and s["percent"] == 100.0
    m.announce(".new", 1, 100)
    assert m.weight(".new") == m.weight(".pdf")


def test_lists_of_a_model():
    assert deep.read_list('```json\n["a one", "b two"]\n```') == ["a one", "b two"]
    assert deep.read_list('["first item", "second it') == ["first item"]
    assert deep.read_list("Here you go:\n1. first item\n- second item") == ["first item", "second item"]
    assert deep.parts_of("What is A?", '["What is A", "how is B built", "how is C built"]') == ["how is B built", "how is C built"]
    assert deep.parts_of("x", '["only one part here"]') == []
    assert deep.rewrites_of("Q", ["q", "r", "R", "s", "t", "u"]) == ["r", "s", "t"]


def test_search_with_injected_models(spark):
    docs = spark.createDataFrame([(1, "the pump housing leaks oil"), (2, "gasket and seal prices"), (3, "pump maintenance plan")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "pump housing leak")], "qid long, question string")
    e = deep.hashing_embedder()
    v = deep.embed(docs, "text", e).select(F.col("doc_id").alias("doc"), "vec")
    assert [r.doc for r in deep.search(q, docs, v, e, top=2).orderBy("rank").collect()][0] == 1
    r = deep.search(q, docs, top=3, scorer=lambda a, b: -len(b)).orderBy("rank").collect()
    assert r[0].doc == 3
    parts = spark.createDataFrame([(1, 0, "pump housing"), (1, 1, "gasket prices")], "qid long, part long, question string")
    d = deep.deep_search(parts, docs)
    assert {x.id for x in d.collect()} == {1, 2, 3} and {x.part: x.hits for x in deep.coverage(d).collect()} == {0: 2, 1: 1}


def test_investigate_export_and_clustering(spark, tmp_path):
    from sheafline.guard import Result
    from sheafline.operators import present, store

    replies = iter([{"sql": "drop table x"}, {"sql": "select 1 as n"}, {"report": "done"}])
    got = explore.investigate(spark, "why?", lambda m: next(replies), "schema")
    assert got["report"] == "done" and [s["ok"] for s in got["steps"]] == [False, True]
    assert explore.investigate(spark, "why?", lambda m: {"sql": "select 1"}, "s", steps=2)["report"] == ""
    assert present.export_html(Result(["a"], [["<x>"], [None]])) == "<table><tr><th>a</th></tr><tr><td>&lt;x&gt;</td></tr><tr><td></td></tr></table>"
    df = spark.range(100).selectExpr("id % 10 as k", "id as v")
    present.export_csv(df.limit(3), str(tmp_path / "c"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == 3
    store.clustered(df, ["k"], 4).write.parquet(str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("k = 3").count() == 10


def test_only_peers_are_benchmarked():
    from sheafline.catalog import ColumnInfo

    def kind(name, *values):
        return explore.peers(ColumnInfo(**{**{f: None for f in ColumnInfo.__dataclass_fields__}, "name": name, "values": list(values)}))

    assert kind("dealer") == "peer" and kind("sales_region", "North", "South") == "peer"
    assert kind("claim_status", "Approved") == "state" and kind("plant_type") == "state"
    assert kind("step", "Approved", "Rejected by", "x", "y") == "state" and kind("dealer", "Open", "Closed") == "state"
    assert kind("product", "A", "B") == "maybe" and kind("colour", "newish", "noble") == "maybe"


def test_failure_words_are_tried_in_order():
    from sheafline.catalog import ColumnInfo

    def worst(*values):
        return explore.worst_value(ColumnInfo(**{**{f: None for f in ColumnInfo.__dataclass_fields__}, "name": "s", "values": list(values)}))

    assert worst("Pending", "Rejected") == "Rejected" and worst("active", "Churned") == "Churned" and worst("ok", "In arrears") == "In arrears" and worst("ok", "fine") is None
