"""Quality, insight, retrieval, chunking, ANN, store and streaming operators on small fixtures."""

import math
import random
import sqlite3

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sheafline.functions import text as t
from sheafline.operators import ann, chunking, insight, locate, quality, retrieval, store
from sheafline.streaming import ingest


@pytest.fixture(scope="module")
def tickets(spark):
    r = random.Random(11)
    rows = []
    for i in range(400):
        region = ("North", "South", "East")[i % 3]
        bad = (i // 3) % 4 == 0 if region == "South" else i % 97 == 0
        rows.append((f"T{i:04d}", f"2025-{9 + i % 4:02d}-{1 + i % 28:02d}", region, ("Acme & Co", "ACME and Co.")[i % 2], "Rejected" if bad else "Approved", float(r.randint(1, 900)), r.uniform(50, 5000), 0 if i % 3 else 1 + i % 4, "" if i % 5 == 0 else "x"))
    rows.append(("T9999", "2031-01-01", "North", "Acme & Co", "Approved", 9_999_999_999.0, 100.0, 0, None))
    return spark.createDataFrame(rows, "id string, closed string, region string, dealer string, status string, hours double, amount double, units long, note string").withColumn("closed", F.to_timestamp("closed")).cache()


def test_findings_and_their_absence(tickets):
    assert quality.outlier(tickets, "hours").first().severity == "high"
    assert quality.outlier(tickets, "amount").first() is None
    assert quality.sentinel(tickets, "units").first().detail == "0.0"
    assert quality.future_date(tickets, "closed", "2026-01-01").first().n == 1
    assert [r.same_as for r in quality.near_labels(tickets, "dealer").collect()] == ["Acme & Co"]
    assert quality.constant(tickets.limit(5), "region").first() is None
    assert {r["column"]: r.severity for r in quality.nulls(tickets, ["note", "id"]).collect()} == {"note": "low"}
    assert quality.nulls(tickets.limit(0), ["note"]).count() == 0 and quality.outlier(tickets.limit(0), "hours").count() == 0


def test_clean_round_trip(tickets):
    rules = quality.propose(tickets, ["dealer", "note"], ["hours", "units"], ["closed"], "2026-01-01")
    assert {r.kind for r in rules} == {"blank_to_null", "map_value", "null_sentinel", "null_outlier", "null_future"}
    c = quality.clean(tickets, rules)
    assert quality.outlier(c, "hours").first() is None and c.select("dealer").distinct().count() == 1
    imp = {r["column"]: r for r in quality.clean_impact(tickets, rules).collect()}
    assert (imp["hours"].changed, imp["dealer"].distinct_before, imp["dealer"].distinct_after) == (1, 2, 1)
    assert tickets.where("hours > 1e9").count() == 1  # the data itself is untouched


def test_rate_and_ranking(tickets):
    r = insight.outlier_rate(tickets, "region", F.col("status") == "Rejected").first()
    assert r.segment == "South" and r.z > 3
    top = insight.ranking(tickets, "region", "sum(amount)").collect()
    assert [x.place for x in top] == [1, 2, 3] and math.isclose(sum(x.share for x in top), 100, abs_tol=0.01)
    assert insight.ranking(tickets.limit(0), "region", "sum(amount)").count() == 0


def test_benchmark_per_record(spark):
    rows = [(s, v) for s, v, n in (("a", 10.0, 100), ("b", 9.5, 100), ("c", 9.0, 100), ("d", 7.5, 1000)) for _ in range(n)]
    got = insight.benchmark(spark.createDataFrame(rows, "s string, v double"), "s", "sum(v)").collect()
    assert {r.segment: (r.benchmark, r.gain) for r in got} == {"c": (10.0, 100.0), "d": (10.0, 2500.0)}


def test_trend_uses_complete_months(spark):
    d = spark.createDataFrame([(f"2025-{m:02d}-05", float(m)) for m in (1, 2, 3, 5) for _ in range(m)], "d string, v double").withColumn("d", F.to_timestamp("d"))
    r = {x.measure: x for x in insight.trend(d, "d", {"v": "sum(v)"}).collect()}
    assert (r["records"].month, r["records"].value, r["records"].before, r["records"].pct) == ("2025-03", 3.0, 2.0, 50.0)


def test_bm25_is_that_of_fts5(spark):
    docs = [(1, "the pump housing leaks"), (2, "pump pump housing"), (3, "a quiet gasket"), (4, "the housing of the pump and the gasket"), (5, None)]
    got = {r.doc: r.score for r in retrieval.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, ["pump", "gasket"])], "qid long, terms array<string>")).collect()}
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table f using fts5(t)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text search in this SQLite")
    db.executemany("insert into f(rowid, t) values (?, ?)", [(i, x or "") for i, x in docs])
    want = {i: -s for i, s in db.execute("select rowid, bm25(f) from f where f match 'pump OR gasket'")}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-8) for k in want)


def test_scope_comes_before_ranks(spark):
    d = spark.createDataFrame([(i, "pump " * (10 - i) + "x" * i) for i in range(9)], "doc_id long, text string")
    q = spark.createDataFrame([(1, ["pump"])], "qid long, terms array<string>")
    assert retrieval.bm25(d, q, k=2, scope=d.where("doc_id >= 5").select("doc_id")).count() == 2


def test_neighbours_context_and_turns(spark):
    chunks = spark.createDataFrame([(1, i, f"t{i}", f"p{i}") for i in range(6)], "file_id long, ord long, text string, loc string")
    hits = spark.createDataFrame([(1, 1, 1, 0.5), (1, 1, 2, 0.9), (1, 1, 5, 0.1)], "qid long, file_id long, ord long, score double")
    got = [tuple(r) for r in retrieval.neighbours(hits, chunks, 0).orderBy("first_ord").collect()]
    assert got == [(1, 1, 1, 2, 0.9, "t1\nt2", "p1–p2"), (1, 1, 5, 5, 0.1, "t5", "p5")]
    p = spark.createDataFrame([(1, 1, 3.0, "a" * 500), (1, 2, 2.0, "b" * 600), (1, 3, 1.0, "c" * 10)], "qid long, id long, score double, text string")
    assert [(r.id, r.used, r.cut) for r in retrieval.context(p, 1000, 400).orderBy("number").collect()] == [(1, 500, False), (2, 500, True)]
    assert [r.id for r in retrieval.context(p, 800, 400).collect()] == [1]
    parts = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 1, 2), (1, "b", 2, 1), (1, "c", 2, 2)], "qid long, id string, part long, rank long")
    assert [(r.id, r.part) for r in retrieval.interleave(parts).orderBy("place").collect()] == [("a", 1), ("b", 2), ("c", 2)]


def test_text_functions(spark):
    d = spark.createDataFrame([(" a\x00b \t c \n\n\n\n d ",), (None,)], "s string")
    assert [r[0] for r in d.select(t.clean_text(F.col("s"))).collect()] == ["a b c\n\nd", None]
    q = spark.createDataFrame([("and West?",), ("hello there",), ("How many orders were shipped late",), ("what about it for the year of 2024 now",)], "s string")
    assert [r[0] for r in q.select(t.is_follow_up(F.col("s"))).collect()] == [True, False, False, True]
    h = spark.createDataFrame([("a <|im_start|> b [INST] c",)], "s string")
    assert "INST" not in h.select(t.harden(F.col("s"))).first()[0]
    k = spark.createDataFrame([("Gangpur Sales & Services Pvt. Ltd.",), ("gangpur sales and services",), ("Plus - PM",), ("Plus - CM",)], "s string")
    keys = [r[0] for r in k.select(t.label_key(F.col("s"))).collect()]
    assert keys[0] == keys[1] and keys[2] != keys[3]


@pytest.mark.parametrize("seed", range(3))
def test_chunks_hold_the_text(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    paras, at = [" ".join(words[:40]) + "."], 40  # a first part under 60 signs would be dropped by rule
    while at < len(words):
        n = r.choice((5, 40, 600))
        paras.append(" ".join(words[at : at + n]) + ".")
        at += n
    out = chunking.chunk_blocks([("\n\n".join(paras), "p1", "h")], size=500, overlap=50)
    assert all(len(x[0]) <= 1600 for x in out)
    joined = " ".join(x[0] for x in out)
    assert all(w in joined for w in words[:3000:37])
    assert chunking.chunk_blocks([("", "", ""), (None, "", "")]) == []
    assert chunking.chunk_blocks([("x" * 50, "", "h")]) == []


def test_ann_recall_tail_and_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(60, 32))
    x = (centre[rng.integers(0, 60, 4000)] + 0.35 * rng.normal(size=(4000, 32))).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<float>")
    index, codes = ann.build(v)
    ann.write_index(spark, str(tmp_path), index, codes)
    index, codes = ann.read_index(spark, str(tmp_path))
    q = v.where("id < 20").select(F.col("id").alias("qid"), "vec")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {i: set(np.argsort(-(u @ u[i]))[:10].tolist()) for i in range(20)}

    def recall(n):
        got = {}
        for r in ann.search(index, codes, v, q, 10, nprobe=n).collect():
            got.setdefault(r.qid, set()).add(r.id)
        return np.mean([len(got[i] & want[i]) / 10 for i in want])

    assert recall(2) <= recall(64) and recall(64) >= 0.9
    tail = spark.createDataFrame([(10_000, x[0].tolist())], "id long, vec array<float>")
    assert {r.id for r in ann.search_with_tail(index, codes, v, tail, q.where("qid = 0"), 2).collect()} == {0, 10_000}
    assert ann.cells_for(2_000_000) == 5656 and ann.slices_for(384) == 32 and ann.probes_for(10_000) == 200


def test_ann_is_exact_below_the_bound_and_calibrated_above(spark, monkeypatch):
    """Vectors without clusters, which few cells cannot hold."""
    x = np.random.default_rng(1).normal(size=(6000, 24)).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<float>")
    q = v.where("id % 300 = 0").select(F.col("id").alias("qid"), "vec")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {i: set(np.argsort(-(u @ u[i]))[:10].tolist()) for i in range(0, 6000, 300)}

    def recall(rows):
        return np.mean([r.id in want[r.qid] for r in rows])

    index, codes = ann.build(v, cells=100)
    got = ann.search(index, codes, v, q, 10).collect()
    assert len(got) == 200 and recall(got) == 1.0
    assert recall(ann.find(v, q, 10).collect()) == 1.0
    monkeypatch.setattr(ann, "EXACT_BELOW", 5000)
    monkeypatch.setattr(ann, "LEAST_PROBES", 2)
    monkeypatch.setattr(ann, "LEAST_SHORTLIST", 20)
    assert recall(ann.search(index, codes, v, q, 10, nprobe=2, shortlist=80).collect()) < 0.9
    index, codes = ann.build(v, cells=100)
    assert 2 < index.nprobe <= 100 and ann.IvfPq.load(index.dump()).shortlist == index.shortlist >= 20
    assert recall(ann.search(index, codes, v, q, 10).collect()) >= 0.88  # 200 neighbours only


def test_ann_takes_every_fiftieth_query_in_blocks(spark):
    from sheafline.plans.relational import QUERIES

    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)], "id long, vec array<float>")
    q = v.selectExpr("id as qid", "vec")
    assert sorted(map(tuple, ann.find(v, q, 3, block=100).collect())) == sorted(map(tuple, ann.find(v, q, 3).collect()))
    got = QUERIES["ann_search"](spark, "/root/testdata/sf0.001").collect()
    assert {r.qid for r in got} == set(range(0, 500, 50)) and len(got) == 100


def test_near_labels_of_many(spark):
    rows = [(f"Dealer {i}",) for i in range(500) for _ in range(2)] + [("DEALER 7 Ltd",), ("the dealer 499",)]
    got = {(r.label, r.same_as) for r in quality.near_labels(spark.createDataFrame(rows, "dealer string"), "dealer").collect()}
    assert got == {("DEALER 7 Ltd", "Dealer 7"), ("the dealer 499", "Dealer 499")}


def test_locate():
    assert locate.asks_where("where is the turnover report") and not locate.asks_where("where does the report say the deadline is")
    assert locate.score("open turnover report.xlsx", "turnover report.xlsx") == 1.0
    assert locate.score("find pqi", "Process Quality Index.xlsx") == 0.9
    assert locate.score("the turnover pdf", "turnover.xlsx") < locate.PLAUSIBLE
    assert locate.score("unrelated words here", "turnover report.xlsx") == 0.0


def test_locate_more_questions_than_a_block(spark):
    f = spark.createDataFrame([(1, "turnover report.xlsx"), (2, "pump 7 manual.pdf"), (3, None)], "id long, name string")
    q = spark.range(10_050).select(F.col("id").alias("qid"), F.expr("if(id % 2 = 0, 'where is the turnover report', 'find pump manual')").alias("question"))
    got = locate.locate(f, q).collect()
    assert sorted((r.qid, r.id, r.rank) for r in got) == [(i, 1 + i % 2, 1) for i in range(10_050)]
    assert locate.locate(f, q.limit(0)).count() == 0


def test_locate_finds_every_name_that_scores():
    r = random.Random(5)
    words = "report port porch qui q q3 2024 20 2 turnover process quality index notes xlsx pqi pq the file über a x re".split()

    def name():
        return r.choice(" _-").join(r.choices(words, k=r.randint(1, 5))) + r.choice([".pdf", ".xlsx", ".txt", ""])

    names = [name() for _ in range(300)]
    asked = [f"where is the file {name()}{r.choice(['', ' 2024 2024', ' pdf'])}" for _ in range(80)] + [None, "", "re", "q", "pq"]
    questions = locate._Questions(asked)
    best = {}
    run = locate._finder([Row(qid=n, question=t) for n, t in enumerate(asked)], 4, 0.3)
    for pdf in run(iter([pd.DataFrame({"id": range(300), "name": names})])):
        for x in pdf.itertuples(index=False):
            best.setdefault(x.qid, []).append((-x.score, x.name, x.id))
    for n, t in enumerate(asked):
        want = [(-s, name, i) for i, name in enumerate(names) if (s := locate.score(t, name)) >= 0.3]
        assert all(n in questions.near(locate._named(name)) for _, name, _ in want)
        assert sorted(best.get(n, [])) == sorted(want)[:4]


def test_store(spark):
    a = spark.createDataFrame([(1, "f1", "a"), (2, "f1", "b"), (3, "f2", "c")], "id long, f string, t string")
    assert sorted(r.t for r in store.upsert(a, spark.createDataFrame([(9, "f1", "new")], a.schema), "f").collect()) == ["c", "new"]
    v = spark.createDataFrame([(i, [float(i)]) for i in (0, 3, 5, 9000)], "vec_row long, vec array<float>")
    c = spark.createDataFrame([(1, 5), (2, 9000), (3, -1), (4, 0)], "id long, vec_row long")
    nv, nc = store.compact(v, c)
    assert sorted((r.vec_row, r.vec[0]) for r in nv.collect()) == [(0, 0.0), (1, 5.0), (2, 9000.0)]
    assert {r.id: r.vec_row for r in nc.collect()} == {1: 1, 2: 2, 3: -1, 4: 0}
    assert store.needs_compaction(12, 25) and not store.needs_compaction(20, 25) and not store.needs_compaction(0, 0)


def test_streaming_takes_each_file_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k long, t string, v long").coalesce(1).write.parquet(src)
    run = lambda: ingest.ingest(spark, src, "k long, t string, v long", cp, ingest.merge_by_key(out, "k", "v"))
    run()
    spark.createDataFrame([(2, "b2", 2), (3, "c", 1)], "k long, t string, v long").coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    assert sorted((r.k, r.t) for r in ingest.current(spark, out, "k", "v").collect()) == [(1, "a"), (2, "b2"), (3, "c")]


def test_stored_index_and_dense_blocks(spark, tmp_path):
    import numpy as np
    from sheafline.operators import retrieval as r

    rng = np.random.default_rng(1)
    d = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 60, 20))) for i in range(200)] + [(900, None), (901, "")], "doc_id long, text string")
    q = spark.createDataFrame([(i, [f"w{x}" for x in rng.integers(0, 60, 4)]) for i in range(30)], "qid long, terms array<string>")
    r.invert(d, root=str(tmp_path / "i"))
    index = r.open_inverted(spark, str(tmp_path / "i"))
    a, b = (sorted(map(tuple, r.bm25(x, q, 5).select("qid", "doc", "score", "rank").collect())) for x in (d, index))
    assert a == b and len(a) == 150
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[5] = x[9] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0])]
    v = spark.createDataFrame(rows, "doc long, vec array<float>").repartition(5)
    qs = v.where("doc % 7 = 0").selectExpr("doc as qid", "vec")
    got = [sorted(map(tuple, r.dense(v, qs, 4, at_once=n).collect())) for n in (10_000, 9)]
    assert got[0] == got[1]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for qid in range(0, 300, 7):
        s = np.round(u @ u[qid], 9)
        want = sorted(range(300), key=lambda i: (-s[i], i))[:4]
        assert [t[1] for t in sorted((t for t in got[0] if t[0] == qid), key=lambda t: t[3])] == want
    assert r.dense(v.limit(0), qs, 4).count() == 0 and r.dense(v, qs.limit(0), 4).count() == 0


def test_short_turns_fold_by_meaning(spark):
    from sheafline.operators import retrieval as r
    from sheafline.operators.deep import hashing_embedder

    t = spark.createDataFrame([(1, 0, "user", "pump housing price list of the north site"), (1, 1, "user", "pump housing price list"), (1, 2, "user", "quarterly revenue of trucks"), (1, 3, "user", "and what does it say"), (1, 4, "user", "thanks"), (1, 5, "user", None)], "conv_id long, turn long, role string, text string")
    got = {x.turn: x.query for x in r.fold_history(t, hashing_embedder(256)).collect()}
    assert got[1].startswith("pump housing price list of") and got[2] == "quarterly revenue of trucks" and got[3].startswith("quarterly") and got[4] == "thanks" and got[5] is None


def test_an_index_is_published_without_a_gap(spark, tmp_path):
    import numpy as np
    from sheafline.operators import ann

    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(np.random.default_rng(0).normal(size=(400, 16)).astype(np.float32))], "id long, vec array<float>")
    index, codes = ann.build(v, cells=8)
    root = str(tmp_path / "ix")
    ann.write_index(spark, root, index, codes)
    first = [p.name for p in (tmp_path / "ix").glob("CURRENT-*")]
    ann.write_index(spark, root, index, codes)
    assert first == ["CURRENT-1"] and [p.name for p in (tmp_path / "ix").glob("CURRENT-*")] == ["CURRENT-2"]
    (tmp_path / "ix" / "CURRENT-3").write_text("")  # its writer died
    assert ann.read_index(spark, root)[1].count() == 400


def test_scan_finds_every_kind(spark):
    from sheafline.operators import quality

    rows = [(f"id{i if i else 1}", f"2025-0{1 + i % 9}-01", "Acme Ltd" if i % 9 else "ACME", 5.0, "s") for i in range(60)]
    d = spark.createDataFrame(rows, "tid string, day string, dealer string, hours double, src string").selectExpr("tid", "cast(day as date) as day", "dealer", "hours", "src")
    got = {(r.check, r.column) for r in quality.scan(d, ["hours"], ["day"], None, "2025-06-30", labels=["dealer"], ids=["tid"], source="src").collect()}
    assert got == {("constant", "hours"), ("constant", "src"), ("near_duplicate", "dealer"), ("duplicate_id", "tid"), ("date_spread", "day"), ("future_date", "day")}


def test_joins_on_order(spark):
    import datetime as dt

    from sheafline.operators import joins

    def at(h, m=0):
        return dt.datetime(2025, 1, 1 + h // 24, h % 24, m, tzinfo=dt.UTC)

    L = spark.createDataFrame([(1, "a", at(5)), (2, "a", at(30)), (3, "a", at(80)), (4, "b", at(5)), (5, None, at(5)), (6, "a", None), (7, "a", at(1))], "id long, k string, t timestamp")
    R = spark.createDataFrame([("a", at(2), 10), ("a", at(2), 11), ("a", at(29), 12), ("a", at(31), 13), ("c", at(1), 14), (None, at(1), 15), ("a", None, 16)], "k string, t timestamp, v long")
    for width in (3600.0, 86_400.0, 1e9):
        assert {r.id: r.v for r in joins.asof(L, R, "t", "k", "v", width).collect()} == {1: 11, 2: 12, 3: 13, 4: None, 5: None, 6: None, 7: None}
    assert joins.asof(L.limit(0), R, "t", "k", "v").count() == 0 and joins.asof(L, R.limit(0), "t", "k", "v").where("v is not null").count() == 0
    S = spark.createDataFrame([(1, at(4), at(6)), (2, at(5), at(90)), (3, at(6), at(6)), (4, None, at(6)), (5, at(80), at(80, 1))], "sid long, a timestamp, b timestamp")
    for width in (1800.0, 86_400.0):
        assert sorted((r.id, r.sid) for r in joins.within(L.select("id", "t"), S, "t", "a", "b", width).collect()) == [(1, 1), (1, 2), (2, 2), (3, 2), (3, 5), (4, 1), (4, 2), (5, 1), (5, 2)]


def test_files_by_initials_and_by_contents(spark):
    from sheafline.operators import locate

    f = spark.createDataFrame([(1, "Process Quality Index Kagal.xlsx", "/lib/q/Process Quality Index Kagal.xlsx"), (2, "AK_Analysis.xlsx", "/lib/AK_Analysis.xlsx"), (3, "260621 RAMS Study V2.pdf", "/lib/r/260621 RAMS Study V2.pdf"), (4, "roadmap.pptx", "/lib/roadmap.pptx")], "id long, name string, path string")
    c = spark.createDataFrame([(3, "The reliability of the gas engine over ten years."), (3, "More on engine parts."), (4, "Plans for the year."), (1, None)], "id long, text string")
    q = spark.createDataFrame([(1, "where is my PQI spreadsheet"), (2, "where is the AK analysis file"), (3, "locate the file about gas engine reliability"), (4, "where is the roadmap"), (5, "where is zzz")], "qid long, question string")
    got = {(r.qid, r.rank): (r.id, r.how) for r in locate.locate_any(f, c, q).collect()}
    assert got[1, 1] == (1, "name") and got[2, 1] == (2, "name") and got[3, 1] == (3, "content") and got[4, 1] == (4, "name") and (5, 1) not in got
    assert locate.steps("/data/lib/q/x.pdf", "/data/lib") == ["lib", "q", "x.pdf"] and locate.steps("a\\b.txt") == ["a", "b.txt"]
    text = locate.answer([{"name": "report[final].pdf", "path": "/lib/r/report[final].pdf", "score": 1.0, "how": "name"}, {"name": "o", "path": "/lib/o", "score": 0.5}], "/lib")
    assert "is in:" in text and "P1[r]" in text and "P2((report(final).pdf))" in text and "- `/lib/o`" in text and locate.answer([]) == ""


def test_plans_are_kept_for_measured_gaps_only():
    import json

    from sheafline.operators import explore

    g = {"table": "t", "dimension": "dealer", "measure": "total", "severity": "high", "prize": 1200.0, "laggards": [{"segment": "A", "rate": 5.0, "benchmark": 10.0, "behind_pct": 50.0, "records": 240}]}
    assert "A at 5.00 (50 % behind, 240 records)" in explore.brief([g]) and explore.brief([]) == "No measurable gap was found."
    seen = []

    def model(text):
        seen.append(text)
        return "```json\n" + json.dumps({"t.dealer.total": {"why": "w" * 900, "actions": "look"}, "made.up.id": {"why": "x"}}) + "\n```"

    got = explore.plan([g], model)
    assert list(got) == ["t.dealer.total"] and len(got["t.dealer.total"]["why"]) == 400 and got["t.dealer.total"]["actions"] == ["look"]
    assert explore.plan([g], lambda t: "no json") == {} and explore.plan([g], lambda t: 1 / 0) == {} and explore.plan([], model) == {} and len(seen) == 1


def test_answers_name_what_they_rest_on(spark):
    from sheafline.catalog import Catalog
    from sheafline.guard import run_sql
    from sheafline.operators import present

    cat = Catalog(spark)
    cat.register("pk_orders", spark.createDataFrame([(i, float(i)) for i in range(30)], "order_id long, total double"))
    cat.register("pk_other", spark.createDataFrame([(1,)], "x long"))
    sql = "select order_id, total from pk_orders where total < 2"
    got = present.packaged(sql, run_sql(spark, sql), cat, "nothing on returns")
    assert got["tables"] == ["pk_orders"] and got["scanned"] == 30 and got["id_columns"] == ["order_id"] and got["rows"] == 2 and "| order_id |" in got["text"] and got["missing"]


def test_one_bad_file_keeps_no_other_back(spark, tmp_path):
    from sheafline.streaming import ingest, progress

    (tmp_path / "in").mkdir()
    for i in range(3):
        spark.createDataFrame([(f"f{i}", "bad" if i == 1 else f"text {i}")], "path string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def process(rows):
        return rows.selectExpr("path", "if(text = 'bad', raise_error('cannot be read'), text) as text")

    watch = progress.Watch()
    spark.streams.addListener(watch)
    merge = ingest.one_by_one(process, str(tmp_path / "out"), "path", str(tmp_path / "failed"))
    q = ingest.ingest(spark, str(tmp_path / "in"), "path string, text string", str(tmp_path / "cp"), merge)
    assert {r.path for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"f0", "f2"}
    bad = spark.read.parquet(str(tmp_path / "failed")).collect()
    assert [r.path for r in bad] == ["f1"] and "cannot be read" in bad[0].error
    import time

    for _ in range(50):
        if watch.rows(q.id) >= 3:
            break
        time.sleep(0.1)
    spark.streams.removeListener(watch)
    assert watch.rows(q.id) >= 3
