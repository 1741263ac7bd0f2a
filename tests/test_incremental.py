"""p5: what the next run must do, and publishing output and tree together."""

import datetime as dt

import pytest

from sheafline.operators import incremental as inc

FILES = "path string, size long, mtime double, hash string, indexed_at double, status string"
LOG = "path string, size long, mtime double, hash string, outcome string, logged_at timestamp"
SCAN = "path string, size long, mtime double, hash string, seen_at timestamp"
T = [dt.datetime(2025, 12, 1, h, tzinfo=dt.UTC) for h in range(10)]


def run(spark, files, log, scan, **kw):
    got = inc.changes(spark.createDataFrame(files, FILES), spark.createDataFrame(log, LOG), spark.createDataFrame(scan, SCAN), **kw)
    return sorted(tuple(r) for r in got.collect())


def test_rules(spark):
    files = [
        ("same", 1, 10.0, "AA", 5.0, "ok"), ("noise", 1, 1764000000.25, "aa", 5.0, "ok"), ("spelt", 1, 10.0, "AB", 5.0, "ok"), ("edited", 1, 10.0, "aa", 5.0, "ok"),
        ("gone", 1, 10.0, "aa", 5.0, "ok"), ("failed", 1, 10.0, " ", 5.0, "error"), ("failed2", 1, 10.0, None, 5.0, "error"), ("later", 1, 10.0, "aa", 5.0, "ok"),
    ]
    log = [("later", 2, 20.0, "bb", "committed", T[1]), ("later", 3, 30.0, "cc", "started", T[2]), ("logonly", 1, 10.0, "aa", "committed", T[1]), ("never", 1, 10.0, "aa", "error", T[1]), ("lost", 1, 1.0, "x", "committed", T[1]), ("lost", 1, 1.0, "x", "committed", T[1])]
    scan = [
        ("same", 1, 10.0, None, T[3]), ("noise", 1, 1764000000.2500002, None, T[3]), ("spelt", 2, 11.0, "sha256:ab", T[3]), ("edited", 1, 12.0, "zz", T[3]), ("failed", 1, 10.0, "q", T[3]), ("failed2", 2, 10.0, "q", T[3]),
        ("later", 2, 20.0, None, T[3]), ("logonly", 1, 11.0, "bb", T[3]), ("never", 1, 10.0, "aa", T[3]), ("new", 9, 9.0, "n", T[3]), ("edited", 1, 10.0, "aa", T[2]), (None, 1, 1.0, "a", T[3]),
    ]
    want = [("edited", "update"), ("failed2", "update"), ("gone", "delete"), ("logonly", "update"), ("lost", "delete"), ("never", "add"), ("new", "add")]
    assert run(spark, files, log, scan) == want
    # The result does not depend on the tree's shape, and repeated rows change nothing.
    assert run(spark, files * 2, log * 2, scan * 2, levels=1, bits=2) == want


def test_empty_tables(spark):
    assert run(spark, [], [], []) == []
    assert run(spark, [("a", 1, 1.0, None, 1.0, "ok")], [], []) == [("a", "delete")]
    assert run(spark, [], [], [("a", None, None, None, T[0])]) == [("a", "add")]


def test_known_bytes_under_a_new_stamp(spark):
    """Not read by the walk, but a failed run has named these bytes: they are the committed ones."""
    got = run(spark, [("a", 1, 1.0, "h", 1.0, "ok")], [("a", 1, 2.0, "h", "error", T[1])], [("a", 1, 2.0, None, T[2])])
    assert got == []


def test_descends_only_into_changed_leaves(spark):
    a = spark.range(5000).selectExpr("cast(id as string) as path", "id as v")
    b = a.selectExpr("path", "case when path = '17' then -1 else v end as v")
    from pyspark.sql import functions as F

    t = [inc.tree(x, F.xxhash64("path", "v")) for x in (a, b)]
    assert inc.changed_leaves(*t).count() == 1
    assert inc.changed_leaves(t[0], t[0]).count() == 0


def test_store_survives_failures(spark, tmp_path):
    s = inc.MerkleStore(spark, str(tmp_path), key="k")
    v1 = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "k long, t string")
    s.run(v1, lambda d: d.selectExpr("k", "upper(t) as u"))
    v2 = v1.where("k <> 3").selectExpr("k", "case when k = 7 then 'changed' else t end as t").unionByName(spark.createDataFrame([(99, None)], "k long, t string"))
    want = [(3, "delete"), (7, "update"), (99, "add")]
    assert sorted(map(tuple, s.diff(v2).collect())) == want

    def broken(d):
        raise RuntimeError("the run dies")

    with pytest.raises(RuntimeError):
        s.run(v2, broken)
    assert sorted(map(tuple, s.diff(v2).collect())) == want  # nothing skipped
    at = s.run(v2, lambda d: d.selectExpr("k", "upper(t) as u"))
    assert sorted(r.k for r in spark.read.parquet(f"{at}/output").collect()) == [7, 99]  # nothing repeated
    assert s.diff(v2).count() == 0


def numbered(spark, n, **changed):
    rows = spark.range(n).selectExpr("id as k", "concat('t', id) as t")
    for k, v in changed.items():
        rows = rows.selectExpr("k", f"case when k = {k[1:]} then '{v}' else t end as t")
    return rows


def test_closed_leaves_are_not_read(spark, tmp_path):
    s = inc.MerkleStore(spark, str(tmp_path), key="k")
    s.run(numbered(spark, 20_000), lambda d: d)
    m = s.manifest()
    assert m["levels"] == 2 and m["rows"] == 20_000
    v2 = numbered(spark, 20_000, k17="changed")
    assert [tuple(r) for r in s.diff(v2).collect()] == [(17, "update")]
    assert s.last_opened == 1
    now = v2.select("k", s._content(v2, "k").alias("_digest"))
    _, known = s.opened(now)
    assert known.count() < 40  # one leaf of the saved records
    assert s.diff(numbered(spark, 20_000)).count() == 0 and s.last_opened == 0


def test_a_run_writes_its_changes_only_and_they_are_merged(spark, tmp_path, monkeypatch):
    s = inc.MerkleStore(spark, str(tmp_path), key="k")
    s.run(numbered(spark, 400), lambda d: d)
    at = s.run(numbered(spark, 400, k3="x", k4="y").where("k <> 9"), lambda d: d)
    m = s.manifest()
    assert len(m["deltas"]) == 1 and spark.read.parquet(m["deltas"][0]).count() == 3 and sorted(r.k for r in spark.read.parquet(f"{at}/output").collect()) == [3, 4]
    assert s.records(m).count() == 399
    third = numbered(spark, 400, k4="z")
    assert sorted(map(tuple, s.diff(third).collect())) == [(3, "update"), (4, "update"), (9, "add")]
    monkeypatch.setattr(inc, "MOST_DELTAS", 1)
    s.run(third, lambda d: d)
    assert s.manifest()["deltas"] == [] and s.records(s.manifest()).count() == 400 and s.diff(third).count() == 0
    assert len(s.manifest()["outputs"]) == 3


def test_of_two_racing_runs_one_is_refused(spark, tmp_path):
    a, b = (inc.MerkleStore(spark, str(tmp_path), key="k") for _ in range(2))
    a.run(numbered(spark, 100), lambda d: d)

    def overtaken(d):
        b.run(numbered(spark, 100, k5="b"), lambda x: x)
        return d

    with pytest.raises(inc.Conflict):
        a.run(numbered(spark, 100, k5="a"), overtaken)
    assert a.diff(numbered(spark, 100, k5="b")).count() == 0  # b's version stands, whole
    a.run(numbered(spark, 100, k5="a"), lambda d: d)
    assert a.diff(numbered(spark, 100, k5="a")).count() == 0


def test_a_torn_pointer_is_no_version(spark, tmp_path):
    s = inc.MerkleStore(spark, str(tmp_path), key="k")
    s.run(numbered(spark, 10), lambda d: d)
    (tmp_path / "current-2").write_text("")
    assert s.manifest()["number"] == 1
    s.run(numbered(spark, 11), lambda d: d)
    assert s.manifest()["number"] == 3 and s.diff(numbered(spark, 11)).count() == 0


def test_the_saved_tree_decides(spark, tmp_path):
    """A walk is compared with what the store holds, and leaves that its tree calls equal stay closed."""
    files = spark.createDataFrame([(f"p{i}", 1, float(i), "h", 1.0, "ok") for i in range(300)], FILES)
    scan = spark.createDataFrame([(f"p{i}", 1, float(i) if i != 7 else 99.0, None, T[1]) for i in range(300)], SCAN)
    root = str(tmp_path / "s")
    assert [tuple(r) for r in inc.changes(files, spark.createDataFrame([], LOG), scan, root=root).collect()] == [("p7", "update")]
    store = inc.MerkleStore(spark, root, "path")
    assert [tuple(r) for r in inc.pending(store, scan).collect()] == [("p7", "update")] and store.last_opened == 1
    t = inc.tree(inc.latest_scan(scan), inc._stamp(inc.F.col("size"), inc.F.col("mtime")), "path", store.manifest()["levels"])
    t.write.mode("overwrite").parquet(store.manifest()["tree"])
    assert inc.pending(store, scan).count() == 0
