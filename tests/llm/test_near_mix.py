"""p3 and p9: near-duplicates against brute force, and mixes that keep their totals."""

import random
from itertools import combinations

import numpy as np
import pytest

from sheafline.llm import mix, near


def shingles(t, k):
    import re

    w = re.findall(r"[^\W_]+", (t or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def corpus(seed=0, n=250):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(60)]
        docs.append(w)
        for _ in range(r.choice((0, 0, 1, 2))):
            v = list(w)
            for _ in range(r.choice((0, 1, 2, 3, 5))):
                v[r.randrange(len(v))] = r.choice(vocab)
            if r.random() < 0.3:
                v = v[10:] + v[:10]
            docs.append(v)
    rows = [(i, i // 2, " ".join(w) if i % 7 else "  ,".join(w).upper(), "clash", 5) for i, w in enumerate(docs)]
    return [*rows, (9001, 1, None, "c", 1), (9002, 1, "", "c", 1), (9003, 1, "two words", "c", 1), (9004, None, rows[0][2], "c", 1)]


@pytest.mark.parametrize("k,threshold", [(3, 0.7), (5, 0.8)])
def test_pairs_against_brute_force(spark, k, threshold):
    rows = corpus()
    df = spark.createDataFrame(rows, "id long, grp long, text string, cls string, n int")
    s = {i: shingles(t, k) for i, _, t, _, _ in rows}
    g = {i: grp for i, grp, *_ in rows}
    want = {(a, b) for a, b in combinations(sorted(s), 2) if s[a] and s[b] and g[a] != g[b] and len(s[a] & s[b]) >= threshold * len(s[a] | s[b]) - 1e-9}
    links, members = near.near_duplicates(df, threshold, k)
    got = {(r.id_a, r.id_b) for r in near.record_pairs(links, members).collect()}
    assert got == want and len(want) > 20
    per = {r.id: r for r in near.record_links(links, members).collect()}
    assert 9002 not in per and per[0].class_id == 0 and per[9004].class_id == 0 and per[0].copies == per[9004].copies


def test_masks_cover_three_positions_of_a_group():
    for bad in combinations(range(near.WIDTH), 3):
        assert any(not set(m) & set(bad) for m in near.MASKS)


def test_pairs_at_the_threshold_meet():
    """4,000 pairs of similarity 0.70: 70 hashes of both sets, 15 of each alone."""
    h = np.random.default_rng(4).integers(0, 1 << 63, (4000, 100), np.uint64)
    at = np.arange(0, 4000 * 85 + 1, 85)
    a, b = near.table_keys(h[:, :85].ravel(), at), near.table_keys(np.hstack([h[:, :70], h[:, 85:]]).ravel(), at)
    assert (a == b).any(axis=1).all()


def test_hot_buckets_lose_nothing(spark, monkeypatch):
    """Copies and near copies by the hundred; buckets beyond the limit take the exact way."""
    monkeypatch.setattr(near, "MAX_RUN", 8)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(40):
        v = list(base)
        v[i * 2] = f"x{i}"
        rows.append((i, i, " ".join(v)))
    rows += [(100 + i, i, " ".join(base)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, grp long, text string").repartition(5)
    links, members = near.near_duplicates(df, 0.8, 5)
    s = {i: shingles(t, 5) for i, _, t in rows}
    g = {i: grp for i, grp, _ in rows}
    want = {(a, b) for a, b in combinations(sorted(s), 2) if g[a] != g[b] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])}
    assert {(r.id_a, r.id_b) for r in near.record_pairs(links, members).collect()} == want and len(want) > 4000


def test_packed_keys_come_back():
    rng = np.random.default_rng(2)
    for n in (1, 1000):
        keys, cls = np.sort(rng.integers(0, 1 << 48, n, np.uint64)), rng.integers(0, 1 << 40, n, np.int64)
        a, b = near._unpack(near._pack(keys, cls))
        assert (a == keys).all() and (b == cls).all()


def test_pairs_at_the_threshold_collide_twice():
    """20,000 pairs of similarity 0.70: nearly none is in fewer than two tables."""
    h = np.random.default_rng(4).integers(0, 1 << 63, (20_000, 100), np.uint64)
    at = np.arange(0, 20_000 * 85 + 1, 85)
    a, b = near.table_keys(h[:, :85].ravel(), at), near.table_keys(np.hstack([h[:, :70], h[:, 85:]]).ravel(), at)
    assert ((a == b).sum(axis=1) < near.COLLISIONS).sum() == 0


def test_classes_of_one_short_hash_stay_apart(spark, monkeypatch):
    """Short hashes of few bits: many unlike classes share one."""
    monkeypatch.setattr(near, "bits_for", lambda n: (40, 4))
    rows = corpus(5, 120)
    df = spark.createDataFrame(rows, "id long, grp long, text string, cls string, n int")
    s = {i: shingles(t, 5) for i, _, t, _, _ in rows}
    g = {i: grp for i, grp, *_ in rows}
    want = {(a, b) for a, b in combinations(sorted(s), 2) if s[a] and s[b] and g[a] != g[b] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]) - 1e-9}
    assert {(r.id_a, r.id_b) for r in near.record_pairs(*near.near_duplicates(df, 0.8, 5)).collect()} == want


def test_empty(spark):
    e = spark.createDataFrame([], "id long, grp long, text string")
    links, members = near.near_duplicates(e, 0.8, 5)
    assert links.count() == 0 and near.record_pairs(links, members).count() == 0


def test_equal_files(spark):
    f = spark.createDataFrame([(1, "AB"), (2, "sha256:ab"), (3, " ab "), (4, ""), (5, None), (6, " "), (7, "cd"), (3, " ab ")], "id long, hash string")
    assert sorted(map(tuple, near.equal_files(f).collect())) == [(1, 2), (1, 3), (2, 3)]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 500])
def test_flight_keeps_totals_and_expectation(n):
    rng = np.random.default_rng(n)
    pi, size = rng.random(n), rng.integers(1, 500, n).astype(float)
    bal = np.column_stack([size, np.ones(n)])
    out = mix.flight(pi, bal, np.random.default_rng(1))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert np.allclose(bal.T @ out, bal.T @ pi)
    done = mix.landing(out, bal, rng)
    assert set(np.unique(done)) <= {0.0, 1.0}
    if n >= 50:
        assert abs((bal.T @ done - bal.T @ pi)[0]) <= 1000


def test_inclusion_probabilities_are_kept():
    pi = np.array([0.2, 0.5, 0.5, 0.8, 0.3, 0.7])
    bal = np.column_stack([[3.0, 1, 4, 1, 5, 9], np.ones(6)])
    runs = np.array([mix.landing(mix.flight(pi, bal, np.random.default_rng(s)), bal, np.random.default_rng(s)) for s in range(1500)])
    assert np.abs(runs.mean(axis=0) - pi).max() < 0.2  # the landing rounds towards balance


DOCS = "id long, source string, text string, tokens long, copies string"


def test_mix(spark):
    r = random.Random(1)
    src = {"big": 900, "small": 30, "none": 200}
    rows = [(i, s if i % 3 else f" {s.upper()}  ", " ".join("word" for _ in range(r.randint(1, 60))), 1, "x") for i, s in enumerate(s for s, n in src.items() for _ in range(n))]
    rows += [(5000, None, "text without a source", 1, "x"), (5001, "big", None, 1, "x"), (5002, "big", "", 1, "x")]
    targets = spark.createDataFrame([("Big", 0.7, 1), ("small", 0.25, 3), ("absent", 0.05, 9)], "source string, weight double, max_repeat long")
    sample, report = mix.mix(spark.createDataFrame(rows, DOCS), targets, block=64)
    rep = {x.source: x for x in report.collect()}
    assert not rep["Big"].short and rep["small"].short and rep["absent"].short and rep["absent"].tokens == 0
    assert abs(rep["Big"].tokens - rep["Big"].want) < 120
    got = sample.collect()
    assert {x.source for x in got} == {"big", "small"} and max(x.copies for x in got if x.source == "big") == 1
    assert all(x.copies == 3 for x in got if x.source == "small") and len({x.id for x in got}) == len(got)
    again = mix.mix(spark.createDataFrame(rows, DOCS).repartition(7), targets, block=64)[0]
    assert {(x.id, x.copies) for x in again.collect()} == {(x.id, x.copies) for x in got}


def test_shares_can_be_kept(spark):
    r = random.Random(2)
    rows = [(i, s, " ".join("word" for _ in range(r.randint(1, 60))), 1, "x") for i, s in enumerate(s for s, n in {"big": 900, "small": 60}.items() for _ in range(n))]
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 2), ("absent", 0.1, 9), ("unwanted", None, None)], "source string, weight double, max_repeat long")
    rep = {x.source: x for x in mix.mix(spark.createDataFrame(rows, DOCS), targets, block=64, keep_shares=True)[1].collect()}
    assert abs(rep["big"].share - 2 / 3) < 0.02 and abs(rep["small"].share - 1 / 3) < 0.02
    assert [k for k, x in rep.items() if x.short] == ["absent"] and rep["unwanted"].tokens == 0


def test_shortage_is_told_by_the_sample(spark, monkeypatch):
    rows = [(i, "a" if i % 2 else "b", "one two three", 1, "x") for i in range(100)]
    targets = spark.createDataFrame([("a", 0.8, 1), ("b", 0.2, 1)], "source string, weight double, max_repeat long")
    df = spark.createDataFrame(rows, DOCS)
    assert {x.source: x.short for x in mix.mix(df, targets)[1].collect()} == {"a": True, "b": False}
    # A sample that leaves copies of 'a' out is not exhausted, so no shortage is reported.
    fly = mix._fly
    monkeypatch.setattr(mix, "_fly", lambda last, seed: (lambda f: lambda pdf: f(pdf).assign(sure=0))(fly(last, seed)))
    assert not any(x.short for x in mix.mix(df, targets)[1].collect())


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeat long")
    sample, report = mix.mix(spark.createDataFrame([], DOCS), targets)
    assert sample.count() == 0 and report.count() == 1
    sample, report = mix.mix(spark.createDataFrame([(1, "a", "text", 1, "x")], DOCS), targets.limit(0))
    assert sample.count() == 0 and report.count() == 0
