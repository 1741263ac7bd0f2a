"""p1: recall against brute force, ties, and vectors without direction."""

import numpy as np
import pytest

from sheafline.llm import knn


def near_copies(n=3000, dim=16, seed=0):
    """Random vectors, a third with a near copy."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n - 1, 3):
        z = rng.normal(size=dim)
        x[i + 1] = x[i] / np.linalg.norm(x[i]) + 0.3 * rng.random() * z / np.linalg.norm(z)
    return x.astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<float>")


def brute(x, k, least=None):
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(x)):
        for j in sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:k]:
            if least is None or s[i, j] >= least:
                out.add((i, j))
    return out


@pytest.mark.parametrize("block", [4096, 64])
def test_pairs_over_a_cosine(spark, block):
    x = near_copies(1500)
    v = frame(spark, x)
    m = knn.fit(v, len(x), 0.92, part=128, per_part=64)
    assert m.parts > 4
    got = {(r.id, r.other) for r in knn.search(v, m, 10, min_cosine=0.92, block=block).collect()}
    want = brute(x, 10, 0.92)
    both = lambda s: {tuple(sorted(p)) for p in s}
    assert not both(got) - both(want)
    assert len(both(got)) >= 0.99 * len(both(want))


def test_every_fiftieth_against_all(spark):
    x = near_copies(2500, 8, 1)
    v = frame(spark, x)
    m = knn.fit(v, len(x), None, 0.95, part=128)
    got = {(r.id, r.other) for r in knn.search(v, m, 10, queries=v.where("id % 50 = 0")).collect()}
    want = {p for p in brute(x, 10) if p[0] % 50 == 0}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("least", [0.92, None])
def test_two_levels_of_parts(spark, least):
    x = near_copies(3000)
    v = frame(spark, x).repartition(4)
    m = knn.fit(v, len(x), least, 0.99, part=64, per_part=32, max_sample=640)
    assert isinstance(m, knn.Tree) and m.top.parts > 4 and m.parts > 20
    home = m.route(knn.unit(x))[0]
    assert np.bincount(home, minlength=m.parts).max() < 640
    got = {(r.id, r.other) for r in knn.search(v, m, 10, min_cosine=least).collect()}
    want = brute(x, 10, least)
    both = (lambda s: {tuple(sorted(p)) for p in s}) if least else set
    assert len(both(got) & both(want)) >= 0.95 * len(both(want))


def test_parts_are_balanced():
    x = knn.unit(near_copies(2000))
    g = knn.neighbour_graph(x, 10)
    rng = np.random.default_rng(0)
    p = knn.balanced_parts(x, g, 16, rng)
    n = np.bincount(p, minlength=16)
    assert n.max() <= np.ceil(1.1 * 2000 / 16)
    random_cut = (rng.permutation(p)[g] != p[:, None]).mean()
    assert (p[g] != p[:, None]).mean() < random_cut - 0.1


def test_useless_vectors_ties_and_empty(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (None, [1.0, 0.0]), (8, [0.0, 1.0])]
    v = knn.usable(spark.createDataFrame(rows, "id long, vec array<float>").selectExpr("id", "vec", "id as grp", "1 as role"))
    assert sorted(r.id for r in v.collect()) == [1, 2, 3, 8]
    m = knn.fit(v, 4, 0.9)
    got = sorted((r.id, r.other) for r in knn.search(v, m, 1, min_cosine=0.9).collect())
    assert got == [(1, 2), (2, 1), (3, 1)]  # ties go to the lesser id
    e = v.where("id < 0")
    assert knn.search(e, knn.fit(e, 0), 5).count() == 0
    one = v.where("id = 8")
    assert knn.search(one, knn.fit(one, 1), 5).count() == 0


def test_one_hot_part_is_split(spark):
    """All vectors alike: one part holds everything, no group is larger than a block of each side."""
    x = np.tile(np.array([[1.0, 2.0, 3.0]], np.float32), (600, 1))
    v = frame(spark, x)
    m = knn.fit(v, 600, 0.92, part=100, per_part=32)
    got = knn.search(v, m, 3, min_cosine=0.92, block=100)
    assert got.count() == 1800 and {r.other for r in got.where("id = 500").collect()} == {0, 1, 2}


def test_groups_of_copies_are_searched_once(spark, monkeypatch):
    """A third of all vectors are equal, some others in smaller groups; the result is that of all."""
    x = near_copies(300, 8, 3)
    x[np.arange(0, 300, 3)] = x[0]
    x[[1, 4, 7, 10, 13, 16]] = x[1]
    v = frame(spark, x).repartition(3)
    m = knn.fit(v, 300, 0.92, part=64, per_part=32)
    surplus, last = knn.copies_apart(v, 3)
    assert surplus.count() == 98 and {r.id for r in last.collect()} == {9, 10}
    for kw in ({"min_cosine": 0.92}, {}, {"queries": v.where("id % 5 = 0")}):
        m.mass = 1.0  # every part is searched, so that both ways are exact
        a, b = (sorted((r.id, r.other) for r in f(v, m, 3, **kw).collect()) for f in (knn.search, knn.similar))
        assert a == b and len(a) > 100
    assert knn.copies_apart(v.where("id < 3"), 3) is None


def shuffled(spark):
    x = spark.sparkContext._jsc.sc()
    x.listenerBus().waitUntilEmpty(30_000)
    e = x.statusStore().executorList(True)
    return sum(e.apply(i).totalShuffleWrite() for i in range(e.size()))


@pytest.mark.parametrize("least", [0.92, None])
def test_two_levels_send_a_vector_once_to_a_coarse_part(spark, least):
    """Not once to every part below: the bytes shuffled follow the coarse parts searched."""
    x = near_copies(6000, 64, 4)
    v = frame(spark, x).repartition(4).localCheckpoint()
    m = knn.fit(v, len(x), least, 0.999, part=32, per_part=8, max_sample=640)
    assert isinstance(m, knn.Tree)
    coarse, fine = (len(r.route(knn.unit(x))[1]) for r in (m.top, m))
    assert fine > 3 * coarse
    before = shuffled(spark)
    assert knn.search(v, m, 10, min_cosine=least).count()
    lists = 0 if least else coarse * 10 * 40
    assert shuffled(spark) - before < 1.2 * (coarse + len(x)) * (4 * 64 + 40) + lists + 1_000_000


def test_two_levels_in_turns_and_blocks_find_all(spark, monkeypatch):
    """Parts over what a task holds, a turn for each few of them: the exact result where everything is searched."""
    x = near_copies(1500)
    v = frame(spark, x).repartition(3)
    m = knn.fit(v, len(x), None, 0.99, part=64, per_part=32, max_sample=320)
    for one in (m.top, *m.below):
        one.mass = 1.1
    monkeypatch.setattr(knn, "HELD_BYTES", 4 * 16 * 50)
    monkeypatch.setattr(knn, "QUERIES_EACH", 6)
    assert len(knn._turns(np.full(m.top.parts, 3000), 4000)) == m.top.parts
    asked = v.where("id % 7 = 0")
    for queries, least in ((None, 0.92), (asked, None)):
        got = {(r.id, r.other) for r in knn.search(v, m, 10, queries=queries, min_cosine=least).collect()}
        assert got == {p for p in brute(x, 10, least) if queries is None or p[0] % 7 == 0}
