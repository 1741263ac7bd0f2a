"""Most similar vectors for every vector: learned partitions.

A bounded sample gives an exact neighbour graph, which is cut into balanced parts (balanced
spherical k-means, then moves that cut fewer edges while no part outgrows its cap).  A small
classifier, softmax regression on the vector, learns the parts of a vector's neighbours.  Every
vector is kept in its most probable part, and as a query it goes to its most probable parts
until their probabilities add up to a share `mass`, which is calibrated on the sample.  Inside
a part candidates are ranked by their exact cosine.

The number of parts follows the number of vectors.  Beyond what one bounded sample can tell apart
the index has two levels (`Tree`): the parts of the first are fitted each on a sample of their
own, by a task each, so a part of PART vectors stays that small up to some 10 ** 8 vectors.
There a vector is sent once to each coarse part that it searches, not to each part below, and the
coarse parts take turns, so that the vectors on disk at once are a few times the vectors searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafline.llm.library import bounded
from sheafline.session import cut, tidy

#: Vectors of a part, sample vectors of a part, and the most vectors the index is fitted on.
PART, PER_PART, MAX_SAMPLE = 1024, 64, 32_768
#: Members and queries of one group of the ranking; larger parts are split into blocks of these.
BLOCK = 16_384
NEIGHBOURS = 10
#: Shuffled bytes of vectors for one task of the ranking.
PARTITION_BYTES = 16 << 20
#: Bytes of the members that a task of the two-level search holds, queries per member of a task, and
#: the vectors that are shuffled at once, as a multiple of the members.
HELD_BYTES, QUERIES_EACH, AT_ONCE = 48 << 20, 4, 2


@dataclass
class Model:
    """weights (dim, parts), bias (parts), mass: the share of probability that is searched."""

    weights: np.ndarray
    bias: np.ndarray
    mass: float = 0.7

    @property
    def parts(self) -> int:
        return len(self.bias)

    @property
    def dim(self) -> int:
        return self.weights.shape[0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        return z / z.sum(axis=1, keepdims=True)

    def route(self, x: np.ndarray, mass: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home, query, part): the home of each vector, and the parts each one searches."""
        mass = self.mass if mass is None else mass
        p = self.probabilities(x)
        home = p.argmax(axis=1)
        # The likeliest parts are found by halves: few vectors need many.
        width = min(8, self.parts)
        query, part = [], []
        rest = np.arange(len(x))
        while len(rest):
            q = p[rest]
            top = np.argpartition(-q, width - 1, axis=1)[:, :width] if width < self.parts else np.argsort(-q, axis=1, kind="stable")
            v = np.take_along_axis(q, top, 1)
            order = np.argsort(-v, axis=1, kind="stable")
            top, v = np.take_along_axis(top, order, 1), np.take_along_axis(v, order, 1)
            before = np.cumsum(v, axis=1) - v
            done = (before[:, -1] + v[:, -1] >= mass) | (width == self.parts)
            i, j = np.nonzero((before < mass) & done[:, None])
            query.append(rest[i]), part.append(top[i, j])
            rest = rest[~done]
            width = min(width * 4, self.parts)
        return home, np.concatenate(query) if query else np.empty(0, int), np.concatenate(part) if part else np.empty(0, int)


@dataclass
class Tree:
    """A model of coarse parts and one below each of them; parts are numbered through."""

    top: Model
    below: list[Model]

    def __post_init__(self) -> None:
        self.first = np.concatenate([[0], np.cumsum([m.parts for m in self.below])])

    @property
    def parts(self) -> int:
        return int(self.first[-1])

    @property
    def dim(self) -> int:
        return self.top.dim

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        coarse, query, part = self.top.route(x)
        home = np.zeros(len(x), np.int64)
        q_out, p_out = [], []
        order = np.argsort(part, kind="stable")
        query, part = query[order], part[order]
        at = np.searchsorted(part, np.arange(len(self.below) + 1))
        for c in np.unique(part).tolist():
            q = query[at[c] : at[c + 1]]
            h, i, p = self.below[c].route(x[q])
            own = coarse[q] == c
            home[q[own]] = self.first[c] + h[own]
            q_out.append(q[i]), p_out.append(self.first[c] + p)
        return home, np.concatenate(q_out) if q_out else np.empty(0, int), np.concatenate(p_out) if p_out else np.empty(0, int)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """(n, k) nearest other vectors by cosine, exact, in blocks."""
    n = len(x)
    out = np.empty((n, k), np.int32)
    for i in range(0, n, 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), i + np.arange(len(s))] = -2
        out[i : i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, m: int, rng: np.random.Generator, slack: float = 1.1, rounds: int = 6) -> np.ndarray:
    """A part of every vector: m parts of at most slack x n / m vectors that cut few edges."""
    n, k = graph.shape
    cap = int(np.ceil(slack * n / m))
    centre = x[rng.permutation(n)[:m]].copy()
    part = np.zeros(n, np.int64)
    for _ in range(4):
        score = x @ centre.T
        first = min(32, m)
        wish = np.argpartition(-score, first - 1, axis=1)[:, :first]
        wish = np.take_along_axis(wish, np.argsort(-np.take_along_axis(score, wish, 1), axis=1), 1)
        load = [0] * m
        for i, row in zip(np.argsort(-score.max(axis=1)).tolist(), wish[np.argsort(-score.max(axis=1))].tolist()):
            p = next((p for p in row if load[p] < cap), None)
            if p is None:
                p = int(np.argmin(load))
            part[i] = p
            load[p] += 1
        total = np.zeros_like(centre)
        np.add.at(total, part, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(size > 1e-9, total / np.maximum(size, 1e-9), centre)
    least = n // m // 2
    for _ in range(rounds):
        # Edges of every vector into every part, both ways, as sorted pairs instead of a matrix.
        src = np.concatenate([np.repeat(np.arange(n), k), graph.ravel()])
        dst = np.concatenate([part[graph.ravel()], np.repeat(part, k)])
        pair, count = np.unique(src.astype(np.int64) * m + dst, return_counts=True)
        who, to = pair // m, pair % m
        own = np.zeros(n, np.int64)
        mine = to == part[who]
        own[who[mine]] = count[mine]
        order = np.lexsort((-count, who))
        who, to, count = who[order], to[order], count[order]
        head = np.concatenate([[True], who[1:] != who[:-1]])
        best, most = part.copy(), own.copy()
        best[who[head]], most[who[head]] = to[head], count[head]
        gain = most - own
        load = np.bincount(part, minlength=m)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            a, b = part[i], best[i]
            if load[b] < cap and load[a] > least:
                part[i] = b
                load[a] -= 1
                load[b] += 1
                moved += 1
        if moved < n // 200:
            break
    return part


def train(x: np.ndarray, graph: np.ndarray, part: np.ndarray, m: int, rng: np.random.Generator, epochs: int = 12, rate: float = 0.05) -> Model:
    """Softmax regression to the parts of a vector's neighbours (half) and its own (half), by Adam."""
    n, k = graph.shape
    w = np.zeros((x.shape[1], m), np.float32)
    np.add.at(w.T, part, x)
    w = 10 * w / np.maximum(np.bincount(part, minlength=m), 1)
    b = np.zeros(m, np.float32)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    model, step = Model(w, b), 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, 512):
            j = order[i : i + 512]
            g = model.probabilities(x[j])
            np.subtract.at(g, (np.arange(len(j))[:, None], part[graph[j]]), 0.5 / k)
            g[np.arange(len(j)), part[j]] -= 0.5
            g /= len(j)
            step += 1
            for v, grad, at in ((model.weights, x[j].T @ g, 0), (model.bias, g.sum(axis=0), 2)):
                s, t = state[at], state[at + 1]
                s *= 0.9
                s += 0.1 * grad
                t *= 0.999
                t += 0.001 * grad * grad
                v -= rate * (s / (1 - 0.9**step)) / (np.sqrt(t / (1 - 0.999**step)) + 1e-8)
    return model


def _mass_for(reached_at: np.ndarray, target: float) -> float:
    """The least mass that reaches a share `target` of the wanted parts, at most 1."""
    return float(min(1.0, np.quantile(reached_at, target, method="higher") + 1e-6))


def _needed(p: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Per row the probability of all parts before `part` (the mass at which it is reached)."""
    at = np.take_along_axis(p, part.reshape(len(p), -1), 1)
    return np.stack([np.where(p > at[:, [c]], p, 0).sum(axis=1) for c in range(at.shape[1])], 1)


def calibrate(model: Model, x: np.ndarray, graph: np.ndarray, min_cosine: float | None, target: float, rng: np.random.Generator) -> float:
    """The mass that finds a share `target` of the neighbours.

    With a least cosine, pairs of that very cosine are made from the sample by a random turn, and
    a pair counts as found when either finds the other.  Without one, the sample's own neighbours
    have to be found.
    """
    q = x[rng.permutation(len(x))[:4000]]
    if min_cosine is not None:
        z = rng.normal(size=q.shape)
        z -= (z * q).sum(axis=1, keepdims=True) * q
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        y = (min_cosine * q + np.sqrt(max(0.0, 1 - min_cosine**2)) * z).astype(np.float32)
        p, r = model.probabilities(q), model.probabilities(y)
        both = np.minimum(_needed(p, r.argmax(axis=1))[:, 0], _needed(r, p.argmax(axis=1))[:, 0])
        return max(0.5, _mass_for(both, target))
    rows = rng.permutation(len(x))[:1000]
    p = model.probabilities(x)
    home = p.argmax(axis=1)
    return _mass_for(_needed(p[rows], home[graph[rows]]).ravel(), target)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """(id, vec) of vectors with a direction: not null, no null or NaN inside, not all zero."""
    ok = F.col("id").isNotNull() & F.col("vec").isNotNull() & F.exists("vec", lambda e: e != 0) & F.forall("vec", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    if dim is not None:
        ok = ok & (F.size("vec") == dim)
    return vectors.where(ok).select("id", F.col("vec").cast("array<float>").alias("vec"))


def _fit(x: np.ndarray, m: int, min_cosine: float | None, target: float, seed: int) -> Model:
    """A model of at most m parts, fitted on the unit vectors x."""
    rng = np.random.default_rng(seed)
    m = max(1, min(m, len(x) // 8))
    k = min(NEIGHBOURS, len(x) - 1)
    if m == 1 or k < 1:
        return Model(np.zeros((x.shape[1], 1), np.float32), np.zeros(1, np.float32), 1.0)
    graph = neighbour_graph(x, k)
    model = train(x, graph, balanced_parts(x, graph, m, rng), m, rng)
    model.mass = calibrate(model, x, graph, min_cosine, target, rng)
    return model


def _fit_below(vectors: DataFrame, top: Model, min_cosine: float | None, target: float, part: int, max_parts: int, max_sample: int, seed: int) -> list[Model]:
    """A model for each part of `top`, each fitted by a task on at most about max_sample vectors."""

    def homes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(top.probabilities(unit(_matrix(b, 1))).argmax(axis=1).astype(np.int64)), b.column(0), b.column(1)], names=["part", "id", "vec"])

    homed = vectors.select("id", "vec").mapInArrow(homes, "part long, id long, vec array<float>")
    # At most one row per coarse part.
    size = {r.part: r["count"] for r in homed.groupBy("part").count().collect()}

    def learn(key: tuple, t: pa.Table) -> pa.Table:
        c = key[0].as_py()
        v = t.column("vec").combine_chunks()
        v = pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v
        x = unit(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1).astype(np.float32))
        got = _fit(x, min(max_parts, max(1, round(size[c] / part))), min_cosine, target, seed)
        return pa.table({"part": [c], "weights": [got.weights.astype(np.float32).tobytes()], "bias": [got.bias.astype(np.float32).tobytes()], "mass": [float(got.mass)]})

    rate = F.least(F.lit(1.0), F.lit(float(max_sample)) / F.element_at(F.create_map(*[F.lit(v) for kv in size.items() for v in kv]), F.col("part")))
    drawn = homed.where(F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 30)) < rate * (1 << 30))
    with tidy(vectors.sparkSession):
        rows = drawn.select("part", "vec").groupBy("part").applyInArrow(learn, "part long, weights binary, bias binary, mass double").collect()
    out = [Model(np.zeros((top.dim, 1), np.float32), np.zeros(1, np.float32), 1.0) for _ in range(top.parts)]
    for r in rows:
        out[r.part] = Model(np.frombuffer(r.weights, np.float32).reshape(top.dim, -1), np.frombuffer(r.bias, np.float32), r.mass)
    return out


def fit(vectors: DataFrame, n: int, min_cosine: float | None = None, target: float = 0.999, part: int = PART, per_part: int = PER_PART, max_sample: int = MAX_SAMPLE, seed: int = 5) -> Model | Tree | None:
    """Fits the index for the n usable vectors (None if n is 0).

    One model is fitted on a sample of at most max_sample vectors.  When n asks for more than
    max_sample / per_part parts, its parts are the square root of that number, and each of them
    is split by a model of its own, fitted on at most max_sample of its vectors.
    """
    if n == 0:
        return None
    wanted, most = max(1, n // part), max_sample // per_part
    deep = wanted > most
    m = min(most, int(np.ceil(np.sqrt(wanted)))) if deep else wanted
    # Coarse parts decide how often a vector is sent, and a larger sample tells them apart better.
    size = min(n, max_sample, max_sample if deep else max(per_part * m, min(n, 2 * part)))
    draw = vectors if size >= n else vectors.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * size / n))
    got = draw.select("vec").limit(int(size * 1.2) + 64).toArrow().column(0).combine_chunks()
    x = unit(got.values.to_numpy(zero_copy_only=False).reshape(len(got), -1).astype(np.float32))
    # With two levels a neighbour has to be reached in both.
    each = float(np.sqrt(target)) if deep else target
    top = _fit(x, m, min_cosine, each, seed)
    if not deep or top.parts == 1:
        return top
    return Tree(top, _fit_below(vectors, top, min_cosine, each, part, most, max_sample, seed))


_ROWS = pa.schema([("grp", pa.int64()), ("id", pa.int64()), ("role", pa.int8()), ("vec", pa.binary())])
_FOUND = "id long, other long, cosine double"
_MEMBER, _QUERY = 1, 2


def _matrix(batch: pa.RecordBatch, col: int) -> np.ndarray:
    a = batch.column(col)
    return a.values[a.offsets[0].as_py() : a.offsets[-1].as_py()].to_numpy(zero_copy_only=False).reshape(len(a), -1).astype(np.float32)


def _sizes(base: DataFrame, queries: DataFrame | None, model: Model | Tree) -> tuple[dict[int, int], dict[int, int]]:
    """Members and queries of each part: at most `parts` rows reach the driver."""

    def count(df: DataFrame, role: int) -> DataFrame:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            home_n, query_n = np.zeros(model.parts, np.int64), np.zeros(model.parts, np.int64)
            for b in it:
                if b.num_rows:
                    h, _, p = model.route(unit(_matrix(b, 0)))
                    home_n += np.bincount(h, minlength=model.parts)
                    query_n += np.bincount(p, minlength=model.parts)
            if not role & _MEMBER:
                home_n[:] = 0
            if not role & _QUERY:
                query_n[:] = 0
            some = np.flatnonzero(home_n + query_n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(home_n[some]), pa.array(query_n[some])], names=["part", "m", "q"])

        return df.select("vec").mapInArrow(run, "part long, m long, q long")

    c = count(base, _MEMBER | _QUERY) if queries is None else count(base, _MEMBER).unionByName(count(queries, _QUERY))
    rows = c.groupBy("part").agg(F.sum("m").alias("m"), F.sum("q").alias("q")).collect()
    return {r.part: r.m for r in rows}, {r.part: r.q for r in rows}


def _nearest(raw: np.ndarray, u: np.ndarray, ids: np.ndarray, m_raw: np.ndarray, m_u: np.ndarray, m_ids: np.ndarray, k: int, min_cosine: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, member, cosine): the k most similar members of each query, itself left out, in tiles.  u: unit vectors of raw."""
    tile = max(1, 4_000_000 // max(1, len(m_ids)))
    for s in range(0, len(ids) if len(m_ids) else 0, tile):
        z = np.arange(s, min(s + tile, len(ids)))
        sim = u[z] @ m_u.T
        if min_cosine is not None:
            i, j = np.nonzero(sim >= min_cosine - 1e-4)
            other = ids[z[i]] != m_ids[j]
            i, j = i[other], j[other]
        else:
            sim[ids[z][:, None] == m_ids[None, :]] = -2.0
            # All ties, with slack for rounding; the exact order is made below.
            least = np.partition(sim, len(m_ids) - k, axis=1)[:, len(m_ids) - k, None] - 1e-5 if len(m_ids) > k else -2.0
            i, j = np.nonzero((sim >= least) & (sim > -2.0))
        few = [slice(t, t + 65_536) for t in range(0, len(i), 65_536)]
        c = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", unit(raw[z[i[t]]].astype(np.float64)), unit(m_raw[j[t]].astype(np.float64))) for t in few)])
        if min_cosine is not None:
            good = c >= min_cosine
            i, j, c = i[good], j[good], c[good]
        i, j, c = _first(z[i], j, c, m_ids[j], k)
        yield i, j, c


def _first(i: np.ndarray, j: np.ndarray, c: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query i the k pairs of the highest cosine, ties by the lesser id."""
    order = np.lexsort((other, -c, i))
    i, j, c = i[order], j[order], c[order]
    good = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
    return i[good], j[good], c[good]


class _Held:
    """The members of one group of a coarse part by their parts below, and what queries find there."""

    def __init__(self, below: Model, ids: np.ndarray, raw: np.ndarray) -> None:
        u = unit(raw)
        home = np.concatenate([below.probabilities(u[s : s + 10_000]).argmax(axis=1) for s in range(0, len(ids), 10_000)])
        order = np.lexsort((ids, home))
        self.below, self.ids, self.raw, self.u = below, ids[order], raw[order], u[order]
        self.at = np.searchsorted(home[order], np.arange(below.parts + 1))

    def ask(self, ids: np.ndarray, raw: np.ndarray, k: int, min_cosine: float | None) -> pa.RecordBatch:
        u = unit(raw)
        _, query, part = self.below.route(u)
        order = np.argsort(part, kind="stable")
        query, part = query[order], part[order]
        to = np.searchsorted(part, np.arange(self.below.parts + 1))
        got = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for p in np.unique(part).tolist():
            q, m = query[to[p] : to[p + 1]], slice(self.at[p], self.at[p + 1])
            got += [(q[i], self.at[p] + j, c) for i, j, c in _nearest(raw[q], u[q], ids[q], self.raw[m], self.u[m], self.ids[m], k, min_cosine)]
        i, j, c = (np.concatenate(x) for x in zip(*got))
        i, j, c = _first(i, j, c, self.ids[j], k)
        return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(self.ids[j]), pa.array(c)], names=["id", "other", "cosine"])


def _turns(rows: np.ndarray, most: int) -> list[np.ndarray]:
    """Coarse parts in turns of at most `most` rows together, or of one part."""
    out, now = [[]], 0
    for p in np.argsort(-rows, kind="stable").tolist():
        if out[-1] and now + rows[p] > most:
            out.append([])
            now = 0
        out[-1].append(p)
        now += rows[p]
    return [np.array(x) for x in out]


def _search_tree(base: DataFrame, tree: Tree, k: int, queries: DataFrame | None, min_cosine: float | None, held: int | None = None) -> DataFrame:
    """`search` by two levels: the parts below a coarse part are told apart where its vectors have arrived.

    A group holds at most `held` members; its queries pass by in batches.  The coarse parts take
    turns, and the shuffle files of one turn go before the next.
    """
    top, held = tree.top, held or max(1, HELD_BYTES // (4 * tree.dim))
    members, asked = _sizes(base, queries, top)
    m, q = (np.array([x.get(p, 0) for p in range(top.parts)], np.int64) for x in (members, asked))
    mb, qb = np.maximum(1, -(-m // held)), np.maximum(1, -(-q // (QUERIES_EACH * held)))

    def rank(start: np.ndarray):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grp, ids, raw, role, index = None, [], [], [], None

            def close() -> Iterator[pa.RecordBatch]:
                """Members are complete: those that are queries too ask first."""
                nonlocal index, ids, raw, role
                if ids:
                    i, x, r = np.concatenate(ids), np.concatenate(raw), np.concatenate(role)
                    ids, raw, role = [], [], []
                    index = _Held(tree.below[int(np.searchsorted(start, grp, "right")) - 1], i, x)
                    own = np.flatnonzero(r & _QUERY)
                    for s in range(0, len(own), 10_000):
                        yield index.ask(i[own[s : s + 10_000]], x[own[s : s + 10_000]], k, min_cosine)

            for b in it:
                g = b.column("grp").to_numpy()
                v = b.column("vec")
                x = np.frombuffer(b"".join(v.to_pylist()), np.float32).reshape(len(g), -1)
                n, what = b.column("id").to_numpy(), b.column("role").to_numpy()
                edge = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
                for s, e in zip(edge, edge[1:]):
                    if s == e:
                        continue
                    if grp != g[s]:
                        yield from close()
                        grp, index = g[s], None
                    own = s + np.flatnonzero(what[s:e] & _MEMBER)
                    if len(own):
                        ids.append(n[own]), raw.append(x[own]), role.append(what[own])
                    rest = s + np.flatnonzero(what[s:e] == _QUERY)
                    if len(rest):
                        yield from close()
                        if index is not None:
                            yield index.ask(n[rest], x[rest], k, min_cosine)
            yield from close()

        return run

    found = None
    for turn in _turns(m * qb + q * mb, int(AT_ONCE * max(m.sum(), 4 * held))):
        # Groups of this turn alone, numbered from 0; the other parts have none.
        groups = np.zeros(top.parts, np.int64)
        groups[turn] = (mb * qb)[turn]
        start = np.concatenate([[0], np.cumsum(groups)])
        rows = _sent(base, queries, top, mb, qb, start, groups > 0)
        rows = rows.repartitionById(int(start[-1]), F.col("grp").cast("int")).sortWithinPartitions("grp", F.col("role") == _QUERY)
        with tidy(base.sparkSession):
            part = cut(rows.mapInArrow(rank(start), _FOUND))
        found = part if found is None else found.unionByName(part)
    return found


def _sent(base: DataFrame, queries: DataFrame | None, model: Model | Tree, mb: np.ndarray, qb: np.ndarray, start: np.ndarray, served: np.ndarray | None = None) -> DataFrame:
    """(grp, id, role, vec): the vectors of each group of member and query blocks; served: the parts that count."""

    def spread(role: int):
        def salt(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
            h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            return ((h >> np.uint64(33)) % n.astype(np.uint64)).astype(np.int64)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                if not b.num_rows:
                    continue
                ids, raw = b.column(0).to_numpy(), _matrix(b, 1)
                home, query, part = model.route(unit(raw))
                if served is not None:
                    query, part = query[served[part]], part[served[part]]
                rows, grp, what = [], [], []
                if role & _MEMBER:
                    # A member meets every block of its part's queries.
                    n = qb[home] if served is None else np.where(served[home], qb[home], 0)
                    at = np.repeat(np.arange(len(ids)), n)
                    j = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                    h = home[at]
                    rows.append(at), grp.append(start[h] + salt(ids[at], mb[h]) * qb[h] + j), what.append(np.full(len(at), _MEMBER))
                if role & _QUERY:
                    # A query meets every block of the members of each part that it searches.
                    n = mb[part]
                    at, p = np.repeat(query, n), np.repeat(part, n)
                    i = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                    rows.append(at), grp.append(start[p] + i * qb[p] + salt(ids[at], qb[p])), what.append(np.full(len(at), _QUERY))
                rows, grp, what = np.concatenate(rows), np.concatenate(grp), np.concatenate(what)
                # A vector that is member and query of one group is sent once.
                order = np.lexsort((what, rows, grp))
                rows, grp, what = rows[order], grp[order], what[order]
                twin = np.zeros(len(rows), bool)
                twin[1:] = (rows[1:] == rows[:-1]) & (grp[1:] == grp[:-1])
                what[:-1][twin[1:]] = _MEMBER | _QUERY
                rows, grp, what = rows[~twin], grp[~twin], what[~twin]
                if not len(rows):
                    continue
                width = raw.shape[1] * 4
                blob = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(raw[rows]))])
                yield pa.RecordBatch.from_arrays([pa.array(grp), pa.array(ids[rows]), pa.array(what.astype(np.int8)), blob], schema=_ROWS)

        return run

    shape = "grp long, id long, role byte, vec binary"
    rows = base.select("id", "vec").mapInArrow(spread(_MEMBER | (_QUERY if queries is None else 0)), shape)
    if queries is not None:
        rows = rows.unionByName(queries.select("id", "vec").mapInArrow(spread(_QUERY), shape))
    return rows


def search(base: DataFrame, model: Model | Tree | None, k: int, queries: DataFrame | None = None, min_cosine: float | None = None, block: int = BLOCK) -> DataFrame:
    """(id, other, cosine): for every query its k most similar vectors of base, itself left out.

    base, queries: (id, vec) of usable vectors with unique ids; without queries every vector of
    base is one.  min_cosine leaves less similar ones out.  Ties in the cosine go to the lesser
    id.  Parts larger than a block are split, members against queries in blocks, so no task
    holds more than a block of each, and nothing is cut off.
    """
    spark = base.sparkSession
    if model is None:
        return spark.createDataFrame([], _FOUND)
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    if isinstance(model, Tree):
        found = _search_tree(base, model, k, queries, min_cosine)
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
    members, asked = _sizes(base, queries, model)
    top = max(model.parts, 1)
    mb = np.array([max(1, -(-members.get(p, 0) // block)) for p in range(top)])
    qb = np.array([max(1, -(-asked.get(p, 0) // (2 * block))) for p in range(top)])
    start = np.concatenate([[0], np.cumsum(mb * qb)])

    rows = _sent(base, queries, model, mb, qb, start)

    def rank(t: pa.Table) -> pa.Table:
        ids, role = t.column("id").to_numpy(), t.column("role").to_numpy()
        x = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float32).reshape(len(ids), -1)
        u = unit(x.astype(np.float64)).astype(np.float32)
        m = np.flatnonzero(role & _MEMBER)
        q = np.flatnonzero(role & _QUERY)
        m = m[np.argsort(ids[m], kind="stable")]
        out_a, out_b, out_c = [], [], []
        for i, j, c in _nearest(x[q], u[q], ids[q], x[m], u[m], ids[m], k, min_cosine):
            out_a.append(ids[q[i]]), out_b.append(ids[m[j]]), out_c.append(c)
        cat = lambda p, d: np.concatenate(p).astype(d) if p else np.empty(0, d)
        return pa.table({"id": cat(out_a, np.int64), "other": cat(out_b, np.int64), "cosine": cat(out_c, np.float64)})

    # As many partitions as the shuffled vectors need at a few MB each, so a task's share does not grow with the data.
    width = 4 * model.dim + 24
    need = int((sum(members.values()) + sum(asked.values())) * width / PARTITION_BYTES) + 1
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(max(need, min(shuffle, int(start[-1]))), "grp")
    found = rows.groupBy("grp").applyInArrow(rank, _FOUND)
    # A few lists of k per query are merged; a query's rows are bounded by parts x blocks x k.
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def copies_apart(base: DataFrame, k: int) -> tuple[DataFrame, DataFrame] | None:
    """(surplus, last) of vectors (id, vec) that more than k + 1 records share exactly, None if
    there are none.  surplus: (id, stand) of the copies beyond the k + 1 least ids, where stand is
    the last id that stays; last: (id) of those.

    The k most similar of a surplus copy are those of the last one that stays, as the lesser ids
    come first among equals; so a group of copies costs as much as k + 1 vectors, whatever its
    size.  Vectors are told apart by 128 bits of hashes; only ids and hashes are moved.
    """
    h = base.select("id", F.xxhash64("vec").alias("_h"), F.xxhash64("vec", F.lit(7)).alias("_g"))
    many = cut(h.groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > k + 1).select("_h", "_g"))
    if not many.limit(1).count():
        return None
    hot = h.join(bounded(many), ["_h", "_g"], "left_semi")
    # Only the least ids of a group leave a task.
    least = hot.withColumn("_r", F.row_number().over(Window.partitionBy("_h", "_g").orderBy("id"))).where(F.col("_r") <= k + 1)
    stand = cut(least.where(F.col("_r") == k + 1).select("_h", "_g", F.col("id").alias("stand")))
    surplus = cut(hot.join(bounded(stand), ["_h", "_g"]).where(F.col("id") > F.col("stand")).select("id", "stand"))
    return surplus, stand.select(F.col("stand").alias("id"))


def similar(base: DataFrame, model: Model | Tree | None, k: int, queries: DataFrame | None = None, min_cosine: float | None = None, block: int = BLOCK) -> DataFrame:
    """`search` with groups of equal vectors searched once (`copies_apart`)."""
    with tidy(base.sparkSession):
        apart = copies_apart(base, k)
    if apart is None:
        return search(base, model, k, queries, min_cosine, block)
    surplus, last = apart
    # Read for the sizes of the parts and for each turn.
    with tidy(base.sparkSession):
        rest = cut(base.join(surplus.select("id"), "id", "left_anti"))
    asked = None
    if queries is not None:
        # The record that stands for surplus queries is asked as well.
        stands = queries.select("id").join(surplus, "id").select(F.col("stand").alias("id")).distinct()
        asked = queries.select("id", "vec").join(surplus.select("id"), "id", "left_anti").unionByName(rest.join(stands, "id", "left_semi").join(queries.select("id"), "id", "left_anti").select("id", "vec"))
    got = cut(search(rest, model, k, asked, min_cosine, block))
    own = got if queries is None else got.join(queries.select("id"), "id", "left_semi")
    wanted = surplus if queries is None else surplus.join(queries.select("id"), "id", "left_semi")
    return own.unionByName(wanted.join(got.withColumnRenamed("id", "stand"), "stand").select("id", "other", "cosine"))
