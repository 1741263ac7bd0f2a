"""IVF-PQ: an approximate index over vectors, with exact re-scoring and an exact tail.

Training runs in NumPy on a bounded sample; assignment and encoding run over all vectors in
Arrow batches.  The index is a folder: codes partitioned by cell, and one file of parameters;
a build writes beside the old one and then moves the pointer.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafline.session import cut

SAMPLE, WORDS, SPHERICAL_ROUNDS = 250_000, 256, 10
EXACT_BELOW, LEAST_PROBES, LEAST_SHORTLIST, PROBE_SHARE = 200_000, 64, 512, 0.02
#: Recall that an index is calibrated to, and about how many vectors are held out for it.
RECALL, HELD = 0.92, 300


def cells_for(n: int) -> int:
    """Cells of an index over n vectors."""
    return max(16, min(int(4 * math.sqrt(n)), n // 48, 16_384))


def slices_for(dim: int) -> int:
    """Sub-quantisers: the largest of a fixed list that divides the dimension."""
    return next(m for m in (32, 24, 16, 12, 8, 6, 4, 2, 1) if dim % m == 0)


def probes_for(cells: int) -> int:
    return min(cells, max(LEAST_PROBES, round(cells * PROBE_SHARE)))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = SPHERICAL_ROUNDS, seed: int = 0) -> np.ndarray:
    """Unit centroids; an empty one is put on the worst-served point."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at, fit = assign(x, c)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        n = np.bincount(at, minlength=k)
        worst = iter(np.argsort(fit))
        for e in np.flatnonzero(n == 0):
            total[e] = x[next(worst)]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return c


def assign(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, fit = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
    for i in range(0, len(x), 8192):
        s = x[i : i + 8192] @ c.T
        at[i : i + 8192] = s.argmax(1)
        fit[i : i + 8192] = s.max(1)
    return at, fit


def balanced_rotation(x: np.ndarray, m: int) -> np.ndarray:
    """Principal axes dealt out so that every slice carries a like share of the variance."""
    d = x.shape[1]
    val, vec = np.linalg.eigh(np.cov(x, rowvar=False) + 1e-9 * np.eye(d))
    slots: list[list[int]] = [[] for _ in range(m)]
    load = np.zeros(m)
    for a in np.argsort(-val):
        open_ = [s for s in range(m) if len(slots[s]) < d // m]
        s = min(open_, key=lambda s: load[s])
        slots[s].append(a)
        load[s] += val[a]
    return np.ascontiguousarray(vec[:, [a for s in slots for a in s]].astype(np.float32))


def codebooks(residual: np.ndarray, m: int, words: int = WORDS, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """(m, words, d/m) codewords of each slice by k-means."""
    rng = np.random.default_rng(seed)
    parts = residual.reshape(len(residual), m, -1)
    out = np.empty((m, words, parts.shape[2]), np.float32)
    for s in range(m):
        p = np.ascontiguousarray(parts[:, s])
        c = p[rng.choice(len(p), words, replace=len(p) < words)].copy()
        for _ in range(rounds):
            at = nearest(p, c)
            n = np.bincount(at, minlength=words)
            total = np.zeros_like(c)
            np.add.at(total, at, p)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], p[rng.choice(len(p), words)])
        out[s] = c
    return out


def nearest(p: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(1)
    out = np.empty(len(p), np.int64)
    for i in range(0, len(p), 8192):
        out[i : i + 8192] = (p[i : i + 8192] @ c.T - half).argmax(1)
    return out


@dataclass
class IvfPq:
    rotation: np.ndarray
    centroids: np.ndarray
    books: np.ndarray
    covers: int
    nprobe: int = 0
    shortlist: int = 0

    @property
    def m(self) -> int:
        return len(self.books)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = x @ self.rotation
        cell, _ = assign(z, self.centroids)
        parts = (z - self.centroids[cell]).reshape(len(z), self.m, -1)
        return cell, np.stack([nearest(np.ascontiguousarray(parts[:, s]), self.books[s]) for s in range(self.m)], 1).astype(np.uint8)

    def dump(self) -> bytes:
        b = io.BytesIO()
        np.savez(b, rotation=self.rotation, centroids=self.centroids, books=self.books, covers=self.covers, nprobe=self.nprobe, shortlist=self.shortlist)
        return b.getvalue()

    @staticmethod
    def load(b: bytes) -> IvfPq:
        z = np.load(io.BytesIO(b))
        return IvfPq(z["rotation"], z["centroids"], z["books"], int(z["covers"]), *[int(z[f]) for f in ("nprobe", "shortlist") if f in z])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def train(x: np.ndarray, covers: int, cells: int | None = None, seed: int = 0) -> IvfPq:
    """From a sample of vectors; `covers` is the number of vectors the index will hold."""
    x = _unit(x.astype(np.float32))
    m = slices_for(x.shape[1])
    rot = balanced_rotation(x, m)
    z = x @ rot
    c = spherical_kmeans(z, min(cells or cells_for(covers), len(x)), seed=seed)
    at, _ = assign(z, c)
    return IvfPq(rot, c, codebooks(z - c[at], m, seed=seed), covers)


def _vecs(b: pa.RecordBatch, i: int) -> np.ndarray:
    a = b.column(i)
    return a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1).astype(np.float32)


def build(vectors: DataFrame, sample: int = SAMPLE, cells: int | None = None, seed: int = 0) -> tuple[IvfPq, DataFrame]:
    """(index, codes) of vectors (id, vec): codes (cell, id, code).  Every vector is indexed; the
    sample of at most `sample` vectors only fits the parameters.  From EXACT_BELOW vectors on, the
    probes and the shortlist are calibrated on vectors that the fit does not see."""
    n = vectors.count()
    large = n >= EXACT_BELOW
    seen = vectors.where(~_held(n)) if large else vectors
    part = seen if n <= sample else seen.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    got = part.select("vec").limit(int(1.1 * sample) + 16).toArrow().column(0).combine_chunks()
    index = train(got.flatten().to_numpy(zero_copy_only=False).reshape(len(got), -1), n, cells, seed)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                cell, code = index.encode(_unit(_vecs(b, 1)))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), b.column(0), pa.array([r.tobytes() for r in code], pa.binary())], names=["cell", "id", "code"])

    codes = vectors.select("id", "vec").mapInArrow(run, "cell int, id long, code binary")
    if large:
        codes = cut(codes)
        index, _ = calibrate(index, codes, vectors)
    return index, codes


def _held(n: int):
    return F.pmod(F.xxhash64("id", F.lit("held")), F.lit(n)) < HELD


def _queries(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of queries (qid, vec), a stated small set."""
    q = queries.select("qid", "vec").limit(100_001).toArrow()
    if q.num_rows > 100_000:
        raise ValueError("more than 100,000 queries at once; pass them in blocks")
    if not q.num_rows:
        return np.empty(0, np.int64), np.empty((0, 0), np.float32)
    qid = q.column(0).to_numpy()
    return qid, _unit(q.column(1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(qid), -1).astype(np.float32))


def exact(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): the k best of every query (qid, vec) among all vectors (id, vec)."""
    from sheafline.operators.retrieval import dense

    return dense(vectors.select(F.col("id").alias("doc"), "vec"), queries, k).withColumnRenamed("doc", "id")


def calibrate(index: IvfPq, codes: DataFrame, vectors: DataFrame, k: int = 10, recall: float = RECALL) -> tuple[IvfPq, float]:
    """(index, its recall) with the probes and the shortlist that find `recall` of the true k
    neighbours of the held-out vectors; a vector does not count as its own neighbour."""
    q = cut(vectors.where(_held(index.covers)).select(F.col("id").alias("qid"), "vec"))
    qid, qx = _queries(q)
    true = cut(exact(vectors, q, k + 1).where("id <> qid").select("qid", "id"))
    want: dict[int, set[int]] = {}
    cells = np.zeros(len(index.centroids), np.int64)
    place = {int(v): i for i, v in enumerate(qid)}
    order = np.argsort(-(qx @ index.rotation @ index.centroids.T), axis=1) if len(qid) else np.empty((0, len(cells)), np.int64)
    for r in true.join(codes.select("cell", "id"), "id").collect():  # at most a few thousand rows
        want.setdefault(r.qid, set()).add(r.id)
        cells[int(np.flatnonzero(order[place[r.qid]] == r.cell)[0])] += 1
    total = int(cells.sum())
    if not total:
        return index, 1.0
    # Cells that hold more than the recall asked for, so that the shortlist may lose some.
    need = int(np.searchsorted(np.cumsum(cells), (1 + recall) / 2 * total)) + 1
    nprobe, shortlist = min(len(cells), max(probes_for(len(cells)), need)), max(8 * k, LEAST_SHORTLIST)
    while True:
        got = search(index, codes, vectors, q, k + 1, nprobe, shortlist).select("qid", "id").collect()
        share = sum(r.id in want.get(r.qid, ()) for r in got) / total
        if share >= recall or shortlist >= index.covers:
            return replace(index, nprobe=nprobe, shortlist=shortlist), share
        shortlist *= 2


def find(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1000) -> DataFrame:
    """(qid, id, score, rank): exact below EXACT_BELOW vectors, through an index from there on.

    Any number of queries: about `block` of them are searched at once.
    """
    small = vectors.count() < EXACT_BELOW
    index, codes = (None, None) if small else build(vectors)
    blocks = max(1, math.ceil(queries.count() / block))
    out = None
    for i in range(blocks):
        q = queries.where(F.pmod(F.xxhash64("qid", F.lit("block")), F.lit(blocks)) == i)
        part = exact(vectors, q, k) if small else search(index, codes, vectors, q, k)
        # The tables of a block are not kept for the next one.
        part = cut(part.select("qid", "id", "score", "rank")) if blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    return out


def search(index: IvfPq, codes: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, nprobe: int | None = None, shortlist: int | None = None) -> DataFrame:
    """(qid, id, score): the k best of every query (qid, vec), a stated small set.

    Without `nprobe` and `shortlist`, an index over less than EXACT_BELOW vectors is not used: all
    vectors are compared; a larger one uses what it was calibrated to.  The likeliest cells of all queries prune the codes; codes are scored by lookup tables, the
    shortlist of each query is scored again with its exact cosine.
    """
    if nprobe is None and shortlist is None and index.covers < EXACT_BELOW:
        return exact(vectors, queries, k)
    qid, qx = _queries(queries)
    if not len(qid):
        return codes.sparkSession.createDataFrame([], "qid long, id long, score double, rank int")
    z = qx @ index.rotation
    near = z @ index.centroids.T
    n = min(nprobe or index.nprobe or probes_for(len(index.centroids)), len(index.centroids))
    probed = np.argpartition(-near, n - 1, axis=1)[:, :n]
    wanted = sorted({int(c) for r in probed for c in r})
    by_cell: dict[int, list[int]] = {}
    for i, r in enumerate(probed):
        for c in r:
            by_cell.setdefault(int(c), []).append(i)
    # table[q, s, w]: what codeword w of slice s adds to the score of query q.
    table = np.einsum("qsd,swd->qsw", z.reshape(len(z), index.m, -1), index.books)
    most = shortlist or max(8 * k, LEAST_SHORTLIST, index.shortlist)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            cell, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            code = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)
            oq, oi, os_ = [], [], []
            for c in np.unique(cell):
                rows = np.flatnonzero(cell == c)
                for i in by_cell.get(int(c), ()):
                    s = near[i, c] + table[i][np.arange(index.m)[None, :], code[rows]].sum(1)
                    top = np.argpartition(-s, most - 1)[:most] if len(s) > most else np.arange(len(s))
                    oq.append(np.full(len(top), qid[i])), oi.append(ids[rows[top]]), os_.append(s[top])
            if oq:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(oq)), pa.array(np.concatenate(oi)), pa.array(np.concatenate(os_).astype(float))], names=["qid", "id", "score"])

    rough = codes.where(F.col("cell").isin(wanted)).mapInArrow(run, "qid long, id long, score double")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    short = rough.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("qid", "id")
    return _rescore(short.join(vectors, "id"), qid, qx, k)


def _rescore(pairs: DataFrame, qid: np.ndarray, qx: np.ndarray, k: int) -> DataFrame:
    at = {int(v): i for i, v in enumerate(qid)}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                i = np.array([at[int(x)] for x in b.column(0).to_pylist()])
                s = np.einsum("ij,ij->i", _unit(_vecs(b, 2)).astype(np.float64), qx[i].astype(np.float64))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=["qid", "id", "score"])

    s = pairs.select("qid", "id", "vec").mapInArrow(run, "qid long, id long, score double")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search_with_tail(index: IvfPq, codes: DataFrame, indexed: DataFrame, tail: DataFrame, queries: DataFrame, k: int, nprobe: int | None = None) -> DataFrame:
    """The index and, exactly, the vectors added since it was built."""
    from sheafline.operators.retrieval import dense

    a = search(index, codes, indexed, queries, k, nprobe).select("qid", "id", "score")
    b = dense(tail.select(F.col("id").alias("doc"), "vec"), queries, k).select("qid", F.col("doc").alias("id"), "score")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return a.unionByName(b).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def write_index(spark, root: str, index: IvfPq, codes: DataFrame) -> None:
    """Codes by cell and the parameters in a new folder, which a new numbered pointer then names.

    The former pointer stays until the new one is there, so at any time there is a current index;
    of two writers of one number the second is refused.
    """
    import uuid

    name = f"ivf-{uuid.uuid4().hex}"
    codes.repartition("cell").write.partitionBy("cell").parquet(f"{root}/{name}/codes")
    spark.createDataFrame([(bytearray(index.dump()),)], "parameters binary").coalesce(1).write.parquet(f"{root}/{name}/parameters")
    before = _pointers(spark, root)
    fs, to = _at(spark, f"{root}/CURRENT-{max(before, default=0) + 1}")
    s = fs.create(to, False)
    s.write(bytearray(name.encode()))
    s.close()
    for n in before:
        fs.delete(_at(spark, f"{root}/CURRENT-{n}")[1], False)


def _at(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _pointers(spark, root: str) -> list[int]:
    fs, p = _at(spark, root)
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(x.removeprefix("CURRENT-")) for x in names if x.startswith("CURRENT-"))


def read_index(spark, root: str) -> tuple[IvfPq, DataFrame]:
    """The index that the latest whole pointer names."""
    for n in reversed(_pointers(spark, root)):
        got = spark.read.text(f"{root}/CURRENT-{n}").first()
        if got is not None and got[0].startswith("ivf-"):
            index = IvfPq.load(bytes(spark.read.parquet(f"{root}/{got[0]}/parameters").first()[0]))
            return index, spark.read.parquet(f"{root}/{got[0]}/codes").select("cell", "id", "code")
    raise FileNotFoundError(f"no index in {root}")
