"""Near-duplicate records with small edits: covering locality-sensitive hashing.

The signature of a record has GROUPS x 11 positions, each the minimum of a hash over its word
shingles; two records agree in a position with the probability of their Jaccard similarity.
The tables are structured masks over the positions: the eleven blocks of the (11, 5, 2) biplane,
each keeping five positions of a group.  Three positions of a group never meet all eleven
blocks, so every pair that differs in at most three positions of some group collides in some
table of it: every pair within Hamming radius 4 x GROUPS - 1 of the signatures collides once, and
every pair within 4 x (GROUPS - 1) - 1 in at least two tables.  Two collisions make a candidate,
as unlike pairs hardly ever collide twice, and candidates are verified with the exact similarity.  Records with equal shingle sets are one class and
enter the tables once.

The tables hold many more keys than the collection has records, so keys travel packed: a task
sorts the keys of many records into ranges and sends each range as one compressed block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.arrow import map_rows
from sheafline.llm.library import MAX_IDS, bounded
from sheafline.session import cut

GROUPS, WIDTH = 14, 11
#: Tables in which a candidate has to collide.
COLLISIONS = 2
#: The eleven masks: the quadratic residues modulo 11, shifted.
MASKS = tuple(tuple(sorted((x + s) % WIDTH for x in (1, 3, 4, 5, 9))) for s in range(WIDTH))
_RUN = re.compile(r"[^\W_]+")
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: Members of a bucket that are paired where they lie; the pairs of larger buckets are made in
#: squares of this side, spread over all tasks.
MAX_RUN = 256
#: Records whose keys are packed together, records hashed at once, and keys that one task sorts.
PACKED, AT_ONCE, KEYS_PER_TASK = 20_000, 8192, 4_000_000
#: Pairs made at once.
PAIRS_AT_ONCE = 1 << 20


def bits_for(n: int) -> tuple[int, int]:
    """Bits of the keys and of the short class hashes in the tables of n records.

    They grow with n, so that chance collisions of keys stay fewer than the records, and those of
    classes fewer than one in a hundred of them.  Neither loses anything: a class is told apart by
    a second hash of 64 bits, and a collision by the exact similarity.
    """
    b = max(10, int(n).bit_length())
    return min(48, b + 13), min(40, b + 6)


class _Words(dict):
    """64-bit hashes of the words of a piece of text without blanks, forgotten once 400,000
    pieces are held."""

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > 400_000:
            self.clear()
        self[piece] = h = tuple(int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for w in _RUN.findall(piece))
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _M[3]
    return h ^ (h >> np.uint64(32))


def shingle_hashes(texts: list[str | None], k: int, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct hashes of the k-word shingles of each text, in order."""
    flat: list[int] = []
    n = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            # Words never span blanks, so most pieces are known and cost one lookup.
            before = len(flat)
            flat.extend(chain.from_iterable(map(words.__getitem__, t.lower().split())))
            n[i] = len(flat) - before
    at = np.concatenate([[0], np.cumsum(n)])
    w = np.array(flat, np.uint64)
    if len(w) < k:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    m = len(w) - k + 1
    h = np.zeros(m, np.uint64)
    for j in range(k):
        h = _mix(h + w[j : j + m] * _M[j % 3] + np.uint64(j + 1))
    owner = np.repeat(np.arange(len(texts)), n)
    good = owner[:m] == owner[k - 1 :]
    h, owner = h[good], owner[:m][good]
    if len(texts) > 1 << 14:
        raise ValueError("at most 16,384 texts at once")
    # Owner and 50 bits of the hash in one number, which sorts faster than two.
    both = np.sort((owner.astype(np.uint64) << np.uint64(50)) | (h >> np.uint64(14)))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    at = np.searchsorted(both, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(50))
    return (both & np.uint64((1 << 50) - 1)) * _M[0], at


def set_hashes(h: np.ndarray, offsets: np.ndarray, class_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, of class_bits and 64 bits; both 0 for an empty set."""
    n = np.diff(offsets).astype(np.uint64)

    def total(x: np.ndarray) -> np.ndarray:
        c = np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
        return _mix(c[offsets[1:]] - c[offsets[:-1]] + n * _M[0])

    short = (total(h) >> np.uint64(64 - class_bits)) | np.uint64(1 << class_bits)
    return np.where(n > 0, short, np.uint64(0)).view(np.int64), np.where(n > 0, total(_mix(h * _M[1]) * _M[2]), np.uint64(0)).view(np.int64)


def table_keys(h: np.ndarray, offsets: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """(sets, groups x 11) keys of non-empty sets: the masked signatures."""
    rng = np.random.default_rng(20_240_501)
    a, b = rng.integers(0, 1 << 32, groups * WIDTH, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, groups * WIDTH, np.uint32)
    low, starts = (h >> np.uint64(16)).astype(np.uint32), offsets[:-1]
    sig = np.stack([np.minimum.reduceat(low * a[i] + b[i], starts) for i in range(groups * WIDTH)], 1).astype(np.uint64) if len(starts) else np.empty((0, groups * WIDTH), np.uint64)
    out = np.empty((len(starts), groups * WIDTH), np.uint64)
    for g in range(groups):
        for m, mask in enumerate(MASKS):
            key = np.full(len(starts), g * WIDTH + m + 1, np.uint64)
            for p in mask:
                key = _mix(key * _M[0] + sig[:, g * WIDTH + p])
            out[:, g * WIDTH + m] = key
    return out.view(np.int64)


def _pack(keys: np.ndarray, cls: np.ndarray) -> bytes:
    """Keys in order with their classes: differences and classes as planes of bytes, compressed."""
    d = np.diff(keys, prepend=np.uint64(0))
    planes = np.concatenate([x.view(np.uint8).reshape(-1, 8).T[:6].ravel() for x in (d, cls.astype(np.uint64))])
    return np.int64(len(keys)).tobytes() + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob[:8], np.int64)[0])
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], 12 * n, asbytes=True), np.uint8).reshape(12, n)
    wide = np.zeros((2, n, 8), np.uint8)
    wide[0, :, :6], wide[1, :, :6] = planes[:6].T, planes[6:].T
    d, cls = wide[0].reshape(-1).view(np.uint64), wide[1].reshape(-1).view(np.int64)
    return np.cumsum(d, dtype=np.uint64), cls


_FLOW = pa.schema([("p", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("cls", pa.int64()), ("cls2", pa.int64()), ("blob", pa.binary())])
_FLOW_DDL = "p int, a long, b long, cls long, cls2 long, blob binary"


def _flow(p, a=None, b=None, cls=None, cls2=None, blob=None) -> pa.RecordBatch:
    n = len(p)
    cols = (pa.array(x, f.type) if x is not None else pa.nulls(n, f.type) for x, f in zip((p, a, b, cls, cls2, blob), _FLOW))
    return pa.RecordBatch.from_arrays(list(cols), schema=_FLOW)


def _hashed(docs: DataFrame, k: int, groups: int, parts: int, key_bits: int, class_bits: int) -> DataFrame:
    """One pass over the texts.  Rows of a record: a = id, b = grp, cls, cls2.  Rows of a range p
    of keys: blob, the packed keys of many classes; a class may come from several tasks."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = _Words(), set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held = 0

        def send() -> Iterator[pa.RecordBatch]:
            keys, cls = np.concatenate([x for x, _ in held]), np.concatenate([c for _, c in held])
            order = np.argsort(keys)
            keys, cls = keys[order], cls[order]
            edges = np.searchsorted(keys, (np.arange(parts + 1, dtype=np.uint64) << np.uint64(key_bits)) // np.uint64(parts))
            full = np.flatnonzero(np.diff(edges))
            for s in range(0, len(full), 256):
                some = full[s : s + 256].tolist()
                yield _flow(some, blob=[_pack(keys[edges[p] : edges[p + 1]], cls[edges[p] : edges[p + 1]]) for p in some])

        for whole in it:
            for at_ in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at_, AT_ONCE)
                h, at = shingle_hashes(batch.column(2).to_pylist(), k, words)
                cls, cls2 = set_hashes(h, at, class_bits)
                on = np.flatnonzero(cls)
                if not len(on):
                    continue
                take = pa.array(on)
                where = (cls[on] % parts).astype(np.int32)
                yield _flow(where, batch.column(0).take(take), batch.column(1).take(take), cls[on], cls2[on])
                keep = []
                for i in on.tolist():
                    c = int(cls2[i])
                    if c not in seen:
                        seen.add(c)
                        keep.append(i)
                if len(seen) > 500_000:
                    seen.clear()  # only saves work; copies meet again behind the shuffle
                if not keep:
                    continue
                keep = np.array(keep)
                n = (at[1:] - at[:-1])[keep]
                rows = np.repeat(at[:-1][keep] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                keys = table_keys(h[rows], np.concatenate([[0], np.cumsum(n)]), groups)
                held.append(((keys.view(np.uint64) >> np.uint64(64 - key_bits)).ravel(), np.repeat(cls[keep], keys.shape[1])))
                n_held += len(keep)
                if n_held >= PACKED:
                    yield from send()
                    held, n_held = [], 0
        if held:
            yield from send()

    return docs.select("id", "grp", "text").mapInArrow(run, _FLOW_DDL)


def _squares(n: int, side: int) -> Iterator[tuple[int, int]]:
    c = -(-n // side)
    for i in range(c):
        for j in range(i, c):
            yield i * side, j * side


def _pairs_within(cls: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The distinct pairs of the buckets (rows starts .. starts + sizes of cls, in order) and how
    many buckets show them, some at once."""
    for n in np.unique(sizes).tolist():
        s = starts[sizes == n]
        i, j = np.triu_indices(n, 1)
        step = max(1, PAIRS_AT_ONCE // len(i))
        for x in range(0, len(s), step):
            at = s[x : x + step, None]
            a, b = cls[(at + i).ravel()], cls[(at + j).ravel()]
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            yield a[first], b[first], np.diff(np.concatenate([first, [len(a)]]))


def _met(flow: DataFrame, parts: int, side: int) -> DataFrame:
    """Rows of records as they are; pairs of classes that share buckets as a, b with p = -1 and the
    number of these buckets as cls; pairs of chunks of large buckets as blobs with p = -2."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, list[bytes]] = {}
        for batch in it:
            blob = batch.column(5)
            is_record = blob.is_null()
            records = batch.filter(is_record)
            if records.num_rows:
                yield records
            rest = batch.filter(pa.compute.invert(is_record))
            for p, x in zip(rest.column(0).to_pylist(), rest.column(5).to_pylist()):
                ranges.setdefault(p, []).append(x)
        for p in sorted(ranges):
            got = [_unpack(x) for x in ranges.pop(p)]
            keys, cls = np.concatenate([x for x, _ in got]), np.concatenate([c for _, c in got])
            order = np.argsort(keys)
            keys, cls = keys[order], cls[order]
            # Most keys stand alone; only the others are put in order by class.
            same = keys[1:] == keys[:-1]
            met = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
            keys, cls = keys[met], cls[met]
            order = np.lexsort((cls, keys))
            keys, cls = keys[order], cls[order]
            # Rows of the same key and class are copies from other tasks.
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (cls[1:] != cls[:-1])
            keys, cls = keys[new], cls[new]
            if not len(keys):
                continue
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(keys)]]))
            some = (sizes > 1) & (sizes <= side)
            for a, b, n in _pairs_within(cls, starts[some], sizes[some]):
                yield _flow(np.full(len(a), -1), a, b, n)
            for s, n in zip(starts[sizes > side].tolist(), sizes[sizes > side].tolist()):
                c = cls[s : s + n]
                for i, j in _squares(n, side):
                    yield _flow([-2], [i], [j], blob=[np.concatenate([[np.int64(len(c[i : i + side]))], c[i : i + side], c[j : j + side]]).tobytes()])

    return flow.repartitionById(parts, "p").mapInArrow(run, _FLOW_DDL)


def _collisions(met: DataFrame) -> DataFrame:
    """(a, b) of classes that share at least COLLISIONS buckets, a < b, each once."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for x in batch.column(0).to_pylist():
                v = np.frombuffer(x, np.int64)
                left, right = v[1 : 1 + v[0]], v[1 + v[0] :]
                i, j = np.nonzero(left[:, None] < right[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(left[i]), pa.array(right[j])], schema=schema)

    small = met.where("p = -1").select("a", "b", F.col("cls").alias("n"))
    # Squares of one large bucket go to many tasks.
    large = met.where("p = -2").select("blob").repartition(F.xxhash64("blob")).mapInArrow(run, "a long, b long")
    return small.unionByName(large.withColumn("n", F.lit(1).cast("long"))).groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= COLLISIONS).select("a", "b")


def similar_classes(docs: DataFrame, members_: DataFrame, cand: DataFrame, threshold: float, k: int) -> DataFrame:
    """(a, a2, b, b2, jaccard) of classes with different shingle sets and at least the similarity."""
    # Classes of one short hash and two long ones are candidates of each other.
    twins = members_.groupBy("cls").agg((F.min("cls2") != F.max("cls2")).alias("t")).where("t").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    cand = cut(cand.unionByName(twins))
    wanted = cand.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    # One record of each class that has a candidate is read again for the exact check.
    reps = cut(members_.join(bounded(wanted), "cls", "left_semi").groupBy("cls", "cls2").agg(F.min("id").alias("id")))
    texts = docs.select("id", "text").join(bounded(reps, MAX_IDS), "id")

    def make():
        words = _Words()

        def f(cls, cls2, ts):
            sets = []
            for s in range(0, len(ts), AT_ONCE):
                h, at = shingle_hashes(ts[s : s + AT_ONCE], k, words)
                h = h.view(np.int64)
                sets += [h[x:y].tolist() for x, y in zip(at[:-1], at[1:])]
            return cls, cls2, sets

        return f

    # Ids are unique, but a repeated one must not double a pair.
    sets = map_rows(texts, ["cls", "cls2", "text"], make, "cls long, cls2 long, s array<long>").dropDuplicates(["cls", "cls2"])
    a, b = (sets.select(F.col("cls").alias(x), F.col("cls2").alias(f"{x}2"), F.col("s").alias(f"s{x}")) for x in ("a", "b"))
    j = cand.join(a, "a").join(b, "b").where((F.col("a") < F.col("b")) | (F.col("a2") < F.col("b2")))
    both = F.size(F.array_intersect("sa", "sb"))
    j = j.select("a", "a2", "b", "b2", (both / (F.size("sa") + F.size("sb") - both)).alias("jaccard"))
    return j.where(F.col("jaccard") >= threshold - 1e-12)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 5, groups: int = GROUPS, side: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, members) of docs (id, grp, text).

    links: (a, a2, b, b2, jaccard) between classes (cls, cls2) of equal shingle sets whose
    similarity is at least the threshold, each pair once.  members: (id, grp, cls, cls2).  Records
    without a full shingle (null, empty, or fewer than k words) belong to no class and are like
    nothing.  The guarantee is on the signatures' radius; the default of 14 groups shows a pair of
    similarity 0.70 in fewer than two tables with a probability of 7e-7, of 0.75 with 2e-9.
    """
    docs = docs.select("id", "grp", "text")
    n = docs.count()
    parts = max(1, docs.sparkSession.sparkContext.defaultParallelism, -(-n * groups * WIDTH // KEYS_PER_TASK))
    met = cut(_met(_hashed(docs, k, groups, parts, *bits_for(n)), parts, side or MAX_RUN))
    m = met.where("p >= 0").select(F.col("a").alias("id"), F.col("b").alias("grp"), "cls", "cls2")
    return similar_classes(docs, m, _collisions(met), threshold, k), m


_CLS = ("cls", "cls2")


def record_pairs(links: DataFrame, members_: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of similar records of different grp: the classes expanded."""
    x, y = members_.alias("x"), members_.alias("y")
    differ = ~F.col("x.grp").eqNullSafe(F.col("y.grp"))
    across = links.join(x, (F.col("a") == F.col("x.cls")) & (F.col("a2") == F.col("x.cls2"))).join(y, (F.col("b") == F.col("y.cls")) & (F.col("b2") == F.col("y.cls2"))).where(differ).select(F.least("x.id", "y.id").alias("id_a"), F.greatest("x.id", "y.id").alias("id_b"))
    several = members_.groupBy(*_CLS).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*_CLS)
    copies = members_.join(several, list(_CLS), "left_semi")
    u, v = copies.alias("x"), copies.alias("y")
    within = u.join(v, (F.col("x.cls") == F.col("y.cls")) & (F.col("x.cls2") == F.col("y.cls2"))).where(F.col("x.id") < F.col("y.id")).where(differ).select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
    return across.unionByName(within).where("id_a < id_b").distinct()


def record_links(links: DataFrame, members_: DataFrame) -> DataFrame:
    """(id, class_id, copies, links): per record its class (least id of it), the size of the
    class, and the number of other classes that it is similar to."""
    size = members_.groupBy(*_CLS).agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("cls"), F.col("a2").alias("cls2")), F.struct(F.col("b").alias("cls"), F.col("b2").alias("cls2")))).alias("e")
    deg = links.select(ends).select("e.*").groupBy(*_CLS).agg(F.count(F.lit(1)).alias("links"))
    per = size.join(deg, list(_CLS), "left").fillna({"links": 0})
    return members_.join(per, list(_CLS)).select("id", "class_id", "copies", "links")


def file_classes(files: DataFrame) -> DataFrame:
    """(id, class_id, copies) of files (id, hash) with a non-blank hash in any spelling: class_id is
    the least id with that hash.  Null and blank hashes are in no class; repeated rows count once."""
    h = F.regexp_replace(F.lower(F.trim("hash")), r"^(sha-?256|sha-?1|md5)\s*[:=]\s*", "")
    f = files.select("id", h.alias("h")).where("h <> ''").distinct()
    c = f.groupBy("h").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    return f.join(c, "h").select("id", "class_id", "copies")


def equal_files(files: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of files of one class: its classes (`file_classes`) expanded."""
    f = file_classes(files).where("copies > 1").select("id", "class_id")
    return f.alias("x").join(f.alias("y"), "class_id").where("x.id < y.id").select(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b")).distinct()
