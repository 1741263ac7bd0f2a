"""Processing only new or changed records: a Merkle tree over key-range hashes.

Keys are spread evenly by a 64-bit hash; a leaf of the tree is a range of that hash, an inner
node the sum of its children.  A run compares the tree of what it sees with the tree saved by
the last successful run, descends only into nodes whose digests differ, and compares records
only inside the leaves that remain.  Saved records lie in the order of their leaves, so leaves
that are not opened are hardly read.  Output, records and tree are published together
(`MerkleStore`), and a run that another one has overtaken publishes nothing.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafline.session import checkpoint_dir, cut

#: Bits of the children of a node.  The levels follow the number of records, so that a leaf holds
#: about so many of them and a few changes leave most leaves closed; trees that are made by hand
#: have LEVELS.
FANOUT_BITS, ROWS_PER_LEAF = 6, 32
LEVELS = 2
#: Leaves up to this many are named in the filter of a read or broadcast; beyond, they are joined.
NAMED_LEAVES, SENT_LEAVES = 500, 1_000_000
#: A version is written anew once its changes are so many folders or such a share of its records.
MOST_DELTAS, DELTA_SHARE = 16, 0.25
#: Modification times this close mean the same instant (seconds).
MTIME_EPS = 1e-6


def clean_hash(c: Column) -> Column:
    """One spelling of a content hash: no blanks, no algorithm prefix, lower case; blank is null."""
    h = F.regexp_replace(F.lower(F.trim(c)), r"^(sha-?256|sha-?1|md5)\s*[:=]\s*", "")
    return F.when(h != "", h)


def levels_for(n: int, bits: int = FANOUT_BITS) -> int:
    return max(1, min(60 // bits, math.ceil(math.log2(max(2.0, n / ROWS_PER_LEAF)) / bits)))


def key_range(key: Column, levels: int = LEVELS, bits: int = FANOUT_BITS) -> Column:
    """The leaf (0 .. 2**(levels*bits)-1) of a key; null keys belong to leaf of the null hash."""
    return F.shiftrightunsigned(F.xxhash64(key), 64 - levels * bits)


def tree(rows: DataFrame, digest: Column, key: str = "path", levels: int = LEVELS, bits: int = FANOUT_BITS) -> DataFrame:
    """All nodes of the tree over `rows`: (level, node, digest, n).

    Level 0 is the root, level `levels` holds the leaves.  The digest of a leaf is the sum of
    its row digests as an exact decimal (order-free, so partial sums combine before the
    shuffle, and repeated rows still count); an inner node is the sum over its children.
    An empty table gives no nodes.
    """
    leaves = rows.select(key_range(F.col(key), levels, bits).alias("node"), digest.cast("decimal(38,0)").alias("d")).groupBy("node").agg(F.sum("d").alias("digest"), F.count(F.lit(1)).alias("n"))
    # Each leaf adds to its ancestors: at most 2**(levels*bits) rows are expanded, whatever the size of the table.
    up = leaves.select("*", F.explode(F.array(*[F.struct(F.lit(lv).alias("level"), F.shiftrightunsigned("node", (levels - lv) * bits).alias("at")) for lv in range(levels + 1)])).alias("a"))
    return up.groupBy(F.col("a.level").alias("level"), F.col("a.at").alias("node")).agg(F.sum("digest").alias("digest"), F.sum("n").alias("n"))


def changed_leaves(now: DataFrame, saved: DataFrame, levels: int = LEVELS, bits: int = FANOUT_BITS) -> DataFrame:
    """(node) of the leaves that differ, found from the root down: a level's nodes are compared
    only below nodes of the level above that differ."""
    open_nodes: DataFrame | None = None
    for lv in range(levels + 1):
        side = []
        for t in (now, saved):
            t = t.where(F.col("level") == lv).select("node", "digest", "n")
            if open_nodes is not None:
                t = t.withColumn("_up", F.shiftrightunsigned("node", bits)).join(open_nodes.select(F.col("node").alias("_up")), "_up", "left_semi").drop("_up")
            side.append(t)
        a, b = side
        open_nodes = a.alias("a").join(b.alias("b"), F.col("a.node") == F.col("b.node"), "full_outer").where(~(F.col("a.digest").eqNullSafe(F.col("b.digest")) & F.col("a.n").eqNullSafe(F.col("b.n")))).select(F.coalesce("a.node", "b.node").alias("node"))
    return open_nodes


def latest_scan(scan: DataFrame) -> DataFrame:
    """(path, size, mtime, hash) as last seen; rows without a path are ignored.

    Of several rows the latest `seen_at` holds, ties go to the greatest (size, mtime, hash).
    The aggregate combines before the shuffle, so a path with many rows is no hot key.
    """
    at = F.struct(F.col("seen_at"), F.col("size"), F.col("mtime"), clean_hash(F.col("hash")).alias("hash"))
    return scan.where(F.col("path").isNotNull()).groupBy("path").agg(F.max(at).alias("s")).select("path", "s.size", "s.mtime", "s.hash")


def committed_state(files: DataFrame, run_log: DataFrame) -> DataFrame:
    """What is known of each path: (path, has_row, failed, f_size, f_mtime, done, size, mtime, hash, known).

    `done` with size, mtime and hash is the last committed state: the latest of the files row
    with status 'ok' (time `indexed_at`) and the committed rows of the run log (`logged_at`).
    `failed` with f_size and f_mtime is a files row that is not ok and that no commit followed.
    `known` lists every (size, mtime, hash) on record, to name bytes a walk did not read again.
    """
    mark = F.struct(F.col("at"), F.col("size"), F.col("mtime"), F.col("hash"))
    f = files.where(F.col("path").isNotNull()).select("path", "size", "mtime", clean_hash(F.col("hash")).alias("hash"), F.col("indexed_at").cast("double").alias("at"), (F.col("status") == "ok").alias("ok"), F.lit(True).alias("row"))
    g = run_log.where(F.col("path").isNotNull()).select("path", "size", "mtime", clean_hash(F.col("hash")).alias("hash"), (F.unix_micros(F.col("logged_at").cast("timestamp")) / 1e6).alias("at"), (F.col("outcome") == "committed").alias("ok"), F.lit(False).alias("row"))
    u = f.unionByName(g).withColumn("ok", F.coalesce("ok", F.lit(False)))
    s = u.groupBy("path").agg(
        F.max("row").alias("has_row"),
        F.max(F.when(F.col("ok"), mark)).alias("c"),
        F.max(F.when(F.col("row") & ~F.col("ok"), mark)).alias("e"),
        F.collect_set(F.when(F.col("hash").isNotNull(), F.struct("size", "mtime", "hash"))).alias("known"),
    )
    bad = F.col("e").isNotNull() & (F.col("c").isNull() | (F.coalesce(F.col("e.at"), F.lit(float("inf"))) >= F.coalesce(F.col("c.at"), F.lit(float("-inf")))))
    return s.select("path", "has_row", bad.alias("failed"), F.col("e.size").alias("f_size"), F.col("e.mtime").alias("f_mtime"), F.col("c").isNotNull().alias("done"), F.col("c.size").alias("size"), F.col("c.mtime").alias("mtime"), F.col("c.hash").alias("hash"), "known")


def _same_instant(a: Column, b: Column) -> Column:
    return F.abs(a - b) < MTIME_EPS


def _stamp(size: Column, mtime: Column) -> Column:
    """Row digest of a path's state.  Equal digests mean equal size and mtimes in the same
    microsecond; float noise across a boundary only costs a comparison inside the leaf."""
    return F.xxhash64(F.col("path"), size, F.floor(mtime / MTIME_EPS))


def changes(files: DataFrame, run_log: DataFrame, scan: DataFrame, levels: int | None = None, bits: int = FANOUT_BITS, root: str | None = None) -> DataFrame:
    """(path, action) of what the next run must do: 'add', 'update' or 'delete'.

    The record of the last runs is saved as a version of a `MerkleStore` (in `root`, by default a
    new folder of the session's shared one), and the walk is compared with that.  Null paths are
    ignored; a null size or mtime equals nothing; a blank hash is no hash; empty tables are
    allowed on either side (an empty scan deletes all, an empty record adds all).  Repeated rows
    and any order give the same result.  Extra columns are ignored.
    """
    spark = scan.sparkSession
    store = MerkleStore(spark, root or f"{checkpoint_dir(spark)}/state-{uuid.uuid4().hex}", "path", levels, bits)
    known = committed_state(files, run_log).where(F.col("has_row") | F.col("done"))
    pick = lambda c, f: F.when(F.col("failed"), F.col(f)).otherwise(F.col(c))
    store.save(known, _stamp(pick("size", "f_size"), pick("mtime", "f_mtime")))
    return pending(store, scan)


def pending(store: MerkleStore, scan: DataFrame) -> DataFrame:
    """(path, action) of a walk against the saved state of a store (see `changes`)."""
    now = latest_scan(scan).withColumn("_digest", _stamp(F.col("size"), F.col("mtime")))
    now, known = store.opened(now)
    n, k = now.alias("n"), known.alias("k")
    j = n.join(k, F.col("n.path") == F.col("k.path"), "full_outer")
    like = F.filter(F.col("k.known"), lambda x: (x["size"] == F.col("n.size")) & _same_instant(x["mtime"], F.col("n.mtime")))
    now_hash = F.coalesce(F.col("n.hash"), F.get(like, F.lit(0))["hash"])
    equal = ((F.col("n.size") == F.col("k.size")) & _same_instant(F.col("n.mtime"), F.col("k.mtime"))) | (now_hash == F.col("k.hash"))
    retry = ~((F.col("n.size") == F.col("k.f_size")) & _same_instant(F.col("n.mtime"), F.col("k.f_mtime")))
    action = (
        F.when(F.col("n.path").isNull(), "delete")
        .when(F.col("k.path").isNull(), "add")
        .when(F.col("k.failed"), F.when(F.coalesce(retry, F.lit(True)), "update"))
        .when(~F.coalesce(equal, F.lit(False)), "update")
    )
    return j.select(F.coalesce("n.path", "k.path").alias("path"), action.alias("action")).where(F.col("action").isNotNull())


class Conflict(RuntimeError):
    """Another run has published since this one began; nothing of this one was."""


class MerkleStore:
    """Versions of (output, records, tree), published together.

    A run writes new folders and then creates the next numbered pointer file, which fails if
    another run has created it meanwhile (`Conflict`).  Until then the former version stays the
    current one.  A run that dies leaves unreferenced folders behind and nothing else: the next
    run sees the same changes again, none twice and none lost.  A run writes its changed records
    only; from time to time they are merged.  `root` must be a folder every executor reaches.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "key", levels: int | None = None, bits: int = FANOUT_BITS):
        self.spark, self.root, self.key, self.levels, self.bits = spark, root.rstrip("/"), key, levels, bits
        #: Leaves that the last comparison opened.
        self.last_opened = 0

    # --- versions
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointers(self) -> list[int]:
        fs, p = self._fs(self.root)
        if not fs.exists(p):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(p)]
        return sorted(int(x.removeprefix("current-")) for x in names if x.startswith("current-") and x.removeprefix("current-").isdigit())

    def manifest(self) -> dict | None:
        """The published version, None before the first.  A pointer whose writer died is none."""
        for n in reversed(self._pointers()):
            fs, p = self._fs(f"{self.root}/current-{n}")
            s = fs.open(p)
            raw = bytes(s.readAllBytes())
            s.close()
            try:
                return {**json.loads(raw), "number": n}
            except ValueError:
                continue
        return None

    def current(self) -> str | None:
        """Folder of the published version, or None before the first run."""
        m = self.manifest()
        return f"{self.root}/{m['version']}" if m else None

    def _publish(self, version: dict, base: dict | None) -> None:
        now = self.manifest()
        if (now or {}).get("number") != (base or {}).get("number"):
            raise Conflict(f"version {(now or {}).get('number')} was published meanwhile")
        n = max(self._pointers(), default=0) + 1
        fs, p = self._fs(f"{self.root}/current-{n}")
        try:
            s = fs.create(p, False)  # fails if it exists
        except Exception as e:
            raise Conflict(f"version {n} was published meanwhile") from e
        s.write(bytearray(json.dumps(version).encode()))
        s.close()
        for i in self._pointers():
            if i < n - 1:
                fs.delete(self._fs(f"{self.root}/current-{i}")[1], False)

    # --- records
    def _leaf(self, levels: int) -> Column:
        return key_range(F.col(self.key), levels, self.bits)

    def _write(self, rows: DataFrame, folder: str) -> str:
        """Rows in the order of their leaves: statistics of a file skip most closed leaves."""
        at = f"{self.root}/{folder}"
        rows.repartitionByRange("_leaf").sortWithinPartitions("_leaf").write.parquet(at)
        return at

    def _tree(self, rows: DataFrame, levels: int) -> DataFrame:
        return tree(rows, F.col("_digest"), self.key, levels, self.bits)

    def _in(self, rows: DataFrame, leaves: DataFrame, named: list[int] | None) -> DataFrame:
        if named is not None:
            return rows.where(F.col("_leaf").isin(named)) if named else rows.where(F.lit(False))
        side = F.broadcast(leaves) if self.last_opened <= SENT_LEAVES else leaves
        return rows.join(side.select(F.col("node").alias("_leaf")), "_leaf", "left_semi")

    def records(self, m: dict, leaves: DataFrame | None = None, named: list[int] | None = None) -> DataFrame:
        """The records of a version, in the given leaves or all: the latest row of each key."""
        rows = self.spark.read.parquet(*m["base"])
        if m["deltas"]:
            rows = rows.unionByName(self.spark.read.parquet(*m["deltas"]), allowMissingColumns=True)
        if leaves is not None:
            rows = self._in(rows, leaves, named)
        if m["deltas"]:
            cols = [c for c in rows.columns if c != self.key]
            rows = rows.groupBy(self.key).agg(F.max_by(F.struct(*cols), "_version").alias("r")).select(self.key, "r.*")
        return rows.where("not _gone").drop("_gone", "_version")

    def save(self, rows: DataFrame, digest: Column, base: dict | None = None, name: str | None = None, outputs: list[str] = ()) -> None:
        """Publishes a version that holds just `rows` (the key once), after version `base`."""
        name = name or f"v-{uuid.uuid4().hex}"
        # Written without leaves first, as their number follows the number of rows.
        state = cut(rows.withColumn("_digest", digest))
        n = state.count()
        levels = self.levels or levels_for(n, self.bits)
        state = state.withColumn("_leaf", self._leaf(levels)).withColumn("_version", F.lit((base or {}).get("number", 0) + 1)).withColumn("_gone", F.lit(False))
        at = self._write(state, f"{name}/records")
        self._tree(state, levels).write.parquet(f"{self.root}/{name}/tree")
        self._publish({"version": name, "base": [at], "deltas": [], "tree": f"{self.root}/{name}/tree", "levels": levels, "rows": n, "changed": 0, "outputs": list(outputs)}, base)

    def opened(self, now: DataFrame, m: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """(rows of now, saved records) in the leaves whose digests differ.

        now: the key once, `_digest` and any other columns.
        """
        m = m or self.manifest()
        now = cut(now.withColumn("_leaf", self._leaf(m["levels"])))
        t_now = cut(self._tree(now, m["levels"]))
        leaves = cut(changed_leaves(t_now, self.spark.read.parquet(m["tree"]), m["levels"], self.bits))
        self.last_opened = leaves.count()
        named = [r.node for r in leaves.collect()] if self.last_opened <= NAMED_LEAVES else None
        self._last_tree = t_now
        return self._in(now, leaves, named).drop("_leaf"), self.records(m, leaves, named).drop("_leaf")

    @staticmethod
    def _content(records: DataFrame, key: str) -> Column:
        return F.xxhash64(F.col(key), *[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in records.columns if c != key])

    def diff(self, records: DataFrame, m: dict | None = None) -> DataFrame:
        """(key, action) against the published version; `records` must hold the key once.

        Every other column counts towards the content, in the order given, nulls included.
        """
        return self._diff(records, m or self.manifest()).select(self.key, "action")

    def _diff(self, records: DataFrame, m: dict | None) -> DataFrame:
        k = self.key
        now = records.select(k, self._content(records, k).alias("_digest"))
        if m is None:
            return now.select(k, F.lit("add").alias("action"), "_digest")
        a, b = self.opened(now, m)
        j = a.alias("a").join(b.alias("b"), F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")), "full_outer")
        act = F.when(F.col("b._digest").isNull(), "add").when(F.col("a._digest").isNull(), "delete").when(F.col("a._digest") != F.col("b._digest"), "update")
        return j.select(F.coalesce(f"a.{k}", f"b.{k}").alias(k), act.alias("action"), F.col("a._digest").alias("_digest")).where("action is not null")

    def run(self, records: DataFrame, process: Callable[[DataFrame], DataFrame]) -> str:
        """Processes the added and changed records and publishes output, records and tree.

        Returns the folder of the version, whose part `output` is what `process` gave.
        """
        k, base, name = self.key, self.manifest(), f"v-{uuid.uuid4().hex}"
        todo = cut(self._diff(records, base))
        t_now = self._last_tree if base else None
        out = f"{self.root}/{name}/output"
        process(records.join(todo.where("action <> 'delete'").select(k), k, "left_semi")).write.parquet(out)
        outputs = [*(base or {"outputs": []})["outputs"], out]
        changed = todo.count()
        if base is None or len(base["deltas"]) >= MOST_DELTAS or base["changed"] + changed > DELTA_SHARE * max(1, base["rows"]):
            self.save(records.select(k, self._content(records, k).alias("_digest")), F.col("_digest"), base, name, outputs)
        else:
            rows = todo.select(k, "_digest", self._leaf(base["levels"]).alias("_leaf"), F.lit(base["number"] + 1).alias("_version"), (F.col("action") == "delete").alias("_gone"))
            at = self._write(rows, f"{name}/records")
            t_now.write.parquet(f"{self.root}/{name}/tree")
            self._publish({**{x: base[x] for x in ("base", "levels", "rows")}, "version": name, "deltas": [*base["deltas"], at], "tree": f"{self.root}/{name}/tree", "changed": base["changed"] + changed, "outputs": outputs}, base)
        return f"{self.root}/{name}"
