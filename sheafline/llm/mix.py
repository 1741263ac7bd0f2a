"""Mixing sources to target weights by cube-method balanced sampling.

Each document of a source gets the same expected number of copies; its whole part is certain,
its fraction is an inclusion probability.  The cube method moves the fractions through the null
space of the balance equations (tokens and documents of the source) until only a few are left:
first inside blocks of bounded size, then over what the blocks left, until one small landing
problem per source remains.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafline.llm.arrow import map_rows
from sheafline.session import cut

#: A public vocabulary (ranks of a byte-level BPE); a parameter wherever texts are counted.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of a block; a task holds one block at a time.
BLOCK = 4096
_EPS = 1e-9


def counter(path: str = TOKENIZER) -> Callable[[list], list[int]]:
    """A function of a list of texts to their token counts (null: 0)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    enc = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def count_tokens(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(id, source, tokens) of docs (id, source, text).  The vocabulary lies with the driver and
    is given to the executors."""
    docs.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def make():
        from pyspark import SparkFiles

        count = counter(SparkFiles.get(name))
        return lambda ids, sources, texts: (ids, sources, count(texts))

    return map_rows(docs, ["id", "source", "text"], make, "id long, source string, tokens long")


def flight(pi: np.ndarray, balance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase: moves probabilities to 0 or 1 while `balance.T @ pi` stays as it is.

    balance: (n, p) values whose totals are kept.  At most p entries stay strictly between.
    Each step looks at p + 1 open units, takes a vector of the null space of their balance
    equations and moves both ways with the probabilities that keep the expectation.
    """
    pi = np.where(pi < _EPS, 0.0, np.where(pi > 1 - _EPS, 1.0, pi)).astype(float)
    n, p = balance.shape
    open_ = [i for i in range(n) if 0.0 < pi[i] < 1.0]
    rng.shuffle(open_)
    window, nxt = open_[: p + 1], p + 1
    draw = iter(rng.random(4 * len(open_) + 8))
    while len(window) > 0:
        a = balance[window].T
        m = len(window)
        if m == 3 and p == 2:
            # The cross product spans the null space of two equations in three unknowns.
            x, y = a
            u = np.array([x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0]])
            if np.abs(u).max() < 1e-12 * max(1.0, np.abs(a).max()):
                u = np.linalg.svd(a)[2][-1]
        else:
            _, s, vt = np.linalg.svd(a, full_matrices=True)
            if (s > 1e-9 * max(1.0, s[0] if len(s) else 1.0)).sum() >= m:
                break
            u = vt[-1]
        v = pi[window]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > 1e-15, (1 - v) / u, np.where(u < -1e-15, -v / u, np.inf)))
            down = np.min(np.where(u > 1e-15, v / u, np.where(u < -1e-15, (v - 1) / u, np.inf)))
        v = v + up * u if next(draw) < down / (up + down) else v - down * u
        v = np.where(v < _EPS, 0.0, np.where(v > 1 - _EPS, 1.0, v))
        pi[window] = v
        left = [w for w, x in zip(window, v) if 0.0 < x < 1.0]
        if len(left) == m:
            break  # no movement is possible any more
        while len(left) < p + 1 and nxt < len(open_):
            left.append(open_[nxt])
            nxt += 1
        if len(left) <= p and nxt >= len(open_):
            window = left
            a = balance[window].T
            if len(window) == 0 or np.linalg.matrix_rank(a) >= len(window):
                break
            continue
        window = left
    return pi


def landing(pi: np.ndarray, balance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rounds the few units the flight left: of all roundings the one whose totals miss least,
    among those drawn by chance where several miss alike.  At most 12 units are enumerated;
    the flight leaves p."""
    pi = pi.copy()
    at = [i for i in range(len(pi)) if 0.0 < pi[i] < 1.0]
    if not at:
        return pi
    if len(at) > 12:
        pi[at] = rng.random(len(at)) < pi[at]
        return pi
    want = balance[at].T @ pi[at]
    scale = np.maximum(np.abs(balance[at]).max(axis=0), 1e-12)
    choices = np.array([[(c >> k) & 1 for k in range(len(at))] for c in range(1 << len(at))], float)
    miss = (np.abs(choices @ balance[at] - want) / scale).sum(axis=1) + rng.random(len(choices)) * 1e-9
    pi[at] = choices[int(miss.argmin())]
    return pi


def plan(tokens: DataFrame, targets: DataFrame, mix_tokens: float | None = None, keep_shares: bool = False) -> DataFrame:
    """Per target: (source, key, weight, want, have, docs, most_docs, rate).

    tokens: (id, source, tokens).  Sources count by name without letter case and outer blanks; a
    null source has no target, a null weight is 0 and a null max_repeat 1.  want is weight x mix
    size, the mix as large as all documents of the targeted sources unless given; with keep_shares
    it is the largest at which no source that has documents runs out, so that their shares among
    each other are those of the weights.  rate is the expected number of copies of each document.
    """
    key = lambda c: F.lower(F.trim(F.col(c)))
    have = tokens.groupBy(key("source").alias("key")).agg(F.sum("tokens").alias("have"), F.count(F.lit(1)).alias("docs"))
    t = targets.where(F.col("source").isNotNull()).select("source", key("source").alias("key"), F.coalesce(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"), F.coalesce(F.col("max_repeat").cast("long"), F.lit(1)).alias("times"))
    j = t.join(have, "key", "left").fillna({"have": 0, "docs": 0})
    one = j.dropDuplicates(["key"])
    if keep_shares:
        total = one.where("have > 0 and weight > 0").agg(F.coalesce(F.min(F.col("times") * F.col("have") / F.col("weight")), F.lit(0.0)).alias("size"))
    else:
        total = one.agg(F.coalesce(F.sum("have"), F.lit(0)).cast("double").alias("size"))
    total = total.select(F.lit(float(mix_tokens)).alias("size")) if mix_tokens is not None else total
    j = j.crossJoin(F.broadcast(total)).withColumn("want", F.col("weight") * F.col("size"))  # one row
    rate = F.when(F.col("have") > 0, F.least(F.col("want") / F.col("have"), F.col("times").cast("double"))).otherwise(F.lit(0.0))
    return j.select("source", "key", "weight", "want", "have", "docs", (F.col("times") * F.col("docs")).alias("most_docs"), rate.alias("rate"))


def _fly(last: bool, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, int(pdf["block"].iloc[0]) & 0x7FFFFFFF, len(pdf)])
        balance = np.column_stack([np.maximum(pdf["tokens"].to_numpy(float), 0.0), np.ones(len(pdf))])
        pi = flight(pdf["pi"].to_numpy(float), balance, rng)
        if last:
            pi = landing(pi, balance, rng)
        return pd.DataFrame({"id": pdf["id"], "key": pdf["key"], "tokens": pdf["tokens"], "sure": pdf["sure"], "pi": pi})

    return f


_UNITS = "id long, key string, tokens long, sure long, pi double"


#: Blocks of one task.
BLOCKS_PER_TASK = 16


def mix(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, mix_tokens: float | None = None, seed: int = 7, block: int = BLOCK, keep_shares: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sample, report) of docs (id, source, text) and targets (source, weight, max_repeat).

    sample: (id, source, copies, tokens) of the documents in the mix; no document has more than
    max_repeat copies.  report: per target source its wanted and actual tokens and shares, and
    whether it fell short: the sample holds every copy that it may and yet too few tokens.  Ids
    must be unique; null texts have no tokens and are kept with the probability of their source;
    sources without a target are left out.  An empty table gives an empty sample and targets that
    are all short.  See `plan` for the size of the mix and keep_shares.
    """
    tokens = cut(count_tokens(docs, tokenizer))
    # One row per target: a table of the caller's, small by its nature and checked here.
    todo = cut(plan(tokens, targets, mix_tokens, keep_shares))
    rows = todo.dropDuplicates(["key"]).select("key", "rate", "docs").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 target sources")
    spark = docs.sparkSession
    rates = F.broadcast(spark.createDataFrame([(r.key, float(r.rate), max(1, -(-int(r.docs) // block))) for r in rows], "key string, rate double, blocks long"))
    units = tokens.withColumn("key", F.lower(F.trim("source"))).join(rates, "key").select("id", "key", "tokens", F.floor("rate").alias("sure"), (F.col("rate") - F.floor("rate")).alias("pi"), "blocks")
    counts = {r.key: int(r.docs) for r in rows}
    done: list[DataFrame] = []
    open_units, level = units, 0
    while True:
        last = max(counts.values(), default=0) <= block
        n = sum(max(1, -(-c // block)) for c in counts.values()) if counts else 1
        blocks = F.lit(0).cast("long") if last else F.pmod(F.xxhash64("id", F.lit(seed + level)), F.col("blocks"))
        # As many tasks as the blocks need: the blocks are few rows each, and would else be put together.
        tasks = max(min(n, 4 * spark.sparkContext.defaultParallelism), n // BLOCKS_PER_TASK)
        flown = open_units.withColumn("block", blocks).select("id", "key", "tokens", "sure", "pi", "block").repartition(tasks, "key", "block").groupBy("key", "block").applyInPandas(_fly(last, seed + level), _UNITS)
        flown = cut(flown)
        if last:
            done.append(flown)
            break
        still = (F.col("pi") > 0) & (F.col("pi") < 1)
        done.append(flown.where(~still))
        open_units = flown.where(still)
        # A block leaves at most two units; the next level has fewer blocks by block / 2.
        counts = {r.key: r["count"] for r in open_units.groupBy("key").count().collect()}
        most = max(counts.values(), default=0)
        open_units = open_units.withColumn("blocks", F.lit(max(1, -(-most // block))).cast("long"))
        level += 1
    sample = done[0]
    for d in done[1:]:
        sample = sample.unionByName(d)
    sample = sample.select("id", F.col("key").alias("source"), (F.col("sure") + F.round("pi").cast("long")).alias("copies"), "tokens").where(F.col("copies") > 0)
    got = sample.groupBy(F.col("source").alias("key")).agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.sum("copies").alias("documents"))
    all_got = got.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("mixed"))
    report = todo.join(got, "key", "left").crossJoin(F.broadcast(all_got)).fillna({"tokens": 0, "documents": 0})
    short = (F.col("documents") >= F.col("most_docs")) & (F.col("tokens") < F.col("want") - 1e-6)
    share = F.when(F.col("mixed") > 0, F.col("tokens") / F.col("mixed")).otherwise(F.lit(0.0))
    return sample, report.select("source", "weight", "want", "tokens", "documents", share.alias("share"), short.alias("short"))
