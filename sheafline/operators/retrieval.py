"""Retrieval over documents: postings, BM25, exact dense search, fusion, neighbours, context."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafline.functions.text import word_count, words
from sheafline.operators.bounds import stated
from sheafline.session import checkpoint_dir

K1, B, RRF_K = 1.2, 0.75, 60
MOST_QUERIES = 10_000


def postings(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc, tf, dl): counts combine before the shuffle; null and empty texts have none."""
    w = docs.select(F.col(doc).alias("doc"), words(F.col(text)).alias("w"))
    return w.select("doc", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("term", "doc", "dl").agg(F.count(F.lit(1)).alias("tf")).select("term", "doc", "tf", "dl")


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: n documents and their average length; a null text has length 0."""
    n = word_count(F.coalesce(F.col(text), F.lit("")))
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(n.cast("double")).alias("avgdl"))


@dataclass
class Inverted:
    """A stored inverted index: postings (term, doc, tf, dl) in the order of their terms, the
    number of documents of each term (term, df), and one row of statistics (n_docs, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame


def invert(docs: DataFrame, doc: str = "doc_id", text: str = "text", root: str | None = None) -> Inverted:
    """Tokenises every document once and stores the result in `root` (default: a new folder of the
    session's shared one), to be opened again by `open_inverted`.

    Files hold ranges of terms, so a search reads the row groups of its own terms only.  Null
    and empty texts have no postings but count as documents.
    """
    spark = docs.sparkSession
    root = root or f"{checkpoint_dir(spark)}/inverted-{uuid.uuid4().hex}"
    p = postings(docs, doc, text)
    p.repartitionByRange("term").sortWithinPartitions("term", "doc").write.parquet(f"{root}/postings")
    p = spark.read.parquet(f"{root}/postings")
    p.groupBy("term").agg(F.count(F.lit(1)).alias("df")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{root}/terms")
    n = docs.count()
    p.agg(F.lit(n).cast("long").alias("n_docs"), F.coalesce(F.sum("tf") / F.lit(max(1, n)), F.lit(0.0)).cast("double").alias("avgdl")).write.parquet(f"{root}/stats")
    return open_inverted(spark, root)


def open_inverted(spark: SparkSession, root: str) -> Inverted:
    return Inverted(*(spark.read.parquet(f"{root}/{x}") for x in ("postings", "terms", "stats")))


#: Terms up to this many are named in the filter of the read; more are joined.
NAMED_TERMS = 200


def bm25(docs: DataFrame | Inverted, queries: DataFrame, k: int = 40, doc: str = "doc_id", text: str = "text", scope: DataFrame | None = None) -> DataFrame:
    """(qid, doc, score, rank): the k best documents of every query (qid, terms array).

    docs: the documents, or their stored index.  Repeated query terms add again.  An idf of 0 and
    less counts as 1e-6.  A scope (doc) limits the documents before ranks are given; the
    statistics stay those of the whole corpus.  Ties go to the lesser document id.  Only postings
    of the queries' terms are shuffled.
    """
    q = queries.select("qid", F.explode("terms").alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qf"))
    wanted = q.select("term").distinct()
    if isinstance(docs, Inverted):
        named = [r.term for r in wanted.limit(NAMED_TERMS + 1).collect()]
        few = len(named) <= NAMED_TERMS
        pick = lambda t: t.where(F.col("term").isin(named)) if few else t.join(wanted, "term", "left_semi")
        p, df, st = pick(docs.postings), pick(docs.terms), F.broadcast(docs.stats)  # one row
    else:
        w = docs.select(F.col(doc).alias("doc"), words(F.col(text)).alias("w"))
        p = w.select("doc", F.size("w").alias("dl"), F.explode("w").alias("term")).join(wanted, "term", "left_semi").groupBy("term", "doc", "dl").agg(F.count(F.lit(1)).alias("tf"))
        df = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        st = F.broadcast(corpus_stats(docs, text))  # one row
    idf = F.log((F.col("n_docs") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    terms = df.crossJoin(st).select("term", F.when(idf > 0, idf).otherwise(F.lit(1e-6)).alias("idf"), "avgdl")
    if scope is not None:
        p = p.join(scope.select(F.col(scope.columns[0]).alias("doc")).distinct(), "doc", "left_semi")
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    part = F.col("qf") * F.col("idf") * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / F.col("avgdl")))
    s = p.join(terms, "term").join(q, "term").groupBy("qid", "doc").agg(F.sum(part).alias("score"))
    s = s.withColumn("score", F.round("score", 9))
    win = Window.partitionBy("qid").orderBy(F.desc("score"), "doc")
    return s.withColumn("rank", F.row_number().over(win)).where(F.col("rank") <= k)


#: Queries compared at once; vectors of a batch against these make one product of matrices.
TILE = 512


def _rows(a: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors in double precision) of the vectors with a direction."""
    n = np.diff(a.offsets.to_numpy()) if len(a) else np.empty(0, np.int64)
    dim = dim or (int(n.max()) if len(n) else 0)
    fits = np.flatnonzero((n == dim) & ~np.asarray(a.is_null()) & (dim > 0))
    x = a.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), -1)
    size = np.sqrt((x * x).sum(axis=1))
    ok = np.isfinite(size) & (size > 0)
    return fits[ok], x[ok] / size[ok, None]


def dense(vectors: DataFrame, queries: DataFrame, k: int = 40, scope: DataFrame | None = None, at_once: int = MOST_QUERIES) -> DataFrame:
    """(qid, doc, score, rank): exact cosine of every query (qid, vec) with vectors (doc, vec).

    Any number of queries: at most `at_once` of them travel to the tasks at a time, and each task
    keeps the k best of each.  A vector without direction has no score; ties go to the lesser
    document.  The scope is applied before ranks are given.
    """
    if scope is not None:
        vectors = vectors.join(scope.select(F.col(scope.columns[0]).alias("doc")).distinct(), "doc", "left_semi")
    spark, vectors = vectors.sparkSession, vectors.select("doc", "vec")
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, doc {vectors.schema['doc'].dataType.simpleString()}, score double"
    blocks = max(1, -(-queries.count() // at_once))
    out = None
    for i in range(blocks):
        part = queries.select("qid", "vec") if blocks == 1 else queries.select("qid", "vec").where(F.pmod(F.xxhash64("qid", F.lit("block")), F.lit(blocks)) == i)
        got = part.toArrow()
        at, q = _rows(got.column(1).combine_chunks()) if got.num_rows else (np.empty(0, int), np.empty((0, 0)))
        qid = got.column(0).combine_chunks().take(pa.array(at))

        def run(it: Iterator[pa.RecordBatch], q=q, qid=qid) -> Iterator[pa.RecordBatch]:
            best_s, best_d = [np.empty((0,))] * len(q), [None] * len(q)
            for b in it:
                rows, x = _rows(b.column(1), q.shape[1]) if len(q) else ([], None)
                if not len(rows):
                    continue
                docs_ = b.column(0).take(pa.array(rows)).to_numpy(zero_copy_only=False)
                by_doc = np.argsort(docs_, kind="stable")
                docs_, x = docs_[by_doc], x[by_doc]
                for j in range(0, len(q), TILE):
                    s = np.round(q[j : j + TILE] @ x.T, 9)
                    m = min(k, s.shape[1])
                    # All that tie with the m-th best stay, so that the order of ties is right.
                    least = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
                    for r in range(len(s)):
                        c = np.flatnonzero(s[r] >= least[r])
                        c = c[np.argsort(-s[r, c], kind="stable")][:m]
                        ss, dd = s[r, c], docs_[c]
                        if best_d[j + r] is not None:
                            ss, dd = np.concatenate([best_s[j + r], ss]), np.concatenate([best_d[j + r], dd])
                            o = np.lexsort((dd, -ss))[:k]
                            ss, dd = ss[o], dd[o]
                        best_s[j + r], best_d[j + r] = ss, dd
            some = [r for r in range(len(q)) if best_d[r] is not None]
            if some:
                n = [len(best_s[r]) for r in some]
                yield pa.RecordBatch.from_arrays([qid.take(pa.array(np.repeat(some, n))), pa.array(np.concatenate([best_d[r] for r in some])), pa.array(np.concatenate([best_s[r] for r in some]))], names=["qid", "doc", "score"])

        s = vectors.mapInArrow(run, schema)
        out = s if out is None else out.unionByName(s)
    win = Window.partitionBy("qid").orderBy(F.desc("score"), "doc")
    return out.withColumn("rank", F.row_number().over(win)).where(F.col("rank") <= k)


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(qid, doc, score): reciprocal rank fusion of ranked lists (qid, doc, rank)."""
    u = lists[0].select("qid", "doc", "rank")
    for x in lists[1:]:
        u = u.unionByName(x.select("qid", "doc", "rank"))
    return u.groupBy("qid", "doc").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))


def hybrid(keyword: DataFrame, vector: DataFrame, top: int = 5, candidates: int | None = None) -> DataFrame:
    """(qid, doc, score, rank): fused, the `candidates` first and then the `top` of them."""
    f = rrf([keyword, vector])
    win = Window.partitionBy("qid").orderBy(F.desc("score"), "doc")
    n = min(candidates or max(4 * top, 24), 48)
    return f.withColumn("rank", F.row_number().over(win)).where((F.col("rank") <= n) & (F.col("rank") <= top))


def neighbours(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """(qid, file_id, first_ord, last_ord, score, text, loc): hits with the chunks around them,
    in runs of consecutive ords; runs without a hit are dropped.

    hits: (qid, file_id, ord, score); chunks: (file_id, ord, text, loc).
    """
    wide = hits.select("qid", "file_id", F.explode(F.sequence(F.col("ord") - window, F.col("ord") + window)).alias("ord")).distinct()
    j = wide.join(chunks.select("file_id", "ord", "text", "loc"), ["file_id", "ord"]).join(hits.groupBy("qid", "file_id", "ord").agg(F.max("score").alias("score")), ["qid", "file_id", "ord"], "left")
    isl = F.col("ord") - F.row_number().over(Window.partitionBy("qid", "file_id").orderBy("ord"))
    r = j.withColumn("run", isl).groupBy("qid", "file_id", "run").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.max("score").alias("score"), F.sort_array(F.collect_list(F.struct("ord", "text", "loc"))).alias("x"))
    r = r.where(F.col("score").isNotNull())
    first, last = F.element_at("x", 1)["loc"], F.element_at("x", -1)["loc"]
    loc = F.when((F.col("first_ord") == F.col("last_ord")) | first.eqNullSafe(last), first).otherwise(F.concat_ws("–", first, last))
    return r.select("qid", "file_id", "first_ord", "last_ord", "score", F.array_join(F.transform("x", lambda c: c["text"]), "\n").alias("text"), loc.alias("loc"))


def context(passages: DataFrame, budget: int = 6000, least: int = 400) -> DataFrame:
    """(qid, number, id, used, cut): passages (qid, id, score, text) in order until the budget is
    spent; the last one is cut if at least `least` signs remain, else left out."""
    n = F.length("text")
    win = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    p = passages.select("qid", "id", "score", "text", F.row_number().over(win).alias("number"), (F.sum(n).over(win.rowsBetween(Window.unboundedPreceding, 0)) - n).alias("before"), n.alias("n"))
    room = F.lit(budget) - F.col("before")
    p = p.withColumn("room", room).where((F.col("room") >= F.col("n")) | (F.col("room") >= least))
    return p.select("qid", "number", "id", F.least("n", "room").cast("long").alias("used"), (F.col("n") > F.col("room")).alias("cut"))


def interleave(parts: DataFrame) -> DataFrame:
    """(qid, id, part, place): results of the parts of a question in turn by rank, then part;
    an id found by several parts counts for the first."""
    first = Window.partitionBy("qid", "id").orderBy("rank", "part")
    once = parts.withColumn("k", F.row_number().over(first)).where("k = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "part", "id"))).select("qid", "id", "part", "rank", "place")


#: A turn of so few words belongs to the one before if their meanings are this close.
SHORT_TURN, SAME_TOPIC = 8, 0.50


def fold_history(turns: DataFrame, embedder: Callable[[Sequence[str]], np.ndarray] | None = None) -> DataFrame:
    """(conv_id, turn, query): a user turn that belongs to the one before is prefixed by it.

    A turn that points back always does.  With an embedder a turn of at most eight words does if
    the cosine of the two is at least 0.50; without one, a turn of at most four words does.
    Small talk never does.
    """
    from sheafline.functions.text import is_follow_up, is_small_talk, points_back

    u = turns.where("role = 'user'")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    u = u.select("conv_id", "turn", "text", before.alias("before"))
    t = F.trim(F.coalesce("text", F.lit("")))
    if embedder is None:
        belongs = is_follow_up(F.col("text"))
    else:

        @F.pandas_udf("boolean")
        def close(a: pd.Series, b: pd.Series) -> pd.Series:
            x, y = (np.asarray(embedder(s.tolist()), np.float64) for s in (a, b))
            n = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
            return pd.Series((x * y).sum(axis=1) >= SAME_TOPIC * np.maximum(n, 1e-9))

        short = (t != "") & (F.size(F.split(t, "\\s+")) <= SHORT_TURN)
        # Only short turns are embedded.
        ask = F.when(short & F.col("before").isNotNull(), close(F.when(short, t).otherwise(F.lit("")), F.coalesce("before", F.lit(""))))
        belongs = (t != "") & ~is_small_talk(t) & (points_back(t) | F.coalesce(ask, F.lit(False)))
    return u.select("conv_id", "turn", F.when(belongs & F.col("before").isNotNull(), F.concat_ws(" ", "before", "text")).otherwise(F.col("text")).alias("query"))


def synonyms(questions: DataFrame, glossary: DataFrame, most: int = 3) -> DataFrame:
    """(qid, variant): the question with a glossary term put for another of its entry.

    glossary: (term, alternative), a small declared list; whole words, also in the plural.  Only
    terms that a question contains meet it.
    """
    g = stated(glossary, MOST_QUERIES, "glossary entries")
    known = F.array(*[F.lit(r.term) for r in glossary.select("term").distinct().collect()]) if glossary.limit(1).count() else F.array().cast("array<string>")
    low = F.lower("question")
    hit = questions.select("qid", "question", F.explode(F.filter(known, lambda x: F.contains(low, F.lower(x)))).alias("term")).join(g, "term")
    hit = hit.where(F.expr("regexp_like(question, concat('(?i)\\\\b', term, 's?\\\\b'))"))
    rx = F.concat(F.lit("(?i)\\b"), F.col("term"), F.lit("s?\\b"))
    v = hit.select("qid", F.lower(F.regexp_replace("question", rx, F.col("alternative"))).alias("variant"), "question").where(F.col("variant") != F.lower("question")).select("qid", "variant").distinct()
    return v.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("variant"))).where(F.col("k") <= most).drop("k")


def embed_text(name: Column, folder: Column, heading: Column, loc: Column, text: Column) -> Column:
    """What is embedded for a chunk: where it stands, then its text; blank parts are left out."""
    tag = lambda t, c: F.when(F.trim(c) != "", F.concat(F.lit(f"{t}: "), c))
    return F.concat(F.concat_ws(" | ", tag("file", name), tag("folder", folder), tag("section", heading), tag("at", loc)), F.lit("\n"), text)
