"""Streaming forms: new files merged once each, and windows over late events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, source: str, schema: str, checkpoint: str, merge: Callable[[DataFrame, int], None], max_files: int = 100, fmt: str = "parquet"):
    """Reads what is new below `source` and hands each batch to `merge(batch, epoch)`.

    The run ends when all present files are done; the checkpoint remembers them, so a restart
    neither skips nor repeats a file.  A batch may be handed over again after a failure with the
    same epoch: merge must be idempotent by epoch, as `merge_by_key` is.
    """
    s = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files).load(source)
    q = s.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()
    q.awaitTermination()
    return q


def one_by_one(process: Callable[[DataFrame], DataFrame], target: str, key: str, failed: str) -> Callable[[DataFrame, int], None]:
    """A merge that saves a batch as a whole, and if that fails, each file of it for itself.

    process(rows of files) gives rows to keep.  Files that fail alone too are noted in `failed`
    (key, error, epoch) and keep no other file back.  A batch holds at most the files of one
    trigger, so the files that come to the driver are bounded.
    """

    def save(rows: DataFrame, at: str) -> None:
        process(rows).write.mode("overwrite").parquet(at)

    def merge(batch: DataFrame, epoch: int) -> None:
        try:
            save(batch, f"{target}/epoch={epoch}/part=all")
            return
        except Exception:
            bad = []
        for n, r in enumerate(batch.select(key).distinct().orderBy(key).collect()):
            try:
                save(batch.where(F.col(key).eqNullSafe(F.lit(r[0]))), f"{target}/epoch={epoch}/part={n}")
            except Exception as e:
                bad.append((r[0], str(e).splitlines()[0][:300], epoch))
        batch.sparkSession.createDataFrame(bad, f"{key} string, error string, epoch long").write.mode("overwrite").parquet(f"{failed}/epoch={epoch}")

    return merge


def merge_by_key(target: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A merge that writes each batch to a folder of its epoch; `current` reads the latest row of
    every key over all epochs.  Writing an epoch twice gives the same."""

    def merge(batch: DataFrame, epoch: int) -> None:
        batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*").write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return merge


def current(spark: SparkSession, target: str, key: str, order: str) -> DataFrame:
    df = spark.read.parquet(target).drop("epoch")
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def windowed(events: DataFrame, ts: str, width: str, slide: str | None = None, late: str = "10 minutes", keys: tuple[str, ...] = (), value: str | None = None) -> DataFrame:
    """Counts (and sums) per window with a watermark; works on streams and on tables."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    e = events.withWatermark(ts, late) if events.isStreaming else events
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return e.groupBy(w.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", *(["total"] if value else []))


def progress_rate(progress: list[dict]) -> float:
    """Rows a second of a query's recent progress, latest weighted most (alpha 0.3)."""
    rate = None
    for p in progress:
        r = float(p.get("processedRowsPerSecond") or 0.0)
        rate = r if rate is None else 0.7 * rate + 0.3 * r
    return rate or 0.0
