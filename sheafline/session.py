"""Session factory and cluster helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark removes the shuffle files of a query as it ends, instead of when the driver collects its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app: str = "sheafline", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the engine relies on (UTC, AQE, Arrow)."""
    cores = cores or os.cpu_count() or 4
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SHEAFLINE_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session for checkpoints and intermediate tables.

    ``spark.checkpoint.dir`` is read from the session.  Only where it is unset (tests, local
    mode) a folder of our own is set; on a cluster a machine-local one would be wrong, so an
    unset value is an error there.
    """
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir", None)
    if known:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(known)
        return known
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="sheafline-checkpoint-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(TIDY)
        else:
            spark.conf.set(TIDY, before)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: `df` as a table written to the shared folder.

    A table survives lost executors like a checkpoint; unlike one it is compressed, read by
    column, and its true size is known to the optimizer, which would otherwise guess the size of
    what comes out of Python and might broadcast it.
    """
    spark = df.sparkSession
    at = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package, once per context, where it is not installed for them.

    The archive lies in the session's shared folder; only local mode without one uses a
    temporary folder.
    """
    import io
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_sheafline_shipped", False):
        return
    root, b = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    if sc.getConf().get("spark.checkpoint.dir", None) or not sc.master.startswith("local"):
        at = f"{checkpoint_dir(spark)}/sheafline-{uuid.uuid4().hex}/sheafline.zip"
        path = sc._jvm.org.apache.hadoop.fs.Path(at)
        out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(b.getvalue()))
        out.close()
    else:
        at = str(Path(tempfile.mkdtemp(prefix="sheafline-")) / "sheafline.zip")
        Path(at).write_bytes(b.getvalue())
    sc.addPyFile(at)
    sc._sheafline_shipped = True
