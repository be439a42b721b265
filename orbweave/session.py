"""Session construction and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "orbweave", **conf: str) -> SparkSession:
    """A session with the settings the engine assumes: UTC, AQE with skew handling, Arrow for Python."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as `spark.checkpoint.dir` names it.

    Only where that setting is absent and all runs on one machine (tests, a laptop) a temporary folder of it is made and
    set; on a cluster without the setting this fails, as each machine would write to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="orbweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Records and bytes of a batch that goes to Python, where pages of html are read.
BATCH_ROWS, BATCH_BYTES = 2_000, 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that large pages do not fill a task's memory. A smaller setting of the session stays."""
    units = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        now = re.fullmatch(r"(\d+)([kmg]?)b?", (spark.conf.get(name) or "").lower())
        if now is None or not 0 < int(now[1]) * units[now[2]] <= most:
            spark.conf.set(name, str(most))


_SCOPES: list[list[str]] = []


@contextmanager
def written_tables(spark: SparkSession):
    """Tables that `durable` writes inside this block go at its end, once their result is stored; a long-running driver keeps no leftovers."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _remove(spark, path)


def durable(df: DataFrame, label: str = "table") -> DataFrame:
    """Write `df` once into the shared folder and read it back: lineage ends, a lost executor costs nothing.

    Parquet keeps the later column pruning; zstd keeps the disk small. The files go when the driver ends, or the block of
    `written_tables` around it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    else:
        atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        if jvm is not None:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is already gone
        local = path.removeprefix("file://")
        if os.path.isdir(local):
            import shutil

            shutil.rmtree(local, ignore_errors=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
