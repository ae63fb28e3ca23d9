"""Session helpers shared by the whole library."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
BATCH, DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(16 << 20)
_made: list[str] = []


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this library from where the driver has it, and bound what they are sent at once.

    On a cluster the library is installed or sent with ``--py-files``; the added path is then
    simply absent on the executors, which does no harm. Arrow batches hold ``BATCH_BYTES`` at
    most, unless the session sets a size of its own.
    """
    if spark.conf.get(BATCH, DEFAULT) == DEFAULT:
        spark.conf.set(BATCH, BATCH_BYTES)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, but only with a ``local`` master;
    a cluster without the setting is an error, since executors could not see each other's files.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _made:
            _made.append(tempfile.mkdtemp(prefix="lexloom-"))
        at = "file://" + _made[0]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; removed when the driver ends."""
    path = f"{work_dir(spark)}/lexloom-{name}-{uuid.uuid4().hex[:12]}"
    _written.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it again.

    A lost executor then costs a re-read, never a recomputation of the whole history; columns
    stay prunable, which a checkpointed RDD's rows are not.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def remove(path: str) -> None:
    from pyarrow import fs

    try:
        store, at = fs.FileSystem.from_uri(path)
        store.delete_dir(at)
    except (OSError, ValueError):
        pass  # already gone, or a store that pyarrow can't reach: left to the folder's own expiry


@atexit.register
def _clean() -> None:
    for path in [*_written, *("file://" + p for p in _made)]:
        remove(path)
