"""Intermediate tables in the cluster's shared folder, and joins by checked size."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only up to this many bytes, taken from the rows of a written table.
BROADCAST_BYTES = 16 << 20
#: Bytes that a row of a broadcast relation takes besides its values.
ROW_OVERHEAD = 96

_run = f"lexigrove-{uuid.uuid4().hex}"
_cleaned: set[str] = set()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """This process's folder under spark.checkpoint.dir; a local one only where that is unset and all runs in one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lexigrove-")
        spark.sparkContext.setCheckpointDir(base)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{_run}")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if folder.startswith("file:/") and not folder.startswith("file://"):  # as other readers of the folder want it
        folder = "file://" + folder[len("file:") :]
    if folder not in _cleaned:
        _cleaned.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may have ended before the process
        return


def cut(df: DataFrame) -> DataFrame:
    """df, written once as Parquet in the shared folder and reread: no lineage, survives lost executors."""
    return cut_path(df)[0]


def new_folder(spark: SparkSession) -> str:
    """A name in the shared folder that nothing has yet."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs inside deletes the files of its shuffles when it has ended."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut_path(df: DataFrame, path: str | None = None) -> tuple[DataFrame, str]:
    """cut(), into path if given, and the folder of the table."""
    spark = df.sparkSession
    path = path or new_folder(spark)
    # the files of the shuffles behind a written table aren't needed any more
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def spread(table: DataFrame) -> DataFrame:
    """A scanned table with at least a partition for each core: one that lies in fewer splits, so a small one, is dealt out."""
    n = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(n) if table._jdf.queryExecution().toRdd().getNumPartitions() < n else table


def checked_broadcast(small: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """small with a broadcast hint if its rows, counted in a written table, fit into limit; else as it is, to be shuffled."""
    return F.broadcast(small) if small.count() * (row_bytes + ROW_OVERHEAD) <= limit else small


#: Rows of an Arrow batch, where the session has Spark's default of 10,000: rows are whole texts here, and a task holds a few batches at once.
BATCH_ROWS = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Lets Python workers of a local session find this package (on a cluster it is shipped with --py-files), and keeps their batches small."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    if spark.conf.get(_ROWS, "10000") == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))
