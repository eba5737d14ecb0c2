"""What needs the session: shipping this package to Python workers, and staging relations in shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="rankloom-", suffix=".zip")
    with os.fdopen(handle, "wb") as out, zipfile.ZipFile(out, "w") as sources:
        for file in sorted(root.rglob("*.py")):
            sources.write(file, file.relative_to(root.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, as the cluster names it in spark.checkpoint.dir. A
    session that runs on this machine alone may leave it unset and gets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="rankloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write df to the shared folder and read it again, dealt by these columns.

    For relations that a plan uses many times: they are computed once, and lost executors don't recompute them. Small
    relations that much work hangs on would else be written, and then read, by one task."""
    if by:
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.staged_path = path
    return staged


def discard(*staged: DataFrame) -> None:
    """Delete tables that stage wrote and nothing reads any more. What a lazy result reads must stay."""
    for df in staged:
        found = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        found.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(found, True)


def few(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df with the hint to broadcast it, if it is counted to have at most this many rows."""
    return F.broadcast(df) if df.count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: an input of fewer splits than cores, as a file of one row group is, is dealt over them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
