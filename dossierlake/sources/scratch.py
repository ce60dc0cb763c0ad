"""Scratch tables in the folder that driver and executors share, and scans dealt out over all cores."""
from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: This process's part of the shared folder, deleted when it ends.
_OWN = uuid.uuid4().hex
_to_delete: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, the context's
    checkpoint folder; a temporary one of this machine only where all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        held = sc._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir is unset: it names the folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="dossierlake-"))
            held = sc._jsc.sc().getCheckpointDir()
        base = held.get()
    return base.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This process's folder below the shared one; it goes when the driver ends."""
    own = f"{shared_dir(spark)}/dossierlake/{_OWN}"
    if own not in _to_delete:
        _to_delete.add(own)
        atexit.register(_delete_quietly, spark, own)
    return own


def materialize(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and a lost
    executor costs only the tasks that read the table. What nobody discards goes when the driver ends."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session may have ended before
        pass


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            _delete(df.sparkSession, path)


def spread(df: DataFrame, *keys: str, each: int = 1) -> DataFrame:
    """A scan of fewer splits than there are cores, dealt out over all of them; any other as it is. ``each``: parts
    that a split is dealt into, where its rows become much larger, so that what a task holds does not grow."""
    cores, n = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df if n >= cores and each == 1 else df.repartition(max(cores, n * each), *keys)
