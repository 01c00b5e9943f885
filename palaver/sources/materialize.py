"""Lineage cuts that survive the loss of an executor.

``materialize`` writes a DataFrame as Parquet below the folder all executors
share (``spark.checkpoint.dir``) and returns a scan of it.  Parquet is used
rather than an RDD checkpoint because it is computed once and still allows
column pruning.  Only where the session names no folder - tests - is a
temporary one set.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by all executors; sets one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="palaver-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palaver-{os.getpid()}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    scan = spark.read.schema(df.schema).parquet(path)
    scan._palaver_path = path
    return scan


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free(df: DataFrame) -> None:
    """Delete the table that ``df`` scans, if :func:`materialize` wrote it; what was computed from it must be written too."""
    path = getattr(df, "_palaver_path", None)
    if path in _written:
        _delete(_written.pop(path), path)


def release() -> None:
    """Delete every table this process has materialised; results read from them must be done."""
    while _written:
        path, spark = _written.popitem()
        try:
            _delete(spark, path)
        except Exception:  # the session may already be gone
            pass


atexit.register(release)
