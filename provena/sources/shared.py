"""Folders for files that a query writes and reads again: below spark.checkpoint.dir where the cluster
names it, else below a folder of this machine (as in tests)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = f"file://{tempfile.mkdtemp(prefix='provena-')}"
        base = _own[app]
    return f"{base.rstrip('/')}/provena/{name}-{uuid.uuid4().hex}"


def write_atomic(df: DataFrame, path: str) -> None:
    """Write beside the target and rename, so readers see all of it or nothing; a failure leaves no part."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    own, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{path}.tmp-{uuid.uuid4().hex}", path))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        df.write.parquet(own.toString())
        if not fs.rename(own, target):
            raise OSError(f"could not rename to {path}")
    finally:
        fs.delete(own, True)
