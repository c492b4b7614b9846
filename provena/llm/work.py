"""Work tables in the shared folder that the cluster names in spark.checkpoint.dir.

A table written there cuts lineage and survives the loss of executors. Only where that setting is
absent (as in tests) is a folder of the machine used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = f"file://{tempfile.mkdtemp(prefix='provena-')}"
        base = _own[app]
    return base.rstrip("/")


def save(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a DataFrame to a new work table and read it back."""
    spark = df.sparkSession
    path = f"{folder(spark)}/provena/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._provena_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a work table that no later plan reads."""
    if path := getattr(df, "_provena_path", None):
        _delete(df.sparkSession, path)
        _made[:] = [x for x in _made if x[1] != path]


def mark() -> int:
    """A point in time for `drop_since`."""
    return len(_made)


def drop_since(point: int, *keep: DataFrame) -> None:
    """Delete the work tables made since a mark, but for those kept: what a step needed for itself."""
    kept = {getattr(x, "_provena_path", None) for x in keep}
    gone = [x for x in _made[point:] if x[1] not in kept]
    for spark, path in gone:
        _delete(spark, path)
    _made[:] = [x for x in _made if x not in gone]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one that no later plan reads."""
    _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder's owner removes what is left
            return
