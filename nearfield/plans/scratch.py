"""Tables in the folder that driver and executors share: where lineage is cut.

A written table needs none of the shuffles that made it, so their files go as soon as it is there; free() removes a table
whose readers have been written. What is left goes at the end of the process.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MADE: dict[str, SparkSession] = {}
_PATH_OF: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset (tests on a local master), one temporary folder a session."""
    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="nearfield-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/nearfield/{what}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Within it, a setting of the session has this value."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffles_end(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Within it, the shuffle files of a query go when the query has ended."""
    return setting(spark, CLEANUP, "true")


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    with shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATH_OF[out] = path
    return out


def free(*tables: DataFrame) -> None:
    """Remove tables that cut() made and that nothing will read any more."""
    for table in tables:
        path = _PATH_OF.pop(table, None)
        if path is not None and (spark := _MADE.pop(path, None)) is not None:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def cleanup() -> None:
    """Remove this process's scratch tables; what reads them must have been written before."""
    while _MADE:
        path, spark = _MADE.popitem()
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return
