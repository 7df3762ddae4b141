"""Writing intermediate tables to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The folders made for local sessions, by application; they go when the process ends.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is named, a local session gets one; a cluster must name it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = tempfile.mkdtemp(prefix="vicinal-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = _LOCAL[spark.sparkContext.applicationId] = f"file://{folder}"
    return path.rstrip("/")


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for a while; those from before come back. Names have __ for dots."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def fixed_splits(spark: SparkSession):
    """Files are split alike for as long as this lasts: as for the tasks that run at once now, however many executors there are later."""
    key = "spark__sql__files__minPartitionNum"
    return settings(spark, **{key: spark.conf.get(key.replace("__", "."), None) or str(spark.sparkContext.defaultParallelism)})


def bounded_batches(spark: SparkSession, rows: int = 1024):
    """For as long as this lasts, at most so many rows go to Python at once: long texts make large batches, which a task holds several times."""
    most = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=str(most if 0 < most <= rows else rows))


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to a new Parquet folder in the shared directory and reads it back: a cut of the lineage that survives lost executors.

    The shuffle files of the job go with its end; else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vicinal/{tag}-{uuid.uuid4().hex}"
    with bounded_batches(spark), settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the folders of staged frames. Only for frames from which nothing is read any more: all that came of them is staged itself."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
