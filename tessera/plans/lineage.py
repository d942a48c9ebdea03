"""Cutting lineage through files in the folder that the whole cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only where the setting is missing and all runs on one machine (tests)."""
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"set {KEY} to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tessera-{tag}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, *paths: str) -> None:
    """Removes files by way of Hadoop's file system, whichever store the folder is in."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings for the time of a block; ``__`` in a name stands for a dot."""
    conf = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again: it survives a lost executor, and its plan starts anew."""
    return cut_at(df, tag)[0]


def cut_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """As :func:`cut`, with the path, so that the caller can delete the files once nothing reads them.

    The write's own shuffle files go as soon as it ends, as nothing after it reads them, and batches for Python are
    kept small, which bounds the memory of a task.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", spark__sql__execution__arrow__maxBytesPerBatch="8m"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path
