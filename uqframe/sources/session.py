"""Shared folders: where lineage is cut and where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A machine-local folder is made up only for a local master without that setting.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="uqframe-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_MADE: list[str] = []


def drop_scratch(spark: SparkSession) -> int:
    """Delete the folders that this process has made with ``new_path``, once no result that
    reads them is needed any more; returns how many there were."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_MADE)
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    path = f"{shared_dir(spark).rstrip('/')}/uqframe/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def cut_lineage(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete what ``cut_lineage`` wrote for ``df``, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        own = next((path for path in _MADE if folder.endswith("/" + path.rsplit("/", 1)[1])), None)
        if own:
            path = spark._jvm.org.apache.hadoop.fs.Path(own)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            _MADE.remove(own)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all cores when the scan alone gives fewer tasks than there are cores.

    A table of few row groups would otherwise keep most cores idle. A scan that already has
    a task per core, as any large table has, comes back unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
