"""Reading tables and cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a local-mode session may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="sealwright-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def _drop(spark: SparkSession) -> None:
    """Delete what this driver made, when it ends; a JVM that is gone already leaves that to the cluster."""
    from py4j.protocol import Py4JError

    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while _made:
            path = jvm.org.apache.hadoop.fs.Path(_made.pop())
            path.getFileSystem(conf).delete(path, True)
    except (Py4JError, AttributeError, OSError):
        _made.clear()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_drop, spark)
    _made.append(path)
    return path


def cut(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends, lost executors lose nothing.

    ``by`` names columns of few values; reads that ask for one of them read only its files.
    """
    path = scratch(df.sparkSession, "cut")
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
