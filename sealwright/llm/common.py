"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: White space of the word definition ``[^\x20\x09-\x0D]+`` as a Java regular expression class.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_made: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the checkpoint dir already set.

    Only a local-mode session (tests) falls back to a temporary folder; on a cluster an unset
    ``spark.checkpoint.dir`` is an error, because executors cannot see each other's local disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="sealwright-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def _drop(spark: SparkSession) -> None:
    """Delete this session's intermediate tables when the driver ends."""
    try:
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        while _made:
            path = jvm.org.apache.hadoop.fs.Path(_made.pop())
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # the JVM may be gone already; the cluster's own clean-up then applies
        pass


def cut(df: DataFrame, name: str, rows_per_batch: int = 2_000) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends, lost executors lose nothing.

    While it is planned and written, Arrow batches hold at most ``rows_per_batch`` rows, which bounds the memory of
    Python workers when rows hold long texts.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sealwright-{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_drop, spark)
    _made.append(path)
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, rows_per_batch)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete tables made by :func:`cut` that no later step reads."""
    for df in frames:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for file in df.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if "/sealwright-" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
                _made[:] = [x for x in _made if x.rsplit("/", 1)[-1] != folder.rsplit("/", 1)[-1]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_doc_batches(series, limit: int = 4_000_000):
    """Slices of a list of texts whose lengths add up to at most ``limit`` characters (one text at least)."""
    start, size = 0, 0
    for i, x in enumerate(series):
        n = len(x) if x is not None else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(series):
        yield start, len(series)
