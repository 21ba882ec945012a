"""The shared folder for what loops and streams keep."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """What the session names in spark.checkpoint.dir; on a local master that names none, a new folder of this machine. An error elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster's session must name a shared folder in spark.checkpoint.dir")
        folder = f"file://{tempfile.mkdtemp(prefix='skyloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, at_once: int | None = None) -> DataFrame:
    """df as Parquet in a folder of its own in the shared one, which goes when the driver ends; each row is computed once. at_once: rows that go to Python at a time, where rows are wide."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/skyloom/kept-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        if at_once:
            spark.conf.set(key, str(at_once))
        df.write.parquet(path)
    finally:
        if at_once:
            spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _written:
        try:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # the session has ended: the folder is the cluster's to clear
            return
