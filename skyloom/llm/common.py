"""What the training-data operators share: tables, shared storage and safe column names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; one of this machine only where the session names none and runs on it alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster's session must name a shared folder in spark.checkpoint.dir")
        folder = f"file://{tempfile.mkdtemp(prefix='skyloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system that holds path, and the path as it knows it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, name: str) -> str:
    """A folder name of its own in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/skyloom/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _written:
        try:
            fs, p = hadoop_path(spark, path)
            fs.delete(p, True)
        except Exception:  # the session has ended: the folder is the cluster's to clear
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like materialize, and gives the folder too, for discard. Shuffle files of the write go with it, so that stages don't add up on disk."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that no later stage reads."""
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


#: A key is hot if it has at least 1 / HOT of all rows; so there are at most HOT hot keys.
HOT = 1000


def join_unique(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """left joined with right, whose keys are unique and which tells in n how many of left's rows (rows in all) have each.

    The hot keys' rows of right, HOT at most whatever the data are, are broadcast, so that the rows of a hot
    key on the left stay spread; all others meet by an ordinary join. n is dropped.
    """
    hot = F.col("n") * HOT >= rows
    few = right.where(hot).drop("n")
    spread = left.join(F.broadcast(few), key)
    rest = left.join(F.broadcast(few.select(key)), key, "left_anti").join(right.where(~hot).drop("n"), key)
    return spread.unionByName(rest)


def fresh(taken, *names: str) -> list[str]:
    """The names, with underscores before those that are taken (in any case)."""
    used = {x.lower() for x in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_crc(doc_id: Column) -> Column:
    """CRC-32 of the identifier as text; null where it is null."""
    return F.crc32(doc_id.cast("string").cast("binary"))
