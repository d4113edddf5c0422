"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only in local mode without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="docquarry-"))
    return "file://" + _own[0]


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write and read again, which cuts the lineage and survives lost executors. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """With a broadcast hint if it has no more rows than that, by a bounded count; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame, most: int = 256 << 20) -> DataFrame:
    """Rows of a few small files dealt over all cores, before work that is heavy for each row; larger inputs as they are.

    A file of one row group is read by one task, however many cores wait.
    """
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not files or len(files) >= cores:
        return df
    at = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in files]
    conf = spark._jsc.hadoopConfiguration()
    return df.repartition(cores) if sum(a.getFileSystem(conf).getFileStatus(a).getLen() for a in at) <= most else df


def small_batches(spark: SparkSession, size: int = 1 << 20) -> None:
    """Let Arrow batches hold fewer bytes than the default of 64 MB: rows here are whole texts or blocks of vectors, and tasks hold much more for each."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > size:
        spark.conf.set(name, f"{size}b")
