"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    A temporary folder takes its place only where the setting is absent, as in
    local tests, where driver and executors are one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="docquarry-"))
    return "file://" + _own_folder[0]


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it again. It goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more: all that came of them has been written."""
    for t in tables:
        files, at = _files(t.sparkSession, t.written_at)
        files.delete(at, True)
        files.cancelDeleteOnExit(at)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: int = 1 << 20) -> None:
    """Let Arrow batches hold fewer bytes than the default of 64 MB: rows here are whole texts, and tasks hold much more for each."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > size:
        spark.conf.set(name, f"{size}b")


def sliced(batches, rows: int = 512):
    """The same rows in batches of a bounded number, so that a task holds few texts at a time."""
    lean()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    lean()


_remembered: dict[str, object] = {}
_libc: list[object] = []


def lean() -> None:
    """Let this worker give freed memory back to the system: large blocks at once, the rest now."""
    if not _libc:
        try:
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(-3, 1 << 20)  # blocks from 1 MB on are mapped one by one
            libc.mallopt(-1, 1 << 22)  # at most 4 MB stay free at the top
            libc.mallopt(-8, 2)  # two arenas
        except (OSError, AttributeError):
            libc = None
        _libc.append(libc)
        pa.set_memory_pool(pa.system_memory_pool())
    if _libc[0] is not None:
        _libc[0].malloc_trim(0)


def remembers(name: str, forget) -> None:
    """Tell that an operator keeps something in this process, and let the others forget: workers live on from stage to stage."""
    if name in _remembered:
        return
    for other in list(_remembered):
        _remembered.pop(other)()
    _remembered[name] = forget
    lean()
