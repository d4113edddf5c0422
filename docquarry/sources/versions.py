"""A folder's state as numbered files of JSON: readers see the last one, writers add the next one or fail.

The state names the data files that are live. A file is put in its place by one
rename, so a job that ends before leaves the state as it was, and of two that
follow the same state only one gets its number.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has taken the next number."""


def files(spark: SparkSession, path: str):
    """The file system of a path, and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def current(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The last number and its state; 0 and an empty one for a new folder."""
    fs, at = files(spark, f"{path}/state")
    if not fs.exists(at):
        return 0, {}
    last = max((int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(at) if f.getPath().getName().endswith(".json")), default=0)
    if not last:
        return 0, {}
    opened = fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state/{last:010d}.json"))
    try:
        return last, json.loads(bytes(opened.readAllBytes()).decode())
    finally:
        opened.close()


def commit(spark: SparkSession, path: str, after: int, state: dict) -> None:
    """Make `state` follow number `after`."""
    fs, last = files(spark, f"{path}/state/{after + 1:010d}.json")
    _, new = files(spark, f"{path}/state/.{uuid.uuid4().hex}")
    out = fs.create(new, False)
    out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    out.close()
    if fs.exists(last) or not fs.rename(new, last):
        fs.delete(new, False)
        raise Conflict(f"{last} is there already")


def names(spark: SparkSession, path: str) -> list[str]:
    """The folders inside a folder."""
    fs, at = files(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, at = files(spark, path)
    fs.delete(at, True)
