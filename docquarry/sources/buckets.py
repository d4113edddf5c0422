"""Tables that are merged in place of being rewritten: buckets by key, copied on write.

A table is a folder of bucket folders and a state that names, for each bucket, the
folder that is live. A merge reads the buckets that its keys fall into, writes these
anew beside the old ones, and swaps the state by one rename; the other buckets'
files aren't touched. A job that ends before the swap leaves the table as it was,
and what it has written is deleted by `clean`. A merge may carry a mark (the number
of a stream's batch, say), which the same swap keeps: a merge whose mark is there
already changes nothing, so a batch that runs twice counts once.

Defined results: keys may be null, and null equals null; of rows of one merge that
share a key the one that comes last by `order` counts, ties by all columns; a merge
of no rows leaves the table as it is; columns that the table lacks are ignored.
"""

from __future__ import annotations

import functools
import operator
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import versions


class BucketTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k).cast(self.schema[k].dataType) for k in self.keys)), F.lit(self.buckets)).cast("int")

    def _state(self) -> tuple[int, dict]:
        version, state = versions.current(self.spark, self.path)
        return version, state or {"live": {}, "marks": {}}

    def _of(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._of(sorted(self._state()[1]["live"].values()))

    def marked(self, name: str) -> int:
        """The last mark of that name; -1 if there is none."""
        return self._state()[1]["marks"].get(name, -1)

    def _last(self, rows: DataFrame, order: list[str]) -> DataFrame:
        """One row a key."""
        rest = [c for c in rows.columns if c not in self.keys and c not in order]
        by = [*(F.col(c).desc_nulls_last() for c in order), F.xxhash64(*rest) if rest else F.lit(0)]
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*self.keys).orderBy(*by))).where("_n = 1").drop("_n")

    def merge(self, changes: DataFrame, matched: dict[str, Column] | None = None, order: list[str] | None = None, insert: bool = True, delete: Column | None = None, where: Column | None = None, mark: tuple[str, int] | None = None) -> dict[str, int]:
        """Bring in rows by key; returns the numbers of buckets that were written and of all.

        `matched`: what columns become where the key is there, as expressions over the structs `old` and `new`
        (without it: the new row); `insert`: whether keys that aren't there come in; `where`: rows of the table, over
        `old`, that this merge may change; `delete`: rows, over `old` and `new`, that go (`new` is null where only the
        table has the key, in the buckets that the merge touches).
        """
        version, state = self._state()
        if mark and state["marks"].get(mark[0], -1) >= mark[1]:
            return {"written": 0, "buckets": self.buckets}
        names = self.schema.fieldNames()
        new = changes.select(*((F.col(c) if c in changes.columns else F.lit(None)).cast(self.schema[c].dataType).alias(c) for c in names))
        new = self._last(new, order or []).withColumn("_bucket", self._bucket())
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # `buckets` numbers at most
        return self._swap(version, state, touched, new, matched, insert, delete, where, mark)

    def delete(self, keys: DataFrame, mark: tuple[str, int] | None = None) -> dict[str, int]:
        """Rows of these keys go."""
        return self.merge(keys, insert=False, delete=F.col("new").isNotNull(), mark=mark)

    def replace(self, rows: DataFrame, slice_of: list[str], mark: tuple[str, int] | None = None) -> dict[str, int]:
        """All rows of the slices that `rows` name go, and `rows` come in. Every bucket may hold some, so all are read; those without are kept."""
        version, state = self._state()
        if mark and state["marks"].get(mark[0], -1) >= mark[1]:
            return {"written": 0, "buckets": self.buckets}
        slices = rows.select(*(F.col(c).cast(self.schema[c].dataType) for c in slice_of)).distinct()
        same = functools.reduce(operator.and_, (F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in slice_of))
        gone = self.read().alias("t").join(slices.alias("s"), same, "left_semi").select(*self.keys)
        new = self._last(rows.select(*(F.col(c).cast(self.schema[c].dataType).alias(c) for c in self.schema.fieldNames())), [])
        both = new.withColumn("_new", F.lit(True)).unionByName(gone.withColumn("_new", F.lit(False)), allowMissingColumns=True)
        one = both.withColumn("_n", F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.desc("_new")))).where("_n = 1").drop("_n").withColumn("_bucket", self._bucket())
        touched = sorted(r[0] for r in one.select("_bucket").distinct().collect())
        return self._swap(version, state, touched, one, None, True, ~F.col("new._new"), None, mark)

    def _swap(self, version, state, touched, new, matched, insert, delete, where, mark) -> dict[str, int]:
        marks = state["marks"] | ({mark[0]: mark[1]} if mark else {})
        live = dict(state["live"])
        if touched:
            names = self.schema.fieldNames()
            old = self._of([live[str(b)] for b in touched if str(b) in live])
            same = functools.reduce(operator.and_, (F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in self.keys))
            one = lambda df, name: df.select(F.struct(*df.columns).alias(name))
            met = one(old, "old").join(one(new, "new"), same, "full_outer")
            if not insert:
                met = met.where(F.col("old").isNotNull())
            may = F.col("new").isNotNull() if where is None else F.col("new").isNotNull() & (F.col("old").isNull() | F.coalesce(where, F.lit(False)))
            if delete is not None:
                met = met.where(~F.coalesce(F.when(F.col("old").isNull(), F.lit(False)).otherwise(delete), F.lit(False)))
            pick = lambda c: F.when(~may, F.col(f"old.{c}")).when(F.col("old").isNull(), F.col(f"new.{c}")).otherwise(matched.get(c, F.col(f"old.{c}")) if matched is not None else F.col(f"new.{c}"))
            rows = met.select(*(pick(c).cast(self.schema[c].dataType).alias(c) for c in names)).withColumn("_bucket", self._bucket())
            name = f"data-{version + 1}-{uuid.uuid4().hex[:8]}"
            rows.repartition(min(len(touched), int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{name}")
            there = set(versions.names(self.spark, f"{self.path}/{name}"))
            for b in touched:  # a bucket that has lost all its rows has no folder
                live.pop(str(b), None)
                if f"_bucket={b}" in there:
                    live[str(b)] = f"{name}/_bucket={b}"
        if touched or mark:
            versions.commit(self.spark, self.path, version, {"live": live, "marks": marks})
        return {"written": len(touched), "buckets": self.buckets}

    def clean(self) -> None:
        """Delete bucket folders that the state doesn't name."""
        live = set(self._state()[1]["live"].values())
        for name in versions.names(self.spark, self.path):
            if name != "state":
                own = versions.names(self.spark, f"{self.path}/{name}")
                for b in own:
                    if f"{name}/{b}" not in live:
                        versions.delete(self.spark, f"{self.path}/{name}/{b}")
                if not any(f"{name}/{b}" in live for b in own):
                    versions.delete(self.spark, f"{self.path}/{name}")
