"""Counters kept as mergeable states: a batch adds its own counts, and nothing is counted again.

The folder holds a delta for each batch: totals (number of rows, sums, sketches) by key, and for
counts of distinct values the values themselves with signed numbers of rows, so that rows can also be
taken away. The state names the deltas and the batches that they hold; a batch that runs twice
counts once. Reading merges the deltas, `compact` writes the merged one.

Defined results: a null key is a key; null values are in no sum and no distinct count; a key whose
rows have all been taken away has no counters. Sketches hold what was ever added, as nothing can be
taken out of them; their error is about 1.04 / sqrt(2^12), 1.6 percent.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions


class Counters:
    """`sums`: columns to add up; `distinct`: columns whose values are counted exactly; `about`: those counted by sketches."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], sums: tuple[str, ...] = (), distinct: tuple[str, ...] = (), about: tuple[str, ...] = ()):
        self.spark, self.path, self.keys, self.sums, self.distinct, self.about = spark, path, keys, sums, distinct, about

    def _state(self) -> tuple[int, dict]:
        version, state = versions.current(self.spark, self.path)
        return version, state or {"deltas": [], "batches": []}

    def _totals(self, rows: DataFrame, n: Column, sums: list[Column], sketches: list[Column]) -> DataFrame:
        added = (F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in zip(sums, self.sums, strict=True))
        return rows.groupBy(*self.keys).agg(F.sum(n).alias("_n"), *added, *(c.alias(f"{name}_about") for c, name in zip(sketches, self.about, strict=True)))

    def add(self, rows: DataFrame, batch: str, sign: Column | None = None) -> bool:
        """Count a batch; `sign` is -1 for rows that are taken away. False if the batch has been counted before."""
        version, state = self._state()
        if batch in state["batches"]:
            return False
        name = f"delta-{version + 1}-{uuid.uuid4().hex[:8]}"
        signed = rows.withColumn("_sign", (F.lit(1) if sign is None else sign).cast("long"))
        sketch = lambda c: F.hll_sketch_agg(F.when(F.col("_sign") > 0, F.col(c).cast("string")))
        self._totals(signed, F.col("_sign"), [F.col(c) * F.col("_sign") for c in self.sums], [sketch(c) for c in self.about]).write.parquet(f"{self.path}/{name}/totals")
        if self.distinct:
            values = F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in self.distinct)))
            each = signed.select(*self.keys, "_sign", values.alias("_z")).where("_z.v is not null").select(*self.keys, F.col("_z.c").alias("_column"), F.col("_z.v").alias("_value"), "_sign")
            each.groupBy(*self.keys, "_column", "_value").agg(F.sum("_sign").alias("_n")).where("_n <> 0").write.parquet(f"{self.path}/{name}/values")
        versions.commit(self.spark, self.path, version, {"deltas": [*state["deltas"], name], "batches": [*state["batches"], batch]})
        return True

    def _read(self, state: dict, kind: str) -> DataFrame:
        return functools.reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.path}/{n}/{kind}") for n in state["deltas"]])

    def _merged(self, state: dict) -> DataFrame:
        return self._totals(self._read(state, "totals"), F.col("_n"), [F.col(c) for c in self.sums], [F.hll_union_agg(f"{c}_about") for c in self.about])

    def _values(self, state: dict) -> DataFrame:
        return self._read(state, "values").groupBy(*self.keys, "_column", "_value").agg(F.sum("_n").alias("_n")).where("_n <> 0")

    def read(self) -> DataFrame:
        """(keys, n, sums, <column>_distinct, <column>_about) of all batches; a folder without batches can't be read."""
        _, state = self._state()
        if not state["deltas"]:
            raise LookupError(f"nothing has been counted in {self.path}")
        names = [f"{c}_distinct" for c in self.distinct]
        merged = self._merged(state)
        counted = merged.select(*self.keys, F.col("_n").alias("n"), *self.sums, *(F.lit(0).cast("long").alias(c) for c in names), *(F.hll_sketch_estimate(f"{c}_about").alias(f"{c}_about") for c in self.about))
        if self.distinct:
            held = self._values(state).where("_n > 0").groupBy(*self.keys).agg(*(F.count_if(F.col("_column") == c).alias(f"{c}_distinct") for c in self.distinct))
            # both sides by one aggregate, in which null keys meet as well
            both = counted.unionByName(held, allowMissingColumns=True)
            counted = both.groupBy(*self.keys).agg(*(F.sum(c).alias(c) for c in ["n", *self.sums, *names]), *(F.max(f"{c}_about").alias(f"{c}_about") for c in self.about))
        return counted.where("n > 0")

    def compact(self) -> None:
        """One delta of all; `clean` deletes the old ones."""
        version, state = self._state()
        if len(state["deltas"]) < 2:
            return
        name = f"delta-{version + 1}-{uuid.uuid4().hex[:8]}"
        self._merged(state).write.parquet(f"{self.path}/{name}/totals")
        if self.distinct:
            self._values(state).write.parquet(f"{self.path}/{name}/values")
        versions.commit(self.spark, self.path, version, state | {"deltas": [name]})

    def clean(self) -> None:
        """Delete folders that the state doesn't name."""
        _, state = self._state()
        for name in versions.names(self.spark, self.path):
            if name != "state" and name not in state["deltas"]:
                versions.delete(self.spark, f"{self.path}/{name}")
