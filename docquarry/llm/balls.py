"""Dealing vectors into balls: blocks of rows that are near one centre.

A group's centres are a farthest-first choice from a bounded sample of it by
hash, the upper level of a cover tree; each row goes to its nearest centre, and a
cell of more rows than a block holds is dealt on by hash. Rows meet the centres
in packs, so a group's size is no task's size.

Balls in turn are packed, those of a cell together, and each pack has a ball
around its balls. Pairs of packs are told apart first, chunk by chunk, so that no
task holds all balls of a group, and only packs that may hold near balls meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Balls of a pack, and packs whose balls are held together.
BALLS, CHUNK = 1024, 256

#: Rows of a group among which its centres are chosen; centres at most; rows that meet the centres together.
SAMPLE, CENTRES, PACK = 4096, 512, 4096


def farthest_first(x: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """An order of unit vectors, and each one's distance to those before it (the first: the greatest of all)."""
    n = len(x) if most is None else min(most, len(x))
    order, radius = np.empty(n, np.int64), np.empty(n)
    order[0], radius[0] = 0, 2.0
    near = 2.0 - 2.0 * (x @ x[0])
    near[0] = -np.inf
    for i in range(1, n):
        j = int(near.argmax())
        order[i], radius[i] = j, np.sqrt(max(near[j], 0.0))
        np.minimum(near, 2.0 - 2.0 * (x @ x[j]), out=near)
        near[j] = -np.inf
    return order, radius


def unit(raw: np.ndarray, dim: int) -> np.ndarray:
    """Rows of unit length; rows of zeros stay zeros."""
    x = raw.reshape(-1, dim).astype(np.float64)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-300)[:, None]


def _matrix(value: pa.ListScalar, dim: int) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False).reshape(-1, dim)


def deal(rows: DataFrame, group: list[str], key: str, vector: str, block_rows: int) -> DataFrame:
    """(key, _block): the block of each row, a number of its group. Rows of a group have vectors of one length."""
    hashed = F.xxhash64(key, F.lit(29))
    sizes = rows.groupBy(*group, F.size(vector).alias("_d")).agg(F.count("*").alias("_n")).withColumn("_m", F.least(F.lit(CENTRES), F.ceil(F.col("_n") / block_rows)).cast("int"))
    # one row a group; centres only where a group is more than one block
    some = rows.join(sizes.where("_m > 1"), group).where(F.pmod(hashed, F.ceil(F.col("_n") / SAMPLE)) == 0)
    sampled = some.groupBy(*group).agg(F.first("_m").alias("_m"), F.first("_d").alias("_d"), F.flatten(F.collect_list(vector)).alias("_s"))
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in group)

    def choose(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                m, d = batch.column("_m")[r].as_py(), batch.column("_d")[r].as_py()
                x = unit(_matrix(batch.column("_s")[r], d), d)
                c = x[farthest_first(x, m)[0]].ravel()
                yield pa.RecordBatch.from_arrays([*(batch.column(g).slice(r, 1) for g in group), pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c))], names=[*group, "_centres"])

    centres = sampled.mapInArrow(choose, f"{fields}, _centres array<double>")
    packs = rows.join(sizes, group).groupBy(*group, F.pmod(hashed, F.ceil(F.col("_n") / PACK)).alias("_pack")).agg(F.first("_d").alias("_d"), F.collect_list(F.struct(key, vector)).alias("_r"))
    packs = packs.join(centres, group, "left").select("_d", "_centres", F.col(f"_r.{key}").alias("_k"), F.flatten(f"_r.{vector}").alias("_x"))
    kind = rows.schema[key].dataType.simpleString()

    def assign(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                keys = batch.column("_k")[r].values
                cell = np.zeros(len(keys), np.int64)
                if batch.column("_centres")[r].is_valid:
                    d = batch.column("_d")[r].as_py()
                    cell = (unit(_matrix(batch.column("_x")[r], d), d) @ _matrix(batch.column("_centres")[r], d).T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([keys, pa.array(cell)], names=[key, "_cell"])

    celled = rows.select(*group, key).join(packs.mapInArrow(assign, f"{key} {kind}, _cell long"), key)
    parts = celled.groupBy(*group, "_cell").agg(F.ceil(F.count("*") / block_rows).alias("_parts"))
    return celled.join(parts, [*group, "_cell"]).select(key, (F.col("_cell") * (1 << 32) + F.pmod(F.xxhash64(key, F.lit(31)), "_parts")).alias("_block"))


def packs(balls: DataFrame, group: list[str], block: str = "_block", ball: str = "_ball") -> DataFrame:
    """(group, _pack, _ids, _balls, _top) from (group, block, ball: centre and radius): the packs, and the ball around each.

    A pack's balls are of one cell; distances are Euclidean.
    """
    celled = balls.withColumn("_cell", F.floor(F.col(block) / (1 << 32)))
    many = celled.groupBy(*group, "_cell").agg(F.ceil(F.count("*") / BALLS).alias("_of"))
    packed = celled.join(many, [*group, "_cell"]).groupBy(*group, (F.col("_cell") * (1 << 20) + F.pmod(F.xxhash64(block, F.lit(37)), "_of")).alias("_pack")).agg(F.collect_list(F.struct(F.col(block).alias("i"), F.col(ball).alias("b"))).alias("_r"))
    packed = packed.select(*group, "_pack", F.col("_r.i").alias("_ids"), F.flatten("_r.b").alias("_balls"))

    def around(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                b = batch.column("_balls")[r].values.to_numpy().reshape(len(batch.column("_ids")[r].values), -1)
                centre = b[:, :-1].mean(axis=0)
                top = np.r_[centre, (np.sqrt(((b[:, :-1] - centre) ** 2).sum(axis=1)) + b[:, -1]).max()]
                yield pa.RecordBatch.from_arrays([*batch.slice(r, 1).columns, pa.ListArray.from_arrays(pa.array([0, len(top)], pa.int32()), pa.array(top))], names=[*batch.schema.names, "_top"])

    return written(packed.mapInArrow(around, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema) + ", _top array<double>"), "packs")


def chunks(packed: DataFrame, group: list[str]) -> DataFrame:
    """(group, _chunk, _of, _packs, _tops): the packs' own balls in chunks of a bounded number."""
    told = packed.select(*group, "_pack", "_top").withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy("_pack")) - 1)
    of = told.groupBy(*group).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("_of"))
    held = told.groupBy(*group, F.floor(F.col("_n") / CHUNK).cast("int").alias("_chunk")).agg(F.collect_list(F.struct("_pack", "_top")).alias("_r"))
    return held.join(of, group).select(*group, "_chunk", "_of", F.col("_r._pack").alias("_packs"), F.flatten("_r._top").alias("_tops"))


def near(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Which balls (rows of centre and radius) of two sets may hold points within `limit`."""
    squares = (a[:, :-1] ** 2).sum(axis=1)[:, None] + (b[:, :-1] ** 2).sum(axis=1)[None, :] - 2.0 * (a[:, :-1] @ b[:, :-1].T)
    return np.sqrt(np.maximum(0.0, squares)) <= limit + a[:, -1][:, None] + b[:, -1][None, :]


def near_pairs(balls: DataFrame, group: list[str], limit: float, block: str = "_block", ball: str = "_ball") -> DataFrame:
    """(group, block, _other) with block <= _other: the pairs of balls, each with itself too, that may hold points within `limit`."""
    packed = packs(balls, group, block, ball)
    tops = written(chunks(packed, group), "pack-chunks")
    names = lambda kind: [*group, *kind]
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema}
    one = ", ".join(f"{g} {kinds[g]}" for g in group)
    left = tops.withColumn("_to", F.explode(F.sequence("_chunk", F.col("_of") - 1)))
    right = tops.select(*group, F.col("_chunk").alias("_to"), F.col("_packs").alias("_packs2"), F.col("_tops").alias("_tops2"))

    def pairs(ids: str, told: str, out: tuple[str, str]):
        def run(batches):
            for batch in batches:
                for r in range(batch.num_rows):
                    a, b = (batch.column(c)[r].values.to_numpy() for c in (ids, f"{ids}2"))
                    x, y = (batch.column(c)[r].values.to_numpy().reshape(len(i), -1) for c, i in ((told, a), (f"{told}2", b)))
                    i, j = np.nonzero(near(x, y, limit))
                    p, q = a[i], b[j]
                    # sets that meet themselves give each pair twice
                    own = len(a) == len(b) and bool((a == b).all())
                    p, q = (p[p <= q], q[p <= q]) if own else (np.minimum(p, q), np.maximum(p, q))
                    yield pa.RecordBatch.from_arrays([*(pa.array([batch.column(g)[r].as_py()] * len(p), batch.schema.field(g).type) for g in group), pa.array(p), pa.array(q)], names=names(out))

        return run

    met = left.join(right.hint("shuffle_hash"), [*group, "_to"]).mapInArrow(pairs("_packs", "_tops", ("_pack", "_pack2")), f"{one}, _pack long, _pack2 long")
    both = met.join(packed.drop("_top"), [*group, "_pack"]).join(packed.select(*group, F.col("_pack").alias("_pack2"), F.col("_ids").alias("_ids2"), F.col("_balls").alias("_balls2")).hint("shuffle_hash"), [*group, "_pack2"])
    return both.repartition(*group, "_pack", "_pack2").mapInArrow(pairs("_ids", "_balls", (block, "_other")), f"{one}, {block} long, _other long")
