"""Exact near-duplicate links of embeddings by dual traversal of cover trees.

Rows of a label are dealt to the centres of a global upper level, as blocks of
bounded size (`balls`), and each block holds one cover tree: farthest-first order
gives nested levels whose radii halve, every point lies within the radius of a
centre of each level, and each centre knows the greatest distance to a point
below it. Pairs of blocks of a label whose balls may hold points within the
threshold, by their centres and covering radii, are traversed together, level by
level: a pair of nodes is dropped if its centres are farther
apart than the threshold and both covering radii allow, and the surviving pairs'
children meet on the next level. Points that are left over are compared by
cosine in double precision, so the links are exact.

Equal vectors of a label are one class before the trees are built, so copies are
never paired. A pair of blocks returns for each class how many rows it links to
and a spanning forest of its links, at most one edge a class, so what leaves a
task grows with the block and not with the number of pairs. A large label
becomes many blocks; no task holds more than two.

Defined results: rows whose vector is null, zero or holds null or non-finite
components, and rows with a null label or of another length, link with nothing
and form their own component; rows that repeat an id count as rows (each links
with the other) and get the same component; a null id is its own component
(null) and isn't linked; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .balls import deal, farthest_first, near_pairs, unit
from .common import partitions, written
from .components import components
from .topk import finite

#: Distances are compared with this slack, and the cosine decides.
SLACK = 1e-6


class CoverTree:
    """Levels of a block of unit vectors in farthest-first order."""

    def __init__(self, x: np.ndarray, radius: np.ndarray):
        self.x = x
        #: number of centres of each level; the last holds every point
        self.sizes, r = [1], 1.0
        while self.sizes[-1] < len(x):
            size = int(np.searchsorted(-radius, -r, side="left"))
            size = max(size, 1)
            if size > self.sizes[-1]:
                self.sizes.append(size)
            r /= 2
            if r < 2**-6:
                if self.sizes[-1] < len(x):
                    self.sizes.append(len(x))
                break
        #: parent of each centre of a level among those of the level above
        self.parent: list[np.ndarray] = []
        for a, b in zip(self.sizes, self.sizes[1:]):
            up = np.arange(b)
            if b > a:
                up[a:] = (x[a:b] @ x[:a].T).argmax(axis=1)
            self.parent.append(up)
        #: covering radius of each centre of a level: greatest distance to a point below it
        self.cover = [np.zeros(s) for s in self.sizes]
        at = np.arange(len(x))
        for k in range(len(self.sizes) - 1, -1, -1):
            if k < len(self.parent):
                at = self.parent[k][at]
            far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", x, x[at])))
            np.maximum.at(self.cover[k], at, far)


def dual(a: CoverTree, b: CoverTree, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of points that may lie within `limit`; none that does is left out."""
    live = np.ones((1, 1), bool)
    rows, columns = np.zeros(1, np.int64), np.zeros(1, np.int64)
    top = max(len(a.sizes), len(b.sizes))
    for k in range(top):
        i, j = min(k, len(a.sizes) - 1), min(k, len(b.sizes) - 1)
        if k:
            # the children of nodes with a surviving partner meet
            up_a = a.parent[i - 1] if k < len(a.sizes) else np.arange(a.sizes[i])
            up_b = b.parent[j - 1] if k < len(b.sizes) else np.arange(b.sizes[j])
            to_a, to_b = np.full(max(a.sizes[max(i - 1, 0)], a.sizes[i]), -1), np.full(max(b.sizes[max(j - 1, 0)], b.sizes[j]), -1)
            to_a[rows], to_b[columns] = np.arange(len(rows)), np.arange(len(columns))
            child_a, child_b = np.nonzero(to_a[up_a] >= 0)[0], np.nonzero(to_b[up_b] >= 0)[0]
            live = live[np.ix_(to_a[up_a[child_a]], to_b[up_b[child_b]])]
            rows, columns = child_a, child_b
        far = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a.x[rows] @ b.x[columns].T)))
        live = live & (far <= limit + SLACK + a.cover[i][rows][:, None] + b.cover[j][columns][None, :])
        some_a, some_b = live.any(axis=1), live.any(axis=0)
        rows, columns, live = rows[some_a], columns[some_b], live[np.ix_(some_a, some_b)]
        if not len(rows):
            break
    p, q = np.nonzero(live)
    return rows[p], columns[q]


def forest(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The least vertex that each of n vertices reaches over the edges (p, q)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        np.minimum.at(new, label[p], low)
        np.minimum.at(new, label[q], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_links(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label", block_rows: int = 2048) -> DataFrame:
    """key, n_links, component_id, kept for every row."""
    spark = vectors.sparkSession
    key_type = vectors.schema[key].dataType.simpleString()
    good = finite(vector) & F.exists(vector, lambda x: x != 0) & F.col(label).isNotNull() & F.col(key).isNotNull()
    element = vectors.schema[vector].dataType.elementType.simpleString()
    rows = vectors.where(good).select(F.col(key).alias("_id"), F.col(label).cast("string").alias("_label"), F.transform(vector, lambda x: x + F.lit(0).cast(element)).alias("_x"))
    # one class for each label and vector; adding 0 has made -0.0 and 0.0 equal
    found = rows.groupBy("_label", "_x").agg(F.min("_id").alias("_first"), F.count("*").alias("_copies"))
    classes = written(found.withColumn("_class", F.monotonically_increasing_id()), "cover-classes")
    sized = classes.withColumn("_dim", F.size("_x"))
    dealt = sized.join(deal(sized, ["_label", "_dim"], "_class", "_x", block_rows), "_class")
    packed = dealt.groupBy("_label", "_dim", "_block").agg(F.collect_list(F.struct("_class", "_copies", "_x")).alias("_r"))
    packed = packed.select("_label", "_dim", "_block", F.col("_r._class").alias("_ids"), F.col("_r._copies").alias("_copies"), F.flatten("_r._x").alias("_x"))
    value = vectors.schema[vector].dataType.elementType.simpleString()
    block_schema = f"_label string, _dim int, _block long, _ids array<long>, _copies array<long>, _radius array<double>, _x array<{value}>, _centre array<double>"

    def build(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column("_dim")[r].as_py()
                raw = batch.column("_x")[r].values.to_numpy(zero_copy_only=False).reshape(-1, dim)
                x = unit(raw, dim)
                order, radius = farthest_first(x)
                # the ball: its centre, and last the greatest distance from there
                centre = unit(x.mean(axis=0) + 1e-12, dim)[0]
                ball = np.r_[centre, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ centre).min()))]
                take = pa.array(order)
                lists = [batch.column(c)[r].values.take(take) for c in ("_ids", "_copies")]
                one = [batch.column(c).slice(r, 1) for c in ("_label", "_dim", "_block")]
                made = [*lists, pa.array(radius), pa.array(raw[order].ravel(), batch.column("_x").type.value_type), pa.array(ball)]
                yield pa.RecordBatch.from_arrays([*one, *(pa.ListArray.from_arrays(pa.array([0, len(m)], pa.int32()), m) for m in made)], names=[c.split()[0] for c in block_schema.split(", ")])

    trees = written(packed.repartition(partitions(spark), "_label", "_dim", "_block").mapInArrow(build, block_schema), "cover-trees")
    limit = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)))

    pairs = near_pairs(trees.select("_label", "_dim", "_block", F.col("_centre").alias("_ball")), ["_label", "_dim"], limit + SLACK)
    left = pairs.join(trees.drop("_centre"), ["_label", "_dim", "_block"])
    right = trees.select("_label", "_dim", F.col("_block").alias("_other"), *(F.col(c).alias(f"{c}2") for c in ("_ids", "_copies", "_radius", "_x")))
    met = left.join(right.hint("shuffle_hash"), ["_label", "_dim", "_other"]).repartition(partitions(spark), "_label", "_block", "_other")
    link_schema = "_id long, _links long, _to long"

    def traverse(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                dim, own = batch.column("_dim")[r].as_py(), batch.column("_block")[r].as_py() == batch.column("_other")[r].as_py()
                get = lambda c: batch.column(c)[r].values  # noqa: B023, E731
                a = CoverTree(unit(get("_x").to_numpy(zero_copy_only=False), dim), get("_radius").to_numpy())
                b = a if own else CoverTree(unit(get("_x2").to_numpy(zero_copy_only=False), dim), get("_radius2").to_numpy())
                p, q = dual(a, b, limit)
                if own:
                    p, q = p[p < q], q[p < q]
                na, n = len(a.x), len(a.x) + (0 if own else len(b.x))
                ok = np.concatenate([np.einsum("ij,ij->i", a.x[p[s : s + 65536]], b.x[q[s : s + 65536]]) >= threshold for s in range(0, len(p), 65536)] or [np.zeros(0, bool)])
                p, q = p[ok], q[ok] + (0 if own else na)
                copies = get("_copies").to_numpy() if own else np.concatenate([get("_copies").to_numpy(), get("_copies2").to_numpy()])
                links = np.zeros(n, np.int64)
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                root = forest(n, p, q)
                some = np.nonzero(links)[0]
                ids = get("_ids") if own else pa.concat_arrays([get("_ids"), get("_ids2")])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(links[some]), ids.take(pa.array(root[some]))], names=["_id", "_links", "_to"])

    links = written(met.mapInArrow(traverse, link_schema), "cover-links")
    joined = components(links.select(F.col("_id").alias("u"), F.col("_to").alias("v"))).withColumnRenamed("id", "_class")
    counted = links.groupBy(F.col("_id").alias("_class")).agg(F.sum("_links").alias("_links"))
    linked = classes.select("_class", "_first").join(joined, "_class")
    least = linked.groupBy("component").agg(F.min("_first").alias("_least"))
    told = joined.join(least, "component").join(counted, "_class").select("_class", "_links", "_least")
    per_class = classes.join(told, "_class", "left").select(
        "_label", "_x", (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("n_links"), F.coalesce("_least", "_first").alias("component_id")
    )
    alone = vectors.where(~F.coalesce(good, F.lit(False))).select(F.col(key).alias(key), F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"))
    single = per_class.join(rows, ["_label", "_x"]).select(F.col("_id").alias(key), "n_links", "component_id")
    return single.unionByName(alone).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
