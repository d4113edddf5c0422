"""Product codes of vectors by the filtering form of Lloyd's algorithm.

A vector's components become integers and are cut into consecutive parts; each
part position has a codebook. Every partition builds kd-trees over the parts of
its vectors, some rows at a time, with the box, the sum and the count of each
node, and writes them once. In a round a tree is walked from its root, a level at
a time, with the entries that may still be nearest: the entry nearest to a box's
middle rules out every other one that is nowhere in the box nearer. A node with
one entry left hands over its cached sum and count, its points are never looked
at; the others' children go on, and the points of a leaf are measured against the
leaf's entries. Partial sums (a row for each used entry and block of rows) are
added up by Spark.

All arithmetic is in whole numbers, so boxes rule out exactly: an entry goes if
it is farther in the whole box, or as far and later in the codebook.

What reaches the driver is of a size that parameters fix: the first `entries`
vectors, and `parts` codebooks of as many entries a round, which go to all tasks.

Defined results: rows whose vector is null, empty or holds null or non-finite
components are dropped, as are vectors of another length than the first one's and
components beyond 2**29 after scaling, so that sums of squares fit a long; rows
with a null key come last in the order that chooses the first entries, rows that
repeat a key follow by their vectors, and each gives a row; fewer rows than
entries make a smaller codebook; lengths that the parts don't divide are cut into
parts that differ by one at most; an empty table gives an empty one. Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, written

#: Points of a leaf at most; vectors whose trees are built together; labels whose sums are broadcast.
LEAF, BLOCK, BROADCAST_LABELS = 32, 8192, 100_000
#: Scaled components are within this bound.
MOST = 1 << 29


def kept(vector: str, scale: int) -> Column:
    """True for vectors that take part."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < MOST)
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, sound), F.lit(False))


def tree(x: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """A kd-tree over rows of whole numbers: `order` puts each node's points in a row, nodes follow by level.

    first, last: a node's points in that order; child: its left child, the right one follows (-1: a leaf).
    low, high, total: its box and the sum of its points.
    """
    order = np.arange(len(x))
    first, last, child, low, high, total = [0], [len(x)], [], [], [], []
    at = 0
    while at < len(first):
        a, z = first[at], last[at]
        own = x[order[a:z]]
        least, most = own.min(axis=0), own.max(axis=0)
        low.append(least)
        high.append(most)
        total.append(own.sum(axis=0))
        spread = most - least
        if z - a <= leaf or not spread.any():
            child.append(-1)
        else:
            middle = (z - a) // 2
            order[a:z] = order[a:z][np.argpartition(own[:, spread.argmax()], middle)]
            child.append(len(first))
            first += [a, a + middle]
            last += [a + middle, z]
        at += 1
    whole = {"order": order, "first": first, "last": last, "child": child, "low": low, "high": high, "total": total}
    return {k: np.asarray(v, np.int64) for k, v in whole.items()}


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, a component at a time."""
    return sum((x[:, d, None] - book[None, :, d]) ** 2 for d in range(book.shape[1]))


def filtered(t: dict[str, np.ndarray], x: np.ndarray, book: np.ndarray, points: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, counts, entry of each point of x): by whole nodes where one entry is left. Without `points` the last is empty."""
    n, far = len(book), np.iinfo(np.int64).max
    sums, counts = np.zeros_like(book), np.zeros(n, np.int64)
    entry = np.zeros(len(x) if points else 0, np.int64)
    nodes, may = np.zeros(1, np.int64), np.ones((1, n), bool)
    later = np.arange(n)
    while len(nodes):
        low, high = t["low"][nodes], t["high"][nodes]
        # twice the middle, so that it is whole; the first of the nearest entries
        best = np.where(may, _distances(low + high, 2 * book), far).argmin(axis=1)
        lead = book[best]
        margin = np.zeros(may.shape, np.int64)
        for d in range(book.shape[1]):
            corner = np.where(book[None, :, d] > lead[:, d, None], high[:, d, None], low[:, d, None])
            margin += (book[None, :, d] - corner) ** 2 - (lead[:, d, None] - corner) ** 2
        # where an entry does best against the lead it is still farther, or as far and later
        out = (margin > 0) | ((margin == 0) & (later[None, :] > best[:, None]))
        out[np.arange(len(nodes)), best] = False
        may &= ~out
        one = may.sum(axis=1) == 1
        done = nodes[one]
        np.add.at(sums, best[one], t["total"][done])
        np.add.at(counts, best[one], t["last"][done] - t["first"][done])
        if points:
            for node, e in zip(done, best[one]):
                entry[t["order"][t["first"][node] : t["last"][node]]] = e
        rest, may = nodes[~one], may[~one]
        inner = t["child"][rest] >= 0
        for node, left in zip(rest[~inner], may[~inner]):
            own = t["order"][t["first"][node] : t["last"][node]]
            entries = np.flatnonzero(left)
            e = entries[_distances(x[own], book[entries]).argmin(axis=1)]
            np.add.at(sums, e, x[own])
            np.add.at(counts, e, 1)
            if points:
                entry[own] = e
        left = t["child"][rest[inner]]
        nodes, may = np.concatenate([left, left + 1]), np.concatenate([may[inner], may[inner]])
    return sums, counts, entry


def _cuts(dim: int, parts: int) -> list[np.ndarray]:
    return np.array_split(np.arange(dim), parts)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *(v.size for v in values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([v.ravel() for v in values]), kind))


def _one(values: pa.Array) -> pa.Array:
    """A column of one row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


#: The fields of a tree and of the points, each a list for every part.
_FIELDS = {"points": "int", "order": "int", "first": "int", "last": "int", "child": "int", "low": "int", "high": "int", "total": "bigint"}
_SCHEMA = "_keys array<bigint>, _labels array<string>, " + ", ".join(f"_{f} array<array<{kind}>>" for f, kind in _FIELDS.items())


def _blocks(batches):
    """The same rows in batches of BLOCK rows; the last holds what is left."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            piece = batch.slice(at, BLOCK - size)
            held.append(piece)
            size, at = size + piece.num_rows, at + piece.num_rows
            if size == BLOCK:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _plant(dim: int, parts: int, scale: int):
    """Batches of vectors to one row a block, with the trees of all parts."""

    def run(batches):
        for block in _blocks(batches):
            x = block.column("_x").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            whole = np.floor(scale * x).astype(np.int64).reshape(-1, dim)
            points = [np.ascontiguousarray(whole[:, c]) for c in _cuts(dim, parts)]
            trees = [tree(p) | {"points": p} for p in points]
            told = [_one(_lists([t[f] for t in trees], pa.int64() if kind == "bigint" else pa.int32())) for f, kind in _FIELDS.items()]
            yield pa.RecordBatch.from_arrays([_one(block.column("_key")), _one(block.column("_label")), *told], names=["_keys", "_labels", *(f"_{f}" for f in _FIELDS)])

    return run


def _trees(batch: pa.RecordBatch, r: int, widths: list[int]) -> list[dict[str, np.ndarray]]:
    """The trees of a block's parts."""
    columns = {f: batch.column(f"_{f}")[r].values for f in _FIELDS}
    shape = lambda f, p: (-1, widths[p]) if f in ("points", "low", "high", "total") else (-1,)
    return [{f: c[p].values.to_numpy().astype(np.int64).reshape(shape(f, p)) for f, c in columns.items()} for p in range(len(widths))]


def codebooks(trees: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """The books after so many rounds: an entry becomes the floor of the mean of its parts, unused ones stay."""
    widths = [b.shape[1] for b in books]
    for _ in range(rounds):

        def partial(batches, books=books):
            for batch in batches:
                for r in range(batch.num_rows):
                    for p, t in enumerate(_trees(batch, r, widths)):
                        sums, counts, _ = filtered(t, t["points"], books[p], points=False)
                        used = np.flatnonzero(counts)
                        told = [pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(counts[used]), _lists(list(sums[used]), pa.int64())]
                        yield pa.RecordBatch.from_arrays(told, names=["_part", "_entry", "_count", "_sums"])

        found = trees.drop("_keys", "_labels").mapInArrow(partial, "_part int, _entry int, _count bigint, _sums array<bigint>")
        # at most parts * entries rows, whatever the table
        added = found.groupBy("_part", "_entry").agg(F.sum("_count"), *(F.sum(F.get("_sums", F.lit(d))) for d in range(max(widths)))).collect()
        books = [b.copy() for b in books]
        for p, e, count, *sums in added:
            books[p][e] = [s // count for s in sums[: widths[p]]]
    return books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def _hex_rows(codes: np.ndarray) -> pa.Array:
    """Two hex digits for each number below 256, a string a row."""
    n, wide = codes.shape
    ends = pa.array(np.arange(n + 1) * 2 * wide, pa.int32())
    return pa.StringArray.from_buffers(n, ends.buffers()[1], pa.py_buffer(codes.astype(np.uint8).tobytes().hex().encode()))


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, code (two hex digits a part), error, label_error, codebooks_sha256 for every row that takes part."""
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits tells 256 entries apart")
    small_batches(vectors.sparkSession)
    order = [F.col("_key").asc_nulls_last(), "_x"]
    own = vectors.where(kept(vector, scale)).select(F.col(key).cast("bigint").alias("_key"), F.col(label).cast("string").alias("_label"), F.col(vector).alias("_x"))
    lead = own.orderBy(*order).limit(1).select(F.size("_x")).collect()
    dim = lead[0][0] if lead else parts
    own = own.where(F.size("_x") == dim)
    some = own.orderBy(*order).limit(entries).select("_x").collect()
    start = np.floor(scale * np.array([list(r[0]) for r in some], np.float64)).astype(np.int64).reshape(-1, dim)
    cuts = _cuts(dim, parts)
    trees = written(own.mapInArrow(_plant(dim, parts, scale), _SCHEMA), "codes-trees")
    books = codebooks(trees, [np.ascontiguousarray(start[:, c]) for c in cuts], rounds)
    widths = [b.shape[1] for b in books]

    def assign(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                codes, errors = [], 0
                for p, t in enumerate(_trees(batch, r, widths)):
                    e = filtered(t, t["points"], books[p], points=True)[2]
                    codes.append(e)
                    errors = errors + ((t["points"] - books[p][e]) ** 2).sum(axis=1)
                told = [batch.column("_keys")[r].values, batch.column("_labels")[r].values, _hex_rows(np.stack(codes, axis=1)), pa.array(errors)]
                yield pa.RecordBatch.from_arrays(told, names=["_key", "_label", "code", "error"])

    told = written(trees.mapInArrow(assign, "_key bigint, _label string, code string, error bigint"), "codes-assigned")
    discard(trees)
    summed = told.groupBy("_label").agg(F.sum("error").alias("label_error"))
    few = summed.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    joined = told.alias("t").join((F.broadcast(summed) if few else summed).alias("s"), F.col("t._label").eqNullSafe(F.col("s._label")))
    return joined.select(F.col("_key").alias(key), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
