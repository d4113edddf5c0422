"""A Merkle manifest of a table's rows: roots, proofs and their verification.

Each source's rows, by doc_id, are the leaves of a tree of three children a node;
the sources' roots are the leaves of the tree above. Rows are sorted over the
cluster and numbered from what each partition tells of its ends, so a source is
spread over as many partitions as its rows need.

The trees are climbed and descended in supersteps over RDDs of (block, messages).
A block holds the up to 3**HEIGHT nodes of a level that share an ancestor HEIGHT
levels above. Going up, nodes message their block; a block that has its children's
messages hashes them level by level and forwards one hash to the block above. A
block that is the only one of its tree and folds to one node is done: that node is
its tree's root. As a first block that isn't full is the only one, no sizes are
needed. Going down, the superstep is reversed: a block gets the sibling path of
its own top node from above, and sends each node its siblings followed by that
path, until leaves hold theirs whole and check it. Every superstep is written to
the shared folder, so a lost executor costs that step's part only.

H is the lowercase hex SHA-256 of the inputs one after another, digests as hex
text. A leaf is H of its columns, each `-` if null, else the number of its UTF-8
bytes, `:` and the value.

Defined results: a null source is a source of its own, the first one; null doc_ids
come first in their source; rows that repeat a doc_id follow by their leaf; equal
rows each have a leaf, a place and a proof; a source of one row has that leaf as
its root; an empty table gives an empty one. Extra columns are no part of a leaf.
Texts of any length are hashed by built-in functions, trees hold digests only.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _files, partitions, shared_folder, written

#: Children of a node, and levels that a superstep climbs unless told otherwise.
FAN, HEIGHT = 3, 6
#: The columns of a leaf, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(columns: list[Column]) -> Column:
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def climb(hashes: list[str], first: bool, height: int = HEIGHT) -> list[list[str]]:
    """The levels of a block, its nodes first. A first block that isn't full stops at one node, others after `height` levels."""
    levels = [hashes]
    whole = not first or len(hashes) == FAN**height
    while len(levels) <= height if whole else len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([digest(*low[i : i + FAN]) for i in range(0, len(low), FAN)])
    return levels


def paths(levels: list[list[str]], above: tuple) -> list[tuple]:
    """For each node of a block its siblings (those before it, those after it), level by level, and then the path from above."""
    told = [above]
    for low in reversed(levels[:-1]):
        told = [((tuple(low[i - i % FAN : i]), tuple(low[i + 1 : i - i % FAN + FAN])), *told[i // FAN]) for i in range(len(low))]
    return told


def fold(start: str, path: tuple) -> str:
    """The root that a leaf leads to by its path; a path's step may be of one node without siblings."""
    for before, after in path:
        start = digest(*before, start, *after)
    return start


def _kept(rdd: RDD, spark: SparkSession, name: str) -> RDD:
    """Cut the lineage: write an RDD in the shared folder and read it again. It goes when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rdd.saveAsPickleFile(path)
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    return spark.sparkContext.pickleFile(path)


def _numbered(rows: RDD) -> RDD:
    """((source's number, place in its source), row) of sorted rows whose first field is the source."""

    def ends(part: int, own):
        """One row a partition: its first and last source, how many it has, rows of the last one."""
        first = last = None
        sources = run = 0
        for source, same in itertools.groupby(own, key=lambda r: r[0]):
            first = source if not sources else first
            last, sources, run = source, sources + 1, sum(1 for _ in same)
        if sources:
            yield part, first, last, sources, run

    starts: dict[int, tuple[int, int]] = {}
    number, place, before = -1, 0, object()
    for part, first, last, sources, run in sorted(rows.mapPartitionsWithIndex(ends).collect(), key=lambda e: e[0]):
        if first != before:
            number, place = number + 1, 0
        starts[part] = number, place
        number, place, before = number + sources - 1, run + (place if sources == 1 else 0), last

    def told(part: int, own):
        number, place = starts.get(part, (0, 0))
        for k, (_, same) in enumerate(itertools.groupby(own, key=lambda r: r[0])):
            for i, row in enumerate(same, 0 if k else place):
                yield (number + k, i), row

    return rows.mapPartitionsWithIndex(told)


def _climbed(leaves: RDD, spark: SparkSession, parts: int, height: int) -> tuple[list[RDD], RDD]:
    """From ((tree, place), (hash, what it carries)) the written supersteps ((tree, block), nodes) and the roots (tree, (superstep, hash))."""
    size = FAN**height
    steps: list[RDD] = []
    roots: list[RDD] = []
    live = leaves
    while True:
        messages = live.map(lambda n: ((n[0][0], n[0][1] // size), (n[0][1] % size, *n[1])))
        step = _kept(messages.groupByKey(parts).mapValues(lambda nodes: sorted(nodes, key=lambda n: n[0])), spark, "merkle-up")
        tops = step.map(lambda b: (b[0], climb([n[1] for n in b[1]], b[0][1] == 0, height)[-1][0], len(b[1])))
        roots.append(tops.filter(lambda b: b[0][1] == 0 and b[2] < size).map(lambda b, k=len(steps): (b[0][0], (k, b[1]))))
        live = _kept(tops.filter(lambda b: b[0][1] > 0 or b[2] == size).map(lambda b: (b[0], (b[1], None))), spark, "merkle-tops")
        steps.append(step)
        if live.isEmpty():
            return steps, spark.sparkContext.union(roots)


def _descended(steps: list[RDD], above: RDD, spark: SparkSession, parts: int, height: int) -> RDD:
    """((tree, place), (told, path, hash, carried)) of all leaves; above: (tree, (superstep of its root, told, path above the root))."""

    def spread(b):
        (tree, block), (nodes, (told, path)) = b
        levels = climb([n[1] for n in nodes], block == 0, height)
        return [((tree, block * FAN**height + n[0]), (told, p, n[1], n[2])) for n, p in zip(nodes, paths(levels, path))]

    down = None
    for k in range(len(steps) - 1, -1, -1):
        ended = above.filter(lambda r, k=k: r[1][0] == k).map(lambda r: ((r[0], 0), r[1][1:]))
        down = ended if down is None else down.union(ended)
        nodes = steps[k].join(down, parts).flatMap(spread)
        if k:
            down = _kept(nodes.map(lambda n: (n[0], n[1][:2])), spark, "merkle-down")
    return nodes


_RESULT = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, tampered: Column, tampered_text: Column, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", source: str = "source", text: str = "text", height: int = HEIGHT) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified for every row.

    Rows where `tampered` holds are checked with `tampered_text` in place of their text.
    """
    spark, parts = docs.sparkSession, partitions(docs.sparkSession)
    changed = F.when(F.coalesce(tampered, F.lit(False)), leaf([tampered_text if c == text else F.col(c) for c in columns]))
    told = docs.select(F.col(source).cast("string").alias("_source"), F.col(key).cast("bigint").alias("_key"), leaf([F.col(c) for c in columns]).alias("_leaf"), changed.alias("_changed"))
    # written first: a sort reads its input twice, for its borders and for the rows
    rows = written(told, "merkle-leaves").orderBy("_source", "_key", "_leaf").rdd.map(tuple)
    leaves = _numbered(rows).map(lambda n: (n[0], (n[1][2], (n[1][1], n[1][3]))))
    steps, subroots = _climbed(leaves, spark, parts, height)
    subroots = _kept(subroots, spark, "merkle-subroots")
    # the tree above: one more tree, whose leaves are the sources' roots in order
    tops, found = _climbed(subroots.map(lambda r: ((0, r[0]), (r[1][1], r[1][0]))), spark, parts, height)
    root = found.map(lambda r: r[1]).collect()  # one row
    schema = f"{key} bigint, {_RESULT}"
    if not root:
        return spark.createDataFrame([], schema)
    upper = _descended(tops, spark.sparkContext.parallelize([(0, (root[0][0], None, ()))], 1), spark, parts, height)
    above = _kept(upper.map(lambda n: (n[0][1], (n[1][3], n[1][2], n[1][1]))), spark, "merkle-above")
    top = root[0][1]

    def check(n):
        _, (subroot, path, own, (doc, changed)) = n
        folded = fold(changed or own, path)
        return doc, own, subroot, top, digest(*(h for side in path for part in side for h in part)), folded, folded == top

    return spark.createDataFrame(_descended(steps, above, spark, parts, height).map(check), schema)
