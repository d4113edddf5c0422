"""Exact Jaccard links between sets of word n-grams by PartEnum signatures.

Sets are put into bands of sizes; a set close enough to the next band's least
size joins that band too, so any two sets that may link meet in one. A band cuts
the domain of the features' hashes into partitions of three cells and enumerates
the three pairs of cells of each: a signature is the content of one pair. Two
linked sets differ in at most k features, so of k // 2 + 1 partitions at least
one has a single differing cell at most, and its other two are a signature that
both sets have. Only partitions with at most one empty cell count, so that no
signature stands for nothing, and a set uses the first k // 2 + 1 of these.

First, every distinct set gives its signatures, of some partitions more than it
needs. Linked sets share one partition more than that margin, so sets that share
fewer signatures, as by a common passage, leave: they link with nothing. Tasks
look at their own signatures together before they send them, so a signature of
many sets leaves a task twice at most. The sets that are left then use half as many partitions again as they need, leave
likewise, and leave out the most frequent signatures of as many partitions as
they can spare. Small sets, and sets near a small set's size, meet by their
Jaccard prefix, features ordered from rare to frequent.

Sets that share a signature are chained, in each band. A chain is cut into blocks of bounded
size by the sets' hash, and its blocks are compared pair by pair, while that
moves fewer sets than its signatures have members. In a larger chain only sets
that share a signature are compared: neighbours in each signature's order, then
all members with the one that has most links, then, for signatures whose members
aren't all connected yet, all members, in salted blocks. Tasks return spanning
forests of the links that hold, never pairs.

Defined results: null and empty texts and texts without words have the empty set
(n_shingles 0) and link with nothing; texts of fewer words than the n-gram are
one feature; repeated rows and rows with equal sets share a component; a
component's id is its least non-null key (null if it has none); texts of any length are
read whole; an empty table gives an empty one; extra columns are ignored. Features are told apart by 64-bit hashes, sets by two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, partitions, sliced, small_batches, text_or_empty, written
from .components import components
from .covertree import forest
from .suffixdup import mixed

#: Sets of up to so many features meet by their Jaccard prefix.
SMALL = 32
#: Least sizes of the bands: each is twice the one before.
BANDS = [SMALL + 1]
while BANDS[-1] < 1 << 40:
    BANDS.append(BANDS[-1] * 2)
#: Groups of up to so many sets are told apart by their members; sets in a part of a frequent signature's chain.
FEW, PART = 48, 5_000
#: More than any set has signatures.
SURELY = 1 << 40
#: Features that are compared together, where a set counts as some features more; signatures that a task looks at
#: together; keys that are broadcast at most.
BLOCK, EACH, TOGETHER, BROADCAST_KEYS = 250_000, 100, 400_000, 200_000
#: Bytes of texts that are cut into words together; longer words are hashed one by one.
TEXTS, WORD = 200_000, 4096
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUES = np.where(_SPACE, 0, np.arange(256) + 1).astype(np.uint64)
_POWERS = np.full(WORD, _K[0], np.uint64)
_POWERS[0] = 1
_POWERS = np.multiply.accumulate(_POWERS)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of lowered bytes that end with white space."""
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.r_[0, edges]
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.r_[starts, len(data)]))
    value = _VALUES[data[starts[0] :]] * _POWERS[place & (WORD - 1)]
    found = mixed(np.add.reduceat(value, starts - starts[0]) + (ends - starts).astype(np.uint64) * _K[1])
    for i in np.flatnonzero(ends - starts >= WORD):
        found[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return found, starts


def features(texts: list[str], width: int):
    """The sorted distinct hashes of each text's n-grams of words; A-Z are lowered, only ASCII white space parts words."""
    raw, i = [t.encode() for t in texts], 0
    while i < len(raw):
        j, size = i, 0
        while j < len(raw) and (j == i or size + len(raw[j]) < TEXTS):
            size += len(raw[j]) + 1
            j += 1
        data = _LOWER[np.frombuffer(b" ".join(raw[i:j]) + b" ", np.uint8)]
        h, starts = word_hashes(data)
        borders = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw[i:j])]))
        total = h.copy()
        for k in range(1, width):
            total = total[:-1] * _K[0] + h[k:] if len(total) > 1 else total[:0]
        total = mixed(total)
        for a, b in zip(borders, borders[1:]):
            if b - a >= width:
                x = np.sort(total[a : b - width + 1])
                yield x[np.r_[True, x[1:] != x[:-1]]]
            elif b > a:
                one = np.full(1, b - a, np.uint64)
                for x in h[a:b]:
                    one = one * _K[0] + x
                yield mixed(one ^ _K[1])
            else:
                yield np.zeros(0, np.uint64)
        i = j


def set_keys(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set: of its features, and of their second hashes."""
    both = np.array([x.sum(dtype=np.uint64), y.sum(dtype=np.uint64)]) + np.full(2, len(x), np.uint64) * _K[2]
    return tuple(mixed(both).view(np.int64).tolist())


def second(x: np.ndarray) -> np.ndarray:
    return mixed(x ^ _K[3])


def allowed(n: int, percent: int) -> int:
    """Most features in which a set of n and one that is linked with it and no smaller may differ."""
    return n * (100 - percent) // percent


def needed(n: int, percent: int) -> int:
    """Partitions of which at least one must be shared."""
    return allowed(n, percent) // 2 + 1


def spare(n: int, percent: int) -> int:
    return needed(n, percent) // 2 + 1


def _needed(n, percent: int):
    """The same as a Column."""
    return F.floor(F.floor(n * (100 - percent) / percent) / 2) + 1


def parts_of(band: int, percent: int) -> int:
    """Partitions of a band: what its largest set uses, and some more in place of those with empty cells."""
    most = BANDS[band + 1] - 1
    return needed(most, percent) + spare(most, percent) + 2


def bands(n: int, percent: int) -> list[int]:
    """The band of a set's size, and the next one if a set of it may be linked; none for a size below all."""
    own = int(np.searchsorted(BANDS, n, side="right")) - 1
    return [own] * (own >= 0) + [own + 1] * (100 * n >= percent * BANDS[own + 1])


def by_prefix(n: int, percent: int) -> bool:
    """Whether a set of n may be linked with a small one."""
    return percent * n <= 100 * SMALL


def prefix(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def signatures(x: np.ndarray, y: np.ndarray, band: int, most: int, percent: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """The signatures of the first partitions of which `most` are full, and their partitions; whether there are so many.

    A full partition has one empty cell at most. Partitions before the last that aren't give what pairs they have,
    as they may be full in another set.
    """
    cells = 3 * parts_of(band, percent)
    cell = (((x >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)).astype(np.int64)
    size = np.bincount(cell, minlength=cells)
    at = np.cumsum(size)
    sums = np.zeros(len(y) + 1, np.uint64)
    np.cumsum(y, out=sums[1:])
    empty = (size == 0).reshape(-1, 3)
    full = np.flatnonzero(empty.sum(axis=1) <= 1)
    last = full[most - 1] + 1 if len(full) >= most else len(empty)
    content, empty = (sums[at] - sums[at - size]).reshape(-1, 3)[:last], empty[:last]
    mark = np.arange(3 * last, dtype=np.uint64).reshape(-1, 3) + np.full(1, band + 1, np.uint64) * _K[4]
    found = mixed(content[:, [0, 0, 1]] * _K[0] + mixed(content[:, [1, 2, 2]] + _K[1]) + mark * _K[2])
    use = ~(empty[:, [0, 0, 1]] & empty[:, [1, 2, 2]])
    return found[use], np.nonzero(use)[0], len(full) >= most


def margin(n: int, percent: int) -> int:
    """Partitions that the screen looks at beyond those of which one must be shared."""
    return needed(n, percent) // 5


def screened(x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, bool]:
    """Signatures of which a linked set shares more than the lesser margin; True if the set has too few, so that it can't leave."""
    n, out, sure = len(x), [], False
    for band in bands(n, percent):
        found, _, enough = signatures(x, y, band, needed(n, percent) + margin(n, percent), percent)
        out.append(found)
        sure |= not enough
    if by_prefix(n, percent):
        out.append(mixed(x[: prefix(n, percent)] + _K[2]))
    return np.concatenate(out), sure


def links(sets: list[np.ndarray], percent: int, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked sets; with `split`, only between those before it and those from it on."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.arange(len(sets)).repeat(sizes)
    # features of one set only can't be common
    shared = np.bincount(column)[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    row = row[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    rows, columns = (np.arange(len(sets)),) * 2 if split is None else (np.arange(split), np.arange(split, len(sets)))
    common = np.zeros((len(rows), len(columns)), np.float32)
    width = max(256, 8_000_000 // max(1, len(sets)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, [at, at + width])
        block = np.zeros((len(sets), min(width, int(column[-1]) + 1 - at)), np.float32)
        block[row[i:j], column[i:j] - at] = 1
        common += block[rows] @ block[columns].T
    p, q = np.nonzero((100 + percent) * common >= percent * (sizes[rows][:, None] + sizes[columns][None, :]) - 1e-3)
    p, q = rows[p], columns[q]
    inner = common[p, q - (0 if split is None else split)].astype(np.int64)
    ok = (100 * inner >= percent * (sizes[p] + sizes[q] - inner)) & (p < q)
    return p[ok], q[ok]


def _streamed(batches, keys: tuple[str, ...]):
    """(key, table) for runs of equal keys in sorted batches."""
    held, now = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        edge = np.zeros(batch.num_rows, bool)
        for c in cols:
            edge[1:] |= c[1:] != c[:-1]
        starts = np.r_[0, np.nonzero(edge)[0], batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(int(c[a]) for c in cols)
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _arrays(column) -> list[np.ndarray]:
    return [v.values.to_numpy(zero_copy_only=False).view(np.uint64) for v in column]


def together(sig: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures with at most two of their sets each (the least and the greatest); the sets between, once for each signature."""
    order = np.lexsort((s, sig))
    sig, s = sig[order], s[order]
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(sig)] - 1 if len(sig) else first
    many = s[first] != s[last]
    run = np.repeat(np.arange(len(first)), last - first + 1)
    between = (s != s[first][run]) & (s != s[last][run])
    return np.concatenate([sig[first], sig[last[many]]]), np.concatenate([s[first], s[last[many]]]), s[between]


def _screen(batches, width: int, percent: int):
    sig, own, seen, sure, size = [], [], set(), [], 0

    def flush():
        a, b, met = together(np.concatenate(sig).view(np.int64), np.concatenate(own))
        # what is known to be shared, or surely stays, travels as a count
        known, n = np.unique(met, return_counts=True)
        known, n = np.r_[known, np.array(sure, np.int64)], np.r_[n, np.full(len(sure), SURELY)]
        return pa.RecordBatch.from_arrays([pa.array(np.r_[a, known]), pa.array(np.r_[b, known]), pa.array(np.r_[np.zeros(len(a), np.int64), n])], names=["sig", "s", "n"])

    for batch in sliced(batches):
        for x in features(batch.column(0).to_pylist(), width):
            if not len(x):
                continue
            y = second(x)
            s, _ = set_keys(x, y)
            if s in seen:
                continue
            if len(seen) > 200_000:
                seen.clear()
            seen.add(s)
            found, must = screened(x, y, percent)
            sig.append(found)
            own.append(np.full(len(found), s))
            sure += [s] * must
            size += len(found)
            if size >= TOGETHER:
                yield flush()
                sig, own, sure, size = [], [], [], 0
    if sig:
        yield flush()


def _meeting(batches):
    """Of rows in order of sig: how many signatures each set shares, in parts to be added."""
    last, first, open_ = None, 0, False
    for batch in batches:
        sig, s, n = (batch.column(c).to_numpy() for c in ("sig", "s", "n"))
        if not len(sig):
            continue
        starts = np.flatnonzero(np.r_[last is None or sig[0] != last, sig[1:] != sig[:-1]])
        goes_on = bool(not len(starts) or starts[0] > 0)
        run = np.cumsum(np.r_[last is None or sig[0] != last, sig[1:] != sig[:-1]]) - (0 if goes_on else 1)
        heads = np.r_[np.array([first] * goes_on, np.int64), s[starts]]
        counted = n > 0
        met = np.flatnonzero((s != heads[run]) & ~counted)
        # the first set of a signature is told when another one shows
        shown = np.unique(run[met])
        told = heads[shown[1:] if goes_on and open_ and len(shown) and shown[0] == 0 else shown]
        found, which = np.unique(np.concatenate([s[met], told, s[counted]]), return_inverse=True)
        total = np.bincount(which, np.concatenate([np.ones(len(met) + len(told)), n[counted]]), len(found)).astype(np.int64)
        end = len(heads) - 1
        open_ = bool(len(shown) and shown[-1] == end) or (open_ and goes_on and end == 0)
        last, first = sig[-1], heads[-1]
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total)], names=["s", "n"])


def _trimmed(batches, percent: int):
    """Of signatures in order of (id, level): those that a set uses.

    A set that shares no more partitions than it can spare, in a band, meets no linked set there. The others leave out
    the most frequent signatures of as many partitions as they can spare: the rarest signature that two linked sets
    share has all others that they share above it, and these are of more partitions than that.
    """

    def some(rows: pa.Table) -> pa.RecordBatch:
        sig, i, pack, df = (rows.column(c).to_numpy() for c in ("sig", "id", "pack", "df"))
        part, level, n = pack & 0xFFFFF, pack >> 20 & 3, pack >> 22
        # each partition by its most frequent signature, from the most to the least frequent one
        order = np.lexsort((sig, df, part, level, i))
        group = i * 4 + level
        top = order[np.r_[(group[order[1:]] != group[order[:-1]]) | (part[order[1:]] != part[order[:-1]]), True]]
        top = top[np.lexsort((sig[top], df[top], group[top]))]
        ends = np.flatnonzero(np.r_[group[top[1:]] != group[top[:-1]], True])
        size = np.diff(np.r_[-1, ends])
        least = -(-n[top[ends]] * percent // 100)
        spares = (least * (100 - percent) // percent // 2 + 1) // 2 + 1
        enough = size > spares
        border = top[np.maximum(ends - spares, 0)]
        at = np.searchsorted(group[top[ends]], group)
        use = enough[at] & ((df < df[border][at]) | (df == df[border][at]) & (sig <= sig[border][at]))
        return pa.RecordBatch.from_arrays([pa.array(c[use]) for c in (sig, i, group, df, n)], names=["sig", "id", "v", "df", "n"])

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= TOGETHER:
            rows = pa.Table.from_batches(held).combine_chunks()
            i = rows.column("id").to_numpy()
            cut = int(np.searchsorted(i, i[-1]))  # the last set may go on
            if cut:
                yield some(rows.slice(0, cut))
            held, size = rows.slice(cut).to_batches(), rows.num_rows - cut
    if held:
        yield some(pa.Table.from_batches(held).combine_chunks())


def _chains(batches):
    """Each set with the one before it in its group; the least set of each part of a frequent signature's group."""
    end = (None, None, None)
    for batch in batches:
        sig, salt, s = (batch.column(c).to_numpy() for c in ("sig", "salt", "id"))
        salted = batch.column("salted").to_numpy(zero_copy_only=False)
        if not len(sig):
            continue
        before_sig, before_salt, before = np.r_[sig[0], sig[:-1]], np.r_[salt[0], salt[:-1]], np.r_[s[0], s[:-1]]
        same = (sig == before_sig) & (salt == before_salt)
        same[0] = False
        if end[0] is not None and (end[0], end[1]) == (sig[0], salt[0]):
            same[0], before[0] = True, end[2]
        end = (sig[-1], salt[-1], s[-1])
        link = same & (s != before)
        head = salted & ~same
        u, v, w = np.r_[s[link], s[head]], np.r_[before[link], s[head]], pa.concat_arrays([pa.nulls(int(link.sum()), pa.int64()), pa.array(sig[head], pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), w], names=["u", "v", "sig"])


def _chained(groups: DataFrame, by: str = "id") -> DataFrame:
    """(u, v): neighbours in each signature's order of sets. `groups`: sig, by, df."""
    spark = groups.sparkSession
    salted = groups.select("sig", F.col(by).alias("id"), "df").withColumns({"salt": F.pmod(F.xxhash64("id"), F.ceil(F.col("df") / PART).cast("long")), "salted": F.col("df") > PART})
    dealt = salted.select("sig", "salt", "id", "salted").repartition(partitions(spark), "sig", "salt").sortWithinPartitions("sig", "salt", "id")
    chained = written(dealt.mapInArrow(_chains, "u long, v long, sig long").distinct(), "partenum-chains")
    heads = chained.where("sig is not null").select("sig", "u")
    joined = heads.join(heads.groupBy("sig").agg(F.min("u").alias("v")), "sig").where("u <> v").select("v", "u")
    return chained.where("sig is null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).unionByName(joined.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))).distinct()


def _compared(met: DataFrame, keys: tuple[str, ...], percent: int) -> DataFrame:
    """(u, v): a spanning forest of the links in each block. `met`: the keys, id, x; with `a`, `b` and `block` among them, only between a and b."""
    spark = met.sparkSession
    two = "block" in met.columns
    dealt = met.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, *(["block"] if two else []), "id")

    def compare(batches):
        for key, rows in _streamed(batches, keys):
            s = rows.column("id").to_numpy()
            split = int((rows.column("block").to_numpy() == key[-2]).sum()) if two and key[-1] != key[-2] else None
            p, q = links(_arrays(rows.column("x")), percent, split)
            root = forest(len(s), p, q)
            some = np.nonzero(root != np.arange(len(s)))[0]
            yield pa.RecordBatch.from_arrays([pa.array(s[some]), pa.array(s[root[some]])], names=["u", "v"])

    return dealt.mapInArrow(compare, "u long, v long")


def _verified(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that are linked."""
    both = pairs.join(held.select(F.col("id").alias("u"), F.col("x").alias("xu")), "u").join(held.select(F.col("id").alias("v"), F.col("x").alias("xv")), "v")

    def check(batches):
        for batch in batches:
            ok = []
            for a, b in zip(_arrays(batch.column("xu")), _arrays(batch.column("xv"))):
                inner = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * inner >= percent * (len(a) + len(b) - inner))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return both.select("u", "v", "xu", "xv").mapInArrow(check, "u long, v long")


def _large_chains(groups: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that connect all linked sets which share a signature. `groups`: sig, id, df, n."""
    near = written(_verified(_chained(groups), held, percent), "partenum-near")
    open_ = _unresolved(groups, near)
    # the member with most links so far, against all of the others
    degree = near.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    star = open_.join(degree, "id", "left").groupBy("sig").agg(F.max_by("id", F.struct(F.coalesce("links", F.lit(0)), "id")).alias("hub"))
    spokes = open_.join(star, "sig").where("id <> hub").select(F.least("id", "hub").alias("u"), F.greatest("id", "hub").alias("v")).distinct()
    near = written(near.unionByName(_verified(spokes.join(near, ["u", "v"], "left_anti"), held, percent)), "partenum-hubs")
    open_ = _unresolved(open_, near)
    # groups with the same members are one; so many members that they aren't listed stay as they are
    small = open_.where(F.col("df") <= FEW).groupBy("sig").agg(F.sort_array(F.collect_set("id")).alias("ids")).groupBy("ids").agg(F.min("sig").alias("sig")).select("sig")
    kept = written(open_.join(small.unionByName(open_.where(F.col("df") > FEW).select("sig").distinct()), "sig", "left_semi"), "partenum-open")
    sized = kept.groupBy("sig").agg(F.ceil(F.sum(F.col("n") + EACH) / BLOCK).cast("int").alias("blocks"))
    dealt = kept.join(sized, "sig").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    met = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("sig", F.least("block", "_o").alias("a"), F.greatest("block", "_o").alias("b"), "block", "id")
    return near.unionByName(_compared(met.join(held, "id"), ("sig", "a", "b"), percent))


def _unresolved(groups: DataFrame, near: DataFrame) -> DataFrame:
    """Groups whose members aren't all connected, with three members or more (of two, the pair has been compared)."""
    joined = components(near).withColumnRenamed("component", "root")
    placed = groups.join(joined, "id", "left").withColumn("root", F.coalesce("root", "id"))
    some = placed.groupBy("sig").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("c")).where("a <> b and c > 2").select("sig")
    return written(groups.join(some, "sig", "left_semi"), "partenum-unresolved")


def _grouped(held: DataFrame, percent: int) -> DataFrame:
    """(sig, id, v, df, n): groups in which any two linked sets meet; v is a set in one of its bands. `held`: id, x."""
    spark = held.sparkSession

    def spread(batches):
        for batch in sliced(batches):
            told = []
            for i, x in zip(batch.column("id").to_pylist(), _arrays(batch.column("x"))):
                n, y = len(x), second(x)
                for level, band in enumerate(bands(n, percent)):
                    found, part, _ = signatures(x, y, band, needed(n, percent) + spare(n, percent), percent)
                    told.append((found.view(np.int64), i, part + (level << 20) + (n << 22)))
            if told:
                ids = np.repeat(np.array([t[1] for t in told], np.int64), [len(t[0]) for t in told])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([t[0] for t in told])), pa.array(ids), pa.array(np.concatenate([t[2] for t in told]))], names=["sig", "id", "pack"])

    every = held.mapInArrow(spread, "sig long, id long, pack long")
    shared = every.join(every.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1"), "sig")
    dealt = shared.select("sig", "id", "pack", "df").repartition(partitions(spark), "id").sortWithinPartitions("id")
    kept = dealt.mapInArrow(lambda batches: _trimmed(batches, percent), "sig long, id long, v long, df long, n long")

    def short(batches):
        for batch in sliced(batches):
            some = []
            for x in _arrays(batch.column("x")):
                n = len(x)
                most = needed(n, percent) + spare(n, percent)
                some.append(by_prefix(n, percent) or not all(signatures(x, x, b, most, percent)[2] for b in bands(n, percent)))
            yield pa.RecordBatch.from_arrays([batch.column("id")], names=["id"]).filter(pa.array(some, pa.bool_()))

    by_features = written(held.mapInArrow(short, "id long"), "partenum-prefixed")
    sets = held.join(by_features, "id", "left_semi").select("id", F.size("x").cast("long").alias("n"), F.explode("x").alias("f"))
    counts = sets.groupBy("f").agg(F.count("*").alias("df"))
    ranked = sets.join(counts, "f").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("df", "f")))
    n = F.col("n")
    rare = ranked.where((F.col("rank") <= n - F.ceil(n * percent / 100) + 1) & (F.col("df") > 1)).select(F.xxhash64("f").alias("sig"), "id", (F.col("id") * 4 + 2).alias("v"), "df", "n")
    return written(kept.unionByName(rare), "partenum-groups")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """key, n_shingles, component_id of every row; linked: 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    small_batches(spark)
    key_type = docs.schema[key].dataType.simpleString()
    picked = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text")).withColumns({"_t1": F.xxhash64("_text"), "_t2": F.xxhash64(F.lit(1), "_text")})

    def light(batches):
        for batch in sliced(batches):
            found = [(*set_keys(x, second(x)), len(x)) for x in features(batch.column("_text").to_pylist(), width)]
            columns = [pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_t1"), batch.column("_t2"), *columns], names=["_key", "_t1", "_t2", "s1", "s2", "n"])

    made = written(picked.select("_key", "_t1", "_t2", "_text").mapInArrow(light, f"_key {key_type}, _t1 long, _t2 long, s1 long, s2 long, n long"), "partenum-sets")
    screen = picked.select("_text").mapInArrow(lambda batches: _screen(batches, width, percent), "sig long, s long, n long")
    met = screen.repartition(partitions(spark), "sig").sortWithinPartitions("sig").mapInArrow(_meeting, "s long, n long")
    stay = written(met.groupBy("s").agg(F.sum("n").alias("shared")), "partenum-stay")
    n = F.col("n")
    lesser = F.floor(_needed(F.ceil(n * percent / 100), percent) / 5)
    # rows with equal sets are one before they meet anything
    sets = made.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("_t1", "_t2")).alias("_t"), F.first("n").alias("n"))
    hopes = sets.join(stay, F.col("s1") == F.col("s")).where((F.col("shared") > lesser) | (n * percent <= 100 * SMALL))
    # numbered and written: from here on a set is its number
    hopes = written(hopes.select("s1", "s2", "_t.*").withColumn("id", F.monotonically_increasing_id()), "partenum-hopes")
    few = hopes.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    mark = hopes.select("_t1", "_t2", "id")
    texts = picked.select("_t1", "_t2", "_text").join(F.broadcast(mark) if few else mark, ["_t1", "_t2"]).groupBy("id").agg(F.first("_text").alias("_text"))

    def again(batches):
        for batch in sliced(batches):
            found = list(features(batch.column("_text").to_pylist(), width))
            ends = np.cumsum([0, *(len(x) for x in found)])
            told = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), told], names=["id", "x"])

    held = written(texts.mapInArrow(again, "id long, x array<long>"), "partenum-features")
    groups = _grouped(held, percent)
    chain = components(_chained(groups, "v")).withColumnsRenamed({"id": "v", "component": "chain"})
    one = written(groups.groupBy("v", "id", "n").agg(F.count("*").alias("rows")).join(chain, "v"), "partenum-chained")
    sized = one.groupBy("chain").agg(F.ceil(F.sum(F.col("n") + EACH) / BLOCK).alias("blocks"), F.count("*").alias("sets"), F.sum("rows").alias("rows"))
    # what a chain's sets cost block by block, as each is compared with all; and signature by signature, at most
    plan = written(sized.withColumn("whole", F.col("blocks") * F.col("sets") <= F.greatest("rows", "sets")), "partenum-plan")
    dealt = one.select("id", "chain").join(plan.where("whole").select("chain", "blocks"), "chain").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    met = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("chain", F.least("block", "_o").alias("a"), F.greatest("block", "_o").alias("b"), "block", "id")
    found = _compared(met.join(held, "id"), ("chain", "a", "b"), percent)
    crowds = plan.where("not whole")
    if not crowds.isEmpty():
        some = one.join(crowds, "chain", "left_semi").select("v")
        found = found.unionByName(_large_chains(written(groups.join(some, "v", "left_semi"), "partenum-crowds"), held, percent))
    joined = components(written(found, "partenum-links"))
    name = hopes.select("id", "s1", "s2")
    roots = joined.join(name, "id").join(name.select(F.col("id").alias("component"), F.col("s1").alias("r1"), F.col("s2").alias("r2")), "component").select("s1", "s2", "r1", "r2")
    rows = made.select("_key", "s1", "s2", "n").where("n > 0").join(roots, ["s1", "s2"], "left").withColumns({"r1": F.coalesce("r1", "s1"), "r2": F.coalesce("r2", "s2")})
    # written, so that both sides of the join are dealt anew and large parts can be split
    least = written(rows.groupBy("r1", "r2").agg(F.min("_key").alias("component_id")), "partenum-least")
    linked = rows.join(least, ["r1", "r2"]).select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), "component_id")
    empty = made.where("n = 0").select(F.col("_key").alias(key), F.col("n").alias("n_shingles"), F.col("_key").alias("component_id"))
    discard(stay, held, groups, one, plan)
    return linked.unionByName(empty)
