"""Exact removal of repeated strings by a range-partitioned, sparse suffix array.

A byte is removed if it lies in a string of `length` bytes that also starts
anywhere else. With `unit="words"` strings are sequences of `length` words: each
word stands as the eight bytes of its hash, strings start at words only, and a
removal takes the white space after its words along. Every such string contains the position whose 64-byte prefix has
the least hash within it; equal strings choose it at the same offset. So only
the suffixes that start at chosen positions are kept (about one in 170), and of
these only those whose leading 64 bytes occur more than once. Splitters sampled
from their leading bytes range-partition these suffixes, with the strings that
chose them around them, into buckets. A bucket sorts its suffixes by multikey
quicksort on eight-byte words, and within a run of equal leading bytes all
strings of `length` bytes at equal offsets are compared (by two independent
64-bit hashes). Leads that the splitters cut through are compared across the
buckets' borders in a second step, so a frequent passage may fill many buckets.

Equal texts are one class: of a class of several rows every byte of a text of at
least `length` units is removed, and one text stands for it elsewhere.

Defined results: a null text counts as empty; shorter texts lose nothing; each
row gives a result, so repeated rows and null or repeated keys do as well, and
repeated rows make each other's text repeated; matches never cross documents;
overlaps within a text count; all copies of a repeated string go, the first one
too; texts of any length are read whole; an empty table gives an empty one; extra columns are ignored. Words are runs of bytes other than ASCII white
space, case and marks included; a text without words is left as it is.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remembers, sliced, small_batches, text_or_empty, written

#: At most so many ranges are split by sampled leads; beyond, a range is split further by a hash of the lead.
RANGES = 4096
#: Bytes that choose a position; suffixes in a bucket; positions in a buffer; windows compared together.
GRAM, BUCKET, BUFFER, WINDOWS = 64, 2048, 1 << 17, 1 << 16
#: Odd multipliers of the two polynomial hashes modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_WORD = r"[^\x20\x09-\x0D]+"
_word = re.compile(_WORD.encode())


@dataclass(frozen=True)
class Unit:
    """What strings are made of: bytes as they are, or words as the bytes of their hashes."""

    words: bool
    #: number of units of a string, and its bytes in the coded text
    length: int

    @property
    def step(self) -> int:
        return 8 if self.words else 1

    @property
    def size(self) -> int:
        return self.length * self.step

    @property
    def least(self) -> int:
        """A text that holds a string has at least so many bytes."""
        return 2 * self.length - 1 if self.words else self.length

    def code(self, text: str) -> bytes:
        raw = text.encode()
        if not self.words:
            return raw
        return b"".join([xxhash.xxh3_64_digest(w) for w in raw.split()])

    def spans(self, raw: bytes, coded: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Places in the coded text as places in the text."""
        if not self.words or not coded:
            return coded
        starts = [m.start() for m in _word.finditer(raw)] + [len(raw)]
        return [(starts[a // 8], starts[b // 8]) for a, b in coded]


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    remembers("suffixdup", _tables.clear)
    if base not in _tables or len(_tables[base][0]) < n:
        size = 1 << max(16, n.bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _tables[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _tables[base]


def rolling(data: np.ndarray, starts: np.ndarray | None, length: int, base: int) -> np.ndarray:
    """Hashes of the strings of `length` bytes at the starts (None: at all)."""
    up, down = _powers(base, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    if starts is None:
        return (sums[length:] - sums[: len(sums) - length]) * down[: len(sums) - length]
    return (sums[starts + length] - sums[starts]) * down[starts]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def segments(texts: list[bytes], length: int, step: int = 1):
    """Lists of (text, offset, bytes) that hold every window of the texts once, up to a buffer's size each."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t) - length + 1), BUFFER):
            part = t[at : at + BUFFER + length - step]
            held.append((i, at, part))
            size += len(part)
            if size >= BUFFER:
                yield held
                held, size = [], 0
    if held:
        yield held


def choose(held: list[tuple[int, int, bytes]], length: int, step: int = 1):
    """The chosen positions of a buffer: text, first and last window (in the text), position (in the text), position in the buffer, hash; and the buffer."""
    data = np.frombuffer(b"".join([p for *_, p in held]) + bytes(GRAM), np.uint8)
    sizes = np.array([len(p) for *_, p in held], np.int64)
    base = np.cumsum(sizes) - sizes
    g = mixed(rolling(data, None, GRAM, _BASES[0]))
    span = length - GRAM + 1
    n = int(sizes.sum())
    # the least hash in each window, the leftmost of equals: hash above, place below
    key = (g[:n] & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
    if step > 1:  # parts begin at a unit, so units begin at multiples of the step
        key = np.where(np.arange(n) % step == 0, key, np.iinfo(np.uint64).max)
    rows = -(-n // span)
    grid = np.full(rows * span, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = key
    grid = grid.reshape(rows, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = np.concatenate([np.arange(b, b + s - length + 1, step) for b, s in zip(base, sizes, strict=True)])
    at = (np.minimum(behind[windows], ahead[windows + span - 1]) & np.uint64((1 << 24) - 1)).astype(np.int64)
    owner = np.arange(len(held)).repeat((sizes - length) // step + 1)
    first = np.nonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])[0]
    last = np.r_[first[1:] - 1, len(windows) - 1]
    owner, place = owner[first], at[first]
    shift = np.array([o for _, o, _ in held], np.int64)[owner] - base[owner]
    text = np.array([i for i, *_ in held], np.int64)[owner]
    return text, windows[first] + shift, windows[last] + shift, place + shift, place, g[place], data


def leads(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The eight leading bytes as a signed number that sorts like them."""
    words = np.ascontiguousarray(data[places[:, None] + np.arange(8)]).view(">u8").ravel().astype(np.uint64)
    return (words ^ np.uint64(1 << 63)).view(np.int64)


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """The order of the rows of a matrix by its columns, first to last: three-way parts by a pivot, the middle one column deeper."""
    out, stack, n = [], [(np.arange(len(words)), 0)], words.shape[1]
    while stack:
        rows, depth = stack.pop()
        if len(rows) < 48 or depth == n:
            out.append(rows[np.lexsort(words[rows, depth:].T[::-1])] if depth < n and len(rows) > 1 else rows)
            continue
        column = words[rows, depth]
        pivot = np.partition(column, len(column) // 2)[len(column) // 2]
        less, same = column < pivot, column == pivot
        for part, deeper in ((rows[~less & ~same], depth), (rows[same], depth + 1), (rows[less], depth)):
            if len(part):
                stack.append((part, deeper))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


_FOUND = "t1 long, t2 long, start long, end long, w1 long, w2 long"


def compare(bucket: pa.Table, length: int, cut: np.ndarray, step: int = 1) -> pa.RecordBatch:
    """Repeated windows of a bucket as intervals; windows of leads in `cut` also by hash, for a comparison with other buckets."""
    bucket = bucket.combine_chunks()
    t1, t2, low, off = (bucket.column(c).to_numpy() for c in ("t1", "t2", "low", "off"))
    contexts = bucket.column("context").to_pylist()
    size = np.array([len(c) for c in contexts], np.int64)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    base = np.cumsum(size) - size
    grams = np.ascontiguousarray(data[(base + off)[:, None] + np.arange(GRAM)])
    words = grams.view(">u8").astype(np.uint64)
    order = multikey_quicksort(words)
    new = np.r_[True, (words[order[1:]] != words[order[:-1]]).any(axis=1)]
    run = np.cumsum(new) - 1
    many = np.bincount(run)[run] > 1
    bordering = np.isin(leads(data, base + off)[order], cut)
    order, run, bordering = order[many | bordering], run[many | bordering], bordering[many | bordering]
    told = []
    count = (size[order] - length) // step + 1
    i = 0
    while i < len(order):
        # whole runs, up to so many windows
        total = np.cumsum(count[i:])
        j = i + max(1, int(np.searchsorted(total, WINDOWS, side="right")))
        while j < len(order) and run[j] == run[j - 1]:
            j += 1
        told += _repeated(data, base, order[i:j], run[i:j], bordering[i:j], count[i:j], off, low, t1, t2, length, step)
        i = j
    if not told:
        return pa.RecordBatch.from_pylist([], schema=pa.schema([(c, pa.int64()) for c in ("t1", "t2", "start", "end", "w1", "w2")]))
    parts = [pa.concat_arrays(c) for c in zip(*told)]
    return pa.RecordBatch.from_arrays(parts, names=["t1", "t2", "start", "end", "w1", "w2"])


def _repeated(data, base, who, run, bordering, count, off, low, t1, t2, length, unit):
    record = np.arange(len(who)).repeat(count)
    step = unit * (np.arange(len(record)) - (np.cumsum(count) - count).repeat(count))
    # only the bytes of these records
    sizes = unit * (count - 1) + length
    joined = np.concatenate([data[b : b + s] for b, s in zip(base[who], sizes, strict=True)])
    starts = (np.cumsum(sizes) - sizes)[record] + step
    offset = (off[who][record] - step).astype(np.uint64)
    first = mixed(rolling(joined, starts, length, _BASES[0]) + offset * np.uint64(0x2545F4914F6CDD1D))
    second = rolling(joined, starts, length, _BASES[1])
    sort = np.argsort(first, kind="stable")
    same = (first[sort[1:]] == first[sort[:-1]]) & (second[sort[1:]] == second[sort[:-1]])
    again = np.zeros(len(record), bool)
    again[sort[1:]] |= same
    again[sort[:-1]] |= same
    out = []
    edge = np.diff(np.r_[False, again].astype(np.int8))
    begins = np.nonzero(again & ((edge == 1) | (step == 0)))[0]
    ends = np.nonzero(again & (np.r_[~again[1:], True] | np.r_[step[1:] == 0, True]))[0]
    if len(begins):
        r = who[record[begins]]
        none = pa.nulls(len(begins), pa.int64())
        out.append([pa.array(t1[r]), pa.array(t2[r]), pa.array(low[r] + step[begins]), pa.array(low[r] + step[ends] + length), none, none])
    # the first of equal windows stands for them across the borders
    lone = np.zeros(len(record), bool)
    lone[sort[np.r_[True, ~same]]] = True
    some = np.nonzero(bordering[record] & lone)[0]
    if len(some):
        r = who[record[some]]
        out.append([pa.array(t1[r]), pa.array(t2[r]), pa.array(low[r] + step[some]), pa.array(low[r] + step[some] + length), pa.array(first[some].view(np.int64)), pa.array(second[some].view(np.int64))])
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def repeated_spans(docs: DataFrame, text: str = "text", unit: Unit = Unit(False, 400)) -> tuple[DataFrame, DataFrame]:
    """(t1, t2, text, spans in the coded text) of the distinct texts that repeat a string within themselves or another text; the rows with t1, t2."""
    length, step = unit.size, unit.step
    if length < 2 * GRAM:
        raise ValueError(f"strings of less than {2 * GRAM // step} units are not supported")
    small_batches(docs.sparkSession)
    keyed = docs.withColumn("_text", text_or_empty(text)).withColumns({"_t1": F.xxhash64("_text"), "_t2": F.xxhash64(F.lit(1), "_text")})
    texts = keyed.select(F.col("_t1").alias("t1"), F.col("_t2").alias("t2"), F.col("_text").alias("text"))

    def anchors(batches):
        for batch in sliced(batches):
            a, b = (batch.column(c).to_numpy() for c in ("t1", "t2"))
            raw = [unit.code(t) for t in batch.column("text").to_pylist()]
            for held in segments(raw, length, step):
                text, _, _, at, place, g, data = choose(held, length, step)
                # one row for each text and hash; a hash at two places of a text is repeated as it is
                order = np.lexsort((at, g, text))
                text, at, place, g = text[order], at[order], place[order], g[order]
                near = (text[1:] == text[:-1]) & (g[1:] == g[:-1])
                twice = np.r_[near & (at[1:] != at[:-1]), False]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g.view(np.int64)), pa.array(a[text]), pa.array(b[text]), pa.array(at), pa.array(leads(data, place)), pa.array(twice)], names=["h", "t1", "t2", "at", "lead", "twice"]
                )

    chosen = written(texts.where(F.octet_length("text") >= unit.least).mapInArrow(anchors, "h long, t1 long, t2 long, at long, lead long, twice boolean"), "suffix-anchors")
    # a long text's buffers don't see each other: count its places as well
    live = chosen.groupBy("h").agg(F.min("t1").alias("a"), F.max("t1").alias("b"), F.max("twice").alias("t"), F.min("at").alias("c"), F.max("at").alias("d")).where("a <> b or t or c <> d").select("h")
    # written, so that both sides of the join are dealt anew and large parts can be split
    live = written(live, "suffix-repeated")
    kept = written(chosen.join(live, "h", "left_semi").select("t1", "t2", "at", "lead").distinct(), "suffix-live")
    n = kept.count()
    buckets = min(-(-n // BUCKET), RANGES) or 1
    parts = -(-n // (buckets * BUCKET)) or 1
    every = max(1, n // (buckets * 64))
    sample = np.array(kept.where(F.pmod(F.xxhash64("t1", "at"), F.lit(every)) == 0).select("lead", "t1").collect(), np.int64).reshape(-1, 2) if buckets > 1 else np.zeros((0, 2), np.int64)
    sample = sample[np.lexsort((sample[:, 1], sample[:, 0]))]
    splitters = sample[[len(sample) * k // buckets for k in range(1, buckets)]] if len(sample) else sample
    places = kept.groupBy("t1", "t2").agg(F.collect_list("at").alias("places"))
    one = texts.where(F.octet_length("text") >= unit.least).groupBy("t1", "t2").agg(F.first("text").alias("text"))
    holding = written(one.join(places, ["t1", "t2"]), "suffix-texts")

    cut_leads = np.unique(splitters[:, 0]) if len(splitters) else np.zeros(0, np.int64)

    def contexts(batches):
        for batch in sliced(batches):
            a, b = (batch.column(c).to_numpy() for c in ("t1", "t2"))
            raw = [unit.code(t) for t in batch.column("text").to_pylist()]
            alive = np.concatenate([np.array(p, np.int64) + (i << 40) for i, p in enumerate(batch.column("places").to_pylist())])
            for held in segments(raw, length, step):
                text, first, last, at, place, _, data = choose(held, length, step)
                some = np.nonzero(np.isin(at + (text << 40), alive))[0]
                text, first, last, at, place = text[some], first[some], last[some], at[some], place[some]
                lead = leads(data, place)
                bucket = np.zeros(len(some), np.int64)
                if len(splitters):
                    bucket = np.searchsorted(splitters[:, 0], lead, side="left")
                    for i in np.nonzero(np.isin(lead, splitters[:, 0]))[0]:
                        same = np.nonzero(splitters[:, 0] == lead[i])[0]
                        bucket[i] = same[0] + np.searchsorted(splitters[same, 1], a[text[i]], side="right")
                # a lead that splitters cut may fill its ranges: its texts part, as their strings meet across borders anyway
                salt = np.where(np.isin(lead, cut_leads), a[text], 0).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                bucket = bucket * parts + (mixed(lead.view(np.uint64) + salt) % np.uint64(parts)).astype(np.int64)
                cut = pa.array([raw[t][f : e + length] for t, f, e in zip(text, first, last, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(a[text]), pa.array(b[text]), pa.array(first), pa.array(at - first), cut], names=["bucket", "t1", "t2", "low", "off", "context"])

    records = holding.mapInArrow(contexts, "bucket long, t1 long, t2 long, low long, off long, context binary")
    found = written(records.groupBy("bucket").applyInArrow(lambda t: pa.Table.from_batches([compare(t, length, cut_leads, step)]), _FOUND), "suffix-found")
    across = found.where("w1 is not null")
    again = across.groupBy("w1", "w2").agg(F.min("t1").alias("a"), F.max("t1").alias("b"), F.min("start").alias("c"), F.max("start").alias("d")).where("a <> b or c <> d").select("w1", "w2")
    spans = found.where("w1 is null").select("t1", "t2", "start", "end").unionByName(across.join(again, ["w1", "w2"], "left_semi").select("t1", "t2", "start", "end"))
    spans = spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return holding.select("t1", "t2", "text").join(spans, ["t1", "t2"]), keyed


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400, texts: bool = False, unit: str = "bytes") -> DataFrame:
    """key, n_bytes, n_removed (both in bytes), n_spans, kept_sha256 of every row.

    Strings are of `length` bytes, or of `length` words with `unit="words"`. If texts are asked for, also `kept`:
    what is left as a string, without the bytes of characters that a removal cut.
    """
    if unit not in ("bytes", "words"):
        raise ValueError(f"no unit: {unit}")
    of = Unit(unit == "words", length)
    found, keyed = repeated_spans(docs, text, of)

    def apply(batches):
        for batch in sliced(batches):
            out = []
            for t, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = t.encode()
                gone = of.spans(raw, merged([(s["start"], s["end"]) for s in spans]))
                at, kept = 0, []
                for a, b in gone:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                whole = "".join([k.decode("utf-8", "ignore") for k in kept]) if texts else None
                out.append((sum(b - a for a, b in gone), len(gone), hashlib.sha256(b"".join(kept)).hexdigest(), whole))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["_t1", "_t2", "removed", "pieces", "sha", "_kept"])

    told = found.mapInArrow(apply, "_t1 long, _t2 long, removed long, pieces long, sha string, _kept string")
    copies = keyed.groupBy("_t1", "_t2").agg(F.count("*").alias("copies")).where("copies > 1")
    enough = F.regexp_count("_text", F.lit(_WORD)) >= length if of.words else F.octet_length("_text") >= length
    light = keyed.select(key, "_t1", "_t2", F.octet_length("_text").cast("long").alias("n_bytes"), enough.alias("enough"), F.sha2("_text", 256).alias("whole"), *(["_text"] if texts else []))
    rows = light.join(copies, ["_t1", "_t2"], "left").join(told, ["_t1", "_t2"], "left")
    gone = F.col("enough") & F.col("copies").isNotNull()
    columns = {
        "n_removed": F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long"),
        "n_spans": F.when(gone, F.lit(1)).otherwise(F.coalesce("pieces", F.lit(0))).cast("long"),
        "kept_sha256": F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "whole")),
    }
    if texts:
        columns["kept"] = F.when(gone, F.lit("")).otherwise(F.coalesce("_kept", "_text"))
    return rows.withColumns(columns).select(key, "n_bytes", *columns)
