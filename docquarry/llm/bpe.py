"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap. Each chunk is pre-tokenised alone, which
may start and end wrongly at its borders. Where two neighbours agree on a
pre-token boundary inside their overlap they agree on all that follows, because
the pattern looks ahead but never back; there they are stitched. The stitched
pre-tokens are then encoded one by one, and decoding concatenates the bytes of
the ids. Texts up to `long_chars` go through all steps inside one map task with
no shuffle. Longer ones are written with a number, their chunks are dealt over
the cluster for their boundaries and meet again by that number to be stitched,
and the stitched pre-tokens are dealt once more, in parts, to be encoded; only
stitching and the last concatenation see a long text whole.

Defined results: a null text counts as empty and gives no ids; rows are never
merged, so repeated rows (and null or repeated keys) each give a result; columns
other than the key and the text are ignored, whatever their names; an empty
table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import partitions, remembers, small_batches, text_or_empty, written

#: Matches that end this close to a chunk's end may still change with what follows.
GUARD = 8
#: Pre-tokens that a task remembers with their ids; pre-tokens of a part of a long text.
REMEMBERED, PART = 300_000, 50_000


def boundaries(pattern: "regex.Pattern", text: str) -> list[int]:
    """Start offsets of the matches; the pattern covers all of a text."""
    return [m.start() for m in pattern.finditer(text)]


def cut(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """Overlapping chunks of a text with their offsets; the empty text has none."""
    step, out, at = chunk - overlap, [], 0
    if step <= 0:
        raise ValueError("a chunk must be longer than its overlap")
    while at < len(text):
        out.append((at, text[at : at + chunk]))
        if at + chunk >= len(text):
            break
        at += step
    return out


def stitch(pattern: "regex.Pattern", chunks: list[tuple[int, str]], starts: list[list[int]]) -> Iterator[str]:
    """Pre-tokens of the whole text from the chunks' own boundaries.

    If two neighbours share no trusted boundary (a pre-token longer than the
    overlap), the left one is continued over the text of the right one.
    """
    if not chunks:
        return
    base, text, own = chunks[0][0], chunks[0][1], starts[0]
    for (at, right), theirs in zip(chunks[1:], starts[1:], strict=True):
        # a boundary is trusted if the match before it ends well before the chunk's end
        limit = len(text) - GUARD
        trusted = {base + s for s in own if s <= limit and base + s >= at}
        meet = next((at + s for s in theirs if at + s in trusted), None)
        if meet is None:
            last = max((s for s in own if s <= limit), default=0)
            for a, b in zip(own, own[1:]):
                if b > last:
                    break
                yield text[a:b]
            text = text[last:] + right[base + len(text) - at :]
            base += last
            own = boundaries(pattern, text)
            continue
        for i, a in enumerate(own):
            if base + a >= meet:
                break
            yield text[a : own[i + 1]]
        own = [s - (meet - at) for s in theirs if at + s >= meet]
        base, text = meet, right[meet - at :]
    for i, a in enumerate(own):
        yield text[a : own[i + 1] if i + 1 < len(own) else len(text)]


def pretokens(pattern: "regex.Pattern", text: str, chunk: int, overlap: int) -> list[str]:
    if len(text) <= chunk:
        return pattern.findall(text)
    chunks = cut(text, chunk, overlap)
    return list(stitch(pattern, chunks, [boundaries(pattern, c) for _, c in chunks]))


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Lines of a rank file: base64 bytes, a blank, the rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of least rank (the leftmost of equals) until none is known."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > 400:
        return _merge_long(parts, ranks)
    none = len(ranks) + 1
    pairs = [ranks.get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while pairs:
        low = min(pairs)
        if low == none:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap over a linked list, for pieces of any length."""
    import heapq

    n = len(parts)
    after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not live[i] or j >= n or parts[i] != a or parts[j] != b:
            continue
        parts[i], live[j], after[i] = a + b, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n and (r := ranks.get(parts[left] + parts[right])) is not None:
                heapq.heappush(heap, (r, left, parts[left], parts[right]))
    return [ranks[p] for p, x in zip(parts, live) if x]


class Encoder(dict):
    """Remembers, by pre-token: the ids as decimals, and their decoded bytes."""

    def __init__(self, content: bytes, pattern: str):
        super().__init__()
        self.ranks = read_ranks(content)
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.pattern = regex.compile(pattern)

    def ids(self, piece: str) -> list[int]:
        return merge(piece.encode(), self.ranks)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def __missing__(self, piece: str) -> tuple[str, bytes]:
        ids = self.ids(piece)
        found = (" ".join(map(str, ids)), self.decode(ids))
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = found
        return found

    def told(self, pieces: list[str]) -> tuple[str, bytes]:
        found = [self[p] for p in pieces]
        return " ".join([a for a, _ in found]), b"".join([b for _, b in found])


def digests(ids: str, raw: bytes) -> tuple[int, str, str]:
    return (ids.count(" ") + 1 if ids else 0), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest()


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(content: bytes, pattern: str) -> Encoder:
    """One encoder for a worker process, kept from task to task."""
    remembers("bpe", _encoders.clear)
    key = (hashlib.sha256(content).hexdigest(), pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(content, pattern)
    return _encoders[key]


def _per_text(docs: DataFrame, key: str, text: str, make, fields: str, long_chars: int, chunk: int, overlap: int, content, pattern: str) -> DataFrame:
    """make(decimal ids, decoded bytes) -> values of `fields`, for each row."""
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(content)
    rows = docs.select(F.col(key).alias("_key"), text_or_empty(text).alias("_text"))
    key_type = rows.schema["_key"].dataType.simpleString()
    schema = f"`{key}` {key_type}, {fields}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def whole(batches):
        enc = encoder(held.value, pattern)
        for batch in batches:
            got = [make(*enc.told(pretokens(enc.pattern, t, chunk, overlap))) for t in batch.column(1).to_pylist()]
            if got:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(zip(*got), list(arrow)[1:]))], schema=arrow)

    def dealt(batches):
        for batch in batches:
            for row, t in zip(batch.column("_row").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                for n, (at, piece) in enumerate(cut(t, chunk, overlap)):
                    yield pa.RecordBatch.from_pylist([{"_row": row, "_n": n, "_at": at, "_chunk": piece}], schema=cut_schema)

    def split(batches):
        found = regex.compile(pattern)
        for batch in batches:
            starts = [boundaries(found, t) for t in batch.column("_chunk").to_pylist()]
            yield batch.append_column("_starts", pa.array(starts, pa.list_(pa.int32())))

    def stitched(group: pa.Table) -> pa.Table:
        got = sorted(zip(*(group.column(c).to_pylist() for c in ("_at", "_chunk", "_starts")), strict=True))
        pieces = stitch(regex.compile(pattern), [(a, c) for a, c, _ in got], [s for *_, s in got])
        parts = [list(p) for p in itertools.batched(pieces, PART)]
        row = pa.array([group.column("_row")[0].as_py()] * len(parts), pa.int64())
        return pa.table([row, pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.list_(pa.string()))], names=["_row", "_n", "_pieces"])

    def encoded(batches):
        enc = encoder(held.value, pattern)
        for batch in batches:
            for r in range(batch.num_rows):
                ids, raw = enc.told(batch.column("_pieces")[r].as_py())
                yield pa.RecordBatch.from_arrays([batch.column("_row").slice(r, 1), batch.column("_n").slice(r, 1), pa.array([ids]), pa.array([raw], pa.binary())], names=["_row", "_n", "_ids", "_raw"])

    def joined(group: pa.Table) -> pa.Table:
        parts = sorted(zip(*(group.column(c).to_pylist() for c in ("_n", "_ids", "_raw")), strict=True))
        values = make(" ".join(i for _, i, _ in parts), b"".join(r for *_, r in parts))
        return pa.table([group.column("_row").slice(0, 1), *(pa.array([v], f.type) for v, f in zip(values, list(arrow)[1:]))], names=["_row", *arrow.names[1:]])

    short = rows.where(F.length("_text") <= long_chars).mapInArrow(whole, schema)
    # numbered and written, so that a task that runs again finds the same numbers
    long = written(rows.where(F.length("_text") > long_chars).withColumn("_row", F.monotonically_increasing_id()), "bpe-long")
    if long.isEmpty():
        return short
    cut_schema = pa.schema([("_row", pa.int64()), ("_n", pa.int32()), ("_at", pa.int64()), ("_chunk", pa.string())])
    chunks = (
        long.select("_row", "_text").mapInArrow(dealt, "_row long, _n int, _at long, _chunk string")
        .repartition(partitions(spark), "_row", "_n").mapInArrow(split, "_row long, _n int, _at long, _chunk string, _starts array<int>")
    )
    pieces = chunks.groupBy("_row").applyInArrow(stitched, "_row long, _n int, _pieces array<string>")
    parts = pieces.repartition(partitions(spark), "_row", "_n").mapInArrow(encoded, "_row long, _n int, _ids string, _raw binary")
    told = parts.groupBy("_row").applyInArrow(joined, f"_row long, {fields}")
    return short.unionByName(long.join(told, "_row").select(F.col("_key").alias(key), *arrow.names[1:]))


def encode_digests(docs: DataFrame, content: bytes, pattern: str, key: str = "doc_id", text: str = "text", long_chars: int = 262_144, chunk: int = 65_536, overlap: int = 2_048) -> DataFrame:
    """Per row: number of ids, sha-256 of the decimal ids, sha-256 of the decoded bytes."""
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _per_text(docs, key, text, digests, fields, long_chars, chunk, overlap, content, pattern)


def encode(docs: DataFrame, content: bytes, pattern: str, key: str = "doc_id", text: str = "text", long_chars: int = 262_144, chunk: int = 65_536, overlap: int = 2_048) -> DataFrame:
    """Per row: the ids themselves."""
    return _per_text(docs, key, text, lambda ids, _: ([int(i) for i in ids.split()],), "ids array<int>", long_chars, chunk, overlap, content, pattern)


def decode(encoded: DataFrame, content: bytes, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: the bytes that the ids stand for (null ids: no bytes)."""
    held = encoded.sparkSession.sparkContext.broadcast(content)

    def run(batches):
        enc = encoder(held.value, r"\s+|\S+")
        for batch in batches:
            raw = [enc.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=[key, "bytes"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, bytes binary")
