"""A persisted inverted index: lists of documents by term, written once, extended by what has changed.

The index is a folder of segments. A segment holds the documents of one addition
(id, digest, length) and their postings: rows (term, range, ids, counts, lengths)
in files by a hash of the term, so a query reads the files of its terms only, and
a frequent term is dealt over as many rows as its documents have ranges, which are
by length and then by hash, of so many documents and counts at most. Each row keeps its greatest count and its least length,
which bound any score inside it.
Documents whose text has changed, and those that have gone, are listed as dead in
their old segment, whose files stay as they are; `compact` rewrites postings
without the dead, from the postings. The state (segments, dead lists, numbers of
documents and tokens) is one file that is swapped by a rename.

Texts are read when documents are added, and only the changed ones are split
into tokens; searching reads postings only.

Defined results: a null text has no tokens; a null id is never added; of rows
that repeat an id one of the greatest digest counts; an empty index finds
nothing. Scores are those of retrieval.bm25 over the live documents.
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..sources import versions
from ..sources.staging import shared_folder, small, small_batches, spread, staged
from .retrieval import COMMON, top_k

#: Documents and counts of a range at most, about, and folders by hash of the term.
RANGE, OF_RANGE, BUCKETS = 8_192, 750_000, 32
#: Counts of a range that a task turns into postings at once, counts of a task that writes postings, and tokens of a task that sorts them anew.
AT_ONCE, OF_WRITER, OF_TASK = 1_000_000, 4_000_000, 2_000_000
#: Words of all queries that meet the lists of a range at once: in full text search, and when they are scored.
FEW_WORDS, SCORED_WORDS = 20_000, 200_000


def _like(length: str) -> Column:
    return F.floor(F.log2(F.col(length) + 1.0) * 4)


def _range(docs: DataFrame, doc: str = "_id", length: str = "_length", counts: str | None = None) -> Column:
    """Documents of like lengths share a range, so that bounds by the least length are close; then by hash.

    Lengths are of a few dozen kinds, each with as many ranges as its documents need, and their counts, if these are told.
    """
    held = F.sum(counts) if counts else F.lit(0)
    ranges = {k: max(-(-n // RANGE), -(-m // OF_RANGE)) for k, n, m in docs.groupBy(_like(length).alias("k")).agg(F.count("*").alias("n"), held.alias("m")).collect()}
    of = F.create_map(*(F.lit(x) for kn in sorted(ranges.items()) for x in kn)) if ranges else F.create_map(F.lit(0), F.lit(1))
    return _like(length) * (1 << 32) + F.pmod(F.xxhash64(doc), F.coalesce(F.try_element_at(of, _like(length)), F.lit(1)))


def _bucket() -> Column:
    return F.pmod(F.xxhash64("_term"), F.lit(BUCKETS)).cast("int")


def _posted(batches):
    """Documents (_range, _id, _length, _terms, _counts) in order of their ranges to postings: a row for each term of a range, more of a very large one."""
    held, entries, at = [], 0, None

    def rows():
        docs = pa.Table.from_batches(held).combine_chunks()
        lists = docs["_terms"].combine_chunks()
        told = lists.flatten().dictionary_encode()
        codes = np.asarray(told.indices, np.int64)
        order = np.argsort(codes, kind="stable")
        ends = np.append(0, np.cumsum(np.bincount(codes, minlength=len(told.dictionary))))
        which = pa.array(np.repeat(np.arange(docs.num_rows), np.asarray(lists.value_lengths()))[order])
        ids, lengths = (docs[c].combine_chunks().take(which) for c in ("_id", "_length"))
        counts = np.asarray(docs["_counts"].combine_chunks().flatten(), np.int32)[order]
        listed = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x)
        most, least = np.maximum.reduceat(counts, ends[:-1]), np.minimum.reduceat(np.asarray(lengths, np.int32), ends[:-1])
        out = pa.RecordBatch.from_arrays(
            [told.dictionary, pa.array(np.full(len(most), at, np.int64)), listed(ids), listed(pa.array(counts)), listed(lengths), pa.array(most), pa.array(least)],
            names=["_term", "_range", "_ids", "_counts", "_lengths", "_most", "_least"],
        )
        for k in range(0, out.num_rows, 50_000):
            yield out.slice(k, 50_000)

    for batch in batches:
        ranges = np.asarray(batch.column("_range"), np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if entries and (ranges[a] != at or entries >= AT_ONCE):
                yield from rows()
            if ranges[a] != at or entries >= AT_ONCE:
                held, entries, at = [], 0, int(ranges[a])
            part = batch.slice(a, b - a)
            held.append(part)
            entries += len(part.column("_terms").flatten())
    if entries:
        yield from rows()


#: Pairs of a query and a document that a batch of found ones holds at most, about.
FOUND = 1 << 18


def _found(batches):
    """Lists (_segment, _range, _ids, _by) in order of their ranges to (_q, _id): the documents of a query's lists, each once.

    A list is let go once it was read: a range holds its ids, and a bit for each query and each of them.
    """
    at, ids, queries, held = None, None, {}, np.zeros((0, 0), np.uint8)

    def pairs():
        asked, step = np.fromiter(queries, np.int64, len(queries)), max(1, FOUND // len(ids))
        for k in range(0, len(asked), step):
            q, doc = np.nonzero(np.unpackbits(held[k : min(k + step, len(asked))], axis=1, count=len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(asked[k + q]), ids.take(pa.array(doc))], names=["_q", "_id"])

    for batch in batches:
        segments, ranges = np.asarray(batch.column("_segment").dictionary_encode().indices), np.asarray(batch.column("_range"), np.int64)
        cuts = [0, *(np.flatnonzero((np.diff(ranges) != 0) | (np.diff(segments) != 0)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            place = (batch.column("_segment")[a].as_py(), int(ranges[a]))
            if place != at:
                if queries:
                    yield from pairs()
                at, ids, queries, held = place, batch.column("_ids").values[:0], {}, np.zeros((0, 0), np.uint8)
            lists, by = batch.column("_ids")[a:b], batch.column("_by")[a:b]
            told = lists.flatten().dictionary_encode()
            known = pc.index_in(told.dictionary, value_set=ids)
            new = np.asarray(known.is_null())
            which = np.asarray(known.fill_null(0), np.int64)
            which[new] = len(ids) + np.arange(new.sum())
            ids = pa.concat_arrays([ids, told.dictionary.filter(pa.array(new))])
            doc = which[np.asarray(told.indices)]
            asked, code = np.unique(np.asarray(by.flatten()), return_inverse=True)
            row = np.array([queries.setdefault(q, len(queries)) for q in asked.tolist()], np.int64)[code]
            if len(queries) > held.shape[0] or len(ids) > 8 * held.shape[1]:
                # twice as large, so that it's copied a few times at most
                more = np.zeros((max(held.shape[0], 2 * len(queries)), max(held.shape[1], len(ids) // 4 + 1)), np.uint8)
                more[: held.shape[0], : held.shape[1]] = held
                held = more
            ends, by_ends = (np.append(0, np.cumsum(np.asarray(x.value_lengths()))) for x in (lists, by))
            for k in range(b - a):
                bits = np.zeros(8 * held.shape[1], bool)
                bits[doc[ends[k] : ends[k + 1]]] = True
                held[row[by_ends[k] : by_ends[k + 1]]] |= np.packbits(bits)
    if queries:
        yield from pairs()


def word_counts(texts: list[str]) -> tuple[list[int], list[int], list[str], list[int]]:
    """(lengths, ends, terms, counts) of texts in lower case: their search tokens, each once for a text, text after text."""
    lengths, ends, terms, counts = [], [0], [], []
    for t in texts:
        words = X.PYTHON_TOKEN.findall(t)
        seen = Counter(words)
        lengths.append(len(words))
        terms += seen
        counts += seen.values()
        ends.append(len(terms))
    return lengths, ends, terms, counts


def gram_counts(texts: list[str]) -> tuple[list[int], np.ndarray, pa.Array, np.ndarray]:
    """The same of the strings of three characters from each place, fewer at a text's end, as whole numbers of 63 bits."""
    lengths = list(map(len, texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64) + 1
    rows = np.repeat(np.arange(len(texts)), lengths)
    keys = points.copy()
    for k in (1, 2):
        keys[:-k] |= np.where(rows[k:] == rows[:-k], points[k:], 0) << 21 * k
    told, codes = np.unique(keys, return_inverse=True)
    n = max(1, len(told))
    each, counts = np.unique(rows * n + codes, return_counts=True)
    parts = np.stack([told >> 21 * k & 0x1FFFFF for k in range(3)], axis=1)
    spelled, at = (parts[parts > 0] - 1).astype("<u4").tobytes().decode("utf-32-le"), np.append(0, np.cumsum((parts > 0).sum(axis=1))).tolist()
    names = pa.array([spelled[a:b] for a, b in zip(at, at[1:])], pa.string())
    return lengths, np.searchsorted(each, np.arange(len(texts) + 1) * n), names.take(pa.array(each % n)), counts


#: Characters of texts that are counted at once.
CHARACTERS = 1 << 20


def _counted(count):
    """Rows (_id, _digest, _text) to (_id, _digest, _length, _n, _terms, _counts)."""

    def each(batches):
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            sizes, a = np.cumsum([len(t) for t in texts]), 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHARACTERS, "right")))
                lengths, ends, terms, counts = count(texts[a:b])
                listed = lambda x, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind))
                yield pa.RecordBatch.from_arrays([batch.column("_id")[a:b], batch.column("_digest")[a:b], pa.array(lengths, pa.int32()), pa.array(np.diff(ends), pa.int32()), listed(terms, pa.string()), listed(counts, pa.int32())], names=["_id", "_digest", "_length", "_n", "_terms", "_counts"])
                a = b

    return each


class Segments:
    """A folder of segments, their documents (id, digest, length) and lists of dead ones, and one state that names what is live."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint"):
        self.spark, self.path, self.id_type = spark, path, id_type

    def _state(self) -> tuple[int, dict]:
        version, state = versions.current(self.spark, self.path)
        return version, state or {"segments": [], "dead": [], "documents": 0, "tokens": 0, "source": None}

    def _read(self, kind: str, names: list[str], schema: str) -> DataFrame:
        """Tables of segments or dead lists, each row with its folder's name."""
        tables = [self.spark.read.schema(schema).parquet(f"{self.path}/{n}/{kind}").withColumn("_segment", F.lit(n)) for n in names]
        return functools.reduce(DataFrame.unionByName, tables) if tables else self.spark.createDataFrame([], f"{schema}, _segment string")

    def documents(self, state: dict | None = None) -> DataFrame:
        """(_id, _digest, _length, _segment) of the live documents."""
        state = state or self._state()[1]
        rows = self._read("documents", state["segments"], f"_id {self.id_type}, _digest string, _length int")
        return rows.join(self._dead(state), ["_segment", "_id"], "left_anti") if state["dead"] else rows

    def _dead(self, state: dict) -> DataFrame:
        return small(self._read("dead", state["dead"], f"_of string, _id {self.id_type}").select(F.col("_of").alias("_segment"), "_id"), 1_000_000)

    def clean(self) -> None:
        """Delete folders that the state doesn't name: those of jobs that ended early, and those that were compacted."""
        _, state = self._state()
        for name in versions.names(self.spark, self.path):
            if name != "state" and name not in state["segments"] and name not in state["dead"]:
                versions.delete(self.spark, f"{self.path}/{name}")


class TextIndex(Segments):
    #: What a text in lower case is listed under.
    counts = staticmethod(word_counts)

    # ---- upkeep

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", complete: bool = False, source: str | None = None) -> dict:
        """Index the documents that are new or have another text; with `complete`, those that aren't among them are dead. Returns the numbers."""
        version, state = self._state()
        name = f"segment-{version + 1}-{uuid.uuid4().hex[:8]}"
        rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast(self.id_type).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
        rows = rows.withColumn("_digest", F.sha2("_text", 256))
        gone, had = None, bool(state["segments"])
        if had:
            live = self.documents(state).select("_id", F.col("_digest").alias("_had"), "_length", "_segment")
            if complete:
                gone = live.join(rows.select("_id").distinct(), "_id", "left_anti")
            rows = rows.join(live.select("_id", "_had"), "_id", "left").where(~F.col("_had").eqNullSafe(F.col("_digest"))).drop("_had")
        small_batches(self.spark)
        counted = staged(rows.select("_id", "_digest", F.lower("_text").alias("_text")).mapInArrow(_counted(self.counts), f"_id {self.id_type}, _digest string, _length int, _n int, _terms array<string>, _counts array<int>"), "index-counts", compression="zstd")
        once = counted.groupBy("_id").agg(F.max(F.struct("_digest", "_length")).alias("_m"), F.count("*").alias("_rows")).select("_id", "_m.*", "_rows")
        once.select("_id", "_digest", "_length").write.parquet(f"{self.path}/{name}/documents")
        added = self.spark.read.parquet(f"{self.path}/{name}/documents")
        n, tokens = added.agg(F.count("*"), F.coalesce(F.sum("_length"), F.lit(0))).first()
        told = {"added": n, "dead": 0}
        if n:
            each = counted.dropDuplicates(["_id", "_digest"]).join(added.select("_id", "_digest"), ["_id", "_digest"], "left_semi") if once.where("_rows > 1").limit(1).count() else counted
            # whole documents go to the task of their range, which turns them into lists and writes these: no row is made for each word of each text
            counts = each.agg(F.sum("_n")).first()[0]
            parts = max(min(self.spark.sparkContext.defaultParallelism, -(-counts // OF_RANGE)), -(-counts // OF_WRITER), 1)
            placed = each.select(_range(each, counts="_n").alias("_range"), "_id", "_length", "_terms", "_counts").repartition(parts, "_range").sortWithinPartitions("_range", "_id")
            self._write(placed.mapInArrow(_posted, self._listing()), f"{self.path}/{name}")
            state["segments"] = [*state["segments"], name]
        if had:
            old = live.join(added.select("_id"), "_id", "left_semi")
            dead = staged(old.unionByName(gone) if gone is not None else old, "index-dead")
            lost, without = dead.agg(F.count("*"), F.coalesce(F.sum("_length"), F.lit(0))).first()
            if lost:
                dead.select(F.col("_segment").alias("_of"), "_id").write.parquet(f"{self.path}/{name}/dead")
                state["dead"] = [*state["dead"], name]
            told["dead"], n, tokens = lost, n - lost, tokens - without
        state |= {"documents": state["documents"] + n, "tokens": state["tokens"] + tokens, "source": source}
        versions.commit(self.spark, self.path, version, state)
        return told

    def _listing(self) -> str:
        return f"_term string, _range bigint, _ids array<{self.id_type}>, _counts array<int>, _lengths array<int>, _most int, _least int"

    def _write(self, listed: DataFrame, at: str) -> None:
        """Postings in folders by the term's hash, sorted; a task writes a file of each folder."""
        rows = listed.withColumn("_bucket", _bucket())
        rows.sortWithinPartitions("_bucket", "_term", "_range").write.partitionBy("_bucket").option("compression", "zstd").parquet(f"{at}/postings")

    def compact(self) -> None:
        """One segment of the live documents, from the postings; the dead go. Old folders stay for readers that have begun, `clean` deletes them."""
        version, state = self._state()
        if not state["segments"]:
            return
        name = f"segment-{version + 1}-{uuid.uuid4().hex[:8]}"
        self.documents(state).select("_id", "_digest", "_length").write.parquet(f"{self.path}/{name}/documents")
        each = self._entries(self._postings(state), state)
        live = self.spark.read.parquet(f"{self.path}/{name}/documents")
        p = F.col("_p")
        listed = each.groupBy("_term", _range(live).alias("_range")).agg(F.sort_array(F.collect_list(F.struct("_id", F.col("_count").alias("c"), F.col("_length").alias("n")))).alias("_p"))
        listed = listed.select("_term", "_range", p["_id"].alias("_ids"), p["c"].alias("_counts"), p["n"].alias("_lengths"), F.array_max(p["c"]).alias("_most"), F.array_min(p["n"]).alias("_least"))
        # a task's part doesn't grow with the table
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-state["tokens"] // OF_TASK))
        self._write(listed.repartition(parts, _bucket(), F.pmod(F.hash("_term", "_range"), F.lit(max(1, parts // BUCKETS)))), f"{self.path}/{name}")
        versions.commit(self.spark, self.path, version, state | {"segments": [name], "dead": []})

    # ---- search

    def _postings(self, state: dict) -> DataFrame:
        return self._read("postings", state["segments"], f"{self._listing()}, _bucket int")

    def _entries(self, postings: DataFrame, state: dict) -> DataFrame:
        """Postings as one row for each live document of a term."""
        rest = [c for c in postings.columns if c not in ("_ids", "_counts", "_lengths", "_most", "_least")]
        flat = postings.select(*rest, F.explode(F.arrays_zip("_ids", "_counts", "_lengths")).alias("_z")).select(*rest, F.col("_z._ids").alias("_id"), F.col("_z._counts").alias("_count"), F.col("_z._lengths").alias("_length"))
        return flat.join(self._dead(state), ["_segment", "_id"], "left_anti") if state["dead"] else flat

    def _lists(self, terms: DataFrame, state: dict) -> DataFrame:
        """The postings of some terms: their folders' files only, as many of these as there are at most."""
        buckets = [r[0] for r in terms.select(_bucket()).distinct().collect()]
        return self._postings(state).where(F.col("_bucket").isin(buckets)).join(small(terms, 100_000), "_term")

    def bm25(self, queries: DataFrame, best: int | None = None, query_id: str = "query_id", query: str = "query", doc_id: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(query_id, doc_id, bm25); with `best`, only rows that may be among so many best of a query, ties by the least ids.

        With `best`, few words and no dead documents, the lists of a range meet in one task and all queries are scored
        there, so no row is made for a document of a list. Else rarer terms are scored first and give a cutoff. What common terms may add is bounded row by row of the
        postings; a row without a document that may still reach the cutoff is skipped whole.
        """
        _, state = self._state()
        asked = queries.select(query_id, F.explode(F.array_distinct(X.search_tokens(query))).alias("_term"))
        terms = staged(asked.select("_term").distinct(), "asked-terms")
        n, mean = float(state["documents"]), (state["tokens"] / state["documents"] if state["tokens"] else 1.0)
        lists = self._lists(terms, state)
        held = self._entries(lists, state).groupBy("_term").agg(F.count("*").alias("_df")) if state["dead"] else lists.groupBy("_term").agg(F.sum(F.size("_ids")).alias("_df"))
        idf = F.log(1.0 + (F.lit(n) - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
        weights = staged(asked.join(held.withColumn("_idf", idf), "_term"), "term-weights")
        score = lambda count, length: F.col("_idf") * F.col(count) * (k1 + 1) / (F.col(count) + k1 * (1 - b + b * F.col(length) / mean))
        place = [query_id, "_segment", "_range", "_id"]
        scored = lambda by: self._entries(self._lists(by.select("_term").distinct(), state), state).join(by, "_term").groupBy(*place).agg(F.sum(score("_count", "_length")).alias("bm25"))
        named = lambda df: df.select(query_id, F.col("_id").alias(doc_id), "bm25")
        if best is None:
            return named(scored(weights))
        if not state["dead"] and weights.limit(SCORED_WORDS + 1).count() <= SCORED_WORDS:
            return self._best(lists, weights, best, query_id, k1, b, mean).select(query_id, F.col("_id").alias(doc_id), "bm25")
        common = F.col("_df") > n * COMMON
        rarer = staged(scored(weights.where(~common)), "rarer-scores")
        kth = top_k(rarer, best, [F.desc("bm25"), F.asc("_id")], [query_id]).groupBy(query_id).agg(F.min("bm25").alias("_cut"), F.count("*").alias("_c")).where(F.col("_c") == best).select(query_id, "_cut")
        frequent = self._lists(weights.where(common).select("_term").distinct(), state)
        bounds = staged(frequent.select("_term", "_segment", "_range", "_most", "_least").join(weights.where(common), "_term").groupBy(query_id, "_segment", "_range").agg(F.sum(score("_most", "_least")).alias("_more")), "list-bounds")
        near = rarer.join(kth, query_id).join(bounds, [query_id, "_segment", "_range"], "left").withColumn("_more", F.coalesce("_more", F.lit(0.0)))
        near = staged(near.where(F.col("bm25") + F.col("_more") >= F.col("_cut") - 1e-6).select(*place, "bm25"), "near-scores")
        # a document without a rarer term may enter where the common terms alone could reach the cutoff
        most = bounds.groupBy(query_id).agg(F.max("_more").alias("_most_more"))
        opened = weights.select(query_id).distinct().join(kth, query_id, "left").join(most, query_id, "left").where(F.col("_cut").isNull() | (F.coalesce("_most_more", F.lit(0.0)) >= F.col("_cut"))).select(query_id)
        opened = staged(opened, "open-queries")
        closed = near.join(small(opened), query_id, "left_anti")
        wanted = self.needed(frequent, closed, weights.where(common), query_id)
        added = self._entries(wanted, state).join(closed.select(*place), place).groupBy(*place).agg(F.sum(score("_count", "_length")).alias("bm25"))
        met = closed.unionByName(added).groupBy(*place).agg(F.sum("bm25").alias("bm25"))
        return named(met.unionByName(scored(weights.join(small(opened), query_id))))

    def _best(self, lists: DataFrame, weights: DataFrame, best: int, query_id: str, k1: float, b: float, mean: float) -> DataFrame:
        """(query_id, _id, bm25) of each range's best documents of each query, all scores taken in the task of the range."""
        # queries are known by numbers, as their ids may be of any type; both sides are few, as counted
        numbers = staged(weights.select(query_id).distinct().withColumn("_q", F.monotonically_increasing_id()), "query-numbers")
        asking = weights.join(F.broadcast(numbers), query_id).groupBy("_term").agg(F.collect_list(F.struct("_q", "_idf")).alias("_by"))
        met = lists.select("_segment", "_range", "_term", "_ids", "_counts", "_lengths").join(F.broadcast(asking), "_term")

        def score(lists: pa.Table) -> pa.Table:
            # a sum of doubles depends on its order: like documents get like scores in every range
            lists = lists.sort_by("_term").combine_chunks()
            told = lists["_ids"].combine_chunks().flatten().dictionary_encode()
            at, ids = np.asarray(told.indices, np.int64), told.dictionary
            flat = lambda c: np.asarray(lists[c].combine_chunks().flatten(), np.float64)
            tf = flat("_counts")
            part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * flat("_lengths") / mean))
            ends = np.append(0, np.cumsum(np.asarray(lists["_ids"].combine_chunks().value_lengths())))
            by = lists["_by"].combine_chunks()
            q, idf = (np.asarray(by.flatten().field(c)) for c in ("_q", "_idf"))
            row, order = np.repeat(np.arange(lists.num_rows), np.asarray(by.value_lengths())), np.argsort(q, kind="stable")
            out = []
            for own in np.split(order, np.flatnonzero(np.diff(q[order])) + 1):
                held, found = np.zeros(len(ids)), np.zeros(len(ids), bool)
                for r, w in zip(row[own].tolist(), idf[own].tolist()):
                    a, z = ends[r], ends[r + 1]
                    held[at[a:z]] += w * part[a:z]
                    found[at[a:z]] = True
                near = np.flatnonzero(found)
                if len(near) > best:
                    near = near[held[near] >= np.partition(held[near], len(near) - best)[len(near) - best] - 1e-6]
                if len(near) > best:
                    # of equal scores the least ids
                    near = near[np.asarray(pc.sort_indices(ids.take(pa.array(near))))]
                    _, kind = np.unique(held[near], return_inverse=True)
                    alike = np.argsort(kind, kind="stable")
                    sizes = np.bincount(kind)
                    place = np.arange(len(near)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    near = near[alike[place < best]]
                out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(near), q[own[0]])), ids.take(pa.array(near)), pa.array(held[near])], names=["_q", "_id", "bm25"]))
            return pa.Table.from_batches(out)

        found = met.groupBy("_segment", "_range").applyInArrow(score, f"_q bigint, _id {self.id_type}, bm25 double")
        return found.join(F.broadcast(numbers), "_q").select(query_id, "_id", "bm25")

    def needed(self, lists: DataFrame, near: DataFrame, weights: DataFrame, query_id: str = "query_id") -> DataFrame:
        """The rows of postings, for each query, that hold the range of a document in question; all others are skipped."""
        return lists.join(weights, "_term").join(near.select(query_id, "_segment", "_range").distinct(), [query_id, "_segment", "_range"], "left_semi")

    def full_text(self, queries: DataFrame, doc_id: str = "doc_id", limit: int | None = None) -> DataFrame:
        """(query_id, doc) of the documents that hold some word of the query, with `limit` those of the least ids."""
        _, state = self._state()
        words = F.filter(F.array_distinct(X.search_tokens("query")), lambda w: w.rlike(r"(?U)^\w+$"))
        each = queries.select("query_id", F.explode(words).alias("_term")).groupBy("query_id").agg(F.collect_set("_term").alias("_w"))
        # queries are known by numbers, as their ids may be of any type
        numbers = staged(each.withColumn("_q", F.monotonically_increasing_id()), "asked-words")
        asked = numbers.select("query_id", "_q", F.explode("_w").alias("_term"))
        if state["dead"] or asked.limit(FEW_WORDS + 1).count() > FEW_WORDS:
            lists = self._lists(asked.select("_term").distinct(), state)
            found = self._entries(lists, state).join(small(asked, 100_000), "_term").select("query_id", "_id").distinct()
        else:
            # all lists of a document have its range: they meet there once for all queries, and what a query finds never moves
            small_batches(self.spark)
            lists = self._lists(asked.groupBy("_term").agg(F.collect_list("_q").alias("_by")), state).select("_segment", "_range", "_ids", "_by")
            met = lists.repartition("_segment", "_range").sortWithinPartitions("_segment", "_range").mapInArrow(_found, f"_q bigint, _id {self.id_type}")
            # few, as counted
            found = met.join(F.broadcast(numbers.select("_q", "query_id")), "_q")
        found = found.select("query_id", F.col("_id").alias(doc_id))
        return found if limit is None else top_k(found, limit, [F.asc(doc_id)], ["query_id"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def grams(lowered: pd.Series) -> pd.Series:
    """The distinct strings of three characters of a pattern in lower case, as the index cuts texts."""
    return lowered.map(lambda t: None if t is None else sorted({t[i : i + 3] for i in range(len(t) - 2)}))


@F.arrow_udf(T.ArrayType(T.StringType()))
def contained(texts: pa.Array, patterns: pa.Array) -> pa.Array:
    """Those of a row's patterns that its text holds."""
    pairs = zip(texts.to_pylist(), patterns.to_pylist())
    return pa.array([[p for p in asked if p in t] if t else [] for t, asked in pairs], pa.list_(pa.string()))


class SubstringIndex(TextIndex):
    """Documents by the strings of three characters that they hold, for patterns inside words, without case.

    An empty or null pattern finds nothing.
    """

    counts = staticmethod(gram_counts)
    #: A pattern's rarest lists that are read.
    LISTS = 4

    def _asked(self, queries: DataFrame, pattern: str) -> DataFrame:
        return staged(queries.select("query_id", F.lower(pattern).alias("_pattern")).where(F.length("_pattern") > 0), "asked-patterns")

    def _holding(self, patterns: DataFrame) -> DataFrame:
        """(_id, _patterns): the patterns whose rarest strings a document holds; the lists of a range meet in one task, so none is taken apart into rows."""
        _, state = self._state()
        long = patterns.where(F.length("_pattern") >= 3).select("_pattern", F.explode(grams("_pattern")).alias("_term"))
        sizes = self._lists(long.select("_term").distinct(), state).groupBy("_term").agg(F.sum(F.size("_ids")).alias("_size"))
        # a string without a list tells that nothing is found; it stays as the rarest of all
        ranked = long.join(sizes, "_term", "left").withColumn("_size", F.coalesce("_size", F.lit(0)))
        chosen = staged(top_k(ranked, self.LISTS, [F.asc("_size"), F.asc("_term")], ["_pattern"]), "rarest-lists")
        needed = chosen.join(chosen.groupBy("_pattern").agg(F.count("*").cast("int").alias("_of")), "_pattern")
        asking = lambda df, by: small(df.groupBy(*by).agg(F.collect_list(F.struct("_pattern", "_of")).alias("_by")), 100_000)
        met = self._lists(chosen.select("_term").distinct(), state).join(asking(needed, ["_term"]), "_term").select("_segment", "_range", "_ids", "_by")
        short = patterns.where(F.length("_pattern") < 3)
        if not short.isEmpty():
            begin = short.select("_pattern", F.lit(1).alias("_of"), F.col("_pattern").alias("_begin"), F.length("_pattern").alias("_long"))
            lists = self._postings(state).withColumn("_long", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("_begin", F.left("_term", F.col("_long"))).where(F.length("_begin") == F.col("_long"))
            met = met.unionByName(lists.join(asking(begin, ["_begin", "_long"]), ["_begin", "_long"]).select("_segment", "_range", "_ids", "_by"))

        def hold(lists: pa.Table) -> pa.Table:
            segment, lists = lists["_segment"][0].as_py(), lists.combine_chunks()
            ids, by = lists["_ids"].combine_chunks(), lists["_by"].combine_chunks()
            told = ids.flatten().dictionary_encode()
            at, ends = np.asarray(told.indices, np.int64), np.append(0, np.cumsum(np.asarray(ids.value_lengths())))
            names = by.flatten().field("_pattern").dictionary_encode()
            of, code = np.asarray(by.flatten().field("_of")), np.asarray(names.indices, np.int64)
            row, order = np.repeat(np.arange(lists.num_rows), np.asarray(by.value_lengths())), np.argsort(code, kind="stable")
            docs, which = [], []
            for own in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                if len(own) < of[own[0]]:
                    continue
                held = np.zeros(len(told.dictionary), np.int32)
                for r in row[own].tolist():
                    held[at[ends[r] : ends[r + 1]]] += 1
                near = np.flatnonzero(held >= of[own[0]])
                docs.append(near)
                which.append(np.full(len(near), code[own[0]]))
            docs, which = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (docs, which))
            order = np.argsort(docs, kind="stable")
            kept, first = np.unique(docs[order], return_index=True)
            found = pa.ListArray.from_arrays(pa.array(np.append(first, len(docs)), pa.int32()), names.dictionary.take(pa.array(which[order])))
            return pa.Table.from_arrays([pa.array([segment] * len(kept), pa.string()), told.dictionary.take(pa.array(kept)), found], names=["_segment", "_id", "_patterns"])

        found = met.groupBy("_segment", "_range").applyInArrow(hold, f"_segment string, _id {self.id_type}, _patterns array<string>")
        return (found.join(self._dead(state), ["_segment", "_id"], "left_anti") if state["dead"] else found).drop("_segment")

    def candidates(self, queries: DataFrame, pattern: str = "pattern") -> DataFrame:
        """(query_id, pattern, id): documents that hold a pattern's rarest strings; every one with the pattern is among them.

        Patterns shorter than three characters are found by the lists that begin with them, which is exact.
        """
        asked = self._asked(queries, pattern)
        return self._holding(asked.select("_pattern").distinct()).select("_id", F.explode("_patterns").alias("_pattern")).join(small(asked, 100_000), "_pattern").select("query_id", "_pattern", "_id")

    def containing(self, queries: DataFrame, docs: DataFrame, pattern: str = "pattern", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(query_id, doc_id) of the documents whose text holds the pattern; only the candidates' texts are looked at, each once with all its patterns."""
        asked = self._asked(queries, pattern)
        small_batches(self.spark)
        near = staged(self._holding(asked.select("_pattern").distinct()), "substring-candidates")
        found = near.join(docs.select(F.col(doc_id).alias("_id"), F.lower(text).alias("_text")), "_id").select("_id", F.explode(contained("_text", "_patterns")).alias("_pattern"))
        return found.join(small(asked, 100_000), "_pattern").select("query_id", F.col("_id").alias(doc_id)).distinct()


def folder_of(table: DataFrame, name: str) -> str:
    """A folder of this application for what is derived from a table's files."""
    spark = table.sparkSession
    return f"{shared_folder(spark)}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid5(uuid.NAMESPACE_URL, ''.join(sorted(table.inputFiles()))).hex}"


def kept_current(index: Segments, table: DataFrame, add) -> Segments:
    """The index after `add` (rows, source), which runs if the table's files have changed since; it goes with the application."""
    spark, told = table.sparkSession, []
    for f in sorted(table.inputFiles()):
        fs, at = versions.files(spark, f)
        status = fs.getFileStatus(at)
        told.append(f"{f}:{status.getLen()}:{status.getModificationTime()}")
    source = uuid.uuid5(uuid.NAMESPACE_URL, "|".join(told)).hex
    version, state = index._state()
    if not version or state["source"] != source:
        add(spread(table), source)
        if not version:
            fs, at = versions.files(spark, index.path)
            fs.deleteOnExit(at)
    return index


def of_files(docs: DataFrame, name: str, doc_id: str = "doc_id", text: str = "text", kind: type[TextIndex] = TextIndex) -> TextIndex:
    """The index of a table of files in the shared folder: made at the first call, brought up to date when the files change."""
    index = kind(docs.sparkSession, folder_of(docs, name), docs.schema[doc_id].dataType.simpleString())
    return kept_current(index, docs, lambda rows, source: index.add(rows, doc_id, text, complete=True, source=source))
