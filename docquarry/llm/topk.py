"""Exact top-k search by a three-phase uniform threshold.

Vectors are dealt to balls of bounded size (`balls`), and their dimensions are
split into lists, so a score is the sum of a vector's entries in the lists.
Phase one gathers, for each query, the best entries of each list in its own ball,
scores them, and takes the k-th best as a cutoff that no true result lies below;
what reaches it in that ball is written. Phase two sends the cutoffs out: of the
other balls, a query needs those whose bound, the score of the centre and the
query's length times the radius, reaches its cutoff. Phase three collects, in
each of these balls, the entries of at least cutoff / lists (a vector whose total
reaches the cutoff has one), resolves their scores exactly and ranks those at or
above the cutoff, ties to the smaller id; k a query leave a ball.

The queries travel to the balls, each ball once; nothing is collected.

Defined results: vectors that are null, empty or hold null or non-finite
components, and rows with a null id, take no part; candidates are all rows but
those of the query's own id, rows that repeat an id each; of a query id's rows
the one of the least vector asks; vectors of unequal length are never compared; a
query with fewer than k candidates gets all of them; components are taken as
floor(scale * x) and sums must fit a long; without queries or candidates the
result is empty; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .balls import chunks, deal, packs
from .common import written

#: Groups of query parts that look at packs apart from one another.
SALTS = 32

_GATHERED = "query_id long, vec_id long, score long"


def finite(vector: str) -> Column:
    """True for vectors with at least one component, all of them finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _lists(q: np.ndarray, v: np.ndarray, lists: int) -> list[np.ndarray]:
    """The queries' entries in each list, exact: in doubles while every sum is below 2**53."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    kind = np.float64 if most < 2**53 else np.int64
    return [np.asarray(q[:, c].astype(kind) @ v[:, c].T.astype(kind)) for c in np.array_split(np.arange(q.shape[1]), min(lists, q.shape[1]))]


def _emit(q: np.ndarray, v: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(v.astype(np.int64)), pa.array(score.astype(np.int64))], names=["query_id", "vec_id", "score"])


def _top(q: np.ndarray, v: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each query, ties to the smaller id."""
    order = np.lexsort((v, -score, q))
    starts = np.flatnonzero(np.r_[True, q[order[1:]] != q[order[:-1]]]) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding", lists: int = 2, block_rows: int = 4096, query_rows: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows of each query row."""
    spark = vectors.sparkSession
    part = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.where(F.col(key).isNotNull() & finite(vector)).select(F.col(key).cast("long").alias("_id"), part.alias("_x"), F.size(vector).alias("_dim"), F.coalesce(is_query, F.lit(False)).alias("_q"))
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "topk-rows")
    blocks = written(rows.select("_row", "_dim").join(deal(rows.select("_row", "_dim", "_x"), ["_dim"], "_row", "_x", block_rows), "_row"), "topk-blocks")
    dealt = rows.join(blocks.select("_row", "_block"), "_row")
    packed = dealt.groupBy("_dim", "_block").agg(F.collect_list(F.struct("_id", "_x")).alias("_r")).select("_dim", "_block", F.col("_r._id").alias("v_ids"), F.flatten("_r._x").alias("v_x"))

    def ball(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                x = batch.column("v_x")[r].values.to_numpy(zero_copy_only=False).reshape(len(batch.column("v_ids")[r].values), -1).astype(float)
                centre = x.mean(axis=0)
                told = np.r_[centre, np.sqrt(((x - centre) ** 2).sum(axis=1).max())]
                yield pa.RecordBatch.from_arrays([batch.column("_dim").slice(r, 1), batch.column("_block").slice(r, 1), pa.ListArray.from_arrays(pa.array([0, len(told)], pa.int32()), pa.array(told))], names=["_dim", "_block", "_ball"])

    vs = written(packed, "topk-balls")
    asks = dealt.where("_q").groupBy("_id", "_dim").agg(F.min(F.struct("_x", "_block")).alias("_m")).groupBy("_id").agg(F.min(F.struct("_dim", "_m")).alias("_m"))
    asks = asks.select("_id", "_m._dim", F.col("_m._m._x").alias("_x"), F.col("_m._m._block").alias("_block"))
    few = asks.groupBy("_dim", "_block").agg(F.ceil(F.count("*") / query_rows).alias("_parts"))
    asks = asks.join(few, ["_dim", "_block"]).withColumn("_part", F.pmod(F.xxhash64("_id"), "_parts"))
    qs = asks.groupBy("_dim", "_block", "_part").agg(F.collect_list(F.struct("_id", "_x")).alias("_r")).select("_dim", "_block", "_part", F.col("_r._id").alias("q_ids"), F.flatten("_r._x").alias("q_x"))
    qs = written(qs, "topk-queries")
    least = -(2**62)
    schema = "_dim int, _block long, _part long, _id long, _cut long, _v long, _s long"

    def gather(batches):
        """Each query's cutoff by its own ball (rows without _v), and what reaches it there."""
        for batch in batches:
            for r in range(batch.num_rows):
                qi, vi = (batch.column(c)[r].values.to_numpy() for c in ("q_ids", "v_ids"))
                q, v = (batch.column(c)[r].values.to_numpy().reshape(len(i), -1) for c, i in (("q_x", qi), ("v_x", vi)))
                parts = _lists(q, v, lists)
                total = sum(parts)
                low = np.finfo(np.float64).min if total.dtype == np.float64 else np.iinfo(np.int64).min
                same = qi[:, None] == vi[None, :]
                chosen = np.zeros(total.shape, bool)
                m = min(k, len(vi))
                for part in parts:
                    part = np.where(same, low, part)
                    np.put_along_axis(chosen, np.argpartition(part, len(vi) - m, axis=1)[:, len(vi) - m :], True, axis=1)
                got = np.where(chosen & ~same, total, low)
                # a query that gathered fewer than k entries has no safe cutoff and collects everything
                cut = np.where((chosen & ~same).sum(axis=1) >= k, np.partition(got, len(vi) - m, axis=1)[:, len(vi) - m], low)
                cut = np.maximum(cut, least).astype(np.int64)
                a, b = np.nonzero((total >= cut[:, None]) & ~same)
                top = _top(qi[a], vi[b], total[a, b], k)
                a, b = a[top], b[top]
                n = len(qi) + len(a)
                one = [pa.array([batch.column(c)[r].as_py()] * n, t) for c, t in (("_dim", pa.int32()), ("_block", pa.int64()), ("_part", pa.int64()))]
                none = pa.nulls(len(qi), pa.int64())
                told = [np.r_[qi, qi[a]], np.r_[cut, cut[a]]]
                yield pa.RecordBatch.from_arrays([*one, *(pa.array(c.astype(np.int64)) for c in told), pa.concat_arrays([none, pa.array(vi[b].astype(np.int64))]), pa.concat_arrays([none, pa.array(total[a, b].astype(np.int64))])], names=["_dim", "_block", "_part", "_id", "_cut", "_v", "_s"])

    home = written(qs.join(vs.hint("shuffle_hash"), ["_dim", "_block"]).mapInArrow(gather, schema), "topk-gathered")
    cuts = home.where("_v is null").groupBy("_dim", "_block", "_part").agg(F.collect_list(F.struct("_id", "_cut")).alias("_c")).select("_dim", "_block", "_part", F.col("_c._id").alias("c_ids"), F.col("_c._cut").alias("c_cut"))
    # the balls in packs; a part of the queries looks at packs by the balls around them, and through those that it needs
    packed = packs(vs.mapInArrow(ball, "_dim int, _block long, _ball array<double>"), ["_dim"])
    tops = chunks(packed, ["_dim"]).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    known = written(qs.join(cuts, ["_dim", "_block", "_part"]).join(tops.select("_dim", "_of").distinct(), "_dim"), "topk-asked")
    dealt_out = known.withColumn("_salt", F.pmod(F.xxhash64("_block", "_part"), F.lit(SALTS)).cast("int")).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_of") - 1))).drop("_of")

    def reached(q, b, cut):
        """Which balls may hold a vector whose score with a query reaches its cutoff."""
        f = q.astype(float)
        bound = f @ b[:, :-1].T + np.sqrt((f * f).sum(axis=1))[:, None] * b[:, -1][None, :]
        # bounds are sums of doubles: a little more than they could be off
        return bound * (1 + 1e-9 * np.sign(bound)) + 1e-6 >= cut[:, None].astype(float)

    def some_of(batch, r, name, number, which, columns):
        told = [pa.ListArray.from_arrays(pa.array([0, x.size], pa.int32()), pa.array(np.ascontiguousarray(x).ravel())) for x in (c[which] for c in columns)]
        return pa.RecordBatch.from_arrays([batch.column("_dim").slice(r, 1), batch.column("_block").slice(r, 1), pa.array([number]), *told], names=["_dim", "_block", name, "q_ids", "q_x", "q_cut"])

    def look(batches):
        """For each pack, the queries of a part that need it."""
        for batch in batches:
            for r in range(batch.num_rows):
                qi, ci, cut, pi = (batch.column(c)[r].values.to_numpy() for c in ("q_ids", "c_ids", "c_cut", "_packs"))
                order = np.argsort(ci)
                cut = cut[order][np.searchsorted(ci[order], qi)]
                q, b = (batch.column(c)[r].values.to_numpy().reshape(len(i), -1) for c, i in (("q_x", qi), ("_tops", pi)))
                need = reached(q, b, cut)
                for j in np.flatnonzero(need.any(axis=0)):
                    yield some_of(batch, r, "_pack", pi[j], np.flatnonzero(need[:, j]), (qi, q, cut))

    asking = dealt_out.join(tops.drop("_of").hint("shuffle_hash"), ["_dim", "_chunk", "_salt"]).mapInArrow(look, "_dim int, _block long, _pack long, q_ids array<long>, q_x array<long>, q_cut array<long>")
    def needed(batches):
        """For each other ball, the queries whose cutoff its bound reaches."""
        for batch in batches:
            for r in range(batch.num_rows):
                qi, cut, bi = (batch.column(c)[r].values.to_numpy() for c in ("q_ids", "q_cut", "_ids"))
                q, b = (batch.column(c)[r].values.to_numpy().reshape(len(i), -1) for c, i in (("q_x", qi), ("_balls", bi)))
                need = reached(q, b, cut)
                need[:, bi == batch.column("_block")[r].as_py()] = False
                for j in np.flatnonzero(need.any(axis=0)):
                    yield some_of(batch, r, "_other", bi[j], np.flatnonzero(need[:, j]), (qi, q, cut))

    asked = asking.join(packed.drop("_top").hint("shuffle_hash"), ["_dim", "_pack"]).mapInArrow(needed, "_dim int, _block long, _other long, q_ids array<long>, q_x array<long>, q_cut array<long>").drop("_block")

    def collect(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                qi, cut, vi = (batch.column(c)[r].values.to_numpy() for c in ("q_ids", "q_cut", "v_ids"))
                q, v = (batch.column(c)[r].values.to_numpy().reshape(len(i), -1) for c, i in (("q_x", qi), ("v_x", vi)))
                parts = _lists(q, v, lists)
                enough = np.zeros(parts[0].shape, bool)
                for part in parts:
                    enough |= part * len(parts) >= cut[:, None]
                a, b = np.nonzero(enough & (qi[:, None] != vi[None, :]))
                score = sum(part[a, b] for part in parts).astype(np.int64)
                reach = np.flatnonzero(score >= cut[a])
                a, b, score = a[reach], b[reach], score[reach]
                top = _top(qi[a], vi[b], score, k)
                yield _emit(qi[a[top]], vi[b[top]], score[top])

    found = asked.join(vs.withColumnRenamed("_block", "_other").hint("shuffle_hash"), ["_dim", "_other"]).mapInArrow(collect, _GATHERED)
    near = home.where("_v is not null").select(F.col("_id").alias("query_id"), F.col("_v").alias("vec_id"), F.col("_s").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.unionByName(near).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
