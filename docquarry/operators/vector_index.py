"""A persisted index of vectors: balls with centres and radii, written once, extended by what has changed.

The index is a folder of segments (text_index.Segments). The rows of an addition are
dealt to cells of their scope by the signs of their products with fixed directions,
a cell to parts of bounded size by the hash of the id, and a part is halved in its
task until a ball holds BALL rows at most. A segment keeps the balls, whole vectors in folders
by a hash of the ball, and a small table of their bounds: centre, greatest angle from it,
number of rows. Cells only help; that results are exact rests on the bounds.

In a search the nearest balls
that hold k rows give each query a cutoff, and only balls whose bound reaches it are
read. Vectors are compared by cosine, negative ones as zero, as in retrieval.dense.

Upkeep is by digest: a row whose digest is known stays where it is, so a caller who gives
the hash of a text as `digest` needn't embed unchanged texts again (`known`). Rows that
have changed or gone are listed as dead; balls keep their bounds, which stay true.

Defined results: vectors that are null, zero or hold null or non-finite components, and
rows with a null in a column of their scope, are never found; vectors of another length
than the query's aren't compared; of rows that repeat an id the one of the greatest
digest counts; equal scores are ordered by id. Directions without clusters leave most balls
within the cutoff: there a search costs what retrieval.dense costs.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources import versions
from ..sources.staging import small, staged
from .retrieval import _blocks, _meet, comparable, top_k
from .text_index import BUCKETS, Segments, folder_of, kept_current

#: Rows of a ball and of a part at most, rows of a cell about, directions whose signs name cells.
BALL, PART, CELL, SIGNS = 256, 16_384, 65_536, 24
#: Angles and scores closer than that aren't told apart by bounds.
SLACK = 1e-6


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _matrix(column, row: int, n: int) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def _signs(batches):
    """Adds _code: the signs of a vector's products with directions that depend on its length alone."""
    directions: dict[int, np.ndarray] = {}
    for batch in batches:
        codes = np.zeros(batch.num_rows, np.int64)
        sizes = np.asarray(batch.column("_size"))
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            if size not in directions:
                directions[size] = np.random.default_rng(int(size)).standard_normal((size, SIGNS))
            m = batch.column("_v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), size)
            codes[at] = (m @ directions[size] > 0) @ (1 << np.arange(SIGNS))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes)], names=[*batch.schema.names, "_code"])


def _halved(u: np.ndarray, most: int):
    """Row numbers of balls: a set is cut in the middle of the line through two rows far apart, until it is small."""
    open_sets = [np.arange(len(u))]
    while open_sets:
        rows = open_sets.pop()
        if len(rows) <= most:
            yield rows
            continue
        x = u[rows]
        far = x[np.argmin(x @ x[0])]
        order = np.argsort(x @ (far - x[np.argmin(x @ far)]), kind="stable")
        half = len(rows) // 2
        open_sets += [rows[order[half:]], rows[order[:half]]]


def _packed(schema: pa.Schema, most: int):
    def pack(group: pa.Table) -> pa.Table:
        """The balls of a part's rows (_scope, _size, _part, _id, _v)."""
        group = group.sort_by("_id")
        scope, size, part = (group.column(c)[0].as_py() for c in ("_scope", "_size", "_part"))
        ids, vectors = group.column("_id").combine_chunks(), group.column("_v").combine_chunks()
        u = _unit(vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size))
        sets = list(_halved(u, most))
        centres, radii = [], []
        for rows in sets:
            x = u[rows]
            mean = x.mean(axis=0)
            norm = np.linalg.norm(mean)
            centres.append(mean / norm if norm > 1e-9 else x[0])
            radii.append(float(_angle(x @ centres[-1]).max()))
        take, ends = pa.array(np.concatenate(sets)), np.cumsum([0, *map(len, sets)])
        lists = lambda values, at: pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)
        n = len(sets)
        columns = [
            pa.array([f"{scope}|{size}|{part}|{i}" for i in range(n)]), pa.array([scope] * n), pa.array([size] * n, pa.int32()), pa.array(np.diff(ends), pa.int32()),
            lists(pa.array(np.concatenate(centres)), np.arange(n + 1) * size), pa.array(radii), lists(ids.take(take), ends), lists(vectors.take(take).flatten(), ends * size),
        ]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return pack


def _near(k: int, schema: pa.Schema):
    def near(batches):
        """For each query of a block the nearest centres of a pack, until they hold k rows."""
        for batch in batches:
            for r in range(batch.num_rows):
                qi, bi = batch.column("q_ids")[r].values, batch.column("v_ids")[r].values
                bounds = _matrix(batch.column("v_v"), r, len(bi))
                angle = _angle(_unit(_matrix(batch.column("q_v"), r, len(qi))) @ bounds[:, :-2].T)
                order = np.argsort(angle, axis=1, kind="stable")
                held = bounds[:, -1][order]
                a, b = np.nonzero(np.cumsum(held, axis=1) - held < k)
                b = order[a, b]
                yield pa.RecordBatch.from_arrays([qi.take(pa.array(a)), bi.take(pa.array(b)), pa.array(angle[a, b]), pa.array(bounds[b, -1].astype(np.int64))], schema=schema)

    return near


def _reached(schema: pa.Schema):
    def reached(batches):
        """For each ball of a pack the queries of a block whose cutoff its bound reaches, with their vectors and cutoffs."""
        for batch in batches:
            for r in range(batch.num_rows):
                qi, bi = batch.column("q_ids")[r].values, batch.column("v_ids")[r].values
                q, bounds = _matrix(batch.column("q_v"), r, len(qi)), _matrix(batch.column("v_v"), r, len(bi))
                best = np.cos(np.maximum(0.0, _angle(_unit(q[:, :-1]) @ bounds[:, :-2].T) - bounds[:, -2] - SLACK))
                hit = np.maximum(0.0, best) >= q[:, -1:] - SLACK
                for b in np.flatnonzero(hit.any(axis=0)):
                    rows = np.flatnonzero(hit[:, b])
                    yield pa.RecordBatch.from_pylist([{"_ball": bi[int(b)].as_py(), "q_ids": qi.take(pa.array(rows)).to_pylist(), "q_v": q[rows].ravel().tolist()}], schema=schema)

    return reached


def _scored(schema: pa.Schema):
    def scored(batches):
        """The rows of a ball that reach a query's cutoff."""
        for batch in batches:
            for r in range(batch.num_rows):
                qi, vi = batch.column("q_ids")[r].values, batch.column("_ids")[r].values
                q = _matrix(batch.column("q_v"), r, len(qi))
                score = np.maximum(0.0, _unit(q[:, :-1]) @ _unit(_matrix(batch.column("_v"), r, len(vi))).T)
                a, b = np.nonzero(score >= q[:, -1:] - SLACK)
                yield pa.RecordBatch.from_arrays([qi.take(pa.array(a)), vi.take(pa.array(b)), pa.array([batch.column("_segment")[r].as_py()] * len(a), pa.string()), pa.array(score[a, b])], schema=schema)

    return scored


class VectorIndex(Segments):
    """`scope`: columns in which a query and its rows must agree; `element`: the type that components are kept in; `ball`: rows of a ball at most."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", scope: list[str] | None = None, element: str = "double", ball: int = BALL):
        super().__init__(spark, path, id_type)
        self.scope, self.element, self.ball = scope or [], element, ball

    def _scope(self) -> Column:
        """One string for the columns of the scope, null if one of them is."""
        whole = F.to_json(F.struct(*self.scope)) if self.scope else F.lit("")
        return F.when(F.forall(F.array(*(F.col(c).isNotNull() for c in self.scope)), lambda x: x), whole) if self.scope else whole

    def _rows(self, df: DataFrame, key: str, vector: str, element: str, *more: Column) -> DataFrame:
        v = F.col(vector)
        sound = comparable(v) & ~F.exists(v, lambda x: F.abs(x) == float("inf"))
        return df.select(F.col(key).alias("_id"), self._scope().alias("_scope"), F.when(sound, v).cast(f"array<{element}>").alias("_v"), *more).withColumn("_size", F.size("_v"))

    # ---- upkeep

    def known(self, rows: DataFrame, key: str, digest: str) -> DataFrame:
        """The rows whose vector is at hand by their digest; all others are to be embedded and added."""
        return rows.join(self.documents().select(F.col("_id").alias(key), F.col("_digest").alias(digest)), [key, digest], "left_semi")

    def add(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", digest: str | None = None, complete: bool = False, source: str | None = None) -> dict:
        """Index the rows that are new or have another digest; with `complete`, ids that aren't among them are dead. Returns the numbers."""
        version, state = self._state()
        name = f"segment-{version + 1}-{uuid.uuid4().hex[:8]}"
        told = F.col(digest) if digest else F.sha2(F.to_json(F.struct(*self.scope, F.col(vector).cast(f"array<{self.element}>").alias("_v"))), 256)
        rows = self._rows(vectors.where(F.col(key).isNotNull()), key, vector, self.element, F.coalesce(told, F.lit("")).alias("_digest")).withColumn("_id", F.col("_id").cast(self.id_type))
        gone, had = None, bool(state["segments"])
        if had:
            live = self.documents(state).select("_id", F.col("_digest").alias("_had"), "_length", "_segment")
            if complete:
                gone = live.join(rows.select("_id").distinct(), "_id", "left_anti")
            rows = rows.join(live.select("_id", "_had"), "_id", "left").where(~F.col("_had").eqNullSafe(F.col("_digest"))).drop("_had")
        # a row that is no vector is kept in the list of documents, so that its digest is known
        once = staged(rows.groupBy("_id").agg(F.max(F.struct("_digest", "_scope", "_v", "_size")).alias("_m")).select("_id", "_m.*"), "index-vectors")
        once.select("_id", "_digest", F.coalesce("_size", F.lit(0)).alias("_length")).write.parquet(f"{self.path}/{name}/documents")
        added = self.spark.read.parquet(f"{self.path}/{name}/documents")
        n, dead = added.count(), 0
        if n:
            self._write(once, f"{self.path}/{name}")
            state["segments"] = [*state["segments"], name]
        if had:
            old = live.join(added.select("_id"), "_id", "left_semi")
            lost = staged(old.unionByName(gone) if gone is not None else old, "index-dead")
            dead = lost.count()
            if dead:
                lost.select(F.col("_segment").alias("_of"), "_id").write.parquet(f"{self.path}/{name}/dead")
                state["dead"] = [*state["dead"], name]
        state |= {"documents": state["documents"] + n - dead, "source": source}
        versions.commit(self.spark, self.path, version, state)
        return {"added": n, "dead": dead}

    def _write(self, rows: DataFrame, at: str) -> None:
        """Balls and their bounds of rows (_id, _scope, _size, _v); rows without a vector or a scope are left out."""
        sound = rows.where(F.col("_scope").isNotNull() & F.col("_v").isNotNull()).select("_id", "_scope", "_size", "_v")
        coded = staged(sound.mapInArrow(_signs, T.StructType([*sound.schema.fields, T.StructField("_code", T.LongType())])), "vector-codes")
        # as many signs as leave a cell about CELL rows, then as many parts as the cell needs
        sizes = coded.groupBy("_scope", "_size").agg(F.least(F.lit(SIGNS), F.ceil(F.log2(F.greatest(F.lit(1.0), F.count("*") / CELL)))).cast("int").alias("_bits"))
        dealt = coded.join(small(sizes), ["_scope", "_size"]).withColumn("_cell", F.expr("_code & (shiftleft(1L, _bits) - 1)"))
        cells = dealt.groupBy("_scope", "_size", "_cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("_of"))
        parts = dealt.join(small(cells), ["_scope", "_size", "_cell"]).withColumn("_part", F.concat_ws(".", "_cell", F.pmod(F.xxhash64("_id"), "_of"))).select("_scope", "_size", "_part", "_id", "_v")
        schema = T._parse_datatype_string(f"_ball string, _scope string, _size int, _n int, _centre array<double>, _radius double, _ids array<{self.id_type}>, _v array<{self.element}>")
        balls = parts.groupBy("_scope", "_size", "_part").applyInArrow(_packed(to_arrow_schema(schema), self.ball), schema)
        balls = balls.withColumn("_bucket", F.pmod(F.xxhash64("_ball"), F.lit(BUCKETS)).cast("int"))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        balls.repartition(n, "_bucket", F.pmod(F.hash("_ball"), F.lit(max(1, n // BUCKETS)))).sortWithinPartitions("_bucket", "_ball").write.partitionBy("_bucket").parquet(f"{at}/balls")
        self.spark.read.schema(f"_ball string, {self._BOUNDS}").parquet(f"{at}/balls").write.parquet(f"{at}/bounds")

    _BOUNDS = "_scope string, _size int, _n int, _centre array<double>, _radius double"

    def _balls(self, state: dict) -> DataFrame:
        return self._read("balls", state["segments"], f"_ball string, _scope string, _size int, _ids array<{self.id_type}>, _v array<{self.element}>, _bucket int")

    def compact(self) -> None:
        """One segment of the live rows; `clean` deletes the old ones."""
        version, state = self._state()
        if not state["segments"]:
            return
        name = f"segment-{version + 1}-{uuid.uuid4().hex[:8]}"
        live = self.documents(state)
        live.select("_id", "_digest", "_length").write.parquet(f"{self.path}/{name}/documents")
        each = self._balls(state).select("_segment", "_scope", "_size", F.posexplode("_ids").alias("_at", "_id"), "_v")
        rows = each.select("_segment", "_scope", "_size", "_id", F.slice("_v", F.col("_at") * F.col("_size") + 1, F.col("_size")).alias("_v"))
        self._write(rows.join(live.select("_segment", "_id"), ["_segment", "_id"], "left_semi"), f"{self.path}/{name}")
        versions.commit(self.spark, self.path, version, state | {"segments": [name], "dead": []})

    # ---- search

    def _places(self, met: DataFrame, state: dict, most: int = 1_000) -> DataFrame:
        """Rows (_segment, _ball, q_ids, q_v) with the vectors of their balls; of few balls only their folders and row groups are read."""
        balls = self._balls(state)
        few = met.select("_ball").distinct().limit(most + 1).collect()
        if len(few) <= most:
            told = [r[0] for r in few]
            buckets = [r[0] for r in met.select(F.pmod(F.xxhash64("_ball"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
            balls = balls.where(F.col("_bucket").isin(buckets) & F.col("_ball").isin(told))
        return met.join(balls.select("_segment", "_ball", "_ids", "_v"), ["_segment", "_ball"])

    def _exact(self, met: DataFrame, state: dict, kind: T.DataType) -> DataFrame:
        """(_query, _id, _score) of the live rows in the balls that reach a cutoff."""
        id_type = T._parse_datatype_string(self.id_type)
        schema = T.StructType([T.StructField("_query", kind), T.StructField("_id", id_type), T.StructField("_segment", T.StringType()), T.StructField("_score", T.DoubleType())])
        found = self._places(met, state).mapInArrow(_scored(to_arrow_schema(schema)), schema)
        if state["dead"]:
            found = found.join(self._dead(state), ["_segment", "_id"], "left_anti")
        return found.select("_query", "_id", F.round("_score", 9).alias("_score"))

    def reached(self, queries: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
        """(_segment, _ball, q_ids, q_v): the balls that may hold one of a query's k best, each with blocks of such queries.

        q_v holds for each query its components and its cutoff.
        """
        _, state = self._state()
        asked = self._rows(queries, query_id, query_vector, "double").where("_scope is not null and _v is not null")
        asked = staged(asked, "asked-vectors")
        kind = queries.schema[query_id].dataType
        own = ["_scope", "_size"]
        bounds = self._read("bounds", state["segments"], f"_ball string, {self._BOUNDS}")
        packs = bounds.select(*own, F.concat_ws("/", "_segment", "_ball").alias("_id"), F.concat("_centre", F.array("_radius", F.col("_n").cast("double"))).alias("_v"))
        # packs of balls of the asked scopes only
        packs = staged(_blocks(packs.join(small(asked.select(*own).distinct()), own, "left_semi"), own, 1024, "v").drop("_dim"), "ball-packs")
        schema = T.StructType([T.StructField("_query", kind), T.StructField("_place", T.StringType()), T.StructField("_angle", T.DoubleType()), T.StructField("_n", T.LongType())])
        blocks = _blocks(asked, own, 1024, "q").drop("_dim")
        near = _meet(staged(blocks, "query-blocks"), packs, own).mapInArrow(_near(k, to_arrow_schema(schema)), schema)
        before = F.sum("_n").over(Window.partitionBy("_query").orderBy("_angle", "_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
        first = staged(near.withColumn("_before", before).where(F.col("_before") < k).select("_query", "_place"), "nearest-balls")
        # exact scores there: the k-th best is a cutoff that no result can be below; without k of them there is none
        parts = F.pmod(F.xxhash64("_query"), F.lit(max(1, -(-asked.count() // 1024))))
        joined = first.join(asked.select(F.col("_id").alias("_query"), F.concat("_v", F.array(F.lit(-1.0))).alias("_q")), "_query")
        dealt = joined.groupBy("_place", parts.alias("_deal")).agg(F.collect_list(F.struct("_query", "_q")).alias("_r")).select(*_split("_place"), F.col("_r._query").alias("q_ids"), F.flatten("_r._q").alias("q_v"))
        top = top_k(self._exact(staged(dealt, "first-balls"), state, kind), k, [F.desc("_score"), F.asc("_id")], ["_query"])
        cuts = top.groupBy("_query").agg(F.when(F.count("*") >= k, F.min("_score")).alias("_cut"))
        cut = asked.join(cuts.withColumnRenamed("_query", "_id"), "_id", "left").select(*own, "_id", F.concat("_v", F.array(F.coalesce("_cut", F.lit(-1.0)))).alias("_v"))
        schema = T.StructType([T.StructField("_ball", T.StringType()), T.StructField("q_ids", T.ArrayType(kind)), T.StructField("q_v", T.ArrayType(T.DoubleType()))])
        met = _meet(staged(_blocks(cut, own, 1024, "q").drop("_dim"), "cutoff-blocks"), packs, own).mapInArrow(_reached(to_arrow_schema(schema)), schema)
        return staged(met.select(*_split("_ball"), "q_ids", "q_v"), "reached-balls")

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "query_vector", target: str = "vec_id") -> DataFrame:
        """(query_id, target, dense) of each query's k nearest rows of its scope; query ids are distinct."""
        _, state = self._state()
        if not state["segments"]:
            return queries.select(query_id, F.lit(None).cast(self.id_type).alias(target), F.lit(0.0).alias("dense")).where("false")
        found = self._exact(self.reached(queries, k, query_id, query_vector), state, queries.schema[query_id].dataType)
        return top_k(found.select(F.col("_query").alias(query_id), F.col("_id").alias(target), F.col("_score").alias("dense")), k, [F.desc("dense"), F.asc(target)], [query_id])


def _split(place: str) -> list[Column]:
    """A place is the segment's name, which has no slash, and the ball's."""
    p = F.col(place)
    return [F.substring_index(p, "/", 1).alias("_segment"), F.expr(f"substring({place}, locate('/', {place}) + 1)").alias("_ball")]


def of_files(vectors: DataFrame, name: str, key: str = "vec_id", vector: str = "embedding", scope: list[str] | None = None) -> VectorIndex:
    """The index of a table of files in the shared folder, as text_index.of_files."""
    id_type, element = vectors.schema[key].dataType.simpleString(), vectors.schema[vector].dataType.elementType.simpleString()
    index = VectorIndex(vectors.sparkSession, folder_of(vectors, name), id_type, scope, element)
    return kept_current(index, vectors, lambda rows, source: index.add(rows, key, vector, complete=True, source=source))
