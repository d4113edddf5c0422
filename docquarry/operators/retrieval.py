"""Hybrid retrieval over a table of queries: resolve, dense, sparse, fuse, rerank, diversify, expand, judge."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X
from ..functions import vectors as V
from ..sources.staging import small, small_batches, staged


def top_k(df: DataFrame, k: int, by: list[Column], within: list[str] | None = None) -> DataFrame:
    """The first k rows, of each group of `within` if given; the order must be total."""
    if not within:
        return df.orderBy(*by).limit(k)
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*within).orderBy(*by))).where(F.col("_rank") <= k).drop("_rank")


def tail(rows: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """(keys, kept, dropped): the last values of each group in order, and how many went before them."""
    own = Window.partitionBy(*keys)
    last = rows.withColumns({"_n": F.row_number().over(own.orderBy(F.desc(order)))})
    held = last.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("_n") <= most, F.col(order)))).alias("kept"), F.count("*").alias("_c"))
    return held.select(*keys, "kept", F.greatest(F.lit(0), F.col("_c") - most).cast("long").alias("dropped"))


def filtered(df: DataFrame, **allowed) -> DataFrame:
    """Rows whose columns have one of the given values; None means no limit. Stays a pushed-down filter."""
    for column, values in allowed.items():
        if values is not None:
            df = df.where(F.col(column).isin(*values))
    return df


#: Terms of a larger share of documents are common: only documents that may still be among the best are scored by them.
COMMON = 0.3


def bm25(queries: DataFrame, docs: DataFrame, query_id: str = "query_id", query: str = "query", doc_id: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75, best: int | None = None) -> DataFrame:
    """(query_id, doc_id, bm25) of the documents with a term in common; statistics are those of `docs`.

    Documents are tokenised once: what is written is each document's length and its counts of the terms that some
    query asks for, and all statistics come from there. With `best`, only rows that may be among so many best of a
    query come out: the scores by its rarer terms give a cutoff, and a document whose score by these can't reach it
    with all common terms at their greatest is never met with them. Queries of common terms only are scored in full.
    """
    asked = queries.select(query_id, F.explode(F.array_distinct(X.search_tokens(query))).alias("term"))
    terms = asked.select("term").distinct()
    words = docs.select(doc_id, X.search_tokens(text).alias("_tokens"))
    # a document's length rides along as the count of a term that no text has
    each = words.select(doc_id, F.size("_tokens").alias("_length"), F.explode(F.concat(F.array(F.lit("")), "_tokens")).alias("term"))
    held = each.join(terms.unionByName(docs.sparkSession.range(1).select(F.lit("").alias("term"))), "term", "left_semi")
    counted = staged(held.groupBy(doc_id, "term").agg(F.count("*").alias("_tf"), F.first("_length").alias("_length")), "term-counts")
    sizes, tf = counted.where("term = ''"), counted.where("term <> ''")
    stats = sizes.agg(F.count("*").alias("_n"), F.when(F.avg("_length") > 0, F.avg("_length")).otherwise(1.0).alias("_mean"))
    df = tf.groupBy("term").agg(F.count("*").alias("_df"))
    idf = F.log(1.0 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    # stats is an aggregate of one row
    weights = asked.join(df.join(F.broadcast(stats), F.lit(True)).withColumn("_idf", idf), "term")
    part = F.col("_idf") * F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_length") / F.col("_mean")))
    scored = lambda by: tf.join(by, "term").groupBy(query_id, doc_id).agg(F.sum(part).alias("bm25"))
    if best is None:
        return scored(weights)
    weights = staged(weights, "term-weights")
    common = F.col("_df") > F.col("_n") * COMMON
    rarer = staged(scored(weights.where(~common)), "rarer-scores")
    kth = top_k(rarer, best, [F.desc("bm25"), F.asc(doc_id)], [query_id]).groupBy(query_id).agg(F.min("bm25").alias("_cut"), F.count("*").alias("_c")).where(F.col("_c") == best).select(query_id, "_cut")
    more = weights.where(common).groupBy(query_id).agg(F.sum(F.col("_idf") * (k1 + 1)).alias("_more"))
    limits = staged(weights.select(query_id).distinct().join(kth, query_id, "left").join(more, query_id, "left").withColumn("_more", F.coalesce("_more", F.lit(0.0))), "score-limits")
    closed = F.coalesce(F.col("_more") < F.col("_cut"), F.lit(False))
    near = rarer.join(limits.where(closed), query_id).where(F.col("bm25") + F.col("_more") >= F.col("_cut") - 1e-6).select(query_id, doc_id, "bm25")
    wanted = near.select(query_id, doc_id).join(weights.where(common), query_id).join(tf, [doc_id, "term"])
    added = near.unionByName(wanted.groupBy(query_id, doc_id).agg(F.sum(part).alias("bm25"))).groupBy(query_id, doc_id).agg(F.sum("bm25").alias("bm25"))
    return added.unionByName(scored(weights.join(limits.where(~closed).select(query_id), query_id)))


#: Blocks of a thousand queries each that are broadcast; beyond, groups of vector blocks that a query block meets apart.
BROADCAST_BLOCKS, SALTS = 16, 32


def comparable(vector: Column | str) -> Column:
    """Neither null nor zero, and without null or NaN components."""
    return F.coalesce(F.exists(vector, lambda x: x != 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x)), F.lit(False))


def _blocks(rows: DataFrame, scope: list[str], size: int, name: str) -> DataFrame:
    """Rows (_id, _v, scope) packed by hash into blocks of about `size` rows; a block's vectors lie end to end."""
    counts = rows.groupBy(*scope, F.size("_v").alias("_dim")).agg(F.ceil(F.count("*") / size).cast("int").alias(f"{name}_of"))
    keyed = rows.withColumn("_dim", F.size("_v")).join(counts, [*scope, "_dim"]).withColumn(f"{name}_n", F.pmod(F.xxhash64("_id"), f"{name}_of").cast("int"))
    packed = keyed.groupBy(*scope, "_dim", f"{name}_n").agg(F.first(f"{name}_of").alias(f"{name}_of"), F.collect_list(F.struct("_id", "_v")).alias("_r"))
    return packed.select(*scope, "_dim", f"{name}_n", f"{name}_of", F.col("_r._id").alias(f"{name}_ids"), F.flatten("_r._v").alias(f"{name}_v"))


def _meet(q: DataFrame, v: DataFrame, keys: list[str]) -> DataFrame:
    """Every block of queries with every block of the same keys."""
    if q.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS:
        return v.join(F.broadcast(q.drop("q_of", "q_n")), keys)
    # a block of queries goes to each salt, and a block of vectors to its own: few query blocks are no few tasks
    parts = q.groupBy(*keys).agg(F.first("q_of").alias("_of"))
    dealt = v.join(parts, keys).withColumn("q_n", F.explode(F.sequence(F.lit(0), F.col("_of") - 1))).withColumn("_salt", F.pmod("v_n", F.lit(SALTS)).cast("int"))
    return dealt.join(q.drop("q_of").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "q_n", "_salt"])


def dense(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "query_vector", target: str = "vec_id", vector: str = "embedding", scope: list[str] | None = None, block: int = 4096) -> DataFrame:
    """(query_id, target, dense) of each query's k nearest; `scope`: columns in which both sides must agree.

    Blocks of queries meet blocks of vectors as matrices; a pair of blocks returns
    k rows a query, so neither the pairs nor an unbounded group are ever made.
    Vectors that are null, zero or of another length than the query's aren't compared.
    """
    scope = scope or []
    small_batches(queries.sparkSession)
    pick = lambda df, i, v: df.where(comparable(v)).select(*scope, F.col(i).alias("_id"), F.col(v).cast("array<double>").alias("_v"))
    q, v = _blocks(pick(queries, query_id, query_vector), scope, 1024, "q"), _blocks(pick(vectors, target, vector), scope, block, "v")
    met = _meet(staged(q, "query-blocks"), v, [*scope, "_dim"])
    q_type, v_type = (df.schema[c].dataType for df, c in ((queries, query_id), (vectors, target)))
    schema = T.StructType([T.StructField(query_id, q_type), T.StructField(target, v_type), T.StructField("dense", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def multiply(batches):
        unit = lambda column, r, n: (lambda m: m / np.sqrt((m * m).sum(axis=1, keepdims=True)))(column[r].values.to_numpy(zero_copy_only=False).reshape(n, -1))
        for batch in batches:
            for r in range(batch.num_rows):
                qi, vi = batch.column("q_ids")[r].values, batch.column("v_ids")[r].values
                score = np.maximum(0.0, unit(batch.column("q_v"), r, len(qi)) @ unit(batch.column("v_v"), r, len(vi)).T)
                # ties at the k-th score stay in, so the final order may break them by id
                least = np.partition(score, len(vi) - k, axis=1)[:, len(vi) - k, None] if len(vi) > k else np.full((len(qi), 1), -1.0)
                a, b = np.nonzero(score >= least - 1e-9)
                yield pa.RecordBatch.from_arrays([qi.take(pa.array(a)), vi.take(pa.array(b)), pa.array(score[a, b])], schema=arrow)

    # products of doubles differ in their last digits with the shape of a block: scores are told apart by nine digits
    return top_k(met.mapInArrow(multiply, schema).withColumn("dense", F.round("dense", 9)), k, [F.desc("dense"), F.asc(target)], [query_id])


def resolve_papers(queries: DataFrame, papers: DataFrame, k: int = 5, scope: str | None = None) -> DataFrame:
    """(query_id, paper_id, score): exact name 1.0, acronym contained .98, name contained .92, explicit scope 1.0.

    `papers`: paper_id, names array, acronym; `scope`: a column of `queries` with an array of paper ids. A name counts
    wherever it stands in the question, inside a word too. Questions are short and names repeat, so both meet on
    strings: a question gives its substrings of the lengths that names have, and a name itself.
    """
    q = X.collapse(F.lower("query"))
    ask = queries.select("query_id", q.alias("_q"))
    spelled = lambda c, acronym: F.struct(X.collapse(F.lower(c)).alias("n"), F.lit(acronym).alias("a"))
    both = F.concat(F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: spelled(n, False)), F.array(spelled(F.col("acronym"), True)))
    known = papers.select("paper_id", F.explode(both).alias("_k")).select("paper_id", F.col("_k.n").alias("_name"), F.col("_k.a").alias("_acronym")).where("_name <> ''")
    # at most as many lengths as the longest question has characters
    lengths = known.select(F.length("_name").alias("_size")).distinct().join(ask.agg(F.max(F.length("_q")).alias("_most")).hint("broadcast"), F.col("_size") <= F.col("_most")).agg(F.collect_set("_size").alias("_sizes"))
    windows = ask.join(F.broadcast(lengths), F.lit(True)).withColumn("_size", F.explode(F.filter("_sizes", lambda n: n <= F.length("_q"))))
    names = F.transform(F.sequence(F.lit(1), F.length("_q") - F.col("_size") + 1), lambda i: F.substring("_q", i, F.col("_size")))
    parts = windows.select("query_id", "_q", F.explode(F.array_distinct(names)).alias("_name"))
    score = F.when(F.col("_name") == F.col("_q"), 1.0).when(F.col("_acronym"), 0.98).otherwise(0.92)
    found = parts.join(known, "_name").select("query_id", "paper_id", score.alias("score"))
    if scope:
        found = found.unionByName(queries.select("query_id", F.explode(scope).alias("paper_id"), F.lit(1.0).alias("score")))
    return top_k(found.groupBy("query_id", "paper_id").agg(F.max("score").alias("score")), k, [F.desc("score"), F.asc("paper_id")], ["query_id"])


def narrowed(rows: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """(query_id, row) for the rows that stand below a query's chosen parents."""
    return chosen.select("query_id", *keys).distinct().join(rows, keys)


def resolved_or_near(queries: DataFrame, papers: DataFrame, vectors: DataFrame, k: int = 5, scope: str | None = None) -> DataFrame:
    """(query_id, paper_id, score): papers by name, and by nearness for the queries that name none. `vectors`: paper_id, embedding."""
    named = staged(resolve_papers(queries, papers, k, scope), "resolved")
    rest = queries.join(named.select("query_id").distinct(), "query_id", "left_anti")
    return named.unionByName(dense(rest, vectors, k, target="paper_id").withColumnRenamed("dense", "score"))


def search_narrowed(queries: DataFrame, papers: DataFrame, paper_vectors: DataFrame, section_vectors: DataFrame, chunks: DataFrame, chunk_vectors: DataFrame, sizes: tuple[int, int, int] = (5, 8, 30), limit: int = 8, least: float = 0.22, scope: str | None = None, diverse: bool = True) -> DataFrame:
    """Evidence by papers (named, else near), then their nearest sections, then dense and sparse chunks in those.

    `section_vectors`: section_id, paper_id, embedding; `chunks`: chunk_id, section_id, paper_id, text; `chunk_vectors`:
    chunk_id, embedding. Each level looks below the last one's choice only, so its pairs are few.
    """
    near = staged(resolved_or_near(queries, papers, paper_vectors, sizes[0], scope), "papers")
    asked = queries.select("query_id", "query", "query_vector")
    closest = lambda rows, keys, k, target: top_k(
        narrowed(rows, keys[0], keys[1]).join(asked.select("query_id", "query_vector"), "query_id").withColumn("dense", F.round(V.dense_score("query_vector", "embedding"), 9)).where("dense is not null"),
        k, [F.desc("dense"), F.asc(target)], ["query_id"],
    )
    sections = staged(closest(section_vectors, (near, ["paper_id"]), sizes[1], "section_id").select("query_id", "section_id"), "sections")
    dense_rows = closest(chunks.select("chunk_id", "section_id").join(chunk_vectors, "chunk_id"), (sections, ["section_id"]), sizes[2], "chunk_id").select("query_id", "chunk_id", "dense")
    sparse_rows = bm25_within(asked, sections, chunks).withColumn("_r", F.round("bm25", 9)).where("_r > 0")
    sparse_rows = top_k(sparse_rows, sizes[2], [F.desc("_r"), F.asc("chunk_id")], ["query_id"]).drop("_r")
    return _judged_evidence(asked, chunks, fuse(dense_rows, sparse_rows, ["query_id", "chunk_id"]), limit, least, diverse)


def bm25_within(queries: DataFrame, chosen: DataFrame, chunks: DataFrame, group: str = "section_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, chunk_id, bm25) where each query has groups of chunks of its own (`chosen`: query_id, group); counts and lengths are those of its chunks.

    A chunk is split into tokens once, however many queries chose its group.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(X.search_tokens("query"))).alias("term")).join(chosen, "query_id")
    words = staged(chunks.join(chosen.select(group).distinct(), group, "left_semi").select("chunk_id", group, X.search_tokens("text").alias("_tokens")), "candidate-tokens")
    sizes = words.groupBy(group).agg(F.count("*").alias("_c"), F.sum(F.size("_tokens")).alias("_t"))
    mean = F.sum("_t") / F.sum("_c")
    stats = chosen.join(sizes, group).groupBy("query_id").agg(F.sum("_c").alias("_n"), F.when(mean > 0, mean).otherwise(1.0).alias("_mean"))
    each = words.select("chunk_id", group, F.size("_tokens").alias("_length"), F.explode("_tokens").alias("term")).join(asked.select(group, "term").distinct(), [group, "term"], "left_semi")
    tf = staged(each.groupBy("chunk_id", group, "term").agg(F.count("*").alias("_tf"), F.first("_length").alias("_length")), "candidate-terms")
    df = tf.groupBy(group, "term").agg(F.count("*").alias("_df")).join(asked, [group, "term"]).groupBy("query_id", "term").agg(F.sum("_df").alias("_df"))
    scored = tf.join(asked, [group, "term"]).join(df, ["query_id", "term"]).join(stats, "query_id")
    idf = F.log(1.0 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    part = idf * F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_length") / F.col("_mean")))
    return scored.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("bm25"))


def full_text(queries: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, doc) of the documents that hold some word of the query; a query without words finds nothing."""
    words = lambda c: F.filter(F.array_distinct(X.search_tokens(c)), lambda w: w.rlike(r"(?U)^\w+$"))
    asked = queries.select("query_id", F.explode(words("query")).alias("term"))
    terms = asked.select("term").distinct()
    held = docs.select(doc_id, F.explode(words(text)).alias("term")).join(terms, "term", "left_semi")
    return held.join(asked, "term").select("query_id", doc_id).distinct()


def fuse(dense_rows: DataFrame, sparse_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of the two lists; each keeps its score."""
    return dense_rows.join(sparse_rows, keys, "full_outer")


def rerank(candidates: DataFrame, query: str = "query", text: str = "text", query_tokens: str | None = None, text_tokens: str | None = None, scorer=V.hybrid_score) -> DataFrame:
    """`scorer`: a Column function of query, text, dense and sparse score, and both sides' tokens; the port for other rankers."""
    return candidates.withColumn("relevance", scorer(query, text, "dense", "bm25", query_tokens, text_tokens))


def select_diverse(candidates: DataFrame, limit: int, similarity: float = 0.85, query_id: str = "query_id", paper_id: str = "paper_id", chunk_id: str = "chunk_id") -> DataFrame:
    """Greedy by (relevance, bm25): at most max(2, ceil(limit / papers)) of a paper, none like one that was taken.

    A query's candidates are a bounded list (the sizes of the dense and sparse lists).
    """
    have = "_tokens" in candidates.columns
    schema = candidates.drop("_tokens").schema

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_b=pdf["bm25"].fillna(0.0)).sort_values(["relevance", "_b", chunk_id], ascending=[False, False, True]).drop(columns="_b")
        most = max(2, math.ceil(limit / max(1, pdf[paper_id].nunique())))
        taken, sets, per = [], [], {}
        for i, row in pdf.iterrows():
            words = set(row["_tokens"])
            if per.get(row[paper_id], 0) >= most or any(not (words | o) or len(words & o) / len(words | o) >= similarity for o in sets):
                continue
            taken.append(i)
            sets.append(words)
            per[row[paper_id]] = per.get(row[paper_id], 0) + 1
            if len(taken) >= limit:
                break
        return pdf.loc[taken].drop(columns="_tokens")

    tokens = F.col("_tokens") if have else X.search_tokens("text")
    return candidates.withColumn("_tokens", F.array_distinct(tokens)).groupBy(query_id).applyInPandas(choose, schema)


def neighbors(seeds: DataFrame, chunks: DataFrame, radius: int = 1, group: list[str] | None = None, order: str = "chunk_order", decay: float = 0.8) -> DataFrame:
    """Chunks within `radius` of a seed in its group: the seed's own relevance, others that of the first seed, less `decay`.

    `seeds`: query_id, chunk_id, relevance, seed_rank and the group's columns.
    """
    group = group or ["version_id", "section_id"]
    # each seed reaches 2 * radius + 1 positions: an equi-join instead of a range join
    reach = seeds.withColumn("_at", F.explode(F.sequence(F.col(order) - radius, F.col(order) + radius))).select("query_id", *group, F.col("_at").alias(order), F.col("relevance").alias("_r"), "seed_rank", F.col(order).alias("_seed"))
    found = chunks.join(reach, [*group, order])
    own = Window.partitionBy("query_id", "chunk_id").orderBy(F.when(F.col("_seed") == F.col(order), 0).otherwise(1), "seed_rank")
    ranked = found.withColumn("_n", F.row_number().over(own)).where("_n = 1")
    return ranked.withColumn("relevance", F.when(F.col("_seed") == F.col(order), F.col("_r")).otherwise(F.col("_r") * decay)).drop("_n", "_r", "_seed", "seed_rank")


def evidence_id(query: str = "query", chunk_id: str = "chunk_id") -> Column:
    return F.sha2(F.concat_ws(":", F.lit("evidence"), F.sha2(F.trim(F.lower(F.col(query))), 256), F.col(chunk_id).cast("string")), 256)


def search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, limit: int = 8, k: int = 30, least: float = 0.22, diverse: bool = True, scorer=V.hybrid_score, index=None) -> DataFrame:
    """Evidence rows of each query; a query without any gets one row of status no_evidence.

    `queries`: query_id, query, query_vector; `chunks`: chunk_id, paper_id, text; `vectors`: chunk_id, embedding;
    `scorer`: as for rerank; `index`: a TextIndex of the chunks, else they are tokenised here.
    """
    near = dense(queries, vectors, k, target="chunk_id")
    sparse = index.bm25(queries, best=k, doc_id="chunk_id") if index is not None else bm25(queries, chunks, doc_id="chunk_id", best=k)
    words = top_k(sparse.withColumn("_r", F.round("bm25", 9)).where("_r > 0"), k, [F.desc("_r"), F.asc("chunk_id")], ["query_id"]).drop("_r")
    return _judged_evidence(queries, chunks, fuse(near, words, ["query_id", "chunk_id"]), limit, least, diverse, scorer)


def _judged_evidence(queries: DataFrame, chunks: DataFrame, candidates: DataFrame, limit: int, least: float, diverse: bool, scorer=V.hybrid_score) -> DataFrame:
    """Evidence rows of the fused candidates (query_id, chunk_id, dense, bm25), or a row that tells there is none."""
    few = staged(candidates, "candidates")
    # each candidate's text and each query is tokenised once, before they meet
    wanted = few.select("chunk_id").distinct()
    split = staged(chunks.join(small(wanted, 100_000), "chunk_id", "left_semi").select("chunk_id", "paper_id", F.lower("text").alias("text"), F.array_distinct(X.search_tokens("text")).alias("_tokens")), "candidate-texts")
    asked = queries.select("query_id", "query", F.array_distinct(X.search_tokens("query")).alias("_query_tokens"))
    both = few.join(split, "chunk_id").join(asked, "query_id")
    # sums of doubles differ in their last digits with the order of rows: scores are told apart by nine digits
    ranked = rerank(both, query_tokens="_query_tokens", text_tokens="_tokens", scorer=scorer).withColumn("relevance", F.round("relevance", 9)).where(F.col("relevance") >= least).drop("_query_tokens")
    chosen = select_diverse(ranked.drop("text").withColumn("text", F.lit("")), limit) if diverse else top_k(ranked.drop("_tokens"), limit, [F.desc("relevance"), F.asc("chunk_id")], ["query_id"])
    found = chosen.select("query_id", "chunk_id", "paper_id", "dense", "bm25", "relevance", evidence_id().alias("evidence_id"))
    return (
        queries.select("query_id").join(found, "query_id", "left")
        .withColumn("status", F.when(F.col("chunk_id").isNull(), "no_evidence").otherwise("ok"))
        .withColumn("reason", F.when(F.col("chunk_id").isNull(), "No candidate reached the least relevance."))
    )


def search_rewritten(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, embed, limit: int = 8, most: int = 4, radius: int = 1, judge_at: float = 0.2, rewriter=X.rewrites, judge=V.judged, scorer=V.hybrid_score, diverse: bool = True, index=None) -> DataFrame:
    """All rewrites in one job, each chunk by its best, neighbours added, judged against the question as asked.

    `embed`: a Column function for query vectors; `chunks` also has version_id, section_id, chunk_order. `rewriter`
    (query, most) gives an array of questions, `judge` (query, text, relevance) a score; the ports for others. `diverse`
    and `index` as for search. A question without rewrites or evidence has no rows.
    """
    asked = queries.select("query_id", "query", F.posexplode(rewriter("query", most)).alias("_n", "_rewrite"))
    each = asked.select(F.struct("query_id", "_n").alias("query_id"), F.col("_rewrite").alias("query")).withColumn("query_vector", embed("query"))
    each = staged(each, "rewritten")
    found = staged(search(each, chunks.select("chunk_id", "paper_id", "text"), vectors, limit, diverse=diverse, scorer=scorer, index=index).where("status = 'ok'"), "rewritten-evidence")
    best = Window.partitionBy("query_id", "chunk_id").orderBy(F.desc("relevance"), "_n")
    seeds = found.select("query_id.query_id", "query_id._n", "chunk_id", "relevance").withColumn("_k", F.row_number().over(best)).where("_k = 1")
    seeds = seeds.withColumn("seed_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_n", F.desc("relevance"), "chunk_id")))
    seeds = seeds.join(chunks.select("chunk_id", "version_id", "section_id", "chunk_order"), "chunk_id").drop("chunk_id", "_n", "_k")
    wide = neighbors(seeds, chunks, radius).join(queries.select("query_id", "query"), "query_id")
    scored = wide.withColumn("relevance", F.round(judge("query", "text", "relevance"), 9)).where(F.col("relevance") >= judge_at)
    return top_k(scored, limit, [F.desc("relevance"), F.asc("chunk_id")], ["query_id"])


def round_robin(rows: DataFrame, per_paper: int, limit: int | None = None, budget: int | None = None, query_id: str = "query_id", paper_id: str = "paper_id", chunk_id: str = "chunk_id", tokens: str = "token_count") -> DataFrame:
    """Up to `per_paper` of each paper, papers in turn, by relevance; then a count or a token budget (what doesn't fit is skipped)."""
    rows = rows.withColumn("_copy", F.row_number().over(Window.partitionBy(query_id, chunk_id).orderBy(F.desc("relevance")))).where("_copy = 1").drop("_copy")
    by = [F.desc("relevance"), F.asc(chunk_id)]
    ranked = rows.withColumn("_turn", F.row_number().over(Window.partitionBy(query_id, paper_id).orderBy(*by))).where(F.col("_turn") <= per_paper)
    ranked = ranked.withColumn("_first", F.max("relevance").over(Window.partitionBy(query_id, paper_id)))
    ordered = ranked.withColumn("position", F.row_number().over(Window.partitionBy(query_id).orderBy("_turn", F.desc("_first"), paper_id))).drop("_turn", "_first")
    if limit is not None:
        ordered = ordered.where(F.col("position") <= limit)
    if budget is None:
        return ordered
    kind = ordered.schema[query_id].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, used, kept = pdf.sort_values("position"), 0, []
        for p, t in zip(pdf["position"], pdf["t"], strict=True):
            if used + t <= budget:
                used += t
                kept.append(p)
        return pd.DataFrame({query_id: pdf[query_id].iloc[: len(kept)].to_numpy(), "position": kept})

    # at most `per_paper` of each paper, by position and size only
    fits = ordered.select(query_id, "position", F.col(tokens).cast("long").alias("t")).groupBy(query_id).applyInPandas(fit, f"{query_id} {kind}, position int")
    return ordered.join(fits, [query_id, "position"])
