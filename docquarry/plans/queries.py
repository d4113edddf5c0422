"""Queries of the library's own operators over the driver's tables, and their SQL.

Every query runs over its whole tables. A query without SQL is one that SQL can't
express exactly (ordered folds, hashed vectors); tests hold it against plain Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import counts as K
from ..operators import curation as C
from ..operators import graph as G
from ..operators import incremental as I
from ..operators import retrieval as R
from ..operators import structure as S
from ..operators import text_index as N
from ..operators import vector_index as VI
from ..operators import workflow as W
from ..sources.staging import small, small_batches, spread, staged
from ..sources.tables import canonical_json, manifest, put_blobs, table
from ..streaming import events as E

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The chunk token pattern in RE2's dialect.
_TOKENS = r"regexp_extract_all({0}, '[\x{{3400}}-\x{{9fff}}]|[A-Za-z0-9_]+|[^\s]')"


def _tokens(x: str) -> str:
    return _TOKENS.format(x)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- retrieval


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_BM25 = f"""
WITH asked AS (SELECT DISTINCT item_id AS query_id, unnest({_tokens("lower(text)")}) AS term FROM benchmark),
words AS (SELECT doc_id, {_tokens("lower(text)")} AS t FROM documents),
sizes AS (SELECT doc_id, len(t) AS n FROM words),
stats AS (SELECT count(*) AS total, avg(n) AS mean FROM sizes),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM words) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (
  SELECT a.query_id, tf.doc_id, sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS bm25
  FROM asked a JOIN tf USING (term) JOIN df USING (term) JOIN sizes USING (doc_id), stats GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, doc_id) AS r FROM scored)
"""


@query(_BM25 + "SELECT query_id, doc_id, round(bm25, 6) AS bm25 FROM ranked WHERE r <= 10")
def bm25_top10(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: the ten best documents of every benchmark item."""
    scored = N.of_files(table(spark, d, "documents"), "documents-index").bm25(_asked(spark, d), best=10).withColumn("bm25", F.round("bm25", 6))
    return R.top_k(scored, 10, [F.desc("bm25"), F.asc("doc_id")], ["query_id"])


@query(
    """
WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, round(greatest(0, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))), 9) AS dense
  FROM embeddings q JOIN embeddings e ON e.label = q.label WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, vec_id) AS r FROM p)
SELECT query_id, vec_id, round(dense, 6) AS dense FROM r WHERE r <= 30"""
)
def dense_top30(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors inside the scope of a label, for every vector whose id is divisible by 100."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "label")
    return R.dense(q, e, 30, scope=["label"]).select("query_id", "vec_id", F.round("dense", 6).alias("dense"))


@query(
    """
WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, round(greatest(0, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))), 9) AS dense
  FROM embeddings q JOIN embeddings e ON true WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, vec_id) AS r FROM p)
SELECT query_id, vec_id, round(dense, 6) AS dense FROM r WHERE r <= 10"""
)
def indexed_top10(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors by the persisted index, for every vector whose id is divisible by 50."""
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return VI.of_files(e, "embeddings-index").search(q, 10).select("query_id", "vec_id", F.round("dense", 6).alias("dense"))


@query(
    _BM25
    + f""", top AS (SELECT query_id, doc_id, bm25 FROM ranked WHERE r <= 10),
s AS (SELECT t.*, b.text AS q, d.text AS x, list_distinct({_tokens("lower(b.text)")}) AS qt, {_tokens("lower(d.text)")} AS xt
  FROM top t JOIN benchmark b ON b.item_id = t.query_id JOIN documents d USING (doc_id)),
o AS (SELECT *, len(list_intersect(qt, xt)) / len(qt) AS overlap, CASE WHEN contains(lower(x), trim(lower(q))) THEN 1.0 ELSE 0.0 END AS phrase FROM s)
SELECT query_id, doc_id, round(least(1, (1 - exp(-bm25 / 3)) * 0.25 + least(1, overlap * 0.85 + phrase * 0.15) * 0.3), 6) AS relevance,
  round(least(1, least(1, (1 - exp(-bm25 / 3)) * 0.25 + least(1, overlap * 0.85 + phrase * 0.15) * 0.3) * 0.7 + overlap * 0.3), 6) AS judged,
  round(len(list_intersect(qt, xt)) / len(list_distinct(list_concat(qt, xt))), 6) AS jaccard FROM o"""
)
def rerank_and_judge(spark: SparkSession, d: str) -> DataFrame:
    asked, docs = _asked(spark, d), spread(table(spark, d, "documents"))
    scored = N.of_files(table(spark, d, "documents"), "documents-index").bm25(asked, best=10).withColumn("_r", F.round("bm25", 6))
    top = R.top_k(scored, 10, [F.desc("_r"), F.asc("doc_id")], ["query_id"]).drop("_r")
    top = staged(top, "best-documents")
    # texts that none of the lists names stay where they are
    texts = docs.select("doc_id", "text").join(small(top.select("doc_id").distinct(), 100_000), "doc_id", "left_semi")
    both = top.join(asked, "query_id").join(texts, "doc_id").withColumn("dense", F.lit(None).cast("double"))
    ranked = R.rerank(both)
    return ranked.select("query_id", "doc_id", F.round("relevance", 6).alias("relevance"), F.round(V.judged("query", "text", "relevance"), 6).alias("judged"), F.round(V.jaccard(X.search_tokens("query"), X.search_tokens("text")), 6).alias("jaccard"))


@query()
def search_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Dense and sparse lists over hashed vectors, fused, reranked and made diverse, with explicit no_evidence."""
    embed = V.hashing_embedding()
    docs = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("paper_id"), "text")
    queries = staged(_asked(spark, d).withColumn("query_vector", embed("query")), "query-vectors")
    # vectors are an index: made once, written, then searched
    vectors = staged(docs.select("chunk_id", embed("text").alias("embedding")), "vectors")
    return R.search(queries, docs, vectors, index=N.of_files(table(spark, d, "documents"), "documents-index"))


@query(
    """
WITH s AS (SELECT conv_id, turn AS seed, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seed_rank FROM conversations WHERE role = 'user'),
f AS (SELECT c.conv_id, c.turn, s.seed, s.seed_rank, row_number() OVER (PARTITION BY c.conv_id, c.turn ORDER BY CASE WHEN s.seed = c.turn THEN 0 ELSE 1 END, s.seed_rank) AS n
  FROM conversations c JOIN s ON s.conv_id = c.conv_id AND c.turn BETWEEN s.seed - 1 AND s.seed + 1)
SELECT conv_id, turn, round(CASE WHEN seed = turn THEN 1.0 / seed_rank ELSE 0.8 / seed_rank END, 6) AS relevance FROM f WHERE n = 1"""
)
def neighbor_expansion(spark: SparkSession, d: str) -> DataFrame:
    """User turns as seeds; the turns around them inherit the first seed's relevance."""
    c = table(spark, d, "conversations")
    chunks = c.select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("chunk_id"))
    seeds = c.where("role = 'user'").withColumn("seed_rank", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    seeds = seeds.select(F.col("conv_id").alias("query_id"), "conv_id", "turn", (1.0 / F.col("seed_rank")).alias("relevance"), "seed_rank")
    found = R.neighbors(seeds, chunks, 1, ["conv_id"], "turn")
    return found.select("conv_id", "turn", F.round("relevance", 6).alias("relevance"))


@query(
    """
WITH r AS (SELECT lang, source, doc_id, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS turn,
  max(n_chars) OVER (PARTITION BY lang, source) AS first FROM documents),
p AS (SELECT lang, source, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY turn, first DESC, source) AS INTEGER) AS position FROM r WHERE turn <= 4)
SELECT * FROM p WHERE position <= 30"""
)
def round_robin_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("lang", "source", "doc_id", F.col("n_chars").alias("relevance"))
    return R.round_robin(docs, 4, 30, query_id="lang", paper_id="source", chunk_id="doc_id").select("lang", "source", "doc_id", "position")


# ---- text


@query(
    f"""
SELECT doc_id, len({_tokens("text")}) AS n_tokens, len(list_distinct({_tokens("lower(text)")})) AS n_distinct,
  len(list_distinct(regexp_extract_all(lower(text), '[\\pL\\pN_-]+'))) AS n_entailment,
  len(regexp_extract_all(text, '[\\pL\\pN_]+|[^\\pL\\pN_\\s]')) AS n_context FROM documents"""
)
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents"))
    counts = {"n_tokens": X.count_tokens("text"), "n_distinct": F.size(F.array_distinct(X.search_tokens("text"))), "n_entailment": F.size(X.entailment_tokens("text")), "n_context": X.count_tokens("text", X.CONTEXT_TOKEN)}
    return docs.select("doc_id", *(c.cast("long").alias(n) for n, c in counts.items()))


@query(
    """
SELECT doc_id, sha256(regexp_replace(regexp_replace(lower(trim(text)), '[.!?。！？]+$', ''), '\\s+', ' ', 'g')) AS statement,
  len(regexp_extract_all(text, '[.!?。！？]\\s+')) + 1 AS n_sentences,
  nullif(regexp_extract(text, '\\b((?:19|20)\\d{2})\\b', 1), '') AS year FROM documents"""
)
def statements_and_sentences(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents"))
    return docs.select("doc_id", F.sha2(X.normalize_statement("text"), 256).alias("statement"), F.size(X.sentences("text")).cast("long").alias("n_sentences"), X.extract_year("text").cast("string").alias("year"))


@query(
    """
SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) AS record_title, regexp_replace(substr(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), 1, 80), '^-+|-+$', '', 'g') AS slug,
  nullif(regexp_extract(html, '<title>([^<]*)', 1), '') AS title, sha256(coalesce(url, '') || chr(10) || CAST(page_id AS VARCHAR)) AS page_key FROM pages"""
)
def page_identifiers(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", X.record_title("url").alias("record_title"), X.slug("url").alias("slug"), X.first_match("html", "<title>([^<]*)").alias("title"), X.key_hash(F.coalesce("url", F.lit("")), "page_id").alias("page_key"))


@query(
    """
SELECT page_id, nullif(regexp_extract(lower(html), '(?:arxiv\\s*:\\s*)?((?:[a-z-]+/\\d{7})|(?:\\d{4}\\.\\d{4,5})(?:v\\d+)?)', 1), '') AS arxiv_id,
  nullif(regexp_extract(lower(html), '\\b(10\\.\\d{4,9}/[-._;()/:a-z0-9]+)', 1), '') AS doi FROM pages"""
)
def page_registries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.extract_arxiv_id("html").alias("arxiv_id"), X.extract_doi("html").alias("doi"))


@query(
    """
WITH d AS (SELECT doc_id, string_split(text, chr(12)) AS ps FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, unnest(ps) AS t, generate_subscripts(ps, 1) AS page FROM d),
p AS (SELECT doc_id, page, list_filter(list_transform(regexp_split_to_array(t, '\\r\\n|[\\n\\x0b\\f\\r]'), lambda v: lower(trim(regexp_replace(v, '\\s+', ' ', 'g')))), lambda v: v <> '') AS l FROM q),
e AS (SELECT doc_id, page, unnest(list_distinct(list_concat(l[1:2], CASE WHEN len(l) > 2 THEN l[-2:] ELSE l END))) AS line FROM p), n AS (SELECT doc_id, count(*) AS pages FROM p GROUP BY 1),
r AS (SELECT e.doc_id, line FROM e JOIN n USING (doc_id) WHERE pages >= 2 GROUP BY 1, 2 HAVING count(*) >= greatest(2, (max(pages) + 1) // 2)),
x AS (SELECT doc_id, page, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM p),
k AS (SELECT x.* FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND r.line = x.line) AND NOT regexp_matches(x.line, '(?i)^(?:page\\s+)?\\d+(?:\\s+of\\s+\\d+)?$'))
SELECT o.doc_id, sha256(string_agg(line, chr(10) ORDER BY page, i)) AS content_hash FROM documents o LEFT JOIN k ON k.doc_id = o.doc_id GROUP BY 1"""
)
def edge_clean_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).select("doc_id", X.content_fingerprint("text").alias("content_hash"))


@query()
def exact_normal_forms(spark: SparkSession, d: str) -> DataFrame:
    small_batches(spark)
    docs = spread(table(spark, d, "documents"))
    return docs.select("doc_id", F.sha2(X.normalize_title("text"), 256).alias("title"), F.sha2(X.casefold("text"), 256).alias("folded"), F.sha2(X.normalize_unicode("text"), 256).alias("nfkc"))


@query(
    f"""
WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS said FROM conversations),
k AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(said), '[\\pL\\pN_-]+')) AS s, list_distinct(regexp_extract_all(lower(text), '[\\pL\\pN_-]+')) AS e,
  contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(said), '\\s+', ' ', 'g'))) AS inside FROM t WHERE said IS NOT NULL),
o AS (SELECT *, len(list_intersect(s, e)) / len(s) AS o, len(list_intersect(s, {X.NEGATIONS})) > 0 AS sn, len(list_intersect(e, {X.NEGATIONS})) > 0 AS en FROM k)
SELECT conv_id, turn, CASE WHEN len(s) = 0 THEN 'insufficient' WHEN inside AND len(e) > 0 THEN 'supported' WHEN len(e) > 0 AND o >= 0.6 AND sn <> en THEN 'contradicted'
  WHEN len(e) > 0 AND o >= 0.7 THEN 'supported' ELSE 'insufficient' END AS status FROM o"""
)
def entailment_of_turns(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("said", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("said is not null")
    return c.select("conv_id", "turn", V.entailment("said", F.array("text")).alias("status"))


# ---- identity and upkeep


@query(
    """
WITH h AS (SELECT doc_id, source || '/' || doc_id AS path, sha256(text) AS file_hash FROM documents),
k AS (SELECT DISTINCT path, file_hash FROM h JOIN labels USING (doc_id))
SELECT h.doc_id, CASE WHEN k.file_hash = h.file_hash THEN 'unchanged' WHEN k.path IS NULL AND h.file_hash IN (SELECT file_hash FROM k) THEN 'duplicate' WHEN k.path IS NOT NULL THEN 'modified' ELSE 'new' END AS state
FROM h LEFT JOIN k ON k.path = h.path"""
)
def classify_files(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents are known; which of all documents are new to that state?"""
    h = table(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "doc_id").alias("path"), F.sha2("text", 256).alias("file_hash"))
    known = h.join(table(spark, d, "labels").select("doc_id"), "doc_id")
    return I.classify_files(h, known).select("doc_id", "state")


@query("SELECT file_hash, copies, doc_id FROM (SELECT sha256(text) AS file_hash, doc_id, count(*) OVER (PARTITION BY text) AS copies FROM documents WHERE text IS NOT NULL) WHERE copies > 1")
def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    return I.exact_duplicates(h, "file_hash", "doc_id").select("file_hash", "copies", "doc_id")


@query(
    """
WITH p AS (SELECT doc_id AS paper_id, sha256(text) AS content_hash, lang, n_chars FROM documents JOIN labels USING (doc_id)),
f AS (SELECT doc_id, sha256(text) AS content_hash, lang, n_chars FROM documents),
a AS (SELECT content_hash, min(paper_id) AS p FROM p GROUP BY 1), b AS (SELECT lang, n_chars, min(paper_id) AS p FROM p GROUP BY 1, 2)
SELECT f.doc_id, coalesce(a.p, b.p) AS paper_id, CAST(CASE WHEN a.p IS NOT NULL THEN 1.0 WHEN b.p IS NOT NULL THEN 0.9 ELSE 1.0 END AS DOUBLE) AS confidence,
  CASE WHEN a.p IS NOT NULL THEN 'content' WHEN b.p IS NOT NULL THEN 'title' ELSE 'new' END AS matched_by
FROM f LEFT JOIN a USING (content_hash) LEFT JOIN b ON b.lang = f.lang AND b.n_chars = f.n_chars"""
)
def identity_cascade(spark: SparkSession, d: str) -> DataFrame:
    """By content, else by language and length (in the place of title and authors)."""
    f = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), "lang", "n_chars")
    papers = f.join(table(spark, d, "labels").select("doc_id"), "doc_id").withColumnRenamed("doc_id", "paper_id")
    found = I.resolve_identity(f, papers, [(["content_hash"], 1.0, "content"), (["lang", "n_chars"], 0.9, "title")])
    return found.select("doc_id", "paper_id", "confidence", "matched_by")


@query("SELECT doc_id, 'missing' AS issue FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_rows(spark: SparkSession, d: str) -> DataFrame:
    return I.missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"]).withColumn("issue", F.lit("missing"))


@query(
    """
WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id, event_type) AS attempts FROM events)
SELECT user_id, event_type, event_id, value, attempts FROM e WHERE r = 1"""
)
def latest_with_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Upsert into an empty table, and the attempt counter."""
    e = table(spark, d, "events").withColumn("attempts", F.count("*").over(Window.partitionBy("user_id", "event_type")))
    empty = e.where(F.lit(False))
    return I.upsert(empty, e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value", "attempts")


@query(
    """
WITH v AS (SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, lead(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS superseded_by FROM events)
SELECT event_id, k, superseded_by IS NULL AS is_active, superseded_by FROM v"""
)
def supersession_chain(spark: SparkSession, d: str) -> DataFrame:
    """Each generation ends the one before; nested JSON properties are read by path."""
    e = K.superseded(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "event_id")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "is_active", "superseded_by")


@query(
    """
WITH c AS (SELECT event_id AS id, user_id AS key, event_type AS generation FROM events WHERE event_type IN ('click', 'view')),
u AS (SELECT key, generation, min(id) AS id FROM c WHERE generation = 'click' GROUP BY ALL), n AS (SELECT key, generation, min(id) AS id FROM c WHERE generation = 'view' GROUP BY ALL)
SELECT u.id, u.generation, n.id IS NULL AS is_active, n.id AS superseded_by FROM u LEFT JOIN n USING (key) UNION ALL SELECT id, generation, true, NULL FROM n"""
)
def supersede_merge(spark: SparkSession, d: str) -> DataFrame:
    """A click generation of each user is ended by the user's view generation."""
    e = table(spark, d, "events")
    gen = lambda g: e.where(F.col("event_type") == g).groupBy(F.col("user_id").alias("key"), F.col("event_type").alias("generation")).agg(F.min("event_id").alias("id"))
    current = gen("click").withColumns({"is_active": F.lit(True), "superseded_by": F.lit(None).cast("long")})
    return G.supersede(current, gen("view"), "key", "generation", "id").select("id", "generation", "is_active", "superseded_by")


@query(
    """
WITH k AS (SELECT doc_id, sha256(text) AS document_hash FROM documents),
l AS (SELECT doc_id, quality, toxic FROM labels)
SELECT k.doc_id, s.stage FROM k LEFT JOIN l USING (doc_id), (VALUES ('parse', 0), ('structure', 1), ('chunk', 2)) s(stage, i)
WHERE s.i >= CASE WHEN l.doc_id IS NULL THEN 0 WHEN l.quality = 0 THEN 1 WHEN l.toxic = 1 THEN 2 ELSE 3 END"""
)
def stale_stages(spark: SparkSession, d: str) -> DataFrame:
    """A ledger made of the labels: unlabelled documents lack all stages, poor ones a structure, toxic ones current chunks."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("version_id"), F.sha2("text", 256).alias("document_hash"))
    lab = table(spark, d, "labels").withColumnRenamed("doc_id", "version_id").join(docs, "version_id")
    run = lambda stage, v: lab.select("version_id", F.lit(stage).alias("stage"), v.alias("stage_version"), "document_hash")
    ledger = run("parse", F.lit("p1")).unionByName(run("structure", F.when(F.col("quality") == 0, "s0").otherwise("s1"))).unionByName(run("chunk", F.when(F.col("toxic") == 1, "c0").otherwise("c1")))
    return I.stale(docs, ledger, [("parse", "p1"), ("structure", "s1"), ("chunk", "c1")]).select(F.col("version_id").alias("doc_id"), "stage")


@query("SELECT event_id, CASE WHEN event_type <> 'error' AND ts < TIMESTAMP '2024-01-08' THEN 'expired' ELSE event_type END AS status FROM events")
def expiry_sweep(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("status", F.when(F.col("event_type") != "error", "active").otherwise(F.col("event_type")))
    swept = I.expired(e, F.lit("2024-01-08").cast("timestamp_ntz"), at="ts")
    return swept.select("event_id", F.when(F.col("status") == "active", F.col("event_type")).otherwise(F.col("status")).alias("status"))


@query(
    """
SELECT coalesce(a.c_custkey, b.s_suppkey) AS key, coalesce(a.c_name, b.s_name) AS name, coalesce(a.c_acctbal, b.s_acctbal) AS balance
FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS c_name, c_acctbal FROM customer) a FULL JOIN supplier b ON a.c_custkey = b.s_suppkey"""
)
def fill_null_merge(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name"), F.col("c_acctbal").alias("balance"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return I.fill_nulls(a, b, ["key"])


@query(
    """
SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT k, nm FROM (SELECT s_suppkey AS k, min(s_name) AS nm FROM supplier GROUP BY 1) WHERE k NOT IN (SELECT n_nationkey FROM nation)"""
)
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return I.insert_or_ignore(a, b, ["key"], [F.asc("name")])


@query(
    """
SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
UNION ALL SELECT c_custkey, 'R' FROM customer WHERE c_nationkey = 3"""
)
def replace_slices(spark: SparkSession, d: str) -> DataFrame:
    cur = table(spark, d, "orders").select(F.col("o_custkey").alias("slice"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    new = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("slice"), F.col("c_custkey").alias("k"), F.lit("R").alias("s"))
    return I.replace_slices(cur, new, "slice").select("k", "s")


@query(
    """
WITH c AS (SELECT doc_id, sha256(text) AS h FROM documents), r AS (SELECT DISTINCT h FROM c JOIN labels USING (doc_id))
SELECT c.doc_id, c.h IN (SELECT h FROM r) AS reused FROM c"""
)
def reusable_vectors(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    have = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id").select("content_hash")
    todo, reused = I.to_compute(docs, have)
    return todo.select("doc_id", F.lit(False).alias("reused")).unionByName(reused.select("doc_id", F.lit(True).alias("reused")))


# ---- joins and aggregates


@query(
    """
SELECT n.n_name AS nation, r.r_name AS region, count(DISTINCT o.o_custkey) AS customers, count(*) FILTER (o.o_orderstatus = 'F') AS finished, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY 1, 2"""
)
def status_counters(spark: SparkSession, d: str) -> DataFrame:
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    found = K.counters(j, ["n_name", "r_name"], {"customers": "o_custkey"}, {"finished": F.col("o_orderstatus") == "F"}, {"total": "o_totalprice"})
    return found.select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"), "customers", "finished", F.col("rows").alias("orders"), F.round("total", 2).alias("total"))


@query(
    """
WITH d AS (SELECT * FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(status))
SELECT d.status, count(o.o_orderkey) AS n, coalesce(bool_or(o.o_totalprice > 400000), false) AS any_large FROM d LEFT JOIN orders o ON o.o_orderstatus = d.status GROUP BY 1"""
)
def zero_filled_counts(spark: SparkSession, d: str) -> DataFrame:
    return K.zero_filled(table(spark, d, "orders"), "o_orderstatus", list("FOPX"), F.col("o_totalprice") > 400000).withColumnRenamed("any", "any_large")


@query("SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus='F') AS files_F, count(*) FILTER (o_orderstatus='O') AS files_O, count(*) FILTER (o_orderstatus='P') AS files_P FROM orders GROUP BY 1")
def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    return K.by_status(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", list("FOP"), "files_").withColumnRenamed("o_orderpriority", "priority")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def semi_and_anti(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return c.join(o.where("o_totalprice > 300000"), "c_custkey", "left_semi").join(o.where("o_orderpriority = '1-URGENT'"), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query(
    """
SELECT o_orderkey, count(*) AS n_lines, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS lines, sha256(string_agg(l_linenumber || ':' || l_partkey, chr(10) ORDER BY l_linenumber || ':' || l_partkey)) AS digest
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"""
)
def nested_children(spark: SparkSession, d: str) -> DataFrame:
    """Children of a parent in order, and the digest of their sorted lines."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    g = K.nested(o, table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"])
    lines = F.array_join(F.transform("children", lambda v: F.concat_ws(":", v["l_linenumber"], v["l_partkey"])), ",")
    return g.select(F.col("l_orderkey").alias("o_orderkey"), F.size("children").cast("long").alias("n_lines"), lines.alias("lines"), "digest")


@query(
    """
WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, count(*) OVER (PARTITION BY conv_id) AS c FROM conversations)
SELECT conv_id, string_agg(turn, ',' ORDER BY turn) FILTER (n <= 3) AS kept, CAST(greatest(0, max(c) - 3) AS BIGINT) AS dropped FROM r GROUP BY 1"""
)
def tail_retention(spark: SparkSession, d: str) -> DataFrame:
    """The last messages of a conversation stay."""
    return R.tail(table(spark, d, "conversations"), ["conv_id"], "turn", 3).select("conv_id", F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept"), "dropped")


# ---- curation


@query(
    """
WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, doc_id FROM r WHERE n <= 40 OR i IN (SELECT CAST(round_even(k * (r.n - 1) / 39.0, 0) AS BIGINT) FROM range(40) t(k))"""
)
def even_sample(spark: SparkSession, d: str) -> DataFrame:
    """A systematic sample of each language (a sampling operator: its size is the feature)."""
    return C.evenly(table(spark, d, "documents"), ["lang"], 40, [F.asc("n_chars"), F.asc("doc_id")]).select("lang", "doc_id")


@query(
    """
WITH r AS (SELECT d.doc_id, sha256(text) AS h, coalesce(quality, -1) AS q, n_chars FROM documents d LEFT JOIN labels USING (doc_id)),
s AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY q DESC, n_chars DESC, doc_id) AS n FROM r) SELECT doc_id, h FROM s WHERE n = 1"""
)
def best_of_duplicates(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.sha2("text", 256).alias("h"), F.coalesce("quality", F.lit(-1)).alias("q"), "n_chars")
    return C.best_record(r, ["h"], [F.desc("q"), F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "h")


@query(
    """
SELECT d.doc_id, CASE WHEN lang NOT IN ('en', 'de') THEN 'language' WHEN toxic = 1 THEN 'toxic' WHEN n_chars < 100 THEN 'short' WHEN quality = 0 THEN 'quality' END AS reason,
  CASE WHEN l.doc_id IS NULL THEN 'not_queried' WHEN quality = 1 AND toxic = 0 THEN 'verified' ELSE 'needs_review' END AS review FROM documents d LEFT JOIN labels l USING (doc_id)"""
)
def exclusion_cascade(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").join(table(spark, d, "labels").withColumn("asked", F.lit(True)), "doc_id", "left")
    rules = [("language", ~F.col("lang").isin("en", "de")), ("toxic", F.col("toxic") == 1), ("short", F.col("n_chars") < 100), ("quality", F.col("quality") == 0)]
    review = C.verification(F.col("quality").cast("double"), F.col("lang"), F.col("toxic") == 0, F.coalesce("asked", F.lit(False)))
    return r.select("doc_id", C.exclusion(rules).alias("reason"), review.alias("review"))


@query("SELECT o_orderpriority AS code, o_orderstatus AS reason, count(*) AS n FROM orders GROUP BY ALL")
def failure_tally(spark: SparkSession, d: str) -> DataFrame:
    return C.failure_tally(table(spark, d, "orders").select(F.col("o_orderpriority").alias("code"), F.col("o_orderstatus").alias("reason")), ["code", "reason"])


@query()
def near_equal_titles(spark: SparkSession, d: str) -> DataFrame:
    """Near-equal names among the distinct page titles."""
    p = table(spark, d, "pages").select("page_id", X.record_title(X.first_match("html", "<title>([^<]*)")).alias("t"))
    return C.similar_titles(p.groupBy("t").agg(F.min("page_id").alias("page_id")), "page_id", "t")


# ---- workflow


@query(
    """
WITH t AS (SELECT event_id, user_id, event_type, length(props) AS tokens, sum(length(props)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS running, value FROM events)
SELECT event_id, CAST(running AS BIGINT) AS running, (event_type = 'error' OR value > 50 OR running > 6000) AS offload FROM t"""
)
def offload_decisions(spark: SparkSession, d: str) -> DataFrame:
    e = W.running_tokens(table(spark, d, "events").withColumn("tokens", F.length("props")), "user_id", ["ts", "event_id"], "tokens")
    go = W.offload(F.lit("text/plain"), F.lit(0), F.lit(0), F.lit(0), (F.col("event_type") == "error") | (F.col("value") > 50), F.col("tokens"), F.col("running"))
    return e.select("event_id", "running", go.alias("offload"))


@query(
    """
WITH u AS (SELECT conv_id AS task_id, turn, role FROM conversations),
s AS (SELECT *, CASE WHEN role = 'assistant' AND turn % 5 = 3 THEN 'failed' ELSE 'completed' END AS state FROM u)
SELECT task_id, CASE WHEN count(*) FILTER (state = 'failed') = count(*) THEN 'failed' WHEN count(*) FILTER (state = 'completed') = count(*) THEN 'completed' ELSE 'partial' END AS status,
  count(*) FILTER (state = 'completed') AS completed, count(*) AS total FROM s GROUP BY 1"""
)
def task_progress(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "conversations").select(F.col("conv_id").alias("task_id"), F.when((F.col("role") == "assistant") & (F.col("turn") % 5 == 3), "failed").otherwise("completed").alias("state"))
    return W.task_status(u)


@query(
    """
WITH RECURSIVE u AS (SELECT n_regionkey AS task_id, n_nationkey AS unit, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, n_nationkey % 7 = 5 AS bad FROM nation),
s(task_id, unit, i, layer, state, attempts) AS (
  SELECT task_id, unit, i, 0, CASE WHEN bad AND unit % 2 = 1 THEN 'failed' ELSE 'completed' END, CASE WHEN bad THEN 2 ELSE 1 END FROM u WHERE i = 1
  UNION ALL SELECT u.task_id, u.unit, u.i, s.layer + 1, CASE WHEN s.state <> 'completed' THEN 'skipped' WHEN u.bad AND u.unit % 2 = 1 THEN 'failed' ELSE 'completed' END, CASE WHEN s.state <> 'completed' THEN 0 WHEN u.bad THEN 2 ELSE 1 END
  FROM s JOIN u ON u.task_id = s.task_id AND u.i = s.i + 1)
SELECT task_id, CAST(unit AS VARCHAR) AS unit_id, layer, state, attempts FROM s"""
)
def dag_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Nations of a region as a chain of units; one whose key leaves 5 on division by 7 fails, an even one only at first."""
    own = Window.partitionBy("task_id").orderBy("k")
    u = table(spark, d, "nation").select(F.col("n_regionkey").alias("task_id"), F.col("n_nationkey").alias("k"))
    u = u.withColumns({"unit_id": F.col("k").cast("string"), "dependency_ids": F.filter(F.array(F.lag("k").over(own).cast("string")), lambda x: x.isNotNull())})
    return W.schedule(u, F.col("k") % 7 != 5, F.col("k") % 2 == 0)


@query("SELECT DISTINCT sha256(text) AS content_hash, length(text) AS n FROM documents")
def artifact_blobs(spark: SparkSession, d: str) -> DataFrame:
    return put_blobs(None, table(spark, d, "documents"), "text").select("content_hash", F.length("payload").cast("long").alias("n"))


@query("SELECT doc_id, sha256('{\"doc_id\":' || doc_id || ',\"quality\":' || quality || ',\"toxic\":' || toxic || '}') AS generation_key FROM labels")
def generation_keys(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels")
    return lab.select("doc_id", F.sha2(canonical_json(lab), 256).alias("generation_key"))


# ---- structure, graph


@query()
def sections(spark: SparkSession, d: str) -> DataFrame:
    return S.section_table(S.sections(S.blocks_of(spread(table(spark, d, "documents")))))


@query()
def chunks(spark: SparkSession, d: str) -> DataFrame:
    return S.chunks(S.groups(S.sections(S.blocks_of(spread(table(spark, d, "documents"))))))


@query()
def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    small_batches(spark)
    return spread(table(spark, d, "documents")).select("doc_id", V.hashing_embedding()("text").alias("embedding"))


# ---- streaming forms, as a batch


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    return E.windowed(table(spark, d, "events")).withColumn("total", F.round("total", 6))


@query(
    """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid"""
)
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    return E.sessions(table(spark, d, "events")).select("user_id", "start", "n")


# ---- filters, recency, best matches


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND lower(source) IN ('src0', 'src3') AND n_chars BETWEEN 500 AND 5000")
def scoped_documents(spark: SparkSession, d: str) -> DataFrame:
    """Scope and range filters, which reach the scan."""
    found = R.filtered(table(spark, d, "documents"), lang=["en", "de"])
    return found.where(F.lower("source").isin("src0", "src3") & F.col("n_chars").between(500, 5000)).select("doc_id", "lang", "source")


@query(
    """
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE props ILIKE '%"k": 1%' OR event_type ILIKE '%err%')
SELECT user_id, event_id FROM r WHERE r <= 5"""
)
def recent_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Keyword filter over several columns without regard to case, newest five of each user."""
    hit = K.mentioned(table(spark, d, "events"), {"props": '"k": 1', "event_type": "err"})
    return R.top_k(hit, 5, [F.desc("ts"), F.desc("event_id")], ["user_id"]).select("user_id", "event_id")


@query(
    """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 20 AND p_size + 5 >= 10) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)"""
)
def either_end(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a chosen end on either side; ranges overlap [10, 20]."""
    parts = table(spark, d, "part").where("p_size <= 20 and p_size + 5 >= 10").select(F.lit("part").alias("type"), F.col("p_partkey").alias("id"))
    chosen = parts.unionByName(table(spark, d, "supplier").where("s_nationkey = 3").select(F.lit("supplier").alias("type"), F.col("s_suppkey").alias("id")))
    ends = {"l_partkey": "part", "l_suppkey": "supplier"}
    return K.edges_of(table(spark, d, "lineitem"), ends, chosen, ["l_orderkey", "l_linenumber", *ends]).select("l_orderkey", "l_linenumber")


@query(
    """
SELECT c_nationkey AS nation, max_by(c_custkey, (c_acctbal, -c_custkey)) AS best, round(max(c_acctbal), 2) AS balance, string_agg(DISTINCT c_mktsegment, ' | ' ORDER BY c_mktsegment) AS segments, round(min(c_acctbal), 2) AS least
FROM customer GROUP BY 1"""
)
def best_matches(spark: SparkSession, d: str) -> DataFrame:
    """Argmax with a tie-break, distinct values in order, least confidence."""
    c = table(spark, d, "customer").withColumnRenamed("c_nationkey", "nation")
    best = K.best_match(c, "nation", "c_acctbal", "c_custkey").withColumn("balance", F.round("score", 2)).drop("score")
    also = c.groupBy("nation").agg(F.array_join(F.sort_array(F.collect_set("c_mktsegment")), " | ").alias("segments"), F.round(F.min("c_acctbal"), 2).alias("least"))
    return best.join(also, "nation")


@query(
    """
WITH u AS (SELECT conv_id AS task_id, turn, role, conv_id || ':' || turn AS unit_id FROM conversations)
SELECT task_id, unit_id, CASE WHEN role = 'assistant' THEN turn ELSE 0 END AS dependencies FROM u"""
)
def unit_plan(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns as verifiers, which wait for all earlier units."""
    u = table(spark, d, "conversations").select(F.col("conv_id").alias("task_id"), F.col("turn").alias("ordinal"), F.concat_ws(":", "conv_id", "turn").alias("unit_id"), F.when(F.col("role") == "assistant", "verify").otherwise("analyse").alias("work_type"))
    return W.plan_units(u).select("task_id", "unit_id", F.size("dependency_ids").cast("long").alias("dependencies"))


from . import library  # noqa: E402,F401 - its queries join these
