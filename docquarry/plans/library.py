"""Further queries of the library's operators over the driver's tables, and their SQL."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import counters as C2
from ..operators import counts as K
from ..operators import curation as C
from ..operators import graph as G
from ..operators import incremental as I
from ..operators import reading as D
from ..operators import retrieval as R
from ..operators import structure as S
from ..operators import text_index as N
from ..operators import views as W2
from ..operators import workflow as W
from ..sources import versions
from ..sources.buckets import BucketTable
from ..sources.ports import structure_function
from ..sources.staging import shared_folder, spread
from ..sources.tables import checksums, delete_blobs, get_blobs, look_up, manifest, put_blobs, save_documents, table
from ..streaming import events as E
from .queries import _BM25, _tokens, query

# ---- SQL that several oracles share

_COLLAPSE = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_PLAIN = "nullif(trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '')"
_FIRST = "nullif(regexp_extract({0}, '{1}', 1), '')"


def _sql_collapse(x: str) -> str:
    return _COLLAPSE.format(x)


def _ordered_distinct(x: str) -> str:
    """A list's values by first occurrence."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def _sql_level(text: str, kind: str, level: str) -> str:
    """structure.heading_level."""
    t = _sql_collapse(text)
    number = f"regexp_extract({t}, '^\\s*((?:\\d+\\.)*\\d+)\\s*[.)]?\\s+\\S', 1)"
    return f"""CASE WHEN length({t}) BETWEEN 1 AND 240 AND length({t}) - length(replace({t}, ' ', '')) <= 30 THEN
      CASE WHEN {level} IS NOT NULL AND {kind} = 'heading' THEN greatest(1, least({level}, 6)) WHEN {number} <> '' THEN length({number}) - length(replace({number}, '.', '')) + 1
        WHEN regexp_matches(coalesce({_PLAIN.format(t)}, ''), '^(?:{S.TOP_TITLES})$') THEN 1 WHEN regexp_matches({t}, '(?i)^\\s*[IVXLC]+[.)]\\s+\\S') THEN 1
        WHEN regexp_matches({t}, '^\\s*[A-Z][.)]\\s+\\S') THEN 2 WHEN {kind} = 'heading' THEN 1 END END"""


#: Turns of conversations as blocks of documents: some numbered, some headings with a level, some captions.
_BLOCKS = """
b AS (SELECT conv_id AS version_id, CAST(turn // 3 + 1 AS INTEGER) AS page_number, 'b' || turn AS block_id, CASE WHEN turn % 3 = 0 THEN 'heading' ELSE 'paragraph' END AS block_type,
  CASE turn % 4 WHEN 0 THEN '1.' || turn || ' ' || text WHEN 1 THEN 'Figure ' || turn || ': ' || text WHEN 2 THEN 'A) ' || text ELSE text END AS text,
  CAST(turn AS INTEGER) AS reading_order, CASE WHEN turn % 6 = 0 THEN CAST(1 + turn % 4 AS INTEGER) END AS level FROM conversations)"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    text = F.when(t % 4 == 0, F.concat(F.lit("1."), t, F.lit(" "), F.col("text"))).when(t % 4 == 1, F.concat(F.lit("Figure "), t, F.lit(": "), F.col("text")))
    text = text.when(t % 4 == 2, F.concat(F.lit("A) "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("version_id"), (F.floor(t / 3) + 1).cast("int").alias("page_number"), F.concat(F.lit("b"), t).alias("block_id"), F.when(t % 3 == 0, "heading").otherwise("paragraph").alias("block_type"),
        text.alias("text"), t.cast("int").alias("reading_order"), F.when(t % 6 == 0, 1 + t % 4).cast("int").alias("level"),
    )


#: Turns of conversations as chunks of papers.
_CHUNKS = """
c AS (SELECT conv_id * 1000 + turn AS chunk_id, conv_id % 10 AS paper_id, conv_id AS version_id, conv_id * 10 + turn // 3 AS section_id, CAST(turn AS INTEGER) AS chunk_order, CAST(turn // 2 + 1 AS INTEGER) AS page_start,
  CAST(turn // 2 + 1 + turn % 2 AS INTEGER) AS page_end, role AS chunk_type, [CAST(turn % 5 AS VARCHAR)] AS related_element_ids, text FROM conversations)"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    t, v = F.col("turn"), F.col("conv_id")
    page = (F.floor(t / 2) + 1).cast("int")
    return table(spark, d, "conversations").select(
        (v * 1000 + t).alias("chunk_id"), (v % 10).alias("paper_id"), v.alias("version_id"), (v * 10 + F.floor(t / 3)).cast("long").alias("section_id"), t.cast("int").alias("chunk_order"), page.alias("page_start"),
        (page + (t % 2).cast("int")).alias("page_end"), F.col("role").alias("chunk_type"), F.array((t % 5).cast("string")).alias("related_element_ids"), "text",
    )


def _sections(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("version_id", "section_id").agg(F.min("chunk_order").alias("section_order")).withColumn("section_path", F.concat(F.lit("S"), F.col("section_id") % 10))


# ---- structure


@query(
    f"""
WITH {_BLOCKS}, s AS (SELECT *, 9 + (reading_order * 5) % 14 AS size, 10 + (reading_order * 7) % 17 AS height, len(string_split({_sql_collapse("text")}, ' ')) <= 25 AS few FROM b)
SELECT version_id, block_id, {_sql_level("text", "block_type", "level")} AS level, CASE WHEN few AND len(string_split(trim(text), chr(10))) <= 3 AND size >= 13 THEN CASE WHEN size >= 20 THEN 1 WHEN size >= 16 THEN 2 ELSE 3 END END AS by_font,
  CASE WHEN few AND len(string_split(text, chr(10))) <= 3 AND height >= 16 THEN CASE WHEN height >= 24 THEN 1 ELSE 2 END END AS by_height FROM s"""
)
def heading_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels of blocks by their text, by their type's size and by their lines' height."""
    b = _blocks(spark, d).withColumns({"size": 9 + (F.col("reading_order") * 5) % 14, "height": 10 + (F.col("reading_order") * 7) % 17})
    return b.select("version_id", "block_id", S.heading_level("text", "block_type", "level").alias("level"), S.font_heading("text", "size").alias("by_font"), S.height_heading("text", "height").alias("by_height"))


@query(
    f"""
WITH RECURSIVE {_BLOCKS},
m AS (SELECT *, {_sql_level("text", "block_type", "level")} AS lv, row_number() OVER w AS ord FROM b WINDOW w AS (PARTITION BY version_id ORDER BY page_number, reading_order, block_id)),
f AS (SELECT *, first_value(lv IS NULL) OVER (PARTITION BY version_id ORDER BY ord) AS front FROM m),
o AS (SELECT *, CAST(sum(CASE WHEN lv IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY version_id ORDER BY ord) - 1 + CASE WHEN front THEN 1 ELSE 0 END AS INTEGER) AS so FROM f),
h AS (SELECT version_id, so, lv, {_sql_collapse("text")} AS title, row_number() OVER (PARTITION BY version_id ORDER BY so) AS k FROM o WHERE lv IS NOT NULL),
r AS (
  SELECT DISTINCT version_id, CAST(0 AS BIGINT) AS k, CASE WHEN front THEN [CAST(0 AS INTEGER)] ELSE CAST([] AS INTEGER[]) END AS st, CASE WHEN front THEN ['Front Matter'] ELSE CAST([] AS VARCHAR[]) END AS ti,
    CAST(CASE WHEN front THEN 0 END AS INTEGER) AS so, CAST(1 AS INTEGER) AS lvl FROM o
  UNION ALL
  SELECT h.version_id, h.k, list_append(r.st[1:least(h.lv, len(r.st) + 1) - 1], h.so), list_append(r.ti[1:least(h.lv, len(r.st) + 1) - 1], h.title), h.so, CAST(least(h.lv, len(r.st) + 1) AS INTEGER)
  FROM r JOIN h ON h.version_id = r.version_id AND h.k = r.k + 1),
n AS (SELECT version_id, so, lvl, CASE WHEN lvl > 1 THEN st[lvl - 1] END AS parent, array_to_string(ti, ' > ') AS path FROM r WHERE so IS NOT NULL)
SELECT n.version_id, n.so AS section_order, n.lvl AS section_level, n.parent AS parent_order, sha256(n.path) AS path, min(o.page_number) AS page_start, max(o.page_number) AS page_end, string_agg(o.block_id, ',' ORDER BY o.ord) AS blocks
FROM n JOIN o ON o.version_id = n.version_id AND o.so = n.so GROUP BY ALL"""
)
def section_trees(spark: SparkSession, d: str) -> DataFrame:
    """Sections of conversations: nesting, paths, page ranges and blocks."""
    t = S.section_table(S.sections(_blocks(spark, d)))
    return t.select("version_id", "section_order", "section_level", "parent_order", F.sha2("section_path", 256).alias("path"), "page_start", "page_end", F.array_join("source_block_ids", ",").alias("blocks"))


_CAPTION = "(?is)^\\s*(fig(?:ure)?\\.?|table|algorithm|alg\\.?|equation|eq\\.?)\\s*([A-Z]?\\d+|[IVXLC]+)?\\s*[:.)-]?\\s*(.*)$"


@query(
    f"""
WITH {_BLOCKS}, t AS (SELECT *, {_sql_collapse("text")} AS t FROM b), w AS (SELECT *, lower(regexp_extract(t, '{_CAPTION}', 1)) AS word, regexp_extract(t, '{_CAPTION}', 2) AS number FROM t),
k AS (SELECT *, CASE WHEN word LIKE 'fig%' THEN 'figure' WHEN word LIKE 'table%' THEN 'table' WHEN word LIKE 'alg%' THEN 'algorithm' WHEN word LIKE 'eq%' THEN 'equation' END AS element_type FROM w)
SELECT version_id, block_id, element_type, CASE WHEN word <> '' AND number <> '' THEN upper(substr(element_type, 1, 1)) || substr(element_type, 2) || ' ' || number END AS label,
  CASE WHEN word <> '' AND element_type <> 'equation' THEN t END AS caption, page_number AS page FROM k WHERE element_type IS NOT NULL"""
)
def elements_of_turns(spark: SparkSession, d: str) -> DataFrame:
    found = S.elements(S.sections(_blocks(spark, d)))
    return found.select("version_id", "block_id", "element_type", "label", "caption", "page")


@query(
    f"""
WITH b AS (SELECT conv_id AS version_id, CAST(turn // 6 AS INTEGER) AS so, CAST(turn AS INTEGER) AS ord, CAST(turn // 4 + 1 AS INTEGER) AS page, 'b' || turn AS block_id, CASE turn % 6 WHEN 0 THEN 'heading' WHEN 2 THEN 'equation' ELSE 'paragraph' END AS kind,
  CASE turn % 6 WHEN 2 THEN 'Equation ' || turn || ': ' || text WHEN 3 THEN CASE WHEN conv_id % 2 = 0 THEN 'where ' || text ELSE text END WHEN 4 THEN 'Figure ' || turn || ': ' || text WHEN 5 THEN CASE WHEN conv_id % 3 = 0 THEN text || ' (see Figure ' || turn - 1 || ')' ELSE text END ELSE text END AS text FROM conversations),
t AS (SELECT *, {_sql_collapse("text")} AS t FROM b), w AS (SELECT *, lower(regexp_extract(t, '{_CAPTION}', 1)) AS word, regexp_extract(t, '{_CAPTION}', 2) AS number FROM t),
e AS (SELECT *, CASE WHEN kind = 'equation' THEN kind WHEN word LIKE 'fig%' THEN 'figure' WHEN word LIKE 'table%' THEN 'table' WHEN word LIKE 'alg%' THEN 'algorithm' WHEN word LIKE 'eq%' THEN 'equation' END AS el FROM w),
n AS (SELECT *, CASE WHEN el IS NOT NULL AND word <> '' AND number <> '' THEN lower(el || ' ' || number) END AS label, lower(lag(text) OVER s) AS bt, lag(kind) OVER s AS bk, lower(lead(text) OVER s) AS behind FROM e WINDOW s AS (PARTITION BY version_id, so ORDER BY ord)),
d AS (SELECT version_id, so,
  ord - CASE WHEN bt IS NOT NULL AND bk <> 'heading' AND (coalesce(contains(bt, label), false) OR el = 'equation' AND len(string_split({_sql_collapse("bt")}, ' ')) <= 80) THEN 1 ELSE 0 END AS a,
  ord + CASE WHEN behind IS NOT NULL AND (coalesce(contains(behind, label), false) OR el = 'equation' AND regexp_matches(behind, '^(?:{"|".join(S.CONTINUES)})')) THEN 1 ELSE 0 END AS z FROM n WHERE el IS NOT NULL),
i AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY version_id, so ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM d),
j AS (SELECT *, sum(fresh) OVER (PARTITION BY version_id, so ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS island FROM i), k AS (SELECT version_id, so, min(a) AS a, max(z) AS z FROM j GROUP BY version_id, so, island),
g AS (SELECT e.*, k.a IS NOT NULL AS dep, coalesce(k.a, e.ord) AS grp FROM e LEFT JOIN k ON k.version_id = e.version_id AND e.so = k.so AND e.ord BETWEEN k.a AND k.z),
m AS (SELECT version_id, so, grp, bool_or(dep) AS dependency, min(page) AS page_start, max(page) AS page_end, string_agg(block_id, ',' ORDER BY ord) AS blocks, string_agg(trim(text), chr(10) || chr(10) ORDER BY ord) FILTER (WHERE trim(text) <> '') AS text,
  coalesce(array_to_string({_ordered_distinct("list(el ORDER BY ord) FILTER (WHERE el IS NOT NULL)")}, ','), '') AS kinds FROM g GROUP BY version_id, so, grp)
SELECT version_id, so AS section_order, CAST(row_number() OVER (PARTITION BY version_id ORDER BY so, grp) - 1 AS INTEGER) AS group_order, dependency, page_start, page_end, blocks, kinds, CAST(len({_tokens("text")}) AS INTEGER) AS token_count, sha256(text) AS content FROM m WHERE text <> ''"""
)
def dependency_groups(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as paragraphs, equations and figures, with the blocks that belong to them in one group."""
    t, text, conv = F.col("turn"), F.col("text"), F.col("conv_id")
    kinds = F.when(t % 6 == 0, "heading").when(t % 6 == 2, "equation").otherwise("paragraph")
    said = F.when(t % 6 == 2, F.concat(F.lit("Equation "), t, F.lit(": "), text)).when((t % 6 == 3) & (conv % 2 == 0), F.concat(F.lit("where "), text)).when(t % 6 == 4, F.concat(F.lit("Figure "), t, F.lit(": "), text))
    said = said.when((t % 6 == 5) & (conv % 3 == 0), F.concat(text, F.lit(" (see Figure "), t - 1, F.lit(")"))).otherwise(text)
    section = F.floor(t / 6).cast("int")
    located = table(spark, d, "conversations").select(
        conv.alias("version_id"), section.alias("section_order"), F.concat(F.lit("S"), section).alias("section_path"), t.cast("int").alias("block_order"), F.concat(F.lit("b"), t).alias("block_id"),
        kinds.alias("block_type"), said.alias("text"), (F.floor(t / 4) + 1).cast("int").alias("page_number"),
    )
    return S.groups(located).select(
        "version_id", "section_order", "group_order", "dependency", "page_start", "page_end", F.array_join("source_block_ids", ",").alias("blocks"), F.array_join("element_types", ",").alias("kinds"), "token_count", F.sha2("text", 256).alias("content")
    )


@query(
    """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
p AS (SELECT doc_id, i // 40 + 1 AS page, '<!-- page ' || (i // 40 + 1) || ' -->' || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY i) AS p FROM l WHERE trim(line) <> '' GROUP BY 1, 2)
SELECT doc_id, sha256(string_agg(p, chr(10) || chr(10) ORDER BY page)) AS markdown FROM p GROUP BY 1"""
)
def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    return S.markdown(S.blocks_of(spread(table(spark, d, "documents")))).select(F.col("version_id").alias("doc_id"), F.sha2("markdown", 256).alias("markdown"))


@query(
    """
WITH p AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\x0b\\f\\r]'), lambda v: lower(trim(regexp_replace(v, '\\s+', ' ', 'g')))), lambda v: v <> '') AS l FROM conversations WHERE text IS NOT NULL),
e AS (SELECT conv_id, turn, unnest(list_distinct(list_concat(l[1:2], CASE WHEN len(l) > 2 THEN l[-2:] ELSE l END))) AS line FROM p),
n AS (SELECT conv_id, count(*) AS pages FROM p GROUP BY 1), f AS (SELECT conv_id, line, count(*) AS k FROM e GROUP BY 1, 2),
r AS (SELECT f.conv_id, f.line FROM f JOIN n USING (conv_id) WHERE pages >= 2 AND k >= greatest(2, (pages + 1) // 2)),
x AS (SELECT conv_id, turn, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM p),
k AS (SELECT x.* FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = x.conv_id AND r.line = x.line) AND NOT regexp_matches(x.line, '(?i)^(?:page\\s+)?\\d+(?:\\s+of\\s+\\d+)?$'))
SELECT n.conv_id, sha256(string_agg(line, chr(10) ORDER BY turn, i)) AS content_hash FROM n LEFT JOIN k USING (conv_id) GROUP BY 1"""
)
def edge_clean_conversations(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's turns as pages: lines at the edges of many of them, and page numbers, go before the hash."""
    g = table(spark, d, "conversations").where("text is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return g.select("conv_id", X.content_fingerprint(F.array_join(F.transform("t", lambda x: x["text"]), "\f")).alias("content_hash"))


# ---- text rules

_FOCUSED = "trim(regexp_replace(regexp_replace({0}, '[^\\pL\\pM\\pN_一-鿿-]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_PHRASES = "b.bare"
for _phrase in X.QUESTION_PHRASES:
    _PHRASES = f"replace({_PHRASES}, '{_phrase}', ' ')"


@query(
    f"""
WITH a AS (SELECT item_id, {_sql_collapse("text")} AS asked FROM benchmark), b AS (SELECT *, regexp_replace(asked, '[?？。]+$', '') AS bare FROM a),
f AS (SELECT item_id, list_filter([asked, bare, {_FOCUSED.format(_PHRASES)}], lambda v: v <> '') AS l FROM b)
SELECT item_id, array_to_string(({_ordered_distinct("l")})[1:4], '|') AS rewrites, regexp_replace(array_to_string(l[1:1], ''), '[.!?。！？]+$', '') || ' method details' AS followup FROM f"""
)
def question_rewrites(spark: SparkSession, d: str) -> DataFrame:
    """All forms of a question, and its follow-up without open questions."""
    b = table(spark, d, "benchmark")
    more = X.followups("text", F.array().cast("array<string>"), "method details")
    return b.select("item_id", F.array_join(X.rewrites("text"), "|").alias("rewrites"), F.get(more, F.lit(0)).alias("followup"))


#: Parts as files: names with and without venues and years, first pages with others.
_FILES = """
f AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'CVPR-2021-' || replace(p_name, ' ', '_') || '.pdf' WHEN 1 THEN 'ICML22 ' || p_name || '-Paper-Conference.pdf' WHEN 2 THEN p_name || ' (2019).PDF'
    WHEN 3 THEN 'papers on video grounding ' || p_brand || '.pdf' ELSE 'weakly-supervised video moment retrieval ' || p_partkey || '.pdf' END AS file_name,
  CASE p_partkey % 7 WHEN 0 THEN 'Proceedings of ACM Multimedia 2018. doi:10.1145/' || p_partkey || '.77, 10.1145/' || p_partkey || '.77' WHEN 1 THEN 'Copyright 2017 ' || p_type WHEN 2 THEN 'ICCVW workshop. AAAI. 10.1109/x' || p_size || ');' ELSE p_type END AS text,
  sha256(p_name) AS file_hash, CAST(p_size AS BIGINT) AS file_size, CAST(p_size AS INTEGER) AS pages FROM part)"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    file = F.when(k % 5 == 0, F.concat(F.lit("CVPR-2021-"), F.replace(name, F.lit(" "), F.lit("_")), F.lit(".pdf"))).when(k % 5 == 1, F.concat(F.lit("ICML22 "), name, F.lit("-Paper-Conference.pdf"))).when(k % 5 == 2, F.concat(name, F.lit(" (2019).PDF")))
    file = file.when(k % 5 == 3, F.concat(F.lit("papers on video grounding "), F.col("p_brand"), F.lit(".pdf"))).otherwise(F.concat(F.lit("weakly-supervised video moment retrieval "), k, F.lit(".pdf")))
    text = F.when(k % 7 == 0, F.concat(F.lit("Proceedings of ACM Multimedia 2018. doi:10.1145/"), k, F.lit(".77, 10.1145/"), k, F.lit(".77"))).when(k % 7 == 1, F.concat(F.lit("Copyright 2017 "), F.col("p_type")))
    text = text.when(k % 7 == 2, F.concat(F.lit("ICCVW workshop. AAAI. 10.1109/x"), F.col("p_size"), F.lit(");"))).otherwise(F.col("p_type"))
    return table(spark, d, "part").select(k.alias("id"), file.alias("file_name"), text.alias("text"), F.sha2(name, 256).alias("file_hash"), F.col("p_size").cast("long").alias("file_size"), F.col("p_size").cast("int").alias("pages"))


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


def _sql_matches(x: str, patterns: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({x}, '{_re2(p)}') THEN '{n}' END" for n, p in patterns) + "], lambda v: v IS NOT NULL)"


_VENUE_TITLE = (
    "regexp_replace(regexp_replace(regexp_replace(file_name, '\\.[^.]+$', ''), '(?i)^(?:AAAI|ACL|CVPR|ICCV|ICML|ICLR|NEURIPS|ACMMM|MM|TPAMI|TMM|TCSVT|TIP|ARXIV|PR)[-_ ]*\\d{2,4}[-_ ]*', ''), "
    "'(?i)(?:_CVPR_\\d{4}_paper|-Paper-Conference|\\((?:AAAI|CVPR|ICCV|ICLR|TMM)?\\d{4}\\))$', '')"
)
_VENUE_TITLE = f"regexp_replace({_sql_collapse(f'''regexp_replace({_VENUE_TITLE}, '_+', ' ', 'g')''')}, '^[ -]+|[ -]+$', '', 'g')"
_YEAR = (
    "coalesce(TRY_CAST(" + _FIRST.format("file_name", "(?:^|\\D)(20\\d{2})(?:\\D|$)") + " AS INTEGER), TRY_CAST(" + _FIRST.format("file_name", "(?i)\\b(?:AAAI|ACL|CVPR|ICCV|ICML|ICLR|NEURIPS|MM|TPAMI|TMM|TIP)[-_ ]?(\\d{2})\\b")
    + " AS INTEGER) + 2000, TRY_CAST(" + _FIRST.format("text", "(?is)(?:©|Copyright|Proceedings of|Conference on).*?\\b(20\\d{2})\\b") + " AS INTEGER))"
)


@query(
    f"""
WITH {_FILES}, t AS (SELECT *, {_VENUE_TITLE} AS title FROM f),
m AS (SELECT *, {_sql_matches("file_name", C.VENUES)} AS vf, {_sql_matches("text", C.VENUES)} AS vt, file_name || chr(10) || title || chr(10) || text AS whole FROM t)
SELECT id, substr(file_hash, 1, 16) AS paper_key, title, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS title_normalized, {_YEAR} AS year, coalesce(vf[1], vt[1]) AS venue,
  CASE WHEN len(vf) > 0 THEN 'filename' WHEN len(vt) > 0 THEN 'first_pages' ELSE 'unknown' END AS venue_source, array_to_string({_sql_matches("whole", C.METHODS)}, ',') AS methods,
  array_to_string({_sql_matches("whole", C.TOPICS)}, ',') AS topics, array_to_string({_sql_matches("whole", C.EXCLUSIONS)}, ',') AS exclusions FROM m"""
)
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    """What files' names and first pages tell: title, year, venue, methods, topics, reasons to leave them out."""
    rows = C.inventory(_files(spark, d), ("id",))
    joined = {c: F.array_join(c, ",") for c in ("methods", "topics", "exclusions")}
    return rows.select("id", "paper_key", "title", "title_normalized", "year", "venue.venue", F.col("venue.source").alias("venue_source"), *(v.alias(c) for c, v in joined.items()))


@query(
    f"""
WITH {_FILES}, t AS (SELECT *, {_VENUE_TITLE} AS title, file_name || chr(10) || {_VENUE_TITLE} || chr(10) || text AS whole, coalesce(({_sql_matches("file_name", C.VENUES)})[1], ({_sql_matches("text", C.VENUES)})[1]) AS venue FROM f),
g AS (SELECT file_hash, count(*) AS n, count(*) FILTER (venue IS NOT NULL) AS c, count(*) FILTER (len({_sql_matches("whole", C.TOPICS)}) > 0) AS t, count(*) FILTER (venue IS NOT NULL AND len({_sql_matches("whole", C.TOPICS)}) > 0) AS b FROM t GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS files, count(*) AS contents, CAST(sum(c) AS BIGINT) AS of_class, CAST(sum(t) AS BIGINT) AS on_topic, CAST(sum(b) AS BIGINT) AS both, count(*) FILTER (n > 1) AS copy_groups FROM g"""
)
def corpus_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = C.inventory(_files(spark, d))
    return C.corpus_summary(rows.select("file_hash", "topics", F.col("venue.venue").alias("venue")))


_SCOPE = "(?i)video (?:temporal )?grounding|moment retrieval"


@query(
    f"""
WITH {_FILES}, t AS (SELECT *, {_VENUE_TITLE} AS title, coalesce(({_sql_matches("file_name", C.VENUES)})[1], ({_sql_matches("text", C.VENUES)})[1]) AS venue FROM f),
p AS (SELECT *, trim(regexp_replace(regexp_replace(replace(lower(title), '&', ' and '), '\\b(?:paper|conference)\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS plain, file_name || chr(10) || title || chr(10) || text AS whole FROM t)
SELECT id, CASE WHEN list_contains({_sql_matches("whole", C.EXCLUSIONS)}, 'workshop') THEN 'workshop_or_non_regular_track'
  {" ".join(f"WHEN regexp_matches(title, '{_re2(p)}') OR regexp_matches(plain, '{_re2(p)}') THEN '{n}'" for n, p in C.TITLE_EXCLUSIONS)}
  WHEN coalesce(venue NOT IN ({", ".join(f"'{v}'" for v in sorted({v for v, _ in C.FULL_NAMES}))}), true) THEN 'not_of_the_class' WHEN NOT (regexp_matches(title, '{_SCOPE}') OR regexp_matches(plain, '{_SCOPE}')) THEN 'outside_title_scope' END AS reason,
  CASE WHEN regexp_matches(title, '{_re2(C.METHODS[0][1])}') THEN 'weakly_supervised' ELSE 'fully_supervised' END AS paradigm FROM p"""
)
def title_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """The cascade of reasons to leave a record out, and its paradigm."""
    rows = C.inventory(_files(spark, d), ("id",))
    reason = C.title_exclusion(F.col("title"), F.col("venue.venue"), F.col("exclusions"), _SCOPE)
    return rows.select("id", reason.alias("reason"), C.primary_paradigm(C.paradigm_tags("title")).alias("paradigm"))


@query(
    f"""
WITH {_FILES}, e AS (SELECT id, list_transform(regexp_extract_all(text, '(?i)\\b(10\\.\\d{{4,9}}/[-._;()/:a-z0-9]+)', 1), lambda v: regexp_replace(v, '[.,;:)\\]}}]+$', '')) AS l, {_sql_matches("text", C.VENUES)} AS venues, pages FROM f)
SELECT id, array_to_string({_ordered_distinct("l")}, ',') AS dois, array_to_string(venues, ',') AS venues, coalesce(list_contains(venues, 'AAAI'), false) AS expected_found, least(3, pages) AS pages_examined FROM e"""
)
def pdf_proofs(spark: SparkSession, d: str) -> DataFrame:
    e = _files(spark, d).select("id", C.pdf_evidence("text", F.lit("AAAI"), "pages").alias("e"))
    return e.select("id", F.array_join("e.dois", ",").alias("dois"), F.array_join("e.venues", ",").alias("venues"), "e.expected_found", "e.pages_examined")


#: Suppliers as release records with two registries' answers.
_RECORDS = """
r AS (SELECT s_suppkey AS id, s_name, s_acctbal, abs(s_suppkey * 37 % 100) / 100.0 AS s1, abs(s_suppkey * 53 % 100) / 100.0 AS s2, s_suppkey % 3 = 0 AS has1, s_suppkey % 4 <> 0 AS has2 FROM supplier)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("s_suppkey"), F.col("s_name")
    score = lambda m: (k * m % 100) / F.lit(100.0)
    match = lambda on, tag, m, year, who: F.when(on, F.struct(F.concat(name, F.lit(tag)).alias("title"), score(m).alias("score"), F.lit(year).alias("year"), who.alias("authors")))
    none = F.array().cast("array<string>")
    return table(spark, d, "supplier").select(
        k.alias("id"), F.concat(F.lit("x"), k).alias("title"), F.lit(2001).alias("year"), match(k % 3 == 0, " first", 37, 2011, F.when(k % 2 == 0, F.array(name)).otherwise(none)).alias("first"),
        match(k % 4 != 0, " second", 53, 0, F.array(F.lit("B"), name)).alias("second"), F.when(k % 5 == 0, F.lit("Untitled")).otherwise(F.concat(F.lit("  a  title of its own "), k)).alias("file_title"),
        F.array(F.concat(F.lit("10.1/"), k % 7)).alias("dois"), (k % 2 == 0).alias("verified"),
    )


@query(
    f"""
WITH {_RECORDS}, t AS (SELECT *, coalesce(CASE WHEN has1 AND s1 >= 0.86 THEN s_name || ' first' END, CASE WHEN has2 AND s2 >= 0.86 THEN s_name || ' second' END, CASE WHEN id % 5 <> 0 AND length('a title of its own ' || id) >= 18 THEN 'a title of its own ' || id END, 'x' || id) AS title FROM r)
SELECT id, CASE WHEN id % 9 = 2 AND title = 'a title of its own ' || id THEN 'Corrected ' || id ELSE title END AS title, CASE WHEN id % 9 = 2 AND title = 'a title of its own ' || id THEN 1999 WHEN has1 THEN 2011 ELSE 2001 END AS year,
  CASE WHEN has1 AND id % 2 = 0 THEN s_name WHEN has2 THEN 'B,' || s_name ELSE '' END AS authors,
  array_to_string(list_filter([CASE WHEN has1 AND id % 2 = 0 THEN 'first_registry' END, CASE WHEN has2 THEN 'second_registry' END, CASE WHEN id % 6 = 0 THEN 'published_marker' END, CASE WHEN id % 5 = 1 THEN 'official_page' END], lambda v: v IS NOT NULL), ',') AS proofs,
  CASE WHEN has1 THEN '10.9/' || id || ',' ELSE '' END || '10.1/' || (id % 7) AS dois FROM t"""
)
def release_records(spark: SparkSession, d: str) -> DataFrame:
    """Title, year and authors by precedence and corrections, proofs of the venue, all identifiers."""
    rows = _records(spark, d)
    k = F.col("id")
    fixes = rows.where(k % 9 == 2).select(F.concat(F.lit("a title of its own "), k).alias("key"), F.concat(F.lit("Corrected "), k).alias("title"), F.lit(1999).alias("year"))
    out = C.release(rows, fixes).withColumn("proofs", C.venue_proofs(F.col("first"), F.col("verified"), F.col("second"), F.lit(True), k % 6 == 0, F.when(k % 5 == 1, F.lit("page"))))
    own = F.when(F.col("first").isNotNull(), F.array(F.concat(F.lit("10.9/"), k)))
    return out.select("id", F.col("release_title").alias("title"), F.col("release_year").alias("year"), F.array_join("release_authors", ",").alias("authors"), F.array_join("proofs", ",").alias("proofs"), F.array_join(C.doi_union(own, F.col("dois")), ",").alias("dois"))


@query(
    f"""
WITH {_RECORDS}, t AS (SELECT id, CASE WHEN has1 AND s1 >= 0.86 THEN s_name || ' first' ELSE 'x' || id END AS title_chosen FROM r)
SELECT id, title_chosen, CASE WHEN id % 2 = 0 THEN 'CVPR' ELSE 'TIP' END AS venue_chosen, CASE WHEN id % 2 = 0 THEN 'registry' ELSE 'inferred' END AS venue_proof, 'fully_supervised' AS paradigm_primary,
  CASE id % 4 WHEN 0 THEN 'ACL' WHEN 1 THEN 'NEURIPS' WHEN 2 THEN NULL ELSE 'TPAMI' END AS short, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'IJCV' WHEN 2 THEN 'ICML' ELSE 'CVPR' END AS full_name FROM t"""
)
def candidate_records(spark: SparkSession, d: str) -> DataFrame:
    """Chosen titles and venues, and the classes of short and full venue names."""
    k = F.col("id")
    rows = _records(spark, d).withColumns({"registry": F.col("first"), "venue_verified": F.when(F.col("verified"), "CVPR"), "venue": F.lit("TIP")})
    short = F.when(k % 4 == 0, "ACL (12)").when(k % 4 == 1, " NIPS ").when(k % 4 == 2, "Some Workshop").otherwise("IEEE Trans. Pattern  Anal. Mach. Intell.")
    names = F.when(k % 4 == 0, F.array(F.lit("A journal"))).when(k % 4 == 1, F.array(F.lit("x"), F.lit("international journal of computer vision"))).when(k % 4 == 2, F.array(F.lit("39th International Conference on Machine Learning"))).otherwise(F.array(F.lit("Proc. CVPR"), F.lit("ICLR")))
    return C.candidates(rows).select("id", "title_chosen", "venue_chosen", "venue_proof", "paradigm_primary", C.venue_class(short).alias("short"), C.venue_of_names(names).alias("full_name"))


@query(
    """
WITH e AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents),
s AS (SELECT lang, doc_id FROM e WHERE n <= 5 OR i IN (SELECT CAST(round_even(k * (e.n - 1) / 4.0, 0) AS BIGINT) FROM range(5) t(k))),
f AS (SELECT d.lang, d.doc_id, row_number() OVER (PARTITION BY d.lang ORDER BY d.n_chars, d.doc_id) - 1 AS i, count(*) OVER (PARTITION BY d.lang) AS n FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM s)),
r AS (SELECT lang, doc_id FROM f WHERE n <= 20 OR i IN (SELECT CAST(round_even(k * (f.n - 1) / 19.0, 0) AS BIGINT) FROM range(20) t(k)))
SELECT d.doc_id, d.lang, CASE WHEN s.doc_id IS NOT NULL THEN 'smoke' WHEN r.doc_id IS NOT NULL THEN 'regression' END AS split FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id"""
)
def split_by_language(spark: SparkSession, d: str) -> DataFrame:
    """Smoke and regression sets of each language (sampling operators: their sizes are the feature)."""
    by = [F.asc("n_chars"), F.asc("doc_id")]
    return C.stratified_split(table(spark, d, "documents"), "doc_id", "lang", {"smoke": 5, "regression": 20}, by).select("doc_id", "lang", "split")


@query(
    """
WITH x AS (SELECT doc_id, CASE WHEN lang NOT IN ('en', 'de') THEN 'language' WHEN n_chars < 100 THEN 'short' END AS reason, n_chars FROM documents)
SELECT doc_id, reason FROM x WHERE reason IN ('language', 'short') ORDER BY n_chars DESC, doc_id LIMIT 20"""
)
def nearest_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """The twenty excluded documents that come nearest to belonging (a report of fixed length)."""
    docs = table(spark, d, "documents").withColumn("reason", C.exclusion([("language", ~F.col("lang").isin("en", "de")), ("short", F.col("n_chars") < 100)]))
    return C.hard_negatives(docs, ["language", "short"], [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id", "reason")


# ---- reading and the index


@query(
    f"""
WITH {_CHUNKS}, m AS (SELECT * FROM c WHERE page_end >= 2 AND page_start <= 3 AND list_contains(related_element_ids, '2') AND chunk_type IN ('user', 'assistant'))
SELECT DISTINCT c.chunk_id, c.section_id FROM c JOIN m ON m.version_id = c.version_id AND abs(c.chunk_order - m.chunk_order) <= 1"""
)
def read_passages(spark: SparkSession, d: str) -> DataFrame:
    """Chunks on pages 2 to 3 that belong to an element, of given types, with their neighbours."""
    return D.read_chunks(_chunks(spark, d), pages=(2, 3), element="2", types=["user", "assistant"], radius=1).select("chunk_id", "section_id")


@query(
    f"""
WITH {_CHUNKS}, e AS (SELECT version_id, chunk_id AS element_id, CASE WHEN chunk_order % 4 = 0 THEN NULL ELSE section_id END AS section_id, chunk_type AS element_type, page_start AS page FROM c)
SELECT element_id, page, CASE WHEN section_id IS NULL THEN '' ELSE 'S' || (section_id % 10) END AS section_path FROM e WHERE page BETWEEN 2 AND 4 AND element_type = 'assistant'"""
)
def read_page_elements(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    e = c.select("version_id", F.col("chunk_id").alias("element_id"), F.when(F.col("chunk_order") % 4 != 0, F.col("section_id")).alias("section_id"), F.col("chunk_type").alias("element_type"), F.col("page_start").alias("page"))
    return D.read_elements(e, _sections(c), pages=(2, 4), types=["assistant"]).select("element_id", "page", "section_path")


@query(
    """
WITH f AS (SELECT o_custkey % 50 AS project_id, o_orderkey % 97 AS paper_id, o_custkey AS version_id, o_orderstatus = 'F' AS canon, o_orderdate AS made FROM orders),
b AS (SELECT project_id, paper_id, version_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id, paper_id ORDER BY canon DESC, made DESC, version_id) AS n FROM f) WHERE n = 1),
q AS (SELECT c_custkey AS request_id, c_custkey % 60 AS project_id, c_custkey % 101 AS paper_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS version_id FROM customer)
SELECT q.request_id, CASE WHEN b.version_id IS NULL THEN 'paper_not_found' WHEN q.version_id IS NOT NULL AND h.version_id IS NULL THEN 'version_not_found' ELSE 'ok' END AS status,
  CASE WHEN b.version_id IS NULL OR q.version_id IS NOT NULL AND h.version_id IS NULL THEN NULL ELSE coalesce(q.version_id, b.version_id) END AS version_id
FROM q LEFT JOIN b USING (project_id, paper_id) LEFT JOIN (SELECT DISTINCT project_id, paper_id, version_id FROM f) h ON h.project_id = q.project_id AND h.paper_id = q.paper_id AND h.version_id = q.version_id"""
)
def owned_versions(spark: SparkSession, d: str) -> DataFrame:
    """Which version each request reads: its own if the project has it, else the canonical and newest."""
    f = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("project_id"), (F.col("o_orderkey") % 97).alias("paper_id"), F.col("o_custkey").alias("version_id"), (F.col("o_orderstatus") == "F").alias("is_canonical"), F.col("o_orderdate").alias("updated_at"))
    k = F.col("c_custkey")
    q = table(spark, d, "customer").select(k.alias("request_id"), (k % 60).alias("project_id"), (k % 101).alias("paper_id"), F.when(k % 3 == 0, k).alias("version_id"))
    return D.owned_version(f, q).select("request_id", "status", "version_id")


_INDEX = f"""
{_CHUNKS}, s AS (SELECT version_id, section_id, min(chunk_order) AS section_order, 'S' || (section_id % 10) AS section_path FROM c GROUP BY 1, 2),
cs AS (SELECT version_id, section_id, substr(string_agg(text, chr(10) ORDER BY chunk_order, chunk_id), 1, 8000) AS t FROM c GROUP BY 1, 2),
cv AS (SELECT version_id, substr(string_agg(text, chr(10) ORDER BY chunk_order, chunk_id), 1, 8000) AS t FROM c GROUP BY 1),
sp AS (SELECT version_id, string_agg(section_path, chr(10) ORDER BY section_order, section_path) AS t FROM s GROUP BY 1),
ix AS (
  SELECT 'paper' AS level, CAST(v.version_id % 10 AS VARCHAR) AS target_id, v.version_id, trim('Paper ' || (v.version_id % 10) || chr(10) || 'p' || (v.version_id % 10) || ' alias' || chr(10) || 'CVPR' || chr(10) || sp.t || chr(10) || cv.t) AS text FROM cv v JOIN cv USING (version_id) JOIN sp USING (version_id)
  UNION ALL SELECT 'section', CAST(s.section_id AS VARCHAR), s.version_id, trim(substr(s.section_path || coalesce(chr(10) || cs.t, ''), 1, 8000)) FROM s JOIN cs USING (version_id, section_id)
  UNION ALL SELECT 'chunk', CAST(c.chunk_id AS VARCHAR), c.version_id, trim('S' || (c.section_id % 10) || coalesce(chr(10) || c.text, '')) FROM c)"""


def _index(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d)
    p = F.col("paper_id").cast("string")
    papers = c.select("paper_id", "version_id").distinct().select(
        "paper_id", "version_id", F.concat(F.lit("Paper "), p).alias("canonical_title"), F.array(F.concat(F.lit("p"), p), F.lit("alias")).alias("aliases"), F.array().cast("array<string>").alias("authors"),
        F.lit("CVPR").alias("venue"), F.lit(None).cast("string").alias("abstract"),
    )
    return D.index_documents(papers, _sections(c), c.drop("paper_id"))


@query(f"WITH {_INDEX} SELECT level, target_id, version_id, sha256(level || chr(10) || text) AS content_hash FROM ix")
def index_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of papers, sections and chunks for the index, by their hashes."""
    return _index(spark, d).select("level", "target_id", "version_id", "content_hash")


@query(
    f"""
WITH {_INDEX}, h AS (SELECT *, sha256(level || chr(10) || text) AS content_hash FROM ix), k AS (SELECT DISTINCT content_hash FROM h WHERE version_id % 3 = 0)
SELECT level, count(*) AS documents, count(*) FILTER (k.content_hash IS NULL) AS generated, count(*) FILTER (k.content_hash IS NOT NULL) AS reused FROM h LEFT JOIN k USING (content_hash) GROUP BY 1"""
)
def index_reports(spark: SparkSession, d: str) -> DataFrame:
    """How many texts of each level have a vector already."""
    docs = _index(spark, d)
    return D.index_report(docs, docs.where("version_id % 3 = 0"))


@query(f"WITH {_INDEX}, h AS (SELECT *, level || ':' || target_id || ':' || sha256(level || chr(10) || text) AS line FROM ix) SELECT version_id, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM h GROUP BY 1")
def source_digests(spark: SparkSession, d: str) -> DataFrame:
    return D.source_digest(_index(spark, d))


@query(
    """
WITH b AS (SELECT l_orderkey % 500 AS version_id, l_linenumber - 1 AS page, l_partkey % 40 AS block, l_suppkey % 30 AS ord FROM lineitem),
p AS (SELECT version_id, page, min(page) < 1 AS low, count(DISTINCT block) < count(*) AS db, count(DISTINCT ord) < count(*) AS dr FROM b GROUP BY 1, 2),
a AS (SELECT DISTINCT version_id, min(page) AS page FROM b GROUP BY version_id, block HAVING count(DISTINCT page) > 1)
SELECT version_id, page AS page_number, 'page_below_1' AS issue FROM p WHERE low UNION ALL SELECT version_id, page, 'duplicate_block_id' FROM p WHERE db UNION ALL SELECT version_id, page, 'duplicate_reading_order' FROM p WHERE dr
UNION ALL SELECT version_id, page, 'block_id_on_several_pages' FROM a"""
)
def block_checks(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("version_id"), (F.col("l_linenumber") - 1).alias("page_number"), (F.col("l_partkey") % 40).alias("block_id"), (F.col("l_suppkey") % 30).alias("reading_order"))
    return D.block_issues(x)


@query(
    """
WITH s AS (SELECT c_nationkey AS version_id, c_custkey % 40 AS id, CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 53 END AS parent FROM customer), e AS (SELECT s_nationkey AS version_id, s_suppkey % 20 AS id, s_suppkey % 45 AS section FROM supplier)
SELECT version_id, CAST(id AS VARCHAR) AS id, 'duplicate_section' AS issue FROM s GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT version_id, CAST(id AS VARCHAR), 'duplicate_element' FROM e GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT version_id, CAST(id AS VARCHAR), 'unknown_parent' FROM s WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s t WHERE t.version_id = s.version_id AND t.id = s.parent)
UNION ALL SELECT version_id, CAST(id AS VARCHAR), 'unknown_section' FROM e WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.version_id = e.version_id AND t.id = e.section)"""
)
def structure_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    s = table(spark, d, "customer").select(F.col("c_nationkey").alias("version_id"), (k % 40).alias("section_id"), F.when(k % 7 == 0, k % 53).alias("parent_section_id"))
    e = table(spark, d, "supplier").select(F.col("s_nationkey").alias("version_id"), (F.col("s_suppkey") % 20).alias("element_id"), (F.col("s_suppkey") % 45).alias("section_id"))
    return D.structure_issues(s, e)


@query(
    """
SELECT event_id, array_to_string(list_filter([CASE WHEN event_type = 'error' THEN 'blank_query' END, CASE WHEN NOT (user_id % 60 BETWEEN 1 AND 50) THEN 'max_evidence' END, CASE WHEN value / 100 > 1 OR value < 0 THEN 'min_relevance' END], lambda v: v IS NOT NULL), ',') AS issues,
  length(CAST(user_id AS VARCHAR)) = 64 AS sound FROM events"""
)
def request_checks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    issues = D.request_issues(F.when(F.col("event_type") == "error", "  ").otherwise(F.col("event_type")), F.col("user_id") % 60, F.col("value") / 100)
    return e.select("event_id", F.array_join(issues, ",").alias("issues"), D.well_formed_hash(F.col("user_id").cast("string")).alias("sound"))


@query("SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey")
def required_parts(spark: SparkSession, d: str) -> DataFrame:
    """Every line finds its part; one that didn't would be an error."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return D.required(x, table(spark, d, "part").select("p_partkey", "p_brand"), ["p_partkey"], "no such part").select("l_orderkey", "l_linenumber", "p_brand")


# ---- retrieval


@query(
    """
WITH q AS (SELECT n_nationkey AS query_id, lower('Which orders of ' || n_name || ' in' || r_name || '?') AS q FROM nation JOIN region ON r_regionkey = n_regionkey),
p AS (SELECT n_nationkey AS paper_id, lower(n_name) AS name, false AS a FROM nation UNION ALL SELECT 100 + r_regionkey, lower(r_name), false FROM region UNION ALL SELECT n_nationkey, lower(substr(n_name, 1, 2)), true FROM nation UNION ALL SELECT 200, q, false FROM q WHERE query_id = 3),
m AS (SELECT query_id, paper_id, max(CASE WHEN name = q THEN 1.0 WHEN a THEN 0.98 ELSE 0.92 END) AS score FROM q JOIN p ON contains(q, name) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS n FROM m) SELECT query_id, paper_id, CAST(score AS DOUBLE) AS score FROM r WHERE n <= 5"""
)
def resolved_papers(spark: SparkSession, d: str) -> DataFrame:
    """Papers that questions name, by name and acronym, also inside longer words."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    q = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("Which orders of "), "n_name", F.lit(" in"), "r_name", F.lit("?")).alias("query"))
    named = lambda df, k, name, acronym: df.select(k.cast("int").alias("paper_id"), F.array(name).alias("names"), acronym.cast("string").alias("acronym"))
    papers = named(n, F.col("n_nationkey"), F.col("n_name"), F.substring("n_name", 1, 2)).unionByName(named(r, 100 + F.col("r_regionkey"), F.col("r_name"), F.lit(None)))
    return R.resolve_papers(q, papers.unionByName(named(q.where("query_id = 3"), F.lit(200), F.col("query"), F.lit(None))))


@query(
    f"""
WITH w AS (SELECT doc_id, list_distinct(list_filter({_tokens("lower(text)")}, lambda t: regexp_matches(t, '^[\\pL\\pM\\pN_]+$'))) AS t FROM documents), q AS (SELECT item_id AS query_id, list_distinct(list_filter({_tokens("lower(text)")}, lambda t: regexp_matches(t, '^[\\pL\\pM\\pN_]+$'))) AS t FROM benchmark)
SELECT query_id, count(*) AS found, CAST(sum(doc_id) AS BIGINT) AS ids FROM q JOIN w ON len(list_intersect(q.t, w.t)) > 0 GROUP BY 1"""
)
def full_text_hits(spark: SparkSession, d: str) -> DataFrame:
    """How many documents hold a word of each benchmark item."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return N.of_files(table(spark, d, "documents"), "documents-index").full_text(q).groupBy("query_id").agg(F.count("*").alias("found"), F.sum("doc_id").alias("ids"))


@query(
    """
WITH q AS (SELECT item_id AS query_id, substr(text, 12, 7) AS p FROM benchmark UNION ALL SELECT -1, 'Q' UNION ALL SELECT -2, 'zz')
SELECT query_id, count(*) AS found, CAST(sum(doc_id) AS BIGINT) AS ids FROM q JOIN documents d ON contains(lower(d.text), lower(p)) GROUP BY 1"""
)
def substring_hits(spark: SparkSession, d: str) -> DataFrame:
    """How many documents hold a string out of each benchmark item, and one and two letters, wherever it stands."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 12, 7).alias("pattern"))
    q = q.unionByName(spark.createDataFrame([(-1, "Q"), (-2, "zz")], "query_id long, pattern string"))
    docs = table(spark, d, "documents")
    return N.of_files(docs, "documents-grams", kind=N.SubstringIndex).containing(q, docs).groupBy("query_id").agg(F.count("*").alias("found"), F.sum("doc_id").alias("ids"))


_FUSED = (
    _BM25
    + f""", sp AS (SELECT query_id, doc_id AS chunk_id, bm25 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS k FROM scored WHERE round(bm25, 9) > 0) WHERE k <= 30),
dn AS (SELECT query_id, chunk_id, dense FROM (SELECT b.item_id AS query_id, e.vec_id AS chunk_id, greatest(0, list_cosine_similarity(CAST(s.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) AS dense,
    row_number() OVER (PARTITION BY b.item_id ORDER BY round(greatest(0, list_cosine_similarity(CAST(s.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))), 9) DESC, e.vec_id) AS k
  FROM benchmark b JOIN embeddings s ON s.vec_id = b.item_id JOIN embeddings e ON true) WHERE k <= 30),
fu AS (SELECT coalesce(sp.query_id, dn.query_id) AS query_id, coalesce(sp.chunk_id, dn.chunk_id) AS chunk_id, dense, bm25 FROM sp FULL JOIN dn ON sp.query_id = dn.query_id AND sp.chunk_id = dn.chunk_id),
sc AS (SELECT f.*, b.text AS q, d.text AS x, list_distinct({_tokens("lower(b.text)")}) AS qt, list_distinct({_tokens("lower(d.text)")}) AS xt FROM fu f JOIN benchmark b ON b.item_id = f.query_id JOIN documents d ON d.doc_id = f.chunk_id),
rv AS (SELECT *, round(least(1, least(1, coalesce(dense, 0)) * 0.45 + (1 - exp(-coalesce(bm25, 0) / 3)) * 0.25 + least(1, len(list_intersect(qt, xt)) / len(qt) * 0.85 + CASE WHEN contains(lower(x), trim(lower(q))) THEN 0.15 ELSE 0 END) * 0.30), 9) AS relevance FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, chunk_id) AS n FROM rv WHERE relevance >= 0.22)
SELECT b.item_id AS query_id, rk.chunk_id, round(rk.relevance, 6) AS relevance, CASE WHEN rk.chunk_id IS NULL THEN 'no_evidence' ELSE 'ok' END AS status FROM benchmark b LEFT JOIN rk ON rk.query_id = b.item_id AND rk.n <= 8"""
)


@query(_FUSED)
def fused_search(spark: SparkSession, d: str) -> DataFrame:
    """Evidence for each benchmark item over given vectors: dense and sparse lists, fused, scored, above the threshold, or none."""
    b, e = table(spark, d, "benchmark"), table(spark, d, "embeddings")
    q = b.join(e, b.item_id == e.vec_id, "left").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("embedding").alias("query_vector"))
    docs = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("paper_id"), "text")
    found = R.search(q, docs, e.select(F.col("vec_id").alias("chunk_id"), "embedding"), diverse=False, index=N.of_files(table(spark, d, "documents"), "documents-index"))
    return found.select("query_id", "chunk_id", F.round("relevance", 6).alias("relevance"), "status")


@query(
    """
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_orderkey) AS orders
FROM lineitem WHERE l_linenumber <> 7 GROUP BY ALL"""
)
def merged_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of lines that came in three batches, the second one twice, less the seventh lines, taken away by a fourth."""
    x = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_partkey", "l_orderkey")
    kept = C2.Counters(spark, f"{shared_folder(spark)}/counters-{uuid.uuid4().hex}", ["l_returnflag", "l_linestatus"], ("l_linenumber",), ("l_partkey", "l_orderkey"))
    for batch in (0, 1, 1, 2):
        kept.add(x.where(F.pmod("l_orderkey", F.lit(3)) == batch), str(batch))
    kept.add(x.where("l_linenumber = 7"), "gone", F.lit(-1))
    fs, at = versions.files(spark, kept.path)
    fs.deleteOnExit(at)
    return kept.read().select("l_returnflag", "l_linestatus", "n", F.col("l_linenumber").alias("lines"), F.col("l_partkey_distinct").alias("parts"), F.col("l_orderkey_distinct").alias("orders"))


#: Vectors that both sides make of a text's length, so that SQL can follow them.
_BY_LENGTH = "[length({0}) % 11 + 1.0, length({0}) % 5, length({0}) % 3, 1.0]"

_REWRITTEN = f"""
WITH a AS (SELECT item_id, {_sql_collapse("text")} AS asked FROM benchmark), b AS (SELECT *, regexp_replace(asked, '[?？。]+$', '') AS bare FROM a),
f AS (SELECT item_id, list_filter([asked, bare, {_FOCUSED.format(_PHRASES)}], lambda v: v <> '') AS l FROM b), fl AS (SELECT item_id, ({_ordered_distinct("l")})[1:4] AS l FROM f),
rw AS (SELECT item_id, n, q, item_id * 10 + n AS query_id FROM (SELECT item_id, unnest(l) AS q, generate_subscripts(l, 1) - 1 AS n FROM fl)),
asked AS (SELECT DISTINCT query_id, unnest({_tokens("lower(q)")}) AS term FROM rw),
""" + _BM25[_BM25.index("words AS"):] + f""", sp AS (SELECT query_id, doc_id AS chunk_id, bm25 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS k FROM scored WHERE round(bm25, 9) > 0) WHERE k <= 30),
nv AS (SELECT query_id, doc_id AS chunk_id, list_cosine_similarity(CAST({_BY_LENGTH.format("rw.q")} AS DOUBLE[]), CAST({_BY_LENGTH.format("d.text")} AS DOUBLE[])) AS dense FROM rw JOIN documents d ON true),
dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dense, 9) DESC, chunk_id) AS k FROM nv) WHERE k <= 30),
fu AS (SELECT coalesce(sp.query_id, dn.query_id) AS query_id, coalesce(sp.chunk_id, dn.chunk_id) AS chunk_id, round(dense, 9) AS dense, bm25 FROM sp FULL JOIN dn ON sp.query_id = dn.query_id AND sp.chunk_id = dn.chunk_id),
sc AS (SELECT f.*, rw.item_id, rw.n, rw.q, d.text AS x, list_distinct({_tokens("lower(rw.q)")}) AS qt, list_distinct({_tokens("lower(d.text)")}) AS xt FROM fu f JOIN rw USING (query_id) JOIN documents d ON d.doc_id = f.chunk_id),
rv AS (SELECT *, round(least(1, least(1, coalesce(dense, 0)) * 0.45 + (1 - exp(-coalesce(bm25, 0) / 3)) * 0.25 + least(1, len(list_intersect(qt, xt)) / len(qt) * 0.85 + CASE WHEN contains(lower(x), trim(lower(q))) THEN 0.15 ELSE 0 END) * 0.30), 9) AS relevance FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, chunk_id) AS k FROM rv WHERE relevance >= 0.22),
sd AS (SELECT item_id, chunk_id, n, relevance, row_number() OVER (PARTITION BY item_id ORDER BY n, relevance DESC, chunk_id) AS seed_rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id, chunk_id ORDER BY relevance DESC, n) AS b FROM rk WHERE k <= 8) WHERE b = 1),
pl AS (SELECT sd.*, d.source, d.lang FROM sd JOIN documents d ON d.doc_id = sd.chunk_id),
nb AS (SELECT * FROM (SELECT t.item_id, d.doc_id AS chunk_id, d.text, CASE WHEN d.doc_id = t.chunk_id THEN t.relevance ELSE t.relevance * 0.8 END AS r, row_number() OVER (PARTITION BY t.item_id, d.doc_id ORDER BY CASE WHEN d.doc_id = t.chunk_id THEN 0 ELSE 1 END, seed_rank) AS k
  FROM pl t JOIN documents d ON d.source = t.source AND d.lang = t.lang AND d.doc_id BETWEEN t.chunk_id - 1 AND t.chunk_id + 1) WHERE k = 1),
jd AS (SELECT nb.item_id AS query_id, chunk_id, CASE WHEN len({_tokens("b.text")}) = 0 THEN round(r, 9) ELSE round(least(1, r * 0.7 + len(list_intersect({_tokens("lower(b.text)")}, {_tokens("lower(nb.text)")})) / len(list_distinct({_tokens("lower(b.text)")})) * 0.3), 9) END AS relevance FROM nb JOIN benchmark b USING (item_id)),
tp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, chunk_id) AS k FROM jd WHERE relevance >= 0.2)
SELECT query_id, chunk_id, round(relevance, 6) AS relevance FROM tp WHERE k <= 8"""


@query(_REWRITTEN)
def rewritten_search(spark: SparkSession, d: str) -> DataFrame:
    """Every form of each benchmark item searched at once, the best of each document, its neighbours of the same source and language, judged."""
    docs = table(spark, d, "documents")
    by_length = lambda c: F.array((F.length(c) % 11 + 1).cast("double"), (F.length(c) % 5).cast("double"), (F.length(c) % 3).cast("double"), F.lit(1.0))
    chunks = spread(docs).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("paper_id"), F.col("source").alias("version_id"), F.col("lang").alias("section_id"), F.col("doc_id").alias("chunk_order"), "text")
    vectors = docs.select(F.col("doc_id").alias("chunk_id"), by_length("text").alias("embedding"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = R.search_rewritten(asked, chunks, vectors, by_length, diverse=False, index=N.of_files(docs, "documents-index"))
    return found.select("query_id", "chunk_id", F.round("relevance", 6).alias("relevance"))


_NARROWED = f"""
WITH qs AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN text || ' in ' || (SELECT max(source) FROM documents) ELSE text END AS query FROM benchmark),
pp AS (SELECT DISTINCT source AS paper_id FROM documents WHERE source IS NOT NULL), ss AS (SELECT DISTINCT source AS paper_id, source || ':' || lang AS section_id FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
nm AS (SELECT query_id, paper_id, max(CASE WHEN {_sql_collapse("lower(paper_id)")} = {_sql_collapse("lower(query)")} THEN 1.0 ELSE 0.92 END) AS score FROM qs JOIN pp ON contains({_sql_collapse("lower(query)")}, {_sql_collapse("lower(paper_id)")}) AND paper_id <> '' GROUP BY 1, 2),
nr AS (SELECT query_id, paper_id, round(list_cosine_similarity(CAST({_BY_LENGTH.format("query")} AS DOUBLE[]), CAST({_BY_LENGTH.format("paper_id")} AS DOUBLE[])), 9) AS score FROM qs JOIN pp ON query_id NOT IN (SELECT query_id FROM nm)),
rp AS (SELECT query_id, paper_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS k FROM (SELECT * FROM nm UNION ALL SELECT * FROM nr)) WHERE k <= 2),
rs AS (SELECT query_id, section_id FROM (SELECT query_id, section_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(CAST({_BY_LENGTH.format("query")} AS DOUBLE[]), CAST({_BY_LENGTH.format("section_id")} AS DOUBLE[])), 9) DESC, section_id) AS k
  FROM rp JOIN ss USING (paper_id) JOIN qs USING (query_id)) WHERE k <= 3),
dc AS (SELECT doc_id, source || ':' || lang AS section_id, text, {_tokens("lower(text)")} AS t FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
cd AS (SELECT query_id, doc_id, text, t FROM rs JOIN dc USING (section_id)),
dn AS (SELECT query_id, doc_id AS chunk_id, dense FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, doc_id) AS k FROM (SELECT query_id, doc_id, round(list_cosine_similarity(CAST({_BY_LENGTH.format("query")} AS DOUBLE[]), CAST({_BY_LENGTH.format("text")} AS DOUBLE[])), 9) AS dense FROM cd JOIN qs USING (query_id))) WHERE k <= 30),
aq AS (SELECT DISTINCT query_id, unnest({_tokens("lower(query)")}) AS term FROM qs),
st AS (SELECT query_id, count(*) AS total, avg(len(t)) AS mean FROM cd GROUP BY 1),
tf AS (SELECT doc_id, section_id, term, count(*) AS tf, min(n) AS n FROM (SELECT doc_id, section_id, len(t) AS n, unnest(t) AS term FROM dc) WHERE term IN (SELECT term FROM aq) GROUP BY 1, 2, 3),
mt AS (SELECT query_id, doc_id, term, tf, n FROM tf JOIN rs USING (section_id) JOIN aq USING (query_id, term)), df AS (SELECT query_id, term, count(*) AS df FROM mt GROUP BY 1, 2),
bm AS (SELECT query_id, doc_id, sum(ln(1 + (total - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS bm25 FROM mt JOIN df USING (query_id, term) JOIN st USING (query_id) GROUP BY 1, 2),
sp AS (SELECT query_id, doc_id AS chunk_id, bm25 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, doc_id) AS k FROM bm WHERE round(bm25, 9) > 0) WHERE k <= 30),
fu AS (SELECT coalesce(sp.query_id, dn.query_id) AS query_id, coalesce(sp.chunk_id, dn.chunk_id) AS chunk_id, dense, bm25 FROM sp FULL JOIN dn ON sp.query_id = dn.query_id AND sp.chunk_id = dn.chunk_id),
sc AS (SELECT f.*, query AS q, d.text AS x, list_distinct({_tokens("lower(query)")}) AS qt, list_distinct(d.t) AS xt FROM fu f JOIN qs USING (query_id) JOIN dc d ON d.doc_id = f.chunk_id),
rv AS (SELECT *, round(least(1, least(1, coalesce(dense, 0)) * 0.45 + (1 - exp(-coalesce(bm25, 0) / 3)) * 0.25 + least(1, len(list_intersect(qt, xt)) / len(qt) * 0.85 + CASE WHEN contains(lower(x), trim(lower(q))) THEN 0.15 ELSE 0 END) * 0.30), 9) AS relevance FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, chunk_id) AS n FROM rv WHERE relevance >= 0.22)
SELECT qs.query_id, rk.chunk_id, round(rk.relevance, 6) AS relevance, CASE WHEN rk.chunk_id IS NULL THEN 'no_evidence' ELSE 'ok' END AS status FROM qs LEFT JOIN rk ON rk.query_id = qs.query_id AND rk.n <= 8"""


@query(_NARROWED)
def narrowed_search(spark: SparkSession, d: str) -> DataFrame:
    """Sources that a benchmark item names, else near ones, their nearest languages, and evidence among the documents of these."""
    docs = table(spark, d, "documents")
    by_length = lambda c: F.array((F.length(c) % 11 + 1).cast("double"), (F.length(c) % 5).cast("double"), (F.length(c) % 3).cast("double"), F.lit(1.0))
    placed = docs.where("source is not null and lang is not null").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("paper_id"), F.concat_ws(":", "source", "lang").alias("section_id"), "text")
    papers = docs.where("source is not null").select(F.col("source").alias("paper_id")).distinct().withColumns({"names": F.array("paper_id"), "acronym": F.lit(None).cast("string")})
    sections = placed.select("paper_id", "section_id").distinct().withColumn("embedding", by_length("section_id"))
    named = F.when(F.col("item_id") % 2 == 0, F.concat_ws(" in ", "text", "_named")).otherwise(F.col("text"))
    asked = table(spark, d, "benchmark").join(F.broadcast(docs.agg(F.max("source").alias("_named"))), F.lit(True)).select(F.col("item_id").alias("query_id"), named.alias("query")).withColumn("query_vector", by_length("query"))
    found = R.search_narrowed(asked, papers, papers.select("paper_id", by_length("paper_id").alias("embedding")), sections, placed, placed.select("chunk_id", by_length("text").alias("embedding")), sizes=(2, 3, 30), diverse=False)
    return found.select("query_id", "chunk_id", F.round("relevance", 6).alias("relevance"), "status")


@query(
    """
WITH RECURSIVE m AS (SELECT conv_id, role, turn, round(length(text) % 97 / 97.0, 6) AS rel, length(text) % 50 AS t FROM conversations WHERE text IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY rel DESC, turn) AS k FROM m), f AS (SELECT *, max(rel) OVER (PARTITION BY conv_id, role) AS first FROM r WHERE k <= 4),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k, first DESC, role) AS pos FROM f),
s(conv_id, pos, used, kept) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), false FROM p
  UNION ALL SELECT p.conv_id, p.pos, CASE WHEN s.used + p.t <= 90 THEN s.used + p.t ELSE s.used END, s.used + p.t <= 90 FROM s JOIN p ON p.conv_id = s.conv_id AND p.pos = s.pos + 1)
SELECT s.conv_id, p.turn, CAST(p.pos AS INTEGER) AS position FROM s JOIN p ON p.conv_id = s.conv_id AND p.pos = s.pos WHERE kept"""
)
def budgeted_round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Turns of the roles in turn, what doesn't fit a budget of tokens skipped."""
    c = table(spark, d, "conversations").where("text is not null").withColumns({"relevance": F.round(F.length("text") % 97 / 97.0, 6), "token_count": F.length("text") % 50})
    return R.round_robin(c, 4, budget=90, query_id="conv_id", paper_id="role", chunk_id="turn").select("conv_id", "turn", "position")


# ---- graph

_SAID = (
    "'We propose ' || p_name || '. However, existing methods fail. Datasets include ' || p_brand || ', Beta and Gamma' || (p_size % 3) || '. Metrics: F1 or IoU. ' || CASE p_partkey % 4 WHEN 0 THEN 'We achieve more on ' || p_type || '.' WHEN 1 THEN "
    "'A limitation is ' || p_size || '! In the future we train it.' WHEN 2 THEN 'Baselines are ' || p_type || '. Model called Net-' || (p_size % 9) || '.' ELSE p_name END"
)
_PAPERS = f"k AS (SELECT p_partkey % 100 AS paper_id, p_partkey AS chunk_id, CASE p_partkey % 3 WHEN 0 THEN '3 Method' WHEN 1 THEN '4 Results' ELSE '5 Discussion' END AS path, {_SAID} AS text FROM part)"


def _said(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    tail = F.when(k % 4 == 0, F.concat(F.lit("We achieve more on "), "p_type", F.lit("."))).when(k % 4 == 1, F.concat(F.lit("A limitation is "), size, F.lit("! In the future we train it.")))
    tail = tail.when(k % 4 == 2, F.concat(F.lit("Baselines are "), "p_type", F.lit(". Model called Net-"), size % 9, F.lit("."))).otherwise(F.col("p_name"))
    text = F.concat(F.lit("We propose "), "p_name", F.lit(". However, existing methods fail. Datasets include "), "p_brand", F.lit(", Beta and Gamma"), size % 3, F.lit(". Metrics: F1 or IoU. "), tail)
    path = F.when(k % 3 == 0, "3 Method").when(k % 3 == 1, "4 Results").otherwise("5 Discussion")
    return table(spark, d, "part").select((k % 100).alias("paper_id"), (k % 100).alias("version_id"), k.alias("chunk_id"), F.lit(0).alias("chunk_order"), path.alias("section_path"), text.alias("text"))


def _any_cue(x: str, cues: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{c}')" for c in cues) + ")"


_FIELDS = f"""
{_PAPERS}, sn AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '([.!?。！？])(\\s+)|\\n+', '\\1' || chr(1), 'g'), chr(1)), lambda v: trim(v)), lambda v: v <> '') AS s FROM k),
sent AS (SELECT paper_id, chunk_id, unnest(s) AS v, generate_subscripts(s, 1) - 1 AS i FROM sn),
cand AS (
  {" UNION ALL ".join(f"SELECT paper_id, chunk_id, '{f}' AS field, v AS value, 0.72 AS confidence, i AS place FROM sent WHERE {_any_cue('lower(v)', cues)}" for f, cues in G.FIELD_CUES.items())}
  {" ".join(f"UNION ALL SELECT paper_id, chunk_id, '{f}', s[1], 0.65, -1 FROM sn WHERE len(s) > 0 AND {_any_cue('lower(path)', cues)}" + (f" AND {_any_cue('lower(s[1])', G.FIELD_CUES['key_results'])}" if f == 'key_results' else '') for f, cues in G.SECTION_CUES.items())}
  {" ".join(f'''UNION ALL SELECT paper_id, chunk_id, '{f}', v, 0.82, {100000 * (n + 1)} + j FROM (SELECT paper_id, chunk_id, unnest(l) AS v, generate_subscripts(l, 1) - 1 AS j FROM (SELECT paper_id, chunk_id,
    list_filter(list_transform(flatten(list_transform(regexp_extract_all(text, '{_re2(p)}', 1), lambda v: regexp_split_to_array(v, ',|\\band\\b|\\bor\\b'))), lambda v: regexp_replace(v, '^[ \\t\\n:;,.()\\[\\]]+|[ \\t\\n:;,.()\\[\\]]+$', '', 'g')), lambda v: v <> '' AND length(v) <= 120) AS l FROM k))''' for n, (f, _, p) in enumerate(G.NAMED))}),
norm AS (SELECT *, {_sql_collapse("regexp_replace(trim(lower(value)), '[.!?。！？]+$', '')")} AS normalized FROM cand)"""


@query(
    f"""
WITH {_FIELDS}, fst AS (SELECT *, row_number() OVER (PARTITION BY paper_id, field, normalized ORDER BY chunk_id, place, value) AS n FROM norm WHERE normalized <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY paper_id, field ORDER BY chunk_id, place, value) - 1 AS ordinal FROM fst WHERE n = 1),
t AS (SELECT *, CASE field {" ".join(f"WHEN '{f}' THEN '{c}'" for f, c in G.CLAIM_OF.items())} END AS claim_type FROM o WHERE ordinal < {G.FIELD_VALUES})
SELECT paper_id, claim_type, trim(value) AS statement, normalized AS normalized_statement, CAST(confidence AS DOUBLE) AS confidence, chunk_id FROM t WHERE claim_type IS NOT NULL"""
)
def profile_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims from the first values of each profile field of papers."""
    return G.claims(G.profile(_said(spark, d))).select("paper_id", "claim_type", "statement", "normalized_statement", "confidence", "chunk_id")


@query(
    f"""
WITH {_FIELDS}, t AS (SELECT *, CASE field {" ".join(f"WHEN '{f}' THEN '{e}'" for f, e, _ in G.NAMED)} END AS entity_type FROM norm WHERE confidence = 0.82),
fst AS (SELECT *, row_number() OVER (PARTITION BY paper_id, entity_type, normalized ORDER BY chunk_id, place) AS n FROM t),
r AS (SELECT *, CASE entity_type {" ".join(f"WHEN '{e}' THEN '{x}'" for e, x in G.RELATION_OF.items())} END AS relation_type FROM fst WHERE n = 1)
SELECT paper_id, relation_type, 'Paper ' || replace(relation_type, '_', ' ') || ' ' || value || '.' AS description, chunk_id FROM r WHERE relation_type IS NOT NULL"""
)
def named_relations(spark: SparkSession, d: str) -> DataFrame:
    return G.relations(G.entities(_said(spark, d))).select("paper_id", "relation_type", "description", "chunk_id")


_TWO_TURNS = """
t AS (SELECT conv_id * 1000 + turn AS claim_id, text AS statement, lead(text) OVER w AS e1, lead(text, 2) OVER w AS e2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@query(
    f"""
WITH {_TWO_TURNS}, j AS (SELECT claim_id, list_distinct(regexp_extract_all(lower(statement), '[\\pL\\pN_-]+')) AS s, {_sql_collapse("lower(statement)")} AS st, list_filter([e1, e2], lambda v: v IS NOT NULL) AS es FROM t WHERE statement IS NOT NULL),
x AS (SELECT claim_id, s, es, list_transform(es, lambda e: {{'c': contains({_sql_collapse("lower(e)")}, st) AND len(regexp_extract_all(lower(e), '[\\pL\\pN_-]+')) > 0, 'k': len(regexp_extract_all(lower(e), '[\\pL\\pN_-]+')) > 0,
  'o': len(list_intersect(s, list_distinct(regexp_extract_all(lower(e), '[\\pL\\pN_-]+')))) / len(s), 'n': (len(list_intersect(s, {X.NEGATIONS})) > 0) <> (len(list_intersect(list_distinct(regexp_extract_all(lower(e), '[\\pL\\pN_-]+')), {X.NEGATIONS})) > 0)}}) AS j FROM j),
y AS (SELECT claim_id, CASE WHEN len(s) = 0 OR len(es) = 0 THEN 'insufficient' WHEN len(list_filter(j, lambda v: v.c)) > 0 THEN 'supported' WHEN len(list_filter(j, lambda v: v.k AND v.o >= 0.6 AND v.n)) > 0 THEN 'contradicted'
  WHEN len(list_filter(j, lambda v: v.k AND v.o >= 0.7)) > 0 THEN 'supported' ELSE 'insufficient' END AS entailment_status FROM x)
SELECT claim_id, entailment_status, CASE WHEN entailment_status = 'supported' THEN 'verified' ELSE 'unreviewed' END AS review_status FROM y"""
)
def verified_claims(spark: SparkSession, d: str) -> DataFrame:
    """Turns as claims, the next two turns as their evidence."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("claim_id"), F.col("text").alias("statement"), F.lead("text").over(own).alias("a"), F.lead("text", 2).over(own).alias("b")).where("statement is not null")
    evidence = c.select("claim_id", F.explode(F.array("a", "b")).alias("evidence_text")).where("evidence_text is not null")
    return G.verify_claims(c.select("claim_id", "statement"), evidence).select("claim_id", "entailment_status", "review_status")


@query(
    """
WITH s AS (SELECT DISTINCT s_suppkey AS entity_id, s_nationkey + 1000 AS stored_id FROM supplier WHERE s_suppkey % 2 = 0)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN coalesce(a.stored_id, l_suppkey) ELSE l_suppkey END AS source_id, coalesce(b.stored_id, l_partkey) AS target_id
FROM lineitem LEFT JOIN s a ON a.entity_id = l_suppkey LEFT JOIN s b ON b.entity_id = l_partkey"""
)
def remapped_relations(spark: SparkSession, d: str) -> DataFrame:
    """Entity ends of relations follow to the stored entities."""
    stored = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("entity_id"), (F.col("s_nationkey").cast("long") + 1000).alias("stored_id"))
    kind = F.when(F.col("l_linenumber") % 2 == 0, "entity").otherwise("paper")
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("source_type"), F.col("l_suppkey").alias("source_id"), F.lit("entity").alias("target_type"), F.col("l_partkey").alias("target_id"))
    return G.remap_endpoints(r, stored).select("l_orderkey", "l_linenumber", "source_id", "target_id")


@query(
    """
WITH r AS (SELECT DISTINCT paper, chunk FROM (SELECT l_suppkey % 40 AS paper, l_partkey % 200 AS chunk FROM lineitem)), m AS (SELECT CAST(id AS VARCHAR) AS id, CAST(id + 500 AS VARCHAR) AS new FROM range(10) t(id)),
t AS (SELECT coalesce(m.new, CAST(paper AS VARCHAR)) AS target_id, p_partkey AS chunk_id, p_name AS evidence_text FROM r JOIN part ON p_partkey = chunk LEFT JOIN m ON m.id = CAST(paper AS VARCHAR))
SELECT target_id, chunk_id, sha256('claim' || chr(10) || target_id || chr(10) || chunk_id || chr(10) || 'supports') AS evidence_key, evidence_text FROM t"""
)
def linked_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Links from claims to chunks, once each, of which some targets became others."""
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("claim_id"), (F.col("l_partkey") % 200).alias("chunk_id"), F.lit(0.7).alias("confidence"))
    zero = F.lit(0)
    chunks = table(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), zero.alias("paper_id"), zero.alias("version_id"), zero.alias("section_id"), zero.alias("page_start"), zero.alias("page_end"), F.col("p_name").alias("text"))
    moved = spark.range(10).select(F.lit("claim").alias("target_type"), F.col("id").cast("string").alias("target_id"), (F.col("id") + 500).cast("string").alias("new_id"))
    return G.retarget(G.evidence_links(rows, chunks, "claim", "claim_id"), moved).select("target_id", "chunk_id", "evidence_key", "evidence_text")


@query(
    """
WITH p AS (SELECT o_custkey AS paper_id, o_orderkey AS profile_id, o_orderdate AS made FROM orders WHERE o_orderstatus <> 'P'), r AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY made DESC, profile_id DESC) AS n FROM p)
SELECT paper_id, profile_id FROM r WHERE n = 1"""
)
def newest_profiles(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("profile_id"), F.col("o_orderdate").alias("updated_at"), (F.col("o_orderstatus") != "P").alias("is_active"))
    return G.latest_profiles(p).select("paper_id", "profile_id")


_VALUES = "v AS (SELECT source AS paper_id, lang AS dimension, doc_id, 'v' || (n_chars % 7) AS value, 0.5 + quality / 4.0 AS confidence FROM documents JOIN labels USING (doc_id))"
_CELLS = f"""
{_VALUES}, g AS (SELECT * FROM (SELECT DISTINCT source AS paper_id FROM documents), (SELECT DISTINCT lang AS dimension FROM documents)),
l AS (SELECT paper_id, dimension, list(value ORDER BY doc_id) AS vs, min(confidence) AS confidence, list(DISTINCT doc_id ORDER BY doc_id) AS ev FROM v GROUP BY 1, 2),
ce AS (SELECT g.dimension, g.paper_id, array_to_string({_ordered_distinct("vs")}, ' | ') AS value, confidence, coalesce(ev, []) AS ev FROM g LEFT JOIN l USING (paper_id, dimension)),
st AS (SELECT dimension, count(*) FILTER (len(ev) > 0) >= 2 AS comparable FROM ce GROUP BY 1)"""


def _compared(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    v = docs.join(table(spark, d, "labels"), "doc_id")
    v = v.select(F.col("source").alias("paper_id"), F.col("lang").alias("dimension"), F.col("doc_id").alias("ordinal"), F.concat(F.lit("v"), F.col("n_chars") % 7).alias("value"), (0.5 + F.col("quality") / 4.0).alias("confidence"), F.col("doc_id").alias("chunk_id"))
    return G.compare(docs.select(F.col("source").alias("paper_id")), docs.select(F.col("lang").alias("dimension")), v)


@query(
    f"""
WITH {_CELLS} SELECT ce.dimension, paper_id, value, CAST(confidence AS DOUBLE) AS confidence, array_to_string(ev, ',') AS evidence, comparable,
  CASE WHEN (SELECT bool_and(comparable) FROM st) THEN 'complete' WHEN (SELECT bool_or(comparable) FROM st) THEN 'partial' ELSE 'insufficient_evidence' END AS status FROM ce JOIN st USING (dimension)"""
)
def compared_papers(spark: SparkSession, d: str) -> DataFrame:
    """The grid of languages and sources with joined values, evidence and statuses."""
    return _compared(spark, d).withColumn("evidence", F.array_join(F.col("evidence").cast("array<string>"), ","))


@query(f"WITH {_CELLS}, x AS (SELECT dimension, paper_id, unnest(ev) AS chunk_id FROM ce) SELECT x.dimension, x.paper_id, x.chunk_id, sha256(d.text) AS evidence FROM x JOIN documents d ON d.doc_id = x.chunk_id")
def comparison_evidence(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("evidence_text"))
    return G.flatten_comparison(_compared(spark, d), texts).select("dimension", "paper_id", "chunk_id", F.sha2("evidence_text", 256).alias("evidence"))


@query(
    """
WITH b AS (SELECT 0 AS o, s_nationkey AS t, s_suppkey % 50 AS k, s_name AS name, [s_name || ' a'] AS al, CASE WHEN s_acctbal > 0 THEN s_name || ' d' END AS de FROM supplier
  UNION ALL SELECT 1, c_nationkey, c_custkey % 80, c_name, [c_name || ' a'], CASE WHEN c_acctbal > 5000 THEN c_name || ' d' END FROM customer),
g AS (SELECT t, k, min_by(name, (o, name)) AS name, list_sort(list_distinct(flatten(list(list_append(al, name))))) AS al, min_by(de, (o, de)) FILTER (de IS NOT NULL) AS de FROM b GROUP BY 1, 2)
SELECT CAST(t AS VARCHAR) AS entity_type, CAST(k AS VARCHAR) AS normalized, name AS canonical_name, array_to_string(list_filter(al, lambda v: v <> name), '|') AS aliases, de AS description FROM g"""
)
def merged_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities from two sides: the first name stays, aliases unite, a missing description is filled."""
    side = lambda t, p, m, least: table(spark, d, t).select(
        F.lit(1).alias("project_id"), F.col(f"{p}_nationkey").cast("string").alias("entity_type"), (F.col(m[0]) % m[1]).cast("string").alias("normalized"), F.col(f"{p}_name").alias("canonical_name"),
        F.array(F.concat(f"{p}_name", F.lit(" a"))).alias("aliases"), F.when(F.col(f"{p}_acctbal") > least, F.concat(f"{p}_name", F.lit(" d"))).alias("description"),
    )
    merged = G.merge_entities(side("supplier", "s", ("s_suppkey", 50), 0), side("customer", "c", ("c_custkey", 80), 5000))
    return merged.select("entity_type", "normalized", "canonical_name", F.array_join("aliases", "|").alias("aliases"), "description")


@query(
    """
WITH e AS (SELECT p_partkey AS id, p_name AS name, p_brand AS kind FROM part), a AS (SELECT p_partkey AS id, p_type AS alias FROM part WHERE p_size > 25)
SELECT id AS entity_id, name AS canonical_name FROM e WHERE (contains(lower(name), 'st') OR id IN (SELECT id FROM a WHERE contains(lower(alias), 'st'))) ORDER BY name, id LIMIT 20"""
)
def found_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities by a word in their name or an alias (a report of fixed length)."""
    p = table(spark, d, "part")
    return G.find_entities(p.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("canonical_name"), F.col("p_brand").alias("entity_type")), p.where("p_size > 25").select(F.col("p_partkey").alias("entity_id"), F.col("p_type").alias("alias")), "ST").select("entity_id", "canonical_name")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O' AND (l_partkey IN (3, 5, 8, 13, 21) OR l_suppkey IN (3, 5, 8, 13, 21)) AND l_returnflag IN ('N', 'R')")
def found_relations(spark: SparkSession, d: str) -> DataFrame:
    """Active relations with one of the given ends on either side, of given kinds."""
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("entity").alias("source_type"), F.col("l_partkey").alias("source_id"), F.lit("entity").alias("target_type"), F.col("l_suppkey").alias("target_id"), F.col("l_returnflag").alias("relation_type"), (F.col("l_linestatus") == "O").alias("is_active"))
    return G.find_relations(r, "entity", [3, 5, 8, 13, 21], ["N", "R"]).select("l_orderkey", "l_linenumber")


# ---- workflow


@query(
    """
WITH RECURSIVE w AS (SELECT conv_id, turn, CAST(length(text) % 70 AS BIGINT) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
s(conv_id, k, used, page) AS (
  SELECT conv_id, k, t, 0 FROM w WHERE k = 1
  UNION ALL SELECT w.conv_id, w.k, CASE WHEN s.used > 0 AND s.used + w.t > 120 THEN w.t ELSE s.used + w.t END, s.page + CASE WHEN s.used > 0 AND s.used + w.t > 120 THEN 1 ELSE 0 END FROM s JOIN w ON w.conv_id = s.conv_id AND w.k = s.k + 1)
SELECT s.conv_id, w.turn, s.page FROM s JOIN w ON w.conv_id = s.conv_id AND w.k = s.k"""
)
def artifact_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a conversation's messages under a token budget."""
    c = table(spark, d, "conversations").withColumn("tokens", (F.length("text") % 70).cast("long"))
    return W.page_by_budget(c.select("conv_id", "turn", "tokens"), "conv_id", "turn", "tokens", 120).select("conv_id", "turn", "page")


#: Turns of conversations as answers that cite other turns' labels.
_ANSWERS = "a AS (SELECT conv_id * 1000 + turn AS answer_id, 'So [E' || (turn % 7) || '] and [P' || (turn % 3) || '], [E' || (turn % 7) || '] ' || CASE turn % 5 WHEN 0 THEN 'see [4]' WHEN 1 THEN '<tool_call>' ELSE '' END AS text, turn FROM conversations), "
_ALLOWED = "al AS (SELECT answer_id, 'E' || j AS label, answer_id % 11 + CASE WHEN j = 3 THEN k ELSE 0 END AS identity FROM a, range(5) t(j), range(2) u(k) WHERE turn % 4 <> 3)"


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = F.col("turn")
    tail = F.when(t % 5 == 0, "see [4]").when(t % 5 == 1, "<tool_call>").otherwise("")
    a = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + t).alias("answer_id"), F.concat(F.lit("So [E"), t % 7, F.lit("] and [P"), t % 3, F.lit("], [E"), t % 7, F.lit("] "), tail).alias("text"), "turn")
    al = a.where(t % 4 != 3).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    return a.drop("turn"), al.select("answer_id", F.concat(F.lit("E"), "j").alias("label"), (F.col("answer_id") % 11 + F.when(F.col("j") == 3, F.col("k")).otherwise(0)).alias("identity"))


@query(
    f"""
WITH {_ANSWERS}{_ALLOWED}, u AS (SELECT DISTINCT answer_id, unnest(regexp_extract_all(text, '\\[([EP]\\d+)\\]', 1)) AS label FROM a), k AS (SELECT answer_id, label, count(DISTINCT identity) AS n FROM al GROUP BY 1, 2)
SELECT u.answer_id, u.label, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'known' END AS status FROM u LEFT JOIN k USING (answer_id, label)"""
)
def citation_checks(spark: SparkSession, d: str) -> DataFrame:
    return W.check_citations(*_answers(spark, d))


@query(
    f"""
WITH {_ANSWERS}{_ALLOWED}, k AS (SELECT answer_id, list(DISTINCT label) AS known FROM al GROUP BY 1),
u AS (SELECT a.answer_id, text, regexp_extract_all(text, '\\[([EP]\\d+)\\]', 1) AS l, coalesce(known, []) AS known FROM a LEFT JOIN k USING (answer_id)), w AS (SELECT *, list_filter({_ordered_distinct("l")}, lambda v: NOT list_contains(known, v)) AS unknown FROM u)
SELECT answer_id, array_to_string(unknown, ',') AS unknown, array_to_string(list_filter([CASE WHEN contains(text, '<tool_call>') THEN 'tool_markup' END, CASE WHEN regexp_matches(text, '\\[\\d+\\]') THEN 'citation_without_namespace' END,
  CASE WHEN len(unknown) > 0 THEN 'unknown_citation' END], lambda v: v IS NOT NULL), ',') AS issues, CASE WHEN contains(text, '<tool_call>') OR regexp_matches(text, '\\[\\d+\\]') OR len(unknown) > 0 THEN 'rejected' ELSE 'accepted' END AS status FROM w"""
)
def finalised_answers(spark: SparkSession, d: str) -> DataFrame:
    f = W.finalise(*_answers(spark, d))
    return f.select("answer_id", F.array_join("unknown", ",").alias("unknown"), F.array_join("issues", ",").alias("issues"), "status")


@query(f"WITH {_ANSWERS}s AS (SELECT 'E' || id AS label, id // 2 AS paper FROM range(6) t(id)), u AS (SELECT DISTINCT answer_id, unnest(regexp_extract_all(text, '\\[([EP]\\d+)\\]', 1)) AS label FROM a) SELECT answer_id, array_to_string(list(DISTINCT paper ORDER BY paper), ',') AS papers FROM u JOIN s USING (label) GROUP BY 1")
def cited_papers(spark: SparkSession, d: str) -> DataFrame:
    """The papers that answers cite."""
    sources = spark.range(6).select(F.concat(F.lit("E"), "id").alias("label"), F.floor(F.col("id") / 2).alias("paper_id"))
    return W.interactions(_answers(spark, d)[0], sources).select("answer_id", F.array_join(F.col("papers").cast("array<string>"), ",").alias("papers"))


#: Turns of conversations as units of work with results.
_UNITS = """
u AS (SELECT conv_id AS task_id, turn AS ordinal, 'u' || turn AS unit_id, CASE turn % 5 WHEN 4 THEN 'failed' WHEN 3 THEN 'pending' ELSE 'completed' END AS state, CASE WHEN turn % 10 = 4 THEN 'timeout' END AS error,
  CASE WHEN turn % 7 <> 6 THEN 'a' || (conv_id * 1000 + turn) END AS out, CASE WHEN turn % 9 = 8 THEN 2 ELSE 1 END AS inputs, turn, conv_id, CASE turn % 3 WHEN 0 THEN 'relevant' ELSE 'irrelevant' END AS rel FROM conversations)"""


def _units(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t, v = F.col("turn"), F.col("conv_id")
    out = F.concat(F.lit("a"), v * 1000 + t)
    c = table(spark, d, "conversations")
    units = c.select(v.alias("task_id"), t.alias("ordinal"), F.concat(F.lit("u"), t).alias("unit_id"), F.when(t % 5 == 4, "failed").when(t % 5 == 3, "pending").otherwise("completed").alias("state"), F.when(t % 10 == 4, "timeout").alias("error"), F.when(t % 7 != 6, out).alias("output_artifact_id"), F.when(t % 9 == 8, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.concat(F.lit("in"), t))).alias("input_artifact_ids"))
    claim = F.struct(F.lit("c").alias("text"), F.array(F.concat(F.lit("[E"), t % 4, F.lit("]")), F.lit("E1")).alias("citations"))
    result = F.when(t % 8 == 7, F.lit("not json")).otherwise(F.to_json(F.struct(F.when(t % 3 == 0, "relevant").otherwise("irrelevant").alias("relevance"), F.concat(F.lit("s"), t).alias("summary"), F.array(claim).alias("claims"), F.array(F.concat(F.lit("q"), t % 2)).alias("unresolved_questions"))))
    results = c.where(t % 11 != 10).select(out.alias("artifact_id"), result.alias("result"))
    cites = c.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2)))).select(out.alias("artifact_id"), F.concat(F.lit("E"), "j").alias("label"), F.concat(out, F.lit("/"), "j").alias("source"))
    return units, results, cites


_REPORTS = f"""
{_UNITS}, j AS (SELECT *, CASE WHEN state = 'failed' THEN coalesce(error, state) WHEN state <> 'completed' THEN NULL WHEN out IS NULL OR inputs <> 1 THEN 'invalid artifact provenance' WHEN turn % 11 = 10 THEN 'result artifact is missing' WHEN turn % 8 = 7 THEN 'result is not a report' END AS reason FROM u),
r AS (SELECT * FROM j WHERE reason IS NULL AND state = 'completed'), us AS (SELECT DISTINCT task_id, unnest(['E' || (turn % 4), 'E1']) AS label FROM r WHERE rel = 'relevant'),
ci AS (SELECT r.task_id, r.unit_id, r.out, 'E' || k AS label, r.out || '/' || k AS source FROM r, range(3) t(k)),
mf AS (SELECT task_id, label, source FROM (SELECT ci.*, row_number() OVER (PARTITION BY ci.task_id, ci.label ORDER BY ci.unit_id, ci.out) AS n FROM ci JOIN us ON us.task_id = ci.task_id AND us.label = ci.label) WHERE n = 1)"""


@query(f"WITH {_REPORTS} SELECT task_id, unit_id, coalesce(reason, rel) AS outcome FROM j WHERE reason IS NOT NULL OR state = 'completed'")
def collected_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports of finished units, and why others give none."""
    reports, failures, _ = W.collect_reports(*_units(spark, d))
    return reports.select("task_id", "unit_id", F.col("relevance").alias("outcome")).unionByName(failures.select("task_id", "unit_id", F.col("reason").alias("outcome")))


@query(f"WITH {_REPORTS} SELECT task_id, label, source FROM mf")
def report_manifest(spark: SparkSession, d: str) -> DataFrame:
    return W.collect_reports(*_units(spark, d))[2].select("task_id", "label", "source")


@query(
    f"""
WITH {_REPORTS}, k AS (SELECT task_id, list(DISTINCT label) AS known FROM mf GROUP BY 1)
SELECT r.task_id, bool_or(rel = 'relevant' AND list_contains(coalesce(known, []), 'E' || (turn % 4)) AND list_contains(coalesce(known, []), 'E1')) AS sufficient FROM r LEFT JOIN k USING (task_id) GROUP BY 1"""
)
def sufficient_reports(spark: SparkSession, d: str) -> DataFrame:
    reports, _, found = W.collect_reports(*_units(spark, d))
    return W.report_sufficient(reports, found)


@query(
    f"""
WITH {_UNITS}, c AS (SELECT * FROM u WHERE state = 'completed'), l AS (SELECT task_id, list('E' || (turn % 4) ORDER BY ordinal, unit_id) AS ci, list('q' || (turn % 2) ORDER BY ordinal, unit_id) AS qu, string_agg('s' || turn, '|' ORDER BY ordinal, unit_id) AS summaries FROM c GROUP BY 1),
f AS (SELECT task_id, string_agg(unit_id, '|' ORDER BY ordinal, unit_id) AS failed FROM u WHERE state = 'failed' GROUP BY 1)
SELECT t.task_id, coalesce(summaries, '') AS summaries, coalesce(array_to_string({_ordered_distinct("ci")}, '|'), '') AS citations, coalesce(array_to_string({_ordered_distinct("qu")}, '|'), '') AS questions, coalesce(failed, '') AS failed
FROM (SELECT DISTINCT task_id FROM u) t LEFT JOIN l USING (task_id) LEFT JOIN f USING (task_id)"""
)
def collected_tasks(spark: SparkSession, d: str) -> DataFrame:
    """A task's summaries in order, distinct citations and questions, and failed units."""
    t = F.col("ordinal")
    u = _units(spark, d)[0].select("task_id", "ordinal", "unit_id", "state", F.concat(F.lit("s"), t).alias("summary"), F.array(F.concat(F.lit("E"), t % 4)).alias("citations"), F.array(F.concat(F.lit("q"), t % 2)).alias("unresolved_questions"))
    names = {"summaries": "summaries", "citations": "citations", "unresolved_questions": "questions", "failed_units": "failed"}
    return W.collect_task(u).select("task_id", *(F.array_join(c, "|").alias(n) for c, n in names.items()))


@query(
    f"""
WITH c AS (SELECT conv_id, list(DISTINCT CASE turn WHEN 1 THEN 'screening' WHEN 3 THEN 'novelty_check' ELSE 'method' END) AS w, count(*) AS n FROM conversations WHERE turn % 2 = conv_id % 2 GROUP BY 1),
k AS (SELECT *, CASE WHEN len(list_intersect(w, {W.TELLING["cross_domain_exploration"]})) > 0 THEN 'cross_domain_exploration' WHEN len(list_intersect(w, {W.TELLING["literature_survey"]})) > 0 THEN 'literature_survey' ELSE 'multi_paper_comparison' END AS kind FROM c)
SELECT conv_id, kind, CASE kind {" ".join(f"WHEN '{n}' THEN '{','.join(p)}'" for n, p in W.PLANS.items())} END AS plan, CAST(CASE WHEN n >= 6 OR conv_id % 4 = 0 THEN least(n, 5) ELSE 0 END AS BIGINT) AS workers FROM k"""
)
def task_plans(spark: SparkSession, d: str) -> DataFrame:
    """What a task is by its kinds of work, its plan, and how many workers it gets."""
    t = F.col("turn")
    word = F.when(t == 1, "screening").when(t == 3, "novelty_check").otherwise("method")
    c = table(spark, d, "conversations").where(t % 2 == F.col("conv_id") % 2).groupBy("conv_id").agg(F.collect_set(word).alias("w"), F.count("*").alias("n"))
    kind = W.task_type("w")
    return c.select("conv_id", kind.alias("kind"), F.array_join(W.default_plan(kind), ",").alias("plan"), W.route(F.col("n"), F.col("conv_id") % 4 == 0).cast("long").alias("workers"))


@query(
    """
SELECT DISTINCT conv_id AS task_id, sha256('chunk-analysis:' || conv_id || ':a' || turn) AS unit_id, sha256('{"task":"' || conv_id || '","type":"chunk_analysis","objective":"Judge whether the artifact answers the question, and claim only what it supports. Question: q'
  || (turn % 3) || '","papers":["' || (turn % 5) || '"],"inputs":["a' || turn || '"],"worker":"chunk_analyst"}') AS generation_key FROM conversations"""
)
def artifact_units(spark: SparkSession, d: str) -> DataFrame:
    """One unit of work for each artifact."""
    t = F.col("turn")
    e = table(spark, d, "conversations").select(F.col("conv_id").alias("task_id"), F.concat(F.lit("a"), t).alias("artifact_id"), (t % 5).alias("paper_id"), F.concat(F.lit("q"), t % 3).alias("query"))
    return W.chunk_units(e).select("task_id", "unit_id", "generation_key")


@query(
    """
WITH p AS (SELECT conv_id, turn, 'E' || CAST('0x' || substr(md5(CAST(conv_id * 1000 + turn AS VARCHAR)), 1, 12) AS BIGINT) AS label FROM conversations),
j AS (SELECT *, '{"chunk_id":' || turn || ',"citation":"' || label || '","page_end":2,"page_start":1,"paper_id":' || (turn % 5) || ',"paper_title":"T","query":"q","section_id":0,"section_path":"S","text":"x' || turn || '","version_id":' || conv_id || ',"retrieval_scores":{"bm25":1.5,"dense":0.5,"relevance":0.25}}' AS payload FROM p)
SELECT conv_id AS task_id, label AS citation, '[' || label || '] T | S | pp.1-2' AS summary, sha256('7:retrieved_evidence:' || conv_id || ':' || sha256(payload)) AS artifact_id FROM j"""
)
def evidence_rows(spark: SparkSession, d: str) -> DataFrame:
    """One artifact for each piece of evidence, with ids that follow from its payload."""
    t, v = F.col("turn"), F.col("conv_id")
    const = {"paper_title": F.lit("T"), "query": F.lit("q"), "section_id": F.lit(0), "section_path": F.lit("S"), "page_start": F.lit(1), "page_end": F.lit(2), "dense": F.lit(0.5), "bm25": F.lit(1.5), "relevance": F.lit(0.25), "project_id": F.lit(7)}
    e = table(spark, d, "conversations").select(v.alias("task_id"), F.md5((v * 1000 + t).cast("string")).alias("evidence_id"), (t % 5).alias("paper_id"), v.alias("version_id"), t.alias("chunk_id"), F.concat(F.lit("x"), t).alias("text"), *(c.alias(n) for n, c in const.items()))
    return W.evidence_artifacts(e).select("task_id", "citation", "summary", "artifact_id")


@query(
    """
SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'not_found' WHEN ts + INTERVAL 3 DAY < TIMESTAMP '2024-01-08' THEN 'expired' WHEN event_id % 5 = 0 THEN 'corrupt' END AS status, sha256('1:' || event_type || ':' || sha256(props)) AS artifact_id, strlen(props) AS byte_size FROM events"""
)
def materialised_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Catalog rows of payloads, and whether each can be read."""
    e = table(spark, d, "events").withColumn("project", F.lit(1))
    made = W.materialise(e, F.col("props"), "event_type", "project", 3, F.col("ts"))
    stored = F.when(F.col("event_id") % 5 == 0, "other").otherwise(F.col("content_hash"))
    status = W.read_status(F.when(F.col("event_id") % 13 != 0, F.col("artifact_id")), F.col("expires_at"), stored, F.col("content_hash"), F.lit("2024-01-08").cast("timestamp_ntz"))
    return made.select("event_id", status.alias("status"), "artifact_id", "byte_size")


@query("SELECT event_id FROM events WHERE contains(lower(props), '7') OR contains(lower(event_type), '7') ORDER BY ts DESC, event_id DESC LIMIT 10")
def recalled_events(spark: SparkSession, d: str) -> DataFrame:
    """The newest ten rows that hold a word (a report of fixed length)."""
    return W.recall(table(spark, d, "events"), F.lit("7"), ["props", "event_type"], [F.desc("ts"), F.desc("event_id")], 10).select("event_id")


@query(
    """
WITH l AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events)
SELECT user_id, event_id FROM l WHERE n = 1 AND ts + INTERVAL 86400 SECOND > (SELECT max(ts) FROM events)"""
)
def live_states(spark: SparkSession, d: str) -> DataFrame:
    """Last states of users that haven't expired by the last event's time."""
    e = table(spark, d, "events")
    now = e.agg(F.max("ts").alias("now"))
    live = W.live_sessions(e.join(F.broadcast(now), F.lit(True)), F.col("now"), key="user_id", at="ts")
    return live.select("user_id", "event_id")


@query(
    """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'typed' WHEN event_type = 'click' THEN 'click_failed' WHEN event_id % 3 = 0 THEN 'stage_failed' ELSE 'internal_error' END AS code,
  CASE WHEN event_id % 2 = 0 THEN event_type ELSE trim('```json' || chr(10) || event_type) END AS body, substr(event_type || ' b c', 1, 500) AS summary, CASE WHEN event_id % 5 = 0 THEN 'a,b' ELSE 'b' END AS ids, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'z' END AS outside,
  event_id % 3 <> 1 AS cited FROM events"""
)
def result_rules(spark: SparkSession, d: str) -> DataFrame:
    """Codes of errors, bodies out of fences, summaries, scopes, and labels inside results."""
    k, kind = F.col("event_id"), F.col("event_type")
    code = W.error_code(F.when(k % 4 == 0, "typed"), {"click": "click_failed"}, kind, {"s": "stage_failed"}, F.when(k % 3 == 0, "s"))
    fenced = F.when(k % 2 == 0, F.concat(F.lit("```json\n"), kind, F.lit("\n```"))).otherwise(F.concat(F.lit("```json\n"), kind))
    scope = W.scope(F.when(k % 5 != 0, F.array(F.lit("b"), F.lit("z"))).otherwise(F.array().cast("array<string>")), F.array(F.lit("a"), F.lit("b")))
    content = F.when(k % 3 == 0, F.lit('{"x":["E1"]}')).when(k % 3 == 1, F.lit('{"x":["E10"],"y":"E1 E1"}')).otherwise(F.lit('{"x":"{\\"c\\":\\"E1\\"}"}'))
    return table(spark, d, "events").select(
        "event_id", code.alias("code"), W.unwrap_fence(fenced).alias("body"), W.summary(F.array(kind, F.lit("b"), F.lit("c"), F.lit("d"))).alias("summary"), F.array_join(scope["ids"], ",").alias("ids"), F.array_join(scope["outside"], ",").alias("outside"),
        W.contains_citation(content, F.lit("E1")).alias("cited"),
    )


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def trace_counts(spark: SparkSession, d: str) -> DataFrame:
    return W.traces(table(spark, d, "events"))


@query("SELECT DISTINCT sha256(text) AS file_hash FROM documents")
def first_sightings(spark: SparkSession, d: str) -> DataFrame:
    return E.first_seen(table(spark, d, "documents").select(F.sha2("text", 256).alias("file_hash")))


@query(
    """
SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'present' ELSE 'missing' END AS presence_status, CASE WHEN c_custkey % 3 = 0 THEN 'arxiv' WHEN c_custkey % 2 = 0 THEN 'doi' ELSE 'local' END AS source FROM customer"""
)
def marked_customers(spark: SparkSession, d: str) -> DataFrame:
    """Known keys marked by whether they were seen, and their source's type."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.when(k % 3 == 0, "a").alias("arxiv_id"), F.when(k % 2 == 0, "d").alias("doi"))
    marked = I.mark_missing(c, table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])
    return marked.select("c_custkey", "presence_status", I.source_type().alias("source"))


@query(
    """
WITH f AS (SELECT c_nationkey AS project_id, o_orderkey AS file_id, o_orderkey % 700 AS paper_id, CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 500 END AS version_id, o_orderstatus = 'F' AS canon, CASE o_orderkey % 4 WHEN 0 THEN 'indexed' WHEN 1 THEN 'parsed' WHEN 2 THEN 'failed' ELSE 'other' END AS status
  FROM orders JOIN customer ON c_custkey = o_custkey), p AS (SELECT p_partkey AS paper_id, CASE WHEN p_partkey % 3 = 0 THEN 'd' END AS doi, CASE WHEN p_partkey % 5 = 0 THEN 'a' END AS arxiv FROM part),
v AS (SELECT DISTINCT project_id, version_id FROM f WHERE version_id IS NOT NULL), c AS (SELECT l_orderkey % 500 AS version_id, count(*) AS n FROM lineitem GROUP BY 1),
k AS (SELECT project_id, CAST(sum(n) AS BIGINT) AS chunks FROM v JOIN c USING (version_id) GROUP BY 1), l AS (SELECT s_nationkey AS project_id, count(*) FILTER (s_acctbal < 0) AS missing FROM supplier GROUP BY 1)
SELECT f.project_id, count(DISTINCT file_id) AS files, count(DISTINCT f.paper_id) AS papers, count(DISTINCT version_id) AS versions, count(*) FILTER (canon) AS canonical_files, count(*) FILTER (doi IS NOT NULL) AS files_with_doi, count(*) FILTER (arxiv IS NOT NULL) AS files_with_arxiv_id,
  count(*) FILTER (status = 'discovered') AS files_discovered, count(*) FILTER (status = 'parsed') AS files_parsed, count(*) FILTER (status = 'indexed') AS files_indexed, count(*) FILTER (status = 'failed') AS files_failed, coalesce(max(l.missing), 0) AS missing_locations, coalesce(max(k.chunks), 0) AS chunks
FROM f LEFT JOIN p USING (paper_id) LEFT JOIN l ON l.project_id = f.project_id LEFT JOIN k ON k.project_id = f.project_id GROUP BY 1"""
)
def project_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counters of each project's status."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    status = F.when(k % 4 == 0, "indexed").when(k % 4 == 1, "parsed").when(k % 4 == 2, "failed").otherwise("other")
    files = o.select(F.col("c_nationkey").alias("project_id"), k.alias("file_id"), (k % 700).alias("paper_id"), F.when(k % 9 > 0, k % 500).alias("version_id"), (F.col("o_orderstatus") == "F").alias("is_canonical"), status.alias("status"))
    p = F.col("p_partkey")
    papers = table(spark, d, "part").select(p.alias("paper_id"), F.when(p % 3 == 0, "d").alias("doi"), F.when(p % 5 == 0, "a").alias("arxiv_id"))
    places = table(spark, d, "supplier").select(F.col("s_nationkey").alias("project_id"), F.when(F.col("s_acctbal") < 0, "missing").otherwise("present").alias("presence_status"))
    return K.project_status(files, papers, places, {"chunks": table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("version_id"))})


@query(
    """
SELECT p_partkey, p_name AS title, CAST(1990 + p_size AS INTEGER) AS year, '10.1/x' || p_size AS doi, CASE p_partkey % 4 WHEN 0 THEN 'A|B' WHEN 1 THEN p_brand WHEN 2 THEN p_brand ELSE '' END AS authors, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '|' || p_type ELSE '' END AS sources FROM part"""
)
def registry_answers(spark: SparkSession, d: str) -> DataFrame:
    """Authors and sources out of registries' JSON, in all the forms that they come in."""
    k, brand, kind = F.col("p_partkey"), F.col("p_brand"), F.col("p_type")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    authors = F.when(k % 4 == 0, F.lit('[{"text":"A"},{"name":"B"},{"id":1}]')).when(k % 4 == 1, F.concat(F.lit('{"text":'), quoted(brand), F.lit("}"))).when(k % 4 == 2, F.concat(F.lit("["), quoted(brand), F.lit("]"))).otherwise(F.lit("null"))
    place = lambda x: F.concat(F.lit('{"source":{"display_name":'), quoted(x), F.lit("}}"))
    places = F.when(k % 2 == 0, F.concat(F.lit("["), place(brand), F.lit(',{"source":null},'), place(kind), F.lit(","), place(brand), F.lit("]"))).otherwise(F.lit("null"))
    text = F.concat(F.lit('{"title":'), quoted(F.col("p_name")), F.lit(',"year":'), 1990 + F.col("p_size"), F.lit(',"doi":"10.1/X'), F.col("p_size"), F.lit('","authors":'), authors, F.lit(',"locations":'), places, F.lit("}"))
    a = table(spark, d, "part").select("p_partkey", C.registry_answer(text).alias("a"))
    return a.select("p_partkey", "a.title", "a.year", "a.doi", F.array_join("a.authors", "|").alias("authors"), F.array_join("a.sources", "|").alias("sources"))


@query(
    """
WITH r AS (SELECT conv_id * 1000 + turn AS unit_id, turn, [' [e' || (turn % 6) || ']', 'E1'] AS raw FROM conversations), l AS (SELECT *, CASE turn % 5 WHEN 0 THEN [] WHEN 1 THEN ['X9'] ELSE (CASE WHEN turn % 6 = 1 THEN ['E1'] ELSE ['E' || (turn % 6), 'E1'] END) END AS labels FROM r)
SELECT unit_id, array_to_string(labels, ',') AS labels, array_to_string(list_filter([CASE WHEN turn % 5 = 1 THEN 'label_syntax' END, CASE WHEN turn % 5 > 1 AND turn % 6 > 3 THEN 'unknown_label' END, CASE WHEN turn % 5 > 1 AND turn % 6 = 3 THEN 'ambiguous_label' END,
  CASE WHEN turn % 5 = 0 AND turn % 2 = 0 THEN 'claim_without_citation' END], lambda v: v IS NOT NULL), ',') AS issues FROM l"""
)
def checked_reports(spark: SparkSession, d: str) -> DataFrame:
    """Labels of workers' claims in one form, and what is wrong with them."""
    t = F.col("turn")
    raw = F.when(t % 5 == 0, F.array().cast("array<string>")).when(t % 5 == 1, F.array(F.lit("x9"))).otherwise(F.array(F.concat(F.lit(" [e"), t % 6, F.lit("]")), F.lit("E1")))
    unit = (F.col("conv_id") * 1000 + t).alias("unit_id")
    c = table(spark, d, "conversations")
    reports = c.select(unit, F.array(F.struct(F.lit("c").alias("text"), raw.alias("citations"))).alias("claims"), (t % 2 == 0).alias("evidence_backed"))
    allowed = c.select(unit, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select("unit_id", F.concat(F.lit("E"), "j").alias("label"), F.when(F.col("j") == 3, F.col("k")).otherwise(0).alias("identity"))
    return W.check_reports(reports, allowed).select("unit_id", F.array_join(F.flatten(F.transform("claims", lambda c: c["citations"])), ",").alias("labels"), F.array_join("issues", ",").alias("issues"))


# ---- stored results


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a source as the evidence of one search each; those of a language as a paper that was read."""
    docs = table(spark, d, "documents")
    cite = F.struct(F.concat(F.lit("E"), F.col("doc_id") % 50).alias("citation"), F.col("lang").alias("paper_id"), F.lit("v").alias("version_id"), F.lit(1).alias("page_start"), F.lit(2).alias("page_end"), F.concat(F.lit("t"), "doc_id").alias("text"), F.col("doc_id").cast("string").alias("chunk_id"))
    found = docs.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("doc_id", cite.alias("c")))).alias("e"))
    items = F.transform("e", lambda x: x["c"])
    search = found.select(F.col("source").alias("artifact_id"), F.lit("knowledge_search").alias("kind"), F.to_json(F.struct(F.lit("q").alias("query"), items.alias("evidence"))).alias("payload"))
    element = F.struct(F.concat(F.lit("P"), F.col("doc_id") % 9).alias("citation"), F.lit(4).alias("page"), F.concat(F.lit("c"), "doc_id").alias("caption"), F.col("doc_id").cast("string").alias("element_id"))
    both = docs.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("doc_id", cite.alias("c")))).alias("e"), F.sort_array(F.collect_list(F.struct("doc_id", element.alias("c")))).alias("f"))
    read = both.select(F.col("lang").alias("artifact_id"), F.lit("paper_read").alias("kind"), F.to_json(F.struct(F.col("lang").alias("paper_id"), F.lit("w").alias("version_id"), F.lit("T").alias("title"), items.alias("passages"), F.transform("f", lambda x: x["c"]).alias("elements"))).alias("payload"))
    return search.unionByName(read)


_STORED = "d AS (SELECT doc_id, source, lang FROM documents)"


@query(
    f"""
WITH {_STORED}, s AS (SELECT source AS a, 'E' || (doc_id % 50) AS label, lang AS paper_id, 1 AS page_start, 't' || doc_id AS text, CAST(doc_id AS VARCHAR) AS chunk_id, CAST(NULL AS VARCHAR) AS element_id, 0 AS l, doc_id FROM d
  UNION ALL SELECT lang, 'E' || (doc_id % 50), lang, 1, 't' || doc_id, CAST(doc_id AS VARCHAR), NULL, 0, doc_id FROM d UNION ALL SELECT lang, 'P' || (doc_id % 9), lang, 4, 'c' || doc_id, NULL, CAST(doc_id AS VARCHAR), 1, doc_id FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY a, label ORDER BY l, doc_id) AS n FROM s)
SELECT a AS artifact_id, label, paper_id, page_start, sha256(text) AS evidence_hash, chunk_id, element_id FROM r WHERE n = 1"""
)
def citation_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Citations of stored results, once a label."""
    return W2.citation_manifest(_payloads(spark, d)).select("artifact_id", "label", "paper_id", "page_start", "evidence_hash", "chunk_id", "element_id")


@query(f"WITH {_STORED} SELECT source AS artifact_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS position, 't' || doc_id AS text FROM d UNION ALL SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS INTEGER), 't' || doc_id FROM d")
def default_views(spark: SparkSession, d: str) -> DataFrame:
    return W2.view_items(_payloads(spark, d), "default").select("artifact_id", "position", F.get_json_object("item", "$.text").alias("text"))


@query(
    f"""
WITH {_STORED}, x AS (SELECT lang, 0 AS l, doc_id, 't' || doc_id AS text, 2 AS page_end FROM d UNION ALL SELECT lang, 1, doc_id, 'c' || doc_id, 4 FROM d)
SELECT lang AS artifact_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY l, doc_id) - 1 AS INTEGER) AS position, text, page_end FROM x"""
)
def read_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Passages and then elements of papers that were read, as evidence."""
    return W2.read_evidence(_payloads(spark, d)).select("artifact_id", "position", "text", "page_end")


_ITEM = """'{"chunk_id":"' || doc_id || '","citation":"E' || (doc_id % 50) || '","page_end":2,"page_start":1,"paper_id":"' || lang || '","text":"t' || doc_id || '","version_id":"v"}'"""


@query(
    f"""
WITH {_STORED}, e AS (SELECT *, len(regexp_extract_all({_ITEM}, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')) AS cost FROM d),
t AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS turn, min(doc_id) OVER (PARTITION BY source, lang) AS first FROM e),
s AS (SELECT *, sum(cost) OVER (PARTITION BY source ORDER BY turn, first) AS used FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM t) WHERE turn <= 4),
r AS (SELECT *, sum(cost) OVER (PARTITION BY lang ORDER BY doc_id) AS used FROM e)
SELECT source AS artifact_id, string_agg('t' || doc_id, ',' ORDER BY turn, first) FILTER (used + k - 1 + 58 <= 600) AS shown, max(n) - count(*) AS omitted
FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY turn, first) AS k FROM s) WHERE used <= 600 GROUP BY source
UNION ALL SELECT lang, string_agg('t' || doc_id, ',' ORDER BY doc_id) FILTER (used + k - 1 + 118 <= 600), max(n) - count(*)
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM r) WHERE used <= 600 GROUP BY lang"""
)
def stored_previews(spark: SparkSession, d: str) -> DataFrame:
    """What previews of 600 tokens show of stored searches and papers: papers in turn, passages in order.

    In the SQL, 58 and 118 are the tokens of the fields before the list.
    """
    shown = W2.previews(_payloads(spark, d), 600)
    items = F.when(F.col("kind") == "knowledge_search", F.get_json_object("preview", "$.selected_evidence[*].text")).otherwise(F.get_json_object("preview", "$.passages[*].text"))
    omitted = F.coalesce(F.get_json_object("preview", "$.omitted_evidence"), F.get_json_object("preview", "$.omitted_passages")).cast("long")
    one = F.coalesce(F.from_json(items, "array<string>"), F.array(F.regexp_replace(items, '"', "")))
    return shown.select("artifact_id", F.array_join(one, ",").alias("shown"), omitted.alias("omitted"))


_COMPARED = "x AS (SELECT c_nationkey AS a, c_mktsegment AS name, count(*) > 12 AS ok, count(*) AS n FROM customer GROUP BY 1, 2)"


def _comparisons(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("n"))
    cell = lambda p: F.struct(F.lit(p).alias("paper_id"), F.concat(F.lit(f"{p}:"), "n").alias("normalized_value"))
    dim = F.struct("name", (F.col("n") > 12).alias("directly_comparable"), F.array(cell("p1"), cell("p2")).alias("cells"))
    rows = g.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(dim)).alias("dimensions"))
    return rows.select(F.col("c_nationkey").alias("artifact_id"), F.lit("paper_comparison").alias("kind"), F.to_json(F.struct(F.lit("partial").alias("status"), "dimensions")).alias("payload"))


@query(f"WITH {_COMPARED} SELECT a AS artifact_id, 'partial' AS status, CAST(count(*) AS INTEGER) AS dimension_count, coalesce(string_agg(name, ',' ORDER BY name) FILTER (ok), '') AS comparable, coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT ok), '') AS insufficient FROM x GROUP BY 1")
def comparison_views(spark: SparkSession, d: str) -> DataFrame:
    s = W2.comparison_summary(_comparisons(spark, d))
    return s.select("artifact_id", "status", "dimension_count", F.array_join("comparable_dimensions", ",").alias("comparable"), F.array_join("insufficient_dimensions", ",").alias("insufficient"))


@query(f"WITH {_COMPARED} SELECT a AS artifact_id, CAST(row_number() OVER (PARTITION BY a ORDER BY name) - 1 AS INTEGER) AS position, 'p2:' || n AS value FROM x")
def paper_cells(spark: SparkSession, d: str) -> DataFrame:
    """The cells of one paper in stored comparisons."""
    return W2.view_items(_comparisons(spark, d), "paper:p2").select("artifact_id", "position", F.get_json_object("item", "$.normalized_value").alias("value"))


@query(f"WITH {_STORED} SELECT lang AS artifact_id, 'E' || (doc_id % 50) AS label FROM d GROUP BY ALL")
def shown_citations(spark: SparkSession, d: str) -> DataFrame:
    """The citations that slices of read papers show."""
    p = _payloads(spark, d).where("kind = 'paper_read'")
    manifest_ = W2.citation_manifest(p).select("artifact_id", "label")
    slices = table(spark, d, "documents").groupBy(F.col("lang").alias("artifact_id")).agg(F.to_json(F.struct(F.collect_list(F.concat(F.lit("E"), F.col("doc_id") % 50)).alias("x"))).alias("content"))
    return W.visible_citations(slices, manifest_).select("artifact_id", "label").distinct()


# ---- tables merged in place


@query(
    """
WITH o AS (SELECT o_custkey AS custkey, max(o_orderkey) AS orderkey FROM orders GROUP BY 1)
SELECT coalesce(custkey, c_custkey) AS custkey, orderkey, c_name AS name, CAST((CASE WHEN custkey IS NULL THEN 0 ELSE 1 END) + (CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END) AS INTEGER) AS seen
FROM o FULL JOIN customer ON c_custkey = custkey WHERE c_nationkey IS DISTINCT FROM 3"""
)
def merged_in_place(spark: SparkSession, d: str) -> DataFrame:
    """Orders, then customers (a batch that comes twice), merged by key into buckets; then the keys of a nation go."""
    t = BucketTable(spark, f"{shared_folder(spark)}/merged-{uuid.uuid4().hex}", "custkey long, orderkey long, name string, seen int", ["custkey"], 16)
    files, at = versions.files(spark, t.path)
    files.deleteOnExit(at)
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), F.lit(1).alias("seen"))
    t.merge(table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.lit(1).alias("seen")), order=["orderkey"])
    for _ in range(2):
        t.merge(customers, {"name": F.col("new.name"), "seen": F.col("old.seen") + 1}, mark=("customers", 0))
    t.delete(table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("custkey")))
    return t.read()


# ---- sources


@query(
    """
WITH h AS (SELECT 'labels' AS name, sha256('{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}') AS h FROM labels UNION ALL SELECT 'nation', sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') FROM nation)
SELECT name, count(*) AS rows, CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM h GROUP BY 1"""
)
def lock_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Rows and digests of tables; a digest doesn't depend on the order of rows."""
    return manifest({t: table(spark, d, t) for t in ("labels", "nation")})


@query("SELECT sha256(p_name) || '  ' || p_partkey || '.pdf' AS value FROM part")
def checksum_lines(spark: SparkSession, d: str) -> DataFrame:
    return checksums(table(spark, d, "part").select(F.concat("p_partkey", F.lit(".pdf")).alias("relative_path"), F.sha2("p_name", 256).alias("file_hash")))


@query(
    """
WITH c AS (SELECT n_name AS k, n_regionkey AS r FROM nation), t AS (SELECT s_suppkey, n_name AS k FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT s_suppkey, CASE WHEN r = 0 THEN 'not_queried' WHEN r = 1 THEN 'error' WHEN r = 2 THEN 'not_found' ELSE 'found' END AS lookup FROM t JOIN c USING (k)"""
)
def looked_up_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles against a table of fetched answers."""
    n, r = table(spark, d, "nation"), F.col("n_regionkey")
    cache = n.where(r != 0).select(F.col("n_name").alias("title_key"), F.when(r > 2, "{}").alias("answer"), F.when(r == 1, "timeout").alias("error"))
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("title_key"))
    return look_up(s, cache).select("s_suppkey", "lookup")


@query(
    """
WITH h AS (SELECT DISTINCT sha256(text) AS content_hash FROM documents), g AS (SELECT DISTINCT sha256(text) AS content_hash FROM documents WHERE doc_id % 3 = 0)
SELECT content_hash, CASE WHEN content_hash IN (SELECT content_hash FROM g) THEN 'missing' ELSE 'ok' END AS status FROM h"""
)
def blob_reads(spark: SparkSession, d: str) -> DataFrame:
    """Blobs of which some were deleted, read back."""
    docs = table(spark, d, "documents").where("text is not null")
    held = put_blobs(None, docs, "text")
    gone = docs.where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("content_hash"))
    return get_blobs(delete_blobs(held, gone), held).select("content_hash", "status")


@query(
    """
WITH b AS (SELECT conv_id, string_agg('{"block_id":"b' || turn || '","page_number":1,"reading_order":' || turn || ',"tag":"' || role || '"}', ',' ORDER BY turn) AS l FROM conversations GROUP BY 1) SELECT conv_id AS version_id, sha256('{"blocks":[' || l || ']}') AS digest FROM b"""
)
def saved_documents(spark: SparkSession, d: str) -> DataFrame:
    """Digests of documents in canonical form."""
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("version_id"), F.lit(1).alias("page_number"), F.col("turn").alias("reading_order"), F.concat(F.lit("b"), "turn").alias("block_id"), F.col("role").alias("tag"))
    return save_documents(c).select("version_id", "digest")


# ---- structure processors plugged in, large tasks


@query(
    """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM l WHERE trim(line) <> '')
SELECT doc_id AS version_id, CAST(k // 8 AS INTEGER) AS packet, CAST(count(*) AS INTEGER) AS n_lines, CAST(min(i) - 1 AS INTEGER) AS first_line, sha256(string_agg(line, chr(10) ORDER BY i)) AS content FROM n GROUP BY 1, 2"""
)
def line_packets(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents in packets of eight, by a processor that is plugged in as a table function."""

    def pack(rows):
        for k in range(0, len(rows), 8):
            part = rows[k : k + 8]
            yield k // 8, len(part), part[0]["reading_order"], hashlib.sha256("\n".join(r["text"] for r in part).encode()).hexdigest()

    packed = structure_function(pack, "packet int, n_lines int, first_line int, content string")
    return packed(S.blocks_of(spread(table(spark, d, "documents"))).asTable())


@query(
    """
WITH RECURSIVE u AS (SELECT DISTINCT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS n FROM lineitem),
e AS (SELECT k, n, CASE WHEN n > 1 THEN k WHEN k > 1 THEN k // 2 END AS pk, CASE WHEN n > 1 THEN n - 1 WHEN k > 1 THEN 1 END AS pn, (k * 7 + n) % 50 <> 0 AS good FROM u),
r AS (SELECT e.k, e.n, good, 0 AS layer, pk IS NULL AS ok FROM e WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.k = pk AND u.n = pn)
  UNION ALL SELECT e.k, e.n, e.good, r.layer + 1, r.ok AND (r.good OR r.k % 3 = 0) FROM r JOIN e ON e.pk = r.k AND e.pn = r.n)
SELECT k || '-' || n AS unit_id, layer, CASE WHEN NOT ok THEN 'skipped' WHEN good OR k % 3 = 0 THEN 'completed' ELSE 'failed' END AS state, CASE WHEN NOT ok THEN 0 WHEN good THEN 1 ELSE 2 END AS attempts FROM r"""
)
def line_schedule(spark: SparkSession, d: str) -> DataFrame:
    """All lines of orders as units of one task: a line waits for the one before it, an order's first for that of the order with half its key.

    Some fail at first; a second run succeeds where 3 divides the order's key.
    """
    k, n = F.col("k"), F.col("n")
    name = lambda a, b: F.concat_ws("-", a, b)
    units = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n")).distinct()
    needs = F.when(n > 1, F.array(name(k, n - 1))).when(k > 1, F.array(name(F.floor(k / 2), F.lit(1))))
    told = W.schedule(units.select("k", "n", F.lit(0).alias("task_id"), name(k, n).alias("unit_id"), needs.alias("dependency_ids")), (k * 7 + n) % 50 != 0, k % 3 == 0)
    return told.select("unit_id", "layer", "state", "attempts")
