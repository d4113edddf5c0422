"""Reading parts of papers, texts for the index, checks of rows, metadata of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Characters of chunk texts that stand for a paper or a section.
TEXT_LIMIT = 8000


def owned_version(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests with the version to read: the one asked for if the project owns it, else that of its canonical, newest file.

    `files`: project_id, paper_id, version_id, is_canonical, updated_at; `requests`: request_id, project_id, paper_id,
    version_id. Status: ok, paper_not_found or version_not_found.
    """
    own = files.where("version_id is not null")
    best = own.withColumn("_n", F.row_number().over(Window.partitionBy("project_id", "paper_id").orderBy(F.desc("is_canonical"), F.desc("updated_at"), "version_id"))).where("_n = 1")
    asked = requests.join(best.select("project_id", "paper_id", F.col("version_id").alias("_best")), ["project_id", "paper_id"], "left")
    held = own.select("project_id", "paper_id", F.col("version_id").alias("_have")).distinct()
    asked = asked.join(held, (asked.project_id == held.project_id) & (asked.paper_id == held.paper_id) & (asked.version_id == held["_have"]), "left").drop(held.project_id, held.paper_id)
    status = F.when(F.col("_best").isNull(), "paper_not_found").when(F.col("version_id").isNotNull() & F.col("_have").isNull(), "version_not_found").otherwise("ok")
    return asked.withColumns({"status": status, "version_id": F.when(status == "ok", F.coalesce("_have", "_best"))}).drop("_best", "_have")


def read_chunks(chunks: DataFrame, section: object = None, pages: tuple[int, int] | None = None, element: object = None, types: list[str] | None = None, radius: int = 0, version: str = "version_id", order: str = "chunk_order") -> DataFrame:
    """Chunks that match all that is asked for, and those within `radius` of one in its version.

    A section by its id, pages that overlap a range, an element among related_element_ids, chunk types.
    """
    hit = F.lit(True)
    if section is not None:
        hit = hit & (F.col("section_id") == section)
    if pages is not None:
        hit = hit & (F.col("page_end") >= pages[0]) & (F.col("page_start") <= pages[1])
    if element is not None:
        hit = hit & F.array_contains("related_element_ids", element)
    if types:
        hit = hit & F.col("chunk_type").isin(*types)
    matched = chunks.where(hit)
    if not radius:
        return matched
    near = matched.select(version, F.explode(F.sequence(F.col(order) - radius, F.col(order) + radius)).alias(order)).distinct()
    return chunks.join(near, [version, order], "left_semi")


def read_elements(elements: DataFrame, sections: DataFrame, section: object = None, pages: tuple[int, int] | None = None, element: object = None, types: list[str] | None = None) -> DataFrame:
    """Elements that match, on a page within the range, with their section's path (empty if it has none)."""
    hit = F.lit(True)
    if element is not None:
        hit = hit & (F.col("element_id") == element)
    if section is not None:
        hit = hit & (F.col("section_id") == section)
    if pages is not None:
        hit = hit & F.col("page").between(*pages)
    if types:
        hit = hit & F.col("element_type").isin(*types)
    paths = sections.select("version_id", "section_id", "section_path")
    return elements.where(hit).join(paths, ["version_id", "section_id"], "left").withColumn("section_path", F.coalesce("section_path", F.lit("")))


def _joined_texts(chunks: DataFrame, keys: list[str], limit: int = TEXT_LIMIT) -> DataFrame:
    """(keys, texts): texts in order, line by line, cut at the limit. Chunks that begin beyond it aren't gathered."""
    before = F.sum(F.length("text") + 1).over(Window.partitionBy(*keys).orderBy("chunk_order", "chunk_id").rowsBetween(Window.unboundedPreceding, -1))
    held = chunks.withColumn("_at", F.coalesce(before, F.lit(0))).where(F.col("_at") < limit)
    parts = F.transform(F.sort_array(F.collect_list(F.struct("chunk_order", "chunk_id", "text"))), lambda c: c["text"])
    return held.groupBy(*keys).agg(F.substring(F.array_join(parts, "\n"), 1, limit).alias("texts"))


def index_documents(papers: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """(level, target_id, paper_id, version_id, section_id, text, content_hash) of papers, sections and chunks.

    A paper's text: title, aliases, authors, venue, abstract, section paths and its first chunks; a section's: its path
    and first chunks; a chunk's: its section's path and its text. Versions without chunks have none. `papers`: paper_id,
    version_id, canonical_title, aliases, authors, venue, abstract.
    """
    full = chunks.select("version_id").distinct()
    listed = sections.groupBy("version_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_order", "section_path"))), lambda s: s["section_path"]), "\n").alias("paths"))
    texts = _joined_texts(chunks, ["version_id"])
    parts = F.array(F.col("canonical_title"), F.array_join("aliases", " "), F.array_join("authors", " "), F.col("venue"), F.col("abstract"), F.col("paths"), F.col("texts"))
    whole = papers.join(full, "version_id", "left_semi").join(listed, "version_id", "left").join(texts, "version_id", "left")
    told = lambda level, target, section, text: [F.lit(level).alias("level"), F.col(target).cast("string").alias("target_id"), "paper_id", "version_id", section, F.trim(text).alias("text")]
    none = F.lit(None).cast(sections.schema["section_id"].dataType).alias("section_id")
    of_paper = whole.select(*told("paper", "paper_id", none, F.array_join(F.filter(parts, lambda v: v.isNotNull() & (v != "")), "\n")))
    owner = papers.select("paper_id", "version_id").distinct()
    held = sections.join(full, "version_id", "left_semi").join(owner, "version_id").join(_joined_texts(chunks, ["version_id", "section_id"]), ["version_id", "section_id"], "left")
    of_section = held.select(*told("section", "section_id", F.col("section_id"), F.substring(F.concat_ws("\n", "section_path", "texts"), 1, TEXT_LIMIT)))
    path = sections.select("version_id", "section_id", F.col("section_path").alias("_path"))
    of_chunk = chunks.join(owner, "version_id").join(path, ["version_id", "section_id"], "left").select(*told("chunk", "chunk_id", F.col("section_id"), F.concat_ws("\n", "_path", "text")))
    return of_paper.unionByName(of_section).unionByName(of_chunk).withColumn("content_hash", F.sha2(F.concat_ws("\n", "level", "text"), 256))


def index_report(documents: DataFrame, known: DataFrame) -> DataFrame:
    """(level, documents, generated, reused): reused are those whose content already has a vector. `known`: content_hash."""
    have = known.select("content_hash").distinct().withColumn("_have", F.lit(True))
    return documents.join(have, "content_hash", "left").groupBy("level").agg(F.count("*").alias("documents"), F.count_if(F.col("_have").isNull()).alias("generated"), F.count_if(F.col("_have").isNotNull()).alias("reused"))


def source_digest(documents: DataFrame, by: str = "version_id") -> DataFrame:
    """(by, digest): the hash of a version's sorted level:id:hash lines."""
    line = F.concat_ws(":", "level", "target_id", "content_hash")
    return documents.groupBy(by).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("digest"))


# ---- checks of rows


def block_issues(blocks: DataFrame) -> DataFrame:
    """(version_id, page_number, issue) of parsed documents: pages from 1, block ids and reading orders told apart."""
    per_page = blocks.groupBy("version_id", "page_number").agg(
        F.array(
            F.when(F.coalesce(F.min("page_number") < 1, F.lit(True)), "page_below_1"),
            F.when(F.count_distinct("block_id") < F.count("*"), "duplicate_block_id"),
            F.when(F.count_distinct("reading_order") < F.count("*"), "duplicate_reading_order"),
        ).alias("i")
    )
    across = blocks.groupBy("version_id", "block_id").agg(F.count_distinct("page_number").alias("n"), F.min("page_number").alias("page_number")).where("n > 1")
    own = per_page.select("version_id", "page_number", F.explode(F.filter("i", lambda x: x.isNotNull())).alias("issue"))
    return own.unionByName(across.select("version_id", "page_number", F.lit("block_id_on_several_pages").alias("issue")).distinct())


def structure_issues(sections: DataFrame, elements: DataFrame) -> DataFrame:
    """(version_id, id, issue): sections and elements are unique, parents exist, elements have a section of their version."""
    known = sections.select("version_id", "section_id").distinct()
    twice = lambda rows, key, issue: rows.groupBy("version_id", F.col(key).cast("string").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("version_id", "id", F.lit(issue).alias("issue"))
    lost = lambda rows, key, ref, issue: rows.where(F.col(ref).isNotNull()).join(known.withColumnRenamed("section_id", ref), ["version_id", ref], "left_anti").select("version_id", F.col(key).cast("string").alias("id"), F.lit(issue).alias("issue"))
    return (
        twice(sections, "section_id", "duplicate_section").unionByName(twice(elements, "element_id", "duplicate_element"))
        .unionByName(lost(sections, "section_id", "parent_section_id", "unknown_parent")).unionByName(lost(elements, "element_id", "section_id", "unknown_section"))
    )


def request_issues(query: Column, most: Column, least: Column) -> Column:
    """What is wrong with a search request: a blank query, a number of results outside 1 to 50, a threshold outside 0 to 1."""
    return F.filter(
        F.array(F.when(F.coalesce(F.trim(query), F.lit("")) == "", "blank_query"), F.when(~F.coalesce(most.between(1, 50), F.lit(False)), "max_evidence"), F.when(least.isNotNull() & ~least.between(0, 1), "min_relevance")),
        lambda x: x.isNotNull(),
    )


def well_formed_hash(digest: Column) -> Column:
    return F.coalesce(digest.rlike("^[0-9a-f]{64}$"), F.lit(False))


def required(rows: DataFrame, known: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Rows joined with what they need; reading one that lacks it is an error that names it."""
    found = known.withColumn("_found", F.lit(True))
    joined = rows.join(found, keys, "left")
    name = F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))
    return joined.where(F.when(F.col("_found"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), name)))).drop("_found")


# ---- metadata


def paper_metadata(files: DataFrame) -> DataFrame:
    """Title, authors, identifiers, year and keywords of files, each with its source and confidence.

    Needs file_name, meta (a map of the file's own metadata), first_page, text, page_count. A title comes from the
    metadata, else from the first page, else from the file's name; authors from the metadata, else from the line after
    the title.
    """
    own = lambda k: F.nullif(X.collapse(F.coalesce(F.element_at("meta", k), F.lit(""))), F.lit(""))
    stem = F.regexp_replace(F.regexp_replace("file_name", r"^.*/", ""), r"\.[^.]+$", "")
    page = X.infer_title("first_page")
    title = F.coalesce(own("title"), page, stem)
    rows = files.withColumns({"title": title, "_listed": X.split_authors(F.coalesce(own("author"), F.lit("")))})
    rows = rows.withColumn("_said", F.coalesce(X.infer_authors("first_page", "title"), F.array().cast("array<string>")))
    search = F.array_join(F.filter(F.array(F.element_at("meta", "subject"), F.col("first_page"), F.col("text")), lambda v: v.isNotNull() & (v != "")), "\n")
    dated = F.coalesce(F.nullif(F.element_at("meta", "creationDate"), F.lit("")), F.col("first_page"))
    fact = lambda field, source, confidence: F.struct(F.lit(field).alias("field"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))
    rows = rows.withColumns({"doi": X.extract_doi(search), "arxiv_id": X.extract_arxiv_id(search), "year": X.extract_year(dated)})
    evidence = F.filter(
        F.array(
            F.when(own("title").isNotNull(), fact("title", "pdf_metadata", 0.9)).when(page.isNotNull() & (page != stem), fact("title", "first_page", 0.65)).otherwise(fact("title", "file_name", 0.3)),
            F.when(F.size("_listed") > 0, fact("authors", "pdf_metadata", 0.85)).when(F.size("_said") > 0, fact("authors", "first_page", 0.45)),
            F.when(F.col("doi").isNotNull(), fact("doi", "document_text", 0.95)),
            F.when(F.col("arxiv_id").isNotNull(), fact("arxiv_id", "document_text", 0.95)),
            F.when(F.col("year").isNotNull(), fact("year", "pdf_metadata", 0.7)),
        ),
        lambda f: f.isNotNull(),
    )
    authors = F.when(F.size("_listed") > 0, F.col("_listed")).otherwise(F.col("_said"))
    return rows.withColumns({
        "authors": authors, "normalized_title": X.ascii_title("title"), "subject": own("subject"), "keywords": X.keywords(F.coalesce(F.element_at("meta", "keywords"), F.lit(""))),
        "content_hash": X.content_fingerprint("text"), "evidence": evidence,
    }).drop("_listed", "_said").withColumn("normalized_authors", X.normalize_authors("authors"))


def structure_version(*parts: str) -> Column:
    """The versions of the builders that made a structure, as one."""
    return F.lit("+".join(parts))
