"""Blocks to sections, elements, dependency groups and chunks."""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X

#: Titles of first-level sections; heading numbers; captions; openings that continue an equation.
TOP_TITLES = "abstract|introduction|related work|background|method|methodology|approach|experiments|experimental results|results|discussion|conclusion|conclusions|references|appendix"
NUMBERED = r"^\s*((?:\d+\.)*\d+)\s*[.)]?\s+\S"
ROMAN = r"(?i)^\s*[IVXLC]+[.)]\s+\S"
LETTER = r"^\s*[A-Z][.)]\s+\S"
CAPTION = r"(?is)^\s*(fig(?:ure)?\.?|table|algorithm|alg\.?|equation|eq\.?)\s*([A-Z]?\d+|[IVXLC]+)?\s*[:.)-]?\s*(.*)$"
CONTINUES = ["where ", "whereas ", "in which ", "as shown", "denotes ", "represents "]
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")
_TOKEN = re.compile(r"[㐀-鿿]|[A-Za-z0-9_]+|[^\s]")


def heading_level(text: Column | str, block_type: Column | str, level: Column | str) -> Column:
    """Level of a heading, null for other blocks."""
    t = X.collapse(text)
    kind = F.col(block_type) if isinstance(block_type, str) else block_type
    given = F.col(level) if isinstance(level, str) else level
    number = F.regexp_extract(t, NUMBERED, 1)
    return F.when(
        (F.length(t) > 0) & (F.length(t) <= 240) & (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) <= 30),
        F.when(given.isNotNull() & (kind == "heading"), F.greatest(F.lit(1), F.least(given, F.lit(6))))
        .when(number != "", F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)
        .when(X.ascii_title(t).rlike(f"^(?:{TOP_TITLES})$"), 1)
        .when(t.rlike(ROMAN), 1)
        .when(t.rlike(LETTER), 2)
        .when(kind == "heading", 1),
    ).cast("int")


def font_heading(text: Column | str, size: Column | str) -> Column:
    """Level of a block set in large type: at most three lines and 25 words, 13 points or more."""
    c = F.col(text) if isinstance(text, str) else text
    s = F.col(size) if isinstance(size, str) else size
    short = (F.size(F.split(F.trim(c), "\n")) <= 3) & (F.size(F.split(X.collapse(c), " ")) <= 25)
    return F.when(short & (s >= 13), F.when(s >= 20, 1).when(s >= 16, 2).otherwise(3))


def height_heading(text: Column | str, height: Column | str) -> Column:
    """The same by a line's height: at most two breaks and 25 words, 16 or more."""
    c = F.col(text) if isinstance(text, str) else text
    h = F.col(height) if isinstance(height, str) else height
    short = (F.size(F.split(c, "\n")) <= 3) & (F.size(F.split(X.collapse(c), " ")) <= 25)
    return F.when(short & (h >= 16), F.when(h >= 24, 1).otherwise(2))


def stay_with_document(spark: SparkSession) -> None:
    """Let rows that are dealt by document be joined on finer keys where they are: documents are many, and texts needn't move again."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def sections(blocks: DataFrame) -> DataFrame:
    """blocks with section_order, section_level, parent_order, section_title, section_path.

    A level is at most one below the last; the first heading has level 1; blocks
    before any heading belong to "Front Matter". The fold runs over a document's
    headings only, not over its blocks.
    """
    order = Window.partitionBy("version_id").orderBy("page_number", "reading_order", "block_id")
    stay_with_document(blocks.sparkSession)
    marked = blocks.withColumn("_level", heading_level("text", "block_type", "level"))
    # only titles go to the fold, not the texts of all blocks
    marked = marked.withColumn("_title", F.when(F.col("_level").isNotNull(), X.collapse("text")))
    marked = marked.withColumns({"_ord": F.row_number().over(order), "_front": F.first(F.col("_level").isNull()).over(order)})
    marked = marked.withColumn("section_order", (F.sum(F.col("_level").isNotNull().cast("int")).over(order) - 1 + F.col("_front").cast("int")).cast("int"))
    heads = marked.where("_level is not null").select("version_id", "section_order", F.col("_level").alias("level"), F.col("_title").alias("title"), "_front")

    def nest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("section_order")
        out, stack, paths = [], [], {}
        if len(pdf) and bool(pdf["_front"].iloc[0]):
            out.append((pdf["version_id"].iloc[0], 0, 1, None, "Front Matter", "Front Matter"))
            stack, paths = [0], {0: "Front Matter"}
        for v, o, wanted, title in zip(pdf["version_id"], pdf["section_order"], pdf["level"], pdf["title"], strict=True):
            level = min(int(wanted), len(stack) + 1) if stack else 1
            del stack[level - 1 :]
            parent = stack[-1] if stack else None
            paths[o] = f"{paths[parent]} > {title}" if parent is not None else title
            out.append((v, int(o), level, parent, title, paths[o]))
            stack.append(o)
        return pd.DataFrame(out, columns=["version_id", "section_order", "section_level", "parent_order", "section_title", "section_path"]).astype({"parent_order": "Int32"})

    kind = blocks.schema["version_id"].dataType.simpleString()
    tree = heads.groupBy("version_id").applyInPandas(nest, f"version_id {kind}, section_order int, section_level int, parent_order int, section_title string, section_path string")
    joined = marked.drop("_level", "_title", "_front").join(tree, ["version_id", "section_order"], "left").withColumnRenamed("_ord", "block_order")
    # a document without any heading is front matter throughout
    alone = {"section_level": F.lit(1), "section_title": F.lit("Front Matter"), "section_path": F.lit("Front Matter")}
    return joined.withColumns({c: F.coalesce(F.col(c), v) for c, v in alone.items()})


def section_table(located: DataFrame) -> DataFrame:
    """One row for each section: page range and blocks in order."""
    keys = ["version_id", "section_order", "section_level", "parent_order", "section_title", "section_path"]
    blocks = F.transform(F.sort_array(F.collect_list(F.struct("block_order", "block_id"))), lambda b: b["block_id"])
    return located.groupBy(*keys).agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"), blocks.alias("source_block_ids"))


def _element(located: DataFrame) -> tuple[DataFrame, Column, Column]:
    """The blocks with element_type and label, null for others; and a caption's word and number."""
    t = X.collapse("text")
    word, number = F.lower(F.regexp_extract(t, CAPTION, 1)), F.regexp_extract(t, CAPTION, 2)
    own = F.when(F.col("block_type").isin("figure", "table", "equation", "algorithm"), F.col("block_type"))
    by_caption = F.when(word.startswith("fig"), "figure").when(word.startswith("table"), "table").when(word.startswith("alg"), "algorithm").when(word.startswith("eq"), "equation")
    found = located.withColumn("element_type", F.coalesce(own, by_caption))
    label = F.when(F.col("element_type").isNotNull() & (word != "") & (number != ""), F.concat_ws(" ", F.initcap("element_type"), number))
    return found.withColumn("label", label), word, t


def elements(located: DataFrame) -> DataFrame:
    """Figures, tables, equations and algorithms, by block type or caption."""
    found, word, t = _element(located)
    return found.where("element_type is not null").select(
        "version_id", "section_order", "block_order", "block_id", "element_type", "label",
        F.when((word != "") & (F.col("element_type") != "equation"), t).alias("caption"), F.when(F.col("element_type") == "equation", t).alias("content"), F.col("page_number").alias("page"),
    )


def groups(located: DataFrame) -> DataFrame:
    """Semantic groups: elements with the blocks that depend on them, all other blocks alone, in order, empty ones left out.

    A block is linked to the one before it in its section if either is an element on which the other depends; runs of
    linked blocks are groups. Blocks stay in the task of their document.
    """
    stay_with_document(located.sparkSession)
    place = Window.partitionBy("version_id", "section_order").orderBy("block_order")
    near, _, _ = _element(located)
    for name, step in (("before", F.lag), ("after", F.lead)):
        near = near.withColumns({f"_{name}_text": F.lower(step("text").over(place)), f"_{name}_type": step("block_type").over(place)})
    label = F.lower("label")
    mentions = lambda t: F.coalesce(F.contains(t, label), F.lit(False))
    continues = F.coalesce(F.col("_after_text").rlike("^(?:" + "|".join(CONTINUES) + ")"), F.lit(False))
    element, equation = F.col("element_type").isNotNull(), F.col("element_type") == "equation"
    back = F.col("_before_text").isNotNull() & (F.col("_before_type") != "heading") & (mentions(F.col("_before_text")) | (equation & (F.size(F.split(X.collapse("_before_text"), " ")) <= 80)))
    ahead = F.col("_after_text").isNotNull() & (mentions(F.col("_after_text")) | (equation & continues))
    near = near.withColumns({"_back": F.coalesce(element & back, F.lit(False)), "_ahead": F.coalesce(element & ahead, F.lit(False))})
    near = near.drop("_before_text", "_before_type", "_after_text", "_after_type")
    near = near.withColumn("_linked", F.col("_back") | F.coalesce(F.lag("_ahead").over(place), F.lit(False)))
    near = near.withColumn("_member", element | F.col("_linked") | F.coalesce(F.lead("_linked").over(place), F.lit(False)))
    owned = near.withColumn("_group", F.max(F.when(~F.col("_linked"), F.col("block_order"))).over(place))
    ordered = F.sort_array(F.collect_list(F.struct("block_order", "block_id", F.trim("text").alias("text"), "element_type")))
    made = owned.groupBy("version_id", "section_order", "section_path", "_group").agg(ordered.alias("_b"), F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"), F.max("_member").alias("dependency"))
    text = F.array_join(F.filter(F.transform("_b", lambda b: b["text"]), lambda t: t != ""), "\n\n")
    made = made.select(
        "version_id", "section_order", "section_path", "_group", text.alias("text"), "page_start", "page_end", "dependency",
        F.transform("_b", lambda b: b["block_id"]).alias("source_block_ids"), F.array_distinct(F.filter(F.transform("_b", lambda b: b["element_type"]), lambda e: e.isNotNull())).alias("element_types"),
    ).where("text <> ''")
    return made.withColumns({"group_order": F.row_number().over(Window.partitionBy("version_id").orderBy("section_order", "_group")) - 1, "token_count": X.count_tokens("text")}).drop("_group")


def _pieces(text: str, most: int) -> list[str]:
    """Sentences packed up to a number of tokens; a longer sentence is packed by tokens."""

    def pack(parts: list[str]) -> list[str]:
        out, held, size = [], [], 0
        for p in parts:
            n = len(_TOKEN.findall(p))
            if held and size + n > most:
                out.append(" ".join(held))
                held, size = [], 0
            held.append(p)
            size += n
        return [*out, " ".join(held)] if held else out

    told = []
    for piece in pack(_SENTENCE.split(text)):
        told += pack(_TOKEN.findall(piece)) if len(_TOKEN.findall(piece)) > most else [piece]
    return told


class _Group(NamedTuple):
    version_id: object
    section_order: int
    section_path: str
    group_order: int
    text: str
    token_count: int
    page_start: int
    page_end: int
    dependency: bool
    source_block_ids: list[str]
    element_types: list[str]


def _packed(groups: list[_Group], target: int, most: int, fill: float) -> list[tuple]:
    """A document's chunks: its groups in order, packed within their sections."""
    out: list[list[tuple[_Group, str]]] = []
    held: list[tuple[_Group, str]] = []
    used, section = 0, None
    for g in groups:
        if held and g.section_order != section:
            out.append(held)
            held, used = [], 0
        section = g.section_order
        whole = g.dependency or g.token_count <= most
        for piece in [g.text] if whole else _pieces(g.text, most):
            n = g.token_count if whole else len(_TOKEN.findall(piece))
            if held and used + n > target and not (used + n <= most and used < target * fill):
                out.append(held)
                held, used = [], 0
            held.append((g, piece))
            used += n
    if held:
        out.append(held)
    rows = []
    for i, held in enumerate(out):
        text, gs = "\n\n".join(p for _, p in held), [g for g, _ in held]
        kinds = list(dict.fromkeys(k for g in gs for k in g.element_types))
        kind = kinds[0] if len(kinds) == 1 else "mixed" if kinds else "text"
        orders, blocks = list(dict.fromkeys(g.group_order for g in gs)), list(dict.fromkeys(b for g in gs for b in g.source_block_ids))
        rows.append((gs[0].version_id, gs[0].section_order, gs[0].section_path, i, kind, text, len(_TOKEN.findall(text)), min(g.page_start for g in gs), max(g.page_end for g in gs), orders, blocks))
    return rows


def chunks(grouped: DataFrame, target: int = 600, most: int = 800, fill: float = 0.6) -> DataFrame:
    """Groups packed into chunks of a section: up to `target` tokens, or up to `most` while less than `fill` of the target is used.

    Documents stream through a task in order of their groups; a task holds one document at a time.
    """
    kind = grouped.schema["version_id"].dataType.simpleString()
    schema = T.StructType.fromDDL(
        f"version_id {kind}, section_order int, section_path string, chunk_order int, chunk_type string, text string, token_count int, page_start int, page_end int, group_orders array<int>, source_block_ids array<string>"
    )
    arrow = to_arrow_schema(schema)

    def pack(batches):
        held: list[_Group] = []
        told: list[tuple] = []
        for batch in batches:
            for g in map(_Group, *(batch.column(c).to_pylist() for c in _Group._fields)):
                if held and g.version_id != held[0].version_id:
                    told += _packed(held, target, most, fill)
                    held = []
                held.append(g)
            if told:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*told), arrow)], schema=arrow)
                told = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*_packed(held, target, most, fill)), arrow)], schema=arrow)

    # a window asks for a document's groups in one task, in order, and moves none that are there; its column is handed on so that it stays
    own = Window.partitionBy("version_id").orderBy("section_order", "group_order")
    return grouped.select(*_Group._fields).withColumn("_n", F.row_number().over(own)).mapInArrow(pack, schema)


def blocks_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lines_per_page: int = 40) -> DataFrame:
    """Plain documents as blocks: one for each line that isn't blank."""
    lines = docs.select(F.col(doc_id).alias("version_id"), F.posexplode(F.split(text, "\n")).alias("reading_order", "text")).where(F.trim("text") != "")
    return lines.select("version_id", (F.floor(F.col("reading_order") / lines_per_page) + 1).cast("int").alias("page_number"), F.concat(F.lit("b"), F.col("reading_order")).alias("block_id"), F.lit("paragraph").alias("block_type"), "text", "reading_order", F.lit(None).cast("int").alias("level"))


def markdown(blocks: DataFrame) -> DataFrame:
    """(version_id, markdown): page comments, headings by level, other kinds as placeholders before their text."""
    line = F.when(F.col("block_type") == "heading", F.concat_ws(" ", F.repeat(F.lit("#"), F.coalesce("level", F.lit(1))), "text")).when(F.col("block_type") == "paragraph", F.col("text")).otherwise(F.concat_ws(" ", F.concat(F.lit("["), F.col("block_type"), F.lit("]")), "text"))
    page = blocks.groupBy("version_id", "page_number").agg(F.sort_array(F.collect_list(F.struct("reading_order", "block_id", line.alias("l")))).alias("b"))
    page = page.select("version_id", "page_number", F.concat_ws("\n\n", F.concat(F.lit("<!-- page "), F.col("page_number"), F.lit(" -->")), F.array_join(F.transform("b", lambda b: b["l"]), "\n\n")).alias("p"))
    return page.groupBy("version_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", "p"))), lambda b: b["p"]), "\n\n").alias("markdown"))
