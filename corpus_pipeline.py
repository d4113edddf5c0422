"""The corpus pipeline: five stages from `documents` to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes
as Parquet to the shared folder and reads again for the next stage. All but the
last return the columns of `documents`.

toxicity    drops the documents that the classifier rejects. A null text counts
            as empty and stays unless empty texts are called toxic; equal texts
            share a fate; labels that are null or held out teach nothing.
near_copies keeps of each group of linked documents the one with the least
            doc_id (rows without a doc_id last, then by place in the input);
            documents without words are all kept. Ties on doc_id go by the
            place, so one row of each group stays whatever repeats.
repeats     removes all copies of sequences of 50 words that repeat, within a
            text or elsewhere, with the white space after them; rewrites text
            and n_chars, keeps rows. A null text comes out empty. A document
            that repeats another one whole loses all its words, so copies that
            are to stay once go in the stage before.
mixture     orders all rows so that sources keep to their target weights. A null
            source is a source; rows with equal keys are ordered by text.
tokens      encodes and decodes: doc_id and the digests of op2, in the order of
            its input. A null text has no ids; repeated rows each give a row.

All stages read whole texts of any length, give an empty table for an empty one,
and keep extra columns of `documents`, whatever their names, up to the last.

Spark reads files in an order of its own. The tokens stage and run() therefore
rebuild each row's place from its file's part number and its row number there.

SQL can't express the stages' models, so there is no ORACLE_SQL; tests hold each
stage against a plain version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import bpe, mixing, partenum, suffixdup, toxicity
from docquarry.llm.common import table, written
from docquarry.llm.queries import vocabulary

#: Up to so many keys of dropped rows are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 500_000
#: Words of a repeated passage.
REPEAT_WORDS = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))
    return toxicity.score(rows, model, ("_row",), "_text").where("predicted = 0").select("_row.*")


def _free(name: str, columns: list[str]) -> str:
    while name.lower() in (c.lower() for c in columns):
        name = "_" + name
    return name


def _with_place(docs: DataFrame, name: str) -> DataFrame:
    """Rows of files with a key that orders and tells them apart however the files are split."""
    place = [F.col("doc_id").isNull().alias("lost"), F.col("doc_id").alias("id"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        return docs.withColumn(name, F.struct(*place))
    except AnalysisException:  # it doesn't come from files
        return written(docs, "pipeline-rows").withColumn(name, F.struct(*place))


def _in_written_order(docs: DataFrame, name: str) -> DataFrame:
    """Rows of files that Spark wrote, with a key of their order when they were written."""
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long")
    place = F.struct(part.alias("part"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return docs.withColumn(name, place)
    except AnalysisException:  # it doesn't come from files
        return written(docs, "pipeline-rows").withColumn(name, place)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    at = _free("_place", docs.columns)
    placed = _with_place(docs, at)
    found = partenum.jaccard_components(placed, key=at)
    gone = written(found.where(F.col(at) != F.col("component_id")).select(at), "pipeline-copies")
    few = gone.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return placed.join(F.broadcast(gone) if few else gone, at, "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.select(F.struct(*rest).alias("_row"), "text")
    kept = suffixdup.remove_repeats(rows, key="_row", texts=True, length=REPEAT_WORDS, unit="words").select("_row.*", F.col("kept").alias("text"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _in_written_order(docs.select("doc_id", "text"), "_at").select(F.struct("_at", "doc_id").alias("_row"), "text")
    # written first: a sort reads its input twice, for its borders and for the rows
    told = written(bpe.encode_digests(rows, vocabulary(), public_tokenizers.PATTERN, key="_row"), "pipeline-encoded")
    return told.orderBy("_row._at").select("_row.doc_id", *told.columns[1:])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", drop_repeats),
    ("mixture", mix_sources),
    ("tokens", encode_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    at = _free("_at", docs.columns)
    return _in_written_order(docs, at).orderBy(at).select(*docs.columns)
