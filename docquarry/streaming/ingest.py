"""Re-ingestion as a stream: batches of documents are merged, and the stages that have gone stale run again.

A batch may run twice, as after a lost driver. Every table that it changes keeps the
batch's number in the same swap as its rows, so the second run finds its work done
table by table: what is stale is told by the documents' hashes and the stages'
ledger, not by what the batch has just changed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import stale
from ..sources.buckets import BucketTable
from ..sources.staging import staged

Stage = tuple[str, str, Callable[[DataFrame], DataFrame], BucketTable]


def merge_stream(stream: DataFrame, table: BucketTable, name: str, checkpoint: str, matched: dict[str, Column] | None = None, order: list[str] | None = None) -> StreamingQuery:
    """Each batch of a stream merged into a table once, whatever is run again. Ends when what is there has been read."""
    step = lambda batch, number: table.merge(batch, matched, order, mark=(name, number))
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_batch(batch: DataFrame, number: int, name: str, documents: BucketTable, ledger: BucketTable, stages: list[Stage], key: str = "version_id", digest: str = "document_hash", order: list[str] | None = None) -> dict[str, int]:
    """Merge a batch of documents and run its stale stages in order; returns how many documents each stage has worked on.

    `stages`: (name, version, from documents to rows, table of these rows, one or more a document that carry `key`).
    A stage's rows of a document replace the earlier ones. The ledger gets a stage's runs after its rows are in place.
    """
    rows = staged(batch, "batch")
    changed = {c: F.when(F.col("old." + digest).eqNullSafe(F.col("new." + digest)), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")) for c in documents.schema.fieldNames()}
    documents.merge(rows, changed, order, mark=(name, number))
    mine = documents.read().join(rows.select(key).distinct(), key, "left_semi")
    plan = staged(stale(mine, ledger.read(), [(n, v) for n, v, *_ in stages], key, digest), "stale")
    told = {}
    for stage, version, work, table in stages:
        due = mine.join(plan.where(F.col("stage") == stage).select(key), key, "left_semi")
        told[stage] = due.count()
        if told[stage]:
            table.replace(staged(work(due), stage), [key], mark=(name, number))
            ledger.merge(due.select(key, F.lit(stage).alias("stage"), F.lit(version).alias("stage_version"), digest), mark=(f"{name}:{stage}", number))
    return told


def reingest(stream: DataFrame, name: str, checkpoint: str, documents: BucketTable, ledger: BucketTable, stages: list[Stage], key: str = "version_id", digest: str = "document_hash", order: list[str] | None = None) -> StreamingQuery:
    """apply_batch for each batch of a stream."""
    step = lambda batch, number: apply_batch(batch, number, name, documents, ledger, stages, key, digest, order) and None
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
