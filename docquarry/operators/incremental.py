"""Identity, deduplication and incremental upkeep as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """One row of each key: the first by a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")


def classify_files(seen: DataFrame, known: DataFrame, path: str = "path", digest: str = "file_hash") -> DataFrame:
    """unchanged (path known with this hash), duplicate (another path has the hash), modified (path known), new."""
    at = known.select(path, F.col(digest).alias("_was")).distinct()
    hashes = known.select(digest).distinct().withColumn("_has", F.lit(True))
    joined = seen.join(at, path, "left").join(hashes, digest, "left")
    state = F.when(F.col("_was") == F.col(digest), "unchanged").when(F.col("_was").isNull() & F.col("_has"), "duplicate").when(F.col("_was").isNotNull(), "modified").otherwise("new")
    return joined.withColumn("state", state).drop("_was", "_has")


def resolve_identity(files: DataFrame, papers: DataFrame, rules: list[tuple[list[str], float, str]]) -> DataFrame:
    """files with paper_id, confidence and matched_by of the first rule that matches; null paper_id: new.

    A rule: columns that must be equal (and not null), confidence, name. The least paper_id wins among equals.
    """
    out, ids, scores, names = files, [], [], []
    for i, (columns, confidence, name) in enumerate(rules):
        target = papers.groupBy(*columns).agg(F.min("paper_id").alias(f"_p{i}"))
        for c in columns:
            target = target.where(F.col(c).isNotNull())
        out = out.join(target, columns, "left")
        ids.append(F.col(f"_p{i}"))
        scores.append(F.when(F.col(f"_p{i}").isNotNull(), F.lit(confidence)))
        names.append(F.when(F.col(f"_p{i}").isNotNull(), F.lit(name)))
    return out.withColumns({"paper_id": F.coalesce(*ids), "confidence": F.coalesce(*scores, F.lit(1.0)), "matched_by": F.coalesce(*names, F.lit("new"))}).drop(*(f"_p{i}" for i in range(len(rules))))


def source_type(arxiv: str = "arxiv_id", doi: str = "doi") -> Column:
    return F.when(F.col(arxiv).isNotNull(), "arxiv").when(F.col(doi).isNotNull(), "doi").otherwise("local")


def fill_nulls(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge in which a value of the target that isn't null wins."""
    rest = [c for c in target.columns if c not in keys]
    joined = target.alias("t").join(source.alias("s"), keys, "full_outer")
    return joined.select(*keys, *(F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")).alias(c) for c in rest))


def insert_or_ignore(current: DataFrame, incoming: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    return current.unionByName(first_by(incoming, keys, by).join(current.select(*keys), keys, "left_anti").select(*current.columns))


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """Incoming rows replace those of their key; among incoming rows of a key the first by an order counts."""
    fresh = first_by(incoming, keys, by)
    return current.join(fresh.select(*keys), keys, "left_anti").select(*current.columns).unionByName(fresh.select(*current.columns))


def replace_slices(current: DataFrame, incoming: DataFrame, slice_key: str) -> DataFrame:
    """All rows of the incoming slices replace the current ones."""
    return current.join(incoming.select(slice_key).distinct(), slice_key, "left_anti").select(*current.columns).unionByName(incoming.select(*current.columns))


def missing(known: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return known.join(seen.select(*keys).distinct(), keys, "left_anti")


def mark_missing(known: DataFrame, seen: DataFrame, keys: list[str], status: str = "presence_status") -> DataFrame:
    found = seen.select(*keys).distinct().withColumn("_here", F.lit(True))
    return known.join(found, keys, "left").withColumn(status, F.when(F.col("_here"), "present").otherwise("missing")).drop("_here")


def stale(documents: DataFrame, ledger: DataFrame, stages: list[tuple[str, str]], key: str = "version_id", digest: str = "document_hash") -> DataFrame:
    """(key, stage) still to run: its version or the document's hash differs from the ledger, or an earlier stage runs again.

    `stages`: (name, version) in order; `ledger`: key, stage, stage_version, digest of the last runs.
    """
    plan = F.array(*(F.struct(F.lit(n).alias("stage"), F.lit(v).alias("stage_version"), F.lit(i).alias("_i")) for i, (n, v) in enumerate(stages)))
    wanted = documents.select(key, digest, F.explode(plan).alias("_s")).select(key, digest, "_s.*")
    done = ledger.select(key, "stage", "stage_version", digest).distinct().withColumn("_ok", F.lit(True))
    joined = wanted.join(done, [key, "stage", "stage_version", digest], "left")
    first = F.min(F.when(F.col("_ok").isNull(), F.col("_i"))).over(Window.partitionBy(key))
    return joined.withColumn("_first", first).where(F.col("_i") >= F.col("_first")).select(key, "stage")


def to_compute(documents: DataFrame, reusable: DataFrame, digest: str = "content_hash") -> tuple[DataFrame, DataFrame]:
    """(rows whose hash has no vector yet, rows with the vector of an equal hash)."""
    return documents.join(reusable.select(digest), digest, "left_anti"), documents.join(reusable.dropDuplicates([digest]), digest)


def expired(df: DataFrame, now: Column, status: str = "status", at: str = "expires_at") -> DataFrame:
    return df.withColumn(status, F.when((F.col(status) == "active") & (F.col(at) < now), "expired").otherwise(F.col(status)))


def exact_duplicates(df: DataFrame, digest: str, member: str) -> DataFrame:
    """Rows (digest, copies, member) of the contents that several members have; a group isn't gathered."""
    rows = df.where(F.col(digest).isNotNull())
    many = rows.groupBy(digest).agg(F.count("*").alias("copies")).where("copies > 1")
    return rows.select(digest, member).join(many, digest).select(digest, "copies", member)
