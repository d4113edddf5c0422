"""Counters, statuses, nested children and best matches of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counters(rows: DataFrame, group: list[str], distinct: dict[str, str], where: dict[str, Column], sums: dict[str, str] | None = None) -> DataFrame:
    """One row for each group: distinct values of columns, rows that hold a condition, rows, and sums."""
    out = [F.count_distinct(c).alias(n) for n, c in distinct.items()]
    out += [F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in where.items()]
    out += [F.sum(c).alias(n) for n, c in (sums or {}).items()]
    return rows.groupBy(*group).agg(*out, F.count("*").alias("rows"))


def project_status(files: DataFrame, papers: DataFrame, locations: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """(project_id, files, papers, versions, canonical_files, missing_locations, <part>s, files_<status>...) of each project.

    `files`: project_id, file_id, paper_id, version_id, is_canonical, status; `papers`: paper_id, doi, arxiv_id;
    `locations`: project_id, presence_status; `parts`: tables by name with version_id (sections, chunks and so on).
    """
    known = files.join(papers, "paper_id", "left")
    out = counters(
        known, ["project_id"], {"files": "file_id", "papers": "paper_id", "versions": "version_id"},
        {"canonical_files": F.col("is_canonical"), "files_with_doi": F.col("doi").isNotNull(), "files_with_arxiv_id": F.col("arxiv_id").isNotNull(), **{f"files_{s}": F.col("status") == s for s in ("discovered", "parsed", "indexed", "failed")}},
    ).drop("rows")
    lost = counters(locations, ["project_id"], {}, {"missing_locations": F.col("presence_status") == "missing"}).drop("rows")
    out = out.join(lost, "project_id", "left").withColumn("missing_locations", F.coalesce("missing_locations", F.lit(0)))
    owned = files.where("version_id is not null").select("project_id", "version_id").distinct()
    for name, part in parts.items():
        n = part.groupBy("version_id").agg(F.count("*").alias(name)).join(owned, "version_id").groupBy("project_id").agg(F.sum(name).alias(name))
        out = out.join(n, "project_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def zero_filled(rows: DataFrame, status: str, domain: list[str], flag: Column) -> DataFrame:
    """(status, n, any): every status of the domain with its rows, and whether one of them holds the flag."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(v,) for v in domain], "_status string")
    counted = rows.groupBy(F.col(status).alias("_status")).agg(F.count("*").alias("n"), F.coalesce(F.bool_or(flag), F.lit(False)).alias("any"))
    return names.join(counted, "_status", "left").select(F.col("_status").alias("status"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("any", F.lit(False)).alias("any"))


def run_status(rows: DataFrame, run: str, disposition: str, domain: list[str], issue: Column) -> DataFrame:
    """(run, status, n_<disposition>...): a run with a failed item or an issue is completed_with_issues."""
    counted = by_status(rows, run, disposition, domain)
    bad = rows.groupBy(run).agg(F.bool_or((F.col(disposition) == "failed") | F.coalesce(issue, F.lit(False))).alias("_bad"))
    return counted.join(bad, run).withColumn("status", F.when(F.col("_bad"), "completed_with_issues").otherwise("completed")).drop("_bad")


def by_status(rows: DataFrame, group: str, status: str, domain: list[str], prefix: str = "n_") -> DataFrame:
    """(group, <prefix><status>...): rows of each status of the domain, 0 where there are none."""
    return rows.groupBy(group).agg(*(F.count_if(F.col(status) == s).alias(f"{prefix}{s}") for s in domain))


def nested(parents: DataFrame, children: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Parents that have children, with `children`, an array in order, and `digest`, the hash of their sorted lines."""
    line = F.concat_ws(":", *order)
    held = children.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order))).alias("children"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("digest"))
    return parents.join(held, key)


def best_match(rows: DataFrame, group: str, score: str, key: str) -> DataFrame:
    """(group, best, score): the row of the greatest score, ties to the least key."""
    own = Window.partitionBy(group).orderBy(F.desc(score), F.asc(key))
    return rows.withColumn("_n", F.row_number().over(own)).where("_n = 1").select(group, F.col(key).alias("best"), F.col(score).alias("score"))


def mentioned(rows: DataFrame, words: dict[str, str]) -> DataFrame:
    """Rows of which some column contains its words, without regard to case."""
    hit = F.lit(False)
    for column, word in words.items():
        hit = hit | F.contains(F.lower(column), F.lit(word.lower()))
    return rows.where(hit)


def edges_of(edges: DataFrame, ends: dict[str, str], chosen: DataFrame, key: list[str]) -> DataFrame:
    """Edges of which either end is chosen: a union of the ends, one semi join. `ends`: type by column; `chosen`: type, id."""
    each = F.array(*(F.struct(F.lit(t).alias("type"), F.col(c).cast("string").alias("id")) for c, t in ends.items()))
    told = edges.select(*key, F.explode(each).alias("_e")).select(*key, "_e.*")
    hit = told.join(chosen.select("type", F.col("id").cast("string").alias("id")).distinct(), ["type", "id"], "left_semi").select(*key).distinct()
    return edges.join(hit, key, "left_semi")


def superseded(rows: DataFrame, keys: list[str], order: list[str], row_id: str) -> DataFrame:
    """Rows with is_active and superseded_by: each generation of a key ends the one before."""
    after = F.lead(row_id).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("superseded_by", after).withColumn("is_active", F.col("superseded_by").isNull())
