"""Readers and writers: tables, files, JSON lines, manifests, content-addressed blobs."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_files(spark: SparkSession, root: str, suffix: str = "pdf", ignored: tuple[str, ...] = (".state",)) -> DataFrame:
    """Files below a root by relative path: their hash, size and time of change; ignored folders left out, ordered by folded path."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), "^" + F_quote(root.rstrip("/")) + "/", "")
    rows = files.select(relative.alias("relative_path"), F.sha2("content", 256).alias("file_hash"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))
    for name in ignored:
        rows = rows.where(~F.array_contains(F.split("relative_path", "/"), name))
    return rows.dropDuplicates(["relative_path"]).orderBy(F.lower("relative_path"), "relative_path")


def F_quote(text: str) -> str:
    """A literal inside a Java pattern."""
    return "\\Q" + text + "\\E"


def outside(paths: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Issue rows of targets that don't lie below the root."""
    inside = F.startswith(F.col(path), F.lit(root.rstrip("/") + "/")) & ~F.array_contains(F.split(path, "/"), "..")
    return paths.where(~inside & (F.col(path) != root)).select(F.col(path), F.lit("path_outside_project").alias("issue"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Objects with sorted keys, one a line."""
    df.select(canonical_json(df).alias("value")).write.mode("overwrite").text(path)


def canonical_json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*sorted(df.columns)))


def manifest(outputs: dict[str, DataFrame], line: str = "value") -> DataFrame:
    """(name, rows, digest) of each output; the digest doesn't depend on the order of rows."""
    parts = [df.select(F.lit(n).alias("name"), F.sha2(canonical_json(df), 256).alias("h")) for n, df in outputs.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    # a sum of 60-bit hashes is mergeable, so no group gathers in one place
    return both.groupBy("name").agg(F.count("*").alias("rows"), F.sum(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest"))


def unchanged(first: DataFrame, second: DataFrame, path: str = "relative_path") -> DataFrame:
    """Files of a scan with an issue if a second scan finds another size or time of change, or no file: it changed while it was read."""
    after = second.select(path, F.col("file_size").alias("_size"), F.col("modified").alias("_time"))
    same = (F.col("_size") == F.col("file_size")) & (F.col("_time") == F.col("modified"))
    return first.join(after, path, "left").withColumn("issue", F.when(~F.coalesce(same, F.lit(False)), "changed_while_read")).drop("_size", "_time")


def checksums(files: DataFrame) -> DataFrame:
    """Lines of a checksum file: the hash, two blanks, the path."""
    return files.orderBy("relative_path").select(F.concat(F.col("file_hash"), F.lit("  "), F.col("relative_path")).alias("value"))


def project_manifest(spark: SparkSession, path: str, project: str, name: str) -> dict:
    """The identity in a project's manifest, which is made if there is none; an existing one stays as it is.

    The file appears whole: it is written aside and then renamed, and whoever comes second reads the first one's.
    """
    conf, at = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(conf)
    if not files.exists(at):
        aside = f"{path}.{uuid.uuid4().hex}"
        text = json.dumps({"name": name, "project_id": project, "schema_version": 1}, sort_keys=True)
        out = files.create(spark._jvm.org.apache.hadoop.fs.Path(aside))
        out.write(bytearray(text.encode()))
        out.close()
        if not files.rename(spark._jvm.org.apache.hadoop.fs.Path(aside), at):
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(aside), False)
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def look_up(titles: DataFrame, cache: DataFrame, key: str = "title_key") -> DataFrame:
    """Titles with the registry's answer from a table of fetched ones: found, error (asked in vain) or not_queried.

    `cache`: key, answer (null where the registry failed or knew nothing), error.
    """
    newest = cache.withColumn("_c", F.lit(True)).dropDuplicates([key])
    joined = titles.join(newest, key, "left")
    status = F.when(F.col("_c").isNull(), "not_queried").when(F.col("error").isNotNull(), "error").when(F.col("answer").isNull(), "not_found").otherwise("found")
    return joined.withColumn("lookup", status).drop("_c")


def select_parser(name: str, available: dict[str, object]) -> str:
    """The parser asked for, or for `auto` the first that is available."""
    if name == "auto":
        if not available:
            raise LookupError("no parser is available")
        return next(iter(available))
    if name not in available:
        raise LookupError(f"parser {name} is not available")
    return name


def parse_documents(files: DataFrame, parser, block_schema: str = "page_number int, block_id string, block_type string, text string, reading_order int, level int") -> DataFrame:
    """Blocks of files by a parser, a function from bytes to block tuples; a file that it can't read gives an error row.

    `files`: version_id, content. The port for parsers that this package doesn't bring.
    """
    kind = files.schema["version_id"].dataType.simpleString()
    names = [c.split()[0] for c in block_schema.split(", ")]

    def run(frames):
        for frame in frames:
            rows = []
            for v, content in zip(frame["version_id"], frame["content"], strict=True):
                try:
                    rows += [(v, *b, None) for b in parser(bytes(content))]
                except Exception as e:  # noqa: BLE001 - a file's failure is a row, and the run goes on
                    rows.append((v, *(None,) * len(names), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["version_id", *names, "error"]).astype({n: "Int32" for n in ("page_number", "reading_order", "level") if n in names})

    return files.select("version_id", "content").mapInPandas(run, f"version_id {kind}, {block_schema}, error string")


def plain_text(content: bytes) -> list[tuple]:
    """A parser of plain texts: pages at form feeds, blocks at blank lines."""
    out, order = [], 0
    for page, text in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
        for part in text.split("\n\n"):
            if part.strip():
                out.append((page, f"b{order}", "paragraph", part.strip(), order, None))
                order += 1
    return out


def save_documents(blocks: DataFrame) -> DataFrame:
    """(version_id, document, digest): a parsed document as one canonical JSON text, and its hash."""
    fields = sorted(c for c in blocks.columns if c != "version_id")
    ordered = F.sort_array(F.collect_list(F.struct("page_number", "reading_order", F.struct(*fields).alias("b"))))
    whole = blocks.groupBy("version_id").agg(F.to_json(F.struct(F.transform(ordered, lambda x: x["b"]).alias("blocks"))).alias("document"))
    return whole.withColumn("digest", F.sha2("document", 256))


def load_documents(saved: DataFrame, schema: str) -> DataFrame:
    """Blocks of saved documents; one whose hash doesn't match is an error that names it. `schema`: of a block."""
    sound = F.when(F.sha2("document", 256) == F.col("digest"), F.col("document")).otherwise(F.raise_error(F.concat(F.lit("corrupt document: "), F.col("version_id").cast("string"))))
    return saved.select("version_id", F.inline(F.from_json(sound, f"struct<blocks:array<struct<{schema}>>>")["blocks"]))


def delete_blobs(current: DataFrame, gone: DataFrame) -> DataFrame:
    return current.join(gone.select("content_hash"), "content_hash", "left_anti")


def get_blobs(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted hashes with their payload and status: ok, missing or corrupt."""
    joined = wanted.select("content_hash").distinct().join(current, "content_hash", "left")
    status = F.when(F.col("payload").isNull(), "missing").when(F.sha2("payload", 256) != F.col("content_hash"), "corrupt").otherwise("ok")
    return joined.withColumn("status", status).withColumn("payload", F.when(status == "ok", F.col("payload")))


def put_blobs(current: DataFrame | None, payloads: DataFrame, payload: str) -> DataFrame:
    """Content-addressed rows: content_hash, payload; known hashes are left as they are, corrupt ones replaced."""
    fresh = payloads.select(F.sha2(payload, 256).alias("content_hash"), F.col(payload).alias("payload")).dropDuplicates(["content_hash"])
    if current is None:
        return fresh
    sound = current.where(F.sha2("payload", 256) == F.col("content_hash"))
    return sound.unionByName(fresh.join(sound.select("content_hash"), "content_hash", "left_anti"))
