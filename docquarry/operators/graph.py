"""Profiles, claims, entities, relations, their upkeep, and comparison of papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..sources.staging import small

#: Cues of profile fields in sentences.
FIELD_CUES = {
    "research_problem": ["we address", "research problem", "challenge", "task of", "问题", "挑战", "目标"],
    "motivation": ["motivat", "existing methods", "however", "because", "现有方法", "由于", "然而"],
    "hypotheses": ["hypoth", "we posit", "we conjecture", "假设"],
    "contributions": ["contribution", "we propose", "we introduce", "贡献", "我们提出"],
    "assumptions": ["we assume", "assumption", "假定", "假设条件"],
    "experimental_settings": ["implementation detail", "we train", "learning rate", "batch size", "实验设置", "训练设置"],
    "key_results": ["outperform", "achieve", "improve", "state-of-the-art", "结果表明", "优于", "提升"],
    "limitations": ["limitation", "is limited", "drawback", "局限", "限制"],
    "failure_cases": ["failure case", "fails when", "failure mode", "失败"],
    "future_work": ["future work", "in the future", "后续工作", "未来工作"],
}
#: Cues of profile fields in section paths.
SECTION_CUES = {
    "method_components": ["method", "approach", "framework", "model", "方法", "模型"],
    "key_results": ["result", "experiment", "evaluation", "结果", "实验"],
    "limitations": ["limitation", "discussion", "局限", "讨论"],
}
#: Fixed values: (field, entity type, pattern whose group lists names).
NAMED = [
    ("datasets", "dataset", r"(?i)\b(?:datasets?|benchmarks?)\s*(?:include|such as|:|=|are|is)\s*([^.;。；]+)"),
    ("metrics", "metric", r"(?i)\b(?:metrics?|measures?)\s*(?:include|such as|:|=|are|is)\s*([^.;。；]+)"),
    ("baselines", "baseline", r"(?i)\b(?:baselines?|compared with|compare against)\s*(?:include|such as|:|=|are|is)?\s*([^.;。；]+)"),
    ("method_name", "method", r"(?i)\b(?:method|model|framework)\s*(?:called|named|:|=|is)\s*([A-Za-z][\w-]{1,80})"),
]
#: Claim type of a field; relation of an entity type.
CLAIM_OF = {
    "research_problem": "problem", "hypotheses": "hypothesis", "contributions": "contribution", "method_name": "method", "method_family": "method", "method_components": "method",
    "assumptions": "assumption", "key_results": "result", "limitations": "limitation", "failure_cases": "limitation", "future_work": "future_work",
}
RELATION_OF = {"method": "uses_method", "method_component": "uses_method", "dataset": "evaluates_on", "baseline": "uses_method"}
#: Values kept of a profile field.
FIELD_VALUES = 5


def _lookup(values: dict[str, str], key: Column | str) -> Column:
    table = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.element_at(table, F.col(key) if isinstance(key, str) else key)


def _any(text: Column, cues: list[str]) -> Column:
    out = F.lit(False)
    for cue in cues:
        out = out | F.contains(text, F.lit(cue))
    return out


def field_candidates(chunks: DataFrame) -> DataFrame:
    """(paper_id, version_id, chunk_id, chunk_order, field, value, confidence, place) from sentences, section paths and names."""
    said = chunks.withColumn("_s", X.evidence_sentences("text"))
    keep = ["paper_id", "version_id", "chunk_id", "chunk_order"]
    head = F.get("_s", F.lit(0))
    sections = []
    for field, cues in SECTION_CUES.items():
        hit = _any(F.lower("section_path"), cues) & head.isNotNull()
        if field == "key_results":
            hit = hit & _any(F.lower(head), FIELD_CUES["key_results"])
        sections.append(F.when(hit, F.struct(F.lit(field).alias("field"), head.alias("value"), F.lit(0.65).alias("confidence"), F.lit(-1).alias("place"))))

    def said_fields(sentence: Column, place: Column) -> Column:
        low = F.lower(sentence)
        told = F.array(*(F.when(_any(low, cues), F.lit(field)) for field, cues in FIELD_CUES.items()))
        return F.transform(F.filter(told, lambda f: f.isNotNull()), lambda f: F.struct(f.alias("field"), sentence.alias("value"), F.lit(0.72).alias("confidence"), place.alias("place")))

    def named(field: str, pattern: str, base: int) -> Column:
        split = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(pattern), 1), lambda v: F.split(v, r",|\band\b|\bor\b")))
        clean = F.filter(F.transform(split, lambda v: F.regexp_replace(v, r"^[ \t\n:;,.()\[\]]+|[ \t\n:;,.()\[\]]+$", "")), lambda v: (v != "") & (F.length(v) <= 120))
        return F.transform(clean, lambda v, i: F.struct(F.lit(field).alias("field"), v.alias("value"), F.lit(0.82).alias("confidence"), (i + base).alias("place")))

    spoken = F.flatten(F.transform("_s", said_fields))
    names = [named(field, pattern, 100_000 * (n + 1)) for n, (field, _, pattern) in enumerate(NAMED)]
    found = F.concat(F.filter(F.array(*sections), lambda s: s.isNotNull()), spoken, *names)
    return said.select(*keep, F.explode(found).alias("_f")).select(*keep, "_f.*")


def profile(chunks: DataFrame) -> DataFrame:
    """The first values of each field, distinct after normalisation, with ordinal and evidence."""
    rows = field_candidates(chunks).withColumn("normalized", X.normalize_statement("value")).where("normalized <> ''")
    by = [F.col("chunk_order"), F.col("chunk_id"), F.col("place"), F.col("value")]
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("version_id", "field", "normalized").orderBy(*by))).where("_n = 1")
    ranked = first.withColumn("ordinal", F.row_number().over(Window.partitionBy("version_id", "field").orderBy(*by)) - 1).where(F.col("ordinal") < FIELD_VALUES)
    return ranked.select("paper_id", "version_id", "field", "ordinal", F.trim("value").alias("value"), "normalized", "confidence", "chunk_id", X.key_hash("version_id", "field", "ordinal", "chunk_id", "normalized").alias("field_id"))


def claims(profiles: DataFrame) -> DataFrame:
    made = profiles.withColumn("claim_type", _lookup(CLAIM_OF, "field")).where("claim_type is not null")
    return made.select("paper_id", "version_id", "claim_type", F.col("value").alias("statement"), F.col("normalized").alias("normalized_statement"), "confidence", "chunk_id", X.key_hash(F.lit("claim"), "field_id", "claim_type").alias("claim_id"))


def entities(chunks: DataFrame, project: str = "default") -> DataFrame:
    """Named entities of a paper, first occurrence by type and normalised name, with their relation (metrics have none)."""
    rows = field_candidates(chunks).where(F.col("field").isin(*(f for f, *_ in NAMED)) & (F.col("confidence") == 0.82))
    rows = rows.withColumns({"entity_type": _lookup({f: t for f, t, _ in NAMED}, "field"), "normalized": X.normalize_statement("value")})
    own = Window.partitionBy("paper_id", "entity_type", "normalized").orderBy("chunk_order", "chunk_id", "place")
    first = rows.withColumn("_n", F.row_number().over(own)).where("_n = 1")
    return first.select("paper_id", F.col("value").alias("canonical_name"), "entity_type", "normalized", "chunk_id", _lookup(RELATION_OF, "entity_type").alias("relation_type"), X.key_hash(F.lit("entity"), F.lit(project), "entity_type", "normalized").alias("entity_id"))


def relations(found: DataFrame) -> DataFrame:
    made = found.where("relation_type is not null")
    text = F.concat(F.lit("Paper "), F.replace("relation_type", F.lit("_"), F.lit(" ")), F.lit(" "), "canonical_name", F.lit("."))
    return made.select("paper_id", "entity_id", "relation_type", text.alias("description"), F.lit(0.78).alias("confidence"), "chunk_id", relation_key(F.lit("paper"), F.col("paper_id").cast("string"), F.lit("entity"), F.col("entity_id"), F.col("relation_type")).alias("relation_key"))


def relation_key(source_type: Column, source: Column, target_type: Column, target: Column, kind: Column, directed: bool = True) -> Column:
    """A key of both ends and the kind; for an undirected relation the lesser end comes first."""
    a, b = F.concat_ws(":", source_type, source), F.concat_ws(":", target_type, target)
    return X.key_hash(a, b, kind) if directed else X.key_hash(F.least(a, b), F.greatest(a, b), kind)


def supersede(current: DataFrame, incoming: DataFrame, key: str, generation: str, row_id: str) -> DataFrame:
    """SCD-2 merge: an incoming row with an active key and the same generation changes nothing; another generation
    ends the active row, which points to its successor. `current` has is_active and superseded_by."""
    active = current.where("is_active").select(F.col(key), F.col(generation).alias("_g"), F.col(row_id).alias("_old"))
    known = incoming.join(active.select(key, F.col("_g").alias(generation)), [key, generation], "left_semi")
    fresh = incoming.join(known.select(row_id), row_id, "left_anti")
    ended = fresh.join(active, key).groupBy("_old").agg(F.min(row_id).alias("_by"))
    kept = current.join(ended.withColumnRenamed("_old", row_id), row_id, "left")
    kept = kept.withColumns({"is_active": F.col("is_active") & F.col("_by").isNull(), "superseded_by": F.coalesce("superseded_by", "_by")}).drop("_by")
    added = fresh.withColumns({"is_active": F.lit(True), "superseded_by": F.lit(None).cast(current.schema["superseded_by"].dataType)})
    return kept.unionByName(added.select(*kept.columns))


def merge_entities(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by (project_id, entity_type, normalized): aliases are united, a null description is filled, the first name stays."""
    both = current.withColumn("_o", F.lit(0)).unionByName(incoming.withColumn("_o", F.lit(1)))
    name = F.min_by("canonical_name", F.struct("_o", "canonical_name"))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat("aliases", F.array("canonical_name"))))))
    merged = both.groupBy("project_id", "entity_type", "normalized").agg(name.alias("canonical_name"), names.alias("aliases"), F.min_by("description", F.when(F.col("description").isNotNull(), F.struct("_o", "description"))).alias("description"))
    return merged.withColumn("aliases", F.filter("aliases", lambda a: a != F.col("canonical_name")))


def verify_claims(claims: DataFrame, evidence: DataFrame, claim_id: str = "claim_id", judge=V.entailment) -> DataFrame:
    """Claims with entailment_status and review_status: verified if their evidence supports them.

    `evidence`: claim_id, evidence_text; `judge`: a Column function of a statement and an array of texts.
    """
    texts = evidence.groupBy(claim_id).agg(F.collect_list("evidence_text").alias("_texts"))
    judged = claims.join(texts, claim_id, "left").withColumn("entailment_status", judge("statement", F.coalesce("_texts", F.array().cast("array<string>"))))
    return judged.withColumn("review_status", F.when(F.col("entailment_status") == "supported", "verified").otherwise("unreviewed")).drop("_texts")


def remap_endpoints(relations: DataFrame, stored: DataFrame) -> DataFrame:
    """Relations whose entity ends point to the stored entities; other ends, and entities that aren't stored, stay.

    `relations`: source_type, source_id, target_type, target_id; `stored`: entity_id (as extracted), stored_id.
    """
    out = relations
    for end in ("source", "target"):
        known = stored.select(F.col("entity_id").alias(f"{end}_id"), F.col("stored_id").alias("_to"))
        out = out.join(known, f"{end}_id", "left").withColumn(f"{end}_id", F.when(F.col(f"{end}_type") == "entity", F.coalesce("_to", f"{end}_id")).otherwise(F.col(f"{end}_id"))).drop("_to")
    return out.select(*relations.columns)


def evidence_links(rows: DataFrame, chunks: DataFrame, target_type: str, target_id: str, relation: str = "supports") -> DataFrame:
    """Links from extracted rows to the chunks they came from, with a key that follows from both; repeats are one.

    `rows`: the target, chunk_id, confidence; `chunks`: chunk_id, paper_id, version_id, section_id, page_start, page_end, text.
    """
    made = rows.select(F.lit(target_type).alias("target_type"), F.col(target_id).cast("string").alias("target_id"), "chunk_id", "confidence").join(chunks.select("chunk_id", "paper_id", "version_id", "section_id", "page_start", "page_end", F.col("text").alias("evidence_text")), "chunk_id")
    key = X.key_hash("target_type", "target_id", "chunk_id", F.lit(relation))
    own = Window.partitionBy("evidence_key").orderBy(F.desc("confidence"))
    return made.withColumns({"relation_to_target": F.lit(relation), "evidence_key": key}).withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def retarget(links: DataFrame, moved: DataFrame) -> DataFrame:
    """Links of targets that became others, under new keys. `moved`: target_type, target_id, new_id."""
    out = links.join(moved, ["target_type", "target_id"], "left").withColumn("target_id", F.coalesce("new_id", "target_id")).drop("new_id")
    return out.withColumn("evidence_key", X.key_hash("target_type", "target_id", "chunk_id", "relation_to_target")).dropDuplicates(["evidence_key"]).select(*links.columns)


def latest_profiles(profiles: DataFrame) -> DataFrame:
    """The newest active profile of each paper."""
    own = Window.partitionBy("paper_id").orderBy(F.desc("updated_at"), F.desc("profile_id"))
    return profiles.where("is_active").withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def flatten_comparison(cells: DataFrame, evidence: DataFrame) -> DataFrame:
    """(dimension, paper_id, chunk_id, evidence_text): the evidence of comparison cells, each chunk once a cell.

    `cells`: dimension, paper_id, evidence (chunk ids); `evidence`: chunk_id, evidence_text.
    """
    each = cells.select("dimension", "paper_id", F.explode(F.array_distinct("evidence")).alias("chunk_id"))
    return each.join(evidence.select("chunk_id", "evidence_text"), "chunk_id").dropDuplicates(["dimension", "paper_id", "chunk_id"]).select("dimension", "paper_id", "chunk_id", "evidence_text")


def find_entities(entities: DataFrame, aliases: DataFrame, words: str, kinds: list[str] | None = None, most: int = 20) -> DataFrame:
    """Entities whose name or some alias contains the words, without regard to case, by name. `aliases`: entity_id, alias."""
    low = F.lit(words.lower())
    named = entities.where(F.contains(F.lower("canonical_name"), low)).select("entity_id")
    also = aliases.where(F.contains(F.lower("alias"), low)).select("entity_id")
    found = entities.join(named.unionByName(also).distinct(), "entity_id", "left_semi")
    return (found.where(F.col("entity_type").isin(*kinds)) if kinds else found).orderBy("canonical_name", "entity_id").limit(most)


def find_relations(relations: DataFrame, end_type: str, end_ids: list, kinds: list[str] | None = None) -> DataFrame:
    """Active relations of which either end is one of the given."""
    at = lambda end: (F.col(f"{end}_type") == end_type) & F.col(f"{end}_id").isin(*end_ids)
    found = relations.where(F.col("is_active") & (at("source") | at("target")))
    return found.where(F.col("relation_type").isin(*kinds)) if kinds else found


def compare(papers: DataFrame, dimensions: DataFrame, values: DataFrame) -> DataFrame:
    """The grid of dimensions and papers with joined values, least confidence, distinct evidence, and each dimension's and the whole's status.

    `papers` and `dimensions` are what a user asks for; `values`: paper_id, dimension, ordinal, value, confidence, chunk_id.
    """
    # the grid is what is asked for; its dimensions are sent to the papers if they are few
    asked = papers.select("paper_id").distinct().crossJoin(small(dimensions.select("dimension").distinct()))
    parts = values.groupBy("paper_id", "dimension").agg(F.sort_array(F.collect_list(F.struct("ordinal", "value"))).alias("_v"), F.min("confidence").alias("confidence"), F.sort_array(F.collect_set("chunk_id")).alias("evidence"))
    cells = asked.join(parts, ["paper_id", "dimension"], "left").select("dimension", "paper_id", F.array_join(F.array_distinct(F.transform("_v", lambda v: v["value"])), " | ").alias("value"), "confidence", F.coalesce("evidence", F.array().cast("array<bigint>") if values.schema["chunk_id"].dataType.simpleString() == "bigint" else F.array().cast("array<string>")).alias("evidence"))
    own = Window.partitionBy("dimension")
    backed = (F.size("evidence") > 0).cast("int")
    cells = cells.withColumn("comparable", F.sum(backed).over(own) >= 2)
    overall = cells.groupBy("dimension").agg(F.first("comparable").alias("c")).agg(F.bool_and("c").alias("_all"), F.bool_or("c").alias("_any"))
    # one row
    return cells.join(F.broadcast(overall), F.lit(True)).withColumn("status", F.when(F.col("_all"), "complete").when(F.col("_any"), "partial").otherwise("insufficient_evidence")).drop("_all", "_any")
