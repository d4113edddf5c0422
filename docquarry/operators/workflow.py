"""Artifacts, views, citations, delegation, sessions: relational state of an agent layer."""

from __future__ import annotations

import functools
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..sources.staging import staged


def offload(media: Column, papers: Column, elements: Column, passages: Column, worker: Column, tokens: Column, running: Column) -> Column:
    """Whether a result becomes an artifact instead of staying in the context."""
    big = (papers > 5) | (elements > 4) | (passages > 4) | (tokens > 2000) | (running > 6000)
    return F.coalesce(~media.startswith("text/"), F.lit(False)) | F.coalesce(worker, F.lit(False)) | F.coalesce(big, F.lit(False))


def running_tokens(rows: DataFrame, session: str, order: list[str], tokens: str) -> DataFrame:
    return rows.withColumn("running", F.sum(tokens).over(Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def materialise(rows: DataFrame, payload: Column, kind: str, project: str, days: int, now: Column) -> DataFrame:
    """Catalog rows whose id follows from the payload, so a second run adds nothing."""
    digest = F.sha2(payload, 256)
    return rows.withColumns({"content_hash": digest, "artifact_id": F.sha2(F.concat_ws(":", F.col(project).cast("string"), F.col(kind), digest), 256), "byte_size": F.octet_length(payload).cast("long"), "token_estimate": X.count_tokens(payload, X.ARTIFACT_TOKEN), "expires_at": now + F.make_dt_interval(F.lit(days))})


def read_status(found: Column, expires: Column, stored_hash: Column, hash_: Column, now: Column) -> Column:
    """null if readable; not found before expired before corrupt."""
    return F.when(found.isNull(), "not_found").when(expires < now, "expired").when(stored_hash != hash_, "corrupt")


def page_by_budget(items: DataFrame, group: str, order: str, tokens: str, budget: int) -> DataFrame:
    """Items with the page they stand on: a page is filled in order up to the budget; an item beyond it has a page alone."""
    schema = f"{group} {items.schema[group].dataType.simpleString()}, {order} {items.schema[order].dataType.simpleString()}, page int"

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        used, page, pages = 0, 0, []
        for t in pdf[tokens]:
            if used and used + t > budget:
                used, page = 0, page + 1
            used += t
            pages.append(page)
        return pdf[[group, order]].assign(page=pages)

    # only sizes meet in a group, the items stay where they are until the join
    pages = items.select(group, order, F.col(tokens).cast("long").alias(tokens)).groupBy(group).applyInPandas(fill, schema)
    return items.join(pages, [group, order])


def fragments(text: Column | str, characters: int) -> Column:
    """Pieces that join to the text again."""
    c = F.col(text) if isinstance(text, str) else text
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(c) / characters).cast("int") - 1)), lambda i: F.substring(c, i * characters + 1, F.lit(characters)))


def check_citations(answers: DataFrame, allowed: DataFrame, answer_id: str = "answer_id", text: str = "text") -> DataFrame:
    """(answer_id, label, status): known, ambiguous (several identities) or unknown."""
    used = answers.select(answer_id, F.explode(X.citations(text)).alias("label"))
    known = allowed.groupBy(answer_id, "label").agg(F.count_distinct("identity").alias("_k"))
    return used.join(known, [answer_id, "label"], "left").withColumn("status", F.when(F.col("_k").isNull(), "unknown").when(F.col("_k") > 1, "ambiguous").otherwise("known")).drop("_k")


def sufficient(reports: DataFrame, task: str = "task_id") -> DataFrame:
    """(task, sufficient): some relevant report cites only what it has."""
    ok = F.col("relevant") & (F.size("cited") > 0) & (F.size(F.array_except("cited", "available")) == 0)
    return reports.groupBy(task).agg(F.bool_or(ok).alias("sufficient"))


def route(papers: Column, explicit: Column) -> Column:
    """Number of workers: none for up to five papers unless asked for, at most five."""
    return F.when(explicit | (papers >= 6), F.least(papers, F.lit(5))).otherwise(0)


#: Kinds of work that check others; the plans of the kinds of task.
VERIFIERS = ["verification", "evidence_verification", "novelty_check"]
PLANS = {
    "multi_paper_comparison": ["method", "datasets", "metrics", "results", "limitations", "verification"],
    "literature_survey": ["retrieval", "screening", "classification", "relation_analysis", "synthesis", "verification"],
    "cross_domain_exploration": ["target_problem_analysis", "source_domain_search", "mechanism_abstraction", "assumption_compatibility", "novelty_check", "evidence_verification"],
}
#: Kinds of work that tell what a task is; the rest are comparisons.
TELLING = {
    "cross_domain_exploration": ["source_domain_search", "mechanism_abstraction", "assumption_compatibility", "novelty_check"],
    "literature_survey": ["retrieval", "screening", "classification", "relation_analysis", "synthesis"],
}


def _strings(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def task_type(workstreams: Column | str) -> Column:
    """What a task is, by the kinds of work asked for."""
    c = F.col(workstreams) if isinstance(workstreams, str) else workstreams
    out = F.lit("multi_paper_comparison")
    for name, kinds in reversed(TELLING.items()):
        out = F.when(F.coalesce(F.arrays_overlap(c, _strings(kinds)), F.lit(False)), name).otherwise(out)
    return out


def default_plan(kind: Column | str) -> Column:
    """The kinds of work of a task, in order."""
    c = F.col(kind) if isinstance(kind, str) else kind
    return F.coalesce(*(F.when(c == name, _strings(plan)) for name, plan in PLANS.items()), _strings(PLANS["cross_domain_exploration"]))


def plan_units(tasks: DataFrame, task: str = "task_id", ordinal: str = "ordinal", kind: str = "work_type") -> DataFrame:
    """Units with their dependencies: a verifier waits for all earlier units of its task.

    The lists are a plan's own size; only verifiers get one, by a join of a task's verifiers with its units.
    """
    verifies = F.col(kind).isin("verify", *VERIFIERS)
    late = tasks.where(verifies).select(F.col(task), F.col("unit_id").alias("_v"), F.col(ordinal).alias("_at"))
    needs = late.join(tasks.select(task, "unit_id", ordinal), task).where(F.col(ordinal) < F.col("_at"))
    needs = needs.groupBy(task, "_v").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col("unit_id").alias("u")))), lambda x: x["u"]).alias("_e"))
    planned = tasks.join(needs.withColumnRenamed("_v", "unit_id"), [task, "unit_id"], "left")
    return planned.withColumn("dependency_ids", F.coalesce("_e", F.array().cast("array<string>"))).drop("_e").select(*tasks.columns, "dependency_ids")


#: A task of up to so many units is settled by one worker; larger ones are contracted over the cluster.
UNITS_IN_ONE = 50_000
_SETTLED = "layer int, state string, attempts int"


def schedule(units: DataFrame, outcome: Column, retry: Column | None = None) -> DataFrame:
    """task_id, unit_id, layer, state, attempts: completed, failed or skipped (a dependency failed, is missing, or is on a cycle).

    `outcome`: whether a unit's run succeeds; `retry`: whether its second run does, if the first fails. A unit's layer is
    one more than the greatest of its dependencies' (0 without any, or with a missing one); units on a cycle or behind
    one have none. Graphs of any depth are settled.
    """
    second = F.lit(False) if retry is None else F.coalesce(retry, F.lit(False))
    good = F.coalesce(outcome, F.lit(False))
    needs = F.array_distinct(F.coalesce("dependency_ids", F.array().cast("array<string>")))
    held = units.select("task_id", "unit_id", needs.alias("dependency_ids"), (good | second).alias("_good"), F.when(good | F.lit(retry is None), 1).otherwise(2).alias("_tries"))
    held = staged(held, "units")
    large = staged(held.groupBy("task_id").agg(F.count("*").alias("n")).where(F.col("n") > UNITS_IN_ONE).select("task_id"), "large-tasks")
    names = ", ".join(f"{c} {held.schema[c].dataType.simpleString()}" for c in ("task_id", "unit_id"))
    done = held.join(F.broadcast(large) if large.limit(1001).count() <= 1000 else large, "task_id", "left_anti").groupBy("task_id").applyInPandas(_settled, f"{names}, {_SETTLED}")
    return done if large.isEmpty() else done.unionByName(_layered(staged(held.join(large, "task_id", "left_semi"), "units")))


def _settled(units: pd.DataFrame) -> pd.DataFrame:
    """A task's units in the order of their dependencies."""
    needs = dict(zip(units["unit_id"], units["dependency_ids"], strict=True))
    good, tries = (dict(zip(units["unit_id"], units[c], strict=True)) for c in ("_good", "_tries"))
    behind: dict[str, list[str]] = {}
    for u, wanted in needs.items():
        for n in wanted:
            behind.setdefault(n, []).append(u)
    left = {u: len(w) for u, w in needs.items()}
    out: dict[str, tuple[int, str, int]] = {}
    ready = [(u, 0) for u, w in needs.items() if not len(w) or any(n not in needs for n in w)]
    bad = {u for u, _ in ready if left[u]}
    while ready:
        after = []
        for u, layer in ready:
            out[u] = (layer, "skipped", 0) if u in bad else (layer, "completed" if good[u] else "failed", int(tries[u]))
            for b in behind.get(u, ()):
                left[b] -= 1
                if out[u][1] != "completed":
                    bad.add(b)
                if not left[b] and b not in out:
                    after.append((b, layer + 1))
        ready = after
    rows = [(t, u, *out.get(u, (None, "skipped", 0))) for t, u in zip(units["task_id"], units["unit_id"], strict=True)]
    return pd.DataFrame(rows, columns=["task_id", "unit_id", "layer", "state", "attempts"]).astype({"layer": "Int32", "attempts": "int32"})


def _layered(units: DataFrame) -> DataFrame:
    """The same for tasks of any size, by contraction.

    An edge carries how its end depends on its start: the end's layer is at least max(low, start's layer + far), and the
    end is skipped unless `ok` holds and the start completes. Such maps compose. In a round, edges from settled units
    become bounds of their ends, and edges from units that wait for one other only are drawn from that other, so chains
    halve and trees fold. An edge longer than there are units comes out of a cycle. Rounds grow with the logarithm of the
    length of chains, and by one for each layer only where units of a layer wait for several of the last.
    """
    at = ["task_id", "unit_id"]
    most = units.count()
    needs = units.select(*at, F.explode("dependency_ids").alias("need"))
    lost = staged(needs.join(units.select("task_id", F.col("unit_id").alias("need")), ["task_id", "need"], "left_anti").select(*at).distinct(), "lost-units")
    open_ = units.join(lost.withColumn("_lost", F.lit(True)), at, "left").select(*at, "_good", "_tries", F.lit(0).cast("long").alias("layer"), F.col("_lost").isNull().alias("ok"))
    edges = staged(needs.join(lost, at, "left_anti").select(*at, "need", F.lit(0).cast("long").alias("low"), F.lit(1).cast("long").alias("far"), F.lit(True).alias("ok"), F.lit(False).alias("endless"), F.lit(True).alias("moved")), "unit-edges")
    done, rounds = [], 0
    while True:
        rounds += 1
        # rows without a need are what settled units have told
        bound = F.col("need").isNull()
        ends = edges.groupBy(*at).agg(
            F.count("need").alias("n"), F.min("need").alias("need"), F.max(F.when(~bound, F.col("low"))).alias("low"), F.max(F.when(~bound, F.col("far"))).alias("far"), F.bool_and(F.when(~bound, F.col("ok"))).alias("_edge_ok"),
            F.max(F.when(bound, F.col("low"))).alias("_least"), F.bool_and(F.when(bound, F.col("ok"))).alias("_told_ok"), F.bool_or(F.col("endless") | (F.col("need") == F.col("unit_id")) | (F.col("far") >= most)).alias("endless"),
        )
        met = open_.join(ends, at, "left").select(
            *at, "_good", "_tries", F.greatest("layer", "_least").alias("layer"), (F.col("ok") & F.coalesce("_told_ok", F.lit(True))).alias("ok"),
            F.coalesce("n", F.lit(0)).alias("n"), "need", "low", "far", "_edge_ok", F.coalesce("endless", F.lit(False)).alias("endless"),
        )
        met = staged(met, "met-units")
        settled = F.col("endless") | (F.col("n") == 0)
        done.append(_outcome(met.where(settled), F.col("endless")))
        open_ = met.where(~settled).select(*at, "_good", "_tries", "layer", "ok")
        passed = (F.col("ok") & F.col("_good")).alias("_ok")
        ended = met.where(settled).select("task_id", F.col("unit_id").alias("need"), F.lit(None).cast(met.schema["unit_id"].dataType).alias("_to"), F.col("layer").alias("_low"), F.lit(0).cast("long").alias("_far"), passed, F.col("endless").alias("_endless"))
        drawn = met.where(~settled & (F.col("n") == 1)).select("task_id", F.col("unit_id").alias("need"), F.col("need").alias("_to"), F.greatest("layer", "low").alias("_low"), F.col("far").alias("_far"), (passed & F.col("_edge_ok")).alias("_ok"), F.lit(False).alias("_endless"))
        # nothing is drawn from a unit that has told its layer, as it tells it once
        drawn = drawn.join(ended.select("task_id", F.col("need").alias("_to")), ["task_id", "_to"], "left_anti")
        step = ended.unionByName(drawn).withColumn("_moved", F.lit(True))
        moved = edges.where(~bound & (F.col("need") != F.col("unit_id")) & (F.col("far") < most)).join(step, ["task_id", "need"], "left")
        moved = moved.select(
            *at, F.when(F.col("_moved"), F.col("_to")).otherwise(F.col("need")).alias("need"), F.greatest("low", F.col("_low") + F.col("far")).alias("low"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"),
            (F.col("ok") & F.coalesce("_ok", F.lit(True))).alias("ok"), F.coalesce("_endless", F.lit(False)).alias("endless"), F.coalesce("_moved", F.lit(False)).alias("moved"),
        )
        edges = staged(moved.groupBy(*at, "need").agg(F.max("low").alias("low"), F.max("far").alias("far"), F.bool_and("ok").alias("ok"), F.bool_or("endless").alias("endless"), F.bool_or("moved").alias("moved")), "unit-edges")
        if edges.where("moved").isEmpty():
            break
        if rounds % 16 == 0:  # keep the plan short, however many rounds there are
            done = [staged(functools.reduce(DataFrame.unionByName, done), "layers")]
    # what moves no more waits for a cycle
    return functools.reduce(DataFrame.unionByName, [*done, _outcome(open_, F.lit(True))])


def _outcome(units: DataFrame, endless: Column) -> DataFrame:
    """Settled units as rows of a schedule; those on or behind a cycle have no layer."""
    skip = endless | ~F.col("ok")
    return units.select(
        "task_id", "unit_id", F.when(~endless, F.col("layer")).cast("int").alias("layer"), F.when(skip, "skipped").when(F.col("_good"), "completed").otherwise("failed").alias("state"), F.when(skip, 0).otherwise(F.col("_tries")).alias("attempts")
    )


def generation_key(task: Column, kind: Column, objective: Column, papers: Column, inputs: Column, worker: Column) -> Column:
    """The hash of what a unit of work is made of; the order of its papers and inputs doesn't matter."""
    sorted_ = lambda ids: F.array_sort(ids.cast("array<string>"))
    told = F.struct(task.cast("string").alias("task"), kind.alias("type"), objective.alias("objective"), sorted_(papers).alias("papers"), sorted_(inputs).alias("inputs"), worker.alias("worker"))
    return F.sha2(F.to_json(told), 256)


def visible_citations(slices: DataFrame, manifest: DataFrame) -> DataFrame:
    """The citations of a result that a slice of it shows, as whole labels. `slices`: artifact_id, content; `manifest`: artifact_id, label."""
    return slices.join(manifest, "artifact_id").where(contains_citation("content", "label")).select("artifact_id", "content", *(c for c in manifest.columns if c != "artifact_id"))


def check_reports(reports: DataFrame, allowed: DataFrame) -> DataFrame:
    """Reports with their labels brought to one form and what is wrong with them.

    `reports`: unit_id, claims (text, citations), evidence_backed; `allowed`: unit_id, label, identity. A label is written
    with or without brackets, in any case; an evidence-backed claim must have one; a label that stands for several
    identities is ambiguous.
    """
    plain = lambda x: F.upper(F.regexp_replace(x, r"^[\s\[]+|[\s\]]+$", ""))
    known = allowed.groupBy("unit_id", "label").agg(F.count_distinct("identity").alias("n")).groupBy("unit_id").agg(F.collect_list(F.struct("label", "n")).alias("_k"))
    claims = F.transform("claims", lambda c: F.struct(c["text"].alias("text"), F.array_distinct(F.transform(c["citations"], plain)).alias("citations")))
    rows = reports.withColumn("claims", claims).join(known, "unit_id", "left").withColumn("_k", F.coalesce("_k", F.array().cast("array<struct<label:string,n:bigint>>")))
    labels = F.array_distinct(F.flatten(F.transform("claims", lambda c: c["citations"])))
    names = F.transform("_k", lambda k: k["label"])
    issues = F.filter(
        F.array(
            F.when(F.exists(labels, lambda x: ~x.rlike(r"^[EP]\d+$")), "label_syntax"),
            F.when(F.size(F.array_except(F.filter(labels, lambda x: x.rlike(r"^[EP]\d+$")), names)) > 0, "unknown_label"),
            F.when(F.exists("_k", lambda k: (k["n"] > 1) & F.array_contains(labels, k["label"])), "ambiguous_label"),
            F.when(F.col("evidence_backed") & F.exists("claims", lambda c: F.size(c["citations"]) == 0), "claim_without_citation"),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.withColumn("issues", issues).drop("_k")


def chunk_units(evidence: DataFrame, question: str = "query", worker: str = "chunk_analyst", tokens: int = 6000, tools: int = 4, seconds: int = 90) -> DataFrame:
    """One unit of work for each evidence artifact: it may read that artifact and nothing else.

    `evidence`: task_id, artifact_id, paper_id and the question. The unit's id and its generation key follow from
    these, so a second plan of the same evidence is the same plan.
    """
    objective = F.concat(F.lit("Judge whether the artifact answers the question, and claim only what it supports. Question: "), F.col(question))
    key = generation_key(F.col("task_id"), F.lit("chunk_analysis"), objective, F.array("paper_id"), F.array("artifact_id"), F.lit(worker))
    return evidence.select(
        "task_id", F.sha2(F.concat_ws(":", F.lit("chunk-analysis"), "task_id", "artifact_id"), 256).alias("unit_id"), F.lit("chunk_analysis").alias("work_type"), objective.alias("objective"),
        F.lit(worker).alias("requested_worker"), F.lit("pending").alias("state"), key.alias("generation_key"), F.array("paper_id").alias("paper_ids"), F.array("artifact_id").alias("input_artifact_ids"),
        _strings(["read_artifact"]).alias("allowed_tools"), F.lit(tokens).alias("token_budget"), F.lit(tools).alias("tool_budget"), F.lit(seconds).alias("timeout_seconds"),
    ).dropDuplicates(["unit_id"])


def evidence_artifacts(evidence: DataFrame, project: str = "project_id") -> DataFrame:
    """Exactly one artifact for each piece of evidence: its citation, its canonical payload, and the ids that follow.

    `evidence`: task_id, query, evidence_id (hex), paper_id, version_id, paper_title, section_id, section_path,
    page_start, page_end, chunk_id, text, dense, bm25, relevance.
    """
    label = X.citation_label("E", "evidence_id")
    told = ["chunk_id", "page_end", "page_start", "paper_id", "paper_title", "query", "section_id", "section_path", "text", "version_id"]
    scores = F.struct("bm25", "dense", "relevance").alias("retrieval_scores")
    rows = evidence.withColumn("citation", label)
    payload = F.to_json(F.struct(*sorted([*told, "citation"]), scores))
    title = F.concat(F.lit("["), F.col("citation"), F.lit("] "), F.concat_ws(" | ", "paper_title", "section_path", F.concat(F.lit("pp."), F.col("page_start"), F.lit("-"), F.col("page_end"))))
    rows = rows.withColumns({"payload": payload, "summary": title, "evidence_hash": F.sha2("text", 256)}).withColumn("content_hash", F.sha2("payload", 256))
    return rows.withColumn("artifact_id", F.sha2(F.concat_ws(":", F.col(project).cast("string"), F.lit("retrieved_evidence"), F.col("task_id").cast("string"), F.col("content_hash")), 256)).dropDuplicates(["artifact_id"])


_REPORT = "struct<relevance:string,summary:string,claims:array<struct<text:string,citations:array<string>>>,unresolved_questions:array<string>>"


def collect_reports(units: DataFrame, results: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reports, failures, manifest) of finished units, in which each unit is a report, a failure with its reason, or still open.

    `units`: task_id, unit_id, state, error, output_artifact_id, input_artifact_ids; `results`: artifact_id, result (the
    worker's JSON); `citations`: artifact_id, label and what else a citation has. The manifest holds the citations that
    the claims of relevant reports use, once a label.
    """
    found = units.join(results.select(F.col("artifact_id").alias("output_artifact_id"), "result"), "output_artifact_id", "left")
    report = F.from_json("result", _REPORT)
    ended = F.col("state").isin("failed", "skipped")
    sound = F.col("output_artifact_id").isNotNull() & (F.coalesce(F.size("input_artifact_ids"), F.lit(0)) == 1)
    good = F.col("_r.relevance").isin("relevant", "partially_relevant", "irrelevant", "uncertain")
    reason = (
        F.when(ended, F.coalesce("error", "state"))
        .when(F.col("state") != "completed", None)
        .when(~sound, "invalid artifact provenance")
        .when(F.col("result").isNull(), "result artifact is missing")
        .when(~F.coalesce(good, F.lit(False)), "result is not a report")
    )
    judged = found.withColumn("_r", report).withColumn("reason", reason)
    bare = F.transform(F.coalesce("_r.claims", F.array().cast("array<struct<text:string,citations:array<string>>>")), lambda c: F.struct(F.coalesce(c["text"], F.lit("")).alias("text"), F.transform(F.coalesce(c["citations"], F.array().cast("array<string>")), lambda x: F.regexp_replace(x, r"^[\[\]]+|[\[\]]+$", "")).alias("citations")))
    reports = judged.where(F.col("reason").isNull() & (F.col("state") == "completed")).select(
        "task_id", "unit_id", F.get("input_artifact_ids", F.lit(0)).alias("evidence_artifact_id"), "output_artifact_id", F.col("_r.relevance").alias("relevance"), F.coalesce("_r.summary", F.lit("")).alias("summary"),
        bare.alias("claims"), F.coalesce("_r.unresolved_questions", F.array().cast("array<string>")).alias("unresolved_questions"),
    )
    failures = judged.where(F.col("reason").isNotNull()).select("task_id", "unit_id", "reason")
    used = reports.where("relevance = 'relevant'").select("task_id", F.explode(F.flatten(F.transform("claims", lambda c: c["citations"]))).alias("label")).distinct()
    cited = reports.select("task_id", "unit_id", F.col("output_artifact_id").alias("artifact_id")).join(citations, "artifact_id").join(used, ["task_id", "label"], "left_semi")
    first = cited.withColumn("_n", F.row_number().over(Window.partitionBy("task_id", "label").orderBy("unit_id", "artifact_id")))
    return reports, failures, first.where("_n = 1").drop("_n", "unit_id")


def report_sufficient(reports: DataFrame, manifest: DataFrame, task: str = "task_id") -> DataFrame:
    """(task, sufficient): a relevant report has a claim of which all citations are in the manifest."""
    known = manifest.groupBy(task).agg(F.collect_set("label").alias("_known"))
    claims = reports.join(known, task, "left").withColumn("_known", F.coalesce("_known", F.array().cast("array<string>")))
    ok = (F.col("relevance") == "relevant") & F.exists("claims", lambda c: F.size(F.array_except(c["citations"], F.col("_known"))) == 0)
    return claims.groupBy(task).agg(F.bool_or(ok).alias("sufficient"))


def finalise(answers: DataFrame, allowed: DataFrame, answer_id: str = "answer_id", text: str = "text") -> DataFrame:
    """Answers with status and issues: tool markup, citations without their namespace, unknown labels, none at all.

    `allowed`: the answer's id and the labels of its evidence.
    """
    known = allowed.groupBy(answer_id).agg(F.collect_set("label").alias("_known"))
    c = F.col(text)
    unknown = F.array_except(X.citations(c), F.coalesce("_known", F.array().cast("array<string>")))
    issues = F.filter(
        F.array(
            F.when(c.rlike(r"(?i)<\s*/?\s*(?:tool_call|function_call|invoke)\b"), "tool_markup"),
            F.when(c.rlike(r"\[\d+\]"), "citation_without_namespace"),
            F.when(F.size(unknown) > 0, "unknown_citation"),
            F.when((F.size(X.citations(c)) == 0) & (F.size(F.coalesce("_known", F.array().cast("array<string>"))) > 0), "no_citation"),
        ),
        lambda x: x.isNotNull(),
    )
    return answers.join(known, answer_id, "left").withColumns({"cited": X.citations(c), "unknown": unknown, "issues": issues}).drop("_known").withColumn("status", F.when(F.size("issues") == 0, "accepted").otherwise("rejected"))


def collect_task(units: DataFrame, task: str = "task_id") -> DataFrame:
    """A task's summaries in the order of its units, and its distinct citations, open questions and failed units.

    `units`: ordinal, unit_id, state, summary, citations, unresolved_questions.
    """
    rows = units.groupBy(task).agg(F.sort_array(F.collect_list(F.struct("ordinal", "unit_id", "state", "summary", "citations", "unresolved_questions"))).alias("_u"))
    done = F.filter("_u", lambda u: u["state"] == "completed")
    each = lambda name: F.array_distinct(F.flatten(F.transform(done, lambda u: F.coalesce(u[name], F.array().cast("array<string>")))))
    return rows.select(
        task, F.filter(F.transform(done, lambda u: u["summary"]), lambda x: x.isNotNull() & (x != "")).alias("summaries"), each("citations").alias("citations"), each("unresolved_questions").alias("unresolved_questions"),
        F.transform(F.filter("_u", lambda u: u["state"] == "failed"), lambda u: u["unit_id"]).alias("failed_units"),
    )


def contains_citation(content: Column | str, label: Column | str) -> Column:
    """Whether a JSON text holds a label as a whole string value, at any depth, or quoted inside a string (not E1 in E10)."""
    c, w = (F.col(x) if isinstance(x, str) else x for x in (content, label))
    # a string value is quoted in JSON, and so is a quoted label inside one, with its quotes escaped
    return F.contains(c, F.concat(F.lit('"'), w, F.lit('"'))) | F.contains(c, F.concat(F.lit('\\"'), w, F.lit('\\"')))


def traces(events: DataFrame, at: str = "ts", kind: str = "event_type", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of trace events by window and kind; the same on a batch or a stream."""
    held = events.withWatermark(at, late) if events.isStreaming else events
    return held.groupBy(F.window(at, size), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def task_status(units: DataFrame, task: str = "task_id", state: str = "state") -> DataFrame:
    done, failed = F.count_if(F.col(state) == "completed"), F.count_if(F.col(state) == "failed")
    return units.groupBy(task).agg(F.when(failed == F.count("*"), "failed").when(done == F.count("*"), "completed").otherwise("partial").alias("status"), done.alias("completed"), F.count("*").alias("total"))


def unwrap_fence(x: Column | str) -> Column:
    """The inside of a text that is one fenced block, else the text."""
    c = F.trim(F.col(x) if isinstance(x, str) else x)
    inside = F.regexp_extract(c, r"(?s)\A```(?:json)?\s*\n(.*?)\n```\z", 1)
    return F.when(inside != "", inside).otherwise(c)


def summary(findings: Column | str) -> Column:
    c = F.col(findings) if isinstance(findings, str) else findings
    return F.substring(F.concat_ws(" ", F.slice(c, 1, 3)), 1, 500)


def error_code(typed: Column, by_operation: dict[str, str], operation: Column, by_stage: dict[str, str], stage: Column, default: str = "internal_error") -> Column:
    """The code an error carries, else its operation's, else its stage's."""
    look = lambda table, key: F.element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), key)
    return F.coalesce(typed, look(by_operation, operation), look(by_stage, stage), F.lit(default))


def scope(requested: Column, assigned: Column) -> Column:
    """struct(ids, outside): an empty request means all that is assigned; ids outside of it are reported."""
    none = F.coalesce(F.size(requested), F.lit(0)) <= 0
    return F.struct(F.when(none, assigned).otherwise(F.array_intersect(requested, assigned)).alias("ids"), F.when(none, F.array().cast("array<string>")).otherwise(F.array_except(requested.cast("array<string>"), assigned.cast("array<string>"))).alias("outside"))


def interactions(answers: DataFrame, sources: DataFrame, answer_id: str = "answer_id", text: str = "text") -> DataFrame:
    """(answer_id, papers): the papers that an answer cites. `sources`: label, paper_id."""
    used = answers.select(answer_id, F.explode(X.citations(text)).alias("label"))
    return used.join(sources, "label").groupBy(answer_id).agg(F.sort_array(F.collect_set("paper_id")).alias("papers"))


def live_sessions(state: DataFrame, now: Column, seconds: int = 86_400, key: str = "session_id", at: str = "updated_at") -> DataFrame:
    """The last state of each session that hasn't expired."""
    last = state.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).where("_n = 1").drop("_n")
    return last.where(F.col(at) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)) > now)


def recall(rows: DataFrame, words: Column, columns: list[str], order: list[Column], most: int) -> DataFrame:
    """Newest rows of which some column contains the words, without regard to case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c)), F.lower(words))
    return rows.where(hit).orderBy(*order).limit(most)


def schema_issues(value: object, schema: dict, path: str = "$") -> list[str]:
    """What is wrong with a JSON value: type, enum, required, extra keys, recursively."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float), "null": type(None)}
    wanted = schema.get("type")
    if wanted and (not isinstance(value, kinds[wanted]) or wanted in ("integer", "number") and isinstance(value, bool)):
        return [f"{path}: not of type {wanted}"]
    out = [f"{path}: not one of the allowed values"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}: lacks {k}" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{path}: has unknown {k}" for k in sorted(set(value) - set(known))]
        for k in sorted(set(value) & set(known)):
            out += schema_issues(value[k], known[k], f"{path}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            out += schema_issues(v, schema["items"], f"{path}[{i}]")
    return out


def validate_json(schema: dict):
    """A pandas UDF from JSON text to the list of its issues."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def check(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return schema_issues(json.loads(t), schema)
            except (TypeError, ValueError):
                return ["$: not JSON"]

        return texts.map(one)

    return check
