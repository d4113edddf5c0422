import itertools
import json
import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as X
from docquarry.operators import curation as C
from docquarry.operators import graph as G
from docquarry.operators import incremental as I
from docquarry.operators import reading as D
from docquarry.operators import retrieval as R
from docquarry.operators import structure as S
from docquarry.operators import views as V2
from docquarry.operators import workflow as W
from docquarry.sources import tables as T
from docquarry.streaming import events as E

BLOCKS = [
    ("paragraph", None, "Paper title"), ("heading", 1, "1 Introduction"), ("paragraph", None, "Figure 1 summarizes the architecture."), ("figure", None, "Figure 1: System architecture"), ("heading", 2, "1.1 Method"),
    ("equation", None, "E = mc^2"), ("paragraph", None, "where m denotes mass."), ("heading", 1, "2 Results"), ("table", None, "Table 1: Main results"), ("algorithm", None, "Algorithm 1: Training procedure"),
]


def blocks(spark):
    rows = [("v", 1, f"b{i}", k, t, i, lv) for i, (k, lv, t) in enumerate(BLOCKS)]
    return spark.createDataFrame(rows, "version_id string, page_number int, block_id string, block_type string, text string, reading_order int, level int")


def test_sections_groups_chunks(spark):
    located = S.sections(blocks(spark)).cache()
    table = S.section_table(located).orderBy("section_order").collect()
    assert [(r["section_path"], r["source_block_ids"]) for r in table] == [("Front Matter", ["b0"]), ("1 Introduction", ["b1", "b2", "b3"]), ("1 Introduction > 1.1 Method", ["b4", "b5", "b6"]), ("2 Results", ["b7", "b8", "b9"])]
    assert {r["element_type"] for r in S.elements(located).collect()} == {"figure", "table", "equation", "algorithm"}
    groups = S.groups(located).cache()
    assert ["b5", "b6"] in [r["source_block_ids"] for r in groups.where("dependency").collect()]
    chunks = S.chunks(groups).orderBy("chunk_order").collect()
    assert [b for c in chunks for b in c["source_block_ids"]] == [f"b{i}" for i in range(10)]
    assert len({c["section_order"] for c in chunks}) == len(chunks)


def test_oversize_split(spark):
    rows = [("v", 0, "s", "语" * 40, 1, 1, False, ["b0"], [], 0, 40), ("v", 0, "s", "字" * 30, 1, 1, True, ["b1"], ["table"], 1, 30)]
    g = spark.createDataFrame(rows, "version_id string, section_order int, section_path string, text string, page_start int, page_end int, dependency boolean, source_block_ids array<string>, element_types array<string>, group_order int, token_count int")
    got = S.chunks(g, 10, 15).orderBy("chunk_order").collect()
    assert all(c["token_count"] <= 15 for c in got[:-1]) and got[-1]["token_count"] == 30


def test_graph(spark):
    text = "We propose a graph mechanism for the task. Method called GraphNet. Datasets: AlphaSet. Metrics: F1."
    c = spark.createDataFrame([("p", "v", "c0", 0, "3 Method", text)], "paper_id string, version_id string, chunk_id string, chunk_order int, section_path string, text string")
    assert {(r["field"], r["value"]) for r in G.profile(c).collect()} >= {("datasets", "AlphaSet"), ("method_name", "GraphNet"), ("metrics", "F1")}
    found = G.entities(c)
    assert {r["canonical_name"]: r["relation_type"] for r in found.collect()} == {"AlphaSet": "evaluates_on", "GraphNet": "uses_method", "F1": None}
    assert G.relations(found).count() == 2 and G.claims(G.profile(c)).count() == 3


def test_comparison(spark):
    papers = spark.createDataFrame([("a",), ("b",)], "paper_id string")
    dims = spark.createDataFrame([("method",), ("data",)], "dimension string")
    values = spark.createDataFrame([("a", "method", 0, "graph", 0.8, "c1"), ("b", "method", 0, "transformer", 0.7, "c2"), ("a", "method", 1, "graph", 0.6, "c1")], "paper_id string, dimension string, ordinal int, value string, confidence double, chunk_id string")
    got = {(r["paper_id"], r["dimension"]): r for r in G.compare(papers, dims, values).collect()}
    assert got["a", "method"]["value"] == "graph" and got["a", "method"]["confidence"] == 0.6 and got["a", "method"]["comparable"] and not got["a", "data"]["comparable"]
    assert {r["status"] for r in got.values()} == {"partial"}
    assert {r["status"] for r in G.compare(papers, dims, values.where("false")).collect()} == {"insufficient_evidence"}


def test_entity_merge(spark):
    schema = "project_id string, entity_type string, normalized string, canonical_name string, aliases array<string>, description string"
    a = spark.createDataFrame([("p", "method", "x", "X", ["ex"], None)], schema)
    b = spark.createDataFrame([("p", "method", "x", "x net", [], "a net"), ("p", "dataset", "x", "X", [], None)], schema)
    got = {r["entity_type"]: r for r in G.merge_entities(a, b).collect()}
    assert got["method"]["canonical_name"] == "X" and got["method"]["aliases"] == ["ex", "x net"] and got["method"]["description"] == "a net"


def test_search_finds_one_and_says_when_there_is_none(spark):
    chunks = spark.createDataFrame([(1, 1, "The codebook is constructed by clustering scene features."), (2, 1, "The codebook is constructed by clustering scene features."), (3, 1, "Training uses a reconstruction objective.")], "chunk_id long, paper_id long, text string")
    dense = {1: 0.85, 2: 0.80, 3: 0.30}
    vectors = spark.createDataFrame([(k, [v, (1 - v * v) ** 0.5]) for k, v in dense.items()], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(1, "How is the codebook constructed?", [1.0, 0.0])], "query_id long, query string, query_vector array<double>")
    found = R.search(q, chunks, vectors).collect()
    assert found[0]["chunk_id"] == 1 and [r["chunk_id"] for r in found].count(2) == 0
    none = R.search(spark.createDataFrame([(1, "quantum banana telescope", [0.05, 0.9987])], q.schema), spark.createDataFrame([(9, 1, "Unrelated optimization details.")], chunks.schema), spark.createDataFrame([(9, [1.0, 0.0])], vectors.schema)).collect()
    assert [(r["status"], r["reason"] is not None) for r in none] == [("no_evidence", True)]


def test_resolve_papers(spark):
    papers = spark.createDataFrame([(1, ["Scene Codebook Network"], "SCANet"), (2, ["Other Work"], None)], "paper_id long, names array<string>, acronym string")
    q = spark.createDataFrame([(1, "scene codebook network"), (2, "what does scanet do"), (3, "is other work better"), (4, "nothing")], "query_id long, query string")
    got = {(r["query_id"], r["paper_id"]): r["score"] for r in R.resolve_papers(q, papers).collect()}
    assert got == {(1, 1): 1.0, (2, 1): 0.98, (3, 2): 0.92}


def test_round_robin_budget(spark):
    rows = spark.createDataFrame([(1, "A", 1, 0.9, 100), (1, "A", 2, 0.8, 100), (1, "B", 3, 0.7, 50)], "query_id long, paper_id string, chunk_id long, relevance double, token_count int")
    got = R.round_robin(rows, 2, budget=150).orderBy("position").collect()
    assert [r["chunk_id"] for r in got] == [1, 3]


def test_classify_files(spark):
    known = spark.createDataFrame([("a", "h1"), ("b", "h2")], "path string, file_hash string")
    seen = spark.createDataFrame([("a", "h1"), ("b", "h9"), ("c", "h1"), ("d", "h8")], "path string, file_hash string")
    assert {r["path"]: r["state"] for r in I.classify_files(seen, known).collect()} == {"a": "unchanged", "b": "modified", "c": "duplicate", "d": "new"}


def test_stages(spark):
    docs = spark.createDataFrame([("v", "h")], "version_id string, document_hash string")
    ledger = spark.createDataFrame([("v", s, f"{s}1", "h") for s in ("parse", "structure", "chunk")], "version_id string, stage string, stage_version string, document_hash string")
    run = lambda *versions: {r["stage"] for r in I.stale(docs, ledger, list(zip(("parse", "structure", "chunk"), versions))).collect()}
    assert run("parse1", "structure1", "chunk1") == set()
    assert run("parse1", "structure1", "chunk2") == {"chunk"}
    assert run("parse1", "structure2", "chunk1") == {"structure", "chunk"}


def test_schedule_with_cycle_and_missing(spark):
    rows = [("t", "a", []), ("t", "b", ["a"]), ("t", "c", ["b", "x"]), ("t", "d", ["e"]), ("t", "e", ["d"]), ("t", "f", ["c"])]
    units = spark.createDataFrame(rows, "task_id string, unit_id string, dependency_ids array<string>")
    got = {r["unit_id"]: r["state"] for r in W.schedule(units, F.lit(True)).collect()}
    assert got == {"a": "completed", "b": "completed", "c": "skipped", "d": "skipped", "e": "skipped", "f": "skipped"}


def test_pages_and_fragments(spark):
    r = random.Random(1)
    items = [(1, i, r.randint(1, 90)) for i in range(40)]
    got = W.page_by_budget(spark.createDataFrame(items, "g long, o long, t int"), "g", "o", "t", 80).collect()
    page, used, want = 0, 0, {}
    for _, o, t in items:
        if used and used + t > 80:
            page, used = page + 1, 0
        used += t
        want[o] = page
    assert {x["o"]: x["page"] for x in got} == want
    text = "中文内容" * 200
    parts = spark.range(1).select(W.fragments(F.lit(text), 80)).first()[0]
    assert "".join(parts) == text and len(parts) == 10


def test_files_lines_blobs(spark, tmp_path):
    for name in ("papers/B.PDF", "papers/a.pdf", "papers/notes.txt", ".state/x.pdf"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(name.encode())
    assert [r["relative_path"] for r in T.scan_files(spark, str(tmp_path)).collect()] == ["papers/a.pdf", "papers/B.PDF"]
    bad = spark.createDataFrame([("/elsewhere/x.pdf",), (f"{tmp_path}/a.pdf",)], "path string")
    assert [r["issue"] for r in T.outside(bad, str(tmp_path)).collect()] == ["path_outside_project"]
    df = spark.createDataFrame([(2, "x"), (1, "y")], "b long, a string")
    T.write_jsonl(df, str(tmp_path / "lines"))
    assert {tuple(r) for r in T.read_jsonl(spark, str(tmp_path / "lines"), "b long, a string").collect()} == {(2, "x"), (1, "y")}
    blobs = T.put_blobs(None, df, "a")
    assert T.put_blobs(blobs, df, "a").count() == 2
    broken = blobs.withColumn("payload", F.lit("?"))
    assert {r["payload"] for r in T.put_blobs(broken, df, "a").collect()} == {"x", "y"}


def test_stream_equals_batch(spark, smallest, tmp_path):
    batch = {tuple(r) for r in E.windowed(T.table(spark, smallest, "events")).withColumn("total", F.round("total", 6)).collect()}
    src = tmp_path / "in"
    T.table(spark, smallest, "events").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(src))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    q = E.windowed(stream).writeStream.outputMode("complete").format("memory").queryName("hourly").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("hourly").select(F.col("start").cast("timestamp_ntz"), "event_type", "n", F.round("total", 6)).collect()
    assert {tuple(r) for r in rows} == batch


@pytest.mark.parametrize("broadcast", [16, -1])
def test_dense_equals_brute_force(spark, monkeypatch, broadcast):
    import numpy as np

    monkeypatch.setattr(R, "BROADCAST_BLOCKS", broadcast)

    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(90, 6))
    rows = [(i, [float(x) for x in v[i]], i % 2) for i in range(90)] + [(200, None, 0), (201, [0.0] * 6, 0), (202, [1.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    queries = vectors.where("vec_id < 12").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "label")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = set()
    for q in range(12):
        near = sorted((-max(0.0, float(u[q] @ u[i])), i) for i in range(90) if i % 2 == q % 2)[:5]
        want |= {(q, i, round(-s, 9)) for s, i in near}
    got = {(r["query_id"], r["vec_id"], round(r["dense"], 9)) for r in R.dense(queries, vectors, 5, scope=["label"], block=16).collect()}
    assert got == want


def test_splits_and_negatives(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], ["x", "y", "z"][i % 3]) for i in range(60)], "id long, s string, reason string")
    got = C.stratified_split(rows, "id", "s", {"smoke": 3, "regression": 10}, [F.asc("id")])
    assert {(r["s"], r["split"]): r["count"] for r in got.groupBy("s", "split").count().collect()} == {("a", "smoke"): 3, ("b", "smoke"): 3, ("a", "regression"): 10, ("b", "regression"): 10, ("a", None): 17, ("b", None): 17}
    assert [r["id"] for r in C.hard_negatives(rows, ["x"], [F.desc("id")], 2).collect()] == [57, 54]
    files = spark.createDataFrame([("CVPR2024_Deep_Things.pdf", "a zero-shot method", "h" * 64, 3, 8)], "file_name string, text string, file_hash string, file_size long, pages int")
    r = C.inventory(files).first()
    assert (r["title"], r["methods"]) == ("Deep Things", ["zero_shot"])


def test_state_and_validation(spark):
    from datetime import datetime

    s = spark.createDataFrame([("a", datetime(2024, 1, 1), "old"), ("a", datetime(2024, 1, 2), "new"), ("b", datetime(2023, 1, 1), "x")], "session_id string, updated_at timestamp, state string")
    assert [r["state"] for r in W.live_sessions(s, F.lit("2024-01-02 12:00:00").cast("timestamp")).collect()] == ["new"]
    assert [r["state"] for r in W.recall(s, F.lit("OL"), ["state"], [F.desc("updated_at")], 5).collect()] == ["old"]
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "array", "items": {"enum": [1, 2]}}}}
    df = spark.createDataFrame([('{"a":[1,2]}',), ('{"a":[3],"b":1}',), ("{}",), ("nope",), (None,)], "t string")
    got = [r[0] for r in df.select(W.validate_json(schema)("t")).collect()]
    assert got == [[], ["$: has unknown b", "$.a[0]: not one of the allowed values"], ["$: lacks a"], ["$: not JSON"], ["$: not JSON"]]
    code = W.error_code(F.lit(None).cast("string"), {"parse": "bad_file"}, F.lit("other"), {"ingest": "failed"}, F.lit("ingest"))
    sc = W.scope(F.array(F.lit("x"), F.lit("q")), F.array(F.lit("x"), F.lit("y")))
    r = spark.range(1).select(code, sc, W.unwrap_fence(F.lit("```json\n{}\n```")), W.route(F.lit(7), F.lit(False)), W.route(F.lit(2), F.lit(False))).first()
    assert r[0] == "failed" and (r[1]["ids"], r[1]["outside"]) == (["x"], ["q"]) and (r[2], r[3], r[4]) == ("{}", 5, 0)
    a = spark.createDataFrame([(1, "see [E1] [E2] [E9]")], "answer_id long, text string")
    src = spark.createDataFrame([("E1", 7), ("E2", 5)], "label string, paper_id long")
    assert W.interactions(a, src).first()["papers"] == [5, 7]


# ---- scheduling, plans, reports


def test_schedule_of_any_depth(spark, monkeypatch):
    """A chain of 150 units completes; small and large tasks are settled alike, with retries, failures and cycles."""
    rows = [("deep", str(i), [str(i - 1)] if i else [], True, False) for i in range(150)]
    rnd = random.Random(3)
    for i in range(40):
        rows.append(("wide", f"w{i}", sorted({f"w{rnd.randrange(i)}" for _ in range(rnd.randint(0, 3))}) if i else None, rnd.random() < 0.8, rnd.random() < 0.5))
    rows += [("ring", "a", ["b"], True, True), ("ring", "b", ["a"], True, True), ("ring", "c", ["b", "zz"], True, True), ("ring", "d", ["c"], True, True), ("ring", "e", ["a"], True, True)]
    units = spark.createDataFrame(rows, "task_id string, unit_id string, dependency_ids array<string>, good boolean, again boolean")
    take = lambda: sorted(map(tuple, W.schedule(units, F.col("good"), F.col("again")).select("task_id", "unit_id", "layer", "state", "attempts").collect()), key=str)
    small = take()
    assert [r[3] for r in small if r[0] == "deep"] == ["completed"] * 150 and max(r[2] for r in small if r[0] == "deep") == 149
    assert {(r[1], r[2], r[3]) for r in small if r[0] == "ring"} == {("a", None, "skipped"), ("b", None, "skipped"), ("c", 0, "skipped"), ("d", 1, "skipped"), ("e", None, "skipped")}
    state = {u: (s, n) for t, u, _, s, n in small if t == "wide"}
    for _, u, needs, good, again in (r for r in rows if r[0] == "wide"):
        if any(state[n][0] != "completed" for n in needs or []):
            assert state[u] == ("skipped", 0)
        else:
            assert state[u] == ("completed" if good or again else "failed", 1 if good else 2)
    monkeypatch.setattr(W, "UNITS_IN_ONE", 3)
    assert take() == small
    assert W.schedule(units.where("false"), F.lit(True)).count() == 0


def test_deep_tasks_are_contracted(spark, monkeypatch):
    """A chain of 100,000 units, a tree and random graphs with cycles settle in few rounds, as one worker would settle them."""
    rounds = []
    monkeypatch.setattr(W, "staged", lambda df, name, kept=W.staged: (rounds.append(name), kept(df, name))[1])
    n = 100_000
    chain = spark.range(n).select(F.lit("t").alias("task_id"), F.col("id").cast("string").alias("unit_id"), F.when(F.col("id") > 0, F.array((F.col("id") - 1).cast("string"))).alias("dependency_ids"), (F.col("id") != 70_000).alias("good"))
    told = W.schedule(chain, F.col("good"))
    assert told.count() == n and rounds.count("met-units") <= 20
    assert told.where("layer <> cast(unit_id as int)").isEmpty()
    assert {r["state"]: r["count"] for r in told.groupBy("state").count().collect()} == {"completed": 70_000, "failed": 1, "skipped": n - 70_001}

    rnd = random.Random(11)
    rows = [("tree", f"{i:03}", [] if i >= 64 else [f"{2 * i:03}", f"{2 * i + 1:03}"], i != 77) for i in range(1, 128)]
    for t in range(6):
        for i in range(60):
            wanted = [f"{rnd.randrange(60) if rnd.random() < 0.06 else rnd.randrange(max(1, i)):03}" for _ in range(rnd.choice((0, 1, 1, 1, 2, 3)))]
            rows.append((f"any{t}", f"{i:03}", [w for w in wanted if t or w != f"{i:03}"], rnd.random() < 0.9))
    units = spark.createDataFrame(rows, "task_id string, unit_id string, dependency_ids array<string>, good boolean")
    take = lambda: sorted(map(tuple, W.schedule(units, F.col("good")).collect()), key=str)
    one = take()
    monkeypatch.setattr(W, "UNITS_IN_ONE", 3)
    assert take() == one and any(r[2] is None for r in one)


def test_plan_of_verifiers(spark):
    rows = [("t", 0, "a", "method"), ("t", 1, "b", "verification"), ("t", 2, "c", "results"), ("t", 3, "d", "novelty_check"), ("u", 0, "e", "verify")]
    units = spark.createDataFrame(rows, "task_id string, ordinal int, unit_id string, work_type string")
    got = {r["unit_id"]: r["dependency_ids"] for r in W.plan_units(units).collect()}
    assert got == {"a": [], "b": ["a"], "c": [], "d": ["a", "b", "c"], "e": []}


def test_names_count_inside_words(spark):
    papers = spark.createDataFrame([(1, ["Scene Codebook Network"], "SCANet"), (2, ["Other"], None), (3, None, "xy")], "paper_id int, names array<string>, acronym string")
    asked = [(1, "how does preSCANet work"), (2, "scene  codebook network"), (3, "the Other one"), (4, "nothing"), (5, None), (6, "")]
    q = spark.createDataFrame(asked, "query_id int, query string")
    assert {(r["query_id"], r["paper_id"], r["score"]) for r in R.resolve_papers(q, papers).collect()} == {(1, 1, 0.98), (2, 1, 1.0), (3, 2, 0.92)}
    assert R.resolve_papers(q, papers.where("false")).count() == 0


def test_narrowed_search_goes_down_the_levels(spark):
    """Papers by name, else by nearness; sections and chunks only below them."""
    e = lambda *x: [float(v) for v in x]
    papers = spark.createDataFrame([(1, ["Alpha"], None), (2, ["Beta"], None)], "paper_id int, names array<string>, acronym string")
    pv = spark.createDataFrame([(1, e(1, 0)), (2, e(0, 1))], "paper_id int, embedding array<double>")
    sv = spark.createDataFrame([(10, 1, e(1, 0)), (11, 1, e(0.5, 0.5)), (20, 2, e(0, 1))], "section_id int, paper_id int, embedding array<double>")
    chunks = spark.createDataFrame([(100, 10, 1, "The codebook is built by clustering."), (101, 11, 1, "Training goes on."), (200, 20, 2, "The codebook is built by clustering here.")], "chunk_id int, section_id int, paper_id int, text string")
    cv = spark.createDataFrame([(100, e(1, 0)), (101, e(0.4, 0.6)), (200, e(0.9, 0.1))], "chunk_id int, embedding array<double>")
    q = spark.createDataFrame([(1, "alpha: how is the codebook built?", e(1, 0)), (2, "how is the codebook built?", e(0, 1))], "query_id int, query string, query_vector array<double>")
    near = {(r["query_id"], r["paper_id"]) for r in R.resolved_or_near(q, papers, pv, 1).collect()}
    assert near == {(1, 1), (2, 2)}
    found = R.search_narrowed(q, papers, pv, sv, chunks, cv, sizes=(1, 8, 30)).where("status = 'ok'").collect()
    assert {(r["query_id"], r["chunk_id"]) for r in found} >= {(1, 100), (2, 200)} and not any(r["query_id"] == 1 and r["chunk_id"] == 200 for r in found)


# ---- reading, metadata


def test_metadata_of_files(spark):
    page = "A Study of Paper Agents in the Wild\nAlice Smith, Bob Li\nCVPR 2024 doi:10.1234/ABC.5, arXiv:2401.01234v2"
    rows = [("d/x.pdf", {"title": "Paper Agents", "author": "Alice Smith; Bob Li", "keywords": "a, b;; c", "creationDate": "2023-05-01"}, page, page, 3), ("d/y.pdf", {}, page, page, 1), ("d/some name.pdf", None, "", None, 0)]
    files = spark.createDataFrame(rows, "file_name string, meta map<string,string>, first_page string, text string, page_count int")
    a, b, c = D.paper_metadata(files).orderBy(F.desc("page_count")).collect()
    assert (a["title"], a["authors"], a["year"], a["doi"], a["arxiv_id"], a["keywords"]) == ("Paper Agents", ["Alice Smith", "Bob Li"], 2023, "10.1234/abc.5", "2401.01234", ["a", "b", "c"])
    assert [(x["field"], x["source"], x["confidence"]) for x in a["evidence"]] == [("title", "pdf_metadata", 0.9), ("authors", "pdf_metadata", 0.85), ("doi", "document_text", 0.95), ("arxiv_id", "document_text", 0.95), ("year", "pdf_metadata", 0.7)]
    assert b["title"].startswith("A Study of Paper Agents") and b["year"] == 2024 and b["evidence"][0]["confidence"] == 0.65
    assert c["title"] == "some name" and c["evidence"][0]["source"] == "file_name" and c["doi"] is None


def test_required_rows_and_gates(spark):
    have, known = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert D.required(have.where("k = 1"), known, ["k"], "no v").first()["v"] == "x"
    with pytest.raises(Exception, match="no v: 2"):
        D.required(have, known, ["k"], "no v").collect()
    records = spark.createDataFrame([("good", ["registry"]), ("bad", [])], "release_title string, venue_proofs array<string>")
    assert C.gated(records.where("release_title = 'good'")).count() == 1
    with pytest.raises(Exception, match="no proof of the venue: bad"):
        C.gated(records).collect()


def test_nested_splits(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], i * 37 % 101) for i in range(60)], "k int, s string, x int")
    got = C.nested_splits(rows, "k", "s", {"a": 3, "b": 2}, {"a": 7, "b": 5}, [F.asc("x"), F.asc("k")]).collect()
    assert sum(r["in_small"] for r in got) == 5 and sum(r["in_large"] for r in got) == 12 and all(r["in_large"] for r in got if r["in_small"])


# ---- stored results


def _tokens(value):
    return len(re.findall(X.ARTIFACT_TOKEN.removeprefix("(?U)"), value))


def _shown(spark, budget, *told):
    """The previews of (kind, payload) as objects, and which were cut."""
    rows = [(i, k, p if p is None or isinstance(p, str) else json.dumps(p), "json") for i, (k, p) in enumerate(told)]
    got = sorted(V2.previews(spark.createDataFrame(rows, "artifact_id int, kind string, payload string, media_type string"), budget).collect())
    assert all(r["preview_tokens"] == _tokens(r["preview"]) and (r["preview_tokens"] <= budget or not r["truncated"]) for r in got)
    return [json.loads(r["preview"]) for r in got], [r["truncated"] for r in got]


def test_previews_fill_lists_in_order(spark):
    evidence = [{"paper_id": p, "relevance": r, "citation": f"E{i}", "text": "word " * 30} for i, (p, r) in enumerate([("A", 0.9), ("A", 0.8), ("B", 0.7), ("A", 0.95), ("A", 0.1), ("A", 0.2)])]
    search = {"query": "q", "status": "ok", "evidence": [*evidence, "no object"], "resolved_papers": list(range(30))}
    read = {"paper_id": "p", "version_id": "v", "title": "T", "passages": [{"text": "x " * 50}, {"text": "y " * 300}, {"text": "z"}], "elements": [{"caption": "c"}] * 4}
    (got, read_whole), cut = _shown(spark, 10_000, ("knowledge_search", search), ("paper_read", read))
    # papers in turn, the best of each first, four of one at most
    assert [x["citation"] for x in got["selected_evidence"]] == ["E3", "E2", "E0", "E1", "E5"] and got["omitted_evidence"] == 1
    assert got["resolved_papers"] == list(range(20)) and got["artifact_ref"]["available_views"] == ["default", "evidence", "papers", "full"]
    assert len(read_whole["passages"]) == 3 and read_whole["available_views"][-1] == "full" and cut == [False, False]
    # a passage that doesn't fit ends the passages; elements may still fit
    (got, read_part), cut = _shown(spark, 250, ("knowledge_search", search), ("paper_read", read))
    assert read_part["passages"] == read["passages"][:1] and len(read_part["elements"]) == 4 and read_part["omitted_passages"] == 2 and not cut[1]
    assert cut[0] and [x["citation"] for x in got["selected_evidence"]][:1] == ["E3"]


def test_previews_of_every_kind(spark):
    comparison = {
        "status": "partial", "paper_ids": ["p1", "p2"], "dimensions": [{"name": "d", "directly_comparable": True, "cells": [{"paper_title": "One", "normalized_value": "1"}, {"paper_title": "Two"}]}, {"name": "e"}],
        "evidence": [{"citation": "E1", "pages": [3, 4], "paper_title": "One"}, {"citation": "E1", "page_start": 9}, {"citation": ""}, {"citation": "E2", "page_start": 5, "page_end": 6}],
    }
    told = [
        ("paper_comparison", comparison), ("worker_result", {"status": "ok", "summary": "s", "unresolved_questions": ["q"], "citations": [{"citation_label": "E7", "page_start": 1}]}),
        ("search_artifact", {"results": [{"a": 1}], "count": 3}), ("delegate_research", {"task_id": "t", "delegated": True, "work_unit_ids": list(range(25))}),
        ("collect_research_task", {"summary": "s", "artifact_refs": [{"id": 1}, 2], "failed_work_units": [{"id": 3}]}),
        ("retrieve_and_analyze_knowledge", {"claims": [{"t": 1}], "reports": [{"r": 1}], "rounds_executed": 2, "citation_manifest": [{"citation_label": "E1"}]}),
        ("other", "not json"), ("other", None), ("other", "[]"), ("other", "{}"), ("knowledge_search", None), ("paper_comparison", "{}"),
    ]
    got, cut = _shown(spark, 1000, *told)
    assert not any(cut) and all(g["artifact_ref"]["media_type"] == "json" for g in got)
    a, worker, listed, task, collected, loop, *plain, search, empty = got
    assert a["comparable_dimensions"] == ["d"] and a["insufficient_dimensions"] == ["e"] and a["paper_count"] == 2
    assert a["high_level_findings"] == [{"dimension": "d", "summary": "One: 1; Two: None"}]
    assert [(c["label"], c["page_start"], c["page_end"]) for c in a["citations"]] == [("E1", 3, 4), ("E2", 5, 6)]
    assert a["available_views"] == ["default", "all-cells", "evidence", "derivation", "dimension:d", "dimension:e", "paper:p1", "paper:p2"] == a["artifact_ref"]["available_views"]
    assert worker["citations"][0]["label"] == "E7" and worker["unresolved_questions"] == ["q"] and worker["available_views"][1] == "result"
    assert listed["omitted_results"] == 2 and listed["results"] == [{"a": 1}]
    assert task["delegated"] is True and len(task["work_unit_ids"]) == 20 and task["assigned_workers"] == []
    assert collected["artifact_refs"] == [{"id": 1}] and collected["omitted_artifact_refs"] == 1 and collected["failed_work_units"] == [{"id": 3}]
    assert loop["claims"] == [{"t": 1}] and loop["rounds_executed"] == 2 and loop["citation_manifest"] == [{"citation_label": "E1"}]
    assert all(p["summary"] == "tool result" and p["artifact_ref"]["available_views"] == [] for p in plain)
    assert search["selected_evidence"] == [] and empty["citations"] == []


def test_previews_are_cut_by_priority(spark):
    whole = {"task_id": "t1", "status": "ok", "summary": 'x "y"\nü ' * 200, "claims": [{"t": "z " * 20}] * 5, "query": "q " * 500}
    for budget in (20, 60, 90, 200):
        (got,), (cut,) = _shown(spark, budget, ("retrieve_and_analyze_knowledge", whole))
        assert cut and got["artifact_ref"]["artifact_id"] == "0" and whole["summary"].startswith(got.get("summary", ""))
        if budget > 60:
            assert got["status"] == "ok" and got["summary"] and "query" not in got
    assert _tokens(json.dumps(got, sort_keys=True, separators=(",", ":"), ensure_ascii=False)) >= 180
    strings = spark.range(1).select(V2.string_values(F.lit('{"a":["x",{"b":"y"}],"c":1}')).alias("s")).first()["s"]
    assert strings == ["x", "y"]


def test_views_of_unknown_kinds_are_empty(spark):
    rows = spark.createDataFrame([(1, "worker_result", '{"evidence":[{"citation":"E1"}]}'), (2, "tool_result", "{}"), (3, "paper_read", None)], "artifact_id int, kind string, payload string")
    assert [(r["artifact_id"], r["position"]) for r in V2.view_items(rows, "evidence").collect()] == [(1, 0)]
    assert V2.view_items(rows, "full").count() == 3 and V2.view_items(rows, "paper:x").count() == 0 and V2.citation_manifest(rows.where("artifact_id > 1")).count() == 0


# ---- sources


def test_files_manifests_and_parsers(spark, tmp_path):
    path = f"file://{tmp_path}/project.json"
    first = T.project_manifest(spark, path, "p1", "one")
    assert first == {"name": "one", "project_id": "p1", "schema_version": 1} and T.project_manifest(spark, path, "p2", "two") == first
    a = spark.createDataFrame([("x", 1, 5), ("y", 2, 5), ("z", 3, 5)], "relative_path string, file_size int, modified int")
    b = spark.createDataFrame([("x", 1, 5), ("y", 2, 6)], "relative_path string, file_size int, modified int")
    assert {r["relative_path"]: r["issue"] for r in T.unchanged(a, b).collect()} == {"x": None, "y": "changed_while_read", "z": "changed_while_read"}
    assert T.select_parser("auto", {"plain": T.plain_text}) == "plain"
    for name, known in (("pdf", {"plain": 1}), ("auto", {})):
        with pytest.raises(LookupError):
            T.select_parser(name, known)

    def parser(content):
        if content == b"bad":
            raise ValueError("no text")
        return T.plain_text(content)

    files = spark.createDataFrame([(1, bytearray(b"one\n\ntwo\fthree")), (2, bytearray(b"bad"))], "version_id int, content binary")
    blocks = T.parse_documents(files, parser)
    rows = sorted((r["version_id"], r["page_number"] or 0, r["text"] or r["error"]) for r in blocks.collect())
    assert rows == [(1, 1, "one"), (1, 1, "two"), (1, 2, "three"), (2, 0, "ValueError: no text")]
    good = blocks.where("error is null").drop("error")
    saved = T.save_documents(good)
    schema = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in good.schema if f.name != "version_id")
    assert sorted(map(str, T.load_documents(saved, schema).select(*good.columns).collect())) == sorted(map(str, good.collect()))
    with pytest.raises(Exception, match="corrupt document: 1"):
        T.load_documents(saved.withColumn("digest", F.lit("x")), schema).collect()


def test_states_expire_alike_on_a_stream(spark, tmp_path):
    """A stream in three files ends the same states as the batch, but for those that its watermark hasn't passed."""
    at = lambda minute: f"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"
    files = [[("a", 0), ("b", 5), ("a", 20)], [("a", 200), ("c", 210)], [("z", 900)]]
    for i, rows in enumerate(files):
        spark.createDataFrame([(k, at(m)) for k, m in rows], "session_id string, t string").select("session_id", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/f{i}")
    paths = [f"{tmp_path}/in/f{i}" for i in range(3)]
    batch = {(r["session_id"], str(r["ts"]), r["updates"]) for r in E.expired_states(spark.read.parquet(*paths), 3600).collect()}
    assert batch == {("a", at(20), 2), ("a", at(200), 1), ("b", at(5), 1), ("c", at(210), 1)}
    stream = spark.readStream.schema("session_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = E.expired_states(stream, 3600).writeStream.format("memory").queryName("expired").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert {(r["session_id"], str(r["ts"]), r["updates"]) for r in spark.table("expired").collect()} == batch


@pytest.mark.parametrize("at_once", [100_000, 3])
def test_leaders_equal_the_greedy_choice(spark, monkeypatch, at_once):
    monkeypatch.setattr(C, "LEAD_IN_ONE", at_once)
    rnd = random.Random(12)
    base = ["temporal grounding of sentences in long videos %d" % i for i in range(6)]
    rows = []
    for i in range(160):
        t = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 2)):
            t[rnd.randrange(len(t))] = rnd.choice("abcxyz ")
        rows.append((i, ("p", "q", None)[i % 3], "".join(t)))
    rows += [(200, "p", "short"), (201, "p", "short"), (202, "p", None), (203, "p", None), (204, None, "short")]
    want = []
    for part in ("p", "q", None):
        leaders = []
        for k, t in ((k, t or "") for k, p, t in rows if p == part):
            found = next((lk for lk, lt in leaders if lt == t or min(len(lt), len(t)) >= 24 and SequenceMatcher(None, t, lt).ratio() >= 0.96), None)
            if found is None:
                leaders.append((k, t))
            want.append((k, k if found is None else found))
    got = C.leader_groups(spark.createDataFrame(rows, "k int, p string, t string").repartition(3), "p", "k", "t")
    assert sorted((r["k"], r["leader"]) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("at_once", [1_000, 40])
def test_followers_equal_the_greedy_choice_on_any_graph(spark, monkeypatch, at_once):
    """Random pairs, a chain, and a star whose first leader is settled after another one."""
    monkeypatch.setattr(C, "LEAD_IN_ONE", at_once)
    rnd = random.Random(5)
    pairs = {tuple(sorted(rnd.sample(range(60), 2))) for _ in range(90)} | {(100 + i, 101 + i) for i in range(9)} | {(200, 201), (201, 202), (202, 210), (203, 210)}
    lead, want = {}, set()
    for b in sorted({b for _, b in pairs}):
        first = next((a for a in sorted(a for a, x in pairs if x == b) if a not in lead), None)
        if first is not None:
            lead[b] = first
            want.add((b, first))
    got = C._followers(spark.createDataFrame(sorted(pairs), "a long, b long"))
    assert {(r["b"], r["leader"]) for r in got.collect()} == want
    assert C._followers(spark.createDataFrame([], "a long, b long")).count() == 0


def test_title_pairs_hold_all_near_ones_and_few_others(spark):
    """Titles that share their words at other places, and lengths that no near title has, don't meet."""
    rnd = random.Random(8)
    words = "temporal grounding language video moment retrieval learning dense caption network".split()
    titles = [" ".join(rnd.choices(words, k=rnd.randint(3, 9))) for _ in range(150)]
    for t in titles[:60]:
        c = list(t)
        for _ in range(rnd.randint(1, 3)):
            at = rnd.randrange(len(c))
            c[at : at + rnd.randint(0, 1)] = rnd.choice(["", "x", "zz"])
        titles.append("".join(c))
    titles = sorted({t for t in titles if len(t) >= 18})
    want = set()
    for (i, a), (j, b) in itertools.combinations(enumerate(titles), 2):
        inside = min(len(a), len(b)) / max(len(a), len(b)) if a in b or b in a else 0.0
        if max(SequenceMatcher(None, a, b).ratio(), inside) >= 0.94:
            want.add((i, j))
    df = spark.createDataFrame(list(enumerate(titles)), "id int, t string")
    assert {(r["a"], r["b"]) for r in C.similar_titles(df, "id", "t").collect()} == want and len(want) > 30
    met = C._title_pairs(df.withColumn("within", F.lit(0)), 0.94).count()
    assert met < len(titles) ** 2 / 2 / 5


def test_pruned_scores_keep_the_best(spark, monkeypatch):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(words[min(59, int(rnd.expovariate(0.12)))] for _ in range(n))
    docs = spark.createDataFrame([(i, text(rnd.randint(0, 40))) for i in range(300)] + [(900, None)], "doc_id int, text string")
    q = spark.createDataFrame([(i, text(6)) for i in range(25)] + [(90, "w0 w1"), (91, "zzz"), (92, None), (93, "")], "query_id int, query string")
    take = lambda df: sorted((r["query_id"], r["doc_id"], round(r["bm25"], 9)) for r in R.top_k(df, 5, [F.desc(F.round("bm25", 9)), F.asc("doc_id")], ["query_id"]).collect())
    want = take(R.bm25(q, docs))
    assert len(want) > 100
    for share in (0.02, 0.3, 0.9):
        monkeypatch.setattr(R, "COMMON", share)
        pruned = R.bm25(q, docs, best=5)
        assert take(pruned) == want
        assert pruned.groupBy("query_id", "doc_id").count().where("count > 1").isEmpty()
