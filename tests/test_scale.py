"""Steps whose cost must not grow faster than their input."""

import json
import re
import time
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from docquarry.functions import text as X
from docquarry.operators import curation as C
from docquarry.operators import retrieval as R
from docquarry.operators import structure as S
from docquarry.operators import text_index as N
from docquarry.operators import views as V2


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_citation_manifest_reads_a_payload_once(spark):
    items = [{"citation": f"E{i % 7}", "text": f"t{i}", "chunk_id": str(i)} for i in range(500)]
    rows = spark.createDataFrame([("a", "paper_read", json.dumps({"paper_id": "p", "version_id": "v", "title": "T", "passages": items}))], "artifact_id string, kind string, payload string")
    found = V2.citation_manifest(rows)
    assert sorted((r["label"], r["paper_id"], r["chunk_id"]) for r in found.collect()) == [(f"E{i}", "p", str(i)) for i in range(7)]
    # what stands above the Generate is evaluated for each item, and would read the whole payload for each
    above = plan(found).split("Generate explode")[0]
    assert "get_json_object(payload" not in above


def test_edge_cleaning_is_linear_in_the_lines(spark):
    lines = [f"line {i}" for i in range(5000)]
    pages = ["\n".join(["Head", *lines[k : k + 1000], f"page {k}"]) for k in range(0, 5000, 1000)]
    rows = spark.createDataFrame([(i, "\f".join(pages)) for i in range(4)], "i int, text string")
    began = time.monotonic()
    got = {r[0] for r in rows.select(X.edge_clean_text("text")).collect()}
    # lists of lines were made again for each line: minutes
    assert time.monotonic() - began < 30 and got == {"\n".join(lines)}


def test_exploded_titles_are_never_broadcast(spark):
    rows = spark.createDataFrame([(i, f"title number {i % 90:03d} of a list of like ones") for i in range(90)], "k int, t string")
    found = C.similar_titles(rows, "k", "t")
    # the join of pieces, which names their places, is a merge
    assert re.search(r"SortMergeJoin \[[^]]*i#[^]]*p#", found._jdf.queryExecution().executedPlan().toString())
    want = {(a, b) for a in range(90) for b in range(a + 1, 90) if SequenceMatcher(None, f"title number {a:03d} of a list of like ones", f"title number {b:03d} of a list of like ones").ratio() >= 0.94}
    assert {(r["a"], r["b"]) for r in found.collect()} == want


def test_bound_of_titles_leaves_out_no_pair():
    texts = ["", "abc", "cba", "abcd", "häuser und straßen", "hauser und strassen", "x" * 40, "x" * 39 + "y", "x" * 20]
    pairs = [(a, b) for a in texts for b in texts]
    told = C.may_match(pd.Series([a for a, _ in pairs]), pd.Series([b for _, b in pairs]), 0.9)
    assert all(m or SequenceMatcher(None, a, b).ratio() < 0.9 for (a, b), m in zip(pairs, told))
    assert not told[pairs.index(("abc", "x" * 40))]


def test_index_makes_no_row_for_each_word(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 40}" for j in range(5 + i % 30))) for i in range(200)], "doc_id long, text string")
    index, plans = N.TextIndex(spark, f"file://{tmp_path}/index"), []
    write = index._write
    monkeypatch.setattr(index, "_write", lambda listed, *a: (plans.append(plan(listed)), write(listed, *a))[1])
    monkeypatch.setattr(N, "AT_ONCE", 50)
    index.add(docs)
    assert "explode" not in plans[0]
    flat = index._entries(index._postings(index._state()[1]), index._state()[1]).select("_term", "_id", "_count", "_length").collect()
    want = {(w, r["doc_id"], n, len(r["text"].split())) for r in docs.collect() for w, n in Counter(r["text"].split()).items()}
    assert len(flat) == len(want) and {tuple(r) for r in flat} == want


def test_full_text_holds_no_lists_of_a_range(spark, tmp_path, monkeypatch):
    """All lists of a range were one row, which was copied for each query."""
    monkeypatch.setattr(N, "RANGE", 16)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 40}" for j in range(5 + i % 30))) for i in range(200)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"w{i} w{i * 3 % 40} - nothing") for i in range(30)] + [(3, "w9"), (None, "w11"), (50, "-"), (51, None)], "query_id long, query string")
    index = N.TextIndex(spark, f"file://{tmp_path}/index")
    index.add(docs)
    found = index.full_text(asked)
    assert not re.search("NestedLoop|Cartesian|collect_list\\(struct", found._jdf.queryExecution().executedPlan().toString())
    hits = lambda df: Counter(map(tuple, df.collect()))
    want = hits(R.full_text(asked, docs))
    assert hits(found) == want and any(q is None for q, _ in want)
    # lists of a range come in several batches, and what is found goes in several
    rows = [(s, r, [k + 100 * r + 1000 * (s == "b") for k in range(n % 5, 20, 1 + n % 7)], [7, 1 << 33, n][n % 2 :]) for s in "ab" for r in (1, 2) for n in range(12)]
    lists = pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["_segment", "_range", "_ids", "_by"])
    want = Counter({(q, i): 1 for _, _, ids, by in rows for q in by for i in ids})
    for size in (1, 5, 100):
        monkeypatch.setattr(N, "FOUND", 10 * size)
        assert Counter((r["_q"], r["_id"]) for b in N._found(lists.to_batches(size)) for r in b.to_pylist()) == want


def test_ranges_hold_few_counts_and_are_written_where_they_are_made(spark, tmp_path, monkeypatch):
    """Ranges of long documents held as many of these as others, and lists moved once more before they were written."""
    monkeypatch.setattr(N, "OF_RANGE", 500, raising=False)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i + j) % 150}" for j in range(100 if i < 60 else 2))) for i in range(260)], "doc_id long, text string")
    index = N.TextIndex(spark, f"file://{tmp_path}/index")
    assert index.add(docs)["added"] == 260
    rows = index._postings(index._state()[1])
    held = {r["_range"]: r["n"] for r in rows.groupBy("_range").agg(F.sum(F.size("_ids")).alias("n")).collect()}
    assert sum(held.values()) == 60 * 100 + 200 * 2 and len(held) > 8 and max(held.values()) <= 3 * 500
    writers = rows.select("_range", F.regexp_extract(F.input_file_name(), "part-([0-9]+)", 1)).distinct()
    assert writers.count() == len(held)
    index.compact()
    flat = index._entries(index._postings(index._state()[1]), index._state()[1])
    assert flat.count() == 60 * 100 + 200 * 2 and flat.where("_id < 60").groupBy("_id").count().where("count = 100").count() == 60


def test_texts_of_blocks_move_once(spark):
    """Sections, groups and chunks of documents are made where a document's blocks are."""
    texts = [(i, f"Introduction\nline {i}\nas equation 2 shows\nEquation 2: a = b\nwhere a is b\nTable 1: numbers\nlast\n2. Method\nFigure 3. one\nFigure 3. two") for i in range(40)]
    grouped = S.groups(S.sections(S.blocks_of(spark.createDataFrame(texts, "doc_id long, text string"))))
    made = S.chunks(grouped, target=4, most=8)
    # the blocks with their texts; and the headings, for their levels and with these
    told = re.findall(r"[^\n]*\bExchange [^\n]*", made._jdf.queryExecution().executedPlan().toString())
    assert len(told) == 3, told
    got = [(r["section_order"], r["source_block_ids"], r["dependency"]) for r in grouped.where("version_id = 7").orderBy("group_order").collect()]
    assert got == [(0, ["b0"], False), (0, ["b1"], False), (0, ["b2", "b3", "b4"], True), (0, ["b5"], True), (0, ["b6"], False), (1, ["b7"], False), (1, ["b8", "b9"], True)]
    assert made.select("version_id").distinct().count() == 40
