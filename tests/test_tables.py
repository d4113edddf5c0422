"""Persisted text index, bucketed merges, re-ingestion and sessions over streams."""

import hashlib
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as X
from docquarry.operators import retrieval as R
from docquarry.operators import text_index as N
from docquarry.sources import versions
from docquarry.sources.buckets import BucketTable
from docquarry.streaming import ingest, store


def _files(path):
    """Data files below a folder and what they hold."""
    return {str(f.relative_to(path)): hashlib.sha256(f.read_bytes()).hexdigest() for f in Path(path).rglob("*.parquet")}


# ---- text index


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def _text(i):
    return " ".join(["the"] * (1 + i % 4) + [WORDS[(i * k) % 14] for k in range(1, 2 + i % 9)])


def _scores(df):
    return {(r[0], r[1]): round(r[2], 9) for r in df.collect()}


def _best(scores, k):
    out = {}
    for (q, d), s in scores.items():
        out.setdefault(q, []).append((-s, d))
    return {q: sorted(v)[:k] for q, v in out.items()}


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(1, "the alpha beta"), (2, "the"), (3, "kappa nu nu"), (4, "unknown"), (5, None)], "query_id int, query string")


def test_index_equals_a_scan_and_keeps_old_files(spark, tmp_path, asked, monkeypatch):
    monkeypatch.setattr(N, "RANGE", 16)
    docs = spark.createDataFrame([(i, _text(i)) for i in range(120)] + [(None, "alpha"), (500, None), (501, ""), (502, "beta beta"), (502, "alpha")], "doc_id long, text string")
    one = [(502, max(("beta beta", "alpha"), key=lambda t: hashlib.sha256(t.encode()).hexdigest()))]
    index = N.TextIndex(spark, f"file://{tmp_path}/index")
    assert index.add(docs.where("false")) == {"added": 0, "dead": 0}
    assert index.add(docs) == {"added": 123, "dead": 0}
    plain = spark.createDataFrame([(i, _text(i)) for i in range(120)] + [(500, ""), (501, "")] + one, "doc_id long, text string")
    assert _scores(index.bm25(asked)) == _scores(R.bm25(asked, plain))
    for k in (1, 5):
        assert _best(_scores(index.bm25(asked, best=k)), k) == _best(_scores(R.bm25(asked, plain)), k)
    before = _files(tmp_path)
    # two changed, one new, the rest as they were
    later = {7: "alpha alpha new", 8: "", 900: "zeta the"}
    more = plain.where("doc_id not in (7, 8)").unionByName(spark.createDataFrame(list(later.items()), "doc_id long, text string"))
    assert index.add(more) == {"added": 3, "dead": 2}
    after = _files(tmp_path)
    assert all(after[f] == h for f, h in before.items())
    added = [f for f in after if f not in before and "postings" in f]
    words = {r[0] for r in spark.read.parquet(*(f"file://{tmp_path}/{f}" for f in added)).select("_term").distinct().collect()}
    assert words == {"alpha", "new", "zeta", "the"}
    assert _scores(index.bm25(asked)) == _scores(R.bm25(asked, more))
    assert _best(_scores(index.bm25(asked, best=4)), 4) == _best(_scores(R.bm25(asked, more)), 4)
    assert index.add(more) == {"added": 0, "dead": 0}
    # those that aren't there any more go
    rest = more.where("doc_id < 60")
    assert index.add(rest, complete=True)["dead"] == 64
    assert _scores(index.bm25(asked)) == _scores(R.bm25(asked, rest))
    index.compact()
    index.clean()
    assert _scores(index.bm25(asked)) == _scores(R.bm25(asked, rest)) and len(versions.names(spark, index.path)) == 2
    hits = lambda df: sorted(map(tuple, df.collect()))
    assert hits(index.full_text(asked)) == hits(R.full_text(asked, rest))
    assert [r for r in hits(index.full_text(asked, limit=3)) if r[0] == 2] == [(2, 0), (2, 1), (2, 2)]


def test_index_reads_no_text_and_skips_lists(spark, tmp_path, asked, monkeypatch):
    monkeypatch.setattr(N, "RANGE", 8)
    docs = spark.createDataFrame([(i, _text(i)) for i in range(200)], "doc_id long, text string")
    docs.write.parquet(f"file://{tmp_path}/docs")
    index = N.TextIndex(spark, f"file://{tmp_path}/index")
    index.add(spark.read.parquet(f"file://{tmp_path}/docs"))
    found = index.bm25(asked, best=2)
    read = found._jdf.queryExecution().executedPlan().toString()
    assert "/docs" not in read and "_digest" not in read
    state = index._state()[1]
    lists = index._postings(state).where("_term = 'the'")
    near = spark.createDataFrame([(1, *lists.select("_segment", "_range").first())], "query_id int, _segment string, _range long")
    weights = spark.createDataFrame([(1, "the")], "query_id int, _term string")
    assert index.needed(lists, near, weights).count() == 1 < lists.count()


def test_empty_index(spark, tmp_path, asked):
    index = N.TextIndex(spark, f"file://{tmp_path}/index")
    assert index.bm25(asked).count() == 0 and index.bm25(asked, best=3).count() == 0 and index.full_text(asked).count() == 0
    assert index.add(spark.createDataFrame([], "doc_id long, text string")) == {"added": 0, "dead": 0}
    index.compact()
    assert index.bm25(asked, best=3).count() == 0


def test_best_documents_are_taken_range_by_range(spark, tmp_path, monkeypatch):
    """No row is made for a document of a list, and of many copies only those of the least ids leave a range."""
    monkeypatch.setattr(N, "RANGE", 64)
    docs = spark.createDataFrame([(i, "the alpha beta") for i in range(300)] + [(i, _text(i)) for i in range(300, 360)], "doc_id long, text string")
    index = N.TextIndex(spark, f"file://{tmp_path}/index")
    index.add(docs)
    queries = spark.createDataFrame([((1, "a"), "the alpha"), ((2, None), "kappa the"), ((3, "c"), "unknown")], "query_id struct<n: int, s: string>, query string")
    found = index.bm25(queries, best=3)
    assert "Generate explode" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() <= 2 * 3 * index.documents().select(N._range(index.documents())).distinct().count()
    plain = R.bm25(queries, docs)
    assert _best(_scores(found), 3) == _best(_scores(plain), 3) and {r[0]["n"] for r in found.select("query_id").collect()} == {1, 2}


def test_counts_of_texts_equal_the_columns(spark):
    odd = ["", "a\x1fb\x85c\u3000d\u180ee", "İstanbul ÀB_1 漢字\U00020000 x\u200by", "\U0001f600\U0001f600 a\x00b", "aa aa aa"]
    low = [r[0] for r in spark.createDataFrame([(t,) for t in odd], "t string").select(F.lower("t")).collect()]
    lengths, ends, terms, counts = N.word_counts(low)
    words = [r[0] for r in spark.createDataFrame([(t,) for t in odd], "t string").select(X.search_tokens("t")).collect()]
    assert lengths == list(map(len, words)) and [dict(zip(terms[a:b], counts[a:b])) for a, b in zip(ends, ends[1:])] == [dict(Counter(w)) for w in words]
    lengths, ends, terms, counts = N.gram_counts(low)
    want = [dict(Counter(t[i : i + 3] for i in range(len(t)))) for t in low]
    assert lengths == list(map(len, low)) and [dict(zip(terms.to_pylist()[a:b], counts.tolist()[a:b])) for a, b in zip(ends, ends[1:])] == want


def test_substrings_equal_contains_on_all_rows(spark, tmp_path):
    rows = [(i, _text(i)) for i in range(150)] + [(500, "ab"), (501, "b"), (502, ""), (503, None), (504, "ALPHA\nbeta.Ünï\U0001f600x"), (505, "aaaa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = [(1, "pha b"), (2, "A\nB"), (3, "aaa"), (4, "ünï\U0001f600"), (5, "b"), (6, "AB"), (7, "nothing"), (8, ""), (9, None), (10, "the"), (11, "aaaaa"), (12, "a (")]
    index = N.SubstringIndex(spark, f"file://{tmp_path}/grams")
    index.add(docs)
    queries = spark.createDataFrame(asked, "query_id int, pattern string")
    want = sorted((q, i) for q, p in asked if p for i, t in rows if p.lower() in (t or "").lower())
    assert sorted(map(tuple, index.containing(queries, docs).collect())) == want
    near = index.candidates(queries.where("query_id in (1, 7)"))
    assert near.where("query_id = 7").count() == 0 and len([1 for q, _ in want if q == 1]) <= near.count() < 60
    index.add(spark.createDataFrame([(505, "b b"), (506, "xaaax")], docs.schema))
    assert [r["doc_id"] for r in index.containing(queries.where("query_id = 3"), docs.unionByName(spark.createDataFrame([(506, "xaaax")], docs.schema))).collect()] == [506]


def test_substring_lists_are_not_taken_apart(spark, tmp_path, monkeypatch):
    """A document is one row whatever its patterns, and no row is made for a document of a list."""
    monkeypatch.setattr(N, "RANGE", 16)
    docs = spark.createDataFrame([(i, _text(i)) for i in range(90)], "doc_id long, text string")
    index = N.SubstringIndex(spark, f"file://{tmp_path}/grams")
    index.add(docs)
    near = index._holding(spark.createDataFrame([("the",), ("alpha",), ("e",), ("q?",)], "_pattern string"))
    assert "arrays_zip" not in near._jdf.queryExecution().executedPlan().toString()
    told = {r["_id"]: set(r["_patterns"]) for r in near.collect()}
    want = {i: {p for p in ("the", "alpha", "e", "q?") if p in _text(i)} for i in range(90)}
    assert near.count() == len(told) and all(want[i] <= told.get(i, set()) for i in want) and all("q?" not in p for p in told.values())


# ---- bucketed tables


SCHEMA = "k long, g string, v long, n long"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merge_touches_its_buckets_only(spark, tmp_path):
    t = BucketTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], buckets=8)
    first = spark.createDataFrame([(i, "ab"[i % 2], i * 10, 1) for i in range(100)] + [(None, "c", 1, 1)], SCHEMA)
    assert t.merge(first)["written"] == 8 and _rows(t.read()) == _rows(first)
    before = _files(tmp_path)
    told = t.merge(spark.createDataFrame([(3, "z", 5, 7), (3, "z", 6, 9), (None, "d", 2, 7)], SCHEMA), {"v": F.col("new.v"), "n": F.col("old.n") + 1}, order=["v"])
    want = [r for r in _rows(first) if r[0] not in (3, None)] + [(3, "b", 6, 2), (None, "c", 2, 2)]
    assert told["written"] <= 2 and _rows(t.read()) == sorted(want, key=str)
    after = _files(tmp_path)
    assert all(after[f] == h for f, h in before.items())
    live = set(t._state()[1]["live"].values())
    assert sum(any(f.startswith(f"t/{x}") for x in live) for f in before) >= 6
    t.clean()
    assert len(_files(tmp_path)) < len(after) and _rows(t.read()) == sorted(want, key=str)
    t.delete(spark.createDataFrame([(4,), (5,), (1000,)], "k long"))
    assert t.read().where("k in (4, 5, 1000)").count() == 0 and t.read().count() == 99
    t.merge(spark.createDataFrame([(6, "q", 0, 0), (2000, "q", 0, 0)], SCHEMA), where=F.col("old.g") == "none", insert=False)
    assert t.read().where("g = 'q'").count() == 0
    t.replace(spark.createDataFrame([(1, "b", -1, 0), (7001, "b", -1, 0)], SCHEMA), ["g"])
    assert _rows(t.read().where("g = 'b'")) == [(1, "b", -1, 0), (7001, "b", -1, 0)] and t.read().where("g = 'a'").count() == 49


def test_merge_survives_a_crash_before_the_swap(spark, tmp_path, monkeypatch):
    t = BucketTable(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], buckets=4)
    first = spark.createDataFrame([(i, "a", i, 1) for i in range(20)], SCHEMA)
    t.merge(first, mark=("s", 0))

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(versions, "commit", crash)
        with pytest.raises(RuntimeError, match="lost"):
            t.merge(first.withColumn("v", F.lit(-1)), mark=("s", 1))
    assert _rows(t.read()) == _rows(first) and t.marked("s") == 0
    t.clean()
    assert t.merge(first.withColumn("v", F.lit(-1)), mark=("s", 1))["written"] == 4
    assert t.merge(first.withColumn("v", F.lit(-2)), mark=("s", 1))["written"] == 0  # the batch again
    assert {r["v"] for r in t.read().collect()} == {-1}
    version, state = t._state()
    versions.commit(spark, t.path, version, state)
    with pytest.raises(versions.Conflict):
        versions.commit(spark, t.path, version, state)
    assert t.merge(spark.createDataFrame([], SCHEMA)) == {"written": 0, "buckets": 4}


# ---- streams


def test_reingest_runs_stale_stages_once(spark, tmp_path):
    at = f"file://{tmp_path}"
    schema = "version_id long, document_hash string, text string, ts long"
    documents = BucketTable(spark, f"{at}/documents", schema, ["version_id"], 4)
    ledger = BucketTable(spark, f"{at}/ledger", "version_id long, stage string, stage_version string, document_hash string", ["version_id", "stage"], 4)
    words = BucketTable(spark, f"{at}/words", "version_id long, n long, word string", ["version_id", "n"], 4)
    sizes = BucketTable(spark, f"{at}/sizes", "version_id long, size long", ["version_id"], 4)
    stages = [("words", "1", lambda d: d.select("version_id", F.posexplode(F.split("text", " ")).alias("n", "word")), words), ("sizes", "1", lambda d: d.select("version_id", F.length("text").alias("size")), sizes)]
    make = lambda rows: spark.createDataFrame([(i, hashlib.sha256(t.encode()).hexdigest(), t, s) for i, t, s in rows], schema)
    make([(1, "a b c", 1), (2, "d", 1), (2, "older", 0)]).coalesce(1).write.parquet(f"{at}/in/1")
    run = lambda s=stages: ingest.reingest(spark.readStream.schema(schema).parquet(f"{at}/in/*"), "in", f"{at}/check", documents, ledger, s, order=["ts"]).awaitTermination(120)
    run()
    assert _rows(words.read()) == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "d")] and _rows(sizes.read()) == [(1, 5), (2, 1)]
    make([(1, "a", 2), (3, "x y", 2)]).coalesce(1).write.parquet(f"{at}/in/2")
    run()
    want = [(1, 0, "a"), (2, 0, "d"), (3, 0, "x"), (3, 1, "y")]
    assert _rows(words.read()) == want and ledger.read().count() == 6 and documents.marked("in") == 1
    # the same batch again, whole and after a stop between two tables
    assert ingest.apply_batch(make([(1, "a", 2), (3, "x y", 2)]), 1, "in", documents, ledger, stages, order=["ts"]) == {"words": 0, "sizes": 0}
    ledger.delete(spark.createDataFrame([(3, "sizes")], "version_id long, stage string"))
    assert ingest.apply_batch(make([(1, "a", 2), (3, "x y", 2)]), 1, "in", documents, ledger, stages, order=["ts"]) == {"words": 0, "sizes": 1}
    assert _rows(words.read()) == want and _rows(sizes.read()) == [(1, 1), (2, 1), (3, 3)]
    # a stage's new version runs it and what follows
    newer = [("words", "2", *stages[0][2:]), stages[1]]
    assert ingest.apply_batch(make([(2, "d", 1)]), 2, "in", documents, ledger, newer, order=["ts"]) == {"words": 1, "sizes": 1}


def test_sessions_live_through_a_restart_and_expire(spark, tmp_path):
    schema = "session_id string, seq long, op string, value string"
    kept = {k: spark.conf.get(k, None) for k in (*store.SETTINGS, "spark.sql.shuffle.partitions")}
    for setting in store.SETTINGS.items():
        spark.conf.set(*setting)
    spark.conf.set("spark.sql.shuffle.partitions", "1")

    def run(name, seconds, n, rows):
        at = f"file://{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/in/{n}")
        told = store.sessions(spark.readStream.schema(schema).parquet(f"{at}/in/*"), seconds, most=2)
        told.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start().awaitTermination(120)
        return sorted((k, s, v, list(h)) for k, s, v, h in spark.read.parquet(f"{at}/out").collect() if (k, s) in {r[:2] for r in rows})

    try:
        assert run("a", 3600, 1, [("a", 1, "set", "x"), ("a", 2, "append", "m1"), ("a", 3, "append", "m2"), ("a", 4, "append", "m3"), ("a", 5, "get", None), ("b", 1, "get", None)]) == [("a", 5, "x", ["m2", "m3"]), ("b", 1, None, [])]
        # another query from the same checkpoint
        assert run("a", 3600, 2, [("a", 6, "get", None), ("b", 2, "set", "y"), ("b", 3, "drop", None), ("b", 4, "get", None)]) == [("a", 6, "x", ["m2", "m3"]), ("b", 4, None, [])]
        run("b", 1, 1, [("a", 1, "set", "x"), ("a", 2, "append", "m")])
        time.sleep(1.5)
        assert run("b", 1, 2, [("a", 3, "get", None)]) == [("a", 3, None, [])]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
