"""Top-k, mixing, embedding links, repeated strings and n-gram links against brute force; the pipeline."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docquarry.llm import balls, components, covertree, mixing, partenum, queries, suffixdup, topk
from docquarry.llm.common import table

TABLES = "documents embeddings pages labels conversations".split()


def plain(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, smallest, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{smallest}/{t}.parquet'")
    df = queries.QUERIES[name](spark, smallest)
    cursor = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    assert plain(df.select(*columns).collect()) == plain([[r[names.index(c)] for c in columns] for r in cursor.fetchall()])


def reach(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in links:
        label[find(a)] = find(b)
    return [find(i) for i in range(n)]


def least(ids, roots):
    best = {}
    for k, r in zip(ids, roots):
        if k is not None:
            best[r] = min(best.get(r, k), k)
    return [best.get(r) for r in roots]


# ---- vectors


@pytest.fixture(scope="module")
def vectors(spark):
    rnd = np.random.default_rng(1)
    rows = []
    for i in range(260):
        v = rnd.normal(size=8)
        if i % 3:
            v = np.array(rows[i - 1][1], float) + rnd.normal(size=8) * 0.15
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 7 == 0)))
    rows += [(300, rows[10][1], 0), (301, rows[10][1], 0), (302, None, 0), (303, [0.0] * 8, 0), (304, [float("nan")] * 8, 0), (305, [None] * 8, 0), (306, rows[10][1], None), (307, [1.0, 2.0], 0), (None, rows[3][1], 0), (308, [float("inf")] * 8, 1), (309, [], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("_x", F.lit("clash")).repartition(3)


def test_topk_brute(spark, vectors):
    rows = [(r["vec_id"], np.floor(64 * np.array(r["embedding"], float)).astype(int)) for r in vectors.collect() if r["vec_id"] is not None and r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"])]
    want = []
    for q, x in rows:
        if q % 20 == 0:
            scored = sorted((-int(x @ y), k) for k, y in rows if k != q and len(y) == len(x))[:20]
            want += [(q, i + 1, k, -s) for i, (s, k) in enumerate(scored)]
    got = topk.search(vectors, F.col("vec_id") % 20 == 0, block_rows=40, query_rows=4)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.search(vectors.where("false"), F.lit(True)).count() == 0
    few = topk.search(vectors.where("vec_id < 4"), F.lit(True)).groupBy("query_id").count().collect()
    assert {r["count"] for r in few} == {3}


def test_topk_repeated_ids_and_large_numbers(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [0.0, 5.0]), (2, [3e14, 1.0]), (3, [2.0, 2.0])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.search(df, F.col("vec_id") == 1, scale=64).collect()}
    assert got == {(1, 2): 64 * 5 * 64, (1, 3): 64 * 5 * 128}


def test_cover_tree_brute(spark, vectors):
    rows = vectors.collect()
    x = [None if not r["embedding"] or any(v is None or not np.isfinite(v) for v in r["embedding"]) or not any(r["embedding"]) or r["label"] is None or r["vec_id"] is None else np.array(r["embedding"], float) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and rows[i]["label"] == rows[j]["label"] and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.93]
    roots = least([r["vec_id"] for r in rows], reach(len(rows), links))
    n = [sum(i in e for e in links) for i in range(len(rows))]
    want = sorted(((r["vec_id"], k, c, r["vec_id"] == c) for r, k, c in zip(rows, n, roots)), key=str)
    for block in (2048, 23):
        got = sorted((tuple(r) for r in covertree.near_links(vectors, block_rows=block).collect()), key=str)
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert [g[3] for g in got if g[0] is not None] == [w[3] for w in want if w[0] is not None]
    assert covertree.near_links(vectors.where("false")).count() == 0


def test_dual_traversal_loses_nothing():
    rnd = np.random.default_rng(3)
    for n, m, spread in ((1, 1, 1.0), (50, 80, 0.2), (200, 3, 1.0), (120, 120, 0.02)):
        a, b = (balls.unit((rnd.normal(size=5) + spread * rnd.normal(size=(k, 5))).ravel(), 5) for k in (n, m))
        trees = []
        for v in (a, b):
            order, radius = balls.farthest_first(v)
            trees.append(covertree.CoverTree(v[order], radius))
        p, q = covertree.dual(*trees, 0.3)
        got = set(zip(p.tolist(), q.tolist()))
        far = np.sqrt(np.maximum(0, 2 - 2 * trees[0].x @ trees[1].x.T))
        assert {(i, j) for i, j in zip(*np.nonzero(far <= 0.3))} <= got


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(999, i) for i in range(500, 560)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    ids = sorted({x for e in edges if None not in e for x in e})
    at = {k: i for i, k in enumerate(ids)}
    want = least(ids, reach(len(ids), [(at[a], at[b]) for a, b in edges if a is not None]))
    assert got == dict(zip(ids, want))
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- mixing


def test_schedule_is_pfair(spark):
    weights = [("a", 7), ("b", 1), ("c", 13), ("d", 4), ("e", 1)]
    slots = mixing.schedule(spark.createDataFrame(weights, "_mix_source string, _mix_weight long")).orderBy("_mix_at").collect()
    total = sum(w for _, w in weights)
    assert [r["_mix_at"] for r in slots] == list(range(total))
    assert all(r["_mix_from"] <= r["_mix_at"] < r["_mix_by"] for r in slots)
    for s, w in weights:
        done = 0
        for t, r in enumerate(slots, 1):
            done += r["_mix_source"] == s
            assert abs(done - t * w / total) < 1


def test_mixing_keeps_all_rows_in_order(spark):
    rnd = random.Random(2)
    rows = [(i, "x" * rnd.randint(0, 60), rnd.choice(["hot"] * 6 + ["b", "c", None])) for i in range(500)] + [(None, None, None), (3, "same", "hot"), (3, "same", "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("MIX_SLOT", F.col("doc_id") * 2).withColumn("_mix_block", F.lit("clash")).withColumn("_m_hash", F.lit(0))
    names = mixing.added(df.columns)
    assert names[0] == "__mix_block" and mixing.added(["a"]) == mixing.ADDED
    mixed = mixing.mix(df, {"hot": 2, "b": 1, "c": 1, None: 1}, block_chars=100, slots=10)
    assert mixed.columns == [*df.columns, *names]
    assert mixed.where("not (MIX_SLOT <=> doc_id * 2) or _mix_block <> 'clash' or _m_hash <> 0").count() == 0
    got = mixed.select("doc_id", "text", "source", *(F.col(n).alias(m) for n, m in zip(names, mixing.ADDED))).collect()
    key = lambda r: str((r["doc_id"], r["text"], r["source"]))
    assert sorted(map(key, got)) == sorted(str(r) for r in rows)
    assert [r["mix_slot"] for r in got] == sorted(r["mix_slot"] for r in got)
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in got)
    at = defaultdict(set)
    for r in got:
        at[r["mix_slot"]].add((r["source"], r["mix_block"]))
    assert all(len(v) == 1 for v in at.values())
    assert mixing.mix(df.where("false")).count() == 0


def test_mixing_stays_native(spark, smallest):
    plan = queries.op6_source_mixing(spark, smallest)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


# ---- repeated strings


def brute_repeats(rows, length=400):
    seen = defaultdict(list)
    for d, (_, t) in enumerate(rows):
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            seen[raw[i : i + length]].append((d, i))
    gone = defaultdict(list)
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].append((i, i + length))
    out = []
    for d, (k, t) in enumerate(rows):
        raw, spans, at, kept = (t or "").encode(), suffixdup.merged(gone[d]), 0, b""
        for a, b in spans:
            kept += raw[at:a]
            at = b
        out.append((k, len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept + raw[at:]).hexdigest()))
    return sorted(out, key=str)


def repeat_rows():
    rnd = random.Random(3)
    text = lambda n, letters="abcdefgh ": "".join(rnd.choice(letters) for _ in range(n))
    shared = [text(700, "ab é") for _ in range(3)]
    rows = [(i, text(rnd.randint(0, 300)) + shared[i % 3][rnd.randint(0, 250) : rnd.randint(300, 700)] + text(rnd.randint(0, 300))) for i in range(150)]
    return rows + [(5, None), (5, None), (None, "x" * 900), (7, "ab" * 500), (8, "y" * 1000), (8, "y" * 1000), (9, "z" * 401), (10, "q" * 400), (11, ""), (12, "é" * 300 + shared[0] + "日" * 200)]


def test_repeats_brute(spark, monkeypatch):
    rows = repeat_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("t1", F.lit("clash")).repartition(3)
    want = brute_repeats(rows)
    assert sorted((tuple(r) for r in suffixdup.remove_repeats(df).collect()), key=str) == want
    for name, value in (("BUCKET", 60), ("RANGES", 5), ("BUFFER", 3000), ("WINDOWS", 2000)):
        monkeypatch.setattr(suffixdup, name, value)
    assert sorted((tuple(r) for r in suffixdup.remove_repeats(df).collect()), key=str) == want
    assert suffixdup.remove_repeats(df.where("false")).count() == 0
    assert suffixdup.remove_repeats(df.where("length(text) < 90")).count() == sum(len(t or "") < 90 and t is not None for _, t in rows)


def test_a_lead_that_fills_ranges_is_dealt_by_text(spark, monkeypatch):
    """One passage in all texts, so nearly all suffixes start alike, in few ranges of many parts."""
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    hot = text(520)
    rows = [(i, text(rnd.randint(0, 90)) + hot[rnd.randint(0, 60) : rnd.randint(455, 520)] + text(rnd.randint(0, 90))) for i in range(120)]
    for name, value in (("BUCKET", 10), ("RANGES", 3)):
        monkeypatch.setattr(suffixdup, name, value)
    seen = {}

    def told(df, name, kept=suffixdup.written):
        out = kept(df, name)
        if name == "suffix-live":
            seen["leads"] = sorted(r["n"] for r in out.groupBy("lead").agg(F.count("*").alias("n")).collect())
        return out

    monkeypatch.setattr(suffixdup, "written", told)
    got = suffixdup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_repeats(rows)
    assert seen["leads"][-1] > 3 * 10  # beyond the buckets of a range


def brute_word_repeats(rows, length=50):
    """The texts without the words of repeated sequences and the white space after them."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    words = [list(word.finditer(t or "")) for _, t in rows]
    seen = defaultdict(list)
    for d, w in enumerate(words):
        for i in range(len(w) - length + 1):
            seen[tuple(m[0] for m in w[i : i + length])].append((d, i))
    gone = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + length))
    out = []
    for (k, t), w, g in zip(rows, words, gone):
        t, kept = t or "", t[: w[0].start()] if t and w else t or ""
        for i, m in enumerate(w):
            kept += "" if i in g else t[m.start() : w[i + 1].start() if i + 1 < len(w) else len(t)]
        out.append((k, "" if len(g) == len(w) > 0 and sum(u == t for _, u in rows) > 1 else kept))
    return sorted(out, key=str)


def test_word_repeats_brute(spark, monkeypatch):
    rnd = random.Random(11)
    words = lambda n: " ".join(rnd.choice(("a", "bé", "cee", "日本", "dddddd")) + str(rnd.randint(0, 99)) for _ in range(n))
    shared = [words(90) for _ in range(3)]
    rows = []
    for i in range(90):
        a, b = rnd.randint(0, 35), rnd.randint(45, 90)
        rows.append((i, f"  {words(rnd.randint(0, 60))}\n{' '.join(shared[i % 3].split()[a:b])}\t{words(rnd.randint(0, 60))}"))
    short = " ".join("w%d" % (i % 10) for i in range(55))  # 55 words of two bytes, well under 400 bytes
    rows += [(200, f"one {short} two"), (201, f"{short}  three"), (202, words(300)), (203, "ha " * 49), (204, "ha " * 51), (205, None), (206, None), (207, " \n ")]
    rows += [(208, shared[0]), (208, shared[0]), (None, shared[1].replace(" ", "  ")), (209, words(49)), (210, "x"), (210, "x")]
    want = brute_word_repeats(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def got():
        return sorted(((r["doc_id"], r["kept"]) for r in suffixdup.remove_repeats(df, length=50, texts=True, unit="words").collect()), key=str)

    assert got() == want
    for name, value in (("BUCKET", 40), ("RANGES", 5), ("BUFFER", 1024), ("WINDOWS", 300)):
        monkeypatch.setattr(suffixdup, name, value)
    assert got() == want


def test_multikey_quicksort():
    rnd = np.random.default_rng(2)
    words = rnd.integers(0, 3, size=(500, 8)).astype(np.uint64)
    order = suffixdup.multikey_quicksort(words)
    assert sorted(map(tuple, words)) == [tuple(words[i]) for i in order]


# ---- n-gram links


def word_sets(rows):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_jaccard(rows):
    sets, links, holding = word_sets(rows), [], defaultdict(list)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in holding[x]:
                common[j] += 1
            holding[x].append(i)
        links += [(i, j) for j, c in common.items() if 100 * c >= 80 * (len(s) + len(sets[j]) - c)]
    roots = least([k for k, _ in rows], reach(len(rows), links))
    return sorted(((k, len(s), r if s else k) for (k, _), s, r in zip(rows, sets, roots)), key=str)


def near_rows():
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    pick = lambda n: [rnd.choice(vocab) for _ in range(n)]
    base, passage, rows = pick(120), pick(60), []
    for i in range(200):
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            j = rnd.randrange(len(w))
            if rnd.random() < 0.5:
                w[j] = rnd.choice(vocab)
            elif rnd.random() < 0.5:
                del w[j]
            else:
                w.insert(j, rnd.choice(vocab))
        rows.append((1000 + i, " ".join(w)))
    rows += [(2000 + i, " ".join(pick(rnd.randint(3, 40)) + passage + pick(rnd.randint(3, 40)))) for i in range(150)]
    rows += [(3000 + i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 14)))) for i in range(200)]
    return rows + [(5, None), (5, None), (None, "a b c"), (None, "q r s t u v"), (7, "A  b\tC"), (8, "\x1c"), (9, "  x"), (10, "x"), (11, "é É"), (12, " ".join(pick(3000)))]


def test_jaccard_brute(spark, monkeypatch):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("s", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    want = brute_jaccard(rows)
    take = lambda d: sorted((tuple(r) for r in d.select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert take(partenum.jaccard_components(df)) == want
    for values in ({"BLOCK": 3000, "TOGETHER": 500, "BROADCAST_KEYS": 0}, {"PART": 20, "BLOCK": 150, "EACH": 0, "FEW": 4, "TEXTS": 2000}):
        for name, value in values.items():
            monkeypatch.setattr(partenum, name, value)
        assert take(partenum.jaccard_components(df)) == want
    assert partenum.jaccard_components(df.where("false")).count() == 0


def test_signatures_of_linked_sets_meet():
    """Linked sets share more signatures of the screen than its margin, and one partition more than they can spare."""
    rnd = np.random.default_rng(4)
    own = lambda x: {int(s) for s in partenum.screened(x, partenum.second(x), 80)[0]}
    met = 0
    for _ in range(1500):
        n = int(rnd.integers(1, 40)) if rnd.random() < 0.3 else int(rnd.integers(30, 700))
        a = np.unique(rnd.integers(0, 2**63, size=n, dtype=np.uint64) * np.uint64(2))
        keep = a[rnd.random(len(a)) > rnd.choice((0.05, 0.1, 0.2))]
        b = np.unique(np.concatenate([keep, rnd.integers(0, 2**63, size=int(rnd.integers(0, 1 + n // 8)), dtype=np.uint64) * np.uint64(2)]))
        inner = len(np.intersect1d(a, b))
        if not len(b) or 100 * inner < 80 * (len(a) + len(b) - inner):
            continue
        met += 1
        sure = [partenum.screened(x, partenum.second(x), 80)[1] for x in (a, b)]
        small = all(partenum.by_prefix(len(x), 80) for x in (a, b))
        assert all(sure) or len(own(a) & own(b)) > (0 if small else min(partenum.margin(len(x), 80) for x in (a, b)))
        assert all(sure) or all(len(partenum.bands(len(x), 80)) > 0 or partenum.by_prefix(len(x), 80) for x in (a, b))
        if not (partenum.by_prefix(len(a), 80) and partenum.by_prefix(len(b), 80)):
            told = []
            for x in (a, b):
                most = partenum.needed(len(x), 80) + partenum.spare(len(x), 80)
                told.append([partenum.signatures(x, partenum.second(x), band, most, 80) for band in partenum.bands(len(x), 80)])
            if all(t[2] for side in told for t in side):
                parts = [{int(s): int(p) for f, at, _ in side for s, p in zip(f, at)} for side in told]
                shared = {parts[0][s] for s in parts[0].keys() & parts[1].keys()}
                assert len(shared) > min(partenum.spare(len(x), 80) for x in (a, b))
    assert met > 300


def test_sets_are_counted_once_a_signature():
    """What tasks and the meeting count together, over all cuts into tasks and batches."""
    rnd = random.Random(9)
    rows = [(rnd.randrange(30), rnd.randrange(12)) for _ in range(400)]
    members = defaultdict(set)
    for sig, s in rows:
        members[sig].add(s)
    want = defaultdict(int)
    for group in members.values():
        for s in group:
            want[s] += len(group) > 1
    for tasks in (1, 3):
        sent = []
        for t in range(tasks):
            own = sorted(set(rows[t::tasks]))  # a task looks at a set once
            a, b, between = partenum.together(*(np.array([r[i] for r in own], np.int64) for i in (0, 1)))
            sent += [(int(x), int(y), 0) for x, y in zip(a, b)] + [(1000 + int(y), int(y), 1) for y in between]
        sent.sort(key=lambda r: (r[0], rnd.random()))
        for size in (1, 7, 1000):
            batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in sent[k : k + size]], pa.int64()) for i in range(3)], names=["sig", "s", "n"]) for k in range(0, len(sent), size)]
            got = defaultdict(int)
            for batch in partenum._meeting(batches):
                for s, n in zip(batch.column("s").to_pylist(), batch.column("n").to_pylist()):
                    got[s] += n
            assert all(got[s] >= want[s] for s in want) and (tasks > 1 or dict(got) == {s: n for s, n in want.items() if n})


def test_word_hashes_see_words_only():
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("abAB \t\né日") for _ in range(rnd.randint(0, 60))) for _ in range(300)] + ["", "x" * 9000 + " y", "X" * 9000 + "  Y", "x" * 8999 + " y"]
    got = [tuple(x.tolist()) for x in partenum.features(texts, 3)]
    sets = defaultdict(set)
    for t, g in zip(texts, got):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).encode().split()
        sets[frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])].add(g)
    assert all(len(v) == 1 and len(next(iter(v))) == len(k) for k, v in sets.items())
    assert len({next(iter(v)) for v in sets.values()}) == len(sets)


# ---- pipeline


def test_pipeline_stages_against_brute_force(spark, smallest):
    docs = table(spark, smallest, "documents")
    columns = docs.columns
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, smallest, "labels").collect()}
    clean = corpus_pipeline.drop_toxic(spark, docs, smallest)
    assert clean.columns == columns
    kept = {r["doc_id"] for r in clean.collect()}
    assert sum(labels.get(k, 1) == 0 for k in kept) == sum(v == 0 for v in labels.values())

    one = corpus_pipeline.drop_near_copies(spark, docs, smallest)
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    heads = sorted({c for _, _, c in brute_jaccard(rows)})
    assert sorted(r["doc_id"] for r in one.collect()) == heads and one.columns == columns

    cut = corpus_pipeline.drop_repeats(spark, docs, smallest)
    assert cut.columns == columns
    cut = cut.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in cut), key=str) == brute_word_repeats([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert all(r["n_chars"] == len(r["text"]) for r in cut)

    mixed = corpus_pipeline.mix_sources(spark, docs, smallest)
    assert mixed.columns == columns and plain(mixed.collect()) == plain(docs.collect())


def test_pipeline_runs_and_survives_odd_tables(spark, smallest, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeats", "mixture", "tokens"]
    out = corpus_pipeline.run(spark, smallest)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < out.count() <= 200
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id long, _place string, _row int, mix_slot int, s1 int"
    rest = (1.0, 2, "p", 3, 4, 5)
    odd = [(1, None, None, None, None, *rest), (1, None, None, None, None, *rest), (None, "some words that are here now", "en", "s", 3, *(None,) * 6), (2, "", "en", "s", 0, *rest), (3, "é " * 150_000, "fr", "s", 300_000, *rest)]
    odd = spark.createDataFrame(odd, schema)
    for d in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, d, smallest)
            assert got.count() == d.count(), name
            if name != "tokens":
                assert got.columns == d.columns
                kept = [c for c in d.columns if c not in ("text", "n_chars")]
                assert plain(got.select(*kept).collect()) == plain(d.select(*kept).collect()), name


def test_pipeline_rows_keep_the_mixed_order(spark, tmp_path, monkeypatch):
    """Over many file splits and with long documents, run()'s rows come in the order of the mixture's slots."""
    rnd = random.Random(8)
    rows = [(i, "xyz "[rnd.randrange(4)] * rnd.choice((9, 4_000, 30_000)), rnd.choice("aaaabbc")) for i in range(240)] + [(900 + i, "long " * 60_000, "abc"[i]) for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    mixed = {r["doc_id"]: r for r in mixing.mix(table(spark, str(tmp_path), "documents")).drop("text").collect()}
    assert sorted(got) == sorted(mixed)
    slots = [mixed[k]["mix_slot"] for k in got]
    assert slots == sorted(slots) and len(set(slots)) > 10
    # in every prefix a source's blocks lie within one of its weight's share: block j is due from release to deadline
    assert all(mixed[k]["mix_release"] <= mixed[k]["mix_slot"] < mixed[k]["mix_deadline"] for k in got)
    assert {mixed[k]["source"] for k in got[: len(got) // 2]} == set("abc")


# ---- balls


def test_balls_hold_every_row_once(spark, monkeypatch):
    """Blocks of bounded size; near vectors of a tight cluster share a block; groups and lengths stay apart."""
    rnd = np.random.default_rng(8)
    far = np.eye(16)
    rows = [(i, int(i % 2), [float(x) for x in far[i % 5] + rnd.normal(size=16) * 0.02]) for i in range(400)] + [(1000 + i, 3, [1.0, 0.0]) for i in range(5)] + [(2000, 4, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "k long, g int, x array<double>").repartition(4)
    monkeypatch.setattr(balls, "PACK", 37)
    got = {r["k"]: r["_block"] for r in balls.deal(df, ["g"], "k", "x", 40).collect()}
    assert sorted(got) == sorted(r[0] for r in rows)
    size = defaultdict(int)
    for k, g, _ in rows:
        size[g, got[k]] += 1
    assert max(size.values()) <= 60 and len(size) < 20
    assert all(len({i % 5 for i in range(400) if i % 2 == g and got[i] == b}) == 1 for g, b in size if g < 2)
    assert balls.deal(df.where("false"), ["g"], "k", "x", 50).count() == 0


def test_near_pairs_of_balls_equal_all_pairs(spark, monkeypatch):
    """Many packs and chunks of balls, in several groups."""
    monkeypatch.setattr(balls, "BALLS", 8)
    monkeypatch.setattr(balls, "CHUNK", 4)
    rng = np.random.default_rng(5)
    rows = []
    for g, n in (("a", 300), ("b", 1), ("c", 40)):
        for i in range(n):
            cell = int(rng.integers(0, 6))
            rows.append((g, 3, cell * (1 << 32) + i, [float(x) for x in np.r_[rng.normal(cell, 0.3, 3), rng.uniform(0, 0.2)]]))
    df = spark.createDataFrame(rows, "g string, d int, _block long, _ball array<double>").repartition(4)
    got = [tuple(r) for r in balls.near_pairs(df, ["g", "d"], 0.5).select("g", "_block", "_other").collect()]
    want = {(g, min(i, j), max(i, j)) for g, _, i, a in rows for h, _, j, b in rows if g == h and np.linalg.norm(np.array(a[:3]) - np.array(b[:3])) <= 0.5 + a[3] + b[3]}
    assert len(got) == len(set(got)) and set(got) == want


def test_search_over_many_packs_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(balls, "BALLS", 2)
    monkeypatch.setattr(balls, "CHUNK", 2)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(0, 1, (400, 6)) + 4 * rng.normal(0, 1, (8, 6))[rng.integers(0, 8, 400)], 3)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.search(df, F.col("vec_id") % 7 == 0, k=5, block_rows=16, query_rows=8).collect()]
    w = np.floor(64 * x).astype(np.int64)
    want = []
    for q in range(0, 400, 7):
        order = sorted((-int(w[q] @ w[v]), v) for v in range(400) if v != q)[:5]
        want += [(q, r + 1, v, -s) for r, (s, v) in enumerate(order)]
    assert sorted(got) == sorted(want)
