"""Vector codes, Merkle manifest and personal data against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm import codes, merkle, pii, queries

SF = "/root/testdata/sf0.001"


# --- vector codes ---------------------------------------------------------


def plain_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    """rows: (key, vector, label), sound ones only."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(scale * c) for c in r[1]] for r in rows]
    cuts = np.array_split(np.arange(len(rows[0][1])), parts)
    books = [[[w[d] for d in cut] for w in whole[:entries]] for cut in cuts]

    def nearest(w, p):
        own = [w[d] for d in cuts[p]]
        return min((sum((a - b) ** 2 for a, b in zip(own, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            members: dict[int, list] = {}
            for w in whole:
                members.setdefault(nearest(w, p)[1], []).append([w[d] for d in cuts[p]])
            new.append([[sum(c) // len(members[i]) for c in zip(*members[i])] if i in members else e for i, e in enumerate(books[p])])
        books = new
    told, by_label = [], {}
    for r, w in zip(rows, whole):
        found = [nearest(w, p) for p in range(parts)]
        error = sum(f[0] for f in found)
        by_label[r[2]] = by_label.get(r[2], 0) + error
        told.append((r[0], "".join(f"{f[1]:02x}" for f in found), error, r[2]))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((k, c, e, by_label[g], digest) for k, c, e, g in told), key=str)


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("code", T.StringType())])


def test_tree_keeps_points_sums_and_boxes():
    x = np.random.default_rng(1).integers(-9, 9, (500, 3))
    t = codes.tree(x, 8)
    assert sorted(t["order"]) == list(range(500))
    for a, z, child, low, high, total in zip(*(t[f] for f in ("first", "last", "child", "low", "high", "total"))):
        own = x[t["order"][a:z]]
        assert (own.min(0) == low).all() and (own.max(0) == high).all() and (own.sum(0) == total).all()
        assert child >= 0 or z - a <= 8 or not (high - low).any()


@pytest.mark.parametrize("seed", range(12))
def test_filtering_equals_all_distances(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-6, 6, (rng.integers(1, 400), rng.integers(1, 5)))
    book = x[rng.integers(0, len(x), 20)] + rng.integers(-1, 2, (20, x.shape[1]))  # ties and equal entries
    e = ((x[:, None] - book[None]) ** 2).sum(2).argmin(1)
    for points in (True, False):
        sums, counts, entry = codes.filtered(codes.tree(x, 4), x, book, points)
        assert (counts == np.bincount(e, minlength=20)).all()
        assert all((sums[i] == x[e == i].sum(0)).all() for i in range(20))
        assert not points or (entry == e).all()


def test_filtering_hands_over_whole_nodes(monkeypatch):
    """Points of far clusters are never measured one by one."""
    x = np.concatenate([np.random.default_rng(c).integers(0, 4, (256, 4)) + 1000 * c for c in range(8)])
    measured = []
    plain = codes._distances
    monkeypatch.setattr(codes, "_distances", lambda a, b: measured.append(len(a)) or plain(a, b))
    codes.filtered(codes.tree(x), x, np.array([[1000 * c] * 4 for c in range(8)]), points=False)
    assert sum(measured) < len(x) / 8


def test_compress_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 70)
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(v) for v in np.float32(rng.normal(0, 0.3, 18))], None if k % 5 == 0 else int(k % 3), "own") for k in rng.integers(0, 400, 300)]
    rows += [rows[0], (None, rows[1][1], 1, "x"), (7, rows[2][1], None, None)]
    odd = [(1000, None, 1, ""), (1001, [], 1, ""), (1002, [None] * 18, 1, ""), (1003, [float("nan")] * 18, 1, ""), (1004, [float("inf")] * 18, 1, ""), (1005, [1.0] * 4, 1, ""), (1006, [3e38] * 18, 1, "")]
    got = codes.compress(spark.createDataFrame(rows + odd, VECTORS).repartition(3), parts=5, entries=11).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_codes([r[:3] for r in rows], 5, 11)


def test_compress_odd_tables(spark):
    assert codes.compress(spark.createDataFrame([], VECTORS)).collect() == []
    one = [(5, [0.5] * 16, None, None)]
    assert [tuple(r) for r in codes.compress(spark.createDataFrame(one, VECTORS)).collect()] == plain_codes([r[:3] for r in one])


def test_op11_equals_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted((tuple(r) for r in queries.op11_vector_codes(spark, SF).collect()), key=str) == plain_codes(rows)


# --- Merkle manifest ------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*(code(v) for v in r))

    def tree(hashes):
        """(root, path of each)."""
        paths, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
        while len(level) > 1:
            for p, i in zip(paths, at):
                low = i - i % 3
                p.append((level[low:i], level[i + 1 : low + 3]))
            level, at = [H(*level[i : i + 3]) for i in range(0, len(level), 3)], [i // 3 for i in at]
        return level[0], paths

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: tree([leaf(r) for r in own[s]]) for s in sources}
    root, above = tree([trees[s][0] for s in sources])
    told = []
    for s, up in zip(sources, above):
        for r, path in zip(own[s], trees[s][1]):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = leaf((*r[:4], r[4].replace("\n", "") if bad and r[4] is not None else r[4]))
            for before, after in path + up:
                h = H(*before, h, *after)
            told.append((r[0], leaf(r), trees[s][0], root, H(*(x for step in path + up for side in step for x in side)), h, h == root))
    return sorted(told, key=str)


DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("text", T.StringType())])
def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))


@pytest.mark.parametrize("height", [1, 2])
def test_manifest_equals_plain(spark, height):
    sizes = {None: 2, "": 1, "a": 3, "b": 9, "ä": 10, "z": 27, "hot": 90, "\U0001f600": 4, "￮": 5}
    rows = [(i, s, "en" if i % 3 else None, i * 7, f"Text {i}\nof ü {s}" if i % 5 else None) for s, n in sizes.items() for i in range(n)]
    rows += [(None, "a", None, None, None), (None, None, None, None, "x\ny"), (3, "b", "de", 1, "another\n"), rows[20], (4, "z", None, -5, "")]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS).repartition(5).withColumn("leaf", F.lit("extra")), *tampered(), height=height).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_manifest(rows)


def test_manifest_odd_tables(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS), *tampered()).collect() == []
    rows = [(1, "a", "en", 3, "a\nb")]
    assert [tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, DOCS), *tampered()).collect()] == plain_manifest(rows)


def test_climb_fills_blocks():
    full = [H(str(i)) for i in range(merkle.FAN**merkle.HEIGHT)]
    assert len(merkle.climb(full, True)) == len(merkle.climb(full[:1], False)) == merkle.HEIGHT + 1
    assert merkle.climb(full[:1], True) == [full[:1]] and len(merkle.climb(full[:4], True)) == 3


# --- personal data --------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_passes(kind, match):
    own = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(own) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(own))) % 10 == 0
    return kind == "email" or 8 <= len(own) <= 15


def plain_base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if plain_passes(k, m.group())]


def plain_lower(share, n, z=pii.SIGMAS):
    return (share + z * z / (2 * n) - z * math.sqrt((share * (1 - share) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def plain_find(rows, rounds=3, least=0.5):
    """rows: (doc_id, text). Python's expressions are those of the operator, without guards against going back."""
    form = {k: re.compile(f) for k, f in pii.FORMS.items()}
    every = re.compile(pii.MENTION)
    said, pairs = [], set()
    for at, (_, text) in enumerate(rows):
        text = text or ""
        spans = [m.span() for m in every.finditer(text)]
        ends = [0, *(z for _, z in spans)]
        starts = [*(a for a, _ in spans), len(text)]
        for i, (a, z) in enumerate(spans):
            before, after = text[ends[i] : a], text[z : starts[i + 1]]
            left = before if len(before) <= pii.AROUND else re.sub(r"^\S*", "", before[-pii.AROUND :])
            right = after if len(after) <= pii.AROUND else re.sub(r"\S*$", "", after[: pii.AROUND], count=1)
            words = [re.sub("[0-9]+", "0", s.lower()).split() for s in (left, right)]
            match = text[a:z]
            kind = next((k for k in pii.KINDS if form[k].fullmatch(match)), None)
            if kind is None:
                continue
            patterns = [f"{n}|{' '.join(words[0][-n:])}" for n in (1, 2, 3) if len(words[0]) >= n]
            patterns += [f"lr|{words[0][-1]} _ {words[1][0]}"] if all(words) else []
            seed = any(k == kind and re.fullmatch(PLAIN[k], match) and plain_passes(k, match) for k in pii.KINDS)
            said.append((at, kind, match, a, z, seed))
            pairs |= {(p, kind, match, seed) for p in patterns}
    trust = {}
    for _ in range(rounds):
        confident = {}
        for p in {p for p, *_ in pairs}:
            own = [e for e in pairs if e[0] == p]
            for k in pii.KINDS:
                if any(e[1] == k and e[3] for e in own):
                    low = plain_lower(sum(1.0 if e[3] else trust.get(e[1:3], 0.0) for e in own if e[1] == k) / len(own), len(own))
                    if low >= least:
                        confident[p, k] = low
        new = {}
        for p, k, match, seed in pairs:
            if not seed and (p, k) in confident:
                new[k, match] = max(new.get((k, match), 0), confident[p, k])
        trust = new
    told = []
    for at, (doc, text) in enumerate(rows):
        base = plain_base(text)
        more = [(k, a, z) for i, k, m, a, z, seed in said if i == at and (seed or (k, m) in trust) and all(z <= b or a >= c for _, b, c in base)]
        line = lambda spans: ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), *s[1:])))
        told.append((doc, *(sum(s[0] == k for s in base) for k in pii.KINDS), hashlib.sha256(line(base).encode()).hexdigest(), line(base + more), len(more)))
    return sorted(told, key=str)


TEXTS = "doc_id long, text string"


def card(k):
    own = f"4{k:014d}"
    return next(own + c for c in "0123456789" if plain_passes("card", own + c))


def planted():
    rows = []
    for i in range(14):
        rows.append((i, f"Please call me at +1 ({200 + i}) 555-{1000 + i} today. Card number {card(i * 7919)} was used, host server {i}.2.3.{i} up, write to user{i}@mail.example.com soon."))
    rows.append((50, "Please call me at (321) 555-7788 today."))  # no sign
    rows.append((51, "Card number 4111 1111 1111 1112 was used"))  # fails Luhn
    rows.append((52, "write to anna (at) mail (dot) example (dot) com soon"))
    rows.append((53, "host server 2001:db8:0:0:1:0:0:1 up"))
    rows.append((54, "They sold 555-7788 apples of 1234 5678 9012 3456 pears in 12:30:45:10 at night."))
    rows.append((55, "Again (321) 555-7788 without any cue"))  # the same instance elsewhere
    rows.append((56, f"swallowed +1 (269) 555-3296 {card(31337)} both"))
    rows += [(None, None), (57, ""), (57, "\U0001f600 a@b.c_d@e.f.g +1 23456789 00012.3.4.255 1.2.3.4.5.6.7.8 256.1.1.1")]
    return rows


def test_find_equals_plain(spark):
    rows = planted()
    table = spark.createDataFrame(rows, TEXTS).repartition(4).withColumn("spans", F.lit(1)).withColumn("_match", F.lit(2))
    got = [tuple(r) for r in pii.find(table).collect()]
    assert sorted(got, key=str) == plain_find(rows)
    told = {r[0]: r[6] for r in got if r[0] != 57}
    assert told[50] == "phone:18:32" and told[51] == "card:12:31" and told[52] == "email:9:47" and told[53] == "ip:12:32"
    assert told[54] == "" and told[55] == "phone:6:20" and told[56].startswith("card:") and "phone:" in told[56]


def test_find_odd_texts(spark):
    assert pii.find(spark.createDataFrame([], TEXTS)).collect() == []
    long = ["1" * 300_000, "a" * 300_000, "a." * 200_000, "1 " * 200_000, "+1" + " " * 200_000, "a@" + "b." * 100_000 + "b", "1.2.3." * 60_000, "1-" * 150_000 + "1", "(1) " * 60_000]
    got = {r[0]: tuple(r)[1:5] for r in pii.find(spark.createDataFrame(list(enumerate(long)), TEXTS)).collect()}
    assert [got[k] for k in range(len(long))] == [(0, 0, 0, 0)] * 5 + [(1, 0, 0, 0), (0, 45_000, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]


@pytest.mark.parametrize("seed", range(3))
def test_bases_equal_plain_expressions(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, "".join(rng.choice(list("ab1290.@+-_() ,é\n"), rng.integers(0, 90), p=[0.07, 0.05, 0.13, 0.08, 0.08, 0.13, 0.12, 0.08, 0.06, 0.05, 0.02, 0.02, 0.02, 0.05, 0.01, 0.02, 0.01]))) for i in range(600)]
    got = {r[0]: tuple(r)[1:6] for r in pii.find(spark.createDataFrame(rows, TEXTS)).collect()}
    for i, text in rows:
        base = plain_base(text)
        told = hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in base).encode()).hexdigest()
        assert got[i] == (*(sum(s[0] == k for s in base) for k in pii.KINDS), told), text


def test_op13_equals_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_pii(spark, SF).collect()), key=str) == plain_find(rows)


def test_op13_runs_no_python(spark):
    plan = queries.op13_pii(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExternalRDD", plan)
