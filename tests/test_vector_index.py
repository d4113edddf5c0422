"""The persisted index of vectors against a comparison with all rows."""

import hashlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.operators import retrieval as R
from docquarry.operators import vector_index as VI

ROWS, ASKED = "vec_id long, embedding array<double>, scope string", "query_id long, query_vector array<double>, scope string"


def _found(df):
    return {(r[0], r[1]): round(r[2], 8) for r in df.collect()}


def _rows(n, seed=0, centres=12, width=8):
    """Rows around a few directions, of three scopes."""
    r = np.random.default_rng(seed)
    c = r.standard_normal((centres, width))
    return [(i, [float(x) for x in c[i % centres] + 0.05 * r.standard_normal(width)], f"s{i % 3}") for i in range(n)]


ODD = [
    (900, None, "s0"), (901, [0.0] * 8, "s0"), (902, [float("nan")] * 8, "s0"), (903, [float("inf")] + [1.0] * 7, "s0"), (904, [1.0, 2.0], "s0"), (905, [1.0, None, *[1.0] * 6], "s1"), (None, [1.0] * 8, "s1"),
    (906, [1.0] * 8, None), (907, [1.0] * 8, "s1"), (908, [1.0] * 8, "s1"), (909, [2.0] * 8, "s1"), (910, [-1.0] * 8, "s1"),
]


@pytest.fixture
def index(spark, tmp_path):
    return VI.VectorIndex(spark, f"file://{tmp_path}/index", scope=["scope"], ball=16)


def _asked(spark):
    rows = [(-i, v, s) for i, v, s in _rows(9, seed=3)] + [(10, [1.0] * 8, "s1"), (11, [1.0, 2.0], "s0"), (12, None, "s0"), (13, [1.0] * 8, "none"), (14, [1.0] * 8, None), (15, [0.0] * 8, "s1")]
    return spark.createDataFrame(rows, ASKED)


def _plain(spark, rows, k):
    sound = [r for r in rows if r[0] is not None and r[2] is not None and not any(x is not None and np.isinf(x) for x in r[1] or [])]
    return _found(R.dense(_asked(spark), spark.createDataFrame(sound, ROWS), k, scope=["scope"]))


def _files(path):
    return {str(f.relative_to(path)): hashlib.sha256(f.read_bytes()).hexdigest() for f in Path(path).rglob("*.parquet")}


def test_index_equals_all_rows_through_changes(spark, tmp_path, index):
    rows = _rows(300) + ODD
    assert index.add(spark.createDataFrame(rows, ROWS)) == {"added": 311, "dead": 0}
    for k in (7, 200):
        assert _found(index.search(_asked(spark), k)) == _plain(spark, rows, k)
    before = _files(tmp_path)
    # ten moved to other places or scopes, one new, one that becomes null; the others keep their files
    changed = {i: (i, _rows(300)[i + 1][1], f"s{(i + 1) % 3}") for i in range(0, 100, 10)} | {950: (950, [0.5] * 8, "s1"), 55: (55, None, "s1")}
    assert index.add(spark.createDataFrame(list(changed.values()), ROWS)) == {"added": 12, "dead": 11}
    assert before.items() <= _files(tmp_path).items()
    now = [r for r in rows if r[0] not in changed] + list(changed.values())
    assert _found(index.search(_asked(spark), 7)) == _plain(spark, now, 7)
    # nothing has changed: nothing is written
    after = _files(tmp_path)
    assert index.add(spark.createDataFrame(now, ROWS), complete=True) == {"added": 0, "dead": 0}
    assert {f for f in _files(tmp_path) if "/balls/" in f} == {f for f in after if "/balls/" in f}
    # half of the rows go
    kept = [r for r in now if r[0] is not None and r[0] % 2]
    assert index.add(spark.createDataFrame(kept, ROWS), complete=True)["dead"] == len({r[0] for r in now if r[0] is not None}) - len(kept)
    assert _found(index.search(_asked(spark), 7)) == _plain(spark, kept, 7)
    index.compact()
    index.clean()
    assert len(index._state()[1]["segments"]) == 1 and not index._state()[1]["dead"] and index._state()[1]["documents"] == len(kept)
    assert _found(index.search(_asked(spark), 7)) == _plain(spark, kept, 7)


def test_only_balls_that_may_hold_results_are_read(spark, tmp_path):
    rows = _rows(1200, centres=40, width=16)
    index = VI.VectorIndex(spark, f"file://{tmp_path}/index", ball=16, element="float")
    index.add(spark.createDataFrame(rows, ROWS))
    asked = spark.createDataFrame([(i, v) for i, v, _ in rows[:40]], "query_id long, query_vector array<double>")
    balls = index._read("bounds", index._state()[1]["segments"], index._BOUNDS).count()
    met = index.reached(asked, 5).select(F.sum(F.size("q_ids"))).first()[0]
    assert balls >= 75 and met < 40 * balls / 5
    plain = R.dense(asked, spark.createDataFrame(rows, ROWS), 5)
    got, want = _found(index.search(asked, 5)), _found(plain)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-6 for p in want)


def test_known_digests_and_empty_tables(spark, index):
    none = spark.createDataFrame([], ROWS)
    assert index.add(none) == {"added": 0, "dead": 0} and index.search(_asked(spark), 3).count() == 0
    rows = spark.createDataFrame([(i, v, s, f"h{i}") for i, v, s in _rows(20)], f"{ROWS}, content string")
    assert index.add(rows, digest="content") == {"added": 20, "dead": 0}
    seen = spark.createDataFrame([(1, "h1"), (2, "other"), (99, "h99")], "vec_id long, content string")
    assert [r["vec_id"] for r in index.known(seen, "vec_id", "content").collect()] == [1]
    assert index.add(rows.withColumn("embedding", F.lit(None).cast("array<double>")), digest="content") == {"added": 0, "dead": 0}
    assert index.search(_asked(spark).where("false"), 3).count() == 0


def test_repeated_ids_count_once_and_equal_rows_stay_together(spark, tmp_path):
    index = VI.VectorIndex(spark, f"file://{tmp_path}/index", ball=4)
    same = [(i, [1.0, 1.0], "a", "x") for i in range(50)] + [(7, [1.0, -1.0], "a", "w"), (60, [1.0, 0.0], "a", "x")]
    assert index.add(spark.createDataFrame(same, f"{ROWS}, content string"), digest="content")["added"] == 51
    asked = spark.createDataFrame([(1, [2.0, 2.0])], "query_id long, query_vector array<double>")
    assert sorted(_found(index.search(asked, 3))) == [(1, 0), (1, 1), (1, 2)]
    assert len(_found(index.search(asked, 80))) == 51
