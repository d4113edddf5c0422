"""Counters kept as states, and small functions that no query runs."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as X
from docquarry.functions import vectors as V
from docquarry.operators import counts as K
from docquarry.operators import reading as D
from docquarry.operators.counters import Counters


def _rows(n, start=0):
    return [(("a", "b", None)[i % 3], i % 7, f"v{i % 11}" if i % 5 else None, i) for i in range(start, start + n)]


def _plain(rows):
    out = {}
    for k, x, v, _ in rows:
        n, s, held = out.get(k, (0, 0, set()))
        out[k] = (n + 1, s + x, held | ({v} if v else set()))
    return {k: (n, s, len(v)) for k, (n, s, v) in out.items()}


def _got(c):
    return {r["k"]: (r["n"], r["x"], r["v_distinct"]) for r in c.read().collect()}


def test_counters_equal_a_full_recount(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "k string, x long, v string, id long")
    c = Counters(spark, f"file://{tmp_path}/counters", ["k"], ("x",), ("v",), ("id",))
    with pytest.raises(LookupError):
        c.read()
    first, second, third = _rows(200), _rows(60, 1000), _rows(30, 3)
    assert c.add(frame(first), "1") and c.add(frame(second), "2") and c.add(frame(third), "3")
    assert not c.add(frame(second), "2")
    assert _got(c) == _plain(first + second + third)
    about = {r["k"]: r["id_about"] for r in c.read().collect()}
    assert all(abs(about[k] - len({r[3] for r in first + second + third if r[0] == k})) <= 4 for k in about)
    # a batch taken away leaves the others' values; an empty batch counts nothing
    assert c.add(frame(second), "undo 2", F.lit(-1)) and c.add(frame([]), "none")
    assert _got(c) == _plain(first + third)
    mixed = frame([("b", 1, "new", 1), *(r for r in first if r[0] == "b")])
    assert c.add(mixed, "moves", F.when(F.col("v").eqNullSafe(F.lit("new")), 1).otherwise(-1))
    want = _plain([*(r for r in first if r[0] != "b"), *third, ("b", 1, "new", 1)])
    assert _got(c) == want
    c.compact()
    c.clean()
    assert len(c._state()[1]["deltas"]) == 1 and _got(c) == want and not c.add(frame(first), "1")


def test_counters_without_values_or_sums(spark, tmp_path):
    c = Counters(spark, f"file://{tmp_path}/counters", ["k"])
    c.add(spark.createDataFrame([("a",), ("a",), (None,)], "k string"), "1")
    c.add(spark.createDataFrame([(None,)], "k string"), "2", F.lit(-1))
    assert [tuple(r) for r in c.read().collect()] == [("a", 2)]


def test_run_status_tells_failed_items_and_issues(spark):
    rows = spark.createDataFrame([(1, "new", False), (1, "failed", False), (2, "new", None), (2, "skipped", False), (3, "new", True)], "run int, d string, issue boolean")
    got = {r["run"]: r.asDict() for r in K.run_status(rows, "run", "d", ["new", "skipped", "failed"], F.col("issue")).collect()}
    assert {k: r["status"] for k, r in got.items()} == {1: "completed_with_issues", 2: "completed", 3: "completed_with_issues"}
    assert (got[1]["n_new"], got[1]["n_failed"], got[2]["n_failed"], got[2]["n_skipped"]) == (1, 1, 0, 1)


def test_small_functions(spark):
    row = spark.createDataFrame([("https://doi.org/10.1000/ABC.5).", 0.0, "Dr. José  Ñandú-Weiß", None)], "doi string, x double, name string, none string")
    got = row.select(X.clean_doi("doi"), V.sigmoid("x"), V.sigmoid(F.lit(2.0)), X.normalize_author("name"), X.clean_doi("none"), X.normalize_author("none"), D.structure_version("1", "b2")).first()
    assert got[0] == "10.1000/abc.5" and got[1] == 0.5 and math.isclose(got[2], 1 / (1 + math.exp(-2.0)))
    assert got[3] == X._folded(pd.Series(["Dr. José  Ñandú-Weiß"]), False)[0] and "ñandú" in got[3] and "weiss" in got[3] and "  " not in got[3]
    assert got[4] is None and got[6] == "1+b2"
