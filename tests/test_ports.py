"""Parsers and structure processors plugged in from outside, and reading order from boxes."""

import random

import pytest
from pyspark.sql import functions as F

from docquarry.operators import layout as L
from docquarry.operators import structure as S
from docquarry.sources import ports as P


def _told(name, parser, spark, **options):
    spark.dataSource.register(P.parser_source(name, parser))
    return lambda path: spark.read.format(name).options(**options).load(path)


def test_a_parser_is_a_data_source(spark, tmp_path):
    def parse(content):
        if content.startswith(b"!"):
            raise ValueError("no notes")
        if content.startswith(b"?"):
            return [("short",)]
        return [(1, f"b{i}", "paragraph", t, i, None) for i, t in enumerate(content.decode().split("\n")) if t]

    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / ".hidden").mkdir()
    for name, text in {"a.note": "one\ntwo", "deep/b.NOTE": "three", "deep/er/c.note": "!", "d.note": "", "e.note": "?", "f.txt": "other", ".hidden/g.note": "hidden", "long.note": "x" * 100_000}.items():
        (tmp_path / name).write_text(text)
    read = _told("notes", parse, spark, suffix=".note", bytesPerTask="6")
    rows = read(str(tmp_path))
    got = {(r["relative_path"], r["block_id"], len(r["text"] or ""), r["error"]) for r in rows.collect()}
    assert got == {
        ("a.note", "b0", 3, None), ("a.note", "b1", 3, None), ("deep/b.NOTE", "b0", 5, None), ("deep/er/c.note", None, 0, "ValueError: no notes"),
        ("e.note", None, 0, "ValueError: the parser's blocks need 6 fields"), ("long.note", "b0", 100_000, None),
    }
    # a.note alone, d.note to b.NOTE together, c.note and e.note, the long one alone
    assert rows.rdd.getNumPartitions() > 2
    assert read(f"file://{tmp_path}/a.note").count() == 2
    (tmp_path / "none").mkdir()
    assert read(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="missing"):
        read(str(tmp_path / "missing")).count()


def test_files_are_packed_in_order():
    assert P._dealt([("a", "a", 4), ("b", "b", 2), ("c", "c", 1), ("d", "d", 90), ("e", "e", 0), ("f", "f", 6)], 6) == [[("a", "a"), ("b", "b")], [("c", "c")], [("d", "d")], [("e", "e"), ("f", "f")]]
    dealt = P._dealt([(str(i), str(i), i % 7) for i in range(100)], 10)
    assert [p for part in dealt for p, _ in part] == [str(i) for i in range(100)]
    assert all(sum(int(p) % 7 for p, _ in part) <= 10 for part in dealt)


def test_a_structure_processor_is_a_table_function(spark):
    def pack(rows):
        out, held = [], []
        for r in rows:
            held.append(r["text"])
            if len(held) == 2:
                out.append((len(out), " ".join(held)))
                held = []
        return out + [(len(out), " ".join(held))] if held else out

    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, ""), (3, None), (4, "only"), (None, "x\ny")], "doc_id long, text string")
    S.blocks_of(docs).createOrReplaceTempView("port_blocks")
    spark.udtf.register("packed_in_twos", P.structure_function(pack, "chunk_order int, text string"))
    got = spark.sql("select * from packed_in_twos(table(port_blocks))")
    assert [f.simpleString() for f in got.schema.fields] == ["version_id:bigint", "chunk_order:int", "text:string"]
    assert {tuple(r) for r in got.collect()} == {(1, 0, "a b"), (1, 1, "c"), (4, 0, "only"), (None, 0, "x y")}
    S.blocks_of(docs.where("false")).createOrReplaceTempView("no_blocks")
    assert spark.sql("select * from packed_in_twos(table(no_blocks))").count() == 0
    docs.createOrReplaceTempView("no_blocks_at_all")
    with pytest.raises(Exception, match="lacks version_id"):
        spark.sql("select * from packed_in_twos(table(no_blocks_at_all))").collect()


#: Pages by hand, in reading order: id, x0, y0, x1, y1.
PAGES = {
    "two columns": [("l1", 50, 100, 290, 200), ("l2", 50, 210, 290, 400), ("l3", 50, 410, 290, 700), ("r1", 310, 100, 550, 200), ("r2", 310, 210, 550, 400), ("r3", 310, 410, 550, 700)],
    "title, columns, figure across, columns": [
        ("title", 80, 40, 520, 70), ("authors", 150, 75, 450, 90), ("l1", 50, 110, 290, 300), ("l2", 50, 306, 290, 350), ("r1", 310, 110, 550, 240), ("r2", 310, 250, 550, 350),
        ("figure", 50, 360, 550, 500), ("caption", 60, 505, 540, 520), ("l3", 50, 530, 290, 600), ("l4", 50, 605, 290, 700), ("r3", 310, 530, 550, 600), ("r4", 310, 605, 550, 660), ("foot", 280, 740, 320, 750),
    ],
    "right column longer": [("l1", 50, 100, 290, 200), ("r1", 310, 100, 550, 150), ("r2", 310, 160, 550, 300), ("r3", 310, 310, 550, 500)],
    "columns start apart": [("l1", 50, 100, 290, 150), ("l2", 50, 170, 290, 300), ("r1", 310, 160, 550, 290), ("r2", 310, 310, 550, 400)],
    "one column": [("a", 50, 50, 550, 80), ("b", 60, 90, 500, 120), ("c", 50, 119.5, 550, 160)],
    "three columns": [(f"{c}{i}", x, 100 + 50 * i, x + 150, 140 + 50 * i) for c, x in (("a", 40), ("b", 210), ("d", 380)) for i in range(4)],
    "columns in a column": [("l", 50, 100, 200, 500), ("head", 220, 100, 550, 120), ("m1", 220, 130, 370, 300), ("m2", 220, 310, 370, 500), ("n1", 390, 130, 550, 300), ("n2", 390, 310, 550, 500)],
    "no cut": [("a", 0, 0, 60, 60), ("b", 40, 40, 100, 100), ("c", 41, 40, 99, 99)],
}


def test_reading_order_of_pages(spark):
    rnd = random.Random(4)
    rows = [(v, 1, *b, "text") for v, page in PAGES.items() for b in page]
    rnd.shuffle(rows)
    boxes = spark.createDataFrame([(*r[:3], *map(float, r[3:7]), r[7]) for r in rows], "version_id string, page_number int, block_id string, x0 double, y0 double, x1 double, y1 double, text string")
    placed = L.reading_order(boxes)
    assert placed.columns == [*boxes.columns, "layout_order", "band", "column"]
    for v, page in PAGES.items():
        assert [r["block_id"] for r in placed.where(F.col("version_id") == v).orderBy("layout_order").collect()] == [b[0] for b in page], v
    told = {r["block_id"]: (r["band"], r["column"]) for r in placed.where("version_id like 'title%'").collect()}
    assert told["l2"][1] == told["l3"][1] == 0 and told["r2"][1] == told["r3"][1] == 1 and told["l1"][0] == told["r2"][0] < told["figure"][0] < told["l3"][0] < told["foot"][0]
    assert L.in_order(placed).where("version_id = 'two columns' and block_id = 'r1'").first()["reading_order"] == 3


def test_reading_order_of_odd_boxes(spark):
    schema = "version_id string, page_number int, block_id string, x0 double, y0 double, x1 double, y1 double, band string"
    nan, inf = float("nan"), float("inf")
    rows = [("v", 1, "a", 0.0, 50.0, 10.0, 60.0), ("v", 1, "b", 0.0, 0.0, 10.0, 10.0), ("v", 1, "c", None, 0.0, 1.0, 1.0), ("v", 1, "d", nan, 0.0, 1.0, 1.0), ("v", 1, "e", 0.0, 0.0, inf, 1.0), ("v", 1, "f", 5.0, 0.0, 1.0, 1.0), ("v", 2, "a", None, None, None, None), (None, None, "z", 0.0, 0.0, 0.0, 0.0), (None, None, None, 0.0, 1.0, 0.0, 1.0), ("v", 1, "b", 0.0, 0.0, 10.0, 10.0)]
    boxes = spark.createDataFrame([(*r, "kept") for r in rows], schema).withColumnRenamed("band", "extra")
    got = [(r["version_id"], r["page_number"], r["block_id"], r["layout_order"]) for r in L.reading_order(boxes).collect()]
    want = [("v", 1, "b", 0), ("v", 1, "b", 0), ("v", 1, "a", 1), ("v", 1, "c", 2), ("v", 1, "d", 3), ("v", 1, "e", 4), ("v", 1, "f", 5), ("v", 2, "a", 0), (None, None, "z", 0), (None, None, None, 1)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert L.reading_order(boxes.where("false")).count() == 0


def test_a_deep_page_is_cut_without_recursion():
    """Columns within strips within columns, a thousand levels and more."""
    boxes, x, y, n = [], 0.0, 0.0, 1500
    for i in range(n):
        boxes.append((x, y, x + 1, 1e6, 2 * i))
        x += 11
        boxes.append((x, y, 1e6, y + 1, 2 * i + 1))
        y += 11
    assert [r for r, _, _ in L._cut(boxes[::-1], 6.0, 1.0)][:40] == list(range(40))
