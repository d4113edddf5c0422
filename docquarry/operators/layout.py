"""Reading order of a page's blocks from their boxes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Box = tuple[float, float, float, float, int]


def reading_order(boxes: DataFrame, gutter: float = 6.0, overlap: float = 1.0) -> DataFrame:
    """Blocks with layout_order, from 0 on each page, and band and column at the first cuts of their page.

    `boxes`: version_id, page_number, block_id, x0, y0, x1, y1 (y grows downwards), and whatever else. A page is cut from
    top to bottom where no block is (blocks may overlap by `overlap`); strips that follow each other and have a gutter
    in common, `gutter` wide or more, are one band, so that columns with paragraphs at like heights aren't read across.
    A band is cut into columns, left to right, and each of these in the same way. What can't be cut goes by its top,
    then its left edge, then its id. Blocks with a null, infinite or unordered box come last, by their id. Rows of a
    page with the same id share the place of the uppermost. An empty table gives an empty one. Pages are dealt over
    tasks; one page's boxes are held at a time, without their texts.
    """
    kinds = {c: boxes.schema[c].dataType.simpleString() for c in ("version_id", "page_number", "block_id")}
    schema = ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", layout_order int, band int, column int"
    sound = (F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1"))
    for c in ("x0", "y0", "x1", "y1"):
        # NaN is greater than any number in Spark, so it is asked for by itself
        sound &= ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    edges = [F.when(sound, F.col(c)).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]

    def order(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["block_id", "y0", "x0", "y1", "x1"]).drop_duplicates("block_id", ignore_index=True)
        known = page.dropna(subset=["x0"])
        found = [(float(a), float(b), float(c), float(d), i) for i, a, b, c, d in zip(known.index, known["x0"], known["y0"], known["x1"], known["y1"], strict=True)]
        told = _cut(found, gutter, overlap)
        last = told[-1][1] + 1 if told else 0
        told += [(i, last, 0) for i in page.index[page["x0"].isna()]]
        rows, bands, columns = zip(*told, strict=True)
        return page.loc[list(rows), list(kinds)].assign(layout_order=range(len(rows)), band=bands, column=columns).astype({"layout_order": "int32", "band": "int32", "column": "int32"})

    placed = boxes.select(*kinds, *edges).groupBy("version_id", "page_number").applyInPandas(order, schema)
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"p.{c}")) for c in kinds]
    return boxes.alias("b").join(placed.alias("p"), same).select("b.*", "p.layout_order", "p.band", "p.column")


def in_order(placed: DataFrame) -> DataFrame:
    """Blocks whose reading_order is their place by layout, for sections and chunks."""
    return placed.withColumn("reading_order", F.col("layout_order")).drop("layout_order", "band", "column")


def _parts(boxes: list[Box], axis: int, room: float) -> list[list[Box]]:
    """Boxes cut where, along an axis, a gap of `room` or more lies between all before and all behind."""
    out: list[list[Box]] = []
    end = 0.0
    for b in sorted(boxes, key=lambda b: (b[axis], b[axis + 2], b[4])):
        if not out or b[axis] - end >= room:
            out.append([])
            end = b[axis + 2]
        out[-1].append(b)
        end = max(end, b[axis + 2])
    return out


def _gutters(boxes: list[Box], room: float) -> list[tuple[float, float]]:
    """Strips of `room` or more that cross no box, with all that lies left and right of them."""
    parts = _parts(boxes, 0, room)
    edges = [(min(b[0] for b in p), max(b[2] for b in p)) for p in parts]
    return [(float("-inf"), edges[0][0]), *((a[1], b[0]) for a, b in zip(edges, edges[1:], strict=False)), (edges[-1][1], float("inf"))]


def _shared(one: list[tuple[float, float]], other: list[tuple[float, float]], room: float) -> list[tuple[float, float]]:
    both = [(max(a, c), min(b, d)) for a, b in one for c, d in other]
    return [(a, b) for a, b in both if b - a >= room]


def _inner(gutters: list[tuple[float, float]], left: float, right: float) -> bool:
    return any(a >= left and b <= right for a, b in gutters)


def _bands(boxes: list[Box], gutter: float, overlap: float) -> list[list[Box]]:
    """Strips from top to bottom, those with a gutter in common taken together."""
    out: list[list[Box]] = []
    free: list[tuple[float, float]] = []
    for strip in _parts(boxes, 1, -overlap):
        own = _gutters(strip, gutter)
        if out:
            both = _shared(free, own, gutter)
            held = out[-1]
            left, right = min(b[0] for b in held + strip), max(b[2] for b in held + strip)
            # one of the two has columns already, and the other keeps to them
            if _inner(both, left, right) and (len(own) > 2 or len(free) > 2):
                held += strip
                free = both
                continue
        out.append(list(strip))
        free = own
    return out


def _cut(boxes: list[Box], gutter: float, overlap: float) -> list[tuple[int, int, int]]:
    """(row, band, column) in reading order; the parts still to be cut are kept on a stack, so depth has no limit."""
    told: list[tuple[int, int, int]] = []
    work: list[tuple[list[Box], tuple[int, int]]] = [(band, (n, 0)) for n, band in reversed(list(enumerate(_bands(boxes, gutter, overlap))))] if boxes else []
    first = {n for _, (n, _) in work}
    while work:
        part, at = work.pop()
        columns = _parts(part, 0, gutter) if len(part) > 1 else [part]
        if len(columns) > 1:
            top = at[0] in first
            first.discard(at[0])
            work += [(c, (at[0], n if top else at[1])) for n, c in reversed(list(enumerate(columns)))]
            continue
        first.discard(at[0])
        bands = _bands(part, gutter, overlap) if len(part) > 1 else [part]
        if len(bands) > 1:
            work += [(b, at) for b in reversed(bands)]
        else:
            told += [(b[4], *at) for b in sorted(part, key=lambda b: (b[1], b[0], b[4]))]
    return told
