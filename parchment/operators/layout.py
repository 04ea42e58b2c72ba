"""Layout of a page from placed items: columns by gaps that recur, blocks as wide as a column or the page, and their reading order."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.operators.documents import LEAST_TOLERANCE, SHARE
from parchment.operators.page_index import list_sizes, slices

#: Least width of a gutter, and by mean height; least width of a bucket of votes, and by mean height; least votes, and
#: their share of the lines with gaps; share of the winner's votes for a second gutter; least margin, and by mean height.
GUTTER, BUCKET, VOTES, SECOND, MARGIN = (16.0, 1.7), (20.0, 2.0), (3, 0.3), 0.6, (4.0, 0.5)
#: Fixed value: items of pages that are Python objects at once.
ITEMS = 20_000
#: Fixed value: what stands alone at a tab stop, in at most five characters.
PAGE_NUMBER = re.compile("[ivxlcdm0-9]+", re.IGNORECASE)


class Item(NamedTuple):
    x1: float
    x2: float
    y1: float
    y2: float
    text: str
    ord: int | None


class Line:
    """Items of one height, from left to right, and the columns they come from."""

    def __init__(self, items: list[Item], columns: frozenset[int] = frozenset()):
        self.items, self.columns = sorted(items, key=lambda i: i.x1), columns
        self.x1, self.x2 = self.items[0].x1, max(i.x2 for i in items)
        self.y1, self.y2 = min(i.y1 for i in items), max(i.y2 for i in items)

    def parts(self, gap: float) -> list[Line]:
        """Cut where an item starts further than `gap` to the right of all before it."""
        out: list[list[Item]] = []
        reach = 0.0
        for item in self.items:
            if not out or item.x1 > reach + gap:
                out.append([])
                reach = item.x2
            out[-1].append(item)
            reach = max(reach, item.x2)
        return [Line(own) for own in out]

    def text(self) -> str:
        return " ".join(i.text for i in self.items if i.text)


def lines_of(items: list[Item], column: int | None = None) -> list[Line]:
    """A line ends at the first item whose top is further than the tolerance from that of the line's first item."""
    if not items:
        return []
    tolerance = max(LEAST_TOLERANCE, SHARE * (float(np.mean([i.y2 - i.y1 for i in items])) or 1.0))
    groups: list[list[Item]] = []
    for item in sorted(items, key=lambda i: (i.y1, i.ord is None, i.ord or 0)):
        if not groups or abs(item.y1 - groups[-1][0].y1) > tolerance:
            groups.append([])
        groups[-1].append(item)
    return [Line(own, frozenset() if column is None else frozenset({column})) for own in groups]


def gutters_of(lines: list[Line], height: float) -> list[float]:
    """Places of at most two gutters. Each gap between parts of a line votes for the bucket of its middle, unless a page number
    follows; of the buckets with enough votes the one with the widest gaps wins."""
    gap, width = max(GUTTER[0], GUTTER[1] * height), max(BUCKET[0], BUCKET[1] * height)
    votes, voters = defaultdict(list), 0
    for line in lines:
        parts = line.parts(gap)
        voters += len(parts) > 1
        for a, b in zip(parts, parts[1:]):
            alone = "".join(i.text for i in b.items).strip()
            if not (len(alone) <= 5 and PAGE_NUMBER.fullmatch(alone)):
                middle = (a.x2 + b.x1) / 2
                votes[int(np.floor(middle / width + 0.5))].append((middle, b.x1 - a.x2))
    enough = max(VOTES[0], int(np.ceil(voters * VOTES[1])))
    found = [np.array(v) for v in votes.values() if len(v) >= enough]
    found.sort(key=lambda v: -v[:, 1].mean())
    return sorted(float(v[:, 0].mean()) for k, v in enumerate(found[:2]) if k == 0 or len(v) >= SECOND * len(found[0]))


def joined_lines(lines: list[Line], height: float) -> list[Line]:
    """Lines of different columns at one height with no gutter between them are one line."""
    tolerance, gap = max(LEAST_TOLERANCE, SHARE * height), max(GUTTER[0], GUTTER[1] * height)

    def one(a: Line, b: Line) -> bool:
        left, right = (a, b) if a.x1 <= b.x1 else (b, a)
        return not a.columns & b.columns and abs(a.y1 + a.y2 - b.y1 - b.y2) / 2 <= tolerance and right.x1 - left.x2 < gap

    rest, out = list(lines), []
    while rest:
        line = rest.pop(0)
        while (k := next((k for k, other in enumerate(rest) if one(line, other)), None)) is not None:
            other = rest.pop(k)
            line = Line(line.items + other.items, line.columns | other.columns)
        out.append(line)
    return sorted(out, key=lambda x: x.y1)


def blocks_of(items: list[Item]) -> tuple[list[float], list[tuple[Line, int | None]]]:
    """Gutters, and blocks in reading order with their column (None: as wide as the page)."""
    rough = lines_of(items)
    height = float(np.mean([x.y2 - x.y1 for x in rough])) or 1.0
    gutters = gutters_of(rough, height)
    if gutters:
        own: list[list[Item]] = [[] for _ in range(len(gutters) + 1)]
        for item in items:
            own[sum((item.x1 + item.x2) / 2 > g for g in gutters)].append(item)
        lines = joined_lines([x for k, column in enumerate(own) for x in lines_of(column, k)], height)
        margin = max(MARGIN[0], MARGIN[1] * height)
        wide = lambda x: len(x.columns) > 1 or any(x.x1 < g - margin and x.x2 > g + margin for g in gutters)
        blocks = [(x, None if wide(x) else min(x.columns)) for x in lines]
    else:
        blocks = []
        for line in rough:
            for part in line.parts(max(GUTTER[0], GUTTER[1] * height)):
                part.y1, part.y2 = line.y1, line.y2
                blocks.append((part, 0))
    blocks.sort(key=lambda b: (b[0].y1, b[0].x1))
    zone, placed = 0, []
    for block, column in blocks:
        zone += column is None  # a wide block closes the zone above it and comes before the next one
        placed.append(((zone, -1 if column is None else column), block, column))
    placed.sort(key=lambda p: p[0])
    return gutters, [(block, column) for _, block, column in placed]


def page_layout(items: DataFrame, page: Sequence[str]) -> DataFrame:
    """items (page keys, x1, x2, y1, y2, text, ord; y grows downward) to one row per block: page keys, place (reading order from 0),
    column (null: as wide as the page), columns, gutters, x1, x2, y1, y2, text, items (their ord, from left to right), n_words. Items without a place do not count; null
    texts are empty; extra columns go. One shuffle by page, which gathers a page's items in an array; then pages go to Python, at most ITEMS items
    of them (or one page) at once."""
    kinds = ", ".join(f"`{k}` {items.schema[k].dataType.simpleString()}" for k in page)
    sides = ("x1", "x2", "y1", "y2")

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, list_sizes(whole.column(len(page))), ITEMS)):
            of, place, column, count, gutters, text, ords = [], [], [], [], [], [], []
            box: list[list] = [[], [], [], []]
            for row, own in enumerate(batch.column(len(page)).to_pylist()):
                cuts, blocks = blocks_of([Item(**item) for item in own])
                of += [row] * len(blocks)
                place += range(len(blocks))
                column += [c for _, c in blocks]
                count += [len(cuts) + 1] * len(blocks)
                gutters += [cuts] * len(blocks)
                text += [b.text() for b, _ in blocks]
                ords += [[i.ord for i in b.items] for b, _ in blocks]
                for k, side in enumerate(sides):
                    box[k] += [getattr(b, side) for b, _ in blocks]
            take = pa.array(of, pa.int64())
            columns = [*(batch.column(k).take(take) for k in range(len(page))), pa.array(place, pa.int32()), pa.array(column, pa.int32()), pa.array(count, pa.int32()), pa.array(gutters, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(b, pa.float64()) for b in box), pa.array(text, pa.string()), pa.array(ords, pa.list_(pa.int64()))], [*page, "place", "column", "columns", "gutters", *sides, "text", "items"])

    item = F.struct(*(F.col(n).cast("double").alias(n) for n in sides), F.coalesce("text", F.lit("")).alias("text"), F.col("ord").cast("long").alias("ord"))
    rows = items.where("x1 is not null and x2 is not null and y1 is not null and y2 is not null").groupBy(*page).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    done = rows.mapInArrow(run, f"{kinds}, place int, column int, columns int, gutters array<double>, x1 double, x2 double, y1 double, y2 double, text string, items array<long>")
    return done.withColumn("n_words", F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")))


def page_texts(items: DataFrame, page: Sequence[str]) -> DataFrame:
    """One row per page: page keys and text, the blocks in reading order, one line each. One more shuffle, of blocks."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda b: b["text"])
    return page_layout(items, page).groupBy(*page).agg(F.array_join(ordered, "\n").alias("text"))


def segmented_layout(items: DataFrame, page: Sequence[str], display: DataFrame | None = None, scale: float = 1.0, shift: float = 0.0) -> DataFrame:
    """One row per block: page keys, place, x, y, width, height, items (their ord), words, n_words, n_chars (of its words), gutters. What the blocks are is decided once, on items; where they are
    drawn follows from `display`, the same items (page keys, ord, x1, x2, y1, y2) as they are seen: a block's box holds those of its items, or is its own where none of them is
    seen. Gutters move by scale and shift. One more shuffle, of the items of blocks, if display is given."""
    blocks = page_layout(items, page).withColumn("words", F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    sides = ("x1", "x2", "y1", "y2")
    if display is not None:
        keys = [*page, "place"]
        seen = display.select(*page, F.col("ord").alias("_item"), *(F.col(n).cast("double").alias(f"_{n}") for n in sides))
        boxes = blocks.select(*keys, F.explode("items").alias("_item")).join(seen, [*page, "_item"]).groupBy(*keys).agg(*((F.min if n.endswith("1") else F.max)(f"_{n}").alias(f"_{n}") for n in sides))
        blocks = blocks.join(boxes, keys, "left").select(*page, "place", *(F.coalesce(f"_{n}", n).alias(n) for n in sides), "items", "words", "gutters")
    size = lambda k: F.greatest(F.lit(0.0), F.col(f"{k}2") - F.col(f"{k}1"))
    return blocks.select(*page, "place", F.col("x1").alias("x"), F.col("y1").alias("y"), size("x").alias("width"), size("y").alias("height"), "items", "words", F.size("words").alias("n_words"),
                         F.length(F.array_join("words", "")).alias("n_chars"), F.transform("gutters", lambda g: g * scale + shift).alias("gutters"))
