"""Boxes, points and strokes of a page: hits, overlaps, the nearest row, erasing, and rectangles for highlights."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from parchment.functions.geometry import affine_product, clamp, length, segment_distance

#: Kinds of shapes by how they are hit, the share of the radius that counts in precise mode, and the shape of a
#: highlight: its least width, and where it stands by the size of the letters.
LINES, PENS = ("line", "arrow"), ("pen", "highlight", "freeshape")
FRAMES = ("rect", "circle", "underline", "strikethrough", "drawTextSelection", "smartVideoCapture")
PRECISE = 0.45
LEAST_WIDTH, ASCENT, HEIGHT = 2.0, 0.85, 1.05
ITEM_ASCENT, ITEM_DESCENT = 0.8, 0.2
#: How many cells of a grid wide a square is in which points and strokes meet, and how many pairs of them are compared at once.
BLOCK, PAIRS = 8, 1 << 18
#: Boxes of a key that are summed up in one group, and into how many columns and rows at most the boxes of a larger key are dealt.
GROUP, BANDS = 1 << 20, 512


def intersect(a: Column, b: Column) -> Column:
    """Whether boxes (x, y, w, h) share more than an edge."""
    return (a["x"] < b["x"] + b["w"]) & (a["x"] + a["w"] > b["x"]) & (a["y"] < b["y"] + b["h"]) & (a["y"] + a["h"] > b["y"])


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def dealt(rows: DataFrame, box: str, size: float) -> DataFrame:
    """Rows once for each square of a grid that their box touches: _cx, _cy."""
    b = F.col(box)
    return rows.withColumn("_cx", F.explode(_cells(b["x"], b["x"] + b["w"], size))).withColumn("_cy", F.explode(_cells(b["y"], b["y"] + b["h"], size)))


def box_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], a_box: str, b_box: str, size: float) -> DataFrame:
    """Pairs of rows of a key whose boxes share more than an edge: an equi-join on squares of a grid. A pair is kept in the square
    of its common part's corner, so it comes once."""
    hit = dealt(a, a_box, size).join(dealt(b, b_box, size), [*keys, "_cx", "_cy"]).where(intersect(F.col(a_box), F.col(b_box)))
    corner = lambda axis: F.floor(F.greatest(F.col(f"{a_box}.{axis}"), F.col(f"{b_box}.{axis}")) / size)
    return hit.where((corner("x") == F.col("_cx")) & (corner("y") == F.col("_cy"))).drop("_cx", "_cy")


def sums_below(u: np.ndarray, v: np.ndarray, weights: list[np.ndarray], x: np.ndarray, y: np.ndarray, sides: tuple[str, str] = ("left", "left")) -> np.ndarray:
    """For each (x, y) how many points (u, v) lie below it on both axes, and the sums of their weights; "right": or level with it. A wavelet matrix over the ranks of v
    of the points by u: (points + questions) times the bits of a rank, whatever the number of pairs."""
    order = np.argsort(u, kind="stable")
    far = np.searchsorted(u[order], x, sides[0])
    level = np.sort(v)
    bound = np.searchsorted(level, y, sides[1])
    rank = np.searchsorted(level, v)[order]
    weights = [w[order] for w in weights]
    near = np.zeros_like(far)
    out = np.zeros((1 + len(weights), len(x)), np.int64)
    for bit in reversed(range(len(u).bit_length())):
        high = (rank >> bit & 1).astype(bool)
        low = np.r_[0, np.cumsum(~high)]
        a, b, up = low[near], low[far], (bound >> bit & 1).astype(bool)
        split = np.r_[np.flatnonzero(~high), np.flatnonzero(high)]
        rank, weights = rank[split], [w[split] for w in weights]
        out[0] += np.where(up, b - a, 0)
        for total, w in zip(out[1:], weights):
            along = np.r_[0, np.cumsum(w)]
            total += np.where(up, along[b] - along[a], 0)
        near, far = np.where(up, low[-1] + near - a, a), np.where(up, low[-1] + far - b, b)
    return out


def box_sums(a: DataFrame, b: DataFrame, keys: Sequence[str], a_box: str, b_box: str, id: str, values: dict[str, Column], size: float, group: int = GROUP) -> DataFrame:
    """What box_pairs(a, b) gives summed up by b's `id`, without the pairs: id, n, and the sums of the `values` of a (whole numbers). A box of a meets one of b if
    it begins before that ends and does not end before that begins, so on each axis those that begin before, less those that end before. Both axes make four sums
    over the points below one. Keys of up to `group` rows are a group each. Of larger ones the axes are cut at quantiles; what lies in the column of a point, and
    what lies in its row in the columns before, is summed in groups of one column or row, all before both from counts of cells. A value at a cut has a column of its own, in
    which nothing is below another, so equal values make no large group. Boxes of a that end before they begin and those of b without extent are joined in pairs."""
    names, ends, high = list(values), ("_xl", "_xr", "_yl", "_yr"), ("_xr", "_yr")
    left = {"_xl": "left", "_yl": "left", "_xr": "right", "_yr": "right"}
    total = [f"_s{k}" for k in range(1 + len(names))]

    def corners(box: str, order: Sequence[int]) -> list[Column]:
        c = F.col(box)
        at = (c["x"], c["x"] + c["w"], c["y"], c["y"] + c["h"])
        return [at[k].cast("double").alias(n) for k, n in zip(order, ends)]

    kind = b.schema[id].dataType
    own = [F.coalesce(v.cast("long"), F.lit(0)).alias(n) for v, n in zip(values.values(), total[1:])]
    boxes = a.select(*keys, *corners(a_box, (0, 1, 2, 3)), F.lit(False).alias("_b"), F.lit(None).cast(kind).alias("_id"), *own)
    frames = b.select(*keys, *corners(b_box, (1, 0, 3, 2)), F.lit(True).alias("_b"), F.col(id).alias("_id"), *(F.lit(0).cast("long").alias(n) for n in total[1:]))
    rows = boxes.unionAll(frames).where(reduce(lambda p, q: p & q, (F.col(n).isNotNull() for n in (*keys, *ends))))
    plain = F.when(F.col("_b"), (F.col("_xl") > F.col("_xr")) & (F.col("_yl") > F.col("_yr"))).otherwise((F.col("_xl") <= F.col("_xr")) & (F.col("_yl") <= F.col("_yr")))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(~plain).alias("_odd"))
    most, odd = sizes.agg(F.max("_n"), F.max("_odd")).first()
    some, sums = rows.where(plain) if odd else rows, StructType([StructField("_id", kind), *(StructField(n, LongType()) for n in total)])

    def summed(p: pa.Table, q: pa.Table, corner: tuple[str, str], of: tuple[str, str] | None = None) -> np.ndarray:
        sign = 1 if (corner[0] == "_xl") == (corner[1] == "_yl") else -1
        u, v = of or corner
        numbers = lambda t, n: t[n].to_numpy()
        return sign * sums_below(numbers(p, u), numbers(p, v), [numbers(p, n) for n in total[1:]], numbers(q, u), numbers(q, v), ("left" if of else left[u], left[v]))

    def run(t: pa.Table) -> pa.Table:
        side = t["_side"][0].as_py() if "_side" in t.schema.names else ""
        p, q = t.filter(pc.invert(t["_b"])), t.filter(t["_b"])
        found = [summed(p, q, (x, y), (f"_c{x}", y) if side in ("_yl", "_yr") else None) for x in ("_xl", "_xr") for y in ("_yl", "_yr") if side in ("", x, y)]
        return pa.table([q["_id"], *map(pa.array, sum(found))], ["_id", *total])

    if (most or 0) <= group:
        found = some.groupBy(*keys).applyInArrow(run, sums)
    else:
        large = F.broadcast(sizes.where(F.col("_n") > group).select(*keys))
        bands = min(BANDS, -(-2 * most // group))
        cuts = some.join(large, list(keys)).groupBy(*keys).agg(*(F.array_distinct(F.percentile_approx(n, [k / bands for k in range(1, bands)], 10_000)).alias(f"_q{n}") for n in ends))
        place = lambda n: F.when(F.col("_b") & F.lit(n in high), 2 * F.size(F.filter(f"_q{n}", lambda c: c <= F.col(n)))).otherwise(2 * F.size(F.filter(f"_q{n}", lambda c: c < F.col(n))) + F.array_contains(f"_q{n}", F.col(n)).cast("int"))
        dealt_out = some.join(cuts, list(keys)).withColumns({f"_c{n}": place(n) for n in ends}).drop(*(f"_q{n}" for n in ends))
        parts = F.array(*(F.struct(F.lit(n).alias("_side"), F.col(f"_c{n}").alias("_part")) for n in ends))
        within = dealt_out.withColumn("_to", F.explode(F.filter(parts, lambda s: s["_part"] % 2 == 0))).select("*", "_to.*").drop("_to")
        pair = F.explode(F.array(*(F.struct(F.lit(x).alias("_x"), F.lit(y).alias("_y"), F.col(f"_c{x}").alias("_u"), F.col(f"_c{y}").alias("_v")) for x in ("_xl", "_xr") for y in ("_yl", "_yr"))))
        corner = dealt_out.select(*keys, "_b", "_id", *total[1:], pair.alias("_to")).select("*", "_to.*").drop("_to")
        cell = [*keys, "_x", "_y", "_u", "_v"]
        cells = corner.groupBy(*cell, "_b").agg(F.count("*").alias(total[0]), *(F.sum(n).alias(n) for n in total[1:]))

        def before(t: pa.Table) -> pa.Table:
            p, q = t.filter(pc.invert(t["_b"])), t.filter(t["_b"])
            numbers = lambda t, n: t[n].to_numpy()
            sign = 1 if (t["_x"][0].as_py() == "_xl") == (t["_y"][0].as_py() == "_yl") else -1
            got = sign * sums_below(numbers(p, "_u"), numbers(p, "_v"), [numbers(p, n) for n in total], numbers(q, "_u"), numbers(q, "_v"))[1:]
            return pa.table([*(q[n] for n in cell), *map(pa.array, got)], [*cell, *total])

        counted = cells.groupBy(*keys, "_x", "_y").applyInArrow(before, StructType([*(cells.schema[n] for n in cell), *(StructField(n, LongType()) for n in total)]))
        found = some.join(large, list(keys), "left_anti").groupBy(*keys).applyInArrow(run, sums)
        found = found.unionByName(within.groupBy(*keys, "_side", "_part").applyInArrow(run, sums))
        found = found.unionByName(corner.where("_b").select(*cell, "_id").join(counted, cell).select("_id", *total))
    if odd:
        ends_before = lambda c, strict: (c["x"] + c["w"] < c["x"]) | (c["y"] + c["h"] < c["y"]) if strict else (c["x"] + c["w"] <= c["x"]) | (c["y"] + c["h"] <= c["y"])
        of_a, of_b = a.select(*keys, a_box, *own), b.select(*keys, b_box, F.col(id).alias("_id"))
        flat, turned = ends_before(F.col(b_box), False), ends_before(F.col(a_box), True)
        pairs = box_pairs(of_a, of_b.where(flat), keys, a_box, b_box, size).unionByName(box_pairs(of_a.where(turned), of_b.where(~flat), keys, a_box, b_box, size))
        found = found.unionByName(pairs.select("_id", F.lit(1).cast("long").alias(total[0]), *total[1:]))
    out = found.groupBy("_id").agg(*(F.sum(n).alias(n) for n in total)).where(F.col(total[0]) > 0)
    return out.select(F.col("_id").alias(id), F.col(total[0]).alias("n"), *(F.col(t).alias(n) for t, n in zip(total[1:], names)))


def topmost_box(points: DataFrame, boxes: DataFrame, keys: Sequence[str], point: Sequence[str], box: str, z: str, id: str, size: float, into: str = "hit") -> DataFrame:
    """Each point with the id of the topmost box (largest z) that holds it, edges included; null if none does. points: a column `point_id`."""
    x, y = map(F.col, point)
    at = points.withColumn("_cx", F.floor(x / size)).withColumn("_cy", F.floor(y / size))
    b = F.col(box)
    hit = at.join(dealt(boxes.select(*keys, box, z, id), box, size), [*keys, "_cx", "_cy"]).where((x >= b["x"]) & (x <= b["x"] + b["w"]) & (y >= b["y"]) & (y <= b["y"] + b["h"]))
    best = hit.groupBy(*keys, "point_id").agg(F.max_by(id, z).alias(into))
    return points.join(best, [*keys, "point_id"], "left")


def stroke_distance(points: Column, x: Column, y: Column) -> Column:
    """From a point to a stroke of points (x, y), two at least; null for fewer."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(points) - 2), lambda i: segment_distance(x, y, F.get(points, i)["x"], F.get(points, i)["y"], F.get(points, i + 1)["x"], F.get(points, i + 1)["y"]))
    return F.when(F.size(points) > 1, F.array_min(pairs))


def dealt_segments(strokes: DataFrame, stroke: str, radius: Column, size: float) -> DataFrame:
    """The segments (ax, ay, bx, by) of strokes, each once for every square of a grid that it passes within `radius` or nearly so: _cx, _cy. Column by column of the grid:
    a segment goes to the squares of the part of it that lies over the column, not to all of its box."""
    p = F.col(stroke)
    ends = F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: F.struct(F.get(p, i)["x"].alias("ax"), F.get(p, i)["y"].alias("ay"), F.get(p, i + 1)["x"].alias("bx"), F.get(p, i + 1)["y"].alias("by")))
    rows = strokes.where(F.size(p) > 1).withColumn("_r", radius).withColumn("_s", F.explode(ends)).drop(stroke)
    rows = rows.select("*", *(F.col(f"_s.{n}").cast("double").alias(n) for n in ("ax", "ay", "bx", "by"))).drop("_s")
    rows = rows.withColumn("_cx", F.explode(_cells(F.least("ax", "bx") - F.col("_r"), F.greatest("ax", "bx") + F.col("_r"), size)))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    at = lambda edge: F.when(dx == 0, None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (edge - F.col("ax")) / F.nullif(dx, F.lit(0.0)))))
    near, far = (F.col("ay") + F.coalesce(at(edge), F.lit(t)) * dy for edge, t in ((F.col("_cx") * size - F.col("_r"), 0.0), ((F.col("_cx") + 1) * size + F.col("_r"), 1.0)))
    return rows.withColumn("_cy", F.explode(_cells(F.least(near, far) - F.col("_r"), F.greatest(near, far) + F.col("_r"), size)))


def first_near(px: np.ndarray, py: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each point the place of the first segment within its radius, -1 if there is none. A stretch of segments at a time, for the points that no earlier one hits."""
    out = np.full(len(px), -1)
    left, at = np.arange(len(px)), 0
    while len(left) and at < len(ax):
        to = at + max(1, PAIRS // len(left))
        x, y, dx, dy = ax[at:to], ay[at:to], bx[at:to] - ax[at:to], by[at:to] - ay[at:to]
        square = dx * dx + dy * dy
        u, v = px[left, None], py[left, None]
        t = np.clip(((u - x) * dx + (v - y) * dy) / np.where(square == 0, 1.0, square), 0.0, 1.0)
        ex, ey = u - (x + t * dx), v - (y + t * dy)
        near = np.sqrt(ex * ex + ey * ey) <= radius[at:to]
        hit = near.any(axis=1)
        out[left[hit]] = at + near[hit].argmax(axis=1)
        left, at = left[~hit], to
    return out


def topmost_stroke(points: DataFrame, strokes: DataFrame, keys: Sequence[str], point: Sequence[str], stroke: str, z: str, id: str, radius: Column, size: float, into: str = "hit") -> DataFrame:
    """Each point with the id of the topmost stroke within `radius` (a column of strokes, or a number); null if there is none. Points and segments meet in squares of BLOCK by BLOCK
    cells of a grid, a segment once in each that it passes; there the segments are tried from the topmost down, each for the points that none above it hits."""
    x, y = map(F.col, point)
    wide, own = size * BLOCK, points.columns
    at = points.withColumns({"_px": x.cast("double"), "_py": y.cast("double"), "_cx": F.floor(x / wide), "_cy": F.floor(y / wide)})
    drawn = strokes.where(reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in [*keys, z])))
    segments = dealt_segments(drawn.select(*keys, F.col(stroke), F.col(z).alias("_z"), F.col(id).alias("_id")), stroke, radius, wide)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, [("_z", "descending")]))
        numbers = lambda t, names: (t[n].to_numpy().astype(float) for n in names)
        hit = first_near(*numbers(left, ("_px", "_py")), *numbers(right, ("ax", "ay", "bx", "by", "_r")))
        ids = right["_id"].take(pa.array(hit, mask=hit < 0)) if right.num_rows else pa.nulls(left.num_rows, right.schema.field("_id").type)
        return left.select(own).append_column(into, ids)

    square = [*keys, "_cx", "_cy"]
    done = StructType([*points.schema.fields, StructField(into, strokes.schema[id].dataType)])
    return at.groupBy(*square).cogroup(segments.groupBy(*square)).applyInArrow(run, done)


def spans_under(strokes: DataFrame, spans: DataFrame, keys: Sequence[str], points: str, box: str, size: float = 256.0) -> DataFrame:
    """Pairs of a stroke and a span of text that it marks: their ranges of x overlap, and the span's middle lies within the stroke's range of y
    widened by half the span's height, that is, their ranges of y touch. Both are dealt to squares of a grid; a pair is kept in that of its common corner."""
    p, b, e = F.col(points), F.col(box), F.col("_e")
    edge = lambda f, k: f(F.transform(p, lambda q: q[k]))
    extent = F.struct(*(edge(F.array_min, k).alias(k) for k in "xy"), *((edge(F.array_max, k) - edge(F.array_min, k)).alias(n) for k, n in (("x", "w"), ("y", "h"))))
    ink = dealt(strokes.where(F.size(p) > 0).withColumn("_e", extent), "_e", size)
    pairs = ink.join(dealt(spans.where(F.trim("text") != ""), box, size), [*keys, "_cx", "_cy"])
    corner = lambda k: F.floor(F.greatest(e[k], b[k]) / size)
    mid = b["y"] + b["h"] / 2
    pairs = pairs.where((corner("x") == F.col("_cx")) & (corner("y") == F.col("_cy")))
    return pairs.where((b["x"] + b["w"] > e["x"]) & (b["x"] < e["x"] + e["w"]) & (mid >= e["y"] - b["h"] / 2) & (mid <= e["y"] + e["h"] + b["h"] / 2)).drop("_cx", "_cy", "_e")


def nearest_row(points: DataFrame, spans: DataFrame, keys: Sequence[str], y: str, row: str, box: str, ord: str) -> DataFrame:
    """Each point (point_id) with the row of text whose middle is nearest; of equally near ones the first to appear. A page's rows are one array
    beside each of its points."""
    b = F.col(box)
    rows = spans.where(F.col(row).isNotNull()).groupBy(*keys, row).agg(F.min(b["y"]).alias("top"), F.max(b["y"] + b["h"]).alias("bottom"), F.min(ord).alias("first"))
    pages = rows.groupBy(*keys).agg(F.collect_list(F.struct(((F.col("top") + F.col("bottom")) / 2).alias("mid"), "first", F.col(row).alias("row"))).alias("_rows"))
    ranked = F.array_min(F.transform("_rows", lambda r: F.struct(F.abs(r["mid"] - F.col(y)).alias("d"), r["first"].alias("first"), r["row"].alias("row"))))
    return points.join(pages, list(keys), "left").withColumn(row, ranked["row"]).drop("_rows")


def hit_by(shape: Column, x: Column, y: Column, radius: Column) -> Column:
    """Whether a shape (type, points, x, y, w, h, x1, y1, x2, y2) lies within radius of a point: pens by their points and segments, lines by their
    segment, frames by their box, others by their place. Missing numbers are 0."""
    n = lambda k: F.coalesce(shape[k], F.lit(0.0))
    points = shape["points"]
    pen = F.exists(points, lambda p: length(p["x"] - x, p["y"] - y) <= radius) | F.coalesce(stroke_distance(points, x, y) <= radius, F.lit(False))
    line = segment_distance(x, y, n("x1"), n("y1"), n("x2"), n("y2")) <= radius
    right, bottom = n("x") + n("w"), n("y") + n("h")
    to = lambda v, a, b: F.least(F.greatest(v, F.least(a, b)), F.greatest(a, b))
    frame = length(to(x, n("x"), right) - x, to(y, n("y"), bottom) - y) <= radius
    place = length(F.coalesce(shape["x"], shape["x1"], F.lit(0.0)) - x, F.coalesce(shape["y"], shape["y1"], F.lit(0.0)) - y) <= radius
    kind = shape["type"]
    return F.when(kind.isin(*PENS) & points.isNotNull(), pen).when(kind.isin(*LINES), line).when(kind.isin(*FRAMES), frame).otherwise(place)


def untouched_points(points: Column, x: Column, y: Column, radius: Column) -> Column:
    """Points that are not within radius, nor are the segments to the one before and the one after."""

    def keep(p: Column, i: Column) -> Column:
        before, after = F.get(points, i - 1), F.get(points, i + 1)
        near = lambda a, b: F.coalesce(segment_distance(x, y, a["x"], a["y"], b["x"], b["y"]) <= radius, F.lit(False))
        return ~((length(p["x"] - x, p["y"] - y) <= radius) | near(before, p) | near(p, after))

    return F.filter(points, keep)


def erased(shapes: DataFrame, shape: str, x: Column, y: Column, radius: Column, precise: bool = False) -> DataFrame:
    """shapes with `erased`, whether the eraser takes them; in precise mode pens lose points instead, and go with fewer than two left."""
    s = F.col(shape)
    if not precise:
        return shapes.withColumn("erased", hit_by(s, x, y, radius))
    pen, left = s["type"].isin(*PENS) & s["points"].isNotNull(), untouched_points(s["points"], x, y, radius * PRECISE)
    out = shapes.withColumn("erased", F.when(pen, F.size(left) < 2).otherwise(hit_by(s, x, y, radius * PRECISE)))
    return out.withColumn(shape, F.when(pen, s.withField("points", left)).otherwise(s))


def kept_runs(points: Column, x: Column, y: Column, radius: Column) -> Column:
    """What is left of a stroke: runs of two or more points in a row further than radius away; the whole stroke if no point is nearer."""
    far = lambda p: length(p["x"] - x, p["y"] - y) > radius
    none = F.array().cast("array<struct<x:double,y:double>>")
    start = F.struct(F.array().cast("array<array<struct<x:double,y:double>>>").alias("runs"), none.alias("open"))
    close = lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["runs"], F.array(acc["open"]))).otherwise(acc["runs"])
    step = lambda acc, p: F.when(far(p), F.struct(acc["runs"].alias("runs"), F.concat(acc["open"], F.array(p)).alias("open"))).otherwise(F.struct(close(acc).alias("runs"), none.alias("open")))
    runs = F.aggregate(points, start, step, close)
    return F.when(F.forall(points, far), F.array(points)).otherwise(F.filter(runs, lambda r: F.size(r) >= 2))


def union_box(boxes: DataFrame, keys: Sequence[str], box: str) -> DataFrame:
    """The least box around all of a key."""
    b = F.col(box)
    return boxes.groupBy(*keys).agg(F.min(b["x"]).alias("x1"), F.min(b["y"]).alias("y1"), F.max(b["x"] + b["w"]).alias("x2"), F.max(b["y"] + b["h"]).alias("y2"))


def spatial_items(items: DataFrame, view: Column | None = None) -> DataFrame:
    """Fragments of text (str, width, has_eol, transform array of 6) with their boxes x1, x2, y1, y2 and font_size: in the page's own space, y down, or
    as a view shows them. Empty ones and those smaller than a point go."""
    m = F.col("transform") if view is None else affine_product(view, F.col("transform"))
    scale = F.lit(1.0) if view is None else F.hypot(view[0], view[1])
    out = items.where("coalesce(str, '') <> ''").withColumn("_m", m).withColumn("font_size", F.hypot(F.col("_m")[0], F.col("_m")[1])).where("font_size >= 1")
    y = -F.col("_m")[5] if view is None else F.col("_m")[5]
    out = out.withColumn("x1", F.col("_m")[4]).withColumn("x2", F.col("_m")[4] + F.col("width") * scale)
    return out.withColumn("y1", y - F.col("font_size") * ITEM_ASCENT).withColumn("y2", y + F.col("font_size") * ITEM_DESCENT).drop("_m")


def highlight_rects(wanted: DataFrame, items: DataFrame, keys: Sequence[str], view: Column) -> DataFrame:
    """Rectangles over items (item_index) of a page: left, top, width, height as the view shows them. wanted: with local_start, local_end and item_length
    where only a part of the item is meant (null: all of it; of several parts of an item the last by `ord`)."""
    last = wanted.groupBy(*keys, "item_index").agg(F.max_by(F.struct("local_start", "local_end", "item_length"), "ord").alias("part"), F.count("*").alias("_n"))
    both = last.join(items, [*keys, "item_index"]).withColumn("_m", affine_product(view, F.col("transform"))).withColumn("_size", F.hypot(F.col("_m")[0], F.col("_m")[1])).where("_size >= 1")
    some = F.col("part.item_length") > 0
    begin = F.when(some, F.col("part.local_start") / F.col("part.item_length")).otherwise(0.0)
    end = F.when(some, F.col("part.local_end") / F.col("part.item_length")).otherwise(1.0)
    width = F.col("width") * F.hypot(view[0], view[1])
    return both.select(*keys, "item_index", (F.col("_m")[4] + begin * width).alias("left"), (F.col("_m")[5] - F.col("_size") * ASCENT).alias("top"), F.greatest(F.lit(LEAST_WIDTH), (end - begin) * width).alias("width"), (F.col("_size") * HEIGHT).alias("height"))


def marker_place(box: Column, canvas: Column, size: Column, gap: Column) -> Column:
    """Where a line's number stands: right of its box, within the canvas; null for a box without extent."""
    x = F.least(box["x"] + box["w"] + gap, F.greatest(F.lit(0.0), canvas - size - 2))
    return F.when((box["w"] > 0) & (box["h"] > 0), F.struct(x.alias("x"), (box["y"] + box["h"] / 2 - size / 2).alias("y")))


def cover_crop(width: Column, height: Column, to_width: Column, to_height: Column) -> Column:
    """The middle part of an image that fills a frame; null where a size is missing or 0."""
    wide = width / height > to_width / to_height
    w, h = F.when(wide, height * (to_width / to_height)).otherwise(width), F.when(wide, height).otherwise(width / (to_width / to_height))
    crop = F.struct(((width - w) / 2).alias("x"), ((height - h) / 2).alias("y"), w.alias("width"), h.alias("height"))
    return F.when((width > 0) & (height > 0) & (to_width > 0) & (to_height > 0), crop)


def to_world(x: Column, y: Column, left: Column, top: Column, tx: Column, ty: Column, scale: Column) -> Column:
    """A point of the screen on the board: without the canvas' place and the pan, by the zoom."""
    return F.struct(((x - left - tx) / scale).alias("x"), ((y - top - ty) / scale).alias("y"))


def zoom_gain(gain: Column, zoom: Column) -> Column:
    return gain / (1 + 4 * F.abs(F.ln(zoom)))


def point_distance(a: Column, b: Column) -> Column:
    """Between two points; 0 where one is missing."""
    return F.coalesce(F.hypot(a["x"] - b["x"], a["y"] - b["y"]), F.lit(0.0))


def level_bounds(levels: DataFrame, keys: Sequence[str], order: str, weight: str) -> DataFrame:
    """Where each level begins, as a share of all weights (0.1 at least each)."""
    w = F.greatest(F.lit(0.1), F.col(weight))
    own = Window.partitionBy(*keys)
    before = F.coalesce(F.sum(w).over(own.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return levels.withColumn("begins", before / F.sum(w).over(own))


def active_level(progress: DataFrame, bounds: DataFrame, keys: Sequence[str], at: str, level: str) -> DataFrame:
    """The last level that begins at or (to a ten-thousandth) just after each place; the first one else. A key's levels are one array."""
    arrays = bounds.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(level, "begins"))).alias("_b"))
    reached = F.filter("_b", lambda b: F.col(at) >= b["begins"] - 0.0001)
    return progress.join(arrays, list(keys)).withColumn(level, F.coalesce(F.array_max(F.transform(reached, lambda b: b[level])), F.get("_b", F.lit(0))[level])).drop("_b")
