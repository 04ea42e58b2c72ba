"""Places in texts: the index of a page, maps between its forms, offsets of items, pages and paragraphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parchment.functions import text as T


def through_segments(places: DataFrame, segments: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Each place with the segment (from_start, from_end, to_start, to_end, in order and apart) that holds it: that with the least end beyond it, which
    in a gap is the next one; beyond all, the last one. One sort of both sides by key instead of a range join. No segments: nulls."""
    seg = F.struct("from_start", "from_end", "to_start", "to_end")
    both = places.withColumn("_s", F.lit(None).cast("struct<from_start:bigint,from_end:bigint,to_start:bigint,to_end:bigint>")).withColumn("_at", F.col(at).cast("long")).withColumn("_side", F.lit(1))
    rows = segments.select(*keys, *(F.col(c).cast("long").alias(c) for c in ("from_start", "from_end", "to_start", "to_end")))
    rows = rows.select(*keys, seg.alias("_s"), F.col("from_end").alias("_at"), F.lit(0).alias("_side"))
    own = Window.partitionBy(*keys)
    # from the end on: a segment that ends at p does not hold p, so places come before segments that end there
    down = own.orderBy(F.desc("_at"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    all_rows = both.unionByName(rows, allowMissingColumns=True)
    found = F.coalesce(F.last("_s", ignorenulls=True).over(down), F.max(F.struct(F.col("_s.from_end"), F.col("_s").alias("s"))).over(own)["s"])
    return all_rows.withColumn("segment", found).where("_side = 1").drop("_s", "_at", "_side")


def mapped_ranges(ranges: DataFrame, segments: DataFrame, keys: Sequence[str], id: str) -> DataFrame:
    """Ranges [start, end) of one space in the other: id, to_start, to_end by the segments of the first and the last character; empty ranges have none."""
    some = ranges.where("start < end")
    ends = some.select(*keys, id, F.explode(F.array(F.struct(F.lit("a").alias("which"), F.col("start").alias("at")), F.struct(F.lit("b").alias("which"), (F.col("end") - 1).alias("at")))).alias("_p")).select(*keys, id, "_p.*")
    found = through_segments(ends, segments, keys, "at").where("segment is not null")
    return found.groupBy(*keys, id).agg(F.min("segment.to_start").alias("to_start"), F.max("segment.to_end").alias("to_end"))


def flow_text(items: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Items (str, has_eol) of a page joined in their order, a new line after the end of a line and a space after others, without white space at the end."""
    piece = F.struct(*order, F.concat("str", F.when(F.coalesce("has_eol", F.lit(False)), "\n").otherwise(" ")).alias("_p"))
    rows = items.where("coalesce(str, '') <> ''").groupBy(*keys).agg(F.sort_array(F.collect_list(piece)).alias("_a"), F.count("*").alias("n_items"))
    return rows.select(*keys, "n_items", F.regexp_replace(F.array_join(F.transform("_a", lambda p: p["_p"]), ""), f"{T.SPACE}+\\z", "").alias("text"))


def item_offsets(items: DataFrame, keys: Sequence[str], block: str, order: Sequence[str]) -> DataFrame:
    """Where each item (str, has_eol) stands in its page's text: start and end. Items of a block follow each other with one sign between; a block that
    does not end a line is followed by one. Two running sums: within blocks, then over blocks."""
    some = items.where("coalesce(str, '') <> ''")
    own = Window.partitionBy(*keys, block).orderBy(*order)
    wide = F.length("str") + 1
    some = some.withColumn("_in", F.coalesce(F.sum(wide).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = F.max_by(F.coalesce("has_eol", F.lit(False)), F.struct(*order))
    blocks = some.groupBy(*keys, block).agg((F.sum(wide) + F.when(last, 0).otherwise(1)).alias("_w"))
    before = F.coalesce(F.sum("_w").over(Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = blocks.withColumn("_shift", before).drop("_w")
    out = some.join(shift, [*keys, block]).withColumn("start", F.col("_in") + F.col("_shift"))
    return out.withColumn("end", F.col("start") + F.length("str")).drop("_in", "_shift")


def page_index(pages: DataFrame, text: str, page: Sequence[str]) -> DataFrame:
    """One row per page: original, normalized, folded and compact text, tokens and sentence chunks, by built-in functions (see text.normalized; where
    other compatibility forms matter, search goes by matching.Folded)."""
    n = T.normalized(F.coalesce(F.col(text), F.lit("")))
    return pages.select(*page, F.coalesce(F.col(text), F.lit("")).alias("original"), n.alias("normalized")).select(
        *page, "original", "normalized", F.lower("normalized").alias("folded"), T.compact(F.regexp_replace("original", T.INVISIBLE, "")).alias("compact"),
        T.tokens(F.col("normalized")).alias("tokens"), F.filter(F.transform(T.sentence_chunks(F.col("normalized")), T.stripped), lambda c: c != "").alias("chunks"))


def marked_pages(text: Column) -> Column:
    """A text parted by lines `=== Page n ===`: array of struct(page, text, start). Without such lines one page, numbered null; nothing for no text."""
    mark = r"(?m)^=== Page (\d+) ===\r?\n?"
    numbers = F.regexp_extract_all(text, F.lit(mark), F.lit(1))
    marks = F.regexp_extract_all(text, F.lit(mark), F.lit(0))
    parts = F.split(text, mark)
    start = F.aggregate(F.sequence(F.lit(1), F.size(marks)), F.array(F.length(F.get(parts, F.lit(0)))), lambda acc, i: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(F.get(marks, i - 1)) + F.length(F.get(parts, i)))))
    # start[i - 1] is the end of part i - 1; a part begins after its mark
    found = F.transform(F.sequence(F.lit(1), F.greatest(F.size(marks), F.lit(1))), lambda i: F.struct(F.get(numbers, i - 1).cast("long").alias("page"), F.get(parts, i).alias("text"), (F.get(start, i - 1) + F.length(F.get(marks, i - 1))).cast("long").alias("start")))
    whole = F.array(F.struct(F.lit(None).cast("long").alias("page"), text.alias("text"), F.lit(0).cast("long").alias("start")))
    return F.when(F.size(numbers) > 0, found).when(F.coalesce(text, F.lit("")) != "", whole).otherwise(F.array().cast("array<struct<page:bigint,text:string,start:bigint>>"))


def paragraph_lines(docs: DataFrame, key: str, text: str, start: int = 0, end: int = 0) -> DataFrame:
    """Paragraphs (between runs of blank lines) and their lines with offsets: key, paragraph, line, begins (two signs between paragraphs, one between lines),
    and the part [mark_from, mark_to) of each line that a range [start, end) marks; null where it does not."""
    parts = docs.select(key, F.posexplode(F.split(F.col(text), r"\n{2,}")).alias("paragraph", "_p"))
    own = Window.partitionBy(key).orderBy("paragraph").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_at", F.coalesce(F.sum(F.length("_p") + 2).over(own), F.lit(0)))
    lines = parts.select(key, "paragraph", "_at", F.posexplode(F.split("_p", "\n")).alias("line", "_l"))
    inner = Window.partitionBy(key, "paragraph").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("begins", F.col("_at") + F.coalesce(F.sum(F.length("_l") + 1).over(inner), F.lit(0)))
    hit = (F.lit(end) > F.col("begins")) & (F.lit(start) < F.col("begins") + F.length("_l"))
    return lines.select(key, "paragraph", "line", "begins", F.when(hit, F.greatest(F.lit(0), start - F.col("begins"))).alias("mark_from"), F.when(hit, F.least(F.length("_l").cast("long"), end - F.col("begins"))).alias("mark_to"))


def paragraphs_of_lines(lines: DataFrame, keys: Sequence[str], order: str, text: str, breaks: Column) -> DataFrame:
    """Lines put together to paragraphs, parted by blank lines and page breaks: keys, paragraph (from 1), text with line breaks."""
    blank = F.coalesce(T.stripped(F.col(text)), F.lit("")) == ""
    rows = lines.withColumn("_stop", blank | breaks)
    rows = rows.withColumn("_g", F.sum(F.col("_stop").cast("int")).over(Window.partitionBy(*keys).orderBy(order)))
    rows = rows.where("not _stop").groupBy(*keys, "_g").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda r: r[text]), "<br />").alias("text"))
    return rows.withColumn("paragraph", F.row_number().over(Window.partitionBy(*keys).orderBy("_g"))).drop("_g")


def first_enough(hits: DataFrame, page: str, most: int, order: Sequence[Column]) -> DataFrame:
    """Hits as a reader of pages finds them who stops after the page with which `most` hits are reached: of the pages up to that one, the first `most` in
    `order`. As every page counted has a hit, it is among the first `most` such pages, which one top-k finds; only these are summed."""
    counts = hits.groupBy(page).agg(F.count("*").alias("_n")).orderBy(page).limit(most)
    before = F.coalesce(F.sum("_n").over(Window.orderBy(page).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    read = counts.withColumn("_before", before).where(F.col("_before") < most).select(page)
    return hits.join(F.broadcast(read), page, "left_semi").orderBy(*order).limit(most)


def without_overlaps(hits: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of the hits (confidence, start, end) of a page the surest that do not overlap: by falling confidence, of equals in `order`, each is kept unless it
    meets one kept before. A fold over the page's hits inside the JVM."""
    hit = F.struct((-F.col("confidence")).alias("_c"), *order, "confidence", "start", "end")
    pages = hits.groupBy(*keys).agg(F.sort_array(F.collect_list(hit)).alias("_h"))
    none = F.slice("_h", 1, 0)
    step = lambda kept, h: F.when(F.exists(kept, lambda k: (h["start"] < k["end"]) & (h["end"] > k["start"])), kept).otherwise(F.concat(kept, F.array(h)))
    return pages.select(*keys, F.explode(F.aggregate("_h", none, step)).alias("_k")).select(*keys, "_k.confidence", "_k.start", "_k.end")


def sampled_density(pages: DataFrame, keys: Sequence[str], page: str, chars: str, most: int = 10) -> DataFrame:
    """How much text the pages (numbered from 1) of each document hold, by every n-th of them, at most `most`: chars_per_page and kind. That sample is the
    rule itself."""
    w = Window.partitionBy(*keys)
    rows = pages.withColumn("_all", F.max(page).over(w))
    count = F.least(F.lit(most), F.col("_all"))
    step = F.greatest(F.lit(1), F.floor(F.col("_all") / count))
    rows = rows.where(((F.col(page) - 1) % step == 0) & ((F.col(page) - 1) / step < count))
    out = rows.groupBy(*keys).agg(F.avg(chars).alias("chars_per_page"))
    return out.withColumn("kind", F.when(F.col("chars_per_page") < 50, "scanned").when(F.col("chars_per_page") < 300, "mixed").otherwise("text-based"))
