"""Lines of a page, reading order of page elements, nested lists, and the series of an append-only entity log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parchment.functions.text import once
from parchment.operators.trees import last_by_id
from parchment.sources.scratch import staged

#: The least tolerance between items of one line, and its share of the mean height.
LEAST_TOLERANCE, SHARE = 4.0, 0.6


def page_lines(items: DataFrame, page: Sequence[str], x1="x1", x2="x2", y1="y1", y2="y2", text="text", ord="ord") -> DataFrame:
    """One row per line: page keys, line (from 0), y1, y2, x1, x2, text. An item opens a line if its top is further than the tolerance from
    the top of the line's first item; ties go by `ord`. One shuffle by page, then a fold over the page's items, inside the JVM. Items
    without a top do not count; null texts are empty."""
    item = F.struct(F.col(y1).cast("double").alias("y1"), F.col(ord).cast("long").alias("ord"), F.col(x1).cast("double").alias("x1"), F.col(x2).cast("double").alias("x2"), F.col(y2).cast("double").alias("y2"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    pages = items.where(F.col(y1).isNotNull()).groupBy(*page).agg(F.sort_array(F.collect_list(item)).alias("_items"), F.avg(F.col(y2) - F.col(y1)).alias("_h"))
    tolerance = F.greatest(F.lit(LEAST_TOLERANCE), F.coalesce("_h", F.lit(0.0)) * SHARE)
    # The fold carries the top of the line's first item and notes for each item the number of its line.
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(-1).alias("n"), F.array().cast("array<int>").alias("line"))

    def step(acc: Column, it: Column) -> Column:
        opens = acc["top"].isNull() | (F.abs(it["y1"] - acc["top"]) > tolerance)
        n = F.when(opens, acc["n"] + 1).otherwise(acc["n"])
        return F.struct(F.when(opens, it["y1"]).otherwise(acc["top"]).alias("top"), n.alias("n"), F.concat(acc["line"], F.array(n)).alias("line"))

    numbered = pages.select(*page, "_items", F.aggregate("_items", start, step)["line"].alias("_line"))
    # Items are exploded within their page and grouped again by page and line: the same partitioning serves both.
    flat = numbered.select(*page, F.explode(F.arrays_zip("_line", "_items")).alias("z")).select(*page, F.col("z._line").alias("line"), F.col("z._items").alias("it"))
    words = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("it.x1", "it.y1", "it.ord", "it.text"))), lambda w: w["text"]), " ")
    return flat.groupBy(*page, "line").agg(F.min("it.y1").alias("y1"), F.max("it.y2").alias("y2"), F.min("it.x1").alias("x1"), F.max("it.x2").alias("x2"), words.alias("text"))


def centre_lines(items: DataFrame, page: Sequence[str]) -> DataFrame:
    """Items (x, y, w, h) of a page as visual lines: page keys, line (from 0, in the order in which lines are opened), x1, x2, y1, y2, n. From the top, and from the left among equals, an item
    joins the first line whose first item's centre is nearer than half the larger of both heights, else opens one. One shuffle by page, then a fold inside the JVM; items without a
    number among the four do not count."""
    names = ("y", "x", "w", "h")
    item = F.struct(*(F.col(n).cast("double").alias(n) for n in names))
    none = F.array().cast("array<struct<c:double,h:double,x1:double,x2:double,y1:double,y2:double,n:int>>")

    def step(lines: Column, i: Column) -> Column:
        centre, right, bottom = i["y"] + i["h"] / 2, i["x"] + i["w"], i["y"] + i["h"]
        fits = F.transform(lines, lambda v: F.abs(v["c"] - centre) < F.greatest(i["h"], v["h"]) * 0.5)
        own = F.struct(centre.alias("c"), i["h"].alias("h"), i["x"].alias("x1"), right.alias("x2"), i["y"].alias("y1"), bottom.alias("y2"), F.lit(1).alias("n"))
        wider = lambda v: F.struct(v["c"].alias("c"), v["h"].alias("h"), F.least(v["x1"], i["x"]).alias("x1"), F.greatest(v["x2"], right).alias("x2"), F.least(v["y1"], i["y"]).alias("y1"), F.greatest(v["y2"], bottom).alias("y2"), (v["n"] + 1).alias("n"))
        return once(F.array_position(fits, F.lit(True)), lambda at: F.when(at == 0, F.concat(lines, F.array(own))).otherwise(F.transform(lines, lambda v, k: F.when(k + 1 == at, wider(v)).otherwise(v))))

    placed = items.where(" and ".join(f"{n} is not null" for n in names)).groupBy(*page).agg(F.sort_array(F.collect_list(item)).alias("_i"))
    lines = placed.select(*page, F.posexplode(F.aggregate("_i", none, step)).alias("line", "_l"))
    return lines.select(*page, "line", *(f"_l.{n}" for n in ("x1", "x2", "y1", "y2", "n")))


def reading_order(elements: DataFrame, page: Sequence[str]) -> DataFrame:
    """Top-level elements with their flow (main by default), its rank by the least reading index, and their place in it; ties by `ord`."""
    top = elements.where("parent_id is null").withColumn("flow", F.coalesce(F.nullif("flow_region_id", F.lit("")), F.lit("main"))).withColumn("_i", F.coalesce("reading_order_index", F.lit(0)))
    flow = Window.partitionBy(*page, "flow")
    top = top.withColumn("_first", F.min("_i").over(flow)).withColumn("_at", F.min("ord").over(flow)).withColumn("place", F.row_number().over(flow.orderBy("_i", "ord")))
    return top.withColumn("flow_rank", F.dense_rank().over(Window.partitionBy(*page).orderBy("_first", "_at"))).drop("_i", "_first", "_at")


def list_tree(elements: DataFrame) -> DataFrame:
    """Elements (id, kind, child_ids) to the items of their nested lists: root (outermost list), item_id, place array<int> (from 0, one
    number per level), depth. A list's items are its children of kind list_item; an item's own list is its first child of kind
    list. Of elements with one id the last by `ord` counts, if they have it. Unknown children do not count; a way that would meet a list again is none. Ways
    upward double in each round, so a thousand nested lists take ten."""
    named = staged(last_by_id(elements, "id", "ord") if "ord" in elements.columns else elements.dropDuplicates(["id"]))
    children = named.select("id", "kind", F.posexplode("child_ids").alias("at", "child"))
    links = children.join(named.select(F.col("id").alias("child"), F.col("kind").alias("child_kind")), "child")
    at = F.row_number().over(Window.partitionBy("id").orderBy("at")) - 1
    own = links.where("kind = 'list' and child_kind = 'list_item'").select(F.col("id").alias("list_id"), F.col("child").alias("item_id"), at.alias("at"))
    nested = links.where("kind = 'list_item' and child_kind = 'list'").groupBy(F.col("id").alias("item_id")).agg(F.min_by("child", "at").alias("list_id"))
    # each item with the way up as far as known: the item above (`up`, null at the outermost list), the list the way begins in, places and lists on the way
    ways = own.join(nested.select("list_id", F.col("item_id").alias("up")), "list_id", "left")
    ways = staged(ways.select("item_id", "up", F.col("list_id").alias("root"), F.array("at").alias("place"), F.array("list_id").alias("met")), "ways")
    while not ways.where("up is not null").isEmpty():
        above = ways.select(F.col("item_id").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("place").alias("_place"), F.col("met").alias("_met"))
        longer = ways.where("up is not null").join(above, "up").where(~F.arrays_overlap("met", "_met"))
        longer = longer.select("item_id", F.col("_up").alias("up"), F.col("_root").alias("root"), F.concat("_place", "place").alias("place"), F.concat("_met", "met").alias("met"))
        ways = staged(ways.where("up is null").unionByName(longer), "ways", instead_of=ways)
    return ways.select("root", "item_id", "place", F.size("place").alias("depth"))


def entity_series(log: DataFrame) -> DataFrame:
    """Readings of a log (id, type, name, domain, parent_schema, trace_name, value, unit, created_at, ord), one row each: domain,
    schema, trace, id, value, unit, created_at, place (by time within schema; bad times last). A schema is the first of its name in any
    case; a reading goes to its own parent, else to that of the first definition of its trace, else has no schema. Names are
    few beside readings, but are joined, not collected."""
    key = lambda c: F.lower(F.trim(c))
    first = lambda c: F.min_by(c, "ord")
    named = log.where("coalesce(name, '') <> ''").withColumn("_k", key(F.col("name")))
    schemas = named.where("type = 'schema'").groupBy("_k").agg(first("name").alias("schema"), first(F.coalesce("domain", F.lit(""))).alias("_d"))
    schemas = schemas.select("_k", "schema", F.coalesce(F.nullif("_d", F.lit("")), F.lit("Unassigned Domain")).alias("domain"))
    traces = named.where("type = 'trace'").groupBy("_k").agg(first(key(F.coalesce("parent_schema", F.lit("")))).alias("_via")).withColumnRenamed("_k", "_t")
    rows = log.where("type in ('trace_value', 'instance', 'intervener') and coalesce(trace_name, '') <> ''")
    rows = rows.select("id", F.col("trace_name").alias("trace"), "value", "unit", "created_at", "ord", key(F.col("trace_name")).alias("_t"), key(F.col("parent_schema")).alias("_own"))
    own = schemas.select(F.col("_k").alias("_own"), F.lit(True).alias("_has"))
    rows = rows.join(traces, "_t", "left").join(own, "_own", "left").withColumn("_k", F.when(F.col("_has"), F.col("_own")).otherwise(F.col("_via")))
    rows = rows.join(schemas, "_k", "left")
    # numbers within days and sums over days: no task sorts all readings of a schema, or all that have none
    kind = dict(rows.dtypes)["created_at"]
    rows = rows.withColumn("_day", F.to_date("created_at") if kind.startswith("timestamp") else F.substring("created_at", 1, 10) if kind == "string" else F.col("created_at"))
    days = rows.groupBy(F.col("schema").alias("_s"), F.col("_day").alias("_e")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_s").orderBy(F.asc_nulls_last("_e")))
    days = days.withColumn("_before", before - F.col("_n")).drop("_n")
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy("schema", "_day").orderBy(F.asc_nulls_last("created_at"), "ord")))
    rows = rows.join(days, rows["schema"].eqNullSafe(days["_s"]) & rows["_day"].eqNullSafe(days["_e"]))
    return rows.withColumn("place", (F.col("_before") + F.col("_in")).cast("int")).select("domain", "schema", "trace", "id", "value", "unit", "created_at", "place")
