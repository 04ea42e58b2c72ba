"""Trees of page elements and of terms: forests from lists of children, ancestors and descendants, visible terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parchment.sources.scratch import staged


def last_by_id(elements: DataFrame, id: str, order: str) -> DataFrame:
    """One row per id: of several the last in order."""
    return elements.withColumn("_n", F.row_number().over(Window.partitionBy(id).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def walked(roots: DataFrame, links: DataFrame) -> DataFrame:
    """All ways down from roots (id): root, id, path (ids from the root on), place (numbers among siblings), depth from 0. links(id, child, at). One join
    per level, each level a written table, however deep; a way ends before an id it has met."""
    level = staged(roots.select(F.col("id").alias("root"), "id", F.array("id").alias("path"), F.array().cast("array<int>").alias("place")))
    levels = []
    links = links.select(F.col("id").alias("_from"), "child", F.col("at").cast("int").alias("at"))
    while not level.isEmpty():
        levels.append(level)
        down = level.join(links, level["id"] == links["_from"]).where(~F.array_contains("path", F.col("child")))
        level = staged(down.select("root", F.col("child").alias("id"), F.concat("path", F.array("child")).alias("path"), F.concat("place", F.array("at")).alias("place")))
    out = level
    for rows in levels:
        out = out.unionByName(rows)
    return out.withColumn("depth", F.size("path") - 1)


def forest(elements: DataFrame, id: str = "id", child_ids: str = "child_ids", parent: str = "parent_id", order: str = "ord") -> DataFrame:
    """Elements that have no parent, and all below them, as walked() gives them. Children are named by lists of ids; unknown ones do not count, and of
    elements with one id the last counts."""
    known = staged(last_by_id(elements, id, order).select(F.col(id).alias("id"), F.col(child_ids).alias("_c"), F.col(parent).alias("_p")))
    links = known.select("id", F.posexplode("_c").alias("at", "child")).join(known.select(F.col("id").alias("child")), "child", "left_semi")
    return walked(known.where("_p is null").select("id"), links)


def ancestors(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """Transitive closure (node, ancestor, depth) by doubling: the ways of up to 2 n steps are those of up to n and any two of them in a row. It holds every pair, half the square of a
    chain's length, so it is for those who ask for all pairs; what lies above some nodes is marked by reached(). Of several ways the shortest counts; a cycle ends where nothing
    new is found."""
    known = edges.where(F.col(parent).isNotNull()).groupBy(F.col(child).alias("node"), F.col(parent).alias("ancestor")).agg(F.lit(1).alias("depth"))
    known, before = staged(known), -1
    total = known.count()
    while total != before:
        far = known.join(known.select(F.col("node").alias("_mid"), F.col("ancestor").alias("_far"), F.col("depth").alias("_d")), F.col("ancestor") == F.col("_mid"))
        more = far.select("node", F.col("_far").alias("ancestor"), (F.col("depth") + F.col("_d")).alias("depth"))
        known = staged(known.unionByName(more).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")), instead_of=known)
        before, total = total, known.count()
    return known


def reached(seeds: DataFrame, edges: DataFrame, start: str, end: str) -> DataFrame:
    """The nodes (node) that some seed (node) reaches along edges, seeds included. Round k marks what lies 2 ** k steps from what is marked and then makes steps twice as long, so a way of a
    million steps takes twenty rounds; where a node has one edge, steps are at most one row per node in each round. A round that marks nothing new ends it: what it would
    reach next lies a step from what is marked. Nulls are no nodes; cycles do no harm. Each round is written; the one before is deleted."""
    steps = edges.select(F.col(start).alias("node"), F.col(end).alias("to")).where("node is not null and to is not null and node <> to").distinct()
    steps, marked = staged(steps, "steps"), staged(seeds.select("node").where("node is not null").distinct(), "marked")
    total, before = marked.count(), -1
    while total != before:
        more = marked.join(steps, "node").select(F.col("to").alias("node"))
        marked = staged(marked.unionByName(more).distinct(), "marked", instead_of=marked)
        before, total = total, marked.count()
        if total != before:
            further = steps.select("node", F.col("to").alias("_mid")).join(steps.select(F.col("node").alias("_mid"), "to"), "_mid")
            steps = staged(further.select("node", "to").distinct(), "steps", instead_of=steps)
    return marked


def term_matches(label: Column, synonyms: Column, query: str) -> Column:
    """Whether a query stands in a label or its synonyms, in any case."""
    return F.lower(F.array_join(F.concat(F.array(label), F.coalesce(synonyms, F.array().cast("array<string>"))), " ")).contains(query.strip().lower())


def visible_terms(terms: DataFrame, query: str, id: str = "id", parent: str = "parent") -> DataFrame:
    """Terms (id, label, synonyms, parent) that match a query and all above them, with `matched`. Ancestors that are no terms do not count. Only what lies above a match is
    looked at."""
    hits = terms.where(term_matches(F.col("label"), F.col("synonyms"), query)).select(F.col(id).alias("node"))
    known = terms.select(F.col(id).alias("_id"))
    edges = terms.select(F.col(id).alias("node"), F.col(parent).alias("above")).join(known, F.col("above") == F.col("_id"), "left_semi")
    seen = reached(hits, edges, "node", "above").join(hits.distinct().withColumn("matched", F.lit(True)), "node", "left")
    return seen.select(F.col("node").alias(id), F.coalesce("matched", F.lit(False)).alias("matched"))
