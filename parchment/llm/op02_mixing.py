"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, first to sources, then
to the shards of each source, then a seeded choice of blocks. DataFrame and SQL functions only.

A shard lays its documents in seeded order on a line of words and cuts it into blocks of equal length. Its
quota of blocks is met by full passes over the line and, for what is left, by every k-th block from a seeded
start, which picks exactly the quota and needs no table of blocks: how many chosen blocks lie before a word
is arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parchment.llm.shared import cut

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+: the parts between blanks that are not empty. Null: 0."""
    blanks = " \t\n\x0b\x0c\r"
    plain = F.translate(F.concat(F.lit(" "), text), blanks[1:], " " * 5)
    parts = F.filter(F.split(plain, " ", -1), lambda w: w != "")
    return F.coalesce(F.size(parts), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """sources(source, source_size) and target: shares by weight of the sum of all sizes, weights repeating over the
    sources by code point (null last); a target stops at `most` times its source's size and the excess goes
    to the others by weight. The capped sources are those with the smallest cap per weight, so one pass of running sums
    over the table of sources finds them."""
    order = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.select("*", w.alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    by = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.asc_nulls_last("source"))
    upto, everything = by.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("cap").over(upto), F.lit(0.0))
    weight_left = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - capped) / weight_left
    s = s.withColumn("level", level).withColumn("over", F.col("level") * F.col("w") > F.col("cap"))
    first_fit = F.max(F.when(~F.col("over"), F.col("level"))).over(everything)
    return s.select(*sources.columns, F.when(F.col("over"), F.col("cap")).otherwise(F.least(F.coalesce(first_fit, F.col("level")) * F.col("w"), F.col("cap"))).alias("target"))


def sainte_lague(votes: DataFrame, party: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """votes(*group, *party, votes double, seats long: the same in a group) -> *group, *party, quota long.

    Seats go to the highest quotients votes / (2 k + 1). By how divisor methods round, a party ends within
    1.5 + share * parties / 2 of its exact share; only quotients in that range are listed and ranked,
    about six per party in all. Ties go to more votes, then to the smaller party, null last.
    """
    all_of = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    v = votes.where("votes > 0 and seats > 0")
    v = v.withColumn("total", F.sum("votes").over(all_of)).withColumn("parties", F.count("*").over(all_of))
    share, slack = F.col("votes") / F.col("total"), F.col("votes") / F.col("total") * F.col("parties") / 2 + 1.5
    v = v.withColumn("base", F.greatest(F.floor(share * F.col("seats") - slack), F.lit(0)).cast("long"))
    v = v.withColumn("upper", F.ceil(share * F.col("seats") + slack).cast("long")).withColumn("given", F.sum("base").over(all_of))
    q = v.withColumn("k", F.explode(F.sequence("base", "upper"))).withColumn("quotient", F.col("votes") / (2 * F.col("k") + 1))
    rank = F.row_number().over((Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))).orderBy(F.desc("quotient"), F.desc("votes"), *(F.asc_nulls_last(p) for p in party), "k"))
    won = q.withColumn("won", rank <= F.col("seats") - F.col("given"))
    return won.groupBy(*group, *party).agg((F.first("base") + F.sum(F.col("won").cast("long"))).alias("quota"))


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5.0, 2.0, 1.0), most: float = 3.0,
             seed: int = 17, block: int | None = None, shard_docs: int = 4_096, row: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, source, source_size, target, taken, and where its words lie: start,
    passes (full passes), chosen, blocks, phase, block.

    block: words in a block; by default a two-hundredth of the smallest positive target, 1 to 1024, so that
    rounding to blocks moves no source's share by more than about half a percent. Shards hold about shard_docs
    documents of one source, so a source with most rows is many shards. Null text has size 0 and is taken 0
    times; null is a source of its own, after all others; an empty table gives an empty table; extra columns are ignored;
    repeated rows are documents each for itself, dealt to shards by id and text. row: a column that comes along under its name.
    """
    carried = [row] if row else []
    sizes = cut(docs.select(*carried, F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
                            F.xxhash64(F.col(doc_id), F.col(text), F.lit(seed)).alias("h"), F.xxhash64(F.col(text)).alias("tie")), "sizes")
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count("*") / shard_docs).alias("shards"))
    per = cut(source_targets(per, weights, most), "sources")
    totals = per.agg(F.min(F.when(F.col("target") > 0, F.col("target"))).alias("least"), F.sum("target").alias("all")).first()
    if block is None:
        block = int(min(1024, max(1, (totals["least"] or 0) // 200)))
    seats = round((totals["all"] or 0.0) / block)
    quotas = sainte_lague(per.select("source", F.col("target").alias("votes"), F.lit(seats).cast("long").alias("seats")), ["source"])
    q = per.join(quotas.withColumnRenamed("source", "s"), per["source"].eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "shards", F.coalesce("quota", F.lit(0)).alias("quota"))

    key = F.struct(F.coalesce("source", F.lit("")).alias("s"), F.isnull("source").alias("none"))  # joins where null equals null
    q = q.withColumn("key", key)
    # only sources of several shards are looked up, at most one for shard_docs documents, so the hot ones are not shuffled
    several = F.broadcast(q.where("shards > 1").select("key", "shards"))
    placed = sizes.withColumn("key", key).join(several, "key", "left").withColumn("shard", F.pmod("h", F.coalesce("shards", F.lit(1))))
    cells = placed.groupBy("key", "shard").agg(F.sum("size").alias("words"))
    asked = cells.join(q.select("key", "quota"), "key")
    by_shard = sainte_lague(asked.select("key", "shard", F.col("words").cast("double").alias("votes"), F.col("quota").alias("seats")), ["shard"], ["key"])
    cells = cells.join(by_shard, ["key", "shard"], "left").join(q.select("key", "source_size", "target"), "key")
    asked_words = F.least(F.coalesce("quota", F.lit(0)) * block, (F.col("words") * most).cast("long"))
    cells = cells.withColumn("passes", F.when(F.col("words") > 0, F.floor(asked_words / F.col("words"))).otherwise(0))
    cells = cells.withColumn("blocks", F.ceil(F.col("words") / block)).withColumn("chosen", F.when(F.col("words") > 0, F.round((asked_words - F.col("passes") * F.col("words")) / block)).otherwise(0).cast("long"))
    cells = cells.withColumn("phase", F.pmod(F.xxhash64("key", "shard", F.lit(seed)), F.greatest("blocks", F.lit(1))))
    line = Window.partitionBy("key", "shard").orderBy("h", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    p = placed.withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0))).join(cells, ["key", "shard"])
    p = p.withColumn("block", F.lit(block).cast("long"))
    taken = F.col("passes") * F.col("size") + chosen_before(F.col("start") + F.col("size")) - chosen_before(F.col("start"))
    return p.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"), "start", "passes", "chosen", "blocks", "phase", "block", *carried)


def block_chosen(index: Column) -> Column:
    """Whether the partial pass takes the block of this index: floor((i * chosen + phase) / blocks) rises after it."""
    at = lambda i: F.floor((i * F.col("chosen") + F.col("phase")) / F.greatest("blocks", F.lit(1)))
    return at(index + 1) > at(index)


def chosen_before(word: Column) -> Column:
    """Number of words of chosen blocks before this place on the shard's line."""
    index = F.floor(word / F.col("block"))
    full = F.floor((index * F.col("chosen") + F.col("phase")) / F.greatest("blocks", F.lit(1)))
    return full * F.col("block") + F.when(block_chosen(index), word - index * F.col("block")).otherwise(0)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed documents, with the columns of docs: a row for each full pass over a document, and one with the
    words (and the white space after each) of its chosen blocks where the partial pass takes some. Rows are told apart by a
    number of their own in a written table, so null and repeated ids neither vanish nor multiply."""
    numbered = cut(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.monotonically_increasing_id().alias("_row")), "rows")
    flat = numbered.select("_row", *(F.col(f"_doc.`{c}`").alias(f"_{c}") for c in dict.fromkeys((doc_id, text, source))))
    plan = mix_plan(flat, f"_{doc_id}", f"_{text}", f"_{source}", row="_row", **options).where("taken > 0").select("_row", "size", "taken", "start", "passes", "chosen", "blocks", "phase", "block")
    plan = plan.withColumn("part", F.col("taken") - F.col("passes") * F.col("size"))
    both = numbered.join(plan, "_row")
    words = F.regexp_extract_all(F.col(f"_doc.{text}"), F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1))
    cut_text = F.array_join(F.filter(words, lambda w, i: block_chosen(F.floor((F.col("start") + i) / F.col("block")))), "")
    whole = F.col("passes") + (F.col("part") == F.col("size")).cast("long")
    rows = both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(whole + ((F.col("part") > 0) & (F.col("part") < F.col("size"))).cast("long"), F.lit(1)).cast("int"))))
    shown = F.when(F.col("_copy") <= whole, F.col(f"_doc.{text}")).otherwise(cut_text)
    return rows.select(*(shown.alias(c) if c == text else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns))
