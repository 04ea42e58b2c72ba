"""Relational operators on DataFrames: lookups, as-of and overlap joins, islands, running numbers, upserts, closures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def contains_any_case(needle: str, *columns: str) -> Column:
    """Case-insensitive substring over several columns joined by spaces; an empty needle passes all."""
    key = needle.strip().lower()
    return F.lit(True) if not key else F.lower(F.concat_ws(" ", *columns)).contains(key)


def lookup(rows: DataFrame, dimension: DataFrame, on: Sequence[str], column: str, order: Sequence[str], default=None) -> DataFrame:
    """Left join to one column of a dimension with a default; of several rows of a key the last in `order` counts."""
    last = dimension.groupBy(*on).agg(F.max_by(column, F.struct(*order)).alias(column))
    return rows.join(last, list(on), "left").withColumn(column, F.coalesce(column, F.lit(default)))


def first_by(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], into: str = "ord") -> DataFrame:
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def last_n(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Rows up to the n-th in an order that starts with the latest."""
    return numbered(rows, keys, order, "_rn").where(F.col("_rn") <= n).drop("_rn")


def running_offset(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], width: Column, into: str = "start_at") -> DataFrame:
    """Sum of the widths of the rows before."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(into, F.coalesce(F.sum(width).over(w), F.lit(0)))


def islands(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], new: Column, into: str = "island") -> DataFrame:
    """Numbers islands from 1; `new` says of a row whether it opens one (null: it does)."""
    return rows.withColumn(into, F.sum(F.coalesce(new.cast("int"), F.lit(1))).over(Window.partitionBy(*keys).orderBy(*order)))


def as_of(rows: DataFrame, states: DataFrame, keys: Sequence[str], time: str, value: str, into: str, order: str | None = None) -> DataFrame:
    """For each row the value of the last state of its key at or before its time: one sort of both sides together instead of a range
    join. With `order`, of all states that have begun the one with the largest order counts, however late it began."""
    rank = F.col(order) if order else F.col(time)
    both = rows.withColumn("_s", F.lit(None)).withColumn("_side", F.lit(1)).unionByName(
        states.select(*keys, time, F.struct(rank.alias("_o"), F.col(value).alias("_v")).alias("_s"), F.lit(0).alias("_side")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max("_s").over(w) if order else F.last("_s", ignorenulls=True).over(w)
    return both.withColumn(into, last["_v"]).where("_side = 1").drop("_s", "_side")


def overlaps(a: DataFrame, b: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Pairs of ranges [a_from, a_to) and [b_from, b_to) of a key that overlap, with the common part. Both sides are dealt into
    buckets of `width`, so the join is an equi-join; a pair is kept in the bucket where its common part begins."""
    deal = lambda df, p: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(f"{p}_from") / width), F.floor((F.col(f"{p}_to") - 1) / width))))
    start = F.greatest("a_from", "b_from")
    hit = deal(a, "a").join(deal(b, "b"), [*keys, "_b"]).where("a_from < b_to and b_from < a_to").where(F.floor(start / width) == F.col("_b"))
    return hit.withColumn("from", start).withColumn("to", F.least("a_to", "b_to")).drop("_b")


def upsert(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changed rows replace those of the same key; new ones are added."""
    return rows.join(changes.select(key), key, "left_anti").select(*rows.columns).unionByName(changes.select(*rows.columns))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a table that was only read, by keys, in eight partitions for each that it is read in and no fewer than a shuffle has: what one task holds then does not grow with the table."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, 8 * rows.rdd.getNumPartitions()), *keys)


def grid(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cells (row, col, row_span, col_span, ord) expanded to grid places; the later cell wins, owner marks its corner."""
    at = cells.withColumn("r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1))).withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)))
    owner = (F.col("r") == F.col("row")) & (F.col("c") == F.col("col"))
    return at.groupBy(*keys, "r", "c").agg(F.max("ord").alias("ord"), F.max_by(owner, "ord").alias("owner"))  # by hash: a struct would be sorted


def last_titles(rows: DataFrame, id: Column, title: Column, order: Sequence[str]) -> DataFrame:
    """Different pairs of trimmed id and title that are not both empty, by title as people sort it, the last occurrence's place as `place`."""
    pairs = rows.select(F.trim(F.coalesce(id.cast("string"), F.lit(""))).alias("id"), F.trim(F.coalesce(title, F.lit(""))).alias("title"), F.struct(*order).alias("_o"))
    return pairs.where("id <> '' or title <> ''").groupBy("id", "title").agg(F.max("_o").alias("_o")).orderBy(F.collate("title", "UNICODE"), "id").select("id", "title")


def by_flag_and_name(rows: DataFrame, flag: Column, name: str, ties: Sequence[str] = ()) -> list[Column]:
    """An order: rows with the flag first, then by name as people sort it."""
    return [F.desc(flag), F.collate(F.col(name), "UNICODE"), *map(F.col, ties)]


def any_hint(name: Column, hints: Sequence[str]) -> Column:
    """Whether a name holds one of some words, in any case."""
    out = F.lit(False)
    for h in hints:
        out = out | F.lower(name).contains(h)
    return out


def prefixed(words: DataFrame, word: str, often: str, prefix: str, most: int = 6) -> DataFrame:
    """The most frequent words that start with a prefix of two letters or more, in any case."""
    if len(prefix) < 2:
        return words.limit(0)
    return words.where(F.lower(word).startswith(prefix.lower())).orderBy(F.desc(often), word).limit(most)


def picked_voice(voices: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wish (wish, uri, lang) the best voice (ord, uri, lang, local): its very uri, else its language here, else a local one of the language's
    first part, else any of that, else the first; of equals the first by ord. Voices are few: they are one array beside each wish."""
    every = voices.agg(F.sort_array(F.collect_list(F.struct("ord", "uri", "lang", "local"))).alias("_v"))
    lang = F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit("en-US"))
    first = F.split_part(lang, F.lit("-"), F.lit(1))

    def rank(v: Column) -> Column:
        return F.when(v["uri"] == F.col("uri"), 0).when((v["lang"] == lang) & v["local"], 1).when(v["lang"].startswith(first) & v["local"], 2).when(v["lang"].startswith(first), 3).otherwise(4)

    best = F.array_min(F.transform("_v", lambda v: F.struct(rank(v).alias("r"), v["ord"].alias("o"), v["uri"].alias("uri"))))
    return wanted.withColumn("_one", F.lit(1)).join(F.broadcast(every.withColumn("_one", F.lit(1))), "_one").select("wish", best["uri"].alias("voice"))


def first_alias(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """For each standard name the first of its aliases (standard, alias, at) that is among the available names in any case; of names that differ only in
    case the last by ord."""
    real = names.groupBy(F.lower("name").alias("_k")).agg(F.max_by("name", "ord").alias("name"))
    return aliases.join(real, F.lower("alias") == F.col("_k")).groupBy("standard").agg(F.min_by("name", "at").alias("name"))
