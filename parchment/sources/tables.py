"""Reading and writing tables: append-only logs and their corrections, saves of what changed, drafts, exports, ranges of pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parchment.sources import versions


def append(rows: DataFrame, path: str, into: Mapping[str, Column] | None = None) -> None:
    """Adds rows to a table; nothing that stands there is read or changed. into: columns set on the way (a time, a state)."""
    rows.withColumns(dict(into or {})).write.mode("append").parquet(path)


def corrected(log: DataFrame, changes: DataFrame, key: str, deleted: str | None = None) -> DataFrame:
    """A log after corrections by key: a change replaces the columns it has (null: keeps), and goes if `deleted` holds. Keys without a
    row change nothing. Rows of one key in the log are changed alike. changes: one change for a key; equal ones count once."""
    columns = [c for c in changes.columns if c not in (key, deleted)]
    both = log.join(changes.distinct().select(key, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_new_{c}") for c in columns), (F.coalesce(deleted, F.lit(False)) if deleted else F.lit(False)).alias("_gone")), key, "left")
    return both.where("not coalesce(_gone, false)").select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in log.columns))


def where_equal(table: DataFrame, filters: Mapping[str, object], limit: int | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """Rows that equal all filters; a filter without a value passes all. The conditions reach the scan. limit: the first in `order`."""
    for name, value in filters.items():
        if value not in (None, ""):
            table = table.where(F.col(name) == F.lit(value))
    return table.orderBy(*order).limit(limit) if limit else table


def page_range(pages: DataFrame, page: str, first: int, last: int) -> DataFrame:
    """Pages first to last; a condition on the column alone, so it reaches the scan."""
    return pages.where(F.col(page).between(first, last))


def page_text(pages: DataFrame, served: DataFrame, fallback: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """The text of each page: what is served if that is not blank, else the fallback."""
    s, f = (d.select(*key, F.col(text).alias(n)) for d, n in ((served, "_served"), (fallback, "_own")))
    out = pages.join(s, list(key), "left").join(f, list(key), "left")
    return out.withColumn(text, F.coalesce(F.when(F.trim("_served") != "", F.col("_served")), F.col("_own"))).drop("_served", "_own")


def only_changed(rows: DataFrame, saved: DataFrame, key: Sequence[str], content: str) -> DataFrame:
    """Rows that are new or whose content differs from what is saved."""
    old = saved.select(*key, F.col(content).alias("_saved"), F.lit(True).alias("_known"))
    return rows.join(old, list(key), "left").where(F.col("_known").isNull() | ~F.col("_saved").eqNullSafe(F.col(content))).drop("_saved", "_known")


def new_content(rows: DataFrame, stored: DataFrame, content: str, order: Sequence[Column]) -> DataFrame:
    """Rows whose content is not stored yet, the first of equal ones: by a hash of the content, so that only hashes meet."""
    mark = F.sha2(F.col(content).cast("binary"), 256)
    fresh = rows.withColumn("_h", mark).join(stored.select(mark.alias("_h")), "_h", "left_anti")
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy("_h").orderBy(*order))).where("_n = 1").drop("_h", "_n")


def latest_version(versions: DataFrame, key: Sequence[str], version: str, state: str) -> DataFrame:
    """Of each key the draft if there is one, else what was saved last; a discarded draft does not count."""
    rank = F.when(F.col(state) == "draft", 0).when(F.col(state) == "saved", 1)
    w = Window.partitionBy(*key).orderBy("_r", F.desc(version))
    return versions.withColumn("_r", rank).where("_r is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_r", "_n")


def export_json(rows: DataFrame, ids: DataFrame, key: str, path: str) -> None:
    """The rows of a set of ids as lines of JSON."""
    rows.join(ids.select(key).distinct(), key, "left_semi").write.mode("overwrite").json(path)


def snapshot(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A landed JSON file, one document or an array of them."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def cached_or(cache: DataFrame, source: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """What the cache has, else what the source has, by key."""
    c, s = cache.select(*key, F.col(value).alias("_c")), source.select(*key, F.col(value).alias("_s"))
    return c.join(s, list(key), "full").select(*key, F.coalesce("_c", "_s").alias(value))


def migrated(rows: DataFrame, path: str, key: str) -> DataFrame:
    """The versioned table at `path` after a one-time move of rows into it: those whose key it has not. The move is one write under a tag, so however often it is asked for, or
    cut off, it is done once and as a whole."""
    spark = rows.sparkSession
    versions.commit(rows.join(versions.current(spark, path).select(key), key, "left_anti"), path, tag="moved")
    return versions.current(spark, path)


def autosaved(stream: DataFrame, path: str, log: str, key: str, order: str, trigger: dict | None = None):
    """A stream of states saved as it comes to a versioned table: of each micro-batch the last state of each key is added under the number of the batch, so that a batch that is run
    again after a failure is not saved twice. trigger: processingTime="1500 milliseconds" for a running query; all that is there by default."""

    def save(batch: DataFrame, number: int) -> None:
        last = batch.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
        versions.commit(last, path, tag=f"{log} {number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", log).trigger(**(trigger or {"availableNow": True})).start()
