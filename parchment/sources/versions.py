"""Tables whose versions are lists of written folders: a version is there as a whole or not at all, and a write that is tried again changes nothing.

`path`/data/<name> holds the Parquet files of one write, `path`/versions/<n> one line for each folder that belongs to version n, with the tag of the write. A version
is written beside and renamed into place, which succeeds for one writer only; the other starts again from what is there then. Folders that no version names are left-overs of
writes that were cut off and are never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Entry = tuple[str, str | None]
STATES = ("draft", "saved")


class Conflict(RuntimeError):
    """Another writer was first."""


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jvm, at, at.getFileSystem(conf), conf


def version_of(spark: SparkSession, path: str) -> int:
    """The number of the current version; 0 before the first."""
    _, at, files, _ = _files(spark, f"{path}/versions")
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return max((int(n) for n in names if n.isdigit()), default=0)


def entries(spark: SparkSession, path: str, version: int | None = None) -> list[Entry]:
    """Folders of a version (the current one by default), in the order in which they were written, and their tags."""
    version = version_of(spark, path) if version is None else version
    if not version:
        return []
    _, at, files, _ = _files(spark, f"{path}/versions/{version}")
    stream = files.open(at)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return [tuple(json.loads(line)) for line in text.splitlines()]


def _publish(spark: SparkSession, path: str, version: int, listed: Sequence[Entry]) -> None:
    jvm, beside, files, conf = _files(spark, f"{path}/versions/.{version}-{uuid.uuid4().hex}")
    out = files.create(beside)
    out.write("\n".join(json.dumps(e) for e in listed).encode())
    out.close()
    rename = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), conf).rename
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        rename(beside, jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{version}"), none)
    except Exception as e:
        files.delete(beside, False)
        raise Conflict(f"version {version} of {path} is there already") from e


def commit(rows: DataFrame, path: str, replace: bool = False, tag: str | None = None, tries: int = 5) -> int:
    """Writes rows as a folder of their own and publishes a version with it: added to what is there, or instead of it. Returns the number of the version. A write whose tag the current
    version has already is not done again. Rows may be made from the table itself: what they read stays. An append that meets another writer's version is added to that; a
    replacement is not, as it was made from what is no longer there: Conflict."""
    spark = rows.sparkSession
    version = version_of(spark, path)
    before = entries(spark, path, version)
    if tag is not None and any(t == tag for _, t in before):
        return version
    name = uuid.uuid4().hex
    rows.write.parquet(f"{path}/data/{name}")
    for attempt in range(tries):
        try:
            _publish(spark, path, version + 1, [(name, tag)] if replace else [*before, (name, tag)])
            return version + 1
        except Conflict:
            if replace or attempt + 1 == tries:
                raise
            version = version_of(spark, path)
            before = entries(spark, path, version)
            if tag is not None and any(t == tag for _, t in before):
                return version
    raise Conflict(path)


def current(spark: SparkSession, path: str, schema: str | None = None, version: int | None = None) -> DataFrame:
    """The rows of a version. schema: that of a table that may have no version yet, or versions without rows."""
    folders = [f"{path}/data/{name}" for name, _ in entries(spark, path, version)]
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*folders) if folders else spark.createDataFrame([], schema)


def changed(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], schema: str, tag: str | None = None) -> int:
    """Replaces a table by what `change` makes of it."""
    return commit(change(current(spark, path, schema)), path, replace=True, tag=tag)


# Contents of pages as draft and as saved: one row for each key and state.


def _rest(table: DataFrame, keys: DataFrame, key: Sequence[str], states: Sequence[str]) -> DataFrame:
    """Rows of other keys, and of these keys in other states."""
    return table.join(keys.select(*key).distinct().withColumn("_state", F.explode(F.array(*map(F.lit, states)))).withColumnRenamed("_state", "state"), [*key, "state"], "left_anti")


def drafted(table: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """New drafts (rows without a state, one for each key) instead of the drafts of their keys; what is saved stays."""
    return _rest(table, rows, key, ["draft"]).select(*table.columns).unionByName(rows.withColumn("state", F.lit("draft")).select(*table.columns))


def saved(table: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """The drafts of these keys become what is saved; keys without a draft keep theirs."""
    drafts = table.where("state = 'draft'").join(keys.select(*key).distinct(), list(key), "left_semi")
    return _rest(table, drafts, key, STATES).select(*table.columns).unionByName(drafts.withColumn("state", F.lit("saved")).select(*table.columns))


def discarded(table: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Without the drafts of these keys; what is saved stays."""
    return _rest(table, keys, key, ["draft"]).select(*table.columns)


def deleted(table: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Without anything of these keys."""
    return _rest(table, keys, key, STATES).select(*table.columns)


def shown(table: DataFrame, key: Sequence[str], contents: Mapping[str, Column] | None = None) -> DataFrame:
    """Each key with its state: its draft if it has one, else what is saved."""
    best = table.groupBy(*key).agg(F.min_by(F.struct(*table.columns), F.col("state")).alias("_row"))  # draft before saved
    return reduce(lambda df, c: df.withColumn(*c), (contents or {}).items(), best.select("_row.*"))
