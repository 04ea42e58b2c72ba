"""What several operators need: shared scratch tables, connected components, word memos."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.operators.page_index import slices, text_bytes

#: The word class of the contracts is the complement of these six characters; bytes.split() parts at exactly them.
BLANKS = r"\x20\x09-\x0D"
#: Bytes of text that a Python worker turns into objects at once.
PORTION = 1 << 22


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one if all run on one
    machine (as in tests), else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='parchment-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def own_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it: ends the lineage, survives lost executors."""
    path = own_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(docs: DataFrame, doc_id: str, text: str) -> tuple[Column, Column]:
    """Two columns (long) that tell documents apart where ids are null or repeated, so that only rows with the same id and text have the
    same: 128 bits of two hashes of the id and the text's SHA-256. Texts under one key are equal as far as SHA-256 tells texts apart, which no
    known pair of texts defeats; two of n rows share a key by chance once in 2 ** 129 / n ** 2 tables."""
    content = F.sha2(F.coalesce(F.col(text).cast("binary"), F.lit(b"")), 256)
    none = F.isnull(doc_id)
    return F.xxhash64(none, doc_id, content), F.xxhash64(content, F.lit("second"), none, doc_id)


def portions(batches: Iterator[pa.RecordBatch], *texts: int) -> Iterator[pa.RecordBatch]:
    """Batches in slices whose texts (the columns of these numbers) have at most PORTION bytes, or of one row: what is made of the rows of a batch grows with a slice."""
    for batch in batches:
        yield from slices(batch, sum(text_bytes(batch.column(k)) for k in texts), PORTION)


class Memo(dict):
    """A dict that computes what it lacks. Call trim() between batches: with more than `most` entries it forgets the half that came last;
    what is frequent comes early and stays."""

    def __init__(self, compute, most: int = 250_000):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        self[key] = out = self.compute(key)
        return out

    def trim(self) -> None:
        if len(self) > self.most:
            for key in list(islice(self, self.most // 2, None)):
                del self[key]


def lowest_joined(links: DataFrame, key: str, lowest: DataFrame, total: int, share: int = 256) -> DataFrame:
    """links with `low`, what `lowest`(k, low) has for links[key] (null where it has nothing). Rows of a key that holds more than
    one in `share` of all links stay where they are and get theirs from a broadcast of at most `share` rows; only the others
    are shuffled by key, so no task holds a hub. Up to 20,000 links are joined as they are."""
    if total <= 20_000:
        return links.join(lowest.withColumnRenamed("k", "other"), F.col(key) == F.col("other"), "left").drop("other")
    most = total // share + 1
    hot = links.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).where(F.col("n") > most).select("k")
    hubs = F.broadcast(hot.join(lowest, "k", "left").select(F.col("k").alias("hub"), F.col("low").alias("hub_low")))
    marked = links.join(hubs, F.col(key) == F.col("hub"), "left")
    plain = marked.where("hub is null").drop("hub", "hub_low").join(lowest.withColumnRenamed("k", "other"), F.col(key) == F.col("other"), "left").drop("other")
    return plain.unionByName(marked.where("hub is not null").withColumn("low", F.col("hub_low")).drop("hub", "hub_low"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): one row (id, component) per node, component its smallest id.

    Alternates large-star steps (a link to a node that has a smaller neighbour goes to that neighbour) and small-star steps
    (all smaller neighbours of a node are linked to the smallest), until a round moves no link: every link
    carries whether it moved, so the end is exact. Links stay in written tables; one boolean per round reaches the
    driver. Null ids link nothing; no edges: no rows.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "links")
    while True:
        lowest = links.groupBy(F.col("v").alias("k")).agg(F.min("m").alias("low"))
        total = links.count()
        large = lowest_joined(links, "m", lowest, total).select("v", F.coalesce("low", "m").alias("m"), F.col("low").isNotNull().alias("moved"))
        large = large.groupBy("v", "m").agg(F.max("moved").alias("moved"))
        if total > 20_000:
            large = cut(large, "links")
        small = lowest_joined(large, "v", large.groupBy(F.col("v").alias("k")).agg(F.min("m").alias("low")), total)
        apart = F.col("m") > F.col("low")
        pairs = F.array(F.struct("v", F.col("low").alias("m"), (F.col("moved") | apart).alias("moved")), F.when(apart, F.struct(F.col("m").alias("v"), F.col("low").alias("m"), F.lit(True).alias("moved"))))
        small = small.select(F.explode(pairs).alias("p")).where("p is not null").select("p.*")
        links = cut(small.groupBy("v", "m").agg(F.max("moved").alias("moved")), "links")
        if links.where("moved").isEmpty():
            break
        links = links.select("v", "m")
    return links.select(F.col("v").alias("id"), F.col("m").alias("component")).unionByName(links.select(F.col("m").alias("id"), F.col("m").alias("component")).distinct())
