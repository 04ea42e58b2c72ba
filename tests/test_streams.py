"""Keyed state over several micro-batches, and after a stop, from the log."""

from pyspark.sql import functions as F

from parchment.streaming import events


def test_nouns_are_numbered_across_batches_and_stops(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", events.STORE)
    source, schema = f"file://{tmp_path}/in", "doc long, at long, mode string, noun string"
    batches = [[(1, 1, "A", "heart"), (1, 2, "A", "lung"), (2, 1, "B", "heart"), (1, 3, "B", "heart")], [(1, 4, "A", "liver"), (1, 5, "A", "lung"), (2, 2, None, "lung")], [(1, 6, "B", "bone"), (2, 3, "B", "liver"), (2, 4, "B", None)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        out = events.numbered_nouns(stream, "doc", "at", F.col("mode"), "noun").writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/log").option("path", f"file://{tmp_path}/out")
        out.trigger(availableNow=True).start().awaitTermination()  # each round is a stream of its own that takes up the log
    got = sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/out").collect()))
    assert got == [(1, "A", "heart", 1), (1, "A", "liver", 3), (1, "A", "lung", 2), (1, "B", "bone", 1), (2, "", "lung", 1), (2, "B", "", 3), (2, "B", "heart", 1), (2, "B", "liver", 2)]
