"""Streams: lines of server-sent events, first sight of a key, spoken phrases that replace near repeats, late answers dropped."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from parchment.functions import text as T
from parchment.sources.scratch import new_path


#: The state store on disk, of which each batch writes only what it changed.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def data_events(lines: DataFrame, line: str, schema: str, into: str = "event") -> DataFrame:
    """`data: {json}` lines parsed; other lines, the end mark and broken JSON go."""
    body = F.regexp_extract(F.col(line), r"^data: ?(.*)$", 1)
    return lines.withColumn(into, F.from_json(body, schema)).where(F.col(line).startswith("data:") & (body != "[DONE]")).where(F.try_parse_json(body).isNotNull())


def message(body: Column, control: str) -> Column:
    """A message of a chat as struct(control, who, text, interrupted); null for blank ones. A JSON object of type `control` is no message but a request, marked so. One with
    a text that is not empty, 0 or false gives its text, who (user; all else is assistant) and whether it was cut off (true itself, nothing like it). Everything else, JSON
    or not, is the assistant's text as it stands, trimmed."""
    raw = T.stripped(body)
    v = F.try_parse_json(raw)
    get = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    kind = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    empty = get("text").isNull() | (get("text") == "") | ((kind("text") == "BOOLEAN") & (get("text") == "false")) | (~kind("text").isin("STRING", "BOOLEAN") & (get("text").try_cast("double") == 0))
    told = ~F.coalesce(empty, F.lit(True))
    asked = F.coalesce((get("type") == control) & (kind("type") == "STRING"), F.lit(False))
    own = lambda then, other: F.when(told & ~asked, then).otherwise(other)
    who = F.when((get("role") == "user") & (kind("role") == "STRING"), "user").otherwise("assistant")
    cut_off = F.coalesce((kind("interrupted") == "BOOLEAN") & (get("interrupted") == "true"), F.lit(False))
    return F.when(raw != "", F.struct(asked.alias("control"), own(who, F.lit("assistant")).alias("who"), own(get("text"), raw).alias("text"), own(cut_off, F.lit(False)).alias("interrupted")))


def first_seen(stream: DataFrame, keys: list[str], time: str | None = None, late: str = "1 hour") -> DataFrame:
    """The first row of each key. With a time, keys are forgotten once the watermark has passed them; without, all keys are kept."""
    return stream.dropDuplicates(keys) if time is None else stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def captions(events: DataFrame, speaker: str, time: str, text: str, final: str) -> DataFrame:
    """What each speaker is saying: the latest text unless it is final. One row of state per speaker, so it also serves a stream
    in update mode. Of equal times, the final one is the latest."""
    last = events.groupBy(speaker).agg(F.max(F.struct(F.col(time).alias("time"), F.coalesce(final, F.lit(False)).alias("final"), F.col(text).alias("text"))).alias("_l"))
    return last.where("not _l.final").select(speaker, F.col("_l.text").alias("caption"))


def still_current(request: Column, latest: Column, page: Column, current_page: Column) -> Column:
    """Whether an answer is to the latest request and still for the page shown."""
    return request.eqNullSafe(latest) & page.eqNullSafe(current_page)


def near(before: str, now: str) -> bool:
    """replaces_phrase() of two dictation keys, for the state of a stream."""
    a, b = before.split(), now.split()
    if min(len(a), len(b)) < T.LEAST_WORDS or not len(a) - T.FEWER <= len(b) <= len(a) + T.MORE:
        return False
    x, y = set(a), set(b)
    return len(x & y) / max(len(x), len(y)) >= T.NEAR


def _fold(key, batches, state: GroupState):
    """State: the dictation key of the last phrase and its number. Rows of a batch are taken in order of `ord`."""
    last, n = state.get if state.exists else ("", 0)
    rows = pd.concat(list(batches)).sort_values("ord", kind="stable")
    out = []
    for t, o, said in zip(rows["text"], rows["ord"], rows["said"]):
        again = near(last, said)
        n += not again
        last = said
        out.append((*key, n, int(o), again, t))
    state.update((last, n))
    yield pd.DataFrame(out, columns=["key", "phrase", "ord", "replaces", "text"])


def phrases(stream: DataFrame, key: str, ord: str, text: str) -> DataFrame:
    """Each row with the number of its phrase in its key (bigint), a row without a place in the order first (-1); one that is near the row before replaces that. The
    state of a key is one phrase, so it does not grow with the stream."""
    rows = stream.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(ord).cast("long"), F.lit(-1)).alias("ord"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("said", T.dictation_key(F.col("text")))
    return rows.groupBy("key").applyInPandasWithState(_fold, "key long, phrase long, ord long, replaces boolean, text string", "last string, n long", "append", GroupStateTimeout.NoTimeout)


def until_terminal(polls: DataFrame, job: str, ord: Sequence[str], status: str, terminal: Sequence[str]) -> DataFrame:
    """Polls of each job up to and with the first that says it is over; what comes after is not asked for."""
    w = Window.partitionBy(job).orderBy(*ord).rowsBetween(Window.unboundedPreceding, -1)
    over = F.lower(F.coalesce(F.col(status), F.lit("queued"))).isin(*terminal)
    return polls.withColumn("_over", F.coalesce(F.sum(over.cast("int")).over(w), F.lit(0))).where("_over = 0").drop("_over")


def settled(queries: DataFrame, keys: Sequence[str], time: str, ord: Sequence[str], wait_us: int, text: str | None = None, least: int = 0) -> DataFrame:
    """Queries that no other of their key replaces within `wait_us` microseconds, with at least so many letters: what a search that waits for the typing to
    end is asked, and whose answers count."""
    w = Window.partitionBy(*keys).orderBy(*ord)
    rows = queries.withColumn("_next", F.lead(F.unix_micros(F.col(time).cast("timestamp"))).over(w)).withColumn("_now", F.unix_micros(F.col(time).cast("timestamp")))
    rows = rows.where(F.col("_next").isNull() | (F.col("_next") - F.col("_now") > wait_us)).drop("_next", "_now")
    return rows.where(F.length(text) >= least) if text else rows


def _lines(key, batches, state: GroupState):
    """State: what came after the last line end, and how many lines there were."""
    rest, n = state.get if state.exists else ("", 0)
    out = []
    for chunk in pd.concat(list(batches)).sort_values("ord", kind="stable")["chunk"]:
        *whole, rest = (rest + chunk).split("\n")
        for line in whole:
            out.append((*key, n, line))
            n += 1
    state.update((rest, n))
    yield pd.DataFrame(out, columns=["key", "n", "line"])


def chunk_lines(stream: DataFrame, key: str, ord: str, chunk: str) -> DataFrame:
    """Whole lines of a stream of chunks of text: key, n (from 0), line. A line may cross chunks and batches; what has no end yet is kept in the state."""
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(ord).cast("long").alias("ord"), F.coalesce(F.col(chunk), F.lit("")).alias("chunk"))
    return rows.groupBy("key").applyInPandasWithState(_lines, "key long, n long, line string", "rest string, n long", "append", GroupStateTimeout.NoTimeout)


def told(events: DataFrame, keys: Sequence[str], ord: str, delta: Column, error: Column) -> DataFrame:
    """What is told so far: deltas one after the other; an error replaces what stands before it."""
    rows = events.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(ord).alias("ord"), delta.alias("delta"), error.alias("error")))).alias("_e"))
    step = lambda said, e: F.when(e["error"].isNotNull(), F.concat(F.lit("Error: "), e["error"])).otherwise(F.concat(said, F.coalesce(e["delta"], F.lit(""))))
    return rows.select(*keys, F.aggregate("_e", F.lit(""), step).alias("content"))


class _Numbers(StatefulProcessor):
    """State of a document: its nouns, and how many each place holds, an entry each, so that a batch reads and writes only what it touches."""

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "noun string", "seen boolean", self.forget_ms)
        self.counts = handle.getMapState("counts", "place string", "n long", self.forget_ms)

    def handleInputRows(self, key, rows, timerValues):
        first = pd.concat(list(rows)).sort_values("ord", kind="stable").drop_duplicates("noun")
        counts, out = {}, []
        known, counted = self.seen.exists(), self.counts.exists()  # of a new document nothing is looked up
        for row in first.itertuples():
            noun = (row.noun,)
            if not (known and self.seen.containsKey(noun)):
                self.seen.updateValue(noun, (True,))
                if row.place not in counts:
                    counts[row.place] = self.counts.getValue((row.place,))[0] if counted and self.counts.containsKey((row.place,)) else 0
                counts[row.place] += 1
                out.append((*key, row.place, row.noun, counts[row.place]))
        for place, n in counts.items():
            self.counts.updateValue((place,), (n,))
        yield pd.DataFrame(out, columns=["key", "place", "noun", "num"])

    def close(self) -> None:
        pass


def numbered_nouns(stream: DataFrame, key: str, ord: str, place: Column, noun: str, forget_ms: int | None = None) -> DataFrame:
    """The first sight of each noun of a document, numbered within its place (card and mode) as they come. The state of a document is its nouns, an entry each; forget_ms: how long
    an entry lasts after it was written. Needs the store that run_available() sets."""
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(ord).cast("long").alias("ord"), F.coalesce(place, F.lit("")).alias("place"), F.coalesce(noun, F.lit("")).alias("noun"))
    return rows.groupBy("key").transformWithStateInPandas(_Numbers(forget_ms), "key long, place string, noun string, num long", "append", "none" if forget_ms is None else "processingTime")


def _speeds(window: float):
    def run(key, batches, state: GroupState):
        """State: the samples of the last `window` units of time."""
        kept = list(zip(*state.get)) if state.exists else []
        out = []
        for s in pd.concat(list(batches)).sort_values(["t", "ord"], kind="stable").itertuples():
            kept = [k for k in kept if k[0] >= s.t - window]
            kept.append((s.t, s.x))
            t, x = kept[0]
            out.append((*key, s.ord, (s.x - x) / (s.t - t) if s.t > t else 0.0))
        state.update(tuple(map(list, zip(*kept))))
        yield pd.DataFrame(out, columns=["key", "ord", "vx"])

    return run


def tracked(stream: DataFrame, key: str, t: str, ord: str, x: str, window: float) -> DataFrame:
    """Velocity of each sample over the last `window` units of time, for samples that come in order of time within their key."""
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(t).cast("double").alias("t"), F.col(ord).cast("long").alias("ord"), F.col(x).cast("double").alias("x"))
    return rows.groupBy("key").applyInPandasWithState(_speeds(window), "key long, ord long, vx double", "t array<double>, x array<double>", "append", GroupStateTimeout.NoTimeout)


def run_available(spark: SparkSession, path: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that a Parquet path holds now, read as a stream, transformed and written as Parquet in the shared folder."""
    out = new_path(spark, "stream")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # keeps maps and lists of a key entry by entry
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    # A stream reads folders; a single file is reached through its parent by name.
    parent, name = path.rstrip("/").rsplit("/", 1)
    stream = source.option("pathGlobFilter", name).parquet(parent) if _is_file(spark, path) else source.parquet(path)
    done = transform(stream).writeStream.format("parquet").option("checkpointLocation", f"{out}/log").option("path", f"{out}/rows").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def _is_file(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
