"""Line dedup: content-defined chunks of lines. A rolling hash over the hashes of consecutive lines chooses the
boundaries, so an inserted line moves only the boundaries near it; multi-line chunks and long lines that occur elsewhere
in the corpus are removed, all but their first occurrence, after a comparison of their bytes. Repeated passages that no
chunk fits are reached by windows of two visible lines, which extend what is removed to the neighbouring equal lines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from parchment.llm.op06_token_counts import as_bytes
from parchment.llm.shared import cut, portions, row_key

LEAST, MOST, MASK = 2, 16, 1  # lines in a chunk; a boundary follows one window in MASK + 1
LONG = 50  # a line of more words is a chunk of its own
MIX = np.uint64(0x9E3779B97F4A7C15)
SLOTS = 25  # bits of a key that choose its place in the bitmap of keys seen twice


def is_long(line: bytes) -> bool:
    return len(line) > 2 * LONG and len(line.split()) > LONG


def chunk_starts(lines: list[bytes]) -> list[int]:
    """First line of each chunk, and the number of lines at the end. The window is the last two lines; blank lines
    count as any other. A long line is a chunk of its own; others have LEAST to MOST lines, but for the last before a
    long line or the end, which may be shorter."""
    n = len(lines)
    h = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in lines), np.uint64, n)
    with np.errstate(over="ignore"):
        rolled = (h * MIX + np.r_[np.uint64(0), h[:-1]]) * MIX
    ends = (rolled >> np.uint64(40)) & np.uint64(MASK) == 0
    long = np.fromiter(map(is_long, lines), bool, n)
    forced = long.copy()
    forced[:-1] |= long[1:]
    out, at = [0], 0
    for i in np.flatnonzero(ends | forced).tolist():
        while i - at >= MOST:
            at += MOST
            out.append(at)
        if forced[i] or i + 1 - at >= LEAST:
            at = i + 1
            out.append(at)
    while n - at > MOST:
        at += MOST
        out.append(at)
    return out if out[-1] == n else [*out, n]


def lines_of(text: bytes) -> list[bytes]:
    """The lines of a text with their ends; joined they give the text."""
    lines = text.split(b"\n")
    return [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])


def chunks_of(text: bytes) -> list[bytes]:
    """The chunks of a text with their line ends; joined they give the text."""
    lines = lines_of(text)
    if not lines:
        return []
    # a line's hash leaves out its end, so that a passage chunks alike at the end of a text
    at = chunk_starts([x.rstrip(b"\n") for x in lines])
    return [b"".join(lines[a:b]) for a, b in zip(at, at[1:])]


def body_of(chunk: bytes) -> bytes | None:
    """What is compared: the chunk without its last line end; None if it is a single line that is not long or has no visible byte."""
    body = chunk[:-1] if chunk.endswith(b"\n") else chunk
    return body if (b"\n" in body or is_long(body)) and body.strip() else None


def windows_of(text: bytes) -> list[tuple[int, int, bytes]]:
    """(first line, number of lines, bytes) of each visible line with the next visible one and the blank lines between."""
    lines = lines_of(text)
    seen = [i for i, x in enumerate(lines) if x.strip()]
    return [(a, b + 1 - a, b"".join(lines[a : b + 1]).removesuffix(b"\n")) for a, b in zip(seen, seen[1:])]


def units_of(text: bytes, extend: bool) -> list[tuple[int, int, bool, bytes, bytes]]:
    """(first line, number of lines, whether a chunk, 128-bit key, bytes) of all that may be removed."""
    out, at = [], 0
    for c in chunks_of(text):
        n = c.count(b"\n") + (not c.endswith(b"\n"))
        if (b := body_of(c)) is not None:
            out.append((at, n, True, xxhash.xxh3_128_digest(b), b))
        at += n
    if extend:
        out += [(a, n, False, xxhash.xxh3_128_digest(b, seed=1), b) for a, n, b in windows_of(text)]
    return out


def keys_seen_twice(keys: DataFrame) -> np.ndarray:
    """A bitmap of 2 ** SLOTS bits with those of all keys that occur twice or more. It is of one size whatever the input, and only
    saves the comparison of texts that can't be equal: other keys may share a bit, none that occurs twice lacks its own."""
    slot = F.col("slot")
    words = keys.groupBy("key", "slot").count().where("count > 1").select((slot / 64).cast("int").alias("w"), F.expr("shiftleft(1L, slot % 64)").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    got = words.toArrow()
    out = np.zeros(1 << (SLOTS - 6), np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out.view(np.uint64)


def slot_of(key: bytes) -> int:
    return int.from_bytes(key[:4], "big") >> (32 - SLOTS)


def repeated_chunks(rows: DataFrame, extend: bool = False) -> DataFrame:
    """What to remove of rows (d, e: the row key, doc, t binary): (d, e, units array<struct<at int, n int, chunk boolean, first boolean>>), lines by
    number. A chunk is repeated if another chunk of any row has the same bytes; `first` tells the first by (doc, length, key, place), null ids
    last, which stays but in further rows of the same key. With `extend`, so are windows of two visible lines.
    Bytes are compared by the smallest and the largest text under each 128-bit key, which a map-side aggregate finds; keys whose
    texts differ remove nothing. As a line goes only for an equal one in an earlier place, one of equal lines always stays."""
    kind = rows.schema["doc"].dataType.simpleString()

    def hashed(batches):
        for batch in portions(batches, 0):
            key = [u[3] for t in batch.column(0) for u in units_of(t.as_py(), extend)]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(map(slot_of, key), pa.int32())], ["key", "slot"])

    twice = rows.sparkSession.sparkContext.broadcast(keys_seen_twice(rows.select("t").mapInArrow(hashed, "key binary, slot int")))

    def explode(batches):
        bits = twice.value
        for batch in portions(batches, 3):
            row, size, out = [], [], [[], [], [], [], []]
            for i, t in enumerate(batch.column(3)):
                t = t.as_py()
                for u in units_of(t, extend):
                    slot = slot_of(u[3])
                    if int(bits[slot >> 6]) >> (slot & 63) & 1:
                        row.append(i)
                        size.append(len(t))
                        for column, value in zip(out, u, strict=True):
                            column.append(value)
            take = pa.array(row, pa.int64())
            kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(3)), pa.array(size, pa.int32()), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["d", "e", "doc", "size", "at", "n", "chunk", "key", "body"])

    place = F.struct(F.isnull("doc").alias("none"), "doc", "size", "d", "e", "at")
    rows = rows.select("d", "e", "doc", "t").mapInArrow(explode, f"d long, e long, doc {kind}, size int, at int, n int, chunk boolean, key binary, body binary")
    rows = cut(rows, "units")  # read twice below
    keys = rows.groupBy("key").agg(F.count("*").alias("times"), F.min(place).alias("first"), F.min("body").alias("lo"), F.max("body").alias("hi"))
    keys = cut(keys.where("times > 1 and lo = hi").select("key", F.col("first.d").alias("first_d"), F.col("first.e").alias("first_e"), F.col("first.at").alias("first_at")), "chunks")
    first = (F.col("d") == F.col("first_d")) & (F.col("e") == F.col("first_e")) & (F.col("at") == F.col("first_at"))
    found = rows.select("d", "e", "at", "n", "chunk", "key").join(keys, "key").withColumn("first", first)
    return found.groupBy("d", "e").agg(F.collect_set(F.struct("at", "n", "chunk", "first")).alias("units"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunks: str = "n_chunks_removed", lines: str = "n_lines_removed", extend: bool = False) -> DataFrame:
    """docs with repeated chunks cut from `text`, and two added columns (replaced where they exist): chunks and lines removed.
    extend: also the lines of every other repeated passage of two or more visible lines; they count as lines, not as chunks.

    Null text stays null; a text that loses everything becomes empty; texts of one line that is not long and empty texts
    stay. Rows with a null or the same id are documents each for itself (see row_key): of equal ids the shorter text comes
    first, of rows equal in id and text the one with the smallest hash of its columns. Two equal chunks of one document count as repeated. An
    empty table gives an empty table.
    """
    own = docs.drop(chunks, lines)
    d, e = row_key(own, doc_id, text)
    keyed = own.select(F.struct(*(F.col(f"`{c}`") for c in own.columns)).alias("own"), d.alias("d"), e.alias("e"))
    texts = keyed.where(F.col(f"own.`{text}`").isNotNull()).select("d", "e", F.col(f"own.`{doc_id}`").alias("doc"), as_bytes(f"own.`{text}`").alias("t"))
    joined = keyed.join(repeated_chunks(texts, extend), ["d", "e"], "left")
    order = F.xxhash64(*(F.col(f"own.`{c}`") for c in own.columns))
    joined = joined.withColumn("again", F.row_number().over(Window.partitionBy("d", "e").orderBy(order)) > 1).select("own", "again", "units")

    def strip(batches):
        for batch in portions(batches, 0):
            kept, n_chunks, n_lines = [], [], []
            for t, units, again in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                units = [u for u in units if again or not u["first"]]
                gone = {k for u in units for k in range(u["at"], u["at"] + u["n"])}
                kept.append(b"".join(x for k, x in enumerate(lines_of(t)) if k not in gone).decode("utf-8", "replace"))
                n_chunks.append(sum(u["chunk"] for u in units))
                n_lines.append(len(gone))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(kept, pa.string()), pa.array(n_chunks, pa.int32()), pa.array(n_lines, pa.int32())], ["own", "kept", "nc", "nl"])

    touched = F.exists("units", lambda u: F.col("again") | ~u.first)
    joined = joined.withColumn("touched", F.coalesce(touched, F.lit(False)))
    some = joined.where("touched").select(as_bytes(f"own.{text}").alias("t"), "units", "own", "again")
    schema = StructType([some.schema["own"], *StructType.fromDDL("kept string, nc int, nl int").fields])  # not as text: columns may have any name
    done = some.mapInArrow(strip, schema).unionByName(joined.where("not touched").select("own", F.lit(None).cast("string").alias("kept"), F.lit(0).alias("nc"), F.lit(0).alias("nl")))
    return done.select(*(F.coalesce("kept", f"own.{c}").alias(c) if c == text else F.col(f"own.`{c}`").alias(c) for c in own.columns), F.col("nc").alias(chunks), F.col("nl").alias(lines))
