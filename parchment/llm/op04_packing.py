"""Packing of token sequences: a configuration linear program over the histogram of lengths, solved by
multiplicative weights with knapsack dynamic programming as pricing, rounded down, completed by best fit.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parchment.llm.op06_token_counts import as_bytes, encoder, looked_up, reading, worker_memo
from parchment.llm.shared import Memo, cut, portions

Pattern = tuple[tuple[int, int], ...]  # (length, how many), by falling length
#: Pre-tokens whose ids a worker remembers: about 200 bytes each.
MEMO = 500_000


def _price(lengths: np.ndarray, price: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best value for each capacity, and the length whose item ends it (0: leave one token free)."""
    best, last = np.zeros(room + 1), np.zeros(room + 1, dtype=np.int64)
    for c in range(1, room + 1):
        k = np.searchsorted(lengths, c, side="right")
        best[c] = best[c - 1]
        if k:
            value = best[c - lengths[:k]] + price[:k]
            at = int(value.argmax())
            if value[at] > best[c]:
                best[c], last[c] = value[at], lengths[at]
    return best, last


def configuration_program(histogram: dict[int, int], room: int, rounds: int = 24, eta: float = 8.0) -> dict[Pattern, float]:
    """A fractional cover of the histogram by patterns. Each round prices lengths by exp(-eta * share already
    covered) / count, solves one knapsack for all capacities and adds, for every length, the best pattern that
    holds it, by 1/rounds of its scarcest length."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    need = np.array([histogram[n] for n in lengths.tolist()], dtype=float)
    at = {n: i for i, n in enumerate(lengths.tolist())}
    covered, use = np.zeros(len(lengths)), Counter()
    for _ in range(rounds):
        price = np.exp(-eta * (covered / need)) / need
        best, last = _price(lengths, price, room)
        for i in np.argsort(covered / need, kind="stable").tolist():
            if covered[i] >= need[i]:
                continue
            items, c = Counter([int(lengths[i])]), room - int(lengths[i])
            while c > 0:
                if n := int(last[c]):
                    items[n] += 1
                    c -= n
                else:
                    c -= 1
            step = min(need[at[n]] / k for n, k in items.items()) / rounds
            use[tuple(sorted(items.items(), reverse=True))] += step
            for n, k in items.items():
                covered[at[n]] += step * k
    return dict(use)


def pack_histogram(histogram: dict[int, int], room: int) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used; together they hold every length exactly as often as the histogram.

    The linear program's use of each pattern is rounded down and bounded by what is left of its lengths;
    the remainder is packed by best fit over counts, longest first.
    """
    left, out = {n: k for n, k in histogram.items() if k}, []
    if left:
        use = configuration_program(left, room)
        full = lambda p: sum(n * k for n, k in p)
        for pattern, x in sorted(use.items(), key=lambda u: (-full(u[0]), -u[1], u[0])):
            times = min(int(x + 1e-9), *(left[n] // k for n, k in pattern))
            if times > 0 and full(pattern) >= room - 1:
                out.append((pattern, times))
                for n, k in pattern:
                    left[n] -= times * k
    open_bins: dict[int, Counter] = {}  # free room: patterns
    def put(free, pattern, times):
        open_bins.setdefault(free, Counter())[pattern] += times
    for n in sorted((n for n, k in left.items() if k), reverse=True):
        todo = left[n]
        while todo:
            free = min((f for f, c in open_bins.items() if f >= n and c), default=None)
            if free is None:
                each = room // n
                if todo >= each:
                    put(room - each * n, ((n, each),), todo // each)
                if todo % each:
                    put(room - todo % each * n, ((n, todo % each),), 1)
                todo = 0
                continue
            pattern, times = next(iter(open_bins[free].items()))
            each = min(free // n, todo)
            used = min(times, todo // each)
            open_bins[free][pattern] -= used
            if not open_bins[free][pattern]:
                del open_bins[free][pattern]
            if not open_bins[free]:
                del open_bins[free]
            put(free - each * n, (*pattern, (n, each)), used)
            todo -= used * each
    return out + [(p, t) for c in open_bins.values() for p, t in c.items()]


def packed_ids(ids: list[int], ends: np.ndarray) -> list[bytes]:
    """Ids of words that end at `ends`, as unsigned little-endian 32-bit numbers."""
    data, cuts = np.array(ids, "<u4").tobytes(), (4 * ends).tolist()
    return [data[a:b] for a, b in zip([0, *cuts], cuts)]


def token_pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", room: int = 2048, end: int = 0) -> DataFrame:
    """Documents as token ids plus `end`, cut into pieces of `room`: doc_id, piece, start, length, ids_crc32."""
    how = reading(tokenizer)

    def pieces(batches):
        encode = encoder(tokenizer)
        ids = worker_memo(("ids", tokenizer), lambda: Memo(None, MEMO))
        tail = np.array([end], "<u4").tobytes()
        for batch in portions(batches, 1):
            out: list[list] = [[], [], [], [], []]
            keys = batch.column(0).to_pylist()
            for row, parts in looked_up(batch, 1, how, ids, ids, encode, packed_ids):
                packed, key = b"".join([*parts, tail]), keys[row]
                for k, at in enumerate(range(0, len(packed), 4 * room)):
                    part = packed[at : at + 4 * room]
                    for column, value in zip(out, (key, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), as_bytes(text).alias("t"))
    return rows.mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", room: int = 2048, end: int = 0, shard_rows: int = 200_000) -> DataFrame:
    """One row per piece: doc_id, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long.

    tokenizer: a file for the tokenizers library or sentencepiece, at the same path on every executor.
    Null and empty text: one piece of the end id alone. Documents longer than `room` are cut into full
    pieces and a rest; no other document is cut. Repeated rows are packed each by itself, also when their
    ids are equal. Extra columns are ignored; an empty table gives an empty table. Only the histogram of
    lengths (at most `room` numbers) and the plan made from it leave the executors; ranks within a length
    are counted in shards of about shard_rows rows, so a common length never meets in one task.
    """
    spark = docs.sparkSession
    salted = cut(token_pieces(docs, tokenizer, doc_id, text, room, end).withColumn("row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in salted.groupBy("length").agg(F.count("*").alias("n")).collect()}
    keys, starts = [], []
    sequence, seen = 0, Counter()
    for pattern, times in pack_histogram(histogram, room):
        offset = 0
        for n, each in pattern:
            keys.append((n << 44) + seen[n])
            starts.append((sequence, each, offset))
            seen[n] += times * each
            offset += n * each
        sequence += times
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    table = spark.sparkContext.broadcast((np.array(keys, dtype=np.int64)[order], np.array(starts, dtype=np.int64).reshape(-1, 3)[order]))

    shards = max(1, -(-sum(histogram.values()) // shard_rows))
    salted = salted.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    counts = salted.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")
    counts = counts.select("length", "shard", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32", "row"))
    ranked = salted.withColumn("within", within).join(counts, ["length", "shard"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within") - 1).alias("rank"))

    def place(batches):
        known, where = table.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            key = (length << 44) + rank
            at = np.searchsorted(known, key, side="right") - 1
            first, each, offset = where[at].T
            k = key - known[at]
            columns = [*(batch.column(i) for i in range(5)), pa.array(first + k // each), pa.array(offset + k % each * length)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
