"""Token ids in files from which any token can be read by itself.

A file holds directly addressable codes: an id is cut into chunks of 8, 4, 4, 8 and 8 bits, lowest first. Level 0 holds the first chunk of
every id and a bitmap of those that go on; level 1 the next chunk of only those, and so on. The chunk of id i on
the next level is the one numbered by the set bits before i, which a directory of counts, one for 512 bits, and the bits behind it
tell. Nothing is coded in blocks, so a token takes one chunk, one bit and one count a level to read.

All numbers are little-endian. After the magic come the sizes (ids, documents, levels), then per level its ids and the places of its
chunks, bitmap and directory, then the documents: ids, which are null, and where their tokens begin.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType
from pyspark.sql.window import Window

from parchment.llm.encoding import TextEncoder, batched
from parchment.llm.op06_token_counts import worker_memo

MAGIC = b"PARCHDAC"
WIDTHS = (8, 4, 4, 8, 8)
STEP = 512  # bits for which the directory holds one count
HEAD = struct.Struct("<8sQQQ")
LEVEL = struct.Struct("<QQQQ")


def _chunks(values: np.ndarray, width: int) -> bytes:
    low = (values & ((1 << width) - 1)).astype(np.uint8)
    if width == 8:
        return low.tobytes()
    low = np.r_[low, np.zeros(len(low) % 2, np.uint8)]
    return (low[::2] | (low[1::2] << 4)).tobytes()


def encode_file(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray) -> bytes:
    """The bytes of a file: ids (unsigned 32 bits) of documents that begin at `starts`."""
    levels, left = [], ids.astype(np.uint32)
    for width in WIDTHS:
        rest = left >> np.uint32(width) if width < 32 else np.zeros_like(left)
        goes_on = rest != 0
        bits = np.packbits(goes_on, bitorder="little")
        per_step = np.add.reduceat(goes_on, np.arange(0, len(left), STEP), dtype=np.int64) if len(left) else np.zeros(0, np.int64)
        directory = np.r_[0, np.cumsum(per_step)].astype("<u4")
        levels.append((len(left), _chunks(left, width), bits.tobytes(), directory.tobytes()))
        left = rest[goes_on]
        if not len(left):
            break
    docs = b"".join((np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes(), starts.astype("<u8").tobytes()))
    at = HEAD.size + LEVEL.size * len(levels)
    table, body = [], []
    for n, *parts in levels:
        places = []
        for part in parts:
            places.append(at)
            body.append(part)
            at += len(part)
        table.append(LEVEL.pack(n, *places))
    return b"".join((HEAD.pack(MAGIC, len(ids), len(doc_ids), len(levels)), *table, *body, docs))


class TokenFile:
    """A file read in place: read(at, n) gives n of its bytes. Only what is asked for is read, besides the sizes."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        magic, self.n_ids, self.n_docs, n_levels = HEAD.unpack(read(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        table = read(HEAD.size, LEVEL.size * n_levels)
        self.levels = [LEVEL.unpack_from(table, LEVEL.size * k) for k in range(n_levels)]
        last_n, _, _, last_directory = self.levels[-1]
        self.docs_at = last_directory + 4 * (-(-last_n // STEP) + 1)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """Ids of the documents, and where each begins and the last ends."""
        n = self.n_docs
        data = self.read(self.docs_at, 17 * n)
        ids, null = np.frombuffer(data, "<i8", n).tolist(), np.frombuffer(data, np.uint8, n, 8 * n)
        starts = np.frombuffer(data, "<u8", n, 9 * n).astype(np.int64)
        return [None if x else i for i, x in zip(ids, null, strict=True)], np.r_[starts, self.n_ids]

    def _bits(self, level: int, a: int, b: int) -> np.ndarray:
        first = a >> 3
        data = self.read(self.levels[level][2] + first, ((b + 7) >> 3) - first)
        return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[a - 8 * first : b - 8 * first].view(bool)

    def rank(self, level: int, i: int) -> int:
        """Set bits before bit i."""
        step = i // STEP
        (count,) = struct.unpack("<I", self.read(self.levels[level][3] + 4 * step, 4))
        return count + int(np.count_nonzero(self._bits(level, step * STEP, i)))

    def _range(self, level: int, a: int, b: int) -> np.ndarray:
        """Elements a to b of a level, with what the levels behind it add."""
        width, at = WIDTHS[level], self.levels[level][1]
        if width == 8:
            out = np.frombuffer(self.read(at + a, b - a), np.uint8).astype(np.uint32)
        else:
            pairs = np.frombuffer(self.read(at + (a >> 1), ((b + 1) >> 1) - (a >> 1)), np.uint8)
            out = np.stack((pairs & 15, pairs >> 4), axis=1).ravel()[a & 1 :][: b - a].astype(np.uint32)
        if level + 1 < len(self.levels):
            more = self._bits(level, a, b)
            n = int(np.count_nonzero(more))
            if n:
                first = self.rank(level, a)
                out[more] |= self._range(level + 1, first, first + n) << np.uint32(width)
        return out

    def tokens(self, a: int, b: int) -> np.ndarray:
        """Ids a to b of the file, unsigned 32 bits."""
        if not 0 <= a <= b <= self.n_ids:
            raise IndexError((a, b))
        return self._range(0, a, b) if a < b else np.zeros(0, np.uint32)

    def token(self, i: int) -> int:
        return int(self.tokens(i, i + 1)[0])


def _store(path: str):
    """File system and path in it; a path without a scheme is local."""
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def open_file(path: str, whole: bool = False) -> TokenFile:
    """A file of any store that pyarrow reads. whole: fetch it once, for those who read most of it."""
    store, at = _store(path)
    source = store.open_input_file(at)
    if not whole:
        return TokenFile(lambda at, n: source.read_at(n, at))
    data = memoryview(source.read())
    source.close()
    return TokenFile(lambda at, n: data[at : at + n])


def write_tokens(docs: DataFrame, tokenizer: str, path: str, doc_id: str = "doc_id", text: str = "text", end: int = 0, ids_per_file: int = 1 << 24) -> None:
    """Write the ids of all texts, `end` after each, to files under `path`, in ascending order of doc_id: nulls first, rows of equal id by a hash of
    their texts. `path`/files lists the files: part, k (order), name, n_ids, n_docs.

    tokenizer: a file for the tokenizers library or sentencepiece, at the same path on every executor; special strings inside texts are
    tokens. doc_id: whole numbers. Null and empty texts have the end id alone. Repeated rows are written each by itself, extra columns not at
    all; an empty table gives no file. A document lies in one file, which holds `ids_per_file` ids or little more. Files are written under
    another name and renamed, and only files of tasks that ended are listed, so a task that runs again does no harm.
    """
    if not isinstance(docs.schema[doc_id].dataType, ByteType | ShortType | IntegerType | LongType):
        raise TypeError(f"{doc_id} must be a column of whole numbers")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), F.col(text).alias("t"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "t").select("doc_id", "t")

    def write(batches):
        encoder = worker_memo(("texts", tokenizer), lambda: TextEncoder(tokenizer))
        store, folder = _store(path)
        store.create_dir(folder, recursive=True)
        part, tail = TaskContext.get().partitionId(), np.array([end], "<u4").tobytes()
        held: list[bytes] = []
        keys: list[int | None] = []
        size, k = 0, 0

        def put() -> pa.RecordBatch:
            starts = np.cumsum([0] + [len(x) // 4 for x in held])
            data = encode_file(np.frombuffer(b"".join(held), "<u4"), keys, starts[:-1])
            name = f"tokens-{part:06d}-{k:06d}-{uuid.uuid4().hex}.dac"
            with store.open_output_stream(f"{folder}/.{name}") as out:
                out.write(data)
            store.move(f"{folder}/.{name}", f"{folder}/{name}")
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "k": pa.array([k], pa.int32()), "name": [name], "n_ids": pa.array([int(starts[-1])], pa.int64()), "n_docs": pa.array([len(keys)], pa.int64())})

        for batch in batches:
            texts = batch.column(1)
            for a, b in batched(texts, pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 1 << 22):
                for key, ids in zip(batch.column(0)[a:b].to_pylist(), encoder.packed(texts[a:b].to_pylist()), strict=True):
                    if size and size + len(ids) // 4 >= ids_per_file:
                        yield put()
                        held, keys, size, k = [], [], 0, k + 1
                    held.append(ids + tail)
                    keys.append(key)
                    size += len(ids) // 4 + 1
        if keys:
            yield put()

    ordered.mapInArrow(write, "part int, k int, name string, n_ids long, n_docs long").write.parquet(f"{path}/files")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document written to `path`: doc_id, start long (ids of all documents before it), n_tokens long, ids_crc32 long (of its ids
    as unsigned little-endian 32-bit numbers), and ids (array) if with_ids. Each task reads whole files, no more."""
    files = spark.read.schema("part int, k int, name string, n_ids long, n_docs long").parquet(f"{path}/files")
    sums = sorted((r.part, r.n, r.files) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n"), F.count("*").alias("files")).collect())
    before, total = [], 0
    for part, n, _ in sums:
        before.append((part, total))
        total += n
    firsts = spark.createDataFrame(before, "part int, before long")  # one row per task of the writing job
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = max(1, min(sum(f for _, _, f in sums), 4 * spark.sparkContext.defaultParallelism))
    placed = files.join(F.broadcast(firsts), "part").select("name", (F.col("before") + within).alias("first")).repartition(tasks)

    def read(batches):
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = open_file(f"{path}/{name}", whole=True)
                keys, starts = file.documents()
                for a, b in batched(keys, np.diff(starts).tolist(), 1 << 20):
                    ids = [file.tokens(x, y) for x, y in zip(starts[a:b].tolist(), starts[a + 1 : b + 1].tolist(), strict=True)]
                    out = {"doc_id": pa.array(keys[a:b], pa.int64()), "start": pa.array(starts[a:b] + first), "n_tokens": pa.array(np.diff(starts[a : b + 1])), "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())}
                    if with_ids:
                        out["ids"] = pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))
