"""Alignment of two tokenizers' readings of the same texts by their bytes.

Two pointers walk the tokens of a text, one for each tokenizer: the tokens they point at overlap and are linked; the pointer whose token
ends first moves on, and where both end at the same byte both move and the text is cut into groups. All texts of a batch walk in lockstep: their
pointers are two NumPy vectors, a step is a few vector operations, and walks that reach their end are taken out. A text of
more than LANE tokens walks in several places at once, each over its own LANE tokens of the first tokenizer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parchment.llm.encoding import TextEncoder, batched
from parchment.llm.op06_token_counts import worker_memo
from parchment.llm.shared import cut

LANE = 512


@dataclass(frozen=True)
class Walk:
    """Links as places of tokens in the batch (a, b: in no order), and whether a token ends a group."""

    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


def lockstep(end_a: np.ndarray, end_b: np.ndarray, docs_a: np.ndarray, lane: int = LANE) -> Walk:
    """Walk all texts of a batch. end_a, end_b: the byte at which each token ends, counted through the batch, so that both end each text
    at the same byte; docs_a: the first token of each text and the end of the last."""
    n = np.diff(docs_a)
    lanes = -(-n // lane)
    first = np.repeat(docs_a[:-1], lanes) + lane * (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    stop = np.minimum(first + lane, np.repeat(docs_a[1:], lanes))
    begin = np.where(first > 0, end_a[first - 1], 0) if len(first) else first
    at_a, at_b = first, np.searchsorted(end_b, begin, side="right")
    links_a, links_b = [], []
    cut_a, cut_b = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool)
    while len(at_a):
        links_a.append(at_a)
        links_b.append(at_b)
        ea, eb = end_a[at_a], end_b[at_b]
        both = ea == eb
        cut_a[at_a[both]] = True
        cut_b[at_b[both]] = True
        at_b = at_b + (eb <= ea)
        at_a = at_a + (ea <= eb)
        live = at_a < stop
        if not live.all():
            at_a, at_b, stop = at_a[live], at_b[live], stop[live]
    none = np.zeros(0, np.int64)
    return Walk(np.concatenate([none, *links_a]), np.concatenate([none, *links_b]), cut_a, cut_b)


@dataclass(frozen=True)
class Batch:
    """Tokens of several texts, one after the other, and their alignment."""

    a: np.ndarray
    b: np.ndarray
    docs_a: np.ndarray
    docs_b: np.ndarray
    walk: Walk

    def link_docs(self) -> np.ndarray:
        return np.searchsorted(self.docs_a, self.walk.a, side="right") - 1


def aligned(tokens_a: list[bytes], tokens_b: list[bytes], lengths_a: np.ndarray, lengths_b: np.ndarray, kind: str = "<u4") -> Batch:
    """The alignment of texts whose token ids are packed as numbers of this kind."""
    a, b = (np.frombuffer(b"".join(t), kind).astype(np.int64) for t in (tokens_a, tokens_b))
    docs_a, docs_b = (np.cumsum([0] + [len(x) // np.dtype(kind).itemsize for x in t]) for t in (tokens_a, tokens_b))
    return Batch(a, b, docs_a, docs_b, lockstep(np.cumsum(lengths_a[a]), np.cumsum(lengths_b[b]), docs_a))


def _written(ids: np.ndarray, signs: bytes) -> np.ndarray:
    """For each id and each sign before it, one row of bytes: the sign and the decimal id, zeros behind."""
    width = 1 + len(str(int(ids.max(initial=0))))
    return np.array([bytes([s]) + str(i).encode() for i in ids.tolist() for s in signs], f"S{width}").view(np.uint8).reshape(-1, width)


def group_texts(x: Batch, decimals: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """The groups of each text as `a1,a2|b1;a3|b2,b3`."""
    group_a, group_b = (np.cumsum(c) - c for c in (x.walk.cut_a, x.walk.cut_b))
    # tokens of the other side in groups up to one's own: a comes before b in each group
    ends_a, ends_b = np.r_[0, np.flatnonzero(x.walk.cut_a) + 1], np.r_[0, np.flatnonzero(x.walk.cut_b) + 1]
    place_a = np.arange(len(x.a)) + ends_b[group_a]
    place_b = np.arange(len(x.b)) + ends_a[group_b + 1] if len(x.b) else np.zeros(0, np.int64)
    new_a, new_b = (np.r_[True, c[:-1]] if len(c) else c for c in (x.walk.cut_a, x.walk.cut_b))
    width = max(d.shape[1] for d in decimals)
    rows = np.zeros((len(x.a) + len(x.b), width), np.uint8)
    rows[place_a, : decimals[0].shape[1]] = decimals[0][2 * x.a + new_a]
    rows[place_b, : decimals[1].shape[1]] = decimals[1][2 * x.b + new_b]
    seen = rows != 0
    sizes = np.r_[0, np.cumsum(seen.sum(axis=1))]
    flat = rows[seen].tobytes()
    ends = sizes[x.docs_a + x.docs_b].tolist()
    return [flat[p + 1 : q] for p, q in zip(ends, ends[1:])]  # without the sign before the first


def token_table(docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text", kind: str = "<u4") -> DataFrame:
    """row long, doc_id, a binary, b binary: the ids of a space and the text by the first tokenizer (special strings taken as text) and of the text
    by the second, which puts the space there itself, packed as numbers of this kind. Both empty for a null or empty text and where the
    bytes of either are not the space and the text."""

    def load():
        both = tuple(TextEncoder(p, plain=True, exact=True, most=400_000, space=True) for p in (first, second))
        return both, tuple(e.lengths() for e in both)

    def tokens(batches):
        (one, two), lengths = worker_memo(("aligned", first, second), load)
        for batch in batches:
            texts = batch.column(1)
            for p, q in batched(texts, pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 1 << 20):
                some = texts[p:q].to_pylist()
                found = [[np.frombuffer(x, "<u4") for x in e.packed(some)] for e in (one, two)]
                good = [bool(t) and all(int(n[x[i]].sum()) == 1 + len(t.encode()) for x, n in zip(found, lengths, strict=True)) for i, t in enumerate(some)]
                columns = [pa.array([x.astype(kind).tobytes() if ok else b"" for x, ok in zip(f, good, strict=True)], pa.binary()) for f in found]
                yield pa.RecordBatch.from_arrays([batch.column(0)[p:q], *columns], ["doc_id", "a", "b"])

    id_kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).mapInArrow(tokens, f"doc_id {id_kind}, a binary, b binary")
    return rows.select(F.monotonically_increasing_id().alias("row"), "*")


def _batches(table, columns: tuple[int, int], lengths, kind: str, most: int = 1 << 19) -> Iterator[tuple[int, int, Batch]]:
    """(from, to, alignment) of rows of a batch that together hold about `most` tokens."""
    a, b = (table.column(c) for c in columns)
    for p, q in batched(a, (pc.binary_length(a).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize).tolist(), most):
        yield p, q, aligned(a[p:q].to_pylist(), b[p:q].to_pylist(), *lengths, kind)


def pair_counts(tokens: DataFrame, lengths: tuple, kind: str) -> DataFrame:
    """a int, b int, n long: in how many rows the two ids are linked. Each task counts its rows' pairs in memory and hands on at most a
    million at a time, so a pair that all rows hold reaches the shuffle once a task."""
    n_b = len(lengths[1])

    def rows(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((pairs // n_b).astype(np.int32)), pa.array((pairs % n_b).astype(np.int32)), pa.array(n)], ["a", "b", "n"])

    def merged(held: list) -> tuple[np.ndarray, np.ndarray]:
        pairs, n = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, np.int64)
        return pairs[first], np.add.reduceat(n[order], first) if len(first) else n

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, x in _batches(batch, (0, 1), lengths, kind):
                space = len(lengths[0]) * n_b
                keys = np.unique(x.link_docs() * space + x.a[x.walk.a] * n_b + x.b[x.walk.b])
                held.append(np.unique(keys % space, return_counts=True))
                size += len(held[-1][0])
                if size > 2_000_000:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > 1_000_000:
                        yield rows(*held[0])
                        held, size = [], 0
        if held:
            yield rows(*merged(held))

    return tokens.select("a", "b").mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def alignments(docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text", links: bool = False, shape: Callable[[Column], Column] = lambda groups: groups, most: int = 2_000_000) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups string (`a1,a2|b1;a3|b2,b3`: the ids of each group; null
    without tokens), and links array<struct<a int, b int>> (places of tokens in the text, from 0, in order) if asked.

    The texts, a space before each, are read by both tokenizer files (at the same path on every executor), special strings as plain text. Tokens are
    linked where their bytes overlap; a group ends where tokens of both end. The count of a pair of ids is the number of rows that hold it linked;
    n_best counts links whose count is the largest of their first id, ties included; count_sum adds up the counts of all links.
    Null and empty texts, and texts that either tokenizer changes, have no tokens and zeros. Nulls in other columns and extra
    columns play no part; repeated rows, also of one id, are rows each for itself; an empty table gives an empty table.

    shape: what becomes of `groups` where the text itself isn't wanted, as a hash of it, so that it need not be written or shuffled.
    Counts of at most `most` pairs, the most frequent, are broadcast; links of other pairs, which few rows hold, meet their counts in a join.
    """
    spark = docs.sparkSession
    lengths = tuple(TextEncoder(p, plain=True).lengths() for p in (first, second))
    kind = "<u2" if max(map(len, lengths)) <= 1 << 16 else "<u4"
    n_b = len(lengths[1])
    tokens = cut(token_table(docs, first, second, doc_id, text, kind), "tokens")
    best = F.col("n") == F.max("n").over(Window.partitionBy("a"))  # an id's pairs: no more than the other vocabulary
    pairs = cut(pair_counts(tokens, lengths, kind).select("a", "b", "n", best.alias("best")), "pairs")
    # classes of counts, eight to a doubling: at most 512 rows; the classes from above that together hold `most` pairs are broadcast
    size = F.floor(8 * F.log2("n")).cast("int")
    least, held = 1 << 30, 0
    for r in sorted(pairs.groupBy(size.alias("size")).agg(F.count("*").alias("n")).collect(), reverse=True):
        held += r.n
        if held > most:
            break
        least = r.size
    known = pairs.where(size >= least).select((F.col("a").cast("long") * n_b + F.col("b")).alias("pair"), "n", "best").toArrow()
    order = np.argsort(known["pair"].to_numpy())
    table = spark.sparkContext.broadcast(tuple(known[c].to_numpy()[order] for c in ("pair", "n", "best")))
    everything = held <= most

    def walk(batches):
        known, counts, bests = table.value
        decimals = worker_memo(("decimals", first, second), lambda: (_written(np.arange(len(lengths[0])), b",;"), _written(np.arange(n_b), b",|")))
        for batch in batches:
            for p, q, x in _batches(batch, (2, 3), lengths, kind):
                docs = q - p
                doc, space = x.link_docs(), len(lengths[0]) * n_b
                keys, times = np.unique(doc * space + x.a[x.walk.a] * n_b + x.b[x.walk.b], return_counts=True)
                of, pair = keys // space, keys % space
                at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
                hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
                n = np.where(hit, counts[at], 0) if len(known) else np.zeros(len(pair), np.int64)
                good = hit & bests[at] if len(known) else hit
                sums, n_best = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
                np.add.at(sums, of, n * times)
                np.add.at(n_best, of[good], times[good])
                groups = np.diff(np.r_[0, np.cumsum(x.walk.cut_a)][x.docs_a])
                texts = group_texts(x, decimals)
                n_a, n_b_ = np.diff(x.docs_a), np.diff(x.docs_b)
                rest = np.flatnonzero(~hit)
                offsets = pa.array(np.searchsorted(of[rest], np.arange(docs + 1)).astype(np.int32))
                left = pa.StructArray.from_arrays([pa.array((pair[rest] // n_b).astype(np.int32)), pa.array((pair[rest] % n_b).astype(np.int32)), pa.array(times[rest])], ["a", "b", "times"])
                columns = [batch.column(0)[p:q], batch.column(1)[p:q], *(pa.array(c) for c in (n_a, n_b_, groups, np.bincount(doc, minlength=docs), n_best, sums)), pa.array([t.decode() if k else None for t, k in zip(texts, n_a.tolist(), strict=True)], pa.string()), pa.ListArray.from_arrays(offsets, left)]
                names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "rest"]
                if links:
                    order = np.lexsort((x.walk.b, x.walk.a))
                    by = np.searchsorted(doc[order], np.arange(docs + 1)).astype(np.int32)
                    places = [(w[order] - d[doc[order]]).astype(np.int32) for w, d in ((x.walk.a, x.docs_a), (x.walk.b, x.docs_b))]
                    columns.append(pa.ListArray.from_arrays(pa.array(by), pa.StructArray.from_arrays(list(map(pa.array, places)), ["a", "b"])))
                    names.append("links")
                yield pa.RecordBatch.from_arrays(columns, names)

    id_kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"row long, doc_id {id_kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, rest array<struct<a int, b int, times long>>"
    out = tokens.select("row", "doc_id", "a", "b").mapInArrow(walk, schema + (", links array<struct<a int, b int>>" if links else ""))
    out = out.withColumn("groups", shape(F.col("groups")))
    if everything:
        return out.drop("row", "rest")
    out = cut(out, "aligned")
    rest = out.select("row", F.explode("rest").alias("r")).select("row", "r.*").join(pairs.where(size < least), ["a", "b"])
    more = rest.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    out = out.drop("rest").join(more, "row", "left")
    return out.withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).drop("row", "more_sum", "more_best")
