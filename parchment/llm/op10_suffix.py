"""Exact substring dedup with suffix arrays: every byte covered by a `span`-byte string that also starts
somewhere else goes.

Shards are made by content. The smallest hash among the GRAM-byte substrings of a string of `span` bytes is a
function of that string, so equal strings carry equal hashes: a document is cut into runs of starts with the
same smallest hash, and only runs whose hash occurs elsewhere go on, each with the bytes of its strings, to the shard of
that hash. A shard sorts the suffixes of its distinct runs (Larsson-Sadakane), computes common prefixes (Kasai)
and finds strings that start twice. A hash with too many runs for one shard is split into parts; parts are
merged two by two: each suffix of one is located in the suffix array of the other by binary search.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.op06_token_counts import as_bytes
from parchment.llm.shared import cut, row_key

GRAM = 24
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
TOP = np.iinfo(np.uint64).max


def gram_hashes(t: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte substrings, by doubling."""
    h = (t.astype(np.uint64) + np.uint64(1)) * A
    h ^= h >> np.uint64(29)
    h2 = h[:-1] * B + h[1:]
    h4 = h2[:-2] * C + h2[2:]
    h8 = h4[:-4] * A + h4[4:]
    h16 = h8[:-8] * B + h8[8:]
    out = h16[:-8] * C + h8[16:]
    out ^= out >> np.uint64(31)
    out *= B
    out ^= out >> np.uint64(27)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` numbers in a row: running minima forwards and backwards in blocks of that width."""
    n = len(x)
    rows = -(-n // width)
    y = np.full(rows * width, TOP, np.uint64)
    y[:n] = x
    y = y.reshape(rows, width)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs_of(data: np.ndarray, ends: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Runs of starts with equal smallest hash in documents that lie one after the other: document, first and last
    start (within the document), hash, and how often that hash occurs in the run."""
    none = tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    begins = np.r_[0, ends[:-1]]
    long = np.flatnonzero(ends - begins >= span)
    if not len(long):
        return none
    g = gram_hashes(data)
    width = span - GRAM + 1
    m = sliding_min(g, width)
    counts = (ends - begins)[long] - span + 1
    doc = np.repeat(long, counts)
    s = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[doc]
    h = m[s]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(s)] - 1
    d, s0, s1, h = doc[first], s[first], s[last], h[first]
    # a gram is the smallest of some string that holds it if it equals the largest of their minima; few are
    low = np.zeros(len(g) + width - 1, np.uint64)
    low[width - 1 : width - 1 + len(m)] = m
    place = np.flatnonzero(g == ~sliding_min(~low, width))
    lo, hi = np.searchsorted(place, s0), np.searchsorted(place, s1 + width)
    n = hi - lo
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    often = np.bincount(np.repeat(np.arange(len(h)), n), g[place[at]] == np.repeat(h, n), len(h)).astype(np.int64)
    return d, s0 - begins[d], s1 - begins[d], h, often


def suffix_array(t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array, ranks and the 8 bytes at each place, by Larsson-Sadakane refinement: suffixes are sorted by 8 bytes,
    then groups that are still equal, and only these, by the rank of what follows after 8, 16, 32 ... bytes."""
    n = len(t)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = t
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    sa = np.argsort(key)
    ordered = key[sa]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, n])
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(first, sizes)
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))
    h = 8
    while len(slots) and h < n:
        at = sa[slots]
        after = at + h
        both = rank[at] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(both)
        at, both = at[order], both[order]
        sa[slots] = at
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        sizes = np.diff(np.r_[first, len(at)])
        rank[at] = np.repeat(slots[first], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        h *= 2
    return sa, rank, key


def same_bytes(x: np.ndarray) -> np.ndarray:
    """Number of equal leading bytes of two 8-byte words, given their exclusive or."""
    out = np.zeros(len(x), np.int64)
    for bits in range(8, 65, 8):
        out += x < np.uint64(1 << (64 - bits)) if bits < 64 else x == 0
    return out


def common_prefixes(key: np.ndarray, sa: np.ndarray, most: int, lanes: int = 4096) -> np.ndarray:
    """Kasai's algorithm, up to `most` bytes: lcp[r] of sa[r] and sa[r - 1]. Places are walked in text order in many
    lanes at once; in each the common length falls by at most one from a place to the next."""
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    lcp = np.zeros(n, np.int64)
    step = -(-n // lanes)
    padded = np.r_[key, np.zeros(most + 8, np.uint64)]
    begin = np.arange(0, n, step)
    length = np.zeros(len(begin), np.int64)
    for k in range(step):
        place = begin + k
        live = np.flatnonzero(place < n)
        p, length = place[live], np.maximum(length[live] - 1, 0)
        begin = begin[live]
        j = before[p]
        length[j < 0] = 0
        todo = np.flatnonzero((j >= 0) & (length < most))
        while len(todo):
            more = same_bytes(padded[p[todo] + length[todo]] ^ padded[j[todo] + length[todo]])
            length[todo] += more
            todo = todo[(more == 8) & (length[todo] < most)]
        length = np.minimum(np.minimum(length, most), n - np.maximum(p, j))
        lcp[p] = length
    return lcp[sa]


def _laid(segments: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments one after the other: bytes, owner of each place, and whether a string starts there."""
    lens = np.array([len(s) for s in segments], np.int64)
    t = np.frombuffer(b"".join(segments), np.uint8)
    owner = np.repeat(np.arange(len(segments)), lens)
    left = np.repeat(np.cumsum(lens), lens) - np.arange(len(t))
    return t, owner, left >= span


def repeated_starts(segments: list[bytes], times: np.ndarray, span: int) -> np.ndarray:
    """Over all places of the segments laid in a row: does a string of `span` bytes start here that starts twice or more,
    a segment counting `times` times?"""
    t, owner, valid = _laid(segments, span)
    sa, _, key = suffix_array(t)
    lcp = common_prefixes(key, sa, span)
    group = np.cumsum(lcp < span)
    weight = np.bincount(group, np.where(valid[sa], times[owner[sa]], 0))
    out = np.zeros(len(t), bool)
    out[sa] = valid[sa] & (weight[group] >= 2)
    return out


def found_in(segments: list[bytes], others: list[bytes], span: int) -> np.ndarray:
    """Cross-shard merge: for all places of `segments`, does the string that starts here also start in `others`? Each is
    located in the suffix array of the others by binary search over `span` bytes, 8 at a time."""
    t, _, valid = _laid(segments, span)
    u, _, valid_u = _laid(others, span)
    sa, _, key_u = suffix_array(u)
    sa = sa[valid_u[sa]]
    padded = np.zeros(len(t) + 8, np.uint64)
    padded[: len(t)] = t
    key_t = np.zeros(len(t), np.uint64)
    for i in range(8):
        key_t = (key_t << np.uint64(8)) | padded[i : i + len(t)]
    steps = [*range(0, span - 7, 8), *([span - 8] if span % 8 else [])]
    want = np.flatnonzero(valid)

    def compare(places: np.ndarray, at: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(places), np.int64), np.arange(len(places))
        for k in steps:
            x, y = key_t[places[todo] + k], key_u[sa[at[todo]] + k]
            out[todo[x < y]] = -1
            out[todo[x > y]] = 1
            todo = todo[x == y]
            if not len(todo):
                break
        return out

    lo, hi = np.zeros(len(want), np.int64), np.full(len(want), len(sa), np.int64)
    hit = np.zeros(len(want), bool)
    todo = np.arange(len(want)) if len(sa) else np.zeros(0, np.int64)
    while len(todo):
        mid = (lo[todo] + hi[todo]) // 2
        c = compare(want[todo], mid)
        hit[todo[c == 0]] = True
        hi[todo[c < 0]] = mid[c < 0]
        lo[todo[c > 0]] = mid[c > 0] + 1
        todo = todo[(c != 0) & (lo[todo] < hi[todo])]
    out = np.zeros(len(t), bool)
    out[want[hit]] = True
    return out


def spans_of(marks: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by strings that start at the marked places."""
    at = np.flatnonzero(marks)
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > span)
    return list(zip(at[np.r_[0, cuts + 1]].tolist(), (at[np.r_[cuts, len(at) - 1]] + span).tolist(), strict=True))


def shard_repeats(hashes: list[int], segments: list[bytes], span: int, parts: list[int] | None = None) -> list[list[tuple[int, int]]]:
    """For each segment of a shard the byte ranges to remove. parts: of a split hash, which of the two parts a segment is in; then
    only strings that occur in both count (each part by itself is another shard's work)."""
    distinct: dict[bytes, int] = {}
    which = [distinct.setdefault(s, len(distinct)) for s in segments]
    unique = list(distinct)
    lens = np.array([len(s) for s in unique], np.int64)
    if parts is not None:
        inside = [sorted({w for w, p in zip(which, parts, strict=True) if p == k}) for k in (0, 1)]
        marks: dict[tuple[int, int], np.ndarray] = {}
        for k in (0, 1):
            mine, other = [unique[i] for i in inside[k]], [unique[i] for i in inside[1 - k]]
            got = found_in(mine, other, span) if mine and other else np.zeros(sum(map(len, mine)), bool)
            for i, part in zip(inside[k], np.split(got, np.cumsum([len(s) for s in mine])[:-1]) if mine else [], strict=True):
                marks[k, i] = part
        return [spans_of(marks[p, w], span) for w, p in zip(which, parts, strict=True)]
    times = np.bincount(np.array(which, np.int64), minlength=len(unique))
    of_hash: dict[int, set[int]] = {}
    for h, w in zip(hashes, which, strict=True):
        of_hash.setdefault(h, set()).add(w)
    # alone under its hash and repeated: all its strings are; alone and single but periodic, or not alone: sort
    sort = sorted({w for ws in of_hash.values() if len(ws) > 1 for w in ws} | {w for ws in of_hash.values() if len(ws) == 1 for w in ws if times[w] == 1})
    out: list[list[tuple[int, int]]] = [[(0, int(n))] if times[i] > 1 else [] for i, n in enumerate(lens)]
    if sort:
        got = repeated_starts([unique[i] for i in sort], times[sort], span)
        for i, part in zip(sort, np.split(got, np.cumsum(lens[sort])[:-1]), strict=True):
            out[i] = spans_of(part, span)
    return [out[w] for w in which]


def duplicate_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = 200, shard_bytes: int = 4_000_000, hot: int = 12_000) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, d, e, t), dealt by their row key d, e, and the byte ranges (d, e, a, b) that repeated strings cover. Of a hash
    with more than `hot` runs or 2 * shard_bytes bytes the runs are dealt to parts."""
    d, e = row_key(docs, doc_id, text)
    base = docs.select(F.col(doc_id).alias("doc_id"), d.alias("d"), e.alias("e"), as_bytes(text).alias("t"))

    def scan(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                column = batch.column(2)
                lens = np.fromiter(map(len, column.to_pylist()), np.int64, len(column))
                at = 0
                while at < len(lens):  # about a quarter of a megabyte at a time stays in the processor's cache
                    to = at + max(1, int(np.searchsorted(np.cumsum(lens[at:]), 1 << 18, side="right")))
                    data = np.frombuffer(b"".join(column[at:to].to_pylist()), np.uint8)
                    doc, s0, s1, h, often = runs_of(data, np.cumsum(lens[at:to]), span)
                    key = pa.array(doc + at)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(key), batch.column(1).take(key), pa.array(h.view(np.int64)), pa.array(s0.astype(np.int32)), pa.array(s1.astype(np.int32)), pa.array(np.minimum(often, 2).astype(np.int32))], ["d", "e", "h", "s0", "s1", "often"])
                    at = to

    runs = base.where(F.octet_length("t") >= span).select("d", "e", "t").mapInArrow(scan, "d long, e long, h long, s0 int, s1 int, often int")
    again = runs.groupBy("h").agg(F.sum("often").alias("c"), F.sum(F.col("s1") - F.col("s0") + span).alias("bytes")).where("c > 1")
    parts = F.greatest(F.ceil(F.col("c") / hot), F.ceil(F.col("bytes") / (2 * shard_bytes))).cast("int")
    mine = runs.select("d", "e", "h", "s0", "s1").join(again.select("h", parts.alias("parts")), "h")
    # a set: rows with the same key have the same runs, which each of them gets once
    mine = cut(mine.groupBy("d", "e").agg(F.collect_set(F.struct("h", "s0", "s1", "parts")).alias("runs")), "runs")
    total = mine.agg(F.sum(F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r.s1 - r.s0 + span))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    dealt = base.repartition("d", "e")

    def segments(batches):
        for batch in batches:
            row, h, s0, n, seg = [], [], [], [], []
            for i, (t, rows) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                t = t.as_py()
                for r in rows.as_py():
                    row.append(i)
                    h.append(r["h"])
                    s0.append(r["s0"])
                    n.append(r["parts"])
                    seg.append(t[r["s0"] : r["s1"] + span])
            key = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(key), batch.column(1).take(key), pa.array(h, pa.int64()), pa.array(s0, pa.int32()), pa.array(n, pa.int32()), pa.array(seg, pa.binary())], ["d", "e", "h", "s0", "parts", "seg"])

    pieces = dealt.join(mine, ["d", "e"]).select("d", "e", "t", "runs").mapInArrow(segments, "d long, e long, h long, s0 int, parts int, seg binary")
    part = F.pmod(F.xxhash64("d", "e", "s0"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(part, k).alias("i"), F.greatest(part, k).alias("j")))
    cold = pieces.where("parts = 1").select(F.pmod("h", F.lit(shards)).alias("g"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(-1).alias("p"), "d", "e", "h", "s0", "seg")
    split = pieces.where("parts > 1").select("d", "e", "h", "s0", "seg", part.alias("p"), F.explode(pairs).alias("pair")).select(F.col("h").alias("g"), "pair.i", "pair.j", "p", "d", "e", "h", "s0", "seg")

    def work(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        by_part = [int(p == j) for p in table["p"].to_pylist()] if i != j else None
        got = shard_repeats(table["h"].to_pylist(), table["seg"].to_pylist(), span, by_part)
        row, a, b = [], [], []
        for k, (at, ranges) in enumerate(zip(table["s0"].to_pylist(), got, strict=True)):
            for x, y in ranges:
                row.append(k)
                a.append(at + x)
                b.append(at + y)
        key = pa.array(row, pa.int64())
        return pa.table({"d": table["d"].take(key), "e": table["e"].take(key), "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32())})

    return dealt, cold.unionByName(split).groupBy("g", "i", "j").applyInArrow(work, "d long, e long, a int, b int")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = 200, keep_text: bool = False, **options) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes long, n_removed long, n_spans long, kept_sha256 string, and kept binary (what is left)
    if keep_text. A byte goes if a `span`-byte string that covers it also starts elsewhere, in this or another
    document; all occurrences go. Strings never cross documents.

    Null text counts as empty; texts shorter than `span` keep every byte. Rows with null or equal ids are documents each for
    itself (see row_key): copies of each other lose what they hold, others only what repeats.
    Extra columns are ignored; an empty table gives an empty table.
    """
    dealt, found = duplicate_spans(docs, doc_id, text, span, **options)
    ranges = found.groupBy("d", "e").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    kind = docs.schema[doc_id].dataType.simpleString()

    def strip(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for t, ranges in zip(batch.column(1), batch.column(2), strict=True):
                t, merged = t.as_py(), []
                for a, b in sorted((r["a"], r["b"]) for r in ranges.as_py() or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                at, kept = 0, []
                for a, b in merged:
                    kept.append(t[at:a])
                    at = b
                rest = b"".join([*kept, t[at:]])
                for column, value in zip(out, (len(t), len(t) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), rest if keep_text else None), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    rows = dealt.join(ranges, ["d", "e"], "left").select("doc_id", "t", "ranges")
    out = rows.mapInArrow(strip, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_text else out.drop("kept")
