"""Near-duplicates by fast similarity sketching: in each round every element of the set of shingles is hashed into one
bin; a bin keeps its smallest (round, value). Rounds end once every bin is filled; from round t on all
elements fall into one bin per round, so 2t rounds always fill the sketch, and as each of the first rounds samples
without replacement, the share of equal bins is concentrated around the Jaccard similarity. Sketches are banded,
and links are confirmed on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.op06_token_counts import as_bytes, worker_memo
from parchment.llm.shared import Memo, components, cut, portions

BANDS, ROWS = 32, 7  # at similarity 0.85 a pair is missed with chance (1 - 0.85^7)^32 = 4e-6
A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def scramble(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * B
    x = (x ^ (x >> np.uint64(27))) * C
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, memo: Memo, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `width` words; a shorter text is one shingle of its own."""
    words = text.lower().split()  # on bytes: A-Z only, ASCII white space
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    k = min(width, n)
    out = h[: n - k + 1].copy()
    for i in range(1, k):
        out = out * A + h[i : n - k + 1 + i]
    return np.unique(scramble(out + np.uint64(k)))


def sketch(items: np.ndarray, t: int) -> np.ndarray:
    """The filled bins of a non-empty set: the round in the upper 16 bits, the value below."""
    bins = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    n, at = len(items), 0
    while at < 2 * t:
        end = min(at + max(1, 2 * t // n), t if at < t else 2 * t)
        rounds = np.arange(at, end, dtype=np.uint64)[:, None]
        h = scramble(items[None] + (rounds + np.uint64(1)) * A)
        value = (rounds << np.uint64(48)) | (h >> np.uint64(16))
        if at < t:
            np.minimum.at(bins, (scramble(h) % np.uint64(t)).ravel(), value.ravel())
        else:
            bins[at - t : end - t] = np.minimum(bins[at - t : end - t], value.min(1))
        if bins.max() >> np.uint64(48) != np.uint64(0xFFFF):
            break
        at = end
    return bins


def band_keys(items: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = sketch(items, bands * rows).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * C
    for i in range(rows):
        key = scramble(key * A + s[:, i])
    return key.view(np.int64)


def word_memo() -> Memo:
    return worker_memo(("words",), lambda: Memo(xxhash.xxh3_64_intdigest))


def sketched(docs: DataFrame, doc_id: str, text: str, bands: int, rows: int) -> DataFrame:
    """doc_id, h long (of the text), n_shingles long, digest binary (of the set; null if empty), bands array<long>."""

    def run(batches):
        memo = word_memo()
        with np.errstate(over="ignore"):
            for batch in portions(batches, 1):
                n, digest, keys = [], [], []
                for t in batch.column(1):
                    items = shingle_set(t.as_py(), memo)
                    n.append(len(items))
                    digest.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                    keys.append(band_keys(items, bands, rows) if len(items) else np.zeros(0, np.int64))
                    memo.trim()
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "h", "n_shingles", "digest", "bands"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), as_bytes(text).alias("t"), text_hash(text).alias("h")).mapInArrow(run, "doc_id long, h long, n_shingles long, digest binary, bands array<long>")


def text_hash(text: str) -> Column:
    """Tells texts of one id apart."""
    return F.xxhash64(F.col(text).cast("binary"))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity. texts(id, text)."""
    left = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches):
        memo, last = word_memo(), (None, None)
        with np.errstate(over="ignore"):
            for batch in portions(batches, 2, 3):
                keep = []
                for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    if last[0] != a:
                        last = a, shingle_set(ta.as_py(), memo)
                    x, y = last[1], shingle_set(tb.as_py(), memo)
                    memo.trim()
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def spanning(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As few pairs (member, smallest member) as connect what the pairs u, v of numbers below n connect."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        if (low == label[u]).all() and (low == label[v]).all():
            moved = np.flatnonzero(label != np.arange(n))
            return moved, label[moved]
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        label = np.minimum(label, label[label])


def block_links(gaps: tuple[list[np.ndarray], list[np.ndarray]], sizes: tuple[np.ndarray, np.ndarray], pivot: int, comp: tuple[np.ndarray, np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of side 0 and side 1 that are linked and in different components. gaps: of each document, what it and the family's
    pivot (of `pivot` shingles) do not share; sizes: of its own set. With k shingles in the pivot, two documents share
    k0 + k1 - pivot and what their gaps share. The latter is at most what each gap shares with the whole other side, which
    settles most pairs; for the rest it is a product of rows of the incidence matrix, exact in blocks of 2048 columns."""
    lens = [np.array([len(g) for g in gs], np.int64) for gs in gaps]
    flat = [np.concatenate([*gs, np.zeros(0, np.int64)]) for gs in gaps]
    row = [np.repeat(np.arange(len(n)), n) for n in lens]
    inside = [np.isin(flat[0], flat[1]), np.isin(flat[1], flat[0])]
    most = [np.bincount(r[i], minlength=len(n)) for r, i, n in zip(row, inside, lens, strict=True)]
    k = [(size + pivot - n) // 2 for size, n in zip(sizes, lens, strict=True)]
    base = k[0][:, None] + k[1][None] - pivot
    need = -(-percent * (sizes[0][:, None] + sizes[1][None]) // (100 + percent)) - base  # shared in the gaps, at least
    open_pairs = (need <= np.minimum(most[0][:, None], most[1][None])) & (comp[0][:, None] != comp[1][None])
    at = [np.flatnonzero(open_pairs.any(1)), np.flatnonzero(open_pairs.any(0))]
    if not len(at[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = [np.full(len(n), -1) for n in lens]
    cells = []
    for side in (0, 1):
        place[side][at[side]] = np.arange(len(at[side]))
        own = inside[side] & (place[side][row[side]] >= 0)
        cells.append((place[side][row[side][own]], flat[side][own]))
    known = np.intersect1d(cells[0][1], cells[1][1])
    common = np.zeros((len(at[0]), len(at[1])), np.int64)
    for first in range(0, len(known), 2048):
        part = known[first : first + 2048]
        ones = []
        for side in (0, 1):
            r, v = cells[side]
            c = np.minimum(np.searchsorted(part, v), len(part) - 1)
            hit = part[c] == v
            m = np.zeros((len(at[side]), len(part)), np.float32)
            m[r[hit], c[hit]] = 1
            ones.append(m)
        common += (ones[0] @ ones[1].T).astype(np.int64)
    grid = np.ix_(*at)
    i, j = np.nonzero(open_pairs[grid] & (common >= need[grid]))
    return at[0][i], at[1][j]


def gaps_to_pivot(docs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """docs(family, doc, comp, pivot) -> (family, doc, comp, pivot, n, pivot_n, near, gap): sizes of both sets, whether they are linked, and
    the shingles that only one of them has."""
    own = docs.join(texts.select(F.col("id").alias("doc"), "text"), "doc")
    many = docs.groupBy("pivot").agg(F.count("*").alias("n"))
    pivots = many.join(texts.select(F.col("id").alias("pivot"), F.col("text").alias("pivot_text")), "pivot")
    # pivots of more than one document in 256 are at most 256, and those of up to 64 KB 16 MB: their documents stay where they are
    hot = (F.col("n") > docs.count() // 256) & (F.octet_length("pivot_text") <= 65_536)
    some = own.join(F.broadcast(pivots.where(hot).drop("n")), "pivot", "left")
    rest = some.where("pivot_text is null").drop("pivot_text").join(pivots.where(~hot).drop("n"), "pivot")
    both = some.where("pivot_text is not null").unionByName(rest).select("family", "doc", "comp", "pivot", "text", "pivot_text")

    def run(batches):
        memo, last = word_memo(), (None, None)
        with np.errstate(over="ignore"):
            for batch in portions(batches, 4, 5):
                n, m, near, gap = [], [], [], []
                for pivot, t, p in zip(batch.column(3).to_pylist(), batch.column(4), batch.column(5), strict=True):
                    if last[0] != pivot:
                        last = pivot, shingle_set(p.as_py(), memo)
                    x = shingle_set(t.as_py(), memo)
                    memo.trim()
                    apart = np.setxor1d(x, last[1], assume_unique=True)
                    common = (len(x) + len(last[1]) - len(apart)) // 2
                    n.append(len(x))
                    m.append(len(last[1]))
                    near.append(100 * common >= percent * (len(x) + len(last[1]) - common))
                    gap.append(apart.view(np.int64))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(near, pa.bool_()), pa.array(gap, pa.list_(pa.int64()))], ["family", "doc", "comp", "pivot", "n", "pivot_n", "near", "gap"])

    return both.mapInArrow(run, "family long, doc long, comp long, pivot long, n long, pivot_n long, near boolean, gap array<long>")


def family_links(rows: DataFrame, texts: DataFrame, percent: int, part_docs: int, part_items: int) -> DataFrame:
    """Links between different components of each family. rows(doc, comp, deg, top): documents and a document of their bucket. Every
    document is compared with the family's pivot, that of the largest degree. What is near the pivot is one component; the rest
    is compared with it and within itself by the gaps to the pivot, in blocks of two parts of part_docs documents and part_items
    shingles: the texts are read once, and a gap is a fraction of a set."""
    families = components(rows.select(F.col("doc").alias("a"), F.col("top").alias("b"))).withColumnRenamed("component", "family")
    docs = rows.select("doc", "comp", "deg").distinct().join(families, F.col("doc") == F.col("id")).select("family", "doc", "comp", "deg")
    pivots = docs.groupBy("family").agg(F.max(F.struct("deg", "doc")).alias("top")).select("family", F.col("top.doc").alias("pivot"))
    gaps = cut(gaps_to_pivot(docs.join(pivots, "family").select("family", "doc", "comp", "pivot"), texts, percent), "gaps")
    to_pivot = gaps.where("near and doc <> pivot").select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b"))
    sizes = gaps.groupBy("family", "comp").agg(F.max("near").alias("big"), F.count("*").alias("docs"), F.sum(F.size("gap")).alias("items"))
    parts = lambda big: F.greatest(F.ceil(F.sum(F.when(F.col("big") == big, F.col("docs"))) / part_docs), F.ceil(F.sum(F.when(F.col("big") == big, F.col("items"))) / part_items), F.lit(1)).cast("int")
    counts = sizes.groupBy("family").agg(parts(True).alias("nb"), parts(False).alias("nr"), F.max(~F.col("big")).alias("open")).where("open")
    own = F.pmod(F.xxhash64("doc"), F.when(F.col("big"), F.col("nb")).otherwise(F.col("nr"))).cast("int")
    docs = gaps.join(sizes.select("family", "comp", "big"), ["family", "comp"]).join(counts, "family").withColumn("own", own)
    block = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    across = F.when(F.col("big"), F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda j: block("x", F.col("own"), j, F.lit(0)))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda i: block("x", i, F.col("own"), F.lit(1))))
    within = F.when(F.col("big"), F.array().cast("array<struct<kind:string,i:int,j:int,side:int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda k: block("r", F.least("own", k), F.greatest("own", k), (k < F.col("own")).cast("int"))))
    comp = F.when(F.col("big"), F.lit(-1)).otherwise(F.col("comp"))
    dealt = docs.select("family", "doc", comp.alias("comp"), "n", "pivot_n", "gap", F.explode(F.concat(across, within)).alias("b")).select("family", "b.kind", "b.i", "b.j", "b.side", "doc", "comp", "n", "pivot_n", "gap")

    def work(table: pa.Table) -> pa.Table:
        side, alone = table["side"].to_numpy(), table["kind"][0].as_py() == "r" and table["i"][0] == table["j"][0]
        masks = [np.ones(len(side), bool)] * 2 if alone else [side == 0, side == 1]
        doc, comp, n = (table[c].to_numpy() for c in ("doc", "comp", "n"))
        column = table["gap"].combine_chunks()
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
        every = [flat[a:b] for a, b in zip(ends, ends[1:])]
        at = [np.flatnonzero(m) for m in masks]
        i, j = block_links(tuple([every[k] for k in own] for own in at), tuple(n[own] for own in at), table["pivot_n"][0].as_py(), tuple(comp[own] for own in at), percent)
        a, b = spanning(at[0][i], at[1][j], len(doc))
        a, b = doc[a], doc[b]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return to_pivot.unionByName(dealt.groupBy("family", "kind", "i", "j").applyInArrow(work, "a long, b long"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85, bands: int = BANDS, rows: int = ROWS, part_docs: int = 2_000, part_items: int = 1_000_000, detail: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles long, component_id long, kept boolean; with `detail` also text_hash long (see
    text_hash) and group long (a number of its own for each component; null where nothing is linked: no shingles or no id).

    Equal sets form one class, which goes on under a number of its own. In each bucket (classes that share a band) all are
    compared with the one that shares most bands with others, so a bucket of any size costs its length. Buckets that
    then still hold several components are joined into families, and within a family all documents of different
    components are compared by what they do not share with the family's pivot (see family_links). Every pair that
    shares a band is thus either confirmed, refuted or already connected.

    Null and empty texts have no shingles and link with nothing; texts of fewer than five words are one
    shingle. Rows with equal ids are documents each for itself; of a component the smallest id is named, and all its rows with
    that id are kept. A null id is a component of its own (null). doc_id must be
    whole numbers. Extra columns are ignored; an empty table gives an empty table.
    """
    all_docs = cut(sketched(docs, doc_id, text, bands, rows), "sketches")
    classes = all_docs.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "h")).alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("doc"), "digest", "least", "n", "bands"), "classes")
    keyed = classes.select("doc", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = cut(keyed.join(shared, "key"), "members")
    degree = members.groupBy("doc").agg(F.sum(F.col("c") - 1).alias("deg"))
    open_rows = cut(members.join(degree, "doc").select("key", "doc", "n", "deg", F.col("doc").alias("comp")), "open")
    wanted = classes.select("doc", "least.*").join(degree.select("doc"), "doc")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_hash(text).alias("h"), as_bytes(text).alias("text"))
    texts = cut(texts.join(wanted, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select(F.col("doc").alias("id"), "text"), "texts")

    alike = lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)  # noqa: E731  sets of too different sizes can't reach it
    per = open_rows.groupBy("key").agg(F.max(F.struct("deg", "doc", "n")).alias("top"))
    pairs = open_rows.join(per, "key").where("doc <> top.doc").where(alike(F.col("n"), F.col("top.n")))
    pairs = cut(pairs.select(F.least("doc", "top.doc").alias("a"), F.greatest("doc", "top.doc").alias("b")).distinct(), "pairs")
    links = cut(confirmed(pairs, texts, percent), "links")
    joined = components(links)
    open_rows = open_rows.select("key", "doc", "deg").join(joined, open_rows["doc"] == joined["id"], "left").select("key", "doc", "deg", F.coalesce("component", "doc").alias("comp"))
    per = open_rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("deg", "doc")).alias("top")).where("lo <> hi")
    left = cut(open_rows.join(per.select("key", "top"), "key").select("doc", "comp", "deg", F.col("top.doc").alias("top")), "left")
    if not left.isEmpty():
        links = links.unionByName(family_links(left, texts, percent, part_docs, part_items))
        joined = components(cut(links, "links"))
    named = joined.join(classes.select(F.col("doc").alias("id"), F.col("least.doc_id").alias("first")), "id")
    named = named.join(named.groupBy("component").agg(F.min("first").alias("component_id")), "component").select(F.col("id").alias("doc"), "component", "component_id")
    by_class = classes.select("digest", "doc", "least").join(named, "doc", "left").select("digest", F.coalesce("component", "doc").alias("group"), F.coalesce("component_id", "least.doc_id").alias("component_id"))
    with_id = all_docs.where("digest is not null and doc_id is not null").join(by_class, "digest", "left").select("doc_id", "n_shingles", "component_id", "h", "group")
    none = all_docs.where("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "h", F.lit(None).cast("long").alias("group"))
    out = with_id.unionByName(none).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("h").alias("text_hash"), "group")
    return out if detail else out.drop("text_hash", "group")
