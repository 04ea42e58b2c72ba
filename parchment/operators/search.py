"""Tolerant search of pages: exact, any case, without spaces, Greek by name; else word by word; else nearly alike."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parchment.functions import matching as M
from parchment.functions import text as T
from parchment.operators.page_index import indexed, through, with_items
from parchment.sources.scratch import staged

#: How sure a match of each stage is; below the last, one that is nearly alike does not count.
CONFIDENCE = {"exact": 1.0, "case_insensitive": 0.97, "compact": 0.93, "alias": 0.9, "token": 0.85}
FUZZY_FLOOR = 0.75

Hit = tuple[str, float, int, int, str]


def occurrences(text: str, needle: str) -> Iterator[int]:
    """Starts of occurrences that do not overlap."""
    at = text.find(needle) if needle else -1
    while at >= 0:
        yield at
        at = text.find(needle, at + len(needle))


def window_sizes(n: int) -> range:
    """How many words of a page are held against a query of n words."""
    more = 4 if n <= 2 else 2 if n <= 5 else 1
    return range(max(1, n - 1), n + more + 1)


class Query:
    def __init__(self, query: str):
        folded = M.Folded(query)
        self.text, self.compact = folded.text, M.lower_each(folded.compact)
        self.lower, self.alias = M.lower_each(folded.text), M.named_greek(M.lower_each(folded.compact))[0]
        self.words = [w for w, _, _ in folded.tokens()]


#: A hit within a page: stage, confidence, form of the text (normal or compact), start and end in it.
Found = tuple[str, float, str, int, int]


def exact_hits(normal: str, compact: str, q: Query) -> list[Found]:
    """Hits of the first stage that has any."""
    for stage, text, needle in (("exact", normal, q.text), ("case_insensitive", M.lower_each(normal), q.lower)):
        if found := [(stage, CONFIDENCE[stage], "normal", k, k + len(needle)) for k in occurrences(text, needle)]:
            return found
    low = M.lower_each(compact)
    if found := [("compact", CONFIDENCE["compact"], "compact", k, k + len(q.compact)) for k in occurrences(low, q.compact)]:
        return found
    named, at = M.named_greek(low) if q.alias and ("-" in low or not M.GREEK.keys().isdisjoint(low)) else ("", [])
    return [("alias", CONFIDENCE["alias"], "compact", at[k], at[k + len(q.alias) - 1] + 1) for k in occurrences(named, q.alias)]


Token = tuple[str, int, int]


def tokens_of(normal: str) -> list[Token]:
    """Lower-case words with their places."""
    return [(m[0].lower(), *m.span()) for m in M.TOKEN.finditer(normal)]


def token_hits(words: list[Token], q: Query) -> list[Found]:
    """Runs of words that, joined, are the query's words joined."""
    whole, found = "".join(q.words), []
    for i in range(len(words) if whole else 0):
        if not whole.startswith(words[i][0]):
            continue
        joined, j = "", i
        while j < len(words) and len(joined) < len(whole):
            joined += words[j][0]
            j += 1
        if joined == whole:
            found.append(("token", CONFIDENCE["token"], "normal", words[i][1], words[j - 1][2]))
    return found


def window_candidates(pages: list[list[Token]], q: Query, floor: float) -> Iterator[tuple[int, int, str]]:
    """(first word, number of words, words joined) of the windows of all pages, numbered through, that may be nearly alike: by their length, and by the letters, as scans
    read them, that they share with the query. A distance is at least what the longer text has beyond the common letters, so no window is lost. Sums of letters up to
    each word are made once for all windows; one that begins or ends inside a pair that scans confuse is not judged by them."""
    words = [w for p in pages for w, _, _ in p]
    joined = "".join(words)
    ends = np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]
    page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    after = np.r_[codes[1:], 0].astype(np.uint32)
    wide = np.ones(len(codes), np.int64)  # signs that a sign adds to the text as scans read it: none for the second of a pair
    seen = codes.copy()
    inside = np.zeros(len(codes) + 1, bool)  # whether a cut before this sign parts a pair
    for pair, one in M.SCANS:
        first = np.flatnonzero((codes == ord(pair[0])) & (after == ord(pair[1])))
        inside[first + 1] = True
        if pair[0] == pair[1]:
            run = np.cumsum(np.r_[True, np.diff(first) > 1])[: len(first)]
            start = np.r_[0, np.flatnonzero(np.diff(run)) + 1][run - 1] if len(first) else first
            first = first[(np.arange(len(first)) - start) % 2 == 0]
        seen[first] = ord(one)
        wide[first + 1] = 0
        seen[first + 1] = 0
    for a, b in zip("lio", "110"):
        seen[seen == ord(a)] = ord(b)
    own = M.bag(q.compact)
    length = np.r_[0, np.cumsum(wide)][ends]
    letters = {x: np.r_[0, np.cumsum(seen == ord(x))][ends] for x in own}
    room, total = max(4, len(q.compact) * 0.5), own.total()
    for size in window_sizes(len(q.words)):
        i = np.arange(max(0, len(words) - size + 1))
        n = ends[i + size] - ends[i]
        i = i[(np.abs(n - len(q.compact)) <= room) & (page[i] == page[i + size - 1])]
        common = sum((np.minimum(letters[x][i + size] - letters[x][i], k) for x, k in own.items()), np.zeros(len(i), np.int64))
        least = np.maximum(total, length[i + size] - length[i]) - common
        longest = np.maximum(ends[i + size] - ends[i], max(len(q.compact), 1))
        cut = inside[ends[i]] | inside[ends[i + size]]
        for k in i[cut | (least <= (1 - floor) * longest + 1e-9)].tolist():
            yield k, size, joined[ends[k] : ends[k + size]]


def fuzzy_hits(pages: list[list[Token]], q: Query, floor: float) -> list[list[Found]]:
    """For each page, windows of words nearly like the query; not where a prefix or a negation turns the meaning round. Each different window is compared once, all
    of a batch at the same time."""
    out: list[list[Found]] = [[] for _ in pages]
    if not q.words:
        return out
    found = list(window_candidates(pages, q, floor))
    texts = list({t for _, _, t in found})
    sure = dict(zip(texts, M.similarities(q.compact, texts), strict=True))
    begins = np.cumsum([0] + [len(p) for p in pages])
    for k, size, text in found:
        if sure[text] >= floor and not M.opposite(q.compact, text):
            p = int(np.searchsorted(begins, k, side="right")) - 1
            window = pages[p][k - begins[p] : k - begins[p] + size]
            if not M.negation_differs(q.words, [w for w, _, _ in window]):
                out[p].append(("fuzzy", sure[text], "normal", window[0][1], window[-1][2]))
    return out


def without_overlaps(hits: list[Hit]) -> list[Hit]:
    """The surest first; of equals the one found first. In order of place."""
    kept: list[Hit] = []
    for h in sorted(hits, key=lambda h: -h[1]):
        if all(h[2] >= k[3] or h[3] <= k[2] for k in kept):
            kept.append(h)
    return sorted(kept, key=lambda h: h[2])


def search_batch(texts: list[str | None], q: Query, fuzzy: bool = True, always_fuzzy: bool = False, floor: float = FUZZY_FLOOR) -> list[list[Hit]]:
    """The hits of each text, in order of place."""
    texts = [t or "" for t in texts]
    out: list[list[Hit]] = [[] for _ in texts]
    if not q.text.strip():
        return out
    normal, compact, normal_map, compact_map = indexed(texts)
    forms = {"normal": normal.to_pylist(), "compact": compact.to_pylist()}
    hits = [exact_hits(a, b, q) for a, b in zip(forms["normal"], forms["compact"], strict=True)]
    words = {i: tokens_of(forms["normal"][i]) for i, h in enumerate(hits) if not h or (fuzzy and always_fuzzy)}
    for i in words:
        hits[i] = hits[i] or token_hits(words[i], q)
    late = [i for i in words if fuzzy and (always_fuzzy or not hits[i])]
    for i, more in zip(late, fuzzy_hits([words[i] for i in late], q, floor), strict=True):
        hits[i] = hits[i] + more
    for form, maps in (("normal", (normal_map,)), ("compact", (compact_map, normal_map))):
        some = [(i, h) for i, page in enumerate(hits) for h in page if h[2] == form]
        doc, start, end = (np.array(x, np.int64) for x in ([i for i, _ in some], [h[3] for _, h in some], [h[4] for _, h in some]))
        for segments in maps:
            start, end, _ = through(segments, doc, start, end)
        for (i, h), a, b in zip(some, start.tolist(), end.tolist(), strict=True):
            out[i].append((h[0], h[1], a, b, forms[form][i][h[3] : h[4]]))
    return [without_overlaps(page) for page in out]


def search_text(text: str | None, q: Query, **options) -> list[Hit]:
    return search_batch([text], q, **options)[0]


def search_pages(pages: DataFrame, key: str, text: str, query: str, **options) -> DataFrame:
    """One row per hit: key, stage, confidence, start and end (code points of the original), matched. A map over pages: no shuffle,
    only two columns read. Null and empty texts and blank queries have no hits."""
    q = Query(query)

    def run(batches):
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            at = 0
            while at < len(sizes):  # about a megabyte at a time
                to, held = at + 1, sizes[at]
                while to < len(sizes) and held + sizes[to] <= 1 << 20:
                    held += sizes[to]
                    to += 1
                found = search_batch(batch.column(1)[at:to].to_pylist(), q, **options)
                rows = [(at + i, *h) for i, page in enumerate(found) for h in page]
                columns = list(zip(*rows)) or [()] * 6
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], [key, "stage", "confidence", "start", "end", "matched"])
                at = to

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, text).mapInArrow(run, f"`{key}` {kind}, stage string, confidence double, start long, end long, matched string")


def first_hits(pages: DataFrame, key: str, text: str, query: str, most: int = 50, wave: int = 256, **options) -> DataFrame:
    """The hits of a reader who goes through pages in order of `key` and stops after the page with which `most` hits are reached; of these the `most` surest, then by page and place. Pages
    are searched in waves, each eight times as many as the one before, so what is read beyond the last page is bounded by eight times what had to be read; a wave's hits
    are written once and counted. Pages with a null key come last."""
    found, total, last = None, 0, None
    while total < most:
        left = pages.where(F.col(key).isNotNull()) if last is None else pages.where(F.col(key) > F.lit(last))
        edge = left.select(key).orderBy(key).limit(wave).agg(F.max(key).alias("last"), F.count("*").alias("n")).first()
        end = edge["n"] < wave
        part = left if end else left.where(F.col(key) <= F.lit(edge["last"]))
        if end:
            part = part.unionByName(pages.where(F.col(key).isNull()))
        hits = staged(search_pages(part, key, text, query, **options), "wave")
        found = hits if found is None else found.unionByName(hits)
        total, last, wave = total + hits.count(), edge["last"], wave * 8
        if end:
            break
    counts = found.groupBy(key).agg(F.count("*").alias("_n")).orderBy(F.asc_nulls_last(key)).limit(most)  # at most `most` rows from here on
    before = F.coalesce(F.sum("_n").over(Window.orderBy(F.asc_nulls_last(key)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    read = counts.withColumn("_before", before).where(F.col("_before") < most).select(F.col(key).alias("_key"))
    kept = found.join(F.broadcast(read), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    return kept.orderBy(F.desc("confidence"), F.asc_nulls_last(key), "start").limit(most)


def hits_with_items(hits: DataFrame, pages: DataFrame, key: str, items: str) -> DataFrame:
    """hits with `items`, the items of their page (a column of pages, array<struct<item, start, end>>) that they touch and the part of each: see page_index.with_items. One join by
    page: hits of a page are put together, its items are not repeated for each."""
    own = [c for c in hits.columns if c != key]
    packed = hits.groupBy(key).agg(F.collect_list(F.struct(*own)).alias("hits"))
    rows = packed.join(pages.select(key, F.col(items).alias("page_items")), key)
    found = with_items(rows.withColumn("ranges", F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end")))), "ranges", "page_items", "items", keep=[key, "hits"])
    return found.select(key, F.explode(F.arrays_zip("hits", "items")).alias("_z")).select(key, "_z.hits.*", "_z.items")


def top_hits(hits: DataFrame, key: str, n: int = 50) -> DataFrame:
    """The surest hits over all pages, then by page and place."""
    return hits.orderBy(F.desc("confidence"), key, "start").limit(n)


def exact_stage(text: Column, query: str) -> Column:
    """The first of exact, case_insensitive and compact that hits a text without ligatures and the like, inside the JVM; else null."""
    q = Query(query)
    flat = T.collapse(text)
    return F.when(flat.contains(q.text), "exact").when(F.lower(flat).contains(q.lower), "case_insensitive").when(F.lower(T.compact(text)).contains(q.compact), "compact")
