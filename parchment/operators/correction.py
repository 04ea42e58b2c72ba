"""Correction of selected text by a dictionary: safe repairs are made, guesses are only proposed."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.functions import matching as M
from parchment.sources.scratch import staged

#: A result below the first is uncertain; floors for guesses of a word and of the whole selection, and the lengths for which these are made;
#: how sure each kind of repair is.
SURE, WORD_FLOOR, WHOLE_FLOOR = 0.9, 0.75, 0.6
LEAST_WORD, WHOLE_LENGTHS = 4, (5, 40)
REPAIRS = {"hyphenation_repair": 0.95, "hyphen_kept": 0.85, "ligature_expansion": 0.99, "unicode_normalization": 0.97, "whitespace_repair": 0.97, "split_word_repair": 0.97}
#: A hyphen at a line break, and signs that stand for several letters.
BREAK = regex.compile(r"(\p{L}+)-[ \t]*\n[ \t]*(\p{Ll}\p{L}*)")
HEAD = regex.compile(r"([\p{L}\p{N}]*)(.*)", regex.S)
JUNK = regex.compile(r"[^\p{L}\p{N}]")
LIGATURES = frozenset("ﬀﬁﬂﬃﬄﬅﬆ")
#: A vocabulary of up to so many words goes to every worker; a larger one is joined.
MAX_WORDS = 500_000


class Dictionary:
    """Known words in order; of equally near ones the first is proposed."""

    def __init__(self, words: Iterable[str]):
        self.words = list(dict.fromkeys(w.lower() for w in words))
        self.known, self.memo = frozenset(self.words), {}
        self.by_length: dict[int, list[tuple[int, str]]] = {}
        for k, w in enumerate(self.words):
            self.by_length.setdefault(len(w), []).append((k, w))

    def __contains__(self, word: str) -> bool:
        return word.lower() in self.known

    def nearest(self, word: str, floor: float) -> tuple[str, float] | None:
        """The nearest word at or above the floor."""
        word = word.lower()
        if (word, floor) not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            gap = int(max(3, len(word) * 0.5))
            best = (floor, 1, None)
            for n in range(len(word) - gap, len(word) + gap + 1):
                for k, w in self.by_length.get(n, ()):
                    if not M.opposite(word, w) and (s := M.similarity(word, w, best[0])) >= best[0] and s > 0:
                        best = max(best, (s, -k, w), key=lambda x: x[:2]) if best[2] else (s, -k, w)
            self.memo[word, floor] = best[2] and (best[2], best[0])
        return self.memo[word, floor]


class Looked:
    """What is known of the terms of one text: the words among them, and the nearest word at or above each floor."""

    def __init__(self, known: Iterable[str], near: Iterable[tuple[str, float, str, float]]):
        self.known, self.near = frozenset(known), {(term, floor): (word, sure) for term, floor, word, sure in near}

    def __contains__(self, word: str) -> bool:
        return word.lower() in self.known

    def nearest(self, word: str, floor: float) -> tuple[str, float] | None:
        return self.near.get((word.lower(), floor))


class _Asking(Looked):
    """Notes what a correction asks for, and knows nothing."""

    def __init__(self):
        super().__init__((), ())
        self.terms: set[str] = set()

    def __contains__(self, word: str) -> bool:
        self.terms.add(word.lower())
        return False

    def nearest(self, word: str, floor: float) -> None:
        self.terms.add(word.lower())


def terms_of(text: str | None) -> set[str]:
    """All that correct() may ask a dictionary of a text: whatever it knows, the words, neighbours joined, and the whole."""
    asking = _Asking()
    correct(text, asking)
    flat = M.Folded(BREAK.sub(lambda m: m[1] + m[2], text or "")).text  # as it stands where all hyphens are joined
    for variant in (flat, M.Folded(text or "").text):
        bare = [JUNK.sub("", w).lower() for w in variant.split(" ")]
        asking.terms.update(bare)
        asking.terms.update(a + HEAD.match(b)[1].lower() for a, b in zip(bare, variant.split(" ")[1:]))
        asking.terms.update(HEAD.match(b)[1].lower() for b in variant.split(" "))
    whole = "".join(JUNK.sub("", w) for w in flat.split(" ")).lower()
    if WHOLE_LENGTHS[0] <= len(whole) <= WHOLE_LENGTHS[1]:
        asking.terms.add(whole)
    return asking.terms - {""}


def correct(text: str | None, words: Dictionary | Looked) -> dict:
    """Hyphens at line breaks, folding and white space, split words; then guesses for unknown words, and for the whole if nothing else
    was found. Blank and null texts come back empty with confidence 1."""
    if not text or not text.strip():
        return {"corrected": "", "confidence": 1.0, "uncertain": False, "changes": [], "candidates": []}
    changes: list[tuple[str, str, str, float]] = []

    def rejoin(m):
        known = m[1] + m[2] in words
        to = m[1] + m[2] if known else f"{m[1]}-{m[2]}"
        changes.append((m[0], to, "hyphenation_repair", REPAIRS["hyphenation_repair" if known else "hyphen_kept"]))
        return to

    joined = BREAK.sub(rejoin, text)
    flat = M.Folded(joined).text
    if not LIGATURES.isdisjoint(joined):
        changes.append((joined, flat, "ligature_expansion", REPAIRS["ligature_expansion"]))
    elif flat != regex.sub(r"\s+", " ", joined).strip() and not joined.isascii():
        changes.append((joined, flat, "unicode_normalization", REPAIRS["unicode_normalization"]))
    if regex.search(r"\s{2,}|\t|\n", joined):
        changes.append((joined, flat, "whitespace_repair", REPAIRS["whitespace_repair"]))

    parts, out, i = flat.split(" "), [], 0
    while i < len(parts):
        a = JUNK.sub("", parts[i])
        b, tail = HEAD.match(parts[i + 1]).groups() if i + 1 < len(parts) else ("", "")
        if a and b and a + b in words and not (a in words and b in words):
            out.append(a + b + tail)
            changes.append((f"{parts[i]} {parts[i + 1]}", out[-1], "split_word_repair", REPAIRS["split_word_repair"]))
            i += 2
        else:
            out.append(parts[i])
            i += 1
    fixed = " ".join(out)

    bare = [(w, JUNK.sub("", w)) for w in out]
    unknown = [(w, c) for w, c in bare if c and c not in words]
    candidates = [(w, *near) for w, c in unknown if len(c) >= LEAST_WORD and (near := words.nearest(c, WORD_FLOOR))]
    # A selection with no word at all has no known words either, so it may be matched as a whole.
    open_ = bool(unknown) or not any(c for _, c in bare)
    whole = JUNK.sub("", fixed).lower()
    if not changes and not candidates and open_ and WHOLE_LENGTHS[0] <= len(whole) <= WHOLE_LENGTHS[1] and (near := words.nearest(whole, WHOLE_FLOOR)):
        if near[1] >= SURE:
            changes.append((text, near[0], "fuzzy_dictionary_match", near[1]))
            fixed = near[0]
        else:
            candidates.append((text, *near))
    confidence = min(c[3] for c in changes) if changes else candidates[0][2] if candidates else 1.0
    return {"corrected": fixed, "confidence": confidence, "uncertain": confidence < SURE, "changes": changes, "candidates": sorted(candidates, key=lambda c: -c[2])}


def _looked_up(rows: DataFrame, text: str, vocabulary: DataFrame, chunk_words: int) -> DataFrame:
    """rows(_row, ...) with `known` and `near` for the terms of each text, by joins: terms with the vocabulary, and unknown ones, each once, with every
    chunk of it."""
    terms = F.pandas_udf(lambda texts: texts.map(lambda t: sorted(terms_of(t))), "array<string>")
    asked = staged(rows.select("_row", F.explode(terms(F.col(text))).alias("term")), "terms")
    known = asked.select("term").distinct().join(vocabulary, F.col("term") == F.col("word"), "left_semi").withColumn("is_word", F.lit(True))
    chunks = max(1, -(-vocabulary.count() // chunk_words))
    unknown = asked.select("term").distinct().join(known, "term", "left_anti").where(F.length("term").between(LEAST_WORD, WHOLE_LENGTHS[1])).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    parts = vocabulary.withColumn("chunk", F.pmod(F.xxhash64("word"), F.lit(chunks)).cast("int"))
    shares = max(1, -(-unknown.count() // 20_000))
    share = F.pmod(F.xxhash64("term"), F.lit(shares)).cast("int")

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        words = Dictionary(sorted(right["word"]))
        found = [(t, floor, *near) for t in left["term"] for floor in (WORD_FLOOR, WHOLE_FLOOR) if (near := words.nearest(t, floor))]
        return pd.DataFrame(found, columns=["term", "floor", "word", "sure"])

    spread = parts.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    near = unknown.withColumn("share", share).groupBy("chunk", "share").cogroup(spread.groupBy("chunk", "share")).applyInPandas(nearest, "term string, floor double, word string, sure double")
    near = near.groupBy("term", "floor").agg(F.max("sure").alias("sure"), F.min_by("word", F.struct(-F.col("sure"), "word")).alias("word")).groupBy("term").agg(F.collect_list(F.struct("term", "floor", "word", "sure")).alias("near"))
    of_row = asked.join(known, "term", "left").join(near, "term", "left").groupBy("_row").agg(F.collect_list(F.when(F.col("is_word"), F.col("term"))).alias("known"), F.flatten(F.collect_list("near")).alias("near"))
    return rows.join(of_row, "_row", "left")


def correct_texts(rows: DataFrame, key: str, text: str, vocabulary: DataFrame, word: str = "word", most: int = MAX_WORDS) -> DataFrame:
    """One row per text: key, corrected, confidence, uncertain, n_changes, change_types, candidates. A vocabulary of up to `most` words is read once on the
    driver, in order of `word`, and sent to every worker; a larger one is joined with what the texts ask of it, to the same results."""
    named = vocabulary.select(F.lower(word).alias("word")).where("word is not null").distinct()
    found = [r[0] for r in named.orderBy("word").limit(most + 1).collect()]
    large = len(found) > most
    shared = rows.sparkSession.sparkContext.broadcast([] if large else found)

    def run(batches):
        words = Dictionary(shared.value)
        for b in batches:
            if large:
                known = ([t for t in k] if k is not None else [] for k in b["known"])
                near = ([(n["term"], n["floor"], n["word"], n["sure"]) for n in x] if x is not None else [] for x in b["near"])
                done = [correct(t, Looked(k, n)) for t, k, n in zip(b[text], known, near)]
            else:
                done = [correct(t, words) for t in b[text]]
            yield pd.DataFrame({key: b[key], "corrected": [d["corrected"] for d in done], "confidence": [d["confidence"] for d in done], "uncertain": [d["uncertain"] for d in done],
                                "n_changes": [len(d["changes"]) for d in done], "change_types": ["|".join(c[2] for c in d["changes"]) for d in done], "candidates": ["|".join(c[1] for c in d["candidates"]) for d in done]})

    kind = dict(rows.dtypes)[key]
    rows = rows.select(key, text)
    if large:
        rows = _looked_up(staged(rows.withColumn("_row", F.monotonically_increasing_id()), "texts"), text, named, most).select(key, text, "known", "near")
    return rows.mapInPandas(run, f"`{key}` {kind}, corrected string, confidence double, uncertain boolean, n_changes int, change_types string, candidates string")
